"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, *extra: str) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, as (rank, label, text, extra...).

    The sample is the smallest hashes of the id, so it is the same in every run.  A
    document whose labels differ takes the largest; of rows that share an id one is taken,
    that of the smallest hash of its columns; null ids and labels are left out.
    """
    marked = (labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    rank = F.xxhash64(F.col("doc_id").cast("long"), F.lit(17))
    # bounded by ``rows``, so its ids can be broadcast
    picked = marked.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("rank", rank).orderBy("rank", "doc_id").limit(rows)
    # an id has one row, so there are at most ``rows`` of them
    row = F.min_by(F.struct("rank", "label", "text", *extra), F.struct(F.xxhash64("text", *extra), F.col("text")))
    found = docs.select("doc_id", "text", *extra).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(row.alias("row"))
    return found.select("row.*")


def fitted(sample: DataFrame, fit: Callable[[pa.Table], pa.RecordBatch], schema: str) -> list:
    """What ``fit`` makes of the whole sample (bounded by its number of ids), in one executor task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got and sum(len(b) for b in got):
            yield fit(pa.Table.from_batches(got).sort_by([("rank", "ascending"), ("text", "ascending")]).combine_chunks())

    return sample.coalesce(1).mapInArrow(run, schema).collect()
