"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then dropped into one
leaf of each tree.  A query walks all trees through one shared priority queue: the
node whose worst margin on its path is best comes next, until the leaves met hold
enough candidates.  Candidates are ranked again by exact distance.

How many leaves are enough is measured on the table itself: the exact neighbours of a
bounded sample of its queries are found by brute force, and all queries open as many
leaves as hold a share RECALL of those.

Equal vectors are one class in index and search, so a vector that a third of all
rows share is searched once; a class gives its k + 1 smallest ids, which is all
that any result can hold of it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import require, shared_folder, stored

#: Share of the sampled queries' true neighbours that must be met: 0.9 and a margin for the sample's error.
RECALL = 0.95
#: Queries whose true neighbours are found by brute force.
PROBES = 64


@dataclass(frozen=True)
class Forest:
    """trees; leaf: vectors of a leaf over the whole table, as far as the sample allows (at
    least 4 sampled vectors a leaf); entries: leaf entries that a query opens over all trees
    at least; more where the recall measured on the table asks for them; sample: bound of the rows that
    the trees are fitted on; block: vectors that are ranked again together."""

    trees: int = 64
    leaf: int = 64
    entries: int = 24_000
    sample: int = 32_768
    block: int = 2048
    seed: int = 11


@dataclass
class Tree:
    """Inner node j: planes[j] and offsets[j], children[j] (left, right); a child < 0 is leaf -child - 1."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), "int64") if len(self.planes) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            j = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.planes[j]) > self.offsets[j]).astype("int64")
            at[inner] = self.children[j, side]
        return -at - 1


def grown(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """One tree: each plane lies halfway between two random members of its node; if those
    split badly, a random direction is cut at the median."""
    planes, offsets, children, leaves = [], [], [], 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) <= leaf:
            leaves += 1
            return -leaves
        for attempt in range(4):
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = b - a if attempt < 3 else rng.normal(size=x.shape[1])
            norm = np.linalg.norm(plane)
            if not norm:
                continue
            plane = plane / norm
            at = x[rows] @ plane
            offset = float((a + b) @ plane / 2) if attempt < 3 else float(np.median(at))
            right = at > offset
            if 0.1 < right.mean() < 0.9 or attempt == 3 and 0 < right.sum() < len(rows):
                j = len(planes)
                planes.append(plane)
                offsets.append(offset)
                children.append([0, 0])
                children[j][0] = split(rows[~right])
                children[j][1] = split(rows[right])
                return j
        leaves += 1
        return -leaves

    split(np.arange(len(x)))
    return Tree(np.array(planes, "f4").reshape(-1, x.shape[1]), np.array(offsets, "f4"), np.array(children, "int64").reshape(-1, 2), leaves)


def visits(forest: list[Tree], x: np.ndarray) -> Iterator[tuple[int, int]]:
    """All (tree, leaf), from one queue over all trees, best margin first."""
    margins = [t.planes @ x - t.offsets for t in forest]
    queue = [(-np.inf, i, 0 if len(t.planes) else -1) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    while queue:
        worst, tree, node = heapq.heappop(queue)  # worst: how far beyond a plane the path went, 0 or less if never
        if node < 0:
            yield tree, -node - 1
            continue
        m, (left, right) = float(margins[tree][node]), forest[tree].children[node]
        heapq.heappush(queue, (max(worst, m), tree, int(left)))
        heapq.heappush(queue, (max(worst, -m), tree, int(right)))


def search(forest: list[Tree], x: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The first ``leaves`` (tree, leaf) met."""
    return list(islice(visits(forest, x), leaves))


def met_after(forest: list[Tree], x: np.ndarray, wanted: np.ndarray) -> list[int]:
    """For each wanted vector the number of leaves that a search from ``x`` opens until it meets the vector."""
    at: dict[tuple[int, int], list[int]] = {}
    for i, t in enumerate(forest):
        for number, leaf in enumerate(t.leaf_of(wanted)):
            at.setdefault((i, int(leaf)), []).append(number)
    out: dict[int, int] = {}
    for n, leaf in enumerate(visits(forest, x), 1):
        for number in at.get(leaf, ()):
            out.setdefault(number, n)
        if len(out) == len(wanted):
            break
    return list(out.values())


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _vectors(pairs: DataFrame, classes: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """For each block its vectors, and those of the queries that meet it."""
    own = classes.select(F.pmod("class", F.lit(blocks)).alias("block"), F.lit(False).alias("is_query"), F.col("class").alias("id"), "smallest", "v")
    guests = pairs.select("block", F.col("query").alias("class")).distinct().join(asked, "class")
    return own.unionByName(guests.select("block", F.lit(True).alias("is_query"), F.col("class").alias("id"), "smallest", "v"))


def ranked(pairs: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """Exact distances of one block's pairs; the ``k`` nearest of each query."""
    asks, ids = vectors["is_query"].to_numpy(), vectors["id"].to_numpy()
    smallest, x = vectors["smallest"].to_numpy(), _matrix(vectors["v"].combine_chunks())

    def place(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        rows = rows[np.argsort(ids[rows])]
        return rows[np.searchsorted(ids[rows], wanted)]

    query, found = pairs["query"].to_numpy(), pairs["class"].to_numpy()
    out: tuple = ([], [], [], [])
    if len(query):
        a, b = place(np.flatnonzero(asks), query), place(np.flatnonzero(~asks), found)
        score = np.empty(len(a))
        for i in range(0, len(a), 65_536):
            score[i:i + 65_536] = np.sqrt(((x[a[i:i + 65_536]] - x[b[i:i + 65_536]]) ** 2).sum(axis=1))
        order = np.lexsort((smallest[b], score, query))
        start = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - start < k]
        out = query[order], found[order], smallest[b[order]], score[order]
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query", "class", "smallest", "score"])


def leaves_needed(classes: DataFrame, forest, k: int) -> int:
    """Leaves that hold a share RECALL of the ``k`` nearest classes of at most PROBES asked classes."""
    spark = classes.sparkSession
    probes = classes.filter("asks").orderBy(F.xxhash64("class", F.lit(1))).limit(PROBES).select("class", "v").toArrow()
    if not len(probes):
        return 0
    asked, x = probes["class"].to_numpy(), _matrix(probes["v"].combine_chunks())
    schema = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("class", pa.int64()), ("v", pa.list_(pa.float64()))])

    def nearest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, "int64"), np.zeros((0, x.shape[1]))) for _ in asked]
        for batch in batches:
            ids, y = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if not len(ids):
                continue
            for q in range(len(asked)):
                score = ((y - x[q]) ** 2).sum(axis=1)
                score[ids == asked[q]] = np.inf
                near = np.argpartition(score, min(k, len(ids)) - 1)[:k]
                near = near[np.isfinite(score[near])]
                score, found, v = (np.concatenate(c) for c in zip(best[q], (score[near], ids[near], y[near])))
                order = np.argsort(score)[:k]
                best[q] = score[order], found[order], v[order]
        for q, (score, found, v) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), pa.array(score), pa.array(found), pa.array(list(v), pa.list_(pa.float64()))], schema=schema)

    near = classes.select("class", "v").mapInArrow(nearest_of_task, "query long, score double, class long, v array<double>")
    near = near.withColumn("place", F.expr("row_number() over (partition by query order by score, class)")).filter(f"place <= {k}")
    # at most PROBES * k rows
    near = near.select("query", "v").toArrow()
    query, wanted = near["query"].to_numpy(), _matrix(near["v"].combine_chunks())

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.column(0).to_numpy():
                if (query == q).any():
                    yield pa.RecordBatch.from_arrays([pa.array(met_after(forest.value, x[q], wanted[query == q]), pa.int64())], ["leaves"])

    n = np.sort(spark.range(0, len(asked), 1, min(16, len(asked))).mapInArrow(walked, "leaves long").toArrow()["leaves"].to_numpy())
    return int(n[math.ceil(RECALL * len(n)) - 1]) if len(n) else 0


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not zero and hold only finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, params: Forest = Forest(), vec_id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found rows for each row that ``queries`` selects, but itself, by
    Euclidean distance in double precision: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id.  Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows with a null id or of another length than the
    usable vector of the smallest id has.  Of rows repeated with id and vector one is
    used; an id with two vectors is two candidates and, as a query, two queries.
    """
    require(vectors, vec_id, vector)
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows = rows.withColumn("class", F.xxhash64("v"))
    width = rows.groupBy().agg(F.min_by(F.size("v"), "id").alias("n")).first().n
    folder = shared_folder(spark)
    rows = rows.filter(F.size("v") == F.lit(width or 0))
    members = rows.groupBy("class", "id").agg(F.max("asks").alias("asks"), F.any_value("v").alias("v"))
    classes = stored(members.groupBy("class").agg(F.any_value("v").alias("v"), F.max("asks").alias("asks"), F.min("id").alias("smallest")), folder, "classes")
    n = classes.count()
    # bounded: at most params.sample vectors reach the driver, and the trees made of them the tasks
    sample = classes.orderBy(F.xxhash64("class")).limit(params.sample).select("v").toArrow()["v"].combine_chunks()
    x, rng = _matrix(sample), np.random.default_rng(params.seed)
    leaf = max(4, min(params.leaf, params.leaf * len(x) // max(n, 1)))
    forest = spark.sparkContext.broadcast([grown(x, leaf, rng) for _ in range(params.trees)])
    mean_leaf = max(1.0, n * params.trees / max(1, sum(t.leaves for t in forest.value)))
    opened = max(params.trees, round(params.entries / mean_leaf))
    if opened < sum(t.leaves for t in forest.value):
        opened = max(opened, leaves_needed(classes, forest, k))

    @F.arrow_udf("array<int>")
    def leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = forest.value
        base = np.cumsum([0] + [t.leaves for t in trees])
        for v in batches:
            at = np.stack([t.leaf_of(_matrix(v)) + b for t, b in zip(trees, base)], axis=1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype="int32") * len(trees)), pa.array(at.ravel().astype("int32")))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        base = np.cumsum([0] + [t.leaves for t in trees])
        for batch in batches:
            for query, q in zip(batch.column(0).to_numpy(), _matrix(batch.column(1))):
                met = np.array([base[t] + leaf for t, leaf in search(trees, q, opened)], "int32")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), query)), pa.array(met)], ["query", "leaf"])

    index = classes.select("class", F.explode(leaves("v")).alias("leaf"))
    asked = classes.filter("asks")
    met = asked.select("class", "v").mapInArrow(visited, "query long, leaf int")
    pairs = met.join(index, "leaf").select("query", "class").distinct()

    pairs = pairs.withColumn("block", F.pmod("class", F.lit(max(1, n // params.block))))
    near = (pairs.groupBy("block").cogroup(_vectors(pairs, classes, asked, max(1, n // params.block)).groupBy("block"))
            .applyInArrow(lambda a, b: ranked(a, b, k + 1), "query long, class long, smallest long, score double"))
    near = near.withColumn("place", F.expr("row_number() over (partition by query order by score, smallest)")).filter(f"place <= {k + 1}")
    ids = members.select("class", "id").withColumn("nth", F.expr("row_number() over (partition by class order by id)")).filter(f"nth <= {k + 1}")
    near = near.join(ids, "class").select("query", "score", "id")
    # per query class the k + 1 best rows, of which each query leaves out itself
    near = near.withColumn("place", F.expr("row_number() over (partition by query order by score, id)")).filter(f"place <= {k + 1}")
    best = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("best"))
    asking = members.filter("asks").select(F.col("class").alias("query"), F.col("id").alias("query_id"))
    found = asking.join(best, "query").select("query_id", F.slice(F.filter("best", lambda b: b.id != F.col("query_id")), 1, k).alias("best"))
    return found.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
