"""Exact distinct counts of integer ids that merge.

A set of ids is held as bitmap words: one row for each 64 neighbouring ids with at least one
in the set.  Tasks make their words before the shuffle, so what moves is a row a word, not a
row for every (group, id); ids that lie close together share words.  Words of fine groups
merge into those of coarser ones by OR, so several levels come from one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_sets(df: DataFrame, groups: Sequence[str], id_: str) -> DataFrame:
    """The words (_word, _bits) of each group's set of ``id_``; a NULL id keeps its group, as an empty word."""
    # the shift count is an integer expression over the id: all of it stays in generated code
    ids = df.select(*groups, F.col(id_).cast("long").alias("_id"))
    return ids.groupBy(*groups, F.shiftright("_id", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_id & 63 as int)))").alias("_bits"))


def merged(sets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sets of coarser ``groups`` (columns of ``sets``)."""
    return sets.groupBy(*groups, "_word").agg(F.expr("bit_or(_bits)").alias("_bits"))


def set_sizes(sets: DataFrame, groups: Sequence[str], out: str) -> DataFrame:
    """COUNT(DISTINCT id) per group."""
    return sets.groupBy(*groups).agg(F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).cast("long").alias(out))


def count_distinct(df: DataFrame, groups: Sequence[str], id_: str, out: str) -> DataFrame:
    return set_sizes(id_sets(df, groups, id_), groups, out)
