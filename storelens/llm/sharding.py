"""Shards of near equal bytes by histogram sort.

Rows have the order (first 60 bits of the text's MD5, doc_id): equal texts stand
together, and a boundary may still fall inside a large group of copies.  Each
round counts exactly, over all partitions, the bytes and rows between candidate
boundaries; a cell that holds a shard boundary off by more than the tolerance, or
too many rows for one task, gets finer candidates in the next round.  When all
cells are settled, the rows go through one exchange by cell.  Only counts of cells
reach the driver: at most about 2**CELL_BITS a round, whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import free_name, require, shared_folder, stored

CELL_BITS = 17


@dataclass(order=True)
class Cell:
    """Rows between two neighbouring candidate boundaries. path: its place in the key order."""

    path: tuple[int, ...]
    id: int
    bytes: int
    rows: int
    low: tuple[int, int]
    high: tuple[int, int]


@dataclass
class Probe:
    """How one round cuts one cell: by key column ``axis`` into slices of 2**shift values."""

    cell: Cell
    axis: int
    shift: int
    base: int

    @property
    def first(self) -> int:
        return self.cell.low[self.axis] >> self.shift


def text_key(text: Column) -> Column:
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1))


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def placed(keys: DataFrame, rounds: list[list[Probe]], k: tuple[str, str], out: str) -> DataFrame:
    """``keys`` with the id of each row's cell after the given rounds."""
    keys = keys.withColumn(out, F.lit(0).cast("long"))
    for probes in rounds:
        def pick(values, at, kind="bigint"):
            return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), at)

        at = free_name(keys, "_at")
        keys = keys.withColumn(at, F.array_position(F.array(*[F.lit(p.cell.id).cast("long") for p in probes]), F.col(out)).cast("int"))
        found = F.nullif(F.col(at), F.lit(0))
        axis = F.when(pick([p.axis for p in probes], found) == 0, F.col(k[0])).otherwise(F.col(k[1]))
        slot = F.call_function("shiftright", axis, pick([p.shift for p in probes], found, "int"))
        inside = slot - pick([p.first for p in probes], found) + pick([p.base for p in probes], found)
        keys = keys.withColumn(out, F.when(F.col(at) > 0, inside).otherwise(F.col(out))).drop(at)
    return keys


def unsettled(cells: list[Cell], total: int, shards: int, tolerance: float, most_rows: int) -> list[Cell]:
    out, before = [], 0
    for c in cells:
        over = (before + c.bytes) * shards - (before * shards // total + 1) * total
        if c.low != c.high and (over > tolerance * total or c.rows > most_rows):
            out.append(c)
        before += c.bytes
    return out


def histogram(keys: DataFrame, shards: int, tolerance: float, cell_rows: int) -> tuple[list[Cell], list[list[Probe]]]:
    """Settled cells in key order, and the rounds of candidate boundaries that led to them."""
    measures = [F.sum("size"), F.count("*"), F.min("k1"), F.max("k1"), F.min("k2"), F.max("k2")]
    row = keys.agg(*measures).first()
    if not row[1]:
        return [], []
    cells, rounds, next_id = [Cell((), 0, row[0], row[1], (row[2], row[4]), (row[3], row[5]))], [], 1
    total, most_rows = row[0], max(cell_rows, row[1] >> (CELL_BITS - 1))
    while wide := unsettled(cells, total, shards, tolerance, most_rows):
        bits = max(1, min(CELL_BITS - 5 + 5 * (not rounds and row[1] > cell_rows << 10), CELL_BITS - math.ceil(math.log2(len(wide)))))
        probes = []
        for c in wide:
            axis = int(c.low[0] == c.high[0])  # one text only: its copies are told apart by doc_id
            shift = max(0, (c.high[axis] - c.low[axis]).bit_length() - bits)
            probes.append(Probe(c, axis, shift, next_id))
            next_id += (c.high[axis] >> shift) - (c.low[axis] >> shift) + 1
        rounds.append(probes)
        ends = [p.base for p in probes[1:]] + [next_id]
        counted = placed(keys, rounds, ("k1", "k2"), "cell").filter(F.col("cell") >= probes[0].base).groupBy("cell").agg(*measures)
        cut = {p.cell.id for p in probes}
        cells = [c for c in cells if c.id not in cut]
        owner = sorted(zip(ends, range(len(probes))))
        at = 0
        for r in sorted(map(tuple, counted.collect())):
            while r[0] >= owner[at][0]:
                at += 1
            p = probes[at]
            cells.append(Cell((*p.cell.path, r[0] - p.base), r[0], r[1], r[2], (r[3], r[5]), (r[4], r[6])))
        cells.sort()
    return cells, rounds


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, cell_rows: int = 250_000,
                     text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot``.

    Shard s holds the rows that begin in the s-th of ``shards`` equal parts of all
    bytes in key order; a boundary may be off by ``tolerance`` of a shard.  Slots
    are gapless from 0 in key order within a shard.  A null text counts as no bytes
    and comes first; a null doc_id counts as the smallest.  Rows equal in text and
    doc_id cannot be told apart: they share a cell, so a shard, and have slots in
    any order.  An empty table gives an empty one; columns named ``size``,
    ``shard`` or ``slot`` are replaced, others pass through.
    """
    require(docs, text, doc_id)
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot")
    k1, k2, cell, first = (free_name(docs, n) for n in ("_k1", "_k2", "_cell", "_first"))
    keyed = docs.withColumns({k1: text_key(F.col(f"`{text}`")),
                              k2: F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))),
                              "size": size_of(F.col(f"`{text}`"))})
    narrow = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "size")
    narrow = stored(narrow, shared_folder(spark), "keys")
    cells, rounds = histogram(narrow, shards, tolerance, cell_rows)
    table, before, counts = [], 0, {}
    total = sum(c.bytes for c in cells)
    for c in cells:
        shard = before * shards // total
        table.append((c.id, shard, counts.get(shard, 0)))
        counts[shard] = counts.get(shard, 0) + c.rows
        before += c.bytes
    places = spark.createDataFrame(pd.DataFrame(table, columns=[cell, "shard", first]).astype({cell: "int64", "shard": "int32", first: "int64"}),
                                   f"`{cell}` bigint, shard int, `{first}` bigint")
    # at most one row for each settled cell, some 2**CELL_BITS a round: bounded, so it can be broadcast
    rows = placed(keyed, rounds, (k1, k2), cell).join(F.broadcast(places), cell)
    number = F.expr(f"row_number() over (partition by `{cell}` order by `{k1}`, `{k2}`)")
    return rows.withColumn("slot", F.col(first) + number - 1).drop(k1, k2, cell, first)
