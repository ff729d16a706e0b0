import hashlib

import pytest

from storelens.llm.sharding import histogram_shards

ROWS = ([(i, "same") for i in range(600)] + [(1000 + i, "x" * (i % 37)) for i in range(500)]
        + [(None, None), (5000, None), (5001, ""), (None, "a"), (-1 << 63, "b"), ((1 << 63) - 1, "b"), (7, "long " * 20_000)])


def order(row):
    key = -1 if row[1] is None else int(hashlib.md5(row[1].encode()).hexdigest()[:15], 16)
    return key, -1 << 63 if row[0] is None else row[0]


def size(row):
    return 1 + len((row[1] or "").encode())


@pytest.mark.parametrize("shards, cell_rows", [(1, 10), (7, 50), (16, 250_000)])
def test_exact_boundaries(spark, shards, cell_rows):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).selectExpr("*", "'x' as shard", "1 as _cell", "2 as _at")
    got = {(r.doc_id, r.text): (r.shard, r.slot, r.size) for r in histogram_shards(df, shards, 0.0, cell_rows).collect()}
    total, before, counts, want = sum(map(size, ROWS)), 0, {}, {}
    for row in sorted(ROWS, key=order):
        s = before * shards // total
        want[row] = s, counts.get(s, 0), size(row)
        counts[s] = counts.get(s, 0) + 1
        before += size(row)
    assert got == want


def test_tolerance_and_repeats(spark):
    rows = [(i, f"text {i % 50} " + "y" * (i % 11)) for i in range(2000)] + [(1, "twin")] * 30
    got = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8, tolerance=0.02).toPandas()
    by = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "size"), top=("slot", "max"), kinds=("slot", "nunique"))
    ideal = got["size"].sum() / 8
    assert len(by) == 8 and (by.b - ideal).abs().max() <= 0.04 * ideal + 30 * 5
    assert (by.n == by.top + 1).all() and (by.n == by.kinds).all() and len(got) == len(rows)


def test_empty(spark):
    assert histogram_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
