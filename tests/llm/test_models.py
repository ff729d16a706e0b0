import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelens.llm import quality, toxicity
from storelens.llm.ann import Forest, nearest

SF = "/root/testdata/sf0.1"


def tables(spark, rows=None):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.94), (quality, "quality", 0.97)])
def test_held_out_accuracy_and_no_leak(spark, module, label, least):
    docs, labels = tables(spark)
    got = module.scored(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    truth = labels.toPandas().set_index("doc_id")[label]
    held = got[got.held_out].set_index("doc_id").join(truth, how="inner")
    assert len(held) > 500 and (held.predicted == held[label]).mean() >= least
    clean = held[held[label] == (0 if module is toxicity else 1)]
    assert (clean.predicted == clean[label]).mean() > 0.99
    # labels of the held-out fold, lang and source change nothing
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn(label, F.when(fold, 1 - F.col(label)).otherwise(F.col(label)))
    again = module.scored(docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")}), turned).toPandas()
    assert np.allclose(got.set_index("doc_id").score.sort_index(), again.set_index("doc_id").score.sort_index())


def odd(spark):
    rows = [(1, "good words here", 15), (2, None, None), (3, "", 0), (None, "stupid idiot", None), (5, "word " * 100_000, 500_000), (6, "a", -3), (6, "a", -3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'x' as score", "1 as rank", "2 as label")


@pytest.mark.parametrize("call, params", [(toxicity.with_toxicity, toxicity.Ftrl(rows=50)), (quality.with_quality, quality.Machine(rows=50))])
def test_odd_rows(spark, call, params):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 3, 5, 6, 6)] + [(2, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = call(docs, labels, params).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.label == 2 for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    none = call(docs, labels.limit(0), params).collect()
    assert len(none) == 7 and {r.score for r in none} == {0.0}
    assert call(docs.limit(0), labels, params).count() == 0


def test_machine_equals_all_pairs():
    """The sum-of-squares identity against the double sum over feature pairs."""
    p = quality.Machine(bits=8, factors=3)
    feature, row, value = quality.Features(p)(pa.array(["one two three two!", "", "x " * 50]), np.array([17.0, np.nan, 100.0]))
    model = np.random.default_rng(1).normal(size=(p.size, 4))
    got = quality.score(model, 0.5, feature, row, value, 3)
    for r in range(3):
        i, x = feature[row == r], value[row == r]
        v = model[i, 1:] * x[:, None]
        pairs = sum(v[a] @ v[b] for a in range(len(i)) for b in range(a))
        assert abs(got[r] - (0.5 + model[i, 0] @ x + pairs)) < 1e-9


def truth(rows, query, k):
    x = {i: np.array(v, "f8") for i, v in rows}
    at = [(float(np.sqrt(((np.array(v, "f8") - x[query]) ** 2).sum())), i) for i, v in rows if i != query]
    return [(query, n + 1, i, s) for n, (s, i) in enumerate(sorted(at)[:k])]


def test_nearest_is_exact_when_every_leaf_is_opened(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    bad = [(500, None), (505, [0.0] * 8), (510, [float("nan")] * 8), (515, [1.0, None] + [0.0] * 6), (520, [float("inf")] * 8), (None, [1.0] * 8), (525, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").repartition(3).selectExpr("*", "1 as leaf", "'x' as class")
    got = nearest(df, F.col("vec_id") % 5 == 0, 10, Forest(trees=4, leaf=16, entries=10**6, sample=200, block=32))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    want = sorted(t for q in range(0, 420, 5) for t in truth(rows, q, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_nearest_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 2.0]), (7, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 5 == 0, 10).collect())
    assert got == [(0, 1, 5, 0.0), (0, 2, 7, 2.0), (5, 1, 0, 0.0), (5, 2, 7, 2.0)]
    assert nearest(df.limit(0), F.lit(True)).count() == nearest(df, F.lit(False)).count() == nearest(df.limit(1), F.lit(True)).count() == 0


def test_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    # a search that opens a part of the leaves only: some 4 of 5 are never met
    got = nearest(vectors, F.col("vec_id") % 100 == 0, 10, Forest(entries=2500)).toPandas().groupby("query_id").vec_id.apply(set)
    hits = [len({t[2] for t in truth(rows, q, 10)} & got[q]) for q, _ in rows if q % 100 == 0]
    assert np.mean(hits) >= 9


def test_recall_decides_how_many_leaves_are_opened(spark):
    x = np.random.default_rng(6).normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = nearest(df, F.col("vec_id") % 60 == 0, 10, Forest(trees=16, entries=500)).toPandas().groupby("query_id").vec_id.apply(set)
    hits = [len({t[2] for t in truth(rows, q, 10)} & got[q]) for q, _ in rows if q % 60 == 0]
    assert len(hits) == 50 and np.mean(hits) >= 9
