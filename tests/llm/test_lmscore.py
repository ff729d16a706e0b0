import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storelens.llm import lmscore


def key(x):
    return (x[0] is None, x[0] or 0, x[1], x[2] is None, round(x[2] or 0, 6))


def test_no_target_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lmscore.word_cross_entropy_difference(df, F.lit(False)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, None), (2, 0, None)]
    assert lmscore.word_cross_entropy_difference(df.limit(0), F.lit(True)).count() == 0


def word_brute(rows):
    toks = [re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").translate({i: i + 32 for i in range(65, 91)})) for _, t, _ in rows]
    models = []
    for some in (toks, [w for w, (_, _, good) in zip(toks, rows) if good]):
        pairs = Counter(p for w in some for p in zip([None, *w], w))
        before = Counter()
        for (v, _), k in pairs.items():
            before[v] += k
        models.append((Counter(x for w in some for x in w), pairs, before))
    kinds = len(models[0][0])

    def log(v, w, uni, pairs, before):
        p = (uni[w] + lmscore.ALPHA) / (sum(uni.values()) + lmscore.ALPHA * kinds)
        return math.log((pairs[v, w] + lmscore.BACKOFF * p) / (before[v] + lmscore.BACKOFF))

    out = []
    for w, (i, _, _) in zip(toks, rows):
        s = [log(v, x, *models[0]) - log(v, x, *models[1]) for v, x in zip([None, *w], w)]
        out.append((i, len(w), sum(s) / len(s) if s else None))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 20_000, 300])
def test_word_bigrams_equal_brute_force(spark, monkeypatch, block_bytes):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(12).collect()]
    rows = [(i, t, i % 3 == 0) for i, t in docs] + [(900, None, True), (901, "", False), (None, "the END of the é", None), (902, "seldom word", True), (902, "seldom word", True)]
    rows += [(903, "word seldom", False)]
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", block_bytes)
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(3)
    got = sorted(map(tuple, lmscore.word_cross_entropy_difference(df, F.col("good")).collect()), key=key)
    want = sorted(word_brute(rows), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9) for a, b in zip(got, want))
    assert lmscore.word_cross_entropy_difference(df, F.lit(False)).filter("score is null").count() == len(rows)
    assert lmscore.word_cross_entropy_difference(df.limit(0), F.lit(True)).count() == 0


def test_query_sees_the_order_of_seldom_words(spark, tmp_path):
    from storelens.llm.queries import op5_cross_entropy

    filler = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, "seldom word"), (2, "seldom word"), (3, "word seldom"), (4, filler)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.score for r in op5_cross_entropy(spark, str(tmp_path)).collect()}
    want = {i: s for i, _, s in word_brute([(i, t, i == 1) for i, t in docs])}
    assert got[1] < got[3] - 1e-6 and all(abs(got[i] - want[i]) < 1e-9 for i in want)
