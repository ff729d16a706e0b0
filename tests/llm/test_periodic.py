import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.llm.periodic import find_runs, runs_of_texts, with_runs
from storelens.llm.queries import op11_periodic_runs


def brute(words, least=6, times=4):
    """Every run by comparing words for each period."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(
                    all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def collapsed(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=8))
def test_runs_equal_brute_force(parts):
    words = [w for part, times in parts for w in part * times]
    assert [tuple(r) for r in find_runs(np.array(words, np.int64)).tolist()] == brute(words)


def test_texts_of_one_step_do_not_meet():
    rnd = random.Random(5)
    texts = [[b"a"] * 5, [b"a"] * 7, [], [b"x", b"y"] * 9, [b"x", b"y"] * 9] + [[rnd.choice([b"a", b"b"]) for _ in range(rnd.randint(0, 90))] for _ in range(60)]
    for words, (runs, kept) in zip(texts, runs_of_texts(texts)):
        want = brute(words)
        assert [tuple(r) for r in runs.tolist()] == want
        assert kept.decode() == collapsed([w.decode() for w in words], want)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, "a b " * 8, "x"), (5, "w v " * 60_000, "x"), (4, "a b " * 8, "x"), (None, "A a " * 4, "x")]
    got = with_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    by = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert len(got) == 7 and by[1, None] == by[2, ""] == ([], "")
    assert by[4, rows[3][1]] == ([(0, 8, 1)], "a b") and by[5, rows[4][1]] == ([(0, 120_000, 2)], "w v")
    assert by[None, rows[6][1]] == ([(0, 8, 2)], "A a")
    assert with_runs(spark.createDataFrame([], "text string")).columns == ["text", "runs", "collapsed"]


def planted(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in words]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    docs = [(i, None if i % 29 == 0 else " ".join(rnd.choice("ab") if rnd.random() < 0.4 else "the" for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == 300
    for doc_id, text in docs:
        words = planted(doc_id, text)
        runs, r = brute(words), got[doc_id]
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
