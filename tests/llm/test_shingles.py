import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from storelens.llm.components import components  # noqa: E402
from storelens.llm.decontam import contaminations, decontaminated  # noqa: E402
from storelens.llm.partenum import near_duplicates, signatures, without_near_duplicates  # noqa: E402
from storelens.llm.wordhash import WordHasher, between_spaces, byte_slices  # noqa: E402


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, t, share):
    w = t.split()
    for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    """Copies, edited copies around the threshold, chains, a passage shared by many, and odd texts."""
    rng = random.Random(3)
    out, passage = [], text(rng, 60)
    for base in (text(rng, n) for n in (3, 5, 6, 12, 40, 150, 400)):
        out += [base, base.upper()] + [edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.04, 0.05, 0.1) for _ in range(3)]
    chain = text(rng, 200).split()
    out += [" ".join(chain[i:i + 150]) for i in range(0, 50, 5)]
    hub = text(rng, 120)
    out += [edited(rng, hub, 0.02) for _ in range(40)] + [hub]
    out += [f"{text(rng, rng.randrange(5, 60))} {passage} {text(rng, 20)}" for _ in range(60)]
    out += [None, "", " \t\n", "a", "a b", "A  B", "a b c d", "a b c d e", "same same same same same same same", "x" * 100_000, text(rng, 30_000)]
    ids = list(range(100, 100 + len(out)))
    rng.shuffle(ids)
    return [*zip(ids, out), (None, out[1]), (None, "no other"), (5, "twin of five words only"), (5, "twin of five words only")]


def left_over(sig, band, frequent, often):
    """What a set still has without its most frequent signatures, in an order common to all sets."""
    out = set()
    for b in set(band.tolist()):
        mine = sorted(sig[band == b].tolist(), key=lambda x: (often(x), x))
        out |= set(mine[:len(mine) - int(frequent[band == b][0])])
    return out


@settings(max_examples=600, deadline=None)
@given(st.sets(st.integers(0, 1 << 18), min_size=1, max_size=300), st.sampled_from([46, 45, 20, 0]), st.integers(0, 99), st.data())
def test_similar_sets_share_a_signature(base, shift, seed, data):
    """At a similarity of 0.8 one signature is left in both sets, whichever order of frequency takes others away."""
    gone = data.draw(st.sets(st.sampled_from(sorted(base)), max_size=len(base) // 5))
    new = data.draw(st.sets(st.integers(1 << 17, 1 << 18), max_size=len(base) // 4))
    both, other = base - gone, (base - gone) | new
    if 100 * len(base & other) < 80 * len(base | other) or base == other or not both:
        return
    # shift 0 and 20 put all elements into few partitions, so that most are empty
    sets = [np.sort(np.array(sorted(s), "u8") << np.uint64(shift)) for s in (base, other)]
    at = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
    sig, row, band, frequent = signatures(np.concatenate(sets), at)
    often = lambda x: random.Random(x * 100 + seed).random()
    a, b = (left_over(sig[row == i], band[row == i], frequent[row == i], often) for i in (0, 1))
    assert a & b


def test_every_size_and_difference_shares_a_signature():
    rng = np.random.default_rng(4)
    for n in [*range(4, 140), 255, 256, 257, 400, 1023, 1025, 5000]:
        for _ in range(6):
            keys = rng.integers(0, 1 << 64, 2 * n, dtype="u8")
            more = rng.integers(0, n // 4 + 1)
            less = rng.integers(0, max(1, (2 * n + more) // 9 - more + 1)) if (2 * n + more) // 9 > more else 0
            one, two = np.sort(keys[:n]), np.sort(keys[less:n + more])
            both = n - less
            if 100 * both < 80 * (n + more) or len(one) == len(two) == both:
                continue
            sig, row, band, frequent = signatures(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
            for often in (lambda x: x, lambda x: -x):
                a, b = (left_over(sig[row == i], band[row == i], frequent[row == i], often) for i in (0, 1))
                assert a & b, (n, more, less)


def test_few_signatures():
    """Signatures of random sets: about 0.4 a shingle, and none that holds nothing."""
    rng = np.random.default_rng(5)
    size = rng.integers(64, 1024, 200)
    at = np.concatenate([[0], np.cumsum(size)])
    key = np.concatenate([np.sort(rng.integers(0, 1 << 64, n, dtype="u8")) for n in size])
    sig, row, _, _ = signatures(key, at)
    assert 0.25 * len(key) < len(sig) < 0.5 * len(key) and len(set(sig.tolist())) == len(sig)


def test_a_leader_of_many_is_salted(spark, monkeypatch):
    """Edited copies of one text, held against it in groups of a few."""
    from storelens.llm import partenum

    monkeypatch.setattr(partenum, "PARTNERS", 3)
    rng = random.Random(11)
    hub = text(rng, 150)
    docs = [*enumerate([hub, *[edited(rng, hub, 0.01) for _ in range(40)], *[text(rng, 150) for _ in range(20)]])]
    got = partenum.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(docs))
    assert {r.component_id for r in got if r.doc_id <= 40} == {0}


def test_near_duplicates(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 as class", "'x' as n", "2 as signature")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    want = sorted(brute.components(rows), key=str)
    assert got == want
    assert len({c for *_, c in want}) < len(want) - 60
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns
    # one row of each group, also of the two equal rows and of the group without an id; all rows without words
    one = [*{c for _, n, c in want if n and c is not None}, None, *(d for d, n, _ in want if not n)]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(one, key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_contaminations(spark, rows):
    rng = random.Random(5)
    items = [(i, text(rng, n)) for i, n in enumerate((1, 4, 5, 9, 15, 40, 60))] + [(70, None), (71, ""), (5, "other text of item five here"), (5, "other text of item five here")]
    docs = list(rows)
    for i, t in items:
        for k in (0, 3, 50, 3000):
            docs.append((1000 + len(docs), f"{text(rng, k)} {(t or '').upper()}  {text(rng, k)}"))
            docs.append((1000 + len(docs), f"{text(rng, k)} {edited(rng, t, 0.03) if t else ''} {text(rng, k)}"))
    docs.append((None, docs[-9][1]))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as row_key", "'x' as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = brute.contaminations(docs, items)
    got = contaminations(d, b).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got), key=str) == want and len(want) > 40
    assert all(abs(r.containment - r.n_shared / r.n_shingles) < 1e-12 for r in got)
    bad = {t for i, t in docs if any(i == w[0] for w in want)}
    kept = decontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in docs if t not in bad), key=str)
    assert contaminations(d.limit(0), b).count() == 0 and contaminations(d, b.limit(0)).count() == 0
    assert decontaminated(d, b.limit(0)).count() == len(docs)


def test_short_items_are_found_in_every_document(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"item{i}word{j}" for j in range(n))) for i, n in enumerate((5, 6, 7, 12, 23, 30))]
    docs = [(d, f"{text(rng, 300)} {' '.join(t for _, t in items)} {text(rng, 300)}") for d in range(80)]
    got = contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(d, i) for d, _ in docs for i, _ in items]


def test_components(spark, tmp_path):
    rng, n = random.Random(2), 300
    edges = [(i, i + 1) for i in range(0, 80)] + [(rng.randrange(100, n), rng.randrange(100, n)) for _ in range(150)] + [(-5, 1 << 40), (7, 7)]
    up = {}

    def top(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long"), f"file://{tmp_path}", "t").collect()}
    assert got == {i: top(i) for e in edges for i in e if top(i) != i}


def test_word_hashes():
    texts = ["a b c", "", None, "  A  b ", "x" * 1_200_000 + " a b", "é à\ta\nB", "a", "b a" * 300_000]
    want = [w for t in texts for w in brute.words(t)]
    for piece in (texts, ["zz", *texts]):
        array = pa.array(piece)[len(piece) - len(texts):]
        hashes, lengths, at = WordHasher(between_spaces())(array)
        assert at.tolist() == np.cumsum([0] + [len(brute.words(t)) for t in texts]).tolist()
        assert lengths.tolist() == [len(w.encode()) for w in want]
        assert len(set(zip(want, hashes.tolist()))) == len(set(want)) == len(set(hashes.tolist()))
    assert [len(s) for s in byte_slices(pa.array(texts), 100)] == [4, 1, 2, 1]
