import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from storelens.llm.merkle import folded, leaf_of, manifest
from storelens.llm.queries import op12_merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, paths): for each node its siblings (left, right) level by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for x, i in enumerate(at):
            run = i - i % 3
            paths[x].append(("".join(now[run:i]), "".join(now[i + 1:run + 3])))
            at[x] = i // 3
        now = [H(*now[i:i + 3]) for i in range(0, len(now), 3)]
    return now[0], paths


def forest(rows):
    """rows of (group, key, leaf) -> [(group, key, leaf, coordinate, subroot, root, path)]."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    parts, subs = {}, []
    for g in groups:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        parts[g] = own, *tree([r[2] for r in own])
        subs.append(parts[g][1])
    root, tops = tree(subs)
    return [(g, k, leaf, i, sub, root, path + tops[n]) for n, g in enumerate(groups)
            for own, sub, paths in [parts[g]] for i, ((_, k, leaf), path) in enumerate(zip(own, paths))]


def _sorted(rows):
    return sorted(rows, key=str)


def _got(df):
    return _sorted((r.g, r.k, r.h, r.coordinate, r.subroot, r.root, [tuple(p) for p in r.path]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    ids = [None, -5, -(2 ** 63), 2 ** 63 - 1, 0, 63, 64, 4095, 4096, 2 ** 24, 2 ** 36 + 1, *range(200), *(rnd.randint(-2 ** 40, 2 ** 40) for _ in range(100))]
    rows = [(rnd.choice([None, "", "a", "b", "é", "Z"]), rnd.choice(ids), H(str(rnd.randint(0, 400)))) for _ in range(900)]
    rows += [("big", i, H(str(i))) for i in range(1500)] + [("one", 7, H("x"))] + [("same", 1, H("y"))] * 40 + [("same", 1, H(str(i))) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k long, h string").repartition(7)
    assert _got(manifest(df, "k", "g", "h")) == _sorted(forest(rows))


@pytest.mark.parametrize("rows", [[("a", 1, H("1"))], [(None, None, H("1"))] * 3, [("a", 1, H("1")), ("b", 1, H("1"))]])
def test_small_trees(spark, rows):
    df = spark.createDataFrame(rows, "g string, k long, h string")
    got = manifest(df.withColumn("coordinate", F.lit(9)).withColumn("path", F.lit("x")), "k", "g", "h", kept=["path"])
    assert got.columns == ["k", "g", "h", "coordinate", "subroot", "root", "path"]
    assert _got(manifest(df, "k", "g", "h")) == _sorted(forest(rows))


def test_many_groups_and_empty(spark):
    rows = [(f"g{i}", i, H(str(i))) for i in range(800)]
    got = manifest(spark.createDataFrame(rows, "g string, k int, h string"), "k", "g", "h")
    assert _got(got) == _sorted(forest(rows))
    assert {r[0] for r in got.select(folded(F.col("h"), F.col("path")) == F.col("root")).collect()} == {True}
    assert manifest(spark.createDataFrame([], "k long, g string, h string"), "k", "g", "h").collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    texts = [None, "", "a\nb", "é\n\n", "plain"]
    docs = [(i, rnd.choice(texts), rnd.choice(["en", None]), rnd.choice([None, "s1", "s2"]), rnd.choice([None, 5])) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")

    def leaf(i, source, lang, n, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    by = {d[0]: d for d in docs}
    want = []
    for g, k, h, _, sub, root, path in forest([(s, i, leaf(i, s, la, n, t)) for i, t, la, s, n in docs]):
        _, t, la, s, n = by[k]
        node = leaf(k, s, la, n, t.replace("\n", "") if t is not None and zlib.crc32(str(k).encode()) % 2 == 0 else t)
        for left, right in path:
            node = H(left, node, right)
        want.append((k, h, sub, root, H(*[a + b for a, b in path]), node, node == root))
    got = op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < sum(r.verified for r in got) < 200


def test_leaf_of(spark):
    row = spark.sql("select 7L a, cast(null as string) b, 'é' c, '' d").select(leaf_of(*[F.col(c) for c in "abcd"])).first()
    assert row[0] == H("1:7-2:é0:")
