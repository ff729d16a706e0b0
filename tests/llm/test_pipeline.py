import sys
from pathlib import Path

import public_tokenizers

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from storelens.llm import quality, toxicity  # noqa: E402
from storelens.llm.bpe import with_digests  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_stage_decides_as_its_operator(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.collect()]
    rows += [(10_001, rows[50][1], "en", "s", 1), (10_002, f"some words before {items[0][1]} and after", "en", "s", 1), (10_003, None, None, None, None), (10_004, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "bpe_encoding"]
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:4], (
            lambda d: {r.doc_id for r in toxicity.scored(d, labels).collect() if not r.predicted},
            lambda d: {r.doc_id for r in quality.scored(d, labels).collect() if r.predicted},
            lambda d: {i for i, _, c in brute.components([(r.doc_id, r.text) for r in d.collect()]) if i == c},
            lambda d: {r.doc_id for r in d.collect()} - {h[0] for h in brute.contaminations([(r.doc_id, r.text) for r in d.collect()], items)})):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        want = kept(docs)
        assert sorted(r[0] for r in got) == sorted(want)
        assert set(got) <= {tuple(r) for r in docs.collect()}
        docs = spark.createDataFrame(got, docs.schema)
    last = corpus_pipeline.encode(spark, docs, SF)
    assert sorted(map(tuple, last.select("doc_id", "n_tokens", "ids_sha256").collect())) == sorted(
        map(tuple, with_digests(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert 0 < last.count() < len(rows)


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 50


def test_without_usable_labels_no_document_is_rejected(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    for name, some in (("none", labels.limit(0)), ("held", held)):
        some.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_good):
            assert stage(spark, docs, f"{tmp_path}/{name}").count() == docs.count() > 0


def test_one_row_of_each_group_stays(spark):
    from storelens.llm.partenum import without_near_duplicates

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a, 1), (7, b, 2), (3, a, 3), (9, b, 4), (None, c, 5), (None, c, 6), (5, "", 7), (5, "", 8), (None, None, 9), (4, c + " d", 10)]
    got = {tuple(r) for r in without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)).collect()}
    assert got == {rows[i] for i in (1, 2, 6, 7, 8, 9)}
    rows = [(None, c, 1), (None, c, 1), (2, a, 5), (2, a, 4), (2, a, 4)] * 20
    got = [tuple(r) for r in without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()]
    assert len(got) == 2 and (None, c, 1) in got and got[0][1] != got[1][1]


def test_training_rows_do_not_depend_on_partitions(spark):
    from storelens.llm.labelled import training_rows

    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(700)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    some = [sorted(map(tuple, training_rows(docs.repartition(n), labels, "toxic", rows).collect())) for n in (2, 7) for rows in (3, 30)]
    assert some[0] == some[2] and some[1] == some[3] and len(some[0]) == 3 and len({r[0] for r in some[1]}) == len(some[1])
