"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.decontam import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=80)


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.sharding import histogram_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return histogram_shards(docs, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that some label marks as good and none as toxic."""
    from storelens.llm.common import broadcast_up_to, shared_folder, stored
    from storelens.llm.lmscore import word_cross_entropy_difference

    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id", F.lit(True).alias("good"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # some 16 bytes a row: ids of up to a million target documents are broadcast, more are joined by a shuffle
    good = broadcast_up_to(stored(good, shared_folder(spark), "target"), 1_000_000)
    marked = docs.join(good, "doc_id", "left")
    return word_cross_entropy_difference(marked, F.col("good"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.bpe import with_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.token_counts import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", "over_limit")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.partenum import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=80)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.common import shared_folder
    from storelens.llm.warc import read_warc, write_warc

    path = f"{shared_folder(spark)}/archives"
    write_warc(table(spark, sf_dir, "pages"), path, smallest_revisit=0)
    refers = F.regexp_extract("refers_to", r"^<urn:page:(\d+)>$", 1)
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", refers.cast("long")).alias("refers_to"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a tenth of the documents the words from a place on are made periodic first, as the contract says."""
    from storelens.llm.common import SPACES
    from storelens.llm.periodic import with_runs

    w, h = F.col("_w"), F.col("_h")
    n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    docs = docs.withColumn("_w", F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda x: x != "")))
    docs = docs.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))
    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")
    docs = docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))
    runs = with_runs(docs)
    # longest first, then the smaller start, then the smaller period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return runs.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.s").alias("start"), (-F.col("_b.l")).alias("length"),
        F.col("_b.p").alias("period"), F.floor(-F.col("_b.l") * 1000 / F.col("_b.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents (by the checksum of their id) lose their line feeds before the root is made again."""
    from storelens.llm.merkle import folded, leaf_of, manifest

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(tampered, leaf_of(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    docs = docs.select("doc_id", "source", leaf_of(*fields, F.col("text")).alias("leaf"), other.alias("other"))
    rows = manifest(docs, "doc_id", "source", "leaf", kept=["other"])
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    rows = rows.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.llm.html_main import with_main_text

    pages = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rp_forest": op1_rp_forest,
    "op2_decontamination": op2_decontamination,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_toxicity_ftrl": op4_toxicity_ftrl,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_warc": op9_warc,
    "op10_quality_fm": op10_quality_fm,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_html_main": op13_html_main,
}

_SHINGLES = """
SELECT DISTINCT id, text, s FROM (
  SELECT id, text, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {id} AS id, text,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x20\\x09-\\x0D]+') AS w
        FROM {table}))"""

ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
     b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
     n AS (SELECT id, text, count(*) AS n FROM b GROUP BY ALL),
     m AS (SELECT d.id AS doc_id, b.id AS item_id, d.text AS dt, b.text AS bt, count(*) AS m
           FROM d JOIN b ON d.s = b.s GROUP BY ALL)
SELECT doc_id, item_id, n.n AS n_shingles, m AS n_shared, m / n.n AS containment
FROM m JOIN n ON n.id = item_id AND n.text = bt
WHERE 100 * m >= 80 * n.n""",
    # runs of three as a recursion over the levels: the groups' trees, then the one over their roots; crc32 bit by bit
    "op12_merkle_manifest": """
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, concat(strlen(doc_id::VARCHAR), ':', doc_id) AS a, coalesce(concat(strlen(source), ':', source), '-') AS b,
         coalesce(concat(strlen(lang), ':', lang), '-') AS c, coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-') AS d,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
             lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
               lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(concat(a, b, c, d, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
         sha256(concat(a, b, c, d, coalesce(concat(strlen(t), ':', t), '-'))) AS given,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM f)),
low AS (
  SELECT 0 AS lv, source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT lv + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY lv, source, i // 3),
subs AS (SELECT source, h AS subroot, lv AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lv, s AS i, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY lv, i // 3),
sides AS (
  SELECT l.doc_id, x.lv AS lv, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < l.i // (3 ** x.lv)::BIGINT), '') AS lft,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i > l.i // (3 ** x.lv)::BIGINT), '') AS rgt
  FROM leaves l JOIN low x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.i // 3 = l.i // (3 ** (x.lv + 1))::BIGINT
  GROUP BY l.doc_id, x.lv
  UNION ALL
  SELECT l.doc_id, g.depth + x.lv, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < g.s // (3 ** x.lv)::BIGINT), ''),
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i > g.s // (3 ** x.lv)::BIGINT), '')
  FROM leaves l JOIN subs g ON g.source IS NOT DISTINCT FROM l.source JOIN high x ON x.n > 1 AND x.i // 3 = g.s // (3 ** (x.lv + 1))::BIGINT
  GROUP BY l.doc_id, g.depth, x.lv),
proofs AS (
  SELECT l.doc_id, min(l.leaf) AS leaf, min(l.given) AS given, min(g.subroot) AS subroot, coalesce(string_agg(p.lft || p.rgt, '' ORDER BY p.lv), '') AS proof,
         coalesce(list(p.lft ORDER BY p.lv) FILTER (WHERE p.lv IS NOT NULL), []) AS ls, coalesce(list(p.rgt ORDER BY p.lv) FILTER (WHERE p.lv IS NOT NULL), []) AS rs
  FROM leaves l JOIN subs g ON g.source IS NOT DISTINCT FROM l.source LEFT JOIN sides p ON p.doc_id = l.doc_id GROUP BY l.doc_id),
fold AS (
  SELECT doc_id, 0 AS lv, given AS h, ls, rs FROM proofs
  UNION ALL
  SELECT doc_id, lv + 1, sha256(concat(ls[lv + 1], h, rs[lv + 1])), ls, rs FROM fold WHERE lv < len(ls)),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, p.subroot, root.root, sha256(p.proof) AS proof_sha256, x.h AS folded_root, x.h = root.root AS verified
FROM proofs p JOIN fold x ON x.doc_id = p.doc_id AND x.lv = len(x.ls) CROSS JOIN root""",
}
