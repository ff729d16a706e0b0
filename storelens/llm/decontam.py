"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Containment of a short item in a long document means a small Jaccard similarity,
the smaller the longer the document.  So documents are partitioned by their number
of shingles n, partition p holding 2**p <= n < 2**(p + 1), and each partition has its
own one-permutation MinHash with 2**(p + 2) bins: the smallest shingle hash of every
bin.  An item's own minima for the bins of a partition are looked up there; the
partitions too small to hold ``threshold`` of the item are left out.  With four to
two bins per shingle an item's shingle is its bin's minimum with probability 0.79 at
least, so a document that shares s shingles is missed with less than 0.21**s.  An
item of which a hit must share fewer than SKETCHED shingles is not sketched: each of its
shingles is looked up among all shingles of every document, so none is missed.  Every
hit is then verified by the exact containment of the shingles as text.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import broadcast_up_to, free_name, require, shared_folder, stored, words

WIDTH = 5
EXTRA_BITS = 2
PARTITIONS = 32
#: Shingles that a hit must share for its item to be sketched: 0.21**20 is 3e-14.
SKETCHED = 20
#: Rows of item shingles, or of contaminated documents, that may be broadcast.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(hashes: Column) -> Column:
    """Hashes of all runs of five words (of their hashes), with repeats; of one to four words, of all of them."""
    n = F.size(hashes)
    run = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WIDTH)]))
    return F.when(n >= WIDTH, run).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column) -> Column:
    """The distinct shingles as text."""
    n = F.size(w)
    run = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.array_join(F.slice(w, i + 1, WIDTH), " "))
    return F.when(n >= WIDTH, F.array_distinct(run)).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def is_minimum(shingles: Column, x: Column, i: Column, bits: Column) -> Column:
    """Whether ``x``, number ``i`` of the sorted hashes, is the smallest of its bin; a bin is the hash's leading ``bits`` bits."""
    def bin_of(x):
        return F.call_function("shiftright", x, F.lit(64) - bits)

    return (i == 0) | (bin_of(x) != bin_of(F.get(shingles, i - 1)))


def minima(shingles: Column, bits: Column) -> Column:
    """The smallest of the sorted hashes in each bin."""
    return F.filter(shingles, lambda x, i: is_minimum(shingles, x, i, bits))


def parted(shingles: Column, part: Column) -> Column:
    """All sorted hashes (``minimum``), each with ``part`` if it is the smallest of its bin there, else with -1."""
    return F.transform(shingles, lambda x, i: F.struct(
        x.alias("minimum"), F.when(is_minimum(shingles, x, i, part + EXTRA_BITS), part).otherwise(-1).alias("part")))


def hashed(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``shingles``, the sorted shingle hashes, in place of the text.
    One array a step: none is computed again inside a later lambda."""
    rows = rows.withColumn("_w", words(F.col(text))).drop(text)
    rows = rows.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")
    return rows.withColumn("_s", shingle_hashes(F.col("_h"))).drop("_h").withColumn("shingles", F.sort_array("_s")).drop("_s")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), F.lit("|"), text)


def hits(docs: DataFrame, benchmark: DataFrame, threshold: int = 80) -> DataFrame:
    """(row_key, item_id, n_shingles, n_shared) of each document and item of which the document
    holds at least ``threshold`` hundredths of the distinct shingles.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.  Null
    and empty texts hold nothing and are held by nothing.  An item of one to four words
    is one shingle, held only by documents of just these words.  Items repeated with
    the same id and text count once; of an id with several texts each text is an item.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text").filter(F.col("text").isNotNull())
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    items = items.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), F.lit("|"), "text"))
    items = stored(items.withColumn("_w", words(F.col("text"))).select("item", "item_id", "text", shingle_texts(F.col("_w")).alias("parts"))
                   .withColumn("n_shingles", F.size("parts")).filter("n_shingles > 0"), folder, "items")

    # candidates: a bin minimum of the document is the item's minimum of the same bin, or,
    # of items with few shingles (part -1), any shingle of the document is one of the item's
    few = F.col("n_shingles") * threshold <= (SKETCHED - 1) * 100
    exact = hashed(items.filter(few).select("item", "text"), "text").select("item", F.lit(-1).alias("part"), F.explode("shingles").alias("minimum"))
    wanted = items.filter(~few).select("item", "n_shingles", "text", F.explode(F.sequence(F.lit(0), F.lit(PARTITIONS - 1))).alias("part"))
    wanted = wanted.filter(F.pow(F.lit(2.0), F.col("part") + 1) * 100 > F.col("n_shingles") * threshold)
    wanted = hashed(wanted, "text")
    wanted = wanted.select("item", "part", F.explode(minima(F.col("shingles"), F.col("part") + EXTRA_BITS)).alias("minimum"))
    wanted = stored(wanted.unionByName(exact).distinct(), folder, "signatures").withColumnRenamed("part", "wanted_part")
    wanted = broadcast_up_to(wanted, BROADCAST_ROWS)
    # never null and never filtered on: a predicate on it would move below the arrays and compute them per element
    size = F.coalesce(F.floor(F.log2(F.size("shingles"))).cast("int"), F.lit(-1))
    sketched = hashed(rows, "text").withColumn("part", size)
    sketched = sketched.select("row_key", F.explode(parted(F.col("shingles"), F.col("part"))).alias("e")).select("row_key", "e.minimum", "e.part")
    same_part = (F.col("wanted_part") == -1) | (F.col("wanted_part") == F.col("part"))
    candidates = sketched.join(wanted, (sketched["minimum"] == wanted["minimum"]) & same_part)
    candidates = stored(candidates.select("row_key", "item").distinct(), folder, "candidates")

    # exact containment, for the candidates' documents only
    some = stored(candidates.select("row_key").distinct(), folder, "candidate_rows")
    texts = rows.join(broadcast_up_to(some, BROADCAST_ROWS), "row_key", "left_semi").dropDuplicates(["row_key"])
    shared = (texts.withColumn("_w", words(F.col("text"))).drop("text")
              .select("row_key", F.explode(shingle_texts(F.col("_w"))).alias("shingle")))
    parts = items.select("item", F.explode("parts").alias("shingle"))
    parts = broadcast_up_to(stored(parts, folder, "parts"), BROADCAST_ROWS)
    shared = shared.join(parts, "shingle").groupBy("row_key", "item").agg(F.count("*").alias("n_shared"))
    shared = shared.join(candidates, ["row_key", "item"], "left_semi")
    found = shared.join(broadcast_up_to(items.select("item", "item_id", "n_shingles"), BROADCAST_ROWS), "item")
    return found.filter(F.col("n_shared") * 100 >= F.col("n_shingles") * threshold).select("row_key", "item_id", "n_shingles", "n_shared")


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of the pairs of :func:`hits`; a document
    repeated with id and text has its pairs once, a null doc_id stays null."""
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    folder = shared_folder(docs.sparkSession)
    found = stored(hits(docs, benchmark, threshold), folder, "hits")
    ids = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    ids = ids.join(broadcast_up_to(stored(found.select("row_key").distinct(), folder, "rows"), BROADCAST_ROWS), "row_key", "left_semi").distinct()
    return found.join(ids, "row_key").select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared",
                                             (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = 80) -> DataFrame:
    """``docs`` without the documents that hold an item; columns and all other rows stay as they are."""
    require(docs, "doc_id", "text")
    folder, key = shared_folder(docs.sparkSession), free_name(docs, "row_key")
    bad = stored(hits(docs, benchmark, threshold).select(F.col("row_key").alias(key)).distinct(), folder, "contaminated")
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(broadcast_up_to(bad, BROADCAST_ROWS), key, "left_anti").drop(key)
