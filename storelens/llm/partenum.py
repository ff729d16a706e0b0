"""Jaccard self-join of the documents' word shingles by PartEnum signatures.

**Bands of sizes.** A set of n shingles belongs to the band [2**b, 2**(b+1)) of n, and signs there.  A partner of
a similarity of 0.8 may be smaller and lie one band below; a set small enough for that signs in that band too.
Any two linked sets therefore sign in one band together, and there their symmetric difference d has a bound that
depends on the band alone.

**Partitions and subsets.** In a band the 64-bit hash domain of shingles is cut into first-level partitions, each of
them into SECOND parts; a signature is what a set holds in SECOND - MISSED parts of one first-level partition, and
all such subsets are enumerated.  There are more than d / (MISSED + 1) first-level partitions, so in one of them
linked sets differ in at most MISSED parts, and share a signature.  Partition and subset are part of the signature.

**What a set may leave out.** d differences spoil at most loss(d) signatures of the pair, since the first part spoiled
in a partition costs most.  A set with M signatures that hold anything thus shares at least L = M - loss(d) of them with
each partner.  Of these it leaves out L - 1, by two orders that are common to all sets: first those of
fewest shingles, before anything moves, then, up to a number given by the band, those that most classes
share.  Both numbers grow with L, so of the signatures that a pair shares the two sets together leave out at most one
less than the larger L, and one remains.  A signature that holds nothing is sent only by a set with L <= 0: if
neither set of a pair has L > 0 both send all, empty ones included, and else the one with L > 0 ensures the link.

**Copies and families.** Documents with equal sets are one class.  Within a signature
every class is first held against one leader, the class whose signatures are shared
most (the original of edited copies); components of those links are formed;
then only pairs of classes in different components are held against each other.  So a
family of near copies costs rows in proportion to its size.  A pair first has to pass
bounds that never reject a link (sizes, parities and differences of counts in cells),
then the exact sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import broadcast_up_to, free_name, require, shared_folder, stored
from storelens.llm.components import components
from storelens.llm.wordhash import U64, WordHasher, between_spaces, byte_slices, distinct, grams, mix

WIDTH = 5
#: Parts of a first-level partition, and how many of them a signature leaves out.
SECOND, MISSED = 2, 1
#: First-level partitions, as a share of the largest difference of a linked pair in the band (one more than
#: 1 / (MISSED + 1) of it at least).
PARTITIONS = 0.6
#: Signatures that a set may leave out for being shared by many, as a share of that difference.
FREQUENT = 0.2
CELLS = 64
#: What the join itself compares: the parities of the counts of 256 cells, in four longs.
PARITIES = ["p0", "p1", "p2", "p3"]
SLICE_BYTES = 4 << 20
#: Rows of keys, or of narrow class and label tables, that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_CLASSES = 200_000
#: Sets that are held against one set in one place; more are spread over salts.
PARTNERS = 256
#: Signatures before the one at hand that are looked at so as to find a pair only once.
BEFORE = 32


def shingle_sets(hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and where each row's begin: runs of WIDTH words, or all words if fewer."""
    words, _, at = hasher(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    key, krow = grams(words, row, *range(1, WIDTH))
    count = np.diff(at)
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    whole = np.zeros(len(few), "u8")
    with np.errstate(over="ignore"):
        for j in range(WIDTH - 1):
            have = count[few] > j
            whole[have] = mix(whole[have] * U64(31) + words[at[few[have]] + j] + U64(j + 1))
    key, krow = distinct(np.concatenate([key, whole]), np.concatenate([krow, few]))
    return key, np.searchsorted(krow, np.arange(len(texts) + 1))


def class_ids(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit identity of each set (order-free sum of mixed hashes); empty sets get 0."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(mix(key ^ U64(0x5851F42D4C957F2D)))])
        out = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype("u8"))
    return np.where(np.diff(at) > 0, out, U64(0)).view("int64")


def differences(x, y, percent: int):
    """The largest symmetric difference of linked sets of x and y elements."""
    return (x + y) * (100 - percent) // (100 + percent)


def layout(band: int, percent: int) -> tuple[int, int, int]:
    """Largest size in the band, largest difference of a linked pair whose smaller set lies in it, first-level partitions."""
    largest = (2 << band) - 1
    most = differences(largest, largest * 100 // percent, percent)
    return largest, most, max(most // (MISSED + 1) + 1, ceil(most * PARTITIONS))


def loss(d, firsts: int):
    """The most signatures that ``d`` differences spoil: first one part in each partition, then a second one, ..."""
    levels = range(1, MISSED + 2)
    return sum(np.clip(d - (t - 1) * firsts, 0, firsts) * comb(SECOND - t, SECOND - MISSED - 1) for t in levels)


def _in_band(key: np.ndarray, at: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, ...]:
    """What :func:`signatures` returns, of sets that all sign in ``band``."""
    sets, size = len(at) - 1, np.diff(at)
    largest, most, firsts = layout(band, percent)
    parts = firsts * SECOND
    slot = np.repeat(np.arange(sets), size) * parts + ((key >> U64(32)) * U64(parts) >> U64(32)).astype("int64")
    begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))  # keys are in order, so slots are too
    with np.errstate(over="ignore"):
        held, sums = np.zeros(sets * parts, "int64"), np.zeros(sets * parts, "u8")
        held[slot[begins]] = np.diff(np.append(begins, len(slot)))
        sums[slot[begins]] = np.add.reduceat(mix(key + U64(0xD1342543DE82EF95)), begins)
        held, sums = held.reshape(sets, firsts, SECOND), sums.reshape(sets, firsts, SECOND)
        # the enumeration: every subset of SECOND - MISSED parts of every first-level partition
        chosen = [list(c) for c in combinations(range(SECOND), SECOND - MISSED)]
        count = np.stack([held[:, :, c].sum(axis=2) for c in chosen], axis=2).reshape(sets, -1)
        value = np.stack([sums[:, :, c].sum(axis=2, dtype="u8") for c in chosen], axis=2).reshape(sets, -1)
        place = mix(np.arange(value.shape[1], dtype="u8") * U64(64) + U64(band + 1))
        value = mix(mix(value) ^ place)
    partner = np.where(size > largest, largest, size * 100 // percent)
    shared = (count > 0).sum(axis=1) - loss(differences(size, partner, percent), firsts)
    frequent = np.clip(shared - 1, 0, min(int(most * FREQUENT), 1 << 24))
    few = np.maximum(shared - 1, 0) - frequent
    row, column = np.nonzero((count > 0) | (shared <= 0)[:, None])
    count, value = count[row, column], value[row, column]
    order = np.lexsort((value, count, row))
    row, value = row[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) >= few[row]
    return value[keep], row[keep], frequent[row[keep]]


def signatures(key: np.ndarray, at: np.ndarray, percent: int = 80) -> tuple[np.ndarray, ...]:
    """Signatures of all sets (distinct, ascending ``key`` in each), the sets they are of, their bands, and how many of
    the most frequent signatures of that set and band may still be left out.  Sets too small for a difference have none."""
    size = np.diff(at)
    own = np.frexp(size)[1] - 1
    out = []
    for band in range(int(own.max(initial=0)) + 1):
        largest, most, _ = layout(band, percent)
        here = np.flatnonzero((own == band) | (own == band + 1) & (size * percent <= largest * 100))
        if most and len(here):
            some = np.zeros(len(size), bool)
            some[here] = True
            value, row, frequent = _in_band(*_kept(key, at, some), band, percent)
            out.append((value, here[row], np.full(len(row), band), frequent))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (key[:0], *[np.zeros(0, "int64")] * 3)


def _per_slice(make, schema: pa.Schema):
    """A mapInArrow function over (text, ...) batches; ``make`` gets hasher and a slice, and returns columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(between_spaces())
        for batch in batches:
            done = 0
            for texts in byte_slices(batch.column(0), SLICE_BYTES):
                columns = make(hasher, texts, batch.slice(done, len(texts)))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _sketches(hasher, texts, batch):
    key, at = shingle_sets(hasher, texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    cells = np.bincount(row * CELLS + (key & U64(CELLS - 1)).astype("int64"), minlength=CELLS * len(texts))
    cells = cells.reshape(len(texts), CELLS)
    cells = np.minimum(cells, 255).astype("u1")
    odd = np.bincount(row * 256 + (key >> U64(8) & U64(255)).astype("int64"), minlength=256 * len(texts)) & 1
    odd = np.packbits(odd.astype("u1").reshape(len(texts), 256), axis=1).view("int64")
    return (batch.column(1), batch.column(2), np.diff(at), class_ids(key, at), [c.tobytes() for c in cells],
            *odd.T.copy())


def _first_of_class(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    ids = class_ids(key, at)
    first = np.zeros(len(ids), bool)
    first[np.unique(ids, return_index=True)[1]] = True
    return first & (np.diff(at) > 0)


def _kept(key: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(at)
    return key[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])


def _signed(percent: int):
    def signed(hasher, texts, batch):
        key, at = shingle_sets(hasher, texts)
        keep = _first_of_class(key, at)
        ids = class_ids(key, at)[keep]
        value, row, band, frequent = signatures(*_kept(key, at, keep), percent)
        return value.view("int64"), ids[row], frequent * 64 + band

    return signed


def _exact(hasher, texts, batch):
    key, at = shingle_sets(hasher, texts)
    keep = _first_of_class(key, at)
    ids = class_ids(key, at)[keep]
    key, at = _kept(key, at, keep)
    return ids, [key[a:b].tobytes() for a, b in zip(at, at[1:])]


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that sizes and cell counts do not rule out."""
    @F.arrow_udf("long")
    def least_difference(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), "u1").reshape(-1, CELLS).astype("i2") for v in (a, b))
        return pa.array(np.abs(x - y).sum(axis=1, dtype="i8"))

    side = broadcast_up_to(classes.select("class", "n", "cells"), BROADCAST_CLASSES)
    pairs = pairs.join(side.toDF("a", "na", "ca"), "a").join(side.toDF("b", "nb", "cb"), "b")
    pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    # with d the symmetric difference: |r & s| / |r | s| = (T - d) / (T + d)
    pairs = pairs.withColumn("d", least_difference("ca", "cb"))
    return pairs.filter(F.col("d") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def _linked(pairs: DataFrame, classes: DataFrame, rows: DataFrame, folder: str, name: str, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, a written table, whose sets are similar.  The sets of a move to b once a pair, those
    of b, the fewer ones, once to every PARTNERS of their pairs."""
    schema, kind = pa.schema([("class", pa.int64()), ("items", pa.binary())]), "class long, items binary"

    def sets_of(side: str) -> DataFrame:
        wanted = classes.join(pairs.select(F.col(side).alias("class")).distinct(), "class", "left_semi")
        keys = stored(wanted.select(F.xxhash64("least.doc_id", "least.text_key").alias("row_key")).distinct(), folder, f"{name}_{side}")
        texts = rows.withColumn("row_key", F.xxhash64("doc_id", "text_key")).join(broadcast_up_to(keys, BROADCAST_ROWS), "row_key", "left_semi")
        return texts.select("text").mapInArrow(_per_slice(_exact, schema), kind)

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    # no leader's partners meet in one task
    salts = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")), folder, f"{name}_salts")
    salts = broadcast_up_to(salts, BROADCAST_ROWS)
    salted = stored(pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt")), folder, f"{name}_salted")
    one = sets_of("a").toDF("a", "sa").join(broadcast_up_to(salted, BROADCAST_ROWS), "a")
    two = sets_of("b").dropDuplicates(["class"]).toDF("b", "sb").join(salts, "b")
    two = two.select("b", "sb", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    return one.join(two, ["b", "salt"]).filter(similar("sa", "sb")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents are linked when
    100 * |intersection| >= percent * |union| of their shingle sets (percent from 80 on, as the signatures
    need), and component_id is the smallest doc_id that links lead to.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles
    are five words, or all words of a shorter text.  Null and empty texts have no
    shingles and are linked with nothing: component_id is their own id.  A null id
    is never the smallest unless its component has no other.  Rows repeated with
    their id stay as they are; an empty table gives an empty one.
    """
    require(docs, doc_id, text)
    members, found = _grouped(docs, percent, doc_id, text)
    return (members.join(found, "class", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id")))


#: What orders the rows of a component: null ids come last.
_PLACE = "struct(doc_id is null as no_id, doc_id, text_key)"


def _grouped(docs: DataFrame, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, text_key, n, class, ...), and for every class the first row of its component: (class, first)."""
    if percent < 80:
        raise ValueError("the signatures are complete from a similarity of 80 hundredths on")
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_key"))

    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("class", pa.int64()), ("cells", pa.binary()),
                        *[(c, pa.int64()) for c in PARITIES]])
    sketched = rows.mapInArrow(_per_slice(_sketches, schema), "doc_id long, text_key long, n int, class long, cells binary, "
                              + ", ".join(f"{c} long" for c in PARITIES))
    members = stored(sketched, folder, "members")
    classes = stored(members.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("cells", *PARITIES)],
                                                                F.min(F.expr(_PLACE)).alias("least")), folder, "classes")

    schema = pa.schema([("signature", pa.int64()), ("class", pa.int64()), ("tag", pa.int32())])
    signed = rows.select("text").mapInArrow(_per_slice(_signed(percent), schema), "signature long, class long, tag int")
    # one exchange; a class comes at most once from a slice of texts, so copies do not pile up on a signature
    signed = signed.repartition("signature").dropDuplicates(["signature", "class"])
    group, own = "over (partition by signature)", "over (partition by class"
    met = signed.selectExpr("*", f"count(1) {group} as often").filter("often > 1")
    # tag: the band in the six lowest bits, above them how many of the set's most frequent signatures there may go
    nth = f"row_number() {own}, tag & 63 order by often desc, signature)"
    met = met.selectExpr("*", f"{nth} as nth", f"sum(often / shiftleft(1L, tag & 63)) {own}) as weight").filter("nth > shiftright(tag, 6)")
    # the leader is the class whose shingles the others share most: the original, if they are its edited copies
    met = stored(met.selectExpr("signature", "class", f"max(struct(weight, class)) {group}.class as leader"), folder, "met")

    # every class against the leader of its signatures
    stars = met.filter("class != leader").select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct()
    stars = stored(_possible(stars, classes, percent), folder, "stars")

    links = stored(_linked(stars, classes, rows, folder, "star_sets", percent), folder, "links")
    labels = components(links, folder, "star")

    # then the pairs of a signature that are still in different components
    small = broadcast_up_to(labels.toDF("class", "label"), BROADCAST_CLASSES)
    apart = met.join(small, "class", "left").withColumn("label", F.coalesce("label", "class"))
    apart = apart.selectExpr("*", f"min(label) {group} as l0", f"max(label) {group} as l1").filter("l0 < l1 and class != leader").drop("l0", "l1", "leader")
    apart = apart.join(broadcast_up_to(classes.select("class", "n", *PARITIES), BROADCAST_CLASSES), "class")
    before = f"collect_list(signature) {own} order by signature rows between {BEFORE} preceding and 1 preceding)"
    apart = stored(apart.selectExpr("*", f"{before} as before"), folder, "apart")
    one, two = apart.alias("one"), apart.alias("two")
    total = F.col("one.n") + F.col("two.n")
    sized = F.least("one.n", "two.n") * 100 >= F.greatest("one.n", "two.n") * percent
    # a shingle in one set only turns one parity
    turned = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"one.{p}").bitwiseXOR(F.col(f"two.{p}"))) for p in PARITIES])
    near = turned * (100 + percent) <= total * (100 - percent)
    first = ~F.arrays_overlap("one.before", "two.before")  # else an earlier signature has the pair
    pairs = one.join(two, (F.col("one.signature") == F.col("two.signature")) & (F.col("one.label") < F.col("two.label")) & sized & near & first)
    pairs = pairs.select(F.col("one.class").alias("a"), F.col("two.class").alias("b")).distinct()
    pairs = stored(_possible(pairs, classes, percent), folder, "pairs")
    if pairs.limit(1).count():
        # the links found there join whole components
        more = _linked(pairs, classes, rows, folder, "pair_sets", percent)
        to = labels.toDF("class", "label")
        for end in ("u", "v"):
            more = more.join(to.toDF(end, "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        joined = components(more, folder, "joined").toDF("label", "last")
        # every class of a component, its smallest too, then what the component was joined to
        to = to.unionByName(joined.select(F.col("label").alias("class"), "label"))
        labels = stored(to.join(joined, "label", "left").select("class", F.coalesce("last", "label").alias("label")), folder, "labels")

    small = broadcast_up_to(labels.toDF("class", "label"), BROADCAST_CLASSES)
    whole = classes.join(small, "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    return members, whole.join(whole.groupBy("label").agg(F.min("least").alias("first")), "label").select("class", "first")


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text) with one row of each group of :func:`near_duplicates`: that of the smallest doc_id,
    a null id counting as the largest; among rows of that id the one whose text has the smallest hash, and among rows
    equal in both the one whose columns have.  Rows whose text has no words are no copies of anything and stay."""
    folder = shared_folder(docs.sparkSession)
    members, found = _grouped(docs, percent, "doc_id", "text")

    def row_key(text_key: Column) -> Column:
        return F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("|"), text_key)

    # equal rows are one here, with a count
    rows = members.filter("n > 0").groupBy("class", "doc_id", "text_key").agg(F.count("*").alias("copies")).join(found, "class")
    rows = stored(rows.select(row_key(F.col("text_key")).alias("key"), "copies", (F.expr(_PLACE).eqNullSafe(F.col("first"))).alias("stays")), folder, "decided")
    gone, again = (stored(rows.filter(f).select("key").distinct(), folder, name) for f, name in (("not stays", "gone"), ("stays and copies > 1", "again")))
    key = free_name(docs, "_row_key")
    left = docs.withColumn(key, row_key(F.xxhash64("text"))).join(broadcast_up_to(gone, BROADCAST_ROWS).toDF(key), key, "left_anti")
    if not again.limit(1).count():
        return left.select([F.col(f"`{c}`") for c in docs.columns])
    small = broadcast_up_to(again, BROADCAST_ROWS).toDF(key)
    own = [F.col(f"`{c}`") for c in docs.columns]
    one = F.min_by(F.struct(*own), F.xxhash64(*own)).alias("row")
    return left.join(small, key, "left_anti").select(own).union(left.join(small, key, "left_semi").groupBy(key).agg(one).select("row.*"))
