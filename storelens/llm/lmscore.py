"""Cross-entropy difference of a target and a background n-gram model (Moore-Lewis scoring).

Both models are word bigrams that back off to the unigram, over one vocabulary, the words of
the whole corpus:

    P(w | v) = (n(v, w) + BACKOFF * P(w)) / (n(v) + BACKOFF)

The background is every document, the target those that the caller marks.  A document's score
is the mean over its tokens of -log P_target + log P_background: low means like the target.

Every word and every bigram of the corpus is counted.  Texts are packed into blocks of about
BLOCK_BYTES.  A block asks for the counts of its distinct words and bigrams: their 64-bit
hashes, with the block's own counts, go to the bucket of the hash's leading bits, packed as one
row per block and bucket.  A bucket adds up what all blocks say of a hash and answers each row
in its own order, so an answer needs no key, and no row per text and bigram ever moves.  The
block, hashed a second time, meets its answers and scores its texts whole.  A hash appears once
per block, however frequent it is, so no bucket is hot; nothing of the vocabulary's size is
held by the driver or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from storelens.llm.common import require, shared_folder, stored
from storelens.llm.wordhash import WordHasher, alphanumeric, buffers, byte_slices

ALPHA = 0.5
#: Tokens that the unigram model counts for in every context of the word bigrams.
BACKOFF = 100.0
SLICE_BYTES = 1 << 20
#: Text that is counted and scored at a time (a longer text makes a longer block).
BLOCK_BYTES = 2 << 20
#: Blocks whose bigrams, or words, fill one bucket.
BLOCKS_A_BUCKET = {"bigram": 4, "word": 16}
#: Pairs of counts, in all and in target texts: a word has one as a token and one as a context, a bigram one.
PAIRS = {"word": 2, "bigram": 1}
#: Code of a pair that is told apart: no count in target texts exceeds that in all.
LARGE = 15


class Block:
    """The tokens of a block's texts, by their places among its distinct words and bigrams.

    ``words`` and ``bigrams`` ascend; the beginning of a text is the word 0."""

    def __init__(self, hasher: WordHasher, texts: pa.Array) -> None:
        hashes, sizes = [np.zeros(1, "u8")], [np.zeros(0, "int64")]
        for some in byte_slices(texts, SLICE_BYTES):
            word, _, at = hasher(some)
            hashes.append(word)
            sizes.append(np.diff(at))
        token = np.concatenate(hashes)
        del hashes
        self.sizes = np.concatenate(sizes)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = np.concatenate([np.ones(1, bool), self.row[1:] != self.row[:-1]])[:len(self.row)]
        self.words, at = np.unique(token, return_inverse=True)
        self.word, self.context = at[1:], np.where(first, at[0], at[:-1])
        before = np.where(first, np.uint64(0), token[:-1])
        # one number for a bigram: the context's hash turned by one bit, and the word's
        bigram = (before << np.uint64(1) | before >> np.uint64(63)) ^ token[1:]
        self.bigrams, self.bigram = np.unique(bigram, return_inverse=True)

    def counts(self, marked: np.ndarray) -> dict[str, np.ndarray]:
        """The PAIRS of each distinct word and bigram; ``marked`` tells the target texts."""
        target = np.repeat(marked, self.sizes).astype("f8")

        def pair(at: np.ndarray, n: int) -> list[np.ndarray]:
            return [np.bincount(at, minlength=n), np.bincount(at, target, n)]

        words = pair(self.word, len(self.words)) + pair(self.context, len(self.words))
        return {"word": np.stack(words, axis=1).astype("int64"), "bigram": np.stack(pair(self.bigram, len(self.bigrams)), axis=1).astype("int64")}


def _packing(schema: pa.Schema):
    out = pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("texts", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block: its number, the bytes of its texts, and its rows as a compressed Arrow stream."""
        first, held, size, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(held).cast(schema).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=out)

        for batch in batches:
            done = 0
            for texts in byte_slices(batch.column("text"), BLOCK_BYTES):
                held.append(batch.slice(done, len(texts)))
                done += len(texts)
                size += int(buffers(texts)[1][-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, made = [], 0, made + 1
        if held:
            yield block()

    return packed


def _unpacked(texts: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(texts.as_buffer()).read_all().combine_chunks()


def _texts(rows: pa.Table) -> pa.Array:
    return pa.concat_arrays(rows["text"].chunks) if len(rows) else pa.array([], pa.string())


def _cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` as binary cells, cut at the row numbers ``cuts``."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = pa.py_buffer((np.asarray(cuts) * width).astype("int32").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def _values(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the cells of a binary column, in order, and where each cell begins."""
    parts, sizes = [np.zeros(0, "u1")], [np.zeros(1, "int64")]
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk):
            at = np.frombuffer(offsets, "int32")[chunk.offset:chunk.offset + len(chunk) + 1]
            sizes.append(np.diff(at).astype("int64"))
            if data is not None:
                parts.append(np.frombuffer(data, "u1")[at[0]:at[-1]])
    return np.concatenate(parts).view(kind), np.cumsum(np.concatenate(sizes)) // np.dtype(kind).itemsize


def _coded(counts: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """Pairs of counts (n, t) as a byte each if n is below 16; the others in cells of their own."""
    pairs = counts.reshape(-1, 2)
    cuts = np.asarray(cuts) * (counts.shape[1] // 2)
    large = pairs[:, 0] > 15
    code = np.where(large, LARGE, pairs[:, 0] << 4 | pairs[:, 1]).astype("u1")
    before = np.concatenate([[0], np.cumsum(large)])
    return [_cells(code, cuts), _cells(pairs[large], before[cuts])]


def _decoded(code: pa.ChunkedArray, large: pa.ChunkedArray, pairs: int) -> np.ndarray:
    code = _values(code, "u1")[0]
    out = np.stack([code >> 4, code & 15], axis=1).astype("int64")
    out[code == LARGE] = _values(large, "int64")[0].reshape(-1, 2)
    return out.reshape(-1, 2 * pairs)


_ASKED = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.binary()), ("high", pa.binary()),
                    ("runs", pa.binary()), ("code", pa.binary()), ("large", pa.binary())])
_ANSWERED = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("block", pa.int64()), ("code", pa.binary()), ("large", pa.binary()),
                       ("n", pa.int64()), ("t", pa.int64()), ("words", pa.int64())])


def _asking(buckets: dict[str, int]):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per kind and bucket of a block: its ascending keys as their low 48 bits and runs of equal high bits."""
        hasher = WordHasher(alphanumeric())
        for batch in batches:
            for number, texts in zip(batch.column("block"), batch.column("texts")):
                rows = _unpacked(texts)
                block = Block(hasher, _texts(rows))
                if not len(block.row):
                    continue
                counts = block.counts(rows["target"].to_numpy())
                for kind, keys in (("word", block.words), ("bigram", block.bigrams)):
                    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets[kind]) >> np.uint64(32)).astype("int64")
                    high = (keys >> np.uint64(48)).astype("<u2")
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]])
                    starts = np.union1d(cuts[:-1], np.flatnonzero(np.diff(high)) + 1)
                    run_cuts = np.searchsorted(starts, cuts)
                    n = len(cuts) - 1
                    columns = [pa.array([kind] * n), pa.array(bucket[cuts[:-1]]), pa.array(np.full(n, number.as_py())),
                               _cells(keys.astype("<u8").view("u1").reshape(-1, 8)[:, :6], cuts), _cells(high[starts], run_cuts),
                               _cells(np.diff(np.append(starts, len(keys))).astype("<u4"), run_cuts), *_coded(counts[kind], cuts)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_ASKED)
                # tasks of other stages run in this worker later
                del rows, block, counts, keys, bucket, high, starts, columns
                pa.default_memory_pool().release_unused()

    return asked


def _answered(rows: pa.Table) -> pa.Table:
    """Per row the whole corpus' counts of its keys; the first row has the bucket's totals."""
    kind = rows["kind"][0].as_py()
    low, at = _values(rows["low"], "u1")
    cuts = at // 6
    keys = np.zeros((len(low) // 6, 8), "u1")
    keys[:, :6] = low.reshape(-1, 6)
    high = np.repeat(_values(rows["high"], "<u2")[0], _values(rows["runs"], "<u4")[0]).astype("u8")
    keys = keys.view("<u8").ravel() | high << np.uint64(48)
    counts = _decoded(rows["code"], rows["large"], PAIRS[kind])
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([np.ones(1, bool), np.diff(keys[order]) != 0])
    whole = np.add.reduceat(counts[order], np.flatnonzero(new), axis=0)
    totals = np.zeros((3, len(rows)), "int64")
    if kind == "word":
        totals[:, 0] = whole[:, 0].sum(), whole[:, 1].sum(), np.count_nonzero(whole[:, 0])
    counts[order] = whole[np.cumsum(new) - 1]
    return pa.Table.from_arrays([rows["kind"], rows["bucket"], rows["block"], *_coded(counts, cuts), *map(pa.array, totals)], schema=_ANSWERED)


def _scoring(total, schema: pa.Schema):
    def scored(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _unpacked(blocks["texts"][0])
        block, answers = Block(WordHasher(alphanumeric()), _texts(rows)), answers.sort_by("bucket")
        whole = {}
        for kind, pairs in PAIRS.items():
            own = answers.filter(pc.equal(answers["kind"], kind))
            whole[kind] = _decoded(own["code"], own["large"], pairs).T.astype("f8")
        sizes, sums = block.sizes, np.zeros(len(block.sizes))
        if len(block.row):
            n, t, cn, ct = whole["word"]
            # what the unigram adds to either count of a bigram, and the difference that its context makes
            pn, pt = ((c + ALPHA) * (BACKOFF / (tokens + ALPHA * total.words)) for c, tokens in ((n, total.n), (t, total.t)))
            gap = np.log((ct + BACKOFF) / (cn + BACKOFF))
            bn, bt = whole["bigram"]
            part = np.log((bn[block.bigram] + pn[block.word]) / (bt[block.bigram] + pt[block.word])) + gap[block.context]
            sums = np.bincount(block.row, part, len(sizes))
        score = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
        return pa.table([rows["doc_id"].cast(schema.field("doc_id").type), pa.array(sizes), score], schema=schema)

    return scored


def word_cross_entropy_difference(docs: DataFrame, target: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of every row of ``docs``; ``target`` is a condition over them.

    Words are runs of ASCII letters, digits and non-ASCII characters, in lower case.  Null and
    empty texts have no tokens and a null score, as have all documents when no target text has a
    token.  A null condition is false.  Texts of any length are scored whole.  Rows repeated
    with id and text count as often as they occur and score alike; a null id is kept; other
    columns, whatever their names, are ignored; an empty table gives an empty one.
    """
    require(docs, doc_id, text)
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    # packed and written once, so a block stays the same whenever a lost task is run again
    packed = rows.mapInArrow(_packing(to_arrow_schema(rows.schema)), "block long, bytes long, texts binary")
    blocks = stored(packed, folder, "blocks")
    size = (blocks.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES

    buckets = {kind: max(1, size // some) for kind, some in BLOCKS_A_BUCKET.items()}
    key, counts = "kind string, bucket long, block long", "code binary, large binary"
    asked = blocks.select("block", "texts").mapInArrow(_asking(buckets), f"{key}, low binary, high binary, runs binary, {counts}")
    answers = asked.groupBy("kind", "bucket").applyInArrow(_answered, f"{key}, {counts}, n long, t long, words long")
    answers = stored(answers, folder, "answers")
    total = answers.agg(*[F.sum(c).alias(c) for c in ("n", "t", "words")]).first()
    if not total.t:
        return _with_lengths(rows)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("score", T.DoubleType())])
    return (blocks.select("block", "texts").groupBy("block").cogroup(answers.select("kind", "bucket", "block", "code", "large").groupBy("block"))
            .applyInArrow(_scoring(total, to_arrow_schema(schema)), schema))


def _with_lengths(rows: DataFrame) -> DataFrame:
    """Token counts alone, for a corpus without a target."""
    @F.arrow_udf("long")
    def length(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher(alphanumeric())
        for texts in batches:
            yield pa.array(np.concatenate([np.diff(hasher(t)[2]) for t in byte_slices(texts, SLICE_BYTES)] or [np.zeros(0, "int64")]), pa.int64())

    return rows.select("doc_id", length("text").alias("n_tokens"), F.lit(None).cast("double").alias("score"))
