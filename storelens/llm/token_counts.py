"""Token counts of whole texts under a SentencePiece BPE model, lengths only.

A text is cut at *safe boundaries*: a space whose left neighbour is neither a
space nor U+2581 and that is followed by more text.  No piece of the model holds
the space mark anywhere but in a leading run (checked when the model is loaded),
so no merge crosses such a place; the space itself comes back as the dummy
prefix of the right-hand fragment.  The count of a text is therefore the sum of
the counts of its fragments.  The fragments that a worker has not met before are
encoded in batches of about ``batch_bytes``, so one very long text fills several
batches and many short ones share a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import require

MARK = "▁"
_SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[\\s\\S])")
_ODD = re.compile(f"^ | $|  |{MARK}")


def fragments(text: str) -> list[str]:
    """The text cut at its safe boundaries (the spaces there are dropped)."""
    return _SAFE.split(text) if _ODD.search(text) else text.split(" ")


class Counter:
    """Counts tokens with a bounded memory of fragments seen before."""

    def __init__(self, model: str, batch_bytes: int, memory: int) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.batch_bytes, self.memory, self.known = batch_bytes, memory, {"": 0}

    def learn(self, fresh: set[str]) -> None:
        batch, size = [], 0
        for f in chain(fresh, [None]):
            if batch and (f is None or size + len(f) > self.batch_bytes):
                self.known.update(zip(batch, map(len, self.model.encode(batch, num_threads=1))))
                batch, size = [], 0
            if f is not None:
                batch.append(f)
                size += len(f)

    def counts(self, texts: list[str]) -> list[int]:
        parts = [fragments(t) if self.splits else [t] for t in texts]
        if len(self.known) > self.memory:
            self.known = {"": 0}
        self.learn(set(chain.from_iterable(parts)) - self.known.keys())
        known = self.known
        return [sum(map(known.__getitem__, p)) for p in parts]


def in_byte_batches(texts: list[str], limit: int) -> Iterator[list[str]]:
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > limit:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def with_token_counts(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", out: str = "n_tokens",
                      batch_bytes: int = 1 << 18, memory: int = 500_000) -> DataFrame:
    """``docs`` with ``out`` (tokens of the whole text, without begin and end) and
    ``over_limit`` (more than ``limit``); only lengths leave the Python workers.

    ``model`` is the path of a SentencePiece model that every executor can open.
    A null text counts as empty: 0 tokens.  Repeated rows are counted each; an
    empty table gives an empty table; columns already named ``out`` or
    ``over_limit`` are replaced, others pass through.
    """
    require(docs, text)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(model, batch_bytes, memory)
        for texts in batches:
            # 16 batches' bytes at a time: the fragments of one step stay small
            steps = in_byte_batches([t or "" for t in texts.to_pylist()], 16 * batch_bytes)
            yield pa.array([n for step in steps for n in counter.counts(step)], pa.int64())

    return docs.withColumn(out, count(F.col(f"`{text}`"))).withColumn("over_limit", F.col(f"`{out}`") > limit)
