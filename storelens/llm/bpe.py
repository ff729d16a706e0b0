"""BPE encoding by forced-boundary splitting, and decoding.

Two adjacent symbols of a word that never stand side by side inside any token of
the vocabulary cannot be merged across, whatever the merges around them do.  Such
a place is a *forced boundary*: the fragments between forced boundaries are merged
independently and their ids concatenated.  A worker remembers
the words, and the chunks between white space, that it has met, up to a fixed number.  Words are cut from the text as the tokenizer file
says (normaliser and splitting pattern).
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import free_name, require

#: Beyond these characters (up to Latin Extended-B, no combining marks) the tokenizer
#: file's own normaliser and splitter are asked, since Unicode versions may differ; also
#: for the four separators that only Python takes for white space.
_UNUSUAL = regex.compile("[^\u0000-\u001b\u0020-ɏ]")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the rest for U+0100 and following, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder for one tokenizer file (byte-level BPE with word ends)."""

    def __init__(self, path: str, memory: int = 400_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if spec["decoder"] is not None or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: not a word-end BPE file of the supported form")
        self.library = Tokenizer.from_file(path)
        self.end, self.ids = model["end_of_word_suffix"], model["vocab"]
        #: Merging inside a fragment: a word's last fragment ends in the word end, the others don't.
        self.last = self.library.model
        self.inner = BPE(self.ids, [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.token = {i: t for t, i in (self.ids | self.special).items()}
        #: Symbol pairs that stand side by side inside some token; all others force a cut.
        self.joined = {pair for t in self.ids for s in [self.symbols(t)] for pair in zip(s, s[1:])}
        self.table = dict(enumerate(byte_symbols()))
        self.memory, self.chunks, self.words = memory, {}, {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def fragments(self, word: list[str]) -> list[tuple[str, ...]]:
        """The symbols of a word cut at every forced boundary."""
        if all(p in self.joined for p in zip(word, word[1:])):
            return [tuple(word)]
        out, start = [], 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in self.joined:
                out.append(tuple(word[start:i]))
                start = i
        return [*out, tuple(word[start:])]

    def learn(self, chunk: str) -> tuple[bytes, str]:
        """Ids of a chunk without white space (little-endian 32-bit integers), and its decoded text."""
        known, table = self.words.get, self.table
        both = [known(w) or self.merged(w, "".join([table[b] for b in w.encode()])) for w in self.word.findall(chunk)]
        out = both[0] if len(both) == 1 else (b"".join([a for a, _ in both]), " ".join([b for _, b in both]))
        if len(self.chunks) > self.memory:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = out
        return out

    def merged(self, key: str | None, word: str) -> tuple[bytes, str]:
        """A word (in byte symbols) cut at its forced boundaries, each fragment merged on its own; remembered under
        ``key``, the word as the text has it, if there is one."""
        *inner, last = self.fragments([*word[:-1], word[-1] + self.end])
        tokens = [t for p in inner for t in self.inner.tokenize("".join(p))]
        tokens += self.last.tokenize("".join(last)[: -len(self.end)])
        out = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens]), " ".join([t.value for t in tokens])
        if len(self.words) > self.memory:
            self.words.clear()
        if key is not None and len(key) <= 64:
            self.words[key] = out
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(self.token[i] for i in ids)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text (little-endian unsigned 32-bit) and the decoded text."""
        both = []
        for piece in self.special_pattern.split(text) if "<|" in text else [text]:
            if piece in self.special:
                both.append((struct.pack("<I", self.special[piece]), piece))
            elif _UNUSUAL.search(piece):
                plain = self.library.normalizer.normalize_str(piece)
                both += [self.merged(None, w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            else:
                known, learn = self.chunks.get, self.learn
                both += [known(c) or learn(c) for c in piece.lower().split()]
        return b"".join([a for a, _ in both]), " ".join([b for a, b in both if a])


def _udf(path: str, kind: str, make):
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ForcedBoundaryBpe(path)
        for texts in batches:
            yield make(bpe, texts)

    return run


def with_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of token ids of the whole text, special strings as
    their own ids, nothing added) and, where ``decoded`` names a column, the decoded text.

    ``path`` is a tokenizer file that every executor can open.  A null text is an
    empty one: no ids, decoded to an empty string.  Repeated rows are encoded each,
    an empty table stays empty, columns of the output names are replaced, others
    pass through.
    """
    require(docs, text)
    out = free_name(docs, "_bpe")

    def make(bpe: ForcedBoundaryBpe, texts: pa.Array) -> pa.Array:
        both = [bpe.encode(t or "") for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(a) // 4 for a, _ in both])]).astype("int32")
        values = np.frombuffer(b"".join(a for a, _ in both), "<u4").astype("int32")
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                                           pa.array([b for _, b in both], pa.string())], names=["ids", "decoded"])

    docs = docs.withColumn(out, _udf(path, "struct<ids:array<int>,decoded:string>", make)(F.col(f"`{text}`")))
    docs = docs.withColumn(ids, F.col(f"{out}.ids"))
    if decoded:
        docs = docs.withColumn(decoded, F.col(f"{out}.decoded"))
    return docs.drop(out)


def with_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` (hex of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (hex of the decoded text): the
    same encoding as :func:`with_ids`, of which only digests leave the worker."""
    require(docs, text)
    out = free_name(docs, "_bpe")

    def make(bpe: ForcedBoundaryBpe, texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            ids, decoded = bpe.encode(t or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                          names=["n", "ids", "decoded"])

    kind = "struct<n:bigint,ids:string,decoded:string>"
    return (docs.withColumn(out, _udf(path, kind, make)(F.col(f"`{text}`")))
            .withColumns({"n_tokens": F.col(f"{out}.n"), "ids_sha256": F.col(f"{out}.ids"),
                          "decoded_sha256": F.col(f"{out}.decoded")}).drop(out))

