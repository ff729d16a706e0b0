"""Periodic runs in word sequences, found through the dictionary of basic factors.

The words of a text get names; two words of a text have one name if they are equal.
From the names of the factors of length L come those of length 2 L (a name for every
pair of adjacent names), so each power-of-two length has its table of names: the
dictionary of basic factors.  A factor that occurs once in its text has no name,
since no longer factor that begins with it can recur.

For every length L, an occurrence whose successor lies at a distance d of at most
2 L, and whose successor has its own successor at d again, stands in an arithmetic
progression and proposes the period d.  The first place of each progression is
extended to both sides by comparing the names of the longest factors first.

Why no run is missed: a run of smallest period q and at least 4 q words holds, at its
start, the factor of length L with q <= L < 2 q.  A word sequence of primitive root q
equals none of its own shifts by less than q, so the successors of that factor are
exactly q and 2 q words further, both inside the run.  For the same reason a
proposed period that holds for 4 d words is the smallest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import free_name, require

#: Words named at a time: texts are taken together up to about this many (a longer one alone).
STEP_WORDS = 400_000


def basic_factors(names: np.ndarray) -> list[np.ndarray]:
    """The names of all factors of length 1, 2, 4, ...; -1 where a factor occurs once or passes the end."""
    def only_repeated(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(names), -1, np.int32)
        if len(at):
            _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
            out[at] = np.where(times[name] > 1, name, -1)
        return out

    at = np.arange(len(names))
    levels, step = [only_repeated(names, at)], 1
    while 2 * step <= len(names):
        last = levels[-1]
        at = np.flatnonzero(last[:len(names) - step] >= 0)
        at = at[last[at + step] >= 0]
        if not len(at):
            break
        levels.append(only_repeated(last[at].astype(np.int64) * (len(names) + 1) + last[at + step], at))
        step *= 2
    return levels


def _proposals(level: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and distances of the arithmetic progressions among the occurrences at one level."""
    at = np.flatnonzero(level >= 0)
    at = at[np.argsort(level[at], kind="stable")]
    gap = np.zeros(len(level), np.int64)
    same = level[at[:-1]] == level[at[1:]]
    gap[at[:-1][same]] = (at[1:] - at[:-1])[same]
    i = np.flatnonzero((gap > 0) & (gap <= 2 * length))
    d = gap[i]
    first = (gap[i + d] == d) & ((i == 0) | (gap[i - 1] != d))
    return i[first], d[first]


def _matching(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from places a and b on (or before them) are equal; a < b."""
    n, total = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length, level, open_ = 1 << k, levels[k], np.arange(len(a))
        while len(open_):
            x, y = (a[open_] + total[open_], b[open_] + total[open_]) if forward else \
                   (a[open_] - total[open_] - length, b[open_] - total[open_] - length)
            ok = (y < n) if forward else (x >= 0)
            ok[ok] = (level[x[ok]] >= 0) & (level[x[ok]] == level[y[ok]])
            open_ = open_[ok]
            total[open_] += length
            if k < len(levels) - 1:  # below the longest length one step is all there can be
                break
    return total


def find_runs(names: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """All runs of a sequence of word names as sorted rows (start, length, period): maximal stretches
    of smallest period q and at least ``max(least, times * q)`` words; ``times`` is 4 or more."""
    if times < 4:
        raise ValueError("the proof of completeness needs four periods a run")
    levels = basic_factors(np.asarray(names, np.int64))
    found = [_proposals(level, 1 << k) for k, level in enumerate(levels)]
    i, d = (np.concatenate([f[j] for f in found]) for j in (0, 1))
    start = i - _matching(levels, i, i + d, forward=False)
    length = i + d + _matching(levels, i, i + d, forward=True) - start
    keep = length >= np.maximum(least, times * d)
    return np.unique(np.stack([start[keep], length[keep], d[keep]], axis=1), axis=0)


def _named(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of several texts in one sequence (no name is shared by two texts), and where each text begins."""
    out, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(w) for w in texts])])


def runs_of_texts(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[tuple[np.ndarray, bytes]]:
    """For each text (a list of words) its runs and the kept words joined by one space: a word goes
    if a run contains it after that run's first period."""
    names, begin = _named(texts)
    runs = find_runs(names, least, times)
    cover = np.zeros(len(names) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(cover)[:-1] == 0
    cut = np.searchsorted(runs[:, 0], begin)
    out = []
    for k, words in enumerate(texts):
        own = runs[cut[k]:cut[k + 1]] - [begin[k], 0, 0]
        mask = kept[begin[k]:begin[k + 1]]
        out.append((own, b" ".join(words if mask.all() else [w for w, keep in zip(words, mask) if keep])))
    return out


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with ``runs`` (array of (start, length, period) in words from 0, by start, then
    period) and ``collapsed`` (the kept words, joined by one space).

    Words are maximal stretches of bytes outside the six ASCII white-space characters.  A null or
    empty text has no words: no runs, an empty ``collapsed``.  Repeated rows are treated each; an
    empty table stays empty; columns of the output names are replaced, others pass through.  A text
    takes 4 bytes a word and factor length reached while its runs are found, whatever its length.
    """
    require(docs, text)
    out = free_name(docs, "_runs")
    kind = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>"

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done, step, size = [], [], 0
            for t in batch:
                words = (t.as_py() or b"").split()  # splits at just these six characters
                if step and size + len(words) > STEP_WORDS:
                    done += runs_of_texts(step, least, times)
                    step, size = [], 0
                step.append(words)
                size += len(words)
            done += runs_of_texts(step, least, times) if step else []
            rows = np.concatenate([r for r, _ in done] or [np.zeros((0, 3), np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r, _ in done])]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(rows[:, j].copy(), pa.int64()) for j in range(3)], names=["start", "length", "period"])
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array([c for _, c in done], pa.binary())],
                                             names=["runs", "collapsed"])

    return (docs.withColumn(out, find(F.col(f"`{text}`").cast("binary")))
            .withColumns({runs: F.col(f"{out}.runs"), collapsed: F.col(f"{out}.collapsed").cast("string")}).drop(out))
