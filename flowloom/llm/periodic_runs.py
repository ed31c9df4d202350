"""Periodic runs of words in documents, by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are identical), at least `max(MIN_LENGTH, REPEATS * q)`
words long, that no neighbouring word extends with that period. The dictionary names the factors of every power-of-two
length: equal stretches have equal names, and names of length 2L are pairs of names of length L. Only positions whose
factor occurs again in its document are kept, so ordinary text leaves the dictionary after two or three levels.

At each length L the next occurrence of a factor within 2L words proposes its distance as a period. Inside a run of
period q, at the level with q <= L < 2q, every position's successor lies exactly q words on (a nearer one would make the
factor, and with it the run, periodic with a divisor of q). The proposals of a run thus form an arithmetic
progression of more than q positions, and a proposal without such a progression needs no look at the text. Progressions
are extended to both sides by comparing words, in steps that double, and equal results of several levels are one run.

All documents of an Arrow slice share one dictionary, whose names contain the document; words are numbered exactly, not hashed.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, compared as bytes. NULL, empty and blank texts have no words, no runs and
an empty collapsed text. Rows without doc_id and repeated rows are treated like others, one result each. Runs may
overlap; a word is dropped if any run holds it after that run's first q words. Extra columns are ignored, a column called
like a result too. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: A run has at least so many words, and so many times its period.
MIN_LENGTH, REPEATS = 6, 4
#: Text whose positions are named at once; bounds the arrays of a task.
SLICE_BYTES = 4 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of keys, and a mark on the keys that occur again."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names, counts[names] > 1


def progressions(words: np.ndarray, doc: np.ndarray, stop: np.ndarray):
    """Arrays `(first, last, period)`: stretches of positions whose factor comes again `period` words on and no earlier.

    `doc` and `stop` give each position's document and where it ends. `last` is the end of what is known to be periodic.
    """
    n, length = len(words), 1
    names, again = _named(doc * (words.max(initial=0) + 1) + words)
    at, names = np.flatnonzero(again), names[again]
    name_of = np.empty(n, np.int64)
    while len(at):
        order = np.argsort(names, kind="stable")
        p, s = at[order], names[order]
        gap = p[1:] - p[:-1]
        near = (s[1:] == s[:-1]) & (gap <= 2 * length)
        where, period = p[:-1][near], gap[near]
        order = np.lexsort((where, period))
        where, period = where[order], period[order]
        fresh = np.ones(len(where), bool)
        fresh[1:] = (period[1:] != period[:-1]) | (where[1:] != where[:-1] + 1)
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(where)))
        enough = size > period[first]
        first, size = first[enough], size[enough]
        yield where[first], where[first] + size - 1 + length + period[first], period[first]
        # Factors of twice the length: both halves must occur again.
        name_of[:] = -1
        name_of[at] = names
        whole = at + 2 * length <= stop[at]
        at, names = at[whole], names[whole]
        right = name_of[at + length]
        at, names, right = at[right >= 0], names[right >= 0], right[right >= 0]
        names, again = _named(names * n + right)
        at, names = at[again], names[again]
        length *= 2


def _reach(words: np.ndarray, at: int, bound: int, period: int, step: int) -> int:
    """How far from `at` towards `bound` words equal those `period` further on (step 1) or stay so backwards (step -1)."""
    width = 16
    while at != bound:
        k = min(width, abs(bound - at))
        lo = at if step > 0 else at - k
        same = words[lo:lo + k] == words[lo + period:lo + k + period]
        if not same.all():
            return at + int(np.argmin(same)) if step > 0 else at - int(np.argmin(same[::-1]))
        at, width = at + step * k, width * 2
    return at


def runs_of(words: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> list[set[tuple[int, int, int]]]:
    """The runs `(start, length, period)` of each document; `begins` has where each document begins, and the end."""
    found: list[set] = [set() for _ in range(len(begins) - 1)]
    for first, last, periods in progressions(words, doc, begins[1:][doc]):
        for i, j, q in zip(first.tolist(), last.tolist(), periods.tolist(), strict=True):
            d = int(doc[i])
            lo, hi = int(begins[d]), int(begins[d + 1])
            start = _reach(words, i, lo, q, -1)
            end = _reach(words, j - q, hi - q, q, 1) + q
            if end - start >= max(MIN_LENGTH, REPEATS * q):
                found[d].add((start - lo, end - start, q))
    return found


def collapsed(words: list[bytes], runs) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """`(doc_id, n_words, runs, collapsed)` for every row of `docs` (doc_id, text); runs by start, then period.

    `edit(doc_id, words)` may change a document's words before they are searched.
    """
    def search(batch):
        number = defaultdict(count().__next__)
        texts, numbers = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            words = edit(doc_id, words) if edit else words
            texts.append(words)
            numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        sizes = np.array([len(w) for w in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        found = [sorted(r, key=lambda x: (x[0], x[2])) for r in runs_of(
            np.concatenate(numbers) if numbers else np.empty(0, np.int64), np.repeat(np.arange(len(sizes)), sizes), begins)]
        return pa.record_batch([
            batch.column("doc_id"), pa.array(sizes),
            pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], pa.list_(RUN)),
            pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
        ], ["doc_id", "n_words", "runs", "collapsed"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                     search, SCHEMA, slice_bytes=SLICE_BYTES)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document (by the checksum of its id) with its tail made periodic, as the registered query wants it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def report(found: DataFrame) -> DataFrame:
    """One line a document: the number of runs, the longest one (then the first, then that of least period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
