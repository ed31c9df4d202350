"""Runs against a search over all periods, and the query against the same search on a whole small table."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import periodic_runs, queries
from flowloom.llm.common import table

DOCS = "doc_id long, text string, runs int, n_words string"


def brute(words):
    """All runs by their definition: for each period the maximal stretches, less those with a smaller period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def fast(words):
    ids = np.array(words, np.int64)
    (found,) = periodic_runs.runs_of(ids, np.zeros(len(ids), np.int64), np.array([0, len(ids)]))
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60))
def test_binary_words(words):
    assert fast(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=5))
def test_powers_side_by_side(parts):
    words = [w for base, times in parts for w in base * times]
    assert fast(words) == brute(words)


def test_documents_of_a_slice_do_not_meet():
    words = [1] * 5 + [1] * 5 + [1, 2] * 4 + [2, 1] * 4
    begins = np.array([0, 5, 10, 18, 26])
    doc = np.repeat(np.arange(4), np.diff(begins))
    assert periodic_runs.runs_of(np.array(words), doc, begins) == [set(), set(), {(0, 8, 2)}, {(0, 8, 2)}]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = brute([number[w] for w in words])
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def answers(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_the_query_over_a_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs)
    assert answers(queries.QUERIES["op12_periodic_runs"](spark, sf)) == sorted((expected(*d) for d in docs), key=str)


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "a a a a a a", "a\ta\na\x0ba a", "x " + "b c " * 40 + "y", "漢 字 " * 5, " ".join(rng.choices("ab", k=300)),
             "z " * 50_000, "same text", "same text"]
    rows = [(None if i == 4 else i, t, 1, "x") for i, t in enumerate(texts)] + [(3, "one", 1, "x")]
    got = periodic_runs.report(periodic_runs.periodic_runs(spark.createDataFrame(rows, DOCS), periodic_runs.planted))
    huge = [r for r in got.collect() if r.doc_id == 9]
    assert [(r.n_runs, r.start, r.length, r.period) for r in huge] == [(1, 0, 50_000, 1)]
    assert answers(got.where("doc_id is null or doc_id <> 9")) == sorted((expected(i, t) for i, t, *_ in rows if i != 9), key=str)


@pytest.mark.parametrize("rows", [[]])
def test_no_rows(spark, rows):
    assert periodic_runs.periodic_runs(spark.createDataFrame(rows, DOCS)).count() == 0
