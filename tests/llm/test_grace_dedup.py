"""Grace hash deduplication against a plain dictionary, with buckets so small that all ways of splitting are taken."""

import hashlib
import random
import re

import pytest

from flowloom.llm import grace_dedup
from flowloom.llm.grace_dedup import ContentTable

DOCS = "doc_id long, text string, entry int, row string, kept string"


def brute(rows):
    groups = {}
    for at, (doc_id, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, at))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def check(spark, rows, **bounds):
    got = grace_dedup.deduplicated(spark.createDataFrame(rows, DOCS).repartition(7), **bounds).collect()
    expected, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def odd_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, rng.choice([" ", "\t", "\n\n"]).join(rng.choices(words, k=rng.randint(0, 3))), 1, "x", "y") for i in range(300)]
    rows += [(1000 + i, "hot  text" if i % 3 else "hottext", 0, None, None) for i in range(400)]
    rows += [(2000, None, 0, "", ""), (2001, "", 0, "", ""), (2002, " \x0b\x0c\r", 0, "", ""), (None, "hot text", 0, "", ""), (None, "only here", 0, "", ""),
             (2003, "a b", 0, "", ""), (2004, "ab", 0, "", ""), (2005, "漢 字", 0, "", ""), (2005, "漢 字", 0, "", ""), (-4, "漢字\n", 0, "", "")]
    rows += [(3000 + i, "long " * 500, 0, "", "") for i in range(3)]
    return rows


@pytest.mark.parametrize("bound", [grace_dedup.BUCKET_BYTES, 2000, 700])
def test_equal_to_a_dictionary_for_any_bound(spark, bound, monkeypatch):
    monkeypatch.setattr(grace_dedup, "FOLD_ROWS", 1 << 14 if bound > 2000 else 5)
    check(spark, odd_rows(), bucket_bytes=bound)


def test_a_content_with_very_many_entries_folds_in_rounds(spark):
    entries = spark.range(400).selectExpr(
        "id entry", "unhex(sha2('x', 256)) digest", "cast('x' as binary) content", "97L bytes", "2L n", "id % 7 points", "id best", "id first").repartition(5)
    got = grace_dedup.groups(entries, 1000).select("entry", "n", "points", "best", "first").collect()
    assert sorted(r.entry for r in got) == list(range(400))
    assert {(r.n, r.points, r.best, r["first"]) for r in got} == {(800, 6, 6, 6)}


def test_no_rows(spark):
    assert grace_dedup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_one_digest_does_not_make_contents_equal():
    table, digest = ContentTable(2), bytes(32)
    assert [table.place(digest, c) for c in (b"a", b"b", b"a", b"c", b"b")] == [(0, True), (1, True), (0, False), (2, True), (1, False)]
    assert [table.place(bytes([7] * 32), str(i).encode())[0] for i in range(500)] == list(range(3, 503))
