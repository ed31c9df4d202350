"""The stratified search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from flowloom.llm import lexical_search
from flowloom.llm.lexical_search import indexed, search

DOCS = "doc_id long, text string, m long, term string"
ITEMS = "item_id long, text string, ids string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    docs = [(d[0], Counter(terms(d[1]))) for d in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text, *_ in items:
        asked, scored = Counter(terms(text)), []
        for doc_id, c, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, x in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def answers(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choices(words, weights=[200 / (j + 1) for j in range(200)], k=rng.choice([1, 3, 10, 11, 12, 40, 41, 300]))), 1, "x")
            for i in range(n)]
    docs += [(1000 + i, "Same TEXT,again w150", 1, "x") for i in range(60)] + [(5, "same text again", 1, "x"), (5, "same text again", 1, "x")]
    docs += [(None, "same text again", 1, "x"), (2000, None, 1, "x"), (2001, " ", 1, "x"), (2002, "Émile ÉMILE 漢字 naïve_x\x00y", 1, "x"), (2003, "w1 " * 5000, 1, "x")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30))), "x") for i in range(30)]
    items += [(100, "same same text", ""), (101, None, ""), (102, "..", ""), (103, "nowhere", ""), (104, "Émile 漢字 X y", ""), (None, "w1 w2", ""), (7, "w3", ""), (7, "w3", "")]
    return docs, items


@pytest.mark.parametrize(("group", "block", "k"), [(256, 1 << 15, 20), (30, 50, 3)])
def test_equal_to_scoring_every_document(spark, monkeypatch, group, block, k):
    monkeypatch.setattr(lexical_search, "BATCH_ITEMS", group)
    monkeypatch.setattr(lexical_search, "CELLS", 1 << 22 if group > 8 else 40)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    docs, items = corpus()
    index = indexed(spark.createDataFrame(docs, DOCS).repartition(3))
    assert answers(search(index, spark.createDataFrame(items, ITEMS), k)) == brute(docs, items, k)


def test_strata_below_the_kth_score_are_not_visited(spark, monkeypatch):
    docs = [(i, "rare " * 3 + "common", 1, "x") for i in range(200)] + [(1000 + i, "common " + "pad " * (i % 90 + 10), 1, "x") for i in range(900)]
    seen = []
    plain = lexical_search._visited

    def spy(index, asked, alive, k):
        seen.append({r.m for r in alive.collect()})
        return plain(index, asked, alive, k)

    monkeypatch.setattr(lexical_search, "_visited", spy)
    items = [(1, "rare common", "")]
    index = indexed(spark.createDataFrame(docs, DOCS))
    assert answers(search(index, spark.createDataFrame(items, ITEMS))) == brute(docs, items, 20)
    strata = index.rows.select("m").distinct().count()
    assert len(set().union(*seen)) < strata / 4


def test_postings_of_a_term_are_grouped_by_tf_in_a_stratum(spark):
    docs = [(1, "a b", 1, "x"), (2, "b a", 1, "x"), (3, "a a", 1, "x"), (4, "a c d", 1, "x")]
    index = indexed(spark.createDataFrame(docs, DOCS).coalesce(1))
    rows = index.rows.toArrow().combine_chunks().to_batches()[0]
    got = sorted((rows["m"][i].as_py(), *g) for i in range(rows.num_rows) for g in zip(
        lexical_search._names(rows, i).to_pylist(), *(lexical_search._numbers(rows[x][i]).tolist() for x in ("tf", "n"))) if g[0] == "a")
    assert sorted(len(lexical_search._numbers(x)) for x in rows["places"]) == [3, 5]
    assert (index.n_docs, index.n_terms) == (4, 9)
    assert got == [(97, "a", 1, 2), (97, "a", 2, 1), (108, "a", 1, 1)]


def test_no_rows(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "a", 1, "x")], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert search(indexed(docs), full[1]).count() == 0
    assert search(indexed(full[0]), items).count() == 0
    assert search(indexed(full[0]), full[1]).count() == 1
