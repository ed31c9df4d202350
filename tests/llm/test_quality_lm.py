"""The language model against a plain one that goes through every text position by position."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowloom.llm import quality_lm
from flowloom.llm.quality_lm import Shard, _common, counted, probabilities, scored

ORDER = 5
DOCS = "doc_id long, text string, lang string, n long, row long"


def grams(text):
    at = "\x02" * (ORDER - 1) + (text or "").replace("\0", "\1") + "\x03"
    return [at[i:i + ORDER] for i in range(len(at) - ORDER + 1)]


def plain_model(trained, everything):
    counts = {ORDER: Counter(g for t in trained for g in grams(t))}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    letters = len({g[-1] for t in everything for g in grams(t)}) + 1
    discount, total, freed = {}, defaultdict(float), defaultdict(float)
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else i / 2 for i in (1, 2, 3)]
        discount[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        for g, c in table.items():
            total[k, g[:-1]] += c
            freed[k, g[:-1]] += discount[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / letters
        k, below = len(g), p(g[1:])
        if (k, g[:-1]) not in total:
            return below
        c = counts[k][g]
        return ((c - discount[k][min(c, 3) - 1] if c else 0) + freed[k, g[:-1]] * below) / total[k, g[:-1]]

    return p


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_costs_are_those_of_a_plain_model(spark, monkeypatch, most):
    monkeypatch.setattr(quality_lm, "PIECE", 7)
    trained = ["the cat sat on the mat", "the bat sat on the hat", "a cat and a bat", "漢字 und Wörter"] * 3 + ["one more"]
    texts = trained[:5] + ["the rat", "", None, "zzz\0", "the cat sat on the mat and the " * 40, "\U0001F600 漢字"]
    rows = [(None if i == 3 else i, t, "en", 1, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = counted(spark.createDataFrame([(t,) for t in trained], "text string")).cache()
    every = counted(docs).withColumnRenamed("c", "met").cache()
    got = {r.doc_id: (r.n, r.micro) for r in scored(docs, probabilities(model, every), most=most).collect()}
    p = plain_model(trained, texts)
    for doc_id, text, *_ in rows:
        costs = [round(-math.log(p(g)) * 1e6) for g in grams(text)]
        n, micro = got[doc_id]
        assert n == len(costs) and micro == pytest.approx(sum(costs), abs=len(costs))


def test_the_common_part_keeps_its_bound(spark):
    table = spark.range(1, 2001).selectExpr("id h", "cast(1 as int) micro", "cast(4000 div id as bigint) met")
    for most in (5000, 300, 1):
        least, h, micro = _common(table, most)
        assert len(h) == len(micro) == table.where(f"met >= {least}").count() <= most
    assert len(_common(table, 300)[1]) > 200


def test_an_n_gram_without_probability_stops_the_job(spark):
    docs = spark.createDataFrame([(1, "abcdef", "en", 1, 1)], DOCS)
    every = counted(docs).withColumnRenamed("c", "met")
    some = probabilities(counted(docs), every).where("g <> 'bcdef'")
    with pytest.raises(Exception, match="no probability"):
        scored(docs, some, most=0).collect()


def test_look_up():
    h = np.arange(1, 5000, 3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shard = Shard(h, np.arange(1, len(h) + 1).astype(np.int32))
    assert (shard.look_up(h) == np.arange(1, len(h) + 1)).all() and not shard.look_up(h + np.uint64(1)).any()


def test_a_task_spells_few_ngrams_at_once_and_counts_them_all():
    letters = np.random.default_rng(4).integers(0x4E00, 0x4E00 + 3_000, 260_000)
    text = "".join(map(chr, letters))
    counter = quality_lm.Counter(3)
    batches = [b for t in (text[:130_000], text[130_000:], text[:130_000]) for b in counter.add(*quality_lm.points([t], 3))]
    batches += counter.flush()
    assert max(b.num_rows for b in batches) <= 100_000
    assert sum(sum(b.column("c").to_pylist()) for b in batches) == 3 * (130_000 + 1)
