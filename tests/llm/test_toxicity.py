"""The noisy-or model: its gradient against differences, length, the bound of the fit."""

import numpy as np
import pytest

from flowloom.llm import toxicity

DOCS = "doc_id long, text string, score double, spans string"


@pytest.mark.parametrize("seed", range(3))
def test_gradient_is_that_of_the_loss(seed):
    rng = np.random.default_rng(seed)
    words, sents = rng.integers(0, 6, 60), rng.integers(0, 15, 60)
    bags, y = np.sort(np.append(rng.integers(0, 5, 10), range(5))), np.array([1, 0, 1, 0, 0])
    w, bias, leak = rng.random(6), -2.0, -4.0
    g = toxicity.gradient(w, bias, leak, words, sents, bags, y)
    point = np.array([*w, bias, leak])
    for i in range(8):
        step = np.eye(8)[i] * 1e-6
        up, down = (toxicity.loss(x[:6], x[6], x[7], words, sents, bags, y) for x in (point + step, point - step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def corpus(spark):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(300):
        said = [" ".join(f"v{x}" for x in rng.integers(0, 150, 8)) for _ in range(5)]
        if i % 3 == 0:
            said[1] += " moronic"
        rows.append((i, ". ".join(said) + ".", 0.0, ""))
        marks.append((i, int(i % 3 == 0)))
    return rows, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_length_alone_is_not_toxic(spark):
    rows, labels = corpus(spark)
    neutral = "This is a calm remark about the garden. " * 5000
    texts = [*rows, (9001, neutral, 0.0, ""), (9002, neutral + "That was moronic.", 0.0, ""), (9003, None, 0.0, ""), (9004, "", 0.0, "")]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(texts, DOCS), labels).collect()}
    assert got[9001].score <= toxicity.MOST_LEAK and got[9001].score == pytest.approx(got[9003].score) == pytest.approx(got[9004].score)
    assert got[9002].predicted == 1
    assert all(r.spans for r in got.values() if r.predicted)


def test_the_fit_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows, labels = corpus(spark)
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE", 1)
    docs = spark.createDataFrame([r for r in rows for _ in range(3)] + [(3, "long " * 4000, 0.0, "")], DOCS)
    for sample, size in ((50, 1 << 20), (10_000, 3000)):
        bags = []
        plain = docs.sparkSession.createDataFrame

        def spy(data, schema):
            if schema == "doc_id long, h long, toxic int":
                bags.extend(data)
            return plain(data, schema)

        monkeypatch.setattr(docs.sparkSession, "createDataFrame", spy)
        toxicity.train(docs, labels, sample, 2, size)
        monkeypatch.undo()
        seen.append(len(bags))
        assert len(bags) == len(set(bags))
    assert seen[0] == 50 and 3 < seen[1] < 20
