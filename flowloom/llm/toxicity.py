"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability grows with the weights of the words in it and is zero without such words; a document is toxic if any
sentence is, or by a small leak that every document has once. These combine by noisy-or: `1 - (1 - leak) product(1 - p)`,
so length alone doesn't raise a score. With a bias b and a sum of weights z, a sentence has `1 - p = (1 - s(b + z)) / (1 - s(b))` for
the logistic function s. Weights, bias and leak are trained from document labels alone by gradient steps on the
log-likelihood of the bags; sentence probabilities then say where a document offends.

The fit takes at most `SAMPLE` labelled texts of `SAMPLE_BYTES` in all (those with the smallest hashes of their id and text, whole
texts, repeated rows once), in one task; its vocabulary is the words that occur in at least `MIN_DOCUMENTS` of them. Scoring covers every text.

Defined results: an empty or NULL text is one sentence without words. Documents are labelled by doc_id;
several labels of one document count as toxic if any is. NULL labels and NULL ids are not learnt from; rows without a doc_id
are scored and not held out. Without labels of both kinds every score is 0. Repeated rows are scored each. A document that is
predicted toxic shows a sentence: its likeliest, if none is likely by itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: The greatest number of labelled texts that the fit takes, and their bytes; a text that doesn't fit is left out whole.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
#: A document's leak is this at most, well below the threshold.
MOST_LEAK = 0.05
MIN_DOCUMENTS = 4
STEPS = 150
THRESHOLD = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (5, 7)
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences of a text."""
    return (m.span() for m in SENTENCE.finditer(text))


def terms(text: str) -> set[str]:
    """What a sentence in lower case is judged by: its words, and beginnings of them that inflections share."""
    words = set(WORD.findall(text))
    return words.union(*({w[:n] + "~" for w in words if len(w) > n} for n in PREFIXES))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_bags(texts: list[str], labels: np.ndarray, steps: int = STEPS, min_documents: int = MIN_DOCUMENTS,
             rate: float = 0.1, l1: float | None = None) -> tuple[list[str], np.ndarray, float, float]:
    """Vocabulary, weights, bias and leak of the noisy-or model, by Adam on the mean log-likelihood of the bags.

    Weights are not negative and have an L1 penalty, so that few words carry the model.
    """
    l1 = 4e-4 * (300 / max(300, len(texts))) ** 0.5 if l1 is None else l1
    known: dict[str, int] = {}
    bag_of, sentence_of, word_of, n_sentences, seen = [], [], [], 0, []
    for at, text in enumerate(texts):
        low = text.lower()
        spans = [low[a:b] for a, b in sentences(low)] or [""]
        own: set[int] = set()
        for s in spans:
            ids = {known.setdefault(w, len(known)) for w in terms(s)}
            sentence_of.append(np.full(len(ids), n_sentences, np.int32))
            word_of.append(np.fromiter(ids, np.int32, len(ids)))
            n_sentences += 1
            own |= ids
        bag_of.append(np.full(len(spans), at, np.int32))
        seen.append(np.fromiter(own, np.int32, len(own)))
    bags, sents, words = (np.concatenate(x) for x in (bag_of, sentence_of, word_of))
    often = np.bincount(np.concatenate(seen), minlength=len(known)) >= min_documents
    place = np.cumsum(often) - 1
    keep = often[words]
    sents, words, size = sents[keep], place[words[keep]].astype(np.int32), int(often.sum())
    y, n = labels.astype(float), len(labels)
    w, bias, leak = np.zeros(size), float(np.log(max(y.mean(), 1e-3) / max(n_sentences / n, 1))), float(np.log(max(y.mean(), 1e-3) / 10))
    moments = np.zeros((2, size + 2))
    for step in range(1, steps + 1):
        g = gradient(w, bias, leak, words, sents, bags, y)
        g[:size] += l1
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-8)
        w, bias = np.maximum(w - move[:size], 0), bias - move[size]  # words only ever add evidence
        leak = min(leak - move[size + 1], float(np.log(MOST_LEAK / (1 - MOST_LEAK))))
    names = [None] * size
    for word, i in known.items():
        if often[i]:
            names[place[i]] = word
    return names, w, bias, leak


def _log_clear(w, bias: float, leak: float, words, sents, bags, n: int) -> np.ndarray:
    """The logarithm of the chance that nothing in a bag is toxic."""
    z = np.bincount(sents, w[words], len(bags))
    return np.bincount(bags, np.logaddexp(0, bias) - np.logaddexp(0, bias + z), n) - np.logaddexp(0, leak)


def loss(w, bias: float, leak: float, words, sents, bags, y) -> float:
    """Mean negative log-likelihood of the bags."""
    clear = _log_clear(w, bias, leak, words, sents, bags, len(y))
    return float(-np.where(y == 1, np.log(np.clip(-np.expm1(clear), 1e-7, 1)), clear).mean())


def gradient(w, bias: float, leak: float, words, sents, bags, y) -> np.ndarray:
    """The gradient of `loss` by the weights, the bias and the leak."""
    n = len(y)
    clear = np.exp(_log_clear(w, bias, leak, words, sents, bags, n))
    pull = np.where(y == 1, -clear / np.clip(1 - clear, 1e-7, 1), 1.0) / n  # by the logarithm of a bag's clearness, negated
    p = _sigmoid(np.bincount(sents, w[words], len(bags)) + bias)
    of = pull[bags]
    return np.concatenate([np.bincount(words, (p * of)[sents], len(w)), [((p - _sigmoid(np.array(bias))) * of).sum(), _sigmoid(np.array(leak)) * pull.sum()]])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS,
          sample_bytes: int = SAMPLE_BYTES) -> tuple[dict[str, float], tuple[float, float] | None]:
    """Weights by word, and the bias and the leak, learnt from the labelled documents of `docs`."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # The sample is chosen by ids and sizes before any text moves: `sample` rows at most reach the driver.
    listed = named.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(known, "doc_id").distinct().orderBy(
        F.xxhash64("doc_id"), "h").limit(sample).collect()
    chosen, held = [], 0
    for r in listed:
        if held + r.bytes <= sample_bytes:
            chosen.append((r.doc_id, r.h, int(r.toxic)))
            held += r.bytes
    local = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, toxic int")
    bags = named.join(F.broadcast(local), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))

    def fit(batches):
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        y = rows["toxic"].to_numpy()
        if y.min() == y.max():
            return
        names, w, bias, leak = fit_bags([t or "" for t in rows["text"].to_pylist()], y, steps)
        yield pa.record_batch([pa.array([None, None, *names], pa.string()), pa.array([bias, leak, *w], pa.float64())], ["word", "weight"])

    # One task fits the model on the bounded sample; a row a word of its vocabulary comes back.
    model = bags.select("text", "toxic").orderBy(F.xxhash64("text"), "text").coalesce(1).mapInArrow(fit, "word string, weight double").toArrow().to_pylist()
    rest = [r["weight"] for r in model if r["word"] is None]
    return {r["word"]: r["weight"] for r in model if r["word"] is not None and r["weight"]}, (tuple(rest) if rest else None)


class Carriers(dict):
    """The weighted terms of a word, remembered for up to a million words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= 1_000_000:
            self.clear()
        out = self[word] = tuple(t for t in terms(word) if t in self.weights)
        return out


def scored(docs: DataFrame, model: tuple[dict[str, float], tuple[float, float] | None], offending: float = 0.5) -> DataFrame:
    """`(doc_id, score, spans)`: spans of offending sentences `(start, length, probability)`, in characters of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        weights, rest = shared.value
        bias, leak = rest or (None, None)
        carriers = Carriers(weights)
        scores, spans = [], []
        for text in batch.column("text").to_pylist():
            if bias is None:
                scores.append(0.0)
                spans.append([])
                continue
            text = text or ""
            low = text.lower()
            moved = len(low) != len(text)  # few letters change their length
            sums, where = [], []
            for a, b in sentences(text):
                found = [t for w in WORD.findall(text[a:b].lower() if moved else low[a:b]) if (t := carriers[w])]
                if found:  # a sentence without such words has no part in the score
                    sums.append(sum(weights[t] for t in set().union(*found)))
                    where.append((a, b - a))
            clear = np.logaddexp(0, bias) - np.logaddexp(0, bias + np.array(sums))
            p = -np.expm1(clear)
            scores.append(float(-np.expm1(clear.sum() - np.logaddexp(0, leak))))
            told = p >= offending
            if scores[-1] >= THRESHOLD and len(p) and not told.any():
                told[np.argmax(p)] = True
            spans.append([{"start": where[i][0], "length": where[i][1], "probability": float(p[i])} for i in np.flatnonzero(told).tolist()])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("probability", pa.float64())]))
        return pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score,
                     "doc_id long, score double, spans array<struct<start: long, length: long, probability: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`(doc_id, held_out, score, predicted, spans)`, learnt without the held-out rows."""
    model = train(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))), sample)
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
