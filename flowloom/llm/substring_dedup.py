"""Substring dedup: repeated paragraphs and passages go from all documents but one.

Paragraphs (lines of at least `MIN_WORDS` words) are sets of five-word shingles. MinHash banding with few
rows a band brings nearly all pairs of similarity 0.8 together, the exact Jaccard coefficient
confirms them, and components are the classes from which one document keeps its paragraph.

Passages are often spliced into paragraphs, where no whole line repeats. So the sentences of all texts are compared
too, by equality of their words; a sentence without an end for long is cut after words that their own hash
chooses, wherever it stands. A run of repeated sentences goes once it has `MIN_WORDS` words; shorter
coincidences stay.

Passages that begin or end inside a sentence are found whole: a window of `PASSAGE` words (split at white space) that
several documents hold goes from all but the keeper, so runs of at least `PASSAGE` words go from end to end. A
window's anchor is the least hash of its runs of `GRAM` words, so equal windows have equal anchors. Where an anchor is in
several documents, the neighbouring windows that share it are one row, with a hash of 64 bits for each; the rows of an anchor
meet in a task, which compares the windows themselves and answers with a span for each row. The windows of
an anchor with more than `CROWD` rows are compared one by one instead, counted on the map side and joined.

The keeper of a class is its smallest doc_id; repeats inside one document stay.

Defined results: NULL and empty texts stay as they are. Rows without doc_id are never keepers of a text that a
document with one has. Rows that share a doc_id are one document. Repeated rows are changed alike. Extra columns stay;
one called `removed` is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import scratch, stabilise
from .common import arrow_map, id_filter, may_contain, mix, shingle_hashes
from .minhash_dedup import node_id
from .near import Scheme, clusters, grouped

WIDTH = 5
MIN_WORDS = 25
LONG_SENTENCE = 20
#: Words of a window that goes when it repeats anywhere, and of the runs that its anchor is chosen from.
PASSAGE, GRAM = 50, 16
#: Neighbouring windows in one row at most: fewer than `PASSAGE`, so that any two of them overlap.
STRETCH = 32
#: Rows of an anchor that meet in one task at most.
CROWD = 1 << 13
#: Bytes of texts that a task takes apart at once: words and spans as Python objects take some twenty times as much.
SLICE = 1 << 20
#: The same for windows, whose arrays then fit the processor's cache.
WINDOWED = 1 << 18


def banding(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of `rows` symbols that catches a pair at the threshold with this probability."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-threshold ** rows)))


#: Few rows a band, since unrelated paragraphs share no five words: 10 bands of 2 miss a pair at 0.8 once in 25,000.
SCHEME = Scheme(chunks=banding(0.8, 0.9999, 2), width=2, errors=0, most=14)
SENTENCE = re.compile(rb"[^.!?\n]+[.!?]*")
LINE = re.compile(rb"[^\n]+")
_seeds = np.random.default_rng(20240608).integers(0, 1 << 63, SCHEME.symbols, np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def sentences(low: bytes):
    """`(start, end, words, hash)` of the sentences of a text in UTF-8 and lower case; long ones in pieces.

    Words are counted by the blanks between them.
    """
    for m in SENTENCE.finditer(low):
        said = m.group()
        n = said.count(b" ") + 1
        if n <= LONG_SENTENCE:
            said = said.strip()
            if said:
                yield m.start(), m.end(), n, xxhash.xxh64_intdigest(said)
            continue
        at, first, held = m.start(), m.start(), 0
        for w in said.split(b" "):
            at += len(w) + 1
            held += 1
            if w and (7 * w[0] + len(w)) % 16 == 0:  # a rule of the word alone cuts a passage alike everywhere
                yield first, at - 1, held, xxhash.xxh64_intdigest(low[first:at - 1].strip())
                first, held = at, 0
        if first < m.end() and (rest := low[first:m.end()].strip()):
            yield first, m.end(), held, xxhash.xxh64_intdigest(rest)


def paragraphs(low: bytes):
    """`(start, end, words, hash)` of the lines that are long enough to be compared."""
    for m in LINE.finditer(low):
        line = m.group()
        n = line.count(b" ") + 1
        if n >= MIN_WORDS and len(line.split(None, MIN_WORDS)) >= MIN_WORDS:
            yield m.start(), m.end(), n, xxhash.xxh64_intdigest(line.strip(), seed=1)


BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def _run_hashes(prefix: np.ndarray, unscale: np.ndarray, width: int) -> np.ndarray:
    return mix((prefix[width:] - prefix[:-width]) * unscale[:len(prefix) - width])


BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\v\f")] = True
LETTERS = np.random.default_rng(20240609).integers(1, 1 << 63, 256, np.uint64)


def _edges(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end."""
    ink = np.zeros(len(low) + 2, bool)
    ink[1:-1] = ~BLANK[np.frombuffer(low, np.uint8)]
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    return edges[::2], edges[1::2]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, UNBASE))


def _hashed_words(lows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one text after the other, and how many each text has."""
    low = b"\n".join(lows)
    starts, ends = _edges(low)
    scale, unscale = _powers(len(low))
    prefix = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(LETTERS[np.frombuffer(low, np.uint8)] * scale[:-1], out=prefix[1:])
    begin = np.cumsum([0, *(len(x) + 1 for x in lows)])
    return mix((prefix[ends] - prefix[starts]) * unscale[starts]), np.diff(np.searchsorted(starts, begin))


def _all_windows(lows: list[bytes], hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """`(text, word, hash, anchor)` of all runs of `PASSAGE` words inside each of the texts: a text's place in the list, a first word's in its text."""
    hashed, sizes = _hashed_words(lows)
    if len(hashed) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    scale, unscale = _powers(len(hashed) - 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashed * scale, dtype=np.uint64)])
    anchor, held = _run_hashes(prefix, unscale, GRAM), 1
    while held < PASSAGE - GRAM + 1:  # sliding minimum
        step = min(held, PASSAGE - GRAM + 1 - held)
        anchor = np.minimum(anchor[:-step], anchor[step:])
        held += step
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(text[:len(anchor)] == text[PASSAGE - 1:])  # others begin in one text and end in another
    first = np.cumsum(sizes) - sizes
    text = text[whole]
    return text, whole - first[text], _run_hashes(prefix, unscale, PASSAGE)[whole] if hashes else None, anchor[whole]


def windows(low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`(start, end, hash, anchor)` of all runs of `PASSAGE` words of a text."""
    _, word, h, anchor = _all_windows([low])
    starts, ends = _edges(low)
    return starts[word], ends[word + PASSAGE - 1], h, anchor


def _stretches(text: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of neighbouring windows with one anchor begin, and the number of windows in each: `STRETCH` at most."""
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    place = np.arange(len(anchor)) - np.repeat(begin, np.diff(np.append(begin, len(anchor))))
    begin = np.flatnonzero(place % STRETCH == 0)
    return begin, np.diff(np.append(begin, len(anchor)))


def _signed(h: list[int]) -> pa.Array:
    return pa.array(np.array(h, np.uint64).view(np.int64))


def _shingled(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of the paragraphs, one after the other, and where each paragraph's begin."""
    flat, sizes = _hashed_words(lines)
    ends = np.cumsum(sizes)
    whole = shingle_hashes(flat, WIDTH)
    inside = np.ones(len(whole), bool)
    for k in range(1, WIDTH):
        inside[ends[:-1] - k] = False
    return whole[inside], np.cumsum(sizes - WIDTH + 1) - (sizes - WIDTH + 1)


def _signatures(lines: list[bytes]) -> np.ndarray:
    """Min-hash signatures of paragraphs, all at once."""
    whole, starts = _shingled(lines)
    out = np.empty((len(lines), SCHEME.symbols), np.uint16)
    for s, odd in enumerate(_seeds):
        h = whole * odd
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, s] = (mix(np.minimum.reduceat(h, starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(node_id().alias("id"), F.xxhash64("doc_id", "text").alias("row"), "text").where("text <> ''")


def _paragraph_items(rows: DataFrame) -> DataFrame:
    """`(h, id, sig)` of every paragraph."""
    def run(batch):
        names, ids, lines = [], [], []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            low = lowered(text)
            for start, end, _, h in paragraphs(low):
                names.append(h)
                ids.append(i)
                lines.append(low[start:end])
        if not lines:
            return None
        sigs = _signatures(lines)
        cells = pa.array([s.tobytes() for s in sigs], pa.binary())
        return pa.record_batch([_signed(names), pa.array(ids, pa.int64()), cells], ["h", "id", "sig"])

    return arrow_map(rows.select("id", "text"), run, "h long, id long, sig binary", SLICE)


def _fetcher(rows: DataFrame):
    def fetch(ids: DataFrame) -> DataFrame:
        wanted = id_filter(ids, "id")

        def run(batch):
            names, lines = [], []
            for text in batch.column("text").to_pylist():
                low = lowered(text)
                for start, end, _, h in paragraphs(low):
                    names.append(h)
                    lines.append(low[start:end])
            h = _signed(names)
            some = np.flatnonzero(may_contain(wanted.value, h))
            if not len(some):
                return None
            whole, starts = _shingled([lines[k] for k in some])
            line = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(whole))))
            by = np.lexsort((whole, line))
            whole, line = whole[by], line[by]
            fresh = np.ones(len(whole), bool)
            fresh[1:] = (whole[1:] != whole[:-1]) | (line[1:] != line[:-1])
            sizes = np.bincount(line[fresh], minlength=len(some))
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(whole[fresh].view(np.int64)))
            return pa.record_batch([h.take(pa.array(some)), sets], ["id", "members"])

        found = arrow_map(rows.select("text"), run, "id long, members array<long>", SLICE)
        return found.join(ids, "id", "left_semi").groupBy("id").agg(F.first("members").alias("members"))

    return fetch


def _sentence_counts(rows: DataFrame) -> DataFrame:
    """`(h, keeper)` of the sentences that several documents hold."""
    def run(batch):
        names, ids = [], []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {s[3] for s in sentences(lowered(text))}
            names.extend(own)
            ids.append(np.full(len(own), i, np.int64))
        return pa.record_batch([_signed(names), pa.array(np.concatenate(ids))], ["h", "id"])

    return arrow_map(rows.select("id", "text"), run, "h long, id long", SLICE).groupBy("h").agg(
        F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper <> last").select("h", "keeper")


def _in_several(found: DataFrame) -> DataFrame:
    """`(h, keeper)` of the hashes that several documents hold."""
    return found.groupBy("h").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper <> last").select("h", "keeper")


def _repeated_windows(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """`(row, start, end)`: runs of words, counted from 0, that consist of windows which a smaller document holds."""
    def anchors(batch):
        text, _, _, anchor = _all_windows([lowered(t) for t in batch.column("text").to_pylist()], hashes=False)
        begin, _ = _stretches(text, anchor)
        return pa.record_batch([_signed(anchor[begin]), batch.column("id").take(pa.array(text[begin]))], ["h", "id"])

    several = stabilise(arrow_map(rows.select("id", "text"), anchors, "h long, id long", WINDOWED).groupBy("h").agg(
        F.min("id").alias("keeper"), F.max("id").alias("last"), F.count("*").alias("n")).where("keeper <> last").select("h", "n"))
    met, crowded = id_filter(several, "h"), several.where(F.col("n") > crowd)
    crowds = None if crowded.isEmpty() else id_filter(crowded, "h")

    def stretches(batch, wanted: bool):
        text, word, h, anchor = _all_windows([lowered(t) for t in batch.column("text").to_pylist()])
        begin, size = _stretches(text, anchor)
        own = _signed(anchor[begin])
        some = may_contain(met.value, own)
        if crowds is not None:
            some &= may_contain(crowds.value, own) == wanted
        return text, word, h, begin[some], size[some], own.filter(pa.array(some))

    def gathered(batch):
        text, word, h, begin, size, own = stretches(batch, False)
        at = pa.array(text[begin])
        cells = h.tobytes()
        return pa.record_batch([own, batch.column("row").take(at), batch.column("id").take(at), pa.array(word[begin].astype(np.int32)),
                                pa.array([cells[8 * b:8 * (b + n)] for b, n in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary())],
                               ["anchor", "row", "id", "word", "hashes"])

    def compared(batches):
        for t in grouped(batches, ["anchor"]):
            cells = t["hashes"].to_pylist()
            size = np.array([len(c) // 8 for c in cells])
            h, ids = np.frombuffer(b"".join(cells), np.uint64), np.repeat(t["id"].to_numpy(), size)
            by = np.argsort(h)
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[by][1:] != h[by][:-1]
            begin = np.flatnonzero(fresh)
            least = np.empty_like(ids)
            least[by] = np.repeat(np.minimum.reduceat(ids[by], begin), np.diff(np.append(begin, len(h))))
            hit = np.flatnonzero(least < ids)
            owner = np.repeat(np.arange(len(cells)), size)[hit]
            if len(hit):
                place = hit - (np.cumsum(size) - size)[owner] + t["word"].to_numpy()[owner]
                first, last = (np.flatnonzero(np.append(x, y)) for x, y in (([True], owner[1:] != owner[:-1]), (owner[1:] != owner[:-1], [True])))
                yield pa.record_batch([pa.array(t["row"].to_numpy()[owner[first]]), pa.array(place[first].astype(np.int32)),
                                       pa.array((place[last] + PASSAGE).astype(np.int32))], ["row", "start", "end"])

    met_rows = arrow_map(rows, gathered, "anchor long, row long, id long, word int, hashes binary", WINDOWED)
    out = met_rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compared, "row long, start int, end int")
    if crowds is None:
        return out

    def single(batch):
        text, word, h, begin, size, _ = stretches(batch, True)
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = pa.array(text[at])
        return pa.record_batch([_signed(h[at]), batch.column("row").take(own), batch.column("id").take(own), pa.array(word[at].astype(np.int32))],
                               ["h", "row", "id", "start"])

    found = stabilise(arrow_map(rows, single, "h long, row long, id long, start int", WINDOWED))
    return out.unionByName(found.join(_in_several(found), "h").where("id <> keeper").select("row", "start", (F.col("start") + PASSAGE).alias("end")))


def spans(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`(row, found)`: for `row` = xxhash64(doc_id, text) the repeated sentences (kind 0), paragraphs (1) and runs of windows (2).

    `start` and `end` are bytes of UTF-8, but words in kind 2.
    """
    rows = _named(docs)
    # Paragraphs: equal ones first, then classes of similar ones.
    items = stabilise(_paragraph_items(rows).groupBy("h").agg(
        F.min("id").alias("least"), F.max("id").alias("last"), F.first("sig").alias("sig")).withColumnRenamed("h", "id"))
    found = clusters(items.select("id", "sig"), _fetcher(rows), SCHEME, percent)
    member = found.join(items.select(F.col("id").alias("node"), "least", "last"), "node")
    kept = member.groupBy("component").agg(F.min("least").alias("keeper"), F.max("last").alias("last")).where("keeper <> last")
    similar = stabilise(member.join(kept.select("component", "keeper"), "component").select(F.col("node").alias("h"), "keeper"))
    repeated = stabilise(_sentence_counts(rows))
    some_paragraphs, some_sentences = id_filter(similar, "h"), id_filter(repeated, "h")

    def occurrences(batch):
        lows, parts = [lowered(t) for t in batch.column("text").to_pylist()], []
        for kind, units, some in ((0, sentences, some_sentences.value), (1, paragraphs, some_paragraphs.value)):
            own = [list(units(low)) for low in lows]
            sizes = np.array([len(o) for o in own])
            if not sizes.any():
                continue
            start, end, words, h = zip(*(s for o in own for s in o), strict=True)
            h = _signed(h)
            hit = np.flatnonzero(may_contain(some, h))
            text = np.repeat(np.arange(len(own)), sizes)[hit]
            at, of = hit - (np.cumsum(sizes) - sizes)[text], pa.array(text)
            parts.append([np.full(len(hit), kind, np.int32), h.take(pa.array(hit)), batch.column("row").take(of), batch.column("id").take(of),
                          at.astype(np.int32), *(np.array(v, np.int32)[hit] for v in (start, end, words))])
        columns = [pa.concat_arrays([pa.array(v) for v in column]) for column in zip(*parts, strict=True)]
        return pa.record_batch(columns, ["kind", "h", "row", "id", "at", "start", "end", "words"]) if columns else None

    met = arrow_map(rows, occurrences, "kind int, h long, row long, id long, at int, start int, end int, words int", SLICE)
    keepers = repeated.withColumn("kind", F.lit(0)).union(similar.withColumn("kind", F.lit(1)))
    gone = met.join(keepers, ["kind", "h"]).where("id <> keeper").select("row", "kind", "at", "start", "end", "words")
    gone = gone.unionByName(_repeated_windows(rows).select(
        "row", F.lit(2).alias("kind"), F.lit(0).alias("at"), "start", "end", F.lit(PASSAGE).alias("words")))
    # Neighbouring sentences form runs; a paragraph or window is long enough by itself. A document's spans are bounded by its text.
    return gone.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("kind", "at", "start", "end", "words"))).alias("found"))


def located(text: str, found: list[tuple]) -> list[tuple]:
    """What `spans` found in a text, all in bytes: rows `(kind, at, start, end, words)`."""
    if not any(f[0] == 2 for f in found):
        return found
    starts, ends = (e.tolist() for e in _edges(lowered(text)))
    return [(kind, at, starts[a], ends[b - 1], words) if kind == 2 else (kind, at, a, b, words) for kind, at, a, b, words in found]


def merged(found: list[tuple], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Spans to remove, in order and without overlap, of a document's repeated sentences and paragraphs."""
    out, first, held, last, upto = [], 0, 0, None, 0
    for kind, at, start, end, words in found:
        if kind:
            out.append((start, end))
            continue
        if last is None or at != last + 1:
            if held >= least:
                out.append((first, upto))
            first, held = start, 0
        held, last, upto = held + words, at, end
    if held >= least:
        out.append((first, upto))
    flat: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if flat and a <= flat[-1][1]:
            flat[-1] = (flat[-1][0], max(b, flat[-1][1]))
        else:
            flat.append((a, b))
    return flat


def cut(text: str, gone: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """The text without the spans, and the spans in characters; a line break goes with the line that it ended."""
    whole, kept, at, spans_, chars = text.encode("utf-8", "surrogatepass"), "", 0, [], 0
    for a, b in [*gone, (len(whole), len(whole))]:
        part, lost = (whole[x:y].decode("utf-8", "surrogatepass") for x, y in ((at, a), (a, b)))
        chars += len(part)
        if lost:
            spans_.append({"start": chars, "length": len(lost)})
        chars += len(lost)
        if part.startswith("\n") and (not kept or kept.endswith("\n")):
            part = part[1:]
        kept, at = kept + part, b
    return kept, spans_


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` with repeated passages cut from `text`, and `removed`: the spans `(start, length)` in the old text."""
    docs = docs.drop("removed")
    with scratch(docs.sparkSession) as keep:  # the spans alone stay beside the texts
        found = keep(stabilise(spans(docs, percent)))
    names = docs.columns
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))

    def rewrite(batch):
        texts, removed, at = [], [], 0
        rows = list(zip(*(c.to_pylist() for c in batch.column("found").flatten().flatten()), strict=True))
        for text, n in zip(batch.column("text").to_pylist(), batch.column("found").value_lengths().fill_null(0).to_pylist(), strict=True):
            gone = merged(located(text, rows[at:at + n])) if n else []
            at += n
            left, lost = cut(text, gone) if gone else (text, [])
            texts.append(left)
            removed.append(lost)
        spans_ = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*columns, spans_], names=[*names, "removed"])

    schema = docs.withColumn("removed", F.array().cast("array<struct<start: long, length: long>>")).schema
    return arrow_map(keyed.join(found.withColumnRenamed("row", "_row"), "_row", "left").drop("_row"), rewrite, schema, SLICE)
