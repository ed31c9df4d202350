"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are characters, so that names, rare words and all languages share one open vocabulary; the
order is 5. Counts of the trusted text and the distinct n-grams of the whole corpus are tables in Spark:
map tasks combine what they see, and a shuffle by n-gram sums it. Continuation counts, context sums and discounts
come from these tables, and joins sharded by n-gram give every distinct n-gram of the corpus its
probability, order by order. A document then needs one figure for each of its positions. A bounded number of the
most frequent n-grams settles most positions where the text is read. What a document has besides leaves as counts of
n-gram hashes, which are joined with the probabilities, sharded by the hash, and summed for each document. No task holds
more of the table than that bounded part, and an n-gram of the join is rarer than all of these, so no key is hot. Sums are
integers (millionths of a nat): the result depends on no order and no number of shards.

Trusted documents with a hash remainder are left out of the training and set the thresholds: per language, a quantile of their
cross-entropy, exact to a thousandth of a nat, plus an allowance that shrinks with the length of the
document (few characters vary more). A language without trusted documents takes the quantile of all.

Defined results: NULL and blank texts have no perplexity and are rejected. NULL lang is a language of its own. Without
trusted documents everything with text is kept and perplexity is that of a uniform model. Labels count by doc_id;
a document labelled both ways is not trusted. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import stabilise
from .common import arrow_map, id_filter, may_contain, mix, sliced

ORDER = 5
#: Padding before a text, and the sign after it.
BEGIN, END = 2, 3
#: The most frequent n-grams, which every task holds: so many at most.
COMMON = 1 << 19
#: Hashes in one row of what a document has besides.
PIECE = 1 << 16
QUANTILE = 0.99
#: Nats that a document of n characters may lie above the quantile, times the square root of n.
SLACK = 2.0
#: Every fifth trusted document is not trained on and sets the thresholds.
HELD_OUT = 5
#: Characters that a task takes apart at once, new n-grams that it merges at once, and n-grams that it holds.
CHUNK, FRESH, HELD = 200_000, 300_000, 1_000_000
#: N-grams that become strings at once.
SPELT = 100_000
#: Bytes of texts that a task has as Python strings.
SLICE = 4 << 20


def points(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded texts one after the other, and where each text's positions begin."""
    pad, end = chr(BEGIN) * (order - 1), chr(END)
    joined = "".join(f"{pad}{t or ''}{end}" for t in texts)
    starts = np.cumsum([0, *(len(t or "") + order for t in texts)])
    at = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(at == 0, 1, at), starts  # NUL can't stand in an n-gram's string


def _chunks(texts: list[str | None]):
    """Slices of a batch with about CHUNK characters each; a longer text is one slice."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Counter:
    """n-gram counts of one task: n-grams are numbers over a growing alphabet, merged by sorting."""

    MOST = 6_000  # letters: five of them fit 63 bits

    def __init__(self, order: int):
        self.order, self.alphabet, self.code = order, [], np.full(0x110000, -1, np.int32)
        self.keys, self.counts, self.fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, at: np.ndarray, starts: np.ndarray):
        new = np.unique(at)
        new = new[self.code[new] < 0]
        if len(self.alphabet) + len(new) > self.MOST:
            yield from self.flush()
            new = np.unique(at)
        if len(new) > self.MOST:  # a slice with a vast alphabet: in halves, which overlap by an n-gram's rest
            half, rest = len(at) // 2, self.order - 1
            yield from self.add(at[:half + rest], starts)
            yield from self.add(at[half:], starts - half)
            return
        self.code[new] = np.arange(len(self.alphabet), len(self.alphabet) + len(new))
        self.alphabet += new.tolist()
        digits, n = self.code[at].astype(np.int64), len(at) - self.order + 1
        keys = np.zeros(n, np.int64)
        for k in range(self.order):
            keys = keys * self.MOST + digits[k:k + n]
        ends = np.ones(n, bool)  # windows that begin in one text and end in the next are none
        for k in range(1, self.order):
            cut = starts[1:-1] - k
            ends[cut[(cut >= 0) & (cut < n)]] = False
        self.fresh.append(np.unique(keys[ends], return_counts=True))
        if sum(len(k) for k, _ in self.fresh) > FRESH:
            self.merge()
            if len(self.keys) > HELD:
                yield from self.flush()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.fresh)])
        counts = np.concatenate([self.counts, *(c for _, c in self.fresh)])
        self.keys = self.counts = None
        self.fresh = []
        if len(keys):
            by = np.argsort(keys)
            keys, counts = keys[by], counts[by]
            del by
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        self.keys, self.counts = keys, counts

    def flush(self):
        self.merge()
        letters = np.array(self.alphabet, np.uint32)
        for at in range(0, len(self.keys), SPELT):
            keys = self.keys[at:at + SPELT]
            digits = np.stack([keys // self.MOST ** (self.order - 1 - k) % self.MOST for k in range(self.order)], axis=1)
            grams = np.ascontiguousarray(letters[digits]).view(f"<U{self.order}").ravel()
            yield pa.record_batch([pa.array(grams.tolist(), pa.string()), pa.array(self.counts[at:at + SPELT])], ["g", "c"])
        self.__init__(self.order)


def counted(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """`(g, c)`: n-gram counts of a table with a column `text`."""
    def count(batches):
        counter = Counter(order)
        for batch in sliced(batches, SLICE):
            rows = batch.column("text").to_pylist()
            for a, b in _chunks(rows):
                yield from counter.add(*points(rows[a:b], order))
        yield from counter.flush()

    return texts.select("text").mapInArrow(count, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(tables: dict[int, DataFrame]) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each order, from its counts of counts."""
    rows = None
    for k, t in tables.items():
        own = t.groupBy(F.lit(k).alias("k"), F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("n"))
        rows = own if rows is None else rows.union(own)
    n = {(r["k"], r["c"]): r["n"] for r in rows.collect()}  # five rows an order
    out = {}
    for k in tables:
        n1, n2, n3, n4 = (n.get((k, i), 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [i - (i + 1) * y * b / a if a and b else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        out[k] = tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))
    return out


def probabilities(trained: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """`(g, p)` of every n-gram in `wanted` (g), by the counts `trained` (g, c): both stored tables. Other columns of `wanted` stay."""
    counts = {order: trained}
    for k in range(order - 1, 0, -1):  # how many different characters precede
        counts[k] = stabilise(counts[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c")))
    discount = _discounts(counts)
    grams, more = {order: wanted}, [n for n in wanted.columns if n != "g"]
    for k in range(order - 1, 0, -1):
        grams[k] = stabilise(grams[k + 1].select(F.substring("g", 2, k).alias("g")).distinct())
    letters = grams[1].count() + 1
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = discount[k]
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = counts[k].select("g", (F.col("c") - cut).alias("above"))
        ctx = F.substring("g", 1, k - 1) if k > 1 else F.lit("")
        contexts = counts[k].withColumn("d", cut).groupBy(ctx.alias("ctx")).agg(
            F.sum("c").cast("double").alias("total"), F.sum("d").alias("freed"))
        rows = grams[k].join(own, "g", "left").withColumn("ctx", ctx).join(contexts, "ctx", "left")
        if lower is None:
            below, suffixed = F.lit(1.0 / letters), rows
        else:
            below, suffixed = F.col("p_below"), rows.withColumn("suffix", F.substring("g", 2, k - 1)).join(
                lower.select(F.col("g").alias("suffix"), F.col("p").alias("p_below")), "suffix")
        p = F.when(F.col("total").isNull(), below).otherwise(
            F.coalesce(F.col("above"), F.lit(0.0)) / F.col("total") + F.col("freed") / F.col("total") * below)
        # Stored order by order: one plan over all orders would make its tables again and again, and the driver would hold it.
        lower = suffixed.select("g", p.alias("p"), *(more if k == order else []))
        if k < order:
            lower = stabilise(lower)
    return lower


def hashed(at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hashes of all windows of `order` code points."""
    n = len(at) - order + 1
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + at[k:k + n]
    return np.maximum(mix(h), np.uint64(1))


class Shard:
    """A part of the probability table for vectorised look-up: open addressing, zero marks a free place."""

    def __init__(self, h: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(h)).bit_length())
        self.mask, self.keys, self.values = np.uint64(size - 1), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        left, slot = np.arange(len(h)), h & self.mask
        while len(left):
            free = self.keys[slot[left]] == 0
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = h[put], values[put]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, 0 where it is not in this shard."""
        slot = h & self.mask
        found = self.keys[slot]
        out = np.where(found == h, self.values[slot], 0)
        open_ = np.flatnonzero((found != h) & (found != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & self.mask
            found = self.keys[slot]
            hit = found == h[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (found != 0)
            open_, slot = open_[more], slot[more]
        return out


def _hash_of(table: DataFrame, order: int) -> DataFrame:
    """`(h, micro, met)` of `(g, p, met)`: the hash of an n-gram and its cost in millionths of a nat."""
    def number(batch):
        at = np.frombuffer("".join(batch.column("g").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)
        h = np.zeros(len(at), np.uint64)
        for k in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + at[:, k]
        return pa.record_batch([pa.array(np.maximum(mix(h), np.uint64(1)).view(np.int64)), batch.column("micro"), batch.column("met")], ["h", "micro", "met"])

    return arrow_map(table.select("g", F.round(-F.log("p") * 1e6).cast("int").alias("micro"), "met"), number, "h long, micro int, met long")


def _common(table: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A number of occurrences that at most `most` n-grams reach, with the hashes and costs of those."""
    step = F.floor(F.log2("met") * 8)  # classes of frequency, a few hundred
    least, held = None, 0
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("met").alias("met")).collect(), key=lambda r: -r.step):
        held += r.n
        if held > most:
            break
        least = r.met
    if least is None:
        return 1 << 62, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    rows = table.where(F.col("met") >= least).select("h", "micro").toArrow()  # at most `most` rows
    return least, rows["h"].to_numpy().view(np.uint64), rows["micro"].to_numpy()


_held: dict[str, Shard] = {}


def _shard(sent) -> Shard:
    """The table of a broadcast; a worker keeps the last one."""
    if sent.id not in _held:
        _held.clear()
        h, micro = sent.value
        _held[sent.id] = Shard(h, micro + 1)  # 0 is for what is not there
    return _held[sent.id]


SCORED = "row long, doc_id long, lang string, n long, micro long, grams array<long>, times array<int>"


class _Sent:
    """A broadcast and a name for it that workers can tell it by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def scored(docs: DataFrame, probability: DataFrame, order: int = ORDER, most: int = COMMON) -> DataFrame:
    """`(doc_id, lang, n, micro)`: positions and cost in millionths of a nat of every text. `probability` is (g, p, met)."""
    table = stabilise(_hash_of(probability, order))
    least, h, micro = _common(table, most)
    sent = _Sent(docs.sparkSession.sparkContext.broadcast((h, micro)))

    def score(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, SLICE):
            texts = batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                at, starts = points(texts[a:b], order)
                h = hashed(at, order)
                value = _shard(sent).look_up(h)
                whole = np.ones(len(h), bool)
                for j in range(1, order):  # windows over the seam of two texts
                    whole[starts[1:-1] - j] = False
                cost = np.append(np.where(whole & (value > 0), value - 1, 0).astype(np.int64), np.zeros(order - 1, np.int64))
                rest = np.flatnonzero(whole & (value == 0))
                doc = np.searchsorted(starts, rest, "right") - 1
                by = np.lexsort((h[rest], doc))
                gram, doc = h[rest][by].view(np.int64), doc[by]
                fresh = np.ones(len(gram), bool)
                fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(fresh)
                times = np.diff(np.append(first, len(gram))).astype(np.int32)
                gram, doc = gram[first], doc[first]
                begin = np.searchsorted(doc, np.arange(b - a + 1))
                sums = np.add.reduceat(cost, starts[:-1]).tolist()
                out = []
                for i in range(b - a):
                    for piece in range(begin[i], max(begin[i + 1], begin[i] + 1), PIECE):
                        upto = min(piece + PIECE, begin[i + 1])
                        lead = piece == begin[i]
                        out.append((row, batch.column("doc_id")[a + i].as_py(), batch.column("lang")[a + i].as_py(),
                                    len(texts[a + i] or "") + 1 if lead else None, sums[i] if lead else None, upto - piece, piece))
                    row += 1
                columns = list(zip(*out, strict=True))
                sizes = pa.array(np.concatenate([[0], np.cumsum(columns[5])]), pa.int32())
                yield pa.record_batch([
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()),
                    pa.array(columns[4], pa.int64()), pa.ListArray.from_arrays(sizes, pa.array(gram)), pa.ListArray.from_arrays(sizes, pa.array(times))],
                    [part.split()[0] for part in SCORED.split(", ")])

    rows = stabilise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(score, SCORED))
    besides = rows.where(F.size("grams") > 0).select("row", F.inline(F.arrays_zip("grams", "times"))).select("row", F.col("grams").alias("h"), "times")
    # Every n-gram of the corpus has a probability; one without would be lost silently, so it stops the job.
    micro = F.coalesce("micro", F.raise_error(F.lit("an n-gram of a document has no probability")).cast("int"))
    joined = besides.join(table.where(F.col("met") < least).select("h", "micro"), "h", "left")
    sums = joined.groupBy("row").agg(F.sum(F.col("times").cast("long") * micro).alias("more"))
    return rows.where("n is not null").join(sums, "row", "left").select(
        "doc_id", "lang", "n", (F.col("micro") + F.coalesce("more", F.lit(0))).alias("micro"))


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK,
               order: int = ORDER) -> DataFrame:
    """`(doc_id, lang, perplexity, threshold, keep)` for every row of `docs` (doc_id, lang, text)."""
    trusted = stabilise(labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("calibrates")))
    training = trusted.where("not calibrates").select("doc_id")
    wanted = id_filter(training, "doc_id")

    def pick(batch):
        return batch.filter(pa.array(may_contain(wanted.value, batch.column("doc_id"))))

    # Only texts that may be trusted leave the map side; the join decides.
    near = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pick, "doc_id long, text string")
    trained = stabilise(counted(near.join(training, "doc_id", "left_semi"), order))
    everything = stabilise(counted(docs, order).withColumnRenamed("c", "met"))
    scores = stabilise(scored(docs, probabilities(trained, everything, order), order))
    blank = F.col("n") <= 1
    milli = F.floor(F.col("micro") / F.col("n") / 1000).cast("long")
    own = scores.where(~blank).join(trusted.where("calibrates").select("doc_id"), "doc_id", "left_semi").groupBy(
        "lang", milli.alias("bin")).agg(F.count("*").alias("n"))

    def edges(bins, by):
        part = W.partitionBy(*by)
        running = F.sum("n").over(part.orderBy("bin"))
        return bins.withColumn("ok", running >= F.ceil(quantile * F.sum("n").over(part))).where("ok").groupBy(*by).agg(
            ((F.min("bin") + 1) / 1000).alias("edge"))

    by_lang = edges(own, ["lang"])
    overall = edges(own.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"]).first()
    nats = F.col("micro") / F.col("n") / 1e6
    limit = F.coalesce("edge", F.lit(overall["edge"] if overall else None).cast("double")) + slack / F.sqrt("n")
    met = scores.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left").select("s.*", "edge")
    return met.select(
        "doc_id", "lang", F.when(~blank, F.exp(nats)).alias("perplexity"), F.exp(limit).alias("threshold"),
        (~blank & F.coalesce(nats <= limit, F.lit(True))).alias("keep"))
