"""Ranked lexical search over a length-stratified index.

Documents with the same normaliser m (a function of the number of terms) form a stratum. A stratum is laid in blocks, one
for each task that indexed some of its documents; a row of the index is a block. In it, a term's postings are grouped by
tf, so the impact of a posting depends on its group alone: it is computed once per (term, m, tf), never per
posting. A posting is a document's place in the block.

A search bounds each (item, stratum): the sum, over the item's terms, of the impact of the greatest tf there. Strata are
visited in the order of their bounds, in a few waves that grow; after each wave the k-th best score so far ends the visit to
all strata whose bound is below it, which loses no result. A visited block adds the impacts of its postings to a matrix of
items and documents. A block holds all postings of its documents, so no posting is ever shuffled. Items come in batches
whose terms are bounded; each batch is broadcast and searched by itself.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, with A-Z in lower case.

Defined results: NULL, empty and blank texts have no term; they count in no statistic and are never found, and an item
without terms finds nothing. Repeated rows are documents of their own, found one beside the other. Documents without
doc_id are found like others and rank last among equal scores. Items are told apart by row, so repeated item_ids have a list each.
Extra columns are ignored, a column called like a result too. No documents or no items give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import pin_small, stabilise
from .common import arrow_map, rows_a_batch, sliced

#: What is no part of a term becomes a blank, A-Z become a-z, all other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms and documents that a task indexes together: they bound a block.
BLOCK_TERMS, BLOCK_DOCS = 1 << 19, 1 << 13
#: Terms and items that are searched at once: they bound what is broadcast, and a task's rows of scores.
BATCH_TERMS, BATCH_ITEMS = 1 << 18, 256
#: Scores that a task holds, and single additions that it makes, at once.
CELLS = 1 << 19
#: Blocks that a task is handed at once.
BLOCKS_A_BATCH = 64
#: Share of the documents that the first wave visits; each later wave visits so many times more.
FIRST_SHARE, WAVE_GROWTH = 1 / 32, 8

#: A block: its documents, and its posting groups: the term and tf of each, how many places it has, and the places of all.
#: Numbers are packed as 32-bit integers, terms as one string with where each ends: lists of so many values cost a reader several times their size.
INDEX = "m long, block long, ids array<long>, terms binary, ends binary, tf binary, n binary, places binary"
INDEX_NAMES = [part.split()[0] for part in INDEX.split(", ")]


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass(frozen=True)
class Index:
    """`rows` is a stored table of blocks; `n_docs` and `n_terms` are the totals of all documents with a term."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def _packed(values: np.ndarray) -> bytes:
    return values.astype(np.int32).tobytes()


def _numbers(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int32).astype(np.int64)


def _names(batch: pa.RecordBatch, i: int) -> pa.Array:
    """The terms of a block."""
    ends = np.frombuffer(batch.column("ends")[i].as_buffer(), np.int32)
    offsets = pa.py_buffer(np.concatenate([[np.int32(0)], ends]).astype(np.int32))
    return pa.StringArray.from_buffers(len(ends), offsets, batch.column("terms")[i].as_buffer())


def _blocks(docs: list, m: list[int], words: list[np.ndarray], names: list[bytes], block: int):
    """The blocks of some documents: a row for each of their strata."""
    m_of = np.array(m, np.int64)
    by_m = np.argsort(m_of, kind="stable")
    strata, first, sizes = np.unique(m_of[by_m], return_index=True, return_counts=True)
    place = np.empty(len(m_of), np.int32)
    place[by_m] = np.arange(len(m_of)) - np.repeat(first, sizes)
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    pairs, tf = np.unique(doc * len(names) + np.concatenate(words), return_counts=True)
    doc, word = np.divmod(pairs, len(names))
    order = np.lexsort((place[doc], tf, word, m_of[doc]))
    doc, word, tf = doc[order], word[order], tf[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (m_of[doc[1:]] != m_of[doc[:-1]]) | (word[1:] != word[:-1]) | (tf[1:] != tf[:-1])
    starts = np.flatnonzero(fresh)
    n = np.diff(np.append(starts, len(doc)))
    group_at = np.searchsorted(m_of[doc[starts]], strata)  # where the groups and the places of each stratum begin
    place_at = np.searchsorted(m_of[doc], strata)
    rows = []
    for k, (g, p, d) in enumerate(zip(group_at, place_at, first, strict=True)):
        g = slice(g, group_at[k + 1] if k + 1 < len(strata) else None)
        p = slice(p, place_at[k + 1] if k + 1 < len(strata) else None)
        spelled = [names[w] for w in word[starts[g]].tolist()]
        rows.append((int(strata[k]), block, [docs[i] for i in by_m[d:d + sizes[k]].tolist()], b"".join(spelled),
                     _packed(np.cumsum([len(t) for t in spelled])), _packed(tf[starts[g]]), _packed(n[g]), _packed(place[doc[p]])))
        if len(rows) == 64 or k + 1 == len(strata):
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], INDEX_NAMES)
            rows = []


def indexed(docs: DataFrame) -> Index:
    """The index of all rows of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sizes(batch):
        n = [len(terms(t)) for t in batch.column("text").to_pylist()]
        return pa.record_batch([[sum(x > 0 for x in n)], [sum(n)]], ["docs", "terms"])

    total = arrow_map(docs.select("text"), sizes, "docs long, terms long", slice_bytes=4 << 20).agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total.docs, total.terms

    def build(batches):
        block = TaskContext.get().partitionId() << 32
        number, ids, m, words, held = defaultdict(count().__next__), [], [], [], 0
        for batch in sliced(batches, 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                ids.append(doc_id)
                m.append(75 + 25 * len(found) * n_docs // n_terms)
                words.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
                held += len(found)
                if held >= BLOCK_TERMS or len(ids) >= BLOCK_DOCS:
                    yield from _blocks(ids, m, words, list(number), block)
                    block += 1
                    number, ids, m, words, held = defaultdict(count().__next__), [], [], [], 0
        if ids:
            yield from _blocks(ids, m, words, list(number), block)

    return Index(stabilise(docs.mapInArrow(build, INDEX)), n_docs, n_terms)


class Asked:
    """The terms of a batch of items, as sent to the tasks: which items ask for a term how often, and its weight."""

    def __init__(self, rows: list, weight: dict[str, int] | None = None):
        self.terms = sorted({r.term for r in rows})
        at = {t: i for i, t in enumerate(self.terms)}
        rows = sorted(rows, key=lambda r: (at[r.term], r.item))
        self.items = np.array([r.item for r in rows], np.int64)
        self.counts = np.array([r.c for r in rows], np.int64)
        self.n = np.bincount([at[r.term] for r in rows], minlength=len(self.terms))
        self.first = np.cumsum(self.n) - self.n
        self.weights = np.array([weight.get(t, 0) for t in self.terms], np.int64) if weight is not None else None

    def met(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of some terms are asked for, and their numbers."""
        number = pc.index_in(names, pa.array(self.terms, pa.string()))
        where = number.is_valid().to_numpy(zero_copy_only=False)
        return np.flatnonzero(where), number.drop_null().to_numpy()


def impact(weight, tf, m):
    """The share of a posting in a score, in whole numbers: of columns of numbers, not of columns of a table."""
    return weight * ((10**9 * tf) // (1000 * tf + 12 * m))


def _seen(index: Index, asked) -> DataFrame:
    """`(term, m, n, tf)`: in how many documents of a stratum a term occurs, and how often at most."""
    def look(batch):
        out = []
        for i in range(batch.num_rows):
            where, number = asked.value.met(_names(batch, i))
            if len(where):
                n, tf = (_numbers(batch.column(x)[i])[where] for x in ("n", "tf"))
                starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                out.append((number[starts], np.full(len(starts), batch.column("m")[i].as_py()), np.add.reduceat(n, starts), np.maximum.reduceat(tf, starts)))
        if out:
            return pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["term", "m", "n", "tf"])

    rows = arrow_map(index.rows.select("m", "terms", "ends", "tf", "n"), look, "term long, m long, n long, tf long")
    return rows.groupBy("term", "m").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"))


def _visited(index: Index, asked, alive: DataFrame, k: int) -> DataFrame:
    """`(item, doc_id, score)`: the k best of every block for each item that visits its stratum.

    `alive` is (m, visitors, least): items, and the scores below which a document is of no use to them.
    """
    def best_of(ids: pa.Array, m: int, groups, visitors: np.ndarray, least: np.ndarray):
        query, (names, tf, n, places), width = asked.value, groups, len(ids)
        where, number = query.met(names)
        impacts = impact(query.weights[number], tf[where], m)
        first_place = (np.cumsum(n) - n)[where]
        n = n[where]
        # One entry for each posting group and item that asks for its term.
        of = np.repeat(np.arange(len(where)), query.n[number])
        inside = np.arange(len(of)) - np.repeat(np.cumsum(query.n[number]) - query.n[number], query.n[number])
        entry = query.first[number][of] + inside
        row_of = np.full(BATCH_ITEMS, -1)
        known, doc_names = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        step = max(1, CELLS // width)
        for v in range(0, len(visitors), step):  # some items at a time
            mine = visitors[v:v + step]
            row_of[:] = -1
            row_of[mine] = np.arange(len(mine))
            rows = row_of[query.items[entry]]
            here = rows >= 0
            groups_of, rows, add = of[here], rows[here], (query.counts[entry] * impacts[of])[here]
            scores = np.zeros(len(mine) * width, np.int64)
            size = n[groups_of]
            reach, at = np.cumsum(size), 0
            while at < len(rows):
                upto = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + CELLS, "right")))
                s = size[at:upto]
                posting = np.repeat(first_place[groups_of[at:upto]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                np.add.at(scores, np.repeat(rows[at:upto] * width, s) + places[posting], np.repeat(add[at:upto], s))
                at = upto
            scores = scores.reshape(len(mine), width)
            for r in np.flatnonzero(scores.max(axis=1) >= least[v:v + step]).tolist():
                row = scores[r]
                floor = max(least[v + r], int(np.partition(row, -k)[-k])) if width > k else least[v + r]
                hit = np.flatnonzero(row >= floor)
                hit = hit[np.lexsort((doc_names[hit], ~known[hit], -row[hit]))][:k]
                yield np.full(len(hit), mine[r]), ids.take(pa.array(hit)), row[hit]

    def score(batch):
        out = []
        for i in range(batch.num_rows):
            ids, visitors, least = (batch.column(x)[i].values for x in ("ids", "visitors", "least"))
            groups = (_names(batch, i), *(_numbers(batch.column(x)[i]) for x in ("tf", "n", "places")))
            out += best_of(ids, batch.column("m")[i].as_py(), groups, visitors.to_numpy(), least.to_numpy())
        if out:
            items, ids, found = zip(*out, strict=True)
            return pa.record_batch([pa.array(np.concatenate(items)), pa.concat_arrays(ids), pa.array(np.concatenate(found))], ["item", "doc_id", "score"])

    return arrow_map(index.rows.drop("block").join(alive, "m"), score, "item long, doc_id long, score long", slice_bytes=8 << 20)


def _batch(index: Index, rows: list, k: int) -> DataFrame:
    """`(item, rank, doc_id, score)` of a batch of items with numbers below BATCH_ITEMS; `rows` are their terms (item, term, c)."""
    spark = index.rows.sparkSession
    asked = Asked(rows)
    with rows_a_batch(spark, BLOCKS_A_BATCH):
        seen = stabilise(_seen(index, spark.sparkContext.broadcast(asked)))
    weights = {asked.terms[r.term]: r.w for r in seen.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.floor(
        1000 * F.log((2.0 * index.n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).alias("w")).collect()}  # a row a term of the batch
    asked = Asked(rows, weights)
    sent = spark.sparkContext.broadcast(asked)

    def bound(batch):
        term, m, tf = (batch.column(x).to_numpy() for x in ("term", "m", "tf"))
        most = impact(asked_weights.value[term], tf, m)
        n = sent.value.n[term]
        of = np.repeat(np.arange(len(term)), n)
        entry = sent.value.first[term][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return pa.record_batch([pa.array(sent.value.items[entry]), pa.array(m[of]), pa.array(sent.value.counts[entry] * most[of])], ["item", "m", "bound"])

    asked_weights = spark.sparkContext.broadcast(asked.weights)
    strata = index.rows.groupBy("m").agg(F.sum(F.size("ids")).alias("docs"))
    bounds = arrow_map(seen, bound, "item long, m long, bound long").groupBy("item", "m").agg(F.sum("bound").alias("bound")).where("bound > 0").join(strata, "m")
    before = W.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(W.unboundedPreceding, -1)
    plan = stabilise(bounds.withColumn("earlier", F.coalesce(F.sum("docs").over(before), F.lit(0))))
    best, low, share = None, -1.0, FIRST_SHARE
    while True:
        high = max(share * index.n_docs, k)
        wave = plan.where((F.col("earlier") > low) & (F.col("earlier") <= high)) if low >= 0 else plan.where(F.col("earlier") <= high)
        if best is None:
            wave = wave.withColumn("least", F.lit(1).cast("long"))
        else:
            # Below the k-th score nothing more is found; at it a smaller doc_id may be.
            reached = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("least"))
            wave = wave.join(reached, "item", "left").withColumn("least", F.coalesce("least", F.lit(1)).cast("long")).where("bound >= least")
        alive, found = pin_small(stabilise(wave.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("item", "least"))).alias("x")).select(
            "m", F.col("x.item").alias("visitors"), F.col("x.least").alias("least"))))  # a row a stratum, at most BATCH_ITEMS in it
        if found != []:
            hits = _visited(index, sent, alive, k)
            with rows_a_batch(spark, BLOCKS_A_BATCH):
                best = stabilise(_top(hits if best is None else best.select(*hits.columns).unionByName(hits), k))
        if high >= index.n_docs:
            return best if best is not None else spark.createDataFrame([], "item long, doc_id long, score long, rank int")
        low, share = high, share * WAVE_GROWTH


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_terms(items: DataFrame) -> DataFrame:
    """`(row, term, c)`: the terms of each item row with their number."""
    def count_terms(batch):
        rows = [(i, *x) for i, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for x in Counter(terms(text)).items()]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                                pa.array([r[2] for r in rows], pa.int64())], ["row", "term", "c"])

    return arrow_map(items.select("row", F.col("text").cast("string").alias("text")), count_terms, "row long, term string, c long")


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the k best documents of each row of `items` (item_id, text) with a score above 0."""
    spark = index.rows.sparkSession
    items = stabilise(items.select("item_id", "text").withColumn("row", F.monotonically_increasing_id()))
    asked = stabilise(_item_terms(items))
    # The driver goes through the items in batches of bounded size, one held at a time; an item's own terms are never parted.
    found, batch, rows = [], {}, []

    def run():
        number = {row: i for i, row in enumerate(batch)}
        local = [_Row(number[r.row], r.term, r.c) for r in rows]
        names = F.broadcast(spark.createDataFrame([(row, i) for row, i in number.items()], "row long, item long"))
        found.append(_batch(index, local, k).join(names, "item").select("row", "rank", "doc_id", "score"))

    for r in asked.orderBy("row").toLocalIterator():
        if r.row not in batch:
            if len(batch) == BATCH_ITEMS or len(rows) >= BATCH_TERMS:
                run()
                batch, rows = {}, []
            batch[r.row] = True
        rows.append(r)
    if rows:
        run()
    result = found[0] if found else spark.createDataFrame([], "row long, rank int, doc_id long, score long")
    for more in found[1:]:
        result = result.unionByName(more)
    return result.join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


@dataclass(frozen=True)
class _Row:
    item: int
    term: str
    c: int


#: The same ranking from one table of counts, without an index.
SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), totals AS (SELECT count(*) AS total, sum(n)::BIGINT AS l FROM lengths
), norms AS (SELECT doc_id, 75 + ((25 * n * total) // l) AS m FROM lengths, totals
), asked AS (
    SELECT item_id, term, count(*) AS c FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(total) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tfs, totals WHERE term IN (SELECT term FROM asked) GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY ALL
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
