"""Grace hash deduplication: records are partitioned to spill files until a bucket fits an open-addressing table.

Two texts are equal when they are identical without the blanks `[\\x20\\x09-\\x0D]`. Map tasks fold their own copies
first, so a content leaves a task once with a count and its best row: these entries are what is spilled. The entries are
cut into buckets by their digest. A bucket whose bytes fit the bound is probed by one task, in an open-addressing table that
compares complete contents. A bucket that doesn't fit is partitioned again: by further digits of the digest if it holds
several contents, or, if all its entries are one content, into pieces that fold to an entry each and meet again in the next
round. Rows never travel with their texts: they name the entry that their task folded them into, and join its group by
that name, so a group with a third of all rows is spread over as many tasks as read it.

Of a group the row with the most code points in its own text stays, then the smallest doc_id (rows without one last), then
the row read first.

Defined results: a NULL text counts as empty, and all empty or blank texts are one group. Rows without doc_id are judged
alike; if such a row stays, keep_id is NULL. Of rows repeated whole exactly one is kept. Extra columns are ignored, a column
called like a result too. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import pin_small, stabilise
from .common import sliced

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Contents that a task holds at once: when folding what it reads, and when probing a bucket.
FOLD_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
#: Rows of one entry at most, so that no name is shared by more of them.
FOLD_ROWS = 1 << 14
#: What an entry costs beside its content.
ENTRY_BYTES = 96


class ContentTable:
    """An open-addressing hash table of whole contents, with linear probing."""

    def __init__(self, capacity: int = 1 << 10):
        self.contents: list[bytes] = []
        self.hashes = array("Q")
        self._empty(capacity)

    def _empty(self, capacity: int) -> None:
        self.mask = capacity - 1
        self.slots = array("q", [-1]) * capacity

    def place(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """The number of the content, and whether it is new."""
        h = int.from_bytes(digest[-8:], "little")
        at = h & self.mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == h and self.contents[found] == content:
                return found, False
            at = (at + 1) & self.mask
        self.slots[at] = n = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        if 2 * (n + 1) > self.mask:
            self._empty(2 * (self.mask + 1))
            for i, x in enumerate(self.hashes):
                at = x & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = i
        return n, True


ENTRY = "entry long, digest binary, content binary, bytes long, n long, points long, best long, first long"
FOLDED = f"rows boolean, doc_id long, row long, {ENTRY}"
LINK = "entry long, rep long, n long, points long, best long, first long, digest binary"
ENTRY_NAMES = [part.split()[0] for part in ENTRY.split(", ")]
LINK_NAMES = [part.split()[0] for part in LINK.split(", ")]


def _rank(points: int, doc_id: int | None, row: int) -> tuple:
    """Smaller is better."""
    return (-points, doc_id is None, doc_id or 0, row)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record, naming its entry, and the entries: distinct contents of what the task read."""
    base = TaskContext.get().partitionId() << 40
    row = base
    table, held, stats = ContentTable(), 0, []
    schema = None

    def entries():
        points, best, first = ([-s[0][0] for s in stats], [None if s[0][1] else s[0][2] for s in stats], [s[0][3] for s in stats])
        n = len(stats)
        return pa.record_batch([
            pa.array([False] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([s[2] for s in stats], pa.int64()),
            pa.array([s[3] for s in stats], pa.binary()), pa.array(table.contents, pa.binary()),
            pa.array([len(c) + ENTRY_BYTES for c in table.contents], pa.int64()), pa.array([s[1] for s in stats], pa.int64()),
            pa.array(points, pa.int64()), pa.array(best, pa.int64()), pa.array(first, pa.int64())], schema=schema)

    fields = [pa.field(name, {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}[kind])
              for name, kind in (part.split() for part in FOLDED.split(", "))]
    schema = pa.schema(fields)
    for batch in sliced(batches, 4 << 20):
        ids, names, rows, digests = batch.column("doc_id").to_pylist(), [], [], []
        for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            text = text or ""
            content = text.encode("utf-8", "surrogatepass").translate(None, BLANKS)
            digest = hashlib.sha256(content).digest()
            at, new = table.place(digest, content)
            rank = _rank(len(text), doc_id, row)
            if new:
                stats.append([rank, 1, row, digest])
                held += len(content) + ENTRY_BYTES
            else:
                s = stats[at]
                s[0], s[1] = min(s[0], rank), s[1] + 1
            names.append(stats[at][2])
            rows.append(row)
            digests.append(digest)
            row += 1
        n = len(rows)
        empty = pa.nulls(n, pa.int64())
        yield pa.record_batch([
            pa.array([True] * n), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(names, pa.int64()),
            pa.array(digests, pa.binary()), pa.nulls(n, pa.binary()), empty, empty, empty, empty, empty], schema=schema)
        if held > FOLD_BYTES or max(s[1] for s in stats) > FOLD_ROWS:
            yield entries()
            table, held, stats = ContentTable(), 0, []
    if stats:
        yield entries()


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by bucket: what entry each is equal to, and the sums of its group within the bucket."""
    bucket, table, stats, links = None, ContentTable(), [], []

    def solved():
        return pa.record_batch([
            pa.array([e for e, _ in links], pa.int64()), pa.array([stats[g][2] for _, g in links], pa.int64()),
            pa.array([stats[g][1] for _, g in links], pa.int64()), pa.array([-stats[g][0][0] for _, g in links], pa.int64()),
            pa.array([None if stats[g][0][1] else stats[g][0][2] for _, g in links], pa.int64()),
            pa.array([stats[g][0][3] for _, g in links], pa.int64()), pa.array([stats[g][3] for _, g in links], pa.binary())], LINK_NAMES)

    for batch in sliced(batches, 4 << 20):
        columns = [batch.column(n).to_pylist() for n in ("bucket", "entry", "digest", "content", "n", "points", "best", "first")]
        for key, entry, digest, content, n, points, best, first in zip(*columns, strict=True):
            if key != bucket:
                if links:
                    yield solved()
                bucket, table, stats, links = key, ContentTable(), [], []
            at, new = table.place(digest, content)
            rank = _rank(points, best, first)
            if new:
                stats.append([rank, n, entry, digest])
            else:
                s = stats[at]
                s[0], s[1] = min(s[0], rank), s[1] + n
            links.append((entry, at))
    if links:
        yield solved()


def _probed(entries: DataFrame, parts: int) -> DataFrame:
    keyed = entries.select("bucket", *ENTRY_NAMES)
    return keyed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_probe, LINK)


def _digits(level: int, parts: Column) -> Column:
    """A bucket below `bucket`, by digits of the digest that no other level uses."""
    return F.xxhash64("bucket", F.pmod(F.xxhash64(F.lit(level), "digest"), parts))


def groups(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For every entry (a stored table) its group: how many rows, and the row that stays."""
    spark = entries.sparkSession
    volume = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * volume // bucket_bytes + 1)
    fan = F.lit(2 * volume // bucket_bytes + 1)  # half full on average
    todo = entries.withColumn("bucket", F.lit(0).cast("long")).withColumn("bucket", _digits(0, fan))
    done, aliases, level = None, [], 0
    while True:
        level += 1
        # Not more entries than two, or bytes than the bound. Only the buckets beyond are told one by one.
        over = stabilise(todo.groupBy("bucket").agg(
            F.sum("bytes").alias("size"), F.count("*").alias("n_entries"), F.min("digest").alias("low"), F.max("digest").alias("high"))
            .where((F.col("size") > bucket_bytes) & (F.col("n_entries") > 2))
            .select("bucket", (F.col("low") == F.col("high")).alias("single"), "n_entries",
                    F.ceil(2 * F.col("size") / bucket_bytes).alias("pieces")))
        over, rows = pin_small(over)
        if rows == []:
            found = stabilise(_probed(todo, parts))
            done = found if done is None else done.unionByName(found)
            break
        found = stabilise(_probed(todo.join(over, "bucket", "left_anti"), parts))
        done = found if done is None else done.unionByName(found)
        wide = todo.join(over, "bucket")
        several = wide.where("not single").withColumn("bucket", _digits(level, F.col("pieces")))
        # Copies of one content: pieces of at least two entries on average, so every round halves them at least.
        pieces = F.least("pieces", F.ceil(F.col("n_entries") / 2))
        one = wide.where("single").withColumn("home", F.col("bucket")).withColumn(
            "bucket", F.xxhash64("bucket", F.pmod(F.xxhash64(F.lit(level), "entry"), pieces)))
        folded = stabilise(_probed(one, parts))
        aliases.append(folded.select("entry", "rep"))
        heads = folded.where("entry = rep").select("entry", "n", "points", "best", "first")
        left = one.select("home", "entry", "digest", "content", "bytes").join(heads, "entry").withColumnRenamed("home", "bucket")
        todo = stabilise(several.select("bucket", *ENTRY_NAMES).unionByName(left.select("bucket", *ENTRY_NAMES)))
    for links in reversed(aliases):
        heads = done.withColumnRenamed("entry", "head").drop("rep")
        done = done.unionByName(links.where("entry <> rep").join(heads, F.col("rep") == F.col("head")).drop("head"))
    return done


def deduplicated(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)` for every row of `docs` (doc_id, text)."""
    folded = stabilise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fold, FOLDED))
    found = groups(folded.where("not rows").select(*ENTRY_NAMES), bucket_bytes)
    answer = found.select("entry", "n", "best", "first")
    return folded.where("rows").select("doc_id", "row", "entry", "digest").join(answer, "entry").select(
        "doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


#: The same result by one window over all rows of a text.
SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS original, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), ranked AS (
    SELECT doc_id, sha256(bare) AS text_sha256, count(*) OVER (PARTITION BY bare) AS group_size,
           first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place
    FROM t
    WINDOW best AS (PARTITION BY bare ORDER BY length(original) DESC, doc_id ASC NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
