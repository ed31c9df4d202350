"""Best-fit packing of documents into sequences, bulk-synchronously.

Documents become token ids with a closing id; one longer than a sequence is cut into full pieces
after a shorter first one. The superstep of best-fit-decreasing is a length: all pieces of one
length look for the successor of that length among the gaps of open sequences, pieces that want
the same gap are told apart by rank, the gaps they enter shrink, and the next shorter length follows.

Pieces of one length and sequences of one gap are interchangeable, and there are at most `capacity` of
either. So the sweep runs over sorted runs of equal lengths and equal gaps (counts, however many
rows they stand for) and needs no shuffle per superstep; the rows then find their place from their
rank in their length, in one distributed pass. The ranks are taken in salted groups, so a
length that a third of all pieces share is spread like any other.

Defined results: NULL text is empty; an empty text is one piece that holds the closing id.
Repeated rows are packed each; rows without doc_id too. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import stabilise
from .common import arrow_map

CAPACITY = 1024
CLOSING_ID = 2
#: Groups in which the pieces of one length are ranked.
SALTS = 512
VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


@functools.cache
def encoder(vocabulary: str = VOCABULARY):
    """The byte-level BPE of a rank file, by the library that is fastest here, with the added tokens of the JSON of that name."""
    import public_tokenizers
    import tiktoken

    added, twin = {}, public_tokenizers.path(vocabulary).removesuffix(".tiktoken") + ".json"
    if os.path.exists(twin):
        with open(twin, encoding="utf-8") as told:
            added = {t["content"]: t["id"] for t in json.load(told)["added_tokens"]}
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cuts(n: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of n ids: the first is what full pieces leave."""
    first = n - (n - 1) // capacity * capacity
    starts = np.concatenate([[0], np.arange(first, n, capacity)])
    return starts, np.diff(np.append(starts, n))


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32[, ids])` of every document."""
    def cut(batch):
        encode = functools.partial(encoder(vocabulary).encode, allowed_special="all")
        ids = batch.column("doc_id").to_pylist()
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            tokens = np.array([*encode(text or ""), CLOSING_ID], "<u4")
            for k, (s, n) in enumerate(zip(*cuts(len(tokens), capacity), strict=True)):
                own = tokens[s:s + n]
                for name, v in zip(out, (doc_id, k, s, n, zlib.crc32(own.tobytes()), own), strict=True):
                    if name != "ids" or with_ids:
                        out[name].append(v)
        arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                  pa.array(out["length"], pa.int32()), pa.array(out["ids_crc32"], pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays, names = [*arrays, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.record_batch(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, cut, PIECES + (", ids array<int>" if with_ids else ""))


def sweep(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit-decreasing over lengths: for each, runs `(first rank, pieces, first sequence, offset)`.

    A run's k-th piece goes to the k-th of its sequences. Gaps are kept as sorted values with runs
    of sequences that have that gap.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    values: list[int] = []
    sequences, out = 0, {}

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(values, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            at = bisect.bisect_left(values, length)
            if at < len(values):  # the successor among the gaps
                gap = values[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], values[at]
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            # A sequence that still has room for the length stays the best fit, so it takes as many as it can.
            each = gap // length
            full = min(n, left // each)
            for k in range(each if full else 0):
                runs.append((rank, full, first, capacity - gap + k * length))
                rank += full
            left -= full * each
            open_gap(gap - each * length, first, full)
            if full < n and left and left < each:
                for k in range(left):
                    runs.append((rank, 1, first + full, capacity - gap + k * length))
                    rank += 1
                open_gap(gap - left * length, first + full, 1)
                left, full = 0, full + 1
            if full < n:
                open_gap(gap, first + full, n - full)
        out[length] = runs
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`rows` (doc_id, piece, length, ...) with `sequence_id` and `offset`. `rows` is read twice: a stored table."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    # At most capacity * SALTS rows, whatever the number of pieces.
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).toArrow()
    table = np.zeros((capacity + 1, SALTS), np.int64)
    table[counted["length"].to_numpy(), counted["_salt"].to_numpy()] = counted["n"].to_numpy()
    before = np.cumsum(table, axis=1) - table
    plan = {k: np.array(v, np.int64) for k, v in sweep({int(k): int(table[k].sum()) for k in np.flatnonzero(table.sum(axis=1))},
                                                       capacity).items()}
    known = rows.sparkSession.sparkContext.broadcast((before, plan))

    def place(batch):
        before, plan = known.value
        length = batch.column("length").to_numpy()
        rank = before[length, batch.column("_salt").to_numpy()] + batch.column("_rank").to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            run = plan[n][np.searchsorted(plan[n][:, 0], rank[own], "right") - 1]
            sequence[own], offset[own] = run[:, 2] + rank[own] - run[:, 0], run[:, 3]
        kept = batch.select([c for c in batch.schema.names if c not in ("_salt", "_rank")])
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)],
                                          names=[*kept.schema.names, "sequence_id", "offset"])

    order = ["doc_id", "piece", *[c for c in rows.columns if c == "ids_crc32"]]
    by = ", ".join(order)
    ranked = salted.withColumn("_rank", F.expr(f"row_number() over (partition by length, _salt order by {by}) - 1").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return arrow_map(ranked, place, f"{schema}, sequence_id long, offset int")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(stabilise(pieces(docs, capacity, vocabulary)), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """`(sequence_id, ids)`: the packed sequences themselves. A sequence holds at most `capacity` ids."""
    placed = pack(stabilise(pieces(docs, capacity, vocabulary, with_ids=True)), capacity)
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
