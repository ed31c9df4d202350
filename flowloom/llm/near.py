"""Clusters of near-duplicate sets: signature keys, candidate pairs, exact verification, components.

The input is one row per distinct set: `(id long, sig binary)`; the sets themselves are fetched
only for ids that occur in a candidate pair. A `Scheme` says how keys are made of a signature.

Candidates come in two passes, so that a bucket with very many members never becomes all its
pairs. First every member is compared with the smallest id of its bucket. Where all members of
a bucket then lie in one component, nothing is left to find in it. The members of the other
buckets are laid out in blocks; a task meets at most two blocks and compares the signatures of
members of different components. This second pass confirms all pairs that are left inside the task, each in the first
bucket that both share, and hands on links only. Every candidate pair is thus either verified or already connected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import stabilise
from .common import arrow_map, matrix, mix
from .components import components

#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Pairs that a task compares at once; bounds its memory whatever a block holds.
PIECE = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """Signatures of `chunks * width` symbols of 16 bits.

    With `errors` = 1 the keys of a chunk are its `width` variants with one symbol left out: two
    signatures whose chunk differs in at most one symbol share a variant. By the pigeonhole
    principle all pairs with at most `2 * chunks - 1` differing symbols share a key. With
    `errors` = 0 a key is the whole chunk (plain banding). `most` is the number of differing
    symbols up to which a candidate is verified on the full sets.
    """

    chunks: int
    width: int
    errors: int
    most: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def guaranteed(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def signature(hashes: np.ndarray, symbols: int) -> np.ndarray:
    """Min-hash symbols of a set of 64-bit hashes: 16 bits of the minimum under each of `symbols` mixers."""
    rng = np.random.default_rng(20240607)
    odd = rng.integers(0, 1 << 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at:at + 2048, None] * odd[None, :]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        out = np.minimum(out, part.min(axis=0))
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def keys_of(sigs: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The keys of each signature, one column per (chunk, variant)."""
    columns = []
    for c in range(scheme.chunks):
        chunk = sigs[:, c * scheme.width:(c + 1) * scheme.width].astype(np.uint64)
        for left_out in (range(scheme.width) if scheme.errors else [None]):
            h = np.full(len(sigs), c * 64 + (0 if left_out is None else left_out + 1), np.uint64)
            for s in range(scheme.width):
                if s != left_out:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chunk[:, s])
            columns.append(h)
    return np.stack(columns, axis=1).view(np.int64)


def _entries(items: DataFrame, scheme: Scheme) -> DataFrame:
    """`(key, id)`: a row for each key of each item."""
    def explode(batch):
        keys = keys_of(matrix(batch.column("sig"), np.uint16, scheme.symbols), scheme)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        return pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])

    return arrow_map(items.select("id", "sig"), explode, "key long, id long")


def _alike(pairs: DataFrame, items: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs `(a, b)` whose signatures differ in at most `most` symbols."""
    a, b = (items.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")

    def keep(batch):
        x, y = (matrix(batch.column(f"sig_{k}"), np.uint16, scheme.symbols) for k in "ab")
        near = (x != y).sum(axis=1) <= scheme.most
        return batch.select(["a", "b"]).filter(pa.array(near))

    return arrow_map(joined, keep, "a long, b long")


def _verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Edges `(u, v)` of pairs with `100 * intersection >= percent * union` on the full sets."""
    pairs = stabilise(pairs)
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    if pairs.isEmpty():
        return pairs.selectExpr("a as u", "b as v")
    sets = fetch(ids)  # (id, members array<long>)
    a, b = (sets.select(F.col("id").alias(x), F.col("members").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(b, "b").join(a, "a").where(100 * both >= percent * union).select(
        F.col("a").alias("u"), F.col("b").alias("v"))


def grouped(batches, names: list[str]):
    """Batches of sorted rows, cut only where the group changes."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        tail = [part[n][-1].as_py() for n in names]
        same = np.ones(part.num_rows, bool)
        for n, v in zip(names, tail, strict=True):
            same &= part[n].to_numpy() == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = part.slice(cut)
        if cut:
            yield part.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _pairs_within(starts: np.ndarray, sizes: np.ndarray):
    """All index pairs i < j inside adjoining groups, in pieces of `PIECE` pairs and at most one row's more."""
    row = np.arange(int(sizes.sum()))
    later = np.repeat(starts + sizes, sizes) - row - 1
    reach, at = np.cumsum(later), 0
    while at < len(row):
        done = reach[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(reach, done + PIECE, "right")))
        n = later[at:upto]
        i = np.repeat(row[at:upto], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = upto


GROUP = ["key", "low", "high"]


def _laid(members: DataFrame) -> DataFrame:
    """Members (key, n, id, ...) of buckets as sorted groups of one or two blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop(
        "blocks", "other", "n").repartition(*GROUP).sortWithinPartitions(*GROUP)


def _candidates(t: pa.Table, scheme: Scheme):
    """Index pairs of rows of different components with like signatures, each in the first bucket that both share."""
    key, low, high = (t[n].to_numpy() for n in GROUP)
    block, comp = t["block"].to_numpy(), t["comp"].to_numpy()
    sigs = matrix(t["sig"].combine_chunks(), np.uint16, scheme.symbols)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    starts = np.flatnonzero(fresh)
    for i, j in _pairs_within(starts, np.diff(np.append(starts, len(key)))):
        ok = (comp[i] != comp[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        near = np.zeros(len(i), np.int32)
        for s in range(scheme.symbols):
            near += sigs[i, s] != sigs[j, s]
        ok = near <= scheme.most
        i, j = i[ok], j[ok]
        if len(i):
            a, b = keys_of(sigs[i], scheme), keys_of(sigs[j], scheme)
            first = a[np.arange(len(i)), (a == b).argmax(axis=1)] == key[i]
            yield i[first], j[first]


def _all_links(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], scheme: Scheme, percent: int) -> DataFrame:
    """Links `(u, v)` among all candidates that are left, confirmed on the full sets inside the task.

    A first pass finds the members that have a candidate at all; only these receive their sets.
    """
    def active(batches):
        for t in grouped(batches, GROUP):
            hit = np.zeros(t.num_rows, bool)
            for i, j in _candidates(t, scheme):
                hit[i] = hit[j] = True
            if hit.any():
                yield from t.select(["key", "low", "high", "block", "id", "comp", "sig"]).filter(pa.array(hit)).combine_chunks().to_batches()

    kept = stabilise(_laid(members).mapInArrow(
        active, "key long, low int, high int, block int, id long, comp long, sig binary"))
    if kept.isEmpty():
        return kept.selectExpr("id as u", "id as v")
    sets = fetch(kept.select("id").distinct())
    armed = kept.join(sets, "id").repartition(*GROUP).sortWithinPartitions(*GROUP)

    def link(batches):
        for t in grouped(batches, GROUP):
            ids, sets = t["id"].to_numpy(), [np.sort(m.values.to_numpy()) for m in t["members"]]
            name: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := name.get(x, x)) != x:
                    x = y
                return x

            us, vs = [], []
            for i, j in _candidates(t, scheme):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = top(ids[x].item()), top(ids[y].item())
                    if a == b:
                        continue
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        name[max(a, b)] = min(a, b)
                        us.append(ids[x])
                        vs.append(ids[y])
            if us:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return armed.mapInArrow(link, "u long, v long")


def clusters(items: DataFrame, fetch: Callable[[DataFrame], DataFrame], scheme: Scheme, percent: int = 80) -> DataFrame:
    """`(node, component)` of all items that are linked with another one.

    `items` is read several times: a stored table. `fetch(ids)` gives `(id, members array<long>)`
    for at least the wanted ids, each id once.
    """
    entries = _entries(items, scheme)
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = stabilise(entries.join(hubs, "key"))
    pairs = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    edges = stabilise(_verified(_alike(pairs, items, scheme), fetch, percent))
    found = components(edges)
    # Buckets of three or more whose members are not all connected yet.
    of = found.select(F.col("node").alias("id"), "component")
    wide = shared.where("n > 2").join(of, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    open_keys = wide.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where(
        "least <> most").select("key")
    members = wide.join(open_keys, "key", "left_semi").join(items.select("id", "sig"), "id").select("key", "n", "id", "comp", "sig")
    more = stabilise(_all_links(members, fetch, scheme, percent))
    # What is connected already goes on as stars: fewer links and rounds than from the start.
    return found if more.isEmpty() else components(found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
