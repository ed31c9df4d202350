"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to eight dimensions per table, shifted, and decoded to the nearest point of the lattice E8,
which is their home cell. A vector also probes the cells of the neighbouring lattice points
nearest to it. Two vectors are compared in double precision if one probes the other's home in any table.

Equal vectors collapse first. Cells are laid out in blocks, so a task compares bounded numbers of
vectors. A first pass compares sign sketches of 128 bits and keeps the memberships that have a partner within
six deviations of the threshold; only these receive their vectors. A pair counts only in the first table where it meets, so links are
counted once and no list of pairs is made: a task hands on sums of links and a spanning tree of what it linked.

With these parameters pairs at the threshold miss each other with probability 2e-6 (0.33 a table, measured on random pairs), and two unrelated
vectors of a table's N meet with probability 2e-4; smaller cells with more probes suit more vectors.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing. Vectors of
different lengths are not compared. Rows without vec_id are counted as links of others and have no
component of their own name: they get the smallest vec_id they reach, or NULL. Rows that share a vec_id are separate
vectors in one component. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import stabilise
from .common import arrow_map, mix
from .components import components
from .near import grouped

TABLES = 12
#: Neighbouring cells that a vector probes in each table, besides its home.
PROBES = 15
#: Side of a cell in units of the projected vectors.
CELL = 0.9
COSINE = 0.95
BLOCK = 512


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) in all places, and halves with an even number of minus signs."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) == 1]
    return np.array(whole + halves)


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: the better of the nearest in D8 and in D8 moved by a half."""
    best, distance = None, None
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        off = y[odd] - r[odd]
        worst = np.abs(off).argmax(axis=1)
        r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        r += shift
        d = ((x - r) ** 2).sum(axis=1)
        if best is None:
            best, distance = r, d
        else:
            better = d < distance
            best[better] = r[better]
    return best


def _names(cells: np.ndarray, table: int) -> np.ndarray:
    h = np.full(cells.shape[:-1], table + 1, np.uint64)
    for k in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (2 * cells[..., k]).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Home names `(n, tables)` and probed names `(n, tables, probes + 1)`, the home first."""
    n, dims = unit.shape
    home, probed = np.zeros((n, tables), np.int64), np.zeros((n, tables, probes + 1), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([8, dims, t])
        y = unit @ rng.standard_normal((dims, 8)) / cell + rng.random(8)
        at = nearest(y)
        order = np.argpartition(-((y - at) @ neighbours().T), probes, axis=1)[:, :probes]
        home[:, t] = probed[:, t, 0] = _names(at, t)
        probed[:, t, 1:] = _names(at[:, None, :] + neighbours()[order], t)
    return home, probed


#: Sketch bits that may differ at the threshold: 128 * angle / pi, and six standard deviations.
SKETCH_BITS = 33


def _bipartite(first: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray):
    """All pairs of `n` rows from `first` on with `m` rows from `other` on, group by group, in bounded pieces."""
    total = n.astype(np.int64) * m
    at = 0
    while at < len(total):
        upto = at + max(1, int(np.searchsorted(np.cumsum(total[at:]), 1 << 20)))
        t, w = total[at:upto], m[at:upto]
        local = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        width = np.repeat(w, t)
        yield np.repeat(first[at:upto], t) + local // width, np.repeat(other[at:upto], t) + local % width
        at = upto


def _sides(t: pa.Table, group: list[str]):
    """Probers and homes of each group of rows sorted by (group, role): first rows and numbers, homes first."""
    keys = [t[g].to_numpy() for g in group]
    fresh = np.ones(t.num_rows, bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, t.num_rows))
    probers = np.add.reduceat(t["role"].to_numpy().astype(np.int64), starts)
    return starts + sizes - probers, probers, starts, sizes - probers


def _laid(entries: DataFrame, size: int) -> DataFrame:
    """Entries `(cell, role, k, ...)` sorted into groups `(cell, low, high)` of at most `size` homes and probers each."""
    counts = entries.groupBy("cell").agg(F.sum(1 - F.col("role")).alias("homes"), F.sum("role").alias("probers"),
                                         F.min("k").alias("a"), F.max("k").alias("b")).where("homes > 0 and a < b")
    known = entries.join(counts.select("cell", F.ceil(F.col("homes") / size).cast("int").alias("nh"),
                                       F.ceil(F.col("probers") / size).cast("int").alias("np")), "cell")
    own = F.pmod(F.xxhash64("k"), F.when(F.col("role") == 0, F.col("nh")).otherwise(F.col("np"))).cast("int")
    spread = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(
        F.col("role") == 0, F.col("np")).otherwise(F.col("nh")) - 1)))
    low, high = (F.when(F.col("role") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("own", "other"), ("other", "own")))
    group = ["cell", "low", "high"]
    return spread.withColumn("low", low).withColumn("high", high).drop("nh", "np", "own", "other").repartition(
        *group).sortWithinPartitions(*group, "role")


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    """`(id, vec_id, digest, vector)`: digest and vector (float64 bytes) are NULL where nothing can be compared."""
    def read(batch):
        digests, vectors = [], []
        for v in batch.column("v").to_pylist():
            a = np.array([np.nan] if not v else [np.nan if x is None else x for x in v], np.float64)
            ok = np.isfinite(a).all() and a.any()
            a = a + 0.0  # one zero
            vectors.append(a.tobytes() if ok else None)
            digests.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest() if ok else None)
        return pa.record_batch([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                               ["vec_id", "digest", "vector"])

    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    named = F.coalesce("vec_id", F.lit(1 << 62) + F.pmod(F.xxhash64("digest"), F.lit(1 << 62)))
    return arrow_map(plain, read, "vec_id long, digest binary, vector binary").withColumn("id", named)


def _units(cells_: list[bytes]) -> np.ndarray:
    a = np.array([np.frombuffer(v, np.float64) for v in cells_])
    return a / np.sqrt((a / np.abs(a).max(axis=1, keepdims=True)) ** 2 @ np.ones(a.shape[1]))[:, None] / np.abs(a).max(axis=1, keepdims=True)


def linked(rows: DataFrame, column: str = "embedding", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES,
           cell: float = CELL) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` for every row of `rows` (vec_id, embedding)."""
    base = stabilise(_vectors(rows, column))
    classes = stabilise(base.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")).withColumn("k", F.xxhash64("digest")))

    def explode(batch):
        out = []
        vectors, k = batch.column("vector").to_pylist(), batch.column("k").to_numpy(zero_copy_only=False)
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            for own in np.array_split(np.flatnonzero(sizes == size), -(-(sizes == size).sum() // 2000)):
                unit = _units([vectors[i] for i in own])
                home, probed = cells(unit, tables, probes, cell)
                signs = unit @ np.random.default_rng([9, unit.shape[1]]).standard_normal((unit.shape[1], 128)) > 0
                sketch = np.packbits(signs, axis=1).view(np.int64)
                names = np.concatenate([home, probed.reshape(len(own), -1)], axis=1)
                w = names.shape[1]
                role = np.tile(np.repeat([0, 1], [tables, w - tables]), len(own)).astype(np.int32)
                out.append(pa.record_batch([
                    pa.array(names.ravel()), pa.array(role), pa.array(np.repeat(k[own], w)),
                    pa.array(np.repeat(sketch[:, 0], w)), pa.array(np.repeat(sketch[:, 1], w))], ["cell", "role", "k", "s0", "s1"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    entries = arrow_map(classes.select("k", "vector"), explode, "cell long, role int, k long, s0 long, s1 long")
    group = ["cell", "low", "high"]

    def promising(batches):
        for t in grouped(batches, group):
            k = t["k"].to_numpy()
            s0, s1 = (t[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))  # bits of signed numbers are counted without sign
            hit = np.zeros(t.num_rows, bool)
            for i, j in _bipartite(*_sides(t, group)):
                near = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int32) + np.bitwise_count(s1[i] ^ s1[j])
                ok = (near <= SKETCH_BITS) & (k[i] != k[j])
                hit[i[ok]] = hit[j[ok]] = True
            if hit.any():
                yield t.select(["cell", "role", "k"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]

    active = stabilise(_laid(entries, BLOCK * 4).mapInArrow(promising, "cell long, role int, k long").distinct())
    armed = _laid(active, BLOCK).join(classes.select("k", "n", "vector"), "k").repartition(*group).sortWithinPartitions(*group, "role")

    def link(batches):
        for t in grouped(batches, group):
            k, n, name = (t[c].to_numpy() for c in ("k", "n", "cell"))
            vectors = t["vector"].to_pylist()
            sizes = np.array([len(v) for v in vectors])
            unit: dict[int, np.ndarray] = {}
            place = np.zeros(len(k), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                unit[size], place[own] = _units([vectors[i] for i in own]), np.arange(len(own))
            found_i, found_j = [], []
            for i, j in _bipartite(*_sides(t, group)):
                ok = (k[i] != k[j]) & (sizes[i] == sizes[j])
                i, j = i[ok], j[ok]
                for size in unit:
                    own = sizes[i] == size
                    a, b = i[own], j[own]
                    for at in range(0, len(a), 1 << 16):
                        x, y = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
                        near = np.einsum("ij,ij->i", unit[size][place[x]], unit[size][place[y]]) >= cosine
                        found_i.append(x[near])
                        found_j.append(y[near])
            if not found_i or not sum(map(len, found_i)):
                continue
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            # Every pair counts in the first table where one probes the other, the smaller key's probe first.
            used = np.unique(np.append(i, j))
            home, probed = np.zeros((len(k), tables), np.int64), np.zeros((len(k), tables, probes + 1), np.int64)
            for size in unit:
                own = used[sizes[used] == size]
                if len(own):
                    home[own], probed[own] = cells(unit[size][place[own]], tables, probes, cell)
            mine = np.zeros(len(i), bool)
            for at in range(0, len(i), 1 << 14):
                x, y = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
                low, high = np.where(k[x] < k[y], x, y), np.where(k[x] < k[y], y, x)
                open_ = np.ones(len(x), bool)
                for table in range(tables):
                    forth = (probed[low, table] == home[high, table][:, None]).any(axis=1)
                    back = (probed[high, table] == home[low, table][:, None]).any(axis=1)
                    here = np.where(forth, home[high, table], home[low, table])
                    prober = np.where(forth, low, high)
                    mine[at:at + len(x)] |= open_ & (forth | back) & (here == name[x]) & (prober == x)
                    open_ &= ~(forth | back)
            names, at = np.unique(k[np.append(i, j)], return_inverse=True)
            a, b = at[:len(i)], at[len(i):]
            links = np.bincount(a[mine], n[j[mine]], len(names)) + np.bincount(b[mine], n[i[mine]], len(names))
            label = np.arange(len(names))
            while True:  # smallest label reachable inside this batch
                before = label.copy()
                np.minimum.at(label, a, label[b])
                np.minimum.at(label, b, label[a])
                label = label[label]
                if (label == before).all():
                    break
            yield pa.record_batch([pa.array(names), pa.array(names[label]), pa.array(links.astype(np.int64))], ["u", "v", "links"])

    met = stabilise(armed.mapInArrow(link, "u long, v long, links long"))
    links = met.groupBy(F.col("u").alias("k")).agg(F.sum("links").alias("links"))
    of_class = classes.select("k", "rep")
    edges = met.where("u <> v").select("u", "v").distinct().join(of_class.withColumnsRenamed({"k": "u", "rep": "a"}), "u").join(
        of_class.withColumnsRenamed({"k": "v", "rep": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Rows that share a vec_id, and so a name, tie their classes together.
    shared = base.where("digest is not null").join(classes.select("digest", "rep"), "digest").where("id <> rep").select(
        F.col("id").alias("u"), F.col("rep").alias("v")).join(classes.select(F.col("rep").alias("u")), "u", "left_semi")
    found = components(edges.union(shared))
    per = classes.join(links, "k", "left").join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").select(
        "digest", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = base.join(per, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
                      F.when(component < (1 << 62), component).alias("component_id"),
                      (F.col("vec_id").isNull() | (F.col("id") == component)).alias("kept"))
