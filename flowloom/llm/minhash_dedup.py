"""MinHash near-dedup with a multi-index Hamming join over b-bit signatures.

A document's set is its distinct word shingles. Signatures of 16-bit min-hash symbols are cut
into chunks; by the pigeonhole principle two signatures within the distance threshold have a
chunk with at most one differing symbol, so the keys that enumerate this one error bring
every such pair together. Candidates are confirmed on the full sets.

Defined results: NULL, empty and blank texts have the empty set and are linked with nothing.
Rows with one doc_id are versions of one document and lie in one component. Rows without
doc_id may connect others and are kept; their component_id is NULL if no document with an
id is in it. Repeated rows stay repeated. Extra columns are ignored, a column called like a result too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import stabilise
from .common import arrow_map, binary, id_filter, may_contain, shingle_hashes
from .components import components
from .near import Scheme, clusters, signature

#: 60 symbols in 10 chunks, one error a chunk. At similarity 0.8 a pair shares no key with probability 2e-5 and
#: differs in more than 26 symbols with probability 4e-6.
SCHEME = Scheme(chunks=10, width=6, errors=1, most=26)
#: Above every document id: rows without one are named by their text.
NAMELESS = 1 << 62


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text. Words: runs of non-blank bytes, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known: dict[bytes, int] = {}
    hashed = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    return np.unique(shingle_hashes(hashed, width))


def node_id() -> Column:
    return F.coalesce("doc_id", F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS)))


def sketched(docs: DataFrame, width: int = 4, scheme: Scheme = SCHEME) -> DataFrame:
    """`(id, doc_id, n_shingles, digest, sig)` for every row; digest and sig are NULL for an empty set."""
    def sketch(batch):
        counts, digests, sigs = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, width)
            counts.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append(signature(s, scheme.symbols).tobytes() if len(s) else None)
        return pa.record_batch([batch.column("id"), batch.column("doc_id"), pa.array(counts, pa.int64()),
                                pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                               ["id", "doc_id", "n_shingles", "digest", "sig"])

    rows = docs.select(node_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, sketch, "id long, doc_id long, n_shingles long, digest binary, sig binary")


def fetcher(docs: DataFrame, width: int):
    """Shingle sets of wanted documents: the texts are read again, and only theirs leave the map side."""
    def fetch(ids: DataFrame) -> DataFrame:
        wanted = id_filter(ids, "id")

        def sets(batch):
            batch = batch.filter(pa.array(may_contain(wanted.value, batch.column("id"))))
            members = [shingles(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            return pa.record_batch([batch.column("id"), pa.array(members, pa.list_(pa.int64()))], ["id", "members"])

        found = arrow_map(docs.select(node_id().alias("id"), "text"), sets, "id long, members array<long>")
        # One set an id: the largest, where versions share it.
        return found.join(ids, "id", "left_semi").groupBy("id").agg(F.max_by("members", F.size("members")).alias("members"))

    return fetch


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, scheme: Scheme = SCHEME) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` for every row of `docs` (doc_id, text)."""
    rows = stabilise(sketched(docs, width, scheme))
    full = rows.where("digest is not null")
    # Equal sets collapse to their smallest id before any pair is made.
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"))
    items = stabilise(full.groupBy("digest").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("id")).groupBy("id").agg(
        F.min("sig").alias("sig")))
    found = clusters(items, fetcher(docs, width), scheme, percent)
    # A document with several versions belongs to several classes: its id ties them together.
    several = full.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("id")
    if not several.isEmpty():
        versions = full.join(several, "id", "left_semi").join(classes, "digest").select("id", "rep").where("id <> rep").distinct()
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(versions))
    of = found.select(F.col("node").alias("rep"), "component")
    labelled = rows.join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "id")).join(of, "rep", "left")
    component = F.coalesce("component", "rep")
    return labelled.select(
        "doc_id", "n_shingles", F.when(component < NAMELESS, component).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("id") == component)).alias("kept"))


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose `column` is in `ids` (distinct): a join in the JVM, since texts that pass a filter in Python are held by both."""
    return docs.join(ids, column, "left_anti").select(*docs.columns)
