"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources get shares of all words by weight, no source more than `cap` times its own
words; what lies above is shared again among the others by weight until none is above.

Documents fall into at most `BLOCKS` hash blocks per source. A source draws whole passes over
its blocks while its target allows one, then blocks in a seeded order as long as they fit, so
that no document is drawn more than `cap` times. The drawn blocks of all sources are dealt to the output
shards by a splitting tree: a node that covers some shards gives its left half an exact
multivariate-hypergeometric share of every source's blocks. A source's draws in permuted order then
fill its quotas shard by shard, so draws are disjoint and complete, and the rows of the mix are
sorted by a seeded hash inside their shard.

Only sums per (source, block) leave the documents, so a source with a third of all rows costs
no task more than another. The tree is planned over counts per source and shard.

Defined results: a text is its number of words, NULL has 0; NULL is a source of its own, the last;
rows of size 0 follow their block. Repeated rows are separate documents in one block.
No rows give no rows. Runs with one seed agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import stabilise

#: Hash blocks per source: the granularity of a draw, and the bound on what is planned for a source.
BLOCKS = 4096
#: Weights by place of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """`(source, source_size, target)` from `(source, source_size)`; one row a source, NULL last.

    Sorted by cap per weight, the sources that end at their cap come first; the
    others share what these leave by weight.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1))
    order = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    level = (everything - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest)
    # The first source whose cap is not reached fixes the level of all that follow.
    leveled = weighed.withColumn("level", level).withColumn("own", F.col("level") * F.col("w") <= cap * F.col("source_size"))
    fixed = leveled.withColumn("level", F.first(F.when(F.col("own"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return fixed.select("source", "source_size", F.when(F.col("level").isNull(), cap * F.col("source_size").cast("double"))
                        .otherwise(F.least(F.col("level") * F.col("w"), cap * F.col("source_size").cast("double"))).alias("target"))


def _draws(blocks: pd.DataFrame, cap: int) -> pd.DataFrame:
    """How often each block of one source is drawn. At most BLOCKS rows."""
    blocks = blocks.sort_values(["order", "block"])
    total, target = int(blocks["words"].sum()), float(blocks["target"].iloc[0])
    times = min(cap, int(target // total)) if total else 1
    left, extra = target - times * total, np.zeros(len(blocks), np.int64)
    if total and times < cap:
        for at, size in enumerate(blocks["words"]):
            if size <= left:
                extra[at], left = 1, left - size
        over = np.where(extra == 0, blocks["words"].to_numpy(), np.iinfo(np.int64).max)
        if over.min() - left < left:  # one block too many is nearer than one too few
            extra[over.argmin()] = 1
    return pd.DataFrame({"source": blocks["source"], "block": blocks["block"], "order": blocks["order"], "times": times + extra})


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard, `(shards, sources)`: halves of halves, each an exact hypergeometric draw."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    share = int(quota.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quota, share, method="marginals") if share else np.zeros_like(quota)
    return np.vstack([split(drawn, left, rng), split(quota - drawn, shards - left, rng)])


def drawn(docs: DataFrame, seed: int = 7, cap: int = 3, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None,
          shard_words: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """Measured documents `(doc_id, source, size, block)` and draws `(source, block, copy, shard, source_size, target)`.

    Without `shards`, one for each `shard_words` words.
    """
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(BLOCKS)).cast("int")
    rows = stabilise(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"),
                                 block.alias("block")))
    sums = stabilise(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    wanted = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    same = F.col("s.source").eqNullSafe(F.col("w.source"))
    known = sums.alias("s").join(wanted.alias("w"), same).select(
        "s.source", "block", "words", "target", "source_size",
        F.xxhash64(F.lit(seed + 1), "s.source", "block").alias("order"))
    plan = known.groupBy("source").applyInPandas(
        lambda b: _draws(b, cap), "source string, block int, order long, times long").where("times > 0")
    plan = stabilise(plan)
    # One row a source: its drawn blocks, split among the shards by the tree.
    per_source = plan.groupBy("source").agg(F.sum("times").alias("quota")).orderBy(F.col("source").asc_nulls_last()).collect()
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // shard_words))
    quotas = split(np.array([r["quota"] for r in per_source], np.int64), shards, np.random.default_rng(seed)) if per_source else []
    bounds = docs.sparkSession.createDataFrame(
        [(r["source"], np.cumsum(quotas[:, i]).tolist()) for i, r in enumerate(per_source)], "source string, bounds array<long>")
    each = plan.select("source", "block", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    permuted = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block", "copy"), "block", "copy")
    ranked = each.withColumn("rank", F.row_number().over(permuted))
    shard = F.size(F.filter("bounds", lambda b: b < F.col("rank")))
    placed = ranked.alias("r").join(bounds.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))).select(
        "r.source", "block", "copy", shard.alias("shard"))
    return rows, placed.alias("s").join(wanted.alias("w"), same).select(
        "s.source", "block", "copy", "shard", "source_size", "target")


def taken(docs: DataFrame, **options) -> DataFrame:
    """`(doc_id, size, source_size, target, taken, shards)` for every row; shards lists where its copies go."""
    rows, draws = drawn(docs, **options)
    per_block = draws.groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    ends = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(ends, options.get("weights", WEIGHTS), options.get("cap", 3))
    same = F.col("d.source").eqNullSafe(F.col("b.source"))
    met = rows.alias("d").join(per_block.alias("b"), same & (F.col("d.block") == F.col("b.block")), "left").select(
        "doc_id", "size", F.col("d.source").alias("source"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    return met.alias("d").join(wanted.alias("b"), same).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix holds, one row for each copy, with their columns, `_shard`, `_copy` and `_order`; columns so called are replaced.

    Rows come shard after shard, shuffled inside by `_order`, a seeded hash. A range of (shard, hash) is a task's share, so
    a large shard is spread; files that are read again have no order of their own, but the two columns restore it.
    """
    seed = options.get("seed", 7)
    docs = docs.drop("_shard", "_copy", "_order")
    _, draws = drawn(docs, **options)
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(BLOCKS)).cast("int")
    # The documents' columns travel as one, so none of them can be taken for one of the draws'.
    whole = docs.select(F.col("source").cast("string").alias("d_source"), block.alias("d_block"), F.struct(*docs.columns).alias("doc"))
    copies = draws.select(F.col("source").alias("c_source"), F.col("block").alias("c_block"), F.col("copy").alias("c_copy"), F.col("shard").alias("c_shard"))
    out = whole.join(copies, F.col("d_source").eqNullSafe(F.col("c_source")) & (F.col("d_block") == F.col("c_block")))
    shuffled = F.xxhash64(F.lit(seed + 3), "c_shard", "doc.doc_id", "c_copy", "doc.text")
    return out.select("doc.*", F.col("c_shard").alias("_shard"), F.col("c_copy").alias("_copy"), shuffled.alias("_order")).orderBy("_shard", "_order")
