"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import scratch, stabilise


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for every node of `edges(u long, v long)`; a component is named by its smallest node.

    Neighbourhoods are never gathered: each step joins the edges with the smallest neighbour of
    every node, so a node with very many links spreads over tasks. Both halves of a round are written to the
    shared checkpoint folder, which cuts the lineage, and only the last stays; the number of rounds grows with the
    logarithm of the longest chain. Self-links and repeated links do no harm; rows with a null
    end are ignored, and no edges give no rows.
    """
    with scratch(edges.sparkSession) as keep:
        now = stabilise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(0).alias("_"))
                        .where("u is not null and v is not null and u <> v").distinct().drop("_"))
        seen = None
        while (mark := now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != seen and mark[0]:
            seen, now = mark, _round(now)
        keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _round(now: DataFrame) -> DataFrame:
    """A large and a small star over stored links `(u, v)`, u > v."""
    both = now.union(now.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = stabilise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
    # After a large star the smallest neighbour of v may be v's own end of a shorter chain: link both to the least.
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return stabilise(large.join(least, "u").select(ends).where("u <> v").distinct())
