"""Chat formatting with collapse of cumulative snapshots.

Loggers that store a conversation after every turn leave many conversations that are prefixes
of longer ones. A rolling hash names every turn prefix; a conversation whose full hash is a
proper prefix of another is dropped by an anti-join, equal conversations collapse to the
smallest id, and the maximal ones are rendered.

The rolling hash of the first k turns is the sum over their digests, each salted with the
turn's place, in four lanes of 32 bits of md5: a running sum in a window, not a gathered list.

Defined results: turns are ordered by (turn, role, text), NULL first. NULL role reads `unknown`,
NULL text is empty. Rows without conv_id form one conversation whose conv_id is NULL; it is kept
unless it prefixes or equals one with an id. A repeated row is a repeated turn. No rows give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANES = ["h0", "h1", "h2", "h3"]


def turns(conversations: DataFrame) -> DataFrame:
    """`(conv_id, k, role, text, h0..h3)`: the k-th turn and the hash of the prefix that ends with it."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    ordered = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    placed = rows.withColumn("k", F.row_number().over(ordered))
    digest = F.md5(F.concat_ws("\x1f", F.col("k").cast("string"), F.length("role").cast("string"), "role", "text"))
    lanes = {h: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i, h in enumerate(LANES)}
    running = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    salted = placed.withColumns(lanes)
    return salted.withColumns({h: F.sum(h).over(running) for h in LANES}).select("conv_id", "k", "role", "text", *LANES)


def maximal(conversations: DataFrame) -> DataFrame:
    """`(conv_id, n_turns, n_copies)` of the conversations that no longer one begins with, copies collapsed."""
    prefixes = turns(conversations).select("conv_id", "k", *LANES)
    size = W.partitionBy("conv_id")
    marked = prefixes.withColumn("n", F.max("k").over(size))
    full = marked.where("k = n").groupBy("n", *LANES).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = marked.where("k < n").select(F.col("k").alias("n"), *LANES).distinct()
    return full.join(proper, ["n", *LANES], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """`(conv_id, n_turns, n_copies, text)`: maximal conversations, each turn as `start role newline text end newline`."""
    keep = maximal(conversations)
    lines = turns(conversations).select("conv_id", "k", F.concat(
        F.lit(start), "role", F.lit("\n"), "text", F.lit(f"{end}\n")).alias("line"))
    kept = lines.join(keep.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    chats = kept.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", "line"))), lambda t: t["line"]), "").alias("text"))
    return keep.alias("a").join(chats.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select(
        "a.conv_id", "n_turns", "n_copies", "text")


SQL = """
with turned as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from conversations),
lines as (
  select conv_id, k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line,
         length(role) || chr(31) || role || chr(31) || length(text) || chr(31) || text as exact from turned),
prefixes as (
  select conv_id, k, string_agg(exact, chr(30)) over (partition by conv_id order by k) as said,
         max(k) over (partition by conv_id) as n from lines),
whole as (
  select said, n, min(conv_id) as conv_id, count(*) as n_copies from prefixes where k = n group by all),
keep as (
  select * from whole where not exists (select 1 from prefixes p where p.k < p.n and p.k = whole.n and p.said = whole.said)),
chats as (select conv_id, string_agg(line, '' order by k) as text from lines group by conv_id)
select keep.conv_id, keep.n as n_turns, keep.n_copies, chats.text
from keep join chats on keep.conv_id is not distinct from chats.conv_id
"""
