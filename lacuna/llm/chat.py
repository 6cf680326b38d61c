"""Chat formatting with cumulative-snapshot collapse.

A chat service logs a conversation again after each turn, so that a log holds many prefixes of one
conversation. Each turn is hashed with its place; the sums of the hashes up to a turn are the rolling
hashes of the conversation's prefixes (four sums of 32-bit parts, 128 bits of hash in all). An
anti-join drops each conversation whose whole hash is that of a proper prefix of another; of equal
conversations the least id stays. Only what stays is rendered.

Places and sums are made in two levels, turns within blocks of BLOCK turn numbers and blocks within a
conversation, so that no window holds one conversation's turns all at once unless they share a block.
Shuffled are hashes first; the texts only of what stays.

DataFrame functions only. Null roles read `unknown`, null texts are empty; turns with a null number
come first; equal turn numbers go by role and a hash of the text. Turns without a conv_id are dropped. Repeated rows
are turns of their own. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SUMS = ["s0", "s1", "s2", "s3"]


def _turns(turns: DataFrame) -> DataFrame:
    return turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv_id"), F.coalesce(turns["turn"].cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("unknown")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (place, from 1), total (turns of the conversation) and the rolling sums of every turn."""
    t = _turns(turns).withColumn("block", F.floor(F.col("turn") / BLOCK))
    t = t.select("conv_id", "block", "turn", "role", F.xxhash64("role", "text").alias("x"), F.xxhash64("text", "role", F.lit(1)).alias("y"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "x", "y")
    t = t.withColumn("k", F.row_number().over(inside))
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("total", F.sum("size").over(Window.partitionBy("conv_id")))
    t = t.join(sizes, ["conv_id", "block"]).withColumn("n", F.col("ahead") + F.col("k"))
    a, b = F.xxhash64("n", "x"), F.xxhash64("n", "y", F.lit(2))
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    t = t.select("conv_id", "block", "k", "n", "total", low(a).alias("h0"), low(F.shiftrightunsigned(a, 32)).alias("h1"), low(b).alias("h2"), low(F.shiftrightunsigned(b, 32)).alias("h3"))
    rolling = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("conv_id", "block").agg(*[F.sum(f"h{i}").alias(f"b{i}") for i in range(4)])
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(4)])
    t = t.select("conv_id", "block", "n", "total", *[F.sum(f"h{i}").over(rolling).alias(f"r{i}") for i in range(4)])
    return t.join(sums, ["conv_id", "block"]).select("conv_id", "n", "total", *[(F.col(f"r{i}") + F.col(f"b{i}")).alias(f"s{i}") for i in range(4)])


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of each conversation that is no prefix of another."""
    p = prefixes(turns)
    whole = p.where("n = total").groupBy("n", *SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = p.where("n < total").select("n", *SUMS).distinct()
    return whole.join(proper, ["n", *SUMS], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of each conversation that stays."""
    kept = collapse(turns)
    line = F.format_string("<|%s|>\n%s<|end|>\n", "role", "text")
    own = _turns(turns).join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.xxhash64("role", "text").alias("x"), F.xxhash64("text", "role", F.lit(1)).alias("y"), line.alias("line")))).alias("turns"))
    return own.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("text"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) ORDER BY turn, role, text) AS lines FROM t GROUP BY conv_id),
g AS (SELECT min(conv_id) AS conv_id, lines, len(lines) AS n, count(*) AS n_copies FROM c GROUP BY lines),
p AS (SELECT DISTINCT lines[1:i] AS lines FROM (SELECT lines, unnest(range(1, len(lines))) AS i FROM c))
SELECT g.conv_id, CAST(g.n AS BIGINT) AS n_turns, CAST(g.n_copies AS BIGINT) AS n_copies, array_to_string(g.lines, '') AS text FROM g WHERE g.lines NOT IN (SELECT lines FROM p)
"""
