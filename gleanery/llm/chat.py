"""Chat formatting after collapsing cumulative snapshots of conversations.

Logs often hold the same conversation several times, each snapshot a prefix of the next. Every turn prefix of every conversation
gets a rolling hash: the running sum of 120-bit hashes of (position, role, text). A conversation whose full hash is a proper
prefix of another is dropped by an anti-join; of equal conversations the smallest conv_id stays. What remains is rendered.

Scale: positions and running sums are made in two levels, within segments of `SEGMENT` turns and over the segments, so one
conversation may hold a third of all rows. Prefixes and full hashes are grouped before they are joined, so a first turn that all
share is one key. Rendered text comes in parts of at most `SEGMENT` turns; shorter conversations are one part.

Defined results: turns are ordered by turn (null last), then role and text; gaps and repeated numbers don't matter. Null role and
text render as empty. Rows without conv_id are one conversation of their own, the largest. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleanery.llm.staging import staged

SEGMENT = 256
_LAST = (1 << 63) - 1
LANES = ("a", "b", "c")


def _before(order_by: str) -> Window:
    return Window.partitionBy("conv").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)


def positioned(turns: DataFrame) -> DataFrame:
    """conv, position (from 1), role, text."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_LAST)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(_LAST)))
    counts = rows.groupBy("conv", "segment").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("conv", "segment", F.coalesce(F.sum("n").over(_before("segment")), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("conv", "segment").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    ranked = rows.withColumn("rank", F.row_number().over(inner)).join(offsets, ["conv", "segment"])
    return ranked.select("conv", (F.col("rank") + F.col("offset")).cast("long").alias("position"), "role", "text")


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """conv, position, and the lanes a, b, c of the hash of the turns up to the position."""
    turn = F.md5(F.concat_ws("\x00", F.col("position").cast("string"), "role", "text"))
    lane = {x: F.conv(F.substring(turn, 1 + 10 * i, 10), 16, 10).cast("long") for i, x in enumerate(LANES)}
    items = rows.select("conv", "position", *[lane[x].alias(x) for x in LANES])
    items = items.withColumn("segment", F.floor((F.col("position") - 1) / SEGMENT))
    sums = items.groupBy("conv", "segment").agg(*[F.sum(x).alias(x) for x in LANES])
    starts = sums.select(
        "conv", "segment", *[F.coalesce(F.sum(x).over(_before("segment")), F.lit(0)).alias(f"{x}0") for x in LANES]
    )
    inner = Window.partitionBy("conv", "segment").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = items.select("conv", "segment", "position", *[F.sum(x).over(inner).alias(x) for x in LANES])
    joined = running.join(starts, ["conv", "segment"])
    return joined.select("conv", "position", *[(F.col(x) + F.col(f"{x}0")).alias(x) for x in LANES])


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv of the conversations that are no proper prefix of another, one of equal ones."""
    lengths = prefixes.groupBy("conv").agg(F.max("position").alias("n"))
    marked = staged(prefixes.join(lengths, "conv"), "prefixes")
    key = ["position", *LANES]
    full = marked.where("position = n").groupBy(*key).agg(F.min("conv").alias("conv"))
    proper = marked.where("position < n").select(*key).distinct()
    return full.join(proper, key, "left_anti").select("conv")


def message(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns and the rendered text of every maximal conversation."""
    rows = staged(positioned(turns), "turns")
    kept = staged(maximal(prefix_hashes(rows)), "maximal")
    rows = rows.join(kept, "conv", "left_semi")
    part = F.floor((F.col("position") - 1) / SEGMENT).cast("int")
    rows = rows.select("conv", part.alias("part"), F.struct("position", message(F.col("role"), F.col("text")).alias("m")).alias("t"))
    parts = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return parts.select(
        F.nullif("conv", F.lit(_LAST)).alias("conv_id"),
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["m"]), "").alias("rendered"),
    )
