"""Connected components of a graph of links, as tables.

Links are contracted round by round: of every two linked labels the larger one hooks on to the smallest it is linked with, chains
of hooks are shortened to their ends, and links within one label disappear. Stars, the usual input, are done in two or three
rounds. A label that many links share makes a hot join key, which adaptive execution splits; its links combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of `links` (columns a, b). Loops are allowed."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    labels = ends.withColumn("label", F.col("node"))
    left = staged(_contracted(links), "links")
    while not left.isEmpty():
        hooks = staged(left.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        hooks = _shortened(hooks)
        labels = staged(_moved(labels, hooks, "label"), "labels")
        moved = _moved(_moved(left, hooks, "low"), hooks, "high")
        left = staged(_contracted(moved.select(F.col("low").alias("a"), F.col("high").alias("b"))), "links")
    return labels


def _contracted(links: DataFrame) -> DataFrame:
    ordered = links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    return ordered.distinct()


def _moved(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    to = hooks.select(F.col("high").alias(column), F.col("low").alias("to_"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("to_", column)).drop("to_")


def _shortened(hooks: DataFrame) -> DataFrame:
    """Every hook leads to the end of its chain; hooks lead downwards, so there is one."""
    while True:
        step = hooks.select(F.col("high").alias("low"), F.col("low").alias("end"))
        jumped = staged(hooks.join(step, "low", "left"), "jumps")
        hooks = jumped.select("high", F.coalesce("end", "low").alias("low"))
        if jumped.where("end is not null").isEmpty():
            return hooks
