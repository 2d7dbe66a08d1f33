"""Heading trees as nested JSON files: the exchange format of other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators.heading_tree import flatten_trees, nested_json


def read_trees(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of JSON files with one nested tree each -> url, title, summary, nodes."""
    return flatten_trees(spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True))


def read_tree(spark: SparkSession, folder: str, url: str) -> DataFrame:
    return read_trees(spark, folder).where(f"url = {_quoted(url)}")


def write_trees(trees: DataFrame, folder: str) -> None:
    """url and nested JSON as JSON lines, split over files as the trees are over partitions."""
    nested_json(trees).write.mode("overwrite").json(folder)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
