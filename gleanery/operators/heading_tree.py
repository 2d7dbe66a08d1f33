"""Heading trees: one array of nodes per page, in document order, with each node's ancestors.

Pre-order is document order, so a subtree is the nodes that name the root among their ancestors and
no recursion is needed anywhere but in the nested JSON form.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import TreeSettings
from gleanery.functions.batches import in_slices, slices
from gleanery.functions.generate import bound, exploded, inlined
from gleanery.functions.page_arrays import ids_by_name
from gleanery.functions.tokens import words

NODE_TYPE = (
    "struct<node_id:string,pos:int,parent_pos:int,ancestors:array<int>,name:string,summary:string,"
    "content_preview:string,level:int,chunk_ids:array<string>>"
)
UNTITLED = "__plain__"


def node_id(number: Column) -> Column:
    return F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))


def tree_nodes(docs: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """docs(url, title, description, sections, chunks) -> url, title, summary, nodes.

    Every node takes the chunks whose section has exactly its heading. Chunks of no heading go to the
    first node, or to a node of their own when the page has no headings.
    """
    heading = lambda c: F.coalesce(c["section_heading"], F.lit(UNTITLED))
    names, headings = F.transform("sections", lambda s: s["heading"]), F.transform("chunks", heading)
    own_ids = ids_by_name(names, headings, F.transform("chunks", lambda c: c["chunk_id"]))
    # Headings that are no section's: few, as chunks are cut from sections.
    left_over = bound(
        F.array_except(headings, names),
        lambda others: F.transform(F.filter("chunks", lambda c: F.array_contains(others, heading(c))), lambda c: c["chunk_id"]),
    )

    def node(left_over: Column, pair: Column, i: Column) -> Column:
        s, own = pair["section"], pair["own"]
        preview = F.substring(s["content"], 1, settings.preview_chars)
        return F.struct(
            node_id(i + 1).alias("node_id"),
            s["pos"].alias("pos"),
            s["parent_pos"].alias("parent_pos"),
            s["ancestors"].alias("ancestors"),
            s["heading"].alias("name"),
            F.when(s["content"] != "", preview).otherwise(s["heading"]).alias("summary"),
            preview.alias("content_preview"),
            s["level"].alias("level"),
            F.when(i == 0, F.concat(own, left_over)).otherwise(own).alias("chunk_ids"),
        ).cast(NODE_TYPE)

    general = F.struct(
        F.lit("0001").alias("node_id"),
        F.lit(0).alias("pos"),
        F.lit(None).cast("int").alias("parent_pos"),
        F.array().cast("array<int>").alias("ancestors"),
        F.lit("General Content").alias("name"),
        F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")).alias("summary"),
        F.lit("").alias("content_preview"),
        F.lit(0).alias("level"),
        F.col("_left_over").alias("chunk_ids"),
    ).cast(NODE_TYPE)
    paired = F.zip_with("sections", own_ids, lambda s, own: F.struct(s.alias("section"), own.alias("own")))
    page = F.struct(paired.alias("pairs"), F.col("_left_over").alias("left_over"))
    of_sections = bound(page, lambda p: F.transform(p["pairs"], lambda pair, i: node(p["left_over"], pair, i)))
    nodes = (
        F.when(F.size("sections") > 0, of_sections)
        .when(F.size("_left_over") > 0, F.array(general))
        .otherwise(F.array().cast(f"array<{NODE_TYPE}>"))
    )
    summary = F.when(F.col("description") != "", F.col("description")).otherwise(
        F.concat(F.lit("Content from "), F.col("title"))
    )
    return docs.withColumn("_left_over", left_over).select("url", "title", summary.alias("summary"), nodes.alias("nodes"))


# ---------------------------------------------------------------- navigation


def find_node(nodes: Column, wanted: str) -> Column:
    """First node with this id in document order, or null."""
    return F.get(F.filter(nodes, lambda n: n["node_id"] == wanted), F.lit(0))


def subtree_chunk_ids(nodes: Column, wanted: str | Column | None = None) -> Column:
    """Chunk ids of a node and everything below it, in document order, repeats kept. The whole tree
    without an id; an empty array for an unknown one."""
    if wanted is None:
        return F.flatten(F.transform(nodes, lambda n: n["chunk_ids"]))
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted

    def below(root: Column) -> Column:
        found = F.filter(nodes, lambda n: (n["pos"] == root) | F.array_contains(n["ancestors"], root))
        return F.when(root.isNotNull(), F.flatten(F.transform(found, lambda n: n["chunk_ids"]))).otherwise(F.array().cast("array<string>"))

    return bound(F.get(F.filter(nodes, lambda n: n["node_id"] == wanted), F.lit(0))["pos"], below)


def table_of_contents(indent: int = 0) -> Column:
    """Readable outline of a tree row (url, title, summary, nodes)."""
    lines = F.transform(
        "nodes",
        lambda n: F.concat(
            F.repeat(F.lit("  "), F.size(n["ancestors"]) + indent),
            F.lit("- ["), n["node_id"], F.lit("] "), n["name"], F.lit(": "), n["summary"],
        ),
    )
    head = F.array(
        F.concat(F.lit("Document: "), F.col("title")),
        F.concat(F.lit("URL: "), F.col("url")),
        F.concat(F.lit("Summary: "), F.col("summary")),
        F.lit(""),
    )
    return F.array_join(F.concat(head, lines), "\n")


# ---------------------------------------------------------------- keyword reasoning


def question_terms(question: str) -> list[str]:
    """Distinct lower-case pieces; punctuation stays on them."""
    return sorted(set(question.lower().split()))


def _node_terms(name: Column, summary: Column) -> Column:
    return words(F.lower(F.concat(name, F.lit(" "), summary)))


def score_nodes(nodes: DataFrame, question: str, name: str = "name", summary: str = "summary") -> DataFrame:
    """Nodes that share a term with the question, with `score`, the share of the question's terms
    found in a node's name or summary."""
    terms = question_terms(question)
    if not terms:
        return nodes.where(F.lit(False)).withColumn("score", F.lit(0.0))
    own, asked = _node_terms(F.col(name), F.col(summary)), F.array(*[F.lit(t) for t in terms])
    # The cheap test stops at the first common term; scores are worked out for what is left.
    shared = F.size(F.array_intersect(own, asked)) / F.lit(float(len(terms)))
    return nodes.where(F.arrays_overlap(own, asked)).withColumn("score", shared)


def relevant_chunks(trees: DataFrame, question: str, max_chunks: int = 15) -> DataFrame:
    """chunk_id, url, rank, score: chunks of the best nodes first, then by url and document order.

    A chunk's place is that of its best node, its first one among equals. Nodes of a page sit in
    one row, so they fold to one row per chunk before the exchange and the limit is taken per task.
    """
    nodes = inlined(trees, "nodes", "pos", ("url",))
    hits = exploded(score_nodes(nodes, question), "chunk_ids", "chunk_id", ("url", "pos", "score"), "at")
    place = F.struct((-F.col("score")).alias("loss"), "url", "pos", "at")
    best = hits.groupBy("chunk_id").agg(F.min(place).alias("place"))
    top = best.orderBy("place", "chunk_id").limit(max_chunks)
    ranked = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place", "chunk_id"))
    return top.select("chunk_id", F.col("place.url").alias("url"), ranked.alias("rank"), (-F.col("place.loss")).alias("score"))


def unassigned_chunks(chunks: DataFrame, trees: DataFrame) -> DataFrame:
    """Chunks no tree node refers to."""
    linked = exploded(trees, subtree_chunk_ids(F.col("nodes")), "chunk_id").distinct()
    return chunks.join(linked, "chunk_id", "left_anti")


# ---------------------------------------------------------------- nested JSON


def _flatten_tree(tree: dict) -> dict:
    rows: list[dict] = []
    waiting = [(n, None, []) for n in reversed(tree.get("nodes", []))]
    while waiting:
        node, parent, ancestors = waiting.pop()
        pos = len(rows)
        rows.append(
            {
                "node_id": node["node_id"], "pos": pos, "parent_pos": parent, "ancestors": ancestors,
                "name": node["name"], "summary": node["summary"],
                "content_preview": node.get("content_preview", ""), "level": node.get("level", 0),
                "chunk_ids": node.get("chunk_ids", []),
            }
        )
        waiting.extend((c, pos, ancestors + [pos]) for c in reversed(node.get("nodes", [])))
    return {"url": tree["url"], "title": tree["title"], "summary": tree["summary"], "nodes": rows}


def _nest_tree(tree: dict) -> dict:
    made: list[dict] = []
    roots: list[dict] = []
    for row in tree["nodes"]:
        node = {k: row[k] for k in ("node_id", "name", "summary", "content_preview", "level", "chunk_ids")}
        node["nodes"] = []
        made.append(node)
        (roots if row["parent_pos"] is None else made[row["parent_pos"]]["nodes"]).append(node)
    return {"url": tree["url"], "title": tree["title"], "summary": tree["summary"], "nodes": roots}


TREE_TYPE = f"struct<url:string,title:string,summary:string,nodes:array<{NODE_TYPE}>>"
_ARROW_NODE = pa.struct(
    [
        ("node_id", pa.string()), ("pos", pa.int32()), ("parent_pos", pa.int32()), ("ancestors", pa.list_(pa.int32())),
        ("name", pa.string()), ("summary", pa.string()), ("content_preview", pa.string()), ("level", pa.int32()),
        ("chunk_ids", pa.list_(pa.string())),
    ]
)
_ARROW_TREE = pa.struct(
    [("url", pa.string()), ("title", pa.string()), ("summary", pa.string()), ("nodes", pa.list_(_ARROW_NODE))]
)


def flatten_trees(text: DataFrame, column: str = "value") -> DataFrame:
    """Nested tree JSON, one tree per row -> url, title, summary, nodes."""

    def some(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _flatten_tree(json.loads(v)) for v in values.to_pylist()], _ARROW_TREE)

    @F.arrow_udf(TREE_TYPE)
    def flat(values: pa.Array) -> pa.Array:
        return in_slices(some, _ARROW_TREE, values)

    return text.select(flat.asNondeterministic()(F.col(column)).alias("tree")).select("tree.*")


def nested_json(trees: DataFrame) -> DataFrame:
    """url and the nested JSON text of every tree."""

    def nested(batches):
        for batch in batches:
            for cut in slices(batch.num_rows, batch.nbytes):
                part = batch.slice(*cut)
                texts = [json.dumps(_nest_tree(t), ensure_ascii=False, indent=2) for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["url", "value"])

    return trees.select("url", "title", "summary", "nodes").mapInArrow(nested, "url string, value string")
