"""Steps that may use a text generator: building trees, choosing nodes, writing answers.

A generator is any picklable callable `complete(prompt, system=None, max_tokens=...) -> str`. It runs
on the executors for corpora and on the driver for the one answer. Without one, or where it fails,
the keyword rules of `heading_tree` and the context-only answer apply.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.config import TreeSettings
from gleanery.functions.generate import exploded
from gleanery.operators import heading_tree
from gleanery.session import cut_lineage

Complete = Callable[..., str]

ANSWER_RULES = (
    "You are given numbered extracts from a document collection. Write a short answer that they support, and put the number of "
    "the extract behind each statement as [Source N]. If they leave the question open, state what is missing."
)


def json_reply(reply: str):
    """The first JSON object or array of a reply; text and code fences around it do not matter."""
    start = min((at for at in (reply.find("{"), reply.find("[")) if at >= 0), default=0)
    return json.JSONDecoder().raw_decode(reply, start)[0]


def outline_prompt(page: dict) -> str:
    sections = "\n".join(
        f"{'  ' * (s['level'] - 1)}- [H{s['level']}] {s['heading']}: {s['content']}" for s in page["sections"]
    )
    chunks = "\n".join(f"  - {c['chunk_id']} ({c['section_heading'] or 'general'}, {c['token_count']} tokens)" for c in page["chunks"])
    return (
        f"Write a table of contents for this page as one JSON object "
        '{"summary": text, "nodes": [{"node_id": "0001", "name": text, "summary": text, "level": 1, '
        '"chunk_ids": [ids], "nodes": [...]}]}. Number the nodes in order, nest them like the headings, '
        "summarise each by what it answers, and give every chunk to at least one node. Reply with JSON only.\n\n"
        f"Title: {page['title']}\nURL: {page['url']}\nDescription: {page['description']}\n\n"
        f"Sections:\n{sections}\n\nChunks:\n{chunks}\n"
    )


def generated_trees(docs: DataFrame, complete: Complete, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Trees written by the generator, one prompt per page; the heading rules where a reply is unusable."""
    ruled = heading_tree.tree_nodes(docs, settings).select("url", F.struct("summary", "nodes").alias("ruled"))
    brief = F.transform(
        "sections",
        lambda s: F.struct(s["heading"].alias("heading"), s["level"].alias("level"), F.substring(s["content"], 1, 300).alias("content")),
    )
    chunk = F.transform(
        "chunks", lambda c: F.struct(*[c[f].alias(f) for f in ("chunk_id", "section_heading", "token_count")])
    )
    asked = docs.select("url", "title", "description", brief.alias("sections"), chunk.alias("chunks")).join(ruled, "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                try:
                    reply = json_reply(complete(outline_prompt(page), None, settings.max_tokens))
                    tree = heading_tree._flatten_tree(
                        {"url": page["url"], "title": page["title"], "summary": reply.get("summary", page["description"]), "nodes": reply.get("nodes", [])}
                    )
                except Exception:  # whatever a generator or its reply does wrong, the rules still apply
                    tree = {"url": page["url"], "title": page["title"], **page["ruled"]}
                yield pa.RecordBatch.from_struct_array(pa.array([tree], heading_tree._ARROW_TREE))

    return asked.mapInArrow(run, f"url string, title string, summary string, nodes array<{heading_tree.NODE_TYPE}>")


def selection_prompt(question: str, outlines: list[str]) -> str:
    return (
        "Below are tables of contents. Choose the sections that would answer the question, best first, with a "
        'parent where its children matter. Reply with JSON only: [{"url": text, "node_ids": [ids]}].\n\n'
        + "\n\n".join(outlines)
        + f"\n\nQuestion: {question}\n"
    )


def chosen_chunks(
    trees: DataFrame, question: str, complete: Complete, max_chunks: int, settings: TreeSettings = TreeSettings()
) -> DataFrame:
    """chunk_id, url, rank as chosen by the generator.

    A prompt holds at most `trees_per_prompt` outlines. Trees of which something was chosen go into another round, until one prompt
    holds them all or a round leaves out none; then choices rank by their place in the reply, and by url between replies. Trees of
    a failed prompt are ranked by the keyword rules, after the chosen ones.
    """
    size = settings.trees_per_prompt
    outlines = trees.select("url", heading_tree.table_of_contents().alias("outline"))
    def ask(held: list[dict]) -> list[dict]:
        first = held[0]["url"]
        try:
            reply = json_reply(complete(selection_prompt(question, [h["outline"] for h in held]), None, 1024))
            return [
                {"batch": first, "at": i, "url": choice.get("url", ""), "node_id": str(node), "ordinal": j}
                for i, choice in enumerate(reply)
                for j, node in enumerate(choice.get("node_ids", []))
            ]
        except Exception:  # a failed prompt is marked by null node ids
            return [{"batch": first, "at": 0, "url": h["url"], "node_id": None, "ordinal": 0} for h in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("batch", pa.string()), ("at", pa.int32()), ("url", pa.string()), ("node_id", pa.string()), ("ordinal", pa.int32())]
        )
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= size:
                yield pa.RecordBatch.from_pylist(ask(held[:size]), schema=schema)
                held = held[size:]
        if held:
            yield pa.RecordBatch.from_pylist(ask(held), schema=schema)

    n_left, failures = outlines.count(), []
    while True:
        prompts = -(-max(n_left, 1) // size)
        # The hash of the url decides who shares a prompt, so reruns ask the same.
        placed = outlines.repartition(prompts, "url").sortWithinPartitions("url")
        chosen = cut_lineage(placed.mapInArrow(run, "batch string, at int, url string, node_id string, ordinal int"))
        failures.append(chosen.where("node_id IS NULL").select("url"))
        named = chosen.where("node_id IS NOT NULL").select("url").distinct()
        outlines = cut_lineage(outlines.join(named, "url", "left_semi"))
        n_before, n_left = n_left, outlines.count()
        if prompts == 1 or n_left in (0, n_before):
            break
    picked = chosen.where("node_id IS NOT NULL").join(trees.select("url", "nodes"), "url")
    turn = F.struct(F.lit(0).alias("kind"), "at", "batch", "ordinal").alias("turn")
    below = heading_tree.subtree_chunk_ids(F.col("nodes"), F.col("node_id"))
    chunks = exploded(picked, below, "chunk_id", ("url", turn), "pos")
    failed = reduce(DataFrame.unionByName, failures).distinct()
    ruled = heading_tree.relevant_chunks(trees.join(failed, "url", "left_semi"), question, max_chunks)
    ruled = ruled.select(
        "url",
        F.struct(F.lit(1).alias("kind"), F.col("rank").alias("at"), F.lit("").alias("batch"), F.lit(0).alias("ordinal")).alias("turn"),
        F.lit(0).alias("pos"),
        "chunk_id",
    )
    place = F.min(F.struct("turn", "pos", "url")).alias("place")
    top = chunks.unionByName(ruled).groupBy("chunk_id").agg(place).orderBy("place", "chunk_id").limit(max_chunks)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place", "chunk_id"))
    return top.select("chunk_id", F.col("place.url").alias("url"), rank.alias("rank"))


def generated_answer(question: str, context: str, complete: Complete) -> str | None:
    """The generator's answer, or None when it fails."""
    try:
        return complete(f"Sources:\n{context}\n\nQuestion: {question}\n", ANSWER_RULES, 2048)
    except Exception:
        return None
