"""Repeated passages of several lines, by content-defined chunks of lines. DataFrame functions only.

A line ends a chunk where a rolling hash over the hashes of the last two lines is 0 modulo `MEAN_LINES`, so equal passages get
equal boundaries wherever they stand. Chunks of at least two lines that are not blank are grouped by their bytes; of a group
that occurs more than once, the first occurrence in the smallest doc_id stays and the others are removed.

Scale: chunks combine on the map side, so a passage in a third of all documents is one row per task. Hot chunks find their group
by a bounded broadcast, others by a shuffle. The flags of a document's chunks come back as one array, as long as the document's
own list of chunks; texts are shuffled once, to meet their flags. All expressions are linear in the text's length.

Defined results: null text stays null, with 0 lines. Rows without doc_id come last; rows with equal doc_id, or without one, are
ordered by a hash of their text. Rows of equal doc_id and text are one: all keep what the first keeps. Blank chunks and single lines are never removed. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.generate import exploded
from gleanery.llm.staging import join_counted, staged

MEAN_LINES = 3
_LAST = (1 << 63) - 1
#: A chunk's start is marked by \x01\x01; a \x01 of the text becomes \x01\x02 meanwhile.
_MARK, _PLAIN, _ESCAPED = "\x01\x01", "\x01", "\x01\x02"


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; together they are the text. All but the last end with the line end."""
    lines = F.split(F.replace(text, F.lit(_PLAIN), F.lit(_ESCAPED)), "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    none = F.array(F.lit(0).cast("long"))
    # Of the two lines before each line: a line starts a chunk where the line before ended one.
    last = F.slice(F.concat(none, hashes), F.lit(1), F.size(lines))
    second = F.slice(F.concat(none, none, hashes), F.lit(1), F.size(lines))
    starts = F.zip_with(second, last, lambda a, b: ((a * 31 + b) % MEAN_LINES == 0) & (b > 0))
    marked = F.zip_with(lines, starts, lambda x, s: F.when(s, F.concat(F.lit(_MARK), x)).otherwise(x))
    return F.transform(F.split(F.array_join(marked, "\n"), _MARK), lambda c: F.replace(c, F.lit(_ESCAPED), F.lit(_PLAIN)))


def _body(chunk: Column) -> Column:
    """Without the line end that the last chunk of a document lacks."""
    return F.when(F.endswith(chunk, F.lit("\n")), F.left(chunk, F.length(chunk) - 1)).otherwise(chunk)


def _is_passage(body: Column) -> Column:
    return F.contains(body, F.lit("\n")) & F.rlike(body, F.lit(r"[^\x20\x09-\x0D]"))


def chunk_flags(docs: DataFrame) -> DataFrame:
    """doc, text_key, and for each chunk of the document in order whether it is a repeat."""
    doc = F.col("doc_id").cast("long")
    keyed = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(doc, F.lit(_LAST)).alias("doc"), F.col("text").cast("string").alias("text")
    )
    rows = exploded(keyed, chunks_of(F.col("text")), "chunk", ("doc", F.xxhash64("text").alias("text_key")), "pos")
    bodies = rows.select("doc", "text_key", "pos", _body(F.col("chunk")).alias("body"))
    passages = bodies.where(_is_passage(F.col("body")))
    # Grouping by the passage itself compares bytes.
    place = F.struct("doc", "text_key", "pos")
    repeated = passages.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = staged(repeated.select(F.unhex(F.sha2("body", 256)).alias("digest"), "n", "first"), "repeated")
    digest = F.when(_is_passage(F.col("body")), F.unhex(F.sha2("body", 256)))
    chunks = staged(bodies.select("doc", "text_key", "pos", digest.alias("digest")), "chunks")
    total = chunks.count()
    found = join_counted(chunks.where("digest is not null"), repeated, "digest", "n", total)
    gone = found.where(place != F.col("first")).select("doc", "text_key", "pos", F.lit(True).alias("gone"))
    every = chunks.select("doc", "text_key", "pos", F.lit(False).alias("gone")).unionByName(gone)
    per_chunk = every.groupBy("doc", "text_key", "pos").agg(F.max("gone").alias("gone"))
    flags = per_chunk.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(F.struct("pos", "gone"))).alias("flags"))
    return staged(flags.select("doc", "text_key", F.transform("flags", lambda f: f["gone"]).alias("flags")), "flags")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Each row of docs as the struct `row`, with n_lines, n_chunks, n_removed and clean_text."""
    flags = chunk_flags(docs)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(text).alias("text_key"),
    )
    joined = rows.join(flags, ["doc", "text_key"], "left")
    kept = F.filter(
        F.zip_with(chunks_of(F.col("text")), "flags", lambda c, gone: F.when(~gone, c)), lambda c: c.isNotNull()
    )
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "row",
        F.coalesce(lines, F.lit(0)).alias("n_lines"),
        F.coalesce(F.array_size("flags"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.array_size(F.filter("flags", lambda f: f)), F.lit(0)).alias("n_removed"),
        F.array_join(kept, "").alias("clean_text"),
    )
