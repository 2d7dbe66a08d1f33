"""Documents to chunks. Everything but the recursive splitter stays on the JVM and within the row:
pieces are numbered by their position in one array per document, so no window or shuffle is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import ChunkSettings
from gleanery.functions.generate import bound, inlined
from gleanery.functions.hashing import chunk_id
from gleanery.functions.page_arrays import repeats
from gleanery.functions.splitter import Splitter, split_pieces
from gleanery.functions.tokens import words
from gleanery.operators.structure import is_blank

CHUNK_FIELDS = (
    "chunk_id", "seq", "text", "token_count", "source_url", "title", "section_heading", "section_path",
    "section_level", "chunk_index", "chunk_type", "table_index", "content_hash",
)

_CHUNK_TYPE = (
    "struct<text:string,token_count:int,section_heading:string,section_path:string,section_level:int,"
    "chunk_index:int,chunk_type:string,table_index:int>"
)


def _chunk(text, tokens, kind, heading=None, path=None, level=None, index=None, table=None) -> Column:
    none = F.lit(None)
    return F.struct(
        text.alias("text"),
        tokens.alias("token_count"),
        (none if heading is None else heading).alias("section_heading"),
        (none if path is None else path).alias("section_path"),
        (none if level is None else level).alias("section_level"),
        (none if index is None else index).alias("chunk_index"),
        F.lit(kind).alias("chunk_type"),
        (none if table is None else table).alias("table_index"),
    ).cast(_CHUNK_TYPE)


def _prefixed(sections: Column, title: Column, with_context: bool) -> Column:
    """Section texts to split; null for blank sections. The context prefix is part of the text that
    is split, so only the first piece of a long section carries it."""

    def text(s: Column) -> Column:
        body = s["content"]
        if with_context:
            body = F.concat(F.lit("["), title, F.lit("] ["), s["path"], F.lit("]\n\n"), s["content"])
        return F.when(~is_blank(s["content"]), body)

    return F.transform(sections, text)


def uncovered_plain_text(sections: Column, plain_text: Column) -> Column:
    """The plain text when there are no sections, or when it is over 1.3 times as long as theirs."""
    covered = F.array_join(
        F.transform(F.filter(sections, lambda s: s["content"] != ""), lambda s: s["content"]), " "
    )
    more = F.length(plain_text) > F.length(covered) * F.lit(1.3)
    return F.when((F.size(sections) == 0) | ((plain_text != "") & more), plain_text)


def chunk_documents(
    docs: DataFrame, settings: ChunkSettings = ChunkSettings(), counter=None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """docs(url, title, plain_text, sections, tables_markdown, content_hash) plus a `chunks` array.

    Order within a document: section pieces, uncovered plain text, then tables that are long enough;
    the position in that order is the running number that goes into the chunk id.
    """
    splitter = Splitter(settings, counter)
    split = docs.withColumn(
        "_pieces",
        split_pieces(
            _prefixed(F.col("sections"), F.col("title"), settings.include_section_context),
            uncovered_plain_text(F.col("sections"), F.col("plain_text")),
            F.col("tables_markdown"),
            splitter,
        ),
    )
    title = F.col("title")
    in_sections = F.flatten(
        F.transform(
            "sections",
            lambda s, i: F.transform(
                F.get(F.col("_pieces.sections"), i),
                lambda p, j: _chunk(p["text"], p["tokens"], "section", s["heading"], s["path"], s["level"], j),
            ),
        )
    )
    in_plain = F.transform(
        "_pieces.plain",
        lambda p, j: _chunk(F.concat(F.lit("["), title, F.lit("]\n\n"), p["text"]), p["tokens"], "plain", index=j),
    )
    in_tables = F.filter(
        F.transform(
            "tables_markdown",
            lambda t, i: _chunk(
                F.concat(F.lit("[Table from "), title, F.lit("]\n\n"), t), F.get(F.col("_pieces.tables"), i), "table", table=i
            ),
        ),
        lambda c: c["token_count"] >= settings.min_chunk_size,
    )
    ordered = split.withColumn("_chunks", F.concat(in_sections, in_plain, in_tables))

    def identified(c: Column, i: Column) -> Column:
        section = (
            F.when(c["chunk_type"] == "section", c["section_heading"])
            .when(c["chunk_type"] == "table", F.concat(F.lit("table-"), c["table_index"].cast("string")))
            .otherwise(F.lit("plain"))
        )
        return F.struct(
            chunk_id(F.col("url"), section, i).alias("chunk_id"), i.alias("seq"),
            *[c[f].alias(f) for f in ("text", "token_count")],
            F.col("url").alias("source_url"), title.alias("title"),
            *[c[f].alias(f) for f in ("section_heading", "section_path", "section_level", "chunk_index", "chunk_type", "table_index")],
            F.col("content_hash").alias("content_hash"),
        )

    named = ordered.withColumn("_named", F.transform("_chunks", identified))
    return named.withColumn("chunks", repaired_ids(F.col("_named"))).drop("_pieces", "_chunks", "_named")


def repaired_ids(chunks: Column) -> Column:
    """Later chunks of a document that repeat an id get a text digest appended to it."""

    def repaired(c: Column, again: Column) -> Column:
        digest = F.substring(F.md5(c["text"].cast("binary")), 1, 8)
        return c.withField("chunk_id", F.when(again, F.concat(c["chunk_id"], digest)).otherwise(c["chunk_id"]))

    return F.zip_with(chunks, repeats(F.transform(chunks, lambda c: c["chunk_id"])), repaired)


def exploded_chunks(docs_with_chunks: DataFrame) -> DataFrame:
    return inlined(docs_with_chunks, "chunks", "chunk_id")


def repair_chunk_ids(rows: DataFrame, order: str, id_col: str = "chunk_id", text: str = "text") -> DataFrame:
    """The same repair for chunk rows that are not grouped by document.

    The first position of every id is a map-side aggregate; joining it back moves one small row per
    id, and an id that holds a large share of the rows is split by the adaptive skew join instead of
    being sorted in one window partition.
    """
    first = rows.groupBy(id_col).agg(F.min(order).alias("_first"))
    joined = rows.join(first, id_col)
    suffix = F.substring(F.md5(F.col(text).cast("binary")), 1, 8)
    fixed = F.when(F.col(order) == F.col("_first"), F.col(id_col)).otherwise(F.concat(F.col(id_col), suffix))
    return joined.withColumn(id_col, fixed).drop("_first")


def word_windows(text: Column, settings: ChunkSettings = ChunkSettings()) -> Column:
    """Hard split as an expression: sliding word windows, short ones dropped; array<struct<start, text>>."""
    size, step = settings.chunk_size * 3 // 4, (settings.chunk_size - settings.chunk_overlap) * 3 // 4
    min_words = -(-settings.min_chunk_size * 3 // 4)

    def windows(pieces: Column) -> Column:
        starts = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(step)))
        cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(pieces, i + 1, F.lit(size)).alias("words")))
        return F.transform(
            F.filter(cut, lambda w: F.size(w["words"]) >= min_words),
            lambda w: F.struct(w["start"].alias("start"), F.array_join(w["words"], " ").alias("text")),
        )

    return bound(words(text), windows)


def with_overlap(pieces: Column, settings: ChunkSettings = ChunkSettings()) -> Column:
    """array<string> -> array<string>: each piece but the first starts with the last words of the
    piece before it, as it was before overlap."""
    keep = settings.chunk_overlap * 3 // 4

    def tail(piece: Column) -> Column:
        return bound(
            words(piece),
            lambda cut: F.array_join(F.slice(cut, F.greatest(F.size(cut) - keep, F.lit(0)) + 1, F.lit(keep)), " "),
        )

    def joined(held: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(None).cast("string")), held), F.lit(1), F.size(held))
        return F.zip_with(held, before, lambda p, b: F.when(b.isNull(), p).otherwise(F.concat(tail(b), F.lit(" "), p)))

    return bound(pieces, joined)
