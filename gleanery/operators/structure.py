"""Pages to structured documents: heading nesting, paths and Markdown, all within the row.

A page's headings arrive as one array, so nesting is a fold over that array: no explode, no
self-join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.generate import bound
from gleanery.functions.html import extracted
from gleanery.functions.tokens import WHITESPACE

SECTION_TYPE = (
    "struct<pos:int,parent_pos:int,ancestors:array<int>,heading:string,level:int,content:string,path:string>"
)
_STACK_TYPE = "struct<pos:int,level:int,heading:string>"


def nested_sections(sections: Column) -> Column:
    """array<struct<heading, level, content>> in document order -> array<SECTION_TYPE>.

    The open headings are kept as a stack of strictly increasing levels; the parent of a heading is
    the nearest earlier one of smaller level, and its path joins the headings from the root down.

    A fold copies what it has gathered at each step, so it runs in two levels: over blocks of about
    the square root of the headings, and within each block, with the stack handed from block to block.
    """
    no_rows, no_open = F.array().cast(f"array<{SECTION_TYPE}>"), F.array().cast(f"array<{_STACK_TYPE}>")

    def step(state: Column, section: Column) -> Column:
        above = F.filter(state["open"], lambda o: o["level"] < section["level"])
        pos = state["first"] + F.size(state["done"])
        trail = F.concat(F.transform(above, lambda o: o["heading"]), F.array(section["heading"]))
        row = F.struct(
            pos.alias("pos"),
            F.get(above, F.size(above) - 1)["pos"].alias("parent_pos"),
            F.transform(above, lambda o: o["pos"]).alias("ancestors"),
            section["heading"].alias("heading"),
            section["level"].cast("int").alias("level"),
            section["content"].alias("content"),
            F.array_join(trail, " > ").alias("path"),
        ).cast(SECTION_TYPE)
        entry = F.struct(
            pos.alias("pos"), section["level"].cast("int").alias("level"), section["heading"].alias("heading")
        ).cast(_STACK_TYPE)
        return F.struct(
            state["first"].alias("first"),
            F.concat(state["done"], F.array(row)).alias("done"),
            F.concat(above, F.array(entry)).alias("open"),
        )

    def block_step(state: Column, block: Column) -> Column:
        start = F.struct(block["first"].alias("first"), no_rows.alias("done"), state["open"].alias("open"))
        done = F.aggregate(block["rows"], start, step)
        return bound(done, lambda d: F.struct(F.concat(state["blocks"], F.array(d["done"])).alias("blocks"), d["open"].alias("open")))

    def folded(held: Column) -> Column:
        n = F.size(held)
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, width)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice(held, i + 1, width).alias("rows")))
        start = F.struct(F.array().cast(f"array<array<{SECTION_TYPE}>>").alias("blocks"), no_open.alias("open"))
        return F.aggregate(blocks, start, block_step, lambda state: F.flatten(state["blocks"]))

    return F.when(sections.isNotNull(), bound(sections, folded))


def table_markdown(table: Column) -> Column:
    """array<array<string>> -> Markdown: first row is the header, others are padded or cut to it."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def rows(held: Column, width: Column) -> Column:
        rule = line(F.array_repeat(F.lit("---"), width))
        body = F.transform(
            F.slice(held, F.lit(2), F.greatest(F.size(held) - 1, F.lit(0))),
            lambda row: line(F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)),
        )
        return F.array_join(F.concat(F.array(line(F.get(held, F.lit(0))), rule), body), "\n")

    return bound(table, lambda held: bound(F.size(F.get(held, F.lit(0))), lambda width: rows(held, width)))


def tables_markdown(tables: Column) -> Column:
    return F.transform(F.filter(tables, lambda t: F.size(t) > 0), table_markdown)


def sections_text(sections: Column) -> Column:
    """Headings and their non-empty contents, separated by blank lines."""
    return F.array_join(
        F.flatten(
            F.transform(
                sections,
                lambda s: F.when(s["content"] != "", F.array(s["heading"], s["content"])).otherwise(F.array(s["heading"])),
            )
        ),
        "\n\n",
    )


def plain_decimal(seconds: Column) -> Column:
    """Epoch seconds as a plain decimal text with at least one decimal."""
    text = seconds.cast("decimal(24,7)").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def front_matter(url: Column, title: Column, content_hash: Column, fetched_at: Column) -> Column:
    return F.concat(
        F.lit("---\nurl: "), url, F.lit('\ntitle: "'), title, F.lit('"\ncontent_hash: '), content_hash,
        F.lit("\nfetched_at: "), plain_decimal(fetched_at), F.lit("\n---\n"),
    )


def document_markdown(doc: str = "") -> Column:
    """The Markdown form of a document row: front matter, title, description, sections, tables."""
    c = F.col
    sections = F.flatten(
        F.transform(
            c("sections"),
            lambda s: F.filter(
                F.array(
                    F.concat(F.repeat(F.lit("#"), F.least(s["level"] + 1, F.lit(6))), F.lit(" "), s["heading"], F.lit("\n")),
                    F.when(s["content"] != "", F.concat(s["content"], F.lit("\n"))),
                ),
                lambda part: part.isNotNull(),
            ),
        )
    )
    main = F.when((F.size("sections") == 0) & (c("main_content") != ""), F.concat(c("main_content"), F.lit("\n")))
    tables = F.when(
        F.size("tables_markdown") > 0,
        F.concat(
            F.array(F.lit("\n## Data Tables\n")),
            F.transform("tables_markdown", lambda t: F.concat(t, F.lit("\n"))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    head = F.filter(
        F.array(
            front_matter(c("url"), c("title"), c("content_hash"), c("fetched_at")),
            F.concat(F.lit("# "), c("title"), F.lit("\n")),
            F.when(c("description") != "", F.concat(F.lit("> "), c("description"), F.lit("\n"))),
        ),
        lambda part: part.isNotNull(),
    )
    tail = F.filter(F.array(main), lambda part: part.isNotNull())
    return F.array_join(F.concat(head, sections, tail, tables), "\n")


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(url, html, ...) -> the same rows with the extracted fields instead of the html.

    Other columns of the input (etag, last_modified, status, fetched_at) pass through.
    """
    passed = [c for c in pages.columns if c != "html"]
    read = pages.withColumn("_page", extracted(F.col("html"), F.col("url")))
    fields = ("title", "description", "main_content", "content_hash", "sections", "tables", "error")
    named = F.filter("_page.anchors", lambda a: a["text"] != "")
    links = F.transform(named, lambda a: F.struct(a["text"].alias("text"), a["href"].alias("href")))
    return read.select(
        *passed, F.col("_page").isNotNull().alias("fetched"), *[F.col("_page")[f].alias(f) for f in fields],
        links.alias("links"), F.col("_page.anchors").alias("anchors"),
    )


def structure_documents(extracted_pages: DataFrame) -> DataFrame:
    """Nested sections, Markdown tables, plain text, Markdown and document metadata."""
    df = extracted_pages.withColumn("sections", nested_sections(F.col("sections")))
    df = df.withColumn("tables_markdown", tables_markdown(F.col("tables")))
    df = df.withColumn(
        "plain_text",
        F.when(F.col("main_content") != "", F.col("main_content")).otherwise(sections_text(F.col("sections"))),
    )
    df = df.withColumn("content_markdown", document_markdown())
    return df.withColumn(
        "metadata",
        F.struct(
            "fetched_at",
            F.size("links").alias("link_count"),
            F.size("tables").alias("table_count"),
            F.size("sections").alias("section_count"),
            "etag",
            "last_modified",
            "status",
        ),
    )


def is_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE)) == ""
