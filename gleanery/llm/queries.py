"""The registered queries of these operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import chat, exact_dedup, fill_middle, fingerprints, language_id, line_dedup, mixing, near_dedup, packing
from gleanery.llm import toxicity, url_filter, vector_codes, warc
from gleanery.llm.staging import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@registered
def op1_mix_to_weights(spark, folder):
    return mixing.taken_words(table(spark, folder, "documents"))


@registered
def op2_url_filter(spark, folder):
    return url_filter.judged(table(spark, folder, "pages"))


@registered
def op3_minhash_near_dedup(spark, folder):
    found = near_dedup.near_groups(table(spark, folder, "documents"), n=2)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


@registered
def op4_line_chunks(spark, folder):
    clean = line_dedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return clean.select(
        "row.doc_id",
        "n_lines",
        "n_chunks",
        "n_removed",
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"),
    )


@registered
def op5_document_fingerprints(spark, folder):
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


@registered
def op6_chat_snapshots(spark, folder):
    return chat.render(table(spark, folder, "conversations"))


@registered
def op7_toxicity(spark, folder):
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered
def op8_exact_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    middle = exact_dedup.id_midpoint(docs)
    found = exact_dedup.exact_groups(exact_dedup.digest_rows(docs), middle)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@registered
def op9_warc_chunks(spark, folder):
    return warc.read_archives(warc.write_archives(table(spark, folder, "pages")))


@registered
def op10_length_buckets(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", packing.n_words(F.col("text")).alias("n"))
    packed = packing.pack(sized, tokens=F.col("n"))
    return packed.select("row.doc_id", "n_tokens", "bucket", "bound", "batch", "slot", "padding")


@registered
def op11_vector_codes(spark, folder):
    return vector_codes.compressed(table(spark, folder, "embeddings"))


@registered
def op12_fill_middle(spark, folder):
    return fill_middle.digests(table(spark, folder, "documents"))


@registered
def op13_language_id(spark, folder):
    return language_id.languages(table(spark, folder, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op8_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_LETTERS})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

ORACLES["op9_warc_chunks"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

# Blocks, permutations and the cut are those of the operator: 60 bits of an MD5.
_H = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
ORACLES["op1_mix_to_weights"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
      FROM d GROUP BY source),
w AS (SELECT *, CASE number % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 2 * source_size / weight AS ratio FROM w),
l AS (SELECT a.number, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
             - coalesce(sum(2 * b.source_size) FILTER (b.ratio < a.ratio), 0))
             / sum(b.weight) FILTER (b.ratio >= a.ratio) AS fill
      FROM r a, r b GROUP BY a.number),
c AS (SELECT r.*, r.weight * l.fill > 2 * r.source_size AS capped FROM r JOIN l USING (number)),
v AS (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2 * source_size) FILTER (capped), 0))
             / coalesce(sum(weight) FILTER (NOT capped), 1) AS fill FROM c),
t AS (SELECT c.*, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE v.fill * weight END AS target FROM c, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
             greatest(64, (source_size + 1048575) // 1048576) AS n_blocks FROM t),
x AS (SELECT d.doc_id, d.size, p.*, target - passes * source_size AS rest,
             {_H.format("'doc20|' || coalesce(CAST(d.doc_id AS VARCHAR), chr(0)) || '|' || coalesce(d.source, chr(0))")} AS h
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
y AS (SELECT *, h % n_blocks AS block FROM x),
b AS (SELECT number, block, rest, sum(size) AS words,
             {_H.format("'block20|' || any_value(passes) || '|' || number || '|' || block")} AS place
      FROM y GROUP BY number, block, rest),
u AS (SELECT *, sum(words) OVER (PARTITION BY number ORDER BY place, block) AS upto FROM b),
z AS (SELECT y.*, u.upto, u.upto - u.words AS base, sum(y.size) OVER (PARTITION BY y.number, y.block ORDER BY y.h) AS inner_upto
      FROM y JOIN u USING (number, block))
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN upto <= rest THEN 1
                                  WHEN base < rest AND base + inner_upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z
"""

ORACLES["op3_minhash_near_dedup"] = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(x) < 2 THEN x ELSE [x[i] || ' ' || x[i + 1] FOR i IN range(1, len(x))] END) AS x
      FROM w),
n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(x) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""

ORACLES["op4_line_chunks"] = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
s AS (SELECT *, lag(h, 1, 0) OVER d AS h1, lag(h, 2, 0) OVER d AS h2 FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, sum(CASE WHEN h1 > 0 AND (h2 * 31 + h1) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS pos
      FROM s),
k AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n_lines FROM c GROUP BY doc_id, pos),
m AS (SELECT *, n_lines > 1 AND regexp_matches(body, '[^\\x20\\x09-\\x0D]') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1
             AS gone FROM k)
SELECT doc_id, sum(n_lines)::INT AS n_lines, count(*)::INT AS n_chunks, (count(*) FILTER (gone))::INT AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone), '')
              || CASE WHEN arg_max(gone, pos) AND NOT bool_and(gone) THEN chr(10) ELSE '' END) AS clean_sha256
FROM m GROUP BY doc_id
"""

ORACLES["op6_chat_snapshots"] = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position
           FROM conversations),
p AS (SELECT *, string_agg(coalesce(role, '') || chr(1) || coalesce(text, ''), chr(2))
                OVER (PARTITION BY conv_id ORDER BY position) AS prefix,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
f AS (SELECT min(conv_id) AS conv_id FROM p a WHERE position = n
      AND NOT EXISTS (SELECT 1 FROM p b WHERE b.prefix = a.prefix AND b.position = a.position AND b.position < b.n)
      GROUP BY prefix)
SELECT conv_id, ((position - 1) // 256)::INT AS part, count(*) AS n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY position)
       AS rendered
FROM t JOIN f USING (conv_id) GROUP BY conv_id, part
"""


def _vector_codes() -> str:
    """Four rounds, one after another: a(r) assigns parts to the entries of c(r), c(r + 1) has their floored means."""
    rounds = []
    for r in range(5):
        rounds.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d
  FROM (SELECT row, part, entry, CAST(sum((p.v - c.v) * (p.v - c.v)) AS BIGINT) AS d FROM p JOIN c{r} c USING (part, pos) GROUP BY ALL)
  GROUP BY row, part
)""")
        if r < 4:
            rounds.append(f"""
m{r} AS (
  SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{r} USING (row, part) GROUP BY ALL
),
c{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c.v) AS v FROM c{r} c LEFT JOIN m{r} USING (part, entry, pos)
)""")
    return f"""
WITH e AS (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row, len(v) // 4 AS width FROM e),
p AS MATERIALIZED (
  SELECT row, (i - 1) // width AS part, (i - 1) % width AS pos, v[i] AS v
  FROM (SELECT row, width, v, unnest(range(1, len(v) + 1)) AS i FROM o)
),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, pos, v FROM p WHERE row <= 256),{",".join(rounds)},
k AS (
  SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY row
),
b AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN k USING (row), b
"""


ORACLES["op11_vector_codes"] = _vector_codes()

ORACLES["op12_fill_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
             [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
k AS (SELECT *, CAST(len(lines) AS BIGINT) AS n, least(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS low,
             greatest(r[1] % (len(lines) + 1), r[2] % (len(lines) + 1)) AS high FROM l),
c AS (SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle,
             array_to_string(lines[high + 1:], '') AS suffix,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
                  WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
