"""SQL counterparts of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

from gleanery.functions.tokens import PUNCTUATION, STOP_WORDS, keyword_tokens_of
from gleanery.plans.catalogue import EMBEDDER, NOW, QUESTION, TOP_K

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_PUNCT = PUNCTUATION.replace("'", "''")
_QUESTION_TERMS = keyword_tokens_of(QUESTION)
_RAW_TERMS = sorted(set(QUESTION.lower().split()))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _tokens(text: str) -> str:
    split = f"regexp_split_to_array(translate(lower({text}), '{_PUNCT}', ''), '\\s+')"
    return f"list_filter({split}, lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"


def _estimate(text: str) -> str:
    return f"CAST(ceil(len({_words(text)}) * 4 / 3.0) AS INTEGER)"


_CORPUS = f"""
corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id, text, source AS source_url,
         split_part(text, chr(10), 1) AS section_heading
  FROM documents
),
tok AS (SELECT chunk_id, source_url, text, {_tokens('text')} AS toks FROM corpus)"""

_BM25 = f"""{_CORPUS},
stat AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
freq AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM tok) GROUP BY term
),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM freq, stat),
mean AS (SELECT avg(idf) AS mean_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM raw, mean),
post AS (
  SELECT chunk_id, term, dl, count(*) AS tf
  FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY ALL
),
asked AS (SELECT unnest({_list(_QUESTION_TERMS)}) AS term),
part AS (
  SELECT chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 12) AS score
  FROM asked JOIN post USING (term) JOIN idf USING (term), stat GROUP BY chunk_id
),
scored AS (
  SELECT chunk_id, source_url, coalesce(score, 0.0) AS score FROM tok LEFT JOIN part USING (chunk_id)
)"""


def _bm25_hits(k: int, where: str = "TRUE") -> str:
    return f"SELECT chunk_id, score FROM scored WHERE score > 0 AND {where} ORDER BY score DESC, chunk_id LIMIT {k}"


# ---- feature-hashed vectors of token lists, as (id, bucket, value) and as arrays

_POSITION = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64"
_SIGN = "CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1.0 ELSE -1.0 END"


def _vectors(name: str, source: str, key: str) -> str:
    """CTEs `name`_cell(key, idx, value): the non-zero cells as single-precision numbers."""
    return f"""
{name}_sum AS (
  SELECT {key}, {_POSITION} AS idx, sum({_SIGN}) AS value
  FROM (SELECT {key}, unnest(toks) AS term FROM {source}) GROUP BY ALL
),
{name}_norm AS (SELECT {key}, sqrt(sum(value * value)) AS norm FROM {name}_sum GROUP BY {key}),
{name}_cell AS (
  SELECT {key}, idx, CAST(CAST(value / norm AS FLOAT) AS DOUBLE) AS value
  FROM {name}_sum JOIN {name}_norm USING ({key}) WHERE value <> 0
),
{name}_len AS (SELECT {key}, sqrt(sum(value * value)) AS len FROM {name}_cell GROUP BY {key})"""


_QUERY_VECTOR = "[" + ", ".join(repr(x) for x in EMBEDDER.embed_query(QUESTION)) + "]::DOUBLE[]"
_DOC_VECTORS = f"""{_CORPUS},{_vectors('doc', 'tok', 'chunk_id')},
q_cell AS (SELECT unnest(range(64)) AS idx, unnest({_QUERY_VECTOR}) AS value),
q_len AS (SELECT sqrt(sum(value * value)) AS len FROM q_cell),
doc_dot AS (
  SELECT chunk_id, sum(d.value * q.value) AS dot FROM doc_cell d JOIN q_cell q USING (idx) GROUP BY chunk_id
),
doc_distance AS (
  SELECT c.chunk_id, c.source_url, c.text, round(1 - coalesce(dot / (l.len * (SELECT len FROM q_len)), 0.0), 12) AS distance
  FROM corpus c LEFT JOIN doc_dot USING (chunk_id) LEFT JOIN doc_len l USING (chunk_id)
)"""


def _knn(distance: str, where: str = "TRUE") -> str:
    return f"""
WITH q AS (SELECT {_QUERY_VECTOR} AS q),
d AS (SELECT vec_id, label, round({distance}, 12) AS distance FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings), q)
SELECT vec_id, round(distance, 6) AS distance FROM d WHERE {where} ORDER BY d.distance, vec_id LIMIT {TOP_K}"""


# ---- heading overlap over one node per document

_RAW_LIST = _list(_RAW_TERMS)
_OVERLAP = f"""
node AS (
  SELECT chunk_id, source_url, section_heading,
    CASE WHEN substr(text, length(section_heading) + 2, 200) <> ''
         THEN substr(text, length(section_heading) + 2, 200) ELSE section_heading END AS summary
  FROM corpus
),
overlap AS (
  SELECT chunk_id, source_url,
    len(list_intersect({_words("lower(section_heading || ' ' || summary)")}, {_RAW_LIST})) / {float(len(_RAW_TERMS))} AS score
  FROM node
)"""


def _hybrid(k: int = TOP_K, where: str = "TRUE", bm25: bool = True, tree: bool = True) -> str:
    """CTE `hybrid`: the ranked results of the question."""
    return f"""{_BM25.strip()},{_DOC_VECTORS.replace(_CORPUS + ',', '')},{_OVERLAP},
v AS (
  SELECT chunk_id, greatest(0.0, 1 - distance) AS v FROM doc_distance WHERE {where}
  ORDER BY distance, chunk_id LIMIT {k}
),
b0 AS ({_bm25_hits(k, where)}),
b AS (SELECT chunk_id, score / max(score) OVER () AS b FROM b0 WHERE {str(bm25).upper()}),
t0 AS (
  SELECT chunk_id, score FROM overlap WHERE score > 0 AND {where} ORDER BY score DESC, chunk_id LIMIT {k}
),
t AS (
  SELECT chunk_id, 1 - (row_number() OVER (ORDER BY score DESC, chunk_id) - 1) * 0.05 AS t
  FROM t0 WHERE {str(tree).upper()}
),
w AS (
  SELECT 0.40 AS wv, CASE WHEN (SELECT count(*) FROM b) > 0 THEN 0.35 ELSE 0 END AS wb,
         CASE WHEN (SELECT count(*) FROM t) > 0 THEN 0.25 ELSE 0 END AS wt
),
fused AS (
  SELECT chunk_id, coalesce(v, 0.0) AS score,
    CAST((wv * coalesce(v, 0.0) + wb * coalesce(b, 0.0) + wt * coalesce(t, 0.0)) / (wv + wb + wt) AS DOUBLE) AS reranker_score,
    concat_ws('+', CASE WHEN v IS NOT NULL THEN 'vector' END, CASE WHEN b IS NOT NULL THEN 'bm25' END,
              CASE WHEN t IS NOT NULL THEN 'page_index' END) AS source
  FROM v FULL JOIN b USING (chunk_id) FULL JOIN t USING (chunk_id), w
),
hybrid AS (
  SELECT chunk_id, source_url, text, section_heading, score, reranker_score, source,
    row_number() OVER (ORDER BY reranker_score DESC, chunk_id) AS rank
  FROM fused JOIN corpus USING (chunk_id) ORDER BY reranker_score DESC, chunk_id LIMIT {k}
)"""


def _hybrid_rows(**options) -> str:
    return f"""WITH {_hybrid(**options)}
SELECT chunk_id, source_url, round(score, 6) AS score, round(reranker_score, 6) AS reranker_score, source FROM hybrid"""


# ---- documents as line sections

_LINES = f"""{_CORPUS.strip()},
line AS (
  SELECT 'doc/' || chunk_id AS url, chunk_id AS doc, pos - 1 AS pos, line AS content,
    split_part(line, ' ', 1) AS heading, length(line) % 6 + 1 AS level
  FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line,
          unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM corpus)
),
nested AS (
  SELECT i.*, (SELECT max(j.pos) FROM line j WHERE j.url = i.url AND j.pos < i.pos AND j.level < i.level) AS parent_pos
  FROM line i
),
walk AS (
  SELECT url, pos, heading AS path, 0 AS depth, [pos] AS trail FROM nested WHERE parent_pos IS NULL
  UNION ALL
  SELECT n.url, n.pos, w.path || ' > ' || n.heading, w.depth + 1, list_append(w.trail, n.pos)
  FROM nested n JOIN walk w ON n.url = w.url AND n.parent_pos = w.pos
)"""

_NODES = f"""{_LINES},
node AS (
  SELECT n.url, n.pos, parent_pos, lpad(CAST(n.pos + 1 AS VARCHAR), 4, '0') AS node_id, heading AS name,
    CASE WHEN content <> '' THEN substr(content, 1, 200) ELSE heading END AS summary,
    substr(content, 1, 200) AS content_preview, level
  FROM nested n
),
node_chunk AS (
  SELECT n.url, n.pos, n.node_id, l.url || '#' || l.pos AS chunk_id, l.pos AS ord
  FROM node n JOIN line l ON l.url = n.url AND l.heading = n.name
  UNION ALL
  SELECT url, pos, node_id, url || '#plain', 1000000 FROM node WHERE pos = 0
)"""

_HASHED = """
hashed AS (SELECT 'doc/' || doc_id AS url, source AS source_url, text, md5(text) AS content_hash FROM documents),
earlier AS (
  SELECT url, CASE WHEN source_url = 'src5' THEN md5(text || '!') ELSE content_hash END AS content_hash
  FROM hashed WHERE source_url <> 'src3'
  UNION ALL SELECT 'gone/' || item_id, md5(text) FROM benchmark
)"""

# ---- pages: one heading per page, no tables, unclosed paragraphs

# Character references end with or without a semicolon, and titles may be cut off inside one.
_PAGE_HEAD = r"""replace(regexp_replace(regexp_extract(html, '(?s)<{0}>(.*?)</{0}>', 1), '&amp;?', '&', 'g'), '&quot;', '"')"""


def _page_text(html: str) -> str:
    """Tags to blanks, the few entities in use decoded, white space collapsed."""
    text = f"regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g')"
    text = f"""replace(regexp_replace({text}, '&amp;?', '&', 'g'), '&quot;', '"')"""
    return f"array_to_string({_words(text)}, ' ')"


_BODY = (
    "regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*', ' ', 'g'), '(?s)<!--.*?-->', '', 'g')"
)

# ---- cache rows

_TURNS = f"""
turn AS (
  SELECT conv_id || '-' || turn AS request_id, conv_id, turn, text AS query, role AS url_filter,
    substr(sha256(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) || '||8||' || role), 1, 20) AS query_hash
  FROM conversations
),
first AS (
  SELECT query_hash, min(struct_pack(c := conv_id, t := turn, q := query, u := url_filter)) AS f FROM turn GROUP BY query_hash
),
entry AS (
  SELECT query_hash, f.q AS query, {NOW} - 90000.0 + f.c * 200 AS created_at,
    CASE WHEN length(f.q) > 400 THEN 'other' ELSE 'current' END AS fp
  FROM first
)"""
_VALID = f"({NOW} - created_at <= 86400 AND fp = 'current')"

_SEMANTIC = f"""{_CORPUS.strip()},
item AS (SELECT CAST(item_id AS VARCHAR) AS item, length(text) AS chars, {_tokens('text')} AS toks FROM benchmark),
{_vectors('doc', 'tok', 'chunk_id')},{_vectors('item', 'item', 'item')},
dots AS (
  SELECT chunk_id, item, sum(d.value * i.value) AS dot FROM doc_cell d JOIN item_cell i USING (idx) GROUP BY ALL
),
sims AS (
  SELECT c.chunk_id, i.item, i.chars, 1 - round(1 - coalesce(dot / (dl.len * il.len), 0.0), 12) AS sim
  FROM corpus c CROSS JOIN item i LEFT JOIN dots USING (chunk_id, item)
  LEFT JOIN doc_len dl USING (chunk_id) LEFT JOIN item_len il USING (item)
)"""

_EVENTS = """
entry AS (
  SELECT CAST(event_id AS VARCHAR) AS query_hash, epoch_us(ts) / 1e6 AS idx,
    CASE WHEN event_type <> 'view' THEN epoch_us(ts) / 1e6 ELSE 0 END AS last_hit_at,
    epoch_us(ts) / 1e6 - value AS created_at, CASE WHEN event_type <> 'view' THEN user_id ELSE 0 END AS hit_count
  FROM events
)"""

ORACLES: dict[str, str] = {
    "token_counts": f"""WITH {_CORPUS}
SELECT chunk_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct, {_estimate('text')} AS n_estimated FROM tok""",
    "bm25_term_stats": f"""WITH {_CORPUS.strip()},
freq AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM tok) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM freq, (SELECT count(*) AS n FROM tok)),
mean AS (SELECT avg(idf) AS mean_idf FROM raw)
SELECT term, df, round(CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END, 6) AS idf FROM raw, mean""",
    "bm25_corpus_stats": f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM stat, mean",
    "bm25_postings": f"""WITH {_BM25}
SELECT chunk_id, dl, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS sum_tf, max(tf) AS max_tf FROM post GROUP BY ALL""",
    "bm25_topk": f"WITH {_BM25}, h AS ({_bm25_hits(TOP_K)}) SELECT chunk_id, round(score, 6) AS score FROM h",
    "bm25_all_scores": f"WITH {_BM25} SELECT chunk_id, round(score, 6) AS score FROM scored",
    "bm25_filtered": f"""WITH {_BM25}, h AS ({_bm25_hits(TOP_K, "source_url = 'src7'")})
SELECT chunk_id, round(score, 6) AS score FROM h""",
    "bm25_max_norm": f"""WITH {_BM25}, h AS ({_bm25_hits(TOP_K)})
SELECT chunk_id, round(score / max(score) OVER (), 6) AS score FROM h""",
    "bm25_index_topk": f"WITH {_BM25}, h AS ({_bm25_hits(TOP_K)}) SELECT chunk_id, round(score, 6) AS score FROM h",
    "hash_embedding": f"WITH {_DOC_VECTORS} SELECT chunk_id, idx, round(value, 6) AS value FROM doc_cell",
    "knn_cosine": _knn("1 - list_cosine_similarity(e, q)"),
    "knn_l2": _knn("list_distance(e, q) * list_distance(e, q)"),
    "knn_ip": _knn("1 - list_inner_product(e, q)"),
    "knn_filtered": _knn("1 - list_cosine_similarity(e, q)", "label = 3"),
    "similarity_clamp": f"""SELECT vec_id, label,
  round(greatest(0.0, 1 - list_sum(list_transform(list_zip(embedding::DOUBLE[], {_QUERY_VECTOR}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS score
FROM embeddings""",
    "knn_document_contains": f"""WITH {_DOC_VECTORS}
SELECT chunk_id, round(distance, 6) AS distance FROM doc_distance WHERE contains(text, 'thnt')
ORDER BY doc_distance.distance, chunk_id LIMIT {TOP_K}""",
    "knn_batch": f"""WITH {_SEMANTIC},
near AS (
  SELECT CAST(item AS BIGINT) AS query_id, chunk_id, 1 - sim AS distance,
    row_number() OVER (PARTITION BY item ORDER BY 1 - sim, chunk_id) AS rank FROM sims
)
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM near WHERE rank <= 3""",
    "get_by_ids": """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS source_url, length(text) AS n_chars, 0.0::DOUBLE AS distance
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "hybrid_topk": _hybrid_rows(),
    "hybrid_no_bm25": _hybrid_rows(bm25=False),
    "hybrid_no_tree": _hybrid_rows(tree=False),
    "vector_only": _hybrid_rows(bm25=False, tree=False),
    "hybrid_url_filter": _hybrid_rows(where="source_url = 'src7'"),
    "fusion_labels": f"""WITH {_hybrid(k=30)}
SELECT source, count(*) AS n, round(max(reranker_score), 6) AS best FROM hybrid GROUP BY source""",
    "tree_overlap_scores": f"WITH {_CORPUS},{_OVERLAP} SELECT chunk_id, round(score, 6) AS score FROM overlap WHERE score > 0",
    "tree_topk": f"""WITH {_CORPUS},{_OVERLAP},
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM overlap WHERE score > 0)
SELECT chunk_id, rank, CAST(round(1 - (rank - 1) * 0.05, 6) AS DOUBLE) AS score FROM best WHERE rank <= 25""",
    "section_nesting": f"WITH RECURSIVE {_LINES} SELECT url, pos, level, parent_pos FROM nested",
    "section_paths": f"WITH RECURSIVE {_LINES} SELECT url, pos, path, depth FROM walk",
    "tree_nodes": f"""WITH RECURSIVE {_NODES}
SELECT url, node_id, name, summary, content_preview, level,
  (SELECT count(*) FROM node_chunk c WHERE c.url = n.url AND c.node_id = n.node_id) AS n_chunks FROM node n""",
    "tree_node_chunks": f"""WITH RECURSIVE {_NODES}
SELECT url, node_id, row_number() OVER (PARTITION BY url, node_id ORDER BY ord) - 1 AS idx, chunk_id FROM node_chunk""",
    "subtree_chunks": f"""WITH RECURSIVE {_NODES}
SELECT c.url, row_number() OVER (PARTITION BY c.url ORDER BY c.pos, c.ord) - 1 AS idx, c.chunk_id
FROM node_chunk c JOIN walk w ON w.url = c.url AND w.pos = c.pos WHERE list_contains(w.trail, 1)""",
    "tree_outline": f"""WITH RECURSIVE {_NODES},
body AS (
  SELECT n.url, string_agg(repeat('  ', w.depth) || '- [' || node_id || '] ' || name || ': ' || summary, chr(10) ORDER BY n.pos) AS body
  FROM node n JOIN walk w USING (url, pos) GROUP BY n.url
)
SELECT url, 'Document: Title ' || chunk_id || chr(10) || 'URL: ' || url || chr(10) || 'Summary: '
  || CASE WHEN section_heading <> '' THEN section_heading ELSE 'Content from Title ' || chunk_id END
  || chr(10) || chr(10) || body AS outline
FROM body JOIN corpus ON url = 'doc/' || chunk_id""",
    "tree_json_round_trip": f"""WITH RECURSIVE {_NODES}
SELECT url, node_id, parent_pos, name, level,
  (SELECT count(*) FROM node_chunk c WHERE c.url = n.url AND c.node_id = n.node_id) AS n_chunks FROM node n""",
    "unassigned_chunks": f"""WITH {_LINES.replace(_LINES[_LINES.index(',' + chr(10) + 'nested'):], '')}
SELECT url || '#' || pos || '+' AS chunk_id FROM line UNION ALL SELECT 'doc/' || chunk_id || '#plain+' FROM corpus""",
    "document_markdown": f"""WITH RECURSIVE {_LINES},
body AS (
  SELECT url, string_agg(repeat('#', least(level + 1, 6)) || ' ' || heading || chr(10)
    || CASE WHEN content <> '' THEN chr(10) || content || chr(10) ELSE '' END, chr(10) ORDER BY pos) AS body
  FROM line GROUP BY url
)
SELECT url, md5('---' || chr(10) || 'url: ' || url || chr(10) || 'title: "Title ' || chunk_id || '"' || chr(10)
  || 'content_hash: ' || md5(text) || chr(10) || 'fetched_at: ' || length(text) || '.0' || chr(10) || '---' || chr(10)
  || chr(10) || '# Title ' || chunk_id || chr(10)
  || CASE WHEN section_heading <> '' THEN chr(10) || '> ' || section_heading || chr(10) ELSE '' END
  || chr(10) || body) AS markdown_md5
FROM body JOIN corpus ON url = 'doc/' || chunk_id""",
    "table_markdown": f"""WITH {_LINES.replace(_LINES[_LINES.index(',' + chr(10) + 'nested'):], '')},
width AS (SELECT doc, len(string_split(content, ' ')) AS n FROM line WHERE pos = 0),
row_text AS (
  SELECT doc, pos, '| ' || array_to_string(list_slice(list_concat(string_split(content, ' '), list_transform(range(n), lambda i: '')), 1, n), ' | ') || ' |'
    || CASE WHEN pos = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |' ELSE '' END AS t
  FROM line JOIN width USING (doc)
)
SELECT doc AS chunk_id, md5(string_agg(t, chr(10) ORDER BY pos)) AS markdown_md5 FROM row_text GROUP BY doc""",
    "sections_text": f"""WITH {_LINES.replace(_LINES[_LINES.index(',' + chr(10) + 'nested'):], '')}
SELECT url, md5(string_agg(heading || CASE WHEN content <> '' THEN chr(10) || chr(10) || content ELSE '' END, chr(10) || chr(10) ORDER BY pos)) AS text_md5
FROM line GROUP BY url""",
    "chunk_hard_split": f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_words('text')} AS ws FROM documents),
s AS (SELECT chunk_id, ws, unnest(range(0, len(ws), 336)) AS start FROM w)
SELECT chunk_id, start, array_to_string(ws[start + 1 : start + 384], ' ') AS text FROM s WHERE len(ws[start + 1 : start + 384]) >= 38""",
    "chunk_overlap": f"""WITH {_LINES.replace(_LINES[_LINES.index(',' + chr(10) + 'nested'):], '')},
prior AS (SELECT doc, pos, content, lag(content) OVER (PARTITION BY doc ORDER BY pos) AS before FROM line)
SELECT doc AS chunk_id, pos AS idx, CASE WHEN pos = 0 THEN content
  ELSE array_to_string(list_slice({_words('before')}, greatest(len({_words('before')}) - 48, 0) + 1, len({_words('before')})), ' ') || ' ' || content END AS text
FROM prior""",
    "chunk_ids": f"""WITH {_LINES.replace(_LINES[_LINES.index(',' + chr(10) + 'nested'):], '')}
SELECT url, pos, substr(sha256(url || '::' || heading || '::' || pos), 1, 16) AS chunk_id FROM line""",
    "chunk_id_repair": """WITH r AS (
  SELECT doc_id, text, substr(sha256(text), 1, 16) AS id, row_number() OVER (PARTITION BY substr(sha256(text), 1, 16) ORDER BY doc_id) AS n
  FROM documents
)
SELECT doc_id, id || CASE WHEN n > 1 THEN substr(md5(text), 1, 8) ELSE '' END AS chunk_id FROM r""",
    "coverage_fallback": f"""WITH {_LINES.replace(_LINES[_LINES.index(',' + chr(10) + 'nested'):], '')},
kept AS (SELECT url, count(*) AS n, sum(length(content)) + count(*) - 1 AS chars FROM line WHERE length(content) > 200 GROUP BY url)
SELECT 'doc/' || chunk_id AS url, coalesce(n, 0) = 0 OR (text <> '' AND length(text) > chars * 1.3::DOUBLE) AS uncovered
FROM corpus LEFT JOIN kept ON url = 'doc/' || chunk_id""",
    "html_titles": f"SELECT url, trim({_PAGE_HEAD.format('title')}) AS title, '' AS description FROM pages",
    "html_main_text": f"""WITH t AS (SELECT url, {_page_text(_BODY)} AS t FROM pages)
SELECT url, md5(t) AS text_md5, length(t) AS n_chars FROM t""",
    "html_links": r"""WITH a AS (
  SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS path,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
    unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS n
  FROM pages
),
f AS (SELECT url, path, min(n) AS n, arg_min(text, n) AS text FROM a GROUP BY url, path)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY n) - 1 AS idx, trim(text) AS text,
  regexp_extract(url, '^(https?://[^/]+)', 1) || path AS href
FROM f WHERE trim(text) <> ''""",
    "html_sections": f"""WITH s AS (SELECT url, html, regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS rest FROM pages)
SELECT url, 0 AS pos, trim({_PAGE_HEAD.format('h1')}) AS heading, 1 AS level, md5({_page_text('rest')}) AS content_md5 FROM s""",
    "page_metadata": r"""SELECT url, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)">', 1))) AS link_count, 0 AS table_count,
  1 AS section_count, 200 AS status FROM pages""",
    "content_fingerprint_of_documents": """SELECT substr(sha256(string_agg(prefix || digest, '|' ORDER BY prefix)), 1, 16) AS fingerprint
FROM (SELECT substr(sha256(h), 1, 4) AS prefix, sha256(string_agg(h, '|' ORDER BY h)) AS digest
      FROM (SELECT DISTINCT md5(text) AS h FROM documents) GROUP BY 1)""",
    "change_detection_status": f"""WITH {_HASHED}
SELECT h.url, h.source_url, e.url IS NULL AS is_new, h.content_hash IS DISTINCT FROM e.content_hash AS has_changed
FROM hashed h LEFT JOIN earlier e USING (url)""",
    "ingest_rollup": f"""WITH {_HASHED},
d AS (
  SELECT h.url, CASE WHEN h.content_hash IS NOT DISTINCT FROM e.content_hash THEN 'cached'
    WHEN {_estimate('h.text')} < 50 THEN 'failed' ELSE 'processed' END AS status,
    len(string_split(h.text, chr(10))) AS chunks, {_estimate('h.text')} AS tokens
  FROM hashed h LEFT JOIN earlier e USING (url)
)
SELECT count(*) FILTER (status = 'processed') AS urls_processed, count(*) FILTER (status = 'cached') AS urls_skipped_cached,
  count(*) FILTER (status = 'failed') AS urls_failed, CAST(coalesce(sum(chunks) FILTER (status = 'processed'), 0) AS BIGINT) AS total_chunks,
  CAST(coalesce(sum(tokens) FILTER (status = 'processed'), 0) AS BIGINT) AS total_tokens FROM d""",
    "orphan_urls": f"WITH {_HASHED} SELECT DISTINCT url FROM earlier WHERE url NOT IN (SELECT url FROM hashed)",
    "upsert_chunks": """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
UNION ALL SELECT CAST(item_id AS VARCHAR), text FROM benchmark""",
    "delete_by_url": "SELECT source AS source_url, count(*) AS n FROM documents WHERE source <> 'src7' GROUP BY source",
    "distinct_urls": "SELECT DISTINCT source AS source_url FROM documents",
    "clean_metadata": f"""WITH {_CORPUS}
SELECT chunk_id, array_to_string(string_split(section_heading, ' '), ', ') AS heading_words, length(text) AS n_chars,
  length(text) > 1000 AS is_long, CASE WHEN source_url <> 'src3' THEN source_url END AS source_url FROM corpus""",
    "cache_keys": f"WITH {_TURNS.replace('lower(text)', 'lower(upper(text))')} SELECT request_id, query_hash FROM turn",
    "cache_exact": f"""WITH {_TURNS}
SELECT request_id, query_hash, 'exact' AS kind FROM turn JOIN entry USING (query_hash) WHERE {_VALID}""",
    "cache_validity": f"WITH {_TURNS} SELECT query_hash, {_VALID} AS valid FROM entry",
    "cache_semantic_best": f"""WITH {_SEMANTIC},
best AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY 1 - sim, item) AS n FROM sims)
SELECT chunk_id AS request_id, item AS query_hash, round(sim, 6) AS similarity FROM best WHERE n = 1""",
    "cache_semantic_usable": f"""WITH {_SEMANTIC},
best AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY 1 - sim, item) AS n FROM sims)
SELECT chunk_id AS request_id, item AS query_hash, round(sim, 6) AS similarity FROM best
WHERE n = 1 AND sim >= 0.5 AND chars > 150""",
    "cache_evict": f"""WITH {_EVENTS}
SELECT query_hash, round(last_hit_at, 6) AS last_hit_at, round(created_at, 6) AS created_at FROM entry
ORDER BY entry.last_hit_at DESC, entry.created_at DESC, query_hash LIMIT 1000""",
    "cache_stats": f"""WITH {_EVENTS}
SELECT count(*) AS total_entries, CAST(coalesce(sum(hit_count), 0) AS BIGINT) AS total_hits, round(coalesce(max(last_hit_at), 0), 6) AS last_hit_at,
  0.92::DOUBLE AS similarity_threshold, 86400.0::DOUBLE AS ttl_seconds FROM entry""",
    "cache_store": f"""WITH {_CORPUS}
SELECT CAST(item_id AS VARCHAR) AS query_hash, text AS query, 'old' AS url_filter, 7 AS hit_count, {NOW}::DOUBLE AS last_hit_at, 1.0::DOUBLE AS created_at
FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)
UNION ALL
SELECT chunk_id, coalesce(b.text, section_heading), CASE WHEN b.text IS NULL THEN source_url ELSE 'old' END, 0, 0.0, {NOW}
FROM corpus LEFT JOIN benchmark b ON chunk_id = CAST(item_id AS VARCHAR)""",
    "context_only": f"""WITH {_hybrid()}
SELECT 'Retrieved context (no LLM generation):' || chr(10) || chr(10) || string_agg(
  printf('--- Result %d (score: %.3f, source: %s) ---', rank, reranker_score, source) || chr(10) || 'URL: ' || source_url
  || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS answer FROM hybrid""",
    "prompt_context": f"""WITH {_hybrid()}
SELECT string_agg('[Source ' || rank || ': ' || source_url || CASE WHEN section_heading <> '' THEN ' > ' || section_heading ELSE '' END
  || printf(' | relevance: %.2f]', reranker_score) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hybrid""",
    "search_values": f"""WITH {_hybrid()}
SELECT rank, printf('%.4f', score)::DOUBLE AS search_score, printf('%.4f', reranker_score)::DOUBLE AS search_reranker_score, text AS content,
  source_url AS sourcefile, source_url AS doc_url FROM hybrid""",
    "search_document": f"""WITH {_hybrid()}
SELECT '{QUESTION}' AS context, {TOP_K} AS n, 'An answer.' AS answer, rank - 1 AS idx, printf('%.4f', score)::DOUBLE AS score,
  length(text) AS n_chars, source_url AS doc_url FROM hybrid""",
    "sources_round_trip": f"""WITH {_hybrid()}
SELECT rank - 1 AS idx, chunk_id, round(score, 6) AS score, round(reranker_score, 6) AS reranker_score, source, source_url FROM hybrid""",
}
