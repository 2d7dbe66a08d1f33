"""Operators on small fixtures, against brute force or worked examples."""

import math
import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.config import ChunkSettings, EmbeddingSettings, FusionSettings
from gleanery.functions import html
from gleanery.functions.hashing import content_fingerprint, query_key, xxh128
from gleanery.functions.splitter import EncodingCounter, Splitter, WordEstimate
from gleanery.functions.tokens import STOP_WORDS, keyword_tokens, keyword_tokens_of, token_estimate, words
from gleanery.functions.vectors import checked_metric
from gleanery.operators import answers, bm25, change_detection, chunking, fusion, heading_tree, result_cache
from gleanery.operators import structure, templates, tiles, vector_search
from gleanery.operators.embedding import HashingEmbedder, ModelEmbedder
from gleanery.session import spread
from gleanery.sources.pages import html_files


# ---------------------------------------------------------------- tokens


def test_tokens_follow_unicode_white_space_and_case(spark):
    texts = ["The Rates, rates! x-Ray a\tDon't", "İstanbul i", "", "of the"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["k"] for r in rows.orderBy("i").select(keyword_tokens(F.col("t")).alias("k")).collect()]
    assert got[0] == ["rates", "rates", "xray", "dont"]
    assert got == [keyword_tokens_of(t) for t in texts]
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 99
    counts = rows.orderBy("i").select(F.size(words(F.col("t"))), token_estimate(F.col("t"))).collect()
    assert [tuple(r) for r in counts] == [(len(t.split()), math.ceil(len(t.split()) * 4 / 3)) for t in texts]


# ---------------------------------------------------------------- BM25


def okapi(corpus, question, k1=1.5, b=0.75, epsilon=0.25):
    docs = [keyword_tokens_of(t) for t in corpus]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (epsilon * mean if v < 0 else v) for t, v in idf.items()}
    return [
        sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avgdl)) for t in keyword_tokens_of(question))
        for d in docs
    ]


CORPUS = ["loan rate loan", "rate offset account rate", "bonus saver rate", "rate fee", "", "offset the loan", "card"]


@pytest.mark.parametrize("question", ["loan rate", "loan loan offset", "the of", "unknown words", "Rate, card?"])
def test_bm25_matches_brute_force_both_ways(spark, question):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(CORPUS)], "chunk_id string, text string")
    tokens = bm25.with_tokens(rows)
    want = okapi(CORPUS, question)
    got = {r["chunk_id"]: r["score"] for r in bm25.score_texts(tokens, question).collect()}
    assert got == pytest.approx({str(i): w for i, w in enumerate(want)})
    best = sorted((-w, str(i)) for i, w in enumerate(want) if w > 0)[:3]
    hits = [r["chunk_id"] for r in bm25.top_hits(bm25.score_texts(tokens, question), 3).collect()]
    assert hits == [i for _, i in best]

    posted = bm25.postings(tokens, ["chunk_id"])
    frequencies = bm25.term_frequencies(posted)
    stats = bm25.corpus_statistics(tokens.select(F.size("tokens").alias("dl")), frequencies)
    scored = bm25.score_postings(posted, bm25.term_statistics(frequencies, stats), stats, question, ["chunk_id"])
    indexed = {r["chunk_id"]: r["score"] for r in scored.collect()}
    assert indexed == pytest.approx({str(i): w for i, w in enumerate(want) if w != 0})


def test_bm25_of_an_empty_corpus_has_no_hits(spark):
    rows = bm25.with_tokens(spark.createDataFrame([], "chunk_id string, text string"))
    assert bm25.top_hits(bm25.score_texts(rows, "loan"), 5).collect() == []


# ---------------------------------------------------------------- vectors


def distance(a, b, metric):
    if metric == "l2":
        return ((a - b) ** 2).sum()
    if metric == "ip":
        return 1 - a @ b
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return 1 - (a @ b / norm if norm else 0.0)


def test_search_and_batch_search_match_brute_force(spark):
    rng = np.random.default_rng(7)
    data = rng.integers(-3, 4, (40, 6)).astype(float)
    data[5] = 0
    asked = rng.integers(-3, 4, (5, 6)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(99, None)], "chunk_id int, embedding array<float>")
    questions = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "query_id string, query_vector array<float>")

    for metric in ("cosine", "l2", "ip"):
        want = {
            f"q{j}": sorted((round(distance(v, q, metric), 9), i) for i, v in enumerate(data))[:7] for j, q in enumerate(asked)
        }
        many = vector_search.search_many(rows.repartition(5), questions, 7, metric).orderBy("query_id", "rank").collect()
        got = {}
        for r in many:
            got.setdefault(r["query_id"], []).append(round(r["distance"], 9))
        assert got == {q: [d for d, _ in hits] for q, hits in want.items()}
        one = vector_search.search(rows, asked[0].tolist(), 7, metric=metric).collect()
        assert [round(r["distance"], 9) for r in one] == [d for d, _ in want["q0"]]
    assert len(vector_search.search(rows, asked[0].tolist(), 0).collect()) == 10
    assert checked_metric("manhattan") == "cosine"


def test_batch_search_with_several_tiles_is_exact(spark, monkeypatch):
    """Both sides over several blocks and slices, equal rows, null vectors on both sides, more than one level of merging."""
    monkeypatch.setattr(tiles, "SLICE_ROWS", 13)
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 7)
    monkeypatch.setattr(tiles, "FAN_IN", 2)
    monkeypatch.setattr(tiles, "CHUNK_CELLS", 30)
    rng = np.random.default_rng(12)
    data = [rng.integers(-2, 3, 6).astype(float).tolist() for _ in range(150)]
    asked = [rng.integers(-2, 3, 6).astype(float).tolist() for _ in range(40)]
    rows = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(data)] + [("none", None)], "chunk_id string, embedding array<double>")
    questions = spark.createDataFrame([*enumerate(asked), (99, None)], "query_id int, query_vector array<double>")
    for metric in ("cosine", "l2", "ip"):
        got = {}
        for r in vector_search.search_many(rows.repartition(3), questions, 5, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((round(r["distance"], 7), r["id"]))
        want = {
            j: sorted((round(float(distance(np.array(v), np.array(q), metric)), 7), f"c{i}") for i, v in enumerate(data))[:5] for j, q in enumerate(asked)
        }
        assert got == want
    assert vector_search.search_many(rows.where("false"), questions, 5).count() == 0
    assert vector_search.search_many(rows, questions.where("false"), 5).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(str(i), [1.0, 0.0]) for i in range(9)], "chunk_id string, embedding array<float>")
    assert [r["chunk_id"] for r in vector_search.search(rows.repartition(4), [1.0, 0.0], 3).collect()] == ["0", "1", "2"]
    question = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<float>")
    assert [r["id"] for r in vector_search.search_many(rows.repartition(4), question, 3).orderBy("rank").collect()] == ["0", "1", "2"]


def test_embedders(spark):
    rows = spark.createDataFrame([("loan rate loan",), ("",), ("loan rate loan",)], "text string")
    embedder = HashingEmbedder(EmbeddingSettings(dimension=16))
    vectors = [r[0] for r in rows.select(embedder.column(F.col("text"))).collect()]
    assert vectors[0] == vectors[2] == pytest.approx(embedder.embed_query("Loan, rate loan"))
    assert sum(x * x for x in vectors[0]) == pytest.approx(1) and set(vectors[1]) == {0.0}

    def encode(texts):
        assert len(texts) == len(set(texts)) <= 2
        return [[len(t), 1.0] for t in texts]

    model = ModelEmbedder(encode, EmbeddingSettings(dimension=2, batch_size=2, normalize=False))
    prefix = "p" * 200
    texts = spark.createDataFrame([(prefix + "a",), (prefix + "bb",), (prefix + "a",)], "text string").coalesce(1)
    # Texts that share their first 200 characters still get vectors of their own.
    assert [r[0] for r in texts.select(model.column(F.col("text"))).collect()] == [[201, 1], [202, 1], [201, 1]]
    assert model.embed_query("abc") == [3, 1]


# ---------------------------------------------------------------- fusion


def fused(spark, vector, keywords=None, tree=None):
    schema = "chunk_id string, score double"
    parts = [None if p is None else spark.createDataFrame(p, schema) for p in (vector, keywords, tree)]
    return {r["chunk_id"]: r for r in fusion.fuse(*parts).collect()}


@pytest.mark.parametrize(
    ("keywords", "tree", "weights"),
    [
        ([("a", 1.0)], [("a", 1.0)], (0.40, 0.35, 0.25)),
        ([("a", 1.0)], [], (0.533, 0.467, 0.0)),
        ([], [("a", 1.0)], (0.615, 0.0, 0.385)),
        (None, None, (1.0, 0.0, 0.0)),
    ],
)
def test_fusion_weights(spark, keywords, tree, weights):
    got = fused(spark, [("v", 1.0)], keywords, tree)
    assert got["v"]["reranker_score"] == pytest.approx(weights[0], abs=5e-4)
    if keywords or tree:
        assert got["a"]["reranker_score"] == pytest.approx(weights[1] + weights[2], abs=5e-4)
        assert got["a"]["score"] == 0.0


def test_fusion_labels_unknown_ids_and_empty_vectors(spark):
    got = fused(spark, [], [("a", 1.0)], [("a", 0.95), ("b", 1.0)])
    # Without vector hits the vector weight still counts.
    assert got["a"]["reranker_score"] == pytest.approx(0.35 + 0.25 * 0.95) and got["a"]["source"] == "bm25+page_index"
    schema = "chunk_id string, score double"
    rows = fusion.fuse(spark.createDataFrame([("x", 0.9), ("c", 0.5), ("b", 0.5)], schema))
    chunks = spark.createDataFrame([("b", "B"), ("c", "C"), ("d", "D")], "chunk_id string, text string")
    assert [(r["chunk_id"], r["text"]) for r in fusion.with_texts(rows, chunks, 2).collect()] == [("b", "B"), ("c", "C")]
    ranks = spark.createDataFrame([("a", 1), ("b", 22)], "chunk_id string, rank int")
    scores = {r["chunk_id"]: r["score"] for r in fusion.rank_scores(ranks).collect()}
    assert scores == pytest.approx({"a": 1.0, "b": -0.05})
    assert FusionSettings().vector_weight + FusionSettings().bm25_weight + FusionSettings().tree_weight == 1.0


# ---------------------------------------------------------------- headings


def stack_parents(levels):
    parents, stack = [], []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        parents.append(stack[-1] if stack else None)
        stack.append(i)
    return parents


def test_nesting_matches_a_stack_on_random_levels(spark):
    rng = random.Random(3)
    cases = [[rng.randint(1, 6) for _ in range(rng.randint(0, 14))] for _ in range(200)]
    # Whole and broken blocks of the fold, also with levels that have no end.
    cases += [[rng.randint(1, 40) for _ in range(n)] for n in (15, 16, 17, 99, 100, 101, 700)]
    rows = [(i, [(f"h{j}", level, "") for j, level in enumerate(levels)]) for i, levels in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, s array<struct<heading:string,level:int,content:string>>")
    for r in df.select("i", structure.nested_sections(F.col("s")).alias("s")).collect():
        parents = stack_parents(cases[r["i"]])
        assert [s["parent_pos"] for s in r["s"]] == parents
        for s in r["s"]:
            trail, at = [], s["pos"]
            while at is not None:
                trail.insert(0, at)
                at = parents[at]
            assert s["ancestors"] == trail[:-1] and s["path"] == " > ".join(f"h{t}" for t in trail)


def test_page_extraction_rules():
    root = html.parse(
        "<title> A &amp; B </title><meta content=no><meta name='description' content=' d&eacute; '>"
        "<body><nav>menu</nav><h2>One <b>bold</b></h2>bare<p>first<p>second<script>x()</script>"
        "<div>wrap <h3>In</h3><p>inner</p></div><h4></h4><p>after</p><footer>foot</footer>"
        "<a href='/q'></a><a href='/q'>late</a><a href='mailto:x@y'>mail</a><a href='z?k#f'> z </a>"
    )
    assert html.title_of(root) == "A & B" and html.description_of(root) == "dé"
    assert html.title_of(html.parse("<title>a<b>c</b></title>")) == ""
    assert html.Outline(root, "").sections == [
        {"heading": "One bold", "level": 2, "content": "first\nsecond\nwrap In inner"},
        {"heading": "In", "level": 3, "content": "inner"},
        {"heading": "", "level": 4, "content": "after\nfoot\nlate\nmail\nz"},
    ]
    assert html.Outline(root, "http://h/p/").links == [{"text": "z", "href": "http://h/p/z?k#f"}]
    text = html.main_text_of(root)
    assert "menu" not in text and "foot" not in text and "x()" not in text and text.startswith("One bold\nbare\nfirst\nsecond")
    assert html.extract("<p>x", "http://[bad")["error"] is None
    assert html.extract("<a href='http://[bad'>x</a>", "http://h/")["error"].startswith("ValueError")
    deep = "<b>" * 5000 + "end"
    assert html.main_text_of(html.parse(deep)) == "end"


def test_tables_and_their_markdown(spark):
    root = html.parse(
        "<table><tr><th>h1<th>h2<tr><td> </td></tr><tr><td>1</td></tr><tr><td>2<td>3<td>4</tr></table>"
        "<table><tr><td></td></tr></table><table><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table>"
    )
    tables = html.Outline(root, "").tables
    # The outer table also sees the rows and cells of the one nested in it.
    assert tables == [[["h1", "h2"], ["1"], ["2", "3", "4"]], [["out in", "in"], ["in"]], [["in"]]]
    df = spark.createDataFrame([(tables,)], "t array<array<array<string>>>")
    md = df.select(structure.tables_markdown(F.col("t"))).first()[0]
    assert md[0] == "| h1 | h2 |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |" and len(md) == 3


# ---------------------------------------------------------------- splitting


class Characters:
    """One token per character, to see every boundary."""

    @staticmethod
    def encode(text):
        return list(text)

    @staticmethod
    def decode(ids):
        return "".join(ids)


def cut(text, size, overlap, least, separators=("\n\n", ". ", " ")):
    settings = ChunkSettings(size, overlap, least, separators)
    return Splitter(settings, EncodingCounter(lambda: Characters)).split(text)


def test_splitter_boundaries():
    assert cut("x" * 9, 10, 0, 5) == ["x" * 9]
    assert cut("x" * 4, 10, 0, 5) == []
    assert cut("  abcdefg ", 10, 0, 5) == ["abcdefg"]
    assert cut("aaaaaa bbbbbb cc", 10, 0, 5) == ["aaaaaa", "bbbbbb cc"]
    # A short head has nothing to be glued to and is lost; a short tail goes to the piece before it.
    assert cut("aa bbbbbbbbb", 10, 0, 5) == ["bbbbbbbbb"]
    assert cut("aaaaaa bbbbb cc dddddddddd e", 10, 0, 5) == ["aaaaaa", "bbbbb cc", "dddddddddd e"]
    # No separator at all: sliding windows, and every level on the way out adds its overlap.
    assert cut("abcdefghijklmnop", 10, 2, 3, ()) == ["abcdefghij", "ijklmnop"]
    assert cut("abcdefghijklmnop", 10, 2, 3, (" ",)) == ["abcdefghij", "ij ijklmnop"]
    assert cut("abcdefghijklmnop", 10, 2, 3) == ["abcdefghij", "ij ij ij ijklmnop"]
    # Overlap comes from the piece before it had overlap itself.
    assert cut("aaaaaa bbbbbb cccccc", 10, 2, 5, (" ",)) == ["aaaaaa", "aa bbbbbb", "bb cccccc"]
    # Deeper levels add their own overlap before the outer ones do.
    assert cut("xxxxxxxx\n\naaaaaa bbbbbb", 10, 2, 5, ("\n\n", " ")) == ["xxxxxxxx", "xx aaaaaa", "aa aa bbbbbb"]


@pytest.mark.parametrize("seed", range(6))
def test_adding_up_words_equals_counting_them(seed):
    rng = random.Random(seed)
    pieces = ["\n## ", "\n### ", "\n\n", "\n", ". ", " ", "  ", "word", "a.", ". ", "Longer text here", "#", "\t"]
    text = "".join(rng.choice(pieces) for _ in range(900))

    class Recount(WordEstimate):
        def ruler(self, text):
            return lambda lo, hi: self.count(text[lo:hi])

    settings = ChunkSettings(40, 8, 6)
    assert Splitter(settings).split(text) == Splitter(settings, Recount()).split(text)


def test_chunk_documents_order_ids_and_prefixes(spark):
    long = " ".join(f"w{i}" for i in range(20)) + "\n\n" + " ".join(f"w{i}" for i in range(20, 90))
    bare = " ".join(f"v{i}" for i in range(70))
    sections = [(0, None, [], "S", 1, long, "S"), (1, 0, [0], "B", 2, " \n", "S > B"), (2, 0, [0], "C", 2, bare, "S > C")]
    docs = spark.createDataFrame(
        [("u", "T", "plain " * 200, sections, ["| a |", "| long table | with words | and more |"], "hash")],
        "url string, title string, plain_text string, sections array<struct<pos:int,parent_pos:int,ancestors:array<int>,"
        "heading:string,level:int,content:string,path:string>>, tables_markdown array<string>, content_hash string",
    )
    settings = ChunkSettings(80, 8, 8)
    rows = chunking.exploded_chunks(chunking.chunk_documents(docs, settings)).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    first = [r for r in rows if r["section_heading"] == "S"]
    assert first[0]["text"].startswith("[T] [S]\n\nw0 ") and len(first) == 3
    assert "[T]" not in first[1]["text"][:3] and [r["chunk_index"] for r in first] == [0, 1, 2]
    assert not [r for r in rows if r["section_heading"] == "B"]
    # The prefix is cut off as a short head of its own where the section does not split after it.
    assert [r["text"][:5] for r in rows if r["section_heading"] == "C"][0] == "v0 v1"
    plain = [r for r in rows if r["chunk_type"] == "plain"]
    assert plain and all(r["text"].startswith("[T]\n\nplain") for r in plain)
    assert plain[0]["token_count"] == WordEstimate().count(plain[0]["text"].removeprefix("[T]\n\n"))
    table = [r for r in rows if r["chunk_type"] == "table"]
    assert [r["table_index"] for r in table] == [1] and table[0]["text"].startswith("[Table from T]\n\n| long")
    import hashlib

    for r in rows:
        section = {"section": r["section_heading"], "plain": "plain"}.get(r["chunk_type"], f"table-{r['table_index']}")
        assert r["chunk_id"] == hashlib.sha256(f"u::{section}::{r['seq']}".encode()).hexdigest()[:16]


def test_repeated_ids_get_a_digest(spark):
    import hashlib

    md5 = hashlib.md5(b"three").hexdigest()[:8]
    rows = spark.createDataFrame([("a", "one", 0), ("b", "two", 1), ("a", "three", 2)], "chunk_id string, text string, seq int")
    assert {r["chunk_id"] for r in chunking.repair_chunk_ids(rows, "seq").collect()} == {"a", "b", "a" + md5}
    array = rows.orderBy("seq").agg(F.collect_list(F.struct("chunk_id", "text")).alias("c"))
    fixed = array.select(chunking.repaired_ids(F.col("c")).alias("c")).first()["c"]
    assert [c["chunk_id"] for c in fixed] == ["a", "b", "a" + md5]


# ---------------------------------------------------------------- trees


def tree_docs(spark, sections, chunks, description=""):
    data = [(i, None if p is None else p, a, h, level, c, h) for i, (p, a, h, level, c) in enumerate(sections)]
    return spark.createDataFrame(
        [("u", "T", description, data, chunks)],
        "url string, title string, description string, sections array<struct<pos:int,parent_pos:int,ancestors:array<int>,"
        "heading:string,level:int,content:string,path:string>>, chunks array<struct<chunk_id:string,section_heading:string>>",
    )


SECTIONS = [(None, [], "Rates", 1, "fixed rates"), (0, [0], "Fees", 2, ""), (0, [0], "Rates", 2, "r" * 300)]


def test_tree_building_navigation_and_outline(spark):
    chunks = [("c1", "Rates"), ("c2", "Fees"), ("c3", "Rates"), ("p", None)]
    trees = heading_tree.tree_nodes(tree_docs(spark, SECTIONS, chunks)).cache()
    tree = trees.first()
    assert [n["node_id"] for n in tree["nodes"]] == ["0001", "0002", "0003"]
    # Same-named nodes share their chunks; left-over chunks go to the first node only.
    assert [n["chunk_ids"] for n in tree["nodes"]] == [["c1", "c3", "p"], ["c2"], ["c1", "c3"]]
    assert tree["nodes"][1]["summary"] == "Fees" and len(tree["nodes"][2]["summary"]) == 200
    assert tree["summary"] == "Content from T"
    nodes = F.col("nodes")
    picked = trees.select(
        heading_tree.subtree_chunk_ids(nodes, "0002"), heading_tree.subtree_chunk_ids(nodes),
        heading_tree.subtree_chunk_ids(nodes, "0042"), heading_tree.find_node(nodes, "0003")["name"],
        heading_tree.find_node(nodes, "0042"), heading_tree.table_of_contents(),
    ).first()
    assert picked[0] == ["c2"] and picked[1] == ["c1", "c3", "p", "c2", "c1", "c3"] and picked[2] == []
    assert picked[3] == "Rates" and picked[4] is None
    assert picked[5].split("\n")[:6] == ["Document: T", "URL: u", "Summary: Content from T", "", "- [0001] Rates: fixed rates", "  - [0002] Fees: Fees"]
    back = heading_tree.flatten_trees(heading_tree.nested_json(trees))
    assert back.first() == tree
    ids = spark.createDataFrame([("c1",), ("zz",)], "chunk_id string")
    assert [r["chunk_id"] for r in heading_tree.unassigned_chunks(ids, trees).collect()] == ["zz"]


def test_page_without_headings_gets_one_general_node(spark):
    tree = heading_tree.tree_nodes(tree_docs(spark, [], [("p", None)], "about")).first()
    assert [(n["node_id"], n["name"], n["summary"], n["chunk_ids"]) for n in tree["nodes"]] == [("0001", "General Content", "about", ["p"])]
    assert heading_tree.tree_nodes(tree_docs(spark, [], [])).first()["nodes"] == []


def test_keyword_reasoning_order_and_repeats(spark):
    chunks = [("c1", "Rates"), ("c2", "Fees"), ("c3", "Rates")]
    trees = heading_tree.tree_nodes(tree_docs(spark, SECTIONS, chunks))
    got = heading_tree.relevant_chunks(trees, "fixed FIXED rates fees?", 5).orderBy("rank").collect()
    # Terms fixed, rates, fees? - punctuation counts, so "fees?" is not "fees".
    assert [(r["chunk_id"], r["rank"], round(r["score"], 6)) for r in got] == [("c1", 1, 0.666667), ("c3", 2, 0.666667)]
    assert heading_tree.relevant_chunks(trees, "fixed fees", 1).count() == 1
    assert heading_tree.relevant_chunks(trees, "  ", 5).count() == 0


# ---------------------------------------------------------------- state and cache


def test_change_and_orphans_and_rollup(spark):
    incoming = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "url string, content_hash string")
    state = spark.createDataFrame([("a", "1"), ("b", "0"), ("x", "9")], "url string, content_hash string")
    rows = {r["url"]: (r["is_new"], r["has_changed"]) for r in change_detection.with_change(incoming, state).collect()}
    assert rows == {"a": (False, False), "b": (False, True), "c": (True, True)}
    gone = {r["url"] for r in change_detection.orphans([state, incoming], incoming).collect()}
    assert gone == {"x"} and not gone & {"a", "b", "c"}
    details = spark.createDataFrame([("processed", 3, 30), ("cached", 9, 9), ("failed", 0, 0)], "status string, chunks int, tokens int")
    assert change_detection.rollup(details).first().asDict() == {
        "urls_processed": 1, "urls_skipped_cached": 1, "urls_failed": 1, "total_chunks": 3, "total_tokens": 30,
    }
    once = change_detection.upserted(state, incoming, "url")
    assert sorted(change_detection.upserted(once, incoming, "url").collect()) == sorted(once.collect())


def test_fingerprint_is_a_set_digest(spark):
    def fingerprint(*hashes):
        return content_fingerprint(spark.createDataFrame([(h,) for h in hashes], "content_hash string")).first()[0]

    assert fingerprint("a", "b", "c") == fingerprint("c", "a", "b", "b", None)
    assert fingerprint("a", "b") != fingerprint("a", "c") and fingerprint("a") != fingerprint("a", "b")


def test_a_store_refuses_another_number_of_buckets(spark, tmp_path):
    from gleanery.sources.keyed_table import KeyedTable

    path, rows = str(tmp_path / "t"), spark.createDataFrame([(f"u{i}", i) for i in range(30)], "url string, n long")
    KeyedTable(spark, path, "url string, n long", buckets=16).rewrite(rows)
    assert KeyedTable(spark, path, "url string, n long", buckets=16).read_key("u3").count() == 1
    with pytest.raises(ValueError, match="16 buckets"):
        KeyedTable(spark, path, "url string, n long", buckets=7).read().count()



def test_digests(spark):
    row = spark.createDataFrame([("  Hello ", 8, None)], "q string, k int, u string")
    import hashlib

    import xxhash

    got = row.select(query_key(F.col("q"), F.col("k"), F.col("u")), xxh128(F.col("q"))).first()
    assert got[0] == hashlib.sha256(b"hello||8||").hexdigest()[:20]
    assert got[1] == xxhash.xxh128_hexdigest("  Hello ".encode())


def cache_rows(spark, *rows):
    full = [
        (f"k{i}", r.get("query", "q"), r["v"], "a", "[]", r.get("fp", "fp"), r.get("k", 8), r.get("url", ""), r.get("at", 0.0), 0, 0.0)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, result_cache.CACHE_SCHEMA)


def usable(spark, cache, vector, top_k=8, url="", now=0.0):
    request = spark.createDataFrame([("r", vector, top_k, url)], "request_id string, request_vector array<float>, top_k int, url_filter string")
    best = result_cache.best_similar(cache, request)
    return [r["query_hash"] for r in result_cache.usable_similar(best, cache, request, F.lit("fp"), F.lit(now)).collect()]


def test_only_the_most_similar_entry_is_tried(spark):
    stale = {"v": [1.0, 0.0], "fp": "old"}
    good = {"v": [1.0, 0.05]}
    assert usable(spark, cache_rows(spark, good), [1.0, 0.0]) == ["k0"]
    assert usable(spark, cache_rows(spark, stale, good), [1.0, 0.0]) == []
    assert usable(spark, cache_rows(spark, {"v": [1.0, 1.0]}), [1.0, 0.0]) == []
    assert usable(spark, cache_rows(spark, good), [1.0, 0.0], top_k=9) == []
    assert usable(spark, cache_rows(spark, good), [1.0, 0.0], url="other") == []
    assert usable(spark, cache_rows(spark, good), [0.0, 0.0]) == []
    # Exactly as old as the time to live still counts.
    assert usable(spark, cache_rows(spark, good), [1.0, 0.0], now=86_400.0) == ["k0"]
    assert usable(spark, cache_rows(spark, good), [1.0, 0.0], now=86_400.5) == []


def test_store_hits_and_eviction(spark):
    cache = result_cache.with_hits(cache_rows(spark, {"v": [1.0], "query": "first"}, {"v": [2.0]}), ["k0"], 5.0)
    rows = {r["query_hash"]: r for r in cache.collect()}
    assert (rows["k0"]["hit_count"], rows["k0"]["last_hit_at"], rows["k1"]["hit_count"]) == (1, 5.0, 0)
    new = cache_rows(spark, {"v": [3.0], "query": "second", "at": 7.0})
    again = {r["query_hash"]: r for r in result_cache.stored(cache, new).collect()}
    assert (again["k0"]["query"], again["k0"]["hit_count"], again["k0"]["created_at"]) == ("first", 0, 7.0) and len(again) == 2
    assert [r["query_hash"] for r in result_cache.evicted(cache, 1).collect()] == ["k0"]
    stats = result_cache.statistics(cache).first()
    assert (stats["total_entries"], stats["total_hits"], stats["last_hit_at"]) == (2, 1, 5.0)
    assert result_cache.statistics(cache.limit(0)).first()["total_hits"] == 0


# ---------------------------------------------------------------- answers and sources


def test_decimals_round_like_exact_binary_values(spark):
    values = [0.2375, 0.2125, 0.5, 1 / 3, 0.0625, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(answers.decimals(F.col("v"), 3), answers.rounded(F.col("v"), 2)).collect()
    assert [r[0] for r in got] == [f"{v:.3f}" for v in values] and [r[1] for r in got] == [round(v, 2) for v in values]


def test_source_file_and_metadata(spark):
    urls = ["http://h/a/b.html", "http://h/a//", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(answers.source_file(F.col("u"))).collect()] == ["b.html", "a", "", ""]
    mixed = spark.createDataFrame([(["a", "b"], 1, None)], "l array<string>, n int, s string")
    assert change_detection.clean_metadata(mixed, ["l", "n", "s"]).first() == ("a, b", 1, None)
    text = spark.createDataFrame([('[{"chunk_id":"c","text":"t","score":0.5,"source":"vector"}]',)], "j string")
    source = text.select(answers.sources_from_json(F.col("j"))).first()[0][0]
    assert source["reranker_score"] == 0.5 and source["metadata"] == {}


def test_html_files_and_spread(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>A</title>\n<p>x")
    (tmp_path / "b.txt").write_text("no")
    rows = html_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["url"].endswith("a.html") and rows[0]["html"] == "<title>A</title>\n<p>x"
    small = spark.range(10)
    assert spread(small, "id").rdd.getNumPartitions() == small.rdd.getNumPartitions()
    spark.conf.set("spark.gleanery.inputPartitions", "3")
    try:
        assert spread(small, "id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.gleanery.inputPartitions")


def test_choice_among_more_trees_than_a_prompt_holds(spark):
    """The last url is the best of all; it comes first however many prompts there are, and whatever a few of them return."""
    import json
    import re

    from gleanery.config import TreeSettings
    from gleanery.operators import reasoning

    node = ("0001", 0, None, [], "N", "s", "", 1)
    rows = [(f"u{i:03}", "T", "s", [(*node, [f"c{i:03}"])]) for i in range(120)]
    trees = spark.createDataFrame(rows, f"url string, title string, summary string, nodes array<{heading_tree.NODE_TYPE}>")

    def last_first(most):
        def complete(prompt, system=None, max_tokens=0):
            urls = sorted(re.findall(r"URL: (\S+)", prompt), reverse=True)[:most]
            return "Here: " + json.dumps([{"url": u, "node_ids": ["0001"]} for u in urls]) + " That is all."

        return complete

    for size, most in ((50, 8), (7, 3), (200, 8)):
        found = reasoning.chosen_chunks(trees, "q", last_first(most), 8, TreeSettings(trees_per_prompt=size)).orderBy("rank").collect()
        assert [r["chunk_id"] for r in found] == [f"c{i}" for i in range(119, 119 - most, -1)]

    def fails(prompt, system=None, max_tokens=0):
        raise RuntimeError("down")

    assert reasoning.chosen_chunks(trees, "zzz", fails, 8).count() == 0


def test_later_page_of_a_url_stays(spark):
    from gleanery.plans.ingestion import latest_pages

    rows = [("u", 1.0, "b"), ("u", 3.0, "a"), ("u", None, "z"), ("v", None, None)]
    pages = spark.createDataFrame(rows, "url string, fetched_at double, content_hash string")
    assert sorted(latest_pages(pages).collect()) == [("u", 3.0, "a"), ("v", None, None)]


def test_punctuation_is_ascii_only(spark):
    text = spark.createDataFrame([(f"{string.punctuation}«café»",)], "t string")
    assert text.select(keyword_tokens(F.col("t"))).first()[0] == ["«café»"]


def test_work_per_document_is_linear(spark):
    """Tree nodes and id repair of one page with many headings and chunks: four times as many, some six times the time at most."""

    def seconds(n: int) -> float:
        numbers = F.sequence(F.lit(0), F.col("id").cast("int") + (n - 1))
        heading = lambda i: F.concat(F.lit("h"), i.cast("string"))
        docs = spark.range(1).select(
            F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("").alias("description"),
            F.transform(
                numbers,
                lambda i: F.struct(
                    i.alias("pos"), F.lit(None).cast("int").alias("parent_pos"), F.array().cast("array<int>").alias("ancestors"),
                    heading(i).alias("heading"), F.lit(1).alias("level"), F.lit("content").alias("content"), heading(i).alias("path"),
                ),
            ).alias("sections"),
            chunking.repaired_ids(
                F.transform(numbers, lambda i: F.struct(F.lit("same").alias("chunk_id"), heading(i).alias("section_heading"), heading(i).alias("text")))
            ).alias("chunks"),
        )
        started = time.perf_counter()
        nodes = heading_tree.tree_nodes(docs).selectExpr("nodes", "size(nodes) AS n").collect()[0]
        took = time.perf_counter() - started
        assert nodes["n"] == n and all(len(x["chunk_ids"]) == 1 for x in nodes["nodes"][1:])
        return took

    seconds(500)
    small = min(seconds(2_000) for _ in range(2))
    assert seconds(8_000) < 6 * small + 1.0


def test_nesting_of_many_headings_is_nearly_linear(spark):
    """Eight times the headings of a page take some eight times as long, not sixty-four."""

    def seconds(n: int) -> float:
        one = lambda i: F.struct(F.concat(F.lit("h"), i.cast("string")).alias("heading"), (i % 5 + 1).alias("level"), F.lit("x").alias("content"))
        page = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.col("id").cast("int") + n), one).alias("s"))
        started = time.perf_counter()
        assert page.select(F.size(structure.nested_sections(F.col("s")))).first()[0] == n
        return time.perf_counter() - started

    seconds(500)
    small = min(seconds(2_000) for _ in range(2))
    assert seconds(16_000) < 12 * small + 1.0


def test_template_blocks_against_brute_force(spark):
    """A hot host, small hosts, hosts at the edge of the share, pages without text, and blocks repeated within a page."""
    rng = random.Random(14)
    rows = []
    for host, n in (("hot.test", 60), ("edge.test", 6), ("small.test", 4), ("", 5)):
        for i in range(n):
            blocks = ["menu home about", *(f"text {rng.randrange(10**6)}" for _ in range(rng.randrange(4)))]
            blocks += ["half"] * (i % 2) + ["less"] * (3 * (i % 3 == 0)) + ["  ", "menu home about " * (i % 4 == 0)]
            rng.shuffle(blocks)
            rows.append((f"http://{host}/{i}" if host else f"no host {i}", "\n".join(blocks)))
    rows += [("http://hot.test/none", None), ("http://HOT.test/empty", "")]
    pages = spark.createDataFrame(rows, "url string, main_content string")
    split = {u: [b.strip() for b in (t or "").split("\n") if b.strip()] for u, t in rows}
    host = lambda u: u.split("://")[1].split("/")[0].lower() if "://" in u else ""
    want = {}
    for u, blocks in split.items():
        of_host = [set(b) for v, b in split.items() if host(v) == host(u)]
        common = lambda b: len(of_host) >= 5 and 1 < (n := sum(b in x for x in of_host)) and n >= 0.5 * len(of_host)
        want[u] = [b for b in blocks if not common(b)]
    for r in templates.without_templates(pages).collect():
        blocks = want[r["url"]]
        assert r["n_dropped"] == len(split[r["url"]]) - len(blocks)
        assert r["main_text"] == (None if r["main_content"] is None else "\n".join(blocks))
    found = {(r["host"], r["block"]) for r in templates.template_blocks(pages).collect()}
    assert ("hot.test", "menu home about") in found and ("edge.test", "half") in found and not any(h == "small.test" for h, _ in found)
