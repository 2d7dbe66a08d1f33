"""The stored indexes against exact answers, and what their plans read."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.operators import ann_index, bm25, posting_blocks, trigram_index, vector_search
from gleanery.operators.ann_index import AnnIndex, AnnSettings
from gleanery.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def clustered(spark):
    """1,500 vectors around 30 centres, some equal, one crowded centre, two without a vector."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(30, 20))
    rows = [(i, (centres[0 if i % 3 == 0 else rng.integers(30)] + rng.normal(size=20) * 0.3).astype(np.float32).tolist(), i % 5) for i in range(1500)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(20)] + [(3000, None, 1), (3001, None, 2)]
    return spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_ann_recall(spark, clustered, tmp_path, metric):
    index = AnnIndex.build(clustered, str(tmp_path / "index"), "vec_id", "embedding", metric, AnnSettings(cells=24, parts=8, probes=6))
    asked = clustered.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = vector_search.search_many(clustered, asked, 10, metric, "vec_id")
    found = index.search_many(asked, 10).cache()
    got = ann_index.recall(found, exact).agg(F.avg("recall"), F.min("recall")).first()
    assert got[0] >= 0.95
    # What is found carries its exact distance, and one question gives what the table of questions gives.
    both = found.join(exact.withColumnRenamed("distance", "d"), ["query_id", "id"])
    assert both.where("abs(distance - d) > 1e-6").count() == 0
    vector = asked.where("query_id = 50").first()["query_vector"]
    one = [(r["id"], round(r["distance"], 6)) for r in index.search(vector, 10).collect()]
    many = [(r["id"], round(r["distance"], 6)) for r in found.where("query_id = 50").orderBy("rank").collect()]
    assert one == many


def test_ann_is_exact_with_all_cells_and_candidates(spark, clustered, tmp_path):
    index = AnnIndex.build(clustered, str(tmp_path / "index"), "vec_id", settings=AnnSettings(cells=9, probes=9, refine=1000))
    question = clustered.where("vec_id = 7").first()["embedding"]
    want = [(r["vec_id"], r["distance"]) for r in vector_search.search(clustered, question, 30, id_col="vec_id").collect()]
    assert [(r["id"], r["distance"]) for r in index.search(question, 30).collect()] == want


def test_ann_reads_only_the_probed_cells(spark, clustered, tmp_path):
    index = AnnIndex.build(clustered, str(tmp_path / "index"), "vec_id", settings=AnnSettings(cells=16, parts=4))
    question = clustered.where("vec_id = 7").first()["embedding"]
    cells = index.quantiser.cell_order(np.array([question]))[0][:3].tolist()
    near = index.estimated(question, cells)
    plan = plan_of(near)
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert "ReadSchema: struct<id:int,code:binary>" in plan
    assert {r["cell"] for r in near.select("cell").distinct().collect()} == set(cells)
    assert len({f.split("cell=")[1].split("/")[0] for f in index.rows().inputFiles()}) == 16


def test_ann_goes_on_until_enough_rows_fit_a_filter(spark, clustered, tmp_path):
    index = AnnIndex.build(clustered, str(tmp_path / "index"), "vec_id", settings=AnnSettings(cells=40, probes=1, refine=100), keep=("label",))
    question = clustered.where("vec_id = 7").first()["embedding"]
    found = [r["id"] for r in index.search(question, 250, F.col("label") == 3).collect()]
    assert len(found) == 250 and all(i % 5 == 3 for i in found)


def test_ann_append_and_reload(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    half = clustered.where("vec_id % 2 = 0")
    AnnIndex.build(half, path, "vec_id", settings=AnnSettings(cells=12)).append(clustered.where("vec_id % 2 = 1"), "vec_id")
    index = AnnIndex(spark, path, AnnSettings(probes=12))
    assert index.rows().count() == clustered.where("embedding is not null").count()
    question = clustered.where("vec_id = 7").first()["embedding"]
    assert index.search(question, 1).first()["id"] == 7


def test_ann_refuses_what_it_cannot_index(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "vec_id int, embedding array<float>")
    with pytest.raises(ValueError):
        AnnIndex.build(empty, str(tmp_path / "a"), "vec_id")


def test_ann_of_few_and_equal_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, 0.0, 2.0]) for i in range(5)], "vec_id int, embedding array<double>")
    index = AnnIndex.build(rows, str(tmp_path / "a"), "vec_id")
    assert [r["id"] for r in index.search([1.0, 0.0, 2.0], 3).collect()] == [0, 1, 2]
    asked = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, None)], "query_id int, query_vector array<double>")
    assert [(r["query_id"], r["id"]) for r in index.search_many(asked, 2).orderBy("rank").collect()] == [(1, 0), (1, 1)]


# ---------------------------------------------------------------- postings in blocks


@pytest.fixture(scope="module")
def worded(spark):
    """700 documents of mixed lengths over a skewed vocabulary; one word is in all of them, some texts are equal or empty."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(f"d{i}", f"s{i % 4}", " ".join(["common", *rng.choices(words, weights, k=rng.choice([2, 5, 20, 150, 600]))])) for i in range(690)]
    rows += [(f"e{i}", "s1", rows[3][2]) for i in range(8)] + [("f1", "s1", ""), ("f2", "s1", None)]
    return spark.createDataFrame(rows, "chunk_id string, source_url string, text string").cache()


def test_block_answers_are_those_of_a_full_scan(spark, worded, tmp_path, monkeypatch):
    monkeypatch.setattr(posting_blocks, "RANGE_DOCS", 8)
    tokens = bm25.with_tokens(worded).cache()
    index = posting_blocks.PostingBlocks.build(tokens, str(tmp_path / "blocks"), ["chunk_id", "source_url"])
    rng = random.Random(10)
    questions = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 5))) for _ in range(2)]
    questions += ["w1 w1 w2", "common", "common w250", "w0 common w299", "nothing here", "w3"]
    skipped = {}
    for i, question in enumerate(questions):
        where = F.col("source_url") == "s1" if i % 2 else None
        want = bm25.top_hits(bm25.score_texts(tokens, question), 6, where).collect()
        found = index.search(question, 6, where, ("chunk_id", "source_url"))
        got = found.hits.orderBy(F.desc("score"), "chunk_id").collect()
        assert [(r["chunk_id"], round(r["score"], 9)) for r in got] == [(r["chunk_id"], round(r["score"], 9)) for r in want], question
        skipped[question] = (found.read, found.ranges)
    read, ranges = skipped["w3"]
    assert ranges > 40 and read < ranges / 2
    assert index.search("the of", 5).hits.collect() == []


def test_block_bounds_hold_for_every_document(spark, worded, tmp_path, monkeypatch):
    monkeypatch.setattr(posting_blocks, "LENGTH_CLASSES", 4)
    tokens = bm25.with_tokens(worded)
    index = posting_blocks.PostingBlocks.build(tokens, str(tmp_path / "blocks"), ["chunk_id"])
    question = "w140 w20"
    bounds = {r["range"]: r["bound"] for r in index.heads(question).collect()}
    for number, bound in bounds.items():
        assert index.scores(question, [number], ["chunk_id"]).agg(F.max("score")).first()[0] <= bound + 1e-9
    total = sum(index.scores(question, [n], ["chunk_id"]).count() for n in bounds)
    assert total == tokens.where(F.arrays_overlap("tokens", F.array(F.lit("w140"), F.lit("w20")))).count()


def test_blocks_of_a_question_are_found_by_term_and_range(spark, worded, tmp_path):
    index = posting_blocks.PostingBlocks.build(bm25.with_tokens(worded), str(tmp_path / "blocks"), ["chunk_id"])
    plan = plan_of(index.heads("w1 w2"))
    assert "PushedFilters: [In(term" in plan and "postings" not in plan.split("Physical Plan")[1]
    plan = plan_of(index.scores("w1 w2", [1, 2, 3], ["chunk_id"]))
    assert "In(range, [1,2,3])" in plan


def test_terms_are_counted_where_the_text_is(spark, worded):
    """Distinct terms and their numbers row by row, without an exchange; rows without tokens stay."""
    rows = bm25.with_tokens(worded)
    counted = bm25.counted(rows, ["chunk_id"])
    assert "Exchange" not in plan_of(counted).split("Physical Plan")[1]
    want = {r["chunk_id"]: r["tokens"] for r in rows.collect()}
    got = {r["chunk_id"]: (r["dl"], dict(zip(r["terms"], r["tfs"]))) for r in counted.collect()}
    assert got == {i: (len(t), {w: t.count(w) for w in set(t)}) for i, t in want.items()}


def test_blocks_of_runs_are_those_of_all_postings(spark, worded, monkeypatch):
    """Only counts move, to their range; rows of the same keys and length are one document; runs of few postings change nothing."""
    monkeypatch.setattr(posting_blocks, "RUN_POSTINGS", 500)
    monkeypatch.setattr(posting_blocks, "BATCH_POSTINGS", 50)
    doubled = worded.unionByName(worded.where("chunk_id IN ('d1', 'd2', 'f1')")).withColumn("chunk_id", F.expr("CASE WHEN chunk_id = 'd5' THEN null ELSE chunk_id END"))
    tokens = bm25.with_tokens(doubled)
    blocks = posting_blocks.blocks_of(bm25.counted(tokens, ["chunk_id"]), tokens.select("chunk_id", F.size("tokens").alias("dl")), ["chunk_id"])
    assert plan_of(blocks).split("Physical Plan")[1].count("Exchange hashpartitioning") == 1
    found = blocks.collect()
    assert len({(r["term"], r["range"]) for r in found}) == len(found)
    for r in found:
        assert r["n"] == len(r["postings"]) and r["max_tf"] == max(p["tf"] for p in r["postings"]) and r["min_dl"] == min(p["dl"] for p in r["postings"])
    got = sorted((str(p["chunk_id"]), p["dl"], r["term"], p["tf"]) for r in found for p in r["postings"])
    assert got == sorted((str(r["chunk_id"]), r["dl"], r["term"], r["tf"]) for r in bm25.postings(tokens, ["chunk_id"]).collect())


def test_postings_of_a_question_from_counted_rows(spark, worded):
    """Only the question's terms are taken from the counts; rows of the same keys and length are one document."""
    tokens = bm25.with_tokens(worded.unionByName(worded.where("chunk_id IN ('d1', 'd2')")))
    rows = bm25.postings_of(bm25.counted(tokens, ["chunk_id"]), ["chunk_id"], ["w1", "common", "not there"])
    want = bm25.postings(tokens, ["chunk_id"]).where("term IN ('w1', 'common')")
    columns = ("chunk_id", "dl", "term", "tf")
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_the_index_query_tokenises_once(spark, monkeypatch):
    calls = []
    real = catalogue._tokens
    monkeypatch.setattr(catalogue, "_tokens", lambda *a: (calls.append(a), real(*a))[1])
    found = catalogue.bm25_index_topk(spark, DATA)
    plan = plan_of(found)
    assert len(calls) == 1 and "documents.parquet" not in plan and "translate(" not in plan
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in catalogue.bm25_topk(spark, DATA).collect()]


# ---------------------------------------------------------------- trigrams


def test_trigram_answers_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigram_index, "PART_DOCS", 40)
    rng = random.Random(3)
    rows = [(f"t{i}", "".join(rng.choice("abcé語 ") for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [("none", None), ("short", "ab"), ("needle", "x needle in a stack"), ("again", "needle needle"), ("parts", "need edle le need")]
    docs = spark.createDataFrame(rows, "chunk_id string, text string")
    index = trigram_index.TrigramIndex.build(docs, str(tmp_path / "trigrams"))
    for needle in ("needle", "abc", "c é", "語a", "ab", "", "ééé", "not there at all", "a%c", "need"):
        got = sorted(r["id"] for r in index.containing(needle).collect())
        assert got == sorted(i for i, t in rows if t is not None and needle in t), needle
    # All of the needle's trigrams, not in its order: a candidate that the test on the text turns down.
    assert {r["id"] for r in index.candidates("needle").collect()} == {"needle", "again", "parts"}


def test_trigrams_read_only_the_parts_with_candidates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigram_index, "PART_DOCS", 10)
    docs = spark.createDataFrame([(i, f"text number {i} of some") for i in range(200)], "chunk_id int, text string")
    index = trigram_index.TrigramIndex.build(docs, str(tmp_path / "trigrams"))
    found = index.containing("number 117 of")
    assert [r["id"] for r in found.collect()] == [117]
    plan = plan_of(found)
    assert "PartitionFilters: [part" in plan or "PartitionFilters: [isnotnull(part" in plan
    parts = {r["part"] for r in index.candidates("number 117 of").collect()}
    assert len(parts) <= 2 and len({f.split("part=")[1].split("/")[0] for f in index.texts().inputFiles()}) == 20


def test_trigrams_of_a_slice_are_those_of_each_text():
    texts = ["", "ab", "abc", "abcabc", "語a\U0001f600語a\U0001f600", "aaaa", "\x00\x00\x00", "x" * 5 + "ab"]
    codes, places = trigram_index.trigrams(pa.array(texts))
    want = {(trigram_index.trigram_code(t[i : i + 3]), n) for n, t in enumerate(texts) for i in range(len(t) - 2)}
    assert list(zip(codes.tolist(), places.tolist())) == sorted(want)


def test_trigram_pairs_stay_in_the_task_that_read_the_text(spark, tmp_path, monkeypatch):
    """A part is listed in runs of a bounded number of pairs: no block grows with a trigram's frequency, and no pair is shuffled."""
    sizes = []
    listed = trigram_index._Run.blocks
    monkeypatch.setattr(trigram_index._Run, "blocks", lambda run: (sizes.append(run.pairs), listed(run))[1])
    monkeypatch.setattr(trigram_index, "RUN_PAIRS", 100)
    monkeypatch.setattr(trigram_index, "TaskContext", type("T", (), {"get": lambda: type("C", (), {"partitionId": lambda self: 3})()}))
    texts = [f"common words and number {i}" for i in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i // 500 for i in range(1_000)], pa.int32()), pa.array(range(1_000)), pa.array(texts)], names=["part", "id", "text"])
    rows = [r for b in trigram_index._blocks(iter([batch])) for r in b.to_pylist()]
    assert len(sizes) == 4 and sum(sizes) == sum(len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts)
    common = [r for r in rows if r["trigram"] == trigram_index.trigram_code("com")]
    assert sorted(i for r in common for i in r["ids"]) == list(range(1_000)) and max(r["n"] for r in common) <= 256
    assert len({(r["part"], r["run"]) for r in common}) == len(common) == 4 and all(r["run"] >> 32 == 3 for r in common)
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    index = trigram_index.TrigramIndex.build(docs, str(tmp_path / "trigrams"))
    assert [r["id"] for r in index.containing("number 117").collect()] == [117]
    assert index.candidates("common").count() == 1_000
