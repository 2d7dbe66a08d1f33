"""Vector codes, fill-in-the-middle and language identification against brute force, and on odd rows."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from gleanery.llm import fill_middle, language_id, vector_codes  # noqa: E402

LINE = re.compile(r"[^\n]*\n|[^\n]+")


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label) in any order; the same rule with plain loops over all entries."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def assign(p):
        d = ((cut[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = assign(p)
            books[p] = [cut[at == e, p].sum(axis=0) // (at == e).sum() if (at == e).any() else books[p][e] for e in range(len(books[p]))]
    found = [assign(p) for p in range(parts)]
    codes = ["".join(f"{found[p][0][i]:02x}" for p in range(parts)) for i in range(len(kept))]
    errors = [int(sum(found[p][1][i] for p in range(parts))) for i in range(len(kept))]
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((r[0], c, e, sums[r[2]], digest) for r, c, e in zip(kept, codes, errors)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [40, 700])
def test_codes_equal_a_search_over_all_entries(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, 16))
    rows = []
    for i in range(n):
        v = (centres[rng.integers(9)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.6])).astype(np.float32).tolist()
        rows.append((i * 3 % n if i % 50 else i, v, None if i % 7 == 0 else int(rng.integers(3))))
    rows += [(5, None, 1), (6, [float("nan")] + [0.0] * 15, 1), (7, [None] + [0.0] * 15, 1), (8, [float("-inf")] + [0.0] * 15, 1)]
    rows += [(None, rows[0][1], 2), (None, rows[1][1], 2), (rows[3][0], rows[3][1], rows[3][2])]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS code", "'x' AS ints", "2 AS n").repartition(5)
    found = vector_codes.compressed(frame)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()), key=str)
    assert got == brute_codes(rows)


def test_bounds_skip_entries_and_lose_none():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, size=(256, 16))
    rows = centres[rng.integers(256, size=2000)] + rng.integers(-60, 60, size=(2000, 16))
    pivots = vector_codes.choose_pivots(centres)
    at, best, evaluated = vector_codes.nearest_entries(rows, vector_codes.pivot_distances(rows, pivots), centres, pivots)
    every = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < 0.2 * every.size


def test_ties_go_to_the_lower_entry():
    entries = np.array([[4, 0], [0, 0], [4, 0], [0, 0]])
    rows = np.array([[2, 0], [4, 0], [0, 0], [2, 5]])
    at, best, _ = vector_codes.nearest_entries(rows, vector_codes.pivot_distances(rows, entries[:1]), entries, entries[:1])
    assert at.tolist() == [0, 0, 1, 0] and best.tolist() == [4, 0, 0, 29]


def test_codes_of_odd_vectors(spark):
    empty = vector_codes.compressed(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [], None), (2, [1.0], None), (3, [1e30, -1e30, 0.5, 0.5, 0.25], 1)]
    found = {r["vec_id"]: r for r in vector_codes.compressed(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {k: r["error"] for k, r in found.items()} == {1: 0, 2: 0, 3: 0}


def test_codes_decode_to_their_entries(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-4, 4, 8).astype(float).tolist(), 0) for i in range(60)]
    kept = spark.createDataFrame(rows, VECTORS).selectExpr("vec_id", "'' AS label_key", "embedding").withColumn("ints", vector_codes.integers(F.col("embedding")))
    books = vector_codes.first_codebooks(kept)
    codes = vector_codes.coded(vector_codes.with_pivots(kept, books), books)
    # Every vector is in the first codebook, so nothing is lost.
    assert {r["vec_id"]: r["vector"] for r in vector_codes.decoded(codes, books).collect()} == {i: v for i, v, _ in rows}


# ---------------------------------------------------------------- fill-in-the-middle


def brute_filled(doc_id, text, moved=100, spm=50):
    text = text or ""
    lines = LINE.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= moved:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    letters = "abc é語😀<\r "
    rows = [(i, "".join(rng.choice(letters + "\n" * rng.randrange(4)) for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "\n"), (303, "one"), (304, "a <S> b\nc\n"), (305, "\n\n\n\n"), (306, "x<P\n>y\n<\nS>")]
    rows += [(307, "".join("é" * rng.randrange(3000) + "\n" for _ in range(400))), (None, "no\nid\nhere"), (None, "no\nid\nhere"), (7, "same\nid\n")]
    rows.append((308, "wörd " * 50_000 + "\nend"))
    return rows


@pytest.mark.parametrize("shares", [fill_middle.Shares(), fill_middle.Shares(7, 60, 0)])
def test_filled_texts_equal_cut_lines(spark, texts, shares):
    frame = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n", "'q' AS form", "'r' AS row", "2 AS index", "3 AS output")
    found = fill_middle.filled(frame, shares).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    rows = found.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_filled(r["doc_id"], r["text"], shares.moved, shares.spm)
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in rows} == ({"plain", "psm", "spm"} if shares.spm else {"plain", "psm"})


def test_every_cut_of_the_index_is_exact(spark, texts):
    some = [t for t in texts if t[1] and len(t[1]) < 100_000]
    index = fill_middle.boundary_index(spark.createDataFrame(some, "doc_id long, text string"))
    rows = index.select("row.text", "index", F.explode(F.sequence(F.lit(0).cast("long"), "index.n")).alias("k"))
    wrong = [
        r
        for r in rows.select("text", "k", fill_middle.cut_offset(F.col("index"), F.col("k")).alias("at")).collect()
        if r["at"] != sum(map(len, LINE.findall(r["text"])[: r["k"]]))
    ]
    assert not wrong


def test_residuals_stay_within_the_error():
    rng = np.random.default_rng(2)
    for widths in (rng.integers(1, 90, 5000), rng.integers(1, 5000, 300), np.r_[np.full(3000, 40), 10**6, np.full(3000, 3)], []):
        offsets = np.r_[0, np.cumsum(widths)].astype(np.int64)
        first, base, slope, residuals = fill_middle.fit_segments(offsets)
        assert np.abs(residuals).max() <= fill_middle.ERROR
        at = np.searchsorted(first, np.arange(len(offsets)), "right") - 1
        predicted = np.array(base)[at] + np.floor(np.array(slope)[at] * (np.arange(len(offsets)) - np.array(first)[at])).astype(np.int64)
        assert (predicted + residuals == offsets).all()
    regular = np.arange(0, 40 * 10_000, 40)
    assert len(fill_middle.fit_segments(regular)[0]) == 1


def test_filled_empty_table(spark):
    assert fill_middle.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---------------------------------------------------------------- languages


def invented(rng, lang, n):
    """Words of syllables that differ by language."""
    parts = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ein", "ver", "ich"], "cc": ["é", "eau", "que", "ç", "oi"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    rows = [(i, invented(rng, lang := rng.choice(["aa", "bb", "cc"]), rng.randrange(3, 80)).upper() if i % 9 == 0 else invented(rng, lang, 30), lang) for i in range(400)]
    odd = [(400, None, "aa"), (401, "", "aa"), (402, "12 34 !?", "bb"), (403, "語語語", None), (404, "ka lo mi", None), (None, "ein schung", "bb"), (None, "ein schung", "bb")]
    return rows + odd


def test_languages_of_held_out_texts(spark, spoken):
    frame = spark.createDataFrame(spoken, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS best", "'x' AS h", "3 AS n")
    found = language_id.languages(frame)
    rows = found.collect()
    assert len(rows) == len(spoken) and found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {i: x for i, _, x in spoken}
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(held) > 50 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (400, 401, 402))
    assert by_id[403]["lang_pred"] in {"aa", "bb", "cc"} and by_id[403]["rejected"]
    assert by_id[404]["lang_pred"] == "aa" and by_id[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learning_never_sees_the_held_out_fold(spark, spoken):
    frame = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    other = frame.withColumn("lang", F.when(language_id.is_held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    before, after = (sorted(map(str, language_id.languages(f).collect())) for f in (frame, other))
    assert before == after


def test_scores_equal_dense_vectors(spark, spoken):
    """Counts, weights and cosines again, with dictionaries instead of blocks of arrays."""
    frame = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    model = language_id.fitted(frame)
    centroids = {r["lang"]: np.frombuffer(r["centroids"], np.float32).reshape(-1, language_id.DIMENSION) for r in model.table.collect()}
    train = [t for i, t, x in spoken if x and t and re.search(r"[^\W\d_]", t) and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]

    def grams(text):
        data = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()) + b" "
        out = {}
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                if data[i : i + 2] != b"  ":
                    key = int.from_bytes(data[i : i + n], "big")
                    mixed = ((key ^ (n << 40)) * 0x9E3779B97F4A7C15) & (2**64 - 1)
                    bucket = (((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)) >> (64 - language_id.BITS)
                    out[bucket] = out.get(bucket, 0) + 1
        return out

    seen = {}
    for t in train:
        for b in grams(t):
            seen[b] = seen.get(b, 0) + 1
    idf = np.array([np.log((1 + len(train)) / (1 + seen.get(b, 0))) for b in range(language_id.DIMENSION)])
    assert np.allclose(idf, model.idf, atol=1e-5)
    rows = {r["doc_id"]: r for r in language_id.identified(frame.select("doc_id", "text"), model).collect() if r["doc_id"] is not None}
    for i, t, _ in [r for r in spoken[::7] if r[0] is not None]:
        v = np.zeros(language_id.DIMENSION)
        for b, c in grams(t or "").items():
            v[b] = np.log1p(c) * idf[b]
        v /= max(np.linalg.norm(v), 1e-12)
        best = max(float((c @ v).max()) for c in centroids.values())
        if rows[i]["lang_pred"] != "und":
            assert abs(rows[i]["score"] - best) < 1e-4


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("kaloémi tu, " * 400).encode()
    whole = language_id.counts([text, b"x", text])
    monkeypatch.setattr(language_id, "PIECE", 97)
    assert (language_id.counts([text, b"x", text]) == whole).all() and (whole[0] == whole[2]).all()


def test_languages_without_training_rows(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.languages(spark.createDataFrame([], schema)).collect() == []
    rows = language_id.languages(spark.createDataFrame([(1, "some text", None)], schema)).collect()
    assert rows[0]["lang_pred"] == "und" and rows[0]["score"] == 0.0


def test_more_languages_than_one_pass_holds(spark, spoken, monkeypatch):
    frame = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    once = sorted(map(str, language_id.languages(frame).collect()))
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    assert sorted(map(str, language_id.languages(frame).collect())) == once


def test_counts_of_null_and_sliced_columns():
    column = pa.array(["ab", None, "cd ef", ""])
    found = np.concatenate([c for _, c in language_id._blocks(column.slice(1, 3))])
    assert found.shape[0] == 3 and not found[0].any() and found[1].any() and not found[2].any()
