"""Language identification by the nearest of several centroids per language, over normalised TF-IDF vectors of byte n-grams.

A text is lower-cased, its ASCII characters other than letters become blanks, and every run of 2 to 4 bytes of its UTF-8 falls
into one of `DIMENSION` buckets by hash. A vector has log(1 + count) times the bucket's inverse document frequency, scaled to
length one. Of each language at most `SAMPLE` training rows, those with the smallest hash of their text and id, are clustered by
spherical k-means into `CENTROIDS` centroids, whose radius is the largest cosine distance of a row to its centroid. A text gets
the language of the centroid with the largest cosine; farther away than `REACH` radii it is `rejected`.

Scale: document frequencies are counted over all training texts, summed per task (at most `DIMENSION` numbers each). The bounded
sample of a language is one group; which rows are in it is settled by counts per language and a threshold on the hash, without a
sort of a language's rows. Scoring is one pass over (text): a task holds the centroids of at most `LANGUAGES` languages, and of
more languages the next ones are compared in a further pass. Texts are worked off in pieces, so memory follows `PIECE`.

Defined results: `lang_pred` is `und` where the text is null or has no letter, and where no language could be learned; score is 0
then. A letter is what Unicode calls one. A text with letters always gets a learned language (ties: the first by code point),
rejected or not. Rows without doc_id are never held out. Repeated rows count as often as they occur. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanery.llm.staging import fresh, hash60, join_counted, staged

BITS = 13
DIMENSION = 1 << BITS
SIZES = (2, 3, 4)
CENTROIDS = 4
SAMPLE = 1000
REACH = 1.25
ITERATIONS = 10
LANGUAGES = 256
UNKNOWN = "und"
#: Bytes of text hashed at once, and rows whose counts are held at once.
PIECE = 1 << 19
ROWS = 64

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def _count(values: np.ndarray, row: np.ndarray, limit: int, out: np.ndarray) -> None:
    """Add the n-grams that begin in the first `limit` bytes; those that leave their row or begin with two blanks don't count."""
    wide = values.astype(np.uint64)
    key = wide.copy()
    flat = out.reshape(-1)
    for n in range(2, max(SIZES) + 1):
        if len(values) < n:
            break
        key = (key[: len(values) - n + 1] << np.uint64(8)) | wide[n - 1 :]
        if n not in SIZES:
            continue
        with np.errstate(over="ignore"):
            mixed = (key ^ np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        starts = np.arange(len(key)) < limit
        inside = starts & (row[: len(key)] == row[n - 1 :]) & ((values[: len(key)] != 32) | (values[1 : len(key) + 1] != 32))
        where = row[: len(key)][inside].astype(np.int64) * DIMENSION + bucket[inside].astype(np.int64)
        flat += np.bincount(where, minlength=len(flat)).astype(np.float32)


def counts(texts: list[bytes]) -> np.ndarray:
    """texts x DIMENSION: how often the n-grams of each bucket occur in each text."""
    out = np.zeros((len(texts), DIMENSION), np.float32)
    # One blank before and after each text.
    whole = [b" " + t + b" " for t in texts]
    step, held, owners, size = PIECE, [], [], 0

    def flush() -> None:
        if held:
            values = _LETTER[np.frombuffer(b"".join(held), np.uint8)]
            _count(values, np.repeat(np.array(owners, np.int32), [len(h) for h in held]), len(values), out)

    for i, text in enumerate(whole):
        if len(text) > step:
            for start in range(0, len(text), step):
                values = _LETTER[np.frombuffer(text, np.uint8, min(len(text) - start, step + max(SIZES) - 1), start)]
                one = out[i : i + 1]
                _count(values, np.zeros(len(values), np.int32), step, one)
            continue
        if size + len(text) > step:
            flush()
            held, owners, size = [], [], 0
        held.append(text)
        owners.append(i)
        size += len(text)
    flush()
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Position of the first row and the counts of every block of rows; null counts as empty."""
    for start in range(0, len(column), ROWS):
        part = pc.utf8_lower(column.slice(start, ROWS).fill_null("")).cast(pa.large_binary())
        yield start, counts(part.to_pylist())


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one (zero where nothing was found)."""
    rows = np.log1p(found) * idf
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def training_rows(docs: DataFrame) -> DataFrame:
    """lang, text of the rows that may be learned from."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = docs.where(~is_held_out(F.col("doc_id")) & lang.isNotNull() & has_letter(text))
    return rows.select(lang.alias("lang"), text.alias("text"), hash60(F.xxhash64(text), F.col("doc_id")).alias("h"))


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Texts that have an n-gram of each bucket, and in the last place the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSION + 1, np.int64)
        for batch in batches:
            for _, found in _blocks(batch.column(0)):
                total[:-1] += (found > 0).sum(axis=0)
                total[-1] += len(found)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(DIMENSION + 1, np.int64)
    summed = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def sample_of_each(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, text of the `sample` rows of each language with the smallest hashes."""
    sizes = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    total = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    # Hashes are spread evenly over 60 bits: twice the share that is needed, and some, leaves few rows of each language.
    limit = F.least(F.lit(1.0), F.lit(2.0 * sample + 50) / F.col("n")) * float(1 << 60)
    near = join_counted(rows, sizes.select("lang", "n", limit.alias("limit")), "lang", "n", total)
    near = near.where(F.col("h") < F.col("limit"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).select("lang", "text")


def cluster(rows: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one and their radii. They begin at the row nearest the mean, then always at the row farthest from those chosen."""
    rows = rows[rows.any(axis=1)]
    if not len(rows):
        return np.zeros((0, rows.shape[1]), np.float32), np.zeros(0, np.float32)
    centres = [rows[int((rows @ rows.mean(axis=0)).argmax())]]
    near = rows @ centres[0]
    while len(centres) < min(k, len(rows)) and near.min() < 0.999:
        centres.append(rows[int(near.argmin())])
        near = np.maximum(near, rows @ centres[-1])
    centres = np.stack(centres)
    for _ in range(ITERATIONS):
        own = (rows @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                mean = rows[own == i].sum(axis=0)
                centres[i] = mean / np.sqrt(mean @ mean)
    cosines = rows @ centres.T
    own, best = cosines.argmax(axis=1), cosines.max(axis=1)
    radii = np.array([(1 - best[own == i]).max() if (own == i).any() else 0.0 for i in range(len(centres))], np.float32)
    return centres, radii


@dataclass
class Model:
    """languages in the order of their code points; the table has lang, centroids and radii as bytes; idf of the buckets."""

    languages: list[str]
    table: DataFrame
    idf: np.ndarray


def fitted(docs: DataFrame) -> Model:
    rows = training_rows(docs)
    frequencies = document_frequencies(rows)
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])).astype(np.float32)

    def run(group: pa.Table) -> pa.Table:
        vectors = [weighted(found, idf) for _, found in _blocks(group.column("text").combine_chunks())]
        centres, radii = cluster(np.concatenate(vectors))
        lang = group.column("lang").slice(0, 1).combine_chunks()
        return pa.Table.from_arrays(
            [lang, pa.array([centres.astype(np.float32).tobytes()], pa.binary()), pa.array([radii.astype(np.float32).tobytes()], pa.binary())],
            names=["lang", "centroids", "radii"],
        )

    found = sample_of_each(rows).groupBy("lang").applyInArrow(run, "lang string, centroids binary, radii binary")
    table = staged(found.where(F.length("centroids") > 0), "centroids")
    return Model(sorted(r[0] for r in table.select("lang").collect()), table, idf)


BEST = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("lang", T.StringType()), T.StructField("rejected", T.BooleanType())])


def _nearest(model: Model, languages: list[str]):
    """An Arrow function: score, language and rejection of a text by the nearest centroid of these languages."""
    rows = {r["lang"]: r for r in model.table.where(F.col("lang").isin(languages)).collect()}
    centres = [np.frombuffer(rows[lang]["centroids"], np.float32).reshape(-1, DIMENSION) for lang in languages]
    owner = np.repeat(np.arange(len(languages)), [len(c) for c in centres])
    matrix = np.concatenate(centres)
    radii = np.concatenate([np.frombuffer(rows[lang]["radii"], np.float32) for lang in languages])
    idf = model.idf

    @F.arrow_udf(BEST)
    def nearest(text: pa.Array) -> pa.Array:
        scores, names, rejected = [], [], []
        for _, found in _blocks(text):
            cosines = weighted(found, idf) @ matrix.T
            # The first of equal ones: languages are in order.
            at = cosines.argmax(axis=1)
            best = np.clip(cosines[np.arange(len(at)), at], 0.0, 1.0).astype(np.float64)
            scores.append(best)
            names += [languages[i] for i in owner[at]]
            rejected.append(1 - best > REACH * radii[at])
        every = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.StructArray.from_arrays(
            [pa.array(every(scores, float)), pa.array(names, pa.string()), pa.array(every(rejected, bool))], names=["score", "lang", "rejected"]
        )

    return nearest


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected (names that are taken get an underscore)."""
    best, letters = fresh(docs.columns, "best"), has_letter(F.col("text").cast("string"))
    text = F.col("text").cast("string")
    rows = docs
    for start in range(0, len(model.languages), LANGUAGES):
        found = _nearest(model, model.languages[start : start + LANGUAGES])(text)
        if start:
            # Languages of further passes win only with a larger cosine.
            rows = staged(rows, "languages_so_far").withColumn(f"{best}_next", found)
            nearer = F.col(f"{best}_next.score") > F.col(f"{best}.score")
            rows = rows.withColumn(best, F.when(nearer, F.col(f"{best}_next")).otherwise(F.col(best))).drop(f"{best}_next")
        else:
            rows = rows.withColumn(best, found)
    if not model.languages:
        rows = rows.withColumn(best, F.lit(None).cast(BEST))
    known = letters & F.col(best).isNotNull()
    return rows.select(
        *docs.columns,
        F.when(known, F.col(best)["lang"]).otherwise(UNKNOWN).alias(fresh(docs.columns, "lang_pred")),
        F.when(known, F.col(best)["score"]).otherwise(0.0).alias(fresh(docs.columns, "score")),
        F.when(known, F.col(best)["rejected"]).otherwise(True).alias(fresh(docs.columns, "rejected")),
    )


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row, learned from the rows that are not held out."""
    narrow = docs.select("doc_id", "text")
    found = identified(narrow, fitted(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
