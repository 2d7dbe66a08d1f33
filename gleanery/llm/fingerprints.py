"""Document fingerprints by MinHash: many universal hash permutations over word shingles, in numpy.

A fingerprint has `PERMUTATIONS` values of 32 bits, each the smallest value of (a * x + b) mod 2**64 >> 32 over the text's
shingles x. The likeness of two fingerprints is the share of equal values, which estimates the Jaccard similarity of the sets.
`near_links` joins bands of the fingerprints in Spark and verifies the Jaccard similarity of the candidates on the full sets.

`edited_fingerprints` compares every text with an edited one, whose last third comes from the next document. Texts move once, by
ranges of doc_id, and a task streams over its ranges in order, so each document meets its next. The first document of each range
is copied to the range before it. The ranges' bounds and first ids, one number for each range, are all the driver sees.

Defined results: null text counts as empty. A text without words has the fingerprint of no shingle, like only to itself. Equal
doc_ids are ordered by text, null ids come last. A single document is its own next. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.near_dedup import bucket_pairs, set_digest, set_nodes, text_sets
from gleanery.llm.staging import join_counted, staged
from gleanery.llm.words import mix64, shingle_hashes, word_hashes

PERMUTATIONS = 64
BAND_ROWS = 4
SHINGLE = 5
PERCENT = 80
PIECE_ROWS = 256
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
_LAST = (1 << 63) - 1

with np.errstate(over="ignore"):
    _A = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    _B = mix64(_A ^ np.uint64(0xD1B54A32D192ED03))
_SLICE = 4096


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of every permutation; all ones for a text without shingles."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), _SLICE):
            values = _A[:, None] * shingles[None, start : start + _SLICE] + _B[:, None]
            np.minimum(out, (values.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def signatures(column: pa.Array, n: int = SHINGLE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Fingerprint and shingle hashes (with repeats) of every text."""
    hashes, offsets = word_hashes(column)
    shingles = [shingle_hashes(hashes[lo:hi], n) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
    return [signature(s) for s in shingles], shingles


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two texts' shingles; 1 for two texts without."""
    a, b = np.unique(a), np.unique(b)
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) or len(b) else 1.0


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text (all, if it has fewer)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, jaccard_edited double"
)
_NAMES = [field.split()[0] for field in _RESULT.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in _RESULT.split(", ")]
def _pairs(ids: list, texts: list[str], n: int) -> list[tuple]:
    """Results of all rows but the last, each with the row after it as its next."""
    prints, shingles = signatures(pa.array(texts, pa.string()), n)
    edits = [edited_text(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    edited, edited_shingles = signatures(pa.array(edits, pa.string()), n)
    return [
        (
            ids[i],
            len(texts[i]),
            hashlib.sha256(edits[i].encode()).hexdigest(),
            prints[i].tobytes().hex(),
            edited[i].tobytes().hex(),
            likeness(prints[i], edited[i]),
            likeness(prints[i], prints[i + 1]),
            jaccard(shingles[i], edited_shingles[i]),
        )
        for i in range(len(edits))
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=_NAMES)


def _ranges(ids: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Bounds that cut the ids (descending order: the negated ids) into ranges, and for the largest id of each range that has
    rows the range before it, which needs a copy of it. One number for each range."""
    shares = [i / parts for i in range(1, parts)]
    bounds = np.unique(np.array(ids.approxQuantile("place", shares, 0.25 / parts) if shares else [], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_numpy()
            part, first = np.searchsorted(bounds, places, "left"), np.full(len(bounds) + 1, _LAST, np.int64)
            np.minimum.at(first, part, places)
            some = np.unique(part)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(first[some])], names=["part", "first"])

    firsts = ids.mapInArrow(run, "part long, first long").groupBy("part").agg(F.min("first").alias("first")).collect()
    filled = sorted((r["part"], r["first"]) for r in firsts)
    guests: dict[int, list[int]] = {}
    for i, (_, first) in enumerate(filled):
        guests.setdefault(first, []).append(filled[i - 1][0])
    return bounds, guests


def edited_fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and how like they are."""
    # Descending doc_id, null last: ascending places.
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(-F.col("doc_id").cast("long"), F.lit(_LAST)).alias("place"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, guests = _ranges(narrow.select("place"), parts)
    copied = np.array(sorted(guests), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "is_guest", "doc_id", "place", "text"]
        for batch in batches:
            places = batch.column("place").to_numpy()
            part = np.searchsorted(bounds, places, "left")
            own = np.zeros(len(part), bool)
            columns = [batch.column(c) for c in ("doc_id", "place", "text")]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own), *columns], names=names)
            for i in np.flatnonzero(np.isin(places, copied)):
                for before in guests[int(places[i])]:
                    row = [c.slice(i, 1) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([before], pa.int64()), pa.array([True]), *row], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, at, done = [], [], None, False
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                columns = [batch.column(k).slice(start, PIECE_ROWS).to_pylist() for k in range(4)]
                out = []
                for part, is_guest, doc_id, text in zip(*columns, strict=True):
                    if part != at or (is_guest and not done):
                        # The guest is the next document of the range's last one; only the first of equal guests counts.
                        if part == at:
                            held_ids.append(doc_id)
                            held.append(text)
                        out += _pairs(held_ids, held, n) if len(held) > 1 else []
                        held_ids, held, done = [], [], part == at
                        at = part
                    if not is_guest:
                        held_ids.append(doc_id)
                        held.append(text)
                if len(held) > 1:
                    out += _pairs(held_ids, held, n)
                held_ids, held = held_ids[-1:], held[-1:]
                if out:
                    yield _batch(out)

    schema = "part long, is_guest boolean, doc_id long, place long, text string"
    dealt = narrow.mapInArrow(deal, schema).repartition("part").sortWithinPartitions("part", "is_guest", "place", "text")
    return dealt.select("part", "is_guest", "doc_id", "text").mapInArrow(run, _RESULT)


def fingerprint_rows(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set, and the keys of its fingerprint's bands (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(start, PIECE_ROWS)
                sets = list(text_sets(part.column(1), n))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([_bands(signature(s)) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "digest", "bands"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = narrow.withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, bands binary")


def _bands(values: np.ndarray) -> bytes:
    keys = mix64(np.arange(PERMUTATIONS // BAND_ROWS, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for column in values.astype(np.uint64).reshape(-1, BAND_ROWS).T:
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.tobytes()


def near_links(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b: all verified links between different sets with a common band, each set named by the smallest doc_id that has it.

    Documents with equal sets are linked by `near_members`.
    """
    rows = staged(fingerprint_rows(docs, n).where("digest is not null"), "fingerprints")
    nodes = set_nodes(rows)
    links = staged(bucket_pairs(docs, nodes, n, percent, PERMUTATIONS // BAND_ROWS), "pairs")
    named = nodes.select("node", "doc_id")
    return (
        links.join(named.select(F.col("node").alias("a"), F.col("doc_id").alias("a_id")), "a")
        .join(named.select(F.col("node").alias("b"), F.col("doc_id").alias("b_id")), "b")
        .select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    )


def near_members(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, name: of every document with a set, the smallest doc_id that has its set, which `near_links` lists."""
    rows = staged(fingerprint_rows(docs, n).where("digest is not null").select("doc_id", "digest"), "members")
    named = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("n")), "names")
    return join_counted(rows, named, "digest", "n", rows.count()).select("doc_id", "name")
