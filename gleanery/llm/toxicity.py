"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Words and word beginnings that toxic training rows have much more often than others form a lexicon, dealt into groups.
2. Voters look at every document: does it have a word of group g, several different entries, many for its length, none, words
   of a fixed list of insults, shouting.
3. The label model sees the votes on all documents, without labels: under one hidden label, two voters' covariance is the product
   of their loadings, so a rank-one fit gives each voter's rates for toxic and clean documents. Pairs that the fit leaves far off
   are correlated; they are taken out of the fit, and their voters count less.
4. The posteriors of the training rows (scaled to their labels, and the label itself as one more voter) train a logistic
   regression on hashed word features and votes, which scores every document.

Scale: three passes over the texts. The lexicon's word statistics cover all labelled rows outside the held-out fold: texts of that
fold's complement meet their labels (a shuffle of those texts unless the labels are few), and counts are summed per task (at most
`DIMENSION` numbers of each kind). The classifier is fitted on at most `TRAIN_ROWS` of these rows, chosen by hash, in blocks of
rows; the votes' moments cover all documents and are summed per task (voters x voters numbers). The model is `DIMENSION` weights.

Defined results: null and empty texts have no words, and get the score of that. Without training rows of both kinds every score is
the share of toxic ones among them, 0 where there are none. A doc_id with several labels counts as toxic if most say so. Rows
without doc_id are never held out. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.staging import hash60, staged
from gleanery.llm.words import affix_hashes

TRAIN_ROWS = 8000
BITS = 18
DIMENSION = 1 << BITS
PREFIXES = (5, 6)
LEXICON = 192
GROUPS = 12
THRESHOLD = 0.7
LABEL_ACCURACY = 0.97
CORRELATED = 0.15
PIECE_ROWS = 256
#: Training rows worked off at once on the driver.
BLOCK_ROWS = 512
#: Common insults.
INSULTS = (
    "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "idiot", "imbecile", "jerk",
    "loser", "moron", "pathetic", "pig", "rat", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
)


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with counts, and each row's words."""
    hashes, rows, words = affix_hashes(pc.utf8_lower(column.fill_null("")), PREFIXES)
    keys, counts = np.unique((rows << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return keys >> BITS, keys & (DIMENSION - 1), counts, words


def insult_buckets() -> np.ndarray:
    hashes, _, _ = affix_hashes(pa.array(INSULTS), ())
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Voters:
    """group: of each bucket, -1 outside the lexicon; insults: whether the bucket is one."""

    group: np.ndarray
    insults: np.ndarray

    N = GROUPS + 9

    def votes(self, rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, words: np.ndarray, shout: np.ndarray) -> np.ndarray:
        n = len(words)
        out = np.zeros((n, self.N), bool)
        group = self.group[buckets]
        hit = group >= 0
        out[rows[hit], group[hit]] = True
        kinds = np.bincount(rows[hit], minlength=n)
        rate = np.bincount(rows[hit], weights=counts[hit], minlength=n) / np.maximum(words, 1)
        named = self.insults[buckets]
        insults = np.bincount(rows[named], weights=counts[named], minlength=n)
        more = (kinds >= 2, kinds >= 4, rate >= 0.003, rate >= 0.01, rate >= 0.03, kinds == 0, insults >= 1, insults >= 2, shout)
        for i, vote in enumerate(more):
            out[:, GROUPS + i] = vote
        return out

    def linear(self, rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, words: np.ndarray, votes: np.ndarray) -> tuple:
        """Rows, weights' positions and values of the classifier's features."""
        n = len(words)
        hit = self.group[buckets] >= 0
        kinds = np.bincount(rows[hit], minlength=n)
        rate = np.bincount(rows[hit], weights=counts[hit], minlength=n) / np.maximum(words, 1)
        value = np.log1p(counts) * 4 / np.sqrt(words[rows] + 20)
        voted = np.nonzero(votes)
        every = np.arange(n)
        return (
            np.concatenate([rows, every, every, voted[0]], dtype=np.int32, casting="unsafe"),
            np.concatenate(
                [buckets, np.full(n, DIMENSION), np.full(n, DIMENSION + 1), DIMENSION + 2 + voted[1]], dtype=np.int32, casting="unsafe"
            ),
            np.concatenate(
                [value, np.log1p(kinds), np.minimum(rate * 30, 2), np.full(len(voted[0]), 0.5)], dtype=np.float32, casting="unsafe"
            ),
        )


WEIGHTS = DIMENSION + 2 + Voters.N


def shouting(column: pa.Array) -> np.ndarray:
    """Whether most of the ASCII letters are capitals, or there is an exclamation mark for every three words."""
    column = column.fill_null("")
    capitals = pc.count_substring_regex(column, "[A-Z]").to_numpy(zero_copy_only=False)
    small = pc.count_substring_regex(column, "[a-z]").to_numpy(zero_copy_only=False)
    marks = pc.count_substring(column, "!").to_numpy(zero_copy_only=False)
    return (capitals > small) | (marks * 20 > capitals + small)


def choose_lexicon(with_it: np.ndarray, without: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The group of every bucket: the clearest LEXICON buckets of toxic rows, dealt in turn; -1 for the others.

    with_it, without: toxic and clean rows that have the bucket; n1, n0: all toxic and clean rows.
    """
    odds = np.log((with_it + 0.1) / (n1 + 0.2)) - np.log((without + 0.1) / (n0 + 0.2))
    share = (with_it + without + 1) / (n1 + n0)
    clear = (with_it / n1 - without / n0) / np.sqrt(share * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((clear > 4.5) & (with_it >= 3) & (odds > 1))
    chosen = chosen[np.lexsort((chosen, -clear[chosen]))][:LEXICON]
    group = np.full(DIMENSION, -1, np.int64)
    group[chosen] = np.arange(len(chosen)) % GROUPS
    return group


@dataclass
class LabelModel:
    """Rates of every voter for toxic and clean documents, and the log-odds its vote and its silence add."""

    prior: float
    toxic_rate: np.ndarray
    clean_rate: np.ndarray
    correlated: np.ndarray

    @classmethod
    def fit(cls, both: np.ndarray, total: int, prior: float) -> "LabelModel":
        """both: how many documents each pair of voters votes on together, over all documents."""
        m = len(both)
        mean = np.diag(both) / total
        covariance = both / total - np.outer(mean, mean)
        varies = np.diag(covariance) > 0
        free = ~np.eye(m, dtype=bool) & varies[:, None] & varies[None, :]
        values, vectors = np.linalg.eigh(covariance)
        loading = vectors[:, -1] * np.sqrt(max(values[-1], 0))
        # Toxic documents have more lexicon words: that fixes the sign.
        loading *= 1 if loading[:GROUPS].sum() >= 0 else -1
        correlated = np.zeros((m, m), bool)
        scale = np.sqrt(np.outer(np.diag(covariance), np.diag(covariance))) + 1e-12
        for _ in range(2 * m):
            for _ in range(60):
                for i in range(m):
                    others = free[i]
                    norm = loading[others] @ loading[others]
                    loading[i] = covariance[i, others] @ loading[others] / norm if norm > 0 else 0.0
            off = np.where(free, np.abs(covariance - np.outer(loading, loading)) / scale, 0)
            i, j = np.unravel_index(off.argmax(), off.shape)
            if off[i, j] < CORRELATED or free[i].sum() <= 3 or free[j].sum() <= 3:
                break
            free[i, j] = free[j, i] = False
            correlated[i, j] = correlated[j, i] = True
        spread = loading / np.sqrt(prior * (1 - prior))
        rates = np.clip(mean + spread * (1 - prior), 1e-3, 1 - 1e-3), np.clip(mean - spread * prior, 1e-3, 1 - 1e-3)
        return cls(prior, *rates, correlated)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        less = 1 / (1 + self.correlated.sum(axis=1))
        yes = np.log(self.toxic_rate / self.clean_rate) * less
        no = np.log((1 - self.toxic_rate) / (1 - self.clean_rate)) * less
        return np.log(self.prior / (1 - self.prior)) + votes @ yes + ~votes @ no


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scaled_posterior(odds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Posterior labels: the model's log-odds on the labels' scale, with the label as one more voter."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * odds + shift)
        weight = p * (1 - p) + 1e-6
        design = np.stack([odds, np.ones_like(odds)], axis=1)
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + 1e-3 * np.eye(2), design.T @ (toxic - p) - 1e-3 * np.array([slope, shift]))
        slope, shift = slope + np.clip(step[0], -1, 1), shift + np.clip(step[1], -1, 1)
    label = np.where(toxic, 1, -1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    return _sigmoid(slope * odds + shift + label)


def fit_linear(blocks: list[tuple], posterior: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by full-batch gradient steps with per-weight scaling.

    blocks: of rows in order, each with its rows counted from 0, weights' positions and values.
    """
    n = len(posterior)
    seen = sum(np.bincount(at, minlength=WEIGHTS) for _, at, _ in blocks) >= 3
    names = np.flatnonzero(seen)
    position = np.zeros(WEIGHTS, np.int32)
    position[names] = np.arange(len(names))
    for i, (rows, at, values) in enumerate(blocks):
        kept = seen[at]
        blocks[i] = rows[kept], position[at[kept]], values[kept]
    w, bias, first, second = np.zeros(len(names)), -2.0, np.zeros(len(names)), np.zeros(len(names))
    for step in range(1, steps + 1):
        slope, off_sum = np.zeros(len(names)), 0.0
        for i, (rows, at, values) in enumerate(blocks):
            soft = posterior[i * BLOCK_ROWS : (i + 1) * BLOCK_ROWS]
            off = _sigmoid(np.bincount(rows, weights=w[at] * values, minlength=len(soft)) + bias) - soft
            slope += np.bincount(at, weights=off[rows] * values, minlength=len(names))
            off_sum += off.sum()
        slope = slope / n + 1e-4 * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        bias -= 1.5 * off_sum / n
    weights = np.zeros(WEIGHTS, np.float32)
    weights[names] = w
    return weights, float(bias)


@dataclass
class ToxicityModel:
    voters: Voters | None
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.voters is None:
            return np.full(len(column), self.bias)
        rows, buckets, counts, words = _features(column)
        votes = self.voters.votes(rows, buckets, counts, words, shouting(column))
        at_row, at, values = self.voters.linear(rows, buckets, counts, words, votes)
        return _sigmoid(np.bincount(at_row, weights=self.weights[at] * values, minlength=len(column)) + self.bias)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of all labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") > 0.5).alias("toxic"))
    return staged(known, "known")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def training_rows(docs: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `rows` of the known rows."""
    chosen = staged(known.orderBy(hash60("train", F.col("doc_id")), "doc_id").limit(rows), "train")
    # `rows` bounds the broadcast.
    return _texts(docs).join(F.broadcast(chosen), "doc_id")


def word_statistics(docs: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """How many of all known toxic and clean rows have each bucket, and the number of toxic and of clean rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last number is that of the rows.
        sums = np.zeros((2, DIMENSION + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(start, PIECE_ROWS)
                rows, buckets, _, _ = _features(part.column("text"))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
                for kind, of_kind in enumerate((toxic, ~toxic)):
                    sums[kind] += np.bincount(buckets[of_kind[rows]], minlength=DIMENSION + 1)
                    sums[kind, DIMENSION] += of_kind.sum()
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["at", "toxic", "clean"])

    # No row that is held out has a label here; without them fewer texts are moved.
    open_rows = _texts(docs.where(~is_held_out(F.col("doc_id")))).join(known, "doc_id").select("text", "toxic")
    parts = open_rows.mapInArrow(run, "at long, toxic long, clean long")
    found = parts.groupBy("at").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    sums = np.zeros((2, DIMENSION + 1), np.int64)
    sums[0, found["at"].to_numpy()] = found["toxic"].to_numpy()
    sums[1, found["at"].to_numpy()] = found["clean"].to_numpy()
    return sums[0, :-1], sums[1, :-1], int(sums[0, -1]), int(sums[1, -1])


def _collected(sample: DataFrame) -> tuple:
    """Features of the training rows: where each row's begin, buckets, counts, words, shouting, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(start, PIECE_ROWS)
                rows, buckets, counts, words = _features(part.column("text"))
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                pairs = list(zip(ends[:-1], ends[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("toxic"),
                        pa.array(words),
                        pa.array(shouting(part.column("text"))),
                        pa.array([buckets[a:b].astype(np.int32).tobytes() for a, b in pairs], pa.binary()),
                        pa.array([np.minimum(counts[a:b], 65535).astype(np.uint16).tobytes() for a, b in pairs], pa.binary()),
                    ],
                    names=["doc_id", "toxic", "words", "shout", "buckets", "counts"],
                )

    schema = "doc_id long, toxic boolean, words long, shout boolean, buckets binary, counts binary"
    found = sample.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    buckets, ends = _flat(found["buckets"], np.int32)
    counts, _ = _flat(found["counts"], np.uint16)
    return (
        ends,
        buckets,
        counts,
        found["words"].to_numpy(),
        found["shout"].to_numpy().astype(bool),
        found["toxic"].to_numpy().astype(bool),
    )


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row's begin, with their end."""
    parts = [np.frombuffer(value.as_buffer(), kind) for chunk in column.chunks for value in chunk]
    return np.concatenate([np.zeros(0, kind), *parts]), np.cumsum([0, *(len(p) for p in parts)])


def _blocks(ends: np.ndarray, buckets: np.ndarray, counts: np.ndarray, words: np.ndarray) -> Iterator[tuple]:
    """Per BLOCK_ROWS rows: their slice, and rows, buckets, counts and words as `_features` has them."""
    for start in range(0, len(words), BLOCK_ROWS):
        part = slice(start, min(start + BLOCK_ROWS, len(words)))
        lo, hi = ends[part.start], ends[part.stop]
        rows = np.repeat(np.arange(part.stop - start, dtype=np.int32), np.diff(ends[start : part.stop + 1]))
        yield part, (rows, buckets[lo:hi], counts[lo:hi], words[part])


def vote_moments(docs: DataFrame, voters: Voters) -> tuple[np.ndarray, int]:
    """How many of all documents each pair of voters votes on together, and the number of documents."""
    m = Voters.N

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, total = np.zeros((m, m), np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                column = batch.column(0).slice(start, PIECE_ROWS)
                votes = voters.votes(*_features(column), shouting(column)).astype(np.int64)
                both, total = both + votes.T @ votes, total + len(votes)
        at = np.arange(m * m + 1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[both.ravel(), total])], names=["at", "n"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "at long, n long")
    sums = {r["at"]: r["n"] for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    both = np.array([sums.get(i, 0) for i in range(m * m)], np.float64).reshape(m, m)
    return both, int(sums.get(m * m, 0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    known = known_labels(labels)
    with_it, without, n1, n0 = word_statistics(docs, known)
    if not n1 or not n0:
        return ToxicityModel(None, np.zeros(0), n1 / (n1 + n0) if n1 + n0 else 0.0)
    insults = np.zeros(DIMENSION, bool)
    insults[insult_buckets()] = True
    voters = Voters(choose_lexicon(with_it, without, n1, n0), insults)
    both, total = vote_moments(docs, voters)
    model = LabelModel.fit(both, total, n1 / (n1 + n0))
    ends, buckets, counts, words, shout, toxic = _collected(training_rows(docs, known, rows))
    blocks, odds = [], []
    for part, features in _blocks(ends, buckets, counts, words):
        votes = voters.votes(*features, shout[part])
        odds.append(model.log_odds(votes))
        blocks.append(voters.linear(*features, votes))
    del buckets, counts
    weights, bias = fit_linear(blocks, scaled_posterior(np.concatenate(odds), toxic))
    return ToxicityModel(voters, weights, bias, model)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Each row of docs as the struct `row`, with its score."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.column(0).slice(start, PIECE_ROWS)
                scores = model.scores(part.field("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part, pa.array(scores)], names=["row", "score"])

    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(start, PIECE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1)))], names=["doc_id", "score"])

    found = narrow.mapInArrow(run, "doc_id long, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that score THRESHOLD or more; the columns of docs."""
    return scored(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD).select("row.*")
