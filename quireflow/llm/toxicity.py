"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Training rows: labelled documents whose crc32(id as text) is not divisible by
   5, the MAX_ROWS with the least hash. Voters are words (lexicon) and word
   beginnings (patterns) that the labels associate with toxicity.
2. A voter votes toxic where its word occurs at all, and abstains elsewhere; a
   few density voters vote on the share of all voters' words. The label model
   estimates each voter's vote rates in both classes by expectation
   maximisation, and corrects for correlated voters: a voter's evidence is
   divided by one plus its summed residual correlations.
3. A logistic regression on per-voter shares and total density is fitted to the
   posterior labels. Its weights are all that a score uses, besides the text.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased;
whole texts are counted. Null texts count as empty and get the intercept's
score; repeated rows are scored each (of a labelled id with several texts the
least one is learned from, as toxic if any of its labels says so); without a toxic training row every score
is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm import textkit

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 20_000
#: Voters at most; the least training documents of a voter, and its least share of toxic ones.
MAX_VOTERS, MIN_DOCS, MIN_PRECISION = 600, 4, 0.8
#: Letters of a word beginning.
BEGINNING = 5
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Model:
    """Hashes of whole words and of beginnings (sorted), and the classifier's weights: one a voter, then density, then intercept."""

    words: np.ndarray
    beginnings: np.ndarray
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _hits(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, beginnings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, voter) of each hit, and the words of each row."""
    lowered = textkit.LOWER[data]
    starts, ends, first = textkit.word_spans(lowered, offsets, _SEPARATOR)
    row = textkit.rows_of(np.diff(first))
    found = []
    for known, hashes, base in ((words, textkit.span_hashes(lowered, starts, ends), 0), (beginnings, textkit.span_hashes(lowered, starts, np.minimum(ends, starts + BEGINNING)), len(words))):
        if len(known) and len(hashes):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero((known[at] == hashes) & (ends - starts > (BEGINNING if base else 0)))
            found.append((row[hit], at[hit] + base))
    rows, voters = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return rows, voters, np.diff(first)


def _shares(rows: np.ndarray, voters: np.ndarray, n_words: np.ndarray, n_voters: int) -> np.ndarray:
    """Dense features: hits per hundred words (log) of each voter, and of all words that a voter hits."""
    counts = np.zeros((len(n_words), n_voters + 1), np.float32)
    np.add.at(counts, (rows, voters), 1)
    counts[:, -1] = counts[:, :-1].sum(axis=1)
    counts *= (100 / np.maximum(n_words, 20)[:, None]).astype(np.float32)
    return np.log1p(counts, out=counts)


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """text, toxic of at most MAX_ROWS labelled documents that are not held out."""
    wanted = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _terms(rows: DataFrame) -> DataFrame:
    """kind, hash, n, toxic: documents with a word (0) or beginning (1), and toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.column_buffer(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high in textkit.row_slices(offsets):
                part, bounds = textkit.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                starts, ends, first = textkit.word_spans(part, bounds, _SEPARATOR)
                row = textkit.rows_of(np.diff(first))
                for kind in (0, 1):
                    use = ends - starts > (BEGINNING if kind else 2)
                    hashes = textkit.span_hashes(part, starts[use], np.minimum(ends[use], starts[use] + BEGINNING) if kind else ends[use])
                    pairs = np.unique(np.stack([hashes.view(np.int64), row[use]], axis=1), axis=0)
                    keys, inverse, n = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
                    bad = np.bincount(inverse, toxic[low + pairs[:, 1]], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(bad)], ["kind", "hash", "n", "toxic"])

    return rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "kind int, hash long, n long, toxic long").groupBy("kind", "hash").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _features(rows: DataFrame, words: np.ndarray, beginnings: np.ndarray) -> np.ndarray:
    """Features of the training rows, on the driver: at most MAX_ROWS times the voters that hit, as (row, voter, hits) and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.column_buffer(batch.column(1))
            for low, high in textkit.row_slices(offsets):
                r, v, n = _hits(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], words, beginnings)
                cuts = np.searchsorted(np.sort(r, kind="stable"), np.arange(high - low + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v[np.argsort(r, kind="stable")].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists, pa.array(n, pa.int64())], ["doc_id", "voters", "n_words"])

    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, voters array<int>, n_words long").orderBy("doc_id").toArrow()
    n_voters = len(words) + len(beginnings)
    counts = np.array([len(x) for x in found["voters"].to_pylist()], np.int64)
    flat = np.array([v for x in found["voters"].to_pylist() for v in x], np.int64)
    return _shares(textkit.rows_of(counts), flat, found["n_words"].to_numpy(), n_voters)


def label_model(votes: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of the toxic class from a matrix of votes (1: toxic, 0: abstains), without labels.

    Vote rates of both classes by expectation maximisation; the evidence of a
    voter is divided by one plus the summed absolute correlation of its
    residuals with other voters'.
    """
    posterior = np.clip(votes.mean(axis=1) * votes.shape[1], 0.02, 0.98)
    weight = np.ones(votes.shape[1])
    prior = 0.1
    for step in range(rounds):
        posterior = posterior.astype(votes.dtype)
        rate1 = np.clip((posterior @ votes + 0.5) / (posterior.sum() + 1), 1e-4, 0.99)
        rate0 = np.clip(((1 - posterior) @ votes + 0.05) / ((1 - posterior).sum() + 1), 1e-5, 0.99)
        prior = np.clip(posterior.mean(), 0.01, 0.5)
        if step in (5, 15):
            residual = votes - np.outer(posterior, rate1).astype(votes.dtype) - np.outer(1 - posterior, rate0).astype(votes.dtype)
            scale = np.sqrt((residual**2).mean(axis=0)) + 1e-9
            residual /= scale
            correlation = np.abs(residual.T @ residual / len(votes))
            np.fill_diagonal(correlation, 0)
            weight = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(axis=1))
        log_odds = np.log(prior / (1 - prior)) + votes @ (weight * (np.log(rate1 / rate0) - (absent := np.log((1 - rate1) / (1 - rate0))))) + weight @ absent
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights and intercept by accelerated gradient descent on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    step = 4.0 / max(np.linalg.norm(x.T @ x / len(x), 2), 1e-9)
    w = previous = np.zeros(x.shape[1])
    for t in range(rounds):
        ahead = w + t / (t + 3) * (w - previous)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(x.dtype), -30, 30)))
        previous, w = w, ahead - step * (x.T @ (p - y).astype(x.dtype) / len(x) + l2 * ahead)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model of the labelled rows that are not held out."""
    rows = training_rows(docs, labels, id_column, text_column)
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    empty = np.zeros(0, np.uint64)
    if not total["toxic"]:
        return Model(empty, empty, np.array([0.0, -1e9]))
    share = F.col("toxic") / F.col("n")
    best = _terms(rows).where((F.col("toxic") >= MIN_DOCS) & (share >= MIN_PRECISION)).orderBy(F.desc("toxic"), "kind", "hash").limit(MAX_VOTERS).collect()
    words, beginnings = (np.sort(np.array([r["hash"] for r in best if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1))
    if not len(best):
        return Model(empty, empty, np.array([0.0, -1e9]))
    x = _features(rows, words, beginnings)
    density = x[:, -1]
    votes = np.concatenate([x[:, :-1] > 0, np.stack([density > cut for cut in np.log1p([0.2, 0.5, 1.0, 2.0])], axis=1)], axis=1).astype(np.float32)
    return Model(words, beginnings, _logistic(x, label_model(votes)))


def scored(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, density, intercept = model.weights[:-2], model.weights[-2], model.weights[-1]
        for batch in batches:
            data, offsets = textkit.column_buffer(batch.column(1))
            for low, high in textkit.row_slices(offsets):
                rows, voters, n = _hits(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], model.words, model.beginnings)
                size = np.maximum(n, 20)
                keys, counts = np.unique(rows * (len(each) + 1) + voters, return_counts=True)
                at, voter = keys // (len(each) + 1), keys % (len(each) + 1)
                total = np.bincount(at, np.log1p(100 * counts / size[at]) * each[voter] if len(each) else None, high - low) + density * np.log1p(100 * np.bincount(rows, minlength=high - low) / size) + intercept
                score = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), held_out(F.col(id_column)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
