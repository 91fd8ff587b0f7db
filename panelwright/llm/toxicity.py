"""Toxicity by non-negative positive-unlabelled learning on hashed word features.

Confirmed toxic examples are the positives; all other training text is unlabelled, toxic or not. Linear numpy classifiers
minimise ``prior * R+ + max(0, R_u - prior * R+_neg)``, the risk estimate that the class prior corrects and that is not allowed to go below
zero. Spark counts features, sums losses and gradients over all training texts and scores every whole text; a text's score is a
sum over its distinct words, so each word is looked up once in a bounded table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import fsum
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm.key_filter import split_by_keys
from panelwright.llm.shared import Workspace

_WORD = re.compile(r"\w+")
DIMENSIONS = 1 << 18
PREFIXES = (4, 5, 6, 7)
BINS = 64


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings, so that unseen endings of a known stem still count."""
    return [crc32(word.encode("utf-8", "replace")) % DIMENSIONS, *[crc32(f"^{word[:n]}".encode("utf-8", "replace")) % DIMENSIONS for n in PREFIXES if len(word) > n]]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, logit: float) -> float:
        z = max(-60.0, min(60.0, logit + self.bias))
        return float(1 / (1 + np.exp(-z)))


class PuRisk:
    """The corrected risk of a linear classifier and its gradient, from sums over positive and unlabelled texts."""

    def __init__(self, prior: float, n_positive: int, n_unlabelled: int) -> None:
        self.prior, self.n_positive, self.n_unlabelled = prior, n_positive, n_unlabelled

    def parts(self, losses: np.ndarray) -> tuple[float, float]:
        """``prior * R+`` and ``R_u - prior * R+_neg`` of summed losses (positives as 1, as 0, unlabelled as 0)."""
        return self.prior * losses[0] / self.n_positive, losses[2] / self.n_unlabelled - self.prior * losses[1] / self.n_positive

    def gradient(self, losses: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The descent direction; ``sums`` holds the three losses' gradients by weight. Below zero the second part alone is undone."""
        second = sums[2] / self.n_unlabelled - self.prior * sums[1] / self.n_positive
        return self.prior * sums[0] / self.n_positive + second if self.parts(losses)[1] >= 0 else -second


def pattern_sums(index: np.ndarray, sizes: np.ndarray, n_positive: np.ndarray, n_texts: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """The three summed losses of rows of features and their gradients by weight, the bias last. A feature counts as often as it is listed."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    z = np.clip(np.bincount(owner, weights=w[index], minlength=len(sizes)) + b, -60, 60)
    sig = 1 / (1 + np.exp(-z))
    losses = np.array([n_positive @ np.logaddexp(0, -z), n_positive @ np.logaddexp(0, z), n_texts @ np.logaddexp(0, z)])
    slopes = (n_positive * (sig - 1), n_positive * sig, n_texts * sig)
    return losses, np.array([np.append(np.bincount(index, weights=g[owner], minlength=len(w)), g.sum()) for g in slopes])


def train_nnpu(risk: PuRisk, sums: Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]], dims: int, *, steps: int = 40, rate: float = 0.15, l1: float = 1e-4) -> Model:
    """One linear classifier by Adam steps on the whole non-negative PU risk with logistic loss, an L1 shrinkage after each."""
    w, b = np.zeros(dims), 0.0
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for step in range(1, steps + 1):
        grad = risk.gradient(*sums(w, b))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1, 0)
    return Model(np.round(w, 6), round(b, 6))


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are never read: ``crc32`` of the id as text divisible by five. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def feature_counts(texts: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """``feature, n``: how many distinct words of each text carry a feature, summed over all texts; of these features, or of any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if among is None else set(among.tolist())
        total, words = np.zeros(DIMENSIONS, dtype=np.int64), Counter()

        def flush() -> None:
            for word, n in words.items():
                for x in word_features(word):
                    if wanted is None or x in wanted:
                        total[x] += n
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                words.update(distinct_words(text.as_py()))
            if len(words) > 300_000:
                flush()
        flush()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["feature", "n"])

    return texts.select("text").mapInArrow(count, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def telling_features(positive: DataFrame, texts: DataFrame, n_positive: int, n_texts: int, *, lift: float = 2.5, z: float = 4.0) -> np.ndarray:
    """Features clearly commoner in positives than in all texts: ``lift`` times the share, ``z`` Poisson deviations above it.

    Only features of three positives' words are counted over all texts. At most ``DIMENSIONS`` rows reach the driver.
    """
    p = np.array(feature_counts(positive).where("n >= 3").collect(), dtype=np.int64).reshape(-1, 2)
    n = np.zeros(DIMENSIONS, dtype=np.int64)
    for feature, found in feature_counts(texts, p[:, 0]).collect():
        n[feature] = found
    expected = (n[p[:, 0]] + 0.5) / (n_texts + 1) * n_positive
    return np.sort(p[(p[:, 1] >= lift * expected) & (p[:, 1] - expected >= z * np.sqrt(expected)), 0])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, prior: float | None = None, steps: int = 40, workspace: Workspace | None = None) -> tuple[Model, float]:
    """The model and the class prior, from every text that is not held out.

    Confirmed toxic texts are the positives, all training texts the unlabelled population that has them in their share. A text is
    reduced to those of its features that tell positives apart (counted over all texts), equal reductions are added up, and each
    step sums losses and gradients over that table in Spark, so no text is left out and the driver holds no more than one
    number a feature. ``prior`` is the toxic share of all texts; where it is not given, that of all training labels. The decision
    point is set on the same positives and unlabelled texts.
    """
    ws = workspace or Workspace(spark, "toxicity")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    nothing = Model(np.zeros(DIMENSIONS), -60.0)
    if not total.n or not total.p:
        return nothing, 0.0
    prior = min(0.9, total.p / total.n if prior is None else prior)
    toxic_ids = known.where("toxic = 1").select("doc_id")
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    maybe, _ = split_by_keys(texts, toxic_ids, "doc_id")  # of the others no text is shuffled
    positive = ws.save(maybe.join(toxic_ids, "doc_id", "left_semi").select("text"), "positive")
    n_positive, n_texts = positive.count(), texts.count()
    if not n_positive:
        return nothing, prior
    kept = telling_features(positive, texts, n_positive, n_texts)
    to = spark.sparkContext.broadcast(dict(zip(kept.tolist(), range(len(kept)), strict=True)))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = to.value

        def kept_of(word: str) -> list[int]:
            return [place[x] for x in word_features(word) if x in place]

        get = _WordTable(kept_of).__getitem__
        for batch in batches:
            rows = [np.array(sorted(chain.from_iterable(map(get, distinct_words(t.as_py())))), dtype="<i4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["f"])

    count = lambda df, p, n: df.select("text").mapInArrow(reduced, "f binary").groupBy("f").agg(F.count(F.lit(1)).alias("c")).select("f", (F.col("c") * p).alias("p"), (F.col("c") * n).alias("n"))
    patterns = ws.save(count(positive, 1, 0).union(count(texts, 0, 1)).groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "patterns")

    def sums(w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            losses, grads = np.zeros(3), np.zeros((3, len(w) + 1))
            for batch in batches:
                own = pattern_sums(*_rows_of(batch), w, b)
                losses, grads = losses + own[0], grads + own[1]
            out = np.column_stack([losses, grads])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.shape[1], dtype=np.int32)), *map(pa.array, out)], names=["i", "a", "b", "c"])

        added = patterns.mapInArrow(part, "i int, a double, b double, c double").groupBy("i").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()
        out = np.zeros((3, len(w) + 2))
        for r in added:  # one row a weight
            out[:, r[0]] = r[1:]
        return out[:, 0], out[:, 1:]

    model = train_nnpu(PuRisk(prior, n_positive, n_texts), sums, len(kept), steps=steps)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, sizes, p, n = _rows_of(batch)
            z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=model.weights[index], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(z, -60, 60) * BINS).astype(np.int32)), pa.array(p), pa.array(n)], names=["bin", "p", "n"])

    binned = np.array(patterns.mapInArrow(bins, "bin int, p bigint, n bigint").groupBy("bin").agg(F.sum("p"), F.sum("n")).orderBy("bin").collect())  # at most 120 * BINS
    out = np.zeros(DIMENSIONS)
    out[kept] = model.weights
    return Model(out, _decision_bias(*binned.T, prior, model.bias)), prior


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch of the reduced table as one index array, sizes, and counts of positives and of all texts."""
    found = batch.column(0).to_pylist()
    index = np.frombuffer(b"".join(found), dtype="<i4").astype(np.int64)
    return index, np.array([len(x) // 4 for x in found], dtype=np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _decision_bias(bins: np.ndarray, positive: np.ndarray, texts: np.ndarray, prior: float, bias: float) -> float:
    """The bias that is best by what positives and unlabelled rows alone can tell: ``recall ** 2 / share predicted``.

    That ratio is proportional to precision times recall, whose negatives are unknown. The share is at least that of the positives
    found, ``prior * recall``. Rows come counted by their sum's bin (``BINS`` to one), in order; a cut lies in the middle between
    two occupied bins. The learned bias stays where it is as good; else the middle of the best cuts is taken.
    """
    cuts = (bins[1:] + bins[:-1] + 1) / (2 * BINS)
    at = np.searchsorted(cuts, -bias)
    above = lambda n: np.cumsum(n[::-1])[::-1] / n.sum()
    recall, share = above(positive), above(texts)
    value = np.where(recall > 0, recall**2 / np.maximum(np.maximum(share, prior * recall), 1e-12), 0.0)
    best = value >= value.max() - 1e-12
    if best[at] or not best[1:].any():
        return bias
    return float(-np.median(cuts[best[1:]]))


class _WordTable(dict):
    """Values of words, each made once; emptied when it has grown large."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make = make

    def __missing__(self, word: str) -> object:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = self.make(word)
        return value


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, prior: float | None = None, steps: int = 40, workspace: Workspace | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``predicted`` is 1 from a score of 0.5.

    Labels count as in :func:`held_out`; labels, languages, sources and ids are no input of a score. Null and empty texts score
    as a text without words. A document labelled more than once is toxic if one label says so. Without a toxic training label
    every score is 0. Repeated rows are scored each; an empty table gives no row; other columns are not read.
    """
    model, _ = fit(spark, docs, labels, prior=prior, steps=steps, workspace=workspace)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        get = _WordTable(lambda word: float(weights[word_features(word)].sum())).__getitem__
        for batch in batches:
            scores = [shared.value.score(fsum(map(get, distinct_words(t.as_py())))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
