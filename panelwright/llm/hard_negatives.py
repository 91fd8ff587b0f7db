"""Hard negatives of anchors by exact integer products, several candidates in one wide integer.

Components are floored to integers. The components of several candidates are made non-negative by a bias and put into separate
fields of one 64-bit integer, wide enough for a whole inner product; each is multiplied once by an anchor's component, and the
fields of the sum, less the biases, are the exact scores. Anchors go out in blocks of bounded size against all rows, in two scans a
block: the first finds each anchor's positives, the second its negatives within the window of every positive's score. Each task
keeps its best few rows of an anchor, so what is shuffled is those and never a row's vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.llm.shared import Workspace

WORST = np.iinfo(np.int64).min


def kronecker_scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, rows by anchors, of two integer matrices of equal width. Python's integers where 64 bits don't hold a field."""
    n, d = rows.shape
    if not (n and d and len(anchors)):
        return np.zeros((n, len(anchors)), np.int64)
    low, low_a = int(rows.min()), int(anchors.min())
    width = max(1, (d * (int(rows.max()) - low) * (int(anchors.max()) - low_a)).bit_length())
    wide = width > 64
    fields, kind = (8, object) if wide else (64 // width, np.uint64)
    biased = np.zeros((-(-n // fields) * fields, d), kind)
    biased[:n] = (rows - low).astype(kind)
    biased = biased.reshape(-1, fields, d)
    step = (lambda f: width * f) if wide else (lambda f: np.uint64(width * f))
    packed = biased[:, 0].copy()
    for f in range(1, fields):
        packed |= biased[:, f] << step(f)
    sums = packed @ (anchors - low_a).astype(kind).T
    mask = (1 << width) - 1 if wide else np.uint64((1 << width) - 1)
    out = np.empty((len(packed), fields, len(anchors)), object if wide else np.int64)
    for f in range(fields):
        out[:, f] = (sums >> step(f)) & mask
    out = out.reshape(-1, len(anchors))[:n]
    exact = object if wide else np.int64
    out += low_a * rows.astype(exact).sum(axis=1)[:, None] + (low * anchors.astype(exact).sum(axis=1) - d * low * low_a)[None, :]
    return out


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integers of any size."""
    x = np.floor(scale * values.astype(np.float64))
    if not x.size or np.abs(x).max() < 2**31:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], object)


def vectors_of(column: pa.ListArray, scale: int, least_width: int = 0) -> np.ndarray:
    """A matrix of floored components; shorter vectors end in zeros."""
    at = column.offsets.to_numpy()
    sizes, values = np.diff(at), column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    width = max(least_width, sizes.max(initial=0))
    dense = np.zeros((len(sizes), width), np.float64)
    dense[np.arange(width)[None, :] < sizes[:, None]] = values
    return floored(dense, scale)


class Best:
    """The ``k`` best (score, id) of each of ``m`` slots: higher scores first, ties by smaller id, equal pairs once."""

    def __init__(self, m: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((m, k), WORST), np.zeros((m, k), np.int64)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, taken: np.ndarray) -> None:
        """Scores of ``slots`` by rows whose ``ids`` ascend; only entries that ``taken`` marks count."""
        taken = taken & (scores >= self.scores[slots, -1][:, None])
        some = taken.any(axis=1)
        slots, scores, taken = slots[some], scores[some], taken[some]
        if not len(slots):
            return
        # among equal scores the earlier row, so the smaller id, is the better one
        n = len(ids)
        rank = np.where(taken, scores, WORST)
        if n > self.k and scores.dtype != object and np.abs(scores).max() < 2**62 // n:
            place = np.where(taken, scores * n - np.arange(n), WORST)
            best = np.argpartition(place, n - self.k, axis=1)[:, n - self.k :]
        else:
            best = np.argsort(-rank.astype(object), axis=1, kind="stable")[:, : self.k]
        here = np.take_along_axis(rank, best, 1).astype(np.int64)
        s, i = np.concatenate([self.scores[slots], here], 1), np.concatenate([self.ids[slots], ids[best]], 1)
        for _ in range(2):
            order = np.lexsort((i, ~s), axis=1)  # ~s falls as s rises, for the least integer too
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            s[:, 1:][(s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1])] = WORST
        self.scores[slots], self.ids[slots] = s[:, : self.k], i[:, : self.k]


def _chunks(batches: Iterator[pa.RecordBatch], scale: int, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids, labels, vectors`` in pieces of at most ``most`` rows, in the order of ids, equal rows once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            x = vectors_of(part.column("vector"), scale, width)
            ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, labels, x = ids[order], labels[order], x[order]
            if (ids[1:] == ids[:-1]).any():
                seen = {(i, l, *v): None for i, l, v in zip(ids.tolist(), labels.tolist(), x.tolist(), strict=True)}
                ids, labels, x = np.array([s[0] for s in seen]), np.array([s[1] for s in seen]), np.array([s[2:] for s in seen], x.dtype).reshape(len(seen), -1)
            yield ids, labels, x


def _same_width(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    components_at_once: int = 2_000_000,
    scores_at_once: int = 1 << 21,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor and positive.

    A row's score is its inner product with the anchor, components as ``floor(scale * x)``. An anchor's positives are its first
    ``n_positives`` rows of the same label and another id; a positive's negatives the first ``n_negatives`` of the rows of another label
    with ``low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score``; higher scores come first, ties by
    smaller id. Rows with a null id, label or vector or a null or non-finite component take no part. Rows repeated with one id and
    score count once; of anchors that share an id, the row of least label, then vector, is the anchor. A shorter vector ends
    in zeros. A window that holds no row, as below a negative score, gives no row; an empty table gives none. Other columns are
    not read. A score that a long doesn't hold is an error.

    ``components_at_once`` bounds the anchors of a block, the only thing sent from the driver.
    """
    ws = workspace or Workspace(spark, "hard-negatives")
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above it
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"), is_anchor.alias("is_anchor"))
    rows = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    anchors = rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    anchors = ws.save(anchors, "anchors")
    rows = rows.select("id", "label", "vector")
    components = anchors.agg(F.sum(F.size("vector") + 1)).first()[0] or 0
    blocks = -(-components // components_at_once)
    at = ws.folder("negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    best_first = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "id")

    for block in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().sort_by("id").combine_chunks()
        if not own.num_rows:
            continue
        shared = spark.sparkContext.broadcast((own.column("id").to_numpy(), own.column("label").to_numpy(), vectors_of(own.column("vector").combine_chunks(), scale)))
        most = max(1, scores_at_once // own.num_rows)

        def positives(batches: Iterator[pa.RecordBatch], shared=shared, most=most) -> Iterator[pa.RecordBatch]:
            a_ids, a_labels, a = shared.value
            best, slots = Best(len(a_ids), n_positives), {label: np.flatnonzero(a_labels == label) for label in np.unique(a_labels).tolist()}
            for ids, labels, x in _chunks(batches, scale, a.shape[1], most):
                for label in set(labels.tolist()) & slots.keys():
                    mine, same = slots[label], labels == label
                    s = kronecker_scores(x[same], _same_width(a[mine], x.shape[1])).T
                    best.add(mine, s, ids[same], ids[same][None, :] != a_ids[mine][:, None])
            slot, k = np.nonzero(best.scores != WORST)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a_ids[slot], best.ids[slot, k], best.scores[slot, k])], ["anchor_id", "id", "score"])

        found = rows.mapInArrow(positives, "anchor_id bigint, id bigint, score bigint")
        found = found.withColumn("rank", F.dense_rank().over(best_first("anchor_id"))).where(F.col("rank") <= n_positives).dropDuplicates()
        pairs = found.select("anchor_id", "id", "score").toArrow().combine_chunks()
        which = np.searchsorted(shared.value[0], pairs.column("anchor_id").to_numpy())
        windows = spark.sparkContext.broadcast((which, pairs.column("id").to_numpy(), pairs.column("score").to_numpy()))

        def negatives(batches: Iterator[pa.RecordBatch], shared=shared, windows=windows, most=most) -> Iterator[pa.RecordBatch]:
            (a_ids, a_labels, a), (which, p_ids, p_scores) = shared.value, windows.value
            order = np.argsort(which, kind="stable")
            nth = np.empty(len(which), np.int64)  # a pair's number among those of its anchor
            nth[order] = np.arange(len(which)) - np.searchsorted(which[order], which[order])
            bounds = [(-(-low_percent * p // 100), high_percent * p // 100) for p in p_scores.tolist()]
            least, highest = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
            best = Best(len(which), n_negatives)
            for ids, labels, x in _chunks(batches, scale, a.shape[1], most):
                s = kronecker_scores(x, _same_width(a, x.shape[1])).T
                other = labels[None, :] != a_labels[:, None]
                for k in range(n_positives):
                    slots = np.flatnonzero((nth == k) & (least <= highest))
                    of = which[slots]
                    best.add(slots, s[of], ids, other[of] & (s[of] >= least[slots][:, None]) & (s[of] <= highest[slots][:, None]))
            slot, k = np.nonzero(best.scores != WORST)
            out = (a_ids[which[slot]], p_ids[slot], p_scores[slot], best.ids[slot, k], best.scores[slot, k])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["anchor_id", "positive_id", "positive_score", "id", "score"])

        kept = rows.mapInArrow(negatives, "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint")
        kept = kept.withColumn("rank", F.dense_rank().over(best_first("anchor_id", "positive_id", "positive_score"))).where(F.col("rank") <= n_negatives).dropDuplicates()
        kept.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(at)
        shared.destroy()
        windows.destroy()
    if not blocks:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(at)
