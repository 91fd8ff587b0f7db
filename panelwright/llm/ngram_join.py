"""Similarity self-join on word n-grams by T-occurrence search, and the classes that its links make.

Two documents link when ``share`` of the union of their shingle sets is common. Then they agree on at least ``T`` shingles,
and so on one of the first ``n - T + 1`` of either in any fixed order; the order taken here puts the most frequent shingles
last, so long posting lists are rarely needed to find a candidate. Equal sets are one class from the start.

Posting lists stream through sorted shuffle partitions; a list never has to fit in memory. From a list come star candidates
(each member against the list's most central one), not pairs. Stars chain into families with one top. A block of a pivot's
candidates is searched for it: the pivot's shingles are posting lists over the block, short ones are merged by a heap, the longest
are binary-probed (DivideSkip), and documents that reach the required overlap are retained. Members that do not link to their
top are compared inside the family through what tells them from the top (:func:`_within_families`), so a large group of near
copies makes short lists. Lists that still hold several families are joined with themselves across those, so no link between
different classes is lost; pairs that share too few prefix shingles to link are not searched. All pairs found are verified by
the same search.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwright.llm.decontamination import small
from panelwright.llm.graph import components
from panelwright.llm.shared import Workspace, in_small_batches

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """64-bit hash of a word, kept while the table is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``n``-word shingles, A-Z lower-cased; of the whole if it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    acc = h[: len(h) - k + 1] ^ np.uint64(k)
    for i in range(1, k):
        acc = acc * _K1
        acc ^= acc >> np.uint64(29)
        acc = acc + h[i : len(h) - k + 1 + i]
    acc = acc * _K2
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def required_overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of sizes ``a`` and ``b`` with ``100 * intersection >= percent * union``."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(own: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first ``n - T + 1`` shingles, ``T`` the least overlap with any set that can link; frequent ones come last."""
    n = len(own)
    size = n - -(-percent * n // 100) + 1
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        often = frequent[at] == own
        own = np.concatenate([own[~often], own[often]])
    return own[: min(size, n)]


def t_occurrence(query: np.ndarray, block: list[np.ndarray], percent: int, mu: float = 0.01) -> list[tuple[int, int]]:
    """``(position in block, overlap)`` of the sets that link to ``query``: heap-merge of short lists, binary probes of long ones.

    The ``L`` longest lists are set aside. What reaches ``T`` occurrences over all lists has at least ``T - L`` in the short
    ones, so only such sets are looked up in the long lists, and a look-up stops when ``T`` is out of reach.
    """
    members = []
    for d, own in enumerate(block):
        at = np.searchsorted(query, own)
        at[at == len(query)] = 0
        members.append((at[query[at] == own] if len(query) else at[:0], d))
    where = np.concatenate([np.stack([q, np.full(len(q), d)]) for q, d in members], axis=1)
    where = where[:, np.lexsort((where[1], where[0]))]
    cuts = np.flatnonzero(np.diff(where[0])) + 1
    lists = sorted((x.tolist() for x in np.split(where[1], cuts) if len(x)), key=len)
    needed = [required_overlap(len(query), len(own), percent) for own in block]
    least = min(needed, default=0)
    if least <= 0 or not lists:
        return []
    n_long = min(least - 1, len(lists), int(least / (mu * log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found = []
    for d, run in groupby(heapq.merge(*short)):
        count = sum(1 for _ in run)
        if count + n_long < needed[d]:
            continue
        for i, postings in enumerate(long):
            if count + n_long - i < needed[d]:
                break
            k = bisect_left(postings, d)
            count += k < len(postings) and postings[k] == d
        if count >= needed[d]:
            found.append((d, count))
    return found


def _frequent_shingles(docs: DataFrame, n: int, keep: int, one_in: int) -> np.ndarray:
    """At most ``keep`` shingles that many documents hold, most frequent first, from one document in ``one_in``.

    They only set the order in which shingles are looked at: any order gives the same links.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingles(t.as_py(), n) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(every or [np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").mapInArrow(sets, "h bigint")
    top = some.groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(keep)
    return np.sort(np.array([r.h for r in top.select("h").collect()], dtype=np.int64).view(np.uint64))


def _streamed(make, fields: list[tuple[str, pa.DataType]], size: int = 50_000):
    """Rows of ``make`` as record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in make(batches):
            rows.append(row)
            if len(rows) >= size:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[x for x, _ in fields])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[x for x, _ in fields])

    return run


def _verify(spark: SparkSession, ws: Workspace, pairs: DataFrame, texts: DataFrame, n: int, percent: int, rows_at_once: int = 500_000) -> DataFrame:
    """The pairs ``(pivot, doc)`` that link, by :func:`t_occurrence` over blocks of at most 64 of a pivot's candidates."""
    salt = F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int").alias("salt")
    asked = pairs.select("pivot", salt, "doc")
    members = asked.select("pivot", "salt", "doc", F.lit(1).alias("role")).union(asked.select("pivot", "salt", F.col("pivot").alias("doc"), F.lit(0).alias("role")).distinct())
    members = small(ws.save(members, "members"), rows_at_once)
    blocks = texts.join(members, members["doc"] == texts["doc_id"]).select("pivot", "salt", "role", "doc", "text")
    blocks = blocks.repartition(F.col("pivot"), F.col("salt")).sortWithinPartitions("pivot", "salt", "role", "doc")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pivot, query, ids, block = None, None, [], []
        for batch in batches:
            for p, role, doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                own = shingles(text.as_py(), n)
                if role == 0 or len(ids) == 64:
                    for d, count in t_occurrence(query, block, percent) if ids else ():
                        yield pivot, ids[d], count
                    ids, block = [], []
                if role == 0:
                    pivot, query = p, own
                else:
                    ids.append(doc)
                    block.append(own)
        for d, count in t_occurrence(query, block, percent) if ids else ():
            yield pivot, ids[d], count

    fields = [("u", pa.int64()), ("v", pa.int64()), ("overlap", pa.int64())]
    return ws.save(blocks.mapInArrow(_streamed(search, fields), "u bigint, v bigint, overlap bigint"), "links")


def residual(own: np.ndarray, reference: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The symmetric difference of ``own`` and ``reference``: first what only ``own`` has and few documents hold."""
    added, missed = np.setdiff1d(own, reference, assume_unique=True), np.setdiff1d(reference, own, assume_unique=True)
    often = np.zeros(len(added), dtype=bool)
    if len(frequent) and len(added):
        often = frequent[np.minimum(np.searchsorted(frequent, added), len(frequent) - 1)] == added
    return np.concatenate([added[~often], np.sort(np.concatenate([added[often], missed]))])


def residual_prefix(n: int, reference_n: int, size: int, linked: bool, percent: int) -> int:
    """How many elements of a residual of ``size`` any link through it can need (see :func:`_within_families`).

    ``T`` grows by ``percent / (100 + percent)`` a shingle, rounded up, which bounds how far the difference that a link allows
    differs between two partners: by ``(100 - percent) / (100 + percent)`` of the difference of their sizes, and two.
    """
    if linked:
        slack = abs(n - reference_n) * (100 - percent) // (100 + percent) + 2
        return min(size, size - max(1, -(-(size + 1 - slack) // 2)) + 1)
    other = n * 100 // percent
    return min(size, n + other - 2 * required_overlap(n, other, percent) + 2)


def _search_stars(spark: SparkSession, ws: Workspace, pairs: DataFrame, texts: DataFrame, often, n: int, percent: int, rows_at_once: int = 500_000) -> DataFrame:
    """``pivot, doc, top, linked, n, size, heads`` of the pairs ``(pivot, doc, top)``: whether they link, by :func:`t_occurrence`
    over blocks of about 64; where the pivot is the family's ``top``, also the size and first elements of the residual.
    """
    blocks = small(ws.save(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("n_blocks")), "blocks"), rows_at_once)
    asked = pairs.join(blocks, "pivot").select("pivot", F.pmod(F.xxhash64("doc"), F.col("n_blocks")).cast("int").alias("salt"), "doc", "top")
    members = asked.select("pivot", "salt", "doc", F.lit(1).alias("role"), "top").union(asked.select("pivot", "salt", F.col("pivot").alias("doc"), F.lit(0).alias("role"), F.lit(False).alias("top")).distinct())
    members = small(ws.save(members, "members"), rows_at_once)
    blocks = texts.join(members, members["doc"] == texts["doc_id"]).select("pivot", "salt", "role", "doc", "top", "text")
    blocks = blocks.repartition(F.col("pivot"), F.col("salt")).sortWithinPartitions("pivot", "salt", "role", "doc")

    def judged(pivot: int, query: np.ndarray, held: list[tuple[int, bool, np.ndarray]]) -> Iterator[tuple]:
        hits = {d for d, _ in t_occurrence(query, [own for _, _, own in held], percent)} if held else ()
        for d, (doc, top, own) in enumerate(held):
            rest = residual(own, query, often.value) if top else own[:0]
            heads = rest[: residual_prefix(len(own), len(query), len(rest), d in hits, percent)] if top else rest
            yield pivot, doc, top, d in hits, len(own), len(rest), heads.view(np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pivot, query, held = None, None, []
        for batch in batches:
            for p, role, doc, top, text in zip(batch.column(0).to_pylist(), *[batch.column(i).to_pylist() for i in (2, 3, 4)], batch.column(5), strict=True):
                own = shingles(text.as_py(), n)
                if role == 0 or len(held) == 128:
                    yield from judged(pivot, query, held)
                    held = []
                if role == 0:
                    pivot, query = p, own
                else:
                    held.append((doc, top, own))
        yield from judged(pivot, query, held)

    fields = [("pivot", pa.int64()), ("doc", pa.int64()), ("top", pa.bool_()), ("linked", pa.bool_()), ("n", pa.int64()), ("size", pa.int64()), ("heads", pa.list_(pa.int64()))]
    return ws.save(blocks.mapInArrow(_streamed(search, fields, 2_000), "pivot bigint, doc bigint, top boolean, linked boolean, n bigint, size bigint, heads array<bigint>"), "stars_searched")


def _families(ws: Workspace, star: DataFrame, ids_at_once: int) -> DataFrame:
    """``star(doc, pivot, top)`` with ``top`` followed up to eight steps: any reference is right, a common one is best."""
    for _ in range(3):
        up = star.select(F.col("doc").alias("top"), F.col("top").alias("_up"))
        star = ws.save(star.join(small(up, ids_at_once), "top", "left").select("doc", "pivot", F.coalesce("_up", "top").alias("top")), "tops")
    return star


def _within_families(ws: Workspace, searched: DataFrame, labels: DataFrame, percent: int, ids_at_once: int) -> DataFrame:
    """Pairs ``(pivot, doc)`` of one family, one of which does not link to the family's top, that can link.

    With ``A`` and ``B`` the residuals of two sets against the same reference, the sets differ in exactly what ``A`` and ``B``
    differ in, and may differ in ``n_a + n_b - 2 T`` elements. As one set does not link to the reference, its residual is larger than
    that, so ``A`` and ``B`` must share ``t = (size_a + size_b - allowed) / 2 >= 1`` elements, and one of the first
    ``size - t + 1`` of either. What all copies of a text have in common is in no residual, so these lists stay short.
    """
    tops = searched.where("top").select("pivot", "doc", "linked", "n", "size", "heads")
    busy = small(ws.save(tops.where(~F.col("linked")).select("pivot").distinct(), "busy"), ids_at_once)
    tops = tops.join(busy, "pivot")
    rows = tops.select(F.posexplode("heads").alias("pos", "key"), "pivot", "doc").select(F.xxhash64("pivot", "key").alias("key"), "doc", "pos")
    rows = rows.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("key")) > 1).where("many").drop("many")  # most elements are one set's own
    own = tops.join(labels, tops["doc"] == labels["v"], "left").select("pivot", F.col("doc").alias("_doc"), "linked", "n", "size", F.coalesce("component", "doc").alias("component"))
    own = small(ws.save(own, "members"), ids_at_once)
    rows = ws.save(rows, "residuals")
    listed = ws.save(rows.join(own, rows["doc"] == own["_doc"]).drop("_doc"), "listed")
    x, y = (listed.select("pivot", "key", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "linked", "n", "size", "component", "pos")]) for s in "xy")
    allowed = F.expr(f"n_x + n_y - 2 * cast(ceil((n_x + n_y) * {percent} / {100 + percent}) as bigint)")
    common = F.ceil((F.col("size_x") + F.col("size_y") - allowed) / 2)
    may = (F.col("component_x") != F.col("component_y")) & (F.col("linked_y") | (F.col("doc_x") < F.col("doc_y")))
    may &= (F.abs(F.col("size_x") - F.col("size_y")) <= allowed) & (F.col("pos_x") <= F.col("size_x") - common) & (F.col("pos_y") <= F.col("size_y") - common)
    on = (x["pivot"] == y["pivot"]) & (x["key"] == y["key"])
    return x.where(~F.col("linked_x")).join(y, on & may).select(F.col("doc_x").alias("pivot"), F.col("doc_y").alias("doc")).distinct()


def _prefix_rows(batches: Iterator[pa.RecordBatch], often: np.ndarray, skip: dict[bytes, int], n: int, percent: int, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """``key, doc, sig, n`` of the prefixes of ``(doc, text)`` rows, sent on as soon as ``size`` rows are there.

    A text of 2,000 bytes has about a hundred, so those of a whole batch of texts are several times its memory.
    """
    rows, held = ([], [], [], []), 0

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=["key", "doc", "sig", "n"])
        for x in rows:
            x.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = shingles(text.as_py(), n)
            if not len(own):
                continue
            sig = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            if skip.get(sig, doc) != doc:
                continue
            head = prefix(own, often, percent)
            for to, x in zip(rows, (head.view(np.int64), doc, int.from_bytes(sig[:8], "little", signed=True), len(own)), strict=True):
                to.append(x.copy() if to is rows[0] else np.full(len(head), x, dtype=np.int64))  # a view would hold the whole set
            held += len(head)
            if held >= size:
                yield sent()
                held = 0
    if held:
        yield sent()


@in_small_batches
def ngram_classes(spark: SparkSession, docs: DataFrame, *, words: int = 5, percent: int = 80, frequent: int = 50_000, one_in: int = 16, ids_at_once: int = 1_000_000, long_list: int = 512, workspace: Workspace | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs(doc_id, text)``.

    ``component_id``: the least ``doc_id`` that links reach. Null texts, and texts without words, have no shingle and link with
    nothing. Rows repeated with their id are one document, returned as often as they are there; if their texts differ, its links
    are those of any. Rows without an id take part in no link and get the class of the documents of equal set, or null. Empty
    tables give no row. Other columns are not read. ``frequent``: at most so many 8-byte hashes are broadcast to order the shingles. ``ids_at_once``: so many
    ids and their tags at most are broadcast to the lists and texts; more are joined by a shuffle. ``long_list``: a member of a list
    this long belongs to a family even where it cannot link to the list's pivot.
    """
    ws = workspace or Workspace(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    often = spark.sparkContext.broadcast(_frequent_shingles(docs, words, frequent, one_in))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingles(text.as_py(), words)
                yield doc, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None

    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary())]
    signed = ws.save(docs.mapInArrow(_streamed(signatures, fields), "doc_id bigint, n_shingles bigint, sig binary"), "signed")
    docs = docs.where("doc_id is not null")
    classes = ws.save(signed.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    large = classes.where("copies > 32").orderBy(F.desc("copies"), "rep").limit(20_000).select("sig", "rep").collect()
    skip = spark.sparkContext.broadcast({bytes(r.sig): r.rep for r in large})  # large groups of copies: only the first goes on

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefix_rows(batches, often.value, skip.value, words, percent)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of lists with two sets at least, one row per set."""
        held = before = None  # an open list's only row so far; the last row seen
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(4)])
            if not rows.shape[1]:
                continue
            ident = rows[[0, 2]]  # key and set
            fresh = np.ones(rows.shape[1], dtype=bool)
            fresh[1:] = (ident[:, 1:] != ident[:, :-1]).any(axis=0)
            fresh[0] = before is None or (ident[:, 0] != before[[0, 2]]).any()
            open_key = before[0] if before is not None and held is None else None
            before, rows = rows[:, -1].copy(), rows[:, fresh]
            if held is not None:
                rows, held = np.concatenate([held[:, None], rows], axis=1), None
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if open_key is not None:
                many |= rows[0] == open_key
            if not many[-1]:
                held = rows[:, -1].copy()
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[[0, 1, 3]][:, many]], names=["key", "doc", "n"])

    listed = docs.mapInArrow(keys, "key bigint, doc bigint, sig bigint, n bigint").repartition(F.col("key")).sortWithinPartitions("key", "sig", "doc")
    lists = ws.save(listed.mapInArrow(shared, "key bigint, doc bigint, n bigint"), "lists")
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    wanted = ws.save(lists.select(F.col("doc").alias("doc_id")).distinct(), "wanted")
    texts = ws.save(docs.join(small(wanted, ids_at_once), "doc_id"), "texts")

    def enough(common, a, b):
        """Sets of sizes ``a`` and ``b`` with so many common prefix shingles can link.

        Of the two prefixes, the one that ends first in the common order meets the other set in its prefix only; what follows
        it adds at most its set's remaining ``T - 1`` shingles.
        """
        rest = lambda n: F.ceil(n * percent / 100) - 1
        return common >= F.ceil((a + b) * percent / (100 + percent)) - F.greatest(rest(a), rest(b))

    # A list's pivot is its most central set: the one with most shingles that others have too.
    met = ws.save(lists.groupBy("doc").agg(F.count(F.lit(1)).alias("met")), "met")
    ranked = lists.join(small(met, ids_at_once), "doc")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("doc")).alias("p"), "n")).alias("best"), F.count(F.lit(1)).alias("listed"))
    pivots = pivots.select("key", (-F.col("best.p")).alias("pivot"), F.col("best.n").alias("pivot_n"), "listed")
    star = ranked.join(pivots, "key").where(F.col("doc") != F.col("pivot")).groupBy("doc", "pivot", "n", "pivot_n").agg(F.count(F.lit(1)).alias("count"), F.max("listed").alias("listed"))
    strong = fits(F.col("n"), F.col("pivot_n")) & enough(F.col("count"), F.col("n"), F.col("pivot_n"))
    choice = F.struct("count", (-F.col("pivot")).alias("p"))
    star = star.groupBy("doc").agg(F.max(F.when(strong, choice)).alias("strong"), F.max(F.when(F.col("listed") >= long_list, choice)).alias("weak"))
    star = ws.save(star.select("doc", (-F.col("strong.p")).alias("pivot"), (-F.col("weak.p")).alias("weak")), "stars")
    led = star.groupBy(F.col("pivot").alias("doc")).count().where(F.col("count") >= 64).select("doc")
    weak = star.where("pivot is null and weak is not null").join(led, "doc", "left_anti").select("doc", "pivot", F.col("weak").alias("top"))
    star = star.where("pivot is not null").select("doc", "pivot", F.col("pivot").alias("top")).union(weak)
    star = _families(ws, ws.save(star, "stars"), ids_at_once)
    near = star.where("pivot is not null")
    asked = star.select(F.col("top").alias("pivot"), "doc", F.lit(True).alias("top")).union(near.where("pivot <> top").select("pivot", "doc", F.lit(False)))
    searched = _search_stars(spark, ws, asked, texts, often, words, percent)
    found = searched.where("linked").select(F.col("pivot").alias("u"), F.col("doc").alias("v"))
    known = searched.where("linked").groupBy(F.col("doc").alias("v")).agg(F.coalesce(F.max(F.when(F.col("top"), F.col("pivot"))), F.min("pivot")).alias("component"))
    for _ in range(2):  # a label two links up is as good here: it only says what need not be compared again
        up = known.select(F.col("v").alias("component"), F.col("component").alias("_up"))
        known = known.join(up, "component", "left").select("v", F.coalesce("_up", "component").alias("component"))
    known = ws.save(known, "labels")
    inside = _within_families(ws, searched, known, percent, ids_at_once)

    tags = known.join(star.select(F.col("doc").alias("v"), F.col("top").alias("family")), "v", "full")
    tags = small(ws.save(tags, "tags"), ids_at_once)
    still = lists.join(tags, lists["doc"] == tags["v"], "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component"), F.coalesce("family", "doc").alias("family"))
    mixed = still.groupBy("key").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a < b").select("key")
    still = ws.save(still.join(small(ws.save(mixed, "mixed"), ids_at_once), "key", "left_semi"), "between")
    x, y = (still.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "component", "family")]) for s in "xy")
    apart = (F.col("component_x") < F.col("component_y")) & (F.col("family_x") != F.col("family_y"))
    pairs = x.join(y, "key").where(apart & fits(F.col("n_x"), F.col("n_y")))
    pairs = pairs.groupBy(F.col("doc_x").alias("pivot"), F.col("doc_y").alias("doc"), "n_x", "n_y").count()
    pairs = pairs.where(enough(F.col("count"), F.col("n_x"), F.col("n_y"))).select("pivot", "doc")
    more = _verify(spark, ws, ws.save(inside.union(pairs), "pairs"), texts, words, percent)
    joined = components(found.union(more.select("u", "v")), ws)

    final = classes.join(joined, classes["rep"] == joined["v"], "left").select(F.col("sig").alias("_sig"), F.coalesce("component", "rep").alias("component_id"))
    return signed.join(final, signed["sig"] == final["_sig"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
