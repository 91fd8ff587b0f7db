"""Exact removal of repeated passages: every byte in a string of ``length`` bytes that starts anywhere else as well.

Only suffixes that can matter are sorted. In each window of ``length`` bytes one anchor is chosen by content (the ``k``-gram
of least hash), so equal windows have the same anchor at the same place. Anchors whose ``k``-gram occurs once are dropped by
a sorted shuffle. What is left is grouped by ``k``-gram, and each group's suffixes are ordered by deep-shallow sorting:
multikey quicksort to a shallow depth, then a blind trie for each set of strings that still agree. The sorted order gives
common prefixes to the right of the anchors; with what agrees to their left, a window is repeated if both together reach
``length``. Bytes are compared throughout; hashes only bring rows together.

A group of more than ``group_bound`` anchors is split until its parts are small. Equal contexts become one class, which is repeated
as a whole if it has two members. If more classes than the bound are left, each window chooses a further anchor, a longer ``k``-gram,
and the classes are split by it and by its distance from the last one; at most, a ``k``-gram is a whole window, and windows that still meet
are classes of equal bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm.decontamination import small
from panelwright.llm.quality_rules import SPACE
from panelwright.llm.shared import Workspace

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_SEGMENT = 1 << 20
_INDEX = np.uint64((1 << 21) - 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse, modulo 2**64. A worker keeps no more than its longest text took."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(max(n, min(1 << max(12, (n - 1).bit_length()), _SEGMENT + 4096)), np.uint64(base))
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def window_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-byte windows of at most a segment of bytes."""
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(raw) - k + 1]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def anchors(raw: np.ndarray, length: int, k: int) -> np.ndarray:
    """Rows ``key, anchor, first start, last start``: each window start of ``length`` bytes is in one row's range, each anchor in one row."""
    out = []
    for at in range(0, len(raw) - length + 1, _SEGMENT):
        part = raw[at : at + _SEGMENT + length - 1]
        h = window_hashes(part, k)
        v = (h & ~_INDEX) | np.arange(len(h), dtype=np.uint64)
        width, step = length - k + 1, 1
        while 2 * step <= width:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        v = np.minimum(v[: len(part) - length + 1], v[width - step : width - step + len(part) - length + 1])
        where = (v & _INDEX).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        ends = np.append(begins[1:], len(where)) - 1
        a = where[begins]
        out.append(np.stack([h[a].view(np.int64), a + at, begins + at, ends + at]))
    if not out:
        return np.zeros((4, 0), dtype=np.int64)
    rows = np.concatenate(out, axis=1)
    begins = np.flatnonzero(np.concatenate([[True], rows[1, 1:] != rows[1, :-1]]))  # an anchor goes on in the next segment
    return np.concatenate([rows[:3, begins], rows[3:, np.append(begins[1:], rows.shape[1]) - 1]])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n - 1  # a[:lo] agrees, a[:hi + 1] does not
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Node:
    """A branch of a blind trie: at byte ``depth`` its children differ. Bytes on the way to it are not stored."""

    __slots__ = ("depth", "keys", "kids")

    def __init__(self, depth: int) -> None:
        self.depth, self.keys, self.kids = depth, [], []

    def put(self, key: int, kid: "_Node | int") -> None:
        k = bisect_left(self.keys, key)
        self.keys.insert(k, key)
        self.kids.insert(k, kid)


def blind_trie_order(strings: list[bytes], items: list[int], depth: int) -> list[int]:
    """``items`` in order of their (distinct) strings, all of which agree on the first ``depth`` bytes."""
    byte = lambda s, d: s[d] if d < len(s) else -1
    root: _Node | int = items[0]
    for item in items[1:]:
        s, node, path = strings[item], root, []
        while isinstance(node, _Node):  # blind descent: only the branching bytes are looked at
            path.append(node)
            key = byte(s, node.depth)
            k = bisect_left(node.keys, key)
            node = node.kids[k if k < len(node.keys) and node.keys[k] == key else 0]
        other = strings[node]
        lcp = common_prefix(s, other, depth)
        while path and path[-1].depth > lcp:
            path.pop()
        if path and path[-1].depth == lcp:
            path[-1].put(byte(s, lcp), item)
            continue
        branch = _Node(lcp)
        if path:
            up = path[-1]
            k = up.keys.index(byte(s, up.depth))
            below, up.kids[k] = up.kids[k], branch
        else:
            below, root = root, branch
        branch.put(byte(other, lcp), below)
        branch.put(byte(s, lcp), item)
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack.extend(reversed(node.kids))
        else:
            order.append(node)
    return order


def deep_shallow_order(strings: list[bytes], depth: int = 0, shallow: int = 8) -> list[int]:
    """Order of distinct strings that agree on ``depth`` bytes: multikey quicksort ``shallow`` bytes deep, then blind tries."""
    byte = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    order: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        items, d = stack.pop()
        if len(items) < 2:
            order += items
        elif d >= depth + shallow:
            order += blind_trie_order(strings, items, d)
        else:
            pivot = sorted(byte(i, d) for i in (items[0], items[len(items) // 2], items[-1]))[1]
            less, same, more = [], [], []
            for i in items:
                b = byte(i, d)
                (same if b == pivot else less if b < pivot else more).append(i)
            stack += [(more, d), (same, d + 1 if pivot >= 0 else depth + shallow), (less, d)]
    return order


def repeated_windows(contexts: list[bytes], offsets: list[int], lengths: tuple[int, ...], k: int) -> list[list[tuple[int, int] | None]]:
    """For each length and context (bytes around an anchor of one ``k``-gram) the bytes before and after the anchor that are repeated.

    ``offsets``: of the anchors. ``None`` where no window of that length over the anchor occurs in another context.
    """
    every: list[list[tuple[int, int] | None]]
    grams: dict[bytes, list[int]] = {}
    for i, (text, o) in enumerate(zip(contexts, offsets, strict=True)):
        grams.setdefault(text[o : o + k], []).append(i)
    if len(grams) > 1:  # other bytes of one hash
        every = [[None] * len(contexts) for _ in lengths]
        for own in grams.values():
            for n, found in enumerate(repeated_windows([contexts[i] for i in own], [offsets[i] for i in own], lengths, k)):
                for i, x in zip(own, found, strict=True):
                    every[n][i] = x
        return every
    first: dict[tuple[bytes, int], int] = {}
    twin = [first.setdefault(x, i) for i, x in enumerate(zip(contexts, offsets, strict=True))]
    every = [[None] * len(contexts) for _ in lengths]
    for i, t in enumerate(twin):
        if t != i:
            for found, length in zip(every, lengths, strict=True):
                if len(contexts[i]) >= length:
                    found[i] = found[t] = offsets[i], len(contexts[i]) - offsets[i]
    if len(first) == 1:
        return every
    own = list(first.values())
    right: dict[bytes, list[int]] = {}
    for i in own:
        right.setdefault(contexts[i][offsets[i] :], []).append(i)
    texts = list(right)
    order = [i for r in deep_shallow_order(texts, k) for i in right[texts[r]]]
    suffix = {i: contexts[i][offsets[i] :] for i in order}
    lcp = [common_prefix(suffix[a], suffix[b], k) for a, b in zip(order, order[1:], strict=False)]
    left = {i: contexts[i][: offsets[i]][::-1] for i in order}
    if len(order) <= 16:
        for x, a in enumerate(order):
            r = len(suffix[a])
            for y in range(x + 1, len(order)):
                r, b = min(r, lcp[y - 1]), order[y]
                reach = common_prefix(left[a], left[b])
                for found, length in zip(every, lengths, strict=True):
                    if reach + r >= length:
                        for i in (a, b):
                            was = found[i] or (0, 0)
                            found[i] = max(was[0], reach), max(was[1], r)
        return every
    reach = np.array([offsets[i] for i in order])
    backs = sorted(set(left.values()))
    place = {x: i for i, x in enumerate(backs)}
    at = np.array([place[left[i]] for i in order])
    agree = np.array([common_prefix(a, b) for a, b in zip(backs, backs[1:], strict=False)], dtype=np.int64)
    room, lcps = np.array([len(suffix[i]) for i in order]), np.array(lcp)
    low, high = [np.full(len(order), n) for n in lengths], [np.full(len(order), -1) for _ in lengths]
    for o in range(int(reach.max()) + 1):  # windows that begin o bytes before the anchor
        before = np.concatenate([[0], np.cumsum(agree < o)])[at]  # one number for those that agree on o bytes to the left
        for n, length in enumerate(lengths):
            may = np.flatnonzero((room >= length - o) & (reach >= o))
            if len(may) < 2:
                continue
            runs = np.concatenate([[0], np.cumsum(lcps < length - o)])
            _, where, counts = np.unique((before * len(order) + runs)[may], return_inverse=True, return_counts=True)
            hit = may[counts[where] > 1]
            low[n][hit] = np.minimum(low[n][hit], o)
            high[n][hit] = np.maximum(high[n][hit], o)
    for n, length in enumerate(lengths):
        for x, i in enumerate(order):
            if high[n][x] >= 0:
                was = every[n][i] or (0, 0)
                every[n][i] = max(was[0], int(high[n][x])), max(was[1], length - int(low[n][x]))
    return every


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; touching ones join."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


Batches = Iterator[pa.RecordBatch]
_CONTEXT = ("key", "item", "start", "o", "last", "around")


def _contexts(length: int, hot: bool) -> Callable[[Batches], Batches]:
    """Bytes around the anchors of ``doc_id, raw, anchors`` whose groups are hot, or of those whose groups are not."""

    def contexts(batches: Batches) -> Batches:
        held, rows = [], 0
        for batch in batches:
            for doc, raw, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                of, body = found.values.field("hot").to_numpy(zero_copy_only=False) == hot, memoryview(raw.as_buffer())
                every = [found.values.field(c).to_numpy()[of] for c in ("key", "a", "lo", "hi")]
                for i in range(0, len(every[0]), 20_000):
                    key, a, lo, hi = (x[i : i + 20_000] for x in every)
                    around = pa.array([body[i:j].tobytes() for i, j in zip(lo.tolist(), (hi + length).tolist(), strict=True)], pa.binary())
                    columns = [pa.array(key).cast(pa.string()), pa.array(np.full(len(key), doc)), pa.array(lo), pa.array((a - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), around]
                    held.append(pa.RecordBatch.from_arrays(columns, names=list(_CONTEXT)))
                    rows += len(key)
                    if rows >= 20_000:
                        yield pa.concat_batches(held)
                        held, rows = [], 0
        if held:
            yield pa.concat_batches(held)

    return contexts


def _cover(lengths: tuple[int, ...], k: int) -> Callable[[Batches], Batches]:
    """``item, s, e, n`` from ``key, item, start, o, around`` in order of the key."""

    def cover(batches: Batches) -> Batches:
        key, items, starts, offsets, around = None, [], [], [], []
        out: list[tuple] = []
        kind = pa.int64()

        def close() -> None:
            if len(items) > 1:
                for n, found in zip(lengths, repeated_windows(around, offsets, lengths, k), strict=True):
                    out.extend((item, start + o - x[0], start + o + x[1], n) for item, start, o, x in zip(items, starts, offsets, found, strict=True) if x is not None)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["item", "s", "e", "n"])

        for batch in batches:
            kind = batch.column(1).type
            for now, item, start, o, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if now != key:
                    close()
                    key, items, starts, offsets, around = now, [], [], [], []
                items.append(item)
                starts.append(start)
                offsets.append(o)
                around.append(text)
            if out:
                yield batch_of()
                out.clear()
        close()
        if out:
            yield batch_of()

    return cover


def _split(least: int, length: int, k: int) -> Callable[[Batches], Batches]:
    """Contexts around further anchors, ``k``-grams of the windows that the given contexts hold.

    Equal windows have equal anchors at equal places, so the distance of the new anchor from the last one belongs to the key. It
    also keeps two anchors of one text apart whose windows share bytes.
    """

    def split(batches: Batches) -> Batches:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(_CONTEXT))

        for batch in batches:
            for key, item, start, o, last, text in zip(*[batch.column(c).to_pylist() for c in _CONTEXT], strict=True):
                for h, a, lo, hi in anchors(np.frombuffer(text[: last + least], dtype=np.uint8), least, k).T.tolist():
                    out.append((f"{key}:{a - o}:{h}", item, start + lo, a - lo, hi - lo, text[lo : hi + length]))
                if len(out) >= 10_000:
                    yield batch_of()
                    out.clear()
        if out:
            yield batch_of()

    return split


class RepeatedPassages:
    """The repeated passages of ``docs(doc_id, text)``; null texts are empty.

    Texts are UTF-8 bytes; matches stay inside a document. Texts shorter than ``length`` have none. A text that is there more
    than once is repeated as a whole (if it is long enough), and only its first copy is searched. Each row is a place of its own,
    also where its id is null or there before: such tables are numbered anew for the search. With ``min_words``, runs of fewer
    words (parts of words at the ends count) stay. Empty tables give no row; other columns are not read.

    ``passages``, two numbers ``(bytes, words)`` of which the first is at most ``length``, lets the same search report a second
    thing beside what is cut: the runs of that many words that strings of that many bytes cover which occur elsewhere too.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, *, length: int = 400, k: int = 32, min_words: int = 0, passages: tuple[int, int] | None = None, group_bound: int = 20_000, ids_at_once: int = 1_000_000, workspace: Workspace | None = None) -> None:
        self.spark, self.length, self.k, self.min_words, self.bound, self.ids_at_once = spark, length, k, min_words, group_bound, ids_at_once
        self.passages = passages
        self.lengths = tuple(sorted({length, *(passages or ())[:1]}))
        if self.lengths[-1] != length:
            raise ValueError("passages can't be longer than length")
        self.ws = workspace or Workspace(spark, "suffix-dedup")
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
        self.numbered = None
        signed = self._sign()
        rows, ids = signed.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
        if rows != ids:
            own = self.ws.save(self.docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "raw"), "numbered")
            self.numbered, self.docs = own.select("row", F.col("doc_id").alias("given")), own.select(F.col("row").alias("doc_id"), "raw")
            signed = self._sign()
        self.signed = signed
        self._find()

    def _sign(self) -> DataFrame:
        words = [F.size(F.array_remove(F.split(F.col("raw").cast("string"), SPACE), "")).cast("bigint").alias("n_words")] if self.passages else []
        return self.ws.save(self.docs.select("doc_id", F.length("raw").cast("bigint").alias("n_bytes"), F.unhex(F.sha2("raw", 256)).alias("sha"), *words), "signed")

    def _given(self, df: DataFrame) -> DataFrame:
        """``df`` under the ids that the rows came with."""
        if self.numbered is None:
            return df
        joined = df.join(self.numbered, df["doc_id"] == self.numbered["row"])
        return joined.select(*[F.col("given").alias(c) if c == "doc_id" else F.col(c) for c in df.columns])

    def _find(self) -> None:
        ws, lengths, k = self.ws, self.lengths, self.k
        least, length = lengths[0], lengths[-1]
        copies = self.signed.where(F.col("n_bytes") >= least).groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        self.copies = ws.save(copies, "copies")
        large = self.copies.where("copies > 32").orderBy(F.desc("copies"), "rep").limit(20_000).collect()
        skip = self.spark.sparkContext.broadcast({bytes(r.sha): r.rep for r in large})  # large groups of copies: only the first goes on

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = text.as_buffer()
                    if raw is None or raw.size < least:
                        continue
                    sha = hashlib.sha256(raw).digest()
                    if skip.value.get(sha, doc) != doc:
                        continue
                    found = anchors(np.frombuffer(raw, dtype=np.uint8), least, k)
                    rows.append(np.concatenate([found, np.full((1, found.shape[1]), doc), np.full((1, found.shape[1]), int.from_bytes(sha[:8], "little", signed=True))]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(rows, axis=1)], names=["key", "a", "lo", "hi", "doc", "sha"])

        def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of keys that are there twice at least, when a text's further copies are left out."""
            held, before = None, None  # an open key's only row so far; the last row seen
            for batch in batches:
                rows = np.stack([batch.column(i).to_numpy() for i in range(6)])
                if not rows.shape[1]:
                    continue
                ident = rows[[0, 5, 1]]  # key, text, anchor
                fresh = np.ones(rows.shape[1], dtype=bool)
                fresh[1:] = (ident[:, 1:] != ident[:, :-1]).any(axis=0)
                fresh[0] = before is None or (ident[:, 0] != before[[0, 5, 1]]).any()
                goes_on = before is not None and held is None
                last_key, before = (before[0] if goes_on else None), rows[:, -1].copy()
                rows = rows[:, fresh]
                if held is not None:
                    rows = np.concatenate([held[:, None], rows], axis=1)
                    held = None
                if not rows.shape[1]:
                    continue
                key = rows[0]
                same = key[1:] == key[:-1]
                many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                if goes_on:
                    many |= key == last_key
                if not many[-1]:
                    held = rows[:, -1].copy()
                if many.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[[0, 4, 1, 2, 3]][:, many]], names=["key", "doc", "a", "lo", "hi"])

        kinds = "key bigint, a bigint, lo bigint, hi bigint, doc bigint, sha bigint"
        found = self.docs.mapInArrow(find, kinds).repartition(F.col("key")).sortWithinPartitions("key", "sha", "a", "doc")
        shared = ws.save(found.mapInArrow(repeated, "key bigint, doc bigint, a bigint, lo bigint, hi bigint"), "anchors")
        hot = shared.groupBy("key").count().where(F.col("count") > self.bound).select(F.col("key").alias("hot_key"))
        marked = shared.join(hot, shared["key"] == hot["hot_key"], "left").select(*shared.columns, F.col("hot_key").isNotNull().alias("hot"))
        by_doc = marked.groupBy("doc").agg(F.collect_list(F.struct("key", "a", "lo", "hi", "hot")).alias("anchors"))
        wanted = small(ws.save(shared.select(F.col("doc").alias("doc_id")).distinct(), "wanted"), self.ids_at_once)
        texts = self.docs.join(wanted, "doc_id", "left_semi")
        self.searched = ws.save(by_doc.join(texts, by_doc["doc"] == texts["doc_id"]).select("doc_id", "raw", "anchors"), "searched")

        near = self.searched.mapInArrow(_contexts(length, False), "key string, item bigint, start bigint, o int, last int, around binary")
        covered = self._compare(near, k, "bigint")
        if not hot.isEmpty():
            within = self.searched.where(F.exists("anchors", lambda x: x["hot"]))
            within = within.mapInArrow(_contexts(length, True), "key string, item bigint, start bigint, o int, last int, around binary")
            covered = covered.union(self._resolve(within.withColumn("item", F.col("item").cast("string")), k, "hot").withColumn("item", F.col("item").cast("bigint")))
        covered = covered.withColumnRenamed("item", "doc")
        self.covered = ws.save(covered, "covered")

    def _compare(self, rows: DataFrame, k: int, kind: str) -> DataFrame:
        """``item, s, e, n``: what of each context is repeated in its group, a group in one task."""
        near = rows.select("key", "item", "start", "o", "around").repartition(F.col("key")).sortWithinPartitions("key")
        return near.mapInArrow(_cover(self.lengths, k), f"item {kind}, s bigint, e bigint, n bigint")

    def _resolve(self, rows: DataFrame, k: int, name: str) -> DataFrame:
        """As :meth:`_compare` with groups of any size, from ``key, item, start, o, last, around``, where windows start at 0 to ``last``.

        A class is one ``key, o, last`` and one string of bytes, which Spark's grouping compares. Only classes go on, and what is found in
        them comes back to their members; a class of very many members is salted in that join.
        """
        ws, (least, length) = self.ws, (self.lengths[0], self.lengths[-1])
        cls = F.sha2(F.concat_ws(":", "key", "o", "last", F.hex("around")), 256).alias("cls")
        rows = ws.save(rows, f"{name}-rows")
        classes = ws.save(rows.groupBy("key", "o", "last", "around").agg(F.count(F.lit(1)).alias("members")).select("*", cls), f"{name}-classes")
        whole = [classes.where((F.col("members") > 1) & (F.octet_length("around") >= n)).select(F.col("cls").alias("item"), F.lit(0).cast("bigint").alias("s"), F.octet_length("around").cast("bigint").alias("e"), F.lit(n).cast("bigint").alias("n")) for n in self.lengths]
        large = ws.save(classes.groupBy("key").count().where(F.col("count") > self.bound).select(F.col("key").alias("large_key")), f"{name}-large")
        inner = classes.select("key", F.col("cls").alias("item"), F.lit(0).cast("bigint").alias("start"), "o", "last", "around")
        found = self._compare(inner.join(large, inner["key"] == large["large_key"], "left_anti"), k, "string")
        for df in whole:
            found = found.union(df)
        if not large.isEmpty():
            rest = inner.join(large, inner["key"] == large["large_key"], "left_semi")
            if k < least:
                longer = min(2 * k, least)
                parts = rest.mapInArrow(_split(least, length, longer), "key string, item string, start bigint, o int, last int, around binary")
                found = found.union(self._resolve(parts, longer, f"{name}-{longer}"))
            else:  # each is one window of the greatest length, and only shorter ones are open
                for n in self.lengths[:-1]:
                    short = rest.withColumn("around", F.substring("around", 1, n))
                    twice = short.groupBy("key", "around").count().where("count > 1").withColumnsRenamed({"key": "_key", "around": "_around"})
                    twice = short.join(twice, (F.col("key") == F.col("_key")) & (F.col("around") == F.col("_around")), "left_semi")
                    found = found.union(twice.select("item", F.lit(0).cast("bigint").alias("s"), F.octet_length("around").cast("bigint").alias("e"), F.lit(n).cast("bigint").alias("n")))
        salts = F.when(F.col("members") > self.bound, 32).otherwise(1)
        sizes = classes.select("cls", salts.alias("salts"))
        found = found.join(sizes, found["item"] == sizes["cls"]).select("cls", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "s", "e", "n")
        members = rows.select("item", "start", cls)
        crowded = classes.where(F.col("members") > self.bound).select(F.col("cls").alias("_cls"))
        members = members.join(crowded, members["cls"] == crowded["_cls"], "left")
        members = members.select("item", "start", "cls", F.when(F.col("_cls").isNotNull(), F.pmod(F.xxhash64("item", "start"), F.lit(32))).otherwise(0).cast("int").alias("salt"))
        return members.join(found, ["cls", "salt"]).select("item", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"), "n")

    def _cut(self, texts: DataFrame) -> DataFrame:
        """``doc_id, spans, kept, text, passage_words`` from ``doc_id, raw, found``."""
        min_words, length, (passage_bytes, passage_words) = self.min_words, self.length, self.passages or (0, 0)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs, spans, kept, text, words = [], [], [], [], []
                for doc, raw, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    body, at, parts = raw.as_py(), 0, []
                    runs = merge_spans([(x["s"], x["e"]) for x in found or () if x["n"] == length])
                    runs = [(s, e) for s, e in runs if not min_words or len(body[s:e].split()) >= min_words]
                    for s, e in runs:
                        parts.append(body[at:s])
                        at = e
                    docs.append(doc)
                    spans.append([{"s": s, "e": e} for s, e in runs])
                    kept.append(b"".join([*parts, body[at:]]))
                    text.append(kept[-1].decode("utf-8", "ignore"))
                    counts = [len(body[s:e].split()) for s, e in merge_spans([(x["s"], x["e"]) for x in found or () if x["n"] == passage_bytes])]
                    words.append(sum(n for n in counts if n >= passage_words))
                span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(text, pa.string()), pa.array(words, pa.int64())], names=["doc_id", "spans", "kept", "text", "passage_words"])

        return texts.mapInArrow(cut, "doc_id bigint, spans array<struct<s:bigint,e:bigint>>, kept binary, text string, passage_words bigint")

    def _spans_by_doc(self) -> DataFrame:
        return self.covered.groupBy("doc").agg(F.collect_list(F.struct("s", "e", "n")).alias("found"))

    def _with_copies(self) -> DataFrame:
        copies = self.copies.select(F.col("sha").alias("_sha"))
        return self.signed.join(copies, self.signed["sha"] == copies["_sha"], "left").select(*self.signed.columns, F.col("_sha").isNotNull().alias("copied"))

    def digests(self) -> DataFrame:
        """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; only searched texts are read again.

        With ``passages`` also ``n_passage_words``: words in its runs; a text that is there more than once is one run.
        """
        spans = self._spans_by_doc()
        every = self._with_copies()
        once = every.where(~F.col("copied")).select(F.col("doc_id").alias("once"))
        cut = self.searched.join(spans, self.searched["doc_id"] == spans["doc"]).join(once, F.col("doc_id") == F.col("once"), "left_semi").select("doc_id", "raw", "found")
        cut = self._cut(cut).select(F.col("doc_id").alias("doc"), F.length("kept").cast("bigint").alias("left"), F.size("spans").cast("bigint").alias("n"), F.sha2("kept", 256).alias("hex"), "passage_words")
        df = every.join(cut, every["doc_id"] == cut["doc"], "left")
        zero, copied = F.lit(0).cast("bigint"), F.col("copied") & (F.col("n_bytes") >= self.length)
        more = []
        if self.passages:
            whole = F.when(F.col("n_words") >= self.passages[1], F.col("n_words")).otherwise(zero)
            more = [F.when(F.col("copied"), whole).otherwise(F.coalesce("passage_words", zero)).alias("n_passage_words")]
        df = df.select(
            "doc_id",
            "n_bytes",
            F.when(copied, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("left"), zero)).alias("n_removed"),
            F.when(copied, F.lit(1).cast("bigint")).otherwise(F.coalesce("n", zero)).alias("n_spans"),
            F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("hex", F.lower(F.hex("sha")))).alias("kept_sha256"),
            *more,
        )
        return self._given(df)

    def texts(self) -> DataFrame:
        """``doc_id, sha, spans, kept, text`` of the rows that lose some; all others are whole.

        ``sha``: SHA-256 of the input text, which alone decides what a row loses. ``kept``: the remaining bytes. ``text``: the same
        without parts of characters that a cut went through. A text that is there more than once and has fewer than ``min_words``
        words is whole.
        """
        spans = self._spans_by_doc()
        every = self._with_copies()
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("s"), F.col("n_bytes").alias("e")))
        copied = every.where(F.col("copied") & (F.col("n_bytes") >= self.length)).select("doc_id", "sha", whole.alias("spans"), F.lit("").cast("binary").alias("kept"), F.lit("").alias("text"))
        if self.min_words:
            enough = self.docs.where(F.size(F.array_remove(F.split(F.col("raw").cast("string"), SPACE), "")) >= self.min_words).select("doc_id")
            copied = copied.join(enough, "doc_id", "left_semi")
        once = every.where(~F.col("copied")).select(F.col("doc_id").alias("once"), "sha")
        partly = self.searched.join(spans, self.searched["doc_id"] == spans["doc"]).join(once.select("once"), F.col("doc_id") == F.col("once"), "left_semi").select("doc_id", "raw", "found")
        partly = self._cut(partly).where(F.size("spans") > 0).join(once, F.col("doc_id") == F.col("once")).select("doc_id", "sha", "spans", "kept", "text")
        return self._given(copied.union(partly))
