from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import graph, ngram_join, suffix_dedup
from panelwright.llm.shared import Workspace
from tests.llm import brute


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def test_ngram_classes_equal_brute_force(spark):
    docs = brute.corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(spark, frame(spark, docs)).collect()}
    assert got == brute.near_classes(docs)


def test_ngram_classes_with_frequent_shingles_first_or_last(spark):
    docs = brute.corpus(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(spark, frame(spark, docs), one_in=1, frequent=50).collect()}
    assert got == brute.near_classes(docs)


def variants(rng: random.Random, words: list[str], many: int, most: float) -> list[str]:
    """Copies with random words exchanged, cut off or put in, up to a share of ``most``."""
    out = []
    for _ in range(many):
        w = list(words)
        for _ in range(int(rng.random() * most * len(w))):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 3])] = [brute.prose(rng, 1)] * rng.choice([0, 1])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("long_list", [3, 32])
def test_ngram_classes_of_large_groups_of_near_copies(spark, long_list):
    """Most members do not link to the original, many to a few others; a passage joins two groups, and prefixes of one text."""
    rng = random.Random(21)
    one, two = (brute.prose(rng, 140).split() for _ in range(2))
    texts = variants(rng, one, 130, 0.12) + variants(rng, two, 40, 0.2) + variants(rng, one[:60] + two[:70], 40, 0.1) + [" ".join(one[:k]) for k in range(60, 140, 4)]
    texts += variants(rng, variants(rng, one, 1, 0.2)[0].split(), 60, 0.06) + [brute.prose(rng, 60) + " " + " ".join(one[20:60]) for _ in range(25)]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 1))
    got = ngram_join.ngram_classes(spark, frame(spark, docs), one_in=1, frequent=200, long_list=long_list)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.near_classes(docs)


@pytest.mark.parametrize("percent", [50, 60, 70, 90])
def test_ngram_classes_at_other_similarities(spark, percent):
    """Families of very unequal sizes: prefixes of a text, variants and mixtures."""
    rng = random.Random(percent)
    one, two = (brute.prose(rng, 90).split() for _ in range(2))
    texts = [" ".join(one[:k]) for k in range(8, 90, 2)] + [" ".join(one[k:]) for k in range(2, 50, 3)] + variants(rng, one, 30, 0.06) + variants(rng, one[:40] + two[:40], 30, 0.04) + variants(rng, two[:30], 30, 0.05)
    rng.shuffle(texts)
    docs = list(enumerate(texts, 1))
    got = ngram_join.ngram_classes(spark, frame(spark, docs), percent=percent, one_in=1, frequent=50, long_list=3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.near_classes(docs, percent)


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 90])
def test_residual_prefix_by_enumeration(percent):
    """A linked member's residual and one that is not linked, of a common reference: what two linked sets must share is in the prefix."""
    most = lambda a, b: a + b - 2 * ngram_join.required_overlap(a, b, percent)
    for reference in range(5, 36, 3):
        for n in range(5, 36):
            for size in range(1, most(n, reference) + 1):
                prefix = ngram_join.residual_prefix(n, reference, size, True, percent)
                for m in range(max(1, n * percent // 100), n * 100 // percent + 1):
                    least = most(m, reference) + 1  # the other is not linked to the reference
                    shared = -(-(size + least - most(n, m)) // 2)
                    assert shared <= 0 or shared > size or prefix >= size - shared + 1, (n, m, reference, size)


def test_ngram_classes_of_rows_without_id_and_small_batches(spark):
    docs = brute.corpus(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = ngram_join.ngram_classes(spark, frame(spark, [*docs, (None, docs[20][1]), (None, "nobody else has these words here"), (None, None)])).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute.near_classes(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    copies = [want[d][1] for d, t in docs if t == docs[20][1]]
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == sorted([str(copies[0]), "None", "None"]) and len(rows) == len(docs) + 3


def test_ngram_prefixes_leave_a_worker_in_bounded_batches():
    """A batch of many texts is not answered by one of all their prefixes; the rows are those of each text alone."""
    rng = random.Random(8)
    texts = [brute.prose(rng, rng.randrange(0, 400)).encode() for _ in range(300)] + [None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    often = ngram_join.shingles(texts[0])
    skip = {hashlib.blake2b(ngram_join.shingles(texts[3]).tobytes(), digest_size=16).digest(): 2}
    out = list(ngram_join._prefix_rows(iter([batch, batch]), often, skip, 5, 80, size=500))
    assert len(out) > 10 and max(b.num_rows for b in out) < 500 + 400
    want = []
    for d, own in enumerate(map(ngram_join.shingles, texts)):
        if d != 3:
            want += [(int(k), d, len(own)) for k in ngram_join.prefix(own, often, 80).view(np.int64)]
    assert [(r["key"], r["doc"], r["n"]) for b in out for r in b.to_pylist()] == want * 2
    assert len(ngram_join._HASHES) <= 100_000


def test_ngram_classes_take_texts_in_small_batches_and_put_the_setting_back(spark, monkeypatch):
    name, seen, save = "spark.sql.execution.arrow.maxBytesPerBatch", set(), Workspace.save
    before = spark.conf.get(name)
    monkeypatch.setattr(Workspace, "save", lambda self, *a: (seen.add(spark.conf.get(name)), save(self, *a))[1])
    assert ngram_join.ngram_classes(spark, frame(spark, [(1, "a b c"), (2, "a b c")])).count() == 2
    assert {int(x.rstrip("b")) for x in seen} == {4 << 20} and spark.conf.get(name) == before


def test_ngram_edge_cases(spark):
    assert ngram_join.ngram_classes(spark, frame(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, "", "b"), (3, "Same words", "c"), (4, "same  WORDS", "d"), (4, "same  WORDS", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted(tuple(r) for r in ngram_join.ngram_classes(spark, df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3)]


def test_t_occurrence_equals_counting():
    rng = np.random.default_rng(1)
    for _ in range(30):
        query = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
        block = [query.copy()]
        for _ in range(20):
            own = query[rng.random(len(query)) > rng.random() * 0.3]
            block.append(np.unique(np.concatenate([own, rng.integers(400, 800, rng.integers(0, 40)).astype(np.uint64)])))
        want = []
        for d, own in enumerate(block):
            n = len(np.intersect1d(query, own))
            if n and 100 * n >= 80 * (len(query) + len(own) - n):
                want.append((d, n))
        assert sorted(ngram_join.t_occurrence(query, block, 80)) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(500, 500)] + [(300, 200), (200, 250)]
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), Workspace(spark, "test")).collect()}
    assert {got[i] for i in range(1, 61)} == {1}
    assert {got[i] for i in range(100, 160)} == {100}
    assert {got[i] for i in (200, 250, 300)} == {200}


def test_components_end_when_the_edges_do(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), Workspace(spark, "t")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("bound", [20_000, 4])
def test_suffix_dedup_equals_brute_force(spark, bound):
    """A bound of four sends most groups the way of groups too large for one task."""
    docs = brute.corpus()
    found = suffix_dedup.RepeatedPassages(spark, frame(spark, docs), group_bound=bound)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.digests().collect()}
    want = brute.repeats(docs)
    assert got == want
    texts = {r.doc_id: r for r in found.texts().collect()}
    assert {d for d, x in want.items() if x[1]} == set(texts)
    assert all(sum(s.e - s.s for s in r.spans) == want[d][1] for d, r in texts.items())


def test_suffix_dedup_of_periodic_and_long_texts(spark):
    rng = random.Random(2)
    docs = [(1, "ab" * 900), (2, "For " * 300), (3, brute.prose(rng, 900)), (4, None), (5, "é" * 199), (6, "é" * 200), (7, "é" * 200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.RepeatedPassages(spark, frame(spark, docs)).digests().collect()}
    assert got == brute.repeats(docs)
    assert suffix_dedup.RepeatedPassages(spark, frame(spark, [])).digests().count() == 0


def test_suffix_dedup_of_short_runs_by_words(spark):
    docs = brute.corpus(8)
    found = suffix_dedup.RepeatedPassages(spark, frame(spark, docs), length=200, min_words=51)
    want = brute.repeats(docs, 200, 51)
    texts = {r.doc_id: r for r in found.texts().collect()}
    assert {d: sum(s.e - s.s for s in r.spans) for d, r in texts.items()} == {d: x[1] for d, x in want.items() if x[1]}
    assert all(hashlib.sha256(r.kept).hexdigest() == want[d][3] for d, r in texts.items())


@pytest.mark.parametrize("bound", [20_000, 4])
def test_suffix_dedup_with_passages_equals_brute_force(spark, bound):
    """One search gives both what 400-byte strings cover and the words that 200-byte strings of over 50 words cover."""
    docs = brute.corpus(12)
    short = " ".join([w for w in brute.prose(random.Random(6), 400).split() if len(w) <= 6][:55])  # more than 50 words, fewer than 400 bytes
    assert 200 <= len(short.encode()) < 400
    docs += [(9000 + i, brute.prose(random.Random(60 + i), 80) + " " + short + " " + brute.prose(random.Random(70 + i), 80)) for i in range(3)] + [(9100, short), (9101, short)]
    found = suffix_dedup.RepeatedPassages(spark, frame(spark, docs), passages=(200, 51), group_bound=bound)
    rows = {r.doc_id: r for r in found.digests().collect()}
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in rows.items()} == brute.repeats(docs)
    want = brute.repeats(docs, 200, 51)
    assert {d for d, r in rows.items() if r.n_passage_words} == {d for d, x in want.items() if x[1]}
    assert all(r.n_passage_words >= 51 for d, r in rows.items() if d >= 9000)


def test_suffix_dedup_of_rows_without_or_with_the_same_id(spark):
    """Every row is a place of its own."""
    docs = brute.corpus(4)[:60]
    odd = [(None if k % 5 == 0 else d // 20, t) for k, (d, t) in enumerate(docs)] + [docs[3], docs[3]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in suffix_dedup.RepeatedPassages(spark, frame(spark, odd)).digests().collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute.repeats([(i, t) for i, (_, t) in enumerate(odd)])
    assert sorted(map(str, got)) == sorted(str((d, *want[i])) for i, (d, _) in enumerate(odd))


def test_suffix_dedup_at_segment_boundaries(spark):
    """Passages of digits that start at, or just after, the second and third segment of a text of over 2 MiB."""
    rng = random.Random(11)
    text = lambda letters, n: "".join(rng.choices(letters, k=n))
    one, two, segment = text("0123456789", 400), text("0123456789", 450), suffix_dedup._SEGMENT
    long = text("abcdefgh", segment) + one + text("abcdefgh", segment - 300) + two + text("abcdefgh", 900)
    docs = [(1, long), (2, text("ijklmnop", 700) + one + text("ijklmnop", 50)), (3, two + text("qrstuvwx", 500))]
    rows = suffix_dedup.anchors(np.frombuffer(long.encode(), dtype=np.uint8), 400, 32)
    assert len(np.unique(rows[1])) == rows.shape[1] and (rows[2, 1:] == rows[3, :-1] + 1).all() and rows[3, -1] == len(long) - 400
    found = suffix_dedup.RepeatedPassages(spark, frame(spark, docs))
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in found.digests().collect()} == {1: (850, 2), 2: (400, 1), 3: (450, 1)}
    assert {r.doc_id: [(s.s, s.e) for s in r.spans] for r in found.texts().collect()}[1] == [(segment, segment + 400), (2 * segment + 100, 2 * segment + 550)]


def test_deep_shallow_order_sorts():
    rng = random.Random(4)
    for _ in range(40):
        head = bytes(rng.randrange(3) for _ in range(rng.randrange(40)))
        strings = list({head + bytes(rng.randrange(2) for _ in range(rng.randrange(60))) for _ in range(60)})
        order = suffix_dedup.deep_shallow_order(strings, 0, shallow=rng.choice([0, 3, 50]))
        assert [strings[i] for i in order] == sorted(strings)


def test_anchors_cover_every_start():
    raw = np.frombuffer(brute.prose(random.Random(9), 600).encode(), dtype=np.uint8)
    rows = suffix_dedup.anchors(raw, 400, 32)
    starts = [s for lo, hi in zip(rows[2], rows[3], strict=True) for s in range(lo, hi + 1)]
    assert starts == list(range(len(raw) - 399))
    assert all(lo <= a and a + 32 <= lo + 400 and hi <= a for a, lo, hi in zip(rows[1], rows[2], rows[3], strict=True))


def test_suffix_dedup_of_groups_of_any_size(spark):
    """Groups split down to whole windows: one passage of 220 and one of 700 bytes with a byte changed here and there, periods, copies."""
    rng = random.Random(31)
    text = lambda letters, n: "".join(rng.choices(letters, k=n))
    short, long = text("abcd", 220), text("efgh", 700)
    docs = [(i, text("0123456789", rng.randrange(60)) + short + text("0123456789", 300)) for i in range(20)]
    docs += [(100 + i, text("ijklmnop", 90) + long[: 35 * i] + "XY"[i % 2] + long[35 * i + 1 :] + text("ijklmnop", 90)) for i in range(20)]
    docs += [(200 + i, "xyz" * (140 + i)) for i in range(6)] + [(300 + i, text("qrst", 30) + "uv" * 250 + text("qrst", 40)) for i in range(6)]
    docs += [(400 + i, docs[i % 2][1]) for i in range(8)] + [(500, long * 2), (501, None), (502, "")]
    found = suffix_dedup.RepeatedPassages(spark, frame(spark, docs), passages=(200, 1), group_bound=2)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.digests().collect()} == brute.repeats(docs)
    again = suffix_dedup.RepeatedPassages(spark, frame(spark, docs), length=200, group_bound=2)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in again.digests().collect()} == brute.repeats(docs, 200)


@pytest.mark.parametrize("n", [3, 16, 60])
def test_repeated_windows_compares_bytes(n):
    """Contexts whose anchors have other bytes are apart though they came under one key; few and many contexts agree with a direct search."""
    rng = random.Random(n)
    gram, other = bytes(range(97, 105)), bytes(range(98, 106))
    contexts, offsets = [], []
    for i in range(n):
        offsets.append(rng.randrange(13))
        contexts.append(bytes(rng.choices(b"ab", [9, 1], k=offsets[-1])) + (other if i % 3 == 0 else gram) + bytes(rng.choices(b"ab", [9, 1], k=rng.randrange(16))))
    for length, got in zip((12, 20), suffix_dedup.repeated_windows(contexts, offsets, (12, 20), 8), strict=True):
        for i, (c, o) in enumerate(zip(contexts, offsets, strict=True)):
            twins = [(d, offsets[j] - o) for j, d in enumerate(contexts) if j != i and d[offsets[j] : offsets[j] + 8] == c[o : o + 8]]
            same = lambda s: any(s + x >= 0 and d[s + x :][:length] == c[s : s + length] for d, x in twins)  # noqa: B023,E731
            spans = [s for s in range(len(c) - length + 1) if same(s)]
            must = {x for s in spans if o + 8 - length <= s <= o for x in range(s, s + length)}
            shown = set(range(o - got[i][0], o + got[i][1])) if got[i] else set()
            assert must <= shown <= {x for s in spans for x in range(s, s + length)}
