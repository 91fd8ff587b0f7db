from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from panelwright.llm import suffix_dedup
from panelwright.llm.shared import Workspace
from tests.llm import brute
from tests.llm.test_text_operators import leak_segments

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_act_on_what_came_before(spark, tmp_path):
    rng = random.Random(21)
    items = [(i, brute.prose(rng, 30)) for i in range(4)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(d, t) for d, t in brute.corpus() if t is None or len(t) < 2500]
    docs += [(5000 + i, brute.prose(rng, 60) + " " + items[i % 4][1] + " " + brute.prose(rng, 40)) for i in range(8)]
    docs += [(6000 + i, " ".join(w + "&&&" for w in brute.prose(rng, 60).split())) for i in range(5)]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    now = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    now.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r.doc_id: r.text for r in before.collect()}, now
        if name != "packing":
            assert now.columns == COLUMNS

    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in after.collect()}
    for d, t in before.items():
        n_words, _, n_symbols, _, n_repeat = brute.base_figures(t)
        if n_words < 10 or 100 * n_repeat > 20 * n_words or n_symbols > n_words:
            assert d not in kept
        elif d < 6000 and n_words > 20:
            assert d in kept

    before, after = seen["ngram_join"]
    assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in brute.near_classes(list(before.items())).items() if c == d}

    before, after = seen["suffix_dedup"]
    want = brute.repeats(list(before.items()), 200, 51)
    assert any(x[1] for x in want.values())
    for r in after.collect():
        assert len(r.text.encode()) == want[r.doc_id][0] - want[r.doc_id][1] or "�" not in r.text and abs(len(r.text.encode()) - want[r.doc_id][0] + want[r.doc_id][1]) < 8 * (1 + want[r.doc_id][2])
        assert r.n_chars == len(r.text)

    before, after = seen["decontamination"]
    leaks = {d for d, _ in leak_segments(list(before.items()), items)}
    assert leaks and {r.doc_id for r in after.collect()} == set(before) - leaks

    before, after = seen["packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == set(before)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces} and corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and columns, rows that are there twice, one id with two texts, columns with clashing names, and no row at all."""
    rng = random.Random(5)
    item, passage = brute.prose(rng, 30), brute.prose(rng, 60)
    spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda n=70: brute.prose(rng, n)
    twice, near = text(), text(200)
    rows = [(1, twice), (1, twice), (2, twice), (None, twice), (3, None), (None, None), (4, ""), (5, near), (None, near + " more"), (7, text()), (7, text())]
    rows += [(8, text() + " " + passage + " " + text()), (None, text() + " " + passage + " " + text()), (None, text() + " " + item), (10, text(20_000))]
    rows = [(d, t, None if i % 4 == 0 else "en", None, i, f"t{i}", i) for i, (d, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, row int"
    for name, data in (("some", rows), ("none", [])):
        now, left = spark.createDataFrame(data, schema), {}
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{step}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{step}")
            if step != "packing":
                assert now.columns == [c.split()[0] for c in schema.split(", ")]
                left[step] = {r.row: r for r in now.collect()}
        if not data:
            assert not left["decontamination"] and not now.count()
            continue
        assert set(left["quality_rules"]) == set(range(len(rows))) - {4, 5, 6}
        once = set(left["ngram_join"])
        assert len(once & {0, 1, 2, 3}) == 1 and len(once & {7, 8}) == 1 and {9, 10, 11, 12, 13, 14} <= once
        cut = left["suffix_dedup"]
        assert all(passage[9:-9] not in cut[k].text and cut[k]._text == f"t{k}" and cut[k].n_chars == len(cut[k].text) for k in (11, 12)) and cut[14].text == rows[14][1]
        assert set(left["decontamination"]) == once - {13}
        assert {r.doc_id for r in now.collect()} == {r.doc_id for r in left["decontamination"].values()}


def test_workers_get_small_batches_and_keep_small_tables(spark, tmp_path, monkeypatch):
    """What runs Python in these two stages is written inside them, with batches of 4 MB; the setting is put back."""
    name, seen, save = "spark.sql.execution.arrow.maxBytesPerBatch", {}, Workspace.save
    before = spark.conf.get(name)
    monkeypatch.setattr(Workspace, "save", lambda self, df, to: (seen.__setitem__(to, spark.conf.get(name)), save(self, df, to))[1])
    docs = spark.createDataFrame([(i, brute.prose(random.Random(i % 2), 90), "en", "s", 1) for i in range(4)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for stage in (corpus_pipeline.remove_repeated_passages, corpus_pipeline.pack):
        seen.clear()
        out = stage(spark, docs, str(tmp_path))
        assert seen and {int(x.rstrip("b")) for x in seen.values()} == {4 << 20} and spark.conf.get(name) == before
        assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString() and out.count() >= 4

    suffix_dedup._powers.clear()
    rng = np.random.default_rng(3)
    for size in (3_000, 700, 9_000, 1 << 20):
        raw = rng.integers(0, 256, size, dtype=np.uint8)
        raw[-300:] = raw[:300]
        h = suffix_dedup.window_hashes(raw, 32)
        assert len(np.unique(h)) == len(h) - 269 and (h[-269:] == h[:269]).all()
        assert sum(x.nbytes for x in suffix_dedup._powers) <= 2 * 8 * max(1 << 14, size)
