from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelwright.llm import decontamination, packing, quality_rules, token_counts, tokens, toxicity
from panelwright.llm.shared import Workspace
from tests.llm import brute


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", f"s{d % 2}") for d, t in docs], "doc_id bigint, text string, lang string, source string")


EDGES = [(1, None), (2, ""), (3, "x"), (4, "a  b\n\nc"), (5, "é中   !!?"), (6, "<|endoftext|> '' s"), (7, "word " * 5000), (7, "word " * 5000)]


def test_rank_and_json_vocabularies_agree():
    rank, plain = tokens.encoder(tokens.public_vocabulary()), tokens.encoder(tokens.public_vocabulary("byte_bpe_50k.json"))
    untouched = Tokenizer.from_file(tokens.public_vocabulary("byte_bpe_50k.json"))
    assert rank.ids("foo <|endoftext|> bar").tolist() == [21943, 220, 50256, 2318]
    rng = random.Random(1)
    texts = [t or "" for _, t in EDGES] + [t or "" for _, t in brute.corpus()]
    texts += ["foo <|endoftext|> bar", "<|endoftext|><|endoftext|>a", "a  <|endoftext|>\n", "<|endoftext", "x<|endoftext|>y <|endoftext|>  "]
    texts += ["".join(rng.choice("aB 9\n\t'.é中 　🙂") for _ in range(200)) for _ in range(100)]
    for t in texts:
        assert rank.ids(t).tolist() == plain.ids(t).tolist() == untouched.encode(t, add_special_tokens=False).ids
        assert (rank.byte_ends(t)[-1] if t else 0) == len(t.encode())


def test_packing_round_trip(spark):
    docs = brute.corpus() + EDGES[:-1]
    rows = packing.pack_documents(frame(spark, docs).repartition(3), tokens.public_vocabulary()).collect()
    encode = tokens.encoder(tokens.public_vocabulary("byte_bpe_50k.json")).ids
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in docs:
        own = sorted(pieces[d], key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in own)
        want = np.append(encode(t or ""), 0).astype("<u4")
        assert ids == want.tobytes() and all(r.doc_tokens == len(want) for r in own)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total == own[0].sequence_tokens <= 1024 and total & (total - 1) == 0
    groups = defaultdict(set)
    for r in rows:
        groups[r.step_group].add((r.sequence_id, r.sequence_tokens))
    assert all(sum(n for _, n in g) <= 8192 for g in groups.values())
    assert packing.pack_documents(frame(spark, []), tokens.public_vocabulary()).count() == 0


def test_packing_with_a_small_buffer(spark):
    docs = brute.corpus()
    rows = packing.pack_documents(frame(spark, docs).coalesce(1), tokens.public_vocabulary(), buffer_tokens=2000).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_token_counts_add_up(spark):
    docs = EDGES[:-1] + brute.corpus()
    rows = token_counts.count_tokens(frame(spark, docs), tokens.public_vocabulary()).collect()
    encode = tokens.encoder(tokens.public_vocabulary()).ids
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d, t in docs:
        own = sorted(by_doc[d], key=lambda r: r.section)
        assert [r.section for r in own] == list(range(len((t or "").split("\n"))))
        assert sum(r.n_tokens for r in own) == own[0].doc_tokens == len(encode(t or ""))
        assert own[-1].char_end == len(t or "")


def test_boundary_tokens_go_to_the_larger_share():
    owner, across = token_counts.allocate(np.array([2, 6, 8, 10]), np.array([3, 5, 7, 9, 9, 10]))
    assert owner.tolist() == [0, 1, 2, 3]  # bytes 2-6: one, two, one; 6-8 and 8-10: a tie, the earlier
    assert across.tolist() == [False, True, True, True]


def test_given_sections(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [(1, "alpha beta gamma")])
    halves = F.array(F.struct(F.lit("a").alias("kind"), F.lit(7).cast("bigint").alias("char_end")), F.struct(F.lit("b").alias("kind"), F.length("text").cast("bigint").alias("char_end")))
    rows = token_counts.count_tokens(df, tokens.public_vocabulary(), sections=halves).collect()
    assert [r.kind for r in rows] == ["a", "b"] and sum(r.n_tokens for r in rows) == rows[0].doc_tokens


def test_odd_sections_equal_an_owner_per_token(spark):
    """Each token belongs to the section with most of its bytes, the earlier one of equals."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    rows = [(1, None, None), (2, "", []), (3, "alpha", None), (4, "alpha beta", [("a", 3)]), (5, "alpha beta", [("a", 99), ("b", 2), (None, None)]), (6, "", [("a", 0), ("b", 4)]), (7, "é😀 beta", [None, ("b", 3)])]
    for i in range(8, 60):
        text = brute.prose(rng, 12) + " é😀naïve"
        rows.append((i, text, [(f"k{j}", rng.randrange(-3, len(text) + 5)) for j in range(rng.randrange(1, 9))]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans array<struct<kind:string,char_end:bigint>>")
    got = defaultdict(list)
    for r in token_counts.count_tokens(df, tokens.public_vocabulary(), sections=F.col("spans")).collect():
        got[r.doc_id].append(r)
    enc = tokens.encoder(tokens.public_vocabulary())
    for i, text, spans in rows:
        text, spans = text or "", [x or (None, None) for x in spans or [None]]
        ends, last = [], 0
        for _, e in spans[:-1]:
            last = max(last, min(max(len(text) if e is None else e, 0), len(text)))
            ends.append(len(text[:last].encode()))
        ends.append(len(text.encode()))
        want, before = [0] * len(spans), 0
        for e in enc.byte_ends(text).tolist() if text else []:
            held = [max(0, min(e, hi) - max(before, lo)) for lo, hi in zip([0, *ends], ends, strict=False)]
            want[held.index(max(held))] += 1
            before = e
        own = sorted(got[i], key=lambda r: r.section)
        assert [r.n_tokens for r in own] == want and [r.kind for r in own] == [k for k, _ in spans], (i, text, spans)


def test_quality_base_figures(spark):
    docs = brute.corpus() + EDGES[:-1] + [(900, "a b c d e a b c d e a b c d e f g h"), (901, "# x\n# x\n\n \n# x | < >")]
    rows = quality_rules.base_figures(frame(spark, docs)).collect()
    want = {d: brute.base_figures(t) for d, t in docs}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(8)
    clean = [(100 + i, brute.prose(rng, 120)) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in brute.prose(rng, 80).split())) for i in range(60)]
    rows = quality_rules.apply_quality_rules(spark, frame(spark, clean + junk + EDGES)).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert {d for d, _ in clean} <= kept and not kept & {d for d, _ in junk}
    assert not kept & {1, 2, 3, 4, 7} and len(rows) == 368
    odd = spark.createDataFrame([(1, "a b", None, None)], "doc_id bigint, text string, lang string, source string")
    assert [r.kept for r in quality_rules.apply_quality_rules(spark, odd).collect()] == [False]
    assert quality_rules.apply_quality_rules(spark, frame(spark, [])).count() == 0


def kept_brute(rows, least_docs):
    """``kept`` by sorted lists; a quantile is the smallest value that ``q`` of all do not exceed."""
    figures, groups, langs = {}, defaultdict(list), defaultdict(list)
    for d, t, lang, source in rows:
        n, chars, symbols, dups, repeats = brute.base_figures(t)
        failed = n < 10 or 100 * repeats > 20 * n
        x = (chars / max(n, 1), *(math.log((c + 1) / (n + 10)) for c in (symbols, dups)))
        figures[d] = lang, source, n, symbols, dups, failed, x
        if not failed:
            groups[lang, source].append(x)
            langs[lang].append(x)
    every = [x for g in groups.values() for x in g]
    at = lambda v, q: sorted(v)[math.ceil(q * len(v)) - 1]
    out = {}
    for d, (lang, source, n, symbols, dups, failed, x) in figures.items():
        own = next((g for g in (groups[lang, source], langs[lang]) if len(g) >= least_docs), every)
        limits = []
        for k, fence in enumerate((4.0, 2.0, 2.0)):
            low, high = (at([y[k] for y in own], q) for q in (0.25, 0.75))
            limits.append((low - fence * (high - low), high + fence * (high - low)))
        slack = 4 / math.sqrt(max(n, 1))
        far = x[0] > limits[0][1] + slack or x[0] < limits[0][0] - slack or symbols > 0 and x[1] > limits[1][1] or dups > 0 and x[2] > limits[2][1]
        out[d] = not failed and not far
    return out


def test_quality_verdict_equals_brute_force(spark):
    """Groups are small enough for their sketches to hold every value."""
    rng, rows = random.Random(15), []
    for i in range(420):
        t = brute.prose(rng, rng.randint(5, 200))
        if i % 9 == 0:
            t += " & | #" * rng.randint(1, 40)
        if i % 7 == 0:
            t += ("\n" + brute.prose(rng, 3)) * rng.randint(2, 4)
        if i % 31 == 0:
            t = t.replace(" ", "") + " " + brute.prose(rng, 12)
        rows.append((i, None if i == 50 else t, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.apply_quality_rules(spark, df.repartition(3), least_docs=40).collect()}
    want = kept_brute(rows, 40)
    assert got == want and 60 < sum(want.values()) < 400
    figures = Workspace(spark, "test").save(quality_rules.base_figures(df), "figures")
    limits = quality_rules.fences(figures, least_docs=40).collect()
    assert all(len({round(r[c], 6) for r in limits}) > 3 for c in ("symbol_high", "dup_line_high", "word_length_high"))


def test_small_groups_borrow_a_sketch(spark):
    rng = random.Random(6)
    rows = [(i, brute.prose(rng, 100), "en", "big") for i in range(220)] + [(500, brute.prose(rng, 100), "en", None), (501, brute.prose(rng, 100), None, "rare")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.apply_quality_rules(spark, df, least_docs=50).collect()}
    assert all(got.values())


def leak_segments(docs, items, min_words=13):
    """All segments of all diagonals of all pairs, at four equal words of five: most equal words, then the lower span."""
    out = {}
    for d, t in docs:
        w = brute.WORD.findall((t or "").lower())
        for i, x in items:
            v = brute.WORD.findall((x or "").lower())
            least = min(min_words, -(-len(v) * 4 // 5) if len(v) >= 6 else len(v))
            for g in range(-len(v) + 1, len(w)):
                same = [w[g + j] == v[j] for j in range(max(0, -g), min(len(v), len(w) - g))]
                if sum(same) < least:
                    continue
                for a in range(len(same)):
                    n = 0
                    for b in range(a, len(same)):
                        n += same[b]
                        if 5 * n >= 4 * (b - a + 1) and n >= least:
                            out[d, i] = max(out.get((d, i), (0, 0)), (n, a - b - 1))
    return {k: (n, -span) for k, (n, span) in out.items()}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(i, brute.prose(rng, rng.randint(3, 40))) for i in range(12)] + [(90, None), (91, "Too short here")]
    docs = [(i, brute.prose(rng, rng.randint(5, 90))) for i in range(40)]
    for k, (_, x) in enumerate(items[:10]):
        w = x.split()
        docs.append((200 + k, brute.prose(rng, 20) + " " + x.upper() + " " + brute.prose(rng, 9)))
        for j in range(4, len(w), 9):
            w[j] = "zzz"
        docs.append((300 + k, " ".join(w)))
        docs.append((400 + k, x[len(x) // 2 :] + " " + brute.prose(rng, 30)))
    docs += [(500, None), (501, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark, frame(spark, docs), bench).collect()}
    assert got == set(leak_segments(docs, items))
    every = decontamination.decontaminate(spark, frame(spark, docs), bench).collect()
    assert len(every) == len(docs) and {r.doc_id for r in every if r.contaminated} == {d for d, _ in got}
    assert decontamination.decontaminate(spark, frame(spark, []), bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontamination.decontaminate(spark, frame(spark, docs), none).collect())


def test_leaks_with_replaced_words_anywhere(spark):
    """One word replaced at any place, or two, or runs of 5, 1, 5, 1 and 5 equal words, which no mask hits."""
    items = [(n, " ".join(f"v{n}x{j}" for j in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 15, 16, 17, 21)]
    docs, rng = [], random.Random(7)
    for n, x in items:
        places = [(j,) for j in range(n)] + [tuple(rng.sample(range(n), r)) for r in (0, 2, 2, 2, 2, 3, 4, 5) if r <= n] + [(5, 7, 13, 15)]
        for at in places:
            docs.append((len(docs), "before it " + " ".join("zzz" if j in at else y for j, y in enumerate(x.split())) + " after it"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.span) for r in decontamination.find_leaks(spark, frame(spark, docs), bench).collect()}
    assert got == leak_segments(docs, items)


def test_toxicity_learns_from_positives_alone(spark):
    rng = random.Random(3)
    bad = ["grumble", "snarl", "spite"]
    docs, labels = [(i, None if i % 97 == 0 else brute.prose(rng, 60)) for i in range(900)], []
    docs = [(i, t if t is None or i % 6 else t + " " + rng.choice(bad) + "! " + rng.choice(bad)) for i, t in docs]
    toxic = {i for i, t in docs if t is not None and i % 6 == 0}
    labels = [(i, int(i in toxic)) for i, _ in docs if i % 2 == 0]
    df = frame(spark, docs)
    rows = toxicity.score_toxicity(spark, df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(rows) == 900 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hit = [r.predicted == int(r.doc_id in toxic) for r in rows if r.held_out]
    assert sum(hit) / len(hit) > 0.97
    none = toxicity.score_toxicity(spark, df, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert not any(r.predicted for r in none)


def listed_sums(rows, toxic):
    """Sums of :func:`toxicity.pattern_sums` from lists of features, a text at a time."""

    def sums(w, b):
        losses, grads = np.zeros(3), np.zeros((3, len(w) + 1))
        for row, is_positive in zip(rows, toxic, strict=True):
            z = min(60.0, max(-60.0, sum(w[x] for x in row) + b))
            sig = 1 / (1 + np.exp(-z))
            for k, (n, loss, slope) in enumerate([(is_positive, np.log1p(np.exp(-z)), sig - 1), (is_positive, np.log1p(np.exp(z)), sig), (1, np.log1p(np.exp(z)), sig)]):
                losses[k] += n * loss
                for x in [*row, len(w)]:
                    grads[k][x] += n * slope
        return losses, grads

    return sums


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_nnpu_gradient_by_finite_differences(prior):
    rng = np.random.default_rng(1)
    rows, toxic = [rng.integers(0, 6, rng.integers(0, 5)).tolist() + [6] * (i < 15) for i in range(60)], [i < 15 for i in range(60)]
    risk, w = toxicity.PuRisk(prior, 15, 60), np.append(rng.normal(size=6), [3.0, -1.0])
    losses, grads = toxicity.pattern_sums(np.array([x for r in rows for x in r]), np.array([len(r) for r in rows]), np.array(toxic, dtype=int), np.ones(60, dtype=int), w[:-1], w[-1])
    by_text = listed_sums(rows, toxic)
    plain = by_text(w[:-1], w[-1])
    assert np.allclose(losses, plain[0]) and np.allclose(grads, plain[1])
    below = risk.parts(losses)[1] < 0
    assert below == (prior == 0.9)

    def value(at):
        first, second = risk.parts(by_text(at[:-1], at[-1])[0])
        return -second if below else first + second

    steps = np.eye(8) * 1e-6
    slopes = [(value(w + d) - value(w - d)) / 2e-6 for d in steps]
    assert np.allclose(risk.gradient(losses, grads), slopes, atol=1e-6)


def test_toxicity_fit_equals_plain_python_over_all_texts(spark):
    rng = random.Random(8)
    docs = [(i, None if i % 50 == 7 else "" if i % 50 == 8 else brute.prose(rng, 25) + (" grumbles grumbled snarl" if i % 5 == 0 else "")) for i in range(400)]
    docs += [docs[5], docs[5], (None, "snarl"), (401, "snarl " * 30_000)]
    labels = [(i, int(i % 5 == 0)) for i in range(0, 400, 3)] + [(9, 0), (9, 1), (None, 1), (12, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got, prior = toxicity.fit(spark, df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), steps=15)
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5
    known = {}
    for i, t in labels:
        if train(i) and t is not None:
            known[i] = max(t, known.get(i, 0))
    assert prior == sum(known.values()) / len(known)
    texts = [(toxicity.distinct_words(t), known.get(i) == 1) for i, t in docs if train(i)]
    n, p = Counter(), Counter()
    for words, toxic in texts:
        for x in (x for w in words for x in toxicity.word_features(w)):
            n[x] += 1
            p[x] += toxic
    positives = sum(t for _, t in texts)
    expected = {x: (n[x] + 0.5) / (len(texts) + 1) * positives for x in n}
    kept = sorted(x for x, e in expected.items() if p[x] >= 3 and p[x] >= 2.5 * e and p[x] - e >= 4 * e**0.5)
    place = {x: j for j, x in enumerate(kept)}
    rows = [[place[x] for w in words for x in toxicity.word_features(w) if x in place] for words, _ in texts]
    want = toxicity.train_nnpu(toxicity.PuRisk(prior, positives, len(texts)), listed_sums(rows, [t for _, t in texts]), len(kept), steps=15)
    assert kept and np.array_equal(np.flatnonzero(got.weights), np.array(kept)[np.flatnonzero(want.weights)])
    assert np.allclose(got.weights[kept], want.weights, atol=2e-6)


def test_toxicity_decision_point():
    bins, positive, texts = np.array([-64, 0, 64, 128]), np.array([0, 0, 3, 7]), np.array([70, 20, 4, 9])
    assert toxicity._decision_bias(bins, positive, texts, 0.1, -1.9) == -0.5078125  # below both bins that hold positives
    assert toxicity._decision_bias(bins, positive, texts, 0.1, -0.6) == -0.6  # as good
    assert toxicity._decision_bias(bins[:1], texts[:1], texts[:1], 0.1, 0.3) == 0.3


def test_toxicity_empty_table_clashing_columns_and_given_prior(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, toxic int")
    assert toxicity.score_toxicity(spark, frame(spark, []), labels).count() == 0
    docs = spark.createDataFrame([(i, "snarl now" if i < 40 else "fine words", 1, 0.5) for i in range(200)], "doc_id bigint, text string, toxic int, score double")
    rows = toxicity.score_toxicity(spark, docs, labels, prior=0.2).collect()
    assert len(rows) == 200 and all(r.predicted == (r.doc_id < 40) for r in rows)


@pytest.mark.parametrize("tiers", [(1000, 10), (128, 256), (256, 256)])
def test_packing_refuses_bad_tiers(spark, tiers):
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark, []), "x", tiers=tiers)
