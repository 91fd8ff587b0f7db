from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from panelwright.llm import personal_data as P
from tests.llm import brute

COLUMNS = "doc_id bigint, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + c for c in "0123456789" if luhn(body + c))


def brute_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                yield f"{kind}:{m.start()}:{m.end()}"


def found(spark, rows, columns=COLUMNS, **options):
    df = P.find_personal_data(spark, spark.createDataFrame(rows, columns), **options)
    return df.select("doc_id", P.joined(F.col("base")).alias("base"), P.joined(F.col("added")).alias("added")).collect()


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b", "x.y_z@mail.example.com,a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 1.2.3", "+1 (017) 555-7713. +12 +1234567890123456 +1(2)3-4.5 6 7 8)", "é😀 a@b.cd 😀 10.0.0.1é+44 20 7946 0958"]
    texts += ["a" * 4_000, "1" * 4_000, "a." * 2_000 + "@b.c", "x@" + "b." * 50_000 + "c", "1.1." * 5_000, "+1" + " 2" * 50_000]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", f"{card(rng)}{card(rng)}", f"n {card(rng)} {card(rng)}", f"{card(rng)}\n{card(rng)}-"]
    texts += ["".join(rng.choice("ab1.@+- ()%5é\n") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [" ".join(rng.choice([card(rng), "a@b.co", "1.2.3.4", "+1 (555) 123-4567", "word", "x,"]) for _ in range(30)) for _ in range(40)]
    got = {r.doc_id: r.base for r in found(spark, list(enumerate(texts)))}
    for i, text in enumerate(texts):
        assert got[i] == ",".join(brute_spans(text)), text[:200]
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(P.joined(F.array().cast("array<struct<kind:string,start:int,end:int>>")).cast("binary"), 256)).first()[0]


def test_long_runs_are_read_once(spark):
    """The plain patterns would take the square of these lengths."""
    rows = [(0, "a" * 400_000 + " 1"), (1, "1" * 400_000), (2, "a." * 200_000 + "@b.c"), (3, "x@" * 200_000)]
    got = {r.doc_id: (r.base, r.added) for r in found(spark, rows)}
    assert got == {0: ("", ""), 1: ("", ""), 2: ("email:0:400004", ""), 3: ("", "")}


def corpus(rng, n=40):
    rows = []
    for i in range(n):
        rows.append((len(rows), f"{brute.prose(rng, 20)} reach me under phone +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} {brute.prose(rng, 8)}"))
        rows.append((len(rows), f"{brute.prose(rng, 12)} my card number: {card(rng)} {brute.prose(rng, 9)}"))
        rows.append((len(rows), f"{brute.prose(rng, 12)} order {rng.randrange(10**7, 10**8)} of part {rng.randrange(10**6, 10**7)}"))
    return rows


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(4)
    rows = corpus(rng)
    n = len(rows)
    head = brute.prose(rng, 6)
    rows += [(n, f"{head} reach me under phone 555-123-4567, {brute.prose(rng, 5)}"), (n + 1, f"{head} my card number: 4111111111111112."), (n + 2, f"😀 {head} 555-123-4567"), (n + 3, f"{head} order 5551234")]
    got = {r.doc_id: r.added for r in found(spark, rows)}
    text = dict(rows)
    where = lambda i, s, kind: f"{kind}:{text[i].index(s)}:{text[i].index(s) + len(s)}"
    assert got[n] == where(n, "555-123-4567", "phone")
    assert got[n + 1] == where(n + 1, "4111111111111112", "card")
    assert got[n + 2] == where(n + 2, "555-123-4567", "phone")  # known by now, so wherever it stands
    assert not any(got[i] for i in got if i < n or i == n + 3)


def test_graph_scores_equal_brute_force(spark):
    rng = random.Random(6)
    rows = corpus(rng, 12)
    for i in range(60):
        rows.append((len(rows), f"{rng.choice(['phone', 'call', 'number:', 'order'])} {rng.randrange(10**6, 10**6 + 40)} {rng.choice(['now', 'today'])}"))
        rows.append((len(rows), f"call {rng.choice(['+1 555 123 ', '+1 555 124 '])}{rng.randrange(1000, 1010)} now"))
    docs = spark.createDataFrame(rows, COLUMNS)
    ws = P.Workspace(spark, "t")
    spans = P.base_spans(docs).collect()
    edges = {(p, x.string.lower(), kind) for r in spans for kind in (*P.KINDS, None) for x in (r[kind or "strings"] or []) for p in x.patterns}
    like = {k: lambda s, k=k: re.search(P.SHAPES[k], s) and P.DIGITS.get(k, (0, 99))[0] <= len(re.sub("[^0-9]", "", s)) <= P.DIGITS.get(k, (0, 99))[1] for k in P.KINDS}
    seeds = {(s, k) for _, s, k in edges if k}
    seeded, by = {s for s, _ in seeds}, {}
    for p, s, _ in edges:
        by.setdefault(p, set()).add(s)
    new = {}
    for _ in range(3):
        worth = {}
        for p, strings in by.items():
            for k in P.KINDS:
                of = {s: float((s, k) in seeds) if s in seeded else (new[s][0] if s in new and new[s][1] == k else 0.0) for s in strings}
                against = sum(0 if of[s] > 0 else 1.0 if s in seeded or s in new or not like[k](s) else 0.25 for s in strings)
                score = sum(of.values()) / (sum(of.values()) + against + 1)
                if sum(of.values()) >= 3 and score >= 0.4:
                    worth[p] = max(worth.get(p, (0, "")), (score, k))
        found = {}
        for p, (score, k) in worth.items():
            for s in by[p] - seeded:
                if like[k](s):
                    found[s] = max(found.get(s, (0, "")), (score, k))
        if {(s, x[1]) for s, x in found.items()} <= {(s, x[1]) for s, x in new.items()} and new:
            new = found
            break
        new = found
    made = P.score_graph(ws, spark.createDataFrame(list(edges), "pattern string, string string, kind string"), least_seeds=3, least_score=0.4, unknown_weight=0.25, rounds=3)
    got = {r.string: (round(r.score, 9), r.kind) for r in made.collect()}
    assert got and got == {s: (round(x[0], 9), x[1]) for s, x in new.items()}


def test_odd_rows(spark):
    assert found(spark, []) == []
    rows = [(1, "a@b.cd", "mine", 1.0), (1, "a@b.cd", "mine", 1.0), (None, "+1 555 123 4567", None, None), (2, None, "", None)]
    got = sorted((r.doc_id or 0, r.base, r.added) for r in found(spark, rows, "doc_id bigint, text string, kind string, score double"))
    assert got == [(0, "phone:0:15", ""), (1, "email:0:6", ""), (1, "email:0:6", ""), (2, "", "")]
