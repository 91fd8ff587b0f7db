from __future__ import annotations

import base64
import hashlib
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwright.llm import html_extraction as H, url_filters, warc
from panelwright.llm.shared import Workspace
from tests.llm import brute

COLUMNS = "page_id bigint, url string, html string"


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in H.extract_text(spark, spark.createDataFrame(rows, COLUMNS), **options).collect()}


def test_article_is_kept_whole_without_boilerplate(spark):
    html = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p><article>no</article>';</script></head><body class='ad'><header>Site</header><nav><ul><li>Menu</li></ul></nav>"
        "<div class='cookie-notice'>We use</div><article><header><h1>Head &amp; &eacute;&#8212;x</h1><p>by me</p></header><p>One<br>two&nbsp; three <b>bold</b><!-- c --><p>Next<div class='ad'>Buy</div>"
        "<ul><li>a<li>b</ul><form>Name <input></form><style>p{}</style><pre>k  l\nm</pre><div id=comments>Nice!</div></article><aside>Also</aside><footer>&copy; me</footer></body>"
    )
    got = texts(spark, [(1, "https://a.example/x", html), (2, None, None), (3, "", ""), (4, "https://a.example/y", "plain < text & more"), (5, "https://a.example/z", "<article><p>cut <b")])
    assert got[1] == "Head & é—x\nby me\nOne two three bold\nNext\na\nb\nk l m"
    assert got[2] == got[3] == ""
    assert got[4] == "plain < text & more"
    assert got[5].startswith("cut")


def test_articles_below_named_layouts_come_back(spark):
    said = "The story is told here."
    pages_ = [
        f"<body><form action=x><p>Path</p><article><p>{said}</p></article></form></body>",
        f"<body><div class='layout has-sidebar'><main><p>{said}</p></main><div class='sidebar'>Links</div></div></body>",
        f"<body><div class='post single-ad-free'><p>{said}</p></div></body>",
        f"<body><div class='widget'><div role=main><p>{said}</p><div class='ad'>Buy</div></div></div></body>",
        f"<body><p>{said}</p><div class='comments'><article class='comment'><p>Nice</p></article></div></body>",
        f"<body><article><p>{said}</p></article><div class='related'><article><p>More</p></article></div></body>",
        f"<body><p>{said}</p><aside><article><p>More</p></article></aside></body>",
    ]
    got = texts(spark, [(i, f"https://h{i}.example/", h) for i, h in enumerate(pages_)])
    assert set(got.values()) == {said}


def test_style_tree_finds_what_a_site_repeats(spark):
    rng = random.Random(5)
    rows = []
    for i in range(20):
        body = "".join(f"<p>{brute.prose(rng, 30)}</p>" for _ in range(3))
        rows.append((i, f"https://site.example/{i}", f"<body><div class='top'>Welcome to our site</div><div class='text'>{body}</div><div class='end'>All rights</div></body>"))
    rows += [(100 + i, "https://other.example/1", "<body><div class='top'>Welcome to our site</div></body>") for i in range(2)]
    a, b = texts(spark, rows), texts(spark, rows, broadcast_nodes=0)
    assert a == b
    assert all("Welcome" not in a[i] and "rights" not in a[i] and a[i].count("\n") == 2 for i in range(20))
    assert a[100] == "Welcome to our site"  # two copies of one page say nothing about the site


def test_extract_empty_table_and_extra_columns(spark):
    assert texts(spark, []) == {}
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "mine", 3)], COLUMNS + ", text string, node int")
    assert [(r.page_id, r.text) for r in H.extract_text(spark, df).collect()] == [(1, "x")]


def pages(spark, rows):
    return spark.createDataFrame(rows, COLUMNS + ", fetched_at bigint")


def test_warc_round_trip(spark):
    rng = random.Random(7)
    rows = [(i, f"http://www.h{i % 5}.example/p{i % 3}?q={i}#f", brute.prose(rng, 20) if i % 4 else "same é\r\n\r\nWARC/1.0\r\n", 1000 + (i * 37) % 50) for i in range(200)]
    rows += [(900, None, None, 5), (901, "x y\n", "", None), (902, "http://h.example/", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 7)]
    got = warc.archive_and_index(spark, pages(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    best: dict = {}
    for i, _, html, _ in rows:
        best[html or ""] = max(best.get(html or "", -1), i)
    by_id = {r.page_id: r for r in got}
    for i, _, html, when in rows:
        raw, r = (html or "").encode(), by_id[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if best[html or ""] == i else ("revisit", best[html or ""]))
        assert r.fetched_at == when
    order = [(r.url_key, -1 if r.fetched_at is None else r.fetched_at, r.page_id) for r in sorted(got, key=lambda r: (r.range_id, r.range_position))]
    assert order == sorted(order, key=lambda x: (x[0].encode(), *x[1:]))
    assert warc.archive_and_index(spark, pages(spark, [])).count() == 0


def test_least_bytes_of_a_revisit(spark):
    got = {r.page_id: r.record_type for r in warc.archive_and_index(spark, pages(spark, [(1, "a", "xy", 1), (2, "b", "xy", 1), (3, "a", "long one", 1), (4, "b", "long one", 1)]), least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(20), r) for _ in range(rng.randrange(12))) for r in range(k)]
        got = list(warc.LoserTree([[(a, (a, r)) for a, r in run] for run in runs]))
        assert [x for _, x in got] == sorted(x for run in runs for x in run)


def test_loser_tree_wants_sorted_runs_and_holds_one_head_each():
    pulled = []

    def run(name, keys):
        for k in keys:
            pulled.append(name)
            yield k, (k, name)

    tree = iter(warc.LoserTree([run("a", [1, 2, 9]), run("b", [3, 4]), run("c", [])]))
    assert [next(tree)[0] for _ in range(3)] == [1, 2, 3] and pulled.count("b") == 1
    with pytest.raises(ValueError, match="not sorted"):
        list(warc.LoserTree([run("a", [1, 5, 2]), run("b", [3])]))


def test_merge_of_runs_with_one_url_and_repeated_rows(spark):
    """Ranges far smaller than a URL's captures, of which many are equal rows; names sort like what is read back."""
    rows = [(i // 3, "http://one.example/a b\tc", f"text {i // 3}", 7) for i in range(600)] + [(1000 + i, f"http://one.example/a{chr(32 + i % 9)}x", "t", i % 4) for i in range(90)]
    ws = Workspace(spark, "t")
    folder = ws.folder("archives")
    warc.write_archives(pages(spark, rows).repartition(3), folder, records_per_file=20)
    index = ws.save(warc.read_index(spark, folder), "index")
    warc.check_revisits(index)
    got = sorted(warc.merge_index(index, rows_per_range=50).collect(), key=lambda r: (r.range_id, r.range_position))
    order = [(r.url_key, r.fetched_at, r.page_id) for r in got]
    assert len(got) == 690 and order == sorted(order) and len({r.range_id for r in got}) > 8
    assert {(r.run, r.at) for r in got} == {(r.run, r.at) for r in index.collect()} and len({(r.run, r.at) for r in got}) == 690


def test_revisits_are_held_against_their_response(spark):
    rows = [(1, "a", "xy", 1), (2, "b", "xy", 1), (3, "c", "z", 1)]
    ws = Workspace(spark, "t")
    folder = ws.folder("archives")
    warc.write_archives(pages(spark, rows), folder)
    index = ws.save(warc.read_index(spark, folder), "index")
    warc.check_revisits(index)
    for wrong in (index.where("page_id != 2"), index.withColumn("payload_bytes", F.when(F.col("page_id") == 1, 9).otherwise(F.col("payload_bytes")))):
        with pytest.raises(ValueError, match="without their response"):
            warc.check_revisits(wrong)


def test_lists_count_as_of_the_fetch(spark):
    d = lambda n: date(2024, 1, n)
    entries = [("domain", "b.example", "block", d(5)), ("domain", "b.example", "allow", d(10)), ("domain", "b.example", "allow", d(5)), ("domain", "example", "block", d(8)), ("prefix", "b.example/x/", "block", d(12)), ("domain", None, "block", d(1)), ("prefix", "b.example/x/", "block", d(12))]
    caps = [(1, "http://b.example/x/y", d(4)), (2, "http://B.example:80/x/y?k", d(5)), (3, "http://b.example/x/y", d(9)), (4, "http://b.example/x/y", d(10)), (5, "http://b.example/x/y", d(12)), (6, "http://b.example/xy", d(12)), (7, "http://a.b.example", d(6)), (8, "https://c.example/", d(8)), (9, None, d(9)), (10, "http://b.example/", None), (6, "http://b.example/xy", d(12))]
    c = spark.createDataFrame(caps, "page_id bigint, url string, fetched_at date")
    e = spark.createDataFrame(entries, "kind string, pattern string, action string, listed_at date")
    got = sorted((r.page_id, r.verdict, r.kind) for r in url_filters.filter_captures(c, e).collect())
    assert got == [(1, "none", None), (2, "block", "domain"), (3, "block", "domain"), (4, "allow", "domain"), (5, "block", "prefix"), (6, "allow", "domain"), (6, "allow", "domain"), (7, "block", "domain"), (8, "block", "domain"), (9, "none", None), (10, "none", None)]
    assert url_filters.filter_captures(c.limit(0), e).count() == 0
    assert {r.verdict for r in url_filters.filter_captures(c, e.limit(0)).collect()} == {"none"}
