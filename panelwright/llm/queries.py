"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import decontamination, fill_in_middle, hard_negatives, html_extraction, ngram_join, packing, personal_data, quality_rules, suffix_dedup, token_counts, tokens, toxicity, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(spark, table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokens.public_vocabulary())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.apply_quality_rules(spark, table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", " ").alias("reasons"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_extraction.extract_text(spark, table(spark, sf_dir, "pages"))
    return df.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packing.pack_documents(table(spark, sf_dir, "documents"), tokens.public_vocabulary())
    return df.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time; each is taken as fetched ``page_id`` seconds into 2024."""
    pages = table(spark, sf_dir, "pages").withColumn("fetched_at", F.lit(1_704_067_200) + F.col("page_id"))
    df = warc.archive_and_index(spark, pages)
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "fetched_at", "range_id", "range_position")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """List entries that follow the pages: each host, and each host with its first path segment, has dated entries of its own."""
    host = url_filters.host_of(F.col("url"))
    hosts = pages.select(host.alias("host"), F.split(url_filters.path_of(F.col("url")), "/")[1].alias("top")).where("host <> ''").distinct()
    patterns = hosts.select(F.lit("domain").alias("kind"), F.col("host").alias("pattern")).union(hosts.select(F.lit("prefix"), F.concat("host", F.lit("/"), F.col("top"), F.lit("/")))).distinct()
    number = lambda k: F.conv(F.substring(F.md5(F.concat("kind", F.lit(":"), "pattern", F.lit(k)).cast("binary")), 1, 6), 16, 10).cast("bigint")
    entry = lambda k: F.struct(F.when(number(f"#a{k}") % 3 == 0, "allow").otherwise("block").alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), (number(f"#d{k}") % 365).cast("int")).alias("listed_at"))
    return patterns.where("pattern is not null").select("kind", "pattern", F.inline(F.array(*[entry(k) for k in range(3)])))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time; day ``page_id % 365`` of 2024 stands for it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    return url_filters.filter_captures(captures, dated_lists(pages))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_at,
         lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '')) AS host,
         coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(path, '/')[2] AS top FROM u WHERE host <> ''),
patterns AS (
  SELECT 'domain' AS kind, host AS pattern FROM hosts
  UNION SELECT 'prefix', host || '/' || top || '/' FROM hosts WHERE top IS NOT NULL),
entries AS (
  SELECT kind, pattern, CASE WHEN CAST('0x' || substr(md5(kind || ':' || pattern || '#a' || k), 1, 6) AS BIGINT) % 3 = 0 THEN 'allow' ELSE 'block' END AS action,
         DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(kind || ':' || pattern || '#d' || k), 1, 6) AS BIGINT) % 365 AS INTEGER) AS valid_from
  FROM patterns, (VALUES (0), (1), (2)) AS n(k)),
one AS (SELECT kind, pattern, valid_from, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY kind, pattern ORDER BY valid_from) AS valid_to FROM one),
labels AS (SELECT *, string_split(host, '.') AS l, string_split(path, '/') AS s FROM u WHERE host <> ''),
asked AS (
  SELECT page_id, fetched_at, host, 'domain' AS kind, array_to_string(l[i:], '.') AS pattern FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels)
  UNION ALL
  SELECT page_id, fetched_at, host, 'prefix', host || array_to_string(s[:i], '/') || CASE WHEN i < len(s) THEN '/' ELSE '' END FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM labels)),
best AS (
  SELECT page_id, action, kind, pattern, valid_from, row_number() OVER (PARTITION BY page_id ORDER BY (kind = 'prefix') DESC, length(pattern) DESC, kind DESC, pattern DESC, action DESC, valid_from DESC) AS r
  FROM asked JOIN spans USING (kind, pattern) WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT u.page_id, u.host, u.fetched_at, coalesce(b.action, 'none') AS verdict, b.kind, b.pattern, b.valid_from
FROM u LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON u.page_id = b.page_id
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the contract ``n_passage_words``: words in repeated passages of over 50 words, which can have fewer than 400 bytes."""
    return suffix_dedup.RepeatedPassages(spark, table(spark, sf_dir, "documents"), passages=(200, 51)).digests()


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the hash are those of the base spans; ``n_added`` counts those of the bootstrap."""
    df = personal_data.find_personal_data(spark, table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    digest = F.sha2(personal_data.joined(F.col("base")).cast("binary"), 256)
    return df.select("doc_id", *[count(k) for k in personal_data.KINDS], digest.alias("base_sha256"), personal_data.joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
f AS (SELECT *, left(text, least(a, b)) AS prefix, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(text, greatest(a, b) + 1) AS suffix FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are moved first where ``vec_id`` is divisible by 7; anchors are the rows whose ``vec_id`` is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark, table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum([a.x[i] * b.x[i] for i in range(1, len(a.x) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity,
        op2_ngram_join,
        op3_token_counts,
        op4_quality_rules,
        op5_html_extraction,
        op6_packing,
        op7_warc,
        op8_decontamination,
        op9_url_filters,
        op10_suffix_dedup,
        op11_personal_data,
        op12_fill_in_middle,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filters": OP9_SQL, "op12_fill_in_middle": OP12_SQL, "op13_hard_negatives": OP13_SQL}
