"""The corpus pipeline: quality rules, near-duplicate join, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the one before it left, as written and read back, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import decontamination, key_filter, ngram_join, packing, quality_rules, suffix_dedup, tokens
from panelwright.llm.queries import table
from panelwright.llm.shared import Workspace, in_small_batches

#: The analysis of several stages (identical ids, hash order) can't be put as SQL; tests hold each stage against brute force.
ORACLE_SQL = None

_last: list[Workspace] = []


def _workspace(spark: SparkSession, docs: DataFrame, name: str) -> Workspace:
    """A new workspace. That of the stage before is deleted, unless ``docs`` still reads it: its result has been written."""
    files = docs.inputFiles() if _last else ()
    for old in [w for w in _last if not any(w.path in f for f in files)]:
        old.drop()
        _last.remove(old)
    _last.append(Workspace(spark, name))
    return _last[-1]


def _by_id(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns, and ``doc_id``, which for rows without an id is a negative number made of the text."""
    made = -1 - F.shiftrightunsigned(F.xxhash64(F.lit("no id"), "text"), 1)
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("bigint"), made).alias("doc_id"))


def _operand(docs: DataFrame) -> DataFrame:
    """The columns that operators read, each row with an id."""
    return _by_id(docs).select("doc_id", *[F.col("row").getField(c).alias(c) for c in ("text", "lang", "source")])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without these ids. Texts whose id is surely not among them stay where they are, at any number of ids."""
    return key_filter.without_keys(_by_id(docs), ids.select("doc_id").distinct(), "doc_id").select("row.*")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    ws = _workspace(spark, docs, "stage-quality")
    judged = quality_rules.apply_quality_rules(spark, _operand(docs), workspace=ws)
    return _without(docs, ws.save(judged.where(~F.col("kept")), "rejected"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id stays; of rows that are there more than once, one."""
    ws = _workspace(spark, docs, "stage-ngram")
    classes = ws.save(ngram_join.ngram_classes(spark, _operand(docs), workspace=ws), "classes")
    rows, ids = classes.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    return _without(docs if rows == ids else docs.dropDuplicates(["doc_id", "text"]), classes.where("doc_id <> component_id"))


@in_small_batches
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (and 200 bytes) that occur elsewhere are cut out; a document that loses all its text stays, empty."""
    ws = _workspace(spark, docs, "stage-suffix")
    found = suffix_dedup.RepeatedPassages(spark, _operand(docs), length=200, min_words=51, workspace=ws)
    cut = ws.save(found.texts().select("sha", F.struct("text").alias("cut")).dropDuplicates(["sha"]), "cut")
    rows = _by_id(docs).select("row", F.unhex(F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256)).alias("sha"))
    own = {c: F.col("row").getField(c) for c in docs.columns}
    now = own | {"text": F.when(F.col("cut").isNotNull(), F.col("cut.text")).otherwise(own["text"]), "n_chars": F.when(F.col("cut").isNotNull(), F.length("cut.text").cast("bigint")).otherwise(own["n_chars"])}
    maybe, rest = key_filter.split_by_keys(rows, cut.select("sha"), "sha")
    return maybe.join(cut, "sha", "left").select(*[now[c].alias(c) for c in docs.columns]).union(rest.select("row.*"))


def reject_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    ws = _workspace(spark, docs, "stage-benchmark")
    leaks = decontamination.find_leaks(spark, _operand(docs), table(spark, sf_dir, "benchmark"), workspace=ws)
    return _without(docs, ws.save(leaks, "leaks"))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, written here since the batches are small only inside the stage."""
    ws = _workspace(spark, docs, "stage-packing")
    df = packing.pack_documents(docs, tokens.public_vocabulary())
    df = df.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")
    return ws.save(df, "packed")


STAGES = [
    ("quality_rules", reject_low_quality),
    ("ngram_join", keep_one_of_each_class),
    ("suffix_dedup", remove_repeated_passages),
    ("decontamination", reject_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read back."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
