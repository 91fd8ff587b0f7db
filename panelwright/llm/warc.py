"""WARC archives from page tables, and their capture index by external merge of locally sorted runs.

Archives are written by Spark's own text writer (a record is a line whose separator is the blank line that ends it), so they go to
any file system Spark knows. Each file is one run, sorted by URL key and time. Reading back parses records by their
``Content-Length``, and each revisit is held against the response it refers to. The index is cut into ranges of (URL key, time, page,
place), so a URL with very many captures spans several; in each range a loser tree merges the runs as they were written.
"""

from __future__ import annotations

import gzip
import hashlib
from base64 import b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm.shared import Workspace

INDEX = "run string, at bigint, url_key string, fetched_at bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
BREAK = "\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort key of a URL: reversed lower-case host, then path and query; the scheme, the fragment and ``www.`` do not count."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?:]*)", 1)), r"^www\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?]*", ""))


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by built-in functions: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """``url_key, fetched_at, page_id, value``: the text of each page's record, without the break after it.

    Of equal payloads of ``least_bytes`` or more, the one of the largest ``page_id`` is a response and the others revisit it.
    """
    df = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.col("fetched_at").cast("bigint").alias("fetched_at"))
    df = df.select("*", F.octet_length("html").cast("bigint").alias("size"), sha1_base32(F.col("html").cast("binary")).alias("digest"))
    kept = df.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "kept")
    df = df.join(kept, df["digest"] == kept["_digest"], "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("kept"), F.col("kept")))
    revisit = F.col("refers_to").isNotNull()
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    written_key = F.regexp_replace(url_key(F.col("url")), r"[\x00-\x20]", "%20")  # runs are sorted by what is read back
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), uri(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds("fetched_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.concat(F.lit("X-Capture-Key: "), written_key),
        F.concat(F.lit("X-Capture-Time: "), F.col("fetched_at").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
    )
    return df.select(written_key.alias("url_key"), "fetched_at", "page_id", F.concat(header, F.lit(BREAK), F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, folder: str, *, records_per_file: int = 1000, least_bytes: int = 0) -> None:
    """Writes ``pages(page_id, url, html, fetched_at)`` as gzipped WARC files of at most so many records, each file a sorted run."""
    rows = records(pages, least_bytes=least_bytes).sortWithinPartitions("url_key", "fetched_at", "page_id")
    rows.select("value").write.option("lineSep", BREAK).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(folder)


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """``offset, headers, payload`` of each record of an archive; offsets are those of the unpacked bytes."""
    at, mark = 0, BREAK.encode()
    while at < len(raw):
        body = raw.index(mark, at) + len(mark)
        version, *lines = raw[at : body - len(mark)].decode().split("\r\n")
        if version != "WARC/1.0":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        if raw[body + size : body + size + len(mark)] != mark:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, head, memoryview(raw)[body : body + size]
        at = body + size + len(mark)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``. Payload sizes and digests are taken from the bytes read."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    number = lambda uri: int(uri[10:-1]) if uri and uri != "<urn:page:>" else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, head, payload in parse_records(gzip.decompress(content.as_buffer())):
                    size, digest = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
                    if head["WARC-Type"] == "revisit":
                        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    elif f"sha1:{digest}" != head["WARC-Payload-Digest"]:
                        raise ValueError(f"{path}: the payload at byte {at} has another digest")
                    when = head.get("X-Capture-Time")
                    rows.append((path.rsplit("/", 1)[-1], at, head["X-Capture-Key"], int(when) if when else None, number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.where("length > 0").select("path", "content").mapInArrow(parse, INDEX)


def check_revisits(index: DataFrame) -> None:
    """Raises unless each revisit's size and digest are those of a response that was read back under the id it refers to.

    Revisits that claim the same are one row before the shuffle, however many there are.
    """
    named = {"refers_to": "_id", "payload_bytes": "_bytes", "payload_digest": "_digest"}
    claims = index.where("record_type = 'revisit'").select([F.col(c).alias(x) for c, x in named.items()]).distinct()
    shown = index.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest").distinct()
    same = (F.col("_id") == F.col("page_id")) & (F.col("_bytes") == F.col("payload_bytes")) & (F.col("_digest") == F.col("payload_digest"))
    wrong = claims.join(shown, same, "left_anti").limit(5).collect()
    if wrong:
        raise ValueError(f"revisits without their response: {[tuple(r) for r in wrong]}")


class LoserTree:
    """Merges sorted runs of ``(key, row)``, any iterators: each step replays one path of a tree that holds the losers of its matches.

    One head of each run is held. A run that is not sorted raises.
    """

    def __init__(self, runs: Iterable[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = max(1, len(self.runs))
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _less(self, a: int, b: int) -> bool:
        """Whether run ``a``'s head goes before ``b``'s; ended runs and places without a run lose, ties go to the earlier run."""
        x = self.heads[a] if a < len(self.heads) else None
        y = self.heads[b] if b < len(self.heads) else None
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.winner < len(self.heads) and self.heads[self.winner] is not None:
            run = self.winner
            head = self.heads[run]
            yield head
            self.heads[run] = next(self.runs[run], None)
            if self.heads[run] is not None and self.heads[run][0] < head[0]:
                raise ValueError(f"run {run} is not sorted at {self.heads[run][0]}")
            node = (run + self.size) // 2
            while node:
                if self._less(self.losers[node], self.winner):
                    self.losers[node], self.winner = self.winner, self.losers[node]
                node //= 2


def _run_rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """``(key, row)`` of one run's rows in the order they come; 256 rows at a time are Python objects."""
    low = -(1 << 63)
    for part in parts:
        for i in range(0, part.num_rows, 256):
            for row in zip(*[c.to_pylist() for c in part.slice(i, 256).columns], strict=True):
                yield (row[2] or "", low if row[3] is None else row[3], low if row[4] is None else row[4]), row


def merge_index(index: DataFrame, *, rows_per_range: int = 100_000) -> DataFrame:
    """The index in global order: ``range_id`` (ascending) and ``range_position`` order all captures by key, time and page.

    A run is one archive, in the order of its records: it was sorted when it was written, and the merge raises if it was not. Spark
    brings the runs' parts of one range together, each as it was, and a loser tree makes one order of them. A task holds the parts as
    Arrow columns and a few rows of each run. A range has about ``rows_per_range`` captures at any size (the cuts come from Spark's
    sample), also where one URL, or one row, is there more often. Nulls go first in each column. Equal rows of two runs keep the
    runs' order.
    """
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            begins = [0, *[i + 1 for i, same in enumerate(pc.equal(batch.column(0)[1:], batch.column(0)[:-1]).to_pylist()) if not same], batch.num_rows]
            for i, j in zip(begins, begins[1:], strict=False):
                if j > i:
                    runs.setdefault(batch.column(0)[i].as_py(), []).append(batch.slice(i, j - i))
        here, rows = TaskContext.get().partitionId(), []
        for n, (_, row) in enumerate(LoserTree(_run_rows(runs[k]) for k in sorted(runs))):
            rows.append((*row, here, n))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, "range_id", "range_position"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, "range_id", "range_position"])

    ranges = max(1, -(-index.count() // rows_per_range))
    ranged = index.repartitionByRange(ranges, "url_key", "fetched_at", "page_id", "run", "at").sortWithinPartitions("run", "at")
    return ranged.mapInArrow(merge, f"{INDEX}, range_id int, range_position bigint")


def archive_and_index(spark: SparkSession, pages: DataFrame, *, least_bytes: int = 0, workspace: Workspace | None = None) -> DataFrame:
    """Writes the archives of ``pages(page_id, url, html, fetched_at)``, reads them back and merges the runs' index.

    A null html is an empty payload, a null URL has an empty key, a null id or time stays null. Equal rows are equal records; of
    equal payloads with the same id none revisits another. An empty table gives no row; other columns are not read.
    """
    ws = workspace or Workspace(spark, "warc")
    folder = ws.folder("archives")
    write_archives(pages, folder, least_bytes=least_bytes)
    index = ws.save(read_index(spark, folder), "index")
    check_revisits(index)
    return merge_index(index)
