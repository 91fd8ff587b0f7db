"""Fill-in-the-middle texts: a document is cut into prefix, middle and suffix, which are put together in another order.

Where a text is cut and which form it takes follows from a hash of its id, computed by Spark. The pieces are made per Arrow batch:
texts become lists of code points, the lists are flattened beside their row numbers, each code point's ordinal says its role,
each role's code points are rebuilt into lists, and the joined lists are put together with the sentinels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draw(key: Column, i: int, seed: int = 1) -> Column:
    """The ``i``-th (from 0) group of eight hexadecimal digits of sha256 of ``seed:key``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")


def code_points(texts: pa.StringArray) -> pa.ListArray:
    """Each text as the list of its code points, which share the texts' bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    lead = (np.frombuffer(data, np.uint8)[at[0] : at[-1]] & 0xC0) != 0x80
    starts = np.append(np.flatnonzero(lead) + at[0], at[-1]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), flat)


def rearrange(texts: pa.StringArray, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
    """The output of each text in its form, cut after ``first`` and ``second`` code points."""
    lists = code_points(texts)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(lists.offsets, parents))
    in_prefix, in_suffix = pc.less(ordinal, pc.take(first, parents)), pc.greater_equal(ordinal, pc.take(second, parents))

    def piece(role: pa.Array) -> pa.Array:
        sizes = np.bincount(pc.filter(parents, role).to_numpy(), minlength=len(texts))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.filter(flat, role)), "")

    prefix, suffix, middle = piece(in_prefix), piece(in_suffix), piece(pc.invert(pc.or_(in_prefix, in_suffix)))
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "spm"), spm, psm))


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text; a longer text is a slice of its own."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20, bytes_at_once: int = 1 << 20) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output``, one row per input row.

    The text is cut after ``min`` and ``max`` of ``draw 0 % (n + 1)`` and ``draw 1 % (n + 1)`` code points. ``plain_percent`` of the
    texts (by draw 2), empty and null texts and texts that contain a sentinel stay as they are (``plain``, no piece sizes); of the
    others ``spm_percent`` (by draw 3) take suffix, prefix, middle, the rest prefix, suffix, middle. Rows are independent: repeated
    rows and ids give equal rows, a null id draws as an empty string, an empty table gives no row, other columns are not read.
    Memory follows ``bytes_at_once``, or the longest single text (about 60 bytes a code point).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("text"), F.length(text).cast("bigint").alias("n"))
    a, b = (draw(F.col("_id"), i) % (F.col("n") + 1) for i in (0, 1))
    plain = (F.col("n") == 0) | (draw(F.col("_id"), 2) % 100 >= 100 - plain_percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.col("text").contains(mark)
    form = F.when(plain, "plain").when(draw(F.col("_id"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    df = df.select("_id", "text", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, bytes_at_once):
                made = rearrange(*(part.column(c) for c in ("text", "first", "second", "form")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "n", "form", "first", "second")), made], ["_id", "n", "form", "first", "second", "output"])

    kind = df.schema["_id"].dataType.simpleString()
    out = df.mapInArrow(outputs, f"_id {kind}, n bigint, form string, first bigint, second bigint, output string")
    cut = F.col("form") != "plain"
    return out.select(F.col("_id").alias(id_col), "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text of which ``output`` was made. A text in pieces holds no sentinel, so the three in the output are those put there."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(F.concat(piece[1], piece[3], piece[2]))
