"""Token counts by section: whole documents are encoded once and token spans are joined to section spans.

Tokens never see a section's edge: the document is encoded whole, each token has a half-open character span, and the interval
join gives it to sections. A token that lies across an edge goes to the section with most of its UTF-8 bytes, to the earlier
one where two have as many. So the counts of a document's sections add up to the count of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.tokens import encoder

SCHEMA = "doc_id bigint, section int, kind string, char_start bigint, char_end bigint, n_tokens bigint, n_split_tokens bigint, doc_tokens bigint"


def line_sections(text: str) -> tuple[list[str], np.ndarray]:
    """Kinds and character ends of a text's lines; a line's newline is its own last character.

    ``kind``: ``title`` (first line), ``table`` (a line with `` | ``) or ``body``.
    """
    lines = text.split("\n")
    ends = np.cumsum([len(x) + 1 for x in lines])
    ends[-1] -= 1
    return ["title" if not i else "table" if " | " in x else "body" for i, x in enumerate(lines)], ends


def allocate(ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it lies across an edge, by byte ends of tokens and byte ends of sections (both rising).

    Interval join by two binary searches. A token over several sections goes to the one that holds most of it, ties to the
    earlier; sections of no bytes get none.
    """
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(cuts, starts, side="right")
    last = np.searchsorted(cuts, ends - 1, side="right")
    owner, across = first.copy(), first != last
    for k in np.flatnonzero(across):
        edges = np.concatenate([[starts[k]], cuts[first[k] : last[k]], [ends[k]]])
        owner[k] = first[k] + int(np.argmax(np.diff(edges)))
    return owner, across


def count_tokens(docs: DataFrame, vocabulary: str, *, sections: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section: ``doc_id, section, kind, char_start, char_end, n_tokens, n_split_tokens, doc_tokens``.

    ``sections``: a column of ``array<struct<kind, char_end>>`` in order; each begins where the one before it ends, and the last one
    ends where the text ends, whatever its ``char_end``. An end before the last one or beyond the text is moved to there; a null
    one means the text's end; a null or empty array is one section without a kind. By default a text's lines.
    ``n_split_tokens``: how many of a section's tokens also reach into another. ``doc_tokens``: tokens of the whole text.

    A null or empty text has one empty section of no token; null ids stay null; repeated rows give repeated results; an empty
    table gives no row; other columns are not read. No shuffle; a text is in memory only while it is counted.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    by_line = sections is None
    types = (pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for r, doc in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[r].as_py() or ""
                if by_line:
                    kinds, hi = line_sections(text)
                else:
                    given = [x or {"kind": None, "char_end": None} for x in batch.column(2)[r].as_py() or [None]]
                    kinds, ends = [x["kind"] for x in given], [len(text) if x["char_end"] is None else x["char_end"] for x in given]
                    hi = np.maximum.accumulate(np.clip(np.array(ends, dtype=np.int64), 0, len(text)))
                    hi[-1] = len(text)
                lo = np.concatenate([[0], hi[:-1]])
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                at = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])  # character -> byte
                ends = enc.byte_ends(text) if text else np.zeros(0, dtype=np.int64)
                owner, across = allocate(ends, at[hi]) if len(ends) else (ends, ends.astype(bool))
                n, split = np.bincount(owner, minlength=len(hi)), np.bincount(owner[across], minlength=len(hi))
                out += zip([doc] * len(hi), range(len(hi)), kinds, lo.tolist(), hi.tolist(), n.tolist(), split.tolist(), [len(ends)] * len(hi), strict=True)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    columns = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *([] if sections is None else [sections.alias("spans")])]
    return docs.select(*columns).mapInArrow(count, SCHEMA)
