"""Hierarchical multi-length packing of token streams into training sequences.

Each document is encoded whole and gets one end id. Its full long windows are cut off first; the rest of it is routed to the
smallest context tier that holds it. Every tier is packed in windows of its own size. A gap in a window takes the largest
whole piece of a shorter tier that fits, and what is still open takes the head of a longer piece, whose tail is routed anew.
So windows are full at a power of two and need no padding. Windows of one tier are dealt to step groups of equal token count.

A task packs its own partition: no shuffle, and memory bounded by ``buffer_tokens`` however large the partition is. A re-run
of a lost task reads the same rows and so builds the same sequences.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.tokens import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, tier int, step_group bigint"


class TierPacker:
    """Packs pieces ``(doc, start, ids, doc_tokens)`` as they come; :meth:`take` gives the finished rows.

    ``tiers``: powers of two, longest first. ``first_id``: id of the first sequence; ids count up from there.
    """

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, buffer_tokens: int, first_id: int) -> None:
        self.tiers, self.step_tokens, self.buffer_tokens = tiers, step_tokens, buffer_tokens
        self.waiting: list[deque] = [deque() for _ in range(tiers[0] + 1)]  # by length of the piece
        self.bits = 0  # bit n is set where waiting[n] holds a piece
        self.held = 0
        self.next_id = first_id
        self.in_tier = dict.fromkeys(tiers, 0)
        self.first_id = first_id
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        long, n = self.tiers[0], len(ids)
        for start in range(0, n - long + 1, long):
            self._close([(doc, start, ids[start : start + long], n)], long)
        if n % long:
            self._wait((doc, n - n % long, ids[n - n % long :], n))
        if self.held > self.buffer_tokens:
            while self.held > self.buffer_tokens // 2:
                self._window()

    def finish(self) -> None:
        """Packs what still waits; the last tokens of all become sequences of falling powers of two."""
        while self.held >= self.tiers[0]:
            self._window()
        while self.held:
            self._fill(1 << (self.held.bit_length() - 1))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2])
        self.waiting[n].append(piece)
        self.bits |= 1 << n
        self.held += n

    def _largest(self, most: int) -> tuple | None:
        """The oldest of the longest waiting pieces of at most so many ids."""
        n = (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 0:
            return None
        piece = self.waiting[n].popleft()
        if not self.waiting[n]:
            self.bits &= ~(1 << n)
        self.held -= n
        return piece

    def _window(self) -> None:
        """One full window of the longest tier that has a piece of its own."""
        longest = self.bits.bit_length() - 1
        self._fill(next((t for t in reversed(self.tiers) if longest <= t <= self.held), self.tiers[0]))

    def _fill(self, size: int) -> None:
        pieces, gap = [], size
        while gap:
            piece = self._largest(gap)
            if piece is None:  # only longer ones wait: cut the shortest of them
                shortest = self.bits >> (gap + 1)
                doc, start, ids, total = self._largest(gap + (shortest & -shortest).bit_length())
                piece = (doc, start, ids[:gap], total)
                self._wait((doc, start + gap, ids[gap:], total))
            pieces.append(piece)
            gap -= len(piece[2])
        self._close(pieces, size)

    def _close(self, pieces: list[tuple], size: int) -> None:
        tier = size if size in self.in_tier else self.tiers[-1]
        group = self.first_id + self.tiers.index(tier) + len(self.tiers) * (self.in_tier[tier] * tier // self.step_tokens)
        self.in_tier[tier] += 1
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset, size, tier, group))
            offset += len(ids)
        self.next_id += 1


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = (1024, 512, 256, 128), step_tokens: int = 8192, end_id: int = 0, buffer_tokens: int = 400_000) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset, sequence_tokens, tier, step_group``.

    Each id of each document, ``end_id`` after its text included, is in exactly one piece. ``sequence_tokens`` is a power of two
    of at most ``tiers[0]`` and the sequence is full, so nothing is padded. Sequences of a step group have one tier and, but
    for a task's last group of a tier, ``step_tokens`` tokens in all.

    A null text counts as empty (its one piece is the end id); a null id stays null; repeated rows are packed once each; an
    empty table gives no row; other columns are not read, whatever their names.
    """
    if any(t & (t - 1) or t <= 0 for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True) or step_tokens % tiers[0]:
        raise ValueError("tiers: falling powers of two; step_tokens: a multiple of the first")

    def rows(packer: TierPacker) -> Iterator[pa.RecordBatch]:
        if done := packer.take():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        packer = TierPacker(tiers, step_tokens, buffer_tokens, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.concatenate([encode(text.as_py() or "").astype("<u4", copy=False), end]))
                if len(packer.rows) >= 2000:
                    yield from rows(packer)
        packer.finish()
        yield from rows(packer)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)
