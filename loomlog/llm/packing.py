"""Hierarchical multi-length packing (operator 2).

A document's full windows are sequences of their own. What is left of it goes to the
smallest context size that holds it. Each tier is packed from its longest pieces
down; the gap behind a piece is filled with the longest fitting pieces of shorter
tiers, and a last piece is cut where nothing fits. Sequences of one tier form step
groups of equally many tokens. Every task packs the rows of its own partition, so nothing is shuffled;
what a task cannot fill at its end (less than one window) is cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomlog.llm.common import id_and_text, release_memory, slices
from loomlog.llm.token_ids import piece_tokenizer

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group: as many sequences of one tier as make this many.
STEP_TOKENS = 32_768
#: Bits of an id that number the sequences of one partition.
LOCAL_BITS = 36

COLUMNS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` into sequences; rows come out as column lists."""

    def __init__(self, tiers: Sequence[int], step_tokens: int, base: int):
        self.tiers, self.step_tokens, self.base = sorted(tiers), step_tokens, base
        self.window = self.tiers[-1]
        self.by_length: dict[int, list[tuple]] = {}
        self.lengths = 0  # a bit for each length that has pieces
        self.sequences = 0
        self.groups = 0
        self.filling: dict[int, tuple[int, int]] = {}  # by size: the open step group and its tokens
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            self._sequence([(doc_id, start, ids[start : start + self.window], len(ids))])
        if full < len(ids):
            self._put((doc_id, full, ids[full:], len(ids)))

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_length.setdefault(n, []).append(piece)
        self.lengths |= 1 << n

    def _take(self, n: int) -> tuple:
        pieces = self.by_length[n]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[n]
            self.lengths ^= 1 << n
        return piece

    def _longest(self, most: int) -> int:
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1

    def pack(self) -> None:
        """Pack all pieces, but for less than a window that may be left."""
        for size in reversed(self.tiers):
            shorter = max([t for t in self.tiers if t < size], default=0)
            while (n := self._longest(size)) > shorter:
                held, gap = [self._take(n)], size - n
                while gap and (n := self._longest(gap)) > 0:
                    held.append(self._take(n))
                    gap -= n
                if gap and self.lengths:  # nothing fits: cut the shortest piece there is
                    low = self.lengths & -self.lengths
                    doc_id, start, ids, total = self._take(low.bit_length() - 1)
                    held.append((doc_id, start, ids[:gap], total))
                    self._put((doc_id, start + gap, ids[gap:], total))
                    gap = 0
                if gap:
                    for piece in held:
                        self._put(piece)
                    return
                self._sequence(held)

    def finish(self) -> None:
        """Cut what is left at powers of two."""
        rest = [self._take(n) for n in list(self.by_length) for _ in range(len(self.by_length[n]))]
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            held, gap = [], size
            while gap:
                doc_id, start, ids, total = rest.pop()
                held.append((doc_id, start, ids[:gap], total))
                if len(ids) > gap:
                    rest.append((doc_id, start + gap, ids[gap:], total))
                gap -= min(gap, len(ids))
            self._sequence(held)
            left -= size

    def _sequence(self, pieces: list[tuple]) -> None:
        size = sum(len(p[2]) for p in pieces)
        group, tokens = self.filling.get(size, (None, 0))
        if group is None or tokens + size > self.step_tokens:
            group, tokens = self.groups, 0
            self.groups += 1
        self.filling[size] = (group, tokens + size)
        offset, number = 0, self.base + self.sequences
        self.sequences += 1
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, number, offset, size, self.base + group))
            offset += len(ids)


_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: ``COLUMNS``, no row in two sequences, no padding.

    ``tiers`` are powers of two, the last is the longest sequence. ``tokenizer`` names a tokenizers JSON file.
    A null or empty text is the end id alone; null ids and repeated rows stay; other
    columns are not read. Ids of sequences and groups hold the number of the input's partition, so
    they are the same when a task runs again over the same files.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    tiers = tuple(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_tokenizer(tokenizer)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << LOCAL_BITS)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * len(_NAMES)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

        for batch in batches:
            for rows, texts in slices(batch):
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), words.ids(texts, end_id)):
                    packer.add(doc_id, ids)
                packer.pack()
                yield out()
        packer.finish()
        yield out()
        release_memory()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, COLUMNS)
