"""Line deduplication with two Bloom filters (operator 7).

Every task puts the hashed keys of its lines into two Bloom filters: once-seen, and
twice-seen for bits that are set a second time. Merged over all tasks, a key that two documents
hold has all its bits in the twice-seen filter, whatever the order of the merge. Only lines that pass this filter are
suspected repeats; their 128-bit digests are shuffled, counted exactly and given
their first document. Then each document loses the lines that an earlier one holds.

The filters grow with the text and are nowhere whole. They travel as positions of set bits, a few bytes a line, cut into
segments; each segment is merged in one task. The positions of each chunk of lines then meet the merged segments, and
the chunk is told which of them are seen twice. The digests of a chunk stay where they were written: the
chunks are a table in buckets, to which only the answers are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.common import SPACES, lower_ascii, release_memory, shuffle_partitions, slices, small_batches, small_reads, unused
from loomlog.workspace import Workspace

#: Bits that stand for one key in each filter, one in each of as many planes.
PLANES = 2
#: Fewest bits of one segment of a plane, and most segments of a plane; beyond, the segments grow.
SEGMENT, MOST_SEGMENTS = 1 << 16, 1 << 14
#: Bits of a plane for a character of text.
BITS_PER_CHAR = 0.05
#: Keys whose bits a task gathers before it hands them on.
FILTER_KEYS = 200_000
#: Filter rows in one batch.
ROWS = 2000
#: Stands for a null id, which comes before all others.
NO_ID = -(1 << 63)


def line_key(line: str) -> bytes:
    """What makes two lines the same: no blanks at the ends, A-Z lower-cased."""
    return lower_ascii(line.strip(SPACES))


def _keys(text: str, shortest: int) -> list[bytes | None]:
    """The key of each line, None for keys that are too short to count."""
    out = []
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        out.append(lower_ascii(bare) if len(bare) >= shortest else None)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each digest (its 16 bytes) in each plane, a column a plane."""
    return (digests.view("<u8").reshape(-1, PLANES) & np.uint64(bits - 1)).astype(np.int64)


_SCAN = pa.schema([
    ("chunk", pa.int64()), ("plane", pa.int32()), ("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary()),
    ("docs", pa.binary()), ("keys", pa.binary()),
])
_SCAN_DDL = "chunk long, plane int, segment int, once binary, twice binary, docs binary, keys binary"


def _filter_rows(chunk: int, digests: np.ndarray, bits: int, segment: int) -> Iterator[dict]:
    """The two filters of a chunk: by plane and segment the positions set once or more, and twice or more."""
    for plane, places in enumerate(_places(digests, bits).T):
        once, n = np.unique(places, return_counts=True)
        twice = once[n > 1]
        cut = np.unique(once // segment)
        a = np.searchsorted(once, cut * segment), np.searchsorted(once, (cut + 1) * segment)
        b = np.searchsorted(twice, cut * segment), np.searchsorted(twice, (cut + 1) * segment)
        one, two = (once % segment).astype("<u4"), (twice % segment).astype("<u4")
        for i, s in enumerate(cut.tolist()):
            yield {
                "chunk": chunk, "plane": plane, "segment": s, "once": one[a[0][i] : a[1][i]].tobytes(),
                "twice": two[b[0][i] : b[1][i]].tobytes(),
            }


def _scanned(docs: DataFrame, bits: int, segment: int, shortest: int) -> DataFrame:
    """The chunks of lines of each task, ``docs`` and ``keys`` (digests), and, with a ``plane``, the filters of each chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, digests, owners = TaskContext.get().partitionId() << 32, [], []

        def rows() -> Iterator[pa.RecordBatch]:
            keys = np.frombuffer(b"".join(digests), dtype=np.uint8)
            docs = np.concatenate(owners).astype("<i8").tobytes()
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "docs": docs, "keys": keys.tobytes()}], schema=_SCAN)
            made = list(_filter_rows(chunk, keys, bits, segment))
            for i in range(0, len(made), ROWS):
                yield pa.RecordBatch.from_pylist(made[i : i + ROWS], schema=_SCAN)

        for batch in batches:
            for rows_, texts in slices(batch):
                for doc, text in zip(rows_.column("_doc").to_pylist(), texts):
                    own = set(_keys(text, shortest)) - {None}
                    digests += map(_digest, own)
                    owners.append(np.full(len(own), doc, dtype=np.int64))
                if len(digests) > FILTER_KEYS:
                    yield from rows()
                    chunk, digests, owners = chunk + 1, [], []
        if digests:
            yield from rows()
        release_memory()

    return docs.mapInArrow(scan, _SCAN_DDL)


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: (row["plane"], row["segment"]))


def seen_twice(filters: DataFrame, segment: int) -> DataFrame:
    """``plane, segment, twice``: the merged twice-seen filter, by positions."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (plane, at), rows in _by_segment(batches):
            once, twice = np.zeros(segment, dtype=bool), np.zeros(segment, dtype=bool)
            for row in rows:
                more = np.frombuffer(row["once"], "<u4")
                twice[more] |= once[more]
                twice[np.frombuffer(row["twice"], "<u4")] = True
                once[more] = True
            places = np.flatnonzero(twice).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([plane], pa.int32()), pa.array([at], pa.int32()), pa.array([places])], ["plane", "segment", "twice"])
        release_memory()

    # a document whose rows lie in two tasks may set a bit twice: that only suspects more lines
    placed = filters.repartition(shuffle_partitions(filters.sparkSession), "plane", "segment").sortWithinPartitions("plane", "segment")
    return placed.select("plane", "segment", "once", "twice").mapInArrow(merge, "plane int, segment int, twice binary")


def _answers(filters: DataFrame, twice: DataFrame, segment: int) -> DataFrame:
    """``chunk, plane, places``: which positions of each chunk are seen twice, as numbers in the whole plane."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (plane, at), rows in _by_segment(batches):
            seen, chunks, places = np.zeros(segment, dtype=bool), [], []
            for row in rows:
                if row["chunk"] is None:  # the merged segment comes first
                    seen[np.frombuffer(row["places"], "<u4")] = True
                    continue
                own = np.frombuffer(row["places"], "<u4")
                if len(own := own[seen[own]]):
                    chunks.append(row["chunk"])
                    places.append((own.astype("<i8") + at * segment).tobytes())
            columns = [pa.array(chunks, pa.int64()), pa.array([plane] * len(chunks), pa.int32()), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "plane", "places"])
        release_memory()

    both = filters.select("plane", "segment", "chunk", F.col("once").alias("places")).unionAll(
        twice.select("plane", "segment", F.lit(None).cast("long"), "twice")
    )
    placed = both.repartition(shuffle_partitions(filters.sparkSession), "plane", "segment")
    placed = placed.sortWithinPartitions("plane", "segment", F.col("chunk").asc_nulls_first())
    return placed.mapInArrow(answer, "chunk long, plane int, places binary")


def _suspects(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The lines of each chunk whose bits are seen twice in every plane."""
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.frombuffer(row["keys"], dtype=np.uint8)
            places, hit = _places(keys, bits), True
            for plane in range(PLANES):
                seen = [np.frombuffer(a["places"], "<i8") for a in row["answers"] if a["plane"] == plane]
                hit = hit & np.isin(places[:, plane], np.concatenate(seen)) if seen else np.zeros(len(places), dtype=bool)
            at = np.flatnonzero(hit)
            chosen = keys.reshape(-1, 16)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.tobytes() for k in chosen], pa.binary()), pa.array(np.frombuffer(row["docs"], "<i8")[at], pa.int64())],
                ["_key", "_doc"],
            )
    release_memory()


def _internal(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ]


def later_lines(
    docs: DataFrame, shortest: int = 10, max_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``_doc, _drop``: for each document that loses lines, the digests of their keys."""
    spark = docs.sparkSession
    work = small_reads(small_batches(docs)).select(*_internal(docs, id_col, text_col))
    chars = docs.agg(F.sum(F.length(text_col))).head()[0] or 0
    bits = SEGMENT
    while bits < chars * BITS_PER_CHAR and (max_bits is None or bits < max_bits):
        bits *= 2
    segment, n = max(SEGMENT, bits // MOST_SEGMENTS), shuffle_partitions(spark)
    tables = Workspace(spark)
    # chunks of a task go to the bucket of their number, where the answers come to
    scanned = tables.save_bucketed(_scanned(work, bits, segment, shortest), "lines", "chunk", n)
    filters = scanned.where(F.col("plane").isNotNull()).select("chunk", "plane", "segment", "once", "twice")
    answers = _answers(filters, seen_twice(filters, segment), segment).groupBy("chunk").agg(F.collect_list(F.struct("plane", "places")).alias("answers"))
    chunks = scanned.where(F.col("plane").isNull()).select("chunk", "docs", "keys")
    told = chunks.join(answers.hint("shuffle_hash"), "chunk").select("docs", "keys", "answers")
    found, _ = tables.save(told.mapInArrow(partial(_suspects, bits=bits), "_key binary, _doc long"), "suspected-lines")
    # one row for each key and task reaches the shuffle, so a line of every document is no burden
    first = found.groupBy("_key").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"))
    repeated, _ = tables.save(first.where("_first < _last").drop("_last"), "repeated-lines")
    # both sides are read from tables, so adaptive execution can split the rows of a hot key
    later = found.join(repeated.hint("merge"), "_key").where("_doc > _first")
    return later.groupBy("_doc").agg(F.collect_set("_key").alias("_drop"))


def _cut_lines(docs: DataFrame, counts: bool, shortest: int, max_bits: int | None, id_col: str, text_col: str) -> DataFrame:
    doc, drop = unused(docs, "_doc"), unused(docs, "_drop")
    drops = later_lines(docs, shortest, max_bits, id_col, text_col).toDF(doc, drop)
    names = docs.columns
    joined = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).join(drops, doc, "left")
    joined = joined.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))).select(*names, drop)
    fields = list(docs.schema.fields)
    if counts:
        fields += [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column(text_col).to_pylist(), batch.column(drop).to_pylist()):
                lines = text.split("\n")
                kept = lines
                if lost:
                    lost = set(lost)
                    kept = [ln for ln, k in zip(lines, _keys(text, shortest)) if k is None or _digest(k) not in lost]
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            if counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return joined.mapInArrow(cut, T.StructType(fields))


def dedup_lines(
    docs: DataFrame, shortest: int = 10, max_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` with shortened texts.

    A line whose key (``line_key``) has ``shortest`` code points or more and occurs in two
    documents stays only in the one with the smallest id; there it stays as often as it occurs. Rows with
    the same id are one document, rows without id too, and that one comes first. A null or
    empty text is one empty line and becomes empty. Repeated rows each come out.
    """
    return _cut_lines(docs, False, shortest, max_bits, id_col, text_col)


def line_report(
    docs: DataFrame, shortest: int = 10, max_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """As ``dedup_lines``: ``doc_id, text, n_lines, n_dropped`` (lines before, and lost)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _cut_lines(own, True, shortest, max_bits, "doc_id", "text")
