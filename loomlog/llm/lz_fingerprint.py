"""Lempel-Ziv phrase fingerprints (operator 10).

A text is parsed into phrases: each is the longest phrase seen before in this text plus one
character. The set of phrases is what a compressor would learn from the text; a minimum-hash signature
of it is the fingerprint, and the share of equal components says how alike two texts
are to such a compressor.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, shuffle_partitions, slices

#: Components of a signature, each 16 bits wide.
COMPONENTS = 64
#: Ranges of ids that neighbours are sought in, for each shuffle partition.
RANGES = 4

_MULTIPLY = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(COMPONENTS)], dtype=np.uint64)
_ADD = np.array([(0xC2B2AE3D27D4EB4F * (i + 1)) % (1 << 64) for i in range(COMPONENTS)], dtype=np.uint64)


def phrases(text: str, known: set[str] | None = None, open_phrase: str = "") -> tuple[set[str], str]:
    """The phrases of a text after those ``known`` (extended in place) and the one left open."""
    known = set() if known is None else known
    add, p = known.add, open_phrase
    for c in text:
        p += c
        if p not in known:
            add(p)
            p = ""
    return known, p


def signature(found: set[str], open_phrase: str = "") -> np.ndarray:
    """The minimum-hash signature of a phrase set; all ones without phrases."""
    # an open phrase is one of the set already, so it adds nothing
    if not found:
        return np.full(COMPONENTS, 0xFFFF, dtype=np.uint16)
    h = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in found), dtype=np.uint64, count=len(found))
    least = np.full(COMPONENTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        np.minimum(least, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(1), out=least)
    # the smallest value's middle bits: its upper ones are nearly all zero
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text, without a shuffle. A null or
    empty text has the fingerprint of no phrase; null ids and repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                prints = [as_text(signature(*phrases(t))) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints)],
                    ["doc_id", "n_chars", "fingerprint"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_NEAR = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NEAR_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NEAR_NAMES = [c.split()[0] for c in _NEAR.split(", ")]


def _pair(doc_id: int | None, text: str, following: str) -> tuple:
    """A document's fingerprint and that of its edited text; both parse its kept half once."""
    n = len(text)
    taken = following[: n // 2]
    keep = n - n // 2
    shared, p = phrases(text[:keep])
    edited = phrases(taken, set(shared), p)
    own = signature(*phrases(text[keep:], shared, p))
    other = signature(*edited)
    digest = hashlib.sha256((text[:keep] + taken).encode()).hexdigest()
    return doc_id, n, digest, own, other


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text and the next document (``_NEAR``).

    The next document is the one with the next larger id, the last one's is the first.
    The edited text is the document with its last floor(n/2) code points replaced by the
    first as many (or all) of the next. Null ids come first; rows with equal ids follow each other by a
    hash of the text, identical rows in either order. A null text is empty. A single
    document is its own successor; an empty table gives no rows.

    Ids are cut into ranges at quantiles (a few numbers for each partition); each range
    gets its rows and, as a guest, the first row after it, so texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("_null", F.col("doc_id").isNull())
    n = shuffle_partitions(spark)
    q = [i / (RANGES * n) for i in range(1, RANGES * n)]
    got = rows.agg(
        F.percentile_approx("doc_id", q, 10 * RANGES * n).alias("cuts"), F.min("doc_id").alias("least"),
        F.max(F.col("_null").cast("int")).alias("nulls"),
    ).head()
    cuts = sorted(set(got["cuts"] or []) - {got["least"]})
    firsts = set(cuts)  # each cut is the id of a row, the first of its range
    last = len(cuts)
    # the first document of all follows the last one
    begin = None if got["nulls"] else got["least"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            to, take, guest = [], [], []
            for i, d in enumerate(ids):
                at = 0 if d is None else bisect_right(cuts, d)
                to.append(at)
                take.append(i)
                guest.append(0)
                if d in firsts:
                    to.append(at - 1)
                    take.append(i)
                    guest.append(1)
                if d == begin:
                    to.append(last)
                    take.append(i)
                    guest.append(2)
            part = batch.select(["doc_id", "text"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(guest, pa.int32()), *part.columns], ["to", "guest", "doc_id", "text"]
            )

    dealt = rows.mapInArrow(deal, "to int, guest int, doc_id long, text string")
    keys = ["to", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = dealt.repartition(n, "to").sortWithinPartitions(*keys)

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(_NEAR_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NEAR_TYPES)], _NEAR_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor is the next one, then its results
        waiting = None  # results that lack the successor's fingerprint
        closed = None  # the range whose guest was met
        found: list[tuple] = []

        def finish(other: np.ndarray) -> None:
            d, chars, digest, own, edited = waiting
            found.append((d, chars, digest, as_text(own), as_text(edited), likeness(own, edited), likeness(own, other)))

        for batch in batches:
            for row in batch.to_pylist():
                if row["to"] == closed:
                    continue  # further guests of this range
                if held is not None:
                    result = _pair(held["doc_id"], held["text"], row["text"])
                    if waiting is not None:
                        finish(result[3])
                    waiting = result
                held = row
                if row["guest"]:
                    if waiting is not None:
                        finish(signature(*phrases(row["text"])))
                    held, waiting, closed = None, None, row["to"]
            if len(found) > 500:
                yield out(found)
                found = []
        yield out(found)

    return placed.mapInArrow(run, _NEAR)
