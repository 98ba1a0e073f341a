"""Alignment of two tokenizers over the same texts, with corpus-wide counts of aligned tokens (operator 13).

Tokenizer A is a byte-level BPE file run on a blank and the text, B a sentencepiece model,
which adds the blank itself. Where tokens of both end at the same byte, a group ends; the two tokens
that end there are linked. Neither has tokens across a blank that follows a word, so texts are cut there and each
distinct unit is encoded and aligned once per worker. How often each pair of ids is linked in the whole corpus is counted outside memory:

* Each task sorts its (pair, document) records by B id, A id and document and deals them into RADICES
  chunks by B id. A chunk is a row of a table, its columns are zstd-compressed arrays; the chunks of one
  task (several sets, if it has more than RUN_RECORDS records) are a run.
* The totals of the chunks of a radix are merged through a heap, FAN_IN runs at a time and level, until
  one is left. In it all pairs of a B id follow each other, so its highest count is known when the B id ends.
* The counts meet the records of some runs at a time, again in the order of the pairs, and what each record
  contributes to its document is summed up before it is sent to its document.

A chunk holds a pair once, whatever its documents, so a frequent pair is one entry per run in
the merge; its documents stay with their run.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, release_memory, shuffle_partitions, slices
from loomlog.workspace import Workspace

#: Parts of the pairs by B id (a power of two), and the parts in which counts go back to the documents.
RADICES, RETURNS = 64, 8
#: Records that a task holds before it writes a run.
RUN_RECORDS = 4_000_000
#: Runs that are merged at once, and runs that one task reads when counts go back.
FAN_IN, RETURN_RUNS = 128, 32
#: Bytes of aligned units that a worker remembers, as estimated.
HELD_BYTES = 100 << 20
#: A pair is B id << PAIR_BITS | A id.
PAIR_BITS = 24

# The white space of Unicode, which the pieces of A go by.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Neither tokenizer makes a token across a blank that follows something other than white space (the last one stays: B drops a blank alone).
CUT = re.compile(rf"(?<=[^{WHITE}])(?= (?!\Z))")

_ROW = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups", pa.string()), ("radix", pa.int32()), ("run", pa.int64()), ("pairs", pa.binary()),
    ("totals", pa.binary()), ("documents", pa.binary()), ("rows", pa.binary()), ("times", pa.binary()),
])
_ROW_DDL = (
    "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups string, radix int, run long, "
    "pairs binary, totals binary, documents binary, rows binary, times binary"
)
_CHUNK = pa.schema([("radix", pa.int32()), ("run", pa.int64()), ("pairs", pa.binary()), ("totals", pa.binary())])
_CHUNK_DDL = "radix int, run long, pairs binary, totals binary"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        from loomlog.llm.speculative_bpe import stand_ins

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = stand_ins()
        a_size, b_size = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        if max(a_size, b_size) >= 1 << PAIR_BITS:
            raise ValueError("a vocabulary is too large")
        self.a_bytes = [b""] * a_size
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(map(byte.__getitem__, token))
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(list(range(b_size))))
        ]
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # how an id is written before a comma, at the end of a side, at the end of a group
        self.written = [f"{i}{end}" for n, end in ((a_size, ","), (a_size, "|"), (b_size, ","), (b_size, ";")) for i in range(n)]
        self.at = np.cumsum([0, a_size, a_size, b_size])

        # how each piece of text is aligned: the linked pairs, the written groups, the numbers of ids
        self.unit: dict[str, int] = {}
        self.links: list[bytes] = []
        self.groups: list[str] = []
        self.sizes: list[tuple[int, int]] = []
        self.held = 0
        if any("▁" in p.lstrip("▁") for p in self.b.id_to_piece(list(range(b_size)))):
            raise ValueError("tokens of B go on after a blank")

    def _learn(self, units: list[str]) -> None:
        """Align units, each of which begins with a blank; B puts that blank back itself."""
        ids = [
            [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)],
            self.b.encode([u[1:] for u in units], num_threads=1),
        ]
        flat = [np.array(list(chain.from_iterable(x)), dtype=np.int64) for x in ids]
        ends = [np.cumsum([len(i) for i in x]) for x in ids]
        sizes = np.array([[len(i) for i in x] for x in ids]).T
        for side, known in enumerate((self.a_bytes, self.b_bytes)):
            spelled = list(map(known.__getitem__, flat[side].tolist()))
            if b"".join(spelled) != "".join(units).encode():
                starts = ends[side] - sizes[:, side]
                same = [b"".join(spelled[i:j]) == u.encode() for u, i, j in zip(units, starts.tolist(), ends[side].tolist())]
                for u in (u for u, good in zip(units, same) if not good):
                    self._keep(u, b"", "", None)
                if any(same):
                    self._learn([u for u, good in zip(units, same) if good])
                return
        pairs, last, places = self._align(*flat)
        cut = np.cumsum(sizes.sum(axis=1)).tolist()
        written = list(map(self.written.__getitem__, places.tolist()))
        link_cut = (np.cumsum(last)[ends[0] - 1] * 8).tolist()
        data, i, j = pairs.tobytes(), 0, 0
        for u, k, m, n in zip(units, cut, link_cut, sizes.tolist()):
            self._keep(u, data[j:m], "".join(written[i:k]), tuple(n))
            i, j = k, m

    def _keep(self, unit: str, links: bytes, groups: str, sizes: tuple[int, int] | None) -> None:
        self.unit[unit] = len(self.links)
        self.links.append(links)
        self.groups.append(groups)
        self.sizes.append(sizes)
        self.held += 200 + 10 * len(unit)

    def _align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ids over the same bytes: the linked pairs, which A ids are linked, and all ids as places in ``written``."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        place = np.minimum(np.searchsorted(b_end, a_end), len(b) - 1)
        a_last = b_end[place] == a_end
        b_last = np.zeros(len(b), dtype=bool)
        b_last[place[a_last]] = True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(a) + len(b), dtype=np.int64)
        out[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + self.at[a_last.astype(int)]
        out[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = b + self.at[2 + b_last.astype(int)]
        return b[b_last] << PAIR_BITS | a[a_last], a_last, out

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, int, int]]:
        """The linked pairs and the written groups of each text, and how many ids A and B have; nothing
        if the text is empty or either does not give it back byte by byte."""
        if self.held > HELD_BYTES:
            self.unit.clear(), self.links.clear(), self.groups.clear(), self.sizes.clear()
            self.held = 0
        split = [CUT.split(" " + t) if t else [] for t in texts]
        if new := set().union(*split).difference(self.unit):
            self._learn(list(new))
        for units in split:
            at = list(map(self.unit.__getitem__, units))
            sizes = list(map(self.sizes.__getitem__, at))
            if None in sizes or not at:
                yield np.zeros(0, dtype=np.int64), "", 0, 0
                continue
            n_a, n_b = map(sum, zip(*sizes))
            links = np.frombuffer(b"".join(map(self.links.__getitem__, at)), dtype=np.int64)
            yield links, "".join(map(self.groups.__getitem__, at))[:-1], n_a, n_b


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's tokenizers for two files."""
    if (a_path, b_path) not in _loaded:
        _loaded.clear()
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array takes a new value."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def _run(run: int, pairs: np.ndarray, rows: np.ndarray) -> Iterator[dict]:
    """The chunks of links, given as pairs and rows."""
    order = np.lexsort((rows, pairs, (pairs >> PAIR_BITS) % RADICES))
    pairs, rows = pairs[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1])]))
    times = np.diff(np.append(first, len(pairs)))
    pairs, rows = pairs[first], rows[first]
    radix = (pairs >> PAIR_BITS) % RADICES
    ends = np.append(_starts(radix), len(radix))
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        at = _starts(pairs[lo:hi])
        yield {
            "radix": int(radix[lo]), "run": run, "pairs": _pack(pairs[lo:hi][at]), "totals": _pack(np.add.reduceat(times[lo:hi], at)),
            "documents": _pack(np.diff(np.append(at, hi - lo))), "rows": _pack(rows[lo:hi]), "times": _pack(times[lo:hi]),
        }


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", run_records: int = RUN_RECORDS
) -> DataFrame:
    """Rows of two kinds, without a shuffle: with a null ``radix`` the documents, ``doc_id, row`` (a number of the input
    row), ``n_a, n_b, n_groups, n_links`` and ``groups`` (A and B ids as ``a1,a2|b1;a3|b2,b3``); with a ``radix`` the chunks of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        seen = runs = held = 0
        pairs: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def chunks() -> Iterator[pa.RecordBatch]:
            for chunk in _run(part + runs, np.concatenate(pairs), np.concatenate(rows)):
                yield pa.RecordBatch.from_pylist([chunk], schema=_ROW)

        for batch in batches:
            for given, texts in slices(batch):
                out = []
                for doc_id, (links, groups, n_a, n_b) in zip(given.column("doc_id").to_pylist(), both.align(texts)):
                    pairs.append(links)
                    rows.append(np.full(len(links), part + seen, dtype=np.int64))
                    held += len(links)
                    out.append({
                        "doc_id": doc_id, "row": part + seen, "n_a": n_a, "n_b": n_b, "n_groups": len(links),
                        "n_links": len(links), "groups": groups,
                    })
                    seen += 1
                yield pa.RecordBatch.from_pylist(out, schema=_ROW)
                if held > run_records:
                    yield from chunks()
                    pairs, rows, held, runs = [], [], 0, runs + 1
        if held:
            yield from chunks()
        release_memory()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _ROW_DDL)


def _by_radix(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of a task, which are sorted by these columns, group by group."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda row: tuple(row[n] for n in names)):
        yield key, list(group)


def _merged(chunks: list[dict]) -> Iterator[tuple[int, int]]:
    """Pairs of some chunks in order, each with its total."""
    streams = [zip(_unpack(c["pairs"]).tolist(), _unpack(c["totals"]).tolist()) for c in chunks]
    for pair, same in groupby(heapq.merge(*streams), key=lambda entry: entry[0]):
        yield pair, sum(n for _, n in same)


def merge_totals(chunks: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One chunk per radix out of the chunks of many runs, by merges of at most about ``fan_in`` at a time."""
    ws, partitions = Workspace(chunks.sparkSession), shuffle_partitions(chunks.sparkSession)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, run), group in _by_radix(batches, ("radix", "run")):
            pairs, totals = np.array(list(_merged(group)), dtype=np.int64).T
            merged = {"radix": radix, "run": run, "pairs": _pack(pairs), "totals": _pack(totals)}
            yield pa.RecordBatch.from_pylist([merged], schema=_CHUNK)

    while True:
        runs = -(-runs // fan_in)
        sets = chunks.select("radix", F.pmod(F.xxhash64("run"), F.lit(runs)).alias("run"), "pairs", "totals")
        sets = sets.repartition(partitions, "radix", "run").sortWithinPartitions("radix", "run")
        chunks, _ = ws.save(sets.mapInArrow(merge, _CHUNK_DDL), "merged")
        if runs <= 1:
            return chunks


def _highest(pairs: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Whether each pair has the highest total of its B id, whose pairs follow each other."""
    at = _starts(pairs >> PAIR_BITS)
    return totals == np.repeat(np.maximum.reduceat(totals, at), np.diff(np.append(at, len(pairs))))


def contributions(chunks: DataFrame, counts: DataFrame, runs: int, return_runs: int = RETURN_RUNS) -> DataFrame:
    """``row, n_best, count_sum`` of every document that has links, summed up over the radices."""
    spark = chunks.sparkSession
    groups = max(-(-runs // return_runs), min(runs, -(-spark.sparkContext.defaultParallelism // RETURNS)), 1)
    group = F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group")
    none = F.lit(None).cast("binary")
    records = chunks.select(group, "radix", F.lit(1).alias("kind"), "pairs", "totals", "documents", "rows", "times")
    copied = counts.select(
        F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("group"), "radix", F.lit(0).alias("kind"), "pairs",
        "totals", none.alias("documents"), none.alias("rows"), none.alias("times"),
    )
    both = records.unionAll(copied).withColumn("part", F.col("radix") % RETURNS)
    both = both.repartition(shuffle_partitions(spark), "group", "part").sortWithinPartitions("group", "part", "radix", "kind")

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, group in groupby(rows, key=lambda row: (row["group"], row["part"])):
            per_row: list[tuple[np.ndarray, ...]] = []
            for row in group:
                pairs = _unpack(row["pairs"])
                if row["kind"] == 0:  # the counts of a radix come before its records
                    known, totals = pairs, _unpack(row["totals"])
                    best = _highest(known, totals)
                    continue
                at = np.repeat(np.searchsorted(known, pairs), _unpack(row["documents"]))
                times = _unpack(row["times"])
                per_row.append(_per_row(_unpack(row["rows"]), times * best[at], times * totals[at]))
                if sum(len(r) for r, _, _ in per_row) > RUN_RECORDS:
                    per_row = [_per_row(*map(np.concatenate, zip(*per_row)))]
            if per_row:
                columns = _per_row(*map(np.concatenate, zip(*per_row)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "n_best", "count_sum"])

    sent = both.mapInArrow(give_back, "row long, n_best long, count_sum long")
    return sent.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _per_row(rows: np.ndarray, best: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = _starts(rows)
    if not len(at):
        return rows, best, total
    return rows[at], np.add.reduceat(best[order], at), np.add.reduceat(total[order], at)


def alignment_counts(
    docs: DataFrame, a_path: str, b_path: str, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    run_records: int = RUN_RECORDS, fan_in: int = FAN_IN, return_runs: int = RETURN_RUNS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every document.

    ``n_best``: links whose pair has the highest corpus-wide count of its B id, ties included; ``count_sum``: the counts of
    all links, added up. ``keep`` may replace ``groups`` by an expression of it before anything is written, such as a digest.
    Both paths must exist on every machine. A null or empty text, and one that either tokenizer does not give back byte by byte, has no
    tokens: zeros and an empty ``groups``. Null ids and repeated rows stay, repeated texts count each time; other columns are not read.
    """
    ws = Workspace(docs.sparkSession)
    groups = F.col("groups") if keep is None else keep
    made = align_documents(docs, a_path, b_path, id_col, text_col, run_records).withColumn("groups", groups)
    written, _ = ws.save(made, "aligned")
    documents = written.where(F.col("radix").isNull())
    documents = documents.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups")
    chunks = written.where(F.col("radix").isNotNull())
    runs = chunks.select("run").distinct().count()
    counts = merge_totals(chunks, runs, fan_in)
    back = contributions(chunks, counts, runs, return_runs)
    return documents.join(back, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups",
    )
