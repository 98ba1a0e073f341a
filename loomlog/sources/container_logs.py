"""Files of container logs: listed and selected first, then read each on its own.

``list_log_files`` gives one row per file and reads no file. Selections on its columns
(``filter_namespace``, ``filter_labels``, a modification time) therefore decide which files are opened
at all; with a ``namespace=/pod=/container=`` layout they prune folders. ``scan_log_files`` then reads
what is left: a file that cannot be read becomes an error row, and the run goes on.

A line of a container log is ``<time> <stream> <flag> <text>``. A record that was too long for one line is
spread over several, all flagged ``P`` but the last, ``F``; they become one record again, also where
lines of the other stream lie between them. Any other line is a record without time and stream.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.plans.skew import hot_list
from loomlog.sources.logs import FILE_PATTERN, SOURCE, _rfc3339, filter_labels, filter_namespace, parse_since
from loomlog.workspace import Workspace

#: Bytes of a plain file that one task reads; compressed files are read whole.
RANGE_BYTES = 128 << 20
#: Bytes of text in one batch of records.
BATCH_BYTES = 4 << 20

# A line of a container log.
RECORD = re.compile(rb"(\d{4}-\d\d-\d\dT\S+) (stdout|stderr) ([FP])(?::\S*)? ?(.*)", re.DOTALL)
COMPRESSED = r"\.gz$"

# What is read of a range: its file and source, and by record the rest.
_UNIT = ["file", *SOURCE, "start"]
_RECORD = [
    ("n", pa.int64()), ("time", pa.string()), ("stream", pa.string()), ("line", pa.string()), ("head", pa.bool_()),
    ("tail", pa.bool_()), ("error", pa.string()),
]
_READ = (
    "file string, namespace string, pod string, container string, start long, n long, time string, stream string, "
    "line string, head boolean, tail boolean, error string"
)


def list_log_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``namespace, pod, container, file, bytes, modified`` of all files below ``root``; none of them is read.

    The source is taken from folders ``namespace=../pod=../container=..``, whose selection prunes the
    listing, or, with ``pattern``, from three groups that match the end of the path (see ``read_log_files``).
    """
    columns = "path string, modificationTime timestamp, length long, content binary"
    source = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if pattern is None:
        files = source.schema(columns + "".join(f", {c} string" for c in SOURCE)).load(root)
        named = [F.col(c) for c in SOURCE]
    else:
        files = source.schema(columns).option("recursiveFileLookup", "true").load(root)
        named = [F.regexp_extract("path", pattern, i + 1).alias(c) for i, c in enumerate(SOURCE)]
    return files.select(*named, F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def modified_since(files: DataFrame, since: str | None, now: datetime | None = None) -> DataFrame:
    """Files written at or after the cutoff (see ``parse_since``); an older file holds no younger line. Reaches the listing."""
    if since is None:
        return files
    at = parse_since(since, _utc(now)).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return files.where(F.col("modified") >= F.lit(at + "+00:00").cast("timestamp"))


def _utc(now: datetime | None) -> datetime:
    now = now or datetime.now(timezone.utc)
    return now if now.tzinfo else now.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class LogScan:
    """What a scan found. ``lines``: ``line, namespace, pod, container, ts, stream``; ``errors``: ``error, location,
    timestamp`` of the files that could not be read; ``files``: the files that were to be read."""

    lines: DataFrame
    errors: DataFrame
    files: DataFrame


def _lines(f, start: int, end: int | None) -> Iterator[bytes]:
    """Lines that begin at ``start`` or later and before ``end``, without their line break."""
    at = start
    if start:
        f.seek(start - 1)
        at += len(f.readline()) - 1
    while end is None or at < end:
        line = f.readline()
        if not line:
            return
        at += len(line)
        yield line.removesuffix(b"\n").removesuffix(b"\r")


class _Records:
    """Puts the lines of one range of a file together. The first record of a stream may go on one of an
    earlier range (``head``), the last may go on in a later one (``tail``)."""

    def __init__(self, start: int):
        self.start, self.n = start, 0
        self.open: dict[str, list] = {}
        self.met: set[str] = set()

    def _row(self, time: str | None, stream: str | None, text: bytes, head: bool, tail: bool) -> tuple:
        self.n += 1
        return self.n, time, stream, text.decode("utf-8", errors="replace"), head, tail, None

    def of(self, lines: Iterator[bytes]) -> Iterator[tuple]:
        for line in lines:
            found = RECORD.fullmatch(line)
            if not found:
                yield self._row(None, None, line, False, False)
                continue
            stream = found[2].decode()
            if stream not in self.open:
                self.open[stream] = [found[1].decode("utf-8", errors="replace"), stream not in self.met and self.start > 0, []]
                self.met.add(stream)
            time, head, parts = self.open[stream]
            parts.append(found[4])
            if found[3] == b"F":
                del self.open[stream]
                yield self._row(time, stream, b"".join(parts), head, False)
        for stream, (time, head, parts) in self.open.items():
            yield self._row(time, stream, b"".join(parts), head, True)


def file_store(path: str):
    """The file system of a listed path, and the path there. Names are taken literally."""
    from pyarrow import fs

    scheme, authority, name = re.fullmatch(r"(?:([a-z0-9]+):(?://([^/]*))?)?(/.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), name
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return store, base.rstrip("/") + name


def _batch(unit: dict, rows: list[tuple]) -> pa.RecordBatch:
    same = [pa.array([unit[c]] * len(rows), pa.int64() if c == "start" else pa.string()) for c in _UNIT]
    own = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RECORD)]
    return pa.RecordBatch.from_arrays(same + own, [*_UNIT, *(n for n, _ in _RECORD)])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range in the listing; a failure ends the range with an error row."""
    for batch in batches:
        for unit in batch.to_pylist():
            start, end = unit["start"], unit["end"]
            held, size = [], 0
            try:
                store, name = file_store(unit["file"])
                with store.open_input_file(name) as raw:
                    f = gzip.GzipFile(fileobj=raw) if end is None else io.BufferedReader(raw)
                    for row in _Records(start).of(_lines(f, start, end)):
                        held.append(row)
                        size += len(row[3]) + 100
                        if size > BATCH_BYTES:
                            yield _batch(unit, held)
                            held, size = [], 0
            except Exception as e:  # whatever a file or a store may raise becomes a row
                held.append((0, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if held:
                yield _batch(unit, held)


def _ranges(files: DataFrame) -> DataFrame:
    """Units of reading: a file, its source, ``start`` and ``end``; a null ``end`` marks a compressed file."""
    packed = F.lower("file").rlike(COMPRESSED)
    step = F.lit(RANGE_BYTES).cast("bigint")
    last = F.greatest(F.col("bytes") - 1, F.lit(0).cast("bigint"))
    starts = F.when(packed, F.expr("array(0L)")).otherwise(F.sequence(F.lit(0).cast("bigint"), last, step))
    units = files.select("file", *SOURCE, "bytes", packed.alias("packed"), F.explode(starts).alias("start"))
    end = F.when(~F.col("packed"), F.least(F.col("start") + step, F.col("bytes")))
    return units.select(*_UNIT, end.alias("end"))


def _stitched(edges: DataFrame) -> DataFrame:
    """Records cut by the border of two ranges, whole again. A range has at most two rows a stream here."""
    order = Window.partitionBy("file", "stream").orderBy("start", "n")
    begins = F.coalesce(~(F.lag("tail").over(order) & F.col("head")), F.lit(True))
    numbered = edges.withColumn("_record", F.sum(begins.cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "n", "time", "line")))
    whole = numbered.groupBy("file", *SOURCE, "stream", "_record").agg(parts.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["line"]), "")
    return whole.select("file", *SOURCE, F.col("_parts")[0]["time"].alias("time"), "stream", text.alias("line"))


def scan_log_files(files: DataFrame, since: str | None = None, now: datetime | None = None) -> LogScan:
    """Read the listed files (see :func:`list_log_files`).

    Plain files are read in ranges, gzip files (``.gz``) whole, each in a guarded step of its own. A file with
    a range that fails gives no lines and one error row, like a container whose log cannot be fetched. The records are written once, to
    the checkpoint folder, so that what was found does not change between uses. With ``since`` older files are not opened and older lines
    left out; lines without a time stay. Null and empty inputs: an empty file has no lines, an empty listing gives empty results.
    """
    spark = files.sparkSession
    ws = Workspace(spark)
    wanted, seen = ws.save(modified_since(files, since, now), "files", ranges=F.sum(F.ceil(F.col("bytes") / RANGE_BYTES) + 1))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = _ranges(wanted).repartition(max(1, min(int(seen["ranges"] or 1), 8 * partitions)), "file", "start")
    read, found = ws.save(units.mapInArrow(_read, _READ), "records", failed=F.count_if(F.col("error").isNotNull()))

    records = read.where(F.col("error").isNull())
    edge = F.coalesce(F.col("head") | F.col("tail"), F.lit(False))
    whole = records.where(~edge).select("file", *SOURCE, "time", "stream", "line").unionAll(_stitched(records.where(edge)))
    failed = read.where(F.col("error").isNotNull()).groupBy("file", *SOURCE).agg(F.min("error").alias("error"))
    if found["failed"]:
        # 128 bits stand for a path, so a row of the list is small
        digest = F.unhex(F.md5(F.col("file").cast("binary"))).alias("_file")
        whole = whole.withColumn("_file", digest).join(hot_list(failed.select(digest)), "_file", "left_anti")
    lines = whole.select("line", *SOURCE, F.try_to_timestamp("time").alias("ts"), "stream")
    if since is not None:
        at = parse_since(since, _utc(now)).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        lines = lines.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(at + "+00:00").cast("timestamp")))
    errors = failed.select(
        F.concat(F.lit("cannot read "), "file", F.lit(": "), "error").alias("error"),
        F.concat(F.lit("pod: "), "pod", F.lit(", container: "), "container").alias("location"),
        F.lit(_rfc3339(now)).alias("timestamp"),
    )
    return LogScan(lines, errors, wanted)


def read_container_logs(
    spark: SparkSession,
    root: str,
    *,
    namespace: str | None = None,
    label: str | None = None,
    pods: DataFrame | None = None,
    since: str | None = None,
    now: datetime | None = None,
    pattern: str | None = None,
) -> LogScan:
    """Container logs below ``root`` of a namespace, of pods with a label and since a time; only their files are opened."""
    files = filter_namespace(list_log_files(spark, root, pattern), namespace)
    if label is not None:
        if pods is None:
            raise ValueError("a label selection needs the pods relation")
        files = filter_labels(files, filter_namespace(pods, namespace), label)
    return scan_log_files(files, since, now)


__all__ = ["FILE_PATTERN", "LogScan", "list_log_files", "modified_since", "read_container_logs", "scan_log_files"]
