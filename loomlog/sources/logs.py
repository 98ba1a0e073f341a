"""Log lines from files and tables, and the selections made on them.

A log relation has ``line`` and the source columns ``namespace, pod, container``;
``ts`` is optional and needed only by time selections.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.workspace import Workspace

SOURCE = ["namespace", "pod", "container"]

# <root>/<namespace>/<pod>/<container>.log
FILE_PATTERN = r"([^/]+)/([^/]+)/([^/]+?)(?:\.log)?$"

# A selected pod list up to this long is broadcast; a longer one is joined by key.
BROADCAST_PODS = 500_000
ERROR_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType(), True) for n in ("error", "location", "timestamp")]
)

# Seconds per duration unit.
UNIT_SECONDS = {
    1e-9: ("nsec", "ns", "nanos"),
    1e-6: ("usec", "us", "micros"),
    1e-3: ("msec", "ms", "millis"),
    1.0: ("seconds", "second", "secs", "sec", "s"),
    60.0: ("minutes", "minute", "mins", "min", "m"),
    3600.0: ("hours", "hour", "hrs", "hr", "h"),
    86400.0: ("days", "day", "d"),
    604800.0: ("weeks", "week", "w"),
    2630016.0: ("months", "month", "M"),
    31557600.0: ("years", "year", "y"),
}
_SECONDS = {name: seconds for seconds, names in UNIT_SECONDS.items() for name in names}


def read_log_files(spark: SparkSession, path: str, pattern: str | None = None, namespace: str | None = None) -> DataFrame:
    """Whole container logs as lines. Lines end in ``\\n`` or ``\\r\\n``.

    The source is taken from folders ``namespace=../pod=../container=..`` if ``path`` holds such, else from the file
    path by three groups of ``pattern`` (:data:`FILE_PATTERN` if null: one file per container). With
    ``namespace`` only files of that namespace are read: folders are pruned in the listing, and
    with a ``pattern`` files are left out by their path. For logs with times, or with files that may be unreadable, see ``container_logs``.
    """
    line = F.regexp_replace("value", r"\r\z", "").alias("line")
    if pattern is None and _has_folders(spark, path):
        schema = "value string" + "".join(f", {c} string" for c in SOURCE)
        raw = filter_namespace(spark.read.schema(schema).text(path, lineSep="\n"), namespace)
        return raw.select(line, *SOURCE)
    location = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = [F.regexp_extract(location, pattern or FILE_PATTERN, i + 1) for i in range(len(SOURCE))]
    raw = spark.read.text(path, lineSep="\n")
    if namespace is not None:
        raw = raw.where(named[0] == namespace)
    return raw.select(line, *[c.alias(n) for n, c in zip(SOURCE, named)])


def _has_folders(spark: SparkSession, path: str) -> bool:
    """Whether the listing of ``path`` finds all source columns in the names of folders; no file is read."""
    return set(SOURCE) <= set(spark.read.format("binaryFile").load(path).columns)


def _as_column(value: Column | str | None) -> Column:
    if value is None:
        return F.lit("")
    return F.col(value) if isinstance(value, str) else value


def from_table(
    df: DataFrame,
    line: Column | str,
    namespace: Column | str | None = None,
    pod: Column | str | None = None,
    container: Column | str | None = None,
    ts: Column | str | None = None,
) -> DataFrame:
    """Give any relation the log schema; a missing source column becomes ''."""
    parts = [_as_column(line).alias("line")]
    parts += [_as_column(c).cast("string").alias(n) for n, c in zip(SOURCE, (namespace, pod, container))]
    if ts is not None:
        parts.append(_as_column(ts).alias("ts"))
    return df.select(*parts)


def attach_source(df: DataFrame, namespace: str, pod: str, container: str) -> DataFrame:
    """Mark every line with one source."""
    return df.withColumns({n: F.lit(v) for n, v in zip(SOURCE, (namespace, pod, container))})


def split_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line of ``text``; a final line break ends the last line."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    rest = [c for c in df.columns if c != text]
    return df.where(F.col(text) != "").select(*rest, F.explode(F.split(body, r"\r?\n")).alias("line"))


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All lines of all inputs; a column absent somewhere is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def filter_namespace(df: DataFrame, namespace: str | None = None) -> DataFrame:
    """Lines of one namespace, or all. Prunes partitions of a namespace= layout."""
    return df if namespace is None else df.where(F.col("namespace") == namespace)


LABEL_TERM = re.compile(
    r"""\s*(?:(?P<absent>!)\s*(?P<no>[\w./-]+)
    |(?P<key>[\w./-]+)\s*(?:(?P<op>==|=|!=)\s*(?P<value>[\w.-]*)
    |\s(?P<set>in|notin)\s*\((?P<values>[^()]*)\))?)\s*(?:,|$)""",
    re.VERBOSE,
)


def label_condition(selector: str, labels: Column | str = "labels") -> Column:
    """A label selector as a condition on a map column.

    Terms joined by commas: ``k=v``, ``k==v``, ``k!=v``, ``k in (a,b)``, ``k notin (a,b)``,
    ``k``, ``!k``. The two negative comparisons hold for pods without the label too.
    """
    labels = F.col(labels) if isinstance(labels, str) else labels
    out, at = F.lit(True), 0
    if not selector.strip() or selector.strip().endswith(","):
        raise ValueError(f"not a label selector: {selector!r}")
    while at < len(selector):
        m = LABEL_TERM.match(selector, at)
        if not m or m.end() == at:
            raise ValueError(f"not a label term: {selector[at:]!r}")
        at = m.end()
        if m["absent"]:
            out = out & F.coalesce(~F.map_contains_key(labels, m["no"]), F.lit(True))
            continue
        value = labels[m["key"]]
        if m["set"]:
            wanted = [v.strip() for v in m["values"].split(",")]
            if "" in wanted:
                raise ValueError(f"an empty value in {selector!r}")
            hit = F.coalesce(value.isin(wanted), F.lit(False))
            out = out & (hit if m["set"] == "in" else ~hit)
        elif m["op"] is None:
            out = out & F.coalesce(F.map_contains_key(labels, m["key"]), F.lit(False))
        else:
            hit = F.coalesce(value == m["value"], F.lit(False))
            out = out & (~hit if m["op"] == "!=" else hit)
    return out


def filter_labels(df: DataFrame, pods: DataFrame, selector: str) -> DataFrame:
    """Lines of pods whose ``labels`` map fulfils the selector (see :func:`label_condition`).

    The chosen pods are written and counted. A short list is broadcast; a long one
    is semi-joined on the pod, where adaptive execution splits a very chatty one.
    """
    chosen = pods.where(label_condition(selector)).select("namespace", "pod").distinct()
    chosen, seen = Workspace(df.sparkSession).save(chosen, "pods")
    chosen = F.broadcast(chosen) if seen["rows"] <= BROADCAST_PODS else chosen.hint("merge")
    return df.join(chosen, ["namespace", "pod"], "left_semi")


def parse_since(text: str, now: datetime) -> datetime:
    """The cutoff named by ``1h``, ``2d 12h``, ... before ``now``, or an RFC 3339
    time. Anything else raises ``ValueError``."""
    text = text.strip()
    parts = re.findall(r"(\d+)\s*([a-zA-Z]+)", text)
    if parts and re.fullmatch(r"(\d+\s*[a-zA-Z]+\s*)+", text):
        unknown = [unit for _, unit in parts if unit not in _SECONDS]
        if unknown:
            raise ValueError(f"unknown duration unit {unknown[0]!r} in {text!r}")
        return now - timedelta(seconds=sum(int(n) * _SECONDS[unit] for n, unit in parts))
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        at = None
    if at is None or at.tzinfo is None:
        raise ValueError(f"neither a duration like '1h' nor an RFC 3339 time: {text!r}")
    return at


def filter_since(df: DataFrame, since: str | None, now: datetime | None = None) -> DataFrame:
    """Lines at or after the cutoff; the bound reaches the scan.

    ``now`` defaults to the current time and may be fixed to repeat a run. A
    ``TIMESTAMP_NTZ`` column is taken as UTC.
    """
    if since is None:
        return df
    now = now or datetime.now(timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    at = parse_since(since, now).astimezone(timezone.utc)
    stamp = at.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(df.schema["ts"].dataType, T.TimestampNTZType):
        cutoff = F.lit(stamp).cast("timestamp_ntz")
    else:
        cutoff = F.lit(stamp + "+00:00").cast("timestamp")
    return df.where(F.col("ts") >= cutoff)


def read_json_logs(
    spark: SparkSession, path: str, schema: str | T.StructType, now: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Structured logs and the records that failed to parse.

    A bad record becomes an error row and the run continues.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # the generator keeps the parser from running once for the test and once more
    # for the fields
    parsed = F.explode(F.array(F.from_json("value", full, options))).alias("r")
    raw = (
        spark.read.text(path)
        .where(F.length(F.trim("value")) > 0)
        .select(parsed, F.col("_metadata.file_path").alias("file"))
    )
    bad = F.col("r._corrupt_record")
    errors = raw.where(bad.isNotNull()).select(
        F.concat(F.lit("malformed record: "), bad).alias("error"),
        F.concat(F.lit("file: "), "file").alias("location"),
        F.lit(_rfc3339(now)).alias("timestamp"),
    )
    return raw.where(bad.isNull()).select(*[F.col(f"r.{n}") for n in fields.names]), errors


def ingest_errors(expected: DataFrame, df: DataFrame, now: datetime | None = None) -> DataFrame:
    """Error rows for expected sources that delivered no line.

    The lines are reduced to their distinct sources before the join.
    """
    seen = df.select(*SOURCE).distinct()
    return expected.select(*SOURCE).distinct().join(seen, SOURCE, "left_anti").select(
        F.lit("no log lines").alias("error"),
        F.concat(F.lit("pod: "), "pod", F.lit(", container: "), "container").alias("location"),
        F.lit(_rfc3339(now)).alias("timestamp"),
    )


def _rfc3339(now: datetime | None) -> str:
    return (now or datetime.now(timezone.utc)).isoformat()
