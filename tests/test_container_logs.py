import gzip
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import loomlog as L
from loomlog.sources import container_logs as C
from loomlog.sources import logs as S

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
NOW = T0 + timedelta(hours=12)


def stamp(minutes):
    return (T0 + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.%f") + "789Z"


def records(seed, n):
    """Lines of two interleaved streams, some in parts, and the records they make, by stream."""
    rnd, lines, whole, open_ = random.Random(seed), [], [], {}
    for i in range(n):
        stream = rnd.choice(["stdout", "stdout", "stderr"])
        text = rnd.choice(["", "x", "größe 日志", "a  b", "P F"]) + "y" * rnd.randrange(30)
        last = rnd.random() < 0.6
        lines.append(f"{stamp(i)} {stream} {'F' if last else 'P'} {text}")
        time, so_far = open_.pop(stream, (stamp(i), ""))
        if last:
            whole.append((stream, time, so_far + text))
        else:
            open_[stream] = (time, so_far + text)
    return lines, whole + [(s, t, x) for s, (t, x) in open_.items()]


def put(root, namespace, pod, container, name, data):
    folder = root / f"namespace={namespace}" / f"pod={pod}" / f"container={container}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)
    return folder / name


def found(scan):
    rows = scan.lines.select("stream", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), "line").collect()
    return sorted((r.stream, r.t, r.line) for r in rows)


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
def test_records_are_whole_however_files_are_cut(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(C, "RANGE_BYTES", size)
    lines, want = records(3, 120)
    put(tmp_path, "007", "web+1 x", "app", "0.log", ("\n".join(lines) + "\n").encode())
    scan = C.read_container_logs(spark, str(tmp_path))
    assert found(scan) == sorted((s, t[:26], x) for s, t, x in want)
    assert scan.errors.count() == 0
    assert {tuple(r) for r in scan.lines.select(*S.SOURCE).distinct().collect()} == {("007", "web+1 x", "app")}


def test_files_that_cannot_be_read(spark, tmp_path):
    """A cut file, one that is no gzip file and one that is gone give an error each; the others are read."""
    lines, want = records(4, 300)
    text = ("\r\n".join(lines)).encode()
    put(tmp_path, "a", "good", "c", "0.log.gz", gzip.compress(text))
    cut = gzip.compress(text)
    put(tmp_path, "a", "cut", "c", "0.log.gz", cut[: len(cut) // 2])
    put(tmp_path, "b", "other", "c", "0.log.gz", b"not compressed")
    gone = put(tmp_path, "b", "gone", "d", "0.log", b"soon gone\n")
    put(tmp_path, "b", "empty", "d", "0.log", b"")
    put(tmp_path, "b", "plain", "d", "0.log", b"no time here\nnor here\xff")
    files = C.list_log_files(spark, str(tmp_path))
    files = spark.createDataFrame(files.collect(), files.schema)
    gone.unlink()
    scan = C.scan_log_files(files, now=NOW)
    assert found(scan.__class__(scan.lines.where("stream is not null"), None, None)) == sorted((s, t[:26], x) for s, t, x in want)
    assert sorted(r.line for r in scan.lines.where("stream is null").collect()) == ["no time here", "nor here�"]
    errors = {r.location: r for r in scan.errors.collect()}
    assert set(errors) == {"pod: cut, container: c", "pod: other, container: c", "pod: gone, container: d"}
    assert "EOFError" in errors["pod: cut, container: c"].error and errors["pod: cut, container: c"].timestamp == NOW.isoformat()
    result, _, told = L.analyze(scan.lines, 0.75, errors=scan.errors)
    assert told.count() == 3 and result.clusters.count() > 0


def test_selections_decide_which_files_are_opened(spark, tmp_path):
    import os

    old = put(tmp_path, "a", "p", "c", "0.log.1", f"{stamp(0)} stdout F old\n".encode())
    os.utime(old, (T0.timestamp(), T0.timestamp()))
    new = put(tmp_path, "a", "p", "c", "0.log", f"{stamp(0)} stdout F early\n{stamp(700)} stdout F late\nno time\n".encode())
    other = put(tmp_path, "b", "q", "c", "0.log", f"{stamp(700)} stdout F other\n".encode())
    for f in (new, other):
        os.utime(f, (NOW.timestamp(), NOW.timestamp()))
    scan = C.read_container_logs(spark, str(tmp_path), namespace="a", since="1h", now=NOW)
    assert sorted(r.line for r in scan.lines.collect()) == ["late", "no time"]
    assert [r.file.rsplit("/", 1)[1] for r in scan.files.collect()] == ["0.log"]
    listed = C.modified_since(S.filter_namespace(C.list_log_files(spark, str(tmp_path)), "a"), "1h", NOW)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan and "GreaterThanOrEqual(modificationTime" in plan
    pods = spark.createDataFrame([("b", "q", {"app": "db"})], "namespace string, pod string, labels map<string,string>")
    scan = C.read_container_logs(spark, str(tmp_path), label="app=db", pods=pods)
    assert [r.line for r in scan.lines.collect()] == ["other"] and scan.files.count() == 1
    assert C.read_container_logs(spark, str(tmp_path), namespace="none").lines.count() == 0
    with pytest.raises(ValueError):
        C.read_container_logs(spark, str(tmp_path), label="app=db")


def test_sources_from_names(spark, tmp_path):
    (tmp_path / "prod" / "web 1%2F").mkdir(parents=True)
    (tmp_path / "prod" / "web 1%2F" / "app.log").write_bytes(b"2024-05-01T10:00:00+02:00 stderr F it fell\n")
    scan = C.read_container_logs(spark, str(tmp_path), pattern=C.FILE_PATTERN)
    assert [tuple(r) for r in scan.lines.select("line", *S.SOURCE, "stream").collect()] == [("it fell", "prod", "web 1%2F", "app", "stderr")]
    assert scan.lines.select(F.col("ts").cast("long")).head()[0] == int(T0.timestamp()) + 8 * 3600


def test_namespace_prunes_the_line_scan(spark, tmp_path):
    for ns in ("a", "b"):
        put(tmp_path, ns, "p", "c", "0.log", f"of {ns}\n".encode())
    lines = S.read_log_files(spark, str(tmp_path), namespace="b")
    assert [tuple(r) for r in lines.collect()] == [("of b", "b", "p", "c")]
    assert "PartitionFilters: [isnotnull(namespace" in lines._jdf.queryExecution().executedPlan().toString()
