from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import loomlog as L
from loomlog.sources import logs as S

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def test_read_log_files(spark, tmp_path):
    for ns, pod, name, data in [("prod", "web-1", "app", b"one\r\ntwo\n\nthree"), ("prod", "web+2 x", "db", b"four\n")]:
        d = tmp_path / ns / pod
        d.mkdir(parents=True)
        (d / f"{name}.log").write_bytes(data)
    got = {tuple(r) for r in S.read_log_files(spark, f"{tmp_path}/*/*/*.log").collect()}
    assert got == {("one", "prod", "web-1", "app"), ("two", "prod", "web-1", "app"), ("", "prod", "web-1", "app"),
                   ("three", "prod", "web-1", "app"), ("four", "prod", "web+2 x", "db")}


def test_split_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, "x\n\n"), (4, "\n")], "id int, text string")
    got = sorted((r.id, r.line) for r in S.split_lines(df, "text").collect())
    want = sorted((i, x) for i, t in [(1, "a\nb\n\nc\n"), (2, ""), (3, "x\n\n"), (4, "\n")] for x in t.splitlines())
    assert got == want


def test_since():
    assert S.parse_since("1h", NOW) == NOW - timedelta(hours=1)
    assert S.parse_since("2d 12h", NOW) == NOW - timedelta(hours=60)
    assert S.parse_since("1w30m", NOW) == NOW - timedelta(days=7, minutes=30)
    assert S.parse_since("2024-01-01T10:00:00Z", NOW) == datetime(2024, 1, 1, 10, tzinfo=timezone.utc)
    for bad in ("", "yesterday", "1 fortnight", "2024-01-01T10:00:00", "h1", "5"):
        with pytest.raises(ValueError):
            S.parse_since(bad, NOW)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_filter_since_reaches_the_scan(spark, tmp_path, kind):
    path = f"{tmp_path}/{kind}"
    spark.range(48).select(
        (F.lit("2024-04-30 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).cast(kind).alias("ts")
    ).write.parquet(path)
    kept = S.filter_since(spark.read.parquet(path), "1h", NOW)
    assert kept.count() == 48 - 35
    assert "GreaterThanOrEqual(ts" in kept._jdf.queryExecution().executedPlan().toString()


def test_labels(spark, monkeypatch):
    logs = spark.createDataFrame([("a", "p1", "x"), ("a", "p2", "y"), ("b", "p1", "z")], "namespace string, pod string, line string")
    pods = spark.createDataFrame(
        [("a", "p1", {"app": "web", "tier": "be"}), ("a", "p2", {"app": "web"}), ("b", "p1", {"app": "db", "tier": "be"})],
        "namespace string, pod string, labels map<string,string>")
    for limit in (S.BROADCAST_PODS, 0):
        monkeypatch.setattr(S, "BROADCAST_PODS", limit)
        assert [r.line for r in S.filter_labels(logs, pods, "app=web,tier=be").collect()] == ["x"]
        assert sorted(r.line for r in S.filter_labels(logs, pods, "app=web").collect()) == ["x", "y"]
    for selector, want in {
        "app": "xyz", "!tier": "y", "tier": "xz", "app!=web": "z", "tier != be": "y", "app in (web, db), tier": "xz",
        "app notin (web)": "z", "tier notin (be)": "y", "app == web , tier=be": "x", "app=web,app=db": "", "zone!=a": "xyz",
    }.items():
        assert sorted(r.line for r in S.filter_labels(logs, pods, selector).collect()) == list(want), selector
    for bad in ("", "=x", "app=a,", "app in ()", "app in a", "!", "app=a b", "app=(a)", "in (a)", "a,,b"):
        with pytest.raises(ValueError):
            S.filter_labels(logs, pods, bad)


def test_ingest_errors(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"line":"ok one","namespace":"a","pod":"p","container":"c"}\nnot json\n')
    good, bad = S.read_json_logs(spark, f"{tmp_path}/in.json", "line string, namespace string, pod string, container string", NOW)
    assert [r.line for r in good.collect()] == ["ok one"]
    (err,) = bad.collect()
    assert "not json" in err.error and err.location.endswith("in.json") and err.timestamp == NOW.isoformat()
    expected = spark.createDataFrame([("a", "p", "c"), ("a", "q", "c")], "namespace string, pod string, container string")
    (miss,) = S.ingest_errors(expected, good, NOW).collect()
    assert miss.location == "pod: q, container: c"


def test_filters(spark):
    df = spark.createDataFrame([("An ERROR",), ("warning",), ("fine",), ("",)], "line string")
    assert L.filter_contains_any(df, []).count() == 4
    assert L.filter_contains_any(df, ["error", "WARN"]).count() == 2
    assert L.filter_contains_any(df, [""]).count() == 4
    plan = L.filter_contains_any(df.select(F.concat("line", F.lit("!")).alias("line")), ["a", "b", "c"])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert tuple(L.filter_stats(df, ["e"]).head()) == (4, 2, 50.0)
    assert tuple(L.filter_stats(df.limit(0), ["e"]).head()) == (0, 0, 0.0)
    assert tuple(L.input_stats(df).head()) == (4, 8 + 7 + 4)
    assert tuple(L.input_stats(df.limit(0)).head()) == (0, 0)


def test_paths_follow_the_default_file_system(spark):
    from loomlog.workspace import qualified

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert qualified(spark, "/x/a b") == "file:/x/a b"
    conf.set("fs.defaultFS", "hdfs://localhost:1/")
    try:
        assert qualified(spark, "/x/y") == "hdfs://localhost:1/x/y" and qualified(spark, "file:///x") == "file:/x"
    finally:
        conf.set("fs.defaultFS", before)
