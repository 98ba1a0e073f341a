import loomlog as L
import loomlog.plans.skew as K
import pytest
from loomlog import sinks
from loomlog.functions import text as T
from loomlog.operators import summary
from loomlog.workspace import Workspace, checkpoint_root
from pyspark.sql import functions as F
from tests import log_generators as G

ROWS = [
    ("disk error on node", "a", "p1", "c"), ("disk error on node", "a", "p1", "c"), ("disk error on node", "a", "p2", "c"),
    ("disk error on node 7", "a", "p1", "c"), ("disk errors on node", "b", "p1", "c"),
    ("payment declined for card", "b", "p3", "d"), ("  ", "b", "p3", "d"), ("123", "b", "p9", "d"),
]
SCHEMA = "line string, namespace string, pod string, container string"


@pytest.fixture(scope="module")
def base(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return L.cluster(df, 0.7), df


def test_counts_members_sources(base):
    result, df = base
    rows = {r.normalized_text: r for r in result.clusters.collect()}
    disk = rows["disk error node"]
    assert (disk["count"], disk.occurrences, disk.n_templates, disk.words) == (3, 5, 2, ["disk", "error", "node"])
    assert disk.representative == "disk error on node"
    got = {(r.cluster_id, r.line, r.occurrences) for r in L.members(result, df).collect()}
    d = disk.cluster_id
    assert {g for g in got if g[0] == d} == {(d, "disk error on node", 3), (d, "disk error on node 7", 1), (d, "disk errors on node", 1)}
    assert {r.line for r in L.members(result, df, 1).where(F.col("cluster_id") == d).collect()} == {"disk error on node"}
    assert {tuple(r)[1:] for r in L.sources(result, df).where(F.col("cluster_id") == d).collect()} == {
        ("a", "p1", "c", 3), ("a", "p2", "c", 1), ("b", "p1", "c", 1)}
    assert tuple(L.cluster_stats(result).head()) == (2, 3, 4, 6)
    assert [r["rank"] for r in L.top_clusters(result, 1).collect()] == [1]
    assert [r.normalized_text for r in L.rare_clusters(result, 1).collect()] == ["payment declined for card"]
    with pytest.raises(ValueError):
        L.members(result, df, -1)


def test_distinct_lines_can_be_reused(base):
    result, df = base
    lines = L.distinct_lines(df)
    again = L.cluster(lines, 0.7)
    cols = ["normalized_text", "count", "occurrences", "representative"]
    assert {tuple(r) for r in again.clusters.select(*cols).collect()} == {tuple(r) for r in result.clusters.select(*cols).collect()}
    want = {tuple(r) for r in L.members(result).collect()}
    assert {tuple(r) for r in L.members(result, lines).collect()} == want == {tuple(r) for r in L.members(result, df).collect()}


def test_distinct_lines_know_how_they_were_made(base):
    """A mismatch raises, and a raw table that happens to have such columns is raw."""
    result, df = base
    lines = L.distinct_lines(df)
    for options in ({"word_filter": False}, {"by": ["namespace"]}):
        with pytest.raises(ValueError):
            L.cluster(lines, 0.7, **options)
        with pytest.raises(ValueError):
            L.members(L.cluster(df, 0.7, **options), lines)
    raw = df.withColumn("normalized_text", F.lit("no")).withColumn("occurrences", F.lit(9))
    assert {r.normalized_text for r in L.cluster(raw, 0.7).clusters.collect()} == {r.normalized_text for r in result.clusters.collect()}
    with pytest.raises(ValueError):
        L.members(L.cluster_templates(L.templates(df), 0.7))


def test_members_read_no_raw_line(base):
    """The distinct lines were written by the clustering."""
    result, df = base
    plan = L.members(result, df)._jdf.queryExecution().executedPlan().toString()
    assert "RDDScan" not in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_workspace_folder(spark, tmp_path, monkeypatch):
    from loomlog import workspace as ws

    assert Workspace(spark).path.startswith(spark.conf.get("spark.checkpoint.dir"))
    # without the setting the warehouse is used
    unset = type("C", (), {"get": staticmethod(lambda k, *d: str(tmp_path) if k == "spark.sql.warehouse.dir" else None)})
    plain = type("S", (), {"conf": unset, "sparkContext": type("X", (), {"getCheckpointDir": lambda s: None, "applicationId": "a"})()})
    monkeypatch.setattr(ws, "_executors_elsewhere", lambda s: False)
    assert checkpoint_root(plain) == str(tmp_path)


def test_a_folder_that_executors_do_not_share_is_refused(spark, tmp_path, monkeypatch):
    from loomlog import workspace as ws

    monkeypatch.setattr(ws, "_checked", set())
    monkeypatch.setattr(ws, "_executors_elsewhere", lambda s: True)
    assert Workspace(spark).path  # it is tried out and works
    monkeypatch.setattr(ws, "_checked", set())
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p: read(self, *p).limit(3))  # part of the files is missing
    with pytest.raises(RuntimeError):
        Workspace(spark)


def test_workspace_is_released(spark):
    w = Workspace(spark)
    a, _ = w.save(spark.range(3), "a")
    b, _ = w.save(spark.range(4), "b")
    w.close(a)
    assert b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(f"{w.path}/0001-a").count()
    w.close()
    with pytest.raises(Exception):
        spark.read.parquet(f"{w.path}/0002-b").count()


NULLS = [("disk error here", None, "p", "c"), ("disk error here", None, "p", "c"), ("disk error there", None, "q", "c"), ("disk error here", "a", "p", "c")]


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame(NULLS, SCHEMA)
    result = L.cluster(df, 0.9, by=["namespace"])
    assert result.clusters.agg(F.sum("count")).head()[0] == 3
    assert sorted((r.namespace or "", r.line, r.occurrences) for r in L.members(result, df).collect()) == [
        ("", "disk error here", 2), ("", "disk error there", 1), ("a", "disk error here", 1)]
    assert sorted((r.namespace or "", r.pod, r.occurrences) for r in L.sources(result, df).collect()) == [("", "p", 2), ("", "q", 1), ("a", "p", 1)]
    again = L.assign_to(df, result.clusters, 0.9, by=["namespace"])
    assert again.matched.count() == 3 and again.formed.membership.count() == 0
    assert {(r["rank"], r.namespace) for r in L.report(result, df).collect()} >= {(1, None)}
    both = L.merge_clusters([L.ClusterSet.of(result, df)] * 2, 0.9)
    assert both.clusters.agg(F.sum("count")).head()[0] == 3 and both.by == ("namespace",)


def test_equal_texts_of_two_groups_rank_by_id(spark):
    df = spark.createDataFrame([("same text", n, "p", "c") for n in ("a", "b", "c")], SCHEMA)
    for _ in range(3):
        top = L.top_clusters(L.cluster(df.repartition(3), 0.9, by=["namespace"]), 2).orderBy("rank").collect()
        assert [r.namespace for r in top] == ["a", "b"]


def test_one_cluster_with_most_sources_is_split(spark, monkeypatch):
    rows = [("disk error on node", "a", f"p{i}", "c") for i in range(90)] + [(f"other message {i}", "a", "p", "c") for i in "abcdefghij"]
    df = spark.createDataFrame(rows, SCHEMA)
    result = L.cluster(df, 0.95)
    want = {tuple(r) for r in L.sources(result, df).collect()}, {tuple(r) for r in L.report(result, df).collect()}
    blocks = []

    def spy(big, unique, on, weight, total, spread_by, **k):
        blocks.append((total, unique.agg(F.max(weight)).head()[0]))
        return K.join_unique(big, unique, on, weight, total, spread_by, rows_per_task=10)

    monkeypatch.setattr(summary, "join_unique", spy)
    assert ({tuple(r) for r in L.sources(result, df).collect()}, {tuple(r) for r in L.report(result, df).collect()}) == want
    # the weights are those of the rows that move: 90 sources, though the cluster has one line
    assert blocks and all(weight == 90 and total == 91 for total, weight in blocks)
    monkeypatch.setattr(K, "BROADCAST_KEYS", 0)
    assert {tuple(r) for r in L.sources(result, df).collect()} == want[0]


def test_hot_template_is_split(base, monkeypatch):
    result, df = base
    want = {tuple(r) for r in L.members(result, df).collect()}
    monkeypatch.setattr(summary, "join_unique", lambda *a, **k: K.join_unique(*a, rows_per_task=1, **k))
    assert {tuple(r) for r in L.members(result, df).collect()} == want


def test_member_limit_is_applied_before_the_shuffle(base):
    result, df = base
    plan = L.members(result, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_report(base, tmp_path):
    result, df = base
    rows = L.report(result, df)
    lines = [r.text for r in rows.orderBy("rank", "section", "item").collect()]
    assert lines[:4] == ["Cluster 1: (Count: 3)", "  Representative: disk error on node",
                         '  Key words: ["disk", "error", "node"]', "  Sources:"]
    assert lines[4:7] == ["    - a/p1/c", "    - a/p2/c", "    - b/p1/c"]
    assert {tuple(r) for r in L.report(result, df, top=5).collect()} == {tuple(r) for r in rows.collect()}
    sinks.write_report(rows, f"{tmp_path}/report")
    assert [r.value for r in result.membership.sparkSession.read.text(f"{tmp_path}/report").collect()] == lines


def _content(s):
    return (
        {tuple(r[c] if c != "words" else tuple(r[c]) for c in ("representative", "normalized_text", "words", "count")) for r in s.clusters.collect()},
        sorted(tuple(r) for r in s.members.collect()),
        sorted(tuple(r) for r in s.sources.collect()),
    )


@pytest.mark.parametrize("by", [(), ("namespace",)])
def test_json_roundtrip(base, tmp_path, by):
    _, df = base
    result = L.cluster(df, 0.7, by=by)
    whole = L.ClusterSet.of(result, df)
    errors = df.sparkSession.createDataFrame([("e", "here", "now")], "error string, location string, timestamp string")
    sinks.write_json(whole, errors, f"{tmp_path}/all")
    back = sinks.read_clusters(df.sparkSession, f"{tmp_path}/all", ", ".join(f"{c} string" for c in by))
    assert _content(back) == _content(whole) and back.by == by
    assert tuple(sinks.read_errors(df.sparkSession, f"{tmp_path}/all").head()) == ("e", "here", "now")
    sinks.write_json(whole, None, f"{tmp_path}/w", member_limit=1)
    back = sinks.read_clusters(df.sparkSession, f"{tmp_path}/w")
    assert back.members.count() == result.clusters.count() and sinks.read_errors(df.sparkSession, f"{tmp_path}/w").count() == 0
    rows = sinks.cluster_rows(whole, 2, 2)
    assert rows.count() == result.clusters.count() and rows.where("size(members) > 2 or size(sources) > 2").count() == 0
    assert sinks.to_json(rows).head().value.startswith('{"')
    with pytest.raises(ValueError):
        sinks.cluster_rows(whole, 0, 1)


def test_merge_unites_members(spark, base):
    result, df = base
    again = L.merge_clusters([L.ClusterSet.of(result, df), L.ClusterSet.of(result, df)], 0.7)
    one, two = _content(L.ClusterSet.of(result, df)), _content(again)
    assert one[0] == two[0] and [m[1] for m in one[1]] == [m[1] for m in two[1]]
    other = spark.createDataFrame([("disk error on node 9", "z", "p", "c"), ("fan speed low", "z", "p", "c")], SCHEMA)
    both = L.merge_clusters([L.ClusterSet.of(result, df), L.ClusterSet.of(L.cluster(other, 0.7), other)], 0.7)
    assert {(r.normalized_text, r["count"]) for r in both.clusters.collect()} == {
        ("disk error node", 4), ("payment declined for card", 1), ("fan speed low", 1)}


def test_analyze_and_windows(spark):
    rows = [("error one alpha", "a", "p", "c", "2024-01-01 00:10:00"), ("error one alpha", "a", "p", "c", "2024-01-01 02:00:00"),
            ("ERROR two beta", "a", "p", "c", "2024-01-01 00:20:00"), ("note", "b", "p", "c", "2024-01-01 00:30:00")]
    df = spark.createDataFrame(rows, SCHEMA + ", ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = spark.createDataFrame([("a", "p", "c"), ("z", "p", "c")], "namespace string, pod string, container string")
    result, lines, errors = L.analyze(
        df, 0.8, namespace="a", contains=["error"], since="2024-01-01T00:15:00Z", expected=expected, errors=None)
    assert lines.count() == 2 and result.clusters.count() == 2
    assert [r.location for r in errors.collect()] == ["pod: p, container: c"]
    with pytest.raises(ValueError):
        L.analyze(df, 0.8, label="app=web")
    got = L.cluster_by_window(df, "1 hour", 0.8).clusters
    assert {(r.window_start.hour, r.normalized_text) for r in got.collect()} == {
        (0, "error one alpha"), (0, "error two beta"), (0, "note"), (2, "error one alpha")}
    untimed = df.withColumn("ts", F.when(F.col("line") != "note", F.col("ts")))
    got = L.cluster_by_window(untimed, "1 hour", 0.8)
    assert [r.line for r in L.members(got).where("window_start is null").collect()] == ["note"]


def test_stream_counts(spark, tmp_path):
    rows = [("error one", "2024-01-01 00:10:00"), ("error 5 one", "2024-01-01 00:20:00"), ("12", "2024-01-01 00:21:00"),
            ("fresh words", "2024-01-01 00:59:00"), ("error one", "2024-01-01 05:00:00")]
    spark.createDataFrame(rows, "line string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([("error one", 7)], "normalized_text string, cluster_id bigint")
    live = spark.readStream.schema("line string, ts timestamp").parquet(f"{tmp_path}/in")
    out = L.template_counts_stream(live, "1 hour", "10 minutes", known)
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(
        f"{tmp_path}/out").awaitTermination()
    got = {(r.normalized_text, r.occurrences, r.cluster_id) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {("error one", 2, 7), ("fresh words", 1, None)}
    # run to the end, the open window comes out too
    got = {(r.window_start.hour, r.normalized_text, r.occurrences, r.cluster_id) for r in L.counts_to_end(out, f"{tmp_path}/end").collect()}
    assert got == {(0, "error one", 2, 7), (0, "fresh words", 1, None), (5, "error one", 1, 7)}


def test_generators(spark):
    assert L.templates(G.low_diversity(spark, 500)).count() == 5
    assert G.high_diversity(spark, 300).distinct().count() == 300
    lens = G.of_length(spark, 200, 100, 300).select(F.min(F.length("line")), F.max(F.length("line"))).head()
    assert lens[0] >= 50 and 250 <= lens[1] <= 300
    df = G.realistic(spark, 2000)
    assert df.where(F.col("line").isNull()).count() == 0
    assert L.cluster(df, 0.75).clusters.agg(F.sum("count")).head()[0] == T.with_template(df).select("line").distinct().count()


def test_tables_are_released(spark, tmp_path):
    """Only the distinct lines and the membership stay after clustering, and nothing after their owner's end."""
    import os

    from loomlog.workspace import checkpoint_root, temporary_tables

    root = checkpoint_root(spark).removeprefix("file:")
    folders = lambda: {f"{w}/{t}" for w in os.listdir(root) if w.startswith("loomlog-") for t in os.listdir(f"{root}/{w}")}
    df = spark.createDataFrame([(f"error {w} of job {i}",) for i in range(20) for w in ("one", "two", "three")], "line string")
    before = folders()
    with temporary_tables():
        result = L.cluster(df, 0.6)
        assert {f.rsplit("-", 1)[1] for f in folders() - before} == {"lines", "membership"}
        assert L.members(result).count() == 60
        with temporary_tables():
            L.similar_pairs(L.templates(df), 0.5).count()
        assert {f.rsplit("-", 1)[1] for f in folders() - before} == {"lines", "membership"}
    assert folders() == before
