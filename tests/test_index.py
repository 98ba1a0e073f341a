"""Clusters that are laid out once give the same assignments."""

import re

import pytest
from pyspark.sql import functions as F

import loomlog as L
import loomlog.plans.simjoin as J
from tests.test_cluster import texts

SCHEMA = "namespace string, cluster_id bigint, normalized_text string, count bigint"


def sides(spark, by):
    ts = texts(160, 21) + ["中", "国", "a", "é", "q" * 300]
    old = [(None if i % 5 == 0 else "ab"[i % 2], 100 + i, t, (i * 7) % 11) for i, t in enumerate(ts[::2])] + [("a", 999, ts[0], 50)]
    new = [("ab"[i % 2] if i % 3 else None, t, 1, 1, t) for i, t in enumerate(ts)]
    new = spark.createDataFrame(new, "namespace string, normalized_text string, count bigint, occurrences bigint, representative string")
    return spark.createDataFrame(old, SCHEMA).repartition(3), (new if by else new.drop("namespace")).repartition(4)


def rows(df):
    return sorted((r.asDict().get("namespace") or "", r.normalized_text, r.cluster_id, r.similarity) for r in df.collect())


@pytest.mark.parametrize(
    "metric,mode,by,block", [("dice_bigrams", "first", [], 20_000), ("dice_chars", "best", ["namespace"], 20_000), ("dice_bigrams", "best", ["namespace"], 3)]
)
def test_index_equals_clusters(spark, tmp_path, monkeypatch, metric, mode, by, block):
    monkeypatch.setattr(J, "BLOCK_ROWS", block)
    old, new = sides(spark, by)
    options = {"metric": metric, "by": by}
    want = rows(L.assign_templates(new, old, 0.6, mode=mode, **options))
    made = L.save_index(old, f"{tmp_path}/index", 0.6, **options)
    assert rows(L.assign_templates(new, made, 0.6, mode=mode, **options)) == want
    assert (made.keys.hot.count() > 0) == (block == 3)
    assert sum(c is not None for *_, c, _ in want) > 30 and any(c is None for *_, c, _ in want)
    again = L.open_index(spark, f"{tmp_path}/index")
    assert again.last == 999 and rows(L.assign_templates(new, again, 0.6, mode=mode, **options)) == want
    with pytest.raises(ValueError):
        L.assign_templates(new, again, 0.7, mode=mode, **options)


def test_old_side_is_not_shuffled(spark, tmp_path):
    old, new = sides(spark, [])
    index = L.save_index(old, f"{tmp_path}/index", 0.75)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.assign_templates(new, index, 0.75)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 2
    depth = lambda line: len(re.match(r"[ :+\-|]*", line).group())
    for i in scans:  # upwards, the first join comes before any exchange
        at, here = i, depth(lines[i])
        while "Join" not in lines[at]:
            assert "Exchange" not in lines[at]
            here = depth(lines[at])
            at = max(k for k in range(at) if depth(lines[k]) < here)


def test_empty_index(spark, tmp_path):
    old, new = sides(spark, [])
    index = L.save_index(old.limit(0), f"{tmp_path}/index", 0.75)
    got = L.assign_templates(new, index, 0.75)
    assert index.last is None and got.where(F.col("cluster_id").isNotNull()).count() == 0 and got.count() == new.count()
