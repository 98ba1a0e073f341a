"""Streams against the batch rule."""

import random

from pyspark.sql import functions as F

import loomlog as L
from tests import plain
from tests.test_cluster import texts


def put(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_distinct_counts_over_batches(spark, tmp_path):
    """Repeats within a file, in a later file, near the end of a window, and in another window."""
    rnd, rows = random.Random(1), []
    for hour in range(6):
        for _ in range(120):
            rows.append((f"line {rnd.choice('abc')} {rnd.randrange(12)} of words", f"2024-01-01 0{hour}:{rnd.randrange(60):02d}:00", rnd.choice("xyz")))
        rows += [("hot line", f"2024-01-01 0{hour}:30:00", f"p{i}") for i in range(50)] + [("12 34", f"2024-01-01 0{hour}:00:00", "x")]
    rows.sort(key=lambda r: r[1])
    source = f"{tmp_path}/in"
    for i in range(0, len(rows), 100):
        put(spark, rows[i : i + 100], source, "line string, ts string, pod string")
    live = spark.readStream.schema("line string, ts timestamp, pod string").option("maxFilesPerTrigger", 1).parquet(source)
    counts = L.distinct_counts_stream(live, "2 hours", "10 minutes")
    got = {(r.window_start.hour, r.normalized_text): (r["count"], r.occurrences) for r in L.counts_to_end(counts, f"{tmp_path}/out").collect()}
    want = {}
    for line, ts, _ in rows:
        if plain.normalize(line):
            lines = want.setdefault((int(ts[11:13]) // 2 * 2, plain.normalize(line)), [])
            lines.append(line)
    assert got == {k: (len(set(v)), len(v)) for k, v in want.items()}


def test_state_of_closed_windows_is_dropped(spark, tmp_path):
    source = f"{tmp_path}/in"
    for day in range(1, 7):
        put(spark, [(f"words of line {i}", f"2024-01-0{day} 10:00:00", "p") for i in range(40)], source, "line string, ts string, pod string")
    live = spark.readStream.schema("line string, ts timestamp, pod string").option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        L.distinct_counts_stream(live, "1 hour", "1 minute").writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = query.recentProgress[-1]["stateOperators"]
    assert len(states) == 3 and all(s["numRowsTotal"] <= 80 for s in states)


def test_distinct_counts_read_a_line_once(spark, tmp_path):
    source = f"{tmp_path}/in"
    put(spark, [(f"words of line {i % 9}", "2024-01-01 10:00:00", f"p{i}") for i in range(40)], source, "line string, ts string, pod string")
    live = spark.readStream.schema("line string, ts timestamp, pod string").parquet(source)
    counts = L.distinct_counts_stream(live, "1 hour", "1 minute")
    query = (
        counts.writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("EventTimeWatermark") == 1 and "ReusedExchange" in plan, plan


def test_state_of_counts_is_on_disk(spark, tmp_path):
    """Digests are kept in files, and the session's options stay as they were."""
    source, key = f"{tmp_path}/in", "spark.sql.streaming.stateStore.providerClass"
    put(spark, [(f"words of line {i}", "2024-01-01 10:00:00", "p") for i in range(40)], source, "line string, ts string, pod string")
    live = spark.readStream.schema("line string, ts timestamp, pod string").parquet(source)
    before = spark.conf.get(key, None)
    rows = L.counts_to_end(L.distinct_counts_stream(live, "1 hour", "1 minute"), f"{tmp_path}/out").collect()
    assert [(r["count"], r.occurrences) for r in rows] == [(40, 40)]
    assert list((tmp_path / "out/state/state").rglob("*.zip")) and spark.conf.get(key, None) == before


def placed_plainly(batches, t):
    """Cluster text of each template, batch by batch: known ones stay, new ones go to the earliest cluster or are clustered."""
    score, leaders, known, out = plain.pair_score("dice_bigrams", t), [], {}, []
    for lines in batches:
        per = {}
        for line in set(lines):
            per[plain.normalize(line)] = per.get(plain.normalize(line), 0) + 1
        per.pop("", None)
        ranked = sorted(per, key=lambda x: (-per[x], x))
        rest = []
        for x in ranked:
            if x in known:
                out.append((x, known[x], per[x], True))
                continue
            near = [y for y in leaders if x == y or score(x, y) >= t]
            if near:
                out.append((x, near[0], per[x], True))
                known[x] = near[0]
            else:
                rest.append(x)
        formed = plain.leaders(rest, t, "dice_bigrams", "first")
        for x in rest:
            known[x] = formed[x]
            out.append((x, formed[x], per[x], False))
        leaders += [x for x in rest if formed[x] == x]
    return sorted(out)


def found(store):
    heads = store.table("clusters").select("cluster_id", F.col("normalized_text").alias("head"))
    rows = store.table("placed").join(heads, "cluster_id").collect()
    return sorted((r.normalized_text, r.head, r["count"], r.existing) for r in rows)


def test_placed_batches(spark, tmp_path):
    rnd = random.Random(2)
    every = [f"{x} {i}" for i, x in enumerate(texts(90, 11))] * 2
    rnd.shuffle(every)
    batches = [every[:60], [], every[60:110], every[110:]]
    store = L.ClusterStore(spark, f"{tmp_path}/store", 0.7)
    assert store.last() is None and store.table("clusters").count() == 0
    for n, lines in enumerate(batches):
        store.place(spark.createDataFrame([(x,) for x in lines], "line string"), n)
    want = placed_plainly(batches, 0.7)
    assert found(store) == want and any(e for *_, e in want) and store.last() == 3

    # committed batches stay as they are, whatever comes under their number
    store.place(spark.createDataFrame([("something else entirely",)], "line string"), 2)
    assert found(store) == want
    # a batch that did not come to its end is written again, with the same result
    folder, commit = store._commit_file(3)
    folder.delete(commit, False)
    assert store.last() == 2 and found(store) == placed_plainly(batches[:3], 0.7)
    store.place(spark.createDataFrame([(x,) for x in batches[3]], "line string"), 3)
    assert found(store) == want
    ids = [r.cluster_id for r in store.table("clusters").collect()]
    assert len(ids) == len(set(ids))


def test_placed_groups(spark, tmp_path):
    """Null groups too; the same text is another template in another group."""
    schema = "namespace string, line string"
    store = L.ClusterStore(spark, f"{tmp_path}/store", 0.7, by=["namespace"])
    store.place(spark.createDataFrame([("a", "connection failed after"), (None, "connection failed after"), ("a", "12")], schema), 0)
    store.place(spark.createDataFrame([("a", "connection failed"), (None, "order payment"), ("b", "connection failed after")], schema), 1)
    rows = {(r.batch, r.namespace, r.normalized_text): r.existing for r in store.table("placed").collect()}
    assert rows == {
        (0, "a", "connection failed after"): False, (0, None, "connection failed after"): False,
        (1, "a", "connection failed"): True, (1, None, "order payment"): False, (1, "b", "connection failed after"): False,
    }
