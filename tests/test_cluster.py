import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import loomlog.plans.leaders as L
import loomlog.plans.simjoin as J
import loomlog.plans.tokens as T
from loomlog import cluster, cluster_templates, similar_pairs, templates
from loomlog.operators.assign import assign_to, assign_templates
from tests import plain

WORDS = ["error", "warn", "failed", "connection", "timeout", "database", "server", "after", "user",
         "payment", "order", "cache", "region", "retry", "queue", "größe", "straße", "日志", "中"]


def texts(n, seed, vocabulary=WORDS):
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 7))]
        for _ in range(rnd.randint(1, 4)):
            w = list(base)
            if rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                w[0] = w[0] + rnd.choice("abxyz")
            out.add(" ".join(w))
    return sorted(out)


def table(spark, ts, seed=0):
    rnd = random.Random(seed)
    rows = [(t, rnd.randint(1, 50), 1, t) for t in ts]
    rnd.shuffle(rows)
    return spark.createDataFrame(
        rows, "normalized_text string, count bigint, occurrences bigint, representative string"
    ).repartition(5)


def ranked(df):
    return [r.normalized_text for r in sorted(df.collect(), key=lambda r: (-r["count"], r.normalized_text))]


@pytest.mark.parametrize("metric", ["dice_bigrams", "dice_chars"])
@pytest.mark.parametrize("t", [0.3, 0.75, 1.0])
def test_pairs_equal_brute_force(spark, t, metric):
    ts = texts(150, 1) + ["中", "国", "a", "é", "q" * 300]
    ts = sorted(set(ts))
    df = spark.createDataFrame([(x,) for x in ts], "normalized_text string")
    score = plain.pair_score(metric, t)
    want = {(a, b): score(a, b) for i, a in enumerate(ts) for b in ts[i + 1 :] if score(a, b) >= t}
    got = similar_pairs(df, t, metric=metric).collect()
    assert len(got) == len(want)
    assert {(r.left_text, r.right_text): r.similarity for r in got} == want


def test_split_keys_lose_nothing(spark, monkeypatch):
    """Hot keys cut into tiny blocks, and the merge join, give the same pairs."""
    ts = texts(200, 2)
    df = spark.createDataFrame([(x,) for x in ts], "normalized_text string")
    want = {tuple(r) for r in similar_pairs(df, 0.6).collect()}
    monkeypatch.setattr(J, "SMALL_PRODUCT", 0)
    monkeypatch.setattr(J, "BLOCK_ROWS", 3)
    assert {tuple(r) for r in similar_pairs(df, 0.6).collect()} == want
    monkeypatch.setattr(J, "HASH_BYTES", 0)
    assert {tuple(r) for r in similar_pairs(df, 0.6).collect()} == want


@pytest.mark.parametrize("metric", ["dice_bigrams", "dice_chars"])
def test_each_pair_is_emitted_once(spark, metric):
    """Neither a self join nor a join of two tables emits a pair twice, although the pairs share many keys."""
    from loomlog.plans import leaders, simjoin
    from loomlog.plans.tokens import with_join_keys
    from loomlog.workspace import Workspace

    ts = sorted(set(texts(150, 8)))
    df = spark.createDataFrame(list(enumerate(ts)), "id long, t string")
    tokens = leaders.tokenized(df, len(ts), "t", metric, [])
    table = leaders.save_comparable(Workspace(spark), with_join_keys(tokens, 0.5, list(range(729))), "x")
    one = [(r.left_id, r.right_id) for r in simjoin.similar_rows(table, table, 0.5, metric, self_join=True).collect()]
    two = [(r.left_id, r.right_id) for r in simjoin.similar_rows(table, table, 0.5, metric).collect()]
    assert len(one) == len(set(one)) > 50
    assert len(two) == len(set(two)) and {p for p in two if p[0] < p[1]} == set(one)


@pytest.mark.parametrize(
    "mode,metric,batch,budget",
    [
        ("first", "dice_bigrams", 10_000, 10**9),
        ("best", "dice_chars", 10_000, 10**9),
        ("first", "dice_chars", 32, 500),
        ("best", "dice_bigrams", 32, 500),
        ("first", "dice_bigrams", 32, 1),
    ],
)
def test_cluster_equals_sequential_rule(spark, monkeypatch, mode, metric, batch, budget):
    monkeypatch.setattr(L, "FIRST_BATCH", batch)
    monkeypatch.setattr(L, "PAIRS_PER_CORE", budget)
    df = table(spark, texts(120, 3))
    got = cluster_templates(df, 0.7, mode=mode, metric=metric).membership
    text = {r.template_id: r.normalized_text for r in got.collect()}
    assert {r.normalized_text: text[r.cluster_id] for r in got.collect()} == plain.leaders(
        ranked(df), 0.7, metric, mode
    )


def test_best_leader_of_a_taken_templates_own_batch(spark, monkeypatch):
    """A template that an earlier batch has taken goes to a closer leader of the batch that it is in itself."""
    monkeypatch.setattr(L, "FIRST_BATCH", 2)
    monkeypatch.setattr(L, "PAIRS_PER_CORE", 0)
    ts = ["abcdefghijkl", "queue weight", "ghijklmnopqr", "efghijklmnop", "user timing", "cache bypass"]
    df = spark.createDataFrame([(t, 9 - i, 1, t) for i, t in enumerate(ts)], table(spark, ts).schema)
    got = cluster_templates(df, 0.6, mode="best").membership.collect()
    assert {r.normalized_text: ts[r.cluster_id] for r in got} == plain.leaders(ts, 0.6, mode="best")
    assert [(r.cluster_id, round(r.similarity, 6)) for r in got if r.normalized_text == ts[3]] == [(2, round(18 / 22, 6))]


def test_order_and_partitions_do_not_matter(spark):
    lines = [f"{t} {i}" for i, t in enumerate(texts(60, 4))] * 2
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    one = {tuple(r) for r in cluster(df, 0.7).clusters.drop("words").collect()}
    two = {tuple(r) for r in cluster(df.repartition(7).orderBy(F.desc("line")), 0.7).clusters.drop("words").collect()}
    assert one == two
    assert sum(r[3] for r in one) == len({x for x in lines if plain.normalize(x)})


def test_groups_are_independent(spark):
    ts = texts(80, 5)
    rows = [(g, f"{t} {i}") for i, t in enumerate(ts) for g in ("a", "b") if (i + len(g)) % 3 or g == "b"]
    df = spark.createDataFrame(rows, "namespace string, line string")
    both = cluster(df, 0.7, by=["namespace"]).clusters
    for g in ("a", "b"):
        alone = cluster(df.where(F.col("namespace") == g), 0.7).clusters
        cols = ["normalized_text", "count", "n_templates", "representative"]
        assert {tuple(r) for r in both.where(F.col("namespace") == g).select(*cols).collect()} == {
            tuple(r) for r in alone.select(*cols).collect()
        }


def test_empty_and_invalid(spark):
    df = spark.createDataFrame([("  ",), ("12 34",)], "line string")
    assert cluster(df, 0.8).clusters.count() == 0
    assert templates(df).count() == 0
    for bad in (0.0, 1.5, -1):
        with pytest.raises(ValueError):
            cluster(df, bad)
    with pytest.raises(ValueError):
        cluster(df, 0.5, mode="none")
    with pytest.raises(ValueError):
        cluster(df, 0.5, metric="none")


@pytest.mark.parametrize("mode", ["first", "best"])
def test_assign(spark, mode):
    old = table(spark, texts(60, 6), 1)
    new = table(spark, texts(80, 7) + texts(60, 6)[:10], 2)
    base = cluster_templates(old, 0.7)
    got = assign_templates(new, base.clusters, 0.7, mode=mode).collect()
    names = {r.cluster_id: r.normalized_text for r in base.clusters.collect()}
    heads = [r.normalized_text for r in sorted(base.clusters.collect(), key=lambda r: (-r["count"], r.normalized_text))]
    for r in got:
        hits = [(plain.similarity(r.normalized_text, h, 0.7), h) for h in heads]
        hits = [(s, h) for s, h in hits if s >= 0.7]
        want = None if not hits else (hits[0] if mode == "first" else max(hits, key=lambda x: x[0]))[1]
        assert names.get(r.cluster_id) == want, r


def test_assign_to_forms_new_clusters(spark):
    old = spark.createDataFrame([("disk error node one",), ("disk error node two",)], "line string")
    new = spark.createDataFrame([("disk errors node three",), ("payment declined for card",)], "line string")
    base = cluster(old, 0.6)
    out = assign_to(new, base.clusters, 0.6)
    rows = {r.normalized_text: r for r in out.membership.collect()}
    assert rows["disk errors node three"].existing
    fresh = rows["payment declined for card"]
    assert not fresh.existing and fresh.cluster_id > max(r.cluster_id for r in base.clusters.collect())
    assert out.formed.clusters.count() == sum(not r.existing for r in rows.values())


@pytest.mark.parametrize("metric", ["dice_bigrams", "dice_chars"])
@pytest.mark.parametrize("wide", [False, True])
def test_join_is_compiled(spark, metric, wide):
    """The JVM leaves methods above 8000 bytes interpreted."""
    ts = [t for t in texts(100, 9) if wide or t.isascii()]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = similar_pairs(spark.createDataFrame([(x,) for x in ts], "normalized_text string"), 0.6, metric=metric)
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        stages = getattr(debug, "MODULE$").codegenStringSeq(pairs._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert len(sizes) > 3 and max(sizes) < 8000


def greedy(edges):
    """Vertices that an earlier leader absorbs, one after the other."""
    earlier = {}
    for lo, hi in edges:
        earlier.setdefault(hi, []).append(lo)
    out = set()
    for v in sorted(earlier):
        if any(u not in out for u in earlier[v]):
            out.add(v)
    return out


def counted_saves(ws):
    names = []
    save = ws.save
    ws.save = lambda df, name, **measures: (names.append(name), save(df, name, **measures))[1]
    return names


def test_long_chain_in_few_rounds(spark):
    from loomlog.workspace import Workspace

    ws = Workspace(spark)
    names = counted_saves(ws)
    edges = [(i, i + 1) for i in range(10_000)]
    out = L.absorbed(ws, spark.createDataFrame(edges, "lo long, hi long"), len(edges))
    assert {r.id for r in out.collect()} == set(range(1, 10_001, 2))
    assert len(names) < 20


@pytest.mark.parametrize("seed", range(4))
def test_absorbed_equals_greedy(spark, monkeypatch, seed):
    """Chains, trees, ladders and random edges, with the chains followed from the first round on and from the second."""
    from loomlog.workspace import Workspace

    monkeypatch.setattr(L, "CHAINS_AFTER", seed % 2)
    rnd, edges = random.Random(seed), set()
    edges |= {(i, i + 1) for i in range(60)}
    edges |= {(rnd.randrange(100, i), i) for i in range(101, 160)}
    edges |= {(i, i + d) for i in range(200, 240) for d in (1, 2)}
    edges |= {tuple(sorted(rnd.sample(range(300, 360), 2))) for _ in range(80)}
    edges |= {tuple(sorted((rnd.randrange(0, 360), rnd.randrange(0, 360)))) for _ in range(10 * seed)}
    edges = [e for e in edges if e[0] != e[1]]
    out = L.absorbed(Workspace(spark), spark.createDataFrame(edges, "lo long, hi long"), len(edges))
    assert sorted(r.id for r in out.collect()) == sorted(greedy(edges))


@pytest.mark.parametrize("metric", ["dice_bigrams", "dice_chars"])
def test_banded_pairs(spark, metric):
    """Nothing wrong, and with many bands nothing missed."""
    ts = sorted({*texts(150, 14), "中", "国", "a", "é", "q" * 300})
    df = spark.createDataFrame([(x, "ab"[i % 2]) for i, x in enumerate(ts)], "normalized_text string, g string")
    key = lambda r: (r.left_text, r.right_text, r.similarity)
    exact = {key(r) for r in similar_pairs(df, 0.7, metric=metric, by=["g"]).collect()}
    few = [key(r) for r in similar_pairs(df, 0.7, metric=metric, by=["g"], bands=2, band_width=4).collect()]
    many = [key(r) for r in similar_pairs(df, 0.7, metric=metric, by=["g"], bands=40, band_width=1).collect()]
    assert set(few) <= exact and len(few) == len(set(few)) and set(many) == exact and len(many) == len(exact) > 10


def test_wide_join_tests_numbers_only(spark):
    """Arrays are compared for the few rows that pass the join, not for every candidate."""
    df = spark.createDataFrame([(x,) for x in texts(60, 4) + ["déjà vu", "déjà vue"]], "normalized_text string")
    plan = similar_pairs(df, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "bit_count" in line]
    assert len(joins) == 1 and "array_intersect" not in joins[0] and "array_intersect" in plan


def test_texts_without_partner_are_left_out_early(spark):
    """Texts too poor in distinct pairs for any partner are not made into token sets."""
    ts = ["", "a", "é", "ab" * 50, "the quick brown fox", "中国中国", "😀é😀é" * 9, "x" * 3000]
    assert T.count_pairs(pa.array([*ts, None])).to_pylist() == [len({t[i : i + 2] for i in range(len(t) - 1)}) for t in ts] + [0]
    df = spark.createDataFrame(list(enumerate(ts)), "id bigint, t string")
    sets = L.token_sets(L.Workspace(spark), df, len(ts), "t", "dice_bigrams", [], 0.75)
    assert {r.id for r in sets.collect()} == {0, 1, 2, 4, 5}


@pytest.mark.parametrize("metric,by,rows,tile", [("dice_bigrams", ["g"], 25, (5, 7)), ("dice_chars", [], 20_000, (128, 1024))])
def test_large_joins_equal_plain_ones(spark, monkeypatch, metric, by, rows, tile):
    """The comparison with numpy finds the pairs of the plain join: wide and long texts, groups with nulls, blocks, small tiles and batches."""
    from loomlog.plans import overlap
    from loomlog.plans.tokens import with_join_keys
    from loomlog.workspace import Workspace

    ts = sorted({*texts(80, 8), "中", "国", "中国日志", "a", "é", "aé", "bé", "q" * 300, "größe " * 40, "größe " * 41})
    df = spark.createDataFrame([(i, t, (None, "null")[i % 2]) for i, t in enumerate(ts)], "id long, t string, g string")
    key = lambda r: (r.left_id, r.right_id, round(r.similarity, 12))
    table = L.save_comparable(Workspace(spark), with_join_keys(L.tokenized(df, len(ts), "t", metric, by), 0.5, list(range(729)), by), "x")
    calls = [(table, table, {"self_join": True}), (table.part(table.rows.where("id % 4 > 0")), table, {"left_first": True})]
    want = [sorted(map(key, J.similar_rows(l, r, 0.5, metric, by, **o).collect())) for l, r, o in calls]
    for name, value in (("SMALL_PRODUCT", 0), ("PLAIN_PAIRS", 0), ("BLOCK_ROWS", rows)):
        monkeypatch.setattr(J, name, value)
    compare = overlap.compare_sorted
    monkeypatch.setattr(J, "compare_sorted", lambda *a: _tiled(compare(*a), tile))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = [J.similar_rows(l, r, 0.5, metric, by, **o) for l, r, o in calls]
        assert all("MapInArrow" in d._jdf.queryExecution().toString() for d in got)
        assert [sorted(map(key, d.collect())) for d in got] == want and min(map(len, want)) > 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _tiled(compare, tile):
    def run(batches):
        from loomlog.plans import overlap

        overlap.TILE = tile
        return compare(batches)

    return run
