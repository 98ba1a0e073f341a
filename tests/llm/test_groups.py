"""Operators that compare documents, vectors or sources, against brute force."""

import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import line_dedup, mixing, near_dedup, norm_search
from loomlog.llm.common import READ_ROWS
from loomlog.workspace import Workspace, checkpoint_root
from tests.llm import plain

EXTRA = "doc_id long, text string, _doc string, _drop int, component_id long, _id string"


def near_texts(seed, n):
    """Texts of a few families with more and fewer changed words, copies, short and empty ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.choice([6, 40, 120]))] for _ in range(5)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out + ["", None, "one two", "ONE\ttwo ", "one two three", " \n "]


@pytest.mark.parametrize("blocks", [1000, 7])
def test_near_duplicates(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", blocks)
    docs = [(i * 7 % 1009, t) for i, t in enumerate(near_texts(blocks, 150))]
    want = plain.components(docs, 85)
    assert len({c for _, c in want.values()}) < len(docs) - 40
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_family_of_near_copies_in_one_star():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    sets, docs = [], []
    for i in range(80):
        w = list(base)
        for _ in range(0 if i == 0 else rng.randint(1, 6)):
            w[rng.randrange(200)] = f"x{rng.random()}"
        docs.append((i, " ".join(w)))
        sets.append(near_dedup.shingles(docs[-1][1]))
    want = {d: c for d, (_, c) in plain.components(docs, 85).items()}
    block = np.arange(80) % 3
    links = []
    for i in range(3):
        for j in range(i, 3):
            take = np.flatnonzero((block == i) | (block == j) | (np.arange(80) == 0))
            links += near_dedup.links_of_star(0, take, [sets[k] for k in take], block[take], i != j, 85)
    comp = {d: d for d in range(80)}
    for _ in range(80):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert comp == want and len(links) < 400


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    for j in (0.85, 0.9, 0.97):
        both = int(1000 * j)
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, 1000 - both, dtype=np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        odd = int(np.bitwise_count(near_dedup.odd_sketch(np.unique(a)) ^ near_dedup.odd_sketch(np.unique(b))).sum())
        differ = np.log(1 - 2 * odd / near_dedup.BITS) / np.log(1 - 2 / near_dedup.BITS) / 2
        assert abs(1 - differ / near_dedup.SAMPLES - true) < 0.09


def test_near_duplicates_of_odd_rows(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, t), (5, t), (None, t), (2, t.upper()), (7, ""), (8, None), (9, "x"), (1, "X"), (3, "y")]
    df = spark.createDataFrame([(d, x, "a", 1, 4, "b") for d, x in rows], EXTRA)
    got = sorted(map(tuple, near_dedup.near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    want = [(5, 2, False), (5, 2, False), (None, None, True), (2, 2, True), (7, 7, True), (8, 8, True), (9, 1, False),
            (1, 1, True), (3, 3, True)]
    assert got == sorted(want, key=str)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 7, 8]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.drop_near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201)]
    rng.shuffle(edges)
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()
    assert {r.node: r.component for r in got} == {
        **{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}, 201: 200
    }


@pytest.mark.parametrize("bits", [1 << 28, 1 << 16])
def test_line_dedup(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "BITS_PER_CHAR", 50)
    rng = random.Random(bits)
    lines = ["Shared License Line", "  shared license LINE\t", "short", "", "É some other line", "é some other line", "twice in here"]
    lines += [f"line number {i} of many" for i in range(30)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(60)] + [(-5, None), (70, "twice in here\ntwice in here")]
    want = plain.dedup_lines(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = line_dedup.line_report(df, max_bits=bits).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want


def test_a_full_filter_only_suspects_more(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENT", 64)
    docs = [(i, f"line number {i // 2} is here\nalways the same line") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.line_report(df, max_bits=64).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == plain.dedup_lines(docs)


def test_filters_in_many_segments(spark, monkeypatch):
    """Filters sized by the text alone, in many segments and chunks, and in few large segments."""
    rng = random.Random(3)
    docs = [(i, "\n".join(f"line {rng.randrange(400)} of the text" for _ in range(rng.randint(0, 30)))) for i in range(120)]
    df, want = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), plain.dedup_lines(docs)
    monkeypatch.setattr(line_dedup, "SEGMENT", 64)
    for most in (1 << 14, 2):
        monkeypatch.setattr(line_dedup, "MOST_SEGMENTS", most)
        got = line_dedup.line_report(df).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want


def test_digests_of_chunks_are_not_shuffled(spark):
    ws = Workspace(spark)
    docs = spark.createDataFrame([(i, f"line number {i // 2} is here") for i in range(100)], "_doc long, text string").repartition(4)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = ws.save_bucketed(line_dedup._scanned(docs, 1 << 16, 1 << 16, 10), "lines", "chunk", n)
    answers = scanned.groupBy("chunk").agg(F.count("plane").alias("answers"))
    told = scanned.where("plane is null").join(answers, "chunk")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and told.count() == scanned.select("chunk").distinct().count()
    before = len(spark.catalog.listTables())
    ws.close()
    assert len(spark.catalog.listTables()) == before - 1


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(f"line number {i % 150_000} of a long text" for i in range(300_000))
    docs = [(1, "line number 7 of a long text\nshort"), (2, long), (3, "line number 149999 of a long text")]
    got = line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == plain.dedup_lines(docs)


def test_line_dedup_of_odd_rows(spark):
    a = "the same long line"
    rows = [(5, a), (5, a + "\nx"), (None, a), (None, a), (2, a), (7, None), (8, "")]
    df = spark.createDataFrame([(d, t, "q", 1, 4, "b") for d, t in rows], EXTRA)
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    want = [(5, ""), (5, "x"), (None, a), (None, a), (2, ""), (7, ""), (8, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.dedup_lines(df.where("doc_id = 5")).where("text = ''").count() == 0  # one document


def test_line_dedup_reads_few_documents_at_a_time(spark, tmp_path):
    """A Parquet reader holds READ_ROWS texts at a time, unless the session says otherwise; the results are the same."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    docs = [(i, f"line number {i % 700} is here\nof {i} alone") for i in range(1500)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    before, want = spark.conf.get(name), plain.dedup_lines(docs)
    try:
        for own, held in ((None, READ_ROWS), (77, 77)):
            spark.conf.unset(name) if own is None else spark.conf.set(name, str(own))
            report = line_dedup.line_report(spark.read.parquet(str(tmp_path / "docs")))
            assert spark.conf.get(name) == str(held) and held < 4096
            assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in report.collect()} == want
    finally:
        spark.conf.set(name, before)


def test_line_dedup_writes_no_table_that_is_read_once(spark):
    docs = spark.createDataFrame([(i, f"line number {i // 2} is here") for i in range(100)], "doc_id long, text string")
    root = Path(urlparse(checkpoint_root(spark)).path)
    before = set(root.glob("loomlog-*"))
    assert line_dedup.line_report(docs).agg(F.sum("n_dropped")).head()[0] == 50
    written = [d for work in set(root.glob("loomlog-*")) - before for d in work.iterdir()]
    assert sorted(d.name.split("-", 1)[1] for d in written) == ["lines", "repeated-lines", "suspected-lines"]


def brute_top_k(rows, is_query, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if is_query(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(norm_search, "BUCKET", 32)
    monkeypatch.setattr(norm_search, "QUERIES", 5)
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 8))
    v = centers[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8)) * rng.choice([0.01, 0.3], (400, 1))
    v *= rng.choice([0.1, 1, 3], (400, 1)) if seed else 1
    rows = [(i, [float(np.float32(x)) for x in w]) for i, w in enumerate(v)]
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, rows[3][1]), (1250, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = norm_search.top_k(df, "id % 50 = 0", 5).collect()
    assert {tuple(r) for r in got} == brute_top_k(rows, lambda i: i % 50 == 0, 5)


def test_top_k_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [-1.0, 0.5]), (50, [0.0, 0.0]), (100, []), (101, []), (None, [1.0, 1.0]),
            (150, [1e30, 1.0]), (3, [1e30, -1.0]), (200, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in norm_search.top_k(df, "id % 50 = 0", 5).collect()}
    assert got[100, 1] == (101, 0) and got[200, 1] == (1, 256 * 768)
    assert got[150, 1] == (0, 2**63 - 1) or got[150, 1][1] == 2**63 - 1
    assert [got[50, r] for r in (1, 2, 3, 4)] == [(0, 0), (2, 0), (3, 0), (150, 0)]
    assert norm_search.top_k(df.limit(0), "id % 50 = 0", 5).count() == 0


def test_coordinates_keep_all_that_can_matter():
    rng = np.random.default_rng(5)
    for _ in range(200):
        d = int(rng.integers(1, 6))
        v = np.round(rng.normal(size=(50, d)) * 100)
        q = np.round(v[0] + rng.normal(size=d) * rng.choice([1, 30]))
        norms = np.sqrt((v**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        v, norms = v[order], norms[order]
        b = norm_search._Block.__new__(norm_search._Block)
        b.norms, b.v = norms, v
        scores = v @ q
        least = float(np.sort(scores)[-3])
        at = norm_search.candidates(q, float(np.sqrt((q**2).sum())), least, b, v / np.where(norms > 0, norms, 1)[:, None])
        assert at is None or set(np.flatnonzero(scores >= least)) <= set(at.tolist())


def mixed(df, weights, percent, epochs, seed=3):
    levels = [F.substring("source", 1, 1), F.col("lang"), F.col("source")]
    out, n = mixing.mix(df, levels, weights, percent, epochs, seed, F.col("t"))
    return out, n


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["en", "de", None]), rng.choice(["a1", "a2", "b1", "b2", "b3"]), rng.choice([0, 1, 7, 40])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, source string, t long")
    weights = ({"a": 3}, {"en": 5, "de": 2}, {"b3": 4, "a2": 0 if seed == 2 else 1})
    out, n = mixed(df, weights, 70, 2)
    rows = out.select("doc_id", n["l0"], n["l1"], n["l2"], n["n_tokens"], n["epoch"]).collect()
    tree = {}
    for d, lang, source, t in docs:
        if not (source == "a2" and seed == 2):
            tree.setdefault(source[0], {}).setdefault(lang or mixing.NONE, {}).setdefault(source, []).append((d, t))
    cap = lambda x: sum(t for _, t in x) * 2 if isinstance(x, list) else sum(map(cap, x.values()))
    w = lambda level, name: weights[level].get(name, 1)
    total = sum(t for *_, s, t in docs if not (s == "a2" and seed == 2))
    own = {}
    top = sorted(tree)
    for d, b in zip(top, plain.water_fill(total * 70 // 100, [(w(0, d), cap(tree[d])) for d in top])):
        langs = sorted(tree[d])
        for g, c in zip(langs, plain.water_fill(b, [(w(1, g), cap(tree[d][g])) for g in langs])):
            leaves = sorted(tree[d][g])
            for s, e in zip(leaves, plain.water_fill(c, [(w(2, s), cap(tree[d][g][s])) for s in leaves])):
                own[d, g, s] = e
    got = {}
    for r in rows:
        got.setdefault(tuple(r)[1:4], []).append((r[n["epoch"]], r["doc_id"], r[n["n_tokens"]]))
    for key, budget in own.items():
        have = tree[key[0]][key[1]][key[2]]
        tokens = sum(t for _, t in have)
        if not tokens:
            assert sorted(got[key]) == sorted((1, d, 0) for d, _ in have)
            continue
        used = sum(t for *_, t in got.get(key, []))
        assert used <= budget and budget - used <= 40
        full = budget // tokens
        for epoch in range(1, full + 1):
            assert {d for e, d, _ in got[key] if e == epoch} == {d for d, _ in have}
        assert all(e <= full + 1 for e, *_ in got.get(key, []))


def test_shortages_go_to_siblings_first(spark):
    """b's small leaf leaves its tokens to the other leaf of b, not to a."""
    leaves = spark.createDataFrame([("a", "x", "a1", 1000), ("b", "x", "b1", 10), ("b", "x", "b2", 1000)], "l0 string, l1 string, l2 string, tokens long")
    own = {r.l2: r.own for r in mixing.leaf_budgets(leaves, ({}, {}, {}), 40, 1).collect()}
    assert own == {"a1": 402, "b1": 10, "b2": 392}


def test_mixing_of_odd_rows(spark):
    rows = [(1, "en", "a1", 5, "x", 1), (1, "en", "a1", 5, "x", 1), (None, "en", "a1", 5, "x", 1), (3, None, None, 2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, t long, l0 string, epoch int")
    out, n = mixed(df, ({}, {}, {}), 100, 1)
    assert out.count() == 4 and n["l0"] == "l0_" and n["epoch"] == "epoch_" and set(df.columns) < set(out.columns)
    half, n = mixed(df.where("source = 'a1'"), ({}, {}, {}), 70, 1)
    ids = sorted(str(r.doc_id) for r in half.collect())
    assert ids in (["1", "1"], ["None"])  # equal ids come together
    assert mixed(df.limit(0), ({}, {}, {}), 50, 2)[0].count() == 0
    assert mixing.word_count(F.lit("a\tb  c\n")) is not None


def test_the_leaf_join_without_broadcast(spark, monkeypatch):
    rows = [(i, "en", f"a{i % 7}", 3) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, t long")
    want = sorted(map(str, mixed(df, ({}, {}, {}), 60, 1)[0].collect()))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert sorted(map(str, mixed(df, ({}, {}, {}), 60, 1)[0].collect())) == want
