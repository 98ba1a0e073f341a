"""The corpus pipeline stage by stage, and the registered queries of this folder against SQL."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare, duck
from tests.llm import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op3_norm_search", "op7_line_dedup", "op8_mixing"])
def test_queries_with_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None


def test_sql_of_line_dedup_has_every_line():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("insert into documents values (1, 'the same long line'), (2, null), (3, repeat('a' || chr(10), 1000001) || 'the same long line')")
    rows = con.sql(entry.oracle_sql()["op7_line_dedup"]).fetchall()
    kept = ["the same long line", "", "\n".join(["a"] * 1_000_001)]
    assert sorted(rows) == [(d, n, dropped, plain.sha(t)) for (d, n, dropped), t in zip([(1, 1, 0), (2, 1, 0), (3, 1_000_002, 1)], kept)]


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = before, docs.collect()
    before, after = kept["quality"]
    assert len(after) < len(before) and all(r == before[r.doc_id] for r in after)
    before, after = kept["line_dedup"]
    want = plain.dedup_lines([(d, r.text) for d, r in before.items()])
    assert {r.doc_id: r.text for r in after} == {d: t for d, (*_, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = kept["near_dedup"]
    want = plain.components([(d, r.text) for d, r in before.items()], 85)
    assert {r.doc_id for r in after} == {d for d, (_, c) in want.items() if c == d}
    before, after = kept["mixing"]
    assert 0 < len(after) < len(before) and len({r.doc_id for r in after}) == len(after)
    before, after = kept["packing"]
    lengths = {}
    for r in after:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths.keys() == before.keys()
    assert all(lengths[r.doc_id] == r.doc_tokens for r in after)


def test_stages_of_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines int"
    rows = [(1, None, None, None, None, "a", 1), (None, "some text here", "en", "src1", 3, None, None),
            (2, "", "en", "x", 0, "b", 2), (2, "", "en", "x", 0, "b", 2), (3, "word " * 9000, "en", "src2", 1, "c", 3)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{len(part)}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{len(part)}")
        assert docs.count() >= (1 if part else 0)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where(F.col("length") < 1).count() == 0
