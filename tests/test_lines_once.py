"""Queries that read their lines several times join the tables behind them once."""

from queries import registry
from queries.views import logs

ROWS = {
    "region": ("r_regionkey long, r_name string", [(0, "ASIA"), (1, "EUROPE")]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "NATION_0", 0), (1, "NATION_1", 1)]),
    "customer": ("c_custkey long, c_mktsegment string", [(1, "BUILDING"), (1, "BUILDING")]),
    "supplier": ("s_suppkey long, s_nationkey long", [(1, 0), (2, 1), (3, None)]),
    "part": ("p_partkey long, p_name string, p_type string, p_brand string", [(1, "red part", "SMALL", "B1")]),
    "orders": ("o_orderkey long, o_custkey long, o_orderpriority string", [(i, 1, None if i == 3 else "1-URGENT") for i in range(9)]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_shipdate string",
                 [(i % 9, 1, 1 + i % 3, i, "1995-01-01") for i in range(40)]),
}


def test_lines_are_joined_once(spark, tmp_path):
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    early, late = registry._halves(spark, str(tmp_path))
    _, every = registry._base(spark, str(tmp_path), again=True)
    want = sorted(map(str, logs(spark, str(tmp_path)).collect()))
    assert want and sorted(map(str, every.collect())) == want
    assert sorted(map(str, early.unionAll(late).collect())) == want
    assert not any("Join" in df._jdf.queryExecution().toString() for df in (early, late, every))
