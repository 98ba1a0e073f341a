"""The JSON round trip is over all lines."""

from queries import registry
from tests.test_lines_once import ROWS


def test_json_roundtrip_holds_every_line(spark, tmp_path):
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.json_roundtrip(spark, str(tmp_path)).collect()
    lines = {r.line for r in registry.logs(spark, str(tmp_path)).where("trim(line) <> ''").collect()}
    assert sum(r.n_members for r in got) == sum(r["count"] for r in got) == len(lines)
    assert sum(r.bytes for r in got) == sum(len(line) for line in lines)
    kinds = {line.split(":")[0] for line in lines}
    assert {"INFO", "DEBUG"} <= kinds == {r.representative.split(":")[0] for r in got}
    warned = registry.json_roundtrip_by_namespace(spark, str(tmp_path)).collect()
    assert {r.representative.split(":")[0] for r in warned} == {"ERROR", "WARN"}
