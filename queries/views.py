"""Log-shaped views over the test tables, for both engines.

``LOGS`` is one SQL text that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents".split()

LOGS = """
select l.l_shipdate as ts, r.r_name as namespace,
  'supplier-' || cast(s.s_suppkey as varchar(20)) as pod, p.p_brand as container,
  case (l.l_orderkey * 7 + l.l_linenumber * 3) % 8
  when 0 then 'ERROR: order ' || cast(l.l_orderkey as varchar(20)) || ' of priority ' || o.o_orderpriority || ' could not be booked in ' || n.n_name
  when 1 then 'INFO: Shipment of ' || p.p_name || ' ' || p.p_type || ' dispatched from ' || n.n_name || ' for segment ' || c.c_mktsegment || ' in ' || cast(l.l_partkey as varchar(20)) || 'ms'
  when 2 then 'WARN: stock of brand ' || p.p_brand || ' below plan by ' || cast(l.l_partkey as varchar(20)) || ' pieces in ' || r.r_name
  when 3 then 'ERROR: supplier s-' || cast(s.s_suppkey as varchar(20)) || ' gave no answer before the timeout, lot ' || cast(l.l_partkey as varchar(20)) || '/' || cast(l.l_orderkey as varchar(20))
  when 4 then 'INFO: customer c_' || cast(o.o_custkey as varchar(20)) || ' of segment ' || c.c_mktsegment || ' confirmed the delivery'
  when 5 then 'DEBUG: price of part ' || cast(l.l_partkey as varchar(20)) || ' looked up for region ' || r.r_name
  when 6 then '   '
  else 'WARN: daily quota of supplier ' || cast(l.l_suppkey as varchar(20)) || ' used up after ' || cast(l.l_partkey as varchar(20)) || ' parcels' end as line
from {lineitem} l
join {orders} o on l.l_orderkey = o.o_orderkey
join {customer} c on o.o_custkey = c.c_custkey
join {part} p on l.l_partkey = p.p_partkey
join {supplier} s on l.l_suppkey = s.s_suppkey
join {nation} n on s.s_nationkey = n.n_nationkey
join {region} r on n.n_regionkey = r.r_regionkey
"""

LOGS_SQL = LOGS.format(**{t: t for t in TABLES})

DOC_LINES_SQL = """
select lang as namespace, source as pod, cast(doc_id as varchar) as container,
  unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line
from documents
"""

EVENT_LINES_SQL = """
select ts, event_type as namespace, cast(user_id as varchar) as pod, '' as container,
  event_type || ' ' || props as line
from events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [t for t in TABLES if "{" + t + "}" in LOGS]
    return spark.sql(LOGS, **{t: table(spark, sf_dir, t) for t in names})


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.sources.logs import split_lines

    docs = table(spark, sf_dir, "documents").select(
        F.col("text"),
        F.col("lang").alias("namespace"),
        F.col("source").alias("pod"),
        F.col("doc_id").cast("string").alias("container"),
    )
    return split_lines(docs, "text")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts",
        F.col("event_type").alias("namespace"),
        F.col("user_id").cast("string").alias("pod"),
        F.lit("").alias("container"),
        F.concat_ws(" ", "event_type", "props").alias("line"),
    )
