"""JSON output, reading it back, and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.text import template_words
from loomlog.operators.merge import ClusterSet
from loomlog.operators.summary import take_per_cluster
from loomlog.sources.logs import ERROR_SCHEMA, SOURCE

CLUSTERS = "cluster_id bigint, representative string, normalized_text string, count bigint"


def cluster_rows(clusters: ClusterSet, member_limit: int, source_limit: int) -> DataFrame:
    """One row per cluster with its first members and sources, in text order, as arrays:
    ``by, cluster_id, representative, normalized_text, words, members, count, sources``.

    Arrays need limits; the whole lists are relations (see :func:`write_json`).
    """
    if member_limit < 1 or source_limit < 1:
        raise ValueError("arrays need positive limits")
    own = [c for c in SOURCE if c in clusters.sources.columns and c not in clusters.by]
    lines = take_per_cluster(clusters.members, member_limit).groupBy("cluster_id")
    places = clusters.sources.withColumn("line", F.to_json(F.struct(*own)))
    places = take_per_cluster(places, source_limit).groupBy("cluster_id")
    return (
        clusters.clusters.join(lines.agg(F.array_sort(F.collect_list("line")).alias("members")), "cluster_id", "left")
        .join(places.agg(F.array_sort(F.collect_list(F.struct(*own))).alias("sources")), "cluster_id", "left")
        .select(
            *clusters.by, "cluster_id", "representative", "normalized_text", "words", "members", "count", "sources"
        )
    )


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON document per row, as ``value``."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_json(clusters: ClusterSet, errors: DataFrame | None, path: str, member_limit: int = 0) -> None:
    """Write ``path/clusters``, ``path/members``, ``path/sources`` and ``path/errors`` as JSON
    lines, one row per cluster, member, source and error at every size.

    ``member_limit`` writes the first members of each cluster only; 0 writes all.
    """
    by = list(clusters.by)
    clusters.clusters.select(*by, "cluster_id", "representative", "normalized_text", "words", "count").write.json(
        f"{path}/clusters"
    )
    take_per_cluster(clusters.members, member_limit).write.json(f"{path}/members")
    clusters.sources.write.json(f"{path}/sources")
    if errors is None:
        errors = clusters.clusters.sparkSession.createDataFrame([], ERROR_SCHEMA)
    errors.select(*ERROR_SCHEMA.names).write.json(f"{path}/errors")


def read_clusters(spark: SparkSession, path: str, by: str = "") -> ClusterSet:
    """Read clusters written by :func:`write_json`; ``by`` gives names and types of
    the group columns, as in ``"namespace string"``."""
    group = T.StructType.fromDDL(by) if by else T.StructType()
    names = group.names

    def relation(name: str, columns: str) -> DataFrame:
        schema = T.StructType([*group.fields, *T.StructType.fromDDL(columns).fields])
        return spark.read.schema(schema).json(f"{path}/{name}")

    heads = relation("clusters", CLUSTERS)
    own = ", ".join(f"{c} string" for c in SOURCE if c not in names)
    return ClusterSet(
        heads.select(
            *names, "cluster_id", "representative", "normalized_text", template_words("normalized_text").alias("words"), "count"
        ),
        relation("members", "cluster_id bigint, line string"),
        relation("sources", f"cluster_id bigint, {own}"),
        tuple(names),
    )


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ERROR_SCHEMA).json(f"{path}/errors")


def write_report(rows: DataFrame, path: str) -> None:
    """Write a report (see ``summary.report``) as text, in reading order."""
    rows.orderBy("rank", "section", "item").select("text").write.text(path)
