"""Cluster sets as relations, and merging sets that were made elsewhere."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators import summary
from loomlog.operators.cluster import Clustering, cluster_templates
from loomlog.plans.skew import join_on, join_unique
from loomlog.sources.logs import SOURCE
from loomlog.workspace import Workspace


@dataclass(frozen=True)
class ClusterSet:
    """Clusters with their members and sources, as three relations.

    ``clusters``: by, cluster_id, representative, normalized_text, words, count;
    ``members``: by, cluster_id, line; ``sources``: by, cluster_id, namespace, pod,
    container. Nothing is gathered per cluster, so a cluster may be any size.
    """

    clusters: DataFrame
    members: DataFrame
    sources: DataFrame
    by: tuple[str, ...] = ()

    @staticmethod
    def of(result: Clustering, df: DataFrame) -> ClusterSet:
        """All lines and sources of a clustering of ``df``."""
        by = list(result.by)
        own = [c for c in SOURCE if c not in by]
        return ClusterSet(
            result.clusters.select(*by, "cluster_id", "representative", "normalized_text", "words", "count"),
            summary.members(result, df).select(*by, "cluster_id", "line"),
            summary.sources(result, df).select(*by, "cluster_id", *own),
            result.by,
        )


def merge_clusters(
    sets: list[ClusterSet],
    threshold: float = 0.9,
    *,
    mode: str = "first",
    metric: str = "dice_bigrams",
) -> ClusterSet:
    """Apply the clustering rule to the clusters of several sets.

    Clusters go in order of size, each group of ``by`` on its own; a smaller one joins the first larger one whose
    text is similar, and that one's representative stays. Members and sources are
    united without repeats and counted again.
    """
    if not sets:
        raise ValueError("no cluster sets to merge")
    by = sets[0].by
    if any(s.by != by for s in sets):
        raise ValueError("the sets have different groups")
    tagged = [s.clusters.withColumn("_set", F.lit(i)) for i, s in enumerate(sets)]
    every = reduce(DataFrame.unionByName, tagged)
    # equal texts meet first; the largest of them sets the rank and the example
    texts = every.groupBy(*by, "normalized_text").agg(
        F.max("count").alias("count"),
        F.min_by("representative", F.struct(-F.col("count"), "representative")).alias("representative"),
    )
    merged = cluster_templates(
        texts.withColumn("occurrences", F.col("count")), threshold, mode=mode, metric=metric, by=by
    )
    new_id = merged.membership.select(*by, "normalized_text", F.col("cluster_id").alias("_new"))
    moved = join_on(every.select("_set", "cluster_id", *by, "normalized_text"), new_id, [*by, "normalized_text"])
    moved = moved.select("_set", "cluster_id", "_new")
    ws = Workspace(every.sparkSession)

    def united(part: str, columns: list[str]) -> DataFrame:
        rows = reduce(
            DataFrame.unionByName,
            [getattr(s, part).select(*by, "cluster_id", *columns, F.lit(i).alias("_set")) for i, s in enumerate(sets)],
        )
        rows, seen = ws.save(rows.withColumn("_row", F.xxhash64(*columns)), part)
        counted = rows.groupBy("_set", "cluster_id").agg(F.count(F.lit(1)).alias("_rows"))
        labels = moved.join(counted, ["_set", "cluster_id"])
        joined = join_unique(rows, labels, ["_set", "cluster_id"], "_rows", seen["rows"], "_row")
        return joined.select(*by, F.col("_new").alias("cluster_id"), *columns).distinct()

    members = united("members", ["line"])
    counted = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"))
    clusters = merged.clusters.drop("count", "occurrences", "n_templates").join(counted, "cluster_id")
    return ClusterSet(
        clusters.select(*by, "cluster_id", "representative", "normalized_text", "words", "count"),
        members,
        united("sources", [c for c in SOURCE if c not in by]),
        by,
    )
