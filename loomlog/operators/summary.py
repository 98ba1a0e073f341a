"""What can be read off a clustering: members, sources, rankings, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.functions.text import with_template
from loomlog.operators.cluster import Clustering
from loomlog.operators.templates import DistinctLines, as_lines
from loomlog.plans.leaders import rank
from loomlog.plans.skew import join_on, join_unique
from loomlog.sources.logs import SOURCE
from loomlog.workspace import Workspace


def take_per_cluster(members: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` lines of each cluster in text order; 0 keeps all.

    The limit is applied per partition before the shuffle and again after it, so
    a huge cluster never gathers in one task.
    """
    if limit < 0:
        raise ValueError("the member limit must not be negative")
    if limit == 0:
        return members
    order = W.partitionBy(*by, "cluster_id").orderBy("line")
    return members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def members(result: Clustering, df: DataFrame | DistinctLines | None = None, limit: int = 0) -> DataFrame:
    """Distinct lines of each cluster as a relation ``by, cluster_id, line,
    occurrences``.

    ``df`` is the relation that was clustered or its distinct lines; it is needed only
    if the clustering began with templates.
    """
    by = list(result.by)
    source = result.lines if result.lines is not None and not isinstance(df, DistinctLines) else df
    if source is None:
        raise ValueError("this clustering began with templates; give the lines")
    lines = as_lines(source, result.word_filter, by).select(*by, "normalized_text", "line", "occurrences")
    total = result.membership.agg(F.sum("count")).head()[0] or 0
    labels = result.membership.select(*by, "normalized_text", "cluster_id", "count")
    joined = join_unique(lines, labels, [*by, "normalized_text"], "count", total, "line")
    return take_per_cluster(
        joined.select(*by, "cluster_id", "line", "occurrences"), limit, result.by
    )


def sources(result: Clustering, df: DataFrame) -> DataFrame:
    """Distinct sources of each cluster with their line counts: ``by, cluster_id,
    namespace, pod, container, occurrences``.

    ``df`` is the clustered relation. Lines are reduced to (template, source)
    counts per map task before anything moves; templates travel as digests. A template that occurs in very many
    containers is cut into blocks by its number of sources when it meets its cluster.
    """
    by = list(result.by)
    own = [c for c in SOURCE if c not in by]
    # 128 bits stand for the text from here on
    digest = F.md5(F.col("normalized_text").cast("binary"))
    seen = (
        with_template(df, result.word_filter)
        .withColumn("_t", digest)
        .groupBy(*by, "_t", *own)
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    seen, measured = Workspace(df.sparkSession).save(seen, "sources")
    counted = seen.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("_rows"))
    labels = join_on(result.membership.select(*by, digest.alias("_t"), "cluster_id"), counted, [*by, "_t"])
    rows = seen.withColumn("_row", F.xxhash64(*own)) if own else seen.withColumn("_row", F.lit(0))
    joined = join_unique(rows, labels, [*by, "_t"], "_rows", measured["rows"], "_row")
    return joined.groupBy(*by, "cluster_id", *own).agg(F.sum("occurrences").alias("occurrences"))


def cluster_order() -> list:
    """Output order: largest first, ties by text, then by rank."""
    return [F.desc("count"), F.asc("normalized_text"), F.asc("cluster_id")]


def top_clusters(result: Clustering, k: int) -> DataFrame:
    """The ``k`` largest clusters with their position ``rank``, from 1."""
    top = result.clusters.orderBy(*cluster_order()).limit(k)
    # the window sees k rows
    return top.withColumn("rank", F.row_number().over(W.orderBy(*cluster_order())))


def ranked_clusters(result: Clustering) -> DataFrame:
    """All clusters with their position ``rank``, numbered by a range sort."""
    ws = Workspace(result.membership.sparkSession)
    numbered, _ = rank(ws, result.clusters.orderBy(*cluster_order()))
    return numbered.withColumn("rank", F.col("id") + 1).drop("id")


def rare_clusters(result: Clustering, max_count: int) -> DataFrame:
    """Clusters of at most ``max_count`` distinct lines: likely anomalies."""
    return result.clusters.where(F.col("count") <= max_count)


def cluster_stats(result: Clustering) -> DataFrame:
    """``clusters, templates, lines, occurrences`` in total."""
    return result.membership.agg(
        F.count_if(F.col("template_id") == F.col("cluster_id")).alias("clusters"),
        F.count(F.lit(1)).alias("templates"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
    )


def report(result: Clustering, df: DataFrame, top: int | None = None) -> DataFrame:
    """The text report as rows ``by, rank, section, item, text``.

    Sorted by rank, section and item, ``text`` reads as the printed report. One row per
    source, so a cluster seen in a million containers stays a million small rows.
    """
    by = list(result.by)
    ranked = ranked_clusters(result) if top is None else top_clusters(result, top)
    ranked = ranked.select(*by, "cluster_id", "rank", "count", "representative", "words")
    quoted = F.transform("words", lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    head = F.array(
        F.format_string("Cluster %d: (Count: %d)", F.col("rank"), F.col("count")),
        F.concat(F.lit("  Representative: "), "representative"),
        F.concat(F.lit("  Key words: ["), F.array_join(quoted, ", "), F.lit("]")),
        F.lit("  Sources:"),
    )
    heads = ranked.select(*by, "rank", F.posexplode(head).alias("section", "text"))
    name = F.concat_ws("/", *SOURCE)
    places, measured = Workspace(df.sparkSession).save(sources(result, df), "places")
    counted = places.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_rows"))
    labels = ranked.select("cluster_id", "rank").join(counted, "cluster_id")
    rows = places.withColumn("_row", F.xxhash64(*SOURCE))
    tails = join_unique(rows, labels, ["cluster_id"], "_rows", measured["rows"], "_row").select(
        *by, "rank", F.lit(4).alias("section"), name.alias("item"), F.concat(F.lit("    - "), name).alias("text")
    )
    return heads.select(*by, "rank", "section", F.lit("").alias("item"), "text").unionAll(tails)
