"""Put new lines into clusters that already exist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.cluster import Clustering, check_mode, cluster_templates
from loomlog.operators.index import ClusterIndex, assigned_by_index
from loomlog.operators.templates import rank_order, templates
from loomlog.plans.leaders import _choose, rank, save_comparable, token_sets
from loomlog.plans.simjoin import similar_rows
from loomlog.plans.skew import join_on
from loomlog.plans.tokens import check_metric, check_threshold, token_order, with_join_keys
from loomlog.workspace import Workspace


def assign_templates(
    new: DataFrame,
    clusters: DataFrame | ClusterIndex,
    threshold: float = 0.9,
    *,
    mode: str = "first",
    metric: str = "dice_bigrams",
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``cluster_id, similarity`` of the matching existing cluster to each
    template of ``new``; both null where no cluster reaches the threshold.

    ``clusters`` has ``by, cluster_id, normalized_text, count``; its rank order
    decides which cluster comes first. A text equal to a cluster's text has
    similarity 1 whatever its bigrams. A :class:`ClusterIndex` stands for clusters that were ranked and
    tokenized once; then only new templates are tokenized and shuffled.
    """
    threshold, metric = check_threshold(threshold), check_metric(metric)
    check_mode(mode)
    by = list(by)
    if isinstance(clusters, ClusterIndex):
        clusters.check(threshold, metric, by)
        return assigned_by_index(new, clusters, mode)
    ws = Workspace(new.sparkSession)
    text = "normalized_text"

    old, n_old = rank(ws, clusters.select(*by, "cluster_id", text, "count").orderBy(*rank_order(by)))
    fresh, n_new = rank(ws, new.orderBy(*rank_order(by)))
    olds = token_sets(ws, old, n_old, text, metric, by, threshold)
    news = token_sets(ws, fresh, n_new, text, metric, by, threshold)
    order = token_order(olds.unionAll(news))
    left = save_comparable(ws, with_join_keys(olds, threshold, order, by), "old")
    right = save_comparable(ws, with_join_keys(news, threshold, order, by), "new")
    close = similar_rows(left, right, threshold, metric, by)

    # texts can repeat among old clusters; the earliest of them is the one met
    same_old = old.groupBy(*by, text).agg(F.min("id").alias("left_id"))
    same = join_on(fresh.select("id", *by, text), same_old, [*by, text]).select(
        "left_id", F.col("id").alias("right_id"), F.lit(1.0).alias("similarity")
    )
    chosen = _choose(close.unionAll(same), "right_id", "left_id", mode)
    found = chosen.join(
        old.select(F.col("id").alias("_leader"), F.col("cluster_id").alias("_known")),
        chosen.cluster_id == F.col("_leader"),
    ).select("id", F.col("_known").alias("cluster_id"), "similarity")
    return fresh.join(found, "id", "left").drop("id")


@dataclass(frozen=True)
class Assignment:
    """Where new templates went.

    ``matched``: templates of existing clusters with ``cluster_id, similarity``;
    ``formed``: a clustering of the rest, numbered after the existing clusters.
    """

    matched: DataFrame
    formed: Clustering

    @property
    def membership(self) -> DataFrame:
        """All new templates with ``cluster_id``; ``existing`` is false for the
        clusters formed here."""
        cols = [c for c in self.formed.membership.columns if c != "template_id"]
        return self.matched.select(*cols, F.lit(True).alias("existing")).unionAll(
            self.formed.membership.select(*cols, F.lit(False).alias("existing"))
        )


def assign_to(
    df: DataFrame,
    clusters: DataFrame | ClusterIndex,
    threshold: float = 0.9,
    *,
    mode: str = "first",
    metric: str = "dice_bigrams",
    by: Sequence[str] = (),
    word_filter: bool = True,
) -> Assignment:
    """Assign the lines of ``df`` to existing clusters, cluster the rest.

    Counts are those of ``df``; ``merge_clusters`` unites them with the existing
    members.
    """
    return place_templates(
        templates(df, word_filter, by), clusters, threshold, mode=mode, metric=metric, by=by, word_filter=word_filter
    )


def place_templates(
    new: DataFrame,
    clusters: DataFrame | ClusterIndex,
    threshold: float = 0.9,
    *,
    mode: str = "first",
    metric: str = "dice_bigrams",
    by: Sequence[str] = (),
    word_filter: bool = True,
) -> Assignment:
    """:func:`assign_to` for a template table."""
    by = list(by)
    ws = Workspace(new.sparkSession)
    placed, _ = ws.save(
        assign_templates(new, clusters, threshold, mode=mode, metric=metric, by=by), "assigned"
    )
    rest = placed.where(F.col("cluster_id").isNull()).drop("cluster_id", "similarity")
    formed = cluster_templates(
        rest, threshold, mode=mode, metric=metric, by=by, word_filter=word_filter
    )
    last = clusters.last if isinstance(clusters, ClusterIndex) else clusters.agg(F.max("cluster_id")).head()[0]
    start = 0 if last is None else int(last) + 1
    shifted = formed.membership.withColumns(
        {c: F.col(c) + start for c in ("template_id", "cluster_id")}
    )
    return Assignment(
        placed.where(F.col("cluster_id").isNotNull()),
        Clustering(shifted, tuple(by), word_filter),
    )
