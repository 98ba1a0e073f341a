"""Clustering of log lines by template similarity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import template_words
from loomlog.operators.templates import DistinctLines, as_lines, distinct_lines, rank_order, templates_of
from loomlog.plans.leaders import cluster_ranked, rank, save_comparable, token_sets
from loomlog.plans.simjoin import similar_rows
from loomlog.plans.tokens import check_metric, check_threshold, token_order, with_band_keys, with_join_keys
from loomlog.workspace import Workspace

MODES = ("first", "best")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return mode


@dataclass(frozen=True)
class Clustering:
    """A finished clustering.

    ``membership`` has one row per template: ``by, template_id, cluster_id,
    similarity, normalized_text, count, occurrences, representative``. It is a
    written table, so deriving several results from it does not repeat the work.
    ``lines`` are the distinct lines that were clustered, written too, if the clustering began with lines.
    """

    membership: DataFrame
    by: tuple[str, ...] = ()
    word_filter: bool = True
    lines: DistinctLines | None = None

    @property
    def clusters(self) -> DataFrame:
        """One row per cluster: ``by, cluster_id, representative,
        normalized_text, words, count, occurrences, n_templates``.

        Text columns are the leader's; counts are sums over its templates, exact
        because a line has one template.
        """
        leader = F.when(
            F.col("template_id") == F.col("cluster_id"), F.struct("representative", "normalized_text")
        )
        return (
            self.membership.groupBy(*self.by, "cluster_id")
            .agg(
                F.max(leader).alias("_leader"),
                F.sum("count").alias("count"),
                F.sum("occurrences").alias("occurrences"),
                F.count(F.lit(1)).alias("n_templates"),
            )
            .select(
                *self.by,
                "cluster_id",
                "_leader.representative",
                "_leader.normalized_text",
                template_words("_leader.normalized_text").alias("words"),
                "count",
                "occurrences",
                "n_templates",
            )
        )


def similar_pairs(
    df: DataFrame,
    threshold: float,
    text: str = "normalized_text",
    metric: str = "dice_bigrams",
    by: Sequence[str] = (),
    bands: int = 0,
    band_width: int = 2,
) -> DataFrame:
    """All pairs of distinct texts with similarity >= threshold.

    Returns ``by, left_text, right_text, similarity`` with ``left_text <
    right_text``. Exact, whatever the threshold; the output itself can be
    quadratic inside a family of near-identical texts, which ``cluster`` avoids.

    With ``bands`` candidates are pairs that share one of so many bands of ``band_width`` minimum hashes; what
    is returned is verified exactly, but a pair at the threshold t is missed with probability
    (1 - (t / (2 - t)) ** band_width) ** bands at most: 1 % at 0.75 with ten bands of two.
    """
    threshold, metric, by = check_threshold(threshold), check_metric(metric), list(by)
    ws = Workspace(df.sparkSession)
    texts, n = rank(ws, df.select(*by, text).distinct().orderBy(text, *by))
    tokens = token_sets(ws, texts, n, text, metric, by, threshold)
    order = token_order(tokens)
    keyed = with_band_keys(tokens, threshold, order, by, bands, band_width) if bands else with_join_keys(tokens, threshold, order, by)
    table = save_comparable(ws, keyed, "tokens")
    pairs = similar_rows(table, table, threshold, metric, by, self_join=True, banded=bands > 0)
    left = texts.select(F.col("id").alias("left_id"), F.col(text).alias("left_text"), *by)
    right = texts.select(F.col("id").alias("right_id"), F.col(text).alias("right_text"))
    return (
        pairs.join(left, "left_id")
        .join(right, "right_id")
        .select(*by, "left_text", "right_text", "similarity")
    )


def cluster_templates(
    df: DataFrame,
    threshold: float = 0.9,
    *,
    mode: str = "first",
    metric: str = "dice_bigrams",
    by: Sequence[str] = (),
    word_filter: bool = True,
) -> Clustering:
    """Cluster a template table (see ``templates``)."""
    threshold, metric = check_threshold(threshold), check_metric(metric)
    check_mode(mode)
    by = list(by)
    loop = Workspace(df.sparkSession)
    ranked, n = rank(loop, df.orderBy(*rank_order(by)))
    led = cluster_ranked(loop, ranked, n, "normalized_text", threshold, metric, by, mode)
    rest = [c for c in df.columns if c not in by]
    membership, _ = Workspace(df.sparkSession).save(
        led.select(*by, F.col("id").alias("template_id"), "cluster_id", "similarity", *rest), "membership"
    )
    loop.close()  # tokens, edges and rounds are not needed any more
    return Clustering(membership, tuple(by), word_filter)


def cluster(
    df: DataFrame | DistinctLines,
    threshold: float = 0.9,
    *,
    mode: str = "first",
    metric: str = "dice_bigrams",
    by: Sequence[str] = (),
    word_filter: bool = True,
) -> Clustering:
    """Cluster log lines (``line`` plus the ``by`` columns, ``ts`` if present).

    Lines are collapsed to templates; in order of distinct-line count each
    template joins an earlier leader with similarity >= threshold, the first
    (``mode="first"``) or the most similar (``"best"``), or becomes a leader.
    Lines without a word are left out. ``by`` clusters each group on its own. The raw lines are read
    once; their distinct lines are written and kept in the result.
    """
    check_threshold(threshold), check_metric(metric), check_mode(mode)
    if isinstance(df, DistinctLines):
        as_lines(df, word_filter, by)
        lines = df
    else:
        made = distinct_lines(df, word_filter, by)
        lines = made.kept(Workspace(df.sparkSession).save(made.df, "lines")[0])
    result = cluster_templates(
        templates_of(lines.df, lines.by), threshold, mode=mode, metric=metric, by=by, word_filter=word_filter
    )
    return replace(result, lines=lines)
