"""Log line clustering on Spark."""

from loomlog.analyze import Analysis, analyze, select_lines
from loomlog.operators.assign import assign_templates, assign_to
from loomlog.operators.cluster import Clustering, cluster, cluster_templates, similar_pairs
from loomlog.operators.filters import contains_any, filter_contains_any, filter_stats, input_stats
from loomlog.operators.index import ClusterIndex, open_index, save_index
from loomlog.operators.merge import ClusterSet, merge_clusters
from loomlog.operators.summary import (
    cluster_stats,
    members,
    ranked_clusters,
    rare_clusters,
    report,
    sources,
    top_clusters,
)
from loomlog.operators.templates import DistinctLines, distinct_lines, templates
from loomlog.streaming.placement import ClusterStore
from loomlog.streaming.template_counts import (
    cluster_by_window,
    counts_to_end,
    distinct_counts_stream,
    template_counts_stream,
)

__all__ = [
    "Analysis", "ClusterIndex", "ClusterSet", "ClusterStore", "Clustering", "DistinctLines", "analyze", "assign_templates", "assign_to",
    "cluster", "cluster_by_window", "cluster_stats", "cluster_templates", "contains_any", "counts_to_end",
    "distinct_counts_stream", "distinct_lines",
    "filter_contains_any", "filter_stats", "input_stats", "members", "merge_clusters", "open_index",
    "ranked_clusters", "rare_clusters", "report", "save_index", "select_lines", "similar_pairs", "sources",
    "template_counts_stream", "templates", "top_clusters",
]
