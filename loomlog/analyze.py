"""One call from log lines to clusters, with every selection as an argument."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame

from loomlog.operators.cluster import Clustering, cluster
from loomlog.operators.filters import filter_contains_any
from loomlog.sources.logs import ERROR_SCHEMA, filter_labels, filter_namespace, filter_since, ingest_errors


class Analysis(NamedTuple):
    """A clustering, the lines it was made of (which ``sources`` and ``report`` take as
    input), and error rows, which ``write_json`` takes."""

    clustering: Clustering
    lines: DataFrame
    errors: DataFrame


def select_lines(
    df: DataFrame,
    *,
    namespace: str | None = None,
    label: str | None = None,
    pods: DataFrame | None = None,
    since: str | None = None,
    now: datetime | None = None,
    contains: Sequence[str] = (),
) -> DataFrame:
    """Apply namespace, time, label and text selections, cheapest first."""
    out = filter_since(filter_namespace(df, namespace), since, now)
    if label is not None:
        if pods is None:
            raise ValueError("a label selection needs the pods relation")
        out = filter_labels(out, filter_namespace(pods, namespace), label)
    return filter_contains_any(out, contains)


def analyze(
    df: DataFrame,
    threshold: float = 0.9,
    *,
    word_filter: bool = True,
    mode: str = "first",
    metric: str = "dice_bigrams",
    by: Sequence[str] = (),
    expected: DataFrame | None = None,
    errors: DataFrame | None = None,
    **selection,
) -> Analysis:
    """Select lines and cluster them.

    ``errors`` are error rows of reading the lines; sources of ``expected`` without any
    line in ``df`` are added to them.
    """
    lines = select_lines(df, **selection)
    result = cluster(lines, threshold, mode=mode, metric=metric, by=by, word_filter=word_filter)
    found = errors if errors is not None else df.sparkSession.createDataFrame([], ERROR_SCHEMA)
    if expected is not None:
        found = found.select(*ERROR_SCHEMA.names).unionAll(ingest_errors(expected, df, selection.get("now")))
    return Analysis(result, lines, found)
