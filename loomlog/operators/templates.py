"""Collapse raw lines to distinct lines and distinct templates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import with_template


def _grouping(df: DataFrame, by: Sequence[str]) -> list[str]:
    missing = [c for c in ("line", *by) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return list(by)


@dataclass(frozen=True)
class DistinctLines:
    """Distinct raw lines that hold a word, as ``df``: ``by, line, occurrences[, first_ts],
    normalized_text``, and how they were made. Write ``df`` once to cluster the lines
    and list members without reading the raw lines again (see ``kept``)."""

    df: DataFrame
    by: tuple[str, ...] = ()
    word_filter: bool = True

    def kept(self, df: DataFrame) -> DistinctLines:
        """The same lines out of another relation, such as a written copy."""
        return replace(self, df=df)


def distinct_lines(df: DataFrame, word_filter: bool = True, by: Sequence[str] = ()) -> DistinctLines:
    """The distinct lines of ``df``.

    One shuffle of bare lines, pre-aggregated per partition; the tokenizer runs
    after it, once per distinct line. A line repeated billions of times arrives as
    one row per map task.
    """
    by = _grouping(df, by)
    aggs = [F.count(F.lit(1)).alias("occurrences")]
    if "ts" in df.columns:
        aggs.append(F.min("ts").alias("first_ts"))
    return DistinctLines(with_template(df.groupBy(*by, "line").agg(*aggs), word_filter), tuple(by), word_filter)


def as_lines(lines: DataFrame | DistinctLines, word_filter: bool, by: Sequence[str]) -> DataFrame:
    """The distinct lines of raw lines, or of :class:`DistinctLines` that were made the same way."""
    if not isinstance(lines, DistinctLines):
        return distinct_lines(lines, word_filter, by).df
    if lines.word_filter != word_filter or lines.by != tuple(by):
        raise ValueError(
            f"distinct lines with word_filter={lines.word_filter}, by={list(lines.by)} cannot be used "
            f"with word_filter={word_filter}, by={list(by)}"
        )
    return lines.df


def templates_of(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Templates of distinct lines: ``by, normalized_text, count,
    occurrences, representative``.

    ``count`` is the number of distinct lines, a plain count because the lines are
    distinct already. The representative is the earliest line if there is a
    timestamp, else the smallest.
    """
    order = F.struct(F.col("first_ts").isNull(), "first_ts", "line") if "first_ts" in lines.columns else None
    first = F.min_by("line", order) if order is not None else F.min("line")
    return lines.groupBy(*by, "normalized_text").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("occurrences").alias("occurrences"),
        first.alias("representative"),
    )


def templates(df: DataFrame | DistinctLines, word_filter: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct template text of the lines in ``df``, raw or distinct
    (see :func:`as_lines`)."""
    return templates_of(as_lines(df, word_filter, by), by)


def rank_order(by: Sequence[str] = ()) -> list:
    """Priority of templates: most distinct lines first, then by text."""
    return [F.desc("count"), F.asc("normalized_text"), *[F.asc(c) for c in by]]
