"""Line filters and input statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(line: Column | str, terms: Sequence[str]) -> Column:
    """True if the line holds any term, ignoring case. No terms keep everything."""
    if not terms:
        return F.lit(True)
    line = F.col(line) if isinstance(line, str) else line
    # one element, so that the line is built and lowered once for all terms
    lowered = F.array(F.lower(line))
    return F.exists(lowered, lambda x: reduce(or_, [F.contains(x, F.lower(F.lit(t))) for t in terms]))


def filter_contains_any(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    return df.where(contains_any("line", terms)) if terms else df


def filter_stats(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``before, after, percent_retained`` of the filter, in one pass."""
    kept = F.count_if(contains_any("line", terms))
    return df.agg(F.count(F.lit(1)).alias("before"), kept.alias("after")).withColumn(
        "percent_retained",
        F.when(F.col("before") == 0, F.lit(0.0)).otherwise(F.col("after") / F.col("before") * 100.0),
    )


def input_stats(df: DataFrame) -> DataFrame:
    """``lines`` and the UTF-8 ``bytes`` in them."""
    return df.agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("bytes"),
    )
