"""Pairwise text similarity as column expressions.

These are the definitions. The similarity join in ``plans.simjoin`` evaluates the
same formulas on pre-computed token sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.functions.text import bigrams

# Fixed values of the composite similarity.
CHAR_CHECK_MIN_BYTES = 15
CHAR_CHECK_FACTOR = 0.75


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def length_bound(threshold: float) -> float:
    """Smallest min/max length ratio two texts of that similarity can have."""
    return threshold / (2.0 - threshold)


def length_ratio(a: Column | str, b: Column | str) -> Column:
    """min / max of the UTF-8 byte lengths."""
    a, b = F.octet_length(_col(a)), F.octet_length(_col(b))
    return F.least(a, b).cast("double") / F.greatest(a, b)


def dice_bigrams(a: Column | str, b: Column | str) -> Column:
    """2 |set(A) & set(B)| / (len(A) + len(B)) over bigram lists A and B.

    The numerator counts distinct shared bigrams and the denominator all of
    them, so a text that repeats bigrams scores below 1 against near copies.
    """

    def score(p: Column) -> Column:
        na, nb = F.size(p.a), F.size(p.b)
        shared = F.size(F.array_intersect(p.a, p.b))
        return (
            F.when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(F.lit(2.0) * shared / (na + nb))
        )

    return _let(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")), score)


def dice_chars(a: Column | str, b: Column | str) -> Column:
    """Sorensen-Dice over the characters of both texts as multisets."""
    a, b = _col(a), _col(b)

    def count(text: Column, ch: Column) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, ch, F.lit("")))

    chars = F.array_distinct(F.split(a, ""))
    common = F.aggregate(chars, F.lit(0), lambda s, c: s + F.least(count(a, c), count(b, c)))
    total = F.char_length(a) + F.char_length(b)
    return (
        F.when(total == 0, F.lit(1.0))
        .when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * common / total)
    )


def char_overlap(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Cheap necessary test: character overlap of at least 0.75 x threshold."""
    return dice_chars(a, b) >= F.lit(threshold * CHAR_CHECK_FACTOR)


def similarity(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Bigram similarity with early rejections that depend on the threshold."""
    a, b = _col(a), _col(b)
    both_long = (F.octet_length(a) > CHAR_CHECK_MIN_BYTES) & (
        F.octet_length(b) > CHAR_CHECK_MIN_BYTES
    )
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .when(length_ratio(a, b) < F.lit(length_bound(threshold)), F.lit(0.0))
        .when(both_long & ~char_overlap(a, b, threshold), F.lit(0.0))
        .otherwise(dice_bigrams(a, b))
    )
