"""Token sets of template texts, in the form the similarity join compares.

A text becomes a set of tokens: its character bigrams (``dice_bigrams``) or its
numbered characters (``dice_chars``; the second "e" is the token ("e", 2), which
turns the multiset overlap into a set overlap). Tokens made of a-z and space have
a fixed slot in 0..728, so a set is twelve BIGINT bit words and an overlap is
twelve ``bit_count(x & y)``. Any other token is kept as text in ``rest``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import bigrams

ALPHABET = " abcdefghijklmnopqrstuvwxyz"
BASE = len(ALPHABET)
SLOTS = BASE * BASE
MASKS = [f"m{i}" for i in range(math.ceil(SLOTS / 64))]
LOWER = [f"c{i}" for i in range(len(MASKS))]
METRICS = ("dice_bigrams", "dice_chars")
# Characters whose pairs are sorted at a time, 8 bytes each.
PAIR_CHARS = 2_000_000

# Only pruning bounds get this tolerance; the final comparison gets none.
EPS = 1e-9


def check_threshold(threshold: float) -> float:
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")
    return float(threshold)


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    return metric


def _code(ch: Column) -> Column:
    a = F.ascii(ch)
    return F.when(a == 32, 0).when(a.between(97, 122), a - 96).otherwise(-1)


def _bigram_tokens(df: DataFrame, text: str) -> DataFrame:
    pair = F.zip_with(
        F.slice("_codes", F.lit(1), F.size("_codes") - 1),
        F.slice("_codes", F.lit(2), F.size("_codes") - 1),
        lambda a, b: F.when((a >= 0) & (b >= 0), a * BASE + b).otherwise(-1),
    )
    wide = F.array_contains("_slots", -1) | (F.char_length(text) < 2)
    other = F.when(F.octet_length(text) < 2, F.array(text)).otherwise(
        F.array_distinct(F.filter(bigrams(text), lambda g: g.rlike("[^a-z ]")))
    )
    return (
        df.withColumn("_codes", F.transform(F.split(text, ""), _code))
        .withColumn("_slots", F.array_distinct(F.when(F.char_length(text) < 2, F.array()).otherwise(pair)))
        .withColumn("rest", F.when(wide, other).otherwise(F.array().cast("array<string>")))
        .withColumn("slots", F.array_remove("_slots", -1))
        .withColumn("b", F.when(F.octet_length(text) < 2, 1).otherwise(F.char_length(text) - 1))
        .drop("_codes", "_slots")
    )


def _char_tokens(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)

    def count(ch: Column) -> Column:
        return F.char_length(t) - F.char_length(F.replace(t, ch, F.lit("")))

    def upto(n: Column, first: int) -> Column:
        return F.when(n >= first, F.sequence(F.lit(first), n)).otherwise(F.array())

    known = F.array(*[upto(F.least(count(F.lit(c)), F.lit(BASE)), 1) for c in ALPHABET])
    slots = F.flatten(F.transform(known, lambda ks, c: F.transform(ks, lambda k: (k - 1) * BASE + c)))

    def numbered(ch: Column) -> Column:
        first = F.when(_code(ch) >= 0, F.lit(BASE + 1)).otherwise(F.lit(1))
        n = count(ch)
        ks = F.when(n >= first, F.sequence(first, n)).otherwise(F.array())
        return F.transform(ks, lambda k: F.concat(ch, k.cast("string")))

    others = F.flatten(F.transform(F.array_distinct(F.split(t, "")), numbered))
    return (
        df.withColumn("slots", slots)
        .withColumn("rest", F.when(F.size("slots") == F.char_length(t), F.array().cast("array<string>")).otherwise(others))
        .withColumn("b", F.char_length(t))
    )


def with_tokens(df: DataFrame, text: str, metric: str) -> DataFrame:
    """Add ``slots``, ``rest``, the token list length ``b``, the set size ``s``
    and the byte length ``nbytes``."""
    out = (_bigram_tokens if metric == "dice_bigrams" else _char_tokens)(df, text)
    return out.withColumn("s", F.size("slots") + F.size("rest")).withColumn(
        "nbytes", F.octet_length(text)
    )


def count_pairs(texts: pa.Array) -> pa.Array:
    """Distinct adjacent character pairs of each text, by sorting the pairs of many texts at once."""
    out, held, size = [], [], 0

    def flush() -> None:
        units = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
        met = np.zeros(0x110000, bool)
        met[units] = True
        n = int(met.sum())
        number = (np.cumsum(met) - 1)[units]  # few characters are met, so text and pair fit in 63 bits
        owner = np.repeat(np.arange(len(held)), [len(t) for t in held])
        pair = ((owner[:-1] * n + number[:-1]) * n + number[1:])[owner[:-1] == owner[1:]]
        pair.sort()
        new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        out.append(np.bincount(pair[new] // max(n * n, 1), minlength=len(held)))

    for text in texts.to_pylist():
        held.append(text or "")
        size += len(held[-1])
        if size > PAIR_CHARS:
            flush()
            held, size = [], 0
    if held:
        flush()
    return pa.array(np.concatenate(out) if out else [], pa.int32())


def can_match(df: DataFrame, text: str, metric: str, threshold: float) -> DataFrame:
    """The rows of ``df`` that can reach the threshold with some other text: a long text repeats its pairs, and what
    counts is distinct pairs against all. Counting them is a small part of making the token sets."""
    if metric != "dice_bigrams":
        return df
    pairs = F.arrow_udf(count_pairs, "int")
    b = F.char_length(text) - 1
    return df.withColumn("_n", pairs(text)).where((b < 1) | (F.col("_n") >= required_overlap(threshold, b, False))).drop("_n")


def token_order(df: DataFrame) -> list[int]:
    """Position of each slot when slots are ordered rarest first.

    At most 729 rows reach the driver: the count of slots, not of texts.
    """
    # exploding a bare column would add a size filter that tokenizes a second time
    slot = F.explode(F.filter("slots", lambda x: x >= 0)).alias("slot")
    seen = dict(df.select(slot).groupBy("slot").agg(F.count(F.lit(1))).collect())
    ranked = sorted(range(SLOTS), key=lambda slot: (seen.get(slot, 0), slot))
    order = [0] * SLOTS
    for position, slot in enumerate(ranked):
        order[slot] = position
    return order


def required_overlap(threshold: float, b: Column, partner_longer: bool) -> Column:
    """Fewest shared tokens a text of list length ``b`` needs with any partner
    that is at least as long (or, else, at most as long)."""
    bound = threshold * b if partner_longer else threshold * b / (2.0 - threshold)
    return F.ceil(bound - EPS).cast("int")


def _masks() -> Column:
    """The slots as an array of bit words, the rarest slot in the lowest bit."""

    def word(i: Column) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % 64).cast("int"))
        return F.aggregate(
            F.filter("_ranked", lambda x: F.floor(x / 64) == i),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc.bitwiseOR(bit(x)),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), word)


def _length_bucket(threshold: float) -> Column:
    """Texts whose length ratio can reach the threshold are at most one apart."""
    width = max(math.log((2.0 - threshold) / threshold) * (1 + EPS), 1e-6)
    return F.floor(F.log(F.greatest(F.col("b"), F.lit(1)).cast("double")) / F.lit(width))


def with_join_keys(
    df: DataFrame, threshold: float, order: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Add the bit words and the prefix-filter keys of both join roles.

    Tokens are put in one global order, rarest first, and a text is indexed under
    its first few tokens only; two texts that share enough tokens must share one
    of those (prefix filtering: Chaudhuri et al. 2006, Xiao et al. 2008). In a
    pair the shorter text uses ``short_keys`` and the longer ``long_keys``: a text
    whose partner is no shorter needs more overlap, hence fewer keys. A key also
    holds the length bucket and the group columns, and comes with the place ``p`` of
    its token in the order. Empty arrays mean the text cannot match any other text in
    that role.
    """
    position = F.expr(f"array({','.join(map(str, order))})")
    ranked = F.array_sort(
        F.concat(
            F.transform("rest", rest_place),
            F.transform("slots", lambda x: F.element_at(position, x + 1).cast("bigint")),
        )
    )

    def prefix(partner_longer: bool) -> Column:
        n = F.col("s") - required_overlap(threshold, F.col("b"), partner_longer) + 1
        # texts without any token all match each other: one common key
        return F.when(F.col("b") == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(
            F.slice("_ranked", F.lit(1), F.greatest(n, F.lit(0)))
        )

    def keys(tokens: str, bucket: Column) -> Column:
        return F.transform(
            tokens, lambda tok: F.struct(F.xxhash64(*by, bucket, tok).alias("k"), tok.alias("p"))
        )

    g = F.col("_g")
    kept = [F.col(c) for c in df.columns if c != "slots"]
    staged = df.withColumns({"_ranked": ranked, "_g": _length_bucket(threshold)})
    staged = staged.withColumns({"_short": prefix(True), "_long": prefix(False), "_masks": _masks()})
    return staged.select(
        *kept,
        keys("_short", g).alias("short_keys"),
        F.concat(keys("_long", g), keys("_long", g - 1)).alias("long_keys"),
        rest_mask().alias("h"),
        *[F.col("_masks")[i].alias(name) for i, name in enumerate(MASKS)],
    )


def with_band_keys(df: DataFrame, threshold: float, order: Sequence[int], by: Sequence[str], bands: int, width: int) -> DataFrame:
    """As :func:`with_join_keys`, with keys that similar texts share with high probability only: a hash of ``width``
    minimum hashes of the token set for each of ``bands``.

    A pair at the threshold t shares at least t / (2 - t) of its tokens (as list lengths are no less than set sizes), so it
    shares a band with probability 1 - (1 - (t / (2 - t)) ** width) ** bands or more.
    """
    tokens = F.concat(F.transform("rest", lambda x: F.xxhash64(x)), F.transform("slots", lambda x: F.xxhash64(x)))

    def band(i: int) -> Column:
        least = [F.array_min(F.transform("_tokens", lambda x: F.xxhash64(x, F.lit(i * width + j)))) for j in range(width)]  # noqa: B023
        return F.struct(F.xxhash64(*by, F.lit(i), *least).alias("k"), F.lit(i).cast("bigint").alias("p"))

    # texts without any token share all bands; a text that is too poor in tokens for any partner has none
    enough = (F.col("s") >= required_overlap(threshold, F.col("b"), False)) | (F.col("b") == 0)
    none = F.expr("cast(array() as array<struct<k: bigint, p: bigint>>)")
    keys = F.when(enough, F.array(*[band(i) for i in range(bands)])).otherwise(none)
    masks = with_join_keys(df, threshold, order, by).drop("short_keys", "long_keys")
    hashed = df.select("id", tokens.alias("_tokens"), "s", "b", *by).select("id", keys.alias("short_keys"))
    return masks.join(hashed, "id").withColumn("long_keys", F.col("short_keys"))


def with_lower_words(rows: DataFrame, place: str) -> DataFrame:
    """Add the bit words cut to the slots before ``place``."""
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("_q")))  # shifts by _q modulo 64
    cut = {
        name: F.when(F.col("_q") >= 64 * (i + 1), F.col(m)).when(F.col("_q") > 64 * i, F.col(m).bitwiseAND(below)).otherwise(zero)
        for i, (name, m, zero) in enumerate(zip(LOWER, MASKS, [F.lit(0).cast("bigint")] * len(MASKS)))
    }
    bounded = F.least(F.greatest(F.col(place), F.lit(0).cast("bigint")), F.lit(64 * len(MASKS)).cast("bigint"))
    return rows.withColumn("_q", bounded.cast("int")).withColumns(cut).drop("_q")


def none_below(cut: str, other: str) -> Column:
    """Whether two aliased rows share no slot before the key that ``cut`` (see :func:`with_lower_words`) is looked at under.

    Both prefixes hold all tokens before their own last one, so the first token that
    two prefixes share is the first that the texts share.
    """
    shared = [F.col(f"{cut}.{c}").bitwiseAND(F.col(f"{other}.{m}")) for c, m in zip(LOWER, MASKS)]
    return reduce(lambda x, y: x.bitwiseOR(y), shared) == 0


def no_rest_below(cut: str, other: str) -> Column:
    """The same of tokens without a slot."""
    l_rest, r_rest = F.col(f"{cut}.rest"), F.col(f"{other}.rest")
    earlier = F.exists(F.array_intersect(l_rest, r_rest), lambda t: rest_place(t) < F.col(f"{cut}.p"))
    return (F.size(l_rest) == 0) | (F.size(r_rest) == 0) | ~earlier


def rest_place(token: Column) -> Column:
    """Tokens without a slot come before all slots, in the order of their hashes."""
    return -1 - F.xxhash64(token).bitwiseAND((1 << 62) - 1)


def rest_mask() -> Column:
    """A bit word of the hashes of the tokens without a slot."""
    return F.aggregate(
        "rest",
        F.lit(0).cast("bigint"),
        lambda acc, t: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))),
    )


def shared_slots(left: str, right: str) -> Column:
    return reduce(add, [F.bit_count(F.col(f"{left}.{m}").bitwiseAND(F.col(f"{right}.{m}"))) for m in MASKS])


def may_reach(left: str, right: str, threshold: float) -> Column:
    """Whether two aliased rows can have that score, from numbers alone: a bit that only one text's ``h`` has stands for
    a token that the other text lacks."""

    def most(a: str, b: str) -> Column:
        return F.size(f"{a}.rest") - F.bit_count(F.col(f"{a}.h").bitwiseAND(F.bitwise_not(F.col(f"{b}.h"))))

    shared = shared_slots(left, right) + F.least(most(left, right), most(right, left))
    return F.lit(2.0) * shared >= F.lit(threshold) * (F.col(f"{left}.b") + F.col(f"{right}.b")) - F.lit(EPS)


def overlap(left: str, right: str, wide: bool) -> Column:
    """Shared tokens of two aliased rows; ``wide`` if any row has ``rest`` tokens."""
    bits = shared_slots(left, right)
    if not wide:
        return bits
    l_rest, r_rest = F.col(f"{left}.rest"), F.col(f"{right}.rest")
    return bits + F.when(
        (F.size(l_rest) > 0) & (F.size(r_rest) > 0), F.size(F.array_intersect(l_rest, r_rest))
    ).otherwise(0)


def score(left: str, right: str, wide: bool) -> Column:
    """The metric's value for two aliased rows, as 2.0 * shared / (b1 + b2) in
    doubles. Only texts of wide characters can have an empty token list."""
    lb, rb = F.col(f"{left}.b"), F.col(f"{right}.b")
    value = F.lit(2.0) * overlap(left, right, wide) / (lb + rb)
    if not wide:
        return value
    return (
        F.when((lb == 0) & (rb == 0), F.lit(1.0)).when((lb == 0) | (rb == 0), F.lit(0.0)).otherwise(value)
    )
