"""Exact set-similarity join over token tables.

Both sides are exploded to (key, token set) rows and meet in an equi-join on the
key (a large one in ``plans.overlap``), with the similarity test as the join condition, so a pair that fails is never
emitted, and one that shares several keys is tested under the first of them only. A key that many texts share is cut into blocks on both sides; each block
meets each block of the other side exactly once, in its own task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.similarity import length_bound
from loomlog.plans.overlap import GROUP, compare_sorted
from loomlog.plans.skew import hot_list
from loomlog.plans.tokens import MASKS, may_reach, no_rest_below, none_below, rest_mask, rest_place, score, with_lower_words
from loomlog.workspace import Workspace

# Rows of one key that a single task may hold from one side.
BLOCK_ROWS = 20_000
# Below this product of row counts no key can be worth splitting.
SMALL_PRODUCT = 50_000_000
# Candidates up to which rows are joined; more are compared with numpy, which takes Python workers.
PLAIN_PAIRS = 1_000_000
# Bytes of a join row without its wide tokens, and of one task's hash table.
ROW_BYTES, HASH_BYTES = 180, 64 << 20


@dataclass(frozen=True)
class Sizes:
    """What the join will touch, from counting keys only."""

    left_rows: int
    right_rows: int
    pairs: int
    largest: int


@dataclass(frozen=True)
class TokenTable:
    """Texts in join form (see ``tokens.with_join_keys``) with their number ``n``,
    None if unknown. ``wide``: some text has tokens outside a-z and space, or none
    at all; without such texts the comparison is plain bit counting. ``last`` is the largest id."""

    rows: DataFrame
    n: int | None
    wide: bool
    last: int = 0

    def part(self, rows: DataFrame, n: int | None = None) -> TokenTable:
        return replace(self, rows=rows, n=n)


def _payload(table: TokenTable, wide: bool, roles: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row per key, with the place ``p`` of its token; ``longer`` if the text takes
    the longer part of a pair under this key. Numbers are made free of nulls, which keeps null tests out of the join's code."""
    rest = ["rest", "h"] if wide else []
    rows = []
    for role in roles:
        key = F.explode(role).alias("_k")
        own = table.rows.select(key, "id", "b", "nbytes", *MASKS, *rest, *by)
        place = [F.coalesce(F.col(f"_k.{c}"), F.lit(0).cast("bigint")).alias(c) for c in ("k", "p")]
        numbers = [F.coalesce(c, F.lit(0).cast(own.schema[c].dataType)).alias(c) for c in ("id", "b", "nbytes", *MASKS)]
        rows.append(own.select(*place, F.lit(role == "long_keys").alias("longer"), *numbers, *rest, *by))
    return rows[0] if len(rows) == 1 else rows[0].unionAll(rows[1])


def _roles(self_join: bool) -> tuple[tuple[str, ...], tuple[str, ...]]:
    if self_join:
        return ("short_keys",), ("long_keys",)
    return ("short_keys", "long_keys"), ("long_keys", "short_keys")


def key_sizes(left: DataFrame, right: DataFrame, self_join: bool) -> DataFrame:
    """Rows per key on both sides: ``k, turn, nl, nr``, aggregated before the shuffle.
    ``turn`` tells the two ways apart in which left and right texts can meet."""
    parts = []
    for turn, roles in enumerate(zip(*_roles(self_join))):
        for side, role, rows in zip((1, 0), roles, (left, right)):
            parts.append(rows.select(F.explode(f"{role}.k").alias("k"), F.lit(turn).alias("turn"), F.lit(side).alias("l")))
    both = reduce(DataFrame.unionAll, parts)
    return both.groupBy("k", "turn").agg(F.sum("l").alias("nl"), F.sum(1 - F.col("l")).alias("nr"))


def join_sizes(sizes: DataFrame) -> Sizes:
    row = sizes.agg(
        F.sum("nl"),
        F.sum("nr"),
        F.sum(F.col("nl") * F.col("nr")),
        F.max(F.greatest("nl", "nr")),
    ).head()
    return Sizes(*(int(v or 0) for v in row))


def _split(rows: DataFrame, hot: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Give each row its own block number and one copy per block it must meet."""
    r = rows.join(hot, "k", "left")
    mine_n = F.coalesce(F.col(mine), F.lit(1))
    theirs_n = F.coalesce(F.col(theirs), F.lit(1))
    return (
        r.withColumn(mine, F.pmod(F.xxhash64("id"), mine_n).cast("int"))
        .withColumn(theirs, F.explode(F.sequence(F.lit(0), theirs_n - 1)))
        .withColumn(theirs, F.col(theirs).cast("int"))
    )


def similar_rows(
    left: TokenTable,
    right: TokenTable,
    threshold: float,
    metric: str,
    by: Sequence[str] = (),
    self_join: bool = False,
    left_first: bool = False,
    banded: bool = False,
) -> DataFrame:
    """Pairs ``left_id, right_id, similarity`` with similarity >= threshold; with ``banded`` keys (see
    ``tokens.with_band_keys``) those that share a key.

    In a self join each unordered pair appears once, the smaller id on the left.
    ``left_first`` keeps only pairs whose left id is the smaller. Joins known to be
    small skip the key count. Those with few candidates are plain joins, the others compare the rows of a key with numpy.
    """
    wide = left.wide or right.wide
    l_roles, r_roles = _roles(self_join)
    l, r = _payload(left, wide, l_roles, by), _payload(right, wide, r_roles, by)
    on = ["k", "p"]
    known = left.n is not None and right.n is not None
    hint, build_left = "shuffle_hash", known and left.n <= right.n
    large = not known or left.n * right.n > SMALL_PRODUCT
    if large:
        per_key = key_sizes(left.rows, right.rows, self_join)
        sizes = join_sizes(per_key)
        build_left = sizes.left_rows <= sizes.right_rows
        partitions = int(left.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the smaller side's average partition, and its largest key on top
        small = min(sizes.left_rows, sizes.right_rows) / partitions + min(sizes.largest, BLOCK_ROWS)
        if small * ROW_BYTES > HASH_BYTES:
            hint = "merge"
        if sizes.largest > BLOCK_ROWS:
            blocks = lambda n: F.greatest(F.max(F.ceil(F.col(n) / BLOCK_ROWS)).cast("int"), F.lit(1))
            hot = per_key.where(F.greatest("nl", "nr") > BLOCK_ROWS)
            hot = hot_list(hot.groupBy("k").agg(blocks("nl").alias("lb"), blocks("nr").alias("rb")))
            l, r = _split(l, hot, "lb", "rb"), _split(r, hot, "rb", "lb")
            on += ["lb", "rb"]
        if not banded and sizes.pairs > PLAIN_PAIRS:
            return _compared(l, r, threshold, metric, by, wide, self_join, left_first, max(partitions, left.rows.sparkSession.sparkContext.defaultParallelism))

    # the side that is not held in memory carries the words a second time, cut below the key
    cut = (lambda rows: rows) if banded else (lambda rows: with_lower_words(rows, "p"))
    if build_left:
        l, r = l.hint(hint), cut(r)
    else:
        l, r = cut(l), r.hint(hint)
    l, r = l.alias("l"), r.alias("r")
    same = reduce(and_, [F.col(f"l.{name}") == F.col(f"r.{name}") for name in on])
    if left_first:
        same = same & (F.col("l.id") < F.col("r.id"))
    side = None if banded else "r" if build_left else "l"
    close, value = _similar(threshold, metric, by, wide, self_join, side)
    ids = [F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id")]
    if self_join:
        ids = [F.least("l.id", "r.id").alias("left_id"), F.greatest("l.id", "r.id").alias("right_id")]
    pairs = l.join(r, same & close).select(*ids, value)
    return pairs.dropDuplicates(["left_id", "right_id"]) if banded else pairs


def _compared(
    l: DataFrame, r: DataFrame, threshold: float, metric: str, by: Sequence[str], wide: bool, self_join: bool, left_first: bool, partitions: int
) -> DataFrame:
    """The pairs of a large join: the rows of both sides are brought together by key and compared there (see ``plans.overlap``)."""

    def side(rows: DataFrame, number: int) -> DataFrame:
        turn = F.col("longer") if number == 0 else ~F.col("longer")
        blocks = [F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in ("lb", "rb")]
        rest = ["h", F.size("rest").alias("n_rest"), "rest", F.transform("rest", rest_place).alias("places")] if wide else []
        group = [F.to_json(F.array(*[F.col(c).cast("string") for c in by])).alias("g")] if by else []
        return rows.select("k", "p", turn.cast("int").alias("turn"), *blocks, F.lit(number).alias("side"), "id", "b", "nbytes", *MASKS, *rest, *group)

    both = side(l, 0).unionAll(side(r, 1)).repartition(partitions, "k", "lb", "rb").sortWithinPartitions(*GROUP, "b")
    compare = compare_sorted(threshold, metric, wide, self_join, left_first, bool(by))
    return both.mapInArrow(compare, "left_id bigint, right_id bigint, similarity double")


def _same_group(name: str) -> Column:
    """Equal or both null, in a form that Spark does not take for a key of the join, which would have to be part of the layout."""
    l, r = F.col(f"l.{name}"), F.col(f"r.{name}")
    return F.coalesce(F.array_contains(F.array(l), r), l.isNull() & r.isNull())


def _similar(
    threshold: float, metric: str, by: Sequence[str], wide: bool, self_join: bool, cut: str | None, laid_out: bool = False
) -> tuple[Column, Column]:
    """What rows of one key aliased ``l`` and ``r`` must fulfil to be a pair, cheap tests first, and their ``similarity``.
    ``cut`` is the side with the lower words, if any, ``laid_out`` tells that the rows lie in buckets of the key alone.

    With ``wide`` the condition is made of numbers and lets some pairs too many pass; the arrays are compared after
    the join, in a generator, which Catalyst does not move into the condition: the join stays small enough to be compiled.
    """
    cond = F.lit(True)
    for name in by:
        cond = cond & (_same_group(name) if laid_out else F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")))
    if self_join:
        shorter = F.col("l.b") < F.col("r.b")
        cond = cond & (shorter | ((F.col("l.b") == F.col("r.b")) & (F.col("l.id") < F.col("r.id"))))
    else:
        # the pair meets in one turn only: the left text is the longer one, or it is not
        cond = cond & (F.col("l.longer") != F.col("r.longer"))
        cond = cond & (F.col("l.longer") == (F.col("l.b") > F.col("r.b")))
    if metric == "dice_bigrams":
        ratio = F.least("l.nbytes", "r.nbytes").cast("double") / F.greatest("l.nbytes", "r.nbytes")
        cond = cond & (ratio >= F.lit(length_bound(threshold)))
    # a pair is looked at under the first token that it shares, so it comes out once
    other = "l" if cut == "r" else "r"
    if cut is not None:
        cond = cond & none_below(cut, other)
    value = score("l", "r", wide)
    if not wide:
        return cond & (value >= F.lit(threshold)), value.alias("similarity")
    first = no_rest_below(cut, other) if cut is not None else F.lit(True)
    exact = F.filter(F.array(value), lambda v: (v >= F.lit(threshold)) & first)
    return cond & may_reach("l", "r", threshold), F.explode(exact).alias("similarity")


@dataclass(frozen=True)
class KeyIndex:
    """One side of a join with its keys laid out once: ``rows`` is a table in buckets of ``k`` with a row per key of a
    text, which also has its ``id`` (its rank) and ``cluster_id``; ``hot`` lists keys of more than BLOCK_ROWS rows
    with their number ``nl``. Other texts are compared through the same ``order`` of tokens."""

    rows: DataFrame
    hot: DataFrame
    order: tuple[int, ...]
    threshold: float
    metric: str
    by: tuple[str, ...]
    wide: bool


def index_rows(table: TokenTable, by: Sequence[str], extra: DataFrame) -> DataFrame:
    """The rows of a :class:`KeyIndex`, with the columns of ``extra`` by ``id``."""
    keyed = _payload(table, True, _roles(False)[0], by)
    return keyed.join(extra, "id")


def probe(index: KeyIndex, right: TokenTable) -> DataFrame:
    """Pairs ``left_id, cluster_id, right_id, similarity`` of indexed texts and those of ``right``.

    Only rows of ``right`` are shuffled, to the buckets; a key that is hot on either side is taken out and cut into blocks on
    both sides, as in :func:`similar_rows`.
    """
    wide, by = index.wide or right.wide, list(index.by)
    r = _payload(right, wide, _roles(False)[1], by)
    count = r.groupBy("k").agg(F.count(F.lit(1)).alias("nr")).join(index.hot, "k", "left")
    blocks = lambda n: F.greatest(F.ceil(F.coalesce(F.col(n), F.lit(1)) / BLOCK_ROWS).cast("int"), F.lit(1))
    hot = count.where((F.col("nr") > BLOCK_ROWS) | F.col("nl").isNotNull()).select("k", blocks("nl").alias("lb"), blocks("nr").alias("rb"))
    hot, seen = Workspace(right.rows.sparkSession).save(hot, "hot-keys")
    rows = index.rows if "h" in index.rows.columns else index.rows.withColumn("h", rest_mask())

    def pairs(l: DataFrame, r: DataFrame, blocked: Sequence[str]) -> DataFrame:
        l, r = l.alias("l"), with_lower_words(r, "p").alias("r")
        # a difference, as an equality of places would have to be part of the layout
        same = (F.col("l.k") == F.col("r.k")) & ((F.col("l.p") - F.col("r.p")) == 0)
        for name in blocked:
            same = same & (F.col(f"l.{name}") == F.col(f"r.{name}"))
        close, value = _similar(index.threshold, index.metric, by, wide, False, "r", True)
        found = l.join(r.hint("merge" if blocked else "shuffle_hash"), same & close)
        return found.select(F.col("l.id").alias("left_id"), F.col("l.cluster_id").alias("cluster_id"), F.col("r.id").alias("right_id"), value)

    if not seen["rows"]:
        return pairs(rows, r, ())
    hot = hot_list(hot)
    cold = pairs(rows, r.join(hot.select("k"), "k", "left_anti"), ())
    chosen = rows.join(hot.select("k"), "k", "left_semi")
    return cold.unionAll(pairs(_split(chosen, hot, "lb", "rb"), _split(r.join(hot.select("k"), "k", "left_semi"), hot, "rb", "lb"), ("lb", "rb")))
