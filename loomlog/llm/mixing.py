"""Mixing sources to target weights by hierarchical budgets (operator 8, DataFrame functions only).

A token budget flows down a tree of domains, languages and sources. A node's budget is
shared among its children by weight, but none gets more than its leaves can give; what
it cannot take goes to its siblings by their weights, and only what no sibling can take
is left to the ancestors' siblings, since a node's own limit is that of all its leaves. A leaf gives its
documents in seeded epochs: whole passes as long as its budget lasts, then the prefix of one
more pass in an order that the seed and the pass set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import unused
from loomlog.workspace import Workspace

#: Leaves up to which their budgets are broadcast; above, the join is shuffled and AQE splits hot leaves.
BROADCAST_LEAVES = 10_000
#: Hexadecimal digits of the order hash that cut a leaf into ranges.
RANGE_DIGITS = 3
#: What a null level of the tree is called.
NONE = "(none)"


def word_count(text: str | Column) -> Column:
    """Runs of characters other than \\x20 and \\x09-\\x0D; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(level: int, weights: Mapping[str, int]) -> Column:
    w = F.lit(1).cast("long")
    for name, value in sorted(weights.items()):
        w = F.when(F.col(f"l{level}") == name, F.lit(int(value)).cast("long")).otherwise(w)
    return w


def _share(nodes: DataFrame, parent: Sequence[str], budget: str) -> DataFrame:
    """Split each parent's ``budget`` among its children (``w``, ``cap``) as ``own``.

    By ``cap / w`` the children come in the order in which they run out while the level
    rises. A child is full if, with all before it full, the rest of the budget shared by weight reaches its cap.
    """
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of tokens and weights pass 64 bits
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), "w", "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    nodes = nodes.withColumn("_rest", rest).withColumn("_w", F.sum("w").over(after))
    nodes = nodes.withColumn("_full", wide(F.col("cap")) * wide(F.col("_w")) <= wide(F.col("_rest")) * wide(F.col("w")))
    # the children that are not full share what the full ones leave: the first of them has the largest _w
    left = F.max(F.when(~F.col("_full"), F.struct("_w", "_rest"))).over(Window.partitionBy(*parent))
    nodes = nodes.withColumn("_left", left)
    share = F.expr("cast(_left._rest as decimal(19,0)) * cast(w as decimal(19,0)) div cast(_left._w as decimal(19,0))")
    own = F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), share))
    return nodes.withColumn("own", own.cast("long")).drop("_rest", "_w", "_full", "_left")


def leaf_budgets(
    leaves: DataFrame, weights: Sequence[Mapping[str, int]], budget_percent: int, max_epochs: int
) -> DataFrame:
    """``l0, l1, l2, tokens, own``: the tokens that each leaf is to give.

    ``leaves`` has the levels and each leaf's ``tokens``. ``weights`` gives each level's integer
    weights by name, 1 for names that are not listed, 0 to leave a name out. The budget is ``budget_percent`` hundredths of all tokens.
    Shares are rounded down to whole tokens.
    """
    for i, level in enumerate(weights):
        leaves = leaves.withColumn(f"w{i}", _weight(i, level)).where(F.col(f"w{i}") > 0)
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.sum("tokens")).head()[0] or 0
    top = leaves.groupBy(F.col("l0").alias("node"), F.col("w0").alias("w")).agg(F.sum("cap").alias("cap"))
    top = top.withColumns({"_root": F.lit(0), "budget": F.lit(total * int(budget_percent) // 100).cast("long")})
    top = _share(top, ["_root"], "budget").select(F.col("node").alias("l0"), F.col("own").alias("budget"))
    middle = leaves.groupBy("l0", F.col("l1").alias("node"), F.col("w1").alias("w")).agg(F.sum("cap").alias("cap"))
    middle = _share(middle.join(top, "l0"), ["l0"], "budget").select("l0", F.col("node").alias("l1"), F.col("own").alias("budget"))
    bottom = leaves.withColumnRenamed("w2", "w").withColumn("node", F.col("l2")).join(middle, ["l0", "l1"])
    return _share(bottom, ["l0", "l1"], "budget").select("l0", "l1", "l2", "tokens", "own")


def mix(
    docs: DataFrame,
    levels: Sequence[Column],
    weights: Sequence[Mapping[str, int]],
    budget_percent: int,
    max_epochs: int,
    seed: int,
    tokens: Column,
    id_col: str = "doc_id",
) -> tuple[DataFrame, dict[str, str]]:
    """The selected rows of ``docs`` with all columns, and the names of the columns added:
    ``l0, l1, l2`` (the levels), ``n_tokens`` and ``epoch`` (from 1; a row may come in several).

    ``tokens`` counts a document, ``levels`` are domain, language and source; null levels are
    one group called NONE. A leaf's last pass takes documents while their sum
    stays within what is left of its budget; rows with the same id come together or not at
    all. A document of 0 tokens in a leaf without any is taken in the first pass. A hot leaf is cut into ranges of
    the order hash: only the range in which its budget ends is sorted.
    """
    names = {n: unused(docs, n) for n in ("l0", "l1", "l2", "n_tokens", "epoch")}
    inner = {n: unused(docs, n) for n in ("_tokens", "_own", "_full", "_left", "_hash", "_range", "_at", "_base", "_end", "_sum")}
    n = names | inner
    tree = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n[f"l{i}"]) for i, c in enumerate(levels)]
    rows = docs.select("*", *tree, tokens.cast("long").alias(n["n_tokens"]))
    key = [n["l0"], n["l1"], n["l2"]]
    tables = Workspace(docs.sparkSession)
    small = rows.select(F.col(id_col).alias("id"), *[F.col(k).alias(f"l{i}") for i, k in enumerate(key)], F.col(n["n_tokens"]).alias("t"))
    small, _ = tables.save(small, "counted")  # a few bytes for each document; its text is not counted again
    leaves, _ = tables.save(small.groupBy("l0", "l1", "l2").agg(F.sum("t").alias("tokens")), "leaves")
    own, n_leaves = tables.save(leaf_budgets(leaves, weights, budget_percent, max_epochs), "budgets")
    few = n_leaves["rows"] <= BROADCAST_LEAVES
    bounded = F.broadcast if few else (lambda df: df)
    own = own.withColumn("full", F.expr("if(tokens = 0, 1, own div tokens)")).withColumn("left", F.expr("if(tokens = 0, 0, own % tokens)"))
    # where in the order of its last pass each leaf's budget ends
    ranged = small.join(bounded(own.select("l0", "l1", "l2", "full", "left")), ["l0", "l1", "l2"]).where("left > 0")
    ranged = ranged.withColumn("range", F.substring(order_hash(F.col("id"), F.col("full") + 1, seed), 1, RANGE_DIGITS))
    sums = ranged.groupBy("l0", "l1", "l2", "range", "left").agg(F.sum("t").alias("t"))
    running = F.sum("t").over(Window.partitionBy("l0", "l1", "l2").orderBy("range"))
    ends = sums.withColumn("run", running).where("run > left")
    ends = ends.groupBy("l0", "l1", "l2").agg(F.min(F.struct("range", (F.col("run") - F.col("t")).alias("base"))).alias("end"))
    plan = own.join(ends, ["l0", "l1", "l2"], "left").select(
        F.col("l0").alias(n["l0"]), F.col("l1").alias(n["l1"]), F.col("l2").alias(n["l2"]), F.col("full").alias(n["_full"]),
        F.col("left").alias(n["_left"]), F.col("end.range").alias(n["_end"]), F.col("end.base").alias(n["_base"]),
    )
    plan, _ = tables.save(plan, "plan")
    planned = rows.join(bounded(plan), key)
    kept = [*docs.columns, *names.values()]
    passes = planned.where(F.col(n["_full"]) > 0)
    passes = passes.withColumn(n["epoch"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(n["_full"])))).select(kept)
    last = planned.where(F.col(n["_left"]) > 0).withColumn(n["epoch"], F.col(n["_full"]) + 1)
    last = last.withColumn(n["_hash"], order_hash(F.col(id_col), F.col(n["epoch"]), seed))
    last = last.withColumn(n["_range"], F.substring(n["_hash"], 1, RANGE_DIGITS))
    sure = last.where(F.col(n["_end"]).isNull() | (F.col(n["_range"]) < F.col(n["_end"]))).select(kept)
    edge = last.where(F.col(n["_range"]) == F.col(n["_end"]))
    order = Window.partitionBy(*key).orderBy(n["_hash"], id_col)  # a range frame: equal ids come together
    edge = edge.withColumn(n["_sum"], F.col(n["_base"]) + F.sum(n["n_tokens"]).over(order))
    edge = edge.where(F.col(n["_sum"]) <= F.col(n["_left"])).select(kept)
    return passes.unionAll(sure).unionAll(edge), names

