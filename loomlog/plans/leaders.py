"""Greedy leader clustering as rounds of DataFrame joins.

In rank order, a template joins the first earlier leader it is similar to, or
becomes a leader. The set of leaders is the lexicographically first maximal
independent set of the similarity graph, which can be found without a sequential
loop (Blelloch, Fineman, Shun 2012).

Comparing all templates with all others would list every pair inside a family of
near-identical templates. So the templates are taken in rank order in batches: the
first batch is resolved on its own, its leaders absorb what they can from
everything below, and only the rest goes on. A family costs one comparison per
template and leader, however large it is. The batch size comes from the counted
work of the batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.plans.simjoin import TokenTable, similar_rows
from loomlog.plans.tokens import can_match, token_order, with_join_keys, with_tokens
from loomlog.workspace import Workspace

# The smallest batch; larger ones are this many texts doubled, as far as the budget goes.
FIRST_BATCH = 4096
# Rounds after which chains of undecided templates are followed to their ends.
CHAINS_AFTER = 5
# Texts one task turns into token sets; the work is in the processor, not in bytes.
TEXTS_PER_TASK = 100_000
# Candidate pairs the first batch may compare, per core of the cluster. Each batch that finds few edges lets the next
# compare four times as many, up to so many times the first: the number of batches follows the families, not the texts.
PAIRS_PER_CORE = 4_000_000
MOST_GROWTH = 16
# Candidates per edge from which a batch has few edges.
FEW_EDGES = 64


def tokenized(df: DataFrame, n: int, text: str, metric: str, by: Sequence[str], threshold: float | None = None) -> DataFrame:
    """``id, by`` and the token sets of ``n`` texts, spread over at least all
    cores: texts are few bytes and much work each, so the file layout would leave
    cores idle. With a threshold, of those that can reach it with some other text."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    texts = df.select("id", *by, text).repartition(max(cores, -(-n // TEXTS_PER_TASK)), "id")
    if threshold is not None:
        texts = can_match(texts, text, metric, threshold)
    return with_tokens(texts, text, metric).drop(text)


def token_sets(ws: Workspace, df: DataFrame, n: int, text: str, metric: str, by: Sequence[str], threshold: float) -> DataFrame:
    """Written, as they are read twice: for the order of tokens and for the keys."""
    return ws.save(tokenized(df, n, text, metric, by, threshold), "sets")[0]


def save_comparable(ws: Workspace, table: DataFrame, name: str) -> TokenTable:
    """Write a join table and keep the texts that can reach the threshold with
    some other text.

    The filter is put on the written table: in front of the write it would be
    pushed below the token expressions and compute them again.
    """
    can_match = (F.size("short_keys") > 0) | (F.size("long_keys") > 0)
    is_wide = (F.size("rest") > 0) | (F.col("b") == 0)
    saved, seen = ws.save(table, name, live=F.count_if(can_match), wide=F.count_if(is_wide), last=F.max("id"))
    return TokenTable(saved.where(can_match), seen["live"], seen["wide"] > 0, seen["last"] or 0)


def _batch_end(live: DataFrame, lo: int, hi: int, budget: int) -> int | None:
    """First rank after the largest affordable batch of ``lo..hi``; None takes everything."""
    ends = [lo + FIRST_BATCH]
    while ends[-1] <= hi:
        ends.append(lo + 2 * (ends[-1] - lo))
    keys = live.select("id", F.explode("short_keys.k").alias("k"), F.lit(True).alias("short")).unionAll(
        live.select("id", F.explode("long_keys.k").alias("k"), F.lit(False).alias("short"))
    )
    below = [F.col("id") < end for end in ends]
    per_key = keys.groupBy("k").agg(
        *[F.count_if(c & F.col("short")).alias(f"s{i}") for i, c in enumerate(below)],
        *[F.count_if(c & ~F.col("short")).alias(f"l{i}") for i, c in enumerate(below)],
    )
    work = per_key.agg(
        *[F.sum(F.col(f"s{i}") * F.col(f"l{i}").cast("double")).alias(f"w{i}") for i in range(len(ends))]
    ).head()
    affordable = [end for end, w in zip(ends, work) if w <= budget]
    end = max(affordable, default=ends[0])
    return None if end > hi else end


def chained(ws: Workspace, live: DataFrame) -> DataFrame:
    """Ids that a chain from a leader decides, with ``leads``, given the undecided edges ``lo < hi``.

    A vertex with a single undecided earlier neighbour leads if that one does not. Such vertices point to
    their neighbour; doubling the pointers finds where each chain begins and how far away that is. Chains that begin at a vertex
    with several earlier neighbours stay undecided.
    """
    single = live.groupBy("hi").agg(F.min("lo").alias("lo"), F.max("lo").alias("_last")).where("lo = _last")
    begin = live.select(F.col("lo").alias("id")).distinct().join(live.select(F.col("hi").alias("id")), "id", "left_anti")
    chain, seen = ws.save(single.select(F.col("hi").alias("id"), F.col("lo").alias("to"), F.lit(True).alias("odd")), "chain")
    moved = seen["rows"]
    while moved:
        step = chain
        for _ in range(2):  # both ends double, so a table reaches four times as far as the one before
            far = step.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
            step = step.join(far, "to", "left").select(
                "id", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
                F.col("_to").isNotNull().alias("moved"),
            )
        saved, seen = ws.save(step, "chain", moved=F.count_if(F.col("moved")))
        moved, chain = seen["moved"], saved.drop("moved")
    return chain.join(begin.withColumnRenamed("id", "to"), "to", "left_semi").select("id", (~F.col("odd")).alias("leads"))


def absorbed(ws: Workspace, edges: DataFrame, n: int) -> DataFrame | None:
    """Ids that an earlier leader absorbs, given all edges ``lo < hi``.

    Each round the vertices without an undecided earlier neighbour are leaders,
    their neighbours are absorbed, and the edges of absorbed vertices disappear.
    The earliest undecided vertex always absorbs something, so it ends. What is left after a few rounds
    hangs together in chains, which are then followed to their ends at once (see :func:`chained`).
    """
    live, parts, rounds = edges.select("lo", "hi"), [], 0
    while n:
        later = live.select(F.col("hi").alias("lo")).distinct()
        heads = live.join(later, "lo", "left_anti").select("hi")
        if rounds >= CHAINS_AFTER:
            decided, _ = ws.save(chained(ws, live), "decided")
            led = live.join(decided.where("leads").select(F.col("id").alias("lo")), "lo", "left_semi").select("hi")
            heads = heads.unionAll(led).unionAll(decided.where("not leads").select("id"))
        rounds += 1
        out = heads.distinct().withColumn("out", F.lit(True))
        marked = (
            live.join(out.withColumnRenamed("out", "hi_out"), "hi", "left")
            .join(out.select(F.col("hi").alias("lo"), F.col("out").alias("lo_out")), "lo", "left")
            .select(
                "lo",
                "hi",
                F.coalesce("hi_out", F.lit(False)).alias("hi_out"),
                (F.coalesce("hi_out", F.lit(False)) | F.coalesce("lo_out", F.lit(False))).alias("done"),
            )
        )
        saved, seen = ws.save(marked, "round", live=F.count_if(~F.col("done")))
        n = seen["live"]
        parts.append(saved.where("hi_out").select(F.col("hi").alias("id")))
        live = saved.where("not done").select("lo", "hi")
    return reduce(DataFrame.unionAll, parts).distinct() if parts else None


def _choose(pairs: DataFrame, member: str, leader: str, mode: str) -> DataFrame:
    """One leader per member: the earliest, or the most similar (ties earliest)."""
    keys = [F.col(leader).alias("l"), (-F.col("similarity")).alias("s")]
    pick = F.min(F.struct(*(keys if mode == "first" else reversed(keys))))
    return (
        pairs.groupBy(F.col(member).alias("id"))
        .agg(pick.alias("p"))
        .select("id", F.col("p.l").alias("cluster_id"), (-F.col("p.s")).alias("similarity"))
    )


def assign_members(
    ws: Workspace,
    table: TokenTable,
    threshold: float,
    metric: str,
    by: Sequence[str],
    mode: str,
) -> list[DataFrame]:
    """Members ``id, cluster_id, similarity`` among the templates of ``table``,
    whose ids are ranks. Every id that is not listed is a leader."""
    first = budget = PAIRS_PER_CORE * ws.spark.sparkContext.defaultParallelism
    members: list[DataFrame] = []
    live, n, start = table.rows.withColumn("taken", F.lit(False)), table.n, 0
    while n:
        end = _batch_end(live.where("not taken"), start, table.last, budget)
        batch = (live if end is None else live.where(F.col("id") < end)).where("not taken")
        size = n if end is None else batch.count()

        part = table.part(batch, size)
        pairs = similar_rows(part, part, threshold, metric, by, self_join=True)
        edges, seen = ws.save(
            pairs.select(F.col("left_id").alias("lo"), F.col("right_id").alias("hi"), "similarity"),
            "edges",
        )
        if seen["rows"] * FEW_EDGES < budget:
            budget = min(4 * budget, MOST_GROWTH * first)
        out = absorbed(ws, edges, seen["rows"])
        leaders = batch
        if out is not None:
            led = edges.join(out.select(F.col("id").alias("lo")), "lo", "left_anti")
            chosen = _choose(led, "hi", "lo", mode)
            # a single batch is read once, by the caller
            members.append(chosen if end is None and not members else ws.save(chosen, "members")[0])
            leaders = batch.join(out, "id", "left_anti")
        # a template that is taken may be closer to a later leader, so it stays for comparison in best mode; inside
        # the batch too, as its pairs above are of templates that are not taken
        below = None if end is None else live.where(F.col("id") >= end)
        others = live.where("taken") if end is None else live.where((F.col("id") >= end) | F.col("taken"))
        if end is not None or (mode == "best" and members):
            found = similar_rows(table.part(leaders, size), table.part(others), threshold, metric, by, left_first=True)
            taken, seen = ws.save(_choose(found, "right_id", "left_id", mode), "members")
            members.append(taken)
        if end is None:
            break

        # what is left is written once a batch, so later batches read nothing that is settled
        rest = below.join(taken.select("id", F.lit(True).alias("_now")), "id", "left")
        rest = rest.withColumn("taken", F.col("taken") | F.coalesce("_now", F.lit(False))).drop("_now")
        rest = rest if mode == "best" else rest.where("not taken")
        live, seen = ws.save(rest, "live", left=F.count_if(~F.col("taken")))
        n, start = seen["left"], end

    if mode == "best" and len(members) > 1:
        # each leader was compared once with each template after it; the closest of all batches counts
        every = reduce(DataFrame.unionAll, members).select(F.col("id").alias("_member"), F.col("cluster_id").alias("_leader"), "similarity")
        members = [_choose(every, "_member", "_leader", mode)]
    return members


def rank(ws: Workspace, ordered: DataFrame) -> tuple[DataFrame, int]:
    """Write an ordered relation with its dense position as ``id``.

    A range sort numbers the rows inside each partition; the partition offsets are
    one number per partition.
    """
    numbered = ordered.withColumn("_pos", F.monotonically_increasing_id())
    part = F.shiftright("_pos", 33)
    saved, seen = ws.save(numbered, "ranked", lo=F.min(part), hi=F.max(part))
    n = seen["rows"]
    if seen["lo"] == seen["hi"]:
        start = (seen["lo"] or 0) << 33
        return saved.select((F.col("_pos") - start).alias("id"), *ordered.columns), n
    counts = sorted(saved.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    offsets, at = [], 0
    for p, rows in counts:
        offsets.append((p, at - (p << 33)))
        at += rows
    table = ws.spark.createDataFrame(offsets, "_p bigint, _shift bigint")
    joined = saved.withColumn("_p", part).join(F.broadcast(table), "_p")
    return joined.select((F.col("_pos") + F.col("_shift")).alias("id"), *ordered.columns), n


def cluster_ranked(
    ws: Workspace,
    ranked: DataFrame,
    n: int,
    text: str,
    threshold: float,
    metric: str,
    by: Sequence[str],
    mode: str,
) -> DataFrame:
    """Add ``cluster_id`` (the leader's id) and ``similarity`` to ranked rows."""
    tokens = token_sets(ws, ranked, n, text, metric, by, threshold)
    keyed = with_join_keys(tokens, threshold, token_order(tokens), by)
    table = save_comparable(ws, keyed, "tokens")
    members = assign_members(ws, table, threshold, metric, by, mode)
    if not members:
        return ranked.withColumns({"cluster_id": F.col("id"), "similarity": F.lit(1.0)})
    led = reduce(DataFrame.unionAll, members)
    return ranked.join(led, "id", "left").withColumns(
        {
            "cluster_id": F.coalesce("cluster_id", "id"),
            "similarity": F.coalesce("similarity", F.lit(1.0)),
        }
    )
