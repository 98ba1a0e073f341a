"""Exact top-k by inner product with norm buckets (operator 3).

Vectors are grouped by length: each bucket holds vectors of about the same length, the
longest first. A query that already has k products needs, in a bucket of largest length m, a cosine
of at least threshold / (|q| * m). Above 1 the bucket is skipped; for high cosines the
bucket's candidates are pruned on the query's largest coordinates, where a vector that
is close enough in direction can only take a narrow range; for low ones by their own length. What is left is
verified by exact products. Query blocks and buckets are paired by the same length bound,
with thresholds that a first round over the longest buckets and each query's own surroundings has set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import shuffle_partitions
from loomlog.workspace import Workspace

#: Vectors of a bucket, queries of a block, and components of either.
BUCKET, QUERIES, CELLS = 4096, 512, 1 << 19
#: Cosine from which coordinates prune, and how many of them.
COORDINATE_COSINE, FOCUS = 0.8, 4
SCALE = 256
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Largest squared length whose products are exact in double arithmetic.
EXACT = float(1 << 53)

_BLOCK = "dim int, block long, n int, most double, ids binary, vectors binary, norms binary, big boolean, floor binary, least double"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v, norm``: every component as floor(256 * x). Vectors that are null or hold a
    null or a component that is not finite are left out, rows without id too."""
    x = F.col("_v")
    cells = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    cells = cells.where(F.col("id").isNotNull() & x.isNotNull()).where(~bad)
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("double"))
    return cells.select("id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def _pack(rows: list[tuple], block: int) -> pa.RecordBatch:
    """A row of ``_BLOCK`` of (id, vector, norm, threshold) rows with one dimension."""
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    v = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    norms = np.array([r[2] for r in rows], dtype=np.float64)
    floor = np.array([np.nan if r[3] is None else float(r[3]) for r in rows], dtype=np.float64)
    big = bool(norms.max() ** 2 >= EXACT)
    least = -np.inf if np.isnan(floor).any() or big else floor.min()
    cells = [
        v.shape[1], block, len(rows), norms.max(), ids.tobytes(), v.tobytes(), norms.tobytes(), big, floor.tobytes(), least
    ]
    types = [
        pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.float64()
    ]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], [c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(vectors: DataFrame, size: int, order: list) -> DataFrame:
    """Vectors in blocks of ``size``, in the given order inside ranges of it."""
    n = shuffle_partitions(vectors.sparkSession)
    placed = vectors.withColumn("dim", F.size("v")).repartitionByRange(n, "dim", *order).sortWithinPartitions("dim", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= min(size, CELLS // max(1, len(r["v"]))) or len(held[0][1]) != len(r["v"])):
                    yield _pack(held, block)
                    held, block = [], block + 1
                held.append((r["id"], r["v"], r["norm"], r.get("floor")))
        if held:
            yield _pack(held, block)

    return placed.mapInArrow(run, _BLOCK)


class _Block:
    def __init__(self, r: dict, side: str):
        get = lambda c: r[f"{side}_{c}"]
        self.ids = np.frombuffer(get("ids"), dtype=np.int64)
        self.v = np.frombuffer(get("vectors"), dtype=np.float64).reshape(get("n"), get("dim"))
        self.norms = np.frombuffer(get("norms"), dtype=np.float64)
        self.floor = np.frombuffer(get("floor"), dtype=np.float64)
        self.big = get("big")


def _products(q: np.ndarray, v: np.ndarray, big: bool) -> np.ndarray:
    """Exact integer products, at the ends of the long range where they do not fit it."""
    if not big:
        return (v @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(q, row)) for row in v]
    return np.array([min(max(x, LONG_MIN), LONG_MAX) for x in exact], dtype=np.int64)


def candidates(q: np.ndarray, norm: float, least: float, b: _Block, unit: np.ndarray) -> np.ndarray | None:
    """Rows of a bucket (longest first) that can reach ``least``; None for all."""
    longest = b.norms[0] if len(b.norms) else 0.0
    if np.isnan(least) or least <= 0 or not norm or not longest:
        return None
    least = least * (1 - 1e-9) - 1e-6
    cosine = least / (norm * longest)
    if cosine > 1:
        return np.zeros(0, dtype=np.int64)
    if cosine < COORDINATE_COSINE:
        n = int(np.searchsorted(-b.norms, -least / norm, side="right"))  # by length
        return None if n == len(b.norms) else np.arange(n)
    # a unit vector at that cosine lies within these bounds in each coordinate of the query
    focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
    alive = np.ones(len(b.norms), dtype=bool)
    room = np.sqrt(max(0.0, 1 - cosine * cosine))
    for f in focus:
        x = q[f] / norm
        reach = room * np.sqrt(max(0.0, 1 - x * x)) + 1e-6
        low, high = x * cosine - reach, x * cosine + reach
        # along the query a closer vector than the cosine asks for may reach further
        if x >= 0:
            high = 1.0 if x >= cosine else high
        else:
            low = -1.0 if -x >= cosine else low
        alive &= (unit[:, f] >= low) & (unit[:, f] <= high)
    return np.flatnonzero(alive)


def best_in_bucket(q: _Block, b: _Block, k: int, seen: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """``query, id, score``: the k best of the bucket for each query that can be in its answer.

    ``seen`` holds the k largest scores that this task has met for a query, and so raises its threshold."""
    found = []
    lengths = np.where(b.norms > 0, b.norms, 1.0)
    unit = b.v / lengths[:, None]
    big = q.big or b.big
    for i, query in enumerate(q.ids.tolist()):
        floor, own = q.floor[i], seen.get(query)
        if own is not None and len(own) == k:
            floor = np.fmax(floor, float(own[0]))
        at = None if big else candidates(q.v[i], q.norms[i], floor, b, unit)
        if at is not None and not len(at):
            continue
        score, ids = (_products(q.v[i], b.v, big), b.ids) if at is None else (_products(q.v[i], b.v[at], big), b.ids[at])
        ok = ids != query
        if not np.isnan(floor) and not big:
            ok &= score >= floor
        score, ids = score[ok], ids[ok]
        if not len(score):
            continue
        if len(score) > 4 * k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            top = score >= cut
            score, ids = score[top], ids[top]
        order = np.lexsort((ids, -score))[:k]
        found += [(query, int(ids[o]), int(score[o])) for o in order]
        seen[query] = np.sort(np.concatenate([score[order], own]) if own is not None else score[order])[-k:]
    return found


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                columns = list(zip(*best_in_bucket(_Block(r, "q"), _Block(r, "b"), k, seen))) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k largest integer products of each query: ``query_id, rank, vec_id, score``.

    ``is_query`` is an SQL condition on ``id``; every other row is a candidate. Ties go to the smaller
    id. A query with fewer than k candidates of its dimension gets them all; vectors of other
    dimensions are no candidates. Repeated ids are candidates each, but not of themselves. Products beyond the
    long range are set to its ends.
    """
    work = Workspace(vectors.sparkSession)
    rows, _ = work.save(quantized(vectors, id_col, vector_col), "quantized")
    buckets, _ = work.save(_blocks(rows, BUCKET, [F.col("norm").desc(), F.col("id")]), "buckets")
    asked = rows.where(is_query).dropDuplicates(["id"])
    # first round: each query among the queries of its own block gets a threshold that holds
    blocks, _ = work.save(_blocks(asked, QUERIES, [F.xxhash64("id")]), "blocks")
    near = blocks.select([F.col(c).alias(f"q_{c}") for c in blocks.columns] + [F.col(c).alias(f"b_{c}") for c in blocks.columns])
    floors = _scored(near, k).groupBy("query_id").agg(F.min("score").alias("_low"), F.count("*").alias("_n"))
    floors = floors.select(F.col("query_id").alias("id"), F.when(F.col("_n") >= k, F.col("_low")).alias("floor"))
    blocks, _ = work.save(_blocks(asked.join(floors, "id", "left"), QUERIES, [F.xxhash64("id")]), "queries")
    q, b = _side(blocks, "q"), _side(buckets, "b")
    # the queries are a stated set: their blocks meet every bucket whose length can matter
    pairs = q.join(b.hint("shuffle_replicate_nl"), (F.col("q_dim") == F.col("b_dim")) & (F.col("q_most") * F.col("b_most") * (1 + 1e-9) + 1 >= F.col("q_least")))
    return _best(_scored(pairs, k), k).select("query_id", "rank", "vec_id", "score")
