"""Clusters laid out once, so that new lines are compared without touching the old ones again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.templates import rank_order
from loomlog.plans import simjoin
from loomlog.plans.leaders import _choose, rank, save_comparable, token_sets
from loomlog.plans.simjoin import KeyIndex, index_rows, probe
from loomlog.plans.tokens import check_metric, check_threshold, token_order, with_join_keys
from loomlog.workspace import Workspace

TEXT = "normalized_text"


def text_digest(by: Sequence[str]) -> Column:
    """128 bits that stand for a text and its group; null groups are groups too."""
    groups = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by]
    return F.md5(F.concat_ws("\x00", *groups, F.col(TEXT)).cast("binary"))


@dataclass(frozen=True)
class ClusterIndex:
    """Saved clusters in the form that :func:`assign_templates` compares them in.

    ``keys``: a row per prefix token of a cluster's text; ``texts``: the digest of each distinct text with its earliest
    cluster. Both are tables in buckets, by token key and by digest.
    """

    keys: KeyIndex
    texts: DataFrame
    last: int | None  # the largest cluster_id

    def check(self, threshold: float, metric: str, by: Sequence[str]) -> None:
        made = self.keys.threshold, self.keys.metric, self.keys.by
        if made != (threshold, metric, tuple(by)):
            raise ValueError(f"an index made for {made} cannot be used for {(threshold, metric, tuple(by))}")


def save_index(
    clusters: DataFrame, path: str, threshold: float = 0.9, *, metric: str = "dice_bigrams", by: Sequence[str] = ()
) -> ClusterIndex:
    """Lay out ``clusters`` (``by, cluster_id, normalized_text, count``) below ``path``, a new folder, in as many buckets
    as the session has shuffle partitions. Their rank order decides which cluster comes first."""
    threshold, metric, by = check_threshold(threshold), check_metric(metric), list(by)
    spark = clusters.sparkSession
    ws, buckets = Workspace(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    old, n = rank(ws, clusters.select(*by, "cluster_id", TEXT, "count").orderBy(*rank_order(by)))
    tokens = token_sets(ws, old, n, TEXT, metric, by, threshold)
    order = token_order(tokens)
    table = save_comparable(ws, with_join_keys(tokens, threshold, order, by), "tokens")

    fields = {}

    def put(df: DataFrame, name: str, key: str) -> None:
        """Each key's rows in one bucket; they are brought together once, here, so that a bucket is one file."""
        fields[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        df.repartition(buckets, key).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key).option(
            "path", f"{path}/{name}"
        ).saveAsTable(f"loomlog_{uuid.uuid4().hex}")

    put(index_rows(table, by, old.select("id", "cluster_id")), "keys", "k")
    first = F.min(F.struct("id", "cluster_id")).alias("_first")
    put(old.groupBy(text_digest(by).alias("d")).agg(first).select("d", "_first.id", "_first.cluster_id"), "texts", "d")
    counted = spark.read.schema(fields["keys"]).parquet(f"{path}/keys").groupBy("k").agg(F.count(F.lit(1)).alias("nl"))
    counted.where(F.col("nl") > simjoin.BLOCK_ROWS).write.parquet(f"{path}/hot")
    made = {
        "threshold": threshold, "metric": metric, "by": by, "wide": table.wide, "order": order, "buckets": buckets, "fields": fields,
        "last": clusters.agg(F.max("cluster_id")).head()[0],
    }
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(f"{path}/made")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> ClusterIndex:
    """An index that :func:`save_index` has written, in this session or another."""
    made = json.loads(spark.read.text(f"{path}/made").head()[0])

    def table(name: str, key: str) -> DataFrame:
        own = f"loomlog_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {own} ({made['fields'][name]}) using parquet clustered by ({key}) sorted by ({key}) into {made['buckets']} buckets location '{path}/{name}'"
        )
        return spark.table(own)

    keys = KeyIndex(
        table("keys", "k"), spark.read.schema("k bigint, nl bigint").parquet(f"{path}/hot"), tuple(made["order"]), made["threshold"], made["metric"],
        tuple(made["by"]), made["wide"],
    )
    return ClusterIndex(keys, table("texts", "d"), made["last"])


def assigned_by_index(new: DataFrame, index: ClusterIndex, mode: str) -> DataFrame:
    """As ``assign_templates``: ``cluster_id, similarity`` of the matching cluster added to each template of ``new``."""
    keys, by = index.keys, list(index.keys.by)
    ws = Workspace(new.sparkSession)
    fresh, n = rank(ws, new.orderBy(*rank_order(by)))
    tokens = token_sets(ws, fresh, n, TEXT, keys.metric, by, keys.threshold)
    right = save_comparable(ws, with_join_keys(tokens, keys.threshold, keys.order, by), "new")
    same = index.texts.join(fresh.select(F.col("id").alias("right_id"), text_digest(by).alias("d")), "d").select(
        F.col("id").alias("left_id"), "cluster_id", "right_id", F.lit(1.0).alias("similarity")
    )
    close = probe(keys, right).unionAll(same)
    # ranks and cluster numbers belong together, so the pair stands for either
    pair = F.struct("left_id", "cluster_id").alias("left_id")
    chosen = _choose(close.select(pair, "right_id", "similarity"), "right_id", "left_id", mode)
    found = chosen.select("id", F.col("cluster_id.cluster_id").alias("cluster_id"), "similarity")
    return fresh.join(found, "id", "left").drop("id")
