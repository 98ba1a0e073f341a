"""A growing set of clusters that takes in a stream, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.operators.assign import place_templates
from loomlog.operators.cluster import check_mode
from loomlog.operators.templates import templates
from loomlog.plans.skew import join_on
from loomlog.plans.tokens import check_metric, check_threshold
from loomlog.workspace import Workspace, temporary_tables

# Tables of a store, each with a folder per batch.
PLACED = "normalized_text string, cluster_id bigint, similarity double, count bigint, occurrences bigint, representative string, existing boolean"
KNOWN = "normalized_text string, cluster_id bigint, similarity double"
CLUSTERS = "cluster_id bigint, normalized_text string, representative string"


class ClusterStore:
    """Clusters below ``path`` that grow with every batch of lines.

    Batch number n sees the tables of the batches before it and writes three folders of its own: ``placed``, a row per
    template of its lines with its cluster; ``known``, the templates never met before; ``clusters``, the leaders
    formed. A template keeps the cluster it was first given. A new one goes to the earliest existing
    cluster with similarity >= threshold (or the most similar one with ``mode="best"``); the rest is
    clustered by itself and numbered after what exists. The batch is committed by an empty file of its number, written
    last; without it the folders are ignored and written again, with it a repeated batch does nothing.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        threshold: float = 0.9,
        *,
        mode: str = "first",
        metric: str = "dice_bigrams",
        by: Sequence[str] = (),
        word_filter: bool = True,
    ):
        self.spark, self.path, self.by, self.word_filter = spark, path.rstrip("/"), list(by), word_filter
        self.options = {"mode": check_mode(mode), "metric": check_metric(metric), "by": self.by, "word_filter": word_filter}
        self.threshold = check_threshold(threshold)

    def _commit_file(self, number: int):
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{number:012d}")
        return where.getFileSystem(context._jsc.hadoopConfiguration()), where

    def committed(self, number: int) -> bool:
        store, where = self._commit_file(number)
        return store.exists(where)

    def last(self) -> int | None:
        """The number of the last committed batch."""
        store, where = self._commit_file(0)
        folder = where.getParent()
        if not store.exists(folder):
            return None
        return max((int(f.getPath().getName()) for f in store.listStatus(folder)), default=None)

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """``placed``, ``known`` or ``clusters`` of all committed batches, or of those before one, with their ``batch``."""
        schema = {"placed": PLACED, "known": KNOWN, "clusters": CLUSTERS}[name]
        schema = ", ".join([*(f"{c} string" for c in self.by), schema, "batch bigint"])
        end = before if before is not None else (-1 if self.last() is None else self.last()) + 1
        if end <= 0 or self.last() is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") < end)

    def place(self, lines: DataFrame, number: int) -> None:
        """Take in the lines of a batch: the function for ``foreachBatch``."""
        if not self.committed(number):
            with temporary_tables():
                self._place(lines, number)

    def _place(self, lines: DataFrame, number: int) -> None:
        by, text, ws = self.by, "normalized_text", Workspace(self.spark)
        new, _ = ws.save(templates(lines, self.word_filter, by), "new")
        known = self.table("known", number).drop("batch")
        clusters = self.table("clusters", number)
        fresh = join_on(new, known.select(*by, text), [*by, text], "left_anti")
        # the number of a cluster is its rank: earlier ones come first
        ranked = clusters.select(*by, "cluster_id", text, (-F.col("cluster_id")).alias("count"))
        found = place_templates(fresh, ranked, self.threshold, **self.options)
        first, _ = ws.save(found.membership, "first")
        columns = [*by, text, "cluster_id", "similarity", "count", "occurrences", "representative"]
        seen = join_on(new, known, [*by, text]).select(*columns, F.lit(True).alias("existing"))
        for name, rows in (
            ("placed", seen.unionAll(first.select(*columns, "existing"))),
            ("known", first.select(*by, text, "cluster_id", "similarity")),
            ("clusters", found.formed.clusters.select(*by, "cluster_id", text, "representative")),
        ):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        store, where = self._commit_file(number)
        store.create(where, True).close()

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Place a stream of lines, e.g. with ``availableNow=True`` or ``processingTime="1 minute"``."""
        return (
            lines.writeStream.foreachBatch(self.place).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
