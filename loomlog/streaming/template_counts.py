"""Segments of time: batch clustering per window and running counts."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from loomlog.functions.text import with_template
from loomlog.operators.cluster import Clustering, cluster

# A label table up to this many rows, a digest and a number each, is broadcast to the stream.
BROADCAST_TEMPLATES = 500_000
# Parts in which the repeats of one line are looked at first.
SPREAD = 16
# Digests of open windows are kept on the executors' disks with bounded memory, not in their heaps, unless the session names a store.
STATE = "spark.sql.streaming.stateStore"
STATE_OPTIONS = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.trackTotalNumberOfRows": "false",  # else each new digest is looked up twice
}


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream takes its options when it starts; the session's own are put back."""
    chosen = spark.conf.get(f"{STATE}.providerClass", None) is not None
    before = {} if chosen else {k: spark.conf.get(k, None) for k in STATE_OPTIONS}
    try:
        for k in before:
            spark.conf.set(k, STATE_OPTIONS[k])
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cluster_by_window(df: DataFrame, width: str, threshold: float = 0.9, **options) -> Clustering:
    """Cluster each tumbling window of ``ts`` on its own, in one run.

    The window start becomes the group column ``window_start``; lines without a time form a
    group of their own, with a null start.
    """
    ts = df.schema["ts"].dataType
    # a window drops rows without a time, so they get one meanwhile
    start = F.window(F.coalesce("ts", F.lit("1970-01-01 00:00:00").cast(ts)), width)["start"]
    slotted = df.withColumn("_start", start)
    slotted = slotted.withColumn("window_start", F.when(F.col("ts").isNotNull(), F.col("_start"))).drop("_start")
    return cluster(slotted, threshold, by=["window_start"], **options)


def template_counts_stream(
    df: DataFrame,
    width: str,
    watermark: str,
    known: DataFrame | None = None,
    word_filter: bool = True,
) -> DataFrame:
    """Occurrences per window and template of a streaming log relation.

    Returns ``window_start, normalized_text, occurrences`` and, with ``known``
    (``normalized_text, cluster_id``, e.g. a saved membership), the cluster of
    templates seen before; others have a null ``cluster_id`` and can be placed by
    ``assign_to`` in a ``foreachBatch``. State holds one counter per open window
    and template; late lines beyond the watermark are dropped by Spark.
    """
    ntz = isinstance(df.schema["ts"].dataType, TimestampNTZType)
    start = F.col("window.start")
    counts = (
        # event time must be a TIMESTAMP; the window goes back to the input's type
        with_template(df, word_filter)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", width), "normalized_text")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .select((start.cast("timestamp_ntz") if ntz else start).alias("window_start"), "normalized_text", "occurrences")
    )
    if known is None:
        return counts
    # 128 bits stand for a text, so a row is small however long the text is
    digest = F.md5(F.col("normalized_text").cast("binary"))
    labels = known.select(digest.alias("_t"), "cluster_id")
    if labels.count() <= BROADCAST_TEMPLATES:
        labels = F.broadcast(labels)
    return counts.withColumn("_t", digest).join(labels, "_t", "left").drop("_t")


def distinct_counts_stream(df: DataFrame, width: str, watermark: str, word_filter: bool = True) -> DataFrame:
    """Distinct lines (``count``) beside ``occurrences`` per window and template of a streaming log relation.

    A line counts once in a window, by its 128-bit digest. The digests of a window are kept until the watermark
    passes its end, so a repeated line is never counted again, however late within the watermark; counts equal those of the batch. A
    line that repeats all the time is first looked at in SPREAD parts of its rows, each in a task of its own, so that
    one task does not see them all. Distinct lines and all lines are counted from one shuffle of the templates, so each line
    is read and tokenized once. Rows without a time are dropped by Spark.
    """
    ntz = isinstance(df.schema["ts"].dataType, TimestampNTZType)
    digest = F.unhex(F.md5(F.col("line").cast("binary")))
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != "line"]), F.lit(SPREAD))
    lines = (
        with_template(df.withColumns({"_line": digest, "_part": part}), word_filter)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .select(F.window("ts", width).alias("window"), "normalized_text", "_line", "_part")
        # the layout that the first of the two below asks for; Spark writes it once and reads it for both branches
        .repartition("window", "_line", "_part")
    )
    first = lines.dropDuplicates(["window", "_line", "_part"]).dropDuplicates(["window", "_line"])
    each = lines.select("window", "normalized_text", F.lit(0).alias("new"), F.lit(1).alias("row"))
    # the branch with state comes first: the shuffle that is read again brings no watermark
    counts = first.select("window", "normalized_text", F.lit(1).alias("new"), F.lit(0).alias("row")).unionAll(each)
    start = F.col("window.start")
    return (
        counts.groupBy("window", "normalized_text")
        .agg(F.sum("new").alias("count"), F.sum("row").alias("occurrences"))
        .select((start.cast("timestamp_ntz") if ntz else start).alias("window_start"), "normalized_text", "count", "occurrences")
    )


def counts_to_end(counts: DataFrame, path: str) -> DataFrame:
    """Run :func:`template_counts_stream` or :func:`distinct_counts_stream` over all data present, and return every count,
    those of windows that are still open too.

    Each batch writes the counts it has changed below ``path``, again under its own number if it is
    repeated; counts only grow, so the largest of a window and template is the last one.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    with _state_on_disk(counts.sparkSession):
        query = (
            counts.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    rows = counts.sparkSession.read.schema(counts.schema).option("recursiveFileLookup", "true").parquet(f"{path}/counts")
    measures = [c for c in counts.columns if c in ("count", "occurrences")]
    keys = [c for c in counts.columns if c not in measures]
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in measures]).select(counts.columns)
