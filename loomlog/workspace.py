"""Written intermediate tables.

Loops cut their lineage by writing small relations (templates, edges, memberships) as
parquet in the cluster's shared checkpoint folder. A lost executor therefore costs a
task retry, never a restart of the loop.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_checked: set[tuple[str, str]] = set()
_scope = threading.local()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the one set on the context,
    else the warehouse; with a ``file:`` folder, executors elsewhere are tried out first."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    app = (spark.sparkContext.applicationId, root)
    if app not in _checked:
        if (root.startswith("file:") or "://" not in root) and _executors_elsewhere(spark):
            _try_out(spark, root)
        _checked.add(app)
    return root


def _executors_elsewhere(spark: SparkSession) -> bool:
    """Whether an executor runs on another machine than the driver."""
    context = spark.sparkContext._jsc.sc()
    infos = context.statusTracker().getExecutorInfos()
    driver = spark.conf.get("spark.driver.host", "")
    return any(info.host() not in (driver, "localhost", "127.0.0.1") for info in infos)


def _try_out(spark: SparkSession, root: str) -> None:
    """Raise if the driver does not see what executors write, or the other way round."""
    n = 4 * spark.sparkContext.defaultParallelism
    target = f"{root}/loomlog-try-{uuid.uuid4().hex}"
    try:
        spark.range(0, n, 1, n).write.parquet(target)
        seen = spark.read.schema("id long").parquet(target).count()
    except Exception as e:  # whatever the file system says about a folder that is not there
        raise RuntimeError(f"{root} is not shared by all executors; set spark.checkpoint.dir") from e
    if seen != n:
        raise RuntimeError(f"{root} is not shared by all executors; set spark.checkpoint.dir")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Spark would read and write it with, for readers and writers other than Spark's."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString()


@contextlib.contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that operators write in this thread meanwhile are deleted at the end. What is made of them has to
    be written or collected by then."""
    outer, _scope.workspaces = getattr(_scope, "workspaces", None), []
    try:
        yield
    finally:
        opened, _scope.workspaces = _scope.workspaces, outer
        for workspace in opened:
            workspace.close()


class Workspace:
    """A fresh folder below the checkpoint folder for one run's tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/loomlog-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []  # names of bucketed tables; dropping one leaves its files
        if getattr(_scope, "workspaces", None) is not None:
            _scope.workspaces.append(self)

    def save(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """Write ``df``; return the written table and what was measured on the way:
        its ``rows`` and the given aggregates."""
        self._n += 1
        target = f"{self.path}/{self._n:04d}-{name}"
        seen = Observation()
        measured = [F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()]]
        df.observe(seen, *measured).write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target), seen.get

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Write ``df`` in ``buckets`` by a hash of ``key``, without a shuffle: a join or aggregate by ``key`` with as many
        shuffle partitions then moves only its other side."""
        self._n += 1
        target, table = f"{self.path}/{self._n:04d}-{name}", f"loomlog_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", target).saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def close(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more, or all of them."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        paths = {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()} if tables else {self.path}
        for path in paths:
            if self.path.split("/loomlog-")[-1] in path:
                where = hadoop(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if not tables:
            for name in self._tables:
                self.spark.sql(f"drop table if exists {name}")
            self._tables.clear()
