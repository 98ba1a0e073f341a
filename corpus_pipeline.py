"""A corpus pipeline of five stages: judge, drop repeated lines, drop near copies, mix, pack.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``,
with ``n_chars`` counted anew where a text has changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import line_dedup, near_dedup, packing, quality
from loomlog.llm.common import table
from loomlog.llm.queries import END_ID, QUALITY_CUT, mixed, tokenizer_path
from loomlog.workspace import Workspace, temporary_tables


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject, whole and unchanged."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), QUALITY_CUT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; none is left out, even if its text becomes empty."""
    cut = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit the target weights, each once: a second epoch would undo the stages before."""
    chosen, _ = mixed(docs, 1)
    return chosen.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs, tokenizer_path(), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", judge),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, Odd Sketches and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work, before = table(spark, sf_dir, "documents"), Workspace(spark), None
    for name, stage in STAGES:
        with temporary_tables():  # of the stage's operator, not needed once its result is written
            docs, _ = work.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.close(before)
        before = docs
    return docs
