"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters (or bytes) of text that one step inside a task works on at a time.
SLICE_CHARS = 2_000_000
#: Texts above this many characters are worked on in parts.
LONG_TEXT = 2_000_000
#: Rows of an Arrow batch of documents.
BATCH_ROWS = 1000
#: Rows that a Parquet reader decodes at a time where they are whole documents.
READ_ROWS = 256
#: The characters \x20 and \x09-\x0D, the only ones that separate words here.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after setting the rows of an Arrow batch to BATCH_ROWS where the session
    has Spark's default: a batch of 10 000 documents takes tens of MB several times over."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def small_reads(df: DataFrame) -> DataFrame:
    """``df``, after setting the rows that Parquet readers decode at a time to READ_ROWS where the session has Spark's
    default: the texts of 4096 documents are one array of tens of MB on the heap, allocated anew as it grows."""
    conf, name = df.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    if conf.get(name) == "4096":
        conf.set(name, str(READ_ROWS))
    return df


def release_memory() -> None:
    """Give what a task has freed back to the system, where the C library can do that; workers live on."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, whatever else the table has; a null text becomes empty."""
    small_batches(docs)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the like, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, size: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch whose ``text`` column holds about ``size`` bytes, one row at least, with their texts."""
    column = batch.column("text")
    before = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(before, before[start] + size, side="right")) - 1)
        part = batch.slice(start, end - start)
        yield part, part.column("text").to_pylist()
        start = end


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return text.encode().lower()


def at_spaces(text: str) -> Iterator[str]:
    """A text in parts of about ``LONG_TEXT`` characters, each but the first beginning with a blank."""
    start = 0
    while len(text) - start > LONG_TEXT:
        cut = text.find(" ", start + LONG_TEXT)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text
