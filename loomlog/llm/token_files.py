"""Token ids as flat binary files with document offsets (operator 6).

A table of token files is a folder. ``shard-00007.bin`` holds the ids of all documents
of a shard, one after the other, as little-endian unsigned integers (16 bit if the
vocabulary allows it, else 32). ``shard-00007.idx`` holds n (int64), the n document ids (int64), n flags for
null ids (uint8) and n + 1 offsets into the shard (uint64). Shards follow each other
in the order of doc_id. ``manifest`` is a Parquet table with a row per shard: its documents, its tokens, and
the number of tokens before it, which is a prefix sum over the shards.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, release_memory, shuffle_partitions, slices
from loomlog.llm.token_ids import piece_tokenizer
from loomlog.sources.container_logs import file_store
from loomlog.workspace import qualified

#: Documents in one batch that a reader returns.
READ_ROWS = 20_000
#: Bytes of input, as Spark estimates them, for one shard; a task holds the index of its shard. Above so
#: many bytes Spark has no estimate, and the texts are counted.
SHARD_BYTES, UNKNOWN_BYTES = 256 << 20, 1 << 60


def _name(shard: int, kind: str) -> str:
    return f"shard-{shard:05d}.{kind}"


def _shards(docs: DataFrame, text_col: str) -> int:
    """One for each shuffle partition, more if the table is so large that shards would pass SHARD_BYTES."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN_BYTES:
        size = docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of all documents in ascending ``doc_id`` order (null first).

    ``path`` is a new folder that all executors reach. A null or empty text is the end id alone;
    repeated rows are written as often as they come, an empty table makes empty shards. A
    task writes under a name of its own and renames at its end, so a second attempt
    replaces the first. Rows with the same id follow each other by a hash of the text.
    """
    spark = docs.sparkSession
    path, n = qualified(spark, path), shards or _shards(docs, text_col)
    store, root = file_store(path)
    store.create_dir(root, recursive=True)
    bounded = id_and_text(docs, id_col, text_col).withColumn("_h", F.xxhash64("text"))
    placed = bounded.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("_h"))
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_tokenizer(tokenizer)
        width = "<u2" if max(words.library.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = file_store(path)
        temporary = {k: posixpath.join(root, f"_{own}.{k}") for k in ("bin", "idx")}
        ids, nulls, lengths = [], [], [np.zeros(1, dtype="<u8")]
        with store.open_output_stream(temporary["bin"]) as f:
            for batch in batches:
                for rows, texts in slices(batch):
                    made = words.ids(texts, end_id)
                    f.write(np.concatenate(made).astype(width).tobytes())
                    lengths.append(np.array([len(x) for x in made], dtype="<u8"))
                    column = rows.column("doc_id")
                    nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype("u1"))
                    ids.append(column.fill_null(0).to_numpy().astype("<i8"))
        offsets = np.cumsum(np.concatenate(lengths), dtype="<u8")
        count = len(offsets) - 1
        with store.open_output_stream(temporary["idx"]) as f:
            f.write(np.array([count], dtype="<i8").tobytes())
            for part in (*ids, *nulls, offsets):
                f.write(part.tobytes())
        for kind, name in temporary.items():
            store.move(name, posixpath.join(root, _name(shard, kind)))
        release_memory()
        columns = [[shard], [count], [int(offsets[-1])], [int(width[-1])]]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["shard", "documents", "tokens", "width"]
        )

    counts = placed.mapInArrow(run, "shard int, documents long, tokens long, width int")
    counts.write.parquet(f"{path}/counts")
    # a row per shard, so this order passes through one task without harm
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.parquet(f"{path}/counts").withColumn(
        "base", F.coalesce(F.sum("tokens").over(before), F.lit(0))
    ).write.parquet(f"{path}/manifest")


def _map(store: fs.FileSystem, name: str, kind: str, n: int, offset: int = 0) -> np.ndarray:
    """Part of a file as an array: mapped into memory where the store is a file system."""
    if not n:
        return np.zeros(0, dtype=kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, dtype=kind, mode="r", offset=offset, shape=(n,))
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, offset), dtype=kind)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id, start`` (ids before it in all shards),
    ``n_tokens`` and ``ids_crc32`` of its ids as little-endian 32-bit integers."""
    path = qualified(spark, path)
    manifest = spark.read.parquet(f"{path}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(path)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["documents"]
                index = posixpath.join(root, _name(row["shard"], "idx"))
                doc_ids = _map(store, index, "<i8", n, 8)
                null = _map(store, index, "u1", n, 8 + 8 * n)
                offsets = _map(store, index, "<u8", n + 1, 8 + 9 * n)
                data = posixpath.join(root, _name(row["shard"], "bin"))
                local = isinstance(store, fs.LocalFileSystem)
                flat = _map(store, data, f"<u{row['width']}", row["tokens"]) if local else None
                for i in range(0, n, READ_ROWS):
                    cut = np.asarray(offsets[i : i + READ_ROWS + 1]).astype(np.int64)
                    first = int(cut[0])
                    if local:
                        part = flat[first : int(cut[-1])]
                    else:
                        part = _map(store, data, f"<u{row['width']}", int(cut[-1]) - first, first * row["width"])
                    crc = [
                        zlib.crc32(part[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1] - first, cut[1:] - first)
                    ]
                    mask = np.asarray(null[i : i + READ_ROWS]).astype(bool)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(doc_ids[i : i + READ_ROWS]), pa.int64(), mask=mask),
                            pa.array(row["base"] + cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = manifest.repartition(shuffle_partitions(spark), "shard")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
