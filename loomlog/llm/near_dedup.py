"""MinHash near-duplicates with Odd Sketches (operator 5).

Documents with equal shingle sets are one node. Nodes that share a band of minimum
hashes meet in a bucket, and every bucket joins the star of its smallest node, so that any two
nodes of a bucket are in one star. A star is looked at in one task, or, if it is large, in pairs of
blocks: minimum-hash samples of each node are folded into a bitmap of parities, whose
exclusive-or with another bitmap counts the samples that differ; only pairs that may
be similar enough are then compared on their full sets. Nodes linked to the centre of
a star are one class already and are not compared with each other. Links come out as
forests, never as all pairs, and are contracted to components in written rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import id_and_text, lower_ascii, release_memory, shuffle_partitions, slices, unused
from loomlog.workspace import Workspace

#: Words of a shingle, and the least similarity of a link in hundredths.
SHINGLE, LINK = 5, 85
#: Bands of as many rows: a pair at similarity 0.85 is missed with probability 4e-7.
BANDS, ROWS = 20, 4
#: Minimum-hash samples of an Odd Sketch and its bits. A pair at the limit differs in more than
#: ``_most_odd`` bits with probability below 1e-6.
SAMPLES, BITS = 256, 2048
#: Nodes and shingles of a block of a star.
BLOCK_NODES, BLOCK_SHINGLES = 1000, 1_000_000
WORD_CACHE = 200_000

_U = np.uint64
_PLACE = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=_U
)
_RANDOM = np.random.default_rng(20240229)
_BAND_A = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_BAND_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD_A = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ODD_B = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes (uint64) of a text's shingles.

    Words are runs without \\x20 and \\x09-\\x0D, A-Z lower-cased. Fewer words than
    ``width`` are one shingle; no word is none.
    """
    words = lower_ascii(text).split()
    if not words:
        return np.zeros(0, dtype=_U)
    if len(_words) > WORD_CACHE:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), dtype=_U, count=len(words))
    place = _PLACE if width == SHINGLE else np.cumprod(np.full(width, _PLACE[0]), dtype=_U)
    if len(h) < width:
        return _mix((h * place[: len(h)]).sum(keepdims=True, dtype=_U) + _U(len(h)) * _U(0x2545F4914F6CDD1D))
    n = len(h) - width + 1
    s = h[:n] * place[0]
    for k in range(1, width):
        s = s + h[k : n + k] * place[k]
    return np.unique(_mix(s))


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> _U(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[None, i : i + 4096] * a[:, None] + b[:, None]).min(1), out=out)
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes."""
    m = _minima(s, _BAND_A, _BAND_B).reshape(BANDS, ROWS).astype(_U)
    return _mix((m * _PLACE[:ROWS]).sum(1, dtype=_U) + np.arange(BANDS, dtype=_U) * _U(0x2545F4914F6CDD1D)).view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the samples that fall on each of BITS bits, packed into uint64."""
    m = _minima(s, _ODD_A, _ODD_B).astype(_U) + np.arange(SAMPLES, dtype=_U) * _U(1 << 32)
    at = (_mix(m * _PLACE[0]) % _U(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(_U)


def _most_odd(link: int) -> float:
    """Differing bits up to which a pair may have the similarity: the mean at the limit plus five deviations."""
    j = link / 100
    differ = SAMPLES * (1 - j) + 5 * (SAMPLES * j * (1 - j)) ** 0.5
    return BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ)) + 8


class _Classes:
    """Union-find over the nodes of a star."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)


def links_of_star(
    center: int, nodes: np.ndarray, sets: list[np.ndarray], block: np.ndarray, across: bool, link: int
) -> list[tuple[int, int]]:
    """A forest of links of similar nodes. With ``across`` only pairs of different blocks are sought."""
    sizes = np.array([len(s) for s in sets])
    odd = np.stack([odd_sketch(s) for s in sets])
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    mark, most = np.zeros(len(flat), dtype=bool), _most_odd(link)
    classes, found = _Classes(len(nodes)), []

    def similar(x: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are linked to x: by size, by sketch, then on the full sets."""
        low, high = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[100 * low >= link * high]
        others = others[np.bitwise_count(odd[others] ^ odd[x]).sum(1) <= most]
        if not len(others):
            return others
        mark[ids[start[x] : start[x + 1]]] = True
        both = np.array([np.count_nonzero(mark[ids[start[y] : start[y + 1]]]) for y in others])
        mark[ids[start[x] : start[x + 1]]] = False
        return others[100 * both >= link * (sizes[others] + sizes[x] - both)]

    every = np.arange(len(nodes))
    middle = np.flatnonzero(nodes == center)
    for x in middle:
        for y in similar(int(x), every[every != x]):
            if classes.of[x] != classes.of[y]:
                classes.join(int(x), int(y))
                if not across:
                    found.append((int(x), int(y)))
    for x in every:
        if len(middle) and classes.of[x] == classes.of[middle[0]]:
            continue
        # a later node outside the centre's class looks at this one itself
        open_ = (classes.of != classes.of[x]) & ((every > x) | (classes.of == (classes.of[middle[0]] if len(middle) else -1)))
        if across:
            open_ &= block != block[x]
        open_[middle] = False
        for y in similar(int(x), every[open_]):
            if classes.of[x] != classes.of[y]:
                classes.join(int(x), int(y))
                found.append((int(x), int(y)))
    return [(min(int(nodes[a]), int(nodes[b])), max(int(nodes[a]), int(nodes[b]))) for a, b in found]


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                n, digest, keys = [], [], []
                for text in texts:
                    s = shingles(text)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(s) if len(s) else [])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "keys"],
                )
        _words.clear()
        release_memory()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _stars(nodes: DataFrame) -> DataFrame:
    """``center, node, i, j``: the nodes of each star, in each pair of blocks they belong to."""
    keys = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    centers = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("_most"))
    centers = centers.where("center < _most").drop("_most")
    stars = keys.join(centers.hint("merge"), "key").groupBy("center", "node").agg(F.max("n_shingles").alias("w"))
    size = stars.groupBy("center").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("w") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.transform(each, lambda k: F.struct(F.least(b, k).alias("i"), F.greatest(b, k).alias("j")))
    all_pairs = F.flatten(
        F.transform(each, lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    at = F.explode(F.when(F.col("node") == F.col("center"), all_pairs).otherwise(own)).alias("at")
    placed = stars.join(size.hint("merge"), "center").select("center", "node", b.alias("block"), at)
    return placed.select("center", "node", "block", "at.i", "at.j")


def _links(stars: DataFrame, docs: DataFrame, link: int) -> DataFrame:
    """Verified links ``a, b`` (a < b)."""
    n = shuffle_partitions(docs.sparkSession)
    # one plan at every size: both sides are shuffled by node, and no text is broadcast
    texts = stars.hint("merge").join(docs.withColumnRenamed("doc_id", "node"), "node")
    texts = texts.repartition(n, "center", "i", "j").sortWithinPartitions("center", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, blocks = None, [], [], []

        def done() -> pa.RecordBatch:
            found = []
            if len(nodes) > 1:
                found = links_of_star(key[0], np.array(nodes), sets, np.array(blocks), key[1] != key[2], link)
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for rows, part in slices(batch):
                columns = [rows.column(c).to_pylist() for c in ("center", "i", "j", "node", "block")]
                for center, i, j, node, block, text in zip(*columns, part):
                    if (center, i, j) != key:
                        if key:
                            yield done()
                        key, nodes, sets, blocks = (center, i, j), [], [], []
                    s = shingles(text)
                    if len(s) and not (nodes and nodes[-1] == node and np.array_equal(sets[-1], s)):
                        nodes.append(node)
                        sets.append(s)
                        blocks.append(block)
        if key:
            yield done()
        _words.clear()
        release_memory()

    return texts.mapInArrow(run, "a long, b long").where("a < b")


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """``node, component`` for all nodes of the links: the smallest node reachable.

    Rounds of large and small stars: each node's larger neighbours move to its smallest
    one, then each node's smaller neighbours do. The edges are written after each round.
    """
    measures = {"check": F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))}
    edges, seen = work.save(links.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), "links", **measures)
    while seen["rows"]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a")
        moved = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, now = work.save(moved.unionAll(small.select("a", F.col("m").alias("b"))).distinct(), "round", **measures)
        same = now == seen
        edges, seen = new, now
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, link: int = LINK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked if 100 * |intersection| >= ``link`` * |union| of their sets of
    5-word shingles; ``component_id`` is the smallest doc_id reachable, itself included, ``kept`` marks that
    document. Texts without words are linked with nothing. Rows with the same id are one
    document and are all kept or not. Rows without id take no part: their component is
    null and they are kept. An empty table gives no rows.
    """
    if link < 80:
        raise ValueError("bands and sketches are laid out for a similarity of 0.8 or more")
    own, work = id_and_text(docs, id_col, text_col), Workspace(docs.sparkSession)
    rows, _ = work.save(_features(own), "features")
    named = rows.where("digest is not null and doc_id is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("_last"))
    classes, _ = work.save(classes.select("digest", "node", (F.col("node") < F.col("_last")).alias("copies")), "classes")
    nodes = named.withColumnRenamed("doc_id", "node").join(classes.drop("copies").hint("merge"), ["digest", "node"])
    stars, seen = work.save(_stars(nodes), "stars")
    found = _links(stars, own, link) if seen["rows"] else stars.selectExpr("center AS a", "node AS b").limit(0)
    reach = components(found, work)
    moved = classes.join(reach.hint("merge"), "node", "left")
    moved = moved.withColumn("component", F.coalesce("component", "node")).where("copies or component < node")
    final = rows.select("doc_id", "n_shingles", "digest").join(moved.select("digest", "component"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return final.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, link: int = LINK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps."""
    lost = near_duplicates(docs, link, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    name = unused(docs, "_id")
    lost = lost.withColumnRenamed("_id", name)
    return docs.join(lost, docs[id_col].cast("long") == lost[name], "left_anti")
