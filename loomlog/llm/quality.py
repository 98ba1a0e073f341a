"""Quality by attention-based multiple-instance learning (operator 1).

A document is a bag of passages. Every passage is described by what its bytes and
words look like, encoded by a learned layer, and weighted by gated attention; the weighted mean of the
encodings is scored. Only labels of whole documents are needed: the attention finds
the passages that decide. Scores see the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import SLICE_CHARS, id_and_text, release_memory, slices, small_batches

#: Bytes of a passage.
PASSAGE = 512
#: Bytes that are described at a time.
PART = 1024 * PASSAGE
#: Labelled documents that the model is fitted on, the first by a hash of their ids.
TRAINING_DOCS = 4000
#: Passages of the documents that the model is fitted on, 128 MB of text: their features take 50 MB on the driver,
#: and a few times as much while the model is fitted.
TRAINING_PASSAGES = 250_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 24, 12, 25, 64, 0.01
HELD_OUT_OF, CUT = 5, 0.3

_SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_GROUPS = 10 + len(_SYMBOLS)
FEATURES = _GROUPS + 8


def _byte_groups() -> np.ndarray:
    """Which of _GROUPS each byte is counted in."""
    g = np.full(256, 9, dtype=np.int64)  # control characters
    g[0x80:] = 0
    g[list(b"aeiou")] = 1
    g[[b for b in range(97, 123) if b not in b"aeiou"]] = 2
    g[list(b"AEIOU")] = 3
    g[[b for b in range(65, 91) if b not in b"AEIOU"]] = 4
    g[48:58] = 5
    g[32], g[10] = 6, 7
    g[[9, 11, 12, 13]] = 8
    g[list(_SYMBOLS)] = 10 + np.arange(len(_SYMBOLS))
    return g


_GROUP = _byte_groups()
_POWERS = np.cumprod(np.full(PASSAGE + 1, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32) and the first passage of each text. An empty text is one passage."""
    raw = [t.encode() for t in texts]
    per_doc = [max(1, -(-len(r) // PASSAGE)) for r in raw]
    parts = [r[i : i + PART] for r in raw for i in range(0, max(1, len(r)), PART)]
    done, held, size = [], [], 0
    for part in parts:
        if held and size + len(part) > PART:
            done.append(_features(held))
            held, size = [], 0
        held.append(part)
        size += len(part)
    if held:
        done.append(_features(held))
    x = np.concatenate(done) if done else np.zeros((0, FEATURES), dtype=np.float32)
    return x, np.concatenate([[0], np.cumsum(per_doc, dtype=np.int64)])


def _features(raw: list[bytes]) -> np.ndarray:
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    per_doc = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(first[-1])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(raw)), sizes)
    passage = first[doc] + (np.arange(len(data)) - start[doc]) // PASSAGE
    out = np.zeros((n, FEATURES), dtype=np.float32)
    counts = np.bincount(passage * _GROUPS + _GROUP[data], minlength=n * _GROUPS).reshape(n, _GROUPS)
    size = np.maximum(1, counts.sum(1))
    out[:, :_GROUPS] = counts / size[:, None]
    # words: runs of bytes above the blank, cut at the ends of passages
    inside = data > 32
    begins = inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | (passage[1:] != passage[:-1])
    at = np.flatnonzero(begins)
    out[:, -1] = size / PASSAGE
    if len(at):
        owner = passage[at]
        word = np.cumsum(begins) - 1
        place = np.minimum(np.arange(len(data)) - at[np.maximum(word, 0)], PASSAGE)
        value = np.where(inside, (data | 0x20).astype(np.uint64) * _POWERS[place], np.uint64(0))
        code = np.add.reduceat(value, at)
        length = np.add.reduceat(inside.astype(np.int64), at)
        n_words = np.bincount(owner, minlength=n)
        words = np.maximum(1, n_words)
        mean = np.bincount(owner, weights=length, minlength=n) / words
        out[:, _GROUPS] = np.minimum(mean, 40) / 10
        out[:, _GROUPS + 1] = np.sqrt(np.maximum(0, np.bincount(owner, weights=length**2, minlength=n) / words - mean**2)) / 10
        same = np.zeros(len(at), dtype=bool)
        same[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        out[:, _GROUPS + 2] = np.bincount(owner, weights=same, minlength=n) / words
        order = np.lexsort((code, owner))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        out[:, _GROUPS + 3] = np.bincount(owner[order], weights=new, minlength=n) / words
        upper = _GROUP[data[at]]
        out[:, _GROUPS + 4] = np.bincount(owner, weights=(upper == 3) | (upper == 4), minlength=n) / words
        tail = _GROUP[data[at + length - 1]]
        out[:, _GROUPS + 5] = np.bincount(owner, weights=tail >= 10, minlength=n) / words
        out[:, _GROUPS + 6] = n_words / 100
    return out


@dataclass(frozen=True)
class Model:
    """A passage encoder, the two halves of the attention gate, and the score of the weighted mean."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    decide: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8)

    def score(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag and the attention of each passage."""
        h, t, g, a, z, p = self._forward(self.scaled(x), first)
        return p, a

    def _forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        starts, sizes = first[:-1], np.diff(first)
        h = np.tanh(x @ self.encode[:-1] + self.encode[-1])
        t, g = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-(h @ self.gate)))
        s = (t * g) @ self.weigh
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = s / np.repeat(np.add.reduceat(s, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts)
        p = 1 / (1 + np.exp(-np.clip(z @ self.decide[:-1] + self.decide[-1], -30, 30)))
        return h, t, g, a, z, p


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam on the mean cross entropy of bags, in an order that ``seed`` sets."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-3)
    x = np.clip((x - mean) * scale, -8, 8)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {
        "encode": init(FEATURES + 1, HIDDEN), "tanh": init(HIDDEN, ATTENTION), "gate": init(HIDDEN, ATTENTION),
        "weigh": init(ATTENTION), "decide": init(HIDDEN + 1),
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    step, sizes = 0, np.diff(first)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            bags = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
            cut = np.concatenate([[0], np.cumsum(sizes[bags])])
            grad = _gradient(Model(mean, scale, **p), x[rows], cut, y[bags])
            step += 1
            for k, g in grad.items():
                g += 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, **p)


def _gradient(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    h, t, g, a, z, p = model._forward(x, first)
    starts, sizes = first[:-1], np.diff(first)
    d = (p - y) / len(y)
    dz = np.repeat(d[:, None] * model.decide[:-1], sizes, axis=0)
    da = (dz * h).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(da * a, starts), sizes))
    dtg = ds[:, None] * model.weigh
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = dz * a[:, None] + dt @ model.tanh.T + dg @ model.gate.T
    dx = dh * (1 - h * h)
    return {
        "encode": np.vstack([x.T @ dx, dx.sum(0)]), "tanh": h.T @ dt, "gate": h.T @ dg,
        "weigh": (t * g).T @ ds, "decide": np.concatenate([z.T @ d, [d.sum()]]),
    }


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_OF)) == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``most`` documents with a label that are not held out.

    Those are the first by a hash of their ids, whole; their features (a few hundred bytes a
    passage) come to the driver. A document that would bring them above TRAINING_PASSAGES is
    passed over as a whole, and fewer documents are taken if need be; if not one is small enough, that is an error. A
    document with several labels counts with the lowest; null labels and ids are left out. Without any usable
    label every score is 0.5.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    own = id_and_text(docs, id_col, text_col)
    passages = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE))
    found = own.select("doc_id", passages.alias("n")).join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.sum("n").alias("n"))
    first = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    taken, size = [], 0
    for r in first:
        if size + r["n"] <= TRAINING_PASSAGES:
            taken.append(r)
            size += r["n"]
    if first and not taken:
        raise ValueError(f"every labelled document has more than {TRAINING_PASSAGES} passages of {PASSAGE} bytes")
    found = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in taken], found.select("doc_id", "y").schema)
    bags = own.join(F.broadcast(found), "doc_id")  # bounded by ``most``, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                x, first = passage_features(texts)
                data = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("y").cast(pa.float64()), pa.array(data, pa.binary())], ["doc_id", "y", "x"]
                )

    got = bags.mapInArrow(run, "doc_id long, y double, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not got:
        zero = np.zeros
        return Model(zero(FEATURES), zero(FEATURES), zero((FEATURES + 1, HIDDEN)), zero((HIDDEN, ATTENTION)),
                     zero((HIDDEN, ATTENTION)), zero(ATTENTION), zero(HIDDEN + 1))
    parts = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in got]
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return fit(np.concatenate(parts), first, np.array([r["y"] for r in got]).clip(0, 1))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages, focus`` for every whole text: the score from 0 to 1, the
    number of passages and the one (from 0) with the largest weight. A null text is
    empty, an empty one a single empty passage; null ids and repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                score, n, focus = _scores(model, texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(score), pa.array(n, pa.int64()), pa.array(focus, pa.int64())],
                    ["doc_id", "score", "passages", "focus"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, passages long, focus long")


def _scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, first = passage_features(texts)
    score, weight = model.score(x, first)
    size = np.diff(first)
    top = weight == np.repeat(np.maximum.reduceat(weight, first[:-1]), size)
    focus = np.minimum.reduceat(np.where(top, np.arange(len(weight)), len(weight)), first[:-1]) - first[:-1]
    return score.astype(np.float64), size, focus


def keep_good(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    schema = small_batches(docs).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            keep, at, held = [], 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held > SLICE_CHARS or i == len(texts) - 1:
                    keep.append(_scores(model, texts[at : i + 1])[0] >= cut)
                    at, held = i + 1, 0
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))
        release_memory()

    return docs.mapInArrow(run, schema)
