"""Fingerprints, quality scores and secrets against slow plain versions, also of very long texts."""

import math
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomlog.llm import lz_fingerprint, quality, queries, secret_scan
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def plain_signature(text):
    """Minimum hashes of the phrase set, one component and phrase at a time."""
    found = plain.lz_phrases(text)
    if not found:
        return "ffff" * lz_fingerprint.COMPONENTS
    hashes, out, word = [xxhash.xxh3_64_intdigest(p) for p in found], "", (1 << 64) - 1
    for i in range(lz_fingerprint.COMPONENTS):
        multiply, add = 0x9E3779B97F4A7C15 * (2 * i + 1) & word | 1, 0xC2B2AE3D27D4EB4F * (i + 1) & word
        least = min((h * multiply + add) & word for h in hashes)
        out += f"{(least * 0x9E3779B97F4A7C15 & word) >> 40 & 0xFFFF:04x}"
    return out


def alike(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / lz_fingerprint.COMPONENTS


@pytest.mark.parametrize("n", [1, 2, 40])
def test_edited_fingerprints(spark, n):
    """With nulls, empty and repeated texts, and equal ids, whose order is found from the digests."""
    rng = random.Random(n)
    docs = [(7 * i - 90, "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 50)))) for i in range(n)]
    if n == 40:
        docs += [(500, None), (501, ""), (502, docs[3][1]), (503, docs[3][1]), (None, "first of all documents")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, edited_fingerprint int").repartition(4)
    got = {r.doc_id: r for r in lz_fingerprint.compare_with_next(df).collect()}
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(order)
    for k, (d, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = plain_signature(text), plain_signature(edited), plain_signature(following)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), plain.sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert (r.near_edited, r.near_next) == (alike(own, other), alike(own, after))


def test_ties_of_ids(spark):
    """Rows with one id follow each other in some order; each is compared with a row that may follow it."""
    docs = [(1, "one text here"), (2, "second text"), (2, "second text"), (2, "another second"), (3, "third and last text")]
    got = lz_fingerprint.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == sorted((d, len(t)) for d, t in docs)
    texts = {plain_signature(t): t for _, t in docs}
    followed = []
    for r in got:
        own = texts[r.fingerprint]
        half = len(own) // 2
        may = [t for _, t in docs if plain.sha(own[: len(own) - half] + t[:half]) == r.edited_sha256]
        assert may and any(r.near_next == alike(r.fingerprint, plain_signature(t)) for t in may)
        assert any(r.edited_fingerprint == plain_signature(own[: len(own) - half] + t[:half]) for t in may)
        followed.append(may[0])
    assert len(followed) == len(docs)


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    found, left = set(), ""
    for c in text:
        left += c
        if left not in found:
            found.add(left)
            left = ""
    assert lz_fingerprint.phrases(text) == (found, left)


def test_forward_pass():
    """The score of each bag by plain sums over its passages."""
    rng = np.random.default_rng(1)
    shapes = {"encode": (quality.FEATURES + 1, 5), "tanh": (5, 3), "gate": (5, 3), "weigh": (3,), "decide": (6,)}
    p = {k: rng.normal(size=s) for k, s in shapes.items()}
    mean, scale = rng.normal(size=quality.FEATURES), np.abs(rng.normal(size=quality.FEATURES)) + 0.1
    x, first = rng.normal(size=(9, quality.FEATURES)) * 20, [0, 1, 5, 9]
    scores, attention = quality.Model(mean, scale, **p).score(x, np.array(first))
    n = quality.FEATURES
    for bag in range(3):
        encoded, raw = [], []
        for row in x[first[bag] : first[bag + 1]]:
            z = [min(8, max(-8, (row[j] - mean[j]) * scale[j])) for j in range(n)]
            h = [math.tanh(sum(z[j] * p["encode"][j][k] for j in range(n)) + p["encode"][n][k]) for k in range(5)]
            t = [math.tanh(sum(h[k] * p["tanh"][k][a] for k in range(5))) for a in range(3)]
            g = [1 / (1 + math.exp(-sum(h[k] * p["gate"][k][a] for k in range(5)))) for a in range(3)]
            raw.append(sum(t[a] * g[a] * p["weigh"][a] for a in range(3)))
            encoded.append(h)
        weights = [math.exp(r) / sum(map(math.exp, raw)) for r in raw]
        pooled = [sum(w * h[k] for w, h in zip(weights, encoded)) for k in range(5)]
        score = 1 / (1 + math.exp(-(sum(v * p["decide"][k] for k, v in enumerate(pooled)) + p["decide"][5])))
        assert abs(scores[bag] - score) < 1e-9
        assert np.allclose(attention[first[bag] : first[bag + 1]], weights)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_of_each_class(spark):
    """A constant answer would be right for one class only."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(quality.held_out(F.col("doc_id")))
    rows = labels.join(queries.op1_quality(spark, SF), "doc_id").select("quality", "predicted").collect()
    for label in (0, 1):
        own = [r.predicted == label for r in rows if r.quality == label]
        assert len(own) >= 5 and np.mean(own) > 0.95


def test_secrets_of_a_very_long_text(spark):
    rng = random.Random(5)
    words = ["password = hunter2x9", "AKIA" + "Q7" * 9, "deadbeef" * 4, "plain words", "token:'abc.def/ghi'", "ümlaut"]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    (r,) = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.base == plain.base_spans(text) and r.n_hex > 1000
