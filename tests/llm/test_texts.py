"""Operators that look at one document at a time, against plain rules and the libraries."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import lz_fingerprint, packing, quality, queries, secret_scan, token_files, token_transducer
from loomlog.llm.token_ids import PieceTokenizer
from loomlog.llm.token_transducer import Transducer
from loomlog.workspace import Workspace
from tests.llm import plain

SF = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path()
ODD = [
    "", " \n", "a<|endoftext|>B's", "<|ENDOFTEXT|>", "don't 'tis x's 's's !'s", "İstanbul ΣΑΣ straße ŉ", "a b\x1cc",
    "é éa ”.a “'s", "日本語 テスト 한국어", "😀😀 123 ½²", "aaaa" * 900, "!?" * 300, "x" * 3000 + " y", "\x00\x01",
]
NULLS = "doc_id long, text string, n_tokens string, score string"


def random_texts(n, seed):
    rng = random.Random(seed)
    sets = ["abcdefghij", "ABCÉÖ", "eiou th in", "'s!? .,", "éèüßñ012", "<|>*#", "İΣ“”́²½一あ  \x85\n"]
    return ["".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    return Transducer(PATH)


def test_transducer_counts_like_the_library(machine, library):
    texts = ODD + random_texts(3000, 1)
    assert machine.counts(texts).tolist() == [len(i) for i in library(texts)]


def test_transducer_knows_every_code_point(machine, library):
    texts = [f"a{chr(c)}B1{chr(c)}!" for c in range(0x110000) if not (0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or c >= 0xF0000)]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        wrong = [hex(ord(t[1])) for t, n, ids in zip(part, machine.counts(part).tolist(), library(part)) if n != len(ids)]
        assert not wrong


def test_transducer_after_a_flush_and_in_one_lane(machine, library, monkeypatch):
    texts = random_texts(200, 2) + ["ab" * 2000]
    want = [len(i) for i in library(texts)]
    monkeypatch.setattr(token_transducer, "MAX_STATES", 10)
    assert machine.counts(texts).tolist() == want
    assert machine.counts(texts).tolist() == want
    monkeypatch.setattr(token_transducer, "LANES", 1)
    assert machine.counts(texts).tolist() == want


def test_transducer_cuts_long_texts(machine, library, monkeypatch):
    from loomlog.llm import common

    monkeypatch.setattr(common, "LONG_TEXT", 50)
    monkeypatch.setattr(token_transducer, "SLICE_CHARS", 200)
    text = " ".join(random_texts(300, 3))
    assert machine.counts([text, "", text]).tolist() == [len(library([text])[0]), 0, len(library([text])[0])]


def test_pieces_give_the_library_ids(library, monkeypatch):
    t = PieceTokenizer(PATH)
    texts = ODD + random_texts(3000, 4)
    want = library(texts)
    assert [x.tolist() for x in t.ids(texts, 1)] == [i + [1] for i in want]
    from loomlog.llm import common, token_ids

    monkeypatch.setattr(common, "LONG_TEXT", 40)
    monkeypatch.setattr(token_ids, "LONG_TEXT", 40)
    assert [x.tolist() for x in t.ids(texts)] == want


def test_control_characters_go_on_a_run_of_punctuation(library, machine):
    rng = random.Random(10)
    controls = [chr(c) for c in (*range(0x21), 0x7F)]
    texts = [f"{a}{c}{b}" for c in controls for a in ("a.", "x)", "(", "..", "***", "!!!!!", "});", "a", "1", "'") for b in ("", "b", "..", "'s", "1")]
    sets = ["ab", "AÉ", "!.,)(*;", "'s", "12", "".join(controls)]
    texts += ["".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = library(texts)
    assert [x.tolist() for x in PieceTokenizer(PATH).ids(texts)] == want
    assert machine.counts(texts).tolist() == [len(i) for i in want]


def nasty(spark):
    rows = [(3, "The cat sat.", "x", "y"), (None, "the dog", None, None), (1, None, "x", "y"), (2, "", "x", "y"),
            (3, "The cat sat.", "x", "y"), (9, "word " * 4000, "x", "y")]
    return spark.createDataFrame(rows, NULLS)


def test_token_counts_of_odd_rows(spark, library):
    got = sorted(token_transducer.count_tokens(nasty(spark), PATH, 2048).collect(), key=str)
    want = sorted(
        [(d, len((t or "").encode()), len(library([t or ""])[0]), len(library([t or ""])[0]) > 2048)
         for d, t, *_ in nasty(spark).collect()], key=lambda r: str(r)
    )
    assert sorted(map(tuple, got), key=str) == want
    assert token_transducer.count_tokens(spark.createDataFrame([], NULLS), PATH, 5).count() == 0


def check_pieces(rows, docs, library):
    """Every id of every document in one piece; sequences gapless, full or powers of two."""
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for d, t in docs:
        ids = library([t or ""])[0] + [1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), plain.crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    groups = {}
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
        groups.setdefault(parts[0].step_group, []).append(at)
    assert all(len(set(g)) == 1 and sum(g) <= packing.STEP_TOKENS for g in groups.values())
    return sum(r.length for r in rows)


def test_packing(spark, library):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["ab", "cat", "zq1"]) for _ in range(rng.choice([0, 3, 90, 400, 900, 5000])))) for i in range(60)]
    docs.append((100, None))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert check_pieces(packing.pack_documents(df, PATH).collect(), docs, library)


def test_packing_of_odd_rows(spark):
    rows = packing.pack_documents(nasty(spark).coalesce(1), PATH).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 9}
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert packing.pack_documents(spark.createDataFrame([], NULLS), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(nasty(spark), PATH, tiers=(100, 2048))


def test_packing_balances_steps():
    p = packing.Packer(packing.TIERS, 4096, 0)
    for i in range(100):
        p.add(i, np.ones(300, dtype="<u4"))
    p.pack()
    p.finish()
    full = {}
    for r in p.rows:
        full[r[8]] = full.get(r[8], 0) + r[2]
    assert sum(full.values()) == 30_000 and list(full.values()).count(4096) >= 6


def test_token_files(spark, library, tmp_path):
    path = f"file://{tmp_path}/files"
    df = nasty(spark).repartition(4)
    token_files.write_token_files(df, path, PATH)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 9]
    at = 0
    for r, t in zip(got, ["the dog", "", "", "The cat sat.", "The cat sat.", "word " * 4000]):
        ids = library([t])[0] + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), plain.crc(ids))
        at += len(ids)
    empty = Workspace(spark).path
    token_files.write_token_files(spark.createDataFrame([], NULLS), empty, PATH)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_of_another_store(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(nasty(spark), path, PATH, shards=2)
    want = sorted(map(str, token_files.read_token_files(spark, path).collect()))
    # a store that cannot be mapped is read in ranges
    class Other(type(token_files.file_store(path)[0])):
        pass

    monkeypatch.setattr(token_files.fs, "LocalFileSystem", Other)
    store, root = token_files.fs.FileSystem.from_uri(path)
    flat = token_files._map(store, f"{root}/shard-00000.idx", "<i8", 1)
    assert flat[0] >= 0 and len(want) == 6


def test_secret_spans():
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [
        "", "token=token:abcdefg", "PassWord : 'abc123x' api_key=short", f"x {key}. {key[:-1]}", "deadbeef" * 3, "deadbeef" * 2,
        'APIKEY="a.b/c=d+e-f" secret=1', "toKen=abcdef tokEn=abcdef", "é token = é token = abcdef",
    ]
    texts += random_secrets(3000)
    for t in texts:
        assert secret_scan._joined(secret_scan.base_spans(t)) == plain.base_spans(t), t


def random_secrets(n):
    rng = random.Random(8)
    parts = ["token", "Secret", "api_key", "passwd", "=", ":", " ", '"', "'", "AKIA", "0123456789ABCDEF", "abc", "f" * 12, "deadbeef", "\n", "é", "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_entropy_windows_count_like_a_fresh_window():
    from collections import Counter
    from math import log2

    rng = random.Random(9)
    for limit in (2.0, 3.0, 3.7):
        s = "".join(rng.choice("abcdefgh0123XYZ"[: rng.randint(2, 15)]) for _ in range(200))
        hot = [
            i for i in range(len(s) - 19)
            if -sum(c / 20 * log2(c / 20) for c in Counter(s[i : i + 20]).values()) >= limit - 1e-12
        ]
        covered = {p for i in hot for p in range(i, i + 20)}
        got = {p for a, b in secret_scan.hot_windows(s, limit) for p in range(a, b)}
        assert got == covered


def test_entropy_and_allow_list():
    secret = "q7Zk2Lw9Xc4Vb8Nm1Ta6Re3Yu5Io0P"
    assert secret_scan.entropy_spans(f"use {secret} now") == [(4, 3, 4 + len(secret))]
    for harmless in ("thonanonoranthendedthing", "some_long_name/with_parts/of-words", "123e4567-e89b-12d3-a456-426614174000"):
        assert secret_scan.entropy_spans(harmless) == []


def test_what_is_glued_to_a_secret_does_not_hide_it():
    rng = random.Random(11)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    sets = ((digits + "ABCDEF", 32), (digits, 24), (upper + lower, 32), (upper + lower + digits, 24), (upper + lower + "7", 30))
    for chars, n in sets:
        found = 0
        for _ in range(300):
            value = "".join(rng.choice(chars) for _ in range(n))
            alone = {p for a, _, b in secret_scan.entropy_spans(value) for p in range(a, b)}
            found += bool(alone)
            for name in ("key=", "id-", "/v1/x/", "AA=", "name=", "some_name/", "x+"):
                for tail in ("", "=", "/end"):
                    spans = secret_scan.entropy_spans(name + value + tail)
                    assert alone <= {p - len(name) for a, _, b in spans for p in range(a, b)}, name + value + tail
                    assert all(x[2] < y[0] for x, y in zip(spans, spans[1:]))
        assert found > 100


def test_windows_have_the_limit_of_their_own_class():
    from collections import Counter
    from math import log2

    rng = random.Random(12)
    sets = ["0123456789", "0123456789ABCDEF", "abcdefghijKLMNOPQRST", "=-_/+", "abc123XYZ"]
    for _ in range(300):
        s = "".join(rng.choice(rng.choice(sets)) if rng.random() < 0.1 else c for c in "".join(rng.choice(x) for x in rng.sample(sets, 3) for _ in range(30)))
        bits = [-sum(c / 20 * log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19)]
        hot = [i for i, b in enumerate(bits) if b >= min(3.9, secret_scan.character_class(s[i : i + 20])[1]) - 1e-12]
        got = {p for a, b in secret_scan.hot_windows(s, 3.9, narrow=True) for p in range(a, b)}
        assert got == {p for i in hot for p in range(i, i + 20)}


def test_secret_scan_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "token=abcdef", "y"), (2, "token=abcdef", "y"), (2, "token=abcdef", "y")],
                               "doc_id long, text string, spans string")
    rows = sorted(map(tuple, secret_scan.scan_secrets(df).select("doc_id", "n_assign", "base").collect()), key=str)
    assert rows == sorted([(1, 0, ""), (None, 1, "assign:0:12"), (2, 1, "assign:0:12"), (2, 1, "assign:0:12")], key=str)
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_lz_phrases():
    for t in ["", "a", "aaaaaaa", "abababab", *random_texts(200, 6)]:
        assert lz_fingerprint.phrases(t)[0] == plain.lz_phrases(t)
    s = [lz_fingerprint.signature(*lz_fingerprint.phrases(t)) for t in ("abc" * 50, "abc" * 50, "xyz" * 50, "", "")]
    like = lz_fingerprint.likeness
    assert like(s[0], s[1]) == 1 and like(s[0], s[2]) < 0.1 and like(s[3], s[4]) == 1 and like(s[0], s[3]) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 60])
def test_next_documents(spark, n):
    rng = random.Random(n)
    docs = [(i * 3 - 20, "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 40)))) for i in range(n)]
    if n == 60:
        docs += [(None, "first of all"), (docs[5][0], docs[5][1]), (docs[9][0], None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).repartition(5)
    got = lz_fingerprint.compare_with_next(df).collect()
    assert len(got) == len(docs)
    if n == 60:
        return
    order = sorted(docs)
    want = {}
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % n][1]
        want[d] = (len(t), plain.sha(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]), nxt)
    prints = {r.doc_id: r.fingerprint for r in lz_fingerprint.fingerprints(df).collect()}
    for r in got:
        chars, sha, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (chars, sha, prints[r.doc_id])
        a, b = (lz_fingerprint.signature(*lz_fingerprint.phrases(t)) for t in (dict(docs)[r.doc_id], nxt))
        assert r.near_next == lz_fingerprint.likeness(a, b)


def test_passages_do_not_depend_on_the_batch(monkeypatch):
    texts = ["", "Short one.", "word " * 700, "É!! " * 300]
    whole, first = quality.passage_features(texts)
    single = [quality.passage_features([t])[0] for t in texts]
    assert np.array_equal(whole, np.concatenate(single)) and first.tolist() == [0, 1, 2, 9, 12]
    monkeypatch.setattr(quality, "PART", quality.PASSAGE)
    assert np.array_equal(quality.passage_features(texts)[0], whole)


def test_gradient():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(6, quality.FEATURES)), np.array([0, 2, 3, 6]), np.array([1.0, 0.0, 1.0])
    p = {"encode": (quality.FEATURES + 1, 5), "tanh": (5, 3), "gate": (5, 3), "weigh": (3,), "decide": (6,)}
    p = {k: rng.normal(size=s) * 0.3 for k, s in p.items()}

    def loss(p):
        s = quality.Model(np.zeros(1), np.ones(1), **p)._forward(x, first)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = quality._gradient(quality.Model(np.zeros(1), np.ones(1), **p), x, first, y)
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += 1e-6
        down[k][i] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - grad[k][i]) < 1e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op1_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in labels)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.9


def test_quality_without_labels_and_odd_rows(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = quality.train(nasty(spark), none)
    rows = quality.score_documents(nasty(spark), model).collect()
    assert len(rows) == 6 and all(r.score == 0.5 for r in rows)
    assert quality.keep_good(nasty(spark), model).count() == 6
    assert quality.keep_good(nasty(spark), model, 0.6).columns == nasty(spark).columns
    assert quality.keep_good(spark.createDataFrame([], NULLS), model).count() == 0


def test_training_passages_are_bounded_by_whole_documents(spark, monkeypatch):
    texts = ["é" * 300 * (i % 7) for i in range(60)] + ["long " * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, texts[4])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    bags = []
    monkeypatch.setattr(quality, "fit", lambda x, first, y: bags.append((x, first, y)))
    for most in (40, 10**6):
        monkeypatch.setattr(quality, "TRAINING_PASSAGES", most, raising=False)
        quality.train(docs, labels)
    whole = {quality.passage_features([t])[0].tobytes() for t in texts}
    for x, first, y in bags:
        assert all(x[a:b].tobytes() in whole for a, b in zip(first[:-1], first[1:]))
    few, every = ((len(x), len(y)) for x, _, y in bags)
    assert 35 < few[0] <= 40 and few[1] > 5
    usable = [r.doc_id for r in docs.where(~quality.held_out(F.col("doc_id"))).collect()]
    assert every == (sum(len(quality.passage_features([texts[d]])[0]) for d in usable), len(usable))
    monkeypatch.setattr(quality, "TRAINING_PASSAGES", 0, raising=False)
    with pytest.raises(ValueError):
        quality.train(docs, labels)
