"""Periodic runs, BPE round trips and token alignment against plain Python and the libraries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomlog.llm import periodic_runs, queries, speculative_bpe, token_alignment
from tests.llm.plain import sha

WORD = P.path("word_bpe_49k.json")
A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, runs string, ids int, row int, groups string, decoded string"


def docs_of(spark, texts):
    """Texts with ids 0, 1, ..., null and repeated rows, and columns named like those of the results."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b a b a b a b"), (0, texts[0])]
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z") for i, t in rows], SCHEMA).repartition(3), rows


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            end = i + q
            if i > start and end - start >= max(6, 4 * q):
                if not any(q % d == 0 and all(x[k] == x[k + d] for k in range(start, end - d)) for d in range(1, q)):
                    out.append((start, end - start, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def word_list(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("b", [1, 2, 8, 64, 512])
def test_squared_differences(b):
    """Exact, also where the sums are beyond one prime."""
    rng = np.random.default_rng(b)
    rows = rng.integers(0, 2 if b < 8 else 1 + (np.arange(20) % 3)[:, None], (20, 3 * b))
    rows[0] = np.arange(3 * b)
    rows[1, b:] = np.concatenate([rows[1, :b]] * 2)
    got = periodic_runs.squared_differences_vanish(rows)
    for row, zero in zip(rows, got):
        assert zero.tolist() == [bool((row[:b] == row[b + e : 2 * b + e]).all()) for e in range(b)]


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for k in range(1500):
        letters, x = rnd.choice([1, 2, 3, 6]), []
        while len(x) < rnd.randrange(150):
            piece = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 15))]
            x += (piece * rnd.randrange(1, 9))[: rnd.randrange(1, 70)]
        got = periodic_runs.find_runs(np.array(x, dtype=np.int64))
        assert [tuple(r) for r in got.tolist()] == plain_runs(x), x


def test_periodic_documents(spark):
    rnd = random.Random(6)
    texts = ["", None, " \t\n", "a", "x\x1cy " * 9, "la " * 40 + "end " + "da di " * 9, "é\x0bé\x0cé é\né é ü", "A a " * 4, "1 2 3 " * 3 + "1 2 3"]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(300))) for _ in range(30)]
    long = [str(rnd.randrange(1000)) for _ in range(20_000)]
    texts.append(" ".join(long * 5 + ["z"] * 100_000))  # very long
    docs, rows = docs_of(spark, texts)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()]
    want = []
    for i, t in rows:
        words = word_list(t)
        runs = plain_runs(words) if len(words) < 1000 else [(0, 100_000, 20_000), (100_000, 100_000, 1)]
        want.append((i, len(words), runs, plain_collapsed(words, runs)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def planted(doc_id, text):
    words, h = word_list(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_op11_digests(spark, tmp_path):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", None, "a a a a a a b b b b b b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = 0
    for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        words = planted(r.doc_id, texts[r.doc_id])
        runs = plain_runs(words)
        found += bool(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(plain_collapsed(words, runs))
    assert found > 5


# --- BPE ---------------------------------------------------------------------------


def bpe_texts():
    rnd = random.Random(8)
    texts = [
        "", None, "  \n\t", "<|endoftext|>", "a<|endoftext|>B <|ENDOFTEXT|> x<|startoftext|><|endoftext|>'s  <|endoftext|> 's",
        "Don't I'LL 'sit x's''s 'VE", "a.\x01b x)\x1bfoo ..\x1c.. \x85 a\xa0b 　 é É", "Å É İ ſ ß ΑΣ σς é ́",
        "ꟋꟜ \U0001f600 हिन्दी 日本語", "-" * 777, "ab" * 3000, "q" * 101 + " " + "xkcd" * 30,
        "".join(rnd.choice("abcdefgh") for _ in range(150_000)), "word " * 500_000,  # very long
    ]
    texts += ["".join(rnd.choice("abcdeinstrhüÉ' .,!0<|>") for _ in range(rnd.randrange(300))) for _ in range(300)]
    return texts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_bpe_round_trip(spark, library):
    docs, rows = docs_of(spark, bpe_texts())
    encoded = speculative_bpe.encode_documents(docs, WORD)
    both = speculative_bpe.decode_column(encoded.withColumn("DECODED", F.lit(1)), WORD).collect()
    assert both[0].__fields__ == ["doc_id", "ids", "decoded"]
    key = lambda r: (r[0] is None, r[0] or 0)
    for got, (i, t) in zip(sorted(both, key=key), sorted(rows, key=key)):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got.doc_id == i and got.ids == want, t[:100]
        assert got.decoded == library.decode(want, skip_special_tokens=False)
    assert speculative_bpe.encode_documents(docs.limit(0), WORD).count() == 0


def test_words_of_all_merges(library):
    """Concatenated tokens, most of which the guess gets wrong."""
    rnd, encoder = random.Random(9), speculative_bpe.SpeculativeBPE(WORD)
    tokens = sorted(t.replace("</w>", "") for t in library.get_vocab())
    texts = [" ".join("".join(rnd.choice(tokens) for _ in range(rnd.randrange(1, 6))) for _ in range(50)) for _ in range(200)]
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.failed > 0.05 * encoder.guessed


def test_every_code_point(library):
    encoder = speculative_bpe.SpeculativeBPE(WORD)
    texts = [f"a{chr(c)}B" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 20_000):
        want = library.encode_batch(texts[i : i + 20_000], add_special_tokens=False)
        for t, x, e in zip(texts[i : i + 20_000], encoder.encode(texts[i : i + 20_000]), want):
            assert x.tolist() == e.ids, hex(ord(t[1]))


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, [320, None, -1, 10**6, 49407]), (2, None), (3, [])], "k long, ids array<int>")
    got = {r.k: r.decoded for r in speculative_bpe.decode_column(df, WORD).collect()}
    assert got == {1: "a</w> <|endoftext|>", 2: None, 3: ""}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        speculative_bpe.SpeculativeBPE(A_PATH)


# --- alignment ---------------------------------------------------------------------


def plain_alignment(texts):
    """What op13 gives for each text, by dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    rows, count = [], collections.Counter()
    for t in texts:
        full, ends, groups = (" " + (t or "")).encode(), [], []
        ids = [a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)] if t else [[], []]
        spelled = [[bytes(byte[c] for c in a_model.id_to_token(i)) for i in ids[0]], []]
        for i in ids[1]:
            p = b_model.id_to_piece(i)
            spelled[1].append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
        if b"".join(spelled[0]) != full or b"".join(spelled[1]) != full:
            ids, spelled = [[], []], [[], []]
        for tokens in spelled:
            at, here = 0, []
            for x in tokens:
                at += len(x)
                here.append(at)
            ends.append(here)
        links = [(y, x) for x, e in zip(ids[0], ends[0]) for y, f in zip(ids[1], ends[1]) if e == f] if len(full) < 3000 else None
        if links is None:
            at_b = dict(zip(ends[1], ids[1]))
            links = [(at_b[e], x) for x, e in zip(ids[0], ends[0]) if e in at_b]
        start = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            sides = [",".join(str(x) for x, e in zip(ids[s], ends[s]) if start < e <= end) for s in (0, 1)] if len(full) < 3000 else []
            groups.append("|".join(sides))
            start = end
        count.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    highest = collections.Counter()
    for (y, _), n in count.items():
        highest[y] = max(highest[y], n)
    return [(a, b, g, len(ls), sum(count[k] == highest[k[0]] for k in ls), sum(count[k] for k in ls), text) for a, b, g, ls, text in rows]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, small):
    """Also with many short runs, merged two at a time over several levels."""
    rnd = random.Random(10)
    texts = ["", None, "the cat", "the cat", "ends in a blank ", "two  ", "a  b\tc\n\nd", "<|endoftext|> x<s>", "▁ spaced", "é日本\U0001f600\x00\x07", "   ", "x" * 400]
    texts += ["".join(rnd.choice(["the", " ", "tion", "é", "a", ".", "\n", "日", "in", "  "]) for _ in range(rnd.randrange(60))) for _ in range(120)]
    texts.append("the quick brown fox " * 20_000)  # very long
    docs, rows = docs_of(spark, texts)
    options = {"run_records": 0, "fan_in": 2, "return_runs": 1} if small else {}
    got = token_alignment.alignment_counts(docs, A_PATH, B_PATH, **options)
    want = plain_alignment([t for _, t in rows])
    found = sorted((r.doc_id is None, r.doc_id or 0, tuple(r)[1:7], len(r.groups) if len(r.groups) > 5000 else r.groups) for r in got.collect())
    assert len(found) == len(rows)
    for (_, _, numbers, groups), (i, t), w in zip(
        found, *zip(*sorted(zip(rows, want), key=lambda p: (p[0][0] is None, p[0][0] or 0)))
    ):
        assert numbers == w[:6], (i, t[:50])
        assert isinstance(groups, int) or groups == w[6], (i, t)
    empty = token_alignment.alignment_counts(docs.limit(0), A_PATH, B_PATH)
    assert empty.count() == 0


def test_merge_levels(spark):
    """Totals of nine runs in levels of two, with pairs that several runs share."""
    rnd, want, chunks = random.Random(11), collections.Counter(), []
    for run in range(9):
        pairs = np.array([rnd.randrange(200) << 24 | rnd.randrange(5) for _ in range(300)], dtype=np.int64)
        want.update(pairs.tolist())
        chunks += [(c["radix"], c["run"], c["pairs"], c["totals"]) for c in token_alignment._run(run, pairs, np.arange(300))]
    df = spark.createDataFrame(chunks, "radix int, run long, pairs binary, totals binary")
    got = {}
    for row in token_alignment.merge_totals(df, 9, 2).collect():
        pairs = token_alignment._unpack(row.pairs)
        assert (np.diff(pairs) > 0).all()
        got |= dict(zip(pairs.tolist(), token_alignment._unpack(row.totals).tolist()))
    assert got == dict(want)


def test_round_three_digests(spark, tmp_path, library):
    texts = ["The cat sat. The cat sat.", "", None, "日本語 tokens", "▁"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_bpe_round_trip(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    want = plain_alignment(texts)
    for r in queries.op13_token_alignment(spark, str(tmp_path)).collect():
        w = want[r.doc_id]
        assert tuple(r)[1:] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")
