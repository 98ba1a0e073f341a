import pytest
from pyspark.sql import functions as F

from loomlog.functions import similarity as S
from loomlog.functions import text as T
from tests import plain

LINES = [
    "Error: UUID-4f8a9b2c failed processing", "", "   ", "123 456", "größe ok", "ÉTAT", "éa xy",
    "abcdefabc", "abcdefab", "ambidextrous", "z" * 20, "z" * 21, "Ⅷab हिन्दी", "a𝐀b 𝐀𝐁",
    "naïve café CAFÉ", "ABC def\tGHI", "don't stop", "x1y2z3 v1beta1 k8s", "ħabc ħħabcd",
    "abcdefghijka abcdefghijkl abcdefghijklm", "中 国 中文日志", "ſKİ strange", " 　",
]


def rows(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1:] for r in sorted(df.select("i", *cols).collect())]


@pytest.mark.parametrize("flag", [True, False])
def test_normalize(spark, flag):
    got = rows(spark, LINES, T.normalize("v", flag))
    alphabetic_marks = {"Ⅷab हिन्दी"}  # Python's isalpha lacks these classes
    for line, (text,) in zip(LINES, got):
        if line not in alphabetic_marks:
            assert text == plain.normalize(line, flag), line


def test_known_texts(spark):
    def one(v, flag=True):
        return rows(spark, [v], T.normalize("v", flag))[0][0]

    assert one(LINES[0]) == "error uuid failed processing"
    assert one("größe ok") == "" and one("größe ok", False) == "größe"
    assert one("ÉTAT", False) == "État"
    assert one("éa xy", False) == "éa"
    assert one("abcdefabc") == "" and one("abcdefab") == "abcdefab"
    assert one("ambidextrous") == ""
    assert one("z" * 20) == "z" * 20 and one("z" * 21) == ""
    # vowel signs are alphabetic, the virama is not
    assert one("Ⅷab हिन्दी", False) == "Ⅷab हिन दी"


def test_nonsense(spark):
    words = ["k8s", "v1beta1", "12345", "a1b2c3", "deadbeef99", "hello", "ab", "größe", "z" * 21,
             "1a2", "12a", "abcdefghijkl", "ABCDEFABC", "éééabc"]
    got = rows(spark, words, T.is_nonsense("v"))
    assert [g for (g,) in got] == [plain._nonsense(w) for w in words]


def test_template_filter_drops_wordless(spark):
    df = spark.createDataFrame([(v,) for v in LINES], "line string")
    got = sorted(r.normalized_text for r in T.with_template(df).collect())
    assert got == sorted(t for t in map(plain.normalize, LINES) if t)


def test_bigrams(spark):
    values = ["aaa", "中", "", "a", "ab", "é", "𝐀𝐁c", "one two"]
    assert [g for (g,) in rows(spark, values, T.bigrams("v"))] == [plain.bigrams(v) for v in values]


def test_similarities(spark):
    texts = ["night", "nacht", "aaaa", "aaab", "", "a", "中", "国", "中国", "error failed", "error failing",
             "connection timeout database", "connection timeouts databases", "größe maß", "grösse mass"]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    t = 0.6
    got = df.select(
        "a", "b", S.dice_bigrams("a", "b"), S.dice_chars("a", "b"), S.similarity("a", "b", t),
        S.char_overlap("a", "b", t),
    ).collect()
    for a, b, bi, ch, sim, over in got:
        assert bi == plain.dice_bigrams(a, b), (a, b)
        assert ch == plain.dice_chars(a, b), (a, b)
        assert sim == plain.similarity(a, b, t), (a, b)
        assert over == (plain.dice_chars(a, b) >= 0.75 * t)
    assert plain.dice_bigrams("night", "nacht") == 0.25
    assert plain.dice_bigrams("aaaa", "aaab") == 2 / 6


def test_long_text_is_linear(spark):
    df = spark.range(1).select(F.repeat(F.lit("lorem ipsum dolor "), 20_000).alias("t"))
    assert df.select(F.size(T.bigrams("t"))).head()[0] == 18 * 20_000 - 1


def test_bigrams_of_ascii_texts(spark):
    """One pattern gives the pairs of an ASCII text, line breaks and repeats too; other texts are split."""
    texts = ["ab", "a", "", "aaaa", "a\nb c\r\n", "a.*\\$(", "x" * 3000, "é", "éa", "naïve text", "a\U0001f600b", "\x00a\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.bigrams("t").alias("b"))
    assert {r.t: r.b for r in df.collect()} == {t: plain.bigrams(t) for t in texts}
    assert spark.createDataFrame([(None,)], "t string").select(T.bigrams("t").alias("b")).head().b is None
    assert "regexp_extract_all" in df._jdf.queryExecution().toString()
