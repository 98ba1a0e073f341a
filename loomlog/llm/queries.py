"""The registered queries of this folder, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import (
    line_dedup, lz_fingerprint, mixing, near_dedup, norm_search, packing, periodic_runs, quality, secret_scan, speculative_bpe,
    token_alignment, token_files, token_transducer,
)
from loomlog.llm.common import table
from loomlog.workspace import Workspace

TOKENIZER = "word_bpe_49k.json"
END_ID, TOKEN_LIMIT = 1, 2048
QUALITY_CUT = quality.CUT

#: Target weights; names that are not listed weigh 1. A domain is a group of sources.
DOMAINS = 4
WEIGHTS = ({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 4, "de": 2, "es": 2, "fr": 2}, {})
BUDGET_PERCENT, MAX_EPOCHS, SEED = 80, 2, 17


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted")
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "passages", "focus")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op3_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0", 5)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    sha = F.sha2("base", 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha, "spans", "n_entropy")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark).path + "/token-files"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def domain() -> F.Column:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("decimal(38,0)") % DOMAINS).cast("string")))


def mixed(docs: DataFrame, max_epochs: int) -> tuple[DataFrame, dict[str, str]]:
    levels = [domain(), F.col("lang"), F.col("source")]
    return mixing.mix(docs, levels, WEIGHTS, BUDGET_PERCENT, max_epochs, SEED, mixing.word_count("text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    chosen, n = mixed(docs, MAX_EPOCHS)
    return chosen.select("doc_id", F.col(n["l0"]).alias("domain"), F.col(n["l1"]).alias("lang"), F.col(n["l2"]).alias("source"),
                         F.col(n["n_tokens"]).alias("n_tokens"), F.col(n["epoch"]).alias("epoch"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), TOKEN_LIMIT)


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, in which the words of a tenth of the documents (by the crc32 of the id) repeat with one period from some word on."""
    space = r"[\x20\x09-\x0D]+"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_words")
    start = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - start) / (3 + g % 8))).cast("int")
    place = lambda i: F.when(i < F.col("_start"), i).otherwise(F.col("_start") + (i - F.col("_start")) % F.col("_period"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("_words", place(i) + 1)), " ")
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", space), lambda w: w != "")).alias("_words"))
    split = split.withColumns({"_start": F.when(n > 0, start), "_period": F.when(n > 0, period)})
    return split.select("doc_id", F.when(F.size("_words") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    order = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    longest = F.array_min(F.transform("runs", order))
    return found.withColumn("_m", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_m.s").alias("start"), (-F.col("_m.l")).alias("length"),
        F.col("_m.p").alias("period"), F.floor(1000 * -F.col("_m.l") / F.col("_m.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = speculative_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    decoded = speculative_bpe.decode_column(encoded, tokenizer_path())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    counted = token_alignment.alignment_counts(table(spark, sf_dir, "documents"), a, b, digest)
    return counted.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_packing, op3_norm_search, op4_secret_scan, op5_near_dedup, op6_token_files, op7_line_dedup,
        op8_mixing, op9_token_counts, op10_lz_fingerprint, op11_periodic_runs, op12_bpe_round_trip, op13_token_alignment,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
  where q.vec_id % 50 = 0
), r as (
  select query_id, vec_id, score,
    cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
  from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP7 = f"""
with l as (
  select doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)
), k as (
  select doc_id, i, line,
    translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') as key
  from l
), f as (
  select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), d as (
  select k.doc_id, k.i, k.line, coalesce(k.doc_id > f.first, false) as dropped from k left join f on k.key = f.key
)
select doc_id, count(*) as n_lines, cast(sum(cast(dropped as integer)) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from d group by doc_id
"""


def _weight_sql(level: int, column: str) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[level].items())
    return f"case {column} {cases} else 1 end" if cases else "1"


def _share_sql(nodes: str, parent: str) -> str:
    """Children of each parent with their share of its ``budget`` as ``own``."""
    return f"""
  select *, case when is_full then cap else least(cap, cast(
      (max(case when not is_full then rest end) over (partition by {parent})) * w
      // (max(case when not is_full then w_left end) over (partition by {parent})) as bigint)) end as own
  from (
    select *, cap::hugeint * w_left <= rest * w as is_full
    from (
      select *,
        budget::hugeint - coalesce(sum(cap) over (partition by {parent} order by cap / w, w, node
          rows between unbounded preceding and 1 preceding), 0)::hugeint as rest,
        (sum(w) over (partition by {parent} order by cap / w, w, node
          rows between current row and unbounded following))::hugeint as w_left
      from {nodes}
    )
  )"""


OP8 = f"""
with d as (
  select doc_id, coalesce(lang, '{mixing.NONE}') as l1, coalesce(source, '{mixing.NONE}') as l2,
    coalesce('d' || (cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') as hugeint) % {DOMAINS}), '{mixing.NONE}') as l0,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as t
  from documents
), leaves as (
  select l0, l1, l2, cast(sum(t) as bigint) as tokens, cast(sum(t) * {MAX_EPOCHS} as bigint) as cap from d group by all
), total as (select cast(coalesce(sum(tokens), 0) * {BUDGET_PERCENT} // 100 as bigint) as budget from leaves
), n0 as (
  select l0 as node, 0 as root, {_weight_sql(0, "l0")} as w, cast(sum(cap) as bigint) as cap, any_value(budget) as budget
  from leaves, total group by l0
), s0 as ({_share_sql("n0", "root")}
), n1 as (
  select l0, l1 as node, {_weight_sql(1, "l1")} as w, cast(sum(leaves.cap) as bigint) as cap, any_value(own) as budget
  from leaves join s0 on l0 = s0.node group by l0, l1
), s1 as ({_share_sql("n1", "l0")}
), n2 as (
  select leaves.l0, l1, l2 as node, {_weight_sql(2, "l2")} as w, leaves.cap, tokens, own as budget
  from leaves join s1 on leaves.l0 = s1.l0 and l1 = s1.node
), s2 as ({_share_sql("n2", "l0, l1")}
), p as (
  select l0, l1, node as l2, if(tokens = 0, 1, own // tokens) as n_full, if(tokens = 0, 0, own % tokens) as n_left from s2
), r as (
  select doc_id, d.l0, d.l1, d.l2, t, n_full, n_left, sum(t) over (
    partition by d.l0, d.l1, d.l2 order by md5('{SEED}:' || (n_full + 1) || ':' || coalesce(cast(doc_id as varchar), '')), doc_id
  ) as run
  from d join p on d.l0 = p.l0 and d.l1 = p.l1 and d.l2 = p.l2
)
select doc_id, l0 as domain, l1 as lang, l2 as source, t as n_tokens, cast(epoch as bigint) as epoch
from (
  select *, unnest(range(1, n_full + 1)) as epoch from r
  union all
  select *, n_full + 1 from r where n_left > 0 and run <= n_left
)
"""

ORACLES: dict[str, str] = {"op3_norm_search": OP3, "op7_line_dedup": OP7, "op8_mixing": OP8}
