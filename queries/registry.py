"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomlog as L
from loomlog import sinks
from loomlog.functions import similarity as S
from loomlog.functions import text as T
from loomlog.plans.skew import join_unique
from loomlog.sources import container_logs as containers
from loomlog.sources import logs as src
from loomlog.workspace import Workspace
from queries.views import LOGS, TABLES, doc_lines, event_lines, logs, table

CLUSTER_COLS = ["representative", "normalized_text", "words", "count", "occurrences", "n_templates"]


def _flat(df: DataFrame) -> DataFrame:
    """Word lists as text, for comparison."""
    return df.withColumn("words", F.array_join("words", ","))


# --- sources and filters ---------------------------------------------------


def namespace_scope(spark, sf):
    return src.filter_namespace(logs(spark, sf), "ASIA").groupBy("pod", "container").agg(F.count("*").alias("lines"))


def input_stats(spark, sf):
    return L.input_stats(logs(spark, sf))


def contains_any_filter(spark, sf):
    return L.filter_contains_any(logs(spark, sf), ["error", "warn"]).select("namespace", "pod", "container", "line")


def filter_stats(spark, sf):
    return L.filter_stats(logs(spark, sf), ["ERROR", "timeout"]).withColumn(
        "percent_retained", F.round("percent_retained", 6)
    )


def _since(since: str, spark, sf):
    now = datetime(2024, 1, 30, tzinfo=timezone.utc)
    kept = src.filter_since(event_lines(spark, sf), since, now)
    return kept.groupBy("namespace").agg(F.count("*").alias("lines"), F.min("ts").alias("first_ts"))


def pods(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    app = F.when(F.col("n_nationkey") % 2 == 0, "web").otherwise("batch")
    return joined.select(
        F.col("r_name").alias("namespace"),
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("pod"),
        F.create_map(F.lit("site"), "n_name", F.lit("app"), app, F.lit("tier"), F.lit("backend")).alias("labels"),
    )


def label_semi_join(spark, sf):
    kept = src.filter_labels(logs(spark, sf), pods(spark, sf), "app=web,tier=backend")
    return kept.groupBy("namespace", "pod", "container").agg(F.count("*").alias("lines"))


def label_set_terms(spark, sf):
    kept = src.filter_labels(logs(spark, sf), pods(spark, sf), "app!=batch, site in (NATION_2, NATION_8,NATION_12,NATION_20), tier, !zone")
    return kept.groupBy("namespace", "pod", "container").agg(F.count("*").alias("lines"))


def log_files(spark, sf):
    """The document lines written as log files of each language and source, and read
    back with the source taken from their paths."""
    path = Workspace(spark).path
    doc_lines(spark, sf).select("namespace", "pod", "line").write.partitionBy("namespace", "pod").text(path)
    back = src.read_log_files(spark, path, r"namespace=([^/]+)/pod=([^/]+)/(part)[^/]*$")
    return back.groupBy("namespace", "pod", "container").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes")
    )


def log_files_namespace(spark, sf):
    """The same of one namespace only, from folders that name the source."""
    path = Workspace(spark).path
    every = doc_lines(spark, sf).withColumn("container", F.lit("main"))
    every.select(*src.SOURCE, "line").write.partitionBy(*src.SOURCE).text(path)
    return src.read_log_files(spark, path, namespace="de").groupBy(*src.SOURCE).agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes")
    )


def _written_containers(spark, sf):
    """The documents as files of container records: a record a line, in parts of 60 characters, every fifth one on stderr. The
    files of pods that end in 4 are compressed, those of pods that end in 3 compressed and cut in half."""
    path = Workspace(spark).path
    docs = table(spark, sf, "documents").withColumns({
        "namespace": F.col("lang"), "pod": F.col("source"), "container": F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")),
    })

    def record(line, i):
        time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60 + i), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        parts = F.greatest(F.ceil(F.length(line) / 60).cast("int"), F.lit(1))
        head = F.concat(time, F.when(i % 5 == 0, " stderr ").otherwise(" stdout "))
        return F.array_join(F.transform(F.sequence(F.lit(1), parts), lambda k: F.concat(
            head, F.when(k < parts, "P ").otherwise("F "), F.substring(line, (k - 1) * 60 + 1, 60))), "\n")

    value = F.array_join(F.transform(F.split("text", r"\r?\n"), record), "\n").alias("value")
    records = docs.where(F.col("text").isNotNull()).select(*src.SOURCE, value)
    packed = F.col("pod").rlike("[34]$")
    records.where(~packed).write.partitionBy(*src.SOURCE).text(path)
    records.where(packed).write.mode("append").option("compression", "gzip").partitionBy(*src.SOURCE).text(path)
    cut = containers.list_log_files(spark, path).where(F.col("pod").endswith("3")).select("file")
    cut.mapInArrow(_cut_in_half, "file string").write.format("noop").mode("overwrite").save()
    return path


def _cut_in_half(batches):
    for batch in batches:
        for file in batch.column("file").to_pylist():
            store, name = containers.file_store(file)
            with store.open_input_file(name) as f:
                data = f.read()
            with store.open_output_stream(name, compression=None) as f:
                f.write(data[: len(data) // 2])
        yield batch


def container_logs(spark, sf):
    """Lines and times of every container whose files can be read."""
    scan = containers.read_container_logs(spark, _written_containers(spark, sf))
    second = F.unix_timestamp("ts")
    return scan.lines.groupBy(*src.SOURCE, "stream").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes"), F.min(second).alias("first"), F.max(second).alias("last")
    )


def container_log_errors(spark, sf):
    """The containers with a file that cannot be read."""
    scan = containers.read_container_logs(spark, _written_containers(spark, sf))
    return scan.errors.select("location", F.substring("error", 1, 11).alias("error")).distinct()


def container_logs_since(spark, sf):
    """Clusters of the lines of one namespace since a time; other namespaces are not opened, unreadable files are told."""
    scan = containers.read_container_logs(spark, _written_containers(spark, sf), namespace="es", since="2024-01-01T05:00:00Z")
    result, _, errors = L.analyze(scan.lines, 0.75, errors=scan.errors)
    return _flat(result.clusters).select(*CLUSTER_COLS).withColumn("failed", F.lit(errors.select("location").distinct().count()))


def json_logs(spark, sf):
    """Events as JSON records, every seventh cut short: good lines and error rows."""
    record = F.to_json(F.struct(F.concat_ws(" ", "event_type", "props").alias("line"), F.col("event_type").alias("namespace")))
    cut = F.when(F.col("event_id") % 7 == 0, F.left(record, F.length(record) - 1)).otherwise(record)
    path = Workspace(spark).path
    table(spark, sf, "events").select(cut.alias("value")).write.text(path)
    good, bad = src.read_json_logs(spark, path, "line string, namespace string")
    return good.groupBy("namespace").agg(F.count("*").alias("lines")).unionAll(
        bad.agg(F.lit("(malformed)").alias("namespace"), F.count("*").alias("lines"))
    )


def table_scan(spark, sf):
    rows = src.from_table(table(spark, sf, "events"), "props", namespace="event_type", pod=F.col("user_id"), ts="ts")
    return rows.groupBy("namespace", "container").agg(
        F.count("*").alias("lines"), F.count_distinct("pod").alias("pods"), F.max("ts").alias("last_ts")
    )


def empty_input(spark, sf):
    """No line is left: one row of zeros from the totals, none from the clusters."""
    none = L.filter_contains_any(logs(spark, sf), ["no line holds this text"])
    result = L.cluster(none, 0.75)
    return L.cluster_stats(result).withColumn("members", F.lit(L.members(result, none).count()))


def split_lines(spark, sf):
    return T.with_template(doc_lines(spark, sf)).groupBy("namespace", "pod", "container").agg(F.count("*").alias("lines"))


def union_sources(spark, sf):
    docs = src.attach_source(doc_lines(spark, sf).select("line"), "docs", "all", "")
    every = src.union_sources(logs(spark, sf), event_lines(spark, sf), docs)
    return T.with_template(every).groupBy("namespace").agg(
        F.count("*").alias("lines"), F.count_distinct("line").alias("distinct_lines")
    )


def missing_sources(spark, sf):
    """Sources that logged something, but no error."""
    every = logs(spark, sf)
    return src.ingest_errors(
        every, L.filter_contains_any(every, ["error:"]), datetime(2024, 2, 1, tzinfo=timezone.utc)
    )


# --- text --------------------------------------------------------------------


def _words(word_filter: bool, spark, sf):
    return (
        doc_lines(spark, sf)
        .select(F.explode(T.words("line", word_filter)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def nonsense_tokens(spark, sf):
    tokens = table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("token")
    )
    return tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("nonsense", T.is_nonsense("token"))


def normalized_lines(spark, sf):
    distinct = doc_lines(spark, sf).select("line").distinct()
    return T.with_template(distinct, word_filter=False).select(
        "line", T.normalize("line").alias("filtered"), F.col("normalized_text").alias("unfiltered")
    )


def bigram_counts(spark, sf):
    return (
        T.with_template(doc_lines(spark, sf), word_filter=False)
        .select("normalized_text")
        .distinct()
        .select(F.explode(T.bigrams("normalized_text")).alias("bigram"))
        .groupBy("bigram")
        .agg(F.count("*").alias("n"))
    )


def line_pairs(spark, sf):
    """Consecutive lines of each document as pairs of template texts."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    texts = T.with_template(docs).select("doc_id", "pos", "normalized_text")
    a = texts.select("doc_id", "pos", F.col("normalized_text").alias("a"))
    b = texts.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("normalized_text").alias("b"))
    return a.join(b, ["doc_id", "pos"]).select("a", "b").distinct()


def dice_pairs(spark, sf):
    return line_pairs(spark, sf).withColumn("dice_bigrams", F.round(S.dice_bigrams("a", "b"), 6))


def char_dice_pairs(spark, sf):
    return line_pairs(spark, sf).select(
        "a", "b", F.round(S.dice_chars("a", "b"), 6).alias("dice_chars"),
        S.char_overlap("a", "b", 0.75).alias("char_overlap"),
    )


def similarity_pairs(spark, sf):
    return line_pairs(spark, sf).withColumn("similarity", F.round(S.similarity("a", "b", 0.5), 6))


def exact_templates(spark, sf):
    return L.templates(logs(spark, sf)).select("normalized_text", "count", "occurrences", "representative")


def exact_templates_docs(spark, sf):
    return L.templates(doc_lines(spark, sf), word_filter=False, by=["namespace"])


# --- similarity and clusters -------------------------------------------------


def _pairs(t: float, metric: str, spark, sf):
    pairs = L.similar_pairs(L.templates(logs(spark, sf)), t, metric=metric)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def _pairs_docs(t: float, spark, sf):
    pairs = L.similar_pairs(L.templates(doc_lines(spark, sf)), t)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def approximate_pairs(t: float, spark, sf):
    """Pairs found through bands against the exact join: how many there are, whether nine in ten are found, and how many are wrong."""
    texts = L.templates(logs(spark, sf))
    exact, close = L.similar_pairs(texts, t), L.similar_pairs(texts, t, bands=10)
    both = exact.withColumn("_e", F.lit(1)).join(close.withColumn("_c", F.lit(1)), exact.columns, "full")
    found = F.count_if(F.col("_e").isNotNull() & F.col("_c").isNotNull())
    return both.agg(F.count("_e").alias("pairs"), F.count_if(F.col("_e").isNull()).alias("wrong"),
                    (found >= 0.9 * F.count("_e")).alias("enough"))


def _membership(result: L.Clustering) -> DataFrame:
    m = result.membership
    head = m.where(F.col("template_id") == F.col("cluster_id")).select(
        "cluster_id", F.col("normalized_text").alias("leader_text")
    )
    return m.join(head, "cluster_id").select(
        *result.by, "normalized_text", "leader_text", F.round("similarity", 6).alias("similarity"), "count"
    )


def _clustered(spark, sf, t=0.75, **options):
    return _membership(L.cluster(logs(spark, sf), t, **options))


def cluster_docs_75(spark, sf):
    return _membership(L.cluster(doc_lines(spark, sf), 0.75))


def cluster_docs_best_75(spark, sf):
    """Enough templates for several batches."""
    return _membership(L.cluster(doc_lines(spark, sf), 0.75, mode="best"))


def cluster_docs_by_language(spark, sf):
    return _membership(L.cluster(doc_lines(spark, sf), 0.6, by=["namespace"], word_filter=False))


def _once(df: DataFrame) -> DataFrame:
    """Written, for queries that read their lines several times: the joins behind them run once."""
    return Workspace(df.sparkSession).save(df, "raw")[0]


def _base(spark, sf, again=False):
    df = _once(logs(spark, sf)) if again else logs(spark, sf)
    return L.cluster(df, 0.75), df


def _named(result: L.Clustering, rows: DataFrame) -> DataFrame:
    """Rows with the text of their cluster; a large cluster's rows are split by their number."""
    rows, seen = Workspace(rows.sparkSession).save(rows, "named")
    counted = rows.groupBy("cluster_id").agg(F.count("*").alias("_rows"))
    names = result.clusters.select("cluster_id", "normalized_text").join(counted, "cluster_id")
    spread = rows.withColumn("_row", F.xxhash64(*[c for c in rows.columns if c != "cluster_id"]))
    return join_unique(spread, names, ["cluster_id"], "_rows", seen["rows"], "_row").drop("cluster_id", "_row")


def _with_null_groups(spark, sf):
    """The log lines, some of them from a source that has no namespace."""
    early, late = _halves(spark, sf)
    return src.union_sources(early, late.drop("namespace"))


def members_null_group(spark, sf):
    df = _with_null_groups(spark, sf)
    result = L.cluster(df, 0.75, by=["namespace"])
    return _named(result, L.members(result, df))


def sources_null_group(spark, sf):
    df = _with_null_groups(spark, sf)
    result = L.cluster(df, 0.75, by=["namespace"])
    return _named(result, L.sources(result, df))


def top_clusters_by_namespace(spark, sf):
    result = L.cluster(logs(spark, sf), 0.75, by=["namespace"])
    return _flat(L.top_clusters(result, 25)).select("rank", "namespace", *CLUSTER_COLS)


def cluster_summary(spark, sf):
    return _flat(_base(spark, sf)[0].clusters).select(*CLUSTER_COLS)


def cluster_members(spark, sf):
    result, df = _base(spark, sf)
    return _named(result, L.members(result, df))


def cluster_members_limit(spark, sf):
    result, df = _base(spark, sf)
    return _named(result, L.members(result, df, limit=3)).drop("occurrences")


def cluster_sources(spark, sf):
    result, df = _base(spark, sf, again=True)
    return _named(result, L.sources(result, df))


def cluster_report(spark, sf):
    return L.report(*_base(spark, sf, again=True))


def top_clusters(spark, sf):
    return _flat(L.top_clusters(_base(spark, sf)[0], 10)).select("rank", *CLUSTER_COLS)


def cluster_stats(spark, sf):
    return L.cluster_stats(_base(spark, sf)[0])


def rare_clusters(spark, sf):
    return _flat(L.rare_clusters(_base(spark, sf)[0], 2)).select(*CLUSTER_COLS)


def _halves(spark, sf):
    df = _once(logs(spark, sf))
    early = F.col("namespace").isin("AFRICA", "ASIA")
    return df.where(early), df.where(~early)


def assign_new_lines(spark, sf, mode="first", index=False):
    old, new = _halves(spark, sf)
    base = L.cluster(old, 0.75, mode=mode)
    known = base.clusters
    if index:  # laid out once, opened again
        path = Workspace(spark).path
        L.save_index(known, path, 0.75)
        known = L.open_index(spark, path)
    out = L.assign_to(new, known, 0.75, mode=mode)
    heads = base.clusters.select("cluster_id", F.col("normalized_text").alias("cluster_text")).unionAll(
        out.formed.clusters.select("cluster_id", "normalized_text")
    )
    return out.membership.join(heads, "cluster_id").select(
        "normalized_text", "cluster_text", F.round("similarity", 6).alias("similarity"), "count", "existing"
    )


def merge_two_runs(spark, sf):
    sets = [L.ClusterSet.of(L.cluster(half, 0.75), half) for half in _halves(spark, sf)]
    out = L.merge_clusters(sets, 0.75)
    n = out.sources.groupBy("cluster_id").agg(F.count("*").alias("n_sources"))
    return out.clusters.join(n, "cluster_id").select("representative", "normalized_text", "count", "n_sources")


def _read_back(spark, sf, by=(), contains=()):
    """Clusters of all lines, or of those that contain a term, and errors for the sources without one, written and read again."""
    df = _once(logs(spark, sf))
    result, lines, errors = L.analyze(df, 0.75, by=by, contains=contains, expected=df)
    path = Workspace(spark).path
    sinks.write_json(L.ClusterSet.of(result, lines), errors, path)
    return sinks.read_clusters(spark, path, ", ".join(f"{c} string" for c in by)), sinks.read_errors(spark, path)


def _told(back):
    lines = back.members.groupBy("cluster_id").agg(
        F.count("*").alias("n_members"), F.min("line").alias("first"), F.sum(F.octet_length("line")).alias("bytes")
    )
    places = back.sources.groupBy("cluster_id").agg(F.count("*").alias("n_sources"))
    return _flat(back.clusters.join(lines, "cluster_id").join(places, "cluster_id")).drop("cluster_id")


def json_roundtrip(spark, sf):
    return _told(_read_back(spark, sf)[0])


def json_roundtrip_by_namespace(spark, sf):
    """Of the errors and warnings."""
    return _told(_read_back(spark, sf, ["namespace"], ["error", "warn"])[0])


def json_errors(spark, sf):
    """Error rows of sources that did not log at all in one half of the data."""
    early, late = _halves(spark, sf)
    result, lines, errors = L.analyze(
        late, 0.75, contains=["quota"], expected=src.union_sources(early, late), now=datetime(2024, 2, 1, tzinfo=timezone.utc)
    )
    path = Workspace(spark).path
    sinks.write_json(L.ClusterSet.of(result, lines), errors, path)
    return sinks.read_errors(spark, path)


def analyze_errors(spark, sf):
    result, *_ = L.analyze(
        logs(spark, sf), 0.75, namespace="EUROPE", label="app=web", pods=pods(spark, sf),
        since="1995-06-01T00:00:00Z", contains=["shipment", "error"],
    )
    return _flat(result.clusters).select(*CLUSTER_COLS)


def cluster_by_window(spark, sf):
    out = L.cluster_by_window(logs(spark, sf), "400 days", 0.75).clusters
    return out.select("window_start", "normalized_text", "representative", "count", "occurrences", "n_templates")


def cluster_by_window_no_time(spark, sf):
    """Lines of one region have no time; they are clustered among themselves."""
    df = logs(spark, sf).withColumn("ts", F.when(F.col("namespace") != "ASIA", F.col("ts")))
    out = L.cluster_by_window(df, "400 days", 0.75).clusters
    return out.select("window_start", "normalized_text", "count", "occurrences", "n_templates")


def _live(spark, sf):
    """The lineitem files as a stream, joined to the static tables, until all files
    present are read; windows that are still open come out too."""
    schema = table(spark, sf, "lineitem").schema
    live = spark.readStream.schema(schema).parquet(f"{sf}/lineitem*.parquet")
    names = [t for t in TABLES if "{" + t + "}" in LOGS and t != "lineitem"]
    return spark.sql(LOGS, lineitem=live, **{t: table(spark, sf, t) for t in names})


def _streamed(spark, sf, known=None):
    return L.counts_to_end(L.template_counts_stream(_live(spark, sf), "30 days", "1 day", known), Workspace(spark).path)


def stream_distinct_counts(spark, sf):
    """Distinct lines and lines per window and template; the lines come twice, as two rows with the same time."""
    lines = _live(spark, sf).select("ts", "namespace", "pod", "line")
    twice = lines.withColumn("pod", F.explode(F.array("pod", F.concat("pod", F.lit("-copy")))))
    return L.counts_to_end(L.distinct_counts_stream(twice, "30 days", "1 day"), Workspace(spark).path)


def stream_placed_clusters(spark, sf):
    """Two batches of a stream, one half of the lines each: the second finds the clusters of the first. A repeated batch does nothing."""
    path = Workspace(spark).path
    store = L.ClusterStore(spark, f"{path}/store", 0.75)
    halves = _halves(spark, sf)
    for half in halves:
        half.write.mode("append").parquet(f"{path}/in")
        live = spark.readStream.schema(half.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{path}/in")
        store.start(live, f"{path}/state", availableNow=True).awaitTermination()
    store.place(halves[1], store.last())
    heads = store.table("clusters").select("cluster_id", F.col("normalized_text").alias("cluster_text"))
    return store.table("placed").join(heads, "cluster_id").select(
        "batch", "normalized_text", "cluster_text", F.round("similarity", 6).alias("similarity"), "count", "existing"
    )


def stream_template_counts(spark, sf):
    return _streamed(spark, sf)


def stream_labelled_counts(spark, sf):
    """Counts per window and known cluster; texts of the other half are new."""
    known = L.cluster(_halves(spark, sf)[0], 0.75).membership
    heads = known.where(F.col("template_id") == F.col("cluster_id")).select("cluster_id", F.col("normalized_text").alias("cluster_text"))
    counts = _streamed(spark, sf, known).join(heads, "cluster_id", "left")
    return counts.groupBy("window_start", "cluster_text").agg(
        F.count("*").alias("templates"), F.sum("occurrences").alias("occurrences")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "namespace_scope": namespace_scope,
    "input_stats": input_stats,
    "contains_any_filter": contains_any_filter,
    "filter_stats": filter_stats,
    "since_filter": partial(_since, "5d 12h"),
    "since_timestamp": partial(_since, "2024-01-20T10:30:00+02:00"),
    "label_semi_join": label_semi_join,
    "split_lines": split_lines,
    "union_sources": union_sources,
    "missing_sources": missing_sources,
    "words_filtered": partial(_words, True),
    "words_unfiltered": partial(_words, False),
    "nonsense_tokens": nonsense_tokens,
    "normalized_lines": normalized_lines,
    "bigram_counts": bigram_counts,
    "dice_pairs": dice_pairs,
    "char_dice_pairs": char_dice_pairs,
    "similarity_pairs": similarity_pairs,
    "exact_templates": exact_templates,
    "exact_templates_docs": exact_templates_docs,
    "similar_pairs_75": partial(_pairs, 0.75, "dice_bigrams"),
    "similar_pairs_60": partial(_pairs, 0.6, "dice_bigrams"),
    "similar_pairs_chars_90": partial(_pairs, 0.9, "dice_chars"),
    "similar_pairs_docs_75": partial(_pairs_docs, 0.75),
    "approximate_pairs_75": partial(approximate_pairs, 0.75),
    "cluster_first_75": _clustered,
    "cluster_best_75": partial(_clustered, mode="best"),
    "cluster_first_60": partial(_clustered, t=0.6),
    "cluster_chars_90": partial(_clustered, t=0.9, metric="dice_chars"),
    "cluster_unfiltered_75": partial(_clustered, word_filter=False),
    "cluster_by_namespace": partial(_clustered, by=["namespace"]),
    "cluster_docs_75": cluster_docs_75,
    "cluster_docs_by_language": cluster_docs_by_language,
    "cluster_summary": cluster_summary,
    "cluster_members": cluster_members,
    "cluster_members_limit": cluster_members_limit,
    "cluster_sources": cluster_sources,
    "cluster_report": cluster_report,
    "top_clusters": top_clusters,
    "cluster_stats": cluster_stats,
    "rare_clusters": rare_clusters,
    "assign_new_lines": assign_new_lines,
    "merge_two_runs": merge_two_runs,
    "json_roundtrip": json_roundtrip,
    "analyze_errors": analyze_errors,
    "cluster_by_window": cluster_by_window,
    "stream_template_counts": stream_template_counts,
    "stream_distinct_counts": stream_distinct_counts,
    "stream_placed_clusters": stream_placed_clusters,
    "stream_labelled_counts": stream_labelled_counts,
    "cluster_by_window_no_time": cluster_by_window_no_time,
    "members_null_group": members_null_group,
    "sources_null_group": sources_null_group,
    "top_clusters_by_namespace": top_clusters_by_namespace,
    "json_roundtrip_by_namespace": json_roundtrip_by_namespace,
    "json_errors": json_errors,
    "assign_new_lines_best": partial(assign_new_lines, mode="best"),
    "assign_new_lines_indexed": partial(assign_new_lines, index=True),
    "assign_new_lines_indexed_best": partial(assign_new_lines, mode="best", index=True),
    "cluster_docs_best_75": cluster_docs_best_75,
    "similar_pairs_docs_85": partial(_pairs_docs, 0.85),
    "label_set_terms": label_set_terms,
    "log_files": log_files,
    "log_files_namespace": log_files_namespace,
    "container_logs": container_logs,
    "container_log_errors": container_log_errors,
    "container_logs_since": container_logs_since,
    "json_logs": json_logs,
    "table_scan": table_scan,
    "empty_input": empty_input,
}
