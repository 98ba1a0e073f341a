"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. The log_* entries
cluster generated lines with the sizes, thresholds, word filter (off) and member limits
written to parquet before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from functools import partial
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession

import loomlog as L
from queries.registry import QUERIES
from tests import log_generators as G

HEADLINE = [
    "contains_any_filter", "words_filtered", "exact_templates", "similar_pairs_75", "cluster_first_75",
    "cluster_best_75", "cluster_by_namespace", "cluster_members_limit", "cluster_sources", "cluster_report",
]
# name: generator, lines, threshold, member limit
GENERATED = {
    "log_50k_t75": (G.realistic, 50_000, 0.75, 0),
    "log_100k_t70": (G.realistic, 100_000, 0.70, 0),
    "log_100k_t75": (G.realistic, 100_000, 0.75, 0),
    "log_100k_t80_limit100": (G.realistic, 100_000, 0.80, 100),
    "log_100k_t85": (G.realistic, 100_000, 0.85, 0),
    "log_100k_t95": (G.realistic, 100_000, 0.95, 0),
    "log_500k_t85_limit50": (G.realistic, 500_000, 0.85, 50),
    "log_100k_high_diversity_t75": (G.high_diversity, 100_000, 0.75, 0),
    "log_100k_low_diversity_t75": (G.low_diversity, 100_000, 0.75, 0),
    "log_100k_short_t75": (partial(G.of_length, lo=20, hi=80), 100_000, 0.75, 0),
    "log_100k_medium_t75": (partial(G.of_length, lo=100, hi=300), 100_000, 0.75, 0),
    "log_100k_long_t75": (partial(G.of_length, lo=300, hi=700), 100_000, 0.75, 0),
}


def timed(*made) -> float:
    """Seconds for all rows of the DataFrames that the functions make."""
    start = time.perf_counter()
    for df_of in made:
        df_of().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def clustered(lines: DataFrame, threshold: float, limit: int) -> float:
    start = time.perf_counter()
    result = L.cluster(lines, threshold, word_filter=False)
    timed(lambda: result.clusters, lambda: L.members(result, limit=limit), lambda: L.sources(result, lines))
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="loomlog-bench-")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomlog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", f"{scratch}/tables")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    # the published numbers are of warmed-up code, so compile before timing
    for name in ("cluster_first_75", "exact_templates"):
        timed(lambda: QUERIES[name](spark, sf))
    times = {name: timed(lambda: QUERIES[name](spark, sf)) for name in HEADLINE}
    for name, (make, n, t, limit) in GENERATED.items():
        make(spark, n).repartition(int(cpus)).write.parquet(f"{scratch}/{name}")
        times[name] = clustered(spark.read.parquet(f"{scratch}/{name}"), t, limit)
    print(json.dumps({
        "metric": "log_clustering_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
