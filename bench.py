"""Times the engine's headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores.  Each query is written to the ``noop`` sink, so all rows
and columns are computed; the first run of a small one warms the session up.
The keyword index that the searches share is built first, as ``index_build``.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from seamark.plans import registry, tables  # noqa: E402

HEADLINE = (
    "r7_hybrid_search", "b2_postings", "b4_search", "b5_snippets", "v1_nearest", "v2_relevance", "r5_fused", "r23_token_budget", "r28_evaluation_summary",
    "c1_fixed_chunks", "c15_chunk_symbol_overlap", "s12_file_tree", "s32_content_grep",
    "j2_dependencies", "j5_module_dependencies", "j10_touching_edges", "j17_nested_relations", "k5_dependency_report", "k6_cycles", "k7_hotspots", "a11_coupling",
    "a20_moving_average", "t6_tumbling_samples", "t8_sessions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("a1_type_counts")
    began = time.time()
    tables.search_index(spark, folder)
    took = {"index_build": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, sum of seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
