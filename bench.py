"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textlode import catalog
from textlode.session import local_session

HEADLINE = (
    "grp_01_literal_search", "grp_01_top_200_with_context", "grp_03_call_index", "rnk_01_tfidf_search", "idx_08_term_frequencies",
    "idx_04_line_trigrams", "idx_12_vocabulary", "idx_13_tfidf_embedding", "rnk_04_vector_search", "rnk_12_fuzzy_symbols", "prs_12_parse_symbols",
    "idx_03_call_graph", "grf_09_degree_stats", "kwl_07_final_vocabulary", "joi_03_symbols_near_line", "agg_01_workspace_stats", "rnk_17_scope_scores",
    "ses_02_retain_and_renumber",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    registry = catalog.load()
    catalog.registry.text_parts = int(os.environ.get("BENCH_CPUS", "8"))  # the benchmark's text tables are one row group each
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
