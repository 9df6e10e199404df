"""Headline queries, timed on a warm local session.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from intelweave.catalog import all_queries
from intelweave.session import local_session

HEADLINE = [
    "actor_indicators", "merge_techniques", "merge_malware", "technique_recommendations",
    "term_hits", "relevant_articles", "rules_for_techniques", "coverage_report",
    "family_iocs", "match_repos", "related_techniques", "matrix_layer", "report_rows",
    "assemble_profile", "strip_html", "read_articles_rss",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    picked = sys.argv[1:] or HEADLINE
    run = lambda name, folder: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    warm = str(Path(sf_dir).with_name("sf0.001"))
    times = {}
    for name in picked:
        if Path(warm).exists():
            run(name, warm)  # class loading and code generation
        start = time.perf_counter()
        run(name, sf_dir)
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
