"""Time the headline queries and print one JSON line.

Inputs derived from the given tables (file metrics, scored files, replies)
are stored once and timed apart as ``prepare_*``.
"""

from __future__ import annotations

import json
import os
import time

from stratalens.queries import fixtures as fx
from stratalens.queries.spark_queries import QUERIES
from stratalens.session import SETTINGS, local_session
from stratalens.sources.tables import project_files, source_texts

HEADLINE = [
    "file_scores", "rule_labels", "antipattern_inputs", "quality_inputs", "file_issues",
    "violations_by_type", "violation_groups", "violation_details", "violation_files",
    "layer_rollup", "project_rollup", "quality_summary", "violation_summary", "worst_files",
    "verdicts_applied", "clean_candidates", "discoveries_merged", "hybrid_scores",
    "validation_requests", "assessment_requests", "fix_requests",
    "fixes_static", "accuracy_by_class", "run_delta", "transitions",
    "full_report", "stream_scores",
]
PREPARE = {
    "prepare_files": project_files,
    "prepare_sources": source_texts,
    "prepare_scored": fx.scored,
    "prepare_verdict_replies": fx.verdict_replies,
    "prepare_clean_check_replies": fx.clean_check_replies,
    "prepare_assessment_replies": fx.assessment_replies,
    "prepare_fix_replies": fx.fix_replies,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the JVM's readers
    seconds = {}
    for name, make in PREPARE.items():
        start = time.perf_counter()
        make(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    files = project_files(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "files": files, "cores": cores, "settings": SETTINGS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
