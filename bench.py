"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from scholarflow.plans import queries as Q
from scholarflow.session import get_spark, shared_folder
from scholarflow.sources import readers

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["q1_normalize_works", "q3_calculated_cite_counts", "q4_hit_events", "q6_hit_panel", "q7_lifetime_panel", "q8_exposure_panel", "q9_two_way_effects", "q10_threshold_event_study", "q12_normalized_excess", "q13_big_hit_screen", "q15_event_cells", "q17_version_clusters", "q18_matched_controls", "q20_coverage_audit", "q21_order_statistics"]


def main() -> None:
    spark = get_spark("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().count()  # start-up isn't a query's
    # nor is making the nested documents that q1 parses
    path = f"{shared_folder(spark)}/bench-works"
    Q.json_works(spark, SF).write.mode("overwrite").text(path)
    runs = {**Q.QUERIES, "q1_normalize_works": lambda spark, _: Q.kept_works(readers.parse_works(spark.read.text(path)))}
    took = {}
    for name in HEADLINE:
        began = time.time()
        runs[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
