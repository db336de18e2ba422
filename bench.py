"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from basketry.plans import catalogue
from basketry.plans.registry import together
from basketry.session import build_session

HEADLINE = (
    "A2_parquet_scan",
    "B3_time_split",
    "C1_semi_join_top",
    "D3_covisitation",
    "D5_item_meta",
    "D14_latency_report",
    "E3_training_examples",
    "I7_vector_top_k",
    "I8_hashed_top_k",
    "I9_seed_neighbours",
    "J2_negative_sampling",
    "J4_training_set",
    "K1_covisit_recommend",
    "K2_vector_recommend",
    "K2_blended_recommend",
    "K3_multi_intent_recommend",
    "K6_popularity",
    "K7_complement_lift",
    "K8_bundles",
    "K9_search",
    "K9_session_search",
    "K10_feed",
    "K10_consented_feed",
    "M1_consent_history",
    "N7_guarded_lists",
    "O1_session_state",
    "O2_all_sessions",
    "P2_averages_and_coverage",
)
# The first fits the models, the others use them.
RANKED = ("J5_boosted_rankers", "K4_retrieve_then_rank", "K9_search_ranked", "K10_feed_ranked")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or list(HEADLINE)
    ranked = [] if sys.argv[1:] else list(RANKED)
    spark = build_session(
        f"local[{cpus}]",
        "basketry-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    queries = catalogue.queries()
    queries["D4_item_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}

    def timed(name: str) -> None:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    for name in names:
        timed(name)
    with together():
        for name in ranked:
            timed(name)
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    lists = {n: round(users / times[n], 1) for n in ("K1_covisit_recommend", "K2_vector_recommend", "K10_feed") if n in times}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "users_per_second": lists,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
