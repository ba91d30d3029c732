"""Times the headline queries and prints one JSON line.

Every query runs once untimed, so compiled code and file listings are warm, and then once timed.
All result columns are computed; nothing is collected. What a query writes while its plan is
built is part of its time. The catalog queries come after the build of the models, whose counts and
profiles they read.
"""

from __future__ import annotations

import json
import os
import sys
import time

from touchstone.plans.queries import QUERIES
from touchstone.session import build_session

HEADLINE = [
    "silver_customers",
    "silver_customers_rejected",
    "silver_accounts",
    "silver_accounts_rejected",
    "silver_transactions",
    "gold_customer_360",
    "gold_monthly_channel_volume",
    "recon_transactions",
    "dq_gate",
    "window_keep_first",
    "profile_numeric",
    "drift_report",
    "contract_diff_schema",
    "contract_next_version",
    "scoped_transactions",
    "cosine_topk",
    "cosine_topk_many",
    "embed_documents",
    "build_lakehouse",
    "transactions_of_month",
    "table_row_counts",
    "catalog_profile",
    "catalog_cards",
    "role_visible_tables",
    "search_catalog",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
             "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
