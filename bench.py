"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2; the
fastest run counts, after one warm-up over the smallest data). Each query is run in full into a noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "spend_by_segment_quarter", "spend_by_leaf", "funnel", "top_suppliers", "payment_ops", "bridge_conversion",
    "prediction_accuracy", "revenue_by_segment_quarter", "top_customers", "contract_values", "journal_balance",
    "account_type_totals", "fpa_actuals", "fpa_forecasts", "op_margin", "off_contract", "scd2_history",
    "scd2_snapshot", "headcount_change", "fact_invoices", "gl_entries", "rescale_to_target", "residual_last_line",
    "reconcile_spend", "clf_features", "hhi", "sourcing_strategy", "upsert_predictions", "stream_ingest_events",
]


def main() -> None:
    from checks import registry
    from ledgerloom.session import session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run = lambda name, where: queries[name](spark, where).write.format("noop").mode("overwrite").save()
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    run(names[0], warm if os.path.isdir(warm) else folder)
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(name, folder)
            times.append(time.perf_counter() - start)
            spark.catalog.clearCache()  # no run may profit from what another one kept
        seconds[name] = round(min(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
