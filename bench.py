"""Times headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs twice
into a sink that reads every row and column; the second run counts, the first is
reported as ``cold``. ``rows_per_sec`` is the rows of the query's main table over
its time.
"""

from __future__ import annotations

import json
import os
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

MAIN_TABLE = {
    "render_template": "customer", "render_template_column": "customer", "extract_references": "part",
    "merge_maps": "orders", "fingerprint": "orders", "graph_order": "part", "graph_closure": "part",
    "graph_first_cycle": "part", "graph_validation_report": "part", "definition_steps": "orders",
    "validate_steps": "orders", "bound_functions": "lineitem", "build_requests": "pages",
}

HEADLINES = (
    "typed_event_flow path_extract path_column resolve_errors render_template render_template_column "
    "extract_references select_json filter_items merge_maps merge_document merge_rows fingerprint "
    "cached_step cache_newest graph_order graph_closure graph_first_cycle graph_validation_report "
    "definition_steps validate_steps run_report fold_step_runs display_status overlap_counts "
    "barrier_violations bound_functions json_from_text build_requests "
    "wait_match wait_batches wait_stream cached_batches live_runs graph_blocked graph_chains "
    "graph_undeclared_references"
).split()


def main() -> None:
    from heddlework.plans import all_queries
    from heddlework.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    known = all_queries()
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES

    def seconds(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold, warm = {}, {}
    for name in chosen:
        cold[name] = seconds(name)
        warm[name] = seconds(name)
    tables = {name: MAIN_TABLE.get(name, "events") for name in chosen}
    sizes = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in set(tables.values())}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "cold": cold,
                "rows_per_sec": {name: round(sizes[tables[name]] / warm[name]) for name in chosen},
            }
        )
    )


if __name__ == "__main__":
    main()
