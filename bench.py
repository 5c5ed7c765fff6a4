"""Headline timings: one JSON line.

Each query runs once to warm up and once timed, all its rows going to Spark's noop sink.
``ratios`` sets governed work against the plain scan of the same table.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import access, masks, relations, trail, verdicts  # noqa: E402, F401  (registration)
from palisade.session import build_session  # noqa: E402

HEADLINE = (
    "mask_table",
    "mask_hash",
    "mask_hash_compat",
    "mask_tokenize_compat",
    "detokenize",
    "redact_json_keys",
    "governed_orders",
    "governed_residents",
    "governed_sql_join",
    "governed_sql_subquery",
    "governed_sql_window",
    "governed_update",
    "governance_decision",
    "governance_decision_large",
    "scope_decision_large",
    "request_outcome",
    "access_matrix",
    "rule_merge",
    "what_if_diff",
    "parse_query_log",
    "parse_free_text",
    "access_cube",
    "rate_limit",
    "peak_concurrency",
    "row_quota",
    "view_rows",
    "stream_rate_limit",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    run()
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {n: timed(lambda n=n: drain(relations.QUERIES[n](spark, sf_dir))) for n in names}
    raw = timed(lambda: drain(relations.table(spark, sf_dir, "lineitem")))
    ratios = {"mask_table / plain scan": round(seconds["mask_table"] / raw, 2)} if "mask_table" in seconds else {}
    if "governance_decision" in seconds:
        rows = relations.table(spark, sf_dir, "events").count()
        ratios["decisions per second"] = round(rows / seconds["governance_decision"])
    if {"mask_hash_compat", "mask_hash"} <= seconds.keys():
        ratios["compat / SHA-256 hash"] = round(seconds["mask_hash_compat"] / seconds["mask_hash"], 2)
    print(
        json.dumps(
            {
                "metric": "governed queries, total of timed runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "plain_scan": raw,
                "ratios": ratios,
            }
        )
    )


if __name__ == "__main__":
    main()
