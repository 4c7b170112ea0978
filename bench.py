"""Benchmark: build the star from the test tables, then run every report-level query.

Prints one JSON line.  Environment: BENCH_SF_DIR (default
/root/testdata/sf0.1), BENCH_CPUS (default 8).  Each query is executed in
full through the ``noop`` sink (every row is produced, nothing is collected
to the driver); ``star_build`` covers flat stand-in -> cleaning -> keys ->
dimensions -> fact, written once.  Each query is timed cold, with no report
kept from an earlier one (``queries``), and once more with the reports it
reads stored (``stored``, not in the total).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from starlane.plans import catalog, registry  # noqa: E402
from starlane.session import get_session  # noqa: E402

# Every report-level registered query (aggregates, KPIs, marts, extras,
# dashboard summaries, preview, row counts), in catalog order.
HEADLINE = list(catalog.STAR_PLANS)


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(
        f"local[{cpus}]",
        app="starlane-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus))),
        extra={"spark.driver.memory": "16g"},
    )
    timings: dict[str, float] = {}

    t0 = time.perf_counter()
    catalog.star_for(spark, sf_dir)
    timings["star_build"] = time.perf_counter() - t0

    star = catalog.star_for(spark, sf_dir)
    stored: dict[str, float] = {}
    for name in HEADLINE:
        # Cold: no report kept from an earlier query.  Timed from plan
        # construction to the last row; then again with its reports stored.
        registry.release(star)
        for into in (timings, stored):
            t0 = time.perf_counter()
            run_noop(catalog.QUERIES[name](spark, sf_dir))
            into[name] = time.perf_counter() - t0

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "star_build_plus_reports_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in timings.items()},
        "stored": {k: round(v, 3) for k, v in stored.items()},
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
