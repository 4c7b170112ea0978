"""Command line: run the batch or show a report.

  python -m starlane batch --csv PATH --out DIR [--lenient]
  python -m starlane batch --tables SF_DIR --out DIR
  python -m starlane report NAME --out DIR [--ordered] [--show 20]
  python -m starlane list

``batch`` cleans the flat lines, loads the star under DIR/star, writes every
report under DIR/reports and both fact layouts under DIR/layouts.  ``report``
reads the loaded star back and prints the first rows of one report.  The
master and other settings come from spark-submit / the environment.
"""

from __future__ import annotations

import argparse
import json

from starlane.operators.star import DIMENSIONS, Star
from starlane.plans import registry
from starlane.session import get_session
from starlane.sources.flat import read_flat_csv, standin_flat
from starlane.sources.tables import read_table


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="starlane")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("batch")
    src = b.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv")
    src.add_argument("--tables")
    b.add_argument("--out", required=True)
    b.add_argument("--lenient", action="store_true")
    r = sub.add_parser("report")
    r.add_argument("name")
    r.add_argument("--out", required=True)
    r.add_argument("--ordered", action="store_true")
    r.add_argument("--show", type=int, default=20)
    sub.add_parser("list")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        for group, reports in registry.REPORTS.items():
            for name, (table, _) in reports.items():
                print(f"{group:13s} {name:36s} -> {table}")
        return

    spark = get_session()
    if args.cmd == "batch":
        flat = read_flat_csv(spark, args.csv) if args.csv else standin_flat(spark, args.tables)
        out = registry.run_batch(flat, args.out, strict=not args.lenient)
        print(json.dumps(out, indent=2))
    else:
        base = args.out.rstrip("/")
        names = ["fact_sales", *DIMENSIONS]
        star = Star(**{n: read_table(spark, f"{base}/star/{n}") for n in names})
        registry.run(star, args.name, ordered=args.ordered).show(args.show, truncate=False)


if __name__ == "__main__":
    main()
