"""Run a registered query: show its first rows or export it as CSV (S-10).

    python -m flightops --list
    python -m flightops delayed_pct_by_destination /root/testdata/sf0.01
    python -m flightops cancelled_flights /root/testdata/sf0.01 --csv <folder>
"""

from __future__ import annotations

import argparse

from flightops import registry
from flightops.session import build_session
from flightops.sources.sinks import export_csv


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="flightops")
    parser.add_argument("query", nargs="?", help="registered query name")
    parser.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    parser.add_argument("--list", action="store_true", help="list the registered queries")
    parser.add_argument("--csv", metavar="FOLDER", help="write the whole result as CSV")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    args = parser.parse_args(argv)

    queries = registry.queries()
    if args.list or not args.query:
        for name in sorted(queries):
            print(name)
        return 0
    if args.query not in queries:
        parser.error(f"unknown query {args.query!r}; see --list")

    spark = build_session()
    df = queries[args.query](spark, args.sf_dir)
    if args.csv:
        export_csv(df, args.csv)
        print(f"wrote {args.csv}")
    else:
        df.show(args.rows, truncate=False)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
