"""``python -m prodlake --raw <dir> --root <dir> [--stage ...] [--top-wells N] [--refresh]``"""

import argparse

from prodlake.plans import refresh, stages
from prodlake.session import get_spark
from prodlake.sources.tables import TablePaths


def main() -> None:
    parser = argparse.ArgumentParser(prog="prodlake", description="Run the batch pipeline.")
    parser.add_argument("--raw", required=True, help="folder with the raw CSV feeds")
    parser.add_argument("--root", required=True, help="folder of the tables")
    parser.add_argument("--stage", choices=["all", *stages.STAGES], default="all")
    parser.add_argument("--top-wells", type=int, help="forecast only the wells with the most oil (default: all)")
    parser.add_argument("--keep-broken", action="store_true", help="land lines with a wrong number of fields in tables of their own")
    parser.add_argument("--refresh", action="store_true", help="add new feed files and bring the clean and KPI tables up to date")
    args = parser.parse_args()
    spark = get_spark()
    if args.refresh:
        paths = TablePaths(args.root)
        added = refresh.land(spark, args.raw, paths)
        done = refresh.refresh(spark, paths)
        print(f"files {added}, years {done.years}")
        counts = done.counts
    else:
        counts = stages.run(spark, args.raw, args.root, args.stage, args.top_wells, args.keep_broken)
    for table, rows in counts.items():
        print(f"{table:<36} {rows:>14,}")
    spark.stop()


if __name__ == "__main__":
    main()
