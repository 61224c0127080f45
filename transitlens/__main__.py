"""Command line: run one of the five reports over day files and print each section.

    python -m transitlens INPUT [INPUT ...] [--box EAST WEST NORTH SOUTH]
                          [--days DAY1 DAY2] [--clock START END]
                          [--year YEAR] [--month MONTH] [--rows 20] [--persist] [--parquet]

The options that are given choose the report:

* ``--box`` alone: box report;
* ``--clock`` alone: clock report (the first day of the data to its last day);
* ``--days`` alone: day report;
* ``--days --clock``: day+clock report;
* ``--box --days --clock``: full report.

``INPUT`` is one or more day files or folders (``--parquet``: the day-partitioned layout).
Run it with ``spark-submit`` or plain ``python``; the session comes from
``SparkSession.builder.getOrCreate()``, so cluster settings apply as usual.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from transitlens.functions.predicates import Box
from transitlens.plans.report import (
    Report,
    box_report,
    clock_report,
    day_clock_report,
    days_report,
    full_report,
)
from transitlens.schema import DEFAULT_MONTH, DEFAULT_YEAR
from transitlens.sources.parquet import load_partitioned
from transitlens.sources.text import load_pings

def parse_args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m transitlens", description=__doc__.split("\n")[0])
    p.add_argument("inputs", nargs="+", help="day files or folders")
    p.add_argument("--box", nargs=4, type=float, metavar=("EAST", "WEST", "NORTH", "SOUTH"))
    p.add_argument("--days", nargs=2, type=int, metavar=("DAY1", "DAY2"))
    p.add_argument("--clock", nargs=2, metavar=("START", "END"), help="HH:MM:SS HH:MM:SS")
    p.add_argument("--year", type=int, help=f"of --days (default {DEFAULT_YEAR})")
    p.add_argument("--month", type=int, help=f"of --days (default {DEFAULT_MONTH})")
    p.add_argument("--rows", type=int, default=20, help="rows printed per section")
    p.add_argument("--persist", action="store_true", help="cache the restricted rows once")
    p.add_argument("--parquet", action="store_true", help="inputs are the Parquet layout")
    return p.parse_args(argv)


def build_report(spark: SparkSession, args: argparse.Namespace) -> Report:
    if args.parquet:
        if len(args.inputs) != 1:
            raise SystemExit("--parquet takes exactly one layout folder")
        pings = load_partitioned(spark, args.inputs[0])
    else:
        pings = load_pings(spark, args.inputs)
    box = Box(*args.box) if args.box else None
    if args.days is None and (args.year is not None or args.month is not None):
        raise SystemExit("--year and --month say which month --days means; give --days with them")
    ym = dict(
        year=DEFAULT_YEAR if args.year is None else args.year,
        month=DEFAULT_MONTH if args.month is None else args.month,
    )
    shape = (box is not None, args.days is not None, args.clock is not None)
    if shape == (True, False, False):
        return box_report(pings, box, persist=args.persist)
    if shape == (False, False, True):
        return clock_report(pings, *args.clock, persist=args.persist)
    if shape == (False, True, False):
        return days_report(pings, *args.days, **ym, persist=args.persist)
    if shape == (False, True, True):
        return day_clock_report(pings, *args.days, *args.clock, **ym, persist=args.persist)
    if shape == (True, True, True):
        return full_report(pings, box, *args.days, *args.clock, **ym, persist=args.persist)
    raise SystemExit(
        "choose --box, --clock, --days, --days with --clock, or --box with --days and --clock"
    )


def main(argv: list[str] | None = None) -> int:
    args = parse_args(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("transitlens-report").getOrCreate()
    try:
        rep = build_report(spark, args)
    except ValueError as exc:  # bad day, clock text or bounds
        raise SystemExit(f"python -m transitlens: error: {exc}") from None
    with rep:
        rep.show(args.rows)
    return 0


if __name__ == "__main__":
    sys.exit(main())
