"""Command line: refresh a snapshot group, or run one report to Parquet.

    python -m depotlens.cli refresh [daily|weekly|monthly] --as-of 2001-07-01 --tables <root>
    python -m depotlens.cli report v1_warehouse_performance --as-of 2001-07-01 --tables <root> --out <dir>
    python -m depotlens.cli layout --fixture-sf /root/testdata/sf0.1 --out <root> [--kind plain|bucketed|monthly]
    python -m depotlens.cli clean --hours 72

``--tables`` is a folder of the twelve base tables (one Parquet folder each);
``--fixture-sf <dir>`` derives them from the test tables instead.  Scheduling
(daily 02:00, Monday 03:00, first of month 04:00) is external; ``due_groups``
tells which groups a given hour runs.
"""

from __future__ import annotations

import argparse
import datetime as dt
import inspect
import json
import sys

from .operators import snapshots as S
from .session import build_session, expire_written


def _tables(spark, args):
    if args.fixture_sf:
        from .sources.fixtures import fixture_tables
        return fixture_tables(spark, args.fixture_sf)
    from .sources.tables import load_tables
    return load_tables(spark, args.tables)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="depotlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("refresh", "report", "layout"):
        sp = sub.add_parser(name)
        if name != "layout":
            sp.add_argument("--as-of", required=True, type=dt.date.fromisoformat)
        src = sp.add_mutually_exclusive_group(required=True)
        src.add_argument("--tables")
        src.add_argument("--fixture-sf")
        sp.add_argument("--master", default=None)
    sub.choices["refresh"].add_argument("group", nargs="?", default="daily")
    sub.choices["refresh"].add_argument("--root", default=None)
    sub.choices["report"].add_argument("name")
    sub.choices["report"].add_argument("--out", required=True)
    sub.choices["layout"].add_argument("--out", required=True)
    sub.choices["layout"].add_argument("--kind", choices=["plain", "bucketed", "monthly"], default="plain")
    sub.choices["layout"].add_argument("--prefix", default="wms_", help="of the names of bucketed tables")
    sub.choices["layout"].add_argument("--buckets", type=int, default=200)
    clean = sub.add_parser("clean")
    clean.add_argument("--hours", required=True, type=float)
    clean.add_argument("--master", default=None)
    args = p.parse_args(argv)

    if args.cmd == "refresh" and args.group not in S.GROUPS:
        print(f"usage: refresh [{'|'.join(S.GROUPS)}]", file=sys.stderr)
        return 2
    spark = build_session(args.master)
    if args.cmd == "clean":
        print(json.dumps(expire_written(spark, args.hours)))
        return 0
    t = _tables(spark, args)
    if args.cmd == "layout":
        if args.kind == "bucketed":
            from .sources.bucketed import write_bucketed
            print(json.dumps(sorted(write_bucketed(t, args.out, args.prefix, args.buckets))))
        elif args.kind == "monthly":
            from .sources.monthly import write_monthly
            write_monthly(t, args.out)
        else:
            from .sources.tables import write_tables
            print(json.dumps(write_tables(t, args.out)))
        return 0
    if args.cmd == "refresh":
        print(json.dumps(S.refresh(spark, t, args.group, args.as_of, args.root), default=str))
        return 0
    from .plans import registry
    fn = registry.REPORT_FUNCTIONS[args.name]
    kwargs = {"as_of": args.as_of} if "as_of" in inspect.signature(fn).parameters else {}
    fn(t, **kwargs).write.mode("errorifexists").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
