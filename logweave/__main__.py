"""Command line: ``python -m logweave dump|check|repair|try-purge --path DIR``."""

from __future__ import annotations

import argparse
import importlib

from .plans.engine import LogEngine
from .session import session
from .sources import rawlog


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="logweave", description="Tools for log tables and directories of raw log files.")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("dump", "print all operations"), ("check", "print regions with holes and their last valid index"), ("repair", "write a repaired copy"), ("try-purge", "collect garbage once")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--path", required=True)
        if name == "dump":
            p.add_argument("--raw", action="store_true", help="the path holds raw log files (or is one)")
            p.add_argument("-r", "--regions", default="", help="comma-separated region ids")
        if name == "repair":
            p.add_argument("--filter", required=True, help="module:function that answers 0, 1 or 2")
            p.add_argument("--to", required=True)
    o = parser.parse_args(args)
    spark = session("logweave", "local[*]")
    if o.command == "dump":
        ids = [int(x) for x in o.regions.split(",") if x]
        if o.raw:
            rawlog.register(spark)
            rows = spark.read.format("raw_log").option("path", o.path).option("payloads", "false").load().drop("payloads")
            rows = rows.where(rows.region_id.isin(ids) | rows.error.isNotNull()) if ids else rows
            rows = rows.orderBy("lsn")
        else:
            rows = LogEngine(spark, o.path).dump(ids).drop("payloads")
        for r in rows.toLocalIterator():
            print({k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if v is not None})
    elif o.command == "check":
        for r in LogEngine(spark, o.path).consistency_check().toLocalIterator():
            print(f"region {r.region_id}: last valid index {r.last_valid}")
    elif o.command == "repair":
        module, _, name = o.filter.partition(":")
        LogEngine(spark, o.path).repair(getattr(importlib.import_module(module), name), o.to)
    else:
        print("compact:", *LogEngine(spark, o.path).purge_expired_files())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
