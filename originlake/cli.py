"""Command line: rebuild, update, fix, search, export, serve."""

from __future__ import annotations

import argparse
import os
import sys
import threading
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlake.functions.dates import strict_date
from originlake.model import OBS_SCHEMA
from originlake.operators import history as H
from originlake.operators import query as Q
from originlake.sources import dumps, jsonl, store
from originlake.streaming import updater


def table_lines(rows: DataFrame) -> Iterator[str]:
    """All result rows as lines of a text table with the columns origin, prefix, max_len, dates_ranges, streamed in order."""
    head = ["origin", "prefix", "max_len", "dates_ranges"]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in head]
    most = Q.display_rows(rows).select(texts).agg(*(F.max(F.length(c)).alias(c) for c in head)).first()
    width = [max(len(c), most[c] or 0) for c in head]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    yield line(head)
    yield "|" + "|".join("-" * (w + 2) for w in width) + "|"
    yield from map(line, Q.display_rows(rows.orderBy(*Q.ORDER)).select(texts).toLocalIterator())


def text_table(rows: DataFrame) -> str:
    """The table's lines as one text, for results that fit the driver."""
    return "\n".join(table_lines(rows))


def _observations(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Good rows of listed dumps: only these files are opened."""
    paths = [r[0] for r in files.select("url").collect()]  # names, five a day
    if paths:
        return dumps.good_rows(dumps.parse_dumps(spark, paths))
    return updater.observations_from_rows(spark.createDataFrame([], OBS_SCHEMA))


def rebuild(spark: SparkSession, path: str, base: str, tal: str | None = None, since=None, until=None) -> str:
    """Bulk load of a dump tree. Gap filling is not part of it: run ``fix`` on the transport, or the updater."""
    return store.publish(H.build_history(_observations(spark, dumps.list_dumps(spark, base, tal, since, until))), path)


def update(spark: SparkSession, path: str, base: str, tal: str | None = None, until=None) -> str:
    """Append the days after the store's latest date, or make the store."""
    if not store.exists(spark, f"{path}/CURRENT"):
        return rebuild(spark, path, base, tal, None, until)
    old = store.open_store(spark, path)
    files = dumps.list_dumps(spark, base, tal, None, until).where(F.col("file_date") > F.lit(store.store_meta(spark, path)["latest_date"]))
    return store.publish(updater.update_history(old, _observations(spark, files), fill=False), path)


def fix(spark: SparkSession, source: str, target: str | None = None) -> str:
    """Compress and gap-fill a transport; in place by writing beside it and renaming, so that it is never missing."""
    out = target or f"{source}.fixed"
    if target is None and not store.exists(spark, source) and store.exists(spark, f"{source}.old"):
        store.replace(spark, f"{source}.old", source)  # of a run that was cut short
    jsonl.export_jsonl(H.fix_history(jsonl.read_jsonl(spark, source)), out)
    if target is None:
        store.replace(spark, out, source)
    return target or source


def _bool(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="originlake")
    p.add_argument("path", nargs="?", default="originlake-store", help="folder of the stored history")
    p.add_argument("-b", "--bootstrap", action="append", metavar="JSONL", help="transport to make a missing store from; first found")
    p.add_argument("--env", help="file of NAME=value lines to put into the environment")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("rebuild")
    r.add_argument("--base", required=True)
    r.add_argument("--tal")
    r.add_argument("--from", dest="since", type=strict_date)
    r.add_argument("--until", type=strict_date)
    u = sub.add_parser("update")
    u.add_argument("--base", required=True)
    u.add_argument("--tal")
    u.add_argument("--until", type=strict_date)
    f = sub.add_parser("fix")
    f.add_argument("input")
    f.add_argument("-o", "--output")
    s = sub.add_parser("search")
    s.add_argument("--asn", type=int)
    s.add_argument("--prefix")
    s.add_argument("--max-len", type=int)
    s.add_argument("--date")
    s.add_argument("--current", type=_bool)
    s.add_argument("--exact", type=_bool, default=True)
    e = sub.add_parser("export")
    e.add_argument("--output", required=True)
    v = sub.add_parser("serve")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=40065)
    v.add_argument("--base", help="dump tree to watch")
    v.add_argument("--checkpoint")
    v.add_argument("--root", default="/", help="path under which the routes stand")
    v.add_argument("--backup-to", help="transport to write after each update; ORIGINLAKE_BACKUP_TO")
    v.add_argument("--heartbeat", help="address to get after each backup; ORIGINLAKE_HEARTBEAT")
    v.add_argument("--update-interval", type=int, default=28_800)
    return p


def _beat(address: str | None):
    return None if address is None else lambda: urllib.request.urlopen(address, timeout=30).close()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.env:
        with open(a.env, encoding="utf-8") as lines:
            os.environ.update(x.strip().split("=", 1) for x in lines if "=" in x and not x.startswith("#"))
    spark = spark or SparkSession.builder.appName("originlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.bootstrap:
        store.bootstrap(spark, a.path, a.bootstrap)
    if a.command == "rebuild":
        print(rebuild(spark, a.path, a.base, a.tal, a.since, a.until))
    elif a.command == "update":
        print(update(spark, a.path, a.base, a.tal, a.until))
    elif a.command == "fix":
        print(fix(spark, a.input, a.output))
    else:
        try:
            rows = store.open_store(spark, a.path)
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 1
        if a.command == "search":
            for line in table_lines(Q.search(rows, a.prefix, a.asn, a.max_len, a.date, a.current, a.exact)):
                print(line)
        elif a.command == "export":
            jsonl.export_jsonl(rows, a.output)
        else:
            from originlake.http_api import serve

            if a.base:
                options = {
                    "backup_to": a.backup_to or os.environ.get("ORIGINLAKE_BACKUP_TO"),
                    "heartbeat": _beat(a.heartbeat or os.environ.get("ORIGINLAKE_HEARTBEAT")),
                }
                args = (threading.Event(), a.update_interval, spark, a.base, a.path, a.checkpoint or f"{a.path}/_checkpoint")
                threading.Thread(target=updater.watch, args=args, kwargs=options, daemon=True).start()
            serve(spark, a.path, a.host, a.port, a.root)
    return 0


if __name__ == "__main__":
    sys.exit(main())
