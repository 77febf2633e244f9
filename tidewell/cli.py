"""Command line: `python -m tidewell.cli STORE ARCHIVE LIVE COMMAND ...`. STORE holds the engine's tables; ARCHIVE and LIVE are
transcript trees.

Usage: build, sync, session ID, catch-up, stats, models, hourly [48], daily [30], weekly, monthly, sessions [40],
  export FOLDER, sql TEXT, schema, pricing [FILE] (shows or replaces the price list: CSV with pattern and five rates in
  micro-USD per million tokens; `--prices FILE` serves a first build).
Archive: archive, restore [--merge-live], status, verify [LOG] (exit 1 if archived lines are missing unexplained).
Repair: repair [--force] [--dry-run].
Prompts: register and merge FILE (append to a history file), scan, find [TEXT] [-n 20] [--project P] [--since DAY] [--all]
  [--full] [--resumable], detect SESSION [FILE].
"""

from __future__ import annotations

import argparse
import csv
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lines as L
from .operators import prompts as P
from .plans.archive import Archive, History, Repairs
from .plans.store import NotReadOnly, UsageStore
from .sources import sinks, transcripts


def read_prices(path: str) -> list[tuple]:
    with open(path, newline="", encoding="utf-8") as f:
        return [(r[0], *map(int, r[1:6])) for r in csv.reader(f) if r and not r[0].startswith("#") and r[1].strip().lstrip("-").isdigit()]


def show(df: DataFrame) -> None:
    for row in sinks.text_rows(df):
        print(row)


def usage(store: UsageStore, a: argparse.Namespace) -> int:
    c, rest = a.command, a.rest
    if c in ("build", "sync", "catch-up"):
        print((store.build() if c == "build" else store.sync()) or "nothing changed")
    elif c == "session":
        print(store.sync_session(rest[0]) or "nothing changed")
    elif c == "stats":
        for name, value in store.figures():
            print(f"{name:<24} {value}")
        if store.unpriced():
            print(f"no price for: {', '.join(store.unpriced())}", file=sys.stderr)
    elif c == "export":
        print("\n".join(store.export(rest[0])))
    elif c == "sql":
        try:
            show(store.sql(rest[0]))
        except NotReadOnly as e:
            print(e, file=sys.stderr)
            return 1
    elif c == "schema":
        print("\n".join(store.schema()))
    elif c == "pricing":
        if rest:
            store.set_pricing(read_prices(rest[0]))
        show(store.table("pricing").orderBy("pattern"))
    else:
        show(store.report(c, int(rest[0]) if rest else None))
    return 0


def archive(spark: SparkSession, a: argparse.Namespace) -> int:
    held = Archive(spark, f"{a.store}/archive", a.live)
    if a.command == "archive":
        print(held.sync())
    elif a.command == "status":
        show(held.status())
    elif a.command == "restore":
        show(held.restore_files(a.merge_live).orderBy("rel"))
    else:
        keyed = lambda root: transcripts.keyed(transcripts.raw_lines(spark, root))
        gone = L.missing(keyed(a.archive), keyed(a.live)).select("rel", "key", "line_no")
        log = transcripts.removal_keys(spark.read.text(a.rest[0])) if a.rest else spark.createDataFrame([], "kind string, rel string, value string")
        classes = L.classify(gone, log)
        show(L.class_counts(classes))
        show(classes.where("class = 'unexplained'").groupBy("rel").count().orderBy(F.desc("count"), "rel").limit(20))
        return int(not classes.where("class = 'unexplained'").isEmpty())
    return 0


def repair(spark: SparkSession, a: argparse.Namespace) -> int:
    held = Repairs(spark, f"{a.store}/repairs", a.live)
    if a.dry_run:
        show(held.due(time.time(), force=a.force).select("rel", "size").orderBy("rel"))
        return 0
    held.sweep(force=a.force)
    show(held.totals())
    show(held.apply().orderBy("rel"))
    return 0


def prompts(spark: SparkSession, a: argparse.Namespace) -> int:
    held, now = History(spark, f"{a.store}/history"), int(time.time() * 1000)
    if a.command in ("register", "merge"):
        state = held.merge_file(a.live, a.rest[0], now)
        print(state)
        return int(state in ("refused", "error"))
    if a.command == "scan":
        show(held.scan(a.live, now).orderBy("timestamp", "session", "line_no"))
        return 0
    rows = transcripts.prompt_rows(transcripts.raw_lines(spark, a.live), now)
    live = transcripts.listing(spark, a.live, top_only=True).select(F.regexp_extract("rel", r"([^/]+)\.jsonl$", 1).alias("session"))
    if a.command == "detect":
        asked = spark.createDataFrame([(a.rest[0],)], "session string")
        show(P.detect(asked, transcripts.history_rows(spark, a.rest[1]) if len(a.rest) > 1 else rows, live))
        return 0
    archived = transcripts.listing(spark, a.archive, top_only=True).select(F.regexp_extract("rel", r"([^/]+)\.jsonl$", 1).alias("session"))
    found = P.state(P.find(rows, a.rest[0] if a.rest else "", a.project, a.since), live, archived)
    found = found.where("state = 'live'") if a.resumable else found
    out = found.orderBy(F.desc("last"), "session")
    out = out.withColumn("matches", F.array_join("matches", " | ") if a.full else F.col("first_match")).drop("first_match")
    show(out if a.all else out.limit(a.n))
    if not a.all:
        print(f"{min(a.n, total := found.count())} of {total}", file=sys.stderr)
    return 0


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("store", "archive", "live", "command"):
        p.add_argument(name)
    p.add_argument("rest", nargs="*")
    p.add_argument("-n", type=int, default=20)
    for name in ("prices", "project", "since"):
        p.add_argument(f"--{name}", default="")
    for name in ("merge-live", "force", "dry-run", "all", "full", "resumable"):
        p.add_argument(f"--{name}", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("archive", "restore", "status", "verify"):
        return archive(spark, a)
    if a.command == "repair":
        return repair(spark, a)
    if a.command in ("register", "merge", "scan", "find", "detect"):
        return prompts(spark, a)
    known = ("build", "sync", "session", "catch-up", "stats", "models", "hourly", "daily", "weekly", "monthly", "sessions", "export", "sql", "schema", "pricing")
    if a.command not in known:
        p.print_usage(sys.stderr)
        return 2
    return usage(UsageStore(spark, f"{a.store}/usage", a.archive, a.live, read_prices(a.prices) if a.prices else None), a)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
