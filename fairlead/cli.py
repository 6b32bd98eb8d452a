"""``python -m fairlead.cli archive|import|generate|export|stats|diff|compact ...``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from fairlead.functions import params
from fairlead.functions.exprs import timeblock
from fairlead.operators import reports
from fairlead.operators.routing import write_tables
from fairlead.plans.query import Query
from fairlead.schema import TEN_MINUTES_MS
from fairlead.sources import archive, nmea, sinks
from fairlead.streaming import ingest


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fairlead")
    to = top.add_subparsers(dest="command", required=True)
    live = to.add_parser("archive", help="store packets of live sources as they come")
    live.add_argument("sources", nargs="*", type=ingest.source_group, help="name=host:port,host:port")
    live.add_argument("--log", help="folder in which a receiver logs lines, a folder for each source; in place of sources")
    live.add_argument("--once", action="store_true", help="take what the log holds and stop")
    live.add_argument("--checkpoint", required=True, help="folder that driver and executors share")
    live.add_argument("--backup", help="folder of zip files to take whenever the stream is idle")
    live.add_argument("--batch", type=int, default=10_000, help="rows of a batch; with fewer in its last one a stream is idle")
    live.add_argument("--every", default="10 seconds")
    take = to.add_parser("import", help="read text files into the tables")
    bulk = to.add_parser("generate", help="read text files into new tables, with ten-degree cells")
    for p in (take, bulk):
        p.add_argument("input")
        p.add_argument("--glob", default="*")
        p.add_argument("--tag")
        p.add_argument("--verbose", action="store_true")
    give = to.add_parser("export", help="write the packets of a query")
    give.add_argument("--mmsi", type=int, action="append")
    give.add_argument("--area", "--box", help="lat,lon,lat,lon of two corners")
    give.add_argument("--date-line", action="store_true", help="the area goes from the first corner eastwards to the second")
    when = give.add_mutually_exclusive_group(required=True)
    when.add_argument("--interval")
    when.add_argument("--last", help="a duration up to now")
    give.add_argument("--filter")
    give.add_argument("--mids", help="CSV table of countries: mid, alpha3, alpha2")
    give.add_argument("--output-format", default="raw", choices=sorted([*sinks.SINKS, "kmz"]))
    give.add_argument("--columns", type=params.column_list)
    give.add_argument("--separator", default=",")
    give.add_argument("--no-header", action="store_true")
    give.add_argument("--min-distance", type=float, help="metres")
    give.add_argument("--min-duration", type=params.duration_ms, help="as PT30S")
    give.add_argument("--duplicate-window", type=int, help="milliseconds")
    give.add_argument("--resume", action="store_true", help="append what the last run into this folder didn't have")
    give.add_argument("--force", action="store_true", help="begin anew")
    give.add_argument("--chunk", type=params.duration_ms, default="P1D", help="time that a resumable export commits at once")
    give.add_argument("--resume-after", type=int)
    give.add_argument("--limit", type=int)
    give.add_argument("--dry-run", action="store_true")
    give.add_argument("out", nargs="?", default="-", help="a folder (kmz: a file); - prints the lines")
    count = to.add_parser("stats", help="count packets by chunks of time blocks")
    count.add_argument("--interval", required=True)
    count.add_argument("--blocks", type=int, default=10)
    less = to.add_parser("diff", help="packets of files that the archive lacks")
    less.add_argument("input")
    less.add_argument("--glob", default="*")
    small = to.add_parser("compact", help="make one run of days that several have written, and delete what no query needs")
    small.add_argument("--most-files", type=int, default=archive.SPREAD)
    small.add_argument("--keep", default="PT4H", type=params.duration_ms, help="how long replaced files stay for queries that still read them")
    for p in (live, take, bulk, give, count, less, small):
        p.add_argument("--archive", required=True)
    return top


def give_out(spark: SparkSession, a: argparse.Namespace) -> None:
    between = params.interval_ms(a.interval) if a.interval else params.ending_now(a.last, int(time.time() * 1000))
    query = Query.choose(a.mmsi, params.bounding_box(a.area) if a.area else None)
    if query.kind == "area" and a.date_line:
        query = Query.for_area(tuple(float(x) for x in a.area.split(",")), wrap=True)
    query = query.between(*between).where(a.filter).resume_after(a.resume_after).first(a.limit)
    query = query.thinned(a.min_duration, a.min_distance, a.duplicate_window)
    mids = spark.read.csv(a.mids, header=True) if a.mids else None
    how = {"output": a.output_format, "columns": a.columns, "separator": a.separator, "header": not a.no_header}
    if a.resume or a.force:
        told = lambda c: print(f"{c['percent']:.1f} %, {c['packageCount']} packets, done at {c['eta']}", file=sys.stderr)
        print(json.dumps(sinks.resumed_export(query, spark, a.archive, a.out, a.force, a.chunk, mids, told, **how)))
        return
    rows = query.to_df(spark, a.archive, mids)
    if a.dry_run:
        rows.explain("formatted")
    elif a.output_format == "kmz":
        print(sinks.export(rows, a.out + ".parts", "kml"), "packets")
        sinks.zipped(spark, a.out + ".parts", a.out)
    elif a.out == "-":
        n = 0
        for n, r in enumerate(sinks.SINKS[a.output_format](rows, columns=a.columns, separator=a.separator).toLocalIterator(), 1):
            print(r["value"])
        print(n, "lines", file=sys.stderr)
    else:
        print(sinks.export(rows, a.out, **how), "packets")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fairlead").getOrCreate()
    if a.command == "archive":
        store = lambda packets: write_tables(packets, a.archive)
        if a.log:
            live = ingest.archive_log(spark, a.log, a.archive, a.checkpoint, **({"availableNow": True} if a.once else {"processingTime": a.every}))
        else:
            packets = ingest.without_replays(ingest.live_packets(spark, dict(a.sources)))
            live = ingest.archive(packets, a.archive, a.checkpoint, processingTime=a.every)
        if a.backup and not a.once:
            ingest.replay_when_idle(spark, live, a.backup, store, a.batch)
        live.awaitTermination()
        while a.once and a.backup and any(ingest.replay_files(spark, a.backup, store).values()):
            pass
    elif a.command in ("import", "generate"):
        seen = reports.Ingest()
        packets = seen.watch(nmea.packets_of(nmea.read_lines(spark, a.input, a.glob, tag=a.tag)))
        if a.command == "generate" and archive.committed(spark, a.archive).version:
            raise SystemExit(f"{a.archive} has tables already")
        write_tables(packets, a.archive, "bulk" if a.command == "generate" else "online", cell10=a.command == "generate")
        if a.verbose:
            print(json.dumps(seen.report()))
    elif a.command == "export":
        give_out(spark, a)
    elif a.command == "stats":
        t0, t1 = params.interval_ms(a.interval)
        for r in reports.chunk_counts(archive.read_table(spark, a.archive, "packets_time", t0, t1), t0, t1, a.blocks).orderBy("first_block").toLocalIterator():
            print(f"blocks {r['first_block']}..{r['last_block']}: {r['n']}")
    elif a.command == "compact":
        print(json.dumps({"replaced": archive.compact(spark, a.archive, a.most_files), "snapshots": len(archive.take_snapshots(spark, a.archive)), "deleted": archive.vacuum(spark, a.archive, int(time.time() * 1000) - a.keep)}))
    else:
        files = nmea.packets_of(nmea.read_lines(spark, a.input, a.glob)).withColumn("timeblock", timeblock("time_ms", TEN_MINUTES_MS))
        for r in reports.missing_from(files, archive.read_table(spark, a.archive, "packets_time")).toLocalIterator():
            print(r["aisdata"])


if __name__ == "__main__":
    main()
