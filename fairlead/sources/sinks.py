"""Export formats by name; every one is a distributed write of text or rows."""

from __future__ import annotations

import json
import time
import zipfile
from collections.abc import Callable
from dataclasses import replace
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions.exprs import iso_instant
from fairlead.operators.reports import eta_ms
from fairlead.plans.query import Query


def raw_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("aisdata").alias("value"))


def json_lines(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One object a row; absent values are left out."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("value"))


def table_lines(rows: DataFrame, columns: list[str], separator: str = ",") -> DataFrame:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.select(F.array_join(F.array(*cells), separator).alias("value"))


def kml_tracks(rows: DataFrame, max_points: int = 10_000) -> DataFrame:
    """One placemark for each vessel and run of ``max_points`` positions, so that no row grows with a vessel's history."""
    placed = rows.where("lat is not null and lon is not null")
    # Runs are cut by day first: a vessel's day is bounded by what a transponder can send.
    day = F.floor(F.col("time_ms") / 86_400_000)
    order = F.row_number().over(W.partitionBy("mmsi", day).orderBy("time_ms", "digest")) - 1
    cut = placed.withColumns({"day": day, "run": F.floor(order / max_points)})
    point = F.struct("time_ms", "digest", F.format_string("%.6f,%.6f", "lon", "lat").alias("at"))
    lines = cut.groupBy("mmsi", "day", "run").agg(F.sort_array(F.collect_list(point)).alias("p"))
    named = [F.lit("<Placemark><name>"), F.col("mmsi").cast("string"), F.lit("</name><LineString><coordinates>")]
    return lines.select("mmsi", F.concat(*named, F.array_join(F.col("p.at"), " "), F.lit("</coordinates></LineString></Placemark>")).alias("value"))


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns], F.lit("</tr>")).alias("value"))


def prefixed_sentences(rows: DataFrame) -> DataFrame:
    """Each packet behind its time in ISO form."""
    return rows.select(F.concat_ws(" ", iso_instant(F.col("time_ms")), F.col("aisdata")).alias("value"))


def kml_document(rows: DataFrame, name: str = "Tracks") -> DataFrame:
    """Placemarks of ``kml_tracks`` between a document's first and last lines; ``part`` orders them."""
    spark = rows.sparkSession
    lines = [(0, '<?xml version="1.0" encoding="UTF-8"?>'), (0, f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(name)}</name>'), (2, "</Document></kml>")]
    frame = spark.createDataFrame(lines, "part int, value string")
    return kml_tracks(rows).select(F.lit(1).alias("part"), "value").unionByName(frame)


SINKS: dict[str, Callable[..., DataFrame]] = {
    "raw": lambda rows, **_: raw_lines(rows),
    "json": lambda rows, **_: json_lines(rows),
    "jsonObject": lambda rows, columns=None, **_: json_lines(rows, columns),
    "table": lambda rows, columns=None, separator=",", **_: table_lines(rows, columns or rows.columns, separator),
    "kml": lambda rows, **_: kml_tracks(rows).select("value"),
    "html": lambda rows, columns=None, **_: html_rows(rows, columns or rows.columns),
    "prefixed_sentences": lambda rows, **_: prefixed_sentences(rows),
}


def export(rows: DataFrame, path: str, output: str = "raw", columns: list[str] | None = None, separator: str = ",", header: bool = True, mode: str = "error", footer: bool = False) -> int:
    """Write rows in a format, as a folder of part files; the number of rows written (observed by the write itself) comes back.

    ``footer`` adds a file that says it. A kml export has its document's first lines in a part before all others and its last in one behind.
    """
    if output not in SINKS:
        raise ValueError(f"unknown output {output!r}: {', '.join(sorted(SINKS))}")
    seen = Observation("export")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if output == "table":
        counted.select(*(columns or rows.columns)).write.mode(mode).csv(path, sep=separator, header=header)
    elif output == "kml":
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = F.when(F.col("part") == 0, 0).when(F.col("part") == 2, n + 1).otherwise(1 + F.pmod(F.hash("value"), F.lit(n)))
        ordered = kml_document(counted).repartitionById(n + 2, place.cast("int")).sortWithinPartitions("part", F.desc(F.col("value").startswith("<?xml")))
        ordered.select("value").write.mode(mode).text(path)
    else:
        SINKS[output](counted, columns=columns, separator=separator).write.mode(mode).text(path)
    if footer:
        one_line(rows.sparkSession, f"{seen.get['n']} packets", f"{path}/_footer")
    return seen.get["n"]


def one_line(spark: SparkSession, text: str, path: str) -> None:
    """Write a line of text to a folder of its own, which replaces what was there."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def zipped(spark: SparkSession, path: str, target: str, member: str = "doc.kml") -> None:
    """The part files of an export, in their order, as one member of a zip file on the driver's disk (kmz); read a line at a time."""
    parts = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as out:
        for part in parts:
            for r in spark.read.text(part).toLocalIterator():
                out.write(r["value"].encode() + b"\n")


def chunks_of(t0_ms: int, t1_ms: int, chunk_ms: int) -> list[tuple[int, int]]:
    """An interval cut at multiples of ``chunk_ms``."""
    edges = [t0_ms, *range((t0_ms // chunk_ms + 1) * chunk_ms, t1_ms, chunk_ms), t1_ms]
    return list(zip(edges, edges[1:]))


def _log(spark: SparkSession, path: str) -> list[dict]:
    """Commits of an export, in order; empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return sorted((json.loads(r["value"]) for r in spark.read.option("recursiveFileLookup", "true").text(f"{path}/_commits").collect()), key=lambda c: c["chunk"])


def resumed_export(
    query: Query, spark: SparkSession, archive: str, path: str, force: bool = False, chunk_ms: int = 86_400_000, mids: DataFrame | None = None,
    watch: Callable[[dict], None] | None = None, **how,
) -> dict:
    """Export a query's interval chunk by chunk of time, and go on where an earlier run into ``path`` ended.

    Each chunk is a folder of its own (``chunk=..``) and counts once its commit stands beside it (``_commits``): how far the export has come, the last
    time and the number of packets so far, and when it will be done at this pace; ``watch`` sees each. A run that is killed
    goes on behind the last commit, and what it had begun is written over: no packet is lost or comes twice. ``_meta`` repeats the last commit for
    readers of that file. A later query may reach further; ``force`` begins anew. A query that thins packets, or takes the first so many,
    is one chunk, since what it keeps depends on all before.
    """
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if force:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    done = _log(spark, path)
    t0, t1 = query.interval
    last = done[-1] if done else {"chunk": -1, "to": None, "timestamp": None, "packageCount": 0}
    begin, again = (t0, query.include_start) if last["to"] is None or last["to"] < t0 else (last["to"], True)
    if query.after_ms is not None and query.after_ms >= begin:
        begin, again = query.after_ms, False
    alone = query.limit is not None or query.min_ms is not None or query.min_m is not None or query.repeats_ms is not None
    began = int(time.time() * 1000)
    for low, high in [(begin, t1)] if alone and begin < t1 else chunks_of(begin, t1, chunk_ms) if begin < t1 else []:
        part = replace(query, interval=(low, high), include_start=again, after_ms=None)
        again = True
        seen = Observation("chunk")
        rows = part.to_df(spark, archive, mids).observe(seen, F.max("time_ms").alias("t"), F.count(F.lit(1)).alias("n"))
        number = last["chunk"] + 1
        export(rows, f"{path}/chunk={number:06d}", mode="overwrite", **how)
        percent = 100.0 * (high - t0) / (t1 - t0)
        last = {
            "chunk": number, "from": low, "to": high, "timestamp": max((x for x in (last["timestamp"], seen.get["t"]) if x is not None), default=None),
            "packageCount": last["packageCount"] + seen.get["n"], "percent": percent, "eta": eta_ms(100.0 * (high - begin) / (t1 - begin), began, int(time.time() * 1000)),
        }
        one_line(spark, json.dumps(last), f"{path}/_commits/{number:06d}")
        one_line(spark, json.dumps(_meta(path, last)), f"{path}/_meta")
        if watch is not None:
            watch(last)
    return _meta(path, last)


def _meta(path: str, last: dict) -> dict:
    return {"filename": path, "timestamp": last["timestamp"], "packageCount": last["packageCount"]}
