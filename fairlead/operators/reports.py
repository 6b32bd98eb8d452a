"""Counts, differences, extents and listings."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.exprs import timeblock
from fairlead.schema import TEN_MINUTES_MS


def chunk_counts(packets: DataFrame, t0_ms: int, t1_ms: int, blocks: int = 10) -> DataFrame:
    """``(first_block, last_block, n)`` for every chunk of ``blocks`` time blocks in [t0, t1), empty ones too."""
    b0, b1 = t0_ms // TEN_MINUTES_MS, (t1_ms - 1) // TEN_MINUTES_MS
    rows = packets.where((F.col("time_ms") >= t0_ms) & (F.col("time_ms") < t1_ms))
    counted = rows.groupBy(F.floor((timeblock("time_ms", TEN_MINUTES_MS) - b0) / blocks).alias("chunk")).agg(F.count("*").alias("n"))
    every = packets.sparkSession.range((b1 - b0) // blocks + 1).withColumnRenamed("id", "chunk")
    first = F.col("chunk") * blocks + b0
    return every.join(counted, "chunk", "left").select(first.alias("first_block"), F.least(first + (blocks - 1), F.lit(b1)).alias("last_block"), F.coalesce("n", F.lit(0)).alias("n"))


def missing_from(files: DataFrame, store: DataFrame) -> DataFrame:
    """Packets whose millisecond the store doesn't hold; texts are not compared."""
    return files.join(store.select("timeblock", "time_ms"), ["timeblock", "time_ms"], "left_anti")


def diff_counts(files: DataFrame, store: DataFrame) -> DataFrame:
    """``(processed, in_store, not_in_store)``."""
    held = store.select("timeblock", "time_ms").distinct().withColumn("held", F.lit(True))
    joined = files.join(held, ["timeblock", "time_ms"], "left")
    return joined.agg(F.count("*").alias("processed"), F.count_if(F.col("held")).alias("in_store"), F.count_if(F.col("held").isNull()).alias("not_in_store"))


def extent(packets: DataFrame) -> DataFrame:
    return packets.agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def eta_ms(percent: float, began_ms: int, now_ms: int) -> int | None:
    """When an export that has covered ``percent`` of its interval will be done at the pace so far; unknown at the start."""
    return None if percent <= 0 else now_ms + round((now_ms - began_ms) * max(0.0, 100.0 - percent) / percent)


class Ingest:
    """Counts of what passes through a write, and its rate: ``watch`` the rows, write them, then ask."""

    def __init__(self) -> None:
        self.seen, self.began = Observation("ingest"), time.monotonic()

    def watch(self, packets: DataFrame) -> DataFrame:
        return packets.observe(self.seen, F.count(F.lit(1)).alias("packets"), F.count("msgtype").alias("decoded"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))

    def report(self) -> dict[str, float]:
        """Counters of the finished write, seconds since the watch began and packets a second."""
        took = max(time.monotonic() - self.began, 1e-9)
        return {**self.seen.get, "seconds": took, "per_second": self.seen.get["packets"] / took}


def is_empty(rows: DataFrame) -> bool:
    """Whether there is no row; one is looked for."""
    return rows.isEmpty()


def progress(packets: DataFrame, t0_ms: int, t1_ms: int) -> DataFrame:
    """Share of the interval that the rows reach, in percent."""
    return packets.agg((100.0 * (F.max("time_ms") - t0_ms) / F.lit(float(t1_ms - t0_ms))).alias("percent"))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, updated, size)`` of the files of a folder, without their contents; empty if there are none."""
    kinds = "path string, name string, updated long, size long"
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], kinds)
    return found.select("path", F.substring_index("path", "/", -1).alias("name"), F.unix_millis("modificationTime").alias("updated"), F.col("length").alias("size"))


def repository(files: DataFrame, suffix: str | None = None) -> DataFrame:
    """``files(path, name, updated, size)``: no hidden ones, with ``complete``; by time, unknown ones first."""
    rows = files.where(~F.col("name").startswith("."))
    rows = rows if suffix is None else rows.where(F.col("name").endswith(suffix))
    return rows.withColumn("complete", ~F.col("name").endswith(".download")).orderBy(F.col("updated").asc_nulls_first(), "name")


def expired(files: DataFrame, now_ms: int, hours: int = 4) -> DataFrame:
    return files.where(F.col("updated") < now_ms - hours * 3_600_000)


def clean_up(spark: SparkSession, path: str, now_ms: int, hours: int = 4) -> int:
    """Delete expired files of a folder, and folders below it that this leaves empty, in whatever store they are; say how many files went."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    files = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root, n = files.makeQualified(new(path)), 0
    for r in expired(files_of(spark, path), now_ms, hours).select("path").toLocalIterator():
        at = new(new(r["path"]).toUri())
        n += bool(files.delete(at, False))
        above = at.getParent()
        while not above.equals(root) and above.depth() > root.depth() and files.exists(above) and not len(files.listStatus(above)):
            files.delete(above, False)
            above = above.getParent()
    return n
