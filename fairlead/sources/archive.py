"""Stored tables: sorted runs under a manifest, read with each packet once.

Every write is a run of Parquet files by table and day. A commit is one small file that names the entries (a row for each
data file: its table, day, rows, first and last time and key, and which vessels it may hold) and the removals that count;
it comes into being by one rename, so that readers see a run whole or not at all. A packet that was written again has the
same primary key: readers take it from the latest run, and compaction leaves it out. Both look at what the entries say first:
a day that one run alone has written needs no comparison, and a vessel's scan opens the files that may hold it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.schema import PLACED

DAY_MS = 86_400_000
#: Files of one table and day in a run, at most; rows of a file that compaction makes; lists of entries in a commit before they are made one.
SPREAD, ROWS_A_FILE, MOST_LISTS = 16, 2_000_000, 32
#: Bits that say which vessels a file may hold.
VESSEL_BITS = 32_768
STORED = T.StructType([*PLACED, T.StructField("run", T.StringType()), T.StructField("table", T.StringType()), T.StructField("day", T.IntegerType())])
ENTRY = "file string, run string, table string, day int, rows long, first_ms long, last_ms long, first_key int, last_key int, vessels binary"


@dataclass(frozen=True)
class Commit:
    """What counts at one version: folders of entries, and of names of files that are no longer live."""

    version: int = 0
    entries: tuple[str, ...] = ()
    removed: tuple[str, ...] = field(default=())


class Taken(RuntimeError):
    """Another writer has made this version."""


def _paths(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> Commit:
    """The latest commit of an archive; one that isn't there yet has none."""
    jvm, at, files = _paths(spark, f"{path}/_log/commits")
    if not files.exists(at):
        return Commit()
    latest = max((s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().endswith(".json")), default=None)
    if latest is None:
        return Commit()
    stream = files.open(jvm.org.apache.hadoop.fs.Path(at, latest))
    try:
        said = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Commit(int(latest.split(".")[0]), tuple(said["entries"]), tuple(said["removed"]))


def commit(spark: SparkSession, path: str, new: Commit) -> None:
    """Make the version by one rename that doesn't replace; ``Taken`` if another writer was first."""
    jvm, folder, files = _paths(spark, f"{path}/_log/commits")
    files.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f"_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"entries": new.entries, "removed": new.removed}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(folder, f"{new.version:012d}.json"), plain)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e):
            raise
        files.delete(draft, False)
        raise Taken(f"version {new.version}") from None


def entries(spark: SparkSession, path: str, at: Commit | None = None) -> DataFrame:
    """Live data files, a row each (``ENTRY``)."""
    at = committed(spark, path) if at is None else at
    if not at.entries:
        return spark.createDataFrame([], ENTRY)
    found = spark.read.schema(ENTRY).parquet(*[f"{path}/_log/{x}" for x in at.entries])
    if at.removed:
        found = found.join(spark.read.schema("file string").parquet(*[f"{path}/_log/{x}" for x in at.removed]), "file", "left_anti")
    return found


def _vessel_bit(mmsi: Column) -> Column:
    return F.pmod(F.hash(mmsi.cast("int")), F.lit(VESSEL_BITS))


def key_of() -> Column:
    """A row's key in its table: its cell, its vessel, none in the table by time."""
    return F.when(F.col("table").startswith("packets_area_cell"), F.col("cellid")).when(F.col("table") != "packets_time", F.col("mmsi"))


def primary_key() -> list[Column]:
    return [F.col("table"), F.col("day"), key_of(), F.col("timeblock"), F.col("time_ms"), F.col("digest")]


def latest_only(rows: DataFrame) -> DataFrame:
    """Rows of one primary key come down to that of the latest run."""
    place = F.row_number().over(W.partitionBy(*primary_key()).orderBy(F.desc("run")))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def _write(rows: DataFrame, path: str, run: str, spread: Column) -> str | None:
    """Write ``rows`` (``STORED``, maybe without run) as a run and its entries; the folder of entries, or none if there was no row.

    One shuffle deals rows by table, day and a share of the keys (of the day's time in the table by time, so that
    files there follow one another); repeats of a key meet in one task and are told apart by the sort that the files have anyway: the latest run's
    stays, where rows have one.
    """
    spark = rows.sparkSession
    share = F.when(F.col("table") == "packets_time", F.pmod(F.col("time_ms"), F.lit(DAY_MS)) * spread / DAY_MS).otherwise(F.pmod(F.hash(key_of()), spread))
    dealt = rows.withColumns({"_share": share.cast("int"), "_key": key_of()}).repartition("table", "day", "_share")
    order, latest = ["table", "day", "_share", "_key", "time_ms", "digest"], [F.desc("run")] if "run" in rows.columns else []
    once = dealt.withColumn("_place", F.row_number().over(W.partitionBy(*order, "timeblock").orderBy(*latest, "aisdata"))).where("_place = 1")
    names = [f.name for f in STORED if f.name != "run"]
    once.sortWithinPartitions(*order).select(*names).write.partitionBy("table", "day").parquet(f"{path}/data/run={run}")
    if not _has_files(spark, f"{path}/data/run={run}"):
        return None
    written = spark.read.option("basePath", f"{path}/data").schema(STORED).parquet(f"{path}/data/run={run}")
    file = F.substring_index(F.col("_metadata.file_path"), "/data/", -1).alias("file")
    told = written.select(file, "run", "table", "day", "time_ms", key_of().alias("key"), _vessel_bit(F.col("mmsi")).alias("bit"))
    made = told.groupBy("file", "run", "table", "day").agg(
        F.count("*").alias("rows"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.min("key").alias("first_key"),
        F.max("key").alias("last_key"), F.bitmap_construct_agg(F.col("bit").cast("long")).alias("vessels"),
    )
    made.coalesce(1).write.parquet(f"{path}/_log/entries-{run}")
    return f"entries-{run}"


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm, at, files = _paths(spark, path)
    return files.exists(at) and any(s.isDirectory() for s in files.listStatus(at))


def new_run() -> str:
    """Runs are in the order of their names."""
    return f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:8]}"


def add_run(rows: DataFrame, path: str, spread: int = SPREAD) -> None:
    """Store ``rows`` (``STORED`` without run) in one commit; where another writer came first, on top of its."""
    spark = rows.sparkSession
    made = _write(rows, path, new_run(), F.lit(spread))
    while made is not None:
        now = committed(spark, path)
        try:
            commit(spark, path, _shortened(spark, path, replace(now, version=now.version + 1, entries=(*now.entries, made))))
            return
        except Taken:
            continue


def _shortened(spark: SparkSession, path: str, at: Commit) -> Commit:
    """Many lists of entries are written as one."""
    if len(at.entries) + len(at.removed) <= MOST_LISTS:
        return at
    name = f"entries-all-{uuid.uuid4().hex}"
    entries(spark, path, at).write.parquet(f"{path}/_log/{name}")
    return Commit(at.version, (name,))


def _between(t0_ms: int | None, t1_ms: int | None) -> Column:
    """Files that may hold a time of the closed interval."""
    fits = F.lit(True)
    if t0_ms is not None:
        fits &= (F.col("last_ms") >= t0_ms) & (F.col("day") >= t0_ms // DAY_MS)
    if t1_ms is not None:
        fits &= (F.col("first_ms") <= t1_ms) & (F.col("day") <= t1_ms // DAY_MS)
    return fits


def files_for(spark: SparkSession, path: str, table: str, t0_ms: int | None = None, t1_ms: int | None = None, vessels: list[int] | None = None, keys: tuple[int, int] | None = None) -> DataFrame:
    """Entries of the files that may hold what is asked: times of a closed interval, vessels, keys from one to another."""
    found = entries(spark, path).where((F.col("table") == table) & _between(t0_ms, t1_ms))
    if keys is not None:
        found = found.where((F.col("last_key") >= keys[0]) & (F.col("first_key") <= keys[1]))
    if vessels is not None:
        asked = spark.range(1).select(F.explode(F.array(*[F.lit(int(m)) for m in set(vessels)])).alias("mmsi")).select(_vessel_bit(F.col("mmsi")).alias("bit")).distinct()
        byte = F.conv(F.hex(F.substring(F.col("vessels"), F.call_function("div", F.col("bit"), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.getbit(byte, F.col("bit") % 8) == 1
        found = found.join(asked, held, "left_semi")
    return found


def read_table(spark: SparkSession, path: str, table: str, t0_ms: int | None = None, t1_ms: int | None = None, vessels: list[int] | None = None, keys: tuple[int, int] | None = None) -> DataFrame:
    """One stored table, each packet once; of the files that may hold what is asked (a caller still filters rows).

    Only days that several runs have written are compared by primary key. The driver gets the names of the files, which the
    question bounds.
    """
    live = files_for(spark, path, table, t0_ms, t1_ms, vessels, keys).select("file", "run", "day").collect()
    runs: dict[int, set[str]] = {}
    for e in live:
        runs.setdefault(e["day"], set()).add(e["run"])

    def of(files: list[str]) -> DataFrame:
        if not files:
            return spark.createDataFrame([], STORED)
        return spark.read.option("basePath", f"{path}/data").schema(STORED).parquet(*[f"{path}/data/{f}" for f in files])

    lone, shared = ([e["file"] for e in live if (len(runs[e["day"]]) > 1) == several] for several in (False, True))
    parts = ([of(lone)] if lone or not shared else []) + ([latest_only(of(shared))] if shared else [])
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.drop("run", "table")


def time_ranges(spark: SparkSession, path: str, table: str, t0_ms: int, t1_ms: int, rows_a_range: int = 500_000) -> list[int]:
    """Times that cut an interval into ranges of about so many rows each, as the entries have them; no more than shuffle partitions."""
    found = files_for(spark, path, table, t0_ms, t1_ms).select("first_ms", "last_ms", "rows")
    n = found.agg(F.sum("rows")).first()[0] or 0
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_a_range))
    # Each file's rows are taken to be spread evenly over its time: a tenth of them at each tenth of it.
    steps = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    at = (F.col("first_ms") + (F.col("last_ms") - F.col("first_ms")) * (F.col("k") + 1) / 10).cast("long")
    steps = steps.select(at.alias("at"), F.col("rows").alias("w"))
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    cuts = steps.where((F.col("at") > t0_ms) & (F.col("at") < t1_ms)).agg(F.percentile("at", F.array(*map(F.lit, shares)), F.col("w"))).first()[0]
    return sorted({int(x) for x in cuts or []})


def in_time_order(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Rows in the order of time and digest: dealt to the range they belong to, which is known beforehand, and sorted there."""
    number = F.lit(0)
    for x in cuts:
        number = number + (F.col("time_ms") >= x).cast("int")
    return rows.repartitionById(len(cuts) + 1, number).sortWithinPartitions("time_ms", "digest")


def compact(spark: SparkSession, path: str, most_files: int = SPREAD, days: tuple[int, int] | None = None, rows_a_file: int = ROWS_A_FILE) -> int:
    """Rewrite the days of tables that have more than ``most_files`` files or several runs, each packet once; how many files went.

    The new run and the removal of the old ones are one commit, and queries that began before still find the old files; they are deleted by
    ``vacuum``. A day that another writer has added to meanwhile keeps that.
    """
    at = committed(spark, path)
    live = entries(spark, path, at)
    if days is not None:
        live = live.where(F.col("day").between(*days))
    state = live.groupBy("table", "day").agg(F.count("*").alias("files"), F.count_distinct("run").alias("runs"), F.sum("rows").alias("n"))
    state = state.where((F.col("files") > most_files) | (F.col("runs") > 1)).select("table", "day", F.ceil(F.col("n") / rows_a_file).cast("int").alias("_spread"))
    old = live.join(state, ["table", "day"]).select("file").collect()
    if not old:
        return 0
    rows = spark.read.option("basePath", f"{path}/data").schema(STORED).parquet(*[f"{path}/data/{r['file']}" for r in old])
    run = new_run()
    made = _write(rows.join(state, ["table", "day"]), path, run, F.col("_spread"))
    gone = f"removed-{run}"
    spark.createDataFrame([(r["file"],) for r in old], "file string").coalesce(1).write.parquet(f"{path}/_log/{gone}")
    while True:
        now = committed(spark, path)
        lists = (*now.entries, *([made] if made else []))
        try:
            commit(spark, path, _shortened(spark, path, Commit(now.version + 1, lists, (*now.removed, gone))))
            return len(old)
        except Taken:
            continue


def vacuum(spark: SparkSession, path: str, older_ms: int) -> int:
    """Delete data files that no entry names and that were written before ``older_ms``: of compacted days and of writes that failed; how many went.

    Commits before the latest one go too, and lists that it doesn't name, if they are as old.
    """
    at = committed(spark, path)
    named = {*at.entries, *at.removed}
    for folder, stays in ((f"{path}/_log/commits", lambda name: name == f"{at.version:012d}.json"), (f"{path}/_log", lambda name: name in named or name == "commits")):
        _, where, files = _paths(spark, folder)
        for s in files.listStatus(where) if files.exists(where) else []:
            if s.getModificationTime() < older_ms and not stays(s.getPath().getName()):
                files.delete(s.getPath(), True)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    every = every.where(F.unix_millis("modificationTime") < older_ms).select("path", F.substring_index("path", "/data/", -1).alias("file"))
    n = 0
    for r in every.join(entries(spark, path), "file", "left_anti").select("path").toLocalIterator():
        _, at, files = _paths(spark, r["path"])
        n += bool(files.delete(at, False))
    return n



#: What a vessel keeps saying until it says something else, in the columns of its packets.
KEPT = ("imo", "name", "callsign", "shiptype", "navstat", "sog", "cog", "hdg")
TARGETS = T.StructType([f for f in PLACED if f.name in {"mmsi", "time_ms", "digest", "lat", "lon", *KEPT}])


def _snapshots(spark: SparkSession, path: str) -> dict[int, tuple[str, str]]:
    """Snapshots of vessels by day, each the latest taken: the run that was the last one then, and its folder."""
    jvm, at, files = _paths(spark, f"{path}/targets")
    found: dict[int, tuple[str, str]] = {}
    if files.exists(at):
        for s in files.listStatus(at):
            name = s.getPath().getName()
            if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                day, _, run = name.partition("-")
                found[int(day)] = max(found.get(int(day), ("", "")), (run, f"{path}/targets/{name}"))
    return found


def _last_runs(spark: SparkSession, path: str) -> dict[int, str]:
    """For each day with packets, the latest run among it and all days before."""
    rows = entries(spark, path).where("table = 'packets_time' AND day IS NOT NULL").groupBy("day").agg(F.max("run").alias("run")).collect()
    out, latest = {}, ""
    for r in sorted(rows, key=lambda r: r["day"]):
        out[r["day"]] = latest = max(latest, r["run"])
    return out


def _base(runs: dict[int, str], taken: dict[int, tuple[str, str]], before: int) -> tuple[int, str] | None:
    """The latest snapshot of a day before ``before`` that no run has added to since."""
    for day in sorted((d for d in taken if d < before), reverse=True):
        if max((r for d, r in runs.items() if d <= day), default="") <= taken[day][0]:
            return day, taken[day][1]
    return None


def targets_before(spark: SparkSession, path: str, t0_ms: int, t1_ms: int) -> DataFrame:
    """``TARGETS`` rows of vessels that say what was known of each up to every time of the closed interval: the latest snapshot before its first
    day, as a row a vessel at the end of that day, and the packets since. Without a snapshot, all packets up to then."""
    names = [f.name for f in TARGETS]
    base = _base(_last_runs(spark, path), _snapshots(spark, path), t0_ms // DAY_MS)
    since = None if base is None else (base[0] + 1) * DAY_MS
    rows = read_table(spark, path, "packets_time", since, t1_ms).where((F.col("time_ms") <= t1_ms) & (F.col("mmsi") != -1))
    if since is None:
        return rows.select(*names)
    held = spark.read.schema(TARGETS).parquet(base[1])
    return rows.where(F.col("time_ms") >= since).select(*names).unionByName(held)


def take_snapshot(spark: SparkSession, path: str, day: int) -> None:
    """Store what is known of each vessel at the end of a day: a row each, from the snapshot before and the packets since."""
    end = (day + 1) * DAY_MS - 1
    latest = max(_last_runs(spark, path).values(), default="")
    rows, order = targets_before(spark, path, day * DAY_MS, end), F.struct("time_ms", "digest")
    placed = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in KEPT]
    at = F.max_by(F.struct("lat", "lon"), F.when(placed, order)).alias("at")
    found = rows.groupBy("mmsi").agg(*last, at).withColumns({"time_ms": F.lit(end).cast("long"), "digest": F.lit(""), "lat": F.col("at.lat"), "lon": F.col("at.lon")})
    found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TARGETS]).write.parquet(f"{path}/targets/{day}-{latest}")


def take_snapshots(spark: SparkSession, path: str, every: int = 10) -> list[int]:
    """Snapshots of every so many days before the last one, where there is none that still holds; the days taken, in order."""
    runs = _last_runs(spark, path)
    if not runs:
        return []
    made = []
    for day in range(min(runs) // every * every, max(runs), every):
        base = _base(runs, _snapshots(spark, path), day + 1)
        if day >= min(runs) and (base is None or base[0] < day):
            take_snapshot(spark, path, day)
            made.append(day)
    return made
