"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

import itertools
import logging
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlead.functions.exprs import valid_position
from fairlead.operators.routing import write_tables
from fairlead.operators.track import carry_forward
from fairlead.schema import CARRY_MS
from fairlead.sources import nmea

log = logging.getLogger(__name__)


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A directory of event files as a stream; ``files_per_batch`` is the rate limit."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


HOUR_MS = 3_600_000


def _hours(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folders of kept positions by hour."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("hour=")]
    return {int(n.removeprefix("hour=")): f"{folder}/{n}" for n in names}


def _forget(spark: SparkSession, hours: dict[int, str], keep_ms: int) -> None:
    """Delete positions of hours that lie ``keep_ms`` and more behind the latest one."""
    for hour, folder in hours.items():
        if (max(hours) - hour - 1) * HOUR_MS >= keep_ms:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


Batch = Callable[[DataFrame, int], None]


def carrier(checkpoint: str, store: Batch, within_ms: int = CARRY_MS, tie: str = "digest", keep_ms: int = 24 * HOUR_MS) -> Batch:
    """What carries positions forward over all micro-batches and gives each, with ``carried_lat`` and ``carried_lon``, to ``store``.

    A batch leaves its own positions beside the checkpoint, by hour of their time, and reads those of the hours that its
    packets may look back to. So what is written follows the batch and not the fleet, and results are those of the batch window however packets
    are cut into batches, also for packets up to ``keep_ms`` late: older hours are deleted, and with them vessels that fell silent.
    Later packets are carried and stored like any other, but see the positions of their own batch alone; there is no watermark that drops them. A batch that
    is run again replaces what it had left and doesn't see it. Positions from the future (an hour past the clock) are not kept.
    """

    def carry(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("mmsi", F.coalesce(F.col("mmsi"), F.lit(-1))).persist()
        try:
            spark, folder = batch.sparkSession, f"{checkpoint}/positions"
            hour = F.floor(F.col("time_ms") / HOUR_MS).cast("int")
            columns = ["mmsi", "time_ms", tie, "lat", "lon"]
            own = rows.where(valid_position() & (F.col("mmsi") != -1) & (F.col("time_ms") <= F.unix_millis(F.current_timestamp()) + HOUR_MS)).select(*columns)
            kept, back = _hours(spark, folder), -(-within_ms // HOUR_MS)
            near = [h + k for h in kept for k in range(back + 1)]
            asked = {r["hour"] for r in rows.select(hour.alias("hour")).where(F.col("hour").isin(near)).distinct().collect()} if kept else set()
            paths = [path for h, path in kept.items() if any(h + k in asked for k in range(back + 1))]
            held = own.limit(0)
            if paths:
                schema = own.withColumns({"hour": F.lit(0), "batch": F.lit(0).cast("long")}).schema
                held = spark.read.option("basePath", folder).schema(schema).parquet(*paths).where(F.col("batch") < number).select(*columns)
            both = rows.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)), allowMissingColumns=True)
            store(carry_forward(both, within_ms, tie).where("not held").drop("held"), number)
            latest = max([*kept, own.agg(F.max(hour)).first()[0]], key=lambda h: -1 if h is None else h)
            # Hours that would be forgotten at once are not written.
            recent = own if latest is None else own.where(hour > latest - 1 - keep_ms / HOUR_MS)
            left = recent.withColumns({"hour": hour, "batch": F.lit(number).cast("long")}).repartition("hour")
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(folder)
            _forget(spark, _hours(spark, folder), keep_ms)
        finally:
            rows.unpersist()

    return carry


def started(rows: DataFrame, checkpoint: str, run: Batch, **trigger) -> StreamingQuery:
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def carry_positions(packets: DataFrame, checkpoint: str, store: Batch, within_ms: int = CARRY_MS, tie: str = "digest", keep_ms: int = 24 * HOUR_MS, **trigger) -> StreamingQuery:
    """``carrier`` on a stream of packets."""
    return started(packets, checkpoint, carrier(checkpoint, store, within_ms, tie, keep_ms), **trigger)


def without_replays(packets: DataFrame, late: str = "1 hour") -> DataFrame:
    """A packet that arrives again within ``late`` is taken once; none is dropped for its age, since the clock of arrival counts."""
    rows = packets.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", late)
    return rows.dropDuplicatesWithinWatermark(["time_ms", "digest"]).drop("arrived")


def storer(
    path: str, mode: str = "online", cell10: bool = False, handlers: tuple[Batch, ...] = (),
    on_failure: Callable[[DataFrame, int, Exception], None] | None = None, spread: int = 1,
) -> Batch:
    """What writes each micro-batch, with positions carried to it, to all tables in one job.

    ``handlers`` see the batch first, in their order. A batch that fails is logged with its cause and given to ``on_failure``
    (which by default keeps it under ``path/_dead_letter`` by hour and number), and the stream goes on; if that fails too,
    the stream stops, so that no packet is lost without a word. A batch that is written again after a failure replaces itself.
    ``spread``: files of a table and day in a batch; ``archive.compact`` makes one of many batches.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for handle in handlers:
                handle(batch, number)
            write_tables(batch, path, mode, cell10, carry=False, spread=spread)
        except Exception as e:  # the batch is kept for replay
            log.exception("batch %d was not stored", number)
            (on_failure or (lambda rows, n, _: keep_failed(rows, path, n)))(batch, number, e)
        finally:
            batch.unpersist()

    return store


def archive(packets: DataFrame, path: str, checkpoint: str, tie: str = "digest", how: dict | None = None, **trigger) -> StreamingQuery:
    """Packets of a stream into the tables, with positions carried over batches; ``how``: see ``storer``."""
    return started(packets, checkpoint, carrier(checkpoint, storer(path, **(how or {})), tie=tie), **trigger)


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of live sources as a receiver has logged them: text files in a folder for each source, a stream that can be replayed.

    A file counts from when it is there; its name orders it behind earlier ones of its source.
    """
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    path = F.col("_metadata.file_path")
    return lines.select(F.element_at(F.split(path, "/"), -2).alias("source"), path.alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


OPEN = "source string, path string, start long, text string, since long"


def cut_batch(batch: DataFrame) -> DataFrame:
    """``(source, path, start, text, open)``: lines of ``read_log`` told apart, each split of a file by itself."""
    names = F.concat_ws("\n", "source", "path")
    parts = batch.select(names.alias("path"), "start", "value").mapInArrow(lambda b: nmea.cut_splits(b, alone=False), "path string, start long, text string, open boolean")
    return parts.withColumns({"source": F.split_part("path", F.lit("\n"), F.lit(1)), "path": F.split_part("path", F.lit("\n"), F.lit(2))})


def assembled(parts: DataFrame, held: DataFrame, now_ms: int, limit_ms: int) -> DataFrame:
    """``(source, text, open, since)``: whole messages of ``cut_batch`` and, ``open``, what has yet to be completed.

    ``held`` is what the batch before left open (``OPEN``). What a split begins or ends with is put together by
    source, in the order of files, with what was held. A message that lacks a sentence for ``limit_ms`` is told as it is.
    """
    sound = parts.where("not open").select("source", "text", "open", F.lit(None).cast("long").alias("since"))

    def stitch(rows: pa.Table) -> pa.Table:
        source = rows.column("source")[0].as_py()
        ages, cut = {}, nmea.Cut(whole=True)
        for r in sorted(rows.to_pylist(), key=lambda r: (r["path"], r["start"])):
            lines = r["text"].split("\n")
            ages |= {line: r["since"] for line in lines if r["since"] is not None}
            for line in lines:
                cut.add(line)
        told, left = ["\n".join(cut.sound), *cut.apart], []
        for lines in [*(unit for _, unit in cut.waiting.values()), *([[cut.tag]] if cut.tag is not None else [])]:
            since = min((ages[x] for x in lines if x in ages), default=now_ms)
            if now_ms - since < limit_ms:
                left.append(("\n".join(lines), since))
            else:
                told.append("\n".join(lines))
        out = [(source, t, False, None) for t in told if t] + [(source, t, True, since) for t, since in left]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["source", "text", "open", "since"])

    waiting = parts.where("open").select("source", "path", "start", "text", F.lit(None).cast("long").alias("since")).unionByName(held)
    return sound.unionByName(waiting.groupBy("source").applyInArrow(stitch, "source string, text string, open boolean, since long"))


def archive_log(
    spark: SparkSession, folder: str, path: str, checkpoint: str, limit_ms: int = 60_000, files_per_batch: int = 100, how: dict | None = None, **trigger,
) -> StreamingQuery:
    """Logged lines of live sources into the tables: tags with their sentences and messages of several sentences also across files and batches.

    What is open after a batch, some messages a source, is written beside the checkpoint under the batch's number, and the next one
    begins with it. A query that was killed repeats its last batch from there: nothing is lost, and what it had stored replaces itself.
    """
    carry = carrier(checkpoint, storer(path, **(how or {})))

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        held = session.read.schema(OPEN).parquet(f"{checkpoint}/open/{number - 1}") if number else session.createDataFrame([], OPEN)
        now_ms = session.sql("SELECT unix_millis(current_timestamp())").first()[0]
        parts = cut_batch(batch).persist()
        found = assembled(parts, held, now_ms, limit_ms).persist()
        try:
            kept = found.where("open").select("source", F.lit("").alias("path"), F.monotonically_increasing_id().alias("start"), "text", "since")
            kept.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/open/{number}")
            lines = found.where("not open").select(F.lit(None).cast("string").alias("path"), "text", F.col("source").alias("src_id"))
            carry(nmea.packets_of(lines, "LIVE").withColumn("time_ms", F.coalesce("time_ms", F.lit(now_ms))), number)
        finally:
            found.unpersist()
            parts.unpersist()
        if number > 1:
            at = session._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/open/{number - 2}")
            at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)

    return started(read_log(spark, folder, files_per_batch), checkpoint, run, **trigger)


def keep_failed(batch: DataFrame, path: str, number: int) -> None:
    """The batch as Parquet under ``path/_dead_letter``, in a folder for each hour of failure and number of batch."""
    hour = batch.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMddHH')").first()[0]
    batch.write.mode("overwrite").parquet(f"{path}/_dead_letter/hour={hour}/batch={number}")


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Packets of failed batches, to be written again."""
    return spark.read.parquet(f"{path}/_dead_letter").drop("hour", "batch")


def replay_files(
    spark: SparkSession, folder: str, store: Callable[[DataFrame], None], glob: str = "*.zip", most_files: int = 50, most_bytes: int | None = None,
) -> dict[str, int]:
    """Take backup files of a watched folder, by name, up to ``most_files`` and ``most_bytes`` (at least one): ``store`` their packets, then delete
    them; say how many were taken and how many set aside.

    A file that can't be read as a zip archive is renamed to end in ``.unreadable``, and the rest go on. Tasks look into the files; the
    driver renames and deletes, by the store's own file system. Files go only after ``store`` has come back, so that a failure leaves them for the next call.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length").orderBy("path").limit(most_files)
    names, size = [], 0
    for r in found.collect():  # a bounded list
        size += r["length"]
        if names and most_bytes is not None and size > most_bytes:
            break
        names.append(r["path"])
    if not names:
        return {"taken": 0, "unreadable": 0}

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for data in batch.column(1):
                try:
                    with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                        good.append(z.testzip() is None)
                except (zipfile.BadZipFile, EOFError, OSError):
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good)], names=["path", "good"])

    looked = spark.read.format("binaryFile").load(names).select("path", "content").mapInArrow(sound, "path string, good boolean").collect()
    good = [r["path"] for r in looked if r["good"]]
    for r in looked:
        if not r["good"]:
            set_aside(spark, r["path"])
    if good:
        store(nmea.packets_of(nmea.read_lines(spark, good)))
        new = spark._jvm.org.apache.hadoop.fs.Path
        files = new(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in good:
            files.delete(new(name), False)
    return {"taken": len(good), "unreadable": len(looked) - len(good)}


def set_aside(spark: SparkSession, path: str) -> None:
    """Rename a file to end in ``.unreadable``, and a number where an earlier one has that name."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    files = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    free = next(name for k in itertools.count() if not files.exists(new(name := f"{path}.unreadable{k or ''}")))
    log.warning("%s is unreadable and set aside as %s", path, free)
    files.rename(new(path), new(free))


def is_idle(live: StreamingQuery, batch_rows: int) -> bool:
    """Whether less than a batch waits: the stream's last micro-batch had fewer than ``batch_rows``, or it has had none and waits for its first.

    A source with a limit for each batch fills its batches as long as there is a backlog.
    """
    last = live.lastProgress
    return not live.status["isTriggerActive"] if last is None else last["numInputRows"] < batch_rows


def replay_when_idle(
    spark: SparkSession, live: StreamingQuery, folder: str, store: Callable[[DataFrame], None], batch_rows: int = 10_000, glob: str = "*.zip", step_files: int = 8,
    step_bytes: int = 64 << 20, most_files: int = 50, rest_s: float = 60.0, look_s: float = 1.0,
) -> dict[str, int]:
    """As long as ``live`` runs, take backup files of a folder (``replay_files``) whenever its backlog is under a batch (``is_idle``).

    Files are taken in steps of up to ``step_files`` and ``step_bytes``, and the stream is asked again before each, so that it waits for one step at most;
    after ``most_files`` there is a rest of ``rest_s``. When ``store`` fails, the files stay, and after a rest they are taken one by
    one; one that fails by itself is set aside as unreadable. Ends when the stream does, and raises what it failed of; says how many were taken and set aside.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    told, since, step = Counter(taken=0, unreadable=0), 0, step_files
    while not live.awaitTermination(look_s):
        if not is_idle(live, batch_rows):
            continue
        try:
            found = replay_files(spark, folder, store, glob, step, step_bytes)
        except Exception:  # the files are still there
            log.exception("backup files of %s were not stored", folder)
            if step == 1:
                first = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path").orderBy("path").first()
                if first is not None:
                    set_aside(spark, first["path"])
                    told["unreadable"] += 1
            step, since = 1, most_files
        else:
            told.update(found)
            since += found["taken"]
            step = step_files if not found["taken"] else step
        if since >= most_files:
            since = 0
            if live.awaitTermination(rest_s):
                break
    return dict(told)


def live_packets(spark: SparkSession, sources: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Packets of live sources; one that says no time has the time of its arrival.

    Each line is read for itself, and a socket can't be read again: of a message of several sentences no vessel is known. For more than trying
    out, let a receiver log the lines (``read_log``, ``archive_log``).
    """
    lines = live_sources(spark, sources).select(F.lit(None).cast("string").alias("path"), F.col("value").alias("text"), "src_id")
    return nmea.packets_of(lines, "LIVE").withColumn("time_ms", F.coalesce("time_ms", F.unix_millis(F.current_timestamp())))


def live_sources(spark: SparkSession, sources: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Lines of TCP sources by group name, as one stream with ``src_id`` (development; a log broker in production)."""
    streams = [spark.readStream.format("socket").option("host", h).option("port", p).load().withColumn("src_id", F.lit(name)) for name, ends in sources.items() for h, p in ends]
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def source_group(text: str) -> tuple[str, list[tuple[str, int]]]:
    """``name=host:port,host:port``."""
    name, _, rest = text.partition("=")
    ends = [e.rpartition(":") for e in rest.split(",") if e]
    if not name or not ends or any(not h or not p.isdigit() for h, _, p in ends):
        raise ValueError(f"not a source group: {text!r}")
    return name, [(h, int(p)) for h, _, p in ends]
