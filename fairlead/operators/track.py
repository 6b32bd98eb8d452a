"""Order-dependent operators on vessel tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions.exprs import EARTH_M, blank, tenths, valid_position
from fairlead.schema import CARRY_MS, POSITION_TYPES


def vessel() -> list[Column]:
    """What windows over a vessel are dealt by. Packets without a vessel (mmsi null or -1) have no state: they are dealt by their text."""
    nobody = F.col("mmsi").isNull() | (F.col("mmsi") == -1)
    return [F.col("mmsi"), F.when(nobody, F.xxhash64("aisdata"))]


def carry_forward(packets: DataFrame, within_ms: int = CARRY_MS, tie: str = "digest") -> DataFrame:
    """``carried_lat``, ``carried_lon``: the packet's own position or the vessel's latest one at most ``within_ms`` older.

    Of equal times the greatest ``tie`` stands.
    """
    window = W.partitionBy(*(vessel() if "aisdata" in packets.columns else ["mmsi"])).orderBy("time_ms").rangeBetween(-within_ms, 0)
    own = F.when(valid_position(), F.struct("time_ms", tie, "lat", "lon"))
    return packets.withColumn("_at", F.max(own).over(window)).withColumns({"carried_lat": F.col("_at.lat"), "carried_lon": F.col("_at.lon")}).drop("_at")


#: Columns that a packet's message has and its vessel keeps until it sends others, by the name they have for the vessel.
TARGET = {
    "target_imo": "imo", "target_name": "name", "target_callsign": "callsign", "target_type": "shiptype", "target_navstat": "navstat",
    "target_sog": "sog", "target_cog": "cog", "target_hdg": "hdg",
}


def with_targets(packets: DataFrame, tie: str = "digest", history: DataFrame | None = None) -> DataFrame:
    """Each packet with what its vessel had last said up to then: static data, navigation status and position (``target_..``).

    ``history``: more packets (the columns of ``archive.TARGETS``) that vessels are known by, as ``archive.targets_before`` gives them.
    """
    if history is not None:
        both = packets.withColumn("_own", F.lit(True)).unionByName(history.withColumn("_own", F.lit(False)), allowMissingColumns=True)
        return with_targets(both, tie).where("_own").drop("_own")
    window = W.partitionBy(*vessel()).orderBy("time_ms", tie).rowsBetween(W.unboundedPreceding, 0)
    seen = {to: F.last(of, ignorenulls=True).over(window) for to, of in TARGET.items() if of in packets.columns}
    place = F.last(F.when(valid_position(), F.struct("lat", "lon")), ignorenulls=True).over(window)
    return packets.withColumns(seen | {"_at": place}).withColumns({"target_lat": F.col("_at.lat"), "target_lon": F.col("_at.lon")}).drop("_at")


def country_part(mmsi: Column) -> Column:
    """The country digits of an identity: of vessels, coast stations, search-and-rescue aircraft and craft with 98 or 99 in front; else null."""
    part = lambda by: F.call_function("div", mmsi, F.lit(by)) % 1000
    return (
        F.when(mmsi.between(200_000_000, 799_999_999), part(1_000_000))
        .when(mmsi.between(2_000_000, 7_999_999), part(10_000))
        .when(mmsi.between(111_200_000, 111_799_999), part(1_000))
        .when(mmsi.between(982_000_000, 987_999_999) | mmsi.between(992_000_000, 997_999_999), part(10_000))
    ).cast("int")


def with_countries(packets: DataFrame, mids: DataFrame, mid: Column | None = None) -> DataFrame:
    """``country``, ``country2`` of the vessel and ``source_alpha3``, ``source_alpha2`` of the source, from a table ``mids(mid int, alpha3, alpha2)``.

    The table has one row for each number that countries have, some hundreds; the planner decides how to join it.
    ``mid`` says otherwise where a packet's number comes from. Unknown numbers give null.
    """
    own = packets.withColumn("_mid", country_part(F.col("mmsi")) if mid is None else mid)
    of = lambda number, a3, a2: mids.select(F.col("mid").cast("int").alias(number), F.col("alpha3").alias(a3), F.col("alpha2").alias(a2))
    found = own.join(of("_mid", "country", "country2"), "_mid", "left").drop("_mid")
    if "source_country" not in packets.columns:
        return found
    source = found.withColumn("_mid", F.col("source_country").try_cast("int"))
    return source.join(of("_mid", "source_alpha3", "source_alpha2"), "_mid", "left").drop("_mid")


def last_positions(packets: DataFrame, tie: str = "digest") -> DataFrame:
    """Latest valid position of each vessel; of equal times the greatest ``tie``."""
    return packets.where(valid_position()).groupBy("mmsi").agg(F.max(F.struct("time_ms", tie, "lat", "lon")).alias("p")).select("mmsi", "p.time_ms", "p.lat", "p.lon")


def past_track(packets: DataFrame, mmsi: int, t0_ms: int, t1_ms: int, source_filter: Column | None = None) -> DataFrame:
    """Position reports of one vessel inside the open interval, in time order."""
    rows = packets.where((F.col("mmsi") == mmsi) & (F.col("time_ms") > t0_ms) & (F.col("time_ms") < t1_ms) & F.col("msgtype").isin(*POSITION_TYPES))
    return (rows if source_filter is None else rows.where(source_filter)).orderBy("time_ms", "digest")


def track_json(rows: DataFrame, *names: str) -> DataFrame:
    """``json`` (behind columns named): an object a report, in their order. With a source tag (a time of its own) clock, station, region and, where known, country come first;
    speeds and courses come in tenths; absent values of a report stay as null."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    report = F.struct(F.col("lat"), F.col("lon"), has("acc").cast("int").alias("acc"), has("hdg").cast("int").alias("hdg"), tenths(has("sog")).alias("sog"), tenths(has("cog")).alias("cog"))
    source = [F.col("time_ms").alias("src.clk"), has("base_station").cast("int").alias("src.id"), has("region").alias("src.reg")]
    nulls = {"ignoreNullFields": "false"}
    body = F.substring(F.to_json(report, nulls), F.lit(2), F.lit(1 << 30))
    opened = lambda *more: F.regexp_replace(F.to_json(F.struct(*source, *more), nulls), r"\}$", ",")
    country = has("source_alpha2")
    tag = F.when(country.isNull(), opened()).otherwise(opened(country.alias("src.cty")))
    return rows.select(*names, F.concat(F.when(F.col("time_ms").isNull(), F.lit("{")).otherwise(tag), body).alias("json"))


def source_json(rows: DataFrame, *names: str) -> DataFrame:
    """``json`` (behind columns named): where a packet came from, without what isn't known; a blank region is not known."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    region = F.when(~blank(has("region")), has("region"))
    known = {"country": has("source_alpha2"), "type": has("source_type"), "bs": has("base_station"), "id": has("source_id"), "region": region}
    return rows.select(*names, F.to_json(F.struct(*[column.alias(name) for name, column in known.items()])).alias("json"))


def drop_repeats_within(packets: DataFrame, window_ms: int, payload: str = "payload", tie: str = "digest") -> DataFrame:
    """Drop a packet when the same vessel sent the same payload, kept or not, at most ``window_ms`` before.

    Without such a column the payload is what sentences say, whatever their tags.
    """
    rows = packets if payload in packets.columns else packets.withColumn(payload, F.regexp_replace("aisdata", r"\$PGHP,[^\r\n]*\r?\n", ""))
    before = F.lag("time_ms").over(W.partitionBy("mmsi", payload).orderBy("time_ms", tie))
    kept = rows.withColumn("_gap", F.col("time_ms") - before).where(F.col("_gap").isNull() | (F.col("_gap") > window_ms))
    return kept.select(*packets.columns)


def thin(packets: DataFrame, min_ms: int | None = None, min_m: float | None = None, tie: str = "digest") -> DataFrame:
    """Greedy per vessel from its first row: keep a row when it is far enough from the last one kept, in time and place.

    Rows, whole, are dealt by vessel and sorted, which spills; the fold holds the last row kept and not the vessel.
    Packets without a vessel are each kept.
    """
    rows = packets.where(valid_position()) if min_m is not None else packets
    names = rows.columns
    at = [names.index(c) for c in ("mmsi", "time_ms", "lat", "lon")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thinner = Thinner(min_ms, min_m)
        for batch in batches:
            yield batch.take(pa.array(thinner.take(*(batch.column(k) for k in at))))

    dealt = vessel() if "aisdata" in names else [F.col("mmsi")]
    return rows.repartition(*dealt).sortWithinPartitions("mmsi", "time_ms", tie, "lat", "lon").mapInArrow(fold, rows.schema)


#: Rows behind a kept one that are looked at one by one, and how many at once after them: first, at most.
NEAR, BLOCK, MOST_BLOCK = 6, 64, 8192
#: Stands for a time that isn't known; it sorts first, as null does.
NEVER = -(1 << 62)


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    """``haversine_m`` of two places."""
    half = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(half(a[0], b[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(a[1], b[1]))))


class Thinner:
    """The fold of ``thin`` over batches of sorted rows: it holds the last row kept, and jumps to the next.

    A duration is searched for in the sorted times; distances are computed for blocks of rows that grow as long as none is far
    enough. Blocks only propose rows: ``metres`` decides, so that batches don't change what is kept.
    """

    def __init__(self, min_ms: int | None, min_m: float | None):
        self.min_ms, self.min_m = min_ms, min_m
        self.last: tuple | None = None

    def take(self, mmsi: pa.Array, time_ms: pa.Array, lat: pa.Array, lon: pa.Array) -> np.ndarray:
        """Places of the rows to keep."""
        if not len(mmsi):
            return np.empty(0, np.int64)
        ids = mmsi.fill_null(-1).to_numpy(zero_copy_only=False)
        times = time_ms.fill_null(NEVER).to_numpy(zero_copy_only=False)
        lats, lons = (x.to_numpy(zero_copy_only=False) for x in (lat, lon))
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        kept: list = []
        for low, high in zip(edges, edges[1:]):
            if ids[low] == -1:
                kept += range(low, high)
                continue
            i = low
            if self.last is None or self.last[0] != ids[low]:
                kept.append(low)
                self.last = self._row(ids, times, lats, lons, low)
                i += 1
            while (i := self._next(times, lats, lons, i, high)) < high:
                kept.append(i)
                self.last = self._row(ids, times, lats, lons, i)
                i += 1
        return np.array(kept, np.int64)

    @staticmethod
    def _row(ids, times, lats, lons, i: int) -> tuple:
        return int(ids[i]), int(times[i]), float(lats[i]), float(lons[i])

    def _next(self, times, lats, lons, i: int, high: int) -> int:
        """The first row from ``i`` on to keep, or ``high``."""
        _, when, *place = self.last
        if self.min_ms is not None:
            if when == NEVER:
                return high
            if i < high and times[i] - when < self.min_ms:
                # Unknown times stand in front of a vessel's others, so they never follow a known one.
                i += int(np.searchsorted(times[i:high], when + self.min_ms))
        if self.min_m is None:
            return i
        for k in range(i, min(i + NEAR, high)):
            if metres(place, (float(lats[k]), float(lons[k]))) >= self.min_m:
                return k
        i, size = i + NEAR, BLOCK
        lat0, lon0 = place
        while i < high:
            end = min(i + size, high)
            north = np.radians(lats[i:end])
            across = np.sin(np.radians(lats[i:end] - lat0) / 2) ** 2 + math.cos(math.radians(lat0)) * np.cos(north) * np.sin(np.radians(lons[i:end] - lon0) / 2) ** 2
            far = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(across, 1.0)))
            for k in np.flatnonzero(far >= self.min_m * (1 - 1e-9)).tolist():
                if metres(place, (float(lats[i + k]), float(lons[i + k]))) >= self.min_m:
                    return i + k
            i, size = end, min(2 * size, MOST_BLOCK)
        return high
