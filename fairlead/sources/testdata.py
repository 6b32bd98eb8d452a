"""The ``events`` table read as ship-position packets: kinds of events stand for types of AIS messages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.exprs import digest, time_ms
from fairlead.sources.nmea import SIX_BIT

# Fixed values of this stand-in: AIS type by kind of event; the first three have positions, a sign-up static data.
TYPES = {"view": 1, "click": 3, "purchase": 18, "signup": 5}
OTHER = 8


def packets_of(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")], F.lit(OTHER))
    has, static = F.col("event_type").isin("view", "click", "purchase"), F.col("event_type") == "signup"
    return events.select(
        "event_id", F.col("user_id").cast("int").alias("mmsi"), kind.alias("msgtype"), time_ms("ts").alias("time_ms"),
        F.when(has, ((n * 7919) % 18000).cast("double") / 100.0 - 90.0).alias("lat"),
        F.when(has, ((n * 104729) % 36000).cast("double") / 100.0 - 180.0).alias("lon"),
        F.when(has, (n % 400).cast("int")).alias("sog"), F.when(has, (n % 3600).cast("int")).alias("cog"), F.when(has, (n % 360).cast("int")).alias("hdg"),
        F.when(has, (n % 2).cast("int")).alias("acc"), F.when(has, (n % 16).cast("int")).alias("navstat"),
        F.when(static, (9_000_000 + n % 1_000_000).cast("int")).alias("imo"), F.when(static, F.concat(F.lit("SHIP "), (n % 50).cast("string"))).alias("name"),
        F.when(static, F.concat(F.lit("CS"), (n % 70).cast("string"))).alias("callsign"), F.when(static, (30 + n % 10).cast("int")).alias("shiptype"),
        F.concat(F.lit("src"), (n % 3).cast("string")).alias("source_id"), F.when(n % 4 == 0, F.lit("SAT")).otherwise(F.lit("LIVE")).alias("source_type"),
        (n % 25).cast("string").alias("source_country"), F.when(n % 9 == 0, F.lit(" ")).otherwise((n % 8 + 800).cast("string")).alias("region"),
        F.when(n % 7 != 0, (2_190_000 + n % 10).cast("string")).alias("base_station"),
        F.concat(n.cast("string"), F.lit("|"), F.col("props")).alias("aisdata"), F.col("value"),
    ).withColumn("digest", digest("aisdata"))


def packets(spark: SparkSession, sf_dir: str, t0_ms: int | None = None, t1_ms: int | None = None) -> DataFrame:
    """All packets, or those from ``t0_ms`` to ``t1_ms``; the bounds are on the stored column too, so that they reach the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda ms: F.expr(f"timestampadd(MILLISECOND, {ms}L, timestamp_ntz'1970-01-01 00:00:00')")
    if t0_ms is not None:
        events = events.where(F.col("ts") >= at(t0_ms))
    if t1_ms is not None:
        events = events.where(F.col("ts") < at(t1_ms + 1))
    return packets_of(events)


#: Fields of each kind's payload, in their order: column (none: zeros) and bits; of a text, its characters of six bits.
_HEAD = [("msgtype", 6), (None, 2), ("mmsi", 30)]
_PLACE = [("acc", 1), ("lon", 28), ("lat", 27), ("cog", 12), ("hdg", 9)]
_REPORT = [*_HEAD, ("navstat", 4), (None, 8), ("sog", 10), *_PLACE, (None, 31)]
_LAYOUTS = {
    1: _REPORT, 3: _REPORT, 18: [*_HEAD, (None, 8), ("sog", 10), *_PLACE, (None, 35)], None: [*_HEAD, (None, 16)],
    5: [*_HEAD, (None, 2), ("imo", 30), ("callsign", 42), ("name", 120), ("shiptype", 8), (None, 184)],
}
_TEXTS = ("callsign", "name")
_ARMOUR = np.array([k + 48 if k < 40 else k + 56 for k in range(64)], dtype=np.uint8)
_SIX = np.zeros(256, dtype=np.int64)
_SIX[np.frombuffer(SIX_BIT.encode(), dtype=np.uint8)] = np.arange(64)


def _field_bits(values: pd.Series, width: int, text: bool) -> np.ndarray:
    """A row of so many 0 and 1 for each value: a whole number, a negative one in two's complement, or a text of six-bit characters."""
    if text:
        raw = b"".join(x[: width // 6].ljust(width // 6, "@").encode("latin-1", "replace") for x in values)
        codes = _SIX[np.frombuffer(raw, dtype=np.uint8)].reshape(len(values), -1)
        return (codes[:, :, None] >> np.arange(5, -1, -1) & 1).reshape(len(values), -1)
    return values.to_numpy(np.int64)[:, None] >> np.arange(width - 1, -1, -1) & 1


def _payloads(told: pd.DataFrame) -> pd.Series:
    """The payload of each row by its kind; null where a field that it has is null."""
    out = pd.Series([None] * len(told), index=told.index, dtype=object)
    kinds = told["msgtype"].where(told["msgtype"].isin([k for k in _LAYOUTS if k is not None]), -1)
    for kind in kinds.unique():
        layout = _LAYOUTS[None if kind == -1 else int(kind)]
        rows = told[kinds == kind]
        rows = rows.dropna(subset=[c for c, _ in layout if c is not None])
        if not (n := len(rows)):
            continue
        bits = np.concatenate([np.zeros((n, w), np.int64) if c is None else _field_bits(rows[c], w, c in _TEXTS) for c, w in layout], axis=1)
        letters = bits[:, : bits.shape[1] // 6 * 6].reshape(n, -1, 6) @ (1 << np.arange(5, -1, -1))
        size = letters.shape[1]
        whole = _ARMOUR[letters].tobytes().decode()
        out.loc[rows.index] = [whole[i : i + size] for i in range(0, len(whole), size)]
    return out


def as_text(events: DataFrame) -> DataFrame:
    """``(path, text, src_id)``: each event as the packet text that says it, to be read back; ``path`` is its id.

    Static reports come in two sentences. Types without a position say their vessel alone.
    """
    p = packets_of(events)
    c, kind = F.col, F.col("msgtype")
    of = F.pandas_udf(_payloads, "string")
    said = {f: c(f).alias(f) for f in dict.fromkeys(f for layout in _LAYOUTS.values() for f, _ in layout if f is not None)}
    said |= {f: F.round(c(f) * 600_000).cast("long").alias(f) for f in ("lon", "lat")}
    payload = of(F.struct(*said.values()))
    ts = F.timestamp_millis(c("time_ms"))
    none = lambda x: F.coalesce(x, F.lit(""))
    tag = F.concat(F.lit("$PGHP,1,"), F.date_format(ts, "y,M,d,H,m,s,"), (c("time_ms") % 1000).cast("string"), F.lit(","), F.concat_ws(",", "source_country", none(c("region")), none(c("base_station"))), F.lit(",,2D*5B\n"))
    one = F.concat(tag, F.lit("!BSVDM,1,1,,A,"), c("payload"), F.lit(",0*00"))
    two = F.concat(tag, F.lit("!BSVDM,2,1,3,A,"), F.substring("payload", 1, 58), F.lit(",0*00\n!BSVDM,2,2,3,A,"), F.substring(c("payload"), F.lit(59), F.lit(999)), F.lit(",2*00"))
    rows = p.withColumn("payload", payload)
    return rows.select(c("event_id").cast("string").alias("path"), F.when(kind == 5, two).otherwise(one).alias("text"), c("source_id").alias("src_id"))
