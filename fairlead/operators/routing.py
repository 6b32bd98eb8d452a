"""Which tables a packet goes to, and their layout on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.exprs import cell, timeblock, valid_position
from fairlead.operators.track import carry_forward
from fairlead.schema import PLACED, TABLES
from fairlead.sources import archive


def keyed(packets: DataFrame, carry: bool = True) -> DataFrame:
    """Packets with the position that stands for them and ``mmsi`` -1 where no message could be read; carried columns that are there stay."""
    rows = packets.withColumn("mmsi", F.coalesce(F.col("mmsi"), F.lit(-1)))
    if not carry and "carried_lat" in packets.columns:
        return rows
    return carry_forward(rows) if carry else rows.withColumns({"carried_lat": F.col("lat"), "carried_lon": F.col("lon")})


def guards(mode: str = "online", cell10: bool = False) -> dict[str, Column]:
    """Rows of each table. Live ingest asks mmsi > 0, and no time of the mmsi table; bulk load mmsi >= 0 and always a time."""
    ts, placed = F.col("time_ms") > 0, valid_position("carried_lat", "carried_lon")
    if mode == "online":
        own = F.col("mmsi") > 0
        return {"packets_time": ts, "packets_mmsi": own, "packets_area_cell1": ts & own & placed, "packets_area_cell10": ts & own & placed & F.lit(cell10), "packets_area_unknown": ts & own & ~placed}
    if mode == "bulk":
        own = F.col("mmsi") >= 0
        return {"packets_time": ts, "packets_mmsi": ts & own, "packets_area_cell1": ts & placed, "packets_area_cell10": ts & placed, "packets_area_unknown": ts & own & ~placed}
    raise ValueError(f"mode is online or bulk, not {mode!r}")


def _cellid(table: str) -> Column:
    if TABLES[table].key != "cellid":
        return F.lit(None).cast("int")
    return cell("carried_lat", "carried_lon", 10 if table.endswith("10") else 1)


def fan_out(packets: DataFrame, mode: str = "online", cell10: bool = False, carry: bool = True) -> dict[str, DataFrame]:
    """One DataFrame a table, each with its key and time block; one plan over the same packets, no collect."""
    rows, out = keyed(packets, carry), {}
    for name, guard in guards(mode, cell10).items():
        t = TABLES[name]
        own = rows.where(guard).withColumn("timeblock", timeblock("time_ms", t.block_ms))
        out[name] = own.withColumn("cellid", _cellid(name)) if t.key == "cellid" else own
    return out


def routed(packets: DataFrame, mode: str = "online", cell10: bool = False, carry: bool = True) -> DataFrame:
    """Each packet once for every table it goes to, named by ``table``, in one pass over the packets."""
    places = [
        F.when(guard, F.struct(F.lit(name).alias("table"), _cellid(name).alias("cellid"), timeblock("time_ms", TABLES[name].block_ms).alias("timeblock")))
        for name, guard in guards(mode, cell10).items()
    ]
    rows = keyed(packets, carry)
    kept = [c for c in rows.columns if c not in ("table", "cellid", "timeblock")]
    return rows.select(*kept, F.explode(F.array_compact(F.array(*places))).alias("_place")).select(*kept, "_place.*")


def route_labels(packets: DataFrame, mode: str = "online", cell10: bool = False) -> DataFrame:
    """``(table_name, n)``: how many packets each table gets, in one pass."""
    rows = keyed(packets)
    names = F.array(*[F.when(g, F.lit(n)) for n, g in guards(mode, cell10).items()])
    return rows.select(F.explode(F.array_compact(names)).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n"))


def by_primary_key(rows: DataFrame, table: str) -> DataFrame:
    """Repeated writes of a packet come down to one row."""
    return rows.dropDuplicates(TABLES[table].primary_key)


def write_tables(packets: DataFrame, path: str, mode: str = "online", cell10: bool = False, carry: bool = True, spread: int = archive.SPREAD) -> None:
    """All tables as one run of the archive under ``path`` (``sources.archive``): one scan, one shuffle and one commit, so that a
    failure leaves no table ahead of another. Columns that packets lack are stored as null.

    A packet that is written again replaces itself. ``spread``: into how many files a day of a table may go, 1 for small batches.
    """
    rows = routed(packets, mode, cell10, carry)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PLACED]
    archive.add_run(rows.select(*columns, "table", F.floor(F.col("time_ms") / archive.DAY_MS).cast("int").alias("day")), path, spread)
