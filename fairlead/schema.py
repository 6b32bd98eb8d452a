"""Tables of the packet archive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TEN_MINUTES_MS, THIRTY_DAYS_MS = 600_000, 30 * 86_400_000
#: How long a position stands for later packets of the same vessel.
CARRY_MS = 20 * 60_000
#: Message types that report a vessel's position.
POSITION_TYPES = (1, 2, 3, 18, 19, 27)

#: One packet: what its message says (null where it doesn't), and what the tag in front of it says about its source.
PACKET = T.StructType([
    T.StructField(name, kind) for kind, names in (
        (T.LongType(), ("time_ms",)), (T.StringType(), ("digest", "aisdata")), (T.IntegerType(), ("mmsi", "msgtype")), (T.DoubleType(), ("lat", "lon")),
        (T.IntegerType(), ("sog", "cog", "hdg", "acc", "navstat", "imo")), (T.StringType(), ("name", "callsign")), (T.IntegerType(), ("shiptype",)),
        (T.StringType(), ("source_id", "source_type", "source_country", "region", "base_station")),
    ) for name in names
])
#: What routing adds: the position that stands for a packet, and the keys of its place in a table.
PLACED = T.StructType([*PACKET, T.StructField("carried_lat", T.DoubleType()), T.StructField("carried_lon", T.DoubleType()), T.StructField("cellid", T.IntegerType()), T.StructField("timeblock", T.IntegerType())])


@dataclass(frozen=True)
class Table:
    """One access path: its key column, block width and sort order inside a file."""

    name: str
    key: str | None
    block_ms: int

    @property
    def primary_key(self) -> list[str]:
        return [*([self.key] if self.key else []), "timeblock", "time_ms", "digest"]


TABLES = {t.name: t for t in (
    Table("packets_time", None, TEN_MINUTES_MS), Table("packets_mmsi", "mmsi", THIRTY_DAYS_MS), Table("packets_area_cell1", "cellid", TEN_MINUTES_MS),
    Table("packets_area_cell10", "cellid", TEN_MINUTES_MS), Table("packets_area_unknown", "mmsi", THIRTY_DAYS_MS),
)}


def create_table_sql(location: str, runs: str = "packet_runs") -> list[str]:
    """DDL for a catalog: a table of all runs of an archive, and a view for each of its tables in which a packet stands once."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PLACED)
    made = [f"CREATE TABLE IF NOT EXISTS {runs} ({columns}, run STRING, `table` STRING, day INT) USING parquet PARTITIONED BY (run, `table`, day) LOCATION '{location}/data'"]
    for t in TABLES.values():
        key = ", ".join(["day", *t.primary_key])
        names = ", ".join([*(f.name for f in PLACED), "day"])
        once = f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY run DESC) AS place FROM {runs} WHERE `table` = '{t.name}'"
        made.append(f"CREATE OR REPLACE VIEW {t.name} AS SELECT {names} FROM ({once}) WHERE place = 1")
    return made
