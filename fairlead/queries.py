"""Queries over the packet tables, with the same in SQL."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import exprs, params
from fairlead.functions.filters import compile_filter, compose
from fairlead.functions.params import instant_ms
from fairlead.operators import reports, routing, track
from fairlead.plans.query import Query, cells_of
from fairlead.schema import CARRY_MS, PACKET, TEN_MINUTES_MS, TABLES
from fairlead.sources import archive, nmea, sinks
from fairlead.sources.testdata import as_text, packets, packets_of
from fairlead.streaming import ingest
from fairlead.streaming.ingest import carry_positions

T0, T1 = instant_ms("2024-01-05T00:00:00Z"), instant_ms("2024-01-15T12:30:00Z")
VESSELS = (3, 7, 11)
BOX = (-30.5, -60.25, 25.75, 40.5)
WIDE = (-80.0, -170.0, 80.0, 170.0)
FILTER = "m.type=1,3 & (m.lat<-10.5|m.lat>10.5)"

P = """WITH p AS (
  SELECT event_id, CAST(user_id AS INTEGER) AS mmsi, epoch_us(ts) // 1000 AS time_ms, value,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 18 WHEN 'signup' THEN 5 ELSE 8 END AS msgtype,
    CASE WHEN has THEN CAST((event_id * 7919) % 18000 AS DOUBLE) / 1e2 - 9e1 END AS lat,
    CASE WHEN has THEN CAST((event_id * 104729) % 36000 AS DOUBLE) / 1e2 - 1.8e2 END AS lon,
    CASE WHEN has THEN CAST(event_id % 400 AS INTEGER) END AS sog, CASE WHEN has THEN CAST(event_id % 3600 AS INTEGER) END AS cog,
    CASE WHEN has THEN CAST(event_id % 360 AS INTEGER) END AS hdg, CASE WHEN has THEN CAST(event_id % 2 AS INTEGER) END AS acc,
    CASE WHEN has THEN CAST(event_id % 16 AS INTEGER) END AS navstat,
    CASE WHEN static THEN CAST(9000000 + event_id % 1000000 AS INTEGER) END AS imo,
    CASE WHEN static THEN 'SHIP ' || CAST(event_id % 50 AS VARCHAR) END AS name,
    CASE WHEN static THEN 'CS' || CAST(event_id % 70 AS VARCHAR) END AS callsign,
    CASE WHEN static THEN CAST(30 + event_id % 10 AS INTEGER) END AS shiptype,
    'src' || CAST(event_id % 3 AS VARCHAR) AS source_id, CASE WHEN event_id % 4 = 0 THEN 'SAT' ELSE 'LIVE' END AS source_type,
    CAST(event_id % 25 AS VARCHAR) AS source_country,
    CASE WHEN event_id % 9 = 0 THEN ' ' ELSE CAST(event_id % 8 + 800 AS VARCHAR) END AS region,
    CASE WHEN event_id % 7 <> 0 THEN CAST(2190000 + event_id % 10 AS VARCHAR) END AS base_station,
    CAST(event_id AS VARCHAR) || '|' || props AS aisdata, md5(CAST(event_id AS VARCHAR) || '|' || props) AS digest
  FROM (SELECT *, event_type IN ('view', 'click', 'purchase') AS has, event_type = 'signup' AS static FROM events)),
c AS (SELECT *, max(CASE WHEN lat IS NOT NULL THEN {'t': time_ms, 'e': event_id, 'lat': lat, 'lon': lon} END)
        OVER (PARTITION BY mmsi ORDER BY time_ms RANGE BETWEEN 1200000 PRECEDING AND CURRENT ROW) AS pos FROM p),
k AS (SELECT *, pos.lat AS clat, pos.lon AS clon FROM c)
"""
INSIDE = f"time_ms > {T0} AND time_ms < {T1}"
CELL = "CAST(floor(clat / {d}) * {n} + floor((clon + 180) / {d}) AS INTEGER)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, sf_dir: str, mode: str = "online", cell10: bool = False) -> dict[str, DataFrame]:
    """Tables for an area scan from T0 to T1: packets of that time and as long before as positions are carried."""
    rows = track.carry_forward(packets(spark, sf_dir, T0 - CARRY_MS, T1), tie="event_id")
    return routing.fan_out(rows, mode, cell10, carry=False)


def time_table(spark: SparkSession, sf_dir: str, *between: int) -> DataFrame:
    """The time table alone, without the positions that only areas need."""
    rows = packets(spark, sf_dir, *between).where("time_ms > 0")
    return rows.withColumn("timeblock", exprs.timeblock("time_ms", TEN_MINUTES_MS))


SHOWN = ["event_id", "time_ms", "aisdata"]


@query(P + f"SELECT event_id, time_ms, aisdata FROM p WHERE {INSIDE}")
def time_range_scan(spark, d):
    return Query.for_time().between(T0, T1).to_df({"packets_time": time_table(spark, d, T0, T1)}).select(*SHOWN)


@query(P + f"SELECT count(*) AS n FROM p WHERE time_ms >= {T0} AND time_ms < {T1}")
def stats_half_open(spark, d):
    return packets(spark, d, T0, T1).where((F.col("time_ms") >= T0) & (F.col("time_ms") < T1)).agg(F.count("*").alias("n"))


@query(P + f""", ch AS (SELECT unnest(range(0, ({(T1 - 1) // 600000} - {T0 // 600000}) // 10 + 1)) AS k),
n AS (SELECT (time_ms // 600000 - {T0 // 600000}) // 10 AS k, count(*) AS n FROM p WHERE time_ms >= {T0} AND time_ms < {T1} GROUP BY 1)
SELECT CAST(ch.k * 10 + {T0 // 600000} AS BIGINT) AS first_block, CAST(least(ch.k * 10 + {T0 // 600000} + 9,
    {(T1 - 1) // 600000}) AS BIGINT) AS last_block, CAST(coalesce(n.n, 0) AS BIGINT) AS n
  FROM ch
  LEFT JOIN n USING (k)""")
def stats_chunked(spark, d):
    return reports.chunk_counts(packets(spark, d, T0, T1), T0, T1, 10)


@query(P + f"SELECT event_id, time_ms, aisdata FROM p WHERE mmsi IN (3, 7, 11) AND {INSIDE}")
def mmsi_scan_multi(spark, d):
    return Query.for_mmsi(*VESSELS).between(T0, T1).to_df(mmsi_table(spark, d)).select(*SHOWN)


def mmsi_table(spark, d):
    rows = packets(spark, d, T0, T1).where("mmsi > 0")
    return {"packets_mmsi": rows.withColumn("timeblock", exprs.timeblock("time_ms", TABLES["packets_mmsi"].block_ms))}


@query(P + f"SELECT event_id, time_ms, aisdata FROM p JOIN (SELECT unnest([3, 3, 7]) AS mmsi) a USING (mmsi) WHERE {INSIDE}")
def mmsi_scan_duplicated_key(spark, d):
    return Query.for_mmsi(3, 3, 7).between(T0, T1).to_df(mmsi_table(spark, d)).select(*SHOWN)


def cell_sql(box, degrees, more=""):
    ids = ", ".join(map(str, cells_of(box, degrees)))
    return P + f"SELECT event_id, time_ms, aisdata FROM k WHERE {INSIDE} AND mmsi > 0 AND clat IS NOT NULL AND {CELL.format(d=degrees, n=360 // degrees)} IN ({ids}){more}"


@query(cell_sql(BOX, 1))
def area_scan_cell1(spark, d):
    return Query.for_area(BOX).between(T0, T1).to_df(tables(spark, d)).select(*SHOWN)


@query(cell_sql(WIDE, 10))
def area_scan_cell10_choice(spark, d):
    return Query.for_area(WIDE, cell10=True).between(T0, T1).to_df(tables(spark, d, cell10=True)).select(*SHOWN)


@query(cell_sql(BOX, 1, f" AND clat BETWEEN {BOX[0]} AND {BOX[2]} AND clon BETWEEN {BOX[1]} AND {BOX[3]}"))
def area_scan_exact(spark, d):
    return Query.for_area(BOX, exact=True).between(T0, T1).to_df(tables(spark, d)).select(*SHOWN)


BROAD, PACIFIC = (-43.5, -95.25, 52.75, 101.5), (-20.0, 170.5, 30.5, -160.25)


@query(cell_sql(BROAD, 1))
def area_scan_mixed(spark, d):
    """The packets of the one-degree cells, by whole ten-degree cells inside and one-degree cells at the edge."""
    return Query.for_area(BROAD, mixed=True).between(T0, T1).to_df(tables(spark, d, cell10=True)).select(*SHOWN)


@query(P + f"""SELECT event_id, time_ms, aisdata FROM k WHERE {INSIDE} AND mmsi > 0 AND clat IS NOT NULL AND clat BETWEEN {PACIFIC[0]} AND {PACIFIC[2]}
    AND (clon >= {PACIFIC[1]} OR clon <= {PACIFIC[3]})""")
def area_scan_date_line(spark, d):
    """A box over the date line."""
    return Query.for_area(PACIFIC, exact=True, wrap=True).between(T0, T1).to_df(tables(spark, d)).select(*SHOWN)


@query(P + "SELECT event_id, CAST(time_ms // 600000 AS INTEGER) AS block10m, CAST(time_ms // 2592000000 AS INTEGER) AS block30d FROM p")
def timeblock_derivation(spark, d):
    block = lambda width, name: exprs.timeblock("time_ms", width).alias(name)
    return packets(spark, d).select("event_id", block(600_000, "block10m"), block(2_592_000_000, "block30d"))


@query(P + f"""SELECT event_id, {CELL.format(d=1, n=360).replace('clat', 'lat').replace('clon', 'lon')} AS cell1, {CELL.format(d=10, n=36).replace('clat',
    'lat').replace('clon', 'lon')} AS cell10, digest
  FROM p""")
def derived_keys(spark, d):
    return packets(spark, d).select("event_id", exprs.cell("lat", "lon").alias("cell1"), exprs.cell("lat", "lon", 10).alias("cell10"), "digest")


@query(P + "SELECT DISTINCT CAST(time_ms // 600000 AS INTEGER) AS timeblock, time_ms, digest FROM p")
def pk_dedup(spark, d):
    rows = time_table(spark, d)
    return routing.by_primary_key(rows.union(rows), "packets_time").select("timeblock", "time_ms", "digest")


def route_sql(mode):
    own, timed, area = ("mmsi > 0", "TRUE", "AND mmsi > 0") if mode == "online" else ("mmsi >= 0", "time_ms > 0", "")
    parts = [
        ("packets_time", "time_ms > 0"), ("packets_mmsi", f"{own} AND {timed}"), ("packets_area_cell1", f"time_ms > 0 AND clat IS NOT NULL {area}"),
        ("packets_area_unknown", f"time_ms > 0 AND {own} AND clat IS NULL"),
    ]
    parts += [("packets_area_cell10", "time_ms > 0 AND clat IS NOT NULL")] if mode == "bulk" else []
    return P + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM k WHERE {w}" for n, w in parts) + ") WHERE n > 0"


@query(route_sql("online"))
def route_online(spark, d):
    return routing.route_labels(packets(spark, d), "online")


@query(route_sql("bulk"))
def route_bulk(spark, d):
    return routing.route_labels(packets(spark, d), "bulk")


@query(P + "SELECT event_id, clat AS carried_lat, clon AS carried_lon FROM k")
def carry_forward_position(spark, d):
    return track.carry_forward(packets(spark, d), tie="event_id").select("event_id", "carried_lat", "carried_lon")


@query(P + """, r AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY time_ms DESC, event_id DESC) AS rn
  FROM p
  WHERE lat IS NOT NULL) SELECT mmsi, time_ms, lat, lon
  FROM r
  WHERE rn = 1""")
def last_position_per_mmsi(spark, d):
    return track.last_positions(packets(spark, d), tie="event_id")


STORED = "event_id % 3 <> 0"


@query(P + "SELECT event_id FROM p f WHERE NOT EXISTS (SELECT 1 FROM p s WHERE s.event_id % 3 <> 0 AND s.time_ms = f.time_ms)")
def diff_missing(spark, d):
    rows = time_table(spark, d)
    return reports.missing_from(rows, rows.where(STORED)).select("event_id")


@query(P + """, h AS (SELECT DISTINCT time_ms
  FROM p
  WHERE event_id % 3 <> 0) SELECT count(*) AS processed, count(h.time_ms) AS in_store, count(*) - count(h.time_ms) AS not_in_store
  FROM p
  LEFT JOIN h USING (time_ms)""")
def diff_counts(spark, d):
    rows = time_table(spark, d)
    return reports.diff_counts(rows, rows.where(STORED))


@query(P + f"""SELECT event_id, time_ms, lat, lon
  FROM p
  WHERE mmsi = 7 AND {INSIDE} AND msgtype IN (1, 2, 3, 18, 19, 27) AND source_type = 'LIVE' AND region IN ('801', '803', '806')""")
def past_track(spark, d):
    source = compile_filter("s.type=LIVE & s.region=801,803,806", only="s")
    return track.past_track(packets(spark, d, T0, T1), 7, T0, T1, source).select("event_id", "time_ms", "lat", "lon")


@query(P + "SELECT event_id, CASE WHEN lat IS NULL THEN '{}' ELSE CAST(to_json({'lat': lat, 'lon': lon}) AS VARCHAR) END AS json FROM p")
def position_json(spark, d):
    return packets(spark, d).select("event_id", F.to_json(F.struct("lat", "lon")).alias("json"))


@query(P + "SELECT event_id FROM p WHERE msgtype IN (1, 3) AND (lat < -10.5 OR lat > 10.5)")
def filter_and_or(spark, d):
    return packets(spark, d).where(compile_filter(FILTER)).select("event_id")


@query(P + "SELECT event_id FROM p WHERE mmsi IN (1, 2, 3) AND msgtype <> 8")
def filter_in_list(spark, d):
    return packets(spark, d).where(compile_filter("m.mmsi in (1,2,3) & m.type!=8")).select("event_id")


@query(P + "SELECT event_id FROM p WHERE upper(name) LIKE 'SHIP 1%' OR upper(callsign) LIKE 'CS_'")
def filter_like(spark, d):
    return packets(spark, d).where(compile_filter("m.name like ship 1* | m.cs like cs?")).select("event_id")


@query("""SELECT event_id, name FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'MADE IN CHINA' WHEN 1 THEN 'LIKE A VIRGIN' WHEN 2 THEN 'A&B (2), LTD'
    WHEN 3 THEN 'O''BRIEN "X" WITHIN' WHEN 4 THEN 'MADE IN HASTE|A=B' ELSE 'SHIP ' || CAST(event_id % 50 AS VARCHAR) END AS name FROM events)
  WHERE name LIKE 'MADE IN %' OR name IN ('LIKE A VIRGIN', 'A&B (2), LTD', 'O''BRIEN "X" WITHIN', 'SHIP 5')""")
def filter_names(spark, d):
    """Names that hold words and signs of the filter language."""
    n = F.col("event_id")
    strange = ["MADE IN CHINA", "LIKE A VIRGIN", "A&B (2), LTD", "O'BRIEN \"X\" WITHIN", "MADE IN HASTE|A=B"]
    name = F.coalesce(F.get(F.array(*map(F.lit, strange)), (n % 6).cast("int")), F.concat(F.lit("SHIP "), (n % 50).cast("string")))
    text = f"m.name like made in * | {compose(m_name=['LIKE A VIRGIN', *strange[2:4]])} | m.name in (ship 5, none)"
    return packets(spark, d).withColumn("name", name).where(compile_filter(text)).select("event_id", "name")


@query(P + "SELECT event_id FROM k WHERE clat BETWEEN -18 AND 15 AND clon BETWEEN -14 AND 10 AND (clat < -0.3 OR clat > 0.3)")
def filter_bbox(spark, d):
    rows = track.carry_forward(packets(spark, d), tie="event_id").withColumns({"target_lat": F.col("carried_lat"), "target_lon": F.col("carried_lon")})
    return rows.where(compile_filter("t.pos within bbox(15,-14,-18,10) & (t.lat<-0.3|t.lat>0.3)")).select("event_id")


@query(P + """, t AS (SELECT *, last_value(shiptype IGNORE NULLS) OVER w AS target_type, last_value(name IGNORE NULLS) OVER w AS target_name,
    last_value(navstat IGNORE NULLS) OVER w AS target_navstat
  FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY time_ms, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, target_type, target_name, target_navstat
  FROM t
  WHERE target_type IN (30, 32, 35) AND (upper(target_name) LIKE 'SHIP 1%' OR target_navstat = 5)""")
def target_attr_filter(spark, d):
    rows = track.with_targets(packets(spark, d), tie="event_id")
    return rows.where(compile_filter("t.type=30,32,35 & (t.name like ship 1* | t.navstat=5)")).select("event_id", "target_type", "target_name", "target_navstat")


def countries(spark, d) -> DataFrame:
    """The test tables' nations as a table of country numbers; XA and on are their codes of two letters."""
    two = F.concat(F.lit("X"), F.char(65 + F.col("n_nationkey")))
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("mid"), F.col("n_name").alias("alpha3"), two.alias("alpha2"))


@query(P + "SELECT event_id, n_name AS country FROM p JOIN nation ON n_nationkey = mmsi % 25")
def country_dim_join(spark, d):
    return track.with_countries(packets(spark, d), countries(spark, d), F.col("mmsi") % 25).select("event_id", "country")


@query(P + f"""SELECT event_id
  FROM p
  JOIN nation s ON CAST(s.n_nationkey AS VARCHAR) = source_country
  WHERE {INSIDE} AND (s.n_name IN ('NATION_3', 'NATION_7') OR s.n_nationkey = 4)""")
def filter_source_country(spark, d):
    query = Query.for_time().between(T0, T1).where("s.country=nation_3,NATION_7,XE")
    return query.to_df({"packets_time": time_table(spark, d, T0, T1)}, mids=countries(spark, d)).select("event_id")


@query("""SELECT o_orderkey, CAST(CASE WHEN m BETWEEN 200000000 AND 799999999 THEN m // 1000000 WHEN m BETWEEN 2000000 AND 7999999 THEN m // 10000
    WHEN m BETWEEN 111200000 AND 111799999 THEN m // 1000 % 1000
    WHEN m BETWEEN 982000000 AND 987999999 OR m BETWEEN 992000000 AND 997999999 THEN m // 10000 % 1000 END AS INTEGER) AS part
  FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 7919 % 1000000000 WHEN 1 THEN o_orderkey * 104729 % 10000000
    WHEN 2 THEN 111000000 + o_orderkey * 31 % 1000000 ELSE 980000000 + o_orderkey * 911 % 20000000 END AS m
  FROM orders)""")
def country_numbers(spark, d):
    k = F.col("o_orderkey")
    mmsi = (
        F.when(k % 4 == 0, k * 7919 % 1_000_000_000)
        .when(k % 4 == 1, k * 104729 % 10_000_000)
        .when(k % 4 == 2, 111_000_000 + k * 31 % 1_000_000)
        .otherwise(980_000_000 + k * 911 % 20_000_000)
    )
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", track.country_part(mmsi).alias("part"))


@query(P + f"""SELECT event_id, '{{"src.clk":' || time_ms || ',"src.id":' || coalesce(base_station, 'null') || ',"src.reg":"' || region || '"'
  || CASE WHEN n_name IS NULL THEN '' ELSE ',"src.cty":"' || 'X' || chr(CAST(65 + n_nationkey AS INTEGER)) || '"' END AS tag, lat, lon, sog, cog, acc, hdg
FROM p LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = source_country WHERE mmsi = 7 AND {INSIDE} AND msgtype IN (1, 2, 3, 18, 19, 27)""")
def past_track_json(spark, d):
    """The past-track objects, taken apart again: numbers in JSON are written differently in different engines."""
    rows = track.with_countries(track.past_track(packets(spark, d, T0, T1), 7, T0, T1), countries(spark, d))
    json = F.col("json")
    number = lambda name: F.get_json_object(json, f"$.{name}").cast("double")
    shown = track.track_json(rows, "event_id")
    tenths = [F.round(number(c) * 10).cast("int").alias(c) for c in ("sog", "cog")]
    whole = [number(c).cast("int").alias(c) for c in ("acc", "hdg")]
    place = [number(c).alias(c) for c in ("lat", "lon")]
    return shown.select("event_id", F.regexp_extract(json, r'^(.*),"lat"', 1).alias("tag"), *place, *tenths, *whole)


@query(P + """SELECT event_id, '{' || concat_ws(',', '"country":"' || 'X' || chr(CAST(65 + n_nationkey AS INTEGER)) || '"',
    '"type":"' || source_type || '"', '"bs":"' || base_station || '"', '"id":"' || source_id || '"',
    CASE WHEN trim(region) <> '' THEN '"region":"' || region || '"' END) || '}' AS json
FROM p LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = source_country""")
def source_json(spark, d):
    return track.source_json(track.with_countries(packets(spark, d), countries(spark, d)), "event_id")


@query(P + """SELECT event_id, mmsi, msgtype, time_ms, lat, lon, sog, cog, hdg, acc, CASE WHEN msgtype IN (1, 3) THEN navstat END AS navstat, imo, name,
    callsign, shiptype,
  source_id, source_country, region, base_station FROM p""")
def packet_text(spark, d):
    """Every event written as packet text and read back: sentences, tags and all fields of their messages."""
    lines = as_text(spark.read.parquet(f"{d}/events.parquet"))
    names = [f.name for f in PACKET if f.name not in ("digest", "aisdata", "source_type")]
    return nmea.packets_of(lines).select(F.col("path").cast("long").alias("event_id"), *names)


@query(P + "SELECT event_id, CAST(sog AS DOUBLE) / 10 AS tenths, upper(md5(aisdata)) AS request, trim(region) = '' AS blank FROM p")
def text_rules(spark, d):
    request = exprs.request_name(F.col("aisdata"))
    return packets(spark, d).select("event_id", exprs.tenths("sog").alias("tenths"), request.alias("request"), exprs.blank("region").alias("blank"))


@query(P + f"SELECT event_id FROM p WHERE {INSIDE}")
def scan_of_repeated_writes(spark, d):
    """Packets that were written twice come once."""
    rows = time_table(spark, d, T0, T1)
    return Query.for_time().between(T0, T1).once().to_df({"packets_time": rows.union(rows)}).select("event_id")


@query(P + f"SELECT event_id, url_encode('src ' || aisdata) AS encoded, printf('%.3f', lat) AS lat3 FROM p WHERE lat IS NOT NULL")
def request_text(spark, d):
    rows = packets(spark, d).where("lat is not null")
    return rows.select("event_id", exprs.url_encoded(F.concat(F.lit("src "), "aisdata")).alias("encoded"), exprs.fixed3(F.col("lat")).alias("lat3"))


@query(P + f"SELECT concat_ws(';', CAST(mmsi AS VARCHAR), CAST(time_ms AS VARCHAR), CAST(msgtype AS VARCHAR)) AS value FROM p WHERE {INSIDE}")
def table_export(spark, d):
    rows = Query.for_time().between(T0, T1).to_df({"packets_time": time_table(spark, d, T0, T1)})
    return sinks.table_lines(rows, ["mmsi", "time_ms", "msgtype"], ";")


@query(P + """, r AS (SELECT *, time_ms // 86400000 AS day, (row_number() OVER (PARTITION BY mmsi, time_ms // 86400000 ORDER BY time_ms,
    digest) - 1) // 10000 AS run
  FROM p
  WHERE lat IS NOT NULL)
SELECT mmsi, '<Placemark><name>' || mmsi || '</name><LineString><coordinates>' || string_agg(printf('%.6f,%.6f', lon, lat),
    ' ' ORDER BY time_ms, digest) || '</coordinates></LineString></Placemark>' AS value
  FROM r
  GROUP BY mmsi, day, run""")
def kml_tracks(spark, d):
    return sinks.kml_tracks(packets(spark, d))


@query(P + f"SELECT event_id FROM p WHERE time_ms > {T0 + 86_400_000} AND time_ms < {T1}")
def resume_filter(spark, d):
    return Query.for_time().between(T0, T1).resume_after(T0 + 86_400_000).to_df({"packets_time": time_table(spark, d, T0, T1)}).select("event_id")


@query(P + """, g AS (SELECT event_id, time_ms - lag(time_ms) OVER (PARTITION BY mmsi, msgtype ORDER BY time_ms, event_id) AS gap
  FROM p) SELECT event_id
  FROM g
  WHERE gap IS NULL OR gap > 3600000""")
def duplicate_window(spark, d):
    return track.drop_repeats_within(packets(spark, d).withColumn("payload", F.col("msgtype")), 3_600_000, tie="event_id").select("event_id")


THIN_SQL = P.replace("WITH p", "WITH RECURSIVE p").replace("{", "{{").replace("}", "}}") + """, s AS (SELECT mmsi, event_id, time_ms, lat, lon,
    row_number() OVER (PARTITION BY mmsi ORDER BY time_ms, event_id) AS rn
  FROM p {where}),
w AS (SELECT mmsi, event_id, rn, time_ms AS kt, lat AS klat, lon AS klon, TRUE AS kept FROM s WHERE rn = 1

  UNION ALL SELECT s.mmsi, s.event_id, s.rn, CASE WHEN {far} THEN s.time_ms ELSE w.kt END, CASE WHEN {far} THEN s.lat ELSE w.klat END,
    CASE WHEN {far} THEN s.lon ELSE w.klon END, {far}
  FROM w
  JOIN s ON s.mmsi = w.mmsi AND s.rn = w.rn + 1)
SELECT event_id FROM w WHERE kept"""
FAR_SQL = """(2 * 6371000.0 * asin(sqrt(pow(sin(radians(s.lat - w.klat) / 2),
    2) + cos(radians(w.klat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - w.klon) / 2), 2))) >= 2500000)"""


@query(THIN_SQL.format(where="", far="(s.time_ms - w.kt >= 21600000)"))
def min_duration_thin(spark, d):
    return track.thin(packets(spark, d), min_ms=21_600_000, tie="event_id").select("event_id")


@query(THIN_SQL.format(where="WHERE lat IS NOT NULL", far=FAR_SQL))
def min_distance_thin(spark, d):
    return track.thin(packets(spark, d), min_m=2_500_000, tie="event_id").select("event_id")


@query(P + f"SELECT event_id FROM p WHERE {INSIDE} ORDER BY time_ms, digest LIMIT 100")
def limit_ordered(spark, d):
    return Query.for_time().between(T0, T1).first(100).to_df({"packets_time": time_table(spark, d, T0, T1)}).select("event_id")


@query(P + "SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM p")
def bbox_extent(spark, d):
    return reports.extent(packets(spark, d))


@query(P + f"SELECT 100.0 * (max(time_ms) - {T0}) / CAST({T1 - T0} AS DOUBLE) AS percent FROM p WHERE time_ms < {T1}")
def progress_pct(spark, d):
    return reports.progress(packets(spark, d).where(F.col("time_ms") < T1), T0, T1)


@query(P + """, m AS (SELECT event_id, lat, lon, CAST(round(abs(lat) * 60000) AS BIGINT) AS a, CAST(round(abs(lon) * 60000) AS BIGINT) AS o
  FROM p
  WHERE lat IS NOT NULL)
SELECT event_id, printf('%02d %06.3f%s %03d %06.3f%s', a // 60000, (a % 60000) / 1000.0, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END,
    o // 60000, (o % 60000) / 1000.0, CASE WHEN lon < 0 THEN 'W' ELSE 'E' END) AS position
  FROM m""")
def format_position(spark, d):
    return packets(spark, d).where("lat is not null").select("event_id", exprs.format_position(F.col("lat"), F.col("lon")).alias("position"))


@query(P + "SELECT event_id, round(lat, 2) AS lat FROM p WHERE lat IS NOT NULL")
def parse_position(spark, d):
    text = F.substring(exprs.format_position(F.col("lat"), F.col("lon")), 1, 10)
    return packets(spark, d).where("lat is not null").select("event_id", F.round(exprs.parse_coordinate(text), 2).alias("lat"))


@query(P + "SELECT event_id, round(value * 1852 / 1000) AS km, round(value * 1000 / 1852) AS nm, round(value * 1852) AS m FROM p")
def unit_convert(spark, d):
    v = F.col("value")
    return packets(spark, d).select("event_id", exprs.miles_to_km(v).alias("km"), exprs.km_to_miles(v).alias("nm"), exprs.miles_to_m(v).alias("m"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%kml%' THEN 'kml' WHEN p_name LIKE '%table%' THEN 'csv' WHEN p_name LIKE '%json%' THEN 'json' ELSE 'txt' END AS ending
  FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN 'kml' WHEN 1 THEN 'table' WHEN 2 THEN 'json' ELSE '' END AS p_name
  FROM part)""")
def file_type(spark, d):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, "kml").when(k == 1, "table").when(k == 2, "json").otherwise(""))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", exprs.file_type(name).alias("ending"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.1f bytes', n * 1.0) WHEN n < 1048576 THEN printf('%.1f kB',
    floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size
  FROM (SELECT o_orderkey, o_orderkey * 97 + 1 AS n
  FROM orders)""")
def byte_size(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", exprs.byte_size(F.col("o_orderkey") * 97 + 1).alias("size"))


@query(P + """SELECT event_id, printf('%02d:%02d:%02d', time_ms // 3600000 % 24, time_ms // 60000 % 60, time_ms // 1000 % 60) AS hms,
    strftime(make_timestamp(time_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN time_ms % 1000 = 0 THEN 'Z' ELSE printf('.%03dZ',
    time_ms % 1000) END AS iso
  FROM p""")
def time_text(spark, d):
    return packets(spark, d).select("event_id", exprs.hms(F.col("time_ms") % 86_400_000).alias("hms"), exprs.iso_instant(F.col("time_ms")).alias("iso"))


REPO_SQL = """SELECT name, updated, size, complete
  FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN '.' ELSE '' END || 'f' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN '.download' ELSE '.zip' END AS name,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS updated, o_orderkey AS size, o_orderkey % 5 <> 0 AS complete
  FROM orders)
  WHERE name NOT LIKE '.%'"""


@query(REPO_SQL)
def repo_listing_sort(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 11 == 0, ".").otherwise(""), F.lit("f"), k.cast("string"), F.when(k % 5 == 0, ".download").otherwise(".zip"))
    files = spark.read.parquet(f"{d}/orders.parquet").select(name.alias("name"), F.when(k % 13 != 0, F.col("o_custkey")).alias("updated"), k.alias("size"))
    return reports.repository(files)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; in local mode (tests) a temporary one where none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='fairlead-')}/{name}-{uuid.uuid4().hex}"


@query(P + "SELECT event_id, clat AS carried_lat, clon AS carried_lon FROM k")
def stream_carry_forward(spark, d):
    """The carrying stream over all events, written to the shared folder and read again, as the batch window gives it.

    One micro-batch: files in no order of time may hold packets of any age. Its window sorts and spills in the executors.
    """
    folder = scratch(spark, "carried")
    # As a pattern, since a stream takes a path itself for a folder.
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    names = ["event_id", "carried_lat", "carried_lon"]

    def store(batch: DataFrame, number: int) -> None:
        batch.select(*names).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    carry_positions(packets_of(source), f"{folder}/checkpoint", store, tie="event_id").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*names)


@query(route_sql("online"))
def stream_archive(spark, d):
    """All events archived as a stream, a file of the given table at a time, and counted by table as a batch routes them."""
    folder = scratch(spark, "archived")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")
    ingest.archive(packets_of(source), f"{folder}/out", f"{folder}/checkpoint", tie="event_id").awaitTermination()
    return archive.entries(spark, f"{folder}/out").groupBy(F.col("table").alias("table_name")).agg(F.sum("rows").alias("n"))


def reimported(spark: SparkSession, d: str, compacted: bool) -> str:
    """A new archive of all packets, those of every third event written a second time; its folder."""
    folder = scratch(spark, "reimported")
    rows = packets(spark, d)
    routing.write_tables(rows, folder)
    routing.write_tables(rows.where(F.col("event_id") % 3 == 0), folder)
    if compacted:
        archive.compact(spark, folder)
    return folder


def event_id():
    """The event that a packet's text names."""
    return F.split_part(F.col("aisdata"), F.lit("|"), F.lit(1)).cast("long").alias("event_id")


@query(P + f"SELECT event_id, time_ms, aisdata FROM p WHERE {INSIDE}")
def archive_after_reimport(spark, d):
    """Packets written to an archive twice are one: a scan by time reads each once."""
    return Query.for_time().between(T0, T1).to_df(spark, reimported(spark, d, False)).select(event_id(), "time_ms", "aisdata")


@query(P + f"SELECT event_id, time_ms, aisdata FROM p WHERE mmsi IN (3, 7, 11) AND {INSIDE}")
def archive_vessel_scan(spark, d):
    """A scan by vessel in a compacted archive, of the files that may hold the vessels."""
    return Query.for_mmsi(*VESSELS).between(T0, T1).to_df(spark, reimported(spark, d, True)).select(event_id(), "time_ms", "aisdata")


@query(P + f""", ch AS (SELECT unnest(range(0, ({(T1 - 1) // 600000} - {T0 // 600000}) // 10 + 1)) AS k),
n AS (SELECT (time_ms // 600000 - {T0 // 600000}) // 10 AS k, count(*) AS n FROM p WHERE time_ms >= {T0} AND time_ms < {T1} GROUP BY 1)
SELECT CAST(ch.k * 10 + {T0 // 600000} AS BIGINT) AS first_block, CAST(least(ch.k * 10 + {T0 // 600000} + 9, {(T1 - 1) // 600000}) AS BIGINT) AS last_block,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n FROM ch LEFT JOIN n USING (k)""")
def archive_counts(spark, d):
    """Counts by chunks of blocks in an archive that was written to twice."""
    return reports.chunk_counts(archive.read_table(spark, reimported(spark, d, False), "packets_time", T0, T1), T0, T1, 10)


@query(P + f""", t AS (SELECT *, last_value(shiptype IGNORE NULLS) OVER w AS target_type, last_value(name IGNORE NULLS) OVER w AS target_name
  FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY time_ms, digest ROWS UNBOUNDED PRECEDING))
SELECT event_id FROM t WHERE {INSIDE} AND (target_type = 32 OR upper(target_name) LIKE 'SHIP 1%')""")
def archive_targets(spark, d):
    """Targets as they were known at each packet's time, from before the query's interval too: by a snapshot of vessels and the packets since."""
    folder = scratch(spark, "targets")
    routing.write_tables(packets(spark, d), folder)
    archive.take_snapshot(spark, folder, T0 // archive.DAY_MS - 1)
    return Query.for_time().between(T0, T1).where("t.type=32 | t.name like SHIP 1*").to_df(spark, folder).select(event_id())


@query(P + f"SELECT event_id FROM p WHERE {INSIDE} AND mmsi IN (3, 7, 11)")
def export_in_chunks(spark, d):
    """A resumable export that stops after half its interval and goes on, read back from its files."""
    folder = scratch(spark, "exported")
    routing.write_tables(packets(spark, d), f"{folder}/archive")
    for end in ((T0 + T1) // 2, T1):
        sinks.resumed_export(Query.for_mmsi(*VESSELS).between(T0, end), spark, f"{folder}/archive", f"{folder}/out", chunk_ms=5 * archive.DAY_MS)
    return spark.read.text(f"{folder}/out/chunk=*").select(F.split_part("value", F.lit("|"), F.lit(1)).cast("long").alias("event_id"))


def exported(spark: SparkSession, d: str, output: str, part: str = "", **how) -> DataFrame:
    """The lines of an export of all packets between T0 and T1, read from its files; ``part`` is a folder of it."""
    folder = scratch(spark, output)
    rows = Query.for_time().between(T0, T1).to_df({"packets_time": time_table(spark, d, T0, T1)})
    sinks.export(rows, folder, output, **how)
    return spark.read.text(f"{folder}/{part}")


@query(P + f"SELECT aisdata AS value FROM p WHERE {INSIDE}")
def export_raw(spark, d):
    return exported(spark, d, "raw")


@query(P + f"""SELECT '{{' || concat_ws(',', '"mmsi":' || mmsi, '"time_ms":' || time_ms, '"name":"' || name || '"', '"navstat":' || navstat) || '}}' AS value
  FROM p WHERE {INSIDE}""")
def export_json_object(spark, d):
    """Objects of a list of columns; what is absent is left out."""
    return exported(spark, d, "jsonObject", columns=params.column_list("mmsi; time_ms,name;;navstat "))


@query(P + f"""SELECT '<tr><td>' || mmsi || '</td><td>' || coalesce(callsign, '') || '</td><td>' || region || '</td></tr>' AS value FROM p WHERE {INSIDE}""")
def export_html(spark, d):
    return exported(spark, d, "html", columns=["mmsi", "callsign", "region"])


@query(P + f"""SELECT strftime(make_timestamp(time_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN time_ms % 1000 = 0 THEN 'Z'
    ELSE printf('.%03dZ', time_ms % 1000) END || ' ' || aisdata AS value FROM p WHERE {INSIDE}""")
def export_prefixed(spark, d):
    return exported(spark, d, "prefixed_sentences")


@query(P + f"SELECT count(*) || ' packets' AS value FROM p WHERE {INSIDE}")
def export_footer(spark, d):
    return exported(spark, d, "table", "_footer", columns=["mmsi"], footer=True)


@query(P + """SELECT time_ms, mmsi, msgtype, lat, lon, sog, cog, hdg, acc, CASE WHEN msgtype IN (1, 3) THEN navstat END AS navstat, imo, name, callsign, shiptype,
    source_country, region, base_station FROM p""")
def file_import(spark, d):
    """Every event written to text files, which are read in splits and put together."""
    folder = scratch(spark, "text")
    as_text(spark.read.parquet(f"{d}/events.parquet")).select("text").write.text(folder)
    names = [f.name for f in PACKET if f.name not in ("digest", "aisdata", "source_id", "source_type")]
    return nmea.packets_of(nmea.read_lines(spark, folder)).select(*names)


def log_parts(events: DataFrame, most: int = 1_500_000) -> int:
    """Log files a source: four at least, and so many that no task writes more than ``most`` events, or about, at any size."""
    return max(4, -(-events.count() // most))


@query(P + "SELECT source_id, time_ms, mmsi, msgtype, lat, lon, name FROM p")
def stream_log(spark, d):
    """Every event logged as text of its live source, archived as a stream in several batches, and read from the archive."""
    folder = scratch(spark, "logged")
    events = spark.read.parquet(f"{d}/events.parquet")
    lines = as_text(events).select("src_id", "text")
    lines.repartition(log_parts(events)).write.partitionBy("src_id").text(f"{folder}/log")
    ingest.archive_log(spark, f"{folder}/log", f"{folder}/out", f"{folder}/checkpoint", files_per_batch=8).awaitTermination()
    source = F.split_part("source_id", F.lit("="), F.lit(2)).alias("source_id")
    return archive.read_table(spark, f"{folder}/out", "packets_time").select(source, "time_ms", "mmsi", "msgtype", "lat", "lon", "name")


@query(P + "SELECT event_id, mmsi, time_ms, msgtype FROM p")
def stream_failed_batches(spark, d):
    """Batches of a stream that a handler fails on are kept, and come back whole."""
    folder = scratch(spark, "failed")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")

    def fails(batch: DataFrame, number: int) -> None:
        raise RuntimeError(f"batch {number} is refused")

    ingest.archive(packets_of(source), f"{folder}/out", f"{folder}/checkpoint", tie="event_id", how={"handlers": (fails,)}).awaitTermination()
    return ingest.replay(spark, f"{folder}/out").select("event_id", "mmsi", "time_ms", "msgtype")


@query(P + "SELECT event_id, msgtype FROM p WHERE event_id % 5 <> 0")
def drop_undecodable(spark, d):
    """Packets without those whose payloads can't be read, here of every fifth event."""
    lines = as_text(spark.read.parquet(f"{d}/events.parquet"))
    spoilt = F.when(F.col("path").cast("long") % 5 == 0, F.regexp_replace("text", ",A,[^,]*", ",A,~")).otherwise(F.col("text"))
    return nmea.decodable(nmea.packets_of(lines.withColumn("text", spoilt))).select(F.col("path").cast("long").alias("event_id"), "msgtype")


@query(P + """SELECT event_id, 'start and duration' AS kind FROM p WHERE time_ms > epoch_ms(TIMESTAMP '2024-01-05 06:00:00')
    AND time_ms < epoch_ms(TIMESTAMP '2024-01-07 18:30:00')
  UNION ALL SELECT event_id, 'duration and end' FROM p WHERE time_ms > epoch_ms(TIMESTAMP '2024-01-03 00:00:00') AND time_ms < epoch_ms(TIMESTAMP '2024-01-10 00:00:00')
  UNION ALL SELECT event_id, 'up to now' FROM p WHERE time_ms > epoch_ms(TIMESTAMP '2024-01-14 12:30:00') AND time_ms < epoch_ms(TIMESTAMP '2024-01-15 12:30:00')
  UNION ALL SELECT event_id, 'from the hour' FROM p WHERE time_ms > epoch_ms(TIMESTAMP '2024-01-15 12:00:00') AND time_ms < epoch_ms(TIMESTAMP '2024-01-15 12:10:00')
  UNION ALL SELECT event_id, 'end moved' FROM p WHERE time_ms > epoch_ms(TIMESTAMP '2024-01-04 23:50:00') AND time_ms < epoch_ms(TIMESTAMP '2024-01-05 00:00:00')
  UNION ALL SELECT event_id, 'start moved' FROM p WHERE time_ms > epoch_ms(TIMESTAMP '2024-01-15 12:30:00') AND time_ms < epoch_ms(TIMESTAMP '2024-01-15 12:40:00')""")
def interval_forms(spark, d):
    """Scans of intervals given in every form there is, now being the end of the others."""
    forms = {
        "start and duration": params.interval_ms("2024-1-5T6/P2DT12H30M"), "duration and end": params.interval_ms("P1W/2024-01-10Z"), "up to now": params.ending_now("PT24H", T1),
        "from the hour": params.default_interval(T1), "start moved": params.repaired(T1, T0), "end moved": params.repaired(T1, T0, moved="end"),
    }
    found = [Query.for_time().between(*x).to_df({"packets_time": time_table(spark, d, *x)}).select("event_id", F.lit(kind).alias("kind")) for kind, x in forms.items()]
    return functools.reduce(DataFrame.union, found)


@query(P + f"""SELECT CAST(b.b AS INTEGER) AS timeblock, count(p.mmsi) AS n FROM (SELECT unnest(range({T0 // 600000}, {T1 // 600000} + 1)) AS b) b
  LEFT JOIN p ON p.time_ms // 600000 = b.b GROUP BY 1""")
def interval_blocks(spark, d):
    """Packets by time block of an interval, for every block that it touches."""
    first, last = exprs.timeblocks(T0, T1, TEN_MINUTES_MS)
    rows = packets(spark, d, first * TEN_MINUTES_MS, (last + 1) * TEN_MINUTES_MS - 1)
    counted = rows.groupBy(exprs.timeblock("time_ms", TEN_MINUTES_MS).alias("timeblock")).agg(F.count("*").alias("n"))
    every = spark.range(first, last + 1).select(F.col("id").cast("int").alias("timeblock"))
    return every.join(counted, "timeblock", "left").select("timeblock", F.coalesce("n", F.lit(0)).alias("n"))


@query(P + "SELECT count(*) AS packets, count(msgtype) AS decoded, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM p")
def ingest_counters(spark, d):
    """What a write of all packets to an archive says of itself."""
    seen = reports.Ingest()
    routing.write_tables(seen.watch(packets(spark, d)), scratch(spark, "counted"))
    told = seen.report()
    names = ["packets", "decoded", "first_ms", "last_ms"]
    return spark.createDataFrame([tuple(told[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(P + f"""SELECT event_id, 'vessels' AS kind FROM p WHERE {INSIDE} AND mmsi IN (3, 7, 11)
  UNION ALL SELECT event_id, 'time' FROM p WHERE {INSIDE}
  UNION ALL SELECT event_id, 'area' FROM k WHERE {INSIDE} AND mmsi > 0 AND clat IS NOT NULL AND {CELL.format(d=1, n=360)} IN ({', '.join(map(str, cells_of(BOX, 1)))})""")
def choice_of_scan(spark, d):
    """Vessels are asked for before an area, an area (two corners in text, in any order) before time alone."""
    box = params.bounding_box("25.75,-60.25,-30.5,40.5")
    asked = {"vessels": (list(VESSELS), box), "area": (None, box), "time": (None, None)}
    stored = tables(spark, d)
    stored |= {"packets_time": time_table(spark, d, T0, T1)} | mmsi_table(spark, d)
    found = [Query.choose(*x).between(T0, T1).to_df(stored).select("event_id", F.lit(kind).alias("kind")) for kind, x in asked.items()]
    return functools.reduce(DataFrame.union, found)


@query(P + "SELECT event_id FROM p WHERE source_type = 'LIVE' AND region IN ('801', '805') AND msgtype = 5 AND name IN ('SHIP 1', 'SHIP 17', 'SHIP 29', 'SHIP 33')")
def filter_composed(spark, d):
    """A filter put together from facets; blank ones and any say nothing."""
    names = [f"SHIP {k}" for k in (1, 17, 29, 33)]
    text = compose(source_type="LIVE", source_region=["801", "805"], source_bs="", source_country="any", message_type="5", message_name=names)
    return packets(spark, d).where(compile_filter(text)).select("event_id")
