"""Scalar rules, parameters, filters, layout and streams of the packet archive."""

import io
import json
import os
import random
import shutil
import socket
import subprocess
import sys
import threading
import time
import zipfile
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlead import cli, queries
from fairlead.functions import exprs, filters, params
from fairlead.operators import reports, routing, track
from fairlead.plans.query import Query, cells_of, inner_cells
from fairlead.schema import TABLES, TEN_MINUTES_MS, create_table_sql
from fairlead.sources import archive, nmea, sinks, testdata
from fairlead.sources.testdata import packets
from fairlead.streaming import ingest

GOLDEN = [("1970-01-01T00:00:00Z", 0), ("1970-01-01T00:09:00Z", 0), ("1970-01-01T00:10:00Z", 1), ("2005-04-19T00:00:00Z", 1856448), ("2005-04-19T00:05:00Z", 1856448), ("2005-04-19T00:10:00Z", 1856449), ("2005-04-19T00:20:00Z", 1856450), ("2005-04-19T09:49:38Z", 1856506), ("2005-04-19T12:30:00Z", 1856523), ("2005-04-19T12:39:59Z", 1856523), ("2005-04-19T23:59:59Z", 1856591)]


def test_time_blocks(spark):
    rows = spark.createDataFrame([(params.instant_ms(t), b) for t, b in GOLDEN], "time_ms long, want int")
    assert rows.where(exprs.timeblock("time_ms", TEN_MINUTES_MS) != F.col("want")).count() == 0
    assert exprs.timeblocks(0, 0, TEN_MINUTES_MS) == (0, 0)
    assert exprs.timeblocks(params.instant_ms("2005-04-19"), params.instant_ms("2005-04-19T23:59:59"), TEN_MINUTES_MS) == (1856448, 1856591)


def test_parameters():
    day = datetime(2015, 1, 5, 6, tzinfo=timezone.utc).timestamp() * 1000
    assert params.interval_ms("2015-1-5T6/PT90M") == (day, day + 5_400_000) and params.interval_ms("P1D/2015-01-06T6:0:0Z")[0] == day
    assert params.duration_ms("PT999H") == 999 * 3_600_000 and params.bounding_box("60,-10,40,20") == (40, -10, 60, 20)
    assert params.column_list("lat;lon, time") == ["lat", "lon", "time"] and params.repaired(5, 3) == (5, 600_005)
    for bad in ("2015", "a/b", "2015-01-01/P"):
        with pytest.raises(ValueError):
            params.interval_ms(bad)
    with pytest.raises(ValueError):
        params.bounding_box("1,2,3")


@pytest.mark.parametrize("text", ["m.type=", "x.type=1", "m.nope=1", "(m.mmsi=1", "m.mmsi=1 &", "t.pos within bbox(1,2,3)", "m.mmsi<a", "m.mmsi=1)"])
def test_bad_filters(spark, text):
    assert not filters.is_valid(text)


@pytest.mark.parametrize("text, names", [
    ("m.name=MADE IN CHINA", ["MADE IN CHINA"]), ("m.name like MADE IN*", ["MADE IN CHINA"]), ("m.name=like a virgin", ["LIKE A VIRGIN"]), ("m.name in (IN, LIKE, WITHIN)", ["IN"]),
    ("m.name='A&B'", ["A&B"]), ('m.name="AB (2)"|m.name=IN', ["AB (2)", "IN"]), ("m.name='O''NEIL'", ["O'NEIL"]), ('m.name="say ""hi"""', ['SAY "HI"']), ("m.name like 'A&*'", ["A&B"]), ("m.name=O'NEIL", ["O'NEIL"]),
    ("(m.name=IN & m.name like i?) | m.name='A&B'", ["A&B", "IN"]), ("m.name=X-1/2.5", ["X-1/2.5"]),
])
def test_values_of_filters(spark, text, names):
    known = ["MADE IN CHINA", "LIKE A VIRGIN", "IN", "A&B", "AB (2)", "O'NEIL", 'SAY "HI"', "X-1/2.5", "OTHER"]
    frame = spark.createDataFrame([(n,) for n in known], "name string")
    assert sorted(r["name"] for r in frame.where(filters.compile_filter(text)).collect()) == names
    every = filters.compose(m_name=known[:-1])
    assert sorted(r["name"] for r in frame.where(filters.compile_filter(every)).collect()) == sorted(known[:-1])
    for bad in ("m.name='A", "m.name=A(2)", "m.name=", "m.name like", "m.name in (A", "m.name=A=B", "m.name=A B)"):
        assert not filters.is_valid(bad)


def test_filters(spark):
    assert filters.is_valid("") and filters.is_valid(None) and filters.is_valid("s.region=806", only="s") and not filters.is_valid("m.mmsi=1", only="s")
    rows = spark.createDataFrame([(1, "a_b", 5.0, 5.0), (2, "axb", -5.0, 0.1), (3, None, 0.0, 0.0)], "mmsi int, name string, target_lat double, target_lon double")
    ids = lambda t: sorted(r["mmsi"] for r in rows.where(filters.compile_filter(t)).collect())
    assert ids("m.name like a_b") == [1] and ids("m.name like A?B") == [1, 2] and ids("m.mmsi=1 | m.mmsi=2 & m.name=zz") == [1]
    assert ids("t.pos within bbox(15,-18,-10,14) & (t.lat<-0.3|t.lat>0.3)") == [1, 2] and ids("m.mmsi in (1,3)") == [1, 3]
    assert filters.compose(source_type="any", source_region=["806", ""], message_country=["DNK", "SWE"]) == "s.region=806 & m.country=DNK,SWE"


def test_positions(spark):
    rows = spark.createDataFrame([("55 30.000N", 55.5), ("012 15.000W", -12.25), ("-3.5", -3.5), ("3.5S", -3.5), (None, None)], "t string, want double")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", exprs.parse_coordinate("t")).collect())
    with pytest.raises(Exception, match="not a position"):
        spark.range(1).select(exprs.parse_coordinate(F.lit("north")).alias("x")).collect()
    one = spark.range(1).select(exprs.format_position(F.lit(-0.99999999), F.lit(10.5)).alias("p"), exprs.byte_size(F.lit(1536)).alias("b"), exprs.byte_size(F.lit(0)).alias("z")).first()
    assert tuple(one) == ("01 00.000S 010 30.000E", "1.5 kB", "-")


def test_access_path():
    small, large = (55.817993, 10.0156428, 55.8487945, 10.1317718), (40.0, -10.0, 60.0, 20.0)
    assert len(cells_of(small)) == 1 and len(cells_of(large)) == 21 * 31 and len(cells_of(large, 10)) == 3 * 4
    assert Query.for_area(small, cell10=True).table() == "packets_area_cell1" and Query.for_area(large, cell10=True).table() == "packets_area_cell10"
    assert Query.for_area(large).table() == "packets_area_cell1" and Query.for_area((60, 20, 40, -10)).box == large
    assert Query.choose([1], large).kind == "mmsi" and Query.choose(None, large).kind == "area" and Query.choose().kind == "time"
    with pytest.raises(ValueError):
        Query.for_mmsi()


def test_guards_differ_for_mmsi_zero_and_old_times(spark):
    rows = spark.createDataFrame([(1, 0, 1, 5_000, 1.0, 1.0), (2, 9, 1, 0, 1.0, 1.0), (3, None, 8, 7_000, None, None), (4, 9, 1, 9_000, 91.0, 0.0)], "event_id long, mmsi int, msgtype int, time_ms long, lat double, lon double").withColumns({"aisdata": F.col("event_id").cast("string"), "digest": F.md5(F.col("event_id").cast("string"))})
    ids = lambda mode, t: sorted(r["event_id"] for r in routing.fan_out(rows, mode)[t].collect())
    assert ids("online", "packets_mmsi") == [2, 4] and ids("bulk", "packets_mmsi") == [1, 4]
    assert ids("online", "packets_area_cell1") == [4] and ids("bulk", "packets_area_cell1") == [1, 4] and ids("online", "packets_area_unknown") == []
    assert ids("online", "packets_time") == [1, 3, 4]


def test_carry_forward_boundary(spark):
    rows = [(1, 5, 0, 1.0, 2.0), (2, 5, 1_200_000, None, None), (3, 5, 1_200_001, None, None), (4, 6, 1, None, None)]
    frame = spark.createDataFrame(rows, "event_id long, mmsi int, time_ms long, lat double, lon double")
    assert {r["event_id"]: r["carried_lat"] for r in track.carry_forward(frame, tie="event_id").collect()} == {1: 1.0, 2: 1.0, 3: None, 4: None}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=30), st.integers(1, 100))
def test_thinning_gaps(spark, times, gap):
    frame = spark.createDataFrame([(i, 1, t, 0.0, 0.0) for i, t in enumerate(times)], "event_id long, mmsi int, time_ms long, lat double, lon double")
    got = sorted(r["time_ms"] for r in track.thin(frame, min_ms=gap, tie="event_id").collect())
    want, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            want.append(t)
            last = t
    assert got == want


def slowly(rows, min_ms, min_m):
    """Thinning of sorted ``(mmsi, time_ms, lat, lon)`` row by row; the numbers of those kept."""
    kept, last = [], None
    for i, r in enumerate(rows):
        if last is None or r[0] != last[0] or r[0] in (None, -1):
            ok = True
        else:
            ok = min_ms is None or None not in (last[1], r[1]) and r[1] - last[1] >= min_ms
            ok = ok and (min_m is None or track.metres(last[2:], r[2:]) >= min_m)
        if ok:
            last = r
            kept.append(i)
    return kept


@pytest.mark.parametrize("min_ms,min_m", [(None, None), (1, None), (40, None), (900, None), (None, 0.0), (None, 3e3), (None, 9e4), (50, 2e4), (700, 5e5)])
def test_thinning_by_blocks_is_thinning_row_by_row(min_ms, min_m):
    """Whatever batches the rows come in, with equal times, vessels that lie still, null times and packets without a vessel."""
    rng = random.Random(17)
    rows = []
    for mmsi in [None, -1, *range(1, 12)]:
        t, lat, lon = 0, rng.uniform(-89, 89), rng.uniform(-179, 179)
        for k in range(rng.choice([1, 2, 30, 700, 2000])):
            t += rng.choice([0, 0, 1, 3, 40])
            if rng.random() < (0.9 if mmsi and mmsi % 2 else 0.02):
                lat, lon = max(-90, min(90, lat + rng.uniform(-0.1, 0.1))), max(-180, min(180, lon + rng.uniform(-0.1, 0.1)))
            rows.append((mmsi, None if mmsi == 7 and k < 2 else t, lat, lon))
    want = slowly(rows, min_ms, min_m)
    for size in (1, 3, 64, 1000, len(rows)):
        kept, thinner = [], track.Thinner(min_ms, min_m)
        for at in range(0, len(rows), size):
            columns = list(zip(*rows[at : at + size]))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.float64()))]
            kept += [at + i for i in thinner.take(*arrays).tolist()]
        assert kept == want, size


def test_thinning_holds_no_vessel_in_a_row(spark):
    rows = spark.range(30_000).selectExpr("id AS event_id", "IF(id % 3 = 0, 7, id) AS mmsi", "id * 1000 AS time_ms", "CAST(id % 90 AS DOUBLE) AS lat", "0D AS lon")
    thinned = track.thin(rows, min_ms=9_000, tie="event_id")
    assert "collect_list" not in thinned._jdf.queryExecution().toString()
    assert thinned.where("mmsi = 7").count() == 3_334 and thinned.where("mmsi <> 7").count() == 19_999
    assert track.thin(rows.limit(0), min_m=1.0, tie="event_id").count() == 0


def test_archive_prunes_and_agrees(spark, tiny, tmp_path):
    rows, path = packets(spark, tiny), str(tmp_path / "archive")
    routing.write_tables(rows, path)
    t0, t1 = params.interval_ms("2024-01-05/2024-01-06T12:00:00Z")
    query = Query.for_time().between(t0, t1)
    stored, direct = query.to_df(spark, path), query.to_df(routing.fan_out(rows))
    assert [r["digest"] for r in stored.collect()] == [r["digest"] for r in direct.collect()] and stored.count() > 0
    plan = stored._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "(day#" in filters and "IsNotNull(timeblock)" in plan[plan.index("PushedFilters: [") :] and "rangepartitioning" not in plan and "Window" not in plan
    assert {r["day"] for r in archive.files_for(spark, path, "packets_time", t0, t1).collect()} == {t0 // 86_400_000, t1 // 86_400_000}
    first, rest = query.between(t0, t0 + 40_000_000), query.resume_after(t0 + 39_999_999)
    assert first.to_df(spark, path).count() + rest.to_df(spark, path).count() == stored.count()
    files = routing.fan_out(rows)["packets_time"]
    missing, held = reports.missing_from(files, stored), reports.diff_counts(files, stored).first()
    assert missing.count() == held["not_in_store"] and held["processed"] == held["in_store"] + held["not_in_store"]
    routing.write_tables(rows.limit(50), path)
    for statement in create_table_sql(path):
        spark.sql(statement)
    spark.sql("MSCK REPAIR TABLE packet_runs")
    assert spark.table("packet_runs").where("table = 'packets_time'").count() == files.count() + 50 and spark.table("packets_time").count() == files.count()
    for name in TABLES:
        spark.sql(f"DROP VIEW {name}")
    spark.sql("DROP TABLE packet_runs")
    for box in ((-30.5, -60.25, 25.75, 40.5), (-80.0, -170.0, 80.0, 180.0), (0.0, 179.5, 10.0, 180.0)):
        for cell10 in (False, True):
            tables = routing.fan_out(rows, cell10=True)
            area = Query.for_area(box, cell10=cell10, exact=True)
            want = {r["digest"] for r in track.carry_forward(rows).where("mmsi > 0").where(F.col("carried_lat").between(box[0], box[2]) & F.col("carried_lon").between(box[1], box[3])).collect()}
            assert {r["digest"] for r in area.to_df(tables).collect()} == want
            if not cell10:
                assert {r["digest"] for r in area.to_df(spark, path).collect()} == want
            cells = set(cells_of(box, 10 if area.table().endswith("10") else 1))
            whole = Query.for_area(box, cell10=cell10).to_df(tables)
            assert whole.count() == tables[area.table()].where(F.col("cellid").isin(*cells)).count() if len(cells) < 8000 else True


def test_mixed_cover_and_date_line(spark, tiny, tmp_path):
    """Mixed covers hold the packets of the one-degree cells, by fewer cells; an area over the date line is both its sides."""
    rows, path = packets(spark, tiny), str(tmp_path / "a")
    routing.write_tables(rows, path, cell10=True)
    made = routing.fan_out(rows, cell10=True)
    for box, wrap in (((-43.5, -95.25, 52.75, 101.5), False), ((0.0, 0.0, 9.5, 9.5), False), ((0.0, 0.0, 9.4, 8.5), False), ((-90.0, -180.0, 90.0, 180.0), False), ((-45.5, 120.25, 45.5, -120.5), True), ((10.0, 175.0, 12.0, -175.0), True)):
        plain, mixed = (Query.for_area(box, mixed=m, wrap=wrap).between(0, 1 << 60) for m in (False, True))
        want = sorted(r["digest"] for r in plain.to_df(made).collect())
        assert sorted(r["digest"] for r in mixed.to_df(made).collect()) == want
        assert [r["digest"] for r in mixed.to_df(spark, path).collect()] == [r["digest"] for r in plain.to_df(spark, path).collect()] and len(want) == mixed.to_df(spark, path).count()
        cells = {c for b in plain.boxes() for c in cells_of(b)}
        assert wrap == (len(plain.boxes()) == 2) and all((c % 360 >= 120 + 180 or c % 360 <= 60) == wrap or not wrap for c in cells)
    assert inner_cells((0.0, 0.0, 9.5, 9.5)) == (0, 0, 18, 18) and inner_cells((0.0, 0.0, 8.5, 9.5)) is None
    both = Query.for_area((-20.0, 150.0, 20.0, -150.0), exact=True, wrap=True).to_df(made)
    assert both.where("NOT (carried_lon >= 150 OR carried_lon <= -150)").count() == 0 and both.where("carried_lon < 0").count() > 0 and both.where("carried_lon > 0").count() > 0


def test_tables_are_written_in_one_job(spark, tiny, tmp_path):
    """The plan has one scan and one shuffle for the tables; all of them, or none, are there afterwards."""
    plan = routing.routed(packets(spark, tiny), "bulk", cell10=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    for mode in ("online", "bulk"):
        routing.write_tables(packets(spark, tiny), str(tmp_path / mode), mode, cell10=True)
        want = routing.fan_out(packets(spark, tiny), mode, cell10=True)
        for name, rows in want.items():
            assert archive.read_table(spark, str(tmp_path / mode), name).count() == rows.count(), (mode, name)


def test_written_again_is_written_once(spark, real, tmp_path, capsys):
    """A file imported twice changes no query, count or diff; the later row of a key stands; compaction changes nothing but files."""
    path, between = str(real / "archive"), params.interval_ms("2015-03-06T04:59:59/2015-03-06T06:00")
    want = {name: sorted(map(str, archive.read_table(spark, path, name).collect())) for name in TABLES}

    def asked():
        cli.main(["stats", "--archive", path, "--interval", "2015-03-06T05:00/2015-03-06T05:10"], spark)
        cli.main(["diff", "--archive", path, str(real / "in")], spark)
        run_cli(spark, real, "--mmsi", "257074900", "-")
        return capsys.readouterr().out

    before = asked()
    for _ in range(2):
        cli.main(["import", str(real / "in"), "--tag", "x", "--archive", path], spark)
    assert asked() == before and {name: sorted(map(str, archive.read_table(spark, path, name).collect())) for name in TABLES} == want
    cli.main(["import", str(real / "in"), "--tag", "later", "--archive", path], spark)
    assert {r["source_id"] for r in Query.for_time().between(*between).to_df(spark, path).collect()} == {"later"}
    files = archive.entries(spark, path)
    assert files.groupBy("table", "day").agg(F.count_distinct("run").alias("n")).agg(F.max("n")).first()[0] == 4
    open_before = Query.for_time().between(*between).to_df(spark, path)
    assert archive.compact(spark, path) == files.count()
    assert asked() == before and archive.entries(spark, path).groupBy("table", "day").count().agg(F.max("count")).first()[0] == 1
    assert archive.compact(spark, path) == 0 and open_before.count() == 44
    assert archive.vacuum(spark, path, 0) == 0 and archive.vacuum(spark, path, int(time.time() * 1000) + 60_000) == files.count()
    assert asked() == before
    cli.main(["compact", "--archive", path], spark)
    assert json.loads(capsys.readouterr().out) == {"replaced": 0, "snapshots": 0, "deleted": 0}
    with pytest.raises(SystemExit):
        cli.main(["generate", str(real / "in"), "--archive", path], spark)


def test_repeats_inside_one_write_and_rows_without_a_time(spark, tiny, tmp_path):
    rows = packets(spark, tiny).withColumn("time_ms", F.when(F.col("event_id") % 10 > 0, F.col("time_ms")))
    routing.write_tables(rows.union(rows), str(tmp_path / "a"))
    want = routing.fan_out(rows)
    for name in want:
        assert archive.read_table(spark, str(tmp_path / "a"), name).count() == want[name].count()
    routing.write_tables(rows.limit(0), str(tmp_path / "a"))
    assert archive.committed(spark, str(tmp_path / "a")).version == 1
    assert archive.read_table(spark, str(tmp_path / "nowhere"), "packets_time").count() == 0


def test_two_writers_both_count(spark, tiny, tmp_path, monkeypatch):
    """A writer that finds its version taken commits on top of it; many lists of entries become one."""
    path, rows = str(tmp_path / "a"), packets(spark, tiny)
    real, raced = archive.commit, []

    def late(session, where, new):
        if not raced:
            raced.append(True)
            routing.write_tables(rows.where("event_id % 2 = 0"), where, spread=1)
        real(session, where, new)

    monkeypatch.setattr(archive, "commit", late)
    monkeypatch.setattr(archive, "MOST_LISTS", 1)
    routing.write_tables(rows.where("event_id % 2 = 1"), path, spread=1)
    at = archive.committed(spark, path)
    assert at.version == 2 and len(at.entries) == 1
    assert archive.read_table(spark, path, "packets_time").count() == rows.count()
    with pytest.raises(archive.Taken):
        real(spark, path, archive.Commit(2))
    log = tmp_path / "a" / "_log"
    assert len(list((log / "commits").glob("*.json"))) == 2 and archive.vacuum(spark, path, 0) == 0
    assert archive.vacuum(spark, path, int(time.time() * 1000) + 60_000) == 0
    assert [x.name for x in (log / "commits").glob("*.json")] == ["000000000002.json"] and {x.name for x in log.iterdir()} == {"commits", *at.entries}
    assert archive.read_table(spark, path, "packets_time").count() == rows.count()


def test_a_vessel_is_read_from_its_files(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).selectExpr("id AS event_id", "CAST(1 + id % 500 AS INT) AS mmsi", "1 AS msgtype", "1704067200000 + id * 20000 AS time_ms", "CAST(id % 80 AS DOUBLE) AS lat", "0D AS lon", "CAST(id AS STRING) AS aisdata", "md5(CAST(id AS STRING)) AS digest")
    monkeypatch.setattr(archive, "_vessel_bit", lambda mmsi: F.pmod(mmsi, F.lit(archive.VESSEL_BITS)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:  # as a large run has it: files that AQE doesn't join
        for k, v in zip(kept, ("32", "false")):
            spark.conf.set(k, v)
        routing.write_tables(rows, str(tmp_path / "a"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    every, some = archive.files_for(spark, str(tmp_path / "a"), "packets_mmsi"), archive.files_for(spark, str(tmp_path / "a"), "packets_mmsi", vessels=[77])
    assert 6 <= every.count() <= 16 and some.count() == 1
    found = Query.for_mmsi(77).between(0, 1 << 60).to_df(spark, str(tmp_path / "a"))
    assert found.count() == 8 and len(found.inputFiles()) == some.count()
    north = Query.for_area((70.0, -1.0, 79.5, 1.0)).between(0, 1 << 60)
    assert north.to_df(spark, str(tmp_path / "a")).count() == rows.where("lat >= 70").count()
    hours = archive.time_ranges(spark, str(tmp_path / "a"), "packets_time", 1704067200000, 1704067200000 + 80_000_000, 1000)
    edges = [1704067200000, *hours, 1704067200000 + 80_000_000]
    assert len(hours) == 3 and all(4_000_000 < b - a < 40_000_000 for a, b in zip(edges, edges[1:]))  # estimates from the entries


def test_packets_without_a_vessel_are_dealt(spark):
    """Undecodable packets carry nothing and share no window."""
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, 5) AS mmsi", "id * 1000 AS time_ms", "CAST(id AS STRING) AS aisdata", "CAST(id AS STRING) AS digest", "IF(id % 3 = 1, 1.0D, NULL) AS lat", "IF(id % 3 = 1, 2.0D, NULL) AS lon")
    done = track.carry_forward(rows)
    assert done.where("mmsi = -1 AND carried_lat IS NOT NULL").count() == 0 and done.where("mmsi = 5 AND carried_lat IS NULL").count() == 0
    assert rows.repartition(4, *track.vessel()).where("mmsi = -1").select(F.spark_partition_id()).distinct().count() == 4


def encode(fields):
    bits = "".join(f"{v & ((1 << n) - 1):0{n}b}" for v, n in fields)
    bits += "0" * (-len(bits) % 6)
    return "".join(chr(v + 48 if v < 40 else v + 56) for v in (int(bits[i : i + 6], 2) for i in range(0, len(bits), 6)))


def test_packet_text(spark, tmp_path):
    payload = encode([(1, 6), (0, 2), (257074900, 30), (0, 4), (0, 8), (123, 10), (0, 1), (int(-10.5 * 600000), 28), (int(55.25 * 600000), 27), (900, 12), (0, 9), (0, 19), (0, 12)])
    tag, line = "$PGHP,1,2015,3,6,5,30,7,250,219,,2190047,,2D*5B", f"!BSVDM,1,1,,A,{payload},0*2D"
    (tmp_path / "a.txt").write_text(f"{tag}\n{line}\n!BSVDM,1,1,,A,1,0*00\nnoise\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("c.txt", f"{tag}\r\n{line}\r\n")
    rows = nmea.packets_of(nmea.read_lines(spark, str(tmp_path), tag="x")).collect()
    good = [r for r in rows if r["mmsi"]]
    assert len(rows) == 3 and len(good) == 2 and {r["source_id"] for r in rows} == {"x"}
    for r in good:
        assert (r["mmsi"], r["msgtype"], r["lat"], r["lon"], r["sog"], r["cog"]) == (257074900, 1, 55.25, -10.5, 123, 900)
        assert r["time_ms"] == params.instant_ms("2015-03-06T05:30:07.25Z") and r["source_country"] == "219" and r["base_station"] == "2190047"


def test_messages_of_several_sentences(spark, tmp_path):
    """A static report in two sentences, with another packet between them, is one packet; a lone part has no vessel."""
    static = encode([(5, 6), (0, 2), (219000123, 30), *[(k % 60, 6) for k in range(62)], (0, 14)])
    position = encode([(1, 6), (0, 2), (257074900, 30), (0, 4), (0, 8), (123, 10), (0, 1), (int(-10.5 * 600000), 28), (int(55.25 * 600000), 27), (900, 12), (0, 9), (0, 19), (0, 12)])
    tag = "$PGHP,1,2015,3,6,5,30,7,250,219,,2190047,,2D*5B"
    parts = [f"!BSVDM,2,{i},3,A,{p},{2 * (i - 1)}*00" for i, p in ((1, static[:58]), (2, static[58:]))]
    single = f"!BSVDM,1,1,,A,{position},0*2D"
    (tmp_path / "a.txt").write_text("\n".join([tag, parts[0], single, parts[1], parts[1], parts[0], tag, single, parts[0].replace(",3,A", ",4,B")]))
    rows = nmea.packets_of(nmea.read_lines(spark, str(tmp_path))).collect()
    whole = [r for r in rows if r["msgtype"] == 5]
    assert [(r["mmsi"], r["aisdata"], r["time_ms"]) for r in whole] == [(219000123, f"{tag}\n{parts[0]}\n{parts[1]}", params.instant_ms("2015-03-06T05:30:07.25Z"))]
    assert sorted(r["mmsi"] or 0 for r in rows) == [0, 0, 0, 219000123, 257074900, 257074900]


def as_messages(text):
    return sorted(map(str, nmea.messages(text)))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30))
def test_cut_lines_are_the_messages_of_the_whole(seed):
    """Tags, noise, messages of one to three sentences, nested, broken off, doubled; cut into splits anywhere."""
    draw = random.Random(seed)
    lines, parts = [], []
    for k in range(draw.randrange(1, 40)):
        what = draw.random()
        if what < 0.15:
            lines.append(draw.choice(["noise", "", "$XX,1", "x!BSVDM,1,1,,A,mid,0*00", "$PGHP,lone"]))
        elif what < 0.4:
            lines += [f"$PGHP,{k}"] * draw.randrange(2) + [f"{draw.choice(['', chr(92) + 'c:1*00' + chr(92)])}!BSVDM,1,1,,A,p{k},0*00"]
        elif what < 0.7 or not parts:
            total, number = draw.choice([2, 3]), draw.randrange(2)
            new = [(f"!BSVDM,{total},{i + 1},{number},{'AB'[k % 2]},q{k}.{i},0*00") for i in range(total)]
            parts += [([f"$PGHP,{k}.{i}"] if draw.random() < 0.4 else []) + [x] for i, x in enumerate(new)]
        for _ in range(draw.randrange(3)):
            if parts:
                lines += parts.pop(0 if draw.random() < 0.85 else draw.randrange(len(parts)))
    cuts = sorted(draw.randrange(len(lines) + 1) for _ in range(draw.randrange(5)))
    splits = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)])]
    sound, left = [], []
    for i, split in enumerate(splits):
        cut = nmea.Cut(whole=False)
        cut.first = i > 0
        for line in split:
            cut.add(line)
        cut.end()
        sound += nmea.messages("\n".join(cut.sound))
        left += cut.left
    last = nmea.Cut(whole=True)
    for line in left:
        last.add(line)
    last.end()
    joined = [m for text in ("\n".join(last.sound), *last.apart) for m in nmea.messages(text)]
    assert sorted(map(str, sound + joined)) == as_messages("\n".join(lines))


def test_a_file_is_read_by_many_tasks(spark, real):
    """Packets of one file in splits of a few lines are those of the whole."""
    want = sorted(map(str, nmea.packets_of(nmea.read_lines(spark, str(real / "in"))).drop("path").collect()))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("301", "1000"):
            for k, v in zip(kept, (size, "0")):
                spark.conf.set(k, v)
            lines = nmea.read_lines(spark, str(real / "in"))
            assert spark.read.text(str(real / "in")).rdd.getNumPartitions() > 4
            assert sorted(map(str, nmea.packets_of(lines).drop("path").collect())) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_decoding_reads_each_field_from_its_bits():
    """Random messages of every type against the bits read one by one; unreadable and short payloads give nulls."""
    draw, payloads = random.Random(6), [None, "", "1", "0000000", "55?MbV0\x7f00000000000000000000", "1" * 5]
    for kind in (1, 2, 3, 4, 5, 8, 9, 18, 19, 21, 24, 27) * 6:
        length = draw.choice([38, 96, 160, 168, 312, 424])
        payloads.append(encode([(kind, 6), (draw.randrange(4), 2), (draw.getrandbits(30), 30), (draw.randrange(2), 2), *((draw.getrandbits(6), 6) for _ in range((length - 40) // 6 + 1))]))
    got = {k: v.to_pylist() for k, v in nmea.decoded(payloads).items()}

    def bits_of(p):
        values = [ord(c) - (56 if ord(c) >= 96 else 48) for c in p or ""]
        return "".join(f"{v:06b}" for v in values) if all(48 <= ord(c) < 88 or 96 <= ord(c) < 120 for c in p or "") else ""

    def text(b):
        return "".join(SIX[int(b[i : i + 6], 2)] for i in range(0, len(b), 6)).split("@")[0].rstrip(" ") or None

    for k, p in enumerate(payloads):
        b = bits_of(p)
        kind = int(b[:6], 2) if len(b) >= 38 else None
        assert got["msgtype"][k] == kind and got["mmsi"][k] == (int(b[8:38], 2) if kind is not None else None)
        for name, places in [*nmea.NUMBERS.items(), *nmea.POSITIONS.items(), *nmea.TEXTS.items()]:
            want = None
            for types, start, length, *parts in places:
                if kind in types and len(b) >= start + length:
                    field = b[start : start + length]
                    value = int(field, 2)
                    want = text(field) if name in nmea.TEXTS else (value - (int(field[0]) << length)) / parts[0] if parts else value
            if kind == 24 and len(b) >= 160:
                which = int(b[38:40], 2)
                want = text(b[40:160]) if name == "name" and which == 0 else int(b[40:48], 2) if name == "shiptype" and which == 1 else text(b[90:132]) if name == "callsign" and which == 1 else want
            want = None if (name, want) in (("lat", 91.0), ("lon", 181.0), ("imo", 0)) else want
            assert got[name][k] == want, (name, kind, len(b))


SIX = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&'()*+,-./0123456789:;<=>?"


def text_bits(text, chars):
    return [(SIX.index(c), 6) for c in text.ljust(chars, "@")]


def position(kind, mmsi, lat, lon, sog=0, cog=0, hdg=511, navstat=0):
    if kind < 4:
        return encode([(kind, 6), (0, 2), (mmsi, 30), (navstat, 4), (0, 8), (sog, 10), (1, 1), (round(lon * 600_000), 28), (round(lat * 600_000), 27), (cog, 12), (hdg, 9), (0, 31)])
    return encode([(kind, 6), (0, 2), (mmsi, 30), (0, 8), (sog, 10), (1, 1), (round(lon * 600_000), 28), (round(lat * 600_000), 27), (cog, 12), (hdg, 9), (0, 35)])


def static(mmsi, imo, callsign, name, shiptype):
    return encode([(5, 6), (0, 2), (mmsi, 30), (0, 2), (imo, 30), *text_bits(callsign, 7), *text_bits(name, 20), (shiptype, 8), (0, 184)])


def tag(second, country="219", region="806", station="2190047"):
    return f"$PGHP,1,2015,3,6,5,{second // 60},{second % 60},0,{country},{region},{station},,2D*5B"


def sentences(payload, second, **more):
    if len(payload) <= 60:
        return f"{tag(second, **more)}\n!BSVDM,1,1,,A,{payload},0*00\n"
    return f"{tag(second, **more)}\n!BSVDM,2,1,{second % 10},A,{payload[:58]},0*00\n!BSVDM,2,2,{second % 10},A,{payload[58:]},2*00\n"


@pytest.fixture
def real(spark, tmp_path):
    """An archive of packet text: two vessels with static data, one without, and noise."""
    danish, norwegian = 219_000_123, 257_074_900
    text = sentences(static(danish, 9_074_729, "OXAB2", "HAMLET", 70), 0)
    text += sentences(encode([(24, 6), (0, 2), (norwegian, 30), (0, 2), *text_bits("NORD STAR", 20), (0, 8)]), 1, region="", station="")
    text += sentences(encode([(24, 6), (0, 2), (norwegian, 30), (1, 2), (36, 8), (0, 42), *text_bits("LKAA", 7), (0, 36)]), 2)
    for k in range(20):
        text += sentences(position(1, danish, 55.0 + k / 100, 10.0, 100 + k, 900, 91, 5), 10 + 30 * k)
        text += sentences(position(18, norwegian, 60.0, 5.0 + k / 100, 10, 10 * k), 11 + 30 * k, country="257")
    text += sentences(position(3, 503_000_001, -33.5, 151.25), 700) + "!BSVDM,1,1,,A,1,0*00\nnoise\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(text)
    cli.main(["import", str(tmp_path / "in"), "--tag", "x", "--archive", str(tmp_path / "archive")], spark)
    spark.createDataFrame([(219, "DNK", "DK"), (257, "NOR", "NO"), (503, "AUS", "AU")], "mid int, alpha3 string, alpha2 string").coalesce(1).write.csv(str(tmp_path / "mids"), header=True)
    return tmp_path


def test_static_reports(spark, real):
    rows = {(r["mmsi"], r["msgtype"], r["name"], r["callsign"], r["imo"], r["shiptype"]) for r in nmea.packets_of(nmea.read_lines(spark, str(real / "in"))).where("msgtype in (5, 24)").collect()}
    assert rows == {(219_000_123, 5, "HAMLET", "OXAB2", 9_074_729, 70), (257_074_900, 24, "NORD STAR", None, None, None), (257_074_900, 24, None, "LKAA", None, 36)}
    assert nmea.decodable(nmea.packets_of(nmea.read_lines(spark, str(real / "in")))).count() == 44


@pytest.mark.parametrize("text, n", [
    ("m.type=1", 20), ("m.type=18,3", 21), ("s.country=219", 24), ("s.country=257", 20), ("s.region=806", 43), ("s.bs=2190047 & m.mmsi=219000123", 21), ("s.id=x", 44),
    ("t.name=HAMLET", 21), ("t.name like h*", 21), ("t.cs=LKAA & m.type=18", 20), ("t.imo=9074729 & t.navstat=5", 20), ("t.type=36", 21), ("m.name like nord*", 1), ("m.imo=9074729", 1), ("m.cs=oxab2", 1), ("m.navstat=5", 20),
    ("t.pos within bbox(54,9,56,11)", 20), ("m.country=DNK", 21), ("m.country in (DK, no)", 43), ("t.country=AUS", 1), ("s.country=NOR", 20), ("s.country=DK,NO", 44), ("m.sog>=110 & m.cog=900", 10),
])
def test_filters_on_packets_from_text(spark, real, text, n):
    (when,) = (params.interval_ms("2015-03-06T05:00/2015-03-06T06:00"),)
    mids = spark.read.csv(str(real / "mids"), header=True)
    rows = Query.for_time().between(when[0] - 1, when[1]).where(text).to_df(spark, str(real / "archive"), mids)
    assert rows.count() == n and filters.is_valid(text)
    if "country" in text and text[0] != "s":
        with pytest.raises(filters.FilterError):
            Query.for_time().between(*when).where(text).to_df(spark, str(real / "archive"))


def run_cli(spark, real, *more):
    cli.main(["export", "--archive", str(real / "archive"), "--interval", "2015-03-06T04:59:59/2015-03-06T06:00", *more], spark)


def lines_of(spark, path):
    return [r["value"] for r in spark.read.text(str(path)).collect()]


def test_operators_on_packets_from_text(spark, real, capsys):
    between = params.interval_ms("2015-03-06T04:59:59/2015-03-06T06:00")
    rows = Query.for_mmsi(219_000_123).between(*between).to_df(spark, str(real / "archive"))
    assert track.past_track(rows, 219_000_123, *between, filters.compile_filter("s.region=806", only="s")).count() == 20
    assert [(r["time_ms"], r["lat"]) for r in track.last_positions(rows).collect()] == [(params.instant_ms("2015-03-06T05:09:40Z"), 55.19)]
    with_c = track.with_countries(rows, spark.read.csv(str(real / "mids"), header=True)).orderBy("time_ms")
    first, second = (json.loads(r["json"]) for r in track.track_json(with_c).take(2))
    assert first["src.cty"] == "DK" and first["lat"] is None and (second["src.clk"], second["src.id"], second["src.reg"]) == (params.instant_ms("2015-03-06T05:00:10Z"), 2190047, "806")
    assert (second["lat"], second["lon"], second["acc"], second["hdg"], second["sog"], second["cog"]) == (55.0, 10.0, 1, 91, 10.0, 90.0)
    assert list(second) == ["src.clk", "src.id", "src.reg", "src.cty", "lat", "lon", "acc", "hdg", "sog", "cog"]
    assert json.loads(track.source_json(with_c).first()["json"]) == {"country": "DK", "bs": "2190047", "id": "x", "region": "806"}
    blank = Query.for_mmsi(257_074_900).between(*between).to_df(spark, str(real / "archive")).where("region is null")
    assert [json.loads(r["json"]) for r in track.source_json(blank).collect()] == [{"id": "x"}]
    untagged = track.track_json(rows.withColumn("time_ms", F.lit(None).cast("long"))).first()["json"]
    assert untagged.startswith('{"lat"')
    run_cli(spark, real, "--min-duration", "PT2M", "--filter", "m.type=1", "--output-format", "table", "--columns", "time_ms", "-")
    assert len(capsys.readouterr().out.split()) == 5
    run_cli(spark, real, "--mmsi", "219000123", "--min-distance", "3000", "--output-format", "table", "--columns", "lat")
    assert len(capsys.readouterr().out.split()) == 7
    same = track.drop_repeats_within(rows.union(rows.withColumn("time_ms", F.col("time_ms") + 5)), 5)
    assert same.count() == 21


def test_exports(spark, real, capsys):
    """Each format says what it should, and a resumed export ends as one that ran through."""
    for kind in sinks.SINKS:
        run_cli(spark, real, "--mmsi", "257074900", "--output-format", kind, "--columns", "mmsi;name", str(real / kind))
    assert capsys.readouterr().out.split() == ["22", "packets"] * len(sinks.SINKS)
    raw = "\n".join(lines_of(spark, real / "raw"))
    assert raw.count("$PGHP") == 22 and raw.count("!BSVDM") == 22
    assert all(json.loads(x)["mmsi"] == 257_074_900 for x in lines_of(spark, real / "json"))
    assert Counter(lines_of(spark, real / "jsonObject")) == Counter({'{"mmsi":257074900}': 21, '{"mmsi":257074900,"name":"NORD STAR"}': 1})
    assert Counter(lines_of(spark, real / "table")) == Counter({"mmsi,name": 1, "257074900,": 21, "257074900,NORD STAR": 1})
    assert Counter(lines_of(spark, real / "html")) == Counter({"<tr><td>257074900</td><td></td></tr>": 21, "<tr><td>257074900</td><td>NORD STAR</td></tr>": 1})
    stamped = lines_of(spark, real / "prefixed_sentences")
    assert sum(x.startswith("2015-03-06T05:0") for x in stamped) == 22 and stamped[0].split(" ", 1)[1].startswith("$PGHP")
    run_cli(spark, real, "--mmsi", "257074900", "--output-format", "kmz", str(real / "t.kmz"))
    with zipfile.ZipFile(real / "t.kmz") as z:
        document = ElementTree.fromstring(z.read("doc.kml"))
    (line,) = document.iter("{http://www.opengis.net/kml/2.2}coordinates")
    assert line.text.split() == [f"{5 + k / 100:.6f},60.000000" for k in range(20)]
    rows = Query.for_mmsi(257_074_900).between(*params.interval_ms("2015-03-06/P1D")).to_df(spark, str(real / "archive"))
    assert sinks.export(rows, str(real / "foot"), footer=True) == 22 and lines_of(spark, real / "foot" / "_footer") == ["22 packets"]
    half, whole = (Query.for_time().between(*params.interval_ms(f"2015-03-06T05:00/{end}")) for end in ("2015-03-06T05:05", "2015-03-06T06:00"))
    first, then = (sinks.resumed_export(q, spark, str(real / "archive"), str(real / "again")) for q in (half, whole))
    assert first["packageCount"] < then["packageCount"] == whole.to_df(spark, str(real / "archive")).count() and then["timestamp"] == params.instant_ms("2015-03-06T05:11:40Z")
    assert Counter(lines_of(spark, f"{real / 'again'}/chunk=*")) == Counter(x for r in whole.to_df(spark, str(real / "archive")).collect() for x in r["aisdata"].split("\n"))
    assert sinks.resumed_export(whole, spark, str(real / "archive"), str(real / "again"))["packageCount"] == then["packageCount"]
    assert sinks.resumed_export(half, spark, str(real / "archive"), str(real / "again"), force=True) == first | {"filename": str(real / "again")}
    with pytest.raises(ValueError):
        sinks.export(rows, str(real / "no"), "nope")


def test_killed_export_goes_on(spark, tiny, tmp_path):
    """A run that is killed in a chunk leaves those before it and no packet twice; progress rises to its end."""
    path, out = str(tmp_path / "archive"), str(tmp_path / "out")
    routing.write_tables(packets(spark, tiny), path)
    t0, t1 = params.interval_ms("2024-01-05T00:00/2024-01-12T12:30")
    query, told = Query.for_time().between(t0, t1), []

    class Killed(Exception):
        pass

    def watch(c):
        told.append(c)
        if len(told) == 3:
            # The next chunk has begun, half of it is there, and the run ends.
            (tmp_path / "out" / "chunk=000003").mkdir()
            (tmp_path / "out" / "chunk=000003" / "part-0.txt").write_text("half a chunk\n")
            raise Killed

    with pytest.raises(Killed):
        sinks.resumed_export(query, spark, path, out, watch=watch)
    assert json.loads(lines_of(spark, f"{out}/_meta")[0])["packageCount"] == told[-1]["packageCount"] < query.to_df(spark, path).count()
    done = sinks.resumed_export(query, spark, path, out, watch=told.append)
    assert sorted(lines_of(spark, f"{out}/chunk=*")) == sorted(r["aisdata"] for r in query.to_df(spark, path).collect())
    assert [c["chunk"] for c in told] == list(range(8)) and [c["from"] for c in told[1:]] == [c["to"] for c in told[:-1]] and told[-1]["percent"] == 100.0
    assert all(a["percent"] < b["percent"] for a, b in zip(told, told[1:])) and told[-1]["eta"] is not None and done["packageCount"] == told[-1]["packageCount"]
    assert sinks.resumed_export(query, spark, path, out) == done
    assert sinks.resumed_export(query.first(10), spark, path, out, force=True)["packageCount"] == 10


def test_targets_are_known_from_before(spark, real):
    """An hour, or a place, with a filter on targets is that part of the whole; a snapshot changes nothing, and one that a late packet makes stale isn't used."""
    path, day = str(real / "archive"), params.instant_ms("2015-03-06") // 86_400_000
    later = "".join(sentences(position(1, m, lat, 10.0), 0).replace("2015,3,6,5", f"2015,3,{d},7") for d in (9, 20) for m, lat in ((219_000_123, 56.0), (257_074_900, 61.0)))
    (real / "later").mkdir()
    (real / "later" / "b.txt").write_text(later)
    cli.main(["import", str(real / "later"), "--archive", path], spark)
    hour = Query.for_time().between(*params.interval_ms("2015-03-09T06:30/2015-03-09T07:30"))
    found = lambda q: sorted(r["mmsi"] for r in q.to_df(spark, path).collect())
    asked = [(hour.where("t.name=HAMLET"), [219_000_123]), (hour.where("t.cs=LKAA | t.imo=9074729"), [219_000_123, 257_074_900]), (hour.where("t.lat>60.5"), [257_074_900])]
    asked += [(Query.for_area((55.5, 9.5, 56.5, 10.5)).between(*hour.interval).where("t.type=70"), [219_000_123]), (Query.for_mmsi(257_074_900).between(*hour.interval).where("t.name=HAMLET"), [])]
    assert [found(q) for q, _ in asked] == [w for _, w in asked]
    archive.take_snapshot(spark, path, day)
    assert archive.targets_before(spark, path, *hour.interval).count() == 3 + 2 and [found(q) for q, _ in asked] == [w for _, w in asked]
    (real / "late").mkdir()
    (real / "late" / "c.txt").write_text(sentences(static(219_000_123, 9_074_729, "OXAB2", "OTHELLO", 70), 3599))
    cli.main(["import", str(real / "late"), "--archive", path], spark)
    assert found(hour.where("t.name=OTHELLO")) == [219_000_123] and found(hour.where("t.name=HAMLET")) == []
    assert archive.take_snapshots(spark, path, every=3) == [d for d in range(day // 3 * 3, day + 14, 3) if d >= day]
    assert archive.take_snapshots(spark, path, every=3) == [] and found(hour.where("t.name=OTHELLO")) == [219_000_123]
    day20 = Query.for_time().between(*params.interval_ms("2015-03-20/P1D")).where("t.name=OTHELLO")
    assert found(day20) == [219_000_123] and archive.targets_before(spark, path, *day20.interval).count() <= 3 + 2


def test_backup_files_are_taken_or_set_aside(spark, real, tmp_path):
    folder = tmp_path / "backup"
    folder.mkdir()
    with zipfile.ZipFile(folder / "good.zip", "w") as z:
        z.writestr("a.txt", (real / "in" / "a.txt").read_text())
    (folder / "bad.zip").write_bytes(b"PK no zip")
    taken = []
    assert ingest.replay_files(spark, str(folder), lambda p: taken.append(p.count())) == {"taken": 1, "unreadable": 1}
    assert taken == [45] and sorted(x.name for x in folder.iterdir()) == ["bad.zip.unreadable"]
    assert ingest.replay_files(spark, str(folder), lambda p: taken.append(p.count())) == {"taken": 0, "unreadable": 0} and len(taken) == 1


def test_backup_files_wait_for_an_idle_stream(spark, real, tmp_path, monkeypatch, caplog):
    """While the stream's batches are full no file is taken; then files go step by step, with a rest, and one that can't be stored is set aside."""
    source, folder, out, full = tmp_path / "lines", tmp_path / "backup", str(tmp_path / "out"), 4
    source.mkdir()
    folder.mkdir()
    text = (real / "in" / "a.txt").read_text()
    for name in ("a", "b", "poison", "z"):
        with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
            z.writestr("a.txt", text)
    (folder / "poison.zip.unreadable").write_text("an earlier one")
    for k in range(4):
        (source / f"{k}.txt").write_text("\n".join(map(str, range(full if k < 3 else 1))))
    seen, taken = [], []

    def run(batch, number):
        seen.append((batch.count(), len(list(folder.glob("*.zip")))))

    lines = spark.readStream.option("maxFilesPerTrigger", 1).option("latestFirst", "false").text(str(source))
    for k in range(4):
        os.utime(source / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    live = ingest.started(lines, str(tmp_path / "cp"), run, processingTime="1 second")
    calls, real_files = [], ingest.replay_files

    def files(spark, folder, store, glob, step, size):
        calls.append((step, live.lastProgress["numInputRows"] if live.lastProgress else 0))
        if len(taken) == 3:
            live.stop()
        return real_files(spark, folder, store, glob, step, size)

    def store(rows):
        left = sorted(x.stem for x in folder.glob("*.zip"))
        if left[0] == "poison":
            raise RuntimeError("no such table")
        routing.write_tables(rows, out)
        taken.append(left[0])

    monkeypatch.setattr(ingest, "replay_files", files)
    try:
        told = ingest.replay_when_idle(spark, live, str(folder), store, batch_rows=full, step_files=2, step_bytes=1, rest_s=0.1, look_s=0.1)
    finally:
        live.stop()
    assert told == {"taken": 3, "unreadable": 1} and taken == ["a", "b", "z"]
    assert sorted(x.name for x in folder.iterdir()) == ["poison.zip.unreadable", "poison.zip.unreadable1"]
    assert all(rows < full for _, rows in calls) and [rows for rows, _ in seen] == [4, 4, 4, 1] and {step for step, _ in calls[:2]} == {2}
    assert all(files == 4 for rows, files in seen[1:3])
    timed = nmea.packets_of(nmea.read_lines(spark, str(real / "in" / "a.txt"))).where("time_ms > 0").count()
    assert "were not stored" in caplog.text and archive.read_table(spark, out, "packets_time").count() == timed


def test_an_idle_stream_has_less_than_a_batch():
    class Stream:
        def __init__(self, rows, active):
            self.lastProgress, self.status = None if rows is None else {"numInputRows": rows}, {"isTriggerActive": active}

    assert [ingest.is_idle(Stream(*x), 10) for x in ((None, True), (None, False), (10, False), (9, True), (0, False))] == [False, True, False, True, True]


def test_live_sources_are_archived(spark, tmp_path):
    """Lines of two sockets, with and without a time of their own, end in the tables under their group's name."""
    noted = [f"\\s:x,c:{1_425_618_000 + k}*00\\!BSVDM,1,1,,A,{position(1, 219_000_123, 55.0, 10.0 + k)},0*00" for k in range(3)]
    bare = [f"!BSVDM,1,1,,A,{position(18, 257_074_900, 60.0, 5.0)},0*00", "noise"]
    servers = [socket.create_server(("localhost", 0)) for _ in range(2)]

    def serve(server, lines):
        peer, _ = server.accept()
        with peer:
            peer.sendall(("\n".join(lines) + "\n").encode())
            done.wait(90)

    done = threading.Event()
    threads = [threading.Thread(target=serve, args=x, daemon=True) for x in zip(servers, (noted, bare))]
    for t in threads:
        t.start()
    group = {"north": [("localhost", x.getsockname()[1]) for x in servers]}
    query = ingest.archive(ingest.live_packets(spark, group), str(tmp_path / "out"), str(tmp_path / "cp"), processingTime="1 second")
    try:
        began, rows = time.monotonic(), []
        while len(rows) < 4 and time.monotonic() - began < 90:
            time.sleep(1)
            if archive.committed(spark, str(tmp_path / "out")).version:
                rows = archive.read_table(spark, str(tmp_path / "out"), "packets_mmsi").collect()
    finally:
        done.set()
        query.stop()
    assert sorted((r["mmsi"], r["lon"]) for r in rows) == [(219_000_123, 10.0), (219_000_123, 11.0), (219_000_123, 12.0), (257_074_900, 5.0)]
    assert {r["time_ms"] for r in rows if r["mmsi"] == 219_000_123} == {1_425_618_000_000 + 1000 * k for k in range(3)} and all(r["time_ms"] for r in rows)
    assert {(r["source_id"], r["source_type"]) for r in rows} == {("north", "LIVE")}


def test_logged_lines_are_archived_once(spark, tmp_path, monkeypatch):
    """Tags and messages across files and batches are whole; a query that is killed and started again loses and doubles nothing."""
    log, out, cp = tmp_path / "log" / "north", str(tmp_path / "out"), str(tmp_path / "cp")
    log.mkdir(parents=True)
    whole = sentences(static(219_000_123, 9_074_729, "OXAB2", "HAMLET", 70), 3)
    one, two = whole.split("!BSVDM,2,2")
    files = [
        sentences(position(1, 219_000_123, 55.0, 10.0), 0) + one,
        sentences(position(18, 257_074_900, 60.0, 5.0), 4) + tag(9) + "\n",
        f"!BSVDM,1,1,,A,{position(3, 503_000_001, -33.5, 151.25)},0*00\n!BSVDM,2,2{two}" + "!BSVDM,2,1,8,B,55,0*00\n",
        "noise\n" + sentences(position(1, 219_000_123, 55.5, 10.0), 20),
    ]

    def take(**more):
        ingest.archive_log(spark, str(tmp_path / "log"), out, cp, files_per_batch=1, **more).awaitTermination()
        return sorted((r["mmsi"], r["msgtype"], r["name"], (r["time_ms"] - params.instant_ms("2015-03-06T05:00")) // 1000) for r in archive.read_table(spark, out, "packets_mmsi").collect())

    for k in (0, 1):
        (log / f"{k}.txt").write_text(files[k])
        os.utime(log / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    assert take() == [(219_000_123, 1, None, 0), (257_074_900, 18, None, 4)]
    (log / "2.txt").write_text(files[2])
    failed = []

    def fails(*_):
        failed.append(True)
        raise RuntimeError("killed when the batch had been stored")

    with monkeypatch.context() as m:
        m.setattr(ingest, "_forget", fails)
        with pytest.raises(Exception, match="killed"):
            take()
    assert failed
    want = [(219_000_123, 1, None, 0), (219_000_123, 5, "HAMLET", 3), (257_074_900, 18, None, 4), (503_000_001, 3, None, 9)]
    assert take() == want
    (log / "3.txt").write_text(files[3])
    assert take(limit_ms=0) == sorted([*want, (219_000_123, 1, None, 20)])
    lone = archive.read_table(spark, out, "packets_time").where("mmsi = -1").collect()
    assert [r["aisdata"] for r in lone] == ["!BSVDM,2,1,8,B,55,0*00"] and {r["source_id"] for r in lone} == {"north"}
    backup = tmp_path / "backup"
    backup.mkdir()
    with zipfile.ZipFile(backup / "1.zip", "w") as z:
        z.writestr("a.txt", sentences(position(1, 338_000_001, 40.0, -70.0), 30))
    (backup / "2.zip").write_bytes(b"no zip")
    cli.main(["archive", "--log", str(tmp_path / "log"), "--once", "--archive", out, "--checkpoint", cp, "--backup", str(backup)], spark)
    assert [x.name for x in backup.iterdir()] == ["2.zip.unreadable"]
    assert sum(r["mmsi"] == 338_000_001 for r in archive.read_table(spark, out, "packets_mmsi").collect()) == 1


def test_failed_batches_are_logged_and_kept(spark, tiny, tmp_path, caplog):
    def fails(batch, number):
        raise ValueError("no room")

    from fairlead.sources.testdata import packets_of

    spark.read.parquet(f"{tiny}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = packets_of(ingest.read_events(spark, str(tmp_path / "in")))
    ingest.archive(stream, str(tmp_path / "out"), str(tmp_path / "cp"), how={"handlers": (fails,)}).awaitTermination()
    assert "no room" in caplog.text and "was not stored" in caplog.text
    assert ingest.replay(spark, str(tmp_path / "out")).count() == packets(spark, tiny).count()


def test_reports_of_files_and_writes(spark, real):
    files = reports.files_of(spark, str(real / "in"))
    assert [(r["name"], r["complete"]) for r in reports.repository(files).collect()] == [("a.txt", True)] and files.first()["size"] > 1000
    assert reports.is_empty(reports.files_of(spark, str(real / "nowhere"))) and not reports.is_empty(files)
    seen = reports.Ingest()
    seen.watch(nmea.packets_of(nmea.read_lines(spark, str(real / "in")))).write.format("noop").mode("overwrite").save()
    assert (seen.report()["packets"], seen.report()["decoded"]) == (45, 44) and seen.report()["per_second"] > 0
    assert reports.eta_ms(25.0, 0, 1000) == 4000 and reports.eta_ms(0.0, 0, 5) is None and reports.eta_ms(100.0, 0, 7) == 7
    (real / "in" / "deep" / "er").mkdir(parents=True)
    (real / "in" / "deep" / "er" / "b.txt").write_text("x")
    (real / "in" / "full").mkdir()
    (real / "in" / "full" / "young.txt").write_text("x")
    os.utime(real / "in" / "full" / "young.txt", (2_000_000_000, 2_000_000_000))
    now = max(r["updated"] for r in files.collect()) + 60_000
    assert reports.clean_up(spark, str(real / "in"), now + 1000) == 0 and reports.clean_up(spark, str(real / "in"), now + 5 * 3_600_000) == 2
    assert sorted(x.name for x in (real / "in").iterdir()) == ["full"]


def test_requests():
    between = params.interval_ms("2015-01-05T06:00/PT1H")
    text = params.request(between, "m.country=DNK & t.name like H*", [1, 2], (40.0, -10.0, 60.12345, 20.0), output="table", columns="lat;lon", noHeader=True, limit=None)
    assert text == "interval=2015-01-05T06:00:00Z/2015-01-05T07:00:00Z&filter=m.country%3DDNK%20%26%20t.name%20like%20H*&mmsi=1&mmsi=2&box=60.123,-10.000,40.000,20.000&output=table&columns=lat;lon&noHeader"
    assert params.ending_now("PT1H", 10_000_000) == (6_400_000, 10_000_000)


def test_stream_equals_batch(spark, tiny, tmp_path):
    rows = spark.read.parquet(f"{tiny}/events.parquet").orderBy("ts")
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from fairlead.sources.testdata import packets_of

    stream = ingest.without_replays(packets_of(ingest.read_events(spark, str(tmp_path / "in"), files_per_batch=100)))
    ingest.archive(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = routing.fan_out(packets(spark, tiny))
    for name in ("packets_time", "packets_mmsi", "packets_area_cell1", "packets_area_unknown"):
        assert archive.read_table(spark, str(tmp_path / "out"), name).count() == want[name].count()
    assert ingest.source_group("a=h:1,i:2") == ("a", [("h", 1), ("i", 2)])


def test_stream_of_small_batches_equals_batch(spark, tiny, tmp_path):
    """Carried positions cross batches; a late file is stored too, and a file sent again is taken once."""
    from fairlead.sources.testdata import packets_of

    rows = spark.read.parquet(f"{tiny}/events.parquet").withColumn("user_id", F.col("event_id") % 2 + 1).withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, event_id)"))
    # In order but for the earliest rows, which come last, a day late; part of the first file comes again.
    early = rows.where("event_id < 100").withColumn("ts", F.expr("ts - INTERVAL '1' DAY"))
    files = [rows.where("event_id >= 100 AND event_id < 400"), rows.where("event_id >= 400 AND event_id < 700"), rows.where("event_id >= 700"), rows.where("event_id >= 100 AND event_id < 200"), early]
    for i, part in enumerate(files):
        part.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (file,) = (tmp_path / f"w{i}").glob("part-*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{i}.parquet"
        file.rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = ingest.without_replays(packets_of(ingest.read_events(spark, str(tmp_path / "in"), files_per_batch=1)))
    ingest.archive(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = routing.fan_out(packets_of(rows.where("event_id >= 100").union(early)))
    for name in ("packets_time", "packets_mmsi", "packets_area_cell1", "packets_area_unknown"):
        got = sorted(r["digest"] for r in archive.read_table(spark, str(tmp_path / "out"), name).collect())
        assert got == sorted(r["digest"] for r in want[name].collect()), name


def test_kept_positions_follow_the_batch(spark, tmp_path):
    """However packets are cut into batches, and late by hours, they get what one window over all that has come by then gives; what is kept is two days,
    and each batch writes its own alone."""
    rows = spark.range(3000).selectExpr("id AS event_id", "CAST(id % 7 AS INT) AS mmsi", "1704067200000 + id * 120000 + (id * 7919) % 900000 AS time_ms", "IF(id % 3 = 0, CAST(id % 80 AS DOUBLE), NULL) AS lat", "IF(id % 3 = 0, 1.0D, NULL) AS lon", "CAST(id AS STRING) AS aisdata", "md5(CAST(id AS STRING)) AS digest")
    rows = rows.withColumn("mmsi", F.when(F.col("event_id") % 100 == 7, -1).when((F.col("event_id") > 500) & (F.col("mmsi") == 3), 4).otherwise(F.col("mmsi")))
    parts = [f"event_id BETWEEN {a} AND {b - 1}" for a, b in ((0, 400), (500, 900), (400, 500), (900, 901), (901, 1700), (1750, 3000), (1700, 1750))]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        rows.where(part).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (file,) = (tmp_path / f"w{i}").glob("part-*.parquet")
        file.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got, sizes = {}, []

    def store(batch, number):
        got.update({r["event_id"]: (r["carried_lat"], r["carried_lon"]) for r in batch.collect()})
        sizes.append({x: len(list(x.glob("batch=*/*.parquet"))) for x in (tmp_path / "cp" / "positions").glob("hour=*")})

    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.carry_positions(source, str(tmp_path / "cp"), store, keep_ms=48 * 3_600_000).awaitTermination()
    known, want = [], {}
    for part in parts:
        new = rows.where(part).collect()
        known += [r for r in new if r["lat"] is not None]
        for r in new:
            near = [x for x in (known if r["mmsi"] != -1 else [r]) if x["lat"] is not None and x["mmsi"] == r["mmsi"] and r["time_ms"] - 1_200_000 <= x["time_ms"] <= r["time_ms"]]
            best = max(near, key=lambda x: (x["time_ms"], x["digest"]), default=None)
            want[r["event_id"]] = (best["lat"], best["lon"]) if best else (None, None)
    assert got == want and len({x for x in want.values()}) > 50 and len(sizes) == len(parts)
    hours = sorted(int(x.name.removeprefix("hour=")) for x in (tmp_path / "cp" / "positions").glob("hour=*"))
    assert 48 <= hours[-1] - hours[0] + 1 <= 50 and max(len(x) for x in sizes) <= 50 + 42
    kept = spark.read.parquet(str(tmp_path / "cp" / "positions"))
    assert kept.groupBy("mmsi", "time_ms", "digest").count().where("count > 1").count() == 0 and kept.where("mmsi IN (3, -1)").count() == 0


def test_carrying_query_reads_a_table_of_many_files(spark, tiny, tmp_path):
    from fairlead import queries

    spark.read.parquet(f"{tiny}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, queries.stream_carry_forward(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, queries.carry_forward_position(spark, tiny).collect()), key=str)


def test_zip_helper_is_bytes():
    assert zipfile.is_zipfile(io.BytesIO(b"x")) is False


def test_library_stands_without_its_optional_part(tmp_path):
    """Without the subpackage and the pipeline the entry module imports and offers the other queries; a fault inside them is no absence."""
    root = Path(__file__).parent.parent
    for name in ("fairlead", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    ask = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    shutil.rmtree(tmp_path / "fairlead" / "llm", ignore_errors=True)
    from fairlead import queries

    assert run().stdout.split() == [str(len(queries.QUERIES)), "False", "True"]
    (tmp_path / "fairlead" / "llm").mkdir()
    (tmp_path / "fairlead" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr


def test_packet_text_is_made_by_arrow_batches(spark):
    """Payloads are made a batch at a time and not by expressions for each letter; fields keep their places, signs and nulls."""
    events = spark.sql("""SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'1969-12-31 23:59:59', -1L, 'view', 1D, '{}'), (7L, TIMESTAMP_NTZ'2024-01-01', NULL, 'signup', 1D, 'x'),
        (13L, TIMESTAMP_NTZ'2024-01-01', 987654321L, 'signup', 1D, 'x'), (11L, TIMESTAMP_NTZ'2024-01-01', 5L, 'error', 1D, 'x') AS t(event_id, ts, user_id, event_type, value, props)""")
    made = testdata.as_text(events)
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    got = {r["path"]: r["text"] for r in made.collect()}
    assert got["7"] is None and len(got["11"].split(",")[-2]) == 9
    back = {r["path"]: r for r in nmea.packets_of(made.where("text is not null")).collect()}
    assert [(back["13"][c]) for c in ("msgtype", "mmsi", "imo", "name", "callsign", "shiptype")] == [5, 987654321, 9000013, "SHIP 13", "CS13", 33]
    own = {str(r["event_id"]): r for r in testdata.packets_of(events).collect()}
    assert all(abs(back["1"][c] - own["1"][c]) < 1e-6 for c in ("lat", "lon")) and back["1"]["mmsi"] == (1 << 30) - 1


def test_log_files_follow_the_events(spark):
    """A task that writes a log has a bounded share of the events; small tables still make several batches."""
    assert [queries.log_parts(spark.range(n), most=1000) for n in (0, 4000, 4001, 60_000)] == [4, 4, 5, 60]


def test_compaction_deals_rows_once(spark, tiny, tmp_path, monkeypatch):
    """Repeats are told apart by the sort of the files, without a shuffle of their own before it; the latest run's row stays."""
    path = str(tmp_path)
    rows = packets(spark, tiny).limit(50)
    for name in ("ZZ", "AA"):
        routing.write_tables(rows.withColumn("name", F.lit(name)), path)
    monkeypatch.setattr(archive, "latest_only", None)
    assert archive.compact(spark, path) > 0
    got = archive.read_table(spark, path, "packets_time").groupBy("name").count().collect()
    assert [tuple(r) for r in got] == [("AA", 50)]
