"""Range, identity and area queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.exprs import timeblocks
from fairlead.functions.filters import FIELDS, WITH_COUNTRIES, compile_filter, fields_in
from fairlead.operators.routing import by_primary_key
from fairlead.operators.track import drop_repeats_within, thin, with_countries, with_targets
from fairlead.schema import TABLES
from fairlead.sources import archive


def cells_of(box: Box, degrees: int = 1) -> list[int]:
    """Ids of all cells that a (south, west, north, east) box meets."""
    south, west, north, east = box
    rows = range(int(south // degrees), int(north // degrees) + 1)
    columns = range(int((west + 180) // degrees), int((east + 180) // degrees) + 1)
    return [r * (360 // degrees) + c for r in rows for c in columns]


def in_cells(box: Box, degrees: int = 1) -> Column:
    """Rows whose ``cellid`` is one of ``cells_of``, as ranges of rows and columns: short for any box, with a range that prunes files."""
    south, west, north, east = box
    wide, cell = 360 // degrees, F.col("cellid")
    r0, r1, c0, c1 = int(south // degrees), int(north // degrees), int((west + 180) // degrees), int((east + 180) // degrees)
    return cell.between(r0 * wide + c0, r1 * wide + c1) & F.pmod(cell, F.lit(wide)).between(c0, min(c1, wide - 1)) if c1 < wide else _past_the_edge(cell, r0, r1, c0, c1, wide)


def _past_the_edge(cell: Column, r0: int, r1: int, c0: int, c1: int, wide: int) -> Column:
    """A box that reaches 180 degrees east: column ``wide`` is the first of the next row, as the cell rule numbers it."""
    inner, over = F.pmod(cell, F.lit(wide)).between(c0, wide - 1), F.pmod(cell - wide, F.lit(wide)) + wide <= c1
    return (cell.between(r0 * wide + c0, r1 * wide + wide - 1) & inner) | (cell.between((r0 + 1) * wide, r1 * wide + c1) & over)


Box = tuple[float, float, float, float]


def inner_cells(box: Box) -> tuple[int, int, int, int] | None:
    """First and last row, first and last column of the ten-degree cells that lie whole inside the one-degree cells of a box; none if there are none."""
    south, west, north, east = box
    rows, columns = (int(south // 1), int(north // 1)), (int((west + 180) // 1), min(359, int((east + 180) // 1)))
    (r0, r1), (c0, c1) = ((-(-a // 10), (b + 1) // 10 - 1) for a, b in (rows, columns))
    return (r0, r1, c0, c1) if r0 <= r1 and c0 <= c1 else None


def _within(cell: Column, wide: int, r0: int, r1: int, c0: int, c1: int) -> Column:
    return cell.between(r0 * wide + c0, r1 * wide + c1) & F.pmod(cell, F.lit(wide)).between(c0, c1)


@dataclass(frozen=True)
class Query:
    """Immutable builder; ``to_df`` gives a lazy DataFrame with block, key and time predicates for pruning.

    The interval is open at both ends unless ``include_start``. An area query returns all packets of the cells it
    meets; ``exact`` also tests the box. A vessel named twice comes twice. An area over the date line is two boxes.
    """

    kind: str
    mmsi: tuple[int, ...] = ()
    box: Box | None = None
    interval: tuple[int, int] | None = None
    cell10: bool = False
    exact: bool = False
    include_start: bool = False
    filter: str | None = None
    after_ms: int | None = None
    limit: int | None = None
    min_ms: int | None = None
    min_m: float | None = None
    repeats_ms: int | None = None
    unrepeated: bool = False
    mixed: bool = False
    beyond: Box | None = None

    @staticmethod
    def for_time() -> Query:
        return Query("time")

    @staticmethod
    def for_mmsi(*mmsi: int) -> Query:
        if not mmsi:
            raise ValueError("name at least one mmsi")
        return Query("mmsi", mmsi=mmsi)

    @staticmethod
    def for_area(box: Box, cell10: bool = False, exact: bool = False, mixed: bool = False, wrap: bool = False) -> Query:
        """Two corners of a box, in any order. ``wrap``: from the first one's longitude eastwards to the second's, over the date line if that is less.

        ``mixed`` takes whole ten-degree cells from their table, and of the one-degree cells only those at the edge: the packets of the
        one-degree cells, by fewer cells.
        """
        if box is None:
            raise ValueError("an area query needs a box")
        a, b, c, d = box
        south, north = min(a, c), max(a, c)
        if wrap and b > d:
            return Query("area", box=(south, b, north, 180.0), beyond=(south, -180.0, north, d), cell10=cell10, exact=exact, mixed=mixed)
        return Query("area", box=(south, min(b, d), north, max(b, d)), cell10=cell10, exact=exact, mixed=mixed)

    def boxes(self) -> list[Box]:
        return [self.box] if self.beyond is None else [self.box, self.beyond]

    @staticmethod
    def choose(mmsi: list[int] | None = None, box=None) -> Query:
        """Vessels before area before time."""
        return Query.for_mmsi(*mmsi) if mmsi else Query.for_area(box) if box else Query.for_time()

    def between(self, t0_ms: int, t1_ms: int, include_start: bool = False) -> Query:
        return replace(self, interval=(t0_ms, t1_ms), include_start=include_start)

    def where(self, text: str | None) -> Query:
        return replace(self, filter=text)

    def resume_after(self, last_ms: int | None) -> Query:
        return replace(self, after_ms=last_ms)

    def first(self, n: int | None) -> Query:
        return replace(self, limit=n)

    def thinned(self, min_ms: int | None = None, min_m: float | None = None, repeats_ms: int | None = None) -> Query:
        """Packets of a vessel at least so far apart in time and place, without repeats inside ``repeats_ms``."""
        return replace(self, min_ms=min_ms, min_m=min_m, repeats_ms=repeats_ms)

    def once(self) -> Query:
        """Of tables given by name, a packet that is there again comes once; in an archive it always does."""
        return replace(self, unrepeated=True)

    def table(self) -> str:
        """The access path; ten-degree cells where they are enabled and ten times fewer."""
        if self.kind != "area":
            return {"time": "packets_time", "mmsi": "packets_mmsi"}[self.kind]
        count = lambda degrees: len({c for box in self.boxes() for c in cells_of(box, degrees)})
        few = self.cell10 and not self.mixed and 10 * count(10) <= count(1)
        return "packets_area_cell10" if few else "packets_area_cell1"

    def to_df(self, source: SparkSession | dict[str, DataFrame], path: str | None = None, mids: DataFrame | None = None, tie: str = "digest") -> DataFrame:
        """Over tables given by name, or the archive under ``path``; ordered by time, then digest.

        Of an archive only files are read that may hold an answer, and a packet that was written again comes once. The entries of
        its files say where to cut the interval, so that rows are dealt to their place in the order at once; a query without an
        interval or with a limit is sorted as a whole.

        Filters on targets see what each vessel had said before, in an archive at any time and place (``archive.targets_before``), else inside the
        query's own packets; those on countries need ``mids`` (``track.with_countries``). Repeats go before thinning, and both after the filter.
        """
        if self.mixed and any(inner_cells(box) for box in self.boxes()):
            return self._mixed_cover(source, path, mids, tie)
        return self._ordered(self._refined(self._scan(source, path, self.table()), source, path, mids, tie), source, path)

    def _scan(self, source: SparkSession | dict[str, DataFrame], path: str | None, name: str, cells: Callable[[Column], Column] | None = None) -> DataFrame:
        """Rows of a table by interval, vessels and cells; ``cells`` stands for those of the boxes."""
        stored = not isinstance(source, dict)
        rows = archive.read_table(source, path, name, *self._asked(name)) if stored else source[name]
        if self.interval is not None:
            t0, t1 = self.interval
            t0, keep_start = (t0, self.include_start) if self.after_ms is None or self.after_ms < t0 else (self.after_ms, False)
            first, last = timeblocks(t0, t1, TABLES[name].block_ms)
            time = F.col("time_ms")
            rows = rows.where(F.col("timeblock").between(first, last) & ((time >= t0) if keep_start else (time > t0)) & (time < t1))
            if "day" in rows.columns:
                rows = rows.where(F.col("day").between(t0 // 86_400_000, t1 // 86_400_000))
        elif self.after_ms is not None:
            rows = rows.where(F.col("time_ms") > self.after_ms)
        if self.kind == "mmsi":
            rows = rows.where(F.col("mmsi").isin(*set(self.mmsi)))
            if len(set(self.mmsi)) < len(self.mmsi):
                spark = rows.sparkSession
                asked = F.explode(F.array(*[F.lit(m).cast(rows.schema["mmsi"].dataType) for m in self.mmsi]))
                rows = rows.join(F.broadcast(spark.range(1).select(asked.alias("mmsi"))), "mmsi")
        elif self.kind == "area":
            degrees = 10 if name.endswith("10") else 1
            rows = rows.where(reduce(or_, [in_cells(box, degrees) for box in self.boxes()]) if cells is None else cells(F.col("cellid")))
            if self.exact:
                held = [F.col("carried_lat").between(s, n) & F.col("carried_lon").between(w, e) for s, w, n, e in self.boxes()]
                rows = rows.where(reduce(or_, held))
        return by_primary_key(rows, name) if self.unrepeated and not stored else rows

    def _mixed_cover(self, source, path, mids, tie) -> DataFrame:
        """Ten-degree cells that lie whole inside, from their table, and the one-degree cells around them."""
        inner = [x for x in map(inner_cells, self.boxes()) if x is not None]
        whole = lambda cell: reduce(or_, [_within(cell, 36, *x) for x in inner])
        inside = lambda cell: reduce(or_, [_within(cell, 360, 10 * r0, 10 * r1 + 9, 10 * c0, 10 * c1 + 9) for r0, r1, c0, c1 in inner])
        edge = lambda cell: reduce(or_, [in_cells(box, 1) for box in self.boxes()]) & ~inside(cell)
        rows = self._scan(source, path, "packets_area_cell10", whole).unionByName(self._scan(source, path, "packets_area_cell1", edge))
        return self._ordered(self._refined(rows, source, path, mids, tie), source, path)

    def _refined(self, rows: DataFrame, source, path: str | None, mids: DataFrame | None, tie: str) -> DataFrame:
        """Filter, repeats and thinning."""
        history = None
        if not isinstance(source, dict) and self.interval is not None and any(n.startswith("t.") for n in fields_in(self.filter)):
            history = archive.targets_before(source, path, *self.interval)
        rows = self._filtered(rows, mids, tie, history)
        if self.repeats_ms is not None:
            rows = drop_repeats_within(rows, self.repeats_ms, tie=tie)
        if self.min_ms is not None or self.min_m is not None:
            rows = thin(rows, self.min_ms, self.min_m, tie=tie)
        return rows

    def _ordered(self, rows: DataFrame, source, path: str | None) -> DataFrame:
        if not isinstance(source, dict) and self.interval is not None and self.limit is None:
            return archive.in_time_order(rows, archive.time_ranges(source, path, self.table(), *self.interval))
        rows = rows.orderBy("time_ms", "digest")
        return rows if self.limit is None else rows.limit(self.limit)

    def _asked(self, name: str) -> tuple:
        """What ``archive.read_table`` may leave out files by."""
        cells = None
        if self.kind == "area":
            degrees = 10 if name.endswith("10") else 1
            number = lambda lat, lon: int(lat // degrees) * (360 // degrees) + int((lon + 180) // degrees)
            cells = min(number(s, w) for s, w, _, _ in self.boxes()), max(number(n, e) for _, _, n, e in self.boxes())
        return (*(self.interval or (self.after_ms, None)), list(self.mmsi) if self.kind == "mmsi" else None, cells)

    def _filtered(self, rows: DataFrame, mids: DataFrame | None, tie: str, history: DataFrame | None) -> DataFrame:
        names = fields_in(self.filter)
        more = rows
        if mids is not None and any(n.endswith(".country") for n in names):
            more = with_countries(more, mids)
        if any(n.startswith("t.") for n in names):
            more = with_targets(more, tie, history)
        kept = more.where(compile_filter(self.filter, FIELDS if mids is None else WITH_COUNTRIES))
        return kept.select(*rows.columns)
