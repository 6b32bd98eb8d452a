"""Scalar rules as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def time_ms(ts: str) -> Column:
    """Whole milliseconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def timeblock(ms: Column | str, width_ms: int) -> Column:
    """Whole blocks since the epoch by whole seconds, cut towards zero; overflow raises."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.call_function("div", F.call_function("div", ms, F.lit(1000).cast("long")), F.lit(width_ms // 1000).cast("long")).cast("int")


def timeblocks(t0_ms: int, t1_ms: int, width_ms: int) -> tuple[int, int]:
    """First and last block of a closed interval."""
    cut = lambda ms: int(int(ms / 1000) / (width_ms // 1000))
    return cut(t0_ms), cut(t1_ms)


def digest(text: Column | str) -> Column:
    return F.md5(text)


def cell(lat: Column | str, lon: Column | str, degrees: int = 1) -> Column:
    lat, lon = (F.col(x) if isinstance(x, str) else x for x in (lat, lon))
    return (F.floor(lat / degrees) * (360 // degrees) + F.floor((lon + 180) / degrees)).cast("int")


def valid_position(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    lat, lon = (F.col(x) if isinstance(x, str) else x for x in (lat, lon))
    return lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def format_position(lat: Column, lon: Column) -> Column:
    """``DD MM.mmmN DDD MM.mmmE``; minutes that round to 60 are carried by rounding first."""

    def one(x: Column, form: str, plus: str, minus: str) -> Column:
        thousandths = F.round(F.abs(x) * 60000).cast("long")
        return F.format_string(form, F.floor(thousandths / 60000), (thousandths % 60000) / 1000.0, F.when(x < 0, F.lit(minus)).otherwise(F.lit(plus)))

    return F.concat_ws(" ", one(lat, "%02d %06.3f%s", "N", "S"), one(lon, "%03d %06.3f%s", "E", "W"))


def parse_coordinate(text: Column | str) -> Column:
    """Degrees from ``DD MM.mmmH`` or a decimal with an optional hemisphere letter; anything else raises."""
    text = F.upper(F.trim(F.col(text) if isinstance(text, str) else text))
    shape = r"^([+-]?\d+(?:\.\d+)?)(?:[ °]+(\d+(?:\.\d+)?))?\s*'?\s*([NSEW]?)$"
    whole, minutes, side = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    value = whole.cast("double") + F.when(minutes == "", 0.0).otherwise(F.try_to_number(minutes, F.lit("999999.999999")).cast("double")) / 60
    signed = F.when(side.isin("S", "W"), -value).otherwise(value)
    return F.when(text.isNull(), F.lit(None).cast("double")).when(text.rlike(shape), signed).otherwise(F.raise_error(F.concat(F.lit("not a position: "), text)).cast("double"))


def miles_to_km(x: Column) -> Column:
    return F.round(x * 1852 / 1000)


def km_to_miles(x: Column) -> Column:
    return F.round(x * 1000 / 1852)


def miles_to_m(x: Column) -> Column:
    return F.round(x * 1852)


def byte_size(n: Column) -> Column:
    """Size by 1024 with one decimal, as ``1.5 kB``; ``-`` for null, zero and less."""
    units = F.array(*[F.lit(u) for u in ("bytes", "kB", "MB", "GB", "TB", "PB")])
    power = F.least(F.floor(F.log2(n.cast("double")) / 10), F.lit(5)).cast("int")
    return F.when(n > 0, F.concat(F.format_string("%.1f", n / F.pow(F.lit(1024.0), power)), F.lit(" "), units[power])).otherwise(F.lit("-"))


def file_type(url: Column) -> Column:
    """File ending by the output a request names; the first that fits wins."""
    has = lambda s: F.contains(url, F.lit(s))
    return F.when(has("output=OUTPUT_TO_KML") | has("kml"), "kml").when(has("OUTPUT_TO_HTML"), "html").when(has("table"), "csv").when(has("json"), "json").otherwise("txt")


def hms(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def iso_instant(ms: Column) -> Column:
    """ISO-8601 in UTC; a zero fraction is left out."""
    ts = F.timestamp_millis(ms)
    return F.when(ms % 1000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def url_encoded(text: Column) -> Column:
    """As a part of a request: a space is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def fixed3(x: Column) -> Column:
    """Three decimals."""
    return F.format_string("%.3f", x)


def blank(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.isNull() | (F.trim(text) == "")


def tenths(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("float") / 10


def request_name(request: Column) -> Column:
    """Default file name of a request."""
    return F.upper(F.md5(request))
