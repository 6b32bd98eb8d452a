"""Query parameters as given in text, turned into plain values on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

_INSTANT = re.compile(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:T(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?)?)?Z?$", re.I)
_DURATION = re.compile(r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$", re.I)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def instant_ms(text: str) -> int:
    """UTC instant, leniently padded (``2015-1-5T6``)."""
    m = _INSTANT.match(text.strip())
    if not m:
        raise ValueError(f"not an instant: {text!r}")
    y, mo, d, h, mi, s, f = m.groups()
    when = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((f or "0").ljust(6, "0")), tzinfo=timezone.utc)
    return (when - EPOCH) // timedelta(milliseconds=1)


def duration_ms(text: str) -> int:
    """ISO-8601 duration with years of 365 and months of 30 days."""
    m = _DURATION.match(text.strip())
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text!r}")
    y, mo, w, d, h, mi = (int(x or 0) for x in m.groups()[:6])
    return (((y * 365 + mo * 30 + w * 7 + d) * 24 + h) * 60 + mi) * 60_000 + round(float(m[7] or 0) * 1000)


def interval_ms(text: str) -> tuple[int, int]:
    """``start/end``, ``start/duration`` or ``duration/end``."""
    parts = text.split("/")
    if len(parts) != 2:
        raise ValueError(f"not an interval: {text!r}")
    a, b = (p.strip() for p in parts)
    if a.upper().startswith("P"):
        end = instant_ms(b)
        return end - duration_ms(a), end
    start = instant_ms(a)
    return start, start + duration_ms(b) if b.upper().startswith("P") else instant_ms(b)


def ending_now(duration: str, now_ms: int) -> tuple[int, int]:
    """The interval of that length up to now."""
    return now_ms - duration_ms(duration), now_ms


def fixed3(x: float) -> str:
    """Three decimals, as boxes are written in requests."""
    return f"{x:.3f}"


def request(interval: tuple[int, int], filter: str | None = None, mmsi: list[int] | None = None, box: tuple[float, float, float, float] | None = None, **more) -> str:
    """A query as the parameters of a request, in their order: north, west, south, east for boxes; values are URL-encoded, blank ones left out.

    ``more`` are further parameters (``output``, ``columns``, ``separator``, ``limit``, ``minDistance``, ``minDuration``,
    ``duplicateWindow``); ``True`` gives a bare name (``noHeader``).
    """
    iso = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = [f"interval={iso(interval[0])}/{iso(interval[1])}"]
    if filter and filter.strip():
        out.append("filter=" + quote(filter.strip(), safe="!'()*-._~"))
    out += [f"mmsi={m}" for m in mmsi or ()]
    if box is not None:
        south, west, north, east = box
        out.append("box=" + ",".join(map(fixed3, (north, west, south, east))))
    out += [k if v is True else f"{k}={v}" for k, v in more.items() if v not in (None, False, "")]
    return "&".join(out)


def bounding_box(text: str) -> tuple[float, float, float, float]:
    """Two opposite corners ``lat,lon,lat,lon`` as (south, west, north, east)."""
    try:
        a, b, c, d = (float(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"a box is four numbers: {text!r}") from None
    return min(a, c), min(b, d), max(a, c), max(b, d)


def column_list(text: str) -> list[str]:
    return [c.strip() for c in re.split("[;,]", text) if c.strip()]


def default_interval(now_ms: int) -> tuple[int, int]:
    start = now_ms - now_ms % 3_600_000
    return start, start + 600_000


def repaired(start: int, end: int, moved: str = "start") -> tuple[int, int]:
    """A reversed interval gets ten minutes on the side that wasn't moved."""
    if start < end:
        return start, end
    return (start, start + 600_000) if moved == "start" else (end - 600_000, end)
