"""The packet filter language, compiled to a Spark column.

    expr  := term ('|' term)*        term := factor ('&' factor)*
    factor := '(' expr ')' | name op values | name 'in' '(' values ')' | name 'like' glob | name 'within' 'bbox' '(' 4 numbers ')'

Names are ``s.`` (source), ``t.`` (target) or ``m.`` (message) fields; ``=`` and ``in`` take comma lists, ``!=`` is
ours. Text compares without case, globs use ``*`` and ``?``. ``&`` binds before ``|``. Blank accepts all.

A value is what stands up to the next ``,``, ``&``, ``|`` or bracket, words of the language too (``m.name=MADE IN CHINA``). With signs of
the language it stands in quotes, ' or ", and a quote inside is doubled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """The expression can't be read, or names a field that isn't known."""


NAME = re.compile(r"[A-Za-z]\w*\.\w+")
OPERATOR = re.compile(r"<=|>=|!=|[=<>]|in(?=\s*\()|(?:like|within)\b", re.I)
#: A quoted value, or a plain one without the signs of the language.
QUOTED, PLAIN = re.compile(r"'((?:[^']|'')*)'|\"((?:[^\"]|\"\")*)\""), re.compile(r"[^,&|()=<>!'\"][^,&|()=<>!]*")
NUMERIC = frozenset(("mmsi", "imo", "lat", "lon", "sog", "cog", "hdg", "speed", "value", "navstat"))
#: Columns of a packet by field; those of targets come from ``track.with_targets``.
FIELDS: dict[str, tuple[str, ...]] = {
    **{f"m.{c}": (c,) for c in ("mmsi", "imo", "name", "navstat", "lat", "lon", "sog", "cog", "hdg")}, "m.type": ("msgtype",), "m.cs": ("callsign",),
    **{f"t.{c}": (f"target_{c}",) for c in ("imo", "name", "type", "navstat", "lat", "lon", "sog", "cog", "hdg")}, "t.mmsi": ("mmsi",), "t.cs": ("target_callsign",),
    "s.id": ("source_id",), "s.type": ("source_type",), "s.country": ("source_country",), "s.region": ("region",), "s.bs": ("base_station",),
}
#: With codes of countries of three and two letters (``track.with_countries``); a source's number stays.
WITH_COUNTRIES = FIELDS | {"m.country": ("country", "country2"), "t.country": ("country", "country2"), "s.country": ("source_country", "source_alpha3", "source_alpha2")}


def fields_in(text: str | None) -> set[str]:
    """Fields that an expression names."""
    found: set[str] = set()
    compile_filter(text, WITH_COUNTRIES, seen=found)
    return found


def compile_filter(text: str | None, fields: dict[str, tuple[str, ...]] = FIELDS, only: str = "smt", seen: set[str] | None = None) -> Column:
    """``only`` restricts prefixes (source filters take ``s`` alone); ``seen`` takes the fields met.

    A field of several columns is equal to a value if one of them is, and unequal if none is.
    """
    if text is None or not text.strip():
        return F.lit(True)
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def taken(pattern: re.Pattern, what: str) -> re.Match:
        nonlocal at
        skip()
        found = pattern.match(text, at)
        if not found:
            raise FilterError(f"expected {what} at {text[at:]!r}" if text[at:] else f"expected {what}, not the end")
        at = found.end()
        return found

    def sign(which: str) -> bool:
        """Whether the next sign is this one; then it is taken."""
        nonlocal at
        skip()
        if not text.startswith(which, at):
            return False
        at += len(which)
        return True

    def need(which: str) -> None:
        if not sign(which):
            raise FilterError(f"expected {which} at {text[at:]!r}")

    def value() -> str:
        skip()
        if text[at : at + 1] in ("'", '"'):
            found = taken(QUOTED, "the end of a quoted value")
            return found[1].replace("''", "'") if found[1] is not None else found[2].replace('""', '"')
        return taken(PLAIN, "a value")[0].strip()

    def values() -> list[str]:
        out = [value()]
        while sign(","):
            out.append(value())
        return out

    def either() -> Column:
        left = both()
        while sign("|"):
            left = left | both()
        return left

    def both() -> Column:
        left = one()
        while sign("&"):
            left = left & one()
        return left

    def number(v: str) -> float:
        try:
            return float(v)
        except ValueError:
            raise FilterError(f"not a number: {v!r}") from None

    def one() -> Column:
        if sign("("):
            inner = either()
            need(")")
            return inner
        name = taken(NAME, "a field")[0].lower()
        prefix, _, field = name.partition(".")
        if prefix not in only:
            raise FilterError(f"unknown field {name!r}")
        op = taken(OPERATOR, "an operator")[0].lower()
        if op == "within":
            taken(re.compile("bbox", re.I), "bbox")
            need("(")
            box = [number(v) for v in values()]
            need(")")
            if field != "pos" or len(box) != 4:
                raise FilterError("within takes pos and four numbers")
            (lat,), (lon,) = columns(f"{prefix}.lat"), columns(f"{prefix}.lon")
            return lat.between(min(box[0], box[2]), max(box[0], box[2])) & lon.between(min(box[1], box[3]), max(box[1], box[3]))
        of = columns(name)
        if op == "like":
            escaped = re.sub(r"([\\%_])", r"\\\1", value()).replace("*", "%").replace("?", "_")
            return any_of([F.upper(x.cast("string")).like(escaped.upper()) for x in of])
        if op == "in":
            need("(")
            found = values()
            need(")")
        else:
            found = values() if op in ("=", "!=") else [value()]
        if op in ("<", ">", "<=", ">="):
            v = number(found[0])
            return any_of([{"<": x < v, ">": x > v, "<=": x <= v, ">=": x >= v}[op] for x in of])
        plain = field in NUMERIC or (prefix, field) == ("m", "type")
        same = any_of([x.isin([number(v) for v in found]) if plain else F.upper(x.cast("string")).isin([v.upper() for v in found]) for x in of])
        return ~same if op == "!=" else same

    def any_of(tests: list[Column]) -> Column:
        """Of several columns an unknown one says nothing; a lone unknown one is unknown."""
        if len(tests) == 1:
            return tests[0]
        return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in tests])

    def columns(name: str) -> list[Column]:
        if name not in fields:
            raise FilterError(f"unknown field {name!r}" if name not in WITH_COUNTRIES else f"{name} needs a table of countries")
        if seen is not None:
            seen.add(name)
        return [F.col(c) for c in fields[name]]

    found = either()
    skip()
    if at < len(text):
        raise FilterError(f"unexpected {text[at:]!r}")
    return found


def is_valid(text: str | None, **more) -> bool:
    try:
        compile_filter(text, **({"fields": WITH_COUNTRIES} | more))
    except FilterError:
        return False
    return True


def quoted(value: str) -> str:
    """A value as an expression has it."""
    return value if PLAIN.fullmatch(value) and value == value.strip() else "'" + value.replace("'", "''") + "'"


def compose(**facets: list[str] | str | None) -> str:
    """``source_type='LIVE', m_country=['DNK', 'SWE']`` -> ``s.type=LIVE & m.country=DNK,SWE``; ``any`` and blanks drop out.

    Values with signs of the language are put in quotes.
    """
    out = []
    for name, given in facets.items():
        given = [given] if isinstance(given, str) else list(given or [])
        given = [g for g in given if g and g.lower() != "any"]
        if given:
            prefix, _, field = name.partition("_")
            out.append(f"{prefix[0]}.{field}={','.join(map(quoted, given))}")
    return " & ".join(out)
