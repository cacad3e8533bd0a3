"""Identifiers, codes, search tokens and their spellings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(c: Column) -> Column:
    """How stored identifiers are compared: upper case, without hyphens."""
    return F.replace(F.upper(c), F.lit("-"), F.lit(""))


def norm_value(value: str) -> str:
    return value.strip().upper().replace("-", "")


def icao24(c: Column) -> Column:
    return F.lower(F.trim(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def flight_id(icao: Column, start_ts: Column) -> Column:
    """icao24 and the start to whole seconds."""
    return F.concat(icao, F.lit(":"), F.date_format(start_ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def parse_flight_id(value: str):
    """(icao24, start) of a flight id; ValueError for another form."""
    from datetime import datetime, timezone

    found = re.fullmatch(r"([0-9a-fA-F]{6}):(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:Z|\+00:00)?", value)
    if not found:
        raise ValueError(f"not a flight id: {value!r}")
    return found[1].lower(), datetime.fromisoformat(found[2]).replace(tzinfo=timezone.utc)


def tokens(*columns: Column) -> Column:
    """Lower-cased words of some columns, for prefix search."""
    text = F.lower(F.concat_ws(" ", *columns))
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 0)


def words(query: str) -> list[str]:
    """The words of a search query."""
    return re.findall(r"\w+", query)


def matches_prefixes(words: Column, query: str) -> Column:
    """Every token of the query begins some word; a query without tokens matches nothing."""
    wanted = [w.lower() for w in re.findall(r"\w+", query)]
    if not wanted:
        return F.lit(False)
    begins = lambda token: F.exists(words, lambda w: w.startswith(token))
    return reduce(lambda a, b: a & b, map(begins, wanted))


# Codes of vertical limits and of aerodrome airspaces.
LIMIT_UNITS = {0: "m", 1: "ft", 6: "fl"}
LIMIT_REFERENCES = {0: "gnd", 1: "msl", 2: "std"}
AERODROME_TYPES = {4: "CTR", 13: "ATZ", 14: "MATZ"}
# Names of airspace types and classes by code.
AIRSPACE_TYPES = dict(enumerate((
    "Other", "Restricted", "Danger", "Prohibited", "CTR", "TMZ", "RMZ", "TMA", "TRA", "TSA", "FIR", "UIR",
    "ADIZ", "ATZ", "MATZ", "Airway", "MTR", "Alert", "Warning", "Protected", "MOA", "CTA", "ACC", "Sport",
)))
AIRSPACE_CLASSES = dict(enumerate("ABCDEFG"))


def lookup(code: Column, table: dict[int, str], default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, code.cast("int"))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def airspace_type(code: Column) -> Column:
    """The name of an airspace type; null for a code without one."""
    return lookup(code, AIRSPACE_TYPES)


def airspace_class(code: Column) -> Column:
    """The letter of an airspace class; null for a code without one (8 is unclassified)."""
    return lookup(code, AIRSPACE_CLASSES)


def limit_unit(code: Column) -> Column:
    return lookup(code, LIMIT_UNITS)


def limit_reference(code: Column) -> Column:
    return lookup(code, LIMIT_REFERENCES, "msl")


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of a one-degree terrain tile by its south-west corner."""
    side = lambda c, plus, minus: F.when(c >= 0, plus).otherwise(minus)
    y, x = F.floor(lat), F.floor(lon)
    return F.concat(side(y, "N", "S"), F.format_string("%02d", F.abs(y)), side(x, "E", "W"), F.format_string("%03d", F.abs(x)))


def release_date(tag: Column) -> Column:
    """Date of a release tag such as v2025.04.01-..."""
    part = lambda k: F.regexp_extract(tag, r"v?(\d{4})\.(\d{2})\.(\d{2})", k)
    return F.try_to_date(F.concat_ws("-", part(1), part(2), part(3))) if hasattr(F, "try_to_date") else F.to_date(F.nullif(F.concat_ws("-", part(1), part(2), part(3)), F.lit("--")))


def is_split_part(name: str) -> bool:
    """Whether a file name is a part of a split archive: .tar.aa, .tar.ab, ..."""
    return re.search(r"\.tar\.(?!gz|xz)[a-z]{2}$", name) is not None
