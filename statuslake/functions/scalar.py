"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_LAT = 111_111.0
#: Latitude whose cosine scales longitudes.
REFERENCE_LAT = 37.77
CLOSED = ("permanently_closed", "closed")


def as_json(c: str | Column) -> Column:
    """Nested value as JSON text."""
    return F.to_json(c)


def json_path(c: str | Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_array(c: str | Column, schema: str) -> Column:
    """JSON text as an array of structs; bad or missing text gives an empty array."""
    return F.coalesce(F.from_json(c, schema), F.array().cast(schema))


def iso_timestamp(c: Column) -> Column:
    """ISO text as an instant; without a zone it means UTC, unreadable text gives null."""
    return F.try_to_timestamp(c)


def any_timestamp(c: Column) -> Column:
    """Epoch milliseconds as digits, or ISO text with its fraction of a second cut off."""
    digits = c.rlike(r"^-?\d+$")
    text = F.regexp_replace(c, r"\.\d+", "")
    return F.when(digits, F.timestamp_millis(F.when(digits, c).try_cast("bigint"))).otherwise(F.try_to_timestamp(F.when(~digits, text)))


def whole_days(earlier: Column, later: Column) -> Column:
    """Whole days of 24 hours from ``earlier`` to ``later``, rounded down, also below zero."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("bigint")


def age_days(earlier: Column, later: Column, missing: float = -1.0) -> Column:
    """``whole_days`` not below zero; ``missing`` where there is no date."""
    days = whole_days(earlier, later)
    return F.when(days.isNull(), F.lit(missing)).otherwise(F.greatest(days, F.lit(0)).cast("double"))


def years(earlier: Column, later: Column) -> Column:
    return whole_days(earlier, later) / F.lit(365.25)


def clean_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def normal_name(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and spaces, ends trimmed; inner spaces stay."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def first_word(normal: Column) -> Column:
    """The first word that isn't an article; else the first word; else the empty text."""
    words = F.filter(F.split(normal, " +"), lambda w: w != "")
    content = F.filter(words, lambda w: ~w.isin("the", "a", "an"))
    return F.coalesce(F.get(content, F.lit(0)), F.get(words, F.lit(0)), F.lit(""))


def comma_list(c: Column) -> Column:
    """Parts of a comma list, trimmed, lower case, spaces as underscores, empty ones dropped."""
    parts = F.transform(F.split(c, ","), lambda x: F.regexp_replace(F.lower(F.trim(x)), " ", "_"))
    return F.filter(parts, lambda x: x != "")


def head(parts: Column) -> Column:
    return F.get(parts, F.lit(0))


def tail(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def join_filled(sep: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])


def review_confidence(n: Column) -> Column:
    return F.least(F.log1p(n) / F.lit(math.log1p(500)), F.lit(1.0))


def distance_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column, reference_lat: float = REFERENCE_LAT) -> Column:
    """Equirectangular distance with a fixed scale of longitude."""
    scale = METRES_LAT * math.cos(math.radians(reference_lat))
    return F.hypot((lat1 - lat2) * METRES_LAT, (lon1 - lon2) * scale)


def midpoint(bbox: str) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a box; null without one."""
    return (F.col(f"{bbox}.ymin") + F.col(f"{bbox}.ymax")) / 2, (F.col(f"{bbox}.xmin") + F.col(f"{bbox}.xmax")) / 2


def decay(d: Column, radius: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / radius)


def or_default(c: Column, default: Column, empty: Column) -> Column:
    """``default`` where ``c`` is null or its empty value."""
    return F.when(c.isNull() | (c == empty), default).otherwise(c)


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def latest(c: Column, get: str) -> Column:
    """The greatest value of a field of an array of structs."""
    return F.array_max(F.transform(c, lambda x: x[get]))


def half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: a lambda over an array of one element binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array, its maximum taken away first."""

    def shares(pair: Column) -> Column:
        return F.transform(pair["e"], lambda x: x / pair["sum"])

    def exponentials(bound: Column) -> Column:
        return F.transform(bound["s"], lambda x: F.exp((x - bound["top"]) / temperature))

    def summed(e: Column) -> Column:
        return F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("sum"))

    topped = let(scores, lambda s: F.struct(s.alias("s"), F.array_max(s).alias("top")))
    return let(let(let(topped, exponentials), summed), shares)


def is_present(c: Column) -> Column:
    """Neither null nor a text that stands for nothing."""
    return c.isNotNull() & ~F.trim(c).isin("", "null", "[]", "{}")


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def open_label(status: Column) -> Column:
    """0 for a closed status, else 1."""
    return F.when(F.lower(status).isin(*CLOSED), 0).otherwise(1)


def first_of(c: str, field: str) -> Column:
    """A field of the first element of an array of structs; null if there is none."""
    return F.get(c, F.lit(0))[field]


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def filled(c: str) -> Column:
    """Whether an array has elements."""
    return flag(F.size(c) > 0)
