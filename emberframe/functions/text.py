"""Scalar expressions on text, time and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: points of the compass, clockwise from north; fixed values
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: units of a wind speed and what they are divided or multiplied by to give metres per second; fixed values
METRES, KILOMETRES, KNOTS = ("m/s", "ms-1"), ("km/h", "kmh"), ("kt", "kts", "knot", "knots")
KMH, KNOT = 3.6, 0.514444
VOLATILE = "updated_at"  #: key that comparisons leave out


def clean(value: Column, most: int) -> Column:
    """Trimmed and cut; null gives the empty string."""
    return F.substring(F.trim(F.coalesce(value, F.lit(""))), 1, most)


def clock(value: Column) -> Column:
    """Digits of a time of day as hhmm; null without digits."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return F.when(digits != "", F.substring(F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), 1, 4))


def first_number(columns: Sequence[Column]) -> Column:
    """The first of these texts that is a number."""
    return F.coalesce(*[c.try_cast("double") for c in columns])


def speed(value: Column) -> Column:
    """Metres per second of a number with a unit (comma or point, any case); a bare number is m/s. Null where it can't be read, also with another unit."""
    raw = F.regexp_replace(F.lower(F.trim(value)), ",", ".")
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*(" + "|".join((*METRES, *KILOMETRES, *sorted(KNOTS, key=len, reverse=True))) + ")?$"
    number, unit = F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")).cast("double"), F.regexp_extract(raw, pattern, 2)
    return F.when(unit.isin(*KILOMETRES), number / KMH).when(unit.isin(*KNOTS), number * KNOT).otherwise(number)


def direction(value: Column) -> Column:
    """Degrees of a number (modulo 360; a degree sign or DEG may stand with it) or of a point of the compass."""
    name = F.trim(F.regexp_replace(F.upper(F.trim(value)), "°|DEG", ""))
    at = F.array_position(F.array(*[F.lit(c) for c in COMPASS]), name)
    number = F.when(name.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?$"), name.try_cast("double"))
    return F.coalesce(F.when(at > 0, (at - 1) * 22.5), F.pmod(number, F.lit(360.0)))


def age_text(seconds: Column) -> Column:
    """Whole minutes below an hour, then hours, from a day on days, to one place."""
    hours, days = F.format_string("%.1f h ago", seconds / 3600), F.format_string("%.1f days ago", seconds / 86_400)
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit(" min ago"))).when(seconds < 86_400, hours).otherwise(days)


def slug(value: Column) -> Column:
    """Lower case, other characters than letters, digits, _ and - as single -, none at the ends, 48 characters at most. Where nothing is left, eight digits of a hash stand for the value."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.substring(F.when(base == "", F.substring(F.md5(F.coalesce(value, F.lit(""))), 1, 8)).otherwise(base), 1, 48)


def redacted(url: Column) -> Column:
    """Scheme, user, host (lower case) and port of a URL: neither its password nor its path. (malformed) without a host, empty for an empty or missing one."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:/@?#]*)(?::[^/@?#]*)?@)?([^:/@?#]+)(?::([0-9]+))?(?:[/?#].*)?$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    shown = F.concat(F.lower(part(1)), F.lit("://"), F.when(part(2) != "", F.concat(part(2), F.lit("@"))).otherwise(""), F.lower(part(3)), F.when(part(4) != "", F.concat(F.lit(":"), part(4))).otherwise(""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(part(3) == "", "(malformed)").otherwise(shown)


def checksum_ok(sentence: Column) -> Column:
    """Whether the exclusive or of the characters between $ and * is the hexadecimal number after it."""
    body = F.regexp_extract(sentence, r"^\$([^*]*)\*[0-9A-Fa-f]{2}\s*$", 1)
    given = F.conv(F.nullif(F.regexp_extract(sentence, r"^\$[^*]*\*([0-9A-Fa-f]{2})\s*$", 1), F.lit("")), 16, 10).cast("int")
    found = F.aggregate(F.split(body, ""), F.lit(0), lambda x, c: x.bitwiseXOR(F.ascii(c)))
    return F.coalesce(found == given, F.lit(False))


def degrees_of(value: Column, hemisphere: Column) -> Column:
    """Signed degrees of ddmm.mmmm."""
    number = value.try_cast("double")
    whole = F.floor(number / 100)
    return (whole + (number - whole * 100) / 60) * F.when(hemisphere.isin("S", "W"), -1.0).otherwise(1.0)


def epoch(value: Column) -> Column:
    """Seconds of an ISO time; without a zone it is UTC, unreadable ones are null."""
    return F.unix_micros(F.try_to_timestamp(value)) / F.lit(1e6)


def stale(reference: Column, model: Column, now: int) -> Column:
    """Whether a result has outlived 6 hours (models) or 24 hours (others)."""
    return reference + F.when(model, 21_600).otherwise(86_400) < now


def finite(value: Column) -> Column:
    """Null instead of what JSON can't hold."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def replay_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
