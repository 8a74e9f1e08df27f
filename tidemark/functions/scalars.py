"""Column functions: angles, positions, rounding, text and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_angle(degrees: Column | str) -> Column:
    """Degrees from 0 up to but not 360."""
    return F.pmod(_col(degrees), F.lit(360.0))


def signed_delta(start: Column | str, end: Column | str) -> Column:
    """Shortest way from one angle to another, over -180 up to 180; a half turn keeps the sign
    of the plain difference."""
    d = normalise_angle(end) - normalise_angle(start)
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def unwrap_toward(reference: Column | str, angle: Column | str) -> Column:
    """The angle moved by whole turns to within half a turn of the normalised reference."""
    return normalise_angle(reference) + signed_delta(reference, angle)


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def initial_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return normalise_angle(F.degrees(F.atan2(y, x)))


def half_up(value: Column | str, places: int) -> Column:
    """Rounded to places; ties go up, below zero too."""
    scale = 10.0**places
    return F.floor(_col(value) * scale + 0.5) / scale


def blank_to_null(text: Column | str) -> Column:
    trimmed = F.trim(_col(text))
    return F.when(trimmed != "", trimmed)


def clamp(value: Column | str, low: float, high: float) -> Column:
    """Null stays null."""
    c = _col(value)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(c, F.lit(high))))


def flexible_timestamp(text: Column | str, formats: list[str]) -> Column:
    """The first of the formats that parses the text, else null."""
    return F.coalesce(*[F.try_to_timestamp(_col(text), F.lit(f)) for f in formats])


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), _col(ts).cast("timestamp_ntz"))


def iso_millis(millis: Column | str) -> Column:
    """ISO 8601 text of milliseconds since 1970, in UTC."""
    c = _col(millis)
    seconds = F.floor(c / 1000)
    base = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.concat(F.date_format(base, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(c, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


def is_number(value: Column | str) -> Column:
    """Whether a numeric column is neither null nor NaN."""
    c = _col(value)
    return c.isNotNull() & ~F.isnan(c.cast("double"))
