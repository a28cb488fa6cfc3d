"""Calendars, named random streams, name-based ids and polygons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name space of URLs for name-based ids (RFC 4122).
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def hijri(day: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of the tabular Islamic calendar (cycles of 30 years, epoch 16 July 622) for a date."""
    div = lambda a, b: F.floor(a / b).cast("long")
    since = F.unix_date(day).cast("long") + 2440588 - 1948440 + 10632
    cycle = div(since - 1, 10631)
    rest = since - 10631 * cycle + 354
    year = div(10985 - rest, 5316) * div(50 * rest, 17719) + div(rest, 5670) * div(43 * rest, 15238)
    rest = rest - div(30 - year, 15) * div(17719 * year, 50) - div(year, 16) * div(15238 * year, 43) + 29
    month = div(24 * rest, 709)
    return (30 * cycle + year - 30).cast("int"), month.cast("int"), (rest - div(709 * month, 24)).cast("int")


def working_days(first: Column, last: Column, weekend: tuple[int, ...] = (6, 7)) -> Column:
    """Days from `first` to `last` that are not on the weekend (1 is Sunday; by default Friday and Saturday)."""
    return F.size(F.filter(F.sequence(first, last), lambda d: ~F.dayofweek(d).isin(*weekend)))


def stream_value(stream: str, key: Column) -> Column:
    """A number in [0, 1) drawn for `key` from a named stream; it depends on nothing else, so neither on order nor on other draws."""
    digest = F.md5(F.concat(F.lit(f"{stream}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def weighted_choice(value: Column, weights: dict[str, float]) -> Column:
    """The option in whose share of [0, 1) a value lies, options in the order given."""
    whole, upto, choice = sum(weights.values()), 0.0, F.lit(list(weights)[-1])
    bounds = []
    for name, w in weights.items():
        upto += w
        bounds.append((name, upto / whole))
    for name, bound in reversed(bounds[:-1]):
        choice = F.when(value < bound, name).otherwise(choice)
    return choice


def named_uuid(name: Column, space: str = URL_SPACE) -> Column:
    """The name-based id of version 5: SHA-1 of name space and name with version and variant put in; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a ray from the point to the right crosses the edges of a polygon an odd number of times."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
        crossings = crossings + (spans & (x < at)).cast("int")
    return crossings % 2 == 1
