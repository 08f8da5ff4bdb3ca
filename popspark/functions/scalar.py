"""Recodes, classes, distances and hash uniforms as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the salt and the keys only."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def lookup(code: Column, values: Mapping, default=None) -> Column:
    """The value of a code; ``default`` for others."""
    chain = None
    for key, value in values.items():
        chain = F.when(code == F.lit(key), F.lit(value)) if chain is None else chain.when(code == F.lit(key), F.lit(value))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def digitize(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds are not above the value; null stays null."""
    total = F.lit(0)
    for b in bounds:
        total = total + (value >= F.lit(b)).cast("int")
    return total


def crowfly(ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    return F.sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy))


def hhmmss(seconds: Column) -> Column:
    """HH:MM:SS, with hours beyond 24 where they are."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def lv03_to_lv95(x: Column, y: Column) -> tuple[Column, Column]:
    """The published offset of the two frames."""
    return x + F.lit(2000000.0), y + F.lit(1000000.0)


def wgs84_to_lv95(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The published approximation (metres, good to about one)."""
    p = (lat * 3600 - F.lit(169028.66)) / 10000
    l = (lon * 3600 - F.lit(26782.5)) / 10000  # noqa: E741
    e = F.lit(2600072.37) + F.lit(211455.93) * l - F.lit(10938.51) * l * p - F.lit(0.36) * l * p * p - F.lit(44.54) * l * l * l
    n = F.lit(1200147.07) + F.lit(308807.95) * p + F.lit(3745.25) * l * l + F.lit(76.63) * p * p - F.lit(194.56) * l * l * p + F.lit(119.79) * p * p * p
    return e, n
