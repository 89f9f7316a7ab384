"""Numbers of icon models as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(pixel: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue bytes of a 16-bit pixel of 5-bit colours, red lowest."""
    return tuple(F.shiftleft(F.shiftright(pixel, s).bitwiseAND(F.lit(31)), 3) for s in (0, 5, 10))


def fixed_point(raw: Column) -> Column:
    """A signed 16-bit number of 1/4096 from its unsigned value."""
    return F.when(raw >= 32768, raw - 65536).otherwise(raw) / F.lit(4096.0)
