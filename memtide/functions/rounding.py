"""Integer rounding, as columns and as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_round_up(a, b: int):
    return F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("long") if isinstance(a, Column) else -(-a // b)


def round_up(a, b: int):
    return div_round_up(a, b) * b


def round_down(a, b: int):
    return F.floor(a / F.lit(b)).cast("long") * b if isinstance(a, Column) else a // b * b
