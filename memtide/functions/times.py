"""Card timestamps: civil Japan time in eight bytes."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

JST_SECONDS = 9 * 3600


def tod_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Unix seconds; month 0 counts as 1, other overflows carry over."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), F.greatest(month, F.lit(1)) - 1)
    days = F.unix_date(first).cast("long") + day - 1
    return days * 86400 + hour * 3600 + minute * 60 + second - JST_SECONDS


def civil_days(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 of a date of any year: years start in March, so that leap days come last."""
    y = year - (month <= 2)
    of_era = y % 400
    of_year = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return y // 400 * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719468


def civil_date(days: int) -> tuple[int, int, int]:
    """(year, month, day) of days since 1970-01-01."""
    era, d = divmod(days + 719468, 146097)
    y = (d - d // 1460 + d // 36524 - d // 146096) // 365
    of_year = d - (365 * y + y // 4 - y // 100)
    m = (5 * of_year + 2) // 153
    month = m + 3 if m < 10 else m - 9
    return era * 400 + y + (month <= 2), month, of_year - (153 * m + 2) // 5 + 1


def unpack_tod(raw: bytes) -> int:
    """Unix seconds of a packed timestamp, whatever its eight bytes say: month 0 counts as 1, overflows carry over."""
    _, s, mi, h, d, mo, y = struct.unpack("<BBBBBBH", raw)
    years, month = divmod(max(mo, 1) - 1, 12)
    return (civil_days(y + years, month + 1, 1) + d - 1) * 86400 + h * 3600 + mi * 60 + s - JST_SECONDS


def pack_tod(unix: int) -> bytes:
    """Times before year 0 or after year 65535, which have no packed form, become the nearest that has."""
    days, second = divmod(int(unix) + JST_SECONDS, 86400)
    days = min(max(days, civil_days(0, 1, 1)), civil_days(65535, 12, 31))
    y, mo, d = civil_date(days)
    return struct.pack("<BBBBBBH", 0, second % 60, second // 60 % 60, second // 3600, d, mo, y)
