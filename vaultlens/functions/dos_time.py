"""DOS date and time words: seconds by two, from 1980 to 2107, as Python values and as columns."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (shift, bits) of year since 1980, month, day, hour, minute and half seconds.
FIELDS = ((25, 7), (21, 4), (16, 5), (11, 5), (5, 6), (0, 5))


def dos_encode(ts: datetime.datetime) -> int:
    if not 1980 <= ts.year <= 2107:
        raise ValueError(f"year {ts.year}")
    parts = (ts.year - 1980, ts.month, ts.day, ts.hour, ts.minute, ts.second // 2)
    return sum(p << shift for p, (shift, _) in zip(parts, FIELDS, strict=True))


def dos_decode(word: int) -> datetime.datetime | None:
    """None where the fields are no date."""
    year, month, day, hour, minute, half = (word >> shift & (1 << bits) - 1 for shift, bits in FIELDS)
    try:
        return datetime.datetime(1980 + year, month, day, hour, minute, 2 * half)
    except ValueError:
        return None


def encode_column(ts: Column) -> Column:
    """Null outside 1980 to 2107."""
    parts = (F.year(ts) - 1980, F.month(ts), F.day(ts), F.hour(ts), F.minute(ts), F.floor(F.second(ts) / 2))
    word = sum((F.shiftleft(p.cast("long"), shift) for p, (shift, _) in zip(parts, FIELDS, strict=True)), F.lit(0))
    return F.when(F.year(ts).between(1980, 2107), word.cast("long"))


def decode_column(word: Column) -> Column:
    """Null where the fields are no date."""
    field = [F.shiftright(word.cast("long"), shift).bitwiseAND((1 << bits) - 1).cast("int") for shift, bits in FIELDS]
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", field[0] + 1980, *field[1:5], field[5] * 2)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
