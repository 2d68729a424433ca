"""Day, month and week keys.

Day keys are ``yyyyMMdd`` strings (the ``pt`` / ``day_id`` format). Month keys default to ``yyyyMM``
so that months of different years stay apart; ``MM`` reproduces a month-of-year key that merges
years.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FMT = "yyyyMMdd"
MONTH_FMT = "yyyyMM"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digits(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def day_key(ts) -> Column:
    """``yyyyMMdd`` of a timestamp, from its parts as integers (pattern formatting costs several times as much a row)."""
    t = _col(ts)
    return _digits(F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t), 8)


def month_key(ts, fmt: str = MONTH_FMT) -> Column:
    """Month key of a timestamp in ``fmt`` (``yyyyMM``, ``MM`` and ``yyyy-MM`` from integers, other patterns formatted)."""
    t = _col(ts)
    if fmt == "yyyyMM":
        return _digits(F.year(t) * 100 + F.month(t), 6)
    if fmt == "MM":
        return _digits(F.month(t), 2)
    if fmt == "yyyy-MM":
        return F.concat(_digits(F.year(t), 4), F.lit("-"), _digits(F.month(t), 2))
    return F.date_format(t, fmt)


def month_of_day_key(key, fmt: str = MONTH_FMT) -> Column:
    """Month key cut out of a ``yyyyMMdd`` string key, in the same ``fmt`` as ``month_key``."""
    k = _col(key)
    if fmt == "yyyyMM":
        return F.substring(k, 1, 6)
    if fmt == "MM":
        return F.substring(k, 5, 2)
    if fmt == "yyyy-MM":
        return F.concat(F.substring(k, 1, 4), F.lit("-"), F.substring(k, 5, 2))
    raise ValueError(f"unsupported month format {fmt!r}")


def monday(ts) -> Column:
    """Date of the Monday that starts the ISO week of ``ts``."""
    return F.to_date(F.date_trunc("week", _col(ts)))


def iso_week(ts) -> Column:
    return F.weekofyear(_col(ts))


def iso_year(ts) -> Column:
    """ISO week-numbering year (the year an ISO week belongs to)."""
    return F.extract(F.lit("YEAROFWEEK"), _col(ts)).cast("int")


def ts_bound(df, column: str, value: str) -> Column:
    """A literal of the column's own timestamp type, so the comparison pushes down to the scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def day_start(day: str) -> str:
    """``'yyyyMMdd'`` -> ``'yyyy-MM-dd 00:00:00'`` (start of that day)."""
    return f"{day[0:4]}-{day[4:6]}-{day[6:8]} 00:00:00"
