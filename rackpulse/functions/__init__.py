"""Column-expression helpers; every helper returns a native Catalyst expression (no Python UDF)."""

from rackpulse.functions.dates import (
    DAY_FMT, MONTH_FMT, day_key, month_key, month_of_day_key, monday, iso_week, iso_year, ts_bound,
    day_start,
)
from rackpulse.functions.headcount import (
    BANDS_COARSE, BANDS_FINE, BANDS_DETAIL, IMPUTE_COARSE, IMPUTE_FINE,
    cut_length, parse_headcount, headcount_number, band, impute_headcount,
)
from rackpulse.functions.ratio import ratio, money

__all__ = [
    "DAY_FMT", "MONTH_FMT", "day_key", "month_key", "month_of_day_key", "monday", "iso_week",
    "iso_year", "ts_bound", "day_start",
    "BANDS_COARSE", "BANDS_FINE", "BANDS_DETAIL", "IMPUTE_COARSE", "IMPUTE_FINE",
    "cut_length", "parse_headcount", "headcount_number", "band", "impute_headcount",
    "ratio", "money",
]
