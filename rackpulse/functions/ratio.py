"""Safe ratios and money output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num / den`` as double; null when ``den`` is 0 or null (the reports' dialect semantics)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def money(c) -> Column:
    """Exact decimal sums leave the operators as double."""
    return _col(c).cast("double")


def line_amount(price) -> Column:
    """``price * quantity`` of an order line: exact for decimal prices, double for double ones."""
    return _col(price) * F.col("quantity").cast("decimal(12,0)")
