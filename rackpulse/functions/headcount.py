"""Company headcount: free text -> number -> size band, and imputation from the rack count.

The headcount column is free text (``'120'``, ``'120+'``, ``'120人'``, ``'30~50'``, ``''``, ``' '``,
null, ...). Comparisons with numbers go through ``try_cast(.. as double)``: text that is not a number
compares as null, so it falls through to the ELSE branch instead of raising (ANSI) or matching.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class BandSpec:
    """Ordered, low-inclusive ranges: ``x < edges[0]`` -> labels[0], ...,
    ``x >= edges[-1]`` -> labels[-1]. ``empty`` labels null / ``''`` text first (None: no such
    rule); ``other`` labels non-numeric text (None: keep the text itself)."""

    edges: tuple
    labels: tuple
    empty: str | None = None
    other: str | None = None


@dataclass(frozen=True)
class ImputeRule:
    """Rack-count range ``lo <= racks <= hi`` (None = open) and the headcount it implies."""

    lo: int | None
    hi: int | None
    label: str


# ---- fixed values: band label sets and imputation rules of the reports ----
# coarse bands, with 'empty' for missing text and 'other' for text that is not a number
BANDS_COARSE = BandSpec(edges=(30, 50, 100, 300),
                        labels=("30-", "30-50", "50-100", "100-300", "300+"),
                        empty="empty", other="other")
# fine bands; text that is not a number is kept as it is
BANDS_FINE = BandSpec(edges=(25, 50, 100, 300, 500),
                      labels=("1~24", "25~49", "50~99", "100~299", "300~499", "500+"))
# bands of the headcount detail table; text that is not a number is kept as it is
BANDS_DETAIL = BandSpec(edges=(30, 50, 100, 300),
                        labels=("30-", "30~49", "50~99", "100~299", "300+"))
# missing headcount guessed from the number of racks: racks < 4, 4..10, > 10
IMPUTE_COARSE = (ImputeRule(None, 3, "30~50"), ImputeRule(4, 10, "100~300"),
                 ImputeRule(11, None, "300+"))
# racks <= 2, 3, 4..10, 11..16, > 16
IMPUTE_FINE = (ImputeRule(None, 2, "30"), ImputeRule(3, 3, "50"), ImputeRule(4, 10, "100"),
               ImputeRule(11, 16, "300"), ImputeRule(17, None, "500"))
# ---- end of fixed values ----


def cut_length(text) -> Column:
    """Characters kept when parsing: the text length without ``'+'`` signs, as bigint.

    The source formula ``(3*len - len) / 2`` reduces to ``len`` for every input, so a leading
    ``'+'`` shortens the kept prefix: ``'+50'`` keeps ``'+5'`` and parses as ``'5'``.
    """
    return F.length(F.replace(_col(text), F.lit("+"), F.lit(""))).cast("bigint")


def parse_headcount(text) -> Column:
    """First run of digits in the kept prefix; ``''`` when the text is null, empty, or has
    nothing to keep; ``''`` also when the prefix holds no digit (``regexp_extract`` no-match)."""
    t = _col(text)
    n = cut_length(t)
    kept = t.substr(F.lit(1), n.cast("int"))
    return F.when(n > 0, F.regexp_extract(kept, r"([0-9]+)", 1)).otherwise(F.lit(""))


def headcount_number(text) -> Column:
    """Numeric value of headcount text, null when it is not a number."""
    return _col(text).try_cast("double")


def band(text, spec: BandSpec) -> Column:
    """Map headcount text to a band label following ``spec``."""
    t = _col(text)
    x = headcount_number(t)
    e, lab = spec.edges, spec.labels
    expr = F.when(t.isNull() | (t == ""), F.lit(spec.empty)) if spec.empty is not None else None

    def add(cond, label):
        nonlocal expr
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))

    add(x < e[0], lab[0])
    for i in range(1, len(e)):
        add((x >= e[i - 1]) & (x < e[i]), lab[i])
    add(x >= e[-1], lab[-1])
    return expr.otherwise(F.lit(spec.other) if spec.other is not None else t)


def impute_headcount(text, racks, rules=IMPUTE_COARSE, null_as_empty: bool = False) -> Column:
    """Replace missing headcount with the label of the rack-count rule that matches.

    As written in the reports (``x is null or x = '' and n < 4`` with AND binding tighter), a null
    headcount always takes the FIRST rule whatever the rack count; only ``''`` is matched by
    range. ``null_as_empty=True`` treats null like ``''`` (the evident intent).
    """
    t, n = _col(text), _col(racks)
    empty = (t.isNull() | (t == "")) if null_as_empty else (t == "")

    def in_range(r: ImputeRule) -> Column:
        c = F.lit(True)
        if r.lo is not None:
            c = c & (n >= r.lo)
        if r.hi is not None:
            c = c & (n <= r.hi)
        return c

    expr = None if null_as_empty else F.when(t.isNull(), F.lit(rules[0].label))
    for r in rules:
        cond = empty & in_range(r)
        expr = F.when(cond, F.lit(r.label)) if expr is None else expr.when(cond, F.lit(r.label))
    return expr.otherwise(t)
