"""Column-expression helpers (inventory 2.B).

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = Column | str


def _c(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- B1 / B2: dates --------------------------------------------------------

def parse_mmyyyy(c: ColLike) -> Column:
    """MMYYYY text -> first day of that month; unparsable -> NULL (B1)."""
    return F.try_to_date(F.trim(_c(c)), "MMyyyy")


def parse_month_date(c: ColLike) -> Column:
    """MMYYYY first, then a standard date string; blank / 'nan' -> NULL (B2)."""
    text = F.trim(_c(c).cast("string"))
    text = F.when((text == "") | (F.lower(text) == "nan"), F.lit(None)).otherwise(text)
    return F.coalesce(F.try_to_date(text, "MMyyyy"), F.try_to_date(text))


# -- B3 / B4: tolerant casts ----------------------------------------------

def try_double(c: ColLike) -> Column:
    """Text -> double, bad text -> NULL."""
    return F.trim(_c(c).cast("string")).try_cast("double")


def try_int(c: ColLike) -> Column:
    """Text -> int with round-half-away ('3.7' -> 4, 'XX' -> NULL)."""
    return F.round(try_double(c)).try_cast("int")


# -- B5 / B10 / B11: calendar arithmetic ----------------------------------

def month_diff(later: ColLike, earlier: ColLike) -> Column:
    """Whole calendar months between two dates, day ignored."""
    a, b = _c(earlier), _c(later)
    return (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))


def add_months(c: ColLike, months: int) -> Column:
    """Calendar month shift, clamped to month end."""
    return F.add_months(_c(c), months)


def quarter_label(c: ColLike) -> Column:
    """Date -> 'YYYYQn'; sorts chronologically as text."""
    d = _c(c)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


# -- B8 / B9 / B17: null handling and guards -------------------------------

def fill_unknown(c: ColLike, value: str = "Unknown") -> Column:
    """Categorical NULL -> 'Unknown' (B8)."""
    return F.coalesce(_c(c).cast("string"), F.lit(value))


def safe_ratio(num: ColLike, den: ColLike) -> Column:
    """num / den with 0 (and NULL) denominators giving NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def clip(c: ColLike, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi] keeping NULL as NULL."""
    x = _c(c)
    out = x
    if lo is not None:
        out = F.greatest(F.lit(float(lo)), out)
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


# -- B12 / B13: code maps and fixed-edge banding ---------------------------

def code_label(c: ColLike, mapping: dict, default: str) -> Column:
    """Code -> label with a default for anything unmapped or NULL."""
    x = _c(c)
    expr = None
    for code, label in mapping.items():
        cond = x == F.lit(code)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def right_closed_band(c: ColLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Fixed edges, bins (e0, e1], (e1, e2], ...; outside -> NULL.

    ``edges`` has one more element than ``labels``.  The first bin is open on
    the left, as in a right-closed cut.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("edges must have exactly one more element than labels")
    x = _c(c).cast("double")
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


# -- B15 / B16: row-wise statistics over a column family --------------------

def row_max(cols: Sequence[ColLike]) -> Column:
    """Row-wise max skipping NULLs."""
    return F.greatest(*[_c(c) for c in cols])


def row_count_at_least(cols: Sequence[ColLike], threshold: float) -> Column:
    """How many of the columns are >= threshold (NULL counts as no)."""
    terms = [F.when(_c(c) >= threshold, 1).otherwise(0) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _non_null_array(cols: Sequence[ColLike]) -> Column:
    return F.filter(F.array(*[_c(c).cast("double") for c in cols]), lambda v: v.isNotNull())


def row_sum(cols: Sequence[ColLike]) -> Column:
    """Row-wise sum skipping NULLs; all NULL -> 0 (pandas sum)."""
    return F.aggregate(_non_null_array(cols), F.lit(0.0), lambda acc, v: acc + v)


def row_mean(cols: Sequence[ColLike]) -> Column:
    """Row-wise mean skipping NULLs; all NULL -> NULL."""
    arr = _non_null_array(cols)
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v), F.size(arr).cast("double"))


def row_std(cols: Sequence[ColLike]) -> Column:
    """Row-wise sample standard deviation (ddof=1) skipping NULLs."""
    arr = _non_null_array(cols)
    n = F.size(arr).cast("double")
    mean = F.try_divide(F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v), n)
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


# -- B22: status banding of a stability metric ------------------------------

# Monitoring thresholds and status codes.
PSI_ALERT = 0.25
PSI_REVIEW = 0.10
STATUS_ALERT, STATUS_REVIEW, STATUS_STABLE = "alert", "review", "stable"


def psi_status(c: ColLike) -> Column:
    """>= 0.25 alert, >= 0.10 review, else stable, on the unrounded value."""
    x = _c(c)
    return (F.when(x >= PSI_ALERT, F.lit(STATUS_ALERT))
            .when(x >= PSI_REVIEW, F.lit(STATUS_REVIEW))
            .otherwise(F.lit(STATUS_STABLE)))
