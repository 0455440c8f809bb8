"""Numeric expressions with explicit missing-value and rounding rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def number(value, fill: float | None = None) -> Column:
    """Double or NULL: text that does not parse and NaN both count as missing; ``fill`` replaces missing."""
    raw = as_col(value).try_cast("double")
    clean = F.nullif(raw, F.lit(float("nan")))
    return clean if fill is None else F.coalesce(clean, F.lit(float(fill)))


def filled(value, fill: float) -> Column:
    """A numeric column with NULL replaced; for columns that were already read with :func:`number`."""
    return F.coalesce(as_col(value).cast("double"), F.lit(float(fill)))


def bounded(value, low: float, high: float) -> Column:
    """Bound a column that is never NULL; names it once, which keeps long expression chains small."""
    return F.least(F.greatest(as_col(value), F.lit(float(low))), F.lit(float(high)))


def ratio(numerator, denominator, fill: float | None = None) -> Column:
    """Safe division: NULL parts, zero denominators and non-finite results become ``fill``."""
    q = F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))
    finite = F.when(F.isnan(q) | (F.abs(q) == float("inf")), F.lit(None).cast("double")).otherwise(q)
    return finite if fill is None else F.coalesce(finite, F.lit(float(fill)))


def clip(value, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bound a value and keep NULL as NULL (``greatest``/``least`` alone would skip it)."""
    c = as_col(value)
    out = c
    if high is not None:
        hi = high if isinstance(high, Column) else F.lit(float(high))
        out = F.when(c > hi, hi).otherwise(out)
    if low is not None:
        lo = low if isinstance(low, Column) else F.lit(float(low))
        out = F.when(c < lo, lo).otherwise(out)
    return out


def half_even(value, digits: int = 0) -> Column:
    """Round half to even on the scaled double, the rule numpy and pandas use."""
    c = as_col(value).cast("double")
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * scale) / F.lit(scale)


def half_up(value) -> Column:
    """Round half towards plus infinity, the rule dashboards written in JavaScript use."""
    return F.floor(as_col(value) + 0.5)


def right_closed(value, edges: Sequence[float], labels: Sequence[str], otherwise: str | None = None) -> Column:
    """Label the interval ``(edge[i], edge[i+1]]`` a value falls into."""
    c = as_col(value)
    branch = None
    for low, high, label in zip(edges, edges[1:], labels):
        test = (c > low) & (c <= high)
        branch = F.when(test, label) if branch is None else branch.when(test, label)
    return branch.otherwise(F.lit(otherwise))


def truthy(value) -> Column:
    """Boolean with NULL read as false."""
    return F.coalesce(as_col(value).cast("boolean"), F.lit(False))


def zero_as_null(value) -> Column:
    """Some consumers show a zero amount as missing; this is that switch."""
    c = as_col(value)
    return F.when(c != 0, c)
