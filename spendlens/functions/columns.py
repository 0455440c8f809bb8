"""Schema-level helpers shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """The column when the frame has it, otherwise a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def with_missing(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add every absent column as a typed NULL in one projection."""
    gaps = {n: F.lit(None).cast(t) for n, t in types.items() if n not in df.columns}
    return df.withColumns(gaps) if gaps else df


def keep(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def fence(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Keep later filters above this point.

    The optimizer moves a filter below projections by writing their expressions into it. After a long chain of
    columns that build on each other that text grows exponentially. A one-row ``inline`` stops the move; it
    runs inside the same generated code and does not shuffle.
    """
    names = list(columns) if columns is not None else df.columns
    return df.select(F.inline(F.array(F.struct(*names))))


def wall_time(value: dt.datetime) -> Column:
    """A timestamp literal that no session time zone shifts."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
