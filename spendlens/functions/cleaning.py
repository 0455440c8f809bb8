"""Cleaning expressions for report cells. One rule object per source family, no row functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, number

# Cell texts that mean "no value", and symbols stripped from amounts, per report family.
EMPTY = ("", "None")
EMPTY_OR_DASH = ("", "None", "-")
EMPTY_OR_NOT_ENTERED = ("", "None", "N/A", "Not Entered")
QUOTED_EMPTY = ("", '""')

# A column whose name contains one of these is read as a number.
NUMERIC_NAME_PARTS = (
    "amount", "budget", "tcv", "cpl", "cpc", "leads", "clicks", "duration", "cycles", "clients",
)

# Date spellings tried in order; the first that parses wins.
DATE_PATTERNS = (
    "yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd", "M-d-yyyy", "M/d/yy", "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMM d yyyy",
    "yyyyMMdd",
)
# A time of day after a date, with seconds, fractions, AM or PM, and a zone, as far as it is written.
TIME_OF_DAY = r"(?i)[T ]\s*\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([AP]M)?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?$"


@dataclass(frozen=True)
class CellRules:
    """How one report family spells numbers and missing cells."""

    missing: tuple[str, ...] = EMPTY
    number_strip: tuple[str, ...] = ("$", ",")
    integer_strip: tuple[str, ...] = ()
    text_strip: tuple[str, ...] = ()
    strict_integer: bool = False
    edge_quotes_only: bool = False


PIPELINE_CELLS = CellRules()
AGREED_CPL_CELLS = CellRules(EMPTY_OR_NOT_ENTERED, ("$", ",", '"'), (",", '"'), ('"',))
GRADER_CELLS = CellRules(EMPTY_OR_DASH, ("USD", "$", ",", '"'), (",", '"'), ('"',))
ALERT_CELLS = CellRules(QUOTED_EMPTY, (), (), (), strict_integer=True, edge_quotes_only=True)


def _present(cell: Column, rules: CellRules) -> Column:
    return F.when(~cell.isin(*rules.missing), cell)


def _stripped(cell: Column, parts: tuple[str, ...], rules: CellRules) -> Column:
    text = F.trim(_present(cell, rules))
    if rules.edge_quotes_only:
        text = F.trim(F.btrim(text, F.lit('"')))
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return _present(F.trim(text), rules)


def clean_number(value, rules: CellRules = PIPELINE_CELLS) -> Column:
    return number(_stripped(as_col(value).cast("string"), rules.number_strip, rules))


def clean_integer(value, rules: CellRules = PIPELINE_CELLS) -> Column:
    text = _stripped(as_col(value).cast("string"), rules.integer_strip, rules)
    if rules.strict_integer:
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return number(text).try_cast("bigint")


def clean_date(value, rules: CellRules = PIPELINE_CELLS, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    return parse_date(_stripped(as_col(value).cast("string"), rules.text_strip, rules), patterns)


def clean_text(value, rules: CellRules = PIPELINE_CELLS) -> Column:
    return _stripped(as_col(value).cast("string"), rules.text_strip, rules)


def parse_date(text, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """The date in a cell; a time of day behind it is dropped, as written, whatever its zone."""
    cell = F.regexp_replace(F.trim(as_col(text)), TIME_OF_DAY, "")
    return F.coalesce(*[F.try_to_date(cell, p) for p in patterns])


def null_tokens(value, tokens: tuple[str, ...] = ("", "NULL")) -> Column:
    cell = as_col(value)
    return F.when(~cell.isin(*tokens), cell)


def numeric_cell(value) -> Column:
    """Keep digits, dots and minus signs, then parse; anything that still does not parse is NULL."""
    return number(F.regexp_replace(as_col(value).cast("string"), r"[^\d.-]", ""))


def is_numeric_name(name: str) -> bool:
    return any(part in name.lower() for part in NUMERIC_NAME_PARTS)


def is_date_name(name: str) -> bool:
    return "date" in name.lower()


def unicode_text(value, mode: str = "compat") -> Column:
    """Repair exported text. ``compat`` also deletes blanks between word characters, as wide-encoded
    exports need; ``collapse`` only drops control marks and squeezes blanks."""
    text = F.coalesce(as_col(value).cast("string"), F.lit(""))
    text = F.translate(text, "﻿\u0000", "")
    if mode == "compat":
        text = F.regexp_replace(text, r"(?U)(\w)\s+(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def valid_email(value) -> Column:
    return F.coalesce(
        as_col(value).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), F.lit(False)
    )


def valid_positive(value) -> Column:
    return F.coalesce(number(value) > 0, F.lit(False))


def valid_date(value, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(as_col(value), pattern).isNotNull()


def percent_to_fraction(utilization, spent, budget, cycle_days) -> Column:
    """Utilization arrives as a percentage. Above 300 the elapsed days are inferred from spend
    (between half a day and the whole cycle) and the share is recomputed on them."""
    util, spend = as_col(utilization), as_col(spent)
    daily = F.try_divide(as_col(budget), as_col(cycle_days))
    days_needed = F.try_divide(spend, daily)
    days = F.least(F.greatest(days_needed, F.lit(0.5)), as_col(cycle_days))
    plain = F.when(util != 0, util / 100.0)
    usable = spend.isNotNull() & as_col(budget).isNotNull() & (daily.isNotNull()) & (as_col(budget) != 0)
    return F.when(usable & (util > 300), F.try_divide(spend, daily * days) * 100.0 / 100.0).otherwise(plain)


def raw_text_flags(head) -> dict[str, Column]:
    """Guards for a downloaded report, given its first line as text (the words are fixed values of the portals)."""
    text = F.lower(as_col(head))
    trimmed = F.ltrim(text)
    return {
        "looks_like_login": text.contains("maincontent-logon")
        | text.contains("corporate portal")
        | text.contains('name="ux"'),
        "looks_like_json": trimmed.startswith("{") | trimmed.startswith("["),
        "looks_like_html": trimmed.startswith("<!doctype") | trimmed.startswith("<html"),
    }
