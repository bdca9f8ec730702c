"""Columns of values kept as strings: what is missing, what parses as what."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.functions import fixed as X


def trimmed(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    """Null, or a word for missing such as N/A."""
    s = c.cast("string")
    return s.isNull() | F.lower(trimmed(s)).isin(*X.NULL_TOKENS)


def is_hidden_missing(c: Column) -> Column:
    """A word for missing that isn't empty."""
    return F.coalesce(is_missing(c) & (trimmed(c.cast("string")) != ""), F.lit(False))


def present(c: Column) -> Column:
    """The trimmed value; null where it is missing."""
    return F.when(~is_missing(c), trimmed(c.cast("string")))


def full_match(c: Column, pattern: str) -> Column:
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return c.rlike(f"{flags}^(?:{pattern.removeprefix('(?i)')})$")


def bare_number(c: Column) -> Column:
    """Without signs of currency, percent signs and space; null where missing."""
    return F.regexp_replace(F.when(~is_missing(c), c.cast("string")), X.NUMBER_SIGNS, "")


def decimal_votes(c: Column) -> tuple[Column, Column]:
    """Counts of values that can only be European ('2.167,60') and only be US ('1,192.90') numbers."""
    b = bare_number(c)
    return F.count_if(full_match(b, X.VOTE_EU)), F.count_if(full_match(b, X.VOTE_US))


def to_number(c: Column, decimal_comma: bool = False) -> Column:
    """Plain numbers, amounts and percentages as doubles; null where nothing parses."""
    b = bare_number(c)
    b = F.replace(F.replace(b, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if decimal_comma else F.replace(b, F.lit(","), F.lit(""))
    return F.when(full_match(b, r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), b).try_cast("double")


def day_votes(c: Column) -> Column:
    """(dates, largest first part, largest second part, share of dots) for day_comes_first."""
    s = present(c)
    first, sep, second = (F.nullif(F.regexp_extract(s, X.DAY_PARTS, k), F.lit("")) for k in (1, 2, 3))
    return F.struct(
        F.count(first).alias("n"), F.max(first.cast("int")).alias("first"), F.max(second.cast("int")).alias("second"),
        F.avg(F.when(sep.isNotNull(), (sep == ".").cast("int"))).alias("dots"),
    )


def day_comes_first(votes) -> bool:
    """From a row of day_votes: a first part over 12, or dots, and no second part over 12."""
    if not votes["n"] or votes["second"] > 12:
        return False
    return votes["first"] > 12 or votes["dots"] > 0.5


def to_timestamp(c: Column, dayfirst: bool = False) -> Column:
    """Dates in any common format; ISO first, then by the order of day and month; null where nothing parses."""
    s = present(c)
    order = X.DAY_FIRST + X.MONTH_FIRST if dayfirst else X.MONTH_FIRST + X.DAY_FIRST
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in (*X.ISO_FORMATS, *order, *X.NAMED_MONTH)])


def to_boolean(c: Column) -> Column:
    w = F.lower(trimmed(c.cast("string")))
    return F.when(w.isin(*X.TRUE_WORDS), True).when(w.isin(*X.FALSE_WORDS), False)


@F.pandas_udf(T.StringType())
def title_case(values: pd.Series) -> pd.Series:
    """Upper case after every character that isn't a letter."""
    return values.str.title()


def cased(c: Column, case: str = "title") -> Column:
    s = trimmed(c.cast("string"))
    return F.lower(s) if case == "lower" else F.upper(s) if case == "upper" else title_case(s)


def snake_name(name: str) -> str:
    import re

    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def formula_safe(c: Column) -> Column:
    """A leading quote where a spreadsheet would take the cell for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def normalized_label(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[\s_-]+", " "))
    return F.when((F.length(s) > 3) & s.endswith("s") & ~s.endswith("ss"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


def file_key(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(c.cast("string"))), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def r4(c: Column) -> Column:
    """Rounded to four places; NaN and infinities are null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), F.round(d, 4))
