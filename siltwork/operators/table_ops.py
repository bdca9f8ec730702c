"""Cleaning operations on tables of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import texts as X
from siltwork.functions import values as V
from siltwork.operators.profile import quantile_values
from siltwork.operators.registry import RID, Param, op

MAYBE = (bool, type(None))


def each(df: DataFrame, columns: list[str], f) -> DataFrame:
    """f applied to each of the columns in one projection."""
    return df.withColumns({c: f(F.col(f"`{c}`")) for c in columns}) if columns else df


def is_text(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.simpleString() == "string"


def decimal_styles(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which columns write their decimals with a comma; one pass for all."""
    votes = {c: V.decimal_votes(F.col(f"`{c}`")) for c in columns}
    row = df.agg(*[v.alias(f"{i}_{k}") for i, c in enumerate(columns) for k, v in zip("eu", votes[c])]).first()
    return {c: row[f"{i}_e"] > row[f"{i}_u"] for i, c in enumerate(columns)}


def day_orders(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    row = df.agg(*[V.day_votes(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: V.day_comes_first(row[str(i)]) for i, c in enumerate(columns)}


def _numbers(df: DataFrame, columns: list[str], decimal_comma: bool | None) -> DataFrame:
    styles = decimal_styles(df, columns) if decimal_comma is None else dict.fromkeys(columns, decimal_comma)
    return df.withColumns({c: V.to_number(F.col(f"`{c}`"), styles[c]) for c in columns})


@op("table", "standardize_null_tokens", "safe", "words for missing become null", needs_columns=True, all_columns_ok=True)
def standardize_null_tokens(df, columns):
    return each(df, [c for c in columns if is_text(df, c)], lambda c: F.when(~V.is_missing(c), c))


@op("table", "mask_injection_text", "lossy", "sentences that try to steer a reader are masked", needs_columns=True)
@op("text", "mask_injection_text", "lossy", "sentences that try to steer a reader are masked")
def mask_injection_text(df, columns):
    return each(df, columns or ["text"], X.mask_injection)


@op("table", "trim_whitespace", "safe", "no space at the ends", needs_columns=True, all_columns_ok=True)
def trim_whitespace(df, columns):
    return each(df, [c for c in columns if is_text(df, c)], V.trimmed)


@op("table", "normalize_case", "lossy", "one case for all values", needs_columns=True, params={"case": Param(str, "title", choices=("lower", "title", "upper"))})
def normalize_case(df, columns, case):
    return each(df, columns, lambda c: V.cased(c, case))


@op("table", "strip_currency", "safe", "amounts become numbers", needs_columns=True, converts=True, params={"decimal_comma": Param(MAYBE, None)})
@op("table", "cast_numeric", "safe", "values become numbers", needs_columns=True, converts=True, params={"decimal_comma": Param(MAYBE, None)})
def cast_numeric(df, columns, decimal_comma):
    return _numbers(df, columns, decimal_comma)


@op("table", "parse_percent", "safe", "percentages become numbers", needs_columns=True, converts=True, params={"as_fraction": Param(bool, False)})
def parse_percent(df, columns, as_fraction):
    out = _numbers(df, columns, None)
    return each(out, columns, lambda c: c / 100) if as_fraction else out


@op("table", "parse_dates", "safe", "dates become timestamps", needs_columns=True, converts=True, params={"dayfirst": Param(MAYBE, None)})
def parse_dates(df, columns, dayfirst):
    orders = day_orders(df, columns) if dayfirst is None else dict.fromkeys(columns, dayfirst)
    return df.withColumns({c: V.to_timestamp(F.col(f"`{c}`"), orders[c]) for c in columns})


@op("table", "parse_boolean", "safe", "words for true and false become booleans", needs_columns=True, converts=True)
def parse_boolean(df, columns):
    return each(df, columns, V.to_boolean)


@op("table", "mark_as_id", "view", "columns are identifiers", needs_columns=True)
def mark_as_id(df, columns):
    return df.withMetadata(columns[0], {"identifier": True}) if len(columns) == 1 else _marked(df, columns)


def _marked(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withMetadata(c, {"identifier": True})
    return df


@op("table", "drop_empty_columns", "safe", "columns without a value go")
def drop_empty_columns(df, columns):
    own = [c for c in df.columns if c != RID]
    row = df.agg(*[F.count_if(~V.is_missing(F.col(f"`{c}`"))).alias(str(k)) for k, c in enumerate(own)]).first()
    return df.drop(*[c for k, c in enumerate(own) if row[str(k)] == 0])


@op("table", "drop_constant_columns", "lossy", "columns with one value at most go")
def drop_constant_columns(df, columns):
    own = [c for c in df.columns if c != RID]
    # two different values, or not: no distinct count is needed
    row = df.agg(*[(F.coalesce(F.min(F.col(f"`{c}`")) == F.max(F.col(f"`{c}`")), F.lit(True))).alias(str(k)) for k, c in enumerate(own)]).first()
    return df.drop(*[c for k, c in enumerate(own) if row[str(k)]])


@op("table", "drop_columns", "destructive", "named columns go", needs_columns=True)
def drop_columns(df, columns):
    return df.drop(*columns)


@op("table", "drop_exact_duplicates", "destructive", "the first of equal rows stays")
def drop_exact_duplicates(df, columns):
    own = [c for c in df.columns if c != RID]
    if RID not in df.columns:
        return df.dropDuplicates()
    return df.groupBy(*[F.col(f"`{c}`") for c in own]).agg(F.min(RID).alias(RID)).select(*[F.col(f"`{c}`") for c in df.columns])


@op("table", "drop_rows_missing_in", "destructive", "rows with a null there go", needs_columns=True)
def drop_rows_missing_in(df, columns):
    return df.na.drop("any", subset=columns)


@op("table", "impute_median", "lossy", "null becomes the median", needs_columns=True)
def impute_median(df, columns):
    known = quantile_values(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(q[0])) for c, q in known.items()})


def most_frequent(df: DataFrame, c: str):
    """The most frequent value, the least of several."""
    v = F.col(f"`{c}`")
    row = df.filter(v.isNotNull()).groupBy(v.alias("v")).count().orderBy(F.desc("count"), "v").limit(1).first()
    return None if row is None else row["v"]


@op("table", "impute_mode", "lossy", "null becomes the most frequent value", needs_columns=True)
def impute_mode(df, columns):
    from siltwork.operators.registry import PlanError

    modes = {c: most_frequent(df, c) for c in columns}
    if none := [c for c, m in modes.items() if m is None]:
        raise PlanError(f"impute_mode: {', '.join(none)} has no value")
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in modes.items()})


@op("table", "impute_constant", "lossy", "null becomes a given value", needs_columns=True, params={"value": Param((str, float, int, bool))})
def impute_constant(df, columns, value):
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(value).cast(df.schema[c].dataType)) for c in columns})


@op("table", "add_missing_indicator", "safe", "a column tells where a value was null", needs_columns=True)
def add_missing_indicator(df, columns):
    return df.withColumns({f"{c}_was_missing": F.col(f"`{c}`").isNull() for c in columns})


@op("table", "winsorize", "lossy", "values beyond two quantiles move there", needs_columns=True, params={"lower": Param(float, 0.01, 0, 0.25), "upper": Param(float, 0.99, 0.75, 1)})
def winsorize(df, columns, lower, upper):
    out = {}
    for c, (low, high) in quantile_values(df, columns, [lower, upper]).items():
        v = F.col(f"`{c}`")
        out[c] = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(high)), F.lit(low)))
    return df.withColumns(out) if out else df


def iqr_fences(q1: Column, q3: Column, k: float = 1.5) -> tuple[Column, Column]:
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


@op("table", "flag_outliers", "safe", "a column tells which values lie beyond 1.5 quartile distances", needs_columns=True)
def flag_outliers(df, columns):
    known, out = quantile_values(df, columns, [0.25, 0.75]), {}
    for c in columns:
        if c not in known:
            out[f"{c}_outlier"] = F.lit(False)
        else:
            q1, q3 = known[c]
            v = F.col(f"`{c}`")
            out[f"{c}_outlier"] = F.coalesce((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1)), F.lit(False))
    return df.withColumns(out)


@op("table", "standardize_column_names", "safe", "names in snake case")
def standardize_column_names(df, columns):
    return df.toDF(*[V.snake_name(c) for c in df.columns])
