"""The catalogue of cleaning operations: typed parameters, risk, and a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RID = "rid"
MEDIA = ("table", "text", "image", "audio", "video")
RISKS = ("safe", "lossy", "destructive", "view")


class PlanError(ValueError):
    """An operation that can't run as it is written."""


@dataclass(frozen=True)
class Param:
    kind: type | tuple[type, ...]
    default: Any = ...
    low: float | None = None
    high: float | None = None
    choices: tuple | None = None
    most: int | None = None  # of a list

    def checked(self, name: str, value: Any) -> Any:
        kinds = self.kind if isinstance(self.kind, tuple) else (self.kind,)
        if value is None and type(None) in kinds:
            return None
        if float in kinds and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, kinds) or isinstance(value, bool) and bool not in kinds:
            raise PlanError(f"{name}: {value!r} has the wrong type")
        if self.choices is not None and value not in self.choices:
            raise PlanError(f"{name}: {value!r} is none of {', '.join(map(str, self.choices))}")
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise PlanError(f"{name}: {value!r} is not between {self.low} and {self.high}")
        if self.most is not None and not 1 <= len(value) <= self.most:
            raise PlanError(f"{name}: between 1 and {self.most} entries are asked for")
        return value


@dataclass(frozen=True)
class OpSpec:
    media: str
    name: str
    risk: str
    run: Callable[..., DataFrame]  # (df, columns, **params)
    about: str
    params: dict[str, Param] = field(default_factory=dict)
    needs_columns: bool = False
    all_columns_ok: bool = False
    converts: bool = False  # values that don't parse become null
    names_rows: bool = False  # takes known, a table of all rows that may be named

    def values(self, given: dict[str, Any] | None) -> dict[str, Any]:
        given = dict(given or {})
        out = {}
        for name, p in self.params.items():
            if name in given:
                out[name] = p.checked(name, given.pop(name))
            elif p.default is ...:
                raise PlanError(f"{self.name}: parameter {name} is missing")
            else:
                out[name] = p.default
        if given:
            raise PlanError(f"{self.name}: unknown parameters {', '.join(sorted(given))}")
        return out


CATALOG: dict[str, dict[str, OpSpec]] = {m: {} for m in MEDIA}


def op(media: str, name: str, risk: str, about: str, **more) -> Callable:
    """Puts a function into the catalogue of each of the media, named with spaces between."""

    def put(run: Callable) -> Callable:
        for m in media.split():
            CATALOG[m][name] = OpSpec(m, name, risk, run, about, **more)
        return run

    return put


def apply_op(df: DataFrame, media: str, name: str, columns: list[str] | None = None, params: dict | None = None, known: DataFrame | None = None) -> DataFrame:
    """Validate and apply one operation of the catalogue; known: a table with the rows that operations before it removed."""
    spec = CATALOG[media].get(name)
    if spec is None:
        raise PlanError(f"unknown operation {name}")
    columns = list(columns or [])
    if unknown := [c for c in columns if c not in df.columns]:
        raise PlanError(f"{name}: no column {', '.join(unknown)}")
    if spec.needs_columns and not columns:
        if not spec.all_columns_ok:
            raise PlanError(f"{name}: columns are asked for")
        columns = [c for c in df.columns if c != RID]
    if not spec.needs_columns and columns and media == "table":
        raise PlanError(f"{name}: takes no columns")
    more = {"known": known} if spec.names_rows else {}
    return spec.run(df, columns, **spec.values(params), **more)


def with_rid(df: DataFrame) -> DataFrame:
    """A row number that grows with the order in the source; sources that have a key should use it in its place."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def keep_first(df: DataFrame, key, order: str = RID) -> DataFrame:
    """The first row of each key.

    Only key and order are grouped, with partial aggregation, so that a hot key costs no sort of its rows and no text
    goes through the aggregation; order tells rows apart.
    """
    if order not in df.columns:
        return df.withColumn("__key", key).dropDuplicates(["__key"]).drop("__key")
    first = df.select(F.xxhash64(key).alias("h"), F.md5(key.cast("string")).alias("m"), F.col(order)).groupBy("h", "m").agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
