"""Whole texts through Python functions, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: rows of a batch that are Python objects at one time
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts at a time are held twice."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_texts(
    docs: DataFrame,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[str | None], tuple]],
    text: str = "text",
) -> DataFrame:
    """docs -> the columns `keep` as they are, and `fields` from make()(text) for each row.

    make is called once for each task. Only `keep` and the text go to Python.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + list(fields))
    kinds = to_arrow_schema(schema)
    first = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in slices(batches):
            rows = [f(t) for t in b.column(first).to_pylist()]
            made = [pa.array([r[k] for r in rows], kinds.field(first + k).type) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(kinds.field(k).type) for k in range(first)), *made], schema=kinds)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, schema)


def once_per_batch(f: Callable[[str | None], str | None]):
    """A column function that Spark evaluates once only, even where it is filtered on."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()


def replace_text(docs: DataFrame, new: Column) -> DataFrame:
    """docs with another text, and n_chars, where there is one, in step with it; a row whose text is null only now goes."""
    held = docs.withColumn("__new_text", new).filter(F.col("text").isNull() | F.col("__new_text").isNotNull())
    changed = ~F.col("text").eqNullSafe(F.col("__new_text"))
    length = F.length("__new_text")

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__new_text").alias("text")
        if c == "n_chars":
            return F.when(changed, length.cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(f"`{c}`")

    return held.select(*[column(c) for c in docs.columns])


def share_of(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 that depends on the values of the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    """The `rows` of docs (doc_id, text, ...) with the least hashes, in that order, whatever the layout of the table."""
    own = docs.withColumn("__share", share_of(seed, "doc_id", "text"))
    n = docs.count()
    if n > rows:  # few more than asked for, so that few are sorted
        own = own.filter(F.col("__share") < (rows + 6 * rows**0.5 + 50) / n)
    return own.orderBy("__share", "doc_id", "text").limit(rows).drop("__share")
