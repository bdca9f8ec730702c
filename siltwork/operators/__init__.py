"""Operators on DataFrames; importing the package fills the catalogue."""

from siltwork.operators import media_ops, table_ops, text_ops  # noqa: F401
