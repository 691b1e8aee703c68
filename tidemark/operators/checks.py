"""Validation of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: dict[str, tuple[Column, str]]) -> Column:
    """field: message for each rule that doesn't hold (or is null), in order, joined by "; "."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{field}: {message}")) for field, (ok, message) in rules.items()]
    return F.array_join(F.array_compact(F.array(*found)), "; ")


def split_valid(df: DataFrame, rules: dict[str, tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with their errors."""
    checked = df.withColumn("errors", errors(rules))
    return checked.filter("errors = ''").drop("errors"), checked.filter("errors <> ''")


def required(c: Column) -> Column:
    return F.trim(c) != ""


def email(c: Column) -> Column:
    return required(c) & c.contains("@")


def at_least(c: Column, n: int) -> Column:
    return F.length(F.trim(c)) >= n
