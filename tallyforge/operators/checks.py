"""Constraint checks: each is a DataFrame of violations; a suite counts them all in one result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def must_hold(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; like a SQL check, null passes."""
    return df.filter(~F.coalesce(condition, F.lit(True)))


def unique(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys with several rows, among the rows that `where` selects; keys with a null pass."""
    rows = (df if where is None else df.filter(where)).dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def references(child: DataFrame, keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """Child rows without a parent; rows with a null in the key pass."""
    known = parent.select(*[F.col(p).alias(c) for c, p in zip(keys, parent_keys, strict=True)])
    return child.dropna(subset=list(keys)).join(known, list(keys), "left_anti")


def exactly_one(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which not exactly one of the columns is filled."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.filter(filled != 1)


def one_current(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys with more than one current row."""
    return unique(df, [key], F.col(flag))


def suite(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, violations), one row per check."""
    out = None
    for name, violations in checks.items():
        row = violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
