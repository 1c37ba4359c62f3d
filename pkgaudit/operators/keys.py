"""Grouping keys and the 'one row per key' aggregates shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKAGE = ["ecosystem", "name", "version"]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the least order value of every key.

    An aggregate, not a window: each task reduces its share of a key to one row before the
    shuffle, so a key holding most of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def dep_key(ecosystem: Column, name: Column) -> Column:
    return F.concat(ecosystem, F.lit(":"), name)


def package_label(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("@"), version)


def explode_rows(df: DataFrame, values: Column | str, alias: str) -> DataFrame:
    """One row per array element, all columns kept.

    The outer form plus a filter: for a plain explode the optimizer adds a size test on the
    array in front, which evaluates the array expression (often a JSON parse) twice.
    """
    return df.withColumn(alias, F.explode_outer(values)).filter(F.col(alias).isNotNull())


def explode_entries(df: DataFrame, values: Column, key: str, value: str) -> DataFrame:
    """One row per map entry, all columns kept; see explode_rows."""
    return df.select("*", F.explode_outer(values).alias(key, value)).filter(F.col(key).isNotNull())


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later filters cannot pull apart.

    A filter on a computed column is pushed below it by repeating its expression, which for an
    expensive one doubles the work. As the element of a generated one-entry array it stays a value.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))
