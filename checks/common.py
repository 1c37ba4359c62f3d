"""Helpers shared by the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import FIXTURES

AS_OF = "2024-02-01 00:00:00"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order(names) -> list[str]:
    """The named views and the views they read, each after what it reads."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for other in FIXTURES:
            if other != name and re.search(rf"\b(from|join) {other}\b", FIXTURES[name]):
                visit(other)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


DOC_KINDS = "'version', 'latest', 'package', 'dependencies', 'mod', 'list', 'versions', 'downloads', 'archive'"
# The document kinds of each library, one row each: the one place where the two dialects differ.
KINDS = {
    "duckdb": f", (select unnest([{DOC_KINDS}]) as kind) kinds",
    "spark": f"lateral view explode(array({DOC_KINDS})) kinds as kind",
}


def with_views(*names: str, dialect: str = "duckdb") -> str:
    """The WITH clause that defines the named views."""
    views = ",\n".join(f"{n} as ({FIXTURES[n].strip()})" for n in _order(names))
    return "with " + views.replace("KINDS", KINDS[dialect]) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a DataFrame over the tables of a folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    statement = with_views(name, dialect="spark") + f"select * from {name}"
    for source in TABLES:
        if re.search(rf"\b(from|join) {source}\b", statement):
            table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(statement)
