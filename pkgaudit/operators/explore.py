"""Looking into packages: list, read and search their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit.functions.binding import bind
from pkgaudit.functions.paths import glob_pattern
from pkgaudit.operators.keys import PACKAGE, explode_rows, first_per_key


def list_files(files: DataFrame, glob: str | None = None) -> DataFrame:
    """The files of each package, those that fit the glob if there is one: (package, entry, ordinal)."""
    rows = files if not glob else files.filter(F.col("path").rlike(glob_pattern(glob)))
    return rows.select(*PACKAGE, F.col("path").alias("entry"), "ordinal")


def folder_counts(files: DataFrame) -> DataFrame:
    """The number of files below each top folder of a package; files outside any are at (root)."""
    top = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(F.lit("(root)"))
    return files.groupBy(*PACKAGE, top.alias("entry")).agg(F.count(F.lit(1)).alias("file_count"))


def read_file(files: DataFrame, path: str) -> DataFrame:
    """The file at a path in each package, else the first whose path ends with it."""
    exact = F.col("path") == path
    hits = files.filter(exact | F.col("path").endswith(path)).select(*PACKAGE, "path", "ordinal", "content")
    return first_per_key(hits, PACKAGE, F.struct(~(F.col("path") == path), F.col("ordinal")))


def grep_files(files: DataFrame, pattern: str, file_glob: str | None = None, context: int = 2) -> DataFrame:
    """Every matching line with the lines around it: one narrow pass, the snippets cut inside the file's own row."""
    rows = files.select(*PACKAGE, "path", "ordinal", "content")
    if file_glob:
        rows = rows.filter(F.col("path").rlike("(?i)" + file_glob.replace("*", ".*")))
    expression = "(?i)" + pattern

    def snippets(lines: Column) -> Column:
        def around(i: Column) -> Column:
            start = F.greatest(i - context, F.lit(0))
            shown = F.transform(
                F.slice(lines, start + 1, i + context - start + 1),
                lambda text, k: F.concat(
                    F.when(start + k == i, F.lit("> ")).otherwise(F.lit("  ")),
                    (start + k + 1).cast("string"), F.lit(": "), text))
            return F.struct((i + 1).alias("line"), F.array_join(shown, "\n").alias("snippet"))

        numbers = F.filter(
            F.transform(lines, lambda line, i: F.when(line.rlike(expression), i)), lambda n: n.isNotNull())
        return F.transform(numbers, around)

    found = rows.select(*PACKAGE, "path", "ordinal", bind(F.split("content", "\n"), snippets).alias("_hits"))
    return explode_rows(found, F.col("_hits"), "_hit").select(*PACKAGE, "path", "ordinal", "_hit.line", "_hit.snippet")
