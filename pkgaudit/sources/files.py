"""Manifest reader, report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.functions.labels import relative_path
from pkgaudit.operators.discovery import MANIFEST_NAMES, find_manifests

# The fields of a vulnerability in the JSON report.
REPORT_FIELDS = (
    "id", "package_name", "package_version", "ecosystem", "severity", "title", "description", "cvss", "cwe",
    "affected_versions", "fixed_versions", "published_date", "references", "source",
)

# Column labels of the exported tables.
DEPENDENCY_HEADERS = (
    ("name", "Package Name"), ("version", "Version"), ("ecosystem", "Ecosystem"), ("file", "File Path"),
    ("is_dev", "Type"), ("is_vulnerable", "Vulnerable"), ("max_severity", "Max Severity"),
    ("provenance_status", "Provenance"),
)
VULNERABILITY_HEADERS = (
    ("severity", "Severity"), ("id", "ID"), ("source", "Source"), ("package_name", "Package"),
    ("package_version", "Version"), ("title", "Title"), ("cvss", "CVSS"), ("files", "File"),
    ("package_age_days", "Package Age (days)"), ("package_published_at", "Package Published"),
    ("references", "References"),
)


def read_manifests(
    spark: SparkSession, root: str, repo: str = "", exclude: list[str] | None = None, max_depth: int = 0
) -> DataFrame:
    """Manifest files below a folder with their whole text; unreadable files are left out.

    The name filter works on the file listing, so no other file is opened.
    """
    # The listing gives percent-encoded addresses; a plus sign in them stands for itself.
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(address, "^file:/*", "/")
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", "{" + ",".join(MANIFEST_NAMES) + "}")
        .text(root, wholetext=True)
        .select(F.lit(repo).alias("repo"), path.alias("path"), F.col("value").alias("content"))
        .withColumn("relative_path", relative_path(F.col("path"), root.rstrip("/")))
    )
    return find_manifests(files, exclude, max_depth)


def report_rows(vulns: DataFrame) -> DataFrame:
    """The fields of the JSON report; a field the table lacks is null."""
    return vulns.select(
        *[F.col(f) if f in vulns.columns else F.lit(None).cast("string").alias(f) for f in REPORT_FIELDS]
    )


def write_report_json(vulns: DataFrame, path: str) -> None:
    """One JSON record per vulnerability, one file per partition."""
    report_rows(vulns).write.mode("overwrite").json(path)


def csv_rows(df: DataFrame, headers) -> DataFrame:
    """Columns under their labels, arrays joined with '; '."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.select(*[
        (F.array_join(name, "; ") if name in arrays else F.col(name)).alias(label) for name, label in headers
    ])


def export_csv(df: DataFrame, headers, path: str) -> None:
    """CSV with label headers, doubled quotes, values as they are to the last blank, and nothing for null."""
    csv_rows(df, headers).write.mode("overwrite").options(
        header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
