"""Report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit.functions.labels import half_up, provenance_label, relative_path, unresolved_reason
from pkgaudit.functions.severity import SEVERITIES, severity_of_rank, severity_rank
from pkgaudit.operators.advisories import NO_DESCRIPTION, severity_summary
from pkgaudit.operators.keys import PACKAGE, package_label

PACKAGE_COLUMNS = ["ecosystem", "package_name", "package_version"]

# Severity levels a scan can be made to fail on.
FAIL_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def aggregate_by_package(vulns: DataFrame, findings: DataFrame) -> DataFrame:
    """Per package version: worst severity and how many vulnerabilities and findings it has.

    Both feeds are added up as one tagged union, which needs one shuffle of partial sums. The rows
    behind a package stay rows, see package_findings.
    """
    def feed(df: DataFrame, static: int) -> DataFrame:
        rank = F.least(severity_rank(F.col("severity")), F.lit(len(SEVERITIES) - 1))
        return df.select(
            *PACKAGE_COLUMNS, rank.alias("_rank"), F.lit(static).cast("bigint").alias("_s"),
            F.lit(1 - static).cast("bigint").alias("_f"),
        )

    both = feed(vulns, 1).unionByName(feed(findings, 0))
    grouped = both.groupBy(*PACKAGE_COLUMNS).agg(
        F.min("_rank").alias("_rank"), F.sum("_s").alias("static_count"), F.sum("_f").alias("supply_chain_count")
    )
    return grouped.select(
        *PACKAGE_COLUMNS, severity_of_rank(F.col("_rank")).alias("highest_severity"), "static_count",
        "supply_chain_count",
    )


def package_findings(vulns: DataFrame, findings: DataFrame) -> DataFrame:
    """The rows behind aggregate_by_package, of both feeds, keyed by package."""
    static = vulns.select(
        *PACKAGE_COLUMNS, F.lit("static").alias("feed"), F.col("id").alias("label"), "severity", "title",
        F.lit(None).cast("double").alias("confidence"), "ordinal",
    )
    supply = findings.select(
        *PACKAGE_COLUMNS, F.lit("supply chain").alias("feed"), F.col("category").alias("label"), "severity", "title",
        "confidence", "ordinal",
    )
    return static.unionByName(supply)


def aggregated_summary(aggregated: DataFrame) -> DataFrame:
    return aggregated.agg(
        F.count(F.lit(1)).alias("total_packages"),
        F.count_if(F.col("static_count") > 0).alias("packages_with_static_findings"),
        F.count_if(F.col("supply_chain_count") > 0).alias("packages_with_supply_chain_findings"),
        *[F.count_if(F.col("highest_severity") == s).alias(s.lower()) for s in SEVERITIES],
    )


def filter_min_severity(vulns: DataFrame, level: str | None) -> DataFrame:
    """Rows at or above a level; an unknown level keeps all."""
    if not level or level.upper() not in SEVERITIES:
        return vulns
    return vulns.filter(severity_rank(F.col("severity")) <= SEVERITIES.index(level.upper()))


def filter_uninformative(vulns: DataFrame) -> DataFrame:
    """All rows but those of UNKNOWN severity that say nothing else either."""
    def stated(name: str, empty: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit("")).isin("", empty)

    description = F.trim(F.coalesce("description", F.lit("")))
    informative = (
        ((description != "") & (F.col("description") != NO_DESCRIPTION))
        | (F.coalesce(F.size("references"), F.lit(0)) > 0)
        | F.col("cvss").isNotNull()
        | (F.coalesce("fixed_versions", F.lit("")) != "")
        | stated("affected_versions", "Unknown")
    )
    return vulns.filter((F.col("severity") != "UNKNOWN") | informative)


def hidden_count(all_rows: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: how many rows a filter hides, from one aggregate over both."""
    tagged = all_rows.select(F.lit(1).alias("n")).unionAll(shown.select(F.lit(-1).alias("n")))
    return tagged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hidden"))


def fail_on(summary: DataFrame, level: str | None) -> DataFrame:
    """Summary rows with 'failed': anything at the level or above; an unknown level never fails."""
    name = (level or "").upper()
    if name not in FAIL_LEVELS:
        return summary.withColumn("failed", F.lit(False))
    counters = [s.lower() for s in FAIL_LEVELS[: FAIL_LEVELS.index(name) + 1]]
    return summary.withColumn("failed", reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counters]))


TOTALS = ("total", "critical", "high", "medium", "low", "unknown")


def overview_totals(vuln_summary: DataFrame, finding_summary: DataFrame) -> DataFrame:
    """Sum of the two one-row summaries."""
    static = vuln_summary.select(*TOTALS)
    supply = finding_summary.select(
        F.col("total_findings").alias("total"), "critical", "high", "medium", "low", F.lit(0).alias("unknown")
    )
    return static.unionByName(supply).agg(*[F.sum(c).alias(c) for c in TOTALS])


def is_unpinned() -> Column:
    spec = F.coalesce("version_spec", F.lit(""))
    npm = (
        spec.startswith("^") | spec.startswith("~") | spec.contains("*") | spec.contains("x") | spec.contains("X")
        | (spec == "latest")
    )
    pypi = ~spec.startswith("==") | spec.contains(">") | spec.contains("~=")
    return F.when(F.col("ecosystem") == "npm", npm).when(F.col("ecosystem") == "pypi", pypi).otherwise(F.lit(False))


def unpinned_dependencies(deps: DataFrame) -> DataFrame:
    return deps.filter(is_unpinned())


def vulnerable_split(deps: DataFrame, aggregated: DataFrame) -> DataFrame:
    """One row: dependencies with and without findings, from counts per package version."""
    counts = deps.groupBy(*PACKAGE).agg(F.count(F.lit(1)).alias("n"))
    hit = aggregated.select(
        "ecosystem", F.col("package_name").alias("name"), F.col("package_version").alias("version"),
        F.lit(True).alias("_hit"),
    ).distinct()
    zero = F.lit(0).cast("bigint")
    return counts.join(hit, PACKAGE, "left").agg(
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)), zero).alias("vulnerable"),
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n")).otherwise(0)), zero).alias("safe"),
    )


def dependency_table(
    deps: DataFrame, vulns: DataFrame, search: str = "", vulnerable_only: bool = False,
    no_provenance_only: bool = False,
) -> DataFrame:
    """Dependencies with the worst severity known for their name."""
    worst = vulns.groupBy(F.col("package_name").alias("name")).agg(
        F.min(severity_rank(F.col("severity"))).alias("_rank")
    )
    rows = deps
    if search:
        rows = rows.filter(F.lower("name").contains(search.lower()) | F.col("version").contains(search))
    if no_provenance_only:
        rows = rows.filter(~F.col("provenance"))
    rows = rows.join(worst, "name", "inner" if vulnerable_only else "left")
    known = F.col("_rank").isNotNull()
    return rows.select(
        "ordinal", *PACKAGE, "file", "is_dev", known.alias("is_vulnerable"),
        F.coalesce(severity_of_rank(F.col("_rank")), F.lit("N/A")).alias("max_severity"),
        provenance_label(F.col("provenance")).alias("provenance_status"),
    )


def vulnerability_table(
    vulns: DataFrame, findings: DataFrame, search: str = "", severity: str = "all"
) -> DataFrame:
    """Both feeds in one table. The files behind a package name are in package_file_links."""
    static = vulns.select("id", "package_name", "package_version", "severity", "title", F.lit("OSV").alias("source"),
                          F.lit(None).cast("string").alias("file"))
    supply = findings.select(
        F.col("category").alias("id"), "package_name", "package_version", "severity", "title",
        F.lit("LLM").alias("source"), F.nullif("file_path", F.lit("")).alias("file"),
    )
    rows = static.unionByName(supply)
    if search:
        text = search.lower()
        rows = rows.filter(
            F.lower("package_name").contains(text) | F.lower("id").contains(text) | F.lower("title").contains(text)
        )
    return rows if severity == "all" else rows.filter(F.col("severity") == severity)


def package_file_links(deps: DataFrame, vulns: DataFrame, scan_path: str = "") -> DataFrame:
    """Distinct (package_name, file): manifests below the scan path that name a vulnerable package.

    One row per link, so a package named everywhere is no large value in any row.
    """
    hit = vulns.select(F.col("package_name").alias("name")).distinct()
    return deps.join(hit, "name", "left_semi").select(
        F.col("name").alias("package_name"), relative_path(F.col("file"), scan_path).alias("file")
    ).distinct()


def unresolved_table(unresolved: DataFrame) -> DataFrame:
    return unresolved.withColumn("reason_text", unresolved_reason(F.col("reason")))


def scan_totals(manifests: DataFrame, deps: DataFrame, vulns: DataFrame) -> DataFrame:
    """Per repository: files, packages, vulnerabilities and the verdict, from one tagged union."""
    parts = []
    severe = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    zero = F.lit(0).cast("bigint")
    n = F.count(F.lit(1))
    for df, column in ((manifests, "files"), (deps, "packages"), (vulns, "vulnerabilities")):
        counts = df.groupBy("repo").agg(n.alias("n"), (severe if df is vulns else F.max(zero)).alias("severe"))
        parts.append(counts.select("repo", *[
            (F.col("n") if c == column else zero).alias(c) for c in ("files", "packages", "vulnerabilities")
        ], "severe"))
    totals = reduce(DataFrame.unionByName, parts).groupBy("repo").agg(
        *[F.sum(c).alias(c) for c in ("files", "packages", "vulnerabilities", "severe")]
    )
    verdict = (
        F.when(F.col("vulnerabilities") == 0, F.lit("clear"))
        .when(F.col("severe") > 0, F.lit("needs attention"))
        .otherwise(F.lit("review recommended"))
    )
    return totals.withColumn("verdict", verdict)


def package_findings_text(vulns: DataFrame, findings: DataFrame) -> DataFrame:
    """The per-package text report as lines: (package, part, ordinal, line), part and ordinal giving the order."""
    aggregated = aggregate_by_package(vulns, findings)
    head = aggregated.select(
        *PACKAGE_COLUMNS, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ordinal"),
        F.concat("highest_severity", F.lit(" "), package_label(F.col("package_name"), F.col("package_version")),
                 F.lit(" ["), "ecosystem", F.lit("]")).alias("line"),
    )

    def heading(count: str, part: int, text: str) -> DataFrame:
        return aggregated.filter(F.col(count) > 0).select(
            *PACKAGE_COLUMNS, F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(text).alias("line")
        )

    titled = F.when(
        ~F.coalesce("title", F.lit("")).isin("", NO_DESCRIPTION), F.concat(F.lit(" — "), "title")
    ).otherwise(F.lit(""))
    static = vulns.select(
        *PACKAGE_COLUMNS, F.lit(2).alias("part"), "ordinal",
        F.concat(F.lit("  • "), "severity", F.lit(" rule matched: "), "id", titled).alias("line"),
    )
    supply = findings.select(
        *PACKAGE_COLUMNS, F.lit(4).alias("part"), "ordinal",
        F.concat(F.lit("  • "), "severity", F.lit(" "), "category", F.lit(": "), "title", F.lit(" ("),
                 half_up(F.col("confidence") * 100).cast("string"), F.lit("% confidence)")).alias("line"),
    )
    parts = [
        head, heading("static_count", 1, "  Static Analysis:"), static,
        heading("supply_chain_count", 3, "  Supply Chain Analysis:"), supply,
    ]
    return reduce(DataFrame.unionByName, parts)


def vulnerability_text(vulns: DataFrame) -> DataFrame:
    """Vulnerabilities with 'text': the block a terminal report shows for each."""
    def part(condition: Column, *text) -> Column:
        return F.when(condition, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])).otherwise(F.lit(""))

    c = F.col
    title, description = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    text = F.concat(
        c("severity"), F.lit(" - "), c("id"), F.lit("\nPackage: "),
        package_label(c("package_name"), c("package_version")),
        part(~title.isin("", NO_DESCRIPTION) & (title != c("id")), "\nTitle: ", title),
        part(F.coalesce("cvss", F.lit(0.0)) != 0, "\nCVSS Score: ", c("cvss").cast("string")),
        part(~F.coalesce("affected_versions", F.lit("")).isin("", "Unknown"), "\nAffected: ", c("affected_versions")),
        part(F.coalesce("fixed_versions", F.lit("")) != "", "\nFixed in: ", c("fixed_versions")),
        part((F.trim(description) != "") & (description != title) & (description != NO_DESCRIPTION), "\n\n", description),
        part(
            F.size("references") > 0, "\n\nReferences:\n",
            F.array_join(F.transform("references", lambda r: F.concat(F.lit("  • "), r)), "\n"),
        ),
        F.lit("\n\nSource: "), c("source"),
    )
    return vulns.withColumn("text", text)


def repo_summary(vulns: DataFrame, level: str | None = None) -> DataFrame:
    """Severity counters and the failure gate per repository."""
    return fail_on(severity_summary(vulns, "repo"), level)
