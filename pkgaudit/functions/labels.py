"""Display labels of the report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Explanation of each reason a dependency stayed unresolved.
UNRESOLVED_REASONS = {
    "not_found": "Package not found in registry",
    "registry_unavailable": "Registry service unavailable",
    "no_access": "No access to private registry",
    "invalid_spec": "Invalid version specification",
}


def half_up(value: Column) -> Column:
    """Round half towards plus infinity, as whole number."""
    return F.floor(value + 0.5).cast("bigint")


def age_label(days: Column) -> Column:
    """'Unknown', 'today', days, months, or years with one decimal below ten."""
    years = days / 365.0
    return (
        F.when(days.isNull() | F.isnan(days.cast("double")) | (days < 0), F.lit("Unknown"))
        .when(days < 1, F.lit("today"))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo")))
        .when(years < 10, F.concat(F.format_number(years, 1), F.lit("y")))
        .otherwise(F.concat(F.floor(years).cast("string"), F.lit("y")))
    )


def reference_label(url: Column) -> Column:
    """Short label of a reference link with the advisory id, CVE id or host where there is one."""
    kind = (
        F.when(url.contains("cve.org"), F.lit("CVE"))
        .when(url.contains("github.com"), F.lit("GitHub"))
        .when(url.contains("nvd.nist.gov"), F.lit("NVD"))
        .otherwise(F.lit("Link"))
    )
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.try_parse_url(url, F.lit("PATH"))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    advisory = F.get(parts, F.array_position(parts, "advisories").cast("int"))
    cve = F.get(F.filter(parts, lambda p: p.startswith("CVE-")), F.lit(0))
    identifier = F.when(
        host.isNotNull(),
        F.when(url.contains("github.com/advisories/"), advisory)
        .when(url.contains("cve.org") | url.contains("nvd.nist.gov"), cve)
        .otherwise(F.regexp_replace(host, r"^www\.", "")),
    )
    return F.when(F.coalesce(identifier, F.lit("")) != "", F.concat(kind, F.lit(" · "), identifier)).otherwise(kind)


def unresolved_reason(reason: Column) -> Column:
    pairs = [F.lit(x) for kv in UNRESOLVED_REASONS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), reason)


def repo_name(url: Column) -> Column:
    """owner/name of a GitHub address, else the last path segment without its first '.git'."""
    github = F.regexp_extract(url, r"github\.com[:/]([^/]+/[^/]+?)(\.git)?$", 1)
    last = F.element_at(F.split(url, "/"), -1)
    cut = F.regexp_replace(last, r"^(.*?)\.git", "$1")
    return F.when(url.isNull() | (url == ""), F.lit(None).cast("string")).otherwise(
        F.when(github != "", github).otherwise(cut)
    )


def relative_path(path: Column, root: str) -> Column:
    """Path below the scan root; '.' for the root itself."""
    if not root:
        return path
    rest = F.regexp_replace(F.substring(path, len(root) + 1, 1 << 30), "^/+", "")
    return F.when(
        path.startswith(root), F.when(rest == "", F.lit(".")).otherwise(rest)
    ).otherwise(path)


def provenance_label(provenance: Column) -> Column:
    return (
        F.when(provenance, F.lit("Enabled")).when(~provenance, F.lit("Missing")).otherwise(F.lit("Unknown"))
    )
