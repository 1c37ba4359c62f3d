"""Advisory matching, severity and the vulnerability table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit import schemas
from pkgaudit.functions.binding import bind
from pkgaudit.functions.severity import (
    SEVERITIES,
    cvss3_score,
    infer_severity_from_text,
    severity_bucket,
    severity_floor,
    severity_rank,
)
from pkgaudit.functions.versions import pep503_name, version_key
from pkgaudit.operators.intervals import points_in_intervals
from pkgaudit.operators.keys import PACKAGE, compute_once, explode_rows, first_per_key
from pkgaudit.session import cut_lineage

# Ecosystem names in the advisory database.
OSV_ECOSYSTEMS = {"npm": "npm", "pypi": "PyPI", "cargo": "crates.io", "go": "Go", "ruby": "RubyGems"}

NO_DESCRIPTION = "No description available"


def parse_advisories(documents: DataFrame) -> DataFrame:
    """Advisory records from JSON text in column 'body', each parsed once."""
    parsed = compute_once(documents.select("body"), "_a", F.from_json("body", schemas.ADVISORY_BODY))
    return parsed.select("_a.*")


def osv_ecosystem(ecosystem: Column) -> Column:
    pairs = [F.lit(x) for kv in OSV_ECOSYSTEMS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), ecosystem)


def advisory_queries(deps: DataFrame) -> DataFrame:
    """Distinct package versions to look up: database ecosystem, and null version for '*'."""
    return (
        deps.select(*PACKAGE)
        .distinct()
        .withColumn("osv_ecosystem", osv_ecosystem(F.col("ecosystem")))
        .withColumn("query_version", F.nullif(F.col("version"), F.lit("*")))
    )


def _match_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "PyPI", pep503_name(name)).otherwise(name)


def _spans(package: Column) -> Column:
    """Version intervals, as version keys, and listed versions of one affected entry.

    The events of a range are put in the order of their versions, however they are listed. Each
    'introduced' one runs to the next 'fixed' or 'limit', which it does not reach, or to the next
    'last_affected', which it still holds; commit ranges are left out. Version 0 is before all.
    """
    empty = F.lit(None).cast("string")

    def opened(r: Column) -> Column:
        def ends(kind: str, inclusive: bool) -> Column:
            some = F.filter(r["events"], lambda e: F.coalesce(e[kind], F.lit("")) != "")
            return F.transform(some, lambda e: F.struct(
                version_key(e[kind]).alias("key"), F.lit(inclusive).alias("inclusive")))

        def intervals(stops: Column) -> Column:
            def interval(e: Column) -> Column:
                start = F.when(e["introduced"] == "0", F.lit("")).otherwise(version_key(e["introduced"]))

                def up_to_stop(key: Column) -> Column:
                    stop = F.array_min(F.filter(stops, lambda s: (s["key"] > key) | (s["inclusive"] & (s["key"] == key))))
                    return bind(stop, lambda s: F.struct(
                        empty.alias("listed"), key.alias("from_key"),
                        F.when(~s["inclusive"], s["key"]).alias("to_key"), F.when(s["inclusive"], s["key"]).alias("last_key")))

                return bind(start, up_to_stop)

            return F.transform(F.filter(r["events"], lambda e: F.coalesce(e["introduced"], F.lit("")) != ""), interval)

        return bind(F.concat(ends("fixed", False), ends("limit", False), ends("last_affected", True)), intervals)

    ranges = F.filter(package["ranges"], lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")
    listed = F.transform(
        package["versions"],
        lambda v: F.struct(v.alias("listed"), empty.alias("from_key"), empty.alias("to_key"), empty.alias("last_key")),
    )
    none = F.array().cast("array<struct<listed:string,from_key:string,to_key:string,last_key:string>>")
    return F.concat(F.coalesce(F.flatten(F.transform(ranges, opened)), none), F.coalesce(listed, none))


def advisory_packages(advisories: DataFrame) -> DataFrame:
    """One row per advisory and affected package: id, osv_ecosystem, match_name and all its spans.

    Entries of an advisory for the same package are put together within the advisory's own row.
    """
    entries = F.transform(
        F.col("affected"),
        lambda p: F.struct(
            F.struct(
                p["package"]["ecosystem"].alias("osv_ecosystem"),
                _match_name(p["package"]["ecosystem"], p["package"]["name"]).alias("match_name"),
            ).alias("key"),
            _spans(p).alias("spans"),
        ),
    )
    rows = advisories.select("id", entries.alias("_entries"))
    rows = explode_rows(rows, F.array_distinct(F.col("_entries.key")), "_key")
    same = F.filter("_entries", lambda e: e["key"] == F.col("_key"))
    return rows.select("id", "_key.*", F.flatten(F.transform(same, lambda e: e["spans"])).alias("spans"))


def match_advisories(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, version, id) of every package version an advisory affects.

    The dependencies are reduced to distinct package versions first, so the joins grow with the
    number of published versions in use and not with how often they are used. Versions meet version
    intervals by rank blocks (`points_in_intervals`), so a package with many versions and many advisories costs
    its hits and not all pairs; listed versions meet by their text, and a version that is not known meets
    every advisory of its name. All are equi joins on ids and keys. The three kinds of hits are made to be
    disjoint and without repeats, so that the hits, many more than the advisories, are never shuffled.
    """
    named = ["osv_ecosystem", "match_name"]
    # Both sides are read several times: parsed and reduced once.
    wanted = cut_lineage(advisory_queries(deps).select(
        *PACKAGE, "osv_ecosystem", "query_version",
        _match_name(F.col("osv_ecosystem"), F.col("name")).alias("match_name"),
        version_key(F.col("query_version")).alias("at_key"),
    ))
    # Parsed texts again: written rows keep the small size that Spark takes them for, so no join may broadcast them.
    packages = cut_lineage(advisory_packages(advisories).select("id", *named, "spans")).hint("merge")
    spans = packages.select("id", *named, F.explode("spans").alias("s")).select("id", *named, "s.*")
    any_version = wanted.filter(F.col("query_version").isNull()).join(packages.select("id", *named).distinct(), named)
    ranges = spans.filter(F.col("listed").isNull()).drop("listed")
    inside = points_in_intervals(wanted.select(*PACKAGE, *named, "at_key"), ranges, named, merge_by=["id"])
    listed = spans.filter(F.col("listed").isNotNull()).select("id", *named, F.col("listed").alias("query_version")).distinct()
    # A listed version that a range of the advisory holds as well is a hit of the range already.
    texts = wanted.join(listed, [*named, "query_version"]).alias("w")
    again = F.col("w.id").eqNullSafe(F.col("r.id"))
    for name in named:
        again = again & (F.col(f"w.{name}") == F.col(f"r.{name}"))
    key = F.col("w.at_key")
    again = again & (F.col("r.from_key") <= key) & F.when(
        F.col("r.to_key").isNotNull(), key < F.col("r.to_key")).otherwise(
        F.col("r.last_key").isNull() | (key <= F.col("r.last_key")))
    hits = [any_version, texts.join(ranges.alias("r"), again, "left_anti"), inside]
    return reduce(DataFrame.unionByName, [h.select(*PACKAGE, "id") for h in hits])


def backfill_advisory_details(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Stub advisories without severity replaced by their detail record where there is one."""
    columns = stubs.columns
    detail = details.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_detail_{c}") for c in columns])
    bare = F.coalesce(F.size("severity"), F.lit(0)) <= 0
    complete = stubs.filter(~bare)
    # Parsed texts are many times what Spark takes them for: never a table to broadcast. Column by column, so that
    # only those in use are moved.
    filled = (
        stubs.filter(bare)
        .join(detail.hint("merge"), F.col("id") == F.col("_id"), "left")
        .select(*[F.when(F.col("_id").isNotNull(), F.col(f"_detail_{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    )
    return complete.unionByName(filled)


def _first_bucket(entries: Column) -> Column:
    """Severity of the first entry with a usable score of no type or type CVSS_V3."""
    usable = F.filter(
        F.transform(
            F.filter(
                entries,
                lambda e: (F.coalesce(e["score"], F.lit("")) != "")
                & F.coalesce(e["type"], F.lit("")).isin("", "CVSS_V3"),
            ),
            lambda e: cvss3_score(e["score"]),
        ),
        lambda s: s.isNotNull(),
    )
    return severity_bucket(F.get(usable, F.lit(0)))


def advisory_severity() -> Column:
    """Top-level scores, then the database's own, then per-package scores, then the wording."""
    raw = F.col("database_specific.severity")
    named = F.when(F.upper(raw).isin(*SEVERITIES), severity_bucket(severity_floor(F.upper(raw))))
    listed = F.when(
        F.ltrim(raw).startswith("["), _first_bucket(F.from_json(raw, schemas.SEVERITY_ENTRIES))
    )
    affected = _first_bucket(F.flatten(F.filter(F.col("affected.severity"), lambda s: s.isNotNull())))
    return F.coalesce(
        _first_bucket(F.col("severity")), named, listed, affected,
        infer_severity_from_text(F.col("id"), F.col("summary"), F.col("details")),
    )


def advisory_cvss(severity: Column) -> Column:
    """Score of the first top-level CVSS_V3 entry, else the floor of the severity."""
    first = F.get(F.filter(F.col("severity"), lambda e: e["type"] == "CVSS_V3"), F.lit(0))
    return F.coalesce(cvss3_score(first["score"]), severity_floor(severity))


def fixed_versions() -> Column:
    """Distinct fixing versions in order, joined; null when there are none."""
    events = F.flatten(
        F.flatten(F.transform(F.filter("affected", lambda p: p["ranges"].isNotNull()),
                              lambda p: F.transform(p["ranges"], lambda r: r["events"])))
    )
    fixes = F.array_distinct(
        F.transform(F.filter(events, lambda e: F.coalesce(e["fixed"], F.lit("")) != ""), lambda e: e["fixed"])
    )
    return F.nullif(F.array_join(fixes, ", "), F.lit(""))


def affected_versions() -> Column:
    """Ranges and listed versions as text; a later 'introduced' in a range starts its text anew."""

    def range_text(r: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            opened = F.when(
                F.coalesce(e["introduced"], F.lit("")) != "", F.concat(F.lit(">="), e["introduced"])
            ).otherwise(acc)
            return F.when(
                F.coalesce(e["fixed"], F.lit("")) != "", F.concat(opened, F.lit(" <"), e["fixed"])
            ).otherwise(opened)

        return F.aggregate(r["events"], F.lit(""), step)

    def package_texts(p: Column) -> Column:
        ranges = F.coalesce(
            F.filter(F.transform(p["ranges"], range_text), lambda t: t != ""), F.array().cast("array<string>")
        )
        listed = F.when(
            p["versions"].isNotNull(), F.array(F.array_join(p["versions"], ", "))
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(ranges, listed)

    texts = F.flatten(F.transform(F.col("affected"), package_texts))
    return F.when(F.size(texts) > 0, F.array_join(texts, ", ")).otherwise(F.lit("Unknown"))


def advisory_facts(advisories: DataFrame) -> DataFrame:
    """One display record per advisory, computed once before it is joined to packages."""
    scored = advisories.withColumn("_severity", advisory_severity())
    summary = F.nullif(F.col("summary"), F.lit(""))
    return scored.select(
        "id",
        F.col("_severity").alias("severity"),
        F.coalesce(summary, F.col("id")).alias("title"),
        F.coalesce(F.nullif(F.col("details"), F.lit("")), summary, F.lit(NO_DESCRIPTION)).alias("description"),
        advisory_cvss(F.col("_severity")).alias("cvss"),
        F.coalesce(F.col("references.url"), F.array().cast("array<string>")).alias("references"),
        affected_versions().alias("affected_versions"),
        fixed_versions().alias("fixed_versions"),
        F.col("published").alias("published_date"),
        F.lit("OSV").alias("source"),
    )


def to_vulnerability(hits: DataFrame, advisories: DataFrame) -> DataFrame:
    """Vulnerability rows of the matched package versions."""
    # The facts are texts, many times what Spark takes them for: dealt out by id and not broadcast.
    return hits.join(advisory_facts(advisories).hint("shuffle_hash"), "id").select(
        "id",
        F.col("name").alias("package_name"),
        F.col("version").alias("package_version"),
        "ecosystem", "severity", "title", "description", "cvss", "references",
        "affected_versions", "fixed_versions", "published_date", "source",
    )


def union_sources(*vulns: DataFrame | None) -> DataFrame:
    """Rows of all data sources in the order given; a source without an answer (None) adds nothing."""
    answered = [v for v in vulns if v is not None]
    if not answered:
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in VULNERABILITY_KEY) + ", source_rank int")
    ranked = [v.withColumn("source_rank", F.lit(i)) for i, v in enumerate(answered)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


VULNERABILITY_KEY = ["id", "ecosystem", "package_name", "package_version"]


def dedup_vulnerabilities(vulns: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per key: the last CRITICAL, else the last HIGH, else the first row."""
    tier = F.least(severity_rank(F.col("severity")), F.lit(2))
    order = F.struct(tier, F.when(tier < 2, -F.col(ordinal)).otherwise(F.col(ordinal)))
    return first_per_key(vulns, VULNERABILITY_KEY, order)


def order_by_severity(vulns: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return vulns.orderBy(severity_rank(F.col("severity")), ordinal)


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]


def severity_summary(vulns: DataFrame, *by: str) -> DataFrame:
    """Total and the five severity counters, per group or over all rows."""
    return vulns.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *severity_counts())
