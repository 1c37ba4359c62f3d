"""Publish dates, package ages and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit import schemas
from pkgaudit.functions.versions import pep503_name
from pkgaudit.operators.keys import PACKAGE, explode_rows, first_per_key, package_label

DAY_MILLIS = 86_400_000


def answered(docs: DataFrame, ecosystem: str | None = None, *kinds: str) -> DataFrame:
    """Documents with a body and an OK status, of one ecosystem and some kinds."""
    rows = docs.filter(F.col("status").between(200, 299) & F.col("body").isNotNull())
    if ecosystem:
        rows = rows.filter(F.col("ecosystem") == ecosystem)
    return rows.filter(F.col("kind").isin(*kinds)) if kinds else rows


def comparable_version(ecosystem: Column, version: Column) -> Column:
    """Version text under which documents and packages meet: Go drops the leading v."""
    return F.when(ecosystem == "go", F.regexp_replace(version, "^v", "")).otherwise(version)


_DATE = "struct<version:string,published_at:string,preference:int>"


def _dates_in(body: Column, version: Column) -> dict[tuple[str, ...], Column]:
    """Publish times a document holds, by ecosystem and document kinds."""

    def date(v: Column, time: Column, preference: int = 0) -> Column:
        return F.struct(v.alias("version"), time.alias("published_at"), F.lit(preference).alias("preference"))

    npm = F.from_json(body, "time map<string,string>")["time"]
    pypi = F.from_json(body, schemas.PYPI_BODY)
    crate = F.from_json(body, schemas.CRATE_BODY)
    go = F.from_json(body, schemas.GO_INFO_BODY)
    gem = F.from_json(body, schemas.GEM_BODY)
    upload = F.array_min(
        F.transform(pypi["urls"], lambda f: F.coalesce(f["upload_time_iso_8601"], f["upload_time"]))
    )
    single = date(F.coalesce(crate["version"]["num"], version), crate["version"]["created_at"], 1)
    return {
        ("npm", "package"): F.transform(F.map_entries(npm), lambda e: date(e["key"], e["value"])),
        ("pypi", "version", "latest"): F.array(date(F.coalesce(pypi["info"]["version"], version), upload)),
        ("cargo", "package", "version", "latest"): F.concat(
            F.coalesce(
                F.transform(crate["versions"], lambda v: date(v["num"], v["created_at"])),
                F.array().cast(f"array<{_DATE}>"),
            ),
            F.array(single).cast(f"array<{_DATE}>"),
        ),
        ("go", "version", "latest"): F.array(date(F.coalesce(go["Version"], version), go["Time"])),
        ("ruby", "version", "latest"): F.array(
            date(F.coalesce(gem["version"], gem["number"], version), F.coalesce(gem["created_at"], gem["built_at"]))
        ),
        ("ruby", "versions"): F.transform(
            F.from_json(body, schemas.GEM_VERSIONS_BODY),
            lambda v: date(v["number"], F.coalesce(v["created_at"], v["built_at"]), 1),
        ),
    }


def by_document(docs: DataFrame, choices: dict[tuple[str, ...], Column], element: str) -> DataFrame:
    """Rows (ecosystem, name, version, _x) of the array each kind of document yields, in one scan."""
    value = reduce(
        lambda acc, item: acc.when(
            (F.col("ecosystem") == item[0][0]) & F.col("kind").isin(*item[0][1:]), item[1].cast(f"array<{element}>")
        ),
        choices.items(), F,
    )
    known = reduce(
        lambda a, b: a | b,
        [(F.col("ecosystem") == k[0]) & F.col("kind").isin(*k[1:]) for k in choices],
    )
    return explode_rows(answered(docs).filter(known).select("ecosystem", "name", "version", value.alias("_a")), "_a", "_x")


def version_dates(docs: DataFrame) -> DataFrame:
    """(ecosystem, name, version, published_at): when each version in the snapshot was published."""
    rows = by_document(docs, _dates_in(F.col("body"), F.col("version")), _DATE).select("ecosystem", "name", "_x.*")
    return (
        rows.filter(F.coalesce(F.col("published_at"), F.lit("")) != "")
        .withColumn("version", comparable_version(F.col("ecosystem"), F.col("version")))
        .groupBy(*PACKAGE)
        .agg(F.min(F.struct("preference", "published_at"))["published_at"].alias("published_at"))
    )


def published_at(pkgs: DataFrame, registry_docs: DataFrame) -> DataFrame:
    """Distinct package versions with their publish time as ISO text; null when unknown."""
    wanted = pkgs.select(*PACKAGE).distinct()
    dates = version_dates(registry_docs).withColumnRenamed("version", "_version")
    return (
        wanted.withColumn("_version", comparable_version(F.col("ecosystem"), F.col("version")))
        .join(dates, ["ecosystem", "name", "_version"], "left")
        .select(*PACKAGE, "published_at")
    )


def age_days(iso: Column, as_of: str) -> Column:
    """Whole days from an ISO time to the reference time; null when the text is no time."""
    then = F.unix_millis(F.try_to_timestamp(iso))
    return F.floor((F.unix_millis(F.lit(as_of).cast("timestamp")) - then) / DAY_MILLIS).cast("bigint")


def package_ages(vulns: DataFrame, registry_docs: DataFrame, as_of: str) -> DataFrame:
    """Publish time and age of every package version that has a vulnerability."""
    pkgs = vulns.select(
        "ecosystem", F.col("package_name").alias("name"), F.col("package_version").alias("version")
    ).filter(F.coalesce(F.col("version"), F.lit("")) != "")
    dated = published_at(pkgs, registry_docs).withColumn("age_days", age_days(F.col("published_at"), as_of))
    return dated.filter(F.col("age_days").isNotNull())


def apply_package_ages(vulns: DataFrame, ages: DataFrame) -> DataFrame:
    """Vulnerabilities with publish time and age where known."""
    lookup = ages.select(
        "ecosystem", F.col("name").alias("package_name"), F.col("version").alias("package_version"),
        F.col("published_at").alias("package_published_at"), F.col("age_days").alias("package_age_days"),
    )
    return vulns.join(lookup, ["ecosystem", "package_name", "package_version"], "left")


def verify_provenance(deps: DataFrame, registry_docs: DataFrame) -> DataFrame:
    """Attestation status of the npm and PyPI package versions among the dependencies."""
    v = F.col("version")
    npm_range = (v == "*") | v.startswith("^") | v.startswith("~") | v.contains(">") | v.contains("<")
    pypi_range = (v == "*") | v.startswith(">") | v.startswith("<")
    is_npm = F.col("ecosystem") == "npm"
    wanted = (
        deps.filter(F.col("ecosystem").isin("npm", "pypi"))
        .select(*PACKAGE)
        .distinct()
        .withColumn("_name", F.when(is_npm, F.col("name")).otherwise(pep503_name(F.col("name"))))
        .withColumn(
            "_lookup", F.when(F.when(is_npm, npm_range).otherwise(pypi_range), F.lit("latest")).otherwise(v)
        )
    )
    docs = registry_docs.filter(
        F.col("ecosystem").isin("npm", "pypi") & F.col("kind").isin("version", "latest")
    )
    ok = F.col("status").between(200, 299)
    predicate = F.get_json_object("body", "$.dist.attestations.provenance.predicateType")
    attested = F.filter(
        F.from_json("body", schemas.PYPI_BODY)["urls"], lambda f: f["attestations"].isNotNull()
    )
    first_attested = F.get(attested, F.lit(0))["attestations"]
    doc_npm = F.col("ecosystem") == "npm"
    status = docs.select(
        "ecosystem",
        F.when(doc_npm, F.col("name")).otherwise(pep503_name(F.col("name"))).alias("_name"),
        F.when(F.col("kind") == "latest", F.lit("latest")).otherwise(F.col("version")).alias("_lookup"),
        F.when(ok, F.when(doc_npm, F.coalesce(predicate, F.lit("")) != "")
               .otherwise(F.coalesce(F.size(attested), F.lit(0)) > 0)).otherwise(F.lit(False)).alias("_has"),
        F.when(ok, F.when(doc_npm, F.get_json_object("body", "$.dist.attestations.url"))
               .otherwise(F.get_json_object(first_attested, "$.provenance.url"))).alias("_url"),
        F.when(~ok, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).alias("_error"),
        F.lit(True).alias("_seen"),
    )
    # Several documents may answer for one normalised name: an attested one counts, then one without error.
    best = F.struct(~F.col("_has"), F.col("_error").isNotNull(), F.coalesce("_url", F.lit("")), F.coalesce("_error", F.lit("")))
    status = first_per_key(status, ["ecosystem", "_name", "_lookup"], best)
    return wanted.join(status, ["ecosystem", "_name", "_lookup"], "left").select(
        F.col("name").alias("package_name"), "version", "ecosystem",
        F.coalesce(F.col("_has"), F.lit(False)).alias("has_provenance"),
        F.col("_url").alias("provenance_url"),
        F.when(F.col("_seen").isNull(), F.lit("HTTP 404")).otherwise(F.col("_error")).alias("error"),
    )


def apply_provenance(deps: DataFrame, provenance: DataFrame) -> DataFrame:
    """Dependencies with provenance set where verified; unknown stays null."""
    known = provenance.select(
        "ecosystem", F.col("package_name").alias("name"), "version", F.col("has_provenance").alias("_verified")
    )
    if "provenance" not in deps.columns:
        deps = deps.withColumn("provenance", F.lit(None).cast("boolean"))
    return (
        deps.join(known, PACKAGE, "left")
        .withColumn("provenance", F.coalesce(F.col("_verified"), F.col("provenance")))
        .drop("_verified")
    )


def provenance_summary(deps: DataFrame) -> DataFrame:
    """One row: how many are attested, missing and unknown. Those missing are in missing_provenance."""
    return deps.agg(
        F.count_if(F.col("provenance")).alias("with_provenance"),
        F.count_if(~F.col("provenance")).alias("without_provenance"),
        F.count_if(F.col("provenance").isNull()).alias("unknown_provenance"),
    )


def missing_provenance(deps: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The dependencies without provenance: (ordinal, label)."""
    return deps.filter(~F.col("provenance")).select(ordinal, package_label(F.col("name"), F.col("version")).alias("label"))
