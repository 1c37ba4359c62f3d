"""Package metadata and risk signals out of registry documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit import schemas
from pkgaudit.functions import signals
from pkgaudit.functions.versions import is_dependency_confusion, natural_key
from pkgaudit.operators.enrich import age_days, answered
from pkgaudit.operators.keys import compute_once, explode_entries, first_per_key, package_label
from pkgaudit.session import cut_lineage

# Registry names in fetch messages.
REGISTRY_LABELS = {"npm": "npm", "pypi": "PyPI", "cargo": "crates.io", "go": "Go proxy", "ruby": "RubyGems"}

# The document that describes a package as a whole, per ecosystem.
METADATA_KINDS = {"npm": "package", "pypi": "latest", "cargo": "package", "go": "latest", "ruby": "latest"}

STRINGS = "array<string>"
HOOKS = "map<string,string>"


def _docs(docs: DataFrame, ecosystem: str, schema: str) -> DataFrame:
    rows = answered(docs, ecosystem, METADATA_KINDS[ecosystem])
    return rows.select("ecosystem", "name", F.from_json("body", schema).alias("b"))


def _metadata(df: DataFrame, **columns) -> DataFrame:
    """The common metadata columns, with defaults for what an ecosystem does not have."""
    defaults = {
        "latest_version": F.lit(""),
        "previous_version": F.lit(None).cast("string"),
        "created_at": F.lit(""),
        "updated_at": F.lit(""),
        "weekly_downloads": F.lit(0).cast("bigint"),
        "maintainers": F.array().cast(STRINGS),
        "install_scripts": F.create_map().cast(HOOKS),
        "has_install_scripts": F.lit(False),
        "repository_url": F.lit(None).cast("string"),
        "description": F.lit(None).cast("string"),
        "license": F.lit(None).cast("string"),
        "previous_maintainers": F.array().cast(STRINGS),
        "new_maintainers": F.array().cast(STRINGS),
        "has_provenance": F.lit(False),
    }
    return df.select("ecosystem", "name", *[columns.get(n, d).alias(n) for n, d in defaults.items()])


def _with_downloads(df: DataFrame, docs: DataFrame, ecosystem: str, path: str) -> DataFrame:
    counts = answered(docs, ecosystem, "downloads").groupBy("name").agg(
        F.max(F.get_json_object("body", path).try_cast("bigint")).alias("_downloads")
    )
    return df.join(counts, "name", "left").withColumn("_downloads", F.coalesce("_downloads", F.lit(0)))


def _people(people: Column) -> Column:
    return F.coalesce(
        F.transform(people, lambda p: F.coalesce(p["name"], p["email"], F.lit("unknown"))),
        F.array().cast(STRINGS),
    )


def npm_metadata(docs: DataFrame) -> DataFrame:
    base = _docs(docs, "npm", schemas.NPM_PACKAGE_BODY).withColumn(
        "_latest", F.coalesce(F.col("b.dist-tags")["latest"], F.lit(""))
    )
    rows = base.withColumn("_meta", F.col("b.versions")[F.col("_latest")]).withColumn(
        "_previous", signals.version_before(F.map_keys("b.versions"), F.col("_latest"))
    )
    rows = _with_downloads(rows, docs, "npm", "$.downloads")
    hooks = F.coalesce(signals.install_hooks(F.col("_meta.scripts")), F.create_map().cast(HOOKS))
    current = _people(F.col("b.maintainers"))
    previous = _people(F.col("b.versions")[F.col("_previous")]["maintainers"])
    return _metadata(
        rows,
        latest_version=F.col("_latest"),
        previous_version=F.col("_previous"),
        created_at=F.coalesce(F.col("b.time")["created"], F.lit("")),
        updated_at=F.coalesce(F.col("b.time")["modified"], F.lit("")),
        weekly_downloads=F.col("_downloads"),
        maintainers=current,
        install_scripts=hooks,
        has_install_scripts=F.size(hooks) > 0,
        repository_url=F.col("b.repository.url"),
        description=F.col("b.description"),
        license=F.col("b.license"),
        previous_maintainers=previous,
        new_maintainers=signals.new_maintainers(current, previous),
        has_provenance=F.col("_meta.dist.attestations").isNotNull(),
    )


def pypi_metadata(docs: DataFrame) -> DataFrame:
    rows = _with_downloads(_docs(docs, "pypi", schemas.PYPI_BODY), docs, "pypi", "$.data.last_week")
    rows = rows.withColumn("_files", F.flatten(F.map_values("b.releases")))
    times = F.filter(
        F.transform("_files", lambda f: F.coalesce(f["upload_time_iso_8601"], f["upload_time"])),
        lambda t: F.coalesce(t, F.lit("")) != "",
    )
    author, maintainer = F.nullif(F.col("b.info.author"), F.lit("")), F.nullif(F.col("b.info.maintainer"), F.lit(""))
    people = F.array_compact(F.array(author, F.when(author.isNull() | (maintainer != author), maintainer)))
    newest = F.col("b.releases")[F.coalesce(F.col("b.info.version"), F.lit(""))]
    attested = F.exists(
        newest,
        lambda f: f["provenance_url"].isNotNull() | F.coalesce(f["metadata_version"] >= "2.3", F.lit(False)),
    )
    sdist = F.exists("_files", lambda f: F.coalesce(f["filename"].endswith(".tar.gz"), F.lit(False)))
    return _metadata(
        rows,
        latest_version=F.coalesce(F.col("b.info.version"), F.lit("")),
        created_at=F.coalesce(F.array_min(times), F.lit("")),
        updated_at=F.coalesce(F.array_max(times), F.lit("")),
        weekly_downloads=F.col("_downloads"),
        maintainers=people,
        has_install_scripts=F.coalesce(sdist, F.lit(False)),
        repository_url=F.coalesce(
            F.col("b.info.project_urls.Source"), F.col("b.info.project_urls.Repository"), F.col("b.info.home_page")
        ),
        description=F.col("b.info.summary"),
        license=F.col("b.info.license"),
        has_provenance=F.coalesce(attested, F.lit(False)),
    )


def crates_metadata(docs: DataFrame) -> DataFrame:
    rows = _docs(docs, "cargo", schemas.CRATE_BODY)
    newest = F.col("b.crate.newest_version")
    match = F.coalesce(
        F.get(F.filter("b.versions", lambda v: v["num"] == newest), F.lit(0)), F.get("b.versions", F.lit(0))
    )
    other = F.get(F.filter("b.versions", lambda v: ~v["num"].eqNullSafe(newest)), F.lit(0))
    keywords = F.transform("b.keywords", lambda k: F.coalesce(k["id"], k["keyword"], F.lit("")))
    return _metadata(
        rows,
        latest_version=F.coalesce(newest, F.lit("")),
        previous_version=other["num"],
        created_at=F.coalesce(F.col("b.crate.created_at"), match["created_at"], F.lit("")),
        updated_at=F.coalesce(F.col("b.crate.updated_at"), match["updated_at"], F.lit("")),
        weekly_downloads=F.coalesce(F.col("b.crate.downloads"), F.lit(0)),
        maintainers=F.coalesce(keywords, F.array().cast(STRINGS)),
        repository_url=F.coalesce(F.col("b.crate.repository"), F.col("b.crate.homepage")),
        description=F.col("b.crate.description"),
        license=F.col("b.crate.license"),
    )


def go_metadata(docs: DataFrame) -> DataFrame:
    lists = answered(docs, "go", "list").groupBy("name").agg(F.max("body").alias("_list"))
    rows = _docs(docs, "go", schemas.GO_INFO_BODY).join(lists, "name", "left")
    latest = F.coalesce(F.col("b.Version"), F.lit(""))
    others = F.filter(
        F.transform(F.split(F.coalesce("_list", F.lit("")), "\n"), lambda v: F.trim(v)),
        lambda v: (v != "") & (v != latest),
    )
    time = F.coalesce(F.col("b.Time"), F.lit(""))
    return _metadata(
        rows,
        latest_version=latest,
        previous_version=F.get(others, F.size(others) - 1),
        created_at=time,
        updated_at=time,
        repository_url=F.when(F.col("name").startswith("github.com/"), F.concat(F.lit("https://"), F.col("name"))),
    )


def ruby_metadata(docs: DataFrame) -> DataFrame:
    lists = answered(docs, "ruby", "versions").groupBy("name").agg(F.max("body").alias("_list"))
    rows = _docs(docs, "ruby", schemas.GEM_BODY).join(lists, "name", "left")
    latest = F.coalesce(F.col("b.version"), F.lit(""))
    numbers = F.transform(F.from_json("_list", schemas.GEM_VERSIONS_BODY), lambda v: v["number"])
    other = F.get(F.filter(numbers, lambda v: (F.coalesce(v, F.lit("")) != "") & (v != latest)), F.lit(0))
    authors = F.filter(
        F.transform(F.split(F.coalesce("b.authors", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != ""
    )
    return _metadata(
        rows,
        latest_version=latest,
        previous_version=other,
        created_at=F.coalesce("b.version_created_at", "b.created_at", F.lit("")),
        updated_at=F.coalesce("b.version_created_at", "b.updated_at", F.lit("")),
        weekly_downloads=F.coalesce("b.downloads", "b.version_downloads", F.lit(0)),
        maintainers=authors,
        repository_url=F.coalesce("b.source_code_uri", "b.homepage_uri", "b.project_uri"),
        description=F.col("b.info"),
        license=F.array_join("b.licenses", ", "),
    )


def time_signals(created: Column, updated: Column, as_of: str) -> tuple[Column, Column]:
    """Whole days since creation and since the last publication; 0 when the time is missing."""

    def days(time: Column) -> Column:
        return F.when(F.coalesce(time, F.lit("")) == "", F.lit(0)).otherwise(age_days(time, as_of))

    return days(created), days(updated)


def with_signals(metadata: DataFrame, as_of: str) -> DataFrame:
    """Metadata with the registry signals and the risk score."""
    age, published = time_signals(F.col("created_at"), F.col("updated_at"), as_of)
    rows = metadata.withColumns({
        "maintainer_changed": F.size("new_maintainers") > 0,
        "package_age_days": age,
        "published_days_ago": published,
        "typosquat_candidate": signals.typosquat_candidate(F.col("ecosystem"), F.col("name")),
        "is_dependency_confusion": is_dependency_confusion(F.col("name")),
    })
    return rows.withColumn("risk_score", signals.registry_risk_score(
        F.col("maintainer_changed"), F.col("package_age_days"), F.col("published_days_ago"),
        F.col("typosquat_candidate"), F.col("is_dependency_confusion"), F.col("has_provenance"),
    ))


def package_metadata(docs: DataFrame, as_of: str) -> DataFrame:
    """Metadata and signals of every package in the snapshot."""
    parts = [npm_metadata, pypi_metadata, crates_metadata, go_metadata, ruby_metadata]
    return with_signals(reduce(DataFrame.unionByName, [p(docs) for p in parts]), as_of)


def typosquat_candidates(pkgs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct package names that resemble a well-known one of their ecosystem, with that one.

    `known` has (ecosystem, known, place); the nearest within two edits wins, of equally near ones the
    first by place. A name that is itself known has no candidate. Without a table, the fixed lists serve.
    A table may be of any size: names and known names meet on what is left of either without up to two
    characters, so each meets its few neighbours and not the whole list. Names within one edit are looked for
    first, on what is left without one character; only the names that have none go on to two.
    """
    if known is None:
        names = pkgs.select("ecosystem", "name").filter(F.col("ecosystem").isin(*signals.KNOWN_NAMES)).distinct()
        # Kept whole, so that the null test is not moved in front of the distinct with all its comparisons.
        candidate = signals.typosquat_candidate(F.col("ecosystem"), F.col("name"))
        return compute_once(names, "candidate", candidate).filter(F.col("candidate").isNotNull())
    known = known.groupBy("ecosystem", "known").agg(F.min("place").alias("place"))
    # Numbers in the order of places, so that the least is found by a number and not by texts that must be sorted.
    listed = cut_lineage(known.orderBy("place", "known").select(
        "ecosystem", "known", F.monotonically_increasing_id().alias("_order")))
    names = pkgs.select("ecosystem", "name").distinct().withColumn("local", signals.local_name(F.col("name")))
    exact = listed.select("ecosystem", F.col("known").alias("local"))
    probes = names.select("ecosystem", "local").distinct().join(exact, ["ecosystem", "local"], "left_anti")

    def nearest(wanted: DataFrame, edits: int) -> DataFrame:
        """The first by place of the known names within so many edits; nearer ones than that have been looked for."""
        left = wanted.withColumn("_left", F.explode(signals.with_deletions(F.col("local"), edits)))
        right = listed.withColumn("_left", F.explode(signals.with_deletions(F.col("known"), edits)))
        # Exploded rows are up to hundreds of times as many as Spark takes them for: never a table to broadcast.
        # What the limit of edits rejects has distance -1.
        near = left.join(right.hint("merge"), ["ecosystem", "_left"]).filter(F.levenshtein("local", "known", edits) > 0)
        return near.groupBy("ecosystem", "local").agg(F.min("_order").alias("_order"))

    once = cut_lineage(nearest(probes, 1))
    twice = nearest(probes.join(once, ["ecosystem", "local"], "left_anti"), 2)
    found = once.unionByName(twice).join(listed.select("_order", F.col("known").alias("candidate")), "_order")
    return names.join(found, ["ecosystem", "local"]).select("ecosystem", "name", "candidate")


def previous_version(versions: DataFrame) -> DataFrame:
    """Per package the version just before its latest, from rows (ecosystem, name, version, latest).

    An aggregate with the latest at hand, so the versions of a package are never sorted together.
    """
    key, latest_key = natural_key(F.col("version")), natural_key(F.col("latest"))
    earlier = F.when(key < latest_key, F.struct(key.alias("key"), F.col("version").alias("version")))
    return (
        versions.groupBy("ecosystem", "name", "latest")
        .agg(F.max(earlier).alias("_m"), F.max(F.col("version") == F.col("latest")).alias("_listed"))
        .select("ecosystem", "name", "latest", F.when(F.col("_listed"), F.col("_m.version")).alias("previous"))
    )


def install_scripts(docs: DataFrame) -> DataFrame:
    """(ecosystem, name, version, hook, command): install-time hooks of the npm versions."""
    rows = answered(docs, "npm", "version").select(
        "ecosystem", "name", "version",
        signals.install_hooks(F.from_json("body", "scripts map<string,string>")["scripts"]).alias("hooks"),
    )
    return explode_entries(rows, F.col("hooks"), "hook", "command").drop("hooks")


def analysis_candidates(deps: DataFrame, max_packages: int = 0, ordinal: str = "ordinal") -> DataFrame:
    """First dependency of every package, the first max_packages of them if a cap is given."""
    first = first_per_key(deps, ["ecosystem", "name"], F.col(ordinal))
    return first.orderBy(ordinal).limit(max_packages) if max_packages > 0 else first


def fetch_errors(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates whose metadata, or else whose source archive, could not be had, with the reason."""
    eco = F.col("ecosystem")
    kind_pairs = [F.lit(x) for kv in METADATA_KINDS.items() for x in kv]
    label_pairs = [F.lit(x) for kv in REGISTRY_LABELS.items() for x in kv]
    meta = docs.filter(F.col("kind") == F.element_at(F.create_map(*kind_pairs), eco)).select(
        "ecosystem", "name", F.col("status").alias("_meta_status"), F.col("url").alias("_url")
    )
    archive = docs.filter(F.col("kind") == "archive").select(
        "ecosystem", "name", "version", F.col("status").alias("_archive_status")
    )
    ok = lambda c: F.col(c).between(200, 299)
    rows = (
        candidates.select("ecosystem", "name", "version")
        .join(meta, ["ecosystem", "name"], "left")
        .join(archive, ["ecosystem", "name", "version"], "left")
        .withColumn("_meta_status", F.coalesce("_meta_status", F.lit(404)))
    )
    target = package_label(F.col("name"), F.col("version"))
    label = F.element_at(F.create_map(*label_pairs), eco)
    status = F.col("_archive_status").cast("string")
    source_message = (
        F.when(F.col("_archive_status").isNull(), F.concat(F.lit("No source archive available for "), target))
        .when(
            F.col("_archive_status").isin(404, 410),
            F.concat(label, F.lit(" package "), target,
                     F.lit(" was not found or may have been removed (HTTP "), status, F.lit(")")),
        )
        .otherwise(
            F.concat(label, F.lit(" registry request failed for "), target, F.lit(" (HTTP "), status, F.lit(")"))
        )
    )
    meta_message = F.concat(
        F.lit("HTTP "), F.col("_meta_status").cast("string"), F.lit(" for "), F.coalesce("_url", F.col("name"))
    )
    failed = rows.filter(~ok("_meta_status") | F.col("_archive_status").isNull() | ~ok("_archive_status"))
    return failed.select(
        F.col("name").alias("package_name"), F.col("version").alias("package_version"), "ecosystem",
        F.when(ok("_meta_status"), "source").otherwise("metadata").alias("stage"),
        F.when(ok("_meta_status"), source_message).otherwise(meta_message).alias("message"),
        F.when(ok("_meta_status"), F.col("_archive_status")).otherwise(F.col("_meta_status")).alias("status_code"),
    )
