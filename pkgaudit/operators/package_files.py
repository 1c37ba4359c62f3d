"""Tables of package source files: what is text, what runs at install time, what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgaudit.functions import paths
from pkgaudit.operators.keys import PACKAGE


def select_text_files(files: DataFrame) -> DataFrame:
    """Text files with any content, by extension and size alone, so the scan skips other content."""
    return files.filter((F.col("size") > 0) & paths.is_text_file(F.col("ecosystem"), F.col("path")))


def entry_points(files: DataFrame, mains: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Path of each package's entry file; mains gives (ecosystem, name, version, main) where declared.

    Only files that can be one are moved; keep names further columns to carry.
    """
    path, eco, name = F.col("path"), F.col("ecosystem"), F.col("name")
    columns = [*PACKAGE, "path", "ordinal", *keep]
    rows = files.select(*columns)
    if mains is not None:
        rows = rows.join(mains.select(*PACKAGE, "main"), PACKAGE, "left")
    else:
        rows = rows.withColumn("main", F.lit(None).cast("string"))
    main = F.regexp_replace(F.coalesce("main", F.lit("index.js")), r"^\./", "")
    inner = paths.without_package_prefix(path)
    matches = paths.by_ecosystem(eco, {
        "npm": (inner == main) | (inner == F.concat(main, F.lit(".js")))
        | (inner == F.concat(main, F.lit("/index.js"))),
        "pypi": path.endswith("/__init__.py") & (F.size(F.split(path, "/")) <= 3),
        "cargo": path.rlike(r"(?i)/src/(lib|main)\.rs$"),
        "go": path.rlike(r"(?i)/(main|init)\.go$|/go\.mod$"),
        "ruby": path.endswith(F.concat(F.lit("/lib/"), F.replace(name, F.lit("-"), F.lit("_")), F.lit(".rb")))
        | path.endswith(F.concat(F.lit("/lib/"), name, F.lit(".rb"))) | path.endswith("/lib.rb"),
    })
    first = F.min_by(F.struct("path", *keep), F.col("ordinal"))
    return rows.filter(matches).groupBy(*PACKAGE).agg(first.alias("_f")).select(*PACKAGE, "_f.*")


def suspicious_files(files: DataFrame) -> DataFrame:
    return files.filter(paths.is_suspicious(F.col("ecosystem"), F.col("path")))


def hook_scripts(install_scripts: DataFrame, files: DataFrame) -> DataFrame:
    """File that the 'node <path>' of an install hook runs: (package, hook, script, path).

    The file name is part of the join key, so a hook only meets files of its own package and name.
    """
    script = F.regexp_extract("command", r"node\s+(.+?)(?:\s|$)", 1)
    hooks = (
        install_scripts.withColumn("script", script)
        .filter(F.col("script") != "")
        .select(*PACKAGE, "hook", "script", paths.basename(F.col("script")).alias("_base"))
    )
    named = files.select(*PACKAGE, "path", "ordinal", paths.basename(F.col("path")).alias("_base"))
    return (
        hooks.join(named, [*PACKAGE, "_base"])
        .filter(F.col("path").endswith(F.concat(F.lit("/"), F.col("script"))))
        .groupBy(*PACKAGE, "hook", "script")
        .agg(F.min_by("path", "ordinal").alias("path"))
    )


def install_script_files(files: DataFrame) -> DataFrame:
    """Files that run at install time outside npm: (package, hook, path).

    The first setup.py and build.rs of a package, and the last file under each gem build script's name.
    """
    path, eco = F.col("path"), F.col("ecosystem")
    base = paths.basename(path)
    hook = (
        F.when((eco == "pypi") & path.endswith("/setup.py"), F.lit("setup.py"))
        .when((eco == "cargo") & path.rlike(r"(?i)build\.rs$"), F.lit("build.rs"))
        .when((eco == "ruby") & ((base == "extconf.rb") | base.endswith(".gemspec")), base)
    )
    order = F.when(eco == "ruby", -F.col("ordinal")).otherwise(F.col("ordinal"))
    return (
        files.select(*PACKAGE, "path", hook.alias("hook"), order.alias("_order"))
        .filter(F.col("hook").isNotNull())
        .groupBy(*PACKAGE, "hook")
        .agg(F.min_by("path", "_order").alias("path"))
    )


def new_files_in_version(files: DataFrame, previous_files: DataFrame) -> DataFrame:
    """Paths of a version that its previous version lacks; 'files' names that one in previous_version."""
    inner = paths.without_package_prefix(F.col("path"))
    current = files.filter(F.col("previous_version").isNotNull()).select(
        *PACKAGE, "previous_version", inner.alias("path")
    )
    before = previous_files.select(
        "ecosystem", "name", F.col("version").alias("previous_version"), inner.alias("path")
    )
    return current.join(before, ["ecosystem", "name", "previous_version", "path"], "left_anti").select(
        *PACKAGE, "previous_version", "path"
    ).distinct()


def content_map(files: DataFrame, install_scripts: DataFrame) -> DataFrame:
    """File rows plus one row per install hook, named 'package.json:<hook>'."""
    columns = ["ordinal", *PACKAGE, "path", "content"]
    hooks = install_scripts.select(
        F.lit(None).cast("bigint").alias("ordinal"), *PACKAGE,
        F.concat(F.lit("package.json:"), F.col("hook")).alias("path"), F.col("command").alias("content"),
    )
    return files.select(*columns).unionByName(hooks)
