"""Dependencies out of a table of manifest files: one scan, one narrow stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit.functions import manifest_text as text

# How each manifest kind is read: ecosystem, entries, and whether a name and version counts once per file.
READERS = {
    "package.json": ("npm", text.package_json, False),
    "package-lock.json": ("npm", text.package_lock, True),
    "yarn.lock": ("npm", text.yarn_lock, True),
    "pnpm-lock.yaml": ("npm", text.pnpm_lock, True),
    "bun.lock": ("npm", text.bun_lock, True),
    "requirements.txt": ("pypi", text.requirements, False),
    "Cargo.toml": ("cargo", text.cargo_toml, False),
    "Cargo.lock": ("cargo", text.cargo_lock, True),
    "go.mod": ("go", text.go_mod, False),
    "go.sum": ("go", text.go_sum, True),
    "Gemfile": ("ruby", text.gemfile, False),
    "Gemfile.lock": ("ruby", text.gemfile_lock, True),
}

# Readable on request, but not part of a scan.
EXTRA_READERS = {
    "pyproject.toml": ("pypi", text.pyproject, False),
    "Pipfile": ("pypi", text.pipfile, False),
}

# The manifest of each ecosystem that a dependency tree starts from.
TREE_MANIFESTS = ("package.json", "requirements.txt", "Cargo.toml", "go.mod", "Gemfile.lock")

_SORTED = (
    "array<struct<name:string,version:string,slot:int,pos:int,version_spec:string,is_dev:boolean,is_pinned:boolean>>"
)


def _positioned(entries: Column, once: bool) -> Column:
    """Entries with their position; those that share name, version and slot are repeats."""
    return F.transform(
        entries,
        lambda e, i: F.struct(
            e["name"].alias("name"), e["version"].alias("version"),
            (F.lit(0) if once else i).cast("int").alias("slot"), i.cast("int").alias("pos"),
            e["version_spec"].alias("version_spec"), e["is_dev"].alias("is_dev"), e["is_pinned"].alias("is_pinned"),
        ),
    )


def _extract(manifests: DataFrame, readers: dict) -> DataFrame:
    kind = F.col("type")
    content = F.col("content")
    whens = reduce(
        lambda acc, item: acc.when(kind == item[0], _positioned(item[1][1](content), item[1][2])),
        list(readers.items())[1:],
        F.when(
            kind == next(iter(readers)),
            _positioned(next(iter(readers.values()))[1](content), next(iter(readers.values()))[2]),
        ),
    )
    pairs = [F.lit(x) for name, reader in readers.items() for x in (name, reader[0])]
    rows = manifests.filter(kind.isin(*readers) & (content != "")).select(
        "repo", F.col("path").alias("file"), F.element_at(F.create_map(*pairs), kind).alias("ecosystem"),
        F.sort_array(whens.cast(_SORTED)).alias("_sorted"),
    )
    previous = F.concat(F.array(F.lit(None)).cast(_SORTED), F.col("_sorted"))
    first = F.zip_with(
        F.col("_sorted"), previous,
        lambda e, p: F.when(
            p.isNull() | (p["name"] != e["name"]) | (p["version"] != e["version"]) | (p["slot"] != e["slot"]), e
        ),
    )
    unique = F.filter(first, lambda e: e["name"].isNotNull())
    return (
        rows.select("repo", "file", "ecosystem", F.explode_outer(unique).alias("_d"))
        .filter(F.col("_d").isNotNull())
        .select(
            "repo", "file", "ecosystem", "_d.name", "_d.version", "_d.version_spec", "_d.is_dev",
            "_d.is_pinned", "_d.pos",
        )
    )


def extract_dependencies(manifests: DataFrame) -> DataFrame:
    """Dependencies of every known manifest kind; other kinds and empty files give no rows."""
    return _extract(manifests, READERS)


def _one(kind: str):
    reader = READERS.get(kind) or EXTRA_READERS[kind]

    def operator(manifests: DataFrame) -> DataFrame:
        return _extract(manifests, {kind: reader})

    operator.__doc__ = f"Dependencies of the {kind} manifests."
    return operator


deps_package_json = _one("package.json")
deps_package_lock = _one("package-lock.json")
deps_yarn_lock = _one("yarn.lock")
deps_pnpm_lock = _one("pnpm-lock.yaml")
deps_bun_lock = _one("bun.lock")
deps_requirements = _one("requirements.txt")
deps_pyproject = _one("pyproject.toml")
deps_pipfile = _one("Pipfile")
deps_cargo_toml = _one("Cargo.toml")
deps_cargo_lock = _one("Cargo.lock")
deps_go_mod = _one("go.mod")
deps_go_sum = _one("go.sum")
deps_gemfile = _one("Gemfile")
deps_gemfile_lock = _one("Gemfile.lock")


def tree_roots(manifests: DataFrame) -> DataFrame:
    """Requirements that dependency trees start from, with '*' where no version is asked for."""
    readers = {k: READERS[k] for k in TREE_MANIFESTS}
    readers["Cargo.toml"] = ("cargo", lambda c: text.cargo_toml(c, nested_sections=True), False)
    rows = _extract(manifests, readers)
    spec = F.when(F.coalesce(F.col("version_spec"), F.lit("")) == "", F.lit("*")).otherwise(F.col("version_spec"))
    return rows.select(
        "repo", "file", "ecosystem", "name", spec.alias("version_spec"),
        F.coalesce("is_dev", F.lit(False)).alias("is_dev"),
    )
