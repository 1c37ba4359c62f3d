"""Dependency graph: resolution, transitive expansion, nodes, edges and views of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit import schemas
from pkgaudit.functions import manifest_text
from pkgaudit.functions.versions import requested_version, strip_operators
from pkgaudit.operators.enrich import answered, by_document, comparable_version
from pkgaudit.operators.keys import PACKAGE, first_per_key, package_label
from pkgaudit.session import cut_lineage

REQUIREMENT = ["ecosystem", "name", "version_spec"]
TREE_KEY = ["repo", "file", *REQUIREMENT]
ROOT = ["root_name", "root_spec"]


def _resolved_text():
    eco = F.col("ecosystem")
    crate = F.coalesce(
        F.nullif(F.get_json_object("body", "$.crate.max_version"), F.lit("")),
        F.get_json_object("body", "$.crate.max_stable_version"),
    )
    return (
        F.when(eco == "pypi", F.get_json_object("body", "$.info.version"))
        .when(eco == "cargo", crate)
        .when(eco == "go", F.regexp_replace(F.get_json_object("body", "$.Version"), "^v", ""))
        .otherwise(F.get_json_object("body", "$.version"))
    )


def resolve_versions(reqs: DataFrame, registry_docs: DataFrame) -> DataFrame:
    """Version each distinct requirement resolves to: the one asked for, else the latest.

    Only names and version texts of the documents take part in the joins, never their bodies.
    """
    docs = answered(registry_docs)
    eco = F.col("ecosystem")
    exact = (
        docs.filter((F.col("kind") == "version") & (eco != "cargo"))
        .select(
            "ecosystem", "name", comparable_version(eco, F.col("version")).alias("_wanted"),
            _resolved_text().alias("_exact"), F.lit(True).alias("_has_exact"),
        )
        .groupBy("ecosystem", "name", "_wanted")
        .agg(F.min("_exact").alias("_exact"), F.first("_has_exact").alias("_has_exact"))
    )
    newest = (
        docs.filter(
            ((F.col("kind") == "latest") & eco.isin("npm", "pypi", "ruby"))
            | ((F.col("kind") == "package") & (eco == "cargo"))
        )
        .select("ecosystem", "name", _resolved_text().alias("_latest"), F.lit(True).alias("_has_latest"))
        .groupBy("ecosystem", "name")
        .agg(F.min("_latest").alias("_latest"), F.first("_has_latest").alias("_has_latest"))
    )
    wanted = (
        reqs.select(*REQUIREMENT)
        .distinct()
        .withColumn("_wanted", requested_version(eco, F.col("version_spec")))
    )
    asked = F.nullif(F.trim(strip_operators(F.col("version_spec"))), F.lit(""))
    return (
        wanted.join(exact, ["ecosystem", "name", "_wanted"], "left")
        .join(newest, ["ecosystem", "name"], "left")
        .withColumn("found", F.col("_has_exact").isNotNull() | F.col("_has_latest").isNotNull())
        .select(
            *REQUIREMENT,
            F.when(
                F.col("found"),
                F.coalesce(
                    F.nullif(F.when(F.col("_has_exact"), F.col("_exact")).otherwise(F.col("_latest")), F.lit("")),
                    asked, F.lit("latest"),
                ),
            ).alias("version"),
            "found",
        )
    )


def unresolved_dependencies(reqs: DataFrame, registry_docs: DataFrame) -> DataFrame:
    """Requirements without any registry document."""
    missing = resolve_versions(reqs, registry_docs).filter(~F.col("found")).select(*REQUIREMENT)
    return reqs.join(missing, REQUIREMENT, "left_semi").withColumn("reason", F.lit("not_found"))


_CHILD = "struct<version:string,child_name:string,child_spec:string>"

def _children_in(body: Column, version: Column) -> dict[tuple[str, ...], Column]:
    """Requirements a document holds, by ecosystem and document kinds."""

    def child(v: Column, name: Column, spec: Column) -> Column:
        wanted = F.coalesce(F.nullif(spec, F.lit("")), F.lit("*"))
        return F.struct(v.alias("version"), name.alias("child_name"), wanted.alias("child_spec"))

    npm = F.from_json(body, "version string, dependencies map<string,string>")
    pypi = F.from_json(body, "info struct<version:string,requires_dist:array<string>>")["info"]
    crate = F.from_json(body, schemas.CRATE_DEPENDENCIES_BODY)["dependencies"]
    gem = F.from_json(
        body, "version string, dependencies struct<runtime:array<struct<name:string,requirements:string>>>"
    )
    # Requirements under a condition are not followed; of several clauses the first one is asked for.
    plain = F.filter(pypi["requires_dist"], lambda r: ~r.contains(";") & (manifest_text.requirement_name(r) != ""))
    used = F.filter(
        crate,
        lambda d: ~F.coalesce(d["optional"], F.lit(False)) & (F.coalesce(d["kind"], F.lit("")) != "dev"),
    )
    direct = F.filter(manifest_text.go_mod(body), lambda d: ~d["is_dev"])
    go_version = F.regexp_replace(version, "^v", "")
    return {
        ("npm", "version", "latest"): F.transform(
            F.map_entries(npm["dependencies"]), lambda e: child(npm["version"], e["key"], e["value"])
        ),
        ("pypi", "version", "latest"): F.transform(
            plain, lambda r: child(
                pypi["version"], manifest_text.requirement_name(r),
                F.substring_index(manifest_text.requirement_specifier(r), ",", 1))
        ),
        ("cargo", "dependencies"): F.transform(
            used,
            lambda d: child(version, F.coalesce(F.nullif(d["crate_name"], F.lit("")), d["crate_id"]), d["req"]),
        ),
        ("go", "mod"): F.transform(direct, lambda d: child(go_version, d["name"], d["version_spec"])),
        ("ruby", "version", "latest"): F.transform(
            gem["dependencies"]["runtime"], lambda d: child(gem["version"], d["name"], d["requirements"])
        ),
    }


def requirement_edges(registry_docs: DataFrame) -> DataFrame:
    """(ecosystem, name, version, child_name, child_spec): what each package version asks for."""
    choices = _children_in(F.col("body"), F.col("version"))
    return by_document(registry_docs, choices, _CHILD).select("ecosystem", "name", "_x.*").distinct()


def requirement_graph(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between requirements: what a requirement leads to once it is resolved."""
    return (
        resolved.filter("found")
        .join(edges, PACKAGE)
        .select(*REQUIREMENT, "child_name", "child_spec")
        .distinct()
    )


def requirement_closure(roots: DataFrame, graph: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(ecosystem, root_name, root_spec, name, version_spec, depth, path): what each root requirement leads to.

    Breadth first from distinct roots, so manifests that ask for the same thing share the work. One
    join per level against the requirement graph, until a level is empty: cycles end because what a
    root has reached before is dropped. A level is reduced to one row per root and requirement before
    it meets the ones already reached, then written to the checkpoint folder, so the plan stays short
    and a lost executor replays one level. 'path' is the least of the shortest name paths.
    """
    key = ["ecosystem", *ROOT, "name", "version_spec"]
    level = cut_lineage(
        roots.select(
            "ecosystem", F.col("name").alias("root_name"), F.col("version_spec").alias("root_spec"), "name", "version_spec"
        ).distinct().withColumn("depth", F.lit(0)).withColumn("path", F.array("name")))
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth - 1:
        depth += 1
        reached = (
            level.join(graph, REQUIREMENT)
            .groupBy("ecosystem", *ROOT, "child_name", "child_spec")
            .agg(F.min("path").alias("path"))
            .withColumnsRenamed({"child_name": "name", "child_spec": "version_spec"})
        )
        seen = reduce(DataFrame.unionByName, levels).select(*key)
        level = cut_lineage(
            reached.join(seen, key, "left_anti").select(
                *key, F.lit(depth).alias("depth"), F.concat("path", F.array("name")).alias("path")))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


CLOSURE_KEY = ["ecosystem", *ROOT, "name", "version_spec"]


def closure_changes(closure: DataFrame, graph: DataFrame, added: DataFrame) -> DataFrame:
    """The rows of a stored closure that added edges make new, or bring nearer, or give a lesser path.

    `graph` has the edges the closure was made from; edges that are in both change nothing. What the added edges
    lead to from what is reached already comes first, then only what has just changed is followed, depth by depth: a
    row changes once, and what has changed before is met by its key alone and never written again. The work is in
    proportion to the changes, besides the joins of what is found with the closure's keys and, of one depth, paths.
    Removed edges need a new closure.
    """
    def followed(rows: DataFrame, edges: DataFrame) -> DataFrame:
        return rows.join(edges, REQUIREMENT).select(
            "ecosystem", *ROOT, F.col("child_name").alias("name"), F.col("child_spec").alias("version_spec"),
            (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child_name")).alias("path"))

    def same_key(known: str, equal: Callable[[Column, Column], Column]) -> Column:
        return reduce(lambda a, b: a & b, [equal(F.col(f"n.{c}"), F.col(f"{known}.{c}")) for c in CLOSURE_KEY])

    def better(found: DataFrame, depth: int, changed: list[DataFrame]) -> DataFrame:
        """Of what is found at a depth, the least path per key, where the key is not reached before or by a path as good."""
        least = found.groupBy(*CLOSURE_KEY).agg(F.min("path").alias("path")).alias("n")
        here = same_key("c", lambda a, b: a == b)
        nearer = closure.filter(F.col("depth") < depth).select(*CLOSURE_KEY).alias("c")
        level = closure.filter(F.col("depth") == depth).select(*CLOSURE_KEY, F.col("path").alias("_path")).alias("c")
        least = least.join(nearer, here, "left_anti").join(level, here & (F.col("_path") <= F.col("n.path")), "left_anti")
        if changed:
            before = reduce(DataFrame.unionByName, changed).select(*CLOSURE_KEY).alias("b")
            least = least.join(before, same_key("b", Column.eqNullSafe), "left_anti")
        return cut_lineage(least.select(*CLOSURE_KEY, F.lit(depth).alias("depth"), "path"))

    # An edge that is in both is followed twice and reduced to one with all else that leads to a requirement.
    edges = graph.unionByName(added)
    first = followed(closure, added).groupBy(*CLOSURE_KEY).agg(F.min(F.struct("depth", "path")).alias("_new"))
    held = closure.groupBy(*CLOSURE_KEY).agg(F.min(F.struct("depth", "path")).alias("_old"))
    first = cut_lineage(first.join(held, CLOSURE_KEY, "left").filter(F.col("_old").isNull() | (F.col("_new") < F.col("_old")))
                        .select(*CLOSURE_KEY, "_new.depth", "_new.path"))
    # As many numbers as there are depths.
    waiting = sorted(r.depth for r in first.select("depth").distinct().collect())
    changed: list[DataFrame] = []
    last, depth = first.limit(0), 0
    while waiting or depth:
        depth = depth + 1 if depth else waiting[0]
        found = followed(last, edges)
        if waiting and waiting[0] == depth:
            waiting.pop(0)
            found = found.unionByName(first.filter(F.col("depth") == depth))
        last = better(found, depth, changed)
        if last.isEmpty():
            depth = 0
        else:
            changed.append(last)
    return reduce(DataFrame.unionByName, changed) if changed else first


def with_changes(closure: DataFrame, changes: DataFrame) -> DataFrame:
    """A closure after its changes."""
    return closure.join(changes.select(*CLOSURE_KEY), CLOSURE_KEY, "left_anti").unionByName(changes)


def expand_tree(roots: DataFrame, graph: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything a manifest's roots lead to, each requirement once per manifest at its least depth.

    The closures of the distinct roots are worked out once; manifests join them and keep, for every
    requirement, the least depth and the least path of that depth. All levels are followed unless a
    number of them is asked for.
    """
    asked = roots.groupBy(*TREE_KEY).agg(F.min("is_dev").alias("is_dev")).withColumnsRenamed(
        {"name": "root_name", "version_spec": "root_spec"})
    rows = asked.join(requirement_closure(roots, graph, max_depth), ["ecosystem", *ROOT])
    best = F.min(F.struct("depth", "path", F.when(F.col("depth") == 0, F.col("is_dev")).otherwise(F.lit(False)).alias("is_dev")))
    return rows.groupBy(*TREE_KEY).agg(best.alias("_b")).select(*TREE_KEY, "_b.is_dev", "_b.depth", "_b.path")


def resolve_tree(expanded: DataFrame, resolved: DataFrame) -> DataFrame:
    """Expanded requirements with the version they resolve to; those that do not resolve are left out."""
    return expanded.join(resolved.filter("found").select(*REQUIREMENT, "version"), REQUIREMENT)


def tree_nodes(tree: DataFrame) -> DataFrame:
    """One node per manifest, package and version: the shallowest entry's fields and how many paths lead there.

    The paths themselves stay rows, see node_paths.
    """
    best = F.min_by(F.struct("version_spec", "is_dev"), F.struct("depth", "path", "version_spec"))
    return (
        tree.groupBy("repo", "file", *PACKAGE)
        .agg(best.alias("_b"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("path_count"))
        .select("repo", "file", *PACKAGE, "_b.version_spec", "_b.is_dev", "depth", "path_count")
    )


def node_paths(tree: DataFrame) -> DataFrame:
    """One row per node and path from a root."""
    return tree.select("repo", "file", *PACKAGE, "depth", "path")


def tree_edges(tree: DataFrame, graph: DataFrame, resolved: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct edges between the nodes of each manifest.

    The children are resolved on the requirement graph, before it meets the manifests: a node, unless
    it is on the last level of a tree cut at a depth, has all its resolved children in the tree.
    """
    child = resolved.filter("found").select(
        "ecosystem", F.col("name").alias("child_name"), F.col("version_spec").alias("child_spec"),
        F.col("version").alias("child_version"),
    )
    targets = graph.join(child, ["ecosystem", "child_name", "child_spec"]).select(
        *REQUIREMENT, package_label(F.col("child_name"), F.col("child_version")).alias("target")
    )
    return (
        (tree if max_depth is None else tree.filter(F.col("depth") < max_depth - 1))
        .join(targets, REQUIREMENT)
        .select(
            "repo", "file", "ecosystem", package_label(F.col("name"), F.col("version")).alias("source"), "target"
        )
        .distinct()
        .withColumn("type", F.lit("dependency"))
    )


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Nodes as dependency rows."""
    return nodes.select(
        "repo", "ecosystem", "name", "version", "version_spec", "file", "is_dev", "depth"
    )


def merge_manifest_trees(nodes: DataFrame, ordinal: str = "file") -> DataFrame:
    """One row per repository and package version over all its manifests: the first one's fields, all paths counted."""
    fields = [c for c in nodes.columns if c not in ("repo", *PACKAGE, "path_count")]
    paths = F.sum("path_count") if "path_count" in nodes.columns else F.count(F.lit(1))
    return (
        nodes.groupBy("repo", *PACKAGE)
        .agg(F.min_by(F.struct(*fields), F.col(ordinal)).alias("_b"), paths.alias("path_count"))
        .select("repo", *PACKAGE, "_b.*", "path_count")
    )


def limit_package_depth(deps: DataFrame, depth: int) -> DataFrame:
    """Dependencies above a depth; a limit of 1 or less keeps all."""
    return deps.filter(F.coalesce("depth", F.lit(0)) < depth) if depth > 1 else deps


def graph_nodes(deps: DataFrame, vulns: DataFrame, file: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """One node per package version with root and vulnerable flags."""
    rows = deps if file is None else deps.filter(F.col("file") == file)
    first = first_per_key(
        rows.select(*PACKAGE, "file", "is_dev", "depth", ordinal), PACKAGE, F.col(ordinal)
    )
    hit = vulns.select(F.col("package_name").alias("name"), F.lit(True).alias("_hit")).distinct()
    return first.join(hit, "name", "left").select(
        package_label(F.col("name"), F.col("version")).alias("id"), *PACKAGE, "file", "is_dev",
        F.coalesce("_hit", F.lit(False)).alias("is_vulnerable"),
        (F.coalesce("depth", F.lit(0)) == 0).alias("is_root"),
    )


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def graph_view(
    deps: DataFrame, edges: DataFrame, vulns: DataFrame, file: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph of all manifests or of one."""
    nodes = graph_nodes(deps, vulns, file)
    return nodes, graph_edges(edges, nodes)


def dependencies_per_file(deps: DataFrame) -> DataFrame:
    return deps.groupBy("file").agg(F.count(F.lit(1)).alias("dependency_count")).orderBy("file")
