"""From manifests, registry snapshot and advisories to the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgaudit.operators import advisories as adv
from pkgaudit.operators import enrich, findings, graph, manifests, package_files, registry, reports, triage
from pkgaudit.operators.keys import PACKAGE
from pkgaudit.session import cut_lineage


def audit_dependencies(deps: DataFrame, advisory_docs: DataFrame) -> DataFrame:
    """Vulnerabilities of the package versions among the dependencies."""
    parsed = adv.parse_advisories(advisory_docs)
    return adv.to_vulnerability(adv.match_advisories(deps, parsed), parsed)


def vulnerable_packages(deps: DataFrame, advisory_docs: DataFrame) -> DataFrame:
    """Which package versions in use are vulnerable, and how badly."""
    vulns = audit_dependencies(deps, advisory_docs)
    none = vulns.select(*reports.PACKAGE_COLUMNS, "severity").limit(0)
    return reports.aggregate_by_package(vulns, none)


def dependency_trees(
    manifest_files: DataFrame, registry_docs: DataFrame, max_depth: int | None = None
) -> dict[str, DataFrame]:
    """Trees of all manifests: nodes, edges, paths and what did not resolve.

    Requirements are resolved once for the whole fleet and the requirement graph is written to the
    checkpoint folder, since every level of the expansion reads it.
    """
    roots = manifests.tree_roots(manifest_files)
    edges = cut_lineage(graph.requirement_edges(registry_docs))
    children = edges.select(
        "ecosystem", F.col("child_name").alias("name"), F.col("child_spec").alias("version_spec")
    )
    reqs = roots.select(*graph.REQUIREMENT).unionByName(children)
    resolved = cut_lineage(graph.resolve_versions(reqs, registry_docs))
    requirements = cut_lineage(graph.requirement_graph(resolved, edges))
    expanded = graph.expand_tree(roots, requirements, max_depth)
    tree = graph.resolve_tree(expanded, resolved)
    missing = resolved.filter(~F.col("found")).select(*graph.REQUIREMENT)
    return {
        "nodes": graph.tree_nodes(tree),
        "paths": graph.node_paths(tree),
        "edges": graph.tree_edges(tree, requirements, resolved, max_depth),
        "unresolved": expanded.join(missing, graph.REQUIREMENT, "left_semi")
        .select("repo", "file", *graph.REQUIREMENT, "is_dev")
        .withColumn("reason", F.lit("not_found")),
    }


def direct_dependencies(manifest_files: DataFrame) -> DataFrame:
    """What the manifests of all kinds ask for themselves, as nodes of depth 0; '*' where the version is not known."""
    version = F.coalesce(F.nullif(F.col("version"), F.lit("")), F.lit("*"))
    return manifests.extract_dependencies(manifest_files).select(
        "repo", "file", "ecosystem", "name", version.alias("version"), "version_spec",
        F.coalesce("is_dev", F.lit(False)).alias("is_dev"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("path_count"))


def scan(
    manifest_files: DataFrame, registry_docs: DataFrame, advisory_docs: DataFrame, as_of: str, package_depth: int = 0
) -> dict[str, DataFrame]:
    """The tables of a scan: dependencies, edges, paths, unresolved, vulnerabilities and summaries.

    Manifests that trees start from give their trees; of all other kinds (lock files, say) the dependencies
    they name stand for themselves. Audited are the dependencies and, besides, the very versions
    that tree manifests ask for, whatever they resolve to.
    """
    trees = dependency_trees(manifest_files, registry_docs)
    of_trees = F.col("type").isin(*manifests.TREE_MANIFESTS)
    listed = direct_dependencies(manifest_files.filter(~of_trees))
    merged = graph.merge_manifest_trees(trees["nodes"].unionByName(listed))
    nodes = cut_lineage(graph.limit_package_depth(merged, package_depth))
    asked = direct_dependencies(manifest_files.filter(of_trees)).select(*PACKAGE)
    deps = enrich.apply_provenance(nodes, enrich.verify_provenance(nodes, registry_docs))
    vulns = cut_lineage(audit_dependencies(nodes.select(*PACKAGE).unionByName(asked), advisory_docs))
    ages = enrich.package_ages(vulns, registry_docs, as_of)
    return {
        **trees,
        "dependencies": deps,
        "vulnerabilities": enrich.apply_package_ages(vulns, ages),
        "summary": adv.severity_summary(vulns),
    }


def review_plan(
    deps: DataFrame, vulns: DataFrame, files: DataFrame, registry_docs: DataFrame, as_of: str,
    previous_files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What to look into after a scan: eligible packages, their signals, scored files and prompts.

    The texts, and the commands of install hooks as files of their own, are scored in one narrow pass, and
    only the rows with indicators are kept, with their text where the score calls for a look. Known
    vulnerable packages are taken out of those rows: doing it before would move every text of the
    file table through a join. With the files of previous versions, and `previous_version` in `files`, prompts
    tell which files are new. Packages whose metadata or archive is missing are in `fetch_errors`.
    """
    eligible, blocked = findings.gate_candidates(deps, vulns)
    wanted = eligible.select(*PACKAGE).distinct()
    hooks = registry.install_scripts(registry_docs)
    content = package_files.content_map(files, hooks)
    scored = triage.triage(content, keep=("content",)).withColumn(
        "content", F.when(F.col("score") >= triage.MIN_SCORE, F.col("content"))
    )
    kept = cut_lineage(scored.join(wanted, PACKAGE, "left_semi"))
    plan = triage.investigation_plan(kept)
    new_files = None if previous_files is None else package_files.new_files_in_version(files, previous_files)
    metadata = registry.package_metadata(registry_docs, as_of)
    counted = files.groupBy(*PACKAGE).agg(F.count(F.lit(1)).alias("total_files"))
    packages = wanted.join(counted, PACKAGE, "left").withColumn("total_files", F.coalesce("total_files", F.lit(0)))
    return {
        "eligible": eligible,
        "blocked": blocked,
        "metadata": metadata,
        "triage": kept.drop("content"),
        "plan": plan.drop("content"),
        "prompts": findings.file_prompts(plan, new_files),
        "package_prompts": findings.package_prompts(metadata, packages),
        "fetch_errors": registry.fetch_errors(wanted, registry_docs),
    }


def review_context(found: DataFrame, files: DataFrame, registry_docs: DataFrame) -> dict[str, DataFrame]:
    """For the findings to look at again: a question for each, and the code of their packages."""
    scripts = registry.install_scripts(registry_docs).select(*PACKAGE, "hook", F.col("command").alias("content"))
    return {"deep_prompts": findings.deep_prompts(found), "context": findings.package_context(found, files, scripts)}


def review_report(found: DataFrame, verdicts: DataFrame, vulns: DataFrame) -> dict[str, DataFrame]:
    """Findings after verdicts, their summary, and both feeds per package."""
    final = findings.aggregate_findings(findings.apply_verdicts(found, verdicts))
    aggregated = reports.aggregate_by_package(vulns, final)
    return {
        "findings": final,
        "findings_summary": findings.findings_summary(final),
        "by_category": findings.findings_by_category(final),
        "packages": aggregated,
        "packages_summary": reports.aggregated_summary(aggregated),
    }
