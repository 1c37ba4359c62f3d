"""Dependency resolution and the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import view, with_views
from pkgaudit.operators import graph
from pkgaudit.session import cut_lineage


def _reqs(spark, sf_dir):
    return view(spark, sf_dir, "fx_lib_deps").withColumn("ordinal", F.col("ordinal"))


def resolve_versions(spark, sf_dir):
    return graph.resolve_versions(_reqs(spark, sf_dir), view(spark, sf_dir, "fx_docs"))


def unresolved_dependencies(spark, sf_dir):
    return graph.unresolved_dependencies(
        _reqs(spark, sf_dir).select("repo", "file", *graph.REQUIREMENT, "is_dev").distinct(),
        view(spark, sf_dir, "fx_docs"),
    )


def requirement_edges(spark, sf_dir):
    return graph.requirement_edges(view(spark, sf_dir, "fx_docs"))


def _graph(spark, sf_dir):
    return view(spark, sf_dir, "fx_edges").select(
        F.lit("npm").alias("ecosystem"), F.col("source").alias("name"), F.lit("*").alias("version_spec"),
        F.col("target").alias("child_name"), F.lit("*").alias("child_spec"),
    ).distinct()


def _resolved(spark, sf_dir):
    """Every name of the edge view resolves to 1.0.0, but for a few that do not."""
    edges = view(spark, sf_dir, "fx_edges")
    names = edges.select(F.col("target").alias("name")).union(edges.select("source")).distinct()
    return names.select(
        F.lit("npm").alias("ecosystem"), "name", F.lit("*").alias("version_spec"),
        F.lit("1.0.0").alias("version"), (~F.col("name").endswith("77")).alias("found"),
    )


def _expanded(spark, sf_dir):
    # Every level reads the edges: written once, as `scan.dependency_trees` does.
    return graph.expand_tree(view(spark, sf_dir, "fx_roots"), cut_lineage(_graph(spark, sf_dir)))


def _tree(spark, sf_dir):
    return graph.resolve_tree(_expanded(spark, sf_dir), _resolved(spark, sf_dir))


def expand_tree(spark, sf_dir):
    return _expanded(spark, sf_dir).withColumn("path", F.array_join("path", ">"))


def tree_nodes(spark, sf_dir):
    return graph.tree_nodes(_tree(spark, sf_dir))


def node_paths(spark, sf_dir):
    return graph.node_paths(_tree(spark, sf_dir)).withColumn("path", F.array_join("path", ">"))


def tree_edges(spark, sf_dir):
    return graph.tree_edges(_tree(spark, sf_dir), _graph(spark, sf_dir), _resolved(spark, sf_dir))


def flatten_tree(spark, sf_dir):
    return graph.flatten_tree(graph.tree_nodes(_tree(spark, sf_dir)))


def merge_manifest_trees(spark, sf_dir):
    nodes = view(spark, sf_dir, "fx_deps").withColumn("path_count", F.col("ordinal") % 3 + 1).drop("provenance")
    return graph.merge_manifest_trees(nodes, "ordinal")


def limit_package_depth(spark, sf_dir):
    return graph.limit_package_depth(view(spark, sf_dir, "fx_deps"), 2).select("ordinal", "depth")


def _graph_view(spark, sf_dir, file=None):
    deps = view(spark, sf_dir, "fx_lib_deps").withColumn("depth", (F.col("ordinal") % 3).cast("int"))
    vulns = view(spark, sf_dir, "fx_vulns_libs")
    edges = view(spark, sf_dir, "fx_libs").select(
        F.concat_ws("@", "name", "version").alias("source"), F.concat("next1", F.lit("@9.9.9")).alias("target")
    )
    return graph.graph_view(deps, edges, vulns, file)


def graph_nodes(spark, sf_dir):
    return _graph_view(spark, sf_dir)[0]


def graph_edges(spark, sf_dir):
    return _graph_view(spark, sf_dir, "repo1/m1")[1]


def dependencies_per_file(spark, sf_dir):
    return graph.dependencies_per_file(view(spark, sf_dir, "fx_deps"))


QUERIES = {f.__name__: f for f in (
    resolve_versions, unresolved_dependencies, requirement_edges, expand_tree, tree_nodes, node_paths,
    tree_edges, flatten_tree, merge_manifest_trees, limit_package_depth, graph_nodes, graph_edges,
    dependencies_per_file,
)}

RESOLVED = with_views("fx_lib_deps", "fx_libs") + """,
reqs as (select distinct d.ecosystem, d.name, d.version_spec, n, l.version as lib_version, l.status
  from fx_lib_deps d join fx_libs l on l.name = d.name),
asked as (select *, case ecosystem
   when 'npm' then regexp_replace(version_spec, '^[^0-9]*', '')
   when 'pypi' then trim(regexp_replace(version_spec, '^[>=<~!^]+', ''))
   when 'go' then regexp_replace(regexp_replace(version_spec, '^[>=<~!^]+', ''), '^v', '')
   when 'ruby' then case when regexp_matches(split_part(regexp_replace(version_spec, '^[>=<~!^]+', ''), ',', 1), '^[0-9]+[.][0-9]+')
     then split_part(regexp_replace(version_spec, '^[>=<~!^]+', ''), ',', 1) else 'latest' end end as want from reqs),
resolved as (select ecosystem, name, version_spec,
   case when ecosystem <> 'cargo' and want = lib_version and status = 200 then lib_version
    when ecosystem = 'npm' and n % 31 <> 0 then '1.10.0' when ecosystem = 'pypi' and n % 31 <> 0 then '2.0'
    when ecosystem = 'ruby' and n % 31 <> 0 then '3.1' when ecosystem = 'cargo' and n % 29 <> 0 then '1.2.0' end as version
  from asked)
"""
# More levels than the edge view has: the last ones are empty, so nothing is cut.
LEVELS = 40
EXPANDED = with_views("fx_roots", "fx_edges") + """, e as materialized (select distinct source, target from fx_edges),
l0 as materialized (select repo, file, name, bool_and(is_dev) as is_dev, 0 as depth, [name] as path from fx_roots group by repo, file, name),
s0 as materialized (select repo, file, name from l0)
""" + "".join(f""", l{i} as materialized (
  select repo, file, target as name, false as is_dev, {i} as depth, list_append(min(path), target) as path
  from l{i - 1} join e on e.source = l{i - 1}.name
  where not exists (select 1 from s{i - 1} s where s.repo = l{i - 1}.repo and s.file = l{i - 1}.file and s.name = e.target)
  group by repo, file, target),
s{i} as materialized (select * from s{i - 1} union all select repo, file, name from l{i})
""" for i in range(1, LEVELS)) + ", expanded as materialized (" + " union all ".join(
    f"select * from l{i}" for i in range(LEVELS)) + """),
tree as materialized (select * from expanded where name not like '%77')
"""
ORACLES = {
    "resolve_versions": RESOLVED + "select *, version is not null as found from resolved",
    "unresolved_dependencies": RESOLVED + """select distinct repo, file, d.ecosystem, d.name, d.version_spec, is_dev,
 'not_found' as reason from fx_lib_deps d join resolved r on r.ecosystem = d.ecosystem and r.name = d.name
 and r.version_spec = d.version_spec where r.version is null""",
    "requirement_edges": with_views("fx_libs") + """select distinct ecosystem, name, version, child_name, child_spec from (
 select ecosystem, name, case when ecosystem = 'cargo' then '1.2.0' else version end as version, next1 as child_name,
  case ecosystem when 'npm' then '^1.0.0' when 'pypi' then '>=1.0' when 'cargo' then '^1' when 'go' then 'v1.4.0' else '>= 1.0, < 9' end as child_spec
 from fx_libs where status = 200 or ecosystem in ('cargo', 'go')
 union all select ecosystem, name, case when ecosystem = 'cargo' then '1.2.0' else version end, next2,
  case ecosystem when 'npm' then '*' when 'pypi' then '>=2.0' when 'cargo' then '*' when 'go' then 'v1.' || (n % 4) || '.0' else '~> 3.1' end
 from fx_libs where (status = 200 or ecosystem in ('cargo', 'go')) and not (ecosystem = 'npm' and next1 = next2)
 union all select ecosystem, name, case ecosystem when 'npm' then '1.10.0' when 'pypi' then '2.0' else '3.1' end, next1,
  case ecosystem when 'npm' then '~1.0' when 'pypi' then '*' else '>= 1.0' end
 from fx_libs where ecosystem in ('npm', 'pypi', 'ruby') and n % 31 <> 0) x""",
    "expand_tree": EXPANDED + """select repo, file, 'npm' as ecosystem, name, '*' as version_spec, is_dev, depth,
 array_to_string(path, '>') as path from expanded""",
    "tree_nodes": EXPANDED + """select repo, file, 'npm' as ecosystem, name, '1.0.0' as version, '*' as version_spec, is_dev,
 depth, 1 as path_count from tree""",
    "node_paths": EXPANDED + """select repo, file, 'npm' as ecosystem, name, '1.0.0' as version, depth,
 array_to_string(path, '>') as path from tree""",
    "tree_edges": EXPANDED + """select distinct t.repo, t.file, 'npm' as ecosystem, t.name || '@1.0.0' as source,
 e.target || '@1.0.0' as target, 'dependency' as type
from tree t join e on e.source = t.name join tree c on c.repo = t.repo and c.file = t.file and c.name = e.target""",
    "flatten_tree": EXPANDED + """select repo, 'npm' as ecosystem, name, '1.0.0' as version, '*' as version_spec, file, is_dev, depth
from tree""",
    "merge_manifest_trees": with_views("fx_deps") + """, m as (select repo, ecosystem, name, version, min(ordinal) as ordinal,
  sum(ordinal % 3 + 1) as path_count from fx_deps group by all)
select m.*, d.version_spec, d.file, d.is_dev, d.is_pinned, d.depth from m join fx_deps d using (ordinal)""".replace(
        "select m.*, ", "select m.repo, m.ecosystem, m.name, m.version, m.ordinal, m.path_count, "),
    "limit_package_depth": with_views("fx_deps") + "select ordinal, depth from fx_deps where depth < 2",
    "graph_nodes": with_views("fx_lib_deps", "fx_vulns_libs") + """, firsts as (
 select *, row_number() over (partition by ecosystem, name, version order by ordinal) as rn from fx_lib_deps)
select name || '@' || version as id, ecosystem, name, version, file, is_dev,
 name in (select package_name from fx_vulns_libs) as is_vulnerable, ordinal % 3 = 0 as is_root
from firsts where rn = 1""",
    "graph_edges": with_views("fx_lib_deps", "fx_libs") + """, ids as (select distinct name || '@' || version as id from fx_lib_deps
  where file = 'repo1/m1')
select name || '@' || version as source, next1 || '@9.9.9' as target from fx_libs
where name || '@' || version in (select id from ids) and next1 || '@9.9.9' in (select id from ids)""",
    "dependencies_per_file": with_views("fx_deps") + "select file, count(*) as dependency_count from fx_deps group by file",
}


def extended_closure(spark, sf_dir):
    """The closure of the edges that lead to a later name, brought up to date with all others."""
    edges, roots = cut_lineage(_graph(spark, sf_dir)), view(spark, sf_dir, "fx_roots")
    later = F.col("name") < F.col("child_name")
    closure = cut_lineage(graph.requirement_closure(roots, edges.filter(later)))
    changes = graph.closure_changes(closure, edges.filter(later), edges.filter(~later))
    return graph.with_changes(closure, changes).select(
        "root_name", "name", "depth", F.array_join("path", ">").alias("path"))


QUERIES["extended_closure"] = extended_closure
ORACLES["extended_closure"] = EXPANDED.replace(
    "select repo, file, name, bool_and(is_dev) as is_dev, 0 as depth, [name] as path from fx_roots group by repo, file, name",
    "select distinct '' as repo, name as file, name, false as is_dev, 0 as depth, [name] as path from fx_roots",
) + "select file as root_name, name, depth, array_to_string(path, '>') as path from expanded"
