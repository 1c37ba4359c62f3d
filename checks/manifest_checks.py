"""Manifest extraction and file discovery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.common import view, with_views
from pkgaudit.functions.versions import clean_version
from pkgaudit.operators import discovery, manifests
from pkgaudit.plans import scan
from pkgaudit.session import ensure_checkpoint_dir
from pkgaudit.sources import files
from pkgaudit.sources.files import DEPENDENCY_HEADERS, REPORT_FIELDS

REPORT_SCHEMA = ", ".join(
    f"`{f}` " + {"cvss": "double", "references": "array<string>"}.get(f, "string") for f in REPORT_FIELDS)
COLUMNS = ["repo", "file", "ecosystem", "name", "version", "version_spec", "is_dev", "is_pinned"]


def _kind_query(operator):
    def query(spark, sf_dir):
        return operator(view(spark, sf_dir, "fx_manifests")).select(*COLUMNS)

    return query


KINDS = {
    "deps_package_json": manifests.deps_package_json,
    "deps_package_lock": manifests.deps_package_lock,
    "deps_yarn_lock": manifests.deps_yarn_lock,
    "deps_pnpm_lock": manifests.deps_pnpm_lock,
    "deps_bun_lock": manifests.deps_bun_lock,
    "deps_requirements": manifests.deps_requirements,
    "deps_pyproject": manifests.deps_pyproject,
    "deps_pipfile": manifests.deps_pipfile,
    "deps_cargo_toml": manifests.deps_cargo_toml,
    "deps_cargo_lock": manifests.deps_cargo_lock,
    "deps_go_mod": manifests.deps_go_mod,
    "deps_go_sum": manifests.deps_go_sum,
    "deps_gemfile": manifests.deps_gemfile,
    "deps_gemfile_lock": manifests.deps_gemfile_lock,
}


def clean_versions(spark, sf_dir):
    spec = F.concat(F.col("version_spec"), F.lit(" , <9 || 2"))
    return view(spark, sf_dir, "fx_deps").select("ordinal", clean_version(spec).alias("cleaned"))


def tree_roots(spark, sf_dir):
    return manifests.tree_roots(view(spark, sf_dir, "fx_manifests"))


def find_manifests(spark, sf_dir):
    return discovery.find_manifests(view(spark, sf_dir, "fx_paths"), ["fixtures"], 3)


def language_stats(spark, sf_dir):
    return discovery.language_stats(view(spark, sf_dir, "fx_paths"))


def language_stats_by_repo(spark, sf_dir):
    return discovery.language_stats(view(spark, sf_dir, "fx_paths"), by=("repo",))


def dedup_responses(spark, sf_dir):
    return discovery.dedup_responses(view(spark, sf_dir, "fx_fetches")).select("url", "status", "body")


def _folder(spark):
    """A new folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"


def write_report_json(spark, sf_dir):
    """The report as it is written, read back from its files."""
    vulns = view(spark, sf_dir, "fx_vulns_full").drop("link", "repo").withColumns({
        "cwe": F.concat(F.lit("CWE-"), F.col("ordinal") % 900), "published_date": F.lit("2023-01-01T00:00:00Z"),
        "references": F.array_compact(F.array("id", "affected_versions")),
        "description": F.concat(F.col("description"), F.lit(' says "no",\nand \\ more'))})
    path = _folder(spark)
    files.write_report_json(vulns, path)
    return spark.read.schema(REPORT_SCHEMA).json(path).withColumn("references", F.array_join("references", "; "))


def export_csv(spark, sf_dir):
    """The exported table as it is written, read back from its files."""
    deps = view(spark, sf_dir, "fx_deps").withColumn("is_vulnerable", F.col("ordinal") % 2 == 0).withColumns({
        "max_severity": F.when(F.col("depth") > 0, "N/A"), "provenance_status": F.array("repo", "ecosystem"),
        "name": F.concat(F.lit('say "'), F.col("name"), F.lit('",\n')), "version": F.concat(F.col("version"), F.lit(", \\"))})
    path = _folder(spark)
    files.export_csv(deps, DEPENDENCY_HEADERS, path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


QUERIES = {name: _kind_query(op) for name, op in KINDS.items()}
QUERIES["extract_dependencies"] = _kind_query(manifests.extract_dependencies)
for _f in (
    clean_versions, tree_roots, find_manifests, language_stats, language_stats_by_repo, dedup_responses,
    write_report_json, export_csv,
):
    QUERIES[_f.__name__] = _f

LINES = """, lines as (
 select repo, path, type, pos, trim(line) as t, line from (
  select repo, path, type, generate_subscripts(string_split(content, chr(10)), 1) as pos,
   unnest(string_split(content, chr(10))) as line from fx_manifests) x)
"""
SECTION = """, sectioned as (
 select *, last_value(case when t like '[%]' then t end ignore nulls)
  over (partition by path order by pos rows between unbounded preceding and current row) as section from lines)
"""
OUT = "select distinct repo, path as file, '{eco}' as ecosystem, {name} as name, {version} as version, {spec} as version_spec, {dev} as is_dev, {pin} as is_pinned from "


def _out(eco, name, version, spec, dev, pin):
    return OUT.format(eco=eco, name=name, version=version, spec=spec, dev=dev, pin=pin)


CLEAN = "split_part(split_part(regexp_replace(regexp_replace({x}, '^[\\^~>=<]+', ''), '\\s+', '', 'g'), ',', 1), '||', 1)"


def _json_map(kind, field, alias="e"):
    return (f"(select repo, path, unnest(json_keys(content, '$.\"{field}\"')) as key, content from fx_manifests "
            f"where type = '{kind}') {alias}")


def _at(field, key="key", tail=""):
    return f"json_extract_string(content, '$.\"{field}\".\"' || {key} || '\"{tail}')"


PACKAGE_JSON = " union all ".join(
    _out("npm", "key", CLEAN.format(x=_at(f)), _at(f), d, "null::boolean") + _json_map("package.json", f)
    for f, d in (("dependencies", "false"), ("devDependencies", "true"))
)
PACKAGE_LOCK = _out(
    "npm", "list_extract(string_split(key, 'node_modules/'), -1)", _at("packages", tail=".version"),
    _at("packages", tail=".version"), f"coalesce({_at('packages', tail='.dev')} = 'true', false)", "true",
) + _json_map("package-lock.json", "packages") + " where key <> ''"
YARN = _out("npm", "regexp_extract(head, '^\"?(@?[^@]+)@', 1)", "v", "v", "dev", "true") + """(
 select repo, path, block, min(case when header then t end) as head,
  min(regexp_extract(t, '^version \"([^\"]+)\"', 1)) filter (t like 'version%') as v,
  bool_or(t = 'dev: true') as dev
 from (select *, sum(case when header then 1 else 0 end) over (partition by path order by pos) as block from (
   select *, line not like ' %' and t <> '' and t not like '#%' as header from lines where type = 'yarn.lock') y) z
 where block > 0 group by all) b"""
PNPM = _out("npm", "regexp_extract(t, '^/(.+)@(.+):$', 1)", "regexp_extract(t, '^/(.+)@(.+):$', 2)",
            "regexp_extract(t, '^/(.+)@(.+):$', 2)", "null::boolean", "true") + """(
 select *, last_value(case when line not like ' %' and t like '%:' then t end ignore nulls)
  over (partition by path order by pos rows between unbounded preceding and current row) as section
 from lines where type = 'pnpm-lock.yaml') s where section = 'packages:' and t like '/%@%:'"""
BUN = (_out("npm", "regexp_extract(key, '^npm:(.+)@([^@]+)$', 1)", "regexp_extract(key, '^npm:(.+)@([^@]+)$', 2)",
            "regexp_extract(key, '^npm:(.+)@([^@]+)$', 2)", "true", "true")
       + "(select repo, path, unnest(json_keys(content, '$.packages')) as key from fx_manifests "
         "where type = 'bun.lock' and content like '{%') j union all "
       + _out("npm", "split_part(t, '@', 1)", "split_part(t, '@', 2)", "split_part(t, '@', 2)", "null::boolean", "true")
       + "lines where type = 'bun.lock' and t like '%@%' and t not like '{%'")
REQ_NAME = "regexp_extract(t, '^[A-Za-z0-9_.-]+')"
REQ_OP = "regexp_extract(t, '^[A-Za-z0-9_.-]+(\\[[^\\]]+\\])?([>=<~!]+)([^,]+)', 2)"
REQ_VERSION = "regexp_extract(t, '^[A-Za-z0-9_.-]+(\\[[^\\]]+\\])?([>=<~!]+)([^,]+)', 3)"
REQUIREMENTS = _out(
    "pypi", REQ_NAME, f"case when {REQ_OP} = '' then '*' else {REQ_VERSION} end",
    f"case when {REQ_OP} = '' then '*' else {REQ_OP} || {REQ_VERSION} end", "false", "null::boolean",
) + "lines where type = 'requirements.txt' and t not like '#%' and t not like '-%' and t <> ''"
QUOTED = "regexp_extract(t, '\"([^\"]+)\"', 1)"
PYPROJECT = _out("pypi", "trim(split_part(t, '=', 1))", QUOTED, QUOTED, "false", "null::boolean") + (
    "sectioned where type = 'pyproject.toml' and section = '[project.dependencies]' and t like '%=%'")
PIP_VALUE = "coalesce(json_extract_string(content, '$.\"{f}\".\"' || key || '\".version'), json_extract_string(content, '$.\"{f}\".\"' || key || '\"'))"
PIPFILE = " union all ".join(
    _out("pypi", "key", PIP_VALUE.format(f=f), PIP_VALUE.format(f=f), d, "null::boolean") + _json_map("Pipfile", f)
    for f, d in (("packages", "false"), ("dev-packages", "true"))
)
CARGO_TOML = _out("cargo", "trim(split_part(t, '=', 1))", QUOTED, QUOTED, "section <> '[dependencies]'", "null::boolean") + (
    "sectioned where type = 'Cargo.toml' and t like '%=%'")
CARGO_LOCK = _out("cargo", "n", "v", "v", "false", "true") + """(
 select repo, path, block, min(regexp_extract(t, '^name = \"([^\"]+)\"', 1)) filter (t like 'name%') as n,
  min(regexp_extract(t, '^version = \"([^\"]+)\"', 1)) filter (t like 'version%') as v
 from (select *, sum(case when t = '[[package]]' then 1 else 0 end) over (partition by path order by pos) as block
  from lines where type = 'Cargo.lock') z where block > 0 group by all) b"""
GO_WORDS = "string_split(regexp_replace(t, '^require ', ''), ' ')"
GO_MOD = _out("go", f"{GO_WORDS}[1]", f"{GO_WORDS}[2]", f"{GO_WORDS}[2]", "t like '%// indirect%'", "null::boolean") + (
    "lines where type = 'go.mod' and t like '%.org/%'")
GO_SUM = _out("go", "split_part(t, ' ', 1)", "split_part(t, ' ', 2)", "split_part(t, ' ', 2)", "false", "true") + (
    "lines where type = 'go.sum' and t <> ''")
GEM_NAME = "regexp_extract(t, '[''\"]([^''\"]+)[''\"]', 1)"
GEM_VERSION = "regexp_extract(t, ',[^''\"]*[''\"]([^''\"]+)[''\"]', 1)"
GEMFILE = _out("ruby", GEM_NAME, GEM_VERSION, GEM_VERSION, "coalesce(section like 'group%', false)", "null::boolean") + """(
 select *, last_value(case when t like 'group%' or t = 'end' then t end ignore nulls)
  over (partition by path order by pos rows between unbounded preceding and current row) as section
 from lines where type = 'Gemfile') s where t like 'gem %'"""
LOCK_LINE = "'^([a-zA-Z0-9_-]+) \\(([0-9][^)]*)\\)'"
LOCK_VERSION = f"regexp_replace(regexp_extract(t, {LOCK_LINE}, 2), '-[a-z].*$', '')"
GEMFILE_LOCK = _out("ruby", f"regexp_extract(t, {LOCK_LINE}, 1)", LOCK_VERSION, LOCK_VERSION, "false", "true") + (
    f"lines where type = 'Gemfile.lock' and regexp_matches(t, {LOCK_LINE})")

PARTS = {
    "deps_package_json": PACKAGE_JSON, "deps_package_lock": PACKAGE_LOCK, "deps_yarn_lock": YARN,
    "deps_pnpm_lock": PNPM, "deps_bun_lock": BUN, "deps_requirements": REQUIREMENTS,
    "deps_pyproject": PYPROJECT, "deps_pipfile": PIPFILE, "deps_cargo_toml": CARGO_TOML,
    "deps_cargo_lock": CARGO_LOCK, "deps_go_mod": GO_MOD, "deps_go_sum": GO_SUM, "deps_gemfile": GEMFILE,
    "deps_gemfile_lock": GEMFILE_LOCK,
}
PRELUDE = with_views("fx_manifests") + LINES + SECTION
ORACLES = {name: PRELUDE + part for name, part in PARTS.items()}
ORACLES["extract_dependencies"] = PRELUDE + " union all ".join(
    f"select * from ({part}) p{i}" for i, (name, part) in enumerate(PARTS.items())
    if name not in ("deps_pyproject", "deps_pipfile")
)
ORACLES["tree_roots"] = PRELUDE + (
    "select repo, file, ecosystem, name, case when version_spec = '' then '*' else version_spec end as version_spec, "
    "coalesce(is_dev, false) as is_dev from ("
    + " union all ".join(
        f"select * from ({PARTS[n]}) p{i}" for i, n in enumerate(
            ("deps_package_json", "deps_requirements", "deps_cargo_toml", "deps_go_mod", "deps_gemfile_lock")))
    + ") t"
)
IGNORED = "'node_modules','.git','.svn','.hg','dist','build','coverage','.venv','venv','env','__pycache__','.pytest_cache','.mypy_cache','target','vendor'"
LANGUAGE = """, recognised as (
 select repo, case lower(regexp_extract(relative_path, '\\.[^./]+$')) when '.js' then 'JavaScript'
  when '.py' then 'Python' when '.rs' then 'Rust' when '.tsx' then 'TypeScript' when '.r' then 'R' end as language
 from fx_paths where not list_has_any(string_split(relative_path, '/')[:-2], [""" + IGNORED + """]))
"""
ORACLES |= {
    "clean_versions": with_views("fx_deps")
    + "select ordinal, regexp_replace(version_spec, '^[^0-9*]+', '') as cleaned from fx_deps",
    "find_manifests": with_views("fx_paths") + f"""select repo, relative_path, ordinal,
 list_extract(string_split(relative_path, '/'), -1) as type from fx_paths
where list_extract(string_split(relative_path, '/'), -1) in ('package.json', 'package-lock.json', 'yarn.lock',
 'pnpm-lock.yaml', 'bun.lock', 'requirements.txt', 'poetry.lock', 'Pipfile.lock', 'Cargo.toml', 'Cargo.lock',
 'go.mod', 'go.sum', 'Gemfile', 'Gemfile.lock')
 and not list_has_any(string_split(relative_path, '/')[:-2], [{IGNORED}])
 and relative_path not like '%fixtures/%' and len(string_split(relative_path, '/')) <= 3""",
    "language_stats": with_views("fx_paths") + LANGUAGE + """select language, count(*) as file_count,
 count(*)::double / sum(count(*)) over () * 100 as percentage from recognised where language is not null group by 1""",
    "language_stats_by_repo": with_views("fx_paths") + LANGUAGE + """select repo, language, count(*) as file_count,
 count(*)::double / sum(count(*)) over (partition by repo) * 100 as percentage
 from recognised where language is not null group by 1, 2""",
    "dedup_responses": with_views("fx_fetches") + """, ranked as (select *, row_number() over (partition by url
 order by fetched_at, status, body) as rn from fx_fetches)
select url, case when status between 200 and 299 and try_cast(body as json) is not null then status else 404 end as status,
 case when status between 200 and 299 and try_cast(body as json) is not null then body end as body
from ranked where rn = 1""",
    "write_report_json": with_views("fx_vulns_full") + """select id, package_name, package_version, ecosystem, severity, title,
 description || ' says "no",' || chr(10) || 'and \\ more' as description, cvss, 'CWE-' || (ordinal % 900) as cwe,
 affected_versions, fixed_versions, '2023-01-01T00:00:00Z' as published_date,
 concat_ws('; ', id, affected_versions) as "references", source from fx_vulns_full""",
    "export_csv": with_views("fx_deps") + """select 'say "' || name || '",' || chr(10) as "Package Name", version || ', \\' as "Version",
 ecosystem as "Ecosystem", file as "File Path", case when is_dev then 'true' else 'false' end as "Type",
 case when ordinal % 2 = 0 then 'true' else 'false' end as "Vulnerable", case when depth > 0 then 'N/A' end as "Max Severity",
 repo || '; ' || ecosystem as "Provenance" from fx_deps""",
}


def direct_dependencies(spark, sf_dir):
    return scan.direct_dependencies(view(spark, sf_dir, "fx_manifests"))


QUERIES["direct_dependencies"] = direct_dependencies
ORACLES["direct_dependencies"] = f"""select repo, file, ecosystem, name, coalesce(nullif(version, ''), '*') as version, version_spec,
 coalesce(is_dev, false) as is_dev, 0 as depth, 1 as path_count from ({ORACLES["extract_dependencies"]}) d"""
