"""Publish dates, ages, provenance, registry metadata and risk signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import AS_OF, table, view, with_views
from pkgaudit.functions import signals
from pkgaudit.functions.versions import is_dependency_confusion, registry_key
from pkgaudit.operators import enrich, registry

META = [
    "name", "ecosystem", "latest_version", "previous_version", "created_at", "updated_at", "weekly_downloads",
    "maintainers", "has_install_scripts", "install_scripts", "repository_url", "description", "license",
    "previous_maintainers", "new_maintainers", "has_provenance",
]


def _flat(df, *more):
    return df.select(*META, *more).withColumns({
        "maintainers": F.array_join("maintainers", "|"),
        "previous_maintainers": F.array_join("previous_maintainers", "|"),
        "new_maintainers": F.array_join("new_maintainers", "|"),
        "install_scripts": F.array_join(F.map_keys("install_scripts"), "|"),
    })


def published_at(spark, sf_dir):
    return enrich.published_at(view(spark, sf_dir, "fx_lib_deps"), view(spark, sf_dir, "fx_docs"))


def package_ages(spark, sf_dir):
    return enrich.package_ages(view(spark, sf_dir, "fx_vulns_libs"), view(spark, sf_dir, "fx_docs"), AS_OF)


def apply_package_ages(spark, sf_dir):
    return enrich.apply_package_ages(view(spark, sf_dir, "fx_vulns_libs"), package_ages(spark, sf_dir))


def verify_provenance(spark, sf_dir):
    return enrich.verify_provenance(view(spark, sf_dir, "fx_lib_deps"), view(spark, sf_dir, "fx_docs"))


def apply_provenance(spark, sf_dir):
    return enrich.apply_provenance(view(spark, sf_dir, "fx_lib_deps"), verify_provenance(spark, sf_dir)).select(
        "ordinal", "ecosystem", "name", "version", "provenance"
    )


def provenance_summary(spark, sf_dir):
    return enrich.provenance_summary(view(spark, sf_dir, "fx_deps"))


def missing_provenance(spark, sf_dir):
    return enrich.missing_provenance(view(spark, sf_dir, "fx_deps"))


def _meta_query(operator):
    return lambda spark, sf_dir: _flat(operator(view(spark, sf_dir, "fx_docs")))


SIGNALS = ["maintainer_changed", "package_age_days", "published_days_ago", "typosquat_candidate",
           "is_dependency_confusion", "risk_score"]


def package_metadata(spark, sf_dir):
    rows = registry.package_metadata(view(spark, sf_dir, "fx_docs"), AS_OF)
    return _flat(rows, *SIGNALS)


def time_signals(spark, sf_dir):
    age, published = registry.time_signals(F.col("created"), F.col("updated"), AS_OF)
    times = view(spark, sf_dir, "fx_vulns").select(
        "ordinal", F.when(F.col("ordinal") % 5 > 0, F.date_format("package_published_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("").alias("created"), F.date_format("package_published_ts", "yyyy-MM-dd").alias("updated"))
    return times.select("ordinal", age.alias("age"), published.alias("published"))


TYPOS = """case ordinal % 8 when 0 then 'lodahs' when 1 then '@x/expres' when 2 then 'requesst' when 3 then 'React'
 when 4 then 'momnet' when 5 then 'loddddash' when 6 then '@acme/internal-tools' else name end"""


def _typo_deps(spark, sf_dir):
    return view(spark, sf_dir, "fx_deps").withColumn("name", F.expr(TYPOS))


def typosquat_candidates(spark, sf_dir):
    return registry.typosquat_candidates(_typo_deps(spark, sf_dir))


# Names of customers stand for packages, and those of the automobile segment for the well-known ones: they differ in digits.
KNOWN_SQL = """select case when c_nationkey < 12 then 'npm' else 'pypi' end as ecosystem, lower(c_name) as known, c_custkey as place
from customer where c_mktsegment = 'AUTOMOBILE'"""
SQUATS_SQL = """select case when c_nationkey < 12 then 'npm' else 'pypi' end as ecosystem,
 case when c_mktsegment = 'BUILDING' then '@Scope/' || c_name when c_mktsegment = 'MACHINERY' then c_name || 'x' else c_name end as name
from customer"""


def typosquats_of_given_names(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return registry.typosquat_candidates(spark.sql(SQUATS_SQL), spark.sql(KNOWN_SQL))


def dependency_confusion(spark, sf_dir):
    return _typo_deps(spark, sf_dir).select("ordinal", is_dependency_confusion(F.col("name")).alias("confusion"))


def maintainer_changes(spark, sf_dir):
    current, previous = F.array("repo", "ecosystem", "repo"), F.array("ecosystem", "version")
    fresh = signals.new_maintainers(current, previous)
    return view(spark, sf_dir, "fx_deps").select(
        "ordinal", F.array_join(fresh, "|").alias("fresh"), (F.size(fresh) > 0).alias("changed"))


def _versions(spark, sf_dir):
    return view(spark, sf_dir, "fx_deps").select(
        "ecosystem", "name", "version",
        F.concat(F.lit("2."), (F.length("name") % 10).cast("string"), F.lit(".3")).alias("latest"),
    )


def previous_version(spark, sf_dir):
    return registry.previous_version(_versions(spark, sf_dir))


def registry_risk_score(spark, sf_dir):
    o = F.col("ordinal")
    score = signals.registry_risk_score(
        o % 2 == 0, o % 700, o % 11, F.when(o % 3 == 0, F.lit("x")), o % 5 == 0, o % 7 == 0)
    return view(spark, sf_dir, "fx_deps").select("ordinal", score.alias("score"))


def install_scripts(spark, sf_dir):
    return registry.install_scripts(view(spark, sf_dir, "fx_docs"))


def analysis_candidates(spark, sf_dir):
    return registry.analysis_candidates(view(spark, sf_dir, "fx_deps")).select("ordinal", "ecosystem", "name")


def fetch_errors(spark, sf_dir):
    candidates = registry.analysis_candidates(view(spark, sf_dir, "fx_lib_deps"))
    return registry.fetch_errors(candidates, view(spark, sf_dir, "fx_docs"))


def registry_keys(spark, sf_dir):
    name = F.expr("case ordinal % 3 when 0 then concat('@Org/', name) when 1 then concat('My_', name) else concat('github.com/Foo/', name) end")
    return view(spark, sf_dir, "fx_deps").select(
        "ordinal", registry_key(F.col("ecosystem"), name, F.col("version")).alias("key"))


QUERIES = {f.__name__: f for f in (
    published_at, package_ages, apply_package_ages, verify_provenance, apply_provenance, provenance_summary,
    missing_provenance,
    package_metadata, time_signals, typosquat_candidates, typosquats_of_given_names, dependency_confusion, maintainer_changes,
    previous_version, registry_risk_score, install_scripts, analysis_candidates, fetch_errors, registry_keys,
)}
QUERIES |= {op.__name__: _meta_query(op) for op in (
    registry.npm_metadata, registry.pypi_metadata, registry.crates_metadata, registry.go_metadata,
    registry.ruby_metadata)}

DATES = with_views("fx_lib_deps", "fx_docs", "fx_vulns_libs", "fx_libs") + """,
dated as (
 select l.ecosystem, l.name, v.version, v.published from fx_libs l,
  lateral (
   select l.version, '2022-0' || (1 + k % 9) || '-01T00:00:00.000Z' as published where l.ecosystem = 'npm' and n % 29 <> 0
   union all select '1.10.0', '2023-12-01T00:00:00Z' where l.ecosystem = 'npm' and n % 29 <> 0
   union all select l.version, '2023-05-01T0' || (k % 10) || ':00:00' where l.ecosystem = 'pypi' and l.status = 200
   union all select '2.0', '2024-01-10T00:00:00' where l.ecosystem = 'pypi' and n % 31 <> 0
   union all select '1.2.0', case when n % 29 <> 0 then '2024-01-31T00:00:00Z' else '2024-01-3' || (k % 2) || 'T00:00:00Z' end
     where l.ecosystem = 'cargo' and (n % 29 <> 0 or l.status = 200)
   union all select '1.1.0', '2022-01-01T00:00:00Z' where l.ecosystem = 'cargo' and n % 29 <> 0
   union all select l.version, '2021-06-0' || (1 + k % 9) || 'T00:00:00Z' where l.ecosystem = 'go' and l.status = 200
   union all select '1.4.0', '2021-06-01T00:00:00Z' where l.ecosystem = 'go' and n % 31 <> 0
   union all select l.version, case when l.status = 200 then '2020-02-0' || (1 + k % 9) || 'T00:00:00Z' else '2018-01-0' || (1 + k % 9) || 'T00:00:00Z' end
     where l.ecosystem = 'ruby'
   union all select '3.1', '2020-02-02T00:00:00Z' where l.ecosystem = 'ruby') v),
aged as (select distinct v.ecosystem, package_name as name, package_version as version, published as published_at,
  cast(floor(date_diff('second', try_cast(published as timestamp), timestamp '2024-02-01 00:00:00') / 86400.0) as bigint) as age_days
 from fx_vulns_libs v join dated d on d.ecosystem = v.ecosystem and d.name = v.package_name and d.version = v.package_version)
"""
PROV = with_views("fx_lib_deps", "fx_docs", "fx_libs") + """,
asked as (select distinct ecosystem, name, version, version = '*' or (ecosystem = 'npm' and version like '^%') as ranged
 from fx_lib_deps where ecosystem in ('npm', 'pypi')),
prov as (
 select a.name as package_name, a.version, a.ecosystem,
  coalesce(case when not ranged and l.status = 200 and a.version = l.version then
    case when a.ecosystem = 'npm' then n % 2 = 0 else k % 2 = 0 end end, false) as has_provenance,
  case when not ranged and l.status = 200 and a.version = l.version then
    case when a.ecosystem = 'npm' and n % 2 = 0 then 'u' || n when a.ecosystem = 'pypi' and k % 2 = 0 then 'p' || n end end as provenance_url,
  case when ranged then case when n % 31 = 0 then 'HTTP 404' end when a.version <> l.version then 'HTTP 404'
   when l.status <> 200 then 'HTTP ' || l.status end as error
 from asked a join fx_libs l on l.name = a.name)
"""
DAYS = "cast(floor(date_diff('second', try_cast({t} as timestamp), timestamp '2024-02-01 00:00:00') / 86400.0) as bigint)"
LIBS = with_views("fx_docs", "fx_libs")
META_SQL = {
    "npm": """select name, ecosystem, '1.10.0' as latest_version, '1.9.0' as previous_version,
 '2015-01-0' || (1 + n % 9) || 'T00:00:00Z' as created_at, '2024-01-' || (10 + k % 20) || 'T00:00:00Z' as updated_at,
 n * 1000 as weekly_downloads, 'm' || (k % 5) || '|e@x' as maintainers, k % 2 = 0 as has_install_scripts,
 case when k % 2 = 0 then 'postinstall' else '' end as install_scripts, 'git+' || n as repository_url,
 'd' as description, 'ISC' as license, 'm' || (k % 7) as previous_maintainers,
 case when k % 5 = k % 7 then 'e@x' else 'm' || (k % 5) || '|e@x' end as new_maintainers, k % 3 = 0 as has_provenance
from fx_libs where ecosystem = 'npm' and n % 29 <> 0""",
    "pypi": """select name, ecosystem, '2.0' as latest_version, null as previous_version,
 '2019-03-0' || (1 + k % 9) || 'T00:00:00Z' as created_at, '2024-01-' || (10 + k % 20) || 'T00:00:00' as updated_at,
 n * 7 as weekly_downloads, case when k % 3 = 0 then 'a' || k else 'a' || k || '|m' || k end as maintainers,
 k % 4 = 0 as has_install_scripts, '' as install_scripts,
 case when k % 2 = 0 then 'r' || n else 'h' end as repository_url, 's' as description, 'MIT' as license,
 '' as previous_maintainers, '' as new_maintainers, k % 5 >= 3 as has_provenance
from fx_libs where ecosystem = 'pypi' and n % 31 <> 0""",
    "crates": """select name, ecosystem, '1.2.0' as latest_version, '1.1.0' as previous_version,
 '2019-01-0' || (1 + k % 9) || 'T00:00:00Z' as created_at, '2024-01-' || (10 + k % 20) || 'T00:00:00Z' as updated_at,
 n as weekly_downloads, 'k' || k || '|w' as maintainers, false as has_install_scripts, '' as install_scripts,
 'r' as repository_url, null as description, null as license, '' as previous_maintainers, '' as new_maintainers,
 false as has_provenance from fx_libs where ecosystem = 'cargo' and n % 29 <> 0""",
    "go": """select name, ecosystem, 'v1.4.0' as latest_version, 'v1.' || (k % 4) || '.9' as previous_version,
 '2021-06-01T00:00:00Z' as created_at, '2021-06-01T00:00:00Z' as updated_at, 0 as weekly_downloads,
 '' as maintainers, false as has_install_scripts, '' as install_scripts, null as repository_url,
 null as description, null as license, '' as previous_maintainers, '' as new_maintainers, false as has_provenance
from fx_libs where ecosystem = 'go' and n % 31 <> 0""",
    "ruby": """select name, ecosystem, '3.1' as latest_version, version as previous_version,
 '2020-02-0' || (1 + k % 9) || 'T00:00:00Z' as created_at, '2020-02-0' || (1 + k % 9) || 'T00:00:00Z' as updated_at,
 n as weekly_downloads, 'A' || k || '|B' as maintainers, false as has_install_scripts, '' as install_scripts,
 'h' || n as repository_url, 'i' as description, 'MIT, X' as license, '' as previous_maintainers,
 '' as new_maintainers, false as has_provenance from fx_libs where ecosystem = 'ruby' and n % 31 <> 0""",
}
NEAR = " union all ".join(
    f"select '{eco}' as ecosystem, '{known}' as known, {i} as place"
    for eco, names in signals.KNOWN_NAMES.items() for i, known in enumerate(names)
)
ORACLES = {
    "published_at": DATES + """select w.ecosystem, w.name, w.version, published as published_at
from (select distinct ecosystem, name, version from fx_lib_deps) w left join dated d
 on d.ecosystem = w.ecosystem and d.name = w.name and d.version = w.version""",
    "package_ages": DATES + "select * from aged",
    "apply_package_ages": DATES + """select v.*, published_at as package_published_at, age_days as package_age_days
from fx_vulns_libs v left join aged a on a.ecosystem = v.ecosystem and a.name = v.package_name and a.version = v.package_version""",
    "verify_provenance": PROV + "select * from prov",
    "apply_provenance": PROV + """select d.ordinal, d.ecosystem, d.name, d.version, has_provenance as provenance
from fx_lib_deps d left join prov p on p.ecosystem = d.ecosystem and p.package_name = d.name and p.version = d.version""",
    "missing_provenance": with_views("fx_deps") + "select ordinal, name || '@' || version as label from fx_deps where not provenance",
    "provenance_summary": with_views("fx_deps") + """select count(*) filter (provenance) as with_provenance, count(*) filter (not provenance) as without_provenance,
 count(*) filter (provenance is null) as unknown_provenance from fx_deps""",
    "package_metadata": LIBS + ", meta as (" + " union all ".join(META_SQL.values()) + f""")
, sig as (select *, new_maintainers <> '' as maintainer_changed, {DAYS.format(t='created_at')} as package_age_days,
 {DAYS.format(t='updated_at')} as published_days_ago from meta)
select *,
 null as typosquat_candidate, false as is_dependency_confusion,
 case when maintainer_changed then 3 else 0 end + case when package_age_days < 30 then 2 else 0 end
 + case when published_days_ago < 3 then 1 else 0 end
 + case when not has_provenance and package_age_days > 365 then 1 else 0 end as risk_score from sig""",
    "time_signals": with_views("fx_vulns") + """select ordinal, case when ordinal % 5 = 0 then 0 else
 cast(floor(date_diff('second', date_trunc('second', package_published_ts), timestamp '2024-02-01 00:00:00') / 86400.0) as bigint) end as age,
 date_diff('day', cast(package_published_ts as date), date '2024-02-01') as published from fx_vulns""",
    "typosquat_candidates": with_views("fx_deps") + f""", known as ({NEAR}),
pkgs as (select distinct ecosystem, {TYPOS} as name from fx_deps where ecosystem in ('npm', 'pypi')),
local as (select *, lower(case when name like '@%' then split_part(name, '/', 2) else name end) as short from pkgs),
near as (select l.ecosystem, l.name, k.known, row_number() over (partition by l.ecosystem, l.name
  order by levenshtein(short, known), place) as rn
 from local l join known k on k.ecosystem = l.ecosystem and abs(length(short) - length(known)) <= 2
 where levenshtein(short, known) between 1 and 2
  and not exists (select 1 from known x where x.ecosystem = l.ecosystem and x.known = l.short))
select ecosystem, name, known as candidate from near where rn = 1""",
    "typosquats_of_given_names": f"""with known as ({KNOWN_SQL}), pkgs as (select distinct * from ({SQUATS_SQL})),
local as (select *, lower(case when name like '@%' then split_part(name, '/', 2) else name end) as short from pkgs),
near as (select l.ecosystem, l.name, k.known, row_number() over (partition by l.ecosystem, l.name
  order by levenshtein(short, known), place) as rn
 from local l join known k on k.ecosystem = l.ecosystem and abs(length(short) - length(known)) <= 2
 where levenshtein(short, known) between 1 and 2
  and not exists (select 1 from known x where x.ecosystem = l.ecosystem and x.known = l.short))
select ecosystem, name, known as candidate from near where rn = 1""",
    "dependency_confusion": with_views("fx_deps") + f"select ordinal, ({TYPOS}) like '@acme/internal-%' as confusion from fx_deps",
    "maintainer_changes": with_views("fx_deps") + "select ordinal, repo || '|' || repo as fresh, true as changed from fx_deps",
    "previous_version": with_views("fx_deps") + """, v as (select ecosystem, name, version,
  '2.' || (length(name) % 10) || '.3' as latest, list_transform(string_split(version, '.'), lambda x: cast(x as int)) as key from fx_deps)
select ecosystem, name, latest, case when bool_or(version = latest) then
  arg_max(version, key) filter (key < list_transform(string_split(latest, '.'), lambda x: cast(x as int))) end as previous
from v group by all""",
    "registry_risk_score": with_views("fx_deps") + """select ordinal, least(10, case when ordinal % 2 = 0 then 3 else 0 end
 + case when ordinal % 700 < 30 then 2 else 0 end + case when ordinal % 11 < 3 then 1 else 0 end
 + case when ordinal % 3 = 0 then 3 else 0 end + case when ordinal % 5 = 0 then 3 else 0 end
 + case when ordinal % 7 <> 0 and ordinal % 700 > 365 then 1 else 0 end) as score from fx_deps""",
    "install_scripts": LIBS + """select ecosystem, name, version, h.hook, h.command from fx_libs,
 (values ('postinstall', 'node i.js'), ('prepare', 'node ./x/build.js now')) h(hook, command)
where ecosystem = 'npm' and status = 200""",
    "analysis_candidates": with_views("fx_deps") + """select min(ordinal) as ordinal, ecosystem, name from fx_deps
group by ecosystem, name""",
    "fetch_errors": with_views("fx_lib_deps", "fx_libs") + """, first as (select ecosystem, name, arg_min(version, ordinal) as version
  from fx_lib_deps group by all),
j as (select f.*, n, l.version as lib_version, case when f.ecosystem in ('npm', 'cargo') then case when n % 29 = 0 then 404 else 200 end
   else case when n % 31 = 0 then 404 else 200 end end as meta,
  case when n % 11 <> 3 and f.version = l.version then case n % 7 when 0 then 404 when 1 then 500 else 200 end end as arch,
  case f.ecosystem when 'npm' then 'npm' when 'pypi' then 'PyPI' when 'cargo' then 'crates.io' when 'go' then 'Go proxy' else 'RubyGems' end as label
 from first f join fx_libs l on l.name = f.name)
select name as package_name, version as package_version, ecosystem, case when meta = 200 then 'source' else 'metadata' end as stage,
 case when meta <> 200 then 'HTTP 404 for https://registry.example.org/' || ecosystem || '/' || case when ecosystem in ('npm', 'cargo') then 'package/' else 'latest/' end || name || '/'
  when arch is null then 'No source archive available for ' || name || '@' || version
  when arch = 404 then label || ' package ' || name || '@' || version || ' was not found or may have been removed (HTTP 404)'
  else label || ' registry request failed for ' || name || '@' || version || ' (HTTP ' || arch || ')' end as message,
 case when meta = 200 then arch else meta end as status_code
from j where meta <> 200 or arch is null or arch <> 200""",
    "registry_keys": with_views("fx_deps") + """, named as (select *, case ordinal % 3 when 0 then '@Org/' || name when 1 then 'My_' || name
  else 'github.com/Foo/' || name end as full_name from fx_deps)
select ordinal, case ecosystem when 'npm' then case when full_name like '@%' then '@' || url_encode(substr(full_name, 2)) else url_encode(full_name) end
  when 'pypi' then regexp_replace(lower(full_name), '[-_.]+', '-', 'g')
  when 'go' then replace(replace(replace(replace(replace(url_encode(full_name), '%2F', '/'), 'O', '!o'), 'F', '!f'), 'M', '!m'), '%40', '%40')
  else url_encode(full_name) end || '@' || version as key from named""",
}
ORACLES |= {f"{k}_metadata": LIBS + v for k, v in META_SQL.items()}
