"""Report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import view, with_views
from pkgaudit.functions.labels import age_label as age_text
from pkgaudit.functions.labels import reference_label as link_text
from pkgaudit.functions.labels import repo_name as name_of_repo
from pkgaudit.operators import advisories, findings, reports


def _vulns(spark, sf_dir):
    return view(spark, sf_dir, "fx_vulns_full").withColumn(
        "references", F.when(F.col("link").isNull(), F.array().cast("array<string>")).otherwise(F.array("link"))
    ).drop("link")


def _findings(spark, sf_dir):
    return view(spark, sf_dir, "fx_findings_full").drop("verdict")


def _aggregated(spark, sf_dir):
    return reports.aggregate_by_package(_vulns(spark, sf_dir), _findings(spark, sf_dir))


def _named_vulns(spark, sf_dir):
    return view(spark, sf_dir, "fx_adv_flat").select(
        F.col("name").alias("package_name"),
        F.when(F.col("k") % 80 == 1, F.lit("HIGH")).otherwise(F.lit("LOW")).alias("severity"),
    )


def aggregate_by_package(spark, sf_dir):
    return _aggregated(spark, sf_dir)


def package_findings(spark, sf_dir):
    return reports.package_findings(_vulns(spark, sf_dir), _findings(spark, sf_dir))


def aggregated_summary(spark, sf_dir):
    return reports.aggregated_summary(_aggregated(spark, sf_dir))


def filter_min_severity(spark, sf_dir):
    return reports.filter_min_severity(_vulns(spark, sf_dir), "medium").select("ordinal", "severity")


def filter_uninformative(spark, sf_dir):
    return reports.filter_uninformative(_vulns(spark, sf_dir)).select("ordinal", "severity")


def hidden_count(spark, sf_dir):
    vulns = _vulns(spark, sf_dir)
    return reports.hidden_count(vulns, reports.filter_uninformative(vulns))


def fail_on(spark, sf_dir):
    return reports.repo_summary(_vulns(spark, sf_dir), "high")


def overview_totals(spark, sf_dir):
    return reports.overview_totals(
        advisories.severity_summary(_vulns(spark, sf_dir)), findings.findings_summary(_findings(spark, sf_dir)))


def unpinned_dependencies(spark, sf_dir):
    return reports.unpinned_dependencies(view(spark, sf_dir, "fx_deps")).select("ordinal", "ecosystem", "version_spec")


def vulnerable_split(spark, sf_dir):
    hit = view(spark, sf_dir, "fx_vulns_libs")
    return reports.vulnerable_split(view(spark, sf_dir, "fx_lib_deps"), hit)


def dependency_table(spark, sf_dir):
    return reports.dependency_table(view(spark, sf_dir, "fx_deps"), _named_vulns(spark, sf_dir))


def dependency_table_filtered(spark, sf_dir):
    return reports.dependency_table(view(spark, sf_dir, "fx_deps"), _named_vulns(spark, sf_dir), "R", True, True)


def vulnerability_table(spark, sf_dir):
    return reports.vulnerability_table(_vulns(spark, sf_dir), _findings(spark, sf_dir), "pkg1", "HIGH")


def package_file_links(spark, sf_dir):
    return reports.package_file_links(view(spark, sf_dir, "fx_deps"), _named_vulns(spark, sf_dir), "repo1")


def age_label(spark, sf_dir):
    days = F.when(F.col("ordinal") % 13 == 0, F.lit(None)).otherwise(F.col("ordinal") - 5)
    return view(spark, sf_dir, "fx_deps").select("ordinal", age_text(days).alias("label"))


def reference_label(spark, sf_dir):
    return view(spark, sf_dir, "fx_vulns").select("ordinal", link_text(F.col("reference")).alias("label"))


def unresolved_table(spark, sf_dir):
    reasons = F.expr("element_at(array('not_found', 'no_access', 'invalid_spec', 'registry_unavailable'), cast(ordinal % 4 + 1 as int))")
    return reports.unresolved_table(view(spark, sf_dir, "fx_deps").select("ordinal", reasons.alias("reason")))


def scan_totals(spark, sf_dir):
    return reports.scan_totals(
        view(spark, sf_dir, "fx_manifests"), view(spark, sf_dir, "fx_deps"), _vulns(spark, sf_dir))


def repo_name(spark, sf_dir):
    url = F.expr("""case ordinal % 4 when 0 then concat('https://github.com/org/', repo, '.git')
      when 1 then concat('git@github.com:org/', repo) when 2 then concat('https://host.example/x/', repo, '.git') else null end""")
    return view(spark, sf_dir, "fx_paths").select("ordinal", name_of_repo(url).alias("repo_name"))


def package_findings_text(spark, sf_dir):
    return reports.package_findings_text(_vulns(spark, sf_dir), _findings(spark, sf_dir))


def vulnerability_text(spark, sf_dir):
    return reports.vulnerability_text(_vulns(spark, sf_dir)).select("ordinal", "text")


REGISTERED = (
    aggregate_by_package, package_findings, aggregated_summary, filter_min_severity, filter_uninformative, hidden_count,
    fail_on, overview_totals, unpinned_dependencies, vulnerable_split, dependency_table, dependency_table_filtered,
    vulnerability_table, package_file_links, age_label, reference_label, unresolved_table, scan_totals, repo_name,
    package_findings_text, vulnerability_text,
)
QUERIES = {f.__name__: f for f in REGISTERED}

BASE = with_views("fx_vulns_full", "fx_findings_full", "fx_manifests", "fx_deps", "fx_adv_flat", "fx_paths", "fx_vulns_libs", "fx_lib_deps")
SEV = "case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end"
AGG = BASE + f""", both_feeds as (
 select ecosystem, package_name, package_version, {SEV} as rank, 1 as s, 0 as f from fx_vulns_full
 union all select ecosystem, package_name, package_version, {SEV}, 0, 1 from fx_findings_full),
agg as (select ecosystem, package_name, package_version,
  case min(rank) when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' when 3 then 'LOW' else 'UNKNOWN' end as highest_severity,
  sum(s) as static_count, sum(f) as supply_chain_count from both_feeds group by all)
"""
KEEP = """(severity <> 'UNKNOWN' or (trim(description) <> '' and description <> 'No description available') or link is not null
 or cvss is not null or fixed_versions is not null or affected_versions <> 'Unknown')"""
COUNTERS = """count(*) as total, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high,
 count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low, count(*) filter (severity = 'UNKNOWN') as unknown"""
NAMED = BASE + """, named as (select name, min(case when k % 80 = 1 then 1 else 3 end) as rank from fx_adv_flat group by 1)
"""
TABLE = """select ordinal, ecosystem, d.name, version, file, is_dev, rank is not null as is_vulnerable,
 case rank when 1 then 'HIGH' when 3 then 'LOW' else 'N/A' end as max_severity,
 case when provenance then 'Enabled' when not provenance then 'Missing' else 'Unknown' end as provenance_status
from fx_deps d left join named n on n.name = d.name"""
ORACLES = {
    "aggregate_by_package": AGG + "select * from agg",
    "package_findings": BASE + """select ecosystem, package_name, package_version, 'static' as feed, id as label, severity, title,
 null as confidence, ordinal from fx_vulns_full
union all select ecosystem, package_name, package_version, 'supply chain', category, severity, title, confidence, ordinal from fx_findings_full""",
    "aggregated_summary": AGG + """select count(*) as total_packages, count(*) filter (static_count > 0) as packages_with_static_findings,
 count(*) filter (supply_chain_count > 0) as packages_with_supply_chain_findings,
 count(*) filter (highest_severity = 'CRITICAL') as critical, count(*) filter (highest_severity = 'HIGH') as high,
 count(*) filter (highest_severity = 'MEDIUM') as medium, count(*) filter (highest_severity = 'LOW') as low,
 count(*) filter (highest_severity = 'UNKNOWN') as unknown from agg""",
    "filter_min_severity": BASE + "select ordinal, severity from fx_vulns_full where severity in ('CRITICAL', 'HIGH', 'MEDIUM')",
    "filter_uninformative": BASE + f"select ordinal, severity from fx_vulns_full where {KEEP}",
    "hidden_count": BASE + f"select count(*) filter (not {KEEP}) as hidden from fx_vulns_full",
    "fail_on": BASE + f"""select repo, {COUNTERS}, count(*) filter (severity in ('CRITICAL', 'HIGH')) > 0 as failed
from fx_vulns_full group by repo""",
    "overview_totals": BASE + f"""select {COUNTERS} from (select severity from fx_vulns_full union all select severity from fx_findings_full) x""",
    "unpinned_dependencies": BASE + """select ordinal, ecosystem, version_spec from fx_deps where
 (ecosystem = 'npm' and (version_spec like '^%' or version_spec like '~%' or version_spec like '%*%'))
 or (ecosystem = 'pypi' and version_spec not like '==%')""",
    "vulnerable_split": BASE + """, hit as (select distinct ecosystem, package_name, package_version from fx_vulns_libs)
select count(*) filter (h.package_name is not null) as vulnerable, count(*) filter (h.package_name is null) as safe
from fx_lib_deps d left join hit h on h.ecosystem = d.ecosystem and h.package_name = d.name and h.package_version = d.version""",
    "dependency_table": NAMED + TABLE,
    "dependency_table_filtered": NAMED + TABLE + " where rank is not null and not provenance and lower(d.name) like '%r%'",
    "vulnerability_table": BASE + """select id, package_name, package_version, severity, title, 'OSV' as source, null as file from fx_vulns_full
where severity = 'HIGH' and package_name like '%pkg1%'
union all select category, package_name, package_version, severity, title, 'LLM', nullif(file_path, '') from fx_findings_full
where severity = 'HIGH' and package_name like '%pkg1%'""",
    "package_file_links": NAMED + """select distinct d.name as package_name, case when file like 'repo1%' then ltrim(substr(file, 6), '/') else file end as file
from fx_deps d where d.name in (select name from named)""",
    "age_label": BASE + """, a as (select ordinal, case when ordinal % 13 = 0 then null else ordinal - 5 end as days from fx_deps)
select ordinal, case when days is null or days < 0 then 'Unknown' when days < 1 then 'today' when days < 30 then days || 'd'
 when days < 365 then (days // 30) || 'mo' when days < 3650 then printf('%.1f', days / 365.0::double) || 'y' else (days // 365) || 'y' end as label from a""",
    "reference_label": with_views("fx_vulns") + """select ordinal, case ordinal % 3 when 0 then 'NVD · CVE-2020-' || ordinal
 when 1 then 'GitHub · ' || 'GHSA-' || ordinal else 'Link · example.com' end as label from fx_vulns""",
    "unresolved_table": BASE + """select ordinal, case ordinal % 4 when 0 then 'not_found' when 1 then 'no_access' when 2 then 'invalid_spec' else 'registry_unavailable' end as reason,
 case ordinal % 4 when 0 then 'Package not found in registry' when 1 then 'No access to private registry'
  when 2 then 'Invalid version specification' else 'Registry service unavailable' end as reason_text from fx_deps""",
    "scan_totals": BASE + """, parts as (select repo, 1 as files, 0 as packages, 0 as vulnerabilities, 0 as severe from fx_manifests
 union all select repo, 0, 1, 0, 0 from fx_deps
 union all select repo, 0, 0, 1, case when severity in ('CRITICAL', 'HIGH') then 1 else 0 end from fx_vulns_full)
select repo, sum(files) as files, sum(packages) as packages, sum(vulnerabilities) as vulnerabilities, sum(severe) as severe,
 case when sum(vulnerabilities) = 0 then 'clear' when sum(severe) > 0 then 'needs attention' else 'review recommended' end as verdict
from parts group by repo""",
    "repo_name": BASE + """select ordinal, case ordinal % 4 when 0 then 'org/' || repo when 1 then 'org/' || repo when 2 then repo end as repo_name from fx_paths""",
    "package_findings_text": AGG + """select ecosystem, package_name, package_version, 0 as part, 0 as ordinal,
 highest_severity || ' ' || package_name || '@' || package_version || ' [' || ecosystem || ']' as line from agg
union all select ecosystem, package_name, package_version, 1, 0, '  Static Analysis:' from agg where static_count > 0
union all select ecosystem, package_name, package_version, 3, 0, '  Supply Chain Analysis:' from agg where supply_chain_count > 0
union all select ecosystem, package_name, package_version, 2, ordinal, '  • ' || severity || ' rule matched: ' || id
 || case when title = 'No description available' then '' else ' — ' || title end from fx_vulns_full
union all select ecosystem, package_name, package_version, 4, ordinal, '  • ' || severity || ' ' || category || ': ' || title
 || ' (' || cast(floor(confidence * 100 + 0.5) as bigint) || '% confidence)' from fx_findings_full""",
    "vulnerability_text": BASE + """select ordinal, severity || ' - ' || id || chr(10) || 'Package: ' || package_name || '@' || package_version
 || case when title in (id, 'No description available') then '' else chr(10) || 'Title: ' || title end
 || case when coalesce(cvss, 0) = 0 then '' else chr(10) || 'CVSS Score: ' || cvss end
 || case when affected_versions = 'Unknown' then '' else chr(10) || 'Affected: ' || affected_versions end
 || coalesce(chr(10) || 'Fixed in: ' || fixed_versions, '')
 || case when trim(description) = '' or description in (title, 'No description available') then '' else chr(10) || chr(10) || description end
 || coalesce(chr(10) || chr(10) || 'References:' || chr(10) || '  • ' || link, '') || chr(10) || chr(10) || 'Source: ' || source as text
from fx_vulns_full""",
}
