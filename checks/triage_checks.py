"""Package files, triage and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import table, view, with_views
from pkgaudit.functions import paths
from pkgaudit.functions.indicators import ADDRESS, INDICATORS, KNOWN_HOSTS
from pkgaudit.operators import explore, package_files, triage
from pkgaudit.operators.keys import PACKAGE
from pkgaudit.session import cut_lineage, spread


def _files(spark, sf_dir):
    """The file view with the texts spread over the task slots: the test tables are one task each, larger ones stay."""
    documents, slots = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() < slots:
        documents = spread(documents, slots, "doc_id")
    documents.createOrReplaceTempView("spread_documents")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    from checks.fixtures import FIXTURES
    return spark.sql(FIXTURES["fx_files"].replace("from documents", "from spread_documents"))


def _sized(spark, sf_dir):
    return view(spark, sf_dir, "fx_sized_files")


def select_text_files(spark, sf_dir):
    return package_files.select_text_files(_sized(spark, sf_dir)).select("ordinal", "path", "size")


def entry_points(spark, sf_dir):
    mains = view(spark, sf_dir, "fx_hooks").select(*PACKAGE, F.lit("./lib/index").alias("main"))
    return package_files.entry_points(_sized(spark, sf_dir), mains)


def suspicious_files(spark, sf_dir):
    return package_files.suspicious_files(_sized(spark, sf_dir)).select("ordinal", "path")


def hook_scripts(spark, sf_dir):
    return package_files.hook_scripts(view(spark, sf_dir, "fx_hooks"), _sized(spark, sf_dir))


def install_script_files(spark, sf_dir):
    return package_files.install_script_files(_sized(spark, sf_dir))


# What stood in the version before: the larger files where they are now, the others in a folder since gone.
PATH_BEFORE = "case when size > 9000 then path else replace(path, 'package/', 'package/old/') end"


def new_files_in_version(spark, sf_dir):
    files = _sized(spark, sf_dir)
    before = files.withColumn("path", F.expr(PATH_BEFORE)).withColumn("version", F.lit("1.0.0"))
    return package_files.new_files_in_version(files, before)


def content_map(spark, sf_dir):
    return package_files.content_map(_sized(spark, sf_dir), view(spark, sf_dir, "fx_hooks"))


def _text(df):
    entries = F.transform(F.map_entries("indicators"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return df.withColumns({"indicators": F.array_join(entries, ","), "categories": F.array_join("categories", "+")})


def indicator_counts(spark, sf_dir):
    counted = triage.indicator_counts(_files(spark, sf_dir))
    shown = F.transform("counts", lambda c: F.concat(c["name"], F.lit(":"), c["count"].cast("string")))
    return counted.select("ordinal", F.array_join(shown, ",").alias("counts"))


def base_scores(spark, sf_dir):
    return _text(triage.base_scores(triage.indicator_counts(_files(spark, sf_dir)))).select(
        "ordinal", "score", "indicators", "categories"
    )


def compound_multiplier(spark, sf_dir):
    scored = triage.base_scores(triage.indicator_counts(_files(spark, sf_dir)))
    return scored.select("ordinal", triage.compound_multiplier(F.col("score"), F.col("categories")).alias("score"))


def combo_bonuses(spark, sf_dir):
    scored = triage.base_scores(triage.indicator_counts(_files(spark, sf_dir)))
    return scored.select("ordinal", triage.combo_bonuses(F.col("score"), F.col("indicators")).alias("score"))


def path_adjustments(spark, sf_dir):
    scored = _files(spark, sf_dir).withColumn("score", (F.col("ordinal") % 40).cast("bigint"))
    return scored.select("ordinal", "path", triage.path_adjustments(F.col("score"), F.col("path")).alias("score"))


def triage_files(spark, sf_dir):
    return _text(triage.triage(_files(spark, sf_dir)))


def triage_report(spark, sf_dir):
    files = _files(spark, sf_dir)
    return triage.triage_report(cut_lineage(triage.triage(files)), files)


def investigation_plan(spark, sf_dir):
    return _text(triage.investigation_plan(cut_lineage(triage.triage(_files(spark, sf_dir)))))


def list_files(spark, sf_dir):
    return explore.list_files(_sized(spark, sf_dir))


def folder_counts(spark, sf_dir):
    return explore.folder_counts(_sized(spark, sf_dir))


def list_files_glob(spark, sf_dir):
    return explore.list_files(_sized(spark, sf_dir).withColumn("name", F.lit("all")), "*lib/*.js")


def read_file(spark, sf_dir):
    return explore.read_file(_sized(spark, sf_dir), "index.js").select(*PACKAGE, "path", "ordinal", "content")


def grep_files(spark, sf_dir):
    return explore.grep_files(_sized(spark, sf_dir), r"eval\(|license", "*.js", 1)


QUERIES = {f.__name__: f for f in (
    select_text_files, entry_points, suspicious_files, hook_scripts, install_script_files, new_files_in_version,
    content_map, indicator_counts, base_scores, compound_multiplier, combo_bonuses, path_adjustments, triage_report,
    investigation_plan, list_files, folder_counts, list_files_glob, read_file, grep_files,
)}
QUERIES["triage"] = triage_files


def quoted(pattern: str) -> str:
    for c in ("202a", "202b", "202c", "202d", "202e", "2066", "2067", "2068", "2069", "200f", "061c", "200b", "200c",
              "200d", "feff", "2060"):
        pattern = pattern.replace("\\u" + c, "\\x{" + c + "}")
    return "'" + pattern.replace("'", "''") + "'"


def count_sql(indicator) -> str:
    if indicator.name == "external-url":
        return (f"len(list_filter(regexp_extract_all(content, '(?i)https?://{ADDRESS}'), "
                f"lambda u: not regexp_matches(u, '(?i)^https?://({KNOWN_HOSTS})')))")
    if indicator.name == "dynamic-exec":
        free = quoted(indicator.pattern.replace("(?!uate)", ""))
        return f"len(regexp_extract_all(content, {free})) - len(regexp_extract_all(content, '(?i)eval\\s*\\(uate'))"
    return f"len(regexp_extract_all(content, {quoted(indicator.pattern)}))"


def scored_sql() -> str:
    names = lambda group: ", ".join(f"'{n}'" for n in group)
    has = lambda *group: f"bool_or(name in ({names(group)}))"
    network, execution = has(*triage.NETWORK_NAMES), has(*triage.EXEC_NAMES)
    combo = " + ".join(f"case when {c} then {p} else 0 end" for c, p in (
        (f"{has('install-script')} and ({network} or {execution})", 10),
        (f"{has('python-setup-override')} and ({network} or {execution})", 10),
        (f"{has('env-bulk-dump', 'credential-files')} and {network}", 8),
        (f"{has('base64-decode-exec')} and {execution}", 6),
        (f"{has('python-pip-install')} and {has('hex-base64-blob', 'encoded-powershell')}", 6),
        (f"{has('child-process')} and {has('curl-wget-nc')}", 6),
    ))
    counts = " union all ".join(
        f"select ordinal, {i} as idx, '{x.name}' as name, '{x.category}' as category, {x.weight} as weight, "
        f"{count_sql(x)} as n from f" for i, x in enumerate(INDICATORS)
    )
    return with_views("fx_sized_files", "fx_hooks") + f""", f as materialized (select * from fx_files),
counts as materialized (select * from ({counts}) c where n > 0),
cats as (select ordinal, category, min(idx) as idx from counts group by all),
base as materialized (
  select ordinal, sum(n * weight) as score, string_agg(name || ':' || n, ',' order by idx) as indicators,
   string_agg(name || '(' || n || ')', ', ' order by n desc, idx) as shown,
   count(distinct category) as n_cat, {combo} as bonus, {has('exec-chr-combo', 'known-c2')} as worst
  from counts group by ordinal),
named as (select b.*, (select string_agg(category, '+' order by idx) from cats c where c.ordinal = b.ordinal) as categories from base b),
multiplied as (select *, floor(case when n_cat >= 3 then score * 2.5::double when n_cat = 2 then score * 1.8::double
  else score::double end + 0.5) as raised from named),
bonused as (select *, case when worst then greatest(raised + bonus, 8) else raised + bonus end as total from multiplied)
"""


def path_sql(source: str, score: str) -> str:
    low = quoted(paths.any_of(paths.LOW_VALUE_PATHS))
    high = quoted(paths.any_of(paths.HIGH_VALUE_PATHS))
    return f"""select *, case when not path like '%.min.js' then p3 when p3 < 6 then floor(p3 * 0.3::double + 0.5)
   else floor(p3 * 1.2::double + 0.5) end as final from (
 select *, case when path like 'package.json:%' then p2 * 3 else p2 end as p3 from (
 select *, case when regexp_matches(path, {high}) then floor(p1 * 1.5::double + 0.5) else p1 end as p2 from (
 select *, case when regexp_matches(path, {low}) then floor({score} * 0.3::double + 0.5) else {score} end as p1
 from {source}) a) b) c"""


SCORED = scored_sql()
FINAL = SCORED + ", final as (" + path_sql("(select b.*, f.* exclude (ordinal) from bonused b join f using (ordinal))", "total") + ")\n"
FILES = with_views("fx_sized_files", "fx_hooks")
TEXT_CASE = " ".join(f"when '{e}' then regexp_matches(path, '{p}')" for e, p in paths.TEXT_FILES.items())
PICK = "row_number() over (partition by ecosystem, name, version order by ordinal)"
ORACLES = {
    "select_text_files": FILES + f"select ordinal, path, size from fx_sized_files where size > 0 and (case ecosystem {TEXT_CASE} end)",
    "entry_points": FILES + f"""select ecosystem, name, version, path from (select *, {PICK} as rn from fx_files where
 (ecosystem = 'npm' and path = 'package/lib/index.js') or (ecosystem = 'pypi' and path like '%/__init__.py')
 or (ecosystem = 'cargo' and (path like '%/src/lib.rs' or path like '%/src/main.rs'))
 or (ecosystem = 'go' and (path like '%/main.go' or path like '%/go.mod')) or (ecosystem = 'ruby' and path like '%/lib.rb')) x where rn = 1""",
    "suspicious_files": FILES + """select ordinal, path from fx_files where
 (ecosystem = 'npm' and path = 'package/scripts/postinstall.js') or (ecosystem = 'pypi' and path = 'package/setup.py')
 or (ecosystem = 'cargo' and path = 'package/build.rs') or (ecosystem = 'ruby' and path = 'package/extconf.rb')""",
    "hook_scripts": FILES + """select distinct h.ecosystem, h.name, h.version, h.hook, case when hook = 'postinstall' then 'scripts/postinstall.js' else 'hook.pth' end as script,
 f.path from fx_hooks h join fx_files f on f.ecosystem = h.ecosystem and f.name = h.name and f.version = h.version
 and f.path = case when hook = 'postinstall' then 'package/scripts/postinstall.js' else 'package/hook.pth' end""",
    "install_script_files": FILES + """select distinct ecosystem, name, version, list_extract(string_split(path, '/'), -1) as hook, path from fx_files
where (ecosystem = 'pypi' and path like '%/setup.py') or (ecosystem = 'cargo' and path like '%build.rs') or (ecosystem = 'ruby' and path like '%/extconf.rb')""",
    "new_files_in_version": FILES + """select distinct ecosystem, name, version, previous_version, substr(path, 9) as path
from fx_sized_files s where previous_version is not null and not exists (
 select 1 from (select ecosystem, name, '1.0.0' as version, """ + PATH_BEFORE + """ as path from fx_sized_files) p
 where p.ecosystem = s.ecosystem and p.name = s.name and p.version = s.previous_version and p.path = s.path)""",
    "content_map": FILES + """select ordinal, ecosystem, name, version, path, content from fx_files
union all select null, ecosystem, name, version, 'package.json:' || hook, command from fx_hooks""",
    "indicator_counts": SCORED + "select f.ordinal, coalesce(indicators, '') as counts from f left join base using (ordinal)",
    "base_scores": SCORED + "select ordinal, score, indicators, categories from named",
    "compound_multiplier": SCORED + "select ordinal, raised as score from multiplied",
    "combo_bonuses": SCORED + "select ordinal, case when worst then greatest(score + bonus, 8) else score + bonus end as score from base",
    "path_adjustments": FILES + "select ordinal, path, final as score from ("
    + path_sql("(select ordinal, path, ordinal % 40 as score from fx_files)", "score") + ") z",
    "triage": FINAL + "select ordinal, ecosystem, name, version, path, final as score, indicators, categories from final",
    "triage_report": FINAL + """, found as (select ecosystem, name, version, count(*) as n from final group by all)
select t.ecosystem, t.name, t.version, null::double as score, null::bigint as ordinal, case when n is null then 'No threat indicators found in any file.'
 else 'Scanned ' || total || ' files. Found indicators in ' || n || ' files.' end as line
from (select ecosystem, name, version, count(*) as total from f group by all) t left join found using (ecosystem, name, version)
union all select ecosystem, name, version, final, ordinal, '[score: ' || cast(final as bigint) || '] ' || path || chr(10)
 || '   categories: ' || categories || ' | indicators: ' || shown from final""",
    "investigation_plan": FINAL + f"""select ordinal, ecosystem, name, version, path, final as score, indicators, categories,
 regexp_matches(path, {quoted(paths.INSTALL_TRIGGER)}) as is_trigger from final where final >= 8""",
    "list_files": FILES + "select ecosystem, name, version, path as entry, ordinal from fx_files",
    "folder_counts": FILES + """select ecosystem, name, version, case when path like '%/%' then split_part(path, '/', 1) else '(root)' end as entry,
 count(*) as file_count from fx_files group by all""",
    "list_files_glob": FILES + """select ecosystem, 'all' as name, version, path as entry, ordinal from fx_files
 where regexp_matches(path, '(?i).*lib/.*.js')""",
    "read_file": FILES + """select ecosystem, name, version, path, ordinal, content from (
 select *, row_number() over (partition by ecosystem, name, version order by ordinal) as rn from fx_files where path like '%index.js') x where rn = 1""",
    "grep_files": FILES + """, lines as (select ecosystem, name, version, path, ordinal,
  generate_subscripts(string_split(content, chr(10)), 1) as line, unnest(string_split(content, chr(10))) as t
  from fx_files where path like '%.js%'),
ctx as (select *, lag(t) over w as before, lead(t) over w as after from lines window w as (partition by ordinal order by line)),
hits as (select * from ctx where regexp_matches(t, '(?i)eval\\(|license'))
select ecosystem, name, version, path, ordinal, line,
 case when line > 1 then '  ' || (line - 1) || ': ' || before || chr(10) else '' end || '> ' || line || ': ' || t
 || case when after is not null then chr(10) || '  ' || (line + 1) || ': ' || after else '' end as snippet
from hits""",
}
