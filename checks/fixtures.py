"""Input views derived from the given tables, as SQL that Spark and DuckDB read alike."""

FIXTURES = {
    "fx_deps": """
select o_orderkey as ordinal, 'repo' || cast(o_custkey % 20 as string) as repo,
 case o_orderkey % 5 when 0 then 'npm' when 1 then 'pypi' when 2 then 'cargo' when 3 then 'go' else 'ruby' end as ecosystem,
 replace(p_name, ' ', '-') as name,
 cast(o_orderkey % 3 as string) || '.' || cast(o_custkey % 10 as string) || '.' || cast(o_orderkey % 7 as string) as version,
 case o_orderkey % 6 when 0 then '^' when 1 then '~' when 2 then '>=' when 3 then '==' else '' end
  || case when o_orderkey % 6 = 5 then '*' else cast(o_orderkey % 3 as string) || '.' || cast(o_custkey % 10 as string) || '.' || cast(o_orderkey % 7 as string) end as version_spec,
 'repo' || cast(o_custkey % 20 as string) || '/' || case o_orderkey % 5 when 0 then 'package.json' when 1 then 'requirements.txt' when 2 then 'Cargo.toml' when 3 then 'go.mod' else 'Gemfile.lock' end as file,
 o_orderstatus = 'F' as is_dev, o_orderkey % 6 = 3 as is_pinned, cast(o_orderkey % 4 as int) as depth,
 case o_orderkey % 3 when 0 then true when 1 then false else null end as provenance
from (select *, o_custkey % (select count(*) from part) as part_number from orders) o join part on p_partkey = part_number
""",
    "fx_adv": """
select case when p_partkey % 17 = 0 then 'MAL-' else 'ADV-' end || cast(p_partkey as string) as id,
 case p_partkey % 5 when 0 then 'npm' when 1 then 'PyPI' when 2 then 'crates.io' when 3 then 'Go' else 'RubyGems' end as osv_ecosystem,
 replace(p_name, ' ', '-') as name,
 cast(p_size % 2 as string) || '.0.0' as introduced,
 case when p_partkey % 7 = 0 then null else cast(1 + p_size % 3 as string) || '.' || cast(p_size % 10 as string) || '.0' end as fixed,
 case when p_partkey % 3 = 0 then null when p_partkey % 11 = 0 then 'CVSS:4.0/AV:N/AC:L' when p_partkey % 13 = 0 then '7.5' else
 'CVSS:3.1/AV:' || case p_partkey % 4 when 0 then 'N' when 1 then 'A' when 2 then 'L' else 'P' end
 || '/AC:' || case p_size % 2 when 0 then 'L' else 'H' end || '/PR:' || case p_size % 3 when 0 then 'N' when 1 then 'L' else 'H' end
 || '/UI:' || case p_partkey % 2 when 0 then 'N' else 'R' end || '/S:' || case when p_size % 5 < 3 then 'U' else 'C' end
 || '/C:' || case p_size % 3 when 0 then 'H' when 1 then 'L' else 'N' end || '/I:' || case p_size % 4 when 0 then 'H' when 1 then 'L' else 'N' end
 || '/A:' || case p_partkey % 3 when 1 then 'H' else 'N' end end as vector,
 case p_partkey % 6 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MODERATE' when 3 then 'LOW' when 4 then 'UNKNOWN' else null end as db_severity,
 'Issue in ' || p_name || case p_brand when 'Brand#1' then ' with backdoor' when 'Brand#2' then ' allows remote code execution' when 'Brand#3' then ' prototype pollution' when 'Brand#4' then ' Denial of Service' else '' end as summary
from part
""",
    "fx_vulns": """
select event_id as ordinal, 'V' || cast(event_id % 40 as string) as id,
 case user_id % 5 when 0 then 'npm' when 1 then 'pypi' when 2 then 'cargo' when 3 then 'go' else 'ruby' end as ecosystem,
 'pkg' || cast(user_id as string) as package_name, cast(event_id % 3 as string) || '.0.0' as package_version,
 case event_type when 'purchase' then 'CRITICAL' when 'error' then 'HIGH' when 'click' then 'MEDIUM' when 'view' then 'LOW' else 'UNKNOWN' end as severity,
 event_type || ' issue ' || cast(event_id as string) as title,
 case when event_id % 4 = 0 then null else value end as cvss,
 case event_id % 3 when 0 then 'https://nvd.nist.gov/vuln/detail/CVE-2020-' || cast(event_id as string) when 1 then 'https://github.com/advisories/GHSA-' || cast(event_id as string) else 'https://www.example.com/a' end as reference,
 ts as package_published_ts
from events
""",
    "fx_edges": """
select 'p' || cast(cast(floor((p_partkey - 1) / 3) as bigint) as string) as source, 'p' || cast(p_partkey as string) as target from part where p_partkey >= 1
union all select 'p' || cast((p_partkey * 7) % 200 as string), 'p' || cast(p_partkey as string) from part where p_partkey % 10 = 0 and p_partkey > 0
""",
    "fx_registry": """
select s_suppkey as ordinal, case s_suppkey % 5 when 0 then 'npm' when 1 then 'pypi' when 2 then 'cargo' when 3 then 'go' else 'ruby' end as ecosystem,
 'lib' || cast(s_suppkey as string) as name, cast(1 + s_nationkey % 3 as string) || '.' || cast(s_suppkey % 4 as string) || '.0' as version,
 case when s_suppkey % 19 = 0 then 404 when s_suppkey % 23 = 0 then 503 else 200 end as status,
 case s_suppkey % 5
 when 0 then '{"version":"1.0.0","dependencies":{"lib' || cast(s_suppkey * 2 % 100 as string) || '":"^1.0.0"},"dist":{"attestations":' || case when s_suppkey % 2 = 0 then '{"url":"u","provenance":{"predicateType":"https://slsa.dev/provenance/v1"}}' else 'null' end || '},"scripts":{"postinstall":"node i.js","test":"t"},"maintainers":[{"name":"m' || cast(s_nationkey as string) || '"}],"time":{"created":"2015-01-0' || cast(1 + s_suppkey % 9 as string) || 'T00:00:00Z","modified":"2024-01-20T00:00:00Z"}}'
 when 1 then '{"info":{"version":"2.0","author":"a","requires_dist":["lib2 (>=1.0)","lib3; extra == ''x''"]},"urls":[{"upload_time_iso_8601":"2023-05-02T00:00:00Z"},{"upload_time":"2023-05-01T00:00:00"' || case when s_nationkey % 2 = 0 then ',"attestations":{}' else '' end || '}]}'
 when 2 then '{"crate":{"newest_version":"1.2.0","max_version":"1.2.0","created_at":"2019-01-01T00:00:00Z","updated_at":"2024-01-31T00:00:00Z","downloads":' || cast(s_suppkey as string) || '},"versions":[{"num":"1.2.0","created_at":"2024-01-31T00:00:00Z"},{"num":"1.1.0","created_at":"2022-01-01T00:00:00Z"}]}'
 when 3 then '{"Version":"v1.4.0","Time":"2021-06-01T00:00:00Z"}'
 else '{"version":"3.1","authors":"A, B","downloads":9,"version_created_at":"2020-02-02T00:00:00Z","dependencies":{"runtime":[{"name":"rack","requirements":">= 1.0"}]}}' end as body
from supplier
""",
    "fx_manifests": """
select c_custkey as ordinal, 'repo' || cast(c_nationkey as string) as repo, 'repo' || cast(c_nationkey as string) || '/m' || cast(c_custkey as string) || '/' || t as path, t as type, body as content from (
select c_custkey, c_nationkey, case c_custkey % 14 when 0 then 'package.json' when 1 then 'package-lock.json' when 2 then 'yarn.lock' when 3 then 'pnpm-lock.yaml' when 4 then 'bun.lock' when 5 then 'requirements.txt' when 6 then 'pyproject.toml' when 7 then 'Pipfile' when 8 then 'Cargo.toml' when 9 then 'Cargo.lock' when 10 then 'go.mod' when 11 then 'go.sum' when 12 then 'Gemfile' else 'Gemfile.lock' end as t,
 case c_custkey % 14
 when 0 then '{"dependencies":{"d' || k || '":"^1.' || k || '.0"},"devDependencies":{"jest":"~2.0.' || k || '"}}'
 when 1 then '{"packages":{"":{"version":"0"},"node_modules/a/node_modules/@s/b' || k || '":{"version":"1.0.' || k || '","dev":true}}}'
 when 2 then '# yarn' || nl || '"@s/y' || k || '@^1.0.0":' || nl || '  version "1.0.' || k || '"' || nl || '  dev: true' || nl
 when 3 then 'lockfileVersion: 5' || nl || 'packages:' || nl || '  /p' || k || '@1.2.' || k || ':' || nl || 'settings:' || nl || '  /no@1:' || nl
 when 4 then case when c_custkey % 28 = 4 then '{"packages":{"npm:u' || k || '@3.0.' || k || '":{"dev":true}}}' else 'u' || k || '@3.1.' || k || nl || '# c' end
 when 5 then '# c' || nl || 'flask' || nl || 'req[x]==2.' || k || nl || '-r other.txt' || nl || 'zope.i>=' || k || ',<9'
 when 6 then '[project.dependencies]' || nl || 'q' || k || ' = "1.' || k || '"' || nl || '[tool.x]' || nl || 'no = "1"'
 when 7 then '{"packages":{"a":"==1.' || k || '","b":{"version":"*"}},"dev-packages":{"c":"*"}}'
 when 8 then '[dependencies]' || nl || 'serde = "1.' || k || '"' || nl || 'tokio = { version = "2.' || k || '", features = [] }' || nl || '[dev-dependencies]' || nl || 'w = "0.1"'
 when 9 then '[[package]]' || nl || 'name = "c' || k || '"' || nl || 'version = "0.' || k || '.1"' || nl || nl || '[[package]]' || nl || 'name = "z"' || nl || 'version = "9.0.0"'
 when 10 then 'module m' || nl || 'go 1.22' || nl || 'require x.org/one v1.0.' || k || nl || 'require (' || nl || ' x.org/two v2.0.' || k || ' // indirect' || nl || ')'
 when 11 then 'x.org/s v1.0.' || k || ' h1:a' || nl || 'x.org/s v1.0.' || k || '/go.mod h1:b'
 when 12 then 'gem ''rails'', ''6.' || k || '''' || nl || 'group :development, :test do' || nl || 'gem "rspec", version: "3.' || k || '"' || nl || 'end'
 else 'GEM' || nl || '  specs:' || nl || '    rack (2.2.' || k || ')' || nl || '    nokogiri (1.13.' || k || '-x86_64-linux)' || nl || '      racc (~> 1.4)' || nl || nl || 'PLATFORMS' || nl || 'DEPENDENCIES' || nl || '  rack' end as body
from (select c_custkey, c_nationkey, cast(c_custkey % 8 as string) as k, chr(10) as nl from customer) a) b
""",
    "fx_paths": """
select source as repo, case doc_id % 9 when 0 then '' when 1 then 'src/' when 2 then 'node_modules/x/' when 3 then 'app/api/' when 4 then 'test/fixtures/' when 5 then 'vendor/' when 6 then 'a/b/c/' when 7 then 'dist/' else 'docs/' end
 || case doc_id % 20 when 0 then 'package.json' when 1 then 'package-lock.json' when 2 then 'yarn.lock' when 3 then 'pnpm-lock.yaml' when 4 then 'bun.lock' when 5 then 'requirements.txt' when 6 then 'poetry.lock' when 7 then 'Pipfile.lock' when 8 then 'Cargo.toml' when 9 then 'Cargo.lock' when 10 then 'go.mod' when 11 then 'go.sum' when 12 then 'Gemfile' when 13 then 'Gemfile.lock'
 when 14 then 'index.js' when 15 then 'main.py' when 16 then 'lib.rs' when 17 then 'App.TSX' when 18 then 'stats.R' else 'notes' end as relative_path, doc_id as ordinal
from documents
""",
    "fx_files": """
select doc_id as ordinal, case doc_id % 5 when 0 then 'npm' when 1 then 'pypi' when 2 then 'cargo' when 3 then 'go' else 'ruby' end as ecosystem, source as name,
 case when doc_id % 2 = 0 then '1.0.0' else '1.1.0' end as version,
 'package/' || case doc_id % 12 when 0 then 'package.json' when 1 then 'setup.py' when 2 then 'lib/index.js' when 3 then 'lib/a.spec.js' when 4 then 'dist/app.min.js' when 5 then 'scripts/postinstall.js' when 6 then 'README.md' when 7 then 'hook.pth' when 8 then 'build.rs' when 9 then 'extconf.rb' when 10 then 'docs/guide.txt' else 'lib/util.js' end
 as path,
 text || chr(10) || case doc_id % 16
 when 0 then 'eval(response);' when 1 then 'require("child_process"); curl http' when 2 then 'os.system("x"); os.popen("y")' when 3 then 'JSON.stringify(process.env); fetch("https://evil.top/")'
 when 4 then '.ssh/id_rsa .npmrc; https.get("https://a.example.net")' when 5 then 'cmdclass = {"install": X}; subprocess.run(["a"])' when 6 then 'pip install x' when 7 then 'exec("".join(map(chr,[1])))'
 when 8 then 'pastebin.com/raw' when 9 then '"postinstall": "node i.js"; fetch(u)' when 10 then 'base64.b64decode(x); eval(y)' when 11 then 'fetch("https://github.com/x")' when 12 then 'crontab -l; wallet.dat' when 13 then 'eval(uated)' when 14 then 'a\u202eb' else 'c\u200bd' end as content
from documents
""",
    "fx_findings": """
select conv_id * 100 + turn as ordinal, 'pkg' || cast(conv_id % 30 as string) as package_name, cast(conv_id % 2 as string) || '.0.0' as package_version,
 case conv_id % 5 when 0 then 'npm' when 1 then 'pypi' when 2 then 'cargo' when 3 then 'go' else 'ruby' end as ecosystem,
 case turn % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as severity,
 case conv_id % 4 when 0 then 'network-exfiltration' when 1 then 'persistence' when 2 then 'code-obfuscation' else 'time-bomb' end as category,
 cast((conv_id * 7 + turn * 13) % 11 as double) / 10 as confidence, role || ' finding ' || cast(turn % 3 as string) as title,
 case (conv_id + turn) % 5 when 0 then 'FALSE_POSITIVE' when 1 then 'CONFIRMED' when 2 then 'DOWNGRADED' else null end as verdict
from conversations
""",
    "fx_llm": """
select conv_id * 100 + turn as ordinal, case turn % 3 when 0 then 'Here: [{"category":"exec","severity":"high","confidence":' || cast(conv_id % 3 as string) || ',"title":"t' || cast(turn as string) || '"},{"category":"time-bomb","severity":"critical","confidence":0.5,"title":"u"},{"category":"exec","severity":"low","confidence":-1,"title":"v' || cast(conv_id as string) || '"}] done'
 when 1 then 'verdict {"verdict":"CONFIRMED","adjustedSeverity":"LOW"} end' else 'no json here [' end as response
from conversations
""",
    "fx_star_deps": """
select ordinal, repo, ecosystem, name, case when version_spec = '*' then '*' else version end as version,
 version_spec, file, is_dev, is_pinned, depth, provenance
from fx_deps """,
    "fx_adv_flat": """
select *, cast(substring(id, 5) as bigint) as k,
 case when cast(substring(id, 5) as bigint) % 23 = 0 then '0.5.0' else null end as early_fixed,
 case when cast(substring(id, 5) as bigint) % 19 = 0 then '2.1.1' else null end as listed,
 case when cast(substring(id, 5) as bigint) % 5 = 0 then '5.0' else null end as package_score,
 case when cast(substring(id, 5) as bigint) % 29 = 0 then '8.1' else null end as database_score
from fx_adv """,
    "fx_adv_docs": """
select k, '{"id":"' || id || '"' || case when k % 4 = 0 then '' else ',"summary":"' || summary || '"' end
 || case when k % 4 = 1 then '' else ',"details":"Details of ' || summary || '"' end
 || case when vector is null then case when k % 2 = 0 then ',"severity":[]' else '' end
    else ',"severity":[{"type":"CVSS_V4","score":"9.9"},{"type":"CVSS_V3","score":"' || vector || '"}]' end
 || ',"affected":[{"package":{"name":"' || name || '","ecosystem":"' || osv_ecosystem || '"}'
 || case when package_score is null then '' else ',"severity":[{"type":"CVSS_V3","score":"' || package_score || '"}]' end
 || ',"ranges":[{"type":"SEMVER","events":[' || case when early_fixed is null then '' else '{"introduced":"0"},{"fixed":"' || early_fixed || '"},' end
 || '{"introduced":"' || introduced || '"}' || case when fixed is null then '' else ',{"fixed":"' || fixed || '"}' end || ']}]'
 || case when listed is null then '' else ',"versions":["' || listed || '","9.9.9"]' end || '}]'
 || case when k % 6 = 0 then '' else ',"references":[{"type":"WEB","url":"https://nvd.nist.gov/vuln/detail/CVE-2020-' || cast(k as string) || '"},{"type":"FIX","url":"https://www.example.com/a"}]' end
 || case when database_score is not null then ',"database_specific":{"severity":[{"type":"CVSS_V3","score":"' || database_score || '"}]}'
    when db_severity is null then '' else ',"database_specific":{"severity":"' || db_severity || '"}' end
 || ',"published":"2023-01-0' || cast(1 + k % 9 as string) || 'T00:00:00Z"}' as body
from fx_adv_flat """,
    "fx_sized_files": """
select *, cast(length(content) * case when ordinal % 17 = 0 then 0 when ordinal % 23 = 0 then 999 else 1 end as bigint) as size,
 case when version = '1.1.0' then '1.0.0' else null end as previous_version
from fx_files """,
    "fx_hooks": """
select distinct ecosystem, name, version, case when version = '1.0.0' then 'postinstall' else 'install' end as hook,
 case when version = '1.0.0' then 'node scripts/postinstall.js --quiet' else 'node hook.pth && curl http' end as command
from fx_files where ecosystem = 'npm' """,
    "fx_fetches": """
select 'https://registry.example.org/' || r.ecosystem || '/' || r.name as url, r.ecosystem, 'version' as kind, r.name,
 l_orderkey * 10 + l_linenumber as fetched_at,
 case when l_orderkey % 11 = 0 then 500 else r.status end as status,
 case when l_orderkey % 13 = 0 then '{broken' else r.body end as body
from lineitem join fx_registry r on r.ordinal = l_suppkey """,
    "fx_libs": """
select s_suppkey as n, s_nationkey as k, cast(s_suppkey as string) as sn, cast(s_nationkey as string) as sk,
 case s_suppkey % 5 when 0 then 'npm' when 1 then 'pypi' when 2 then 'cargo' when 3 then 'go' else 'ruby' end as ecosystem,
 'lib' || cast(s_suppkey as string) as name,
 cast(1 + s_nationkey % 3 as string) || '.' || cast(s_suppkey % 4 as string) || '.0' as version,
 'lib' || cast((s_suppkey + 5) % 100 as string) as next1, 'lib' || cast((s_suppkey * 6 + 10) % 100 as string) as next2,
 case when s_suppkey % 19 = 0 then 404 when s_suppkey % 23 = 0 then 503 else 200 end as status
from supplier """,
    "fx_docs": """
select ecosystem, kind, name, doc_version as version, 'https://registry.example.org/' || ecosystem || '/' || kind || '/' || name || '/' || coalesce(doc_version, '') as url, doc_status as status, body from (
select ecosystem, kind, name,
 case kind when 'version' then case ecosystem when 'cargo' then '1.2.0' when 'go' then 'v' || version else version end
  when 'dependencies' then '1.2.0' when 'mod' then version when 'archive' then version else null end as doc_version,
 case kind when 'version' then status when 'latest' then case when n % 31 = 0 then 404 else 200 end
  when 'package' then case when n % 29 = 0 then 404 else 200 end
  when 'archive' then case n % 7 when 0 then 404 when 1 then 500 else 200 end else 200 end as doc_status,
 case kind
 when 'version' then case ecosystem
 when 'npm' then '{"version":"' || version || '","dependencies":{"' || next1 || '":"^1.0.0","' || next2 || '":"*"},"dist":{"tarball":"t","attestations":' || case when n % 2 = 0 then '{"url":"u' || sn || '","provenance":{"predicateType":"https://slsa.dev/provenance/v1"}}' else 'null' end || '},"scripts":{"postinstall":"node i.js","prepare":"node ./x/build.js now","test":"t"}}'
 when 'pypi' then '{"info":{"version":"' || version || '","requires_dist":["' || next1 || ' (>=1.0)","extra9; extra == ''x''","' || next2 || '>=2.0"]},"urls":[{"upload_time_iso_8601":"2023-05-02T00:00:00Z"},{"upload_time":"2023-05-01T0' || cast(k % 10 as string) || ':00:00"' || case when k % 2 = 0 then ',"attestations":{"provenance":{"url":"p' || sn || '"}}' else '' end || '}]}'
 when 'cargo' then '{"version":{"num":"1.2.0","created_at":"2024-01-3' || cast(k % 2 as string) || 'T00:00:00Z"}}'
 when 'go' then '{"Version":"v' || version || '","Time":"2021-06-0' || cast(1 + k % 9 as string) || 'T00:00:00Z"}'
 else '{"version":"' || version || '","created_at":"2020-02-0' || cast(1 + k % 9 as string) || 'T00:00:00Z","dependencies":{"runtime":[{"name":"' || next1 || '","requirements":">= 1.0, < 9"},{"name":"' || next2 || '","requirements":"~> 3.1"}]}}' end
 when 'latest' then case ecosystem
 when 'npm' then '{"version":"1.10.0","dependencies":{"' || next1 || '":"~1.0"},"dist":{}}'
 when 'pypi' then '{"info":{"version":"2.0","author":"a' || sk || '","maintainer":"' || case when k % 3 = 0 then 'a' || sk else 'm' || sk end || '","summary":"s","license":"MIT","home_page":"h","project_urls":{' || case when k % 2 = 0 then '"Repository":"r' || sn || '"' else '"Other":"o"' end || '},"requires_dist":["' || next1 || '"]},"releases":{"1.0":[{"filename":"a.' || case when k % 4 = 0 then 'tar.gz' else 'whl' end || '","upload_time_iso_8601":"2019-03-0' || cast(1 + k % 9 as string) || 'T00:00:00Z"}],"2.0":[{"filename":"b.whl","upload_time":"2024-01-' || cast(10 + k % 20 as string) || 'T00:00:00","metadata_version":"2.' || cast(k % 5 as string) || '"}]},"urls":[{"upload_time":"2024-01-10T00:00:00"}]}'
 when 'go' then '{"Version":"v1.4.0","Time":"2021-06-01T00:00:00Z"}'
 when 'ruby' then '{"version":"3.1","authors":"A' || sk || ', B ,","downloads":' || sn || ',"info":"i","licenses":["MIT","X"],"version_created_at":"2020-02-0' || cast(1 + k % 9 as string) || 'T00:00:00Z","homepage_uri":"h' || sn || '","dependencies":{"runtime":[{"name":"' || next1 || '","requirements":">= 1.0"}]}}'
 else '{}' end
 when 'package' then case ecosystem when 'npm' then '{"dist-tags":{"latest":"1.10.0"},"versions":{"1.10.0":{"scripts":{' || case when k % 2 = 0 then '"postinstall":"node i.js","install":"",' else '' end || '"test":"t"},"dist":{"attestations":' || case when k % 3 = 0 then '{"url":"u"}' else 'null' end || '}},"1.2.0":{"maintainers":[{"name":"old"}]},"1.9.0":{"maintainers":[{"name":"m' || cast(k % 7 as string) || '"}]}},"time":{"created":"2015-01-0' || cast(1 + n % 9 as string) || 'T00:00:00Z","modified":"2024-01-' || cast(10 + k % 20 as string) || 'T00:00:00Z","1.10.0":"2023-12-01T00:00:00Z","' || version || '":"2022-0' || cast(1 + k % 9 as string) || '-01T00:00:00.000Z"},"maintainers":[{"name":"m' || cast(k % 5 as string) || '"},{"email":"e@x"}],"repository":{"url":"git+' || sn || '"},"description":"d","license":"ISC"}'
 else '{"crate":{"newest_version":"1.2.0","max_version":"1.2.0","created_at":"2019-01-0' || cast(1 + k % 9 as string) || 'T00:00:00Z","updated_at":"2024-01-' || cast(10 + k % 20 as string) || 'T00:00:00Z","downloads":' || sn || ',"repository":"r"},"versions":[{"num":"1.2.0","created_at":"2024-01-31T00:00:00Z"},{"num":"1.1.0","created_at":"2022-01-01T00:00:00Z"}],"keywords":[{"id":"k' || sk || '"},{"keyword":"w"}]}' end
 when 'dependencies' then '{"dependencies":[{"crate_id":"' || next1 || '","req":"^1","optional":false,"kind":"normal"},{"crate_id":"' || next2 || '","req":"","optional":false,"kind":"build"},{"crate_id":"devonly","req":"1","kind":"dev"},{"crate_id":"opt","req":"1","optional":true,"kind":"normal"}]}'
 when 'mod' then 'module m' || chr(10) || 'require ' || next1 || ' v1.4.0' || chr(10) || 'require (' || chr(10) || ' ' || next2 || ' v1.' || cast(n % 4 as string) || '.0' || chr(10) || ' other v0.1.0 // indirect' || chr(10) || ')'
 when 'list' then 'v1.2.0' || chr(10) || 'v1.' || cast(k % 4 as string) || '.9' || chr(10) || 'v1.4.0' || chr(10)
 when 'versions' then '[{"number":"3.1","created_at":"2020-02-02T00:00:00Z"},{"number":"' || version || '","built_at":"2018-01-0' || cast(1 + k % 9 as string) || 'T00:00:00Z"}]'
 when 'downloads' then case ecosystem when 'npm' then '{"downloads":' || cast(n * 1000 as string) || '}' else '{"data":{"last_week":' || cast(n * 7 as string) || '}}' end
 else null end as body
from fx_libs KINDS
where kind = 'version' or (kind = 'latest' and ecosystem <> 'cargo') or (kind = 'package' and ecosystem in ('npm', 'cargo'))
 or (kind = 'dependencies' and ecosystem = 'cargo') or (kind in ('mod', 'list') and ecosystem = 'go')
 or (kind = 'versions' and ecosystem = 'ruby') or (kind = 'downloads' and ecosystem in ('npm', 'pypi'))
 or (kind = 'archive' and n % 11 <> 3)
) d """,
    "fx_lib_deps": """
select (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 as ordinal, 'repo' || cast(l_orderkey % 20 as string) as repo,
 'repo' || cast(l_orderkey % 20 as string) || '/m' || cast(l_partkey % 3 as string) as file, ecosystem, name,
 case l_partkey % 4 when 0 then '9.9.9' when 1 then '*' when 2 then '^' || version else version end as version,
 case l_partkey % 7 when 0 then '^' || version when 1 then '*' when 2 then '==9.9.9' when 3 then '>=1.0, <3' when 4 then 'v' || version when 5 then '~' || version else version end as version_spec,
 l_returnflag = 'R' as is_dev, cast(null as boolean) as provenance
from lineitem join fx_libs on n = l_suppkey """,
    "fx_roots": """
select distinct 'repo' || cast(n_regionkey as string) as repo, 'repo' || cast(n_regionkey as string) || '/package.json' as file,
 'npm' as ecosystem, 'p' || cast(case when n_nationkey = 0 then 0 else n_nationkey * 3 end as string) as name, '*' as version_spec, n_nationkey % 4 = 1 as is_dev
from nation """,
    "fx_vulns_libs": """
select (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 as ordinal, 'V' || cast(l_orderkey % 40 as string) as id, ecosystem, name as package_name,
 case l_partkey % 3 when 0 then '9.9.9' when 1 then '1.2.0' else version end as package_version
from lineitem join fx_libs on n = l_suppkey """,
    "fx_findings_full": """
select ordinal, package_name, package_version, ecosystem, case when ordinal % 7 = 0 then '' else '/scan/root/' || category || '.js' end as file_path,
 category, severity, confidence, title, 'd' || cast(ordinal as string) as description,
 case when ordinal % 3 = 0 then null else 'e' end as evidence, 'fix' as remediation, false as deep_investigated, verdict
from fx_findings """,
    "fx_verdicts": """
select ordinal, verdict, case when verdict = 'DOWNGRADED' then 'low' when ordinal % 2 = 0 then 'none' else null end as adjusted_severity,
 case when ordinal % 3 = 0 then cast(1.5 as double) when ordinal % 3 = 1 then cast(0.25 as double) else null end as adjusted_confidence,
 case when ordinal % 4 = 0 then 'step' else null end as attack_chain, case when ordinal % 8 = 0 then 'keys' else null end as data_at_risk,
 case when ordinal % 5 = 0 then 'upgrade' else null end as remediation
from fx_findings where verdict is not null """,
    "fx_vulns_full": """
select ordinal, id, ecosystem, package_name, package_version, severity, 'repo' || cast(ordinal % 20 as string) as repo,
 case when ordinal % 5 = 0 then id when ordinal % 5 = 1 then 'No description available' else title end as title,
 case when ordinal % 3 = 0 then 'No description available' when ordinal % 3 = 1 then ' ' else title end as description,
 cvss, case when ordinal % 2 = 0 then null else reference end as link, case when ordinal % 6 = 0 then '>=1 <2' else 'Unknown' end as affected_versions,
 case when ordinal % 10 = 0 then '2.0' else null end as fixed_versions, 'OSV' as source
from fx_vulns """,
}
