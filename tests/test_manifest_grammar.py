"""Manifest texts beyond the plainest ones, by hand."""

import pytest
from pyspark.sql import functions as F

from pkgaudit.functions import manifest_text as M


def read(spark, reader, text, *args):
    row = spark.createDataFrame([(text,)], "t string").select(reader(F.col("t"), *args).cast(M.ENTRIES).alias("e")).first()
    return [(e.name, e.version, e.is_dev) for e in row.e]


def test_pyproject_arrays_and_tables(spark):
    text = '''[build-system]
requires = ["setuptools"]
[project]
name = "x"
dependencies = [
  "requests[security,socks] >= 2.8.1, == 2.8.* ; python_version < '2.7'",  # not "this"
  'numpy',
  "pip @ https://example.org/pip.zip",
]
[project.optional-dependencies]
dev = ["pytest>=7", "a.b-c (==1.0)"]
"docs" = []
[project.dependencies]
'quoted-name' = "1.2"
plain[extra] = '^3'
[tool.other]
dependencies = ["no==1"]
'''
    assert sorted(read(spark, M.pyproject, text)) == [
        ("a.b-c", "==1.0", True), ("numpy", "*", False), ("pip", "*", False), ("plain", "^3", False), ("pytest", ">=7", True),
        ("quoted-name", "1.2", False), ("requests", ">=2.8.1,==2.8.*", False)]


def test_cargo_keys_and_tables(spark):
    text = '''[package]
version = "0.1.0"
[dependencies]
serde = "1.0"
"quoted" = '2'
tokio = { features = ["full"], version = "1.4" }
local = { path = "../x" }
dotted.version = "3.1"
[dependencies.own]
features = []
version = "4"
[dev-dependencies.test-kit]
version = '5'
[target.'cfg(unix)'.dependencies]
libc = "0.2"
[features]
default = "serde"
'''
    plain = [("dotted", "3.1", False), ("local", "", False), ("own", "4", False), ("quoted", "2", False), ("serde", "1.0", False),
             ("test-kit", "5", True), ("tokio", "1.4", False)]
    assert sorted(read(spark, M.cargo_toml, text)) == plain
    nested = sorted([("libc", "0.2", False), *(("local", "*", False) if e[0] == "local" else e for e in plain)])
    assert sorted(read(spark, M.cargo_toml, text, True)) == nested


def test_gemfile_calls(spark):
    text = '''source "https://rubygems.org"
gem 'rails', '~> 7.0', '>= 7.0.4'
gem("puma", ">= 5")
gem "local", path: "../local"
gem 'key', :require => 'x', version: "1.2"
gemspec
group :test do
  gem "it's", "2"
end
# gem "no", "1"
'''
    assert read(spark, M.gemfile, text) == [
        ("rails", "~> 7.0", False), ("puma", ">= 5", False), ("local", "", False), ("key", "1.2", False), ("it's", "2", True)]


@pytest.mark.parametrize(("text", "want"), [
    ("@s/a@1.0.0, x\nb@npm:c@2\n# d@1\n@e\nf@\nnpm:g@3 y\n", [("@s/a", "1.0.0", None), ("b", "npm:c@2", None), ("g", "3", None)]),
    ('{"packages":{"npm:@s/a@1":{"dev":true},"b@c@2":["x"],"d":{},"e@1":"text"}}', [("@s/a", "1", True), ("b@c", "2", False)]),
])
def test_bun_locks(spark, text, want):
    assert read(spark, M.bun_lock, text) == want


@pytest.mark.parametrize(("text", "name", "spec"), [
    ("requests[security]>=2,<3", "requests", ">=2,<3"), ("a (>= 1.0a1)", "a", ">=1.0a1"), ("b", "b", ""),
    ("c @ https://x.org/c.zip", "c", ""), ("D.e_f-g!=1 ; python_version>'3'", "D.e_f-g", "!=1"), ("-r other", "", "-rother"),
])
def test_requirements_of_distributions(spark, text, name, spec):
    row = spark.createDataFrame([(text,)], "t string").select(
        M.requirement_name(F.col("t")).alias("n"), M.requirement_specifier(F.col("t")).alias("s")).first()
    assert (row.n, row.s) == (name, spec)
