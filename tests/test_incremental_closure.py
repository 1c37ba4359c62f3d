"""Closures kept up to date against closures made anew."""

import random

import pytest
from pyspark.sql import functions as F

from pkgaudit.operators import graph

EDGES = "ecosystem string, name string, version_spec string, child_name string, child_spec string"


def frames(spark, edges):
    return spark.createDataFrame([("npm", a, "*", b, "*") for a, b in edges], EDGES)


def roots(spark, names):
    return spark.createDataFrame([("npm", n, "*") for n in names], "ecosystem string, name string, version_spec string")


def rows(df):
    return {(r.root_name, r.name): (r.depth, tuple(r.path)) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_added_edges(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(24)})
    old, new = edges[:16], edges[14:]
    asked = roots(spark, nodes[:5])
    closure = graph.requirement_closure(asked, frames(spark, old))
    changes = graph.closure_changes(closure, frames(spark, old), frames(spark, new))
    whole = graph.requirement_closure(asked, frames(spark, edges))
    before, after, changed = rows(closure), rows(whole), rows(changes)
    assert rows(graph.with_changes(closure, changes)) == after
    assert changed == {k: v for k, v in after.items() if before.get(k) != v}


def test_nothing_added_and_nothing_new(spark):
    closure = graph.requirement_closure(roots(spark, ["a"]), frames(spark, [("a", "b"), ("b", "a")]))
    none = frames(spark, [("x", "y")]).limit(0)
    assert graph.closure_changes(closure, frames(spark, [("a", "b"), ("b", "a")]), none).count() == 0
    assert graph.closure_changes(closure, frames(spark, [("a", "b"), ("b", "a")]), frames(spark, [("b", "a"), ("z", "a")])).count() == 0


def test_work_follows_the_change(spark, monkeypatch):
    """Of a long chain, only the end changes: what is followed are the new rows, not the chain."""
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)]
    closure = graph.requirement_closure(roots(spark, ["c00"]), frames(spark, chain))
    sizes = []
    real = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: sizes.append((cut := real(df)).count()) or cut)
    changes = graph.closure_changes(closure, frames(spark, chain), frames(spark, [("c12", "d"), ("d", "e")]))
    assert {r.name for r in changes.collect()} == {"d", "e"} and max(sizes) <= 2
    assert changes.filter(F.col("depth") == 14).first().path[-2:] == ["d", "e"]


def test_changes_are_written_once(spark, monkeypatch):
    """A chain that is added to one edge: each new row is written in its own round and not again in later ones."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(6)]
    closure = graph.requirement_closure(roots(spark, ["a"]), frames(spark, [("x", "y")]))
    sizes = []
    real = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: sizes.append((cut := real(df)).count()) or cut)
    changes = graph.closure_changes(closure, frames(spark, chain), frames(spark, [("a", "c0")]))
    assert len(rows(changes)) == 7 and changes.count() == 7 and sum(sizes) == 8
