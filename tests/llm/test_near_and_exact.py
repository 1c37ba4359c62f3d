"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import pytest

from pkgaudit.llm import exact_dedup as E
from pkgaudit.llm import near_dedup as N
from tests.llm.conftest import odd_rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    for cut in (0, 1, 4096, 5000, 19_999):
        assert E.combine(E.fingerprint(data[:cut]), E.fingerprint(data[cut:])) == E.fingerprint(data)


@pytest.mark.parametrize("part_chars", [E.PART_CHARS, 1000])
def test_exact_groups(odd, part_chars):
    rows = E.dedup_exact(odd, part_chars).collect()
    assert len(rows) == len(odd_rows())
    groups = {}
    for i, t, _ in odd_rows():
        groups.setdefault(hashlib.sha256(normal(t).encode()).hexdigest(), []).append(i)
    kept = {}
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


@pytest.mark.parametrize(("chunk_bytes", "salt_rows"), [(1 << 20, 2048), (7, 2)])
def test_equal_fingerprints_of_different_texts_are_told_apart(spark, odd, monkeypatch, chunk_bytes, salt_rows):
    """With one fingerprint for all texts of a length, only the comparison can tell them apart."""
    from pkgaudit.llm import common

    common.ship(spark)
    marks = E.fingerprints(odd).withColumn("fp_a", E.F.lit(1).cast("long")).withColumn("fp_b", E.F.lit(1).cast("long"))
    monkeypatch.setattr(E, "fingerprints", lambda docs, part_chars: marks)
    monkeypatch.setattr(E, "collisions", lambda docs, given, real=E.collisions: real(docs, given, salt_rows, chunk_bytes))
    digests = {}
    for i, t, _ in odd_rows():
        digests.setdefault(hashlib.sha256(normal(t).encode()).hexdigest(), []).append(i)
    rows = E.dedup_exact(odd).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        ids = digests[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)


def test_many_copies_without_an_id(spark):
    """Each is compared once, not with all others."""
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'one  text' as text").unionByName(
        spark.range(3).selectExpr("id as doc_id", "'one text' as text"))
    rows = E.dedup_exact(docs)
    assert rows.filter("kept").count() == 1 and rows.first().group_size == 20_003 and rows.first().keep_id == 0
    marks = E.stored(E.fingerprints(docs))
    assert E.collisions(docs, marks, 256).count() == 0


def brute_components(rows, size=N.SIZE):
    sets = [N.shingle_set(N.words_of(t), size) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return sorted(out, key=repr)


def test_near_classes(odd):
    got = N.near_classes(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(odd_rows())


def chained_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        if i % 30 == 0:
            words = [f"w{rng.randrange(900)}" for _ in range(60)]
        words[rng.randrange(60)] = f"w{rng.randrange(900)}"
        rows.append((i, " ".join(words), "s"))
    return rows


@pytest.mark.parametrize("rounds", [1, 2])
def test_groups_in_small_blocks(spark, monkeypatch, rounds):
    """Groups are compared in blocks; chains of links are followed; links beyond the chosen members are found."""
    monkeypatch.setattr(N, "ROUNDS", rounds)
    monkeypatch.setattr(N, "MAP_ROWS", 3)
    monkeypatch.setattr(N, "SET_ROWS", 2)
    monkeypatch.setattr(N, "COLUMNS", 7)
    rows = chained_rows()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = N.near_classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_many_texts_share_a_passage_and_edits(spark):
    """Copies of long texts with many edits, around the threshold, all with one passage in common."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for k in range(6):
        base = [f"b{rng.randrange(4000)}" for _ in range(300)] + passage
        for _ in range(25):
            words = [f"e{rng.randrange(10**6)}" if rng.random() < rng.choice((0.01, 0.03, 0.05)) else w for w in base]
            rows.append((len(rows), " ".join(words), "s"))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    for size in (2, 5):
        got = N.near_classes(df, size).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == brute_components(rows, size)


def test_intersections(monkeypatch):
    import numpy as np

    monkeypatch.setattr(N, "COLUMNS", 4)
    rng = np.random.default_rng(2)
    sides = [[np.unique(rng.integers(0, 40, int(rng.integers(0, 30)))) for _ in range(m)] for m in (7, 9)]
    want = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    assert N.intersections(*sides).tolist() == want
    assert N.intersections([], sides[1]).shape == (0, 9)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, N.components(links).select("row", "comp").collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_empty_tables(nothing):
    assert E.dedup_exact(nothing).count() == 0
    assert N.near_classes(nothing).count() == 0
