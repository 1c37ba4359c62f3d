"""Mixing and sharding against their laws."""

import re
import zlib

import pytest

from pkgaudit.llm import mixing as M
from pkgaudit.llm import sharding as S
from tests.llm.conftest import odd_rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        share = left / rest if rest else 0
        above = [s for s in names if s not in full and share * weight[s] > 2 * sizes[s]]
        if not above:
            target.update({s: share * weight[s] for s in names if s not in full})
            return sizes, target
        for s in above:
            full.add(s)
            target[s] = 2.0 * sizes[s]
            left -= target[s]


@pytest.mark.parametrize("block_words", [64, M.BLOCK_WORDS])
def test_mix_meets_targets(odd, block_words):
    documents, pieces = M.mix(odd, block_words=block_words)
    rows, parts = documents.collect(), pieces.collect()
    sizes, targets = brute_targets(odd_rows())
    taken = {}
    for r in rows:
        assert r["size"] >= 0 and 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], abs=1e-6)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in targets.items():
        assert taken[source] == int(target + 1e-6)
    slots = {}
    for p in parts:
        slots[p.slot] = slots.get(p.slot, 0) + p.words
    assert max(slots.values()) <= block_words
    again = {(r.row, r.taken) for r in M.mix(odd, block_words=block_words)[0].collect()}
    assert len(again) == len(rows)


def test_schedule_is_spread_evenly(odd):
    layout = M.lay_out(odd)
    slots = M.schedule(layout, 64).orderBy("slot").collect()
    hot = [s.place for s in slots]
    common = max(set(hot), key=hot.count)
    share, seen = hot.count(common) / len(hot), 0
    for i, place in enumerate(hot, start=1):
        seen += place == common
        assert abs(seen - share * i) < 12


def test_cuts_are_minimal():
    sizes = [5, 1, 9, 2, 7, 3, 3, 8]

    def best(rest, shards):
        if shards == 1 or not rest:
            return sum(rest)
        return min(max(sum(rest[:i]), best(rest[i:], shards - 1)) for i in range(1, len(rest) + 1))

    for shards in range(1, 9):
        cuts = [0, *S.minimax_cuts(sizes, shards), len(sizes)]
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) == best(sizes, shards)


def test_oversized_unit_is_alone():
    shards = S.assign_units([1, 1, 50, 1, 1, 1], 4)
    assert shards.count(shards[2]) == 1 and len(set(shards)) == 4


@pytest.mark.parametrize("units", [8, S.UNITS])
def test_shards(odd, units):
    rows = S.shard_by_bytes(odd.select("doc_id", "text"), 4, units).collect()
    assert len(rows) == len(odd_rows())
    expected = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == expected
    of_text = {}
    for r in rows:
        of_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert sum(len(s) > 1 for s in of_text.values()) <= 1  # null and empty texts may part
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_near_equal_without_hot_groups(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 2) as text")
    sums = [r[1] for r in S.shard_by_bytes(df, 40).groupBy("shard").sum("size").collect()]
    assert len(sums) == 40 and max(sums) < 1.02 * sum(sums) / 40


def test_empty_tables(nothing):
    documents, pieces = M.mix(nothing)
    assert documents.count() == 0 and pieces.count() == 0
    assert S.shard_by_bytes(nothing).count() == 0
