"""Fill-in-middle against a regular expression and plain string work."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgaudit.llm import fim
from tests.llm.conftest import odd_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = "a b\t\n\v\f\r é日\U0001f600\x00\x1f!<>PSM\x85\xa0"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def _random_texts(count):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40))) for _ in range(count)]


def _check(rows):
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.restored == r.text


def test_random_texts(spark):
    df = spark.createDataFrame(list(enumerate(_random_texts(3000))), "doc_id long, text string")
    rows = fim.fill_in_middle(df).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    _check(rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_marks_and_half_marks(spark):
    texts = ["<P>", "a <S> b", "x<M>", "<", "<P", "a <S b <M c <P d", ">S> <<P <<S <<M", "<<S<S"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fim.fill_in_middle(df, moved=100).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.restored == r.text for r in rows)
    assert {r.text for r in rows if r.form == "plain"} == {"<P>", "a <S> b", "x<M>"}


def test_odd_rows(odd):
    rows = fim.fill_in_middle(odd).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(odd_rows()) and rows[0].row == "r" and rows[0].input_ids == "i"
    _check(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x", "y")], "doc_id long, text string, n int, output string, given string")
    row = fim.fill_in_middle(df, moved=100).first()
    assert row.n == 3 and row.given == "y" and fim.fill_in_middle(df).columns.count("output") == 1


@pytest.mark.parametrize("slab", [1, 50, 1 << 20])
def test_slabs(spark, monkeypatch, slab):
    import pyarrow as pa

    monkeypatch.setattr(fim, "SLAB_BYTES", slab)
    texts = _random_texts(200)
    keys = pa.array(np.arange(200) * 7919)
    got = fim._cut_batch(pa.array(texts)[:], keys, keys).to_pylist()
    sliced = fim._cut_batch(pa.array(["zz", *texts])[1:], keys, keys).to_pylist()
    assert got == sliced and [g["n"] for g in got] == [len(UNIT.findall(t)) for t in texts]


def test_empty_table(nothing):
    assert fim.fill_in_middle(nothing).count() == 0
