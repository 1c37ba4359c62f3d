"""The pipeline's stage of near copies against brute force of its own."""

import random

import pytest

import corpus_pipeline as C
from pkgaudit.llm import near_dedup as N


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def groups(texts, size):
    """For each text, the least place of those linked with it."""
    sets, label = [shingles(t, size) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def changed_texts():
    """Texts of 100 words with none to six words changed: at two words most are linked, at five words few."""
    rng, texts = random.Random(11), []
    for k in range(12):
        base = [f"v{k}x{i}" for i in range(100)]
        texts.append(" ".join(base))
        for n in range(1, 7):
            words = list(base)
            for i in range(n):
                words[5 + 15 * i] = f"new{k}y{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    return texts


def test_stage_takes_five_words(spark):
    texts = changed_texts()
    assert groups(texts, 5) != groups(texts, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, label in enumerate(groups(texts, 5)) if i == label}
    assert {r.doc_id for r in C.drop_near_copies(spark, docs, "").collect()} == want


@pytest.mark.parametrize("size", [2, 5])
def test_classes_of_both_sizes(spark, size):
    texts = changed_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_classes(docs, size).collect()}
    assert got == dict(enumerate(groups(texts, size)))


def test_stage_with_null_and_repeated_ids(spark):
    rows = [
        (None, "first text without an id"), (None, "second text of no id either"), (None, "third one"), (None, None), (None, " "),
        (6, "two words"), (6, "other words"), (7, "a text that two ids share here"), (3, "a text that two ids share here"),
        (None, "a text that two ids share here"), (8, None), (9, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.drop_near_copies(spark, docs, "").collect()
    want = [r for r in rows if r[1] != "a text that two ids share here" or r[0] == 3]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
