"""Packing: ids against the tokenizer itself, places against the rules, numbers of sequences against bounds."""

import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pkgaudit.llm import packing as P
from tests.llm.conftest import odd_rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def _check(tokenizer, given, rows, capacity):
    want = []
    for doc_id, text in given:
        ids = ids_of(tokenizer, text)
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want.append((str(doc_id), n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), math.ceil(sum(r.length for r in rows) / capacity)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_odd_rows(odd, tokenizer, capacity):
    rows = P.pack_documents(odd, capacity=capacity).collect()
    used, least = _check(tokenizer, [(i, t) for i, t, _ in odd_rows()], rows, capacity)
    assert used <= 1.1 * least + 1


def test_query(spark, sf_dir, tokenizer):
    from pkgaudit.llm.registry import QUERIES
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = _check(tokenizer, given, QUERIES["op12_packing"](spark, sf_dir).collect(), 4096)
    assert used <= 1.01 * least + 1


ODD_WORDS = ["Don't", "it's!", "'s", "''ll", "a.b,c", "<|endoftext|>", "x<|endoftext|>.", "<|ENDOFTEXT|>", "Été.", "İx",
             "ΣΑΣ", "İ.", "a\x1cb", "a\x85b", " ", " z", "...", "a...!?", "$#*", "1,234.5", "\U0001f600!", "\x00", "ﬁ.",
             "가", "KK.", "end.'", "'", "́", "a.́", "Z" * 70 + "."]


@pytest.mark.parametrize("seed", range(8))
def test_ids_word_by_word(tokenizer, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(P, "KNOWN_WORDS", (5, 100_000)[seed % 2])
    monkeypatch.setattr(P, "SEGMENT_BYTES", (7, 1 << 20)[seed // 2 % 2])
    coder = P.WordIds(P.tokenizer_path())
    for _ in range(20):
        texts = ["".join(rng.choice(ODD_WORDS) + rng.choice((" ", "\t", "\n", "\v", "\f", "\r", "  ", "", ". ")) for _ in range(rng.randrange(12)))
                 for _ in range(10)]
        got = [np.frombuffer(b, "<u4").tolist() for b in coder.encode([t.encode() for t in texts])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def _pack(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    runs, total = P.plan(counts, capacity)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    order = np.argsort(lengths, kind="stable")
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
    used = np.bincount(P.lay(lengths, ranks, runs), weights=lengths, minlength=total)
    assert len(used) == total and (total == 0 or (used.max() <= capacity and used.min() > 0))
    return total


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 100, 4096]))
    low, high = sorted(rng.integers(1, capacity + 1, 2))
    lengths = rng.integers(low, high + 1, int(rng.choice([1, 10, 1000, 20_000])))
    lengths = np.concatenate([lengths, np.full(int(rng.choice([0, 7000])), int(rng.integers(1, capacity + 1)))])
    total = _pack(lengths, capacity)
    # Two pieces above half never share; first fit by falling length is within 11/9 of the best packing.
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True)[:3000] if len(lengths) <= 1000 else []:
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(capacity)
            at = -1
        rooms[at] -= n
    least = max(math.ceil(lengths.sum() / capacity), int((2 * lengths > capacity).sum()))
    assert least <= total <= (len(rooms) * 1.05 + 1 if rooms else least * 1.3 + 1)


def test_program_beats_greedy_filling():
    # Falling best fit puts 44 + 44, 30 + 30 + 30 and 26 + 26 + 26 together: 350 sequences.
    lengths = np.array([44] * 300 + [30] * 300 + [26] * 300)
    assert _pack(lengths, 100) == 300


def test_empty_and_clashing(nothing, spark):
    assert P.pack_documents(nothing).count() == 0
    df = spark.createDataFrame([(1, "a b", 3, "q")], "doc_id long, text string, length int, task string")
    assert P.pack_documents(df).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_sequences(odd, tokenizer):
    whole = P.sequences(P.pack_documents(odd, keep_ids=True)).collect()
    got = sorted(n for r in whole for n in np.frombuffer(bytes(r.input_ids), "<u4").tolist())
    assert got == sorted(n for _, t, _ in odd_rows() for n in ids_of(tokenizer, t))
    assert all(sum(r.lengths) * 4 == len(r.input_ids) for r in whole)


def test_words_in_lines_have_the_ids_of_words_alone(monkeypatch):
    """Words of letters are encoded by the line: few calls' worth of texts, and each word's own ids."""
    coder = P.WordIds(P.tokenizer_path())
    words = [f"{a}{b}{c}".encode() for a in ("the", "Ünd", "ción", "x") for b in "abcdefghijklmnopé" for c in ("", "ß", "re", "ª", "İ", "é", "日本", "s", "'s", "1")]
    words.append(b"a" * 70)
    sizes = []
    real = coder.coder

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return real.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    coder.coder = Counting()
    made = coder._learn(set(words))
    alone = {w: np.array(real.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words}
    assert made == alone and sum(sizes) < len(set(words)) * 0.7
    # A line that does not come apart as expected is encoded word by word.
    coder.closing[:] = False
    assert coder._learn({b"abc", b"abd"}) == {w: np.array(real.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in (b"abc", b"abd")}
