"""The quality classifier's line features, neighbours and length weighting against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest

from pkgaudit.llm import quality_classifier as Q

PIECES = ["a", "Zz", "hello", "WORLD", "é", "É", "ß", "日本", "42", "!", "|", "#", "$%", ".", ", ", ";", " ", "  ", "\t", "\r", "\n", "\n", "\n\n",
          "again again", "same line\n", "x" * 50, "{", "=", "_", "?"]


def line_by_hand(line: bytes, seen: set) -> list[float]:
    lower = upper = digit = bang = bar = symbol = stop = 0
    kind = "blank"
    for at, byte in enumerate(line):
        c = chr(byte)
        if at and line[at - 1] == 0xC3:
            kind = "upper" if byte < 0x9F else "lower"
        elif byte < 128 and c.islower():
            kind = "lower"
        elif byte < 128 and c.isupper():
            kind = "upper"
        else:
            kind = ("digit" if c in "0123456789" else "blank" if c in " \t\x0b\f\r" else "bang" if c == "!" else "bar" if c == "|" else
                    "symbol" if c in "#*$%&<>{}[]\\^~=_" else "stop" if c in ".,;:?" else "other")
        lower, upper, digit = lower + (kind == "lower"), upper + (kind == "upper"), digit + (kind == "digit")
        bang, bar, symbol, stop = bang + (kind == "bang"), bar + (kind == "bar"), symbol + (kind == "symbol"), stop + (kind == "stop")
    words = line.split()
    doubles = sum(len(a) == len(b) and a[0] == b[0] and sum(a) == sum(b) for a, b in itertools.pairwise(words))
    length, size, letters = len(line), max(len(line), 1), max(lower + upper, 1)
    again = bool(line) and line in seen
    seen.add(line)
    return [
        math.log1p(length) / 5, length == 0, length < 30, upper / letters, upper > 0.5 * letters, digit / size * 5,
        math.sqrt(bang / size), math.sqrt(bar / size), math.sqrt(symbol / size), symbol > 0.03 * size, stop / size * 5,
        len(words) / size * 3, min(size / max(len(words), 1), 40) / 10, again, bool(line) and kind == "stop",
        doubles / max(len(words), 1), doubles > 0.3 * len(words)]


def texts_of(seed, n=30, longest=12):
    rng = random.Random(seed)
    return ["", "\n", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(longest))) for _ in range(n))]


def inputs_by_hand(text: str) -> tuple[np.ndarray, list[int]]:
    seen: set = set()
    lines = text.encode().split(b"\n")
    own = [line_by_hand(line, seen) for line in lines]
    none = [0.0] * Q.FEATURES
    rows = [[1.0, *own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)] for i in range(len(own))]
    return np.array(rows), [len(line) + 1 for line in lines]


@pytest.mark.parametrize("seed", range(5))
def test_features_and_neighbours(seed):
    texts = texts_of(seed)
    features, length, per_text = Q.line_features([t.encode() for t in texts])
    got = Q.with_neighbours(features, per_text)
    want, lengths = zip(*map(inputs_by_hand, texts), strict=True)
    assert per_text.tolist() == [len(w) for w in want]
    assert length.tolist() == [x for one in lengths for x in one]
    assert np.allclose(got, np.concatenate(want), atol=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_scores(seed):
    """All labellings of a text, weighed one by one; lines count by their length."""
    texts = [t for t in texts_of(seed, 40, 8) if t.count("\n") < 7]
    rng = np.random.default_rng(seed)
    weights, ties = rng.normal(size=(1 + 3 * Q.FEATURES, 2)), rng.normal(size=(2, 2))
    got = Q.score_texts([t.encode() for t in texts], weights, ties)
    for text, score in zip(texts, got, strict=True):
        inputs, lengths = inputs_by_hand(text)
        own, total, good = inputs @ weights, 0.0, np.zeros(len(lengths))
        for labels in itertools.product((0, 1), repeat=len(lengths)):
            weight = math.exp(sum(own[i, k] for i, k in enumerate(labels)) + sum(ties[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            good += weight * np.array(labels)
        assert score == pytest.approx(float(good / total @ lengths) / sum(lengths), abs=1e-5)
