"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is what the line and the lines before and after it look like;
transitions tie neighbours together. Forward-backward gives each line's probability of being good,
and the mean over lines, weighted by their lengths, is the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgaudit.llm import crf
from pkgaudit.llm.common import let_go, need, ship, table

# The labelled rows a model is fitted on: so many at most, of at most so many lines each.
SAMPLE_DOCS = 3000
SAMPLE_LINES = 400
STEPS = 150
SLAB_BYTES = 2_000_000

OTHER, LOWER, UPPER, DIGIT, BLANK, BANG, BAR, SYMBOL, STOP = range(9)


def _class_table() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                        (b"0123456789", DIGIT), (b" \t\n\x0b\f\r", BLANK), (b"!", BANG), (b"|", BAR),
                        (b"#*$%&<>{}[]\\^~=_", SYMBOL), (b".,;:?", STOP)):
        kinds[list(chars)] = kind
    return kinds


_KINDS = _class_table()
FEATURES = 17


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, the lines' lengths, and how many lines each text has (one at least)."""
    data = b"\n".join(texts)
    buf = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.concatenate([breaks, [len(buf)]])
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    kinds = _KINDS[buf]
    if len(buf) > 1:
        # Latin capitals and small letters with marks: two bytes, told apart by the second.
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1
        kinds[second] = np.where(buf[second] < 0x9F, UPPER, LOWER)

    def per_line(mask: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=upto[1:], dtype=np.int32)
        return (upto[ends] - upto[starts]).astype(np.float64)

    blank = kinds == BLANK
    lower, upper, digit, bang, bar, symbol, stop = (per_line(kinds == k) for k in (
        LOWER, UPPER, DIGIT, BANG, BAR, SYMBOL, STOP))
    begins = ~blank
    begins[1:] &= blank[:-1]
    words = per_line(begins)
    # A word like the one before it: same length, first byte and sum of bytes, in the same line.
    doubled = np.zeros(len(buf), bool)
    at_word = np.flatnonzero(begins)
    if len(at_word) > 1:
        stops = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
        upto = np.concatenate([[0], np.cumsum(buf, dtype=np.int64)])
        sums, sizes = upto[stops] - upto[at_word], stops - at_word
        like = (sums[1:] == sums[:-1]) & (sizes[1:] == sizes[:-1]) & (buf[at_word[1:]] == buf[at_word[:-1]])
        like &= np.searchsorted(breaks, at_word[1:]) == np.searchsorted(breaks, at_word[:-1])
        doubled[at_word[1:][like]] = True
    doubles = per_line(doubled)
    length = (ends - starts).astype(np.float64)
    size = np.maximum(length, 1)
    letters = np.maximum(lower + upper, 1)
    again = np.zeros(len(starts))
    lines, at = data.split(b"\n"), 0
    for n in per_text.tolist():
        if n > 1:
            seen: set[bytes] = set()
            for i in range(at, at + n):
                line = lines[i]
                if line in seen:
                    again[i] = bool(line)
                else:
                    seen.add(line)
        at += n
    last = np.where(length > 0, kinds[np.maximum(ends - 1, 0)] if len(buf) else 0, BLANK)
    features = np.stack([
        np.log1p(length) / 5, length == 0, length < 30, upper / letters, upper > 0.5 * letters, digit / size * 5,
        np.sqrt(bang / size), np.sqrt(bar / size), np.sqrt(symbol / size), symbol > 0.03 * size, stop / size * 5,
        words / size * 3, np.minimum(size / np.maximum(words, 1), 40) / 10, again, last == STOP,
        doubles / np.maximum(words, 1), doubles > 0.3 * words], axis=1)
    return features.astype(np.float32), length + 1, per_text


def with_neighbours(features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A constant, the line's features, those of the line before and of the line after (zeros at the ends)."""
    firsts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    lasts = firsts + per_text - 1
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[firsts] = 0
    after[lasts] = 0
    return np.concatenate([np.ones((len(features), 1), np.float32), features, before, after], axis=1)


def fit(features: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights and ties, where a document's label is that of its lines."""
    inputs = with_neighbours(features, per_text).astype(np.float64)
    return crf.fit(inputs, per_text, np.repeat(labels, per_text), 2, steps)


def score_texts(texts: list[bytes], weights: np.ndarray, ties: np.ndarray) -> np.ndarray:
    features, length, per_text = line_features(texts)
    good = crf.forward_backward(with_neighbours(features, per_text) @ weights, per_text, ties)[0][:, 1]
    firsts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    return np.add.reduceat(good * length, firsts) / np.add.reduceat(length, firsts)


def slabs(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in lists of a bounded number of bytes; a longer text is a list by itself."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLAB_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_lines: int) -> list:
    """(features, number of lines, label) of the labelled rows to fit on: those of least hash, a bounded number."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for doc_id, text, quality in zip(*(part.column(c) for c in ("doc_id", "text", "quality")), strict=True):
                    features, _, per_text = line_features([(text.as_py() or "").encode()])
                    rows.append((doc_id.as_py(), int(per_text[0]), quality.as_py(), features.tobytes()))
                doc_id, n, quality, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), pa.array(n, pa.int32()), pa.array(quality, pa.int32()),
                     pa.array(packed, pa.binary())], ["doc_id", "n", "quality", "features"])

    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .filter(lines <= sample_lines)
        .join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id")
        .mapInArrow(run, "doc_id long, n int, quality int, features binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample_docs).collect())


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
          sample_lines: int = SAMPLE_LINES) -> tuple[np.ndarray, np.ndarray]:
    """The model, from at most `sample_docs` labelled rows that are not held out and have at most `sample_lines` lines.

    Both bounds are parameters; with no labelled row the model knows nothing and scores 0.5.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    ship(docs.sparkSession)
    rows = _sample(docs, labels, sample_docs, sample_lines)
    if not rows:
        return np.zeros((1 + 3 * FEATURES, 2)), np.zeros((2, 2))
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in rows])
    return fit(features, np.array([r.n for r in rows]), np.array([int(r.quality > 0) for r in rows]))


def score_documents(docs: DataFrame, weights: np.ndarray, ties: np.ndarray) -> DataFrame:
    """All columns of `docs`, and score: 0 to 1, higher for better texts.

    Only the text counts. A null text is an empty one: one empty line, scored like any other; repeated
    rows get equal scores; an empty table gives an empty result. A given column `score` is replaced.
    """
    need(docs, "text")
    ship(docs.sparkSession)
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [(t.as_py() or "").encode() for t in part.column(place)]
                scores = np.concatenate([score_texts(s, weights, ties) for s in slabs(texts)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their score; the model is fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, *train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
