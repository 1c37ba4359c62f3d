"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is the value of its bytes as a polynomial at a fixed point, modulo two primes,
plus its length. Fingerprints of consecutive chunks combine by shifting the second by the length of
the first, so chunks are hashed independently: texts beyond `part_chars` are cut into rows that any
task may hash, and combined by a sum. Texts with equal fingerprints are compared with the first of
their group, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.llm.common import BLANK, BLANKS, may_be_in, need, ship, stored, table

CHUNK = 4096
# Primes below 2^43: a byte times a power, summed over a chunk, stays within 64 bits.
PRIMES = (8796093022151, 8796093022141)
BASES = (6364136223847, 2862933555781)
PART_CHARS = 16_000_000
# A chunk of a text that is compared at once, in bytes.
CHUNK_BYTES = 1 << 20
FP = ["fp_a", "fp_b", "length"]
SALT_ROWS = 2048

_TO_SPACE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def _powers(base: int, prime: int) -> np.ndarray:
    out, value = np.empty(CHUNK, np.uint64), 1
    for i in range(CHUNK):
        out[i] = value
        value = value * base % prime
    return out


_POWERS: list[np.ndarray] = []


def normalise(data: bytes) -> bytes:
    """Every run of blanks becomes one space."""
    data = data.translate(_TO_SPACE)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def combine(first: tuple[int, int, int], second: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of two texts put together: the second is shifted by the length of the first."""
    length = first[2]
    a, b = ((f + s * pow(base, length, prime)) % prime
            for f, s, base, prime in zip(first, second, BASES, PRIMES, strict=False))
    return a, b, length + second[2]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """Both polynomial values and the length; the chunks' values are combined in order."""
    if not _POWERS:
        _POWERS.extend(_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))
    whole = (0, 0, 0)
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), CHUNK):
        piece = view[at:at + CHUNK].astype(np.uint64)
        a, b = (int(piece @ powers[:len(piece)]) % p for powers, p in zip(_POWERS, PRIMES, strict=True))
        whole = combine(whole, (a, b, len(piece))) if at else (a, b, len(piece))
    return whole


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            data = normalise((text.as_py() or "").encode())
            rows.append((*fingerprint(data), hashlib.sha256(data).hexdigest()))
        yield _with_columns(batch, rows, keep_text=False)


def _with_columns(batch: pa.RecordBatch, rows: list, keep_text: bool) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if keep_text or n != "text"]
    a, b, n, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in names]
        + [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
        [*names, "fp_a", "fp_b", "length", "text_sha256"])


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts carry the character before them: a run of blanks that it ends belongs to the part before."""
    for batch in batches:
        rows = []
        for text, no in zip(batch.column("text"), batch.column("part"), strict=True):
            piece = text.as_py()
            if no.as_py():
                piece = piece[1:].lstrip(BLANKS) if piece[0] in BLANKS else piece[1:]
            rows.append((*fingerprint(normalise(piece.encode())), ""))
        yield _with_columns(batch, rows, keep_text=False).drop_columns(["text_sha256"])


def fingerprints(docs: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, row, text_hash, fp_a, fp_b, length, text_sha256 of every row's normalised text."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.monotonically_increasing_id() * 2).alias("row"),
        F.xxhash64("text").alias("text_hash"), text.alias("text"))
    marks = "doc_id long, row long, text_hash long"
    fps = "fp_a long, fp_b long, length long"
    whole = rows.filter(F.length("text") <= part_chars).mapInArrow(_hash_texts, f"{marks}, {fps}, text_sha256 string")
    parts = (
        rows.filter(F.length("text") > part_chars)
        .withColumn("text_sha256", F.sha2(F.regexp_replace("text", BLANK, " "), 256))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / part_chars).cast("int"))))
        .select("doc_id", (F.col("row") + 1).alias("row"), "text_hash", "text_sha256", "part",
                F.expr(f"substring(text, if(part = 0, 1, part * {part_chars}), "
                       f"{part_chars} + if(part = 0, 0, 1))").alias("text"))
        .repartition("row", "part")
        .select("doc_id", "row", "text_hash", F.col("text_sha256").alias("sha"), "part", "text")
        .mapInArrow(_hash_parts, f"{marks}, sha string, part int, {fps}"))
    # A huge text has few parts: their values, in order, become one.
    joined = F.udf(_combine_all, "struct<fp_a: long, fp_b: long, length: long>")
    huge = (
        parts.groupBy("doc_id", "row", "text_hash", F.col("sha").alias("text_sha256"))
        .agg(F.array_sort(F.collect_list(F.struct("part", "fp_a", "fp_b", "length"))).alias("parts"))
        .select("doc_id", "row", "text_hash", joined("parts").alias("fp"), "text_sha256")
        .select("doc_id", "row", "text_hash", "fp.*", "text_sha256"))
    return whole.unionByName(huge)


def _combine_all(parts: list) -> tuple[int, int, int]:
    whole = (0, 0, 0)
    for part in parts:
        whole = combine(whole, (part["fp_a"], part["fp_b"], part["length"]))
    return whole


def _chunker(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The normalised texts in chunks, each a row of its own: an empty text has one."""
        for batch in batches:
            for at in range(batch.num_rows):
                data = normalise((batch.column("text")[at].as_py() or "").encode())
                pieces = [data[i:i + chunk_bytes] for i in range(0, len(data), chunk_bytes)] or [b""]
                same = batch.slice(at, 1).take(pa.array([0] * len(pieces)))
                yield pa.RecordBatch.from_arrays(
                    [*(same.column(c) for c in (*FP, "salt", "rest", "row")), pa.array(range(len(pieces)), pa.int32()),
                     pa.array(pieces, pa.binary())], [*FP, "salt", "rest", "row", "chunk", "data"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come place by place, that of the group's first text in front: only that one is held."""
    key, first = None, b""
    for batch in batches:
        odd = []
        for *place, rest, row, data in zip(*(batch.column(c) for c in (*FP, "salt", "chunk", "rest", "row", "data")), strict=True):
            place, data = tuple(p.as_py() for p in place), data.as_py()
            if place != key:
                # Lengths are equal, so every chunk has its like in the first text.
                key, first = place, data
            elif first != data:
                odd.append(row.as_py())
        if odd:
            yield pa.RecordBatch.from_arrays([pa.array(odd, pa.int64())], ["row"])


def collisions(docs: DataFrame, marks: DataFrame, salt_rows: int = SALT_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Fingerprints shared by different texts, with the digest of each text unlike its group's first.

    Only texts whose fingerprint another row has are read again. They are compared chunk by chunk with the first
    of their group, chunks of one text apart from each other; a group is dealt over as many salted parts
    as it has `salt_rows`, and the chunks of its first text go to each.
    """
    groups = (
        marks.groupBy(*FP).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")).filter("n > 1")
        .withColumn("salts", F.ceil(F.col("n") / salt_rows).cast("int")))
    # Rows that repeat id and text are one here, and each still comes with its own text.
    wanted = marks.join(groups, FP).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *FP, "salts").agg(
        F.min("row").alias("row"), F.max(F.col("row") == F.col("first_row")).alias("first"))
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    found = may_be_in(source, wanted, "_id", "_hash").alias("s").join(
        wanted.alias("w"), F.col("s._id").eqNullSafe(F.col("w._id")) & (F.col("s._hash") == F.col("w._hash")))
    columns = [*FP, "salt", "rest", "row", "text"]
    others = found.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")).cast("int")).withColumn(
        "rest", F.lit(1)).select(*columns)
    firsts = found.filter("first").dropDuplicates(FP).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("rest", F.lit(0)).select(*columns)
    fps = ", ".join(f"{c} long" for c in FP)
    odd = (
        firsts.unionByName(others).mapInArrow(_chunker(chunk_bytes), f"{fps}, salt int, rest int, row long, chunk int, data binary")
        .repartition(*FP, "salt", "chunk").sortWithinPartitions(*FP, "salt", "chunk", "rest")
        .mapInArrow(_compare, "row long").distinct())
    return marks.join(odd, "row", "left_semi").select(*FP, "text_sha256").distinct()


def dedup_exact(docs: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, row, text_hash, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal if they are the same once each run of blanks is one space; null counts as empty,
    and all empty texts are equal. The least doc_id stays; null ids come last. Of rows that repeat
    both id and text one stays. An empty table gives an empty result; other columns are not read.
    """
    need(docs, "doc_id", "text")
    marks = stored(fingerprints(docs, part_chars))
    odd = stored(collisions(docs, marks))
    keys = ["fp_a", "fp_b", "length", "own"]
    keyed = marks.join(odd.withColumn("_odd", F.lit(True)), ["fp_a", "fp_b", "length", "text_sha256"], "left").withColumn(
        "own", F.when(F.col("_odd"), F.col("text_sha256")).otherwise("")).drop("_odd")
    groups = keyed.groupBy(*keys).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.min_by("row", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("keep_row"))
    return keyed.join(groups, keys).select(
        "doc_id", "row", "text_hash", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of their group."""
    return dedup_exact(table(spark, sf_dir, "documents")).drop("row", "text_hash")


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from n window g as (partition by text_sha256)
"""}
