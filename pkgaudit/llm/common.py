"""Helpers of the training-data operators: tables, stored intermediates, words, shipping."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's setting; only a local session gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back.

    A lost executor replays nothing in front of it, the values of nondeterministic columns are
    fixed, and later joins know the table's real size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, release_memory: Callable[[], None]) -> None:
    """Called in a worker by an operator that keeps what it learns from task to task.

    Workers serve one operator after another: what another one keeps is let go, so that a worker holds the
    tables of one operator at a time.
    """
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        give_back()
    _HELD[owner] = release_memory


def give_back() -> None:
    """Return freed memory to the system: workers live on, and allocators keep what they once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def let_go() -> None:
    """Called in a worker by an operator that keeps nothing."""
    claim("", lambda: None)


@contextmanager
def collector_off() -> Iterator[None]:
    """No search for garbage while a task builds tables of many small objects."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; the same as --py-files at submit time."""
    context = spark.sparkContext
    if getattr(context, "_pkgaudit_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "pkgaudit_llm.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder in ("pkgaudit", os.path.join("pkgaudit", "llm")):
            for name in sorted(os.listdir(os.path.join(root, folder))):
                if name.endswith(".py"):
                    archive.write(os.path.join(root, folder, name), os.path.join(folder, name))
    context.addPyFile(path)
    context._pkgaudit_shipped = True


def word_list(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has: starts of words after padding with one blank, no array of words."""
    blanked = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), BLANKS, " " * len(BLANKS))
    squeezed = F.regexp_replace(blanked, " +", " ")
    ended = F.length(F.translate(squeezed, " ", "")).cast("long")
    return F.length(squeezed).cast("long") - ended - F.when(F.endswith(squeezed, F.lit(" ")), 1).otherwise(0)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """One value for a row's id and text."""
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash.cast("string"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose id and text `kept` (doc_id, text_hash) names, one row for each."""
    keys = kept.select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key")).distinct()
    # The row as one value: its columns may have any names.
    rows = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def may_be_in(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows that may have a partner in `keys` by these columns: of the others, few are left to deal out.

    A table of 2^24 bits, one set for each key, goes to all tasks: 2^18 words at most, whatever the number of keys.
    """
    hashed = F.xxhash64(*columns)
    word = F.pmod(F.shiftright(hashed, 6), F.lit(1 << 18))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return (rows.join(F.broadcast(words), word == F.col("_word"))
            .filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits"))
