"""Quality rules: cross-document line frequency, beside plain counts of a text.

One pass over the texts gives each row its counts and the hashes and sizes of its distinct normalised
lines; from there on only those move. A line is boilerplate of a host if more than `limit` different
texts of the host hold it (exact copies count once). Its occurrences are taken out, and a row that
keeps too little of its characters is rejected. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.llm.common import BLANKS, need, stored, table, word_list

LIMIT = 100
LEAST_KEPT = 0.3
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _length_of(text: Column, without: str) -> Column:
    return F.length(F.translate(text, without, "")).cast("long")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of five that a text holds twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. Where all are different the answer
    is 0; else (hash, place) pairs are sorted, those with an equal neighbour kept, and the stretches
    that their places cover added up, so the work is that of one sort however often windows repeat.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # A name for a value inside an expression: the one entry of an array.
    windows = F.transform(F.array(hashed), lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))),
        lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, window)])))

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        places = F.transform(F.array(pairs), lambda p: F.array_sort(F.transform(
            F.filter(p, lambda e, j: (F.get(p, j - 1)["x"] == e["x"]) | (F.get(p, j + 1)["x"] == e["x"])),
            lambda e: e["i"])))
        return F.get(F.transform(places, lambda at: F.aggregate(
            at, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(
                (i + window).alias("end"),
                (acc["n"] + (i + window) - F.greatest(i, acc["end"])).cast("long").alias("n")),
            lambda acc: acc["n"])), F.lit(0))

    return F.get(F.transform(windows, lambda found: F.when(
        F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(covered(found))), F.lit(0))


def normalised_line(line: Column) -> Column:
    """Lower case, blanks at the ends gone, digits as one: lines that differ in a date or a count are one line."""
    return F.translate(F.lower(F.trim(F.translate(line, BLANKS, " " * len(BLANKS)))), "123456789", "0" * 9)


def profile(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document without its text: counts, and its distinct lines as (hash, characters in all)."""
    need(docs, "doc_id", "text", host)
    rows = docs.select("doc_id", F.col(host).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lined = rows.withColumn("lines", F.filter(
        F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    hashed = F.transform("lines", lambda x: F.struct(
        F.xxhash64(normalised_line(x)).alias("h"), F.length(x).cast("long").alias("n")))
    counted = lined.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"),
        _length_of(F.col("text"), BLANKS).alias("word_chars"),
        (F.length("text") - _length_of(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.get(F.transform(F.array(word_list(F.col("text"))), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeated"))), F.lit(0)).alias("words"),
        hashed.alias("lines"),
    )
    return counted.select(
        "doc_id", "host", "text_hash", "row", "word_chars", "n_symbols", "n_dup_lines",
        F.col("words.n").alias("n_words"), F.col("words.repeated").alias("n_repeat_words"), "lines")


def frequent_lines(profiled: DataFrame, limit: int = LIMIT) -> DataFrame:
    """host, h, n_texts of the lines that more than `limit` different texts of a host hold."""
    first = profiled.groupBy("host", "text_hash").agg(F.min("row").alias("row")).select("row")
    lines = profiled.select("row", "host", F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("h")).join(
        first, "row", "left_semi").select("host", F.explode("h").alias("h"))
    return lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") > limit)


def judge(docs: DataFrame, host: str = "source", limit: int = LIMIT, least_kept: float = LEAST_KEPT) -> DataFrame:
    """Every row with its counts, base_failed, the characters boilerplate takes from it, and kept.

    A null text has no words and fails the base rules; a null host is a host of its own; repeated rows
    are rows of their own, their lines counted once; an empty table gives an empty result. Columns
    beyond doc_id, text and the host are not read.
    """
    profiled = stored(profile(docs, host))
    frequent = stored(frequent_lines(profiled, limit).select(F.col("host").alias("_host"), F.col("h").alias("_h")))
    taken = profiled.select("row", "host", F.explode("lines").alias("line")).select(
        "row", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    removed = (
        taken.join(frequent, taken["host"].eqNullSafe(frequent["_host"]) & (taken["h"] == frequent["_h"]))
        .groupBy("row").agg(F.sum("n").alias("removed_chars")))
    line_chars = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    depleted = (F.col("line_chars") - F.col("removed_chars")) < F.col("line_chars") * F.lit(least_kept)
    return (
        profiled.withColumn("line_chars", line_chars).drop("lines", "text_hash")
        .join(removed, "row", "left")
        .withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0).cast("long")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted))


def remove_lines(docs: DataFrame, host: str = "source", limit: int = LIMIT) -> DataFrame:
    """The documents with boilerplate lines taken out of their texts; other lines stay as they are.

    For each row the hashes of its frequent lines are found first, so what joins the texts is one
    short list for the rows that have any.
    """
    frequent = stored(frequent_lines(stored(profile(docs, host)), limit).select(
        F.col("host").alias("_host"), F.col("h").alias("_h")))
    marked = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    hashes = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(normalised_line(x))))
    hits = (
        marked.select("_row", F.col(host).alias("_of"), F.explode(hashes).alias("_line"))
        .join(frequent, F.col("_of").eqNullSafe(F.col("_host")) & (F.col("_line") == F.col("_h")))
        .groupBy("_row").agg(F.collect_set("_h").alias("_drop")))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_drop"), F.xxhash64(normalised_line(x))))
    return marked.join(hits, "_row", "left").withColumn(
        "text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the base counts and the verdict of the line rule; the source is the host."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_chars")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": r"""
with d as (select doc_id, source, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
grams as (select r, i, array_to_string(ws[i:i+4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from grams) where c > 1),
inside as (select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2, 3, 4]) as k) group by r),
l as (select r, source, md5(text) as t, unnest(string_split(text, chr(10))) as line from d),
lines as (select r, source, t, line,
    translate(lower(trim(translate(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '))), '123456789', '000000000') as norm
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select r, count(*) - count(distinct line) as n, sum(length(line)) as chars from lines group by r),
frequent as (select source, norm from lines group by source, norm having count(distinct t) > 100),
removed as (select a.r, sum(length(a.line)) as n from lines a join frequent f on a.source is not distinct from f.source and a.norm = f.norm group by a.r),
counts as (
  select d.doc_id, len(w.ws)::bigint as n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(u.n, 0)::bigint as n_dup_lines, coalesce(i.n, 0)::bigint as n_repeat_words,
    coalesce(u.chars, 0) as chars, coalesce(x.n, 0)::bigint as removed_chars
  from d join w using (r) left join dups u using (r) left join inside i using (r) left join removed x using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_chars,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (chars - removed_chars < 0.3 * chars) as kept
from counts
"""}
