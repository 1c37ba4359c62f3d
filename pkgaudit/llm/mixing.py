"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid on a line of words, cut into blocks of equal
words. Golden-ratio points, mapped through the cumulative slot shares of the sources, say which
source each slot of the mix takes from; the slots of a source are ranked and the r-th takes the
source's block r, going round again when the line ends. Texts never move: only sizes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgaudit.llm.common import need, stored, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 4096
GOLDEN = 0.6180339887498949
CHUNK = 1 << 16
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, words -> source, source_size, place, target: the words the mix takes from each source.

    Sources in code point order, null last, weigh `weights`, repeating. `share` of all words is dealt
    by weight; a target stops at `most` times its source's words and the excess goes to the others by
    weight. With the sources ordered by most * size / weight, the level every open source gets per
    unit of weight is the greatest of the levels left by closing the sources before each.
    """
    catalogue = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = catalogue.withColumn("place", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1))
    limit = F.col("source_size") * F.lit(float(most))
    return (
        placed.withColumn("ratio", limit / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * share
                    - F.coalesce(F.sum(limit).over(by_ratio), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left") / F.col("open")).over(everything))
        .select("source", "source_size", "place",
                F.greatest(F.lit(0.0), F.least(limit, F.col("level") * F.col("weight"))).alias("target"))
    )


def lay_out(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every row's stretch of its source's line, without the text: row, size, start, source facts.

    The start is a prefix sum in two steps (over the 4,096 hash buckets of a source, then inside a
    bucket), so a source with a third of all rows is dealt over thousands of groups.
    """
    need(docs, "doc_id", "text", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = stored(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"),
        F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row")))
    targets = stored(source_targets(rows.select("source", "size"), weights, share, most))
    placed = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn(
        "bucket", F.substring("key", 1, 3))
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("place", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "text_hash", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    return stored(
        placed.join(firsts, ["place", "bucket"])
        .withColumn("start", F.col("first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select("row", "doc_id", "source", "text_hash", "size", "place", "start", "source_size", "target"))


def _golden(i: Column) -> Column:
    point = (i + 1) * F.lit(GOLDEN)
    return point - F.floor(point)


def schedule(layout: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix in order: slot, place, pass, block, slot_words.

    A source gets exactly the slots its target needs. Where the points give it more, the last ones
    are dropped; where they give it fewer (a few at most, as low-discrepancy points do), the missing
    slots stand at the end. The last slot of a source is cut so that its words meet the target.
    """
    spark = layout.sparkSession
    quota = F.floor(F.col("target") + 1e-6).cast("long")
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    passes = F.floor(F.col("quota") / F.col("source_size")).cast("long")
    wanted = stored(
        layout.groupBy("place").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        .filter("source_size > 0").withColumn("quota", quota).withColumn("blocks", blocks)
        .withColumn("slots", passes * F.col("blocks")
                    + F.ceil((F.col("quota") - passes * F.col("source_size")) / block_words).cast("long")))
    total = wanted.agg(F.sum("slots")).first()[0] or 0
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        wanted.withColumn("high", F.sum("slots").over(upto) / max(total, 1))
        .withColumn("low", F.col("high") - F.col("slots") / max(total, 1)).filter("slots > 0"))
    # Points meet the sources' intervals cell by cell: an equality join on the cell.
    cells = shares.select(
        "place", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))))
        .alias("cell"))
    points = spark.range(total).withColumn("u", _golden(F.col("id"))).withColumn(
        "cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(cells, "cell").filter("u >= low and u < high").select(
        F.col("id").alias("slot"), "place", F.floor(F.col("id") / CHUNK).alias("chunk"))
    dealt = stored(dealt)
    counts = dealt.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    in_chunk = Window.partitionBy("place", "chunk").orderBy("slot")
    ranked = dealt.join(firsts, ["place", "chunk"]).select(
        "slot", "place", (F.col("first") + F.row_number().over(in_chunk) - 1).alias("rank"))
    given = counts.groupBy("place").agg(F.sum("n").alias("given"))
    behind = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    missing = (
        shares.join(given, "place", "left").withColumn("given", F.coalesce("given", F.lit(0)))
        .filter("given < slots").withColumn("lack", F.col("slots") - F.col("given"))
        .withColumn("first", F.coalesce(F.sum("lack").over(behind), F.lit(0)) + total)
        .withColumn("rank", F.explode(F.sequence("given", F.col("slots") - 1)))
        .select((F.col("first") + F.col("rank") - F.col("given")).alias("slot"), "place", "rank"))
    return (
        ranked.unionByName(missing).join(wanted, "place").filter("rank < slots")
        .withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
        .withColumn("block", F.col("rank") - F.col("pass") * F.col("blocks"))
        .withColumn("slot_words", F.least(
            F.lit(block_words), F.col("source_size") - F.col("block") * block_words,
            F.col("quota") - F.col("pass") * F.col("source_size") - F.col("block") * block_words))
        .filter("slot_words > 0")
        .select("slot", "place", "pass", "block", "slot_words"))


def mix_pieces(layout: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot, pass, and the stretch of words [first_word, first_word + words) of a document row it takes."""
    ends = F.col("start") + F.col("size") - 1
    pieces = layout.filter("size > 0").select(
        "row", "doc_id", "place", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor(ends / block_words))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("slot_words"))
    return pieces.join(slots, ["place", "block"]).select(
        "slot", "pass", "place", "row", "doc_id", (low - F.col("start")).alias("first_word"),
        (high - low).alias("words")).filter("words > 0")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST,
        block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The documents' layout, one row each, with `taken`; and the pieces of the mix in slot order.

    A null text has no words and is never taken; a null source is a source of its own; repeated rows
    are rows of their own; an empty table gives empty results. Targets are met to the word (rounded
    down), so no document is taken more than `most` times: a source's passes stop at that.
    """
    layout = lay_out(docs, weights, share, most)
    pieces = mix_pieces(layout, schedule(layout, block_words), block_words)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return layout.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")), pieces


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of each."""
    documents, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return documents.select("doc_id", F.col("size").cast("long").alias("size"), "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": r"""
with sized as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as k, rowid as r,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from (select *, row_number() over () as rowid from documents) d),
catalogue as (
  select source, sum(size)::double as source_size,
         row_number() over (order by source is null, source) - 1 as place from sized group by source),
weighed as (select *, [3.0, 1.0, 2.0][place % 3 + 1]::double as weight from catalogue),
levels as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over w, 0))
            / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as here
  from weighed
  window w as (order by 2 * source_size / weight, place rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, greatest(0, least(2 * source_size, max(here) over () * weight)) as target from levels),
laid as (
  select s.doc_id, s.size, t.source_size, t.target, floor(t.target + 1e-6) as quota,
         coalesce(sum(s.size) over (partition by s.source order by k, s.doc_id, r
                                    rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size::bigint as source_size, target,
       case when source_size = 0 then 0 else
         floor(quota / source_size) * size
         + greatest(0, least(size, quota - floor(quota / source_size) * source_size - start)) end::bigint as taken
from laid
"""}
