"""Sharding by minimax contiguous partition.

Rows are laid on a line of ordered atomic units and the line is cut where a greedy filling with the
smallest feasible shard capacity cuts it. A unit holds whole groups of equal texts: texts are put in
order by their hash, the leading bits of the hash name the unit, and a group with more than a unit's
fair part is a unit of its own. The number of units is bounded by a parameter, so the driver's search
is the same work for any number of rows; all that touches rows is Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgaudit.llm.common import need, stored, table

UNITS = 1 << 16


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Where filling shards one after the other with at most `capacity` begins a new one."""
    cuts, filled = [], 0
    for i, size in enumerate(sizes):
        if i and filled + size > capacity:
            cuts.append(i)
            filled = 0
        filled += size
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """The cuts of the contiguous partition into at most `shards` parts whose largest part is least."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return greedy_cuts(sizes, low)


def assign_units(sizes: list[int], shards: int) -> list[int]:
    """The shard of every unit, in order.

    A unit above the fair part of what is left fills a shard by itself: no partition can do better
    for it, and the others are then cut evenly over the shards that remain.
    """
    alone: set[int] = set()
    while len(alone) < shards - 1:
        rest = sum(s for i, s in enumerate(sizes) if i not in alone)
        above = [i for i, s in enumerate(sizes) if i not in alone and s * (shards - len(alone)) > rest]
        if not above or len(sizes) - len(alone) <= 1:
            break
        alone.add(max(above, key=lambda i: (sizes[i], -i)))
    shared = [i for i in range(len(sizes)) if i not in alone]
    cuts = set(minimax_cuts([sizes[i] for i in shared], shards - len(alone)))
    shard_of, shard = {}, 0
    for place, i in enumerate(shared):
        shard += place in cuts
        shard_of[i] = shard
    for shard, i in enumerate(sorted(alone), start=shards - len(alone)):
        shard_of[i] = shard
    return [shard_of[i] for i in range(len(sizes))]


def shard_by_bytes(docs: DataFrame, shards: int = 40, units: int = UNITS) -> DataFrame:
    """Every row with its shard and its gapless place in it; equal texts share a shard.

    Returns all columns of `docs` but the text, and size, text_crc32, law, shard, slot, grown_shard
    (given columns of these names are replaced). A null text has no bytes and groups with no other
    text but null; an empty text is a text. Repeated rows each get their own slot. Shard sizes differ
    from the mean by a unit at most (1 / `units` of all bytes), unless a group of equal texts is
    larger than a shard's fair part: it is kept whole and is a shard of its own. An empty table gives
    an empty result; with fewer units than shards the last shards stay empty.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    made = ("text", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "_hash", "_row")
    kept = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        *kept,
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    # Groups of equal texts; each task adds up its rows of a group before the shuffle.
    groups = rows.groupBy("_hash").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    all_bytes, all_rows = total[0] or 0, total[1]
    heavy = (F.col("bytes") * units > all_bytes) | (F.col("n") * units > all_rows)
    leading = F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * units).cast("long")
    # Fewer than 2 * units heavy groups and at most `units` others: bounded whatever the input.
    line = (
        groups.groupBy(leading.alias("unit"), F.when(heavy, F.col("_hash")).alias("alone"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .collect()
    )
    line.sort(key=lambda u: (u.unit, u.alone is not None, u.alone or 0))
    shard_of = assign_units([u.bytes for u in line], shards)
    # A unit with many rows is numbered in parts, so that no task numbers more than a unit's fair rows.
    parts = [-(-u.n * units // max(1, all_rows)) for u in line]
    plan = spark.createDataFrame(
        [(i, u.unit, u.alone, shard_of[i], parts[i]) for i, u in enumerate(line)],
        "place int, unit long, alone long, shard int, parts long",
    )
    alone = plan.filter("alone is not null").select(F.col("alone").alias("_hash"), F.lit(True).alias("_heavy"))
    placed = (
        rows.join(F.broadcast(alone), "_hash", "left")
        .withColumn("unit", leading)
        .withColumn("_alone", F.when(F.col("_heavy"), F.col("_hash")))
        .join(
            F.broadcast(plan.withColumnRenamed("alone", "_plan_alone").withColumnRenamed("unit", "_plan_unit")),
            (F.col("unit") == F.col("_plan_unit")) & F.col("_alone").eqNullSafe(F.col("_plan_alone")),
        )
        .withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")))
    )
    counts = placed.groupBy("shard", "place", "part").agg(F.count(F.lit(1)).alias("part_rows"))
    before = Window.partitionBy("shard").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("place", "part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("place", "part").orderBy("doc_id", "_row")
    return (
        placed.withColumn("_nth", F.row_number().over(within))
        .join(F.broadcast(starts), ["place", "part"])
        .select(
            *kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("_nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
