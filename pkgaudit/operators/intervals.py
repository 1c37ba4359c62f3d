"""Points in intervals, by group, as an equi join.

The distinct point keys of a group get ranks, interval ends become ranks too, and the rank interval is cut into
blocks of a power of two: at most two of each size. A point lies in one block of every size, so it has as many
block keys as its group's size has binary digits, and point and interval meet in exactly one of them, if
at all. The join grows with points times digits and with what it finds, not with points times intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def _levels(size: Column) -> Column:
    """0 to the number of binary digits of `size`, less one."""
    return F.sequence(F.lit(0), F.greatest(F.length(F.bin(size)).cast("int") - 1, F.lit(0)))


def _blocks(low: Column, high: Column) -> Column:
    """The blocks (level, block) that make up the ranks low to high: disjoint, two of a level at most.

    At level j the interval has shrunk to [ceil(low / 2^j), floor((high + 1) / 2^j)); an odd end cannot be
    part of a larger block.
    """
    end = high + 1

    def of_level(level: Column) -> Column:
        begin_at = _shift("shiftright", low + _shift("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        end_at = _shift("shiftright", end, level)
        left = (begin_at % 2 == 1) & (begin_at < end_at)
        right = (end_at % 2 == 1) & (begin_at + left.cast("long") < end_at)
        def block(at: Column) -> Column:
            return F.struct(level.alias("level"), at.alias("block"))

        return F.array(F.when(left, block(begin_at)), F.when(right, block(end_at - 1)))

    return F.filter(F.flatten(F.transform(_levels(end), of_level)), lambda b: b.isNotNull())


def _merged(located: DataFrame, key: list[str]) -> DataFrame:
    """Rank intervals of a key that overlap or touch put together: disjoint ones that cover the same ranks."""
    of_key = Window.partitionBy(*key).orderBy("_low", "_high")
    reach = F.max("_high").over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    opened = located.withColumn("_new", F.when(F.col("_low") > reach + 1, 1).otherwise(0))
    numbered = opened.withColumn("_run", F.sum("_new").over(of_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*key, "_run").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).drop("_run")


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, group: list[str], merge_by: list[str] | None = None
) -> DataFrame:
    """The columns of `points` and of `intervals` for every point inside an interval of its group, once each.

    Points have the columns of `group` and `at_key`; intervals those of `group`, `from_key`, and `to_key` (not
    inside) or `last_key` (inside); without either they are open. Keys compare as texts; rows with a null group
    column, `at_key` or `from_key` meet nothing. Further columns may not share a name.

    With `merge_by`, intervals of a group with equal values there (nulls are equal) count as one set: a point meets
    it once, however many of its intervals hold the point, and of the intervals only these columns are returned.
    The rows of the result need no distinct then.
    """
    keys = points.filter(F.col("at_key").isNotNull()).select(*group, "at_key").distinct()
    spans = intervals.filter(F.col("from_key").isNotNull())
    stop = F.coalesce("to_key", "last_key")
    # At one key, interval ends that lie before it come first, then the point, then ends that hold it.
    marks = keys.select(*group, F.col("at_key").alias("key"), F.lit(1).alias("place"), F.lit(1).alias("one")).unionByName(
        spans.select(*group, F.explode(F.array_distinct(F.array(
            F.struct(F.col("from_key").alias("key"), F.lit(0).alias("place")),
            F.when(stop.isNotNull(), F.struct(stop.alias("key"), F.when(F.col("to_key").isNotNull(), 0).otherwise(2).alias("place"))),
        ))).alias("mark")).filter("mark is not null").select(*group, "mark.key", "mark.place").distinct().withColumn("one", F.lit(0)))
    of_group = Window.partitionBy(*group)
    upto = of_group.orderBy("key", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = marks.select(*group, "key", "place", F.sum("one").over(upto).alias("rank"), F.sum("one").over(of_group).alias("size"))

    def at(place: int, key: str, rank: str) -> DataFrame:
        return ranked.filter(F.col("place") == place).select(*group, F.col("key").alias(key), F.col("rank").alias(rank), "size")

    located = spans.join(at(0, "from_key", "_before"), [*group, "from_key"])
    ends = ranked.filter("place <> 1").select(
        *group, F.col("key").alias("_stop"), (F.col("place") == 0).alias("_open"), F.col("rank").alias("_rank"))
    located = located.withColumn("_stop", stop).withColumn("_open", F.col("to_key").isNotNull()).join(
        ends, [*group, "_stop", "_open"], "left")
    low, high = F.col("_before") + 1, F.when(F.col("_stop").isNull(), F.col("size")).otherwise(F.col("_rank"))
    kept = [c for c in intervals.columns if c not in group] if merge_by is None else merge_by
    located = located.select(*group, *kept, low.alias("_low"), high.alias("_high")).filter("_low <= _high")
    if merge_by is not None:
        located = _merged(located, [*group, *kept])
    cut = located.select(*group, *kept, F.explode(_blocks(F.col("_low"), F.col("_high"))).alias("_b")).select(
        *group, *kept, "_b.level", "_b.block")
    placed = points.join(at(1, "at_key", "_rank"), [*group, "at_key"])
    spread = placed.withColumn("level", F.explode(_levels(F.col("size") + 1))).withColumn(
        "block", _shift("shiftright", F.col("_rank"), F.col("level")))
    return spread.drop("_rank", "size").join(cut, [*group, "level", "block"]).drop("level", "block")
