"""Ranks over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.store import stored

#: Positions inside a partition take the low bits of monotonically_increasing_id().
LOW = (1 << 33) - 1


def with_rank(df: DataFrame, keys: list[Column], out: str = "rank", descending: bool = False) -> DataFrame:
    """df with its place (from 1) in the order of keys, which must leave no ties.

    The rows are range-partitioned and sorted; a partition's places start after the rows of those before it. Descending
    is the reverse of the ascending order, ties included.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # range bounds are sampled anew by each run of the plan, so the places are written once
    placed = placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(LOW)) + 1)
    placed = stored(placed, "ranked")
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_start") + F.col("_at")
    return placed.join(F.broadcast(starts), "_pid").withColumn(out, F.col("_all") + 1 - place if descending else place).drop("_pid", "_at", "_start", "_all")


def with_running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, settled: bool = False) -> DataFrame:
    """df with the sum of `value` over the group's rows that stand before a row in `order`.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over many tasks. At most one group of a
    range goes on from the range before: what its rows must add is a table of at most as many rows as there are ranges.
    settled says that df is read from a table with little more to work out, so that it need not be written first.
    """
    keys = [*group, *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df if settled else stored(df, "summed")  # the bounds of ranges are sampled: what makes the rows should not run twice
    placed = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "running")
    key = F.struct(*group)
    edges = placed.groupBy("_pid").agg(F.min(key).alias("_low"), F.max(key).alias("_high")).select(F.explode(F.array("_low", "_high")).alias("_g")).distinct()
    sums = placed.withColumn("_g", key).join(F.broadcast(edges), "_g", "left_semi").groupBy("_g", "_pid").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carried", F.sum("_sum").over(before)).where("_carried is not null").select("_g", "_pid", "_carried")
    own = Window.partitionBy("_pid", "_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_g", key).join(F.broadcast(carried), ["_g", "_pid"], "left")
    return rows.withColumn(out, F.coalesce("_carried", F.lit(0).cast("long")) + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_g", "_pid", "_at", "_carried")
