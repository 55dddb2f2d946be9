"""Places in a total order, without one task that ranks all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.scratch import held


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in the order given: ranges of rows are sorted apart, and each begins where those before it end."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = held(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # one row for each range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return ranged.withColumn("__k", within).join(F.broadcast(base), "__range").select(*df.columns, (F.col("__base") + F.col("__k")).cast("long").alias(name))


def sliced(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """df with ``slice``, from 0: so many rows each, in the order given."""
    return numbered(df, *order, name="__place").withColumn("slice", F.floor((F.col("__place") - 1) / size).cast("long")).drop("__place")


def running(df: DataFrame, by: list[str], order: str, marks: Column, name: str) -> DataFrame:
    """df with a counter that grows at each marked row of its group."""
    return df.withColumn(name, F.sum(F.when(marks, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def owner(df: DataFrame, by: list[str], order: str, heads: Column, value: str, name: str) -> DataFrame:
    """df with the value of the last head at or before each row of its group, null before the first."""
    return df.withColumn(name, F.last(F.when(heads, F.col(value)), ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def neighbours(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with the value of the row before and of the row behind in its group."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def islands(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, value, island, n, first): runs of neighbours with one value, numbered from 1."""
    change = F.lag(value).over(Window.partitionBy(*by).orderBy(order)).eqNullSafe(F.col(value))
    marked = running(df.withColumn("__fresh", ~F.coalesce(change, F.lit(False))), by, order, F.col("__fresh"), "island")
    return marked.groupBy(*by, value, "island").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def first_of_kind(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """Of each group the values of the first row, by partial aggregation."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*values), order).alias("__x")).select(*by, *(F.col(f"__x.{v}").alias(v) for v in values))


def windows_of(df: DataFrame, by: list[str], order: str, value: str, size: int) -> DataFrame:
    """df with ``cons``: the values of the last ``size`` rows of the group up to and with each."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn("cons", F.collect_list(value).over(w))


def draw(seed: int, *keys: Column | str) -> Column:
    """A row's place in the lot: the digest of a seed and its keys, the same in every run and on any cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys)))


def sampled(df: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group (all of smaller ones), drawn by the least digests of seed and key. Each task keeps k of its own first, so a large group isn't gathered."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key), key))
    return df.withColumn("__k", place).where(F.col("__k") <= k).drop("__k")


def shuffled(df: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in a shuffle of all rows; ranges of digests are ordered apart."""
    return numbered(df.withColumn("__lot", draw(seed, key)), "__lot", key, name=name).drop("__lot")
