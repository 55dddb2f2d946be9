"""Functions on arrays and maps, in the order of first appearance where order matters, and on tables by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(xs: Column, *values) -> Column:
    """The array without these values."""
    return F.filter(xs, lambda x: ~x.isin(*values) | x.isNull())


def partition(xs: Column, test: Callable[[Column], Column]) -> Column:
    """(yes, no): the elements that pass and those that don't."""
    return F.struct(F.filter(xs, test).alias("yes"), F.filter(xs, lambda x: ~F.coalesce(test(x), F.lit(False))).alias("no"))


def fold_right(xs: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.reverse(xs), start, step)


def initial(xs: Column, n: int = 1) -> Column:
    """All but the last n."""
    return F.slice(xs, F.lit(1), F.greatest(F.size(xs) - n, F.lit(0)))


def rest(xs: Column, n: int = 1) -> Column:
    """All but the first n."""
    return F.slice(xs, F.lit(n + 1), F.greatest(F.size(xs) - n, F.lit(0)))


def last_index(xs: Column, value: Column) -> Column:
    """The last place of a value, from 0, or -1."""
    back = F.array_position(F.reverse(xs), value)
    return F.when(back == 0, -1).otherwise(F.size(xs) - back).cast("int")


def index(xs: Column, value: Column) -> Column:
    """The first place of a value, from 0, or -1."""
    return (F.array_position(xs, value) - 1).cast("int")


def sorted_index(xs: Column, value: Column) -> Column:
    """Where a value belongs in a sorted array, before its equals, from 0."""
    return F.size(F.filter(xs, lambda x: x < value))


def slices(xs: Column, n: int) -> Column:
    """The array in pieces of n; the last may be shorter."""
    return F.when(F.size(xs) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda k: F.slice(xs.cast("array<string>"), k * n + 1, F.lit(n))))


def conses(xs: Column, n: int) -> Column:
    """All stretches of n neighbours."""
    return F.when(F.size(xs) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(xs) - n + 1), lambda k: F.slice(xs.cast("array<string>"), k, F.lit(n))))


def take_while(xs: Column, test: Callable[[Column], Column]) -> Column:
    at = F.array_position(F.transform(xs, test), F.lit(False)).cast("int")
    return F.when(at == 0, xs).otherwise(F.slice(xs, F.lit(1), F.greatest(at - 1, F.lit(0))))


def drop_while(xs: Column, test: Callable[[Column], Column]) -> Column:
    at = F.array_position(F.transform(xs, test), F.lit(False)).cast("int")
    return F.when(at == 0, F.slice(xs, F.lit(1), F.lit(0))).otherwise(F.slice(xs, F.greatest(at, F.lit(1)), F.size(xs)))


def invert(m: Column) -> Column:
    """Values to keys; of equal values the last key wins."""
    entries = F.map_entries(m)
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["value"] == e["value"]))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["value"], e["key"])))


def pick(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*names))


def omit(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def merge(left: Column, right: Column) -> Column:
    """Both maps; where they share a key the right one's value holds."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def defaults(m: Column, fallback: Column) -> Column:
    """A map with what it lacks taken from another."""
    return merge(fallback, m)


def sorted_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def index_by(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row for each key: the last in the order given."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("__x")).select(key, *(F.col(f"__x.{v}").alias(v) for v in values))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both bags; columns go by name."""
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def bounds(df: DataFrame, key: str, value: str) -> DataFrame:
    """The least and the greatest value of each key."""
    return df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def all_and_some(df: DataFrame, key: str, every: Column, some: Column) -> DataFrame:
    return df.groupBy(key).agg(F.every(every).alias("every"), F.some(some).alias("some"))


def first_and_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
