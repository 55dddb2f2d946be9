"""Dominance counting: for every point the points of an equal or smaller slot and a strictly larger level.

Points of one slot and level are summed into cells first. Cells are dealt into chunks by ranges of (slot, level falling);
in this order what counts for a cell lies before it, so a slot that holds a third of all cells is split like any other.
Levels are dealt into blocks by ranges. What lies above a cell is then the sum of three parts:

* earlier chunks, higher blocks: the cumulative block array that its chunk starts from; sums by chunk and block, scanned
  along the chunks and from the highest block down,
* earlier chunks, its own block: a sweep of the block by chunk,
* its own chunk: a sweep of the chunk by slot.

Both sweeps are :func:`sweep`: levels in blocks of about their square root, a sum above each block and one above each
level within its block, so a query adds two numbers and an update touches one row of sums and the blocks it meets.
There are at most as many chunks and blocks as the square root of the number of cells, so the block arrays are never more
than the cells; nothing that grows with the points goes to the driver, into a broadcast or through one task. Cells that
hold more than a thousandth of all points, so fewer than a thousand cells, are broadcast to their points, the others are
joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc32_sql, cut, drop_cut, table

#: Cells of a chunk, and rows of a block of levels, about; more only where their number would pass the square root of all.
CELLS = 1 << 16
#: A cell with more than this share of all points is hot.
HOT = 1000


def sweep(order: np.ndarray, level: np.ndarray, amounts: np.ndarray, inclusive: bool) -> np.ndarray:
    """Sums of the amounts (a row for each entry) of entries with a larger level and a smaller, or equal if inclusive, order.

    Entries come sorted by order and have distinct levels within one. No entries give no sums.
    """
    out = np.zeros_like(amounts)
    if not len(order):
        return out
    levels, rank = np.unique(level, return_inverse=True)
    side = math.isqrt(len(levels) - 1) + 1
    blocks = -(-len(levels) // side)
    block, inside = rank // side, rank % side
    above_block = np.zeros((blocks, amounts.shape[1]), np.int64)
    above_level = np.zeros((blocks, side, amounts.shape[1]), np.int64)
    starts = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        b, i = block[lo:hi], inside[lo:hi]
        if not inclusive:
            out[lo:hi] = above_block[b] + above_level[b, i]
        met, row = np.unique(b, return_inverse=True)
        fresh = np.zeros((len(met), side, amounts.shape[1]), np.int64)
        fresh[row, i] = amounts[lo:hi]
        above_level[met] += fresh[:, ::-1].cumsum(1)[:, ::-1] - fresh
        sums = fresh.sum(1)
        above = sums[::-1].cumsum(0)[::-1]  # of this met block and those above it
        above_block[: met[0]] += above[0]
        for k in range(len(met) - 1):
            above_block[met[k] : met[k + 1]] += above[k + 1]
        if inclusive:
            out[lo:hi] = above_block[b] + above_level[b, i]
    return out


def _swept(df: DataFrame, order: str, inclusive: bool, names: tuple[str, str]) -> DataFrame:
    """df, dealt by ranges, with the sums that :func:`sweep` finds within each partition; df has at least the columns order, level, n and w."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.LongType()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        whole = whole.sort_by([(order, "ascending"), ("level", "ascending")])
        at, level, n, w = (whole.column(c).to_numpy() for c in (order, "level", "n", "w"))
        found = sweep(at, level, np.stack([n, w], 1), inclusive)
        for x, name in enumerate(names):
            whole = whole.append_column(name, pa.array(found[:, x]))
        yield from whole.to_batches(max_chunksize=1 << 16)

    return df.mapInArrow(run, schema)


def count_cells(cells: DataFrame) -> DataFrame:
    """(slot, level, n, w), one row for each slot and level, to these with n_above and w_above, written to the shared folder."""
    count = cells.count()
    parts = max(1, min(-(-count // CELLS), math.isqrt(count)))
    ranged = cells.repartitionByRange(parts, F.col("slot"), F.col("level").desc()).withColumn("chunk", F.spark_partition_id())
    own = cut(_swept(ranged, "slot", True, ("n_own", "w_own")), "chunks")
    by_level = own.groupBy("chunk", "level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = by_level.repartitionByRange(parts, "level").withColumn("block", F.spark_partition_id())
    before = cut(_swept(blocks, "chunk", False, ("n_before", "w_before")), "blocks")

    sums = before.groupBy("chunk", "block").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    last = before.agg(F.max("block")).first()[0]
    dense = own.select("chunk").distinct().select("chunk", F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("block")).join(sums, ["chunk", "block"], "left")
    earlier = Window.partitionBy("block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy("chunk").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    scanned = dense.select("chunk", "block", *(F.sum(F.coalesce(x, F.lit(0))).over(earlier).alias(x) for x in "nw"))
    arrays = scanned.select("chunk", "block", *(F.coalesce(F.sum(x).over(higher), F.lit(0)).alias(f"{x}_higher") for x in "nw"))
    start = before.join(arrays, ["chunk", "block"]).select("chunk", "level", *((F.col(f"{x}_before") + F.col(f"{x}_higher")).alias(f"{x}_start") for x in "nw"))
    done = cut(own.join(start, ["chunk", "level"]).select("slot", "level", "n", "w", *((F.col(f"{x}_own") + F.col(f"{x}_start")).alias(f"{x}_above") for x in "nw")), "cells")
    drop_cut(own, before)
    return done


def count_above(df: DataFrame, slot: Column, level: Column, weight: Column, names: tuple[str, str] = ("n_above", "w_above")) -> DataFrame:
    """df with two columns: how many rows have an equal or smaller slot and a strictly larger level, and their summed weight.

    slot and level are long, weight is long and not null. Rows with a null slot or level have nulls and are counted for
    none. Equal rows count each. Columns of df that bear the new names give way to them. df is read several times. An
    empty table gives an empty one.
    """
    held = [c for c in df.columns if c not in names]
    points = df.select(*(df[c] for c in held), slot.cast("long").alias("__slot"), level.cast("long").alias("__level"), weight.cast("long").alias("__weight"))
    known = points.where("__slot is not null and __level is not null")
    cells = cut(known.groupBy(F.col("__slot").alias("slot"), F.col("__level").alias("level")).agg(F.count("*").alias("n"), F.sum("__weight").alias("w")), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    counted = count_cells(cells)
    drop_cut(cells)
    found = counted.select(F.col("slot").alias("__slot"), F.col("level").alias("__level"), "n", F.col("n_above").alias("__n"), F.col("w_above").alias("__w"))
    hot = F.col("n") * HOT > total
    out = [*held, F.col("__n").alias(names[0]), F.col("__w").alias(names[1])]
    few = F.broadcast(found.where(hot).drop("n"))
    cold = known.join(few.select("__slot", "__level"), ["__slot", "__level"], "left_anti").join(found.where(~hot).drop("n"), ["__slot", "__level"])
    none = points.where("__slot is null or __level is null").select(*held, *(F.lit(None).cast("long").alias(x) for x in names))
    return known.join(few, ["__slot", "__level"]).select(*out).unionByName(cold.select(*out)).unionByName(none)


def hour_slot(df: DataFrame, time: str) -> Column:
    """Whole hours since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return F.unix_date(F.col(time).cast("date")).cast("long") * 24 + F.hour(time)
    return F.floor(F.unix_seconds(time) / 3600)


def op12_dominance(spark, sf_dir: str) -> DataFrame:
    """Sales above each sale. A total that isn't finite has no level; a sale without an id stands for one row."""
    sales = table(spark, sf_dir, "sales")
    finite = F.when(~F.isnan("total") & (F.abs("total") < F.lit(1e16)), F.col("total"))
    level = F.floor(F.floor(100 * finite + 0.5) / 100)
    weight = 1 + F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 2, F.lit(0))
    points = sales.select("sale_id", hour_slot(sales, "sold_at").alias("slot"), level.alias("level"), weight.alias("__stands_for"))
    return count_above(points, F.col("slot"), F.col("level"), F.col("__stands_for"), ("n_sales", "n_rows")).drop("__stands_for")


OP12_SQL = f"""
WITH p AS (SELECT sale_id, (epoch_us(sold_at) - ((epoch_us(sold_at) % 3600000000) + 3600000000) % 3600000000) // 3600000000 AS slot,
                  CASE WHEN abs(total) < 1e16 THEN floor(floor(100 * total + 0.5) / 100)::BIGINT END AS level, 1 + coalesce({crc32_sql("sale_id::VARCHAR")} % 2, 0) AS w FROM sales),
c AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM p WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
a AS (SELECT a.slot, a.level, coalesce(sum(b.n), 0)::BIGINT AS n_sales, coalesce(sum(b.w), 0)::BIGINT AS n_rows
      FROM c AS a LEFT JOIN c AS b ON b.slot <= a.slot AND b.level > a.level GROUP BY a.slot, a.level)
SELECT sale_id, p.slot, p.level, n_sales, n_rows FROM p LEFT JOIN a ON p.slot = a.slot AND p.level = a.level
"""
