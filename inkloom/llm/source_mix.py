"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, shuffled by a hash of their id, form a queue of up to ``epochs`` rounds. A document's
virtual finish time is the number of its source's words up to and with it, divided by the source's target; the
queues are merged by that time and cut where the words reach the total budget. Targets share the budget by weight,
stop at ``epochs`` times their source, and what is left over is shared anew: the water level is found in closed form
over the sources sorted by their cap over their weight.

No source is ever sorted by one task: a source's running totals come from sums by hash bucket, prefix sums over the
buckets (their number grows with the rows) and a window within each bucket, and the global cut alike from
``TIME_BUCKETS`` buckets of the virtual time, of which only the one that holds the cut is ordered. Texts are read
once to count their words and never shuffled.

What a source takes is a stretch of its queue for each round, so :func:`take` applies a mix to the documents by the place
where each source's stretch ends: one row for each source and round, joined by source, and no list of documents.

Null texts have size 0 and null sources form one source, last in order. Repeated rows, rows that share an id and rows
without one queue as rows of their own; :func:`take` tells them apart by file and row. A source without words has target
0, and its documents take 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
#: A source's hash buckets: 2^10 at least, and as many as hold so many rows each if it holds all.
BUCKET_BITS, BUCKET_ROWS = 10, 1 << 16
TIME_BUCKETS = 65536


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row for each source, so the windows over all of them are small."""
    cycle = F.array(*map(F.lit, weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(whole) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level)
    # The first source whose cap the level doesn't reach sets the level; without one all are full.
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    return levelled.withColumn("water", first["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def plan(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, ties: tuple[str, ...] = ("doc_id", "size")) -> DataFrame:
    """(source, size, place, the columns ties) to these with source_size, target and ``copies``; place: a hash of 60 bits that shuffles, ties: what orders rows of one place. slim is read several times.

    With a column ``times`` a row stands for so many equal ones, which come out one by one.
    """
    times = F.col("times") if "times" in slim.columns else F.lit(1).cast("long")
    slim = slim.withColumn("times", times)
    many = not slim.where("times > 1").isEmpty()
    bits = max(BUCKET_BITS, math.ceil(math.log2((slim.count() + 1) / BUCKET_ROWS)))
    slim = slim.withColumn("bucket", F.shiftright("place", 60 - bits))
    sums = slim.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("times")).alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("words").over(so_far), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    goal = goal.withColumnRenamed("source", "g")
    offsets = base.join(goal, F.col("s").eqNullSafe(F.col("g"))).drop("g")
    within = Window.partitionBy("source", "bucket").orderBy("place", *ties).rowsBetween(Window.unboundedPreceding, 0)
    queued = slim.withColumn("run", F.sum(F.col("size") * F.col("times")).over(within)).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    if many:
        queued = _each(queued)
    done = queued.withColumn("done", F.when(F.col("target") > 0, (F.col("base") + F.col("run")) / F.col("target")))
    lap = F.col("source_size") / F.col("target")
    held = [c for c in dict.fromkeys([*ties, "source", "size"])]
    done = cut(done.select("place", *held, "source_size", "target", "done", lap.alias("lap")), "mix")
    items = done.where("target > 0 and size > 0").select("size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.col("done") + e * F.col("lap"))).alias("at"))
    items = items.withColumn("slice", F.least(F.floor(F.col("at") * (TIME_BUCKETS // 4)), F.lit(TIME_BUCKETS)))
    budget = goal.agg(F.sum("target").alias("budget"))
    steps = items.groupBy("slice").agg(F.sum("size").alias("words"))
    run = steps.withColumn("upto", F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)))
    # Rounding of the targets must not lose the last document.
    fits = lambda c: F.col(c) <= F.col("budget") * (1 + 1e-12)
    edge = run.crossJoin(F.broadcast(budget)).agg(F.max(F.when(fits("upto"), F.col("upto"))).alias("full"), F.min(F.when(~fits("upto"), F.col("slice"))).alias("edge"))
    inside = items.join(F.broadcast(edge), F.col("slice") == F.col("edge")).groupBy("at").agg(F.sum("size").alias("words"), F.first("full").alias("full"))
    by_time = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.coalesce("full", F.lit(0)) + F.sum("words").over(by_time)).crossJoin(F.broadcast(budget)).agg(F.max(F.when(fits("upto"), F.col("at"))).alias("last"))
    stop = edge.crossJoin(last).select("edge", "last")
    taken = lambda e: (F.col("edge").isNull() | (F.least(F.floor((F.col("done") + e * F.col("lap")) * (TIME_BUCKETS // 4)), F.lit(TIME_BUCKETS)) < F.col("edge")) | F.coalesce(F.col("done") + e * F.col("lap") <= F.col("last"), F.lit(False))).cast("int")
    copies = sum((taken(e) for e in range(1, epochs)), taken(0))
    return done.crossJoin(F.broadcast(stop)).select("place", *held, "source_size", "target", F.when((F.col("target") > 0) & (F.col("size") > 0), copies).otherwise(0).alias("copies"))


#: Equal rows that a task unfolds at a time.
UNFOLD = 1 << 14


def _each(queued: DataFrame) -> DataFrame:
    """Each row as many times as it stands for, its running sum less by the size of those behind it. Many equal rows are dealt out before they are unfolded."""
    begun = queued.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(UNFOLD).cast("long"))).alias("__from"))
    dealt = begun.repartition("source", "place", "size", "__from")
    each = dealt.select("*", F.explode(F.sequence("__from", F.least(F.col("__from") + UNFOLD, F.col("times")) - 1)).alias("__behind"))
    return each.withColumn("run", F.col("run") - F.col("size") * F.col("__behind")).drop("__from", "__behind")


def slim_of(docs: DataFrame) -> DataFrame:
    """What the queue needs of each document, read from the texts once; documents alike in it (such as those without an id) are one row with their number."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("place"))
    return cut(rows.groupBy("doc_id", "source", "size", "place").agg(F.count("*").alias("times")), "sizes")


def _identified(docs: DataFrame) -> DataFrame:
    """docs as a table of files, each row with its file and its place there; written to the shared folder unless it is one."""
    where = lambda df: df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    try:
        return where(docs)
    except AnalysisException:  # not read from files
        return where(cut(docs, "rows"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The rows of docs (source, text and any others), each as often as the mix takes it. Texts are neither shuffled nor written."""
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = ("__place", "__file", "__row")
    rows = _identified(docs).withColumn("__place", F.shiftright(F.xxhash64(*plain), 4).bitwiseAND(F.lit((1 << 60) - 1)))
    slim = cut(rows.select("source", size_of(F.col("text")).alias("size"), F.col("__place").alias("place"), "__file", "__row"), "sizes")
    planned = plan(slim, weights, share, epochs, ("__file", "__row")).withColumnRenamed("place", "__place").where("copies > 0")
    last = [F.max(F.when(F.col("copies") > e, F.struct(*order))).alias(f"__last{e}") for e in range(epochs)]
    ends = cut(planned.groupBy(F.col("source").alias("__source")).agg(*last), "ends")
    both = rows.where(F.col("text").rlike(WORD)).join(ends, F.col("source").eqNullSafe(F.col("__source")))
    copies = sum((F.coalesce(F.struct(*order) <= F.col(f"__last{e}"), F.lit(False)).cast("int") for e in range(epochs)), F.lit(0))
    some = both.withColumn("__copies", copies).where("__copies > 0")
    return some.select(*docs.columns, F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).select(*docs.columns)


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = plan(slim_of(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level <= cap / weight) * weight, cap)) AS target FROM l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT / target AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT size, done + e * (source_size / target) AS fin FROM q, (VALUES (0), (1)) AS laps(e) WHERE size > 0),
c AS (SELECT fin, sum(sum(size)) OVER (ORDER BY fin) AS upto FROM i GROUP BY fin),
z AS (SELECT max(fin) AS last_fin FROM c WHERE upto <= (SELECT sum(target) FROM t) * (1 + 1e-12))
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE size * ((done <= last_fin)::BIGINT + (done + source_size / target <= last_fin)::BIGINT) END AS taken FROM q, z
"""
