"""Shard placement by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, given by an offset and a stride. The shards
take turns; at its turn a shard claims the first slot of its permutation that is still free. So all shards own the
same number of slots, give or take one, and a shard that joins or leaves moves few slots of the others. The table
has a fixed size (``SLOTS``), so it is broadcast with a proven bound, and a row finds its shard with one hash and
one lookup. No Python runs on the executors.

A key that holds more than half a shard's fair share of the rows is hot; there are at most 2 x shards of them, a
bound that lets their list be broadcast. With ``split_hot`` and where ``spread`` names columns, the rows of hot keys are
dealt over the table by these as well. Rows with a null key are placed by the spread columns (the text). Rows are kept one to one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

SLOTS = 65537
SHARDS = 64


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard of each slot. slots must be prime, so that every stride visits all of them."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("need a prime number of slots, one for each shard at least")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8]) % slots for d in digest]
    stride = [int.from_bytes(d[8:]) % (slots - 1) + 1 for d in digest]
    owner, free, k = [-1] * slots, slots, 0
    while free:
        at = place[k]
        while owner[at] >= 0:
            at = (at + stride[k]) % slots
        owner[at], place[k] = k, (at + stride[k]) % slots
        free, k = free - 1, (k + 1) % len(shards)
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % F.lit(slots)


def lookup(spark, owner: list[int]) -> DataFrame:
    """The table as rows of (slot, shard), from one literal."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def place(df: DataFrame, key: str, n_shards: int = SHARDS, spread: list[str] | None = None, slots: int = SLOTS, split_hot: bool = False) -> DataFrame:
    """Add ``slot`` (long) and ``shard`` (int); columns of these names give way. split_hot: deal hot keys out by ``spread``, at the cost of counting keys."""
    owner = fill([f"shard-{i}" for i in range(n_shards)], slots)
    df = df.select(*(c for c in df.columns if c not in ("slot", "shard")))
    other = F.concat_ws("\x1f", *(F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in spread or [])) if spread else F.lit("")
    name = F.col(key).cast("string")
    if split_hot and spread:
        counts = df.where(F.col(key).isNotNull()).groupBy(name.alias("__key")).agg(F.count("*").alias("n"))
        total = df.agg(F.count("*").alias("all"))
        hot = counts.join(F.broadcast(total), F.col("n") * 2 * n_shards > F.col("all")).select("__key", F.lit(True).alias("__hot"))
        df = df.join(F.broadcast(hot), name.eqNullSafe(F.col("__key")), "left")
        name = F.when(F.col("__hot"), F.concat_ws("\x1f", name, other)).otherwise(name)
    out = df.withColumn("slot", slot_of(F.coalesce(name, other), slots)).drop("__key", "__hot")
    return out.join(F.broadcast(lookup(df.sparkSession, owner)), "slot", "left").select(*(c for c in out.columns if c != "slot"), "slot", "shard")


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write placed rows, a folder for each shard; files hold rows_per_file at most, and no task gathers a whole shard unless it is small."""
    df.repartition("shard", F.pmod("slot", F.lit(16))).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", spread=["text"], split_hot=True).select("doc_id", "slot", "shard")


def op7_sql() -> str:
    owner = ",".join(map(str, fill([f"shard-{i}" for i in range(SHARDS)])))
    return f"""
WITH t AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents),
owner AS (SELECT unnest([{owner}]) AS shard, generate_subscripts([{owner}], 1) - 1 AS slot)
SELECT doc_id, slot, CAST(shard AS INTEGER) AS shard FROM t JOIN owner USING (slot)
"""
