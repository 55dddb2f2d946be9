"""Incremental ingestion: the batch operators behind a stream, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from inkloom.functions import text as X
from inkloom.operators.scratch import shared_folder


def follow(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def as_glob(path: str) -> str:
    """A path that streams read alike whether it is a file or a folder."""
    return f"{path[:-1]}[{path[-1]}]"


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run a batch transform on what is new and write it, a folder for each batch, so a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; on a stream, events later than ``late`` are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


#: Leading hexadecimal digits of a canonical hash that share one group of the stream, and so one call of Python a batch.
DIGITS = 3


def _first(kind: str) -> StatefulProcessor:
    """Of each canonical hash the key that came first; state is one key a hash. A local class, so that it travels whole to where the state is kept."""

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.first = handle.getMapState("first", "canon string", f"first {kind}")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
            taken = {}
            for row in rows:
                taken.setdefault(row["__canon"], []).append(row["__key"])
            any_known = self.first.exists()
            for canon, keys in taken.items():
                keys.sort(key=lambda k: (k is None, k))
                seen = self.first.getValue((canon,)) if any_known else None
                if seen is None:
                    self.first.updateValue((canon,), (keys[0],))
                first = keys[0] if seen is None else seen[0]
                for n, k in enumerate(keys):
                    yield Row(key=k, survivor=first, status="NEW" if seen is None and n == 0 else "REUSED")

        def close(self) -> None:
            pass

    return First()


def reuse(stream: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """(key, survivor, status) of a stream as it comes: the first of equal canonical texts is NEW, in a batch that with the least key; all others are REUSED.

    The first keys are kept as state by canonical hash, so a query that is started again on its checkpoint goes on where it
    stopped. Texts are hashed before the shuffle; hashes that begin alike are taken up together, and only those of a batch are
    looked up. Needs the RocksDB state store (:func:`keep_state`).
    """
    kind = X.strict_key if strict else X.canonical_key
    hashed = stream.select(kind(F.coalesce(F.col(text), F.lit(""))).alias("__canon"), F.col(key).alias("__key"))
    of = stream.schema[key].dataType.simpleString()
    out = hashed.withColumn("__begin", F.substring("__canon", 1, DIGITS)).groupBy("__begin").transformWithState(_first(of), f"key {of}, survivor {of}, status string", "Append", "None")
    return out.withColumnRenamed("key", key)


def keep_state(spark: SparkSession) -> None:
    """Streams begun from now on keep their state in RocksDB, by deltas to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def reused(spark: SparkSession, path: str, key: str, text: str, out: str, checkpoint: str, files_per_trigger: int = 100) -> DataFrame:
    """Take up what is new below a path and give (key, survivor, status) of all that was ever taken up; a batch that is run again replaces its own folder."""
    keep_state(spark)
    schema = spark.read.parquet(path).select(key, text).schema
    stream = reuse(follow(spark, path, schema, files_per_trigger), key, text)
    ingest(stream, lambda batch: batch, out, checkpoint).awaitTermination()
    of = schema[key].dataType.simpleString()
    return spark.read.schema(f"{key} {of}, survivor {of}, status string").parquet(out).select(key, "survivor", "status")


def taken_up(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, n) of a table that comes as a stream of files: they are taken up batch by batch where they lie, the counts written, and added up from what was written."""
    folder = shared_folder(spark, "taken")
    stream = follow(spark, as_glob(path), spark.read.parquet(path).schema, files_per_trigger=2)
    ingest(stream, lambda batch: batch.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("key string, n long").parquet(f"{folder}/out").groupBy("key").agg(F.sum("n").alias("n"))
