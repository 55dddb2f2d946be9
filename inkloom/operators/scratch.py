"""Tables written between two steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder where the session says, else in the warehouse; on a cluster a warehouse on local disks is refused, since executors don't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/inkloom-shared"
        if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or base.startswith("/")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def held(df: DataFrame, tag: str = "held") -> DataFrame:
    """df computed once and read back: its lineage ends in files that outlive executors."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_held(*tables: DataFrame) -> None:
    """Delete the files of tables made by held() once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
