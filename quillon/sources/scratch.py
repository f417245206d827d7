"""Tables written between the steps of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the SQL warehouse where that is unset; it is deleted when the application ends.

    Executors on other machines must see it: outside local mode a warehouse on a
    local disk is refused.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        local = shared.startswith("file:") or "://" not in shared
        if local and not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    root = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)  # only what is there is deleted at the end
    files.deleteOnExit(path)
    return root


def writer(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table under a name and reads it back; see folder."""
    root = folder(spark, name)

    def written(df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{table}")
        return spark.read.schema(df.schema).parquet(f"{root}/{table}")

    return written
