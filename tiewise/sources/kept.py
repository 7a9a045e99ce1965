"""Small tables that many plans read: written once as Parquet into the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below the warehouse where that is unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


class Kept:
    """Tables kept together and emptied together. A kept frame's plan is one scan with known size, whatever it came from."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = folder(self.spark)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            self.spark.range(0).write.mode("overwrite").parquet(path)
        self.paths = []
