"""Ending the lineage of intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """End the lineage of an intermediate table that several later stages read.

    It is written to the folder in ``spark.checkpoint.dir``, so that it outlives executors.
    Without such a folder it is only persisted, which a local master alone allows: there, no
    executor can be lost. ``release`` deletes what was written.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        return df.persist()
    path = f"{folder.rstrip('/')}/onomast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, out: str = "index") -> DataFrame:
    """``out``: each row's place (from 0) in ``order``, which must tell rows apart, by ranges.

    Rows are dealt by ranges of the order and numbered within; what comes before a range is a
    sum over the ranges, a row each. No task sees more than its range.
    """
    part = "onomast range"
    dealt = settle(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = dealt.groupBy(part).count().withColumn("onomast before", F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(out, within).join(F.broadcast(before), part).withColumn(out, F.col(out) + F.col("onomast before") - 1).drop(part, "onomast before")


_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Delete what ``settle`` wrote in this application, once no result of it is read any more."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
