"""Incremental matching: arriving names against a catalog, each id once.

The grams' statistics must be frozen (``context`` fits them on a first batch): a stream
has no corpus of its own. Arrivals are deduplicated by id with a watermark, micro-batches
are matched by the exact and structural rules as static joins, and appended to a ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions import text as X


def exact_stream(arrivals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Arrivals joined with the static catalog (party_id, party_name) on the normalised name."""
    names = catalog.select("party_id", X.normalize(F.col("party_name")).alias("norm"))
    sole = names.filter("norm != ''").groupBy("norm").agg(F.countDistinct("party_id").alias("owners"), F.min("party_id").alias("party_id")).filter("owners = 1").drop("owners")
    return arrivals.withColumn("norm", X.normalize(F.col("raw_name"))).join(sole, "norm", "left").drop("norm")


def once(arrivals: DataFrame, time: str, delay: str = "1 hour", key: str = "adm_party_id") -> DataFrame:
    """Each id once within the watermark."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts(arrivals: DataFrame, time: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Arrivals by window of event time."""
    return arrivals.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def match_batches(arrivals: DataFrame, match: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str):
    """A streaming query that matches each micro-batch and appends to the ledger.

    Ids in the ledger are passed over, so a batch that is run again after a failure adds
    nothing twice.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        from onomast.sources.io import append_ledger

        append_ledger(match(batch), ledger)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
