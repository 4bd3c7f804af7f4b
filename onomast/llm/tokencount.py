"""Exact length histogram of encoded documents.

Each document's number of ids is counted once (Arrow batches), documents are added up
by that number, and suffix sums over the histogram answer, for every context limit L:
how many documents have at least or more than L ids, the total, the total if each text
is cut at L (sum of min(length, L)), and quantiles (the length at which the running
count reaches a share). The suffix sums run in two levels, within blocks of lengths and
over block totals, so no task reads the whole histogram however many lengths there are.

Null and empty texts have length 0. Rows are counted as they come, repeats and ties included;
very long texts are encoded whole. Only the text is read, so other columns may be called
anything and hold nulls. An empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm import tokens
from onomast.llm._common import cuts, materialise, utf8

BLOCK = 1024


def lengths(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """One row per document: ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(0))
            for lo, hi in cuts(offsets, 1 << 20):
                yield pa.record_batch([pa.array(tokens.counts(path, batch.column(0).slice(lo, hi - lo).to_pylist()))], ["n_tokens"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens``, ``n_docs`` and the suffix sums, by length."""
    # written, as it is read twice: a row for each length, and no text is encoded again
    by = materialise(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    totals = by.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per 1024 lengths
    above = totals.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_above"), F.sum("d").over(Window.partitionBy(F.lit(0))).alias("docs"), F.sum("t").over(Window.partitionBy(F.lit(0))).alias("tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    down = by.join(above, "block").select(
        "n_tokens", "n_docs", "docs", "tokens",
        (F.sum("n_docs").over(within) + F.col("d_above")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(within) + F.col("t_above")).alias("tokens_at_least"),
    )
    return down.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("docs_at_least") - F.col("n_docs")).alias("docs_longer"),
        (F.col("tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_cut_here"),
        ((F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")).alias("quantile"),
        F.col("docs").alias("total_docs"), F.col("tokens").alias("total_tokens"),
    )


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed."""
    return hist.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def cut_total(hist: DataFrame, limit: int) -> DataFrame:
    """Ids left if each text is cut at ``limit``, whether or not a text has that length."""
    return hist.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))
