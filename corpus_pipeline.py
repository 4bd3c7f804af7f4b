"""A corpus pipeline: language ID, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read back as the next one's ``docs``. All but the last return the columns
of ``docs``, also those called like a column that an operator adds. Every stage works on
all rows it is given: texts are read whole, repeated rows are rows of their own, ties are
settled by ids or hashes, and an empty table gives an empty one. What nulls mean is said
at each stage. Stages with Python workers bound the bytes of the session's Arrow batches,
so that long texts fill no executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import langid, minhash, mixing, queries
from onomast.llm._common import materialise, maybe_broadcast, small_batches, table


def _aside(docs: DataFrame, *taken: str) -> DataFrame:
    """``docs`` with columns of the names ``taken`` (in any case) called by their places."""
    return docs.withColumnsRenamed({c: f"onomast aside {i}" for i, c in enumerate(docs.columns) if c.lower() in taken})


def _back(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in order and by their own names again."""
    there = set(done.columns)
    return done.select(*[F.col(f"`onomast aside {i}`").alias(c) if f"onomast aside {i}" in there else F.col(f"`{c}`") for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language at all go: those whose text is null or has no letter.

    A null ``lang`` is filled in with the predicted one. Where no row has a ``lang`` there is
    nothing to learn from: then every text with a letter stays, and ``lang`` stays null. Null
    ids and sources make no difference.
    """
    small_batches(spark)
    model = langid.train(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = langid.identify(_aside(docs, "lang_pred", "score"), model).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return _back(judged.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Rows with a null id belong to no group and stay, as do texts without a word; rows of one
    id are one document and stay or go together.
    """
    small_batches(spark)
    gone = minhash.cluster(docs).filter(~F.col("kept")).select("doc_id").distinct()
    gone = materialise(gone)
    return docs.join(maybe_broadcast(gone, 16), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source the same share of as many rows as there are; copies are rows of their own.

    A null source is a source; rows with equal or null ids are repeated alike.
    """
    return _back(mixing.mix(_aside(docs, "replica", "mix_key")), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids; a null text is an empty document."""
    small_batches(spark)
    return queries.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: BPE, PPM and best fit are beyond SQL; tests hold ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
