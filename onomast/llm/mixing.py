"""Mixing sources to target weights by Poisson replication.

A source with n rows and target weight w gets the mean repetition rate
rate = total * w / n, where ``total`` (default: the rows there are) is the mixture's
expected size. Each document is repeated Poisson(rate) times: a uniform number is
hashed from its key and the seed, and the distribution is inverted by counting the
entries of the source's cumulative distribution that do not exceed it. Rates above
``PART`` are split into equal parts with a number each, as a sum of Poisson numbers is
one. The copies are exploded and dealt by a hashed key over all partitions, sorted by
that key within them: a global shuffle that depends on keys and seed alone.

Everything is DataFrame functions. A null source is a source of its own; a source
without a weight gets ``default``; weights need not add up to 1, none may be negative,
and if all weights are 0 nothing remains. Null keys hash as empty text; rows with equal keys
are repeated alike and dealt by all their columns. Texts are carried whole, other columns
as they are but for ``replica`` and ``mix_key``, which are replaced. An empty table gives an
empty mixture.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm._common import hash53, materialise, maybe_broadcast, without

PART = 8.0
#: Entries of a cumulative distribution of rate PART or less; beyond, it is 1 in doubles.
ENTRIES = 60


def rates(docs: DataFrame, weights: Mapping[str, float] | None, *, source: str = "source", default: float = 1.0, total: float | None = None) -> DataFrame:
    """A row for each source: ``mix_source``, ``n``, ``weight``, ``rate``, ``parts``, ``cdf``."""
    if any(w < 0 for w in [default, *(weights or {}).values()]):
        raise ValueError("weights must not be negative")
    counted = docs.groupBy(F.col(f"`{source}`").cast("string").alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    given = F.lit(None).cast("double")
    for name, w in sorted((weights or {}).items()):
        given = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(given)
    counted = materialise(counted.withColumn("weight", F.coalesce(given, F.lit(float(default)))))  # a row for each source
    sums = counted.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    size = float((sums["n"] or 0) if total is None else total)
    rate = F.lit(size) * F.col("weight") / F.lit(float(sums["w"])) / F.col("n") if sums["w"] else F.lit(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    return counted.withColumn("rate", rate).withColumn("parts", parts).withColumn("cdf", _cumulative(F.col("rate") / F.col("parts")))


def _cumulative(mean: Column) -> Column:
    """[P(0), P(0)+P(1), ...], each probability from the last: p(k) = p(k - 1) * mean / k."""
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES)), first, step, lambda acc: acc["c"])


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, source: str = "source", key: str = "doc_id", default: float = 1.0, total: float | None = None, seed: str = "mix") -> DataFrame:
    """All columns of each copy, ``replica`` (from 0) and ``mix_key``, its place in the shuffle."""
    docs = without(docs, "replica", "mix_key")
    table = rates(docs, weights, source=source, default=default, total=total)
    small = maybe_broadcast(table.select("mix_source", "parts", "cdf"), 16 + 8 * (ENTRIES + 1) + 64)
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    id_ = F.coalesce(F.col(f"d.`{key}`").cast("string"), F.lit(""))
    joined = docs.alias("d").join(small.alias("r"), F.col(f"d.`{source}`").cast("string").eqNullSafe(F.col("r.mix_source")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("r.parts")),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter(F.col("r.cdf"), lambda c: c <= hash53(F.lit(seed), id_, j.cast("string")) / float(1 << 52))),
    )
    copies = joined.select(*names, drawn.alias("replica")).filter("replica > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("replica") - 1)))
    keyed = copies.withColumn("mix_key", hash53(F.lit(seed), F.lit("order"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col("replica").cast("string")))
    # rows with one key (or none) have one place in the order, but need not share a partition
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return keyed.repartition("mix_key", row).sortWithinPartitions("mix_key")
