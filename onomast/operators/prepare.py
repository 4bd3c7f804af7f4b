"""Preparation of labelled names: cleaning, eligibility, leakage-safe splits, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.functions import ids
from onomast.functions import text as X
from onomast.operators.settle import numbered

TRUE = ("1", "true", "yes", "y", "verified")


def find_column(columns: list[str], configured: str | None, candidates: list[str], required: bool = False) -> str | None:
    """The first column whose normalised header is the configured or a candidate name."""
    by_name = {X.plain(c): c for c in reversed(columns)}
    for want in [configured, *candidates]:
        if want and X.plain(want) in by_name:
            return by_name[X.plain(want)]
    if required:
        raise ValueError(f"none of the columns {[configured, *candidates]} is there")
    return None


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE), F.lit(False))


def known(label: Column) -> Column:
    return F.coalesce((F.trim(label) != "") & (F.lower(F.trim(label)) != "unknown"), F.lit(False))


def clean(rows: DataFrame) -> DataFrame:
    """Add ``cleaning``: why a row (raw_name, label, source_row) is dropped, or null.

    Conflicting labels of one raw name come first, then rows that only repeat the label,
    then later repeats of (raw name, label).
    """
    labels = F.collect_set(F.when(known(F.col("label")), F.col("label"))).over(Window.partitionBy("raw_name"))
    first = F.row_number().over(Window.partitionBy("raw_name", "label").orderBy("source_row"))
    rows = rows.withColumn("labels", F.size(labels)).withColumn("nth", first)
    why = F.when(F.col("labels") > 1, "CONFLICTING_LABELS").when(known(F.col("label")) & (F.trim("raw_name") == F.trim("label")), "VERIFIED_SELF_ROW").when(F.col("nth") > 1, "EXACT_DUPLICATE")
    return rows.withColumn("cleaning", why).drop("labels", "nth")


def records(rows: DataFrame, verified: DataFrame, account: str) -> DataFrame:
    """Ids, eligibility and split of cleaned rows (raw_name, label, parent_id, source_row).

    ``verified`` (party_id, party_name): a parent counts as verified by id or by name; a column
    ``parent_verified`` of ``rows`` says so itself where it is filled in.
    """
    names = verified.select(F.col("party_id").alias("k")).unionByName(verified.select(X.normalize(F.col("party_name")).alias("k"))).distinct().withColumn("hit", F.lit(True))
    keyed = rows.withColumn("k", F.col("parent_id")).join(names, "k", "left").withColumnRenamed("hit", "by_id").drop("k")
    keyed = keyed.withColumn("k", X.normalize(F.col("parent_id"))).join(names, "k", "left").drop("k")
    up = F.coalesce(F.col("by_id"), F.col("hit"), F.lit(False))
    if "parent_verified" in rows.columns:
        said = F.trim(F.col("parent_verified").cast("string"))
        up = F.when(F.coalesce(said, F.lit("")) != "", as_bool(said)).otherwise(up)
    out = keyed.withColumn("parent_is_verified", up).drop("by_id", "hit")
    out = out.withColumn("eligible", (F.coalesce(F.trim("parent_id"), F.lit("")) == "") | ~F.col("parent_is_verified"))
    out = out.withColumn("adm_party_id", ids.stable_id("adm", F.lit(account), F.col("source_row"), F.col("raw_name")))
    split = F.when(~F.col("eligible"), "INELIGIBLE").when(~known(F.col("label")), "UNKNOWN").otherwise(ids.split(X.normalize(F.col("label")), X.normalize(F.col("raw_name"))))
    out = out.withColumn("split", split).withColumn("scorable", F.col("eligible") & known(F.col("label")))
    return out.withColumn("exclusion_reason", F.when(~F.col("eligible"), "INELIGIBLE").when(~known(F.col("label")), "UNKNOWN_LABEL"))


def catalog(rows: DataFrame, account: str) -> DataFrame:
    """``party_id, party_name, index``: the known labels in list order."""
    names = rows.filter(known(F.col("label"))).select(F.trim("label").alias("party_name")).distinct()
    placed = numbered(names, [F.lower("party_name"), F.col("party_name")])
    return placed.select(ids.stable_id("verified", F.lit(account), F.col("party_name")).alias("party_id"), "party_name", "index")


def prefix(records: DataFrame, limit: int, order: str = "source_row") -> DataFrame:
    """The first ``limit`` records in source order: a limit the caller asks for."""
    return records.orderBy(order).limit(limit)


def listed(df: DataFrame, verified: str = "party_name", raw: str = "raw_name", key: str = "adm_party_id") -> DataFrame:
    """Rows as they are handed out: by verified name, then written name, both without case, then id."""
    return df.orderBy(F.lower(F.coalesce(verified, F.lit(""))), F.lower(raw), key)


def sample_summary(rows: DataFrame) -> DataFrame:
    """``category, n, names``: how many rows a category has, and their names joined."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("raw_name")), "; ").alias("names"))


#: How the sample writes a canonical name, as (category, pattern of {name} and {base}).
SAMPLE_FORMS = (("verified", "{name}"), ("plain", "{base}"), ("upper", "{upper}"), ("segment", "{base} - Partner"), ("connector", "{name} OBO Public Sector Client"))


def sample(spark: SparkSession, names: list[str]) -> DataFrame:
    """A small labelled table (raw_name, label, parent_id, category, source_row) made of canonical names.

    Each name is written in the forms of ``SAMPLE_FORMS``; besides, there are a child of a
    verified party, an unknown organisation, an unlabelled row and a blank one.
    """
    rows = []
    for name in names:
        base = name.rsplit(" ", 1)[0] if " " in name else name
        rows += [(form.format(name=name, base=base, upper=base.upper()), name, None, category) for category, form in SAMPLE_FORMS]
    rows += [(f"{names[0]} Holdings", f"{names[0]} Holdings", names[0], "child"), ("Riverside Rowing Club", "UNKNOWN", None, "unknown"), ("FES", None, None, "unlabelled"), ("", names[0], None, "blank")]
    return spark.createDataFrame([(*r, i + 2) for i, r in enumerate(rows)], "raw_name string, label string, parent_id string, category string, source_row int")


def jobs(parties: DataFrame, account: str, cutoff: float = 0.0, size: int = 100) -> DataFrame:
    """Shards of ``size`` parties as arrays, one job each."""
    shards = parties.withColumn("shard", ids.shard(F.col("index"), size))
    packed = shards.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "party_id", "party_name"))), lambda x: F.struct(x["party_id"].alias("partyId"), x["party_name"].alias("partyName"))).alias("verifiedParties"))
    return packed.select(F.lit(account).alias("accountId"), F.lit(cutoff).alias("confidenceCutoff"), ids.stable_id("job", F.lit(account), F.col("shard")).alias("jobId"), F.concat(F.col("shard").cast("string"), F.lit(".us")).alias("shardId"), "verifiedParties")


def frame_hash(df: DataFrame) -> str:
    """A hash of all rows that does not depend on their order."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    out = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0)).alias("s")).first()
    return f"{out['n']:x}-{out['x'] & (1 << 64) - 1:x}-{out['s']:x}"
