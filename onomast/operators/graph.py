"""The verified forest: closure, variants, inverted indexes, expansions and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.functions import text as X
from onomast.operators.settle import settle

#: What a snapshot keeps of each party.
SNAPSHOT_COLUMNS = ("party_id string", "party_name string", "parent_id string", "aliases array<struct<name: string, type: string, source: string, confidence: double>>", "suggested_parent string")
SNAPSHOT = ", ".join(SNAPSHOT_COLUMNS)


def closure(parties: DataFrame) -> DataFrame:
    """``party_id, root_id, depth, path`` (from the party up); a cycle raises an error.

    Pointer doubling: each round appends to every open path the path found so far of the party
    where it stands, so a chain of n owners takes log2(n) rounds. Each round is written, and
    only open paths are joined. A parent that is no party ends a path, as its root.
    """
    table = settle(parties.select("party_id", F.array("party_id").alias("path"), F.col("parent_id").alias("next")))
    while True:
        open_ = table.filter("next is not null")
        if open_.isEmpty():
            break
        broken = open_.filter(F.array_contains("path", F.col("next"))).select("next").head(1)
        if broken:
            raise ValueError(f"the hierarchy has a cycle at {broken[0]['next']}")
        up = table.select(F.col("party_id").alias("next"), F.col("path").alias("above"), F.col("next").alias("further"))
        longer = open_.join(up, "next", "left").select("party_id", F.concat("path", F.coalesce("above", F.array("next"))).alias("path"), F.col("further").alias("next"))
        table = settle(table.filter("next is null").unionByName(longer))
    return table.select("party_id", F.element_at("path", -1).alias("root_id"), F.size("path").alias("depth"), "path")


def identity_closure(parties: DataFrame) -> DataFrame:
    return parties.select("party_id", F.col("party_id").alias("root_id"), F.lit(1).alias("depth"), F.array("party_id").alias("path"))


def variants(parties: DataFrame) -> DataFrame:
    """``party_id, name, type, source, confidence``: the official name and the aliases."""
    official = parties.select("party_id", F.col("party_name").alias("name"), F.lit("official").alias("type"), F.lit("official").alias("source"), F.lit(None).cast("double").alias("confidence"))
    if "aliases" not in parties.columns:
        return official
    more = parties.select("party_id", F.explode("aliases").alias("a")).select("party_id", "a.name", "a.type", "a.source", "a.confidence")
    return official.unionByName(more)


def collisions(all_variants: DataFrame) -> DataFrame:
    """``norm_name, collisions``: owners of each normalised name."""
    named = all_variants if "norm_name" in all_variants.columns else all_variants.withColumn("norm_name", X.normalize(F.col("name")))
    return named.select("party_id", "norm_name").filter("norm_name != ''").groupBy("norm_name").agg(F.countDistinct("party_id").alias("collisions"))


def add_parties(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by id: new parties are added, known ones renamed in place; repeating it changes nothing."""
    new = incoming.select("party_id", F.col("party_name").alias("new_name")).dropDuplicates(["party_id"])
    merged = snapshot.join(new, "party_id", "full")
    return merged.select("party_id", F.coalesce("new_name", "party_name").alias("party_name"), *[c for c in snapshot.columns if c not in ("party_id", "party_name")])


def apply_expansions(parties: DataFrame, expansions: DataFrame) -> DataFrame:
    """``party_id, name, type, source, confidence``: aliases worth keeping.

    Without blanks and the party's own name; one alias for each normalised name, the most confident.
    """
    named = expansions.withColumn("norm", X.normalize(F.col("name"))).join(parties.select("party_id", X.normalize(F.col("party_name")).alias("own")), "party_id").filter("norm != '' and norm != own")
    best = Window.partitionBy("party_id", "norm").orderBy(F.desc_nulls_last("confidence"), "name")
    return named.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("party_id", "name", "type", "source", "confidence")


def correlate(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (ref, at, ...) with the ``party_id`` of the request (ref, party_id); of several the first in order."""
    first = Window.partitionBy("ref").orderBy("at")
    one = answers.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "at")
    return requests.select("ref", "party_id").join(one, "ref").drop("ref")


def validate_expansions(raw: DataFrame, minimum: float = 0.70) -> DataFrame:
    """Candidates of a known type with a probability in [0, 1] above the floor.

    Where a suggested parent stands beside them (``parent_name``), its name is no alias.
    """
    p = F.col("confidence").try_cast("double")
    p = F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    if "parent_name" in raw.columns:
        raw = raw.filter(~F.coalesce(X.normalize(F.col("name")) == X.normalize(F.col("parent_name")), F.lit(False)))
    return raw.withColumn("confidence", p).filter(F.col("type").isin("official", "abbreviation", "alias", "former_name", "trade_name", "brand") & (F.col("confidence") >= minimum))


def pending_parents(parties: DataFrame, suggested: DataFrame) -> DataFrame:
    """Suggestions (party_id, parent_name) still open: a blank name is none, a party with a parent keeps it."""
    blank = F.coalesce(F.trim("parent_name"), F.lit("")) == ""
    free = parties.filter("parent_id is null").select("party_id")
    return suggested.filter(~blank).join(free, "party_id", "left_semi").select("party_id", F.trim("parent_name").alias("parent_name"))


def reconcile_parents(spark: SparkSession, parties: DataFrame, suggested: DataFrame) -> DataFrame:
    """``party_id, parent_id`` of suggested parents that name exactly one other party.

    Candidates come from joins on full and base names. Only parties without a parent take one,
    and one each, so the new edges together with the old make at most one cycle where they
    meet. Taken in the order of child ids, of each cycle just the last edge would be refused:
    that is the one of its largest child. Cycles are found by pointer doubling from child to
    the root its parent hangs under; nothing is gathered on the driver.
    """
    keys = lambda name: F.explode(F.array_distinct(F.array(X.normalize(name), X.base(X.normalize(name)))))
    index = parties.select("party_id", keys(F.col("party_name")).alias("key")).filter("key != ''")
    wanted = pending_parents(parties, suggested).select(F.col("party_id").alias("child"), keys(F.col("parent_name")).alias("key"))
    found = wanted.join(index, "key").filter("child != party_id").groupBy("child").agg(F.min("party_id").alias("parent"), F.max("party_id").alias("other")).filter("parent = other").drop("other")
    edges = settle(found)
    roots = closure(parties).select(F.col("party_id").alias("parent"), F.col("root_id").alias("next"))
    children = edges.select(F.col("child").alias("next"))
    steps = settle(edges.join(roots, "parent").join(children, "next", "left_semi").select("child", "next", F.col("child").alias("largest")))
    for _ in range(max(1, steps.count()).bit_length() + 1):
        if steps.isEmpty():
            break
        up = steps.select(F.col("child").alias("next"), F.col("next").alias("further"), F.col("largest").alias("above"))
        steps = settle(steps.join(up, "next").select("child", F.col("further").alias("next"), F.greatest("largest", "above").alias("largest")))
    # whoever still goes on stands before or on a cycle; what they reach is on it
    on = steps.select(F.col("next").alias("child")).distinct()
    last = steps.join(on, "child", "left_semi").filter("child = largest").select("child")
    return edges.join(last, "child", "left_anti").select(F.col("child").alias("party_id"), F.col("parent").alias("parent_id"))


def with_parents(parties: DataFrame, edges: DataFrame) -> DataFrame:
    """``parties`` with the parents of ``edges`` (party_id, parent_id) where they had none."""
    new = edges.select("party_id", F.col("parent_id").alias("new_parent"))
    kept = [c for c in parties.columns if c != "parent_id"]
    return parties.join(new, "party_id", "left").select(*kept, F.coalesce("parent_id", "new_parent").alias("parent_id"))


def one_party(parties: DataFrame, party_id: str) -> DataFrame:
    """The graph of one party alone, without parents: what it has to say for itself."""
    return parties.filter(F.col("party_id") == party_id).withColumn("parent_id", F.lit(None).cast("string"))


def in_scope(parties: DataFrame, scope: DataFrame) -> DataFrame:
    """The parties of ``scope`` (party_id), with parents that are in scope as well, and no others."""
    kept = parties.join(scope.select("party_id").distinct(), "party_id", "left_semi")
    up = kept.select(F.col("party_id").alias("parent_id"), F.lit(True).alias("there"))
    rest = [c for c in parties.columns if c != "parent_id"]
    return kept.join(up, "parent_id", "left").select(*rest, F.when(F.col("there"), F.col("parent_id")).alias("parent_id"))


def load_snapshot(spark: SparkSession, path: str, account: str, schema: str = SNAPSHOT) -> DataFrame:
    """The parties of the last snapshot, none where there is none; another account's is an error."""
    try:
        versions = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    last = versions.agg(F.max("version").alias("v")).first()["v"]
    rows = versions.filter(F.col("version") == last)
    other = rows.filter(~F.col("account_id").eqNullSafe(F.lit(account))).select("account_id").head(1)
    if other:
        raise ValueError(f"the snapshot belongs to account {other[0]['account_id']}")
    return rows.filter("party_id is not null").drop("account_id", "version")


def save_snapshot(parties: DataFrame, path: str, account: str) -> bool:
    """Write ``parties`` as a new version if they differ from the last one; whether it was written.

    A version is a directory of its own, so a run that fails leaves the last one whole.
    """
    spark = parties.sparkSession
    kinds = dict(c.split(" ", 1) for c in SNAPSHOT_COLUMNS)
    now = parties.select(*[(F.col(c) if c in parties.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    old = load_snapshot(spark, path, account)
    count = lambda df: df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    if tuple(count(now)) == tuple(count(old.select(*now.columns))):
        return False
    try:
        version = (spark.read.parquet(path).agg(F.max("version").alias("v")).first()["v"] or 0) + 1
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        version = 1
    now.withColumn("account_id", F.lit(account)).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")
    return True
