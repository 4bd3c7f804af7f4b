"""Decisions from scored proposals: plain names, connector names, guards and cutoffs.

A proposal row has adm_party_id, mention_id, mention_text, position, party_id, owner_name,
root_id, root_name, name, type, confidence, collisions, sources, path, the features and
``score``. All ranking is done by windows over a record (or a mention of it); a record has
at most a few hundred proposals, so no window grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions import text as X
from onomast.operators import scoring
from onomast.operators.settle import settle


@dataclass(frozen=True)
class Policy:
    """Cutoffs and switches; ``system`` holds for connector segments, ``plain`` for plain names."""

    system: float = 0.933
    plain: float = 0.80
    margin: float = 0.04
    containment: bool = True
    short_names: bool = True
    multiword: bool = True
    floor: float = 0.40
    short_margin: float = 0.08
    lexical: float = 0.50
    near_band: float = 0.03


SCHEMA = (
    "adm_party_id string, raw_name string, decision string, reason string, confidence double, party_id string, party_name string, member_id string, member_name string, "
    "matched_name string, matched_type string, matched_mention string, method string, tier string, margin double, runner_up_id string, runner_up_score double, "
    "retrieved_roots array<string>, graph_path array<string>, parse_warning string, resolution string, mention_results string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def shaped(df: DataFrame) -> DataFrame:
    """``df`` with exactly the decision columns; missing ones are null."""
    kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def override(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """``decisions`` with the rows of ``new`` in place of those with the same id."""
    return shaped(decisions.join(new.select("adm_party_id"), "adm_party_id", "left_anti")).unionByName(shaped(new))


def support(proposals: DataFrame) -> DataFrame:
    """``adm_party_id, root_id, support``: how many mentions of a record speak for a root."""
    return proposals.groupBy("adm_party_id", "root_id").agg(F.count_distinct("mention_id").alias("support"))


def ranked(proposals: DataFrame, *group: str, target=None) -> DataFrame:
    """The best proposal of each root with its ``target`` score, guard, rank and runner-up.

    ``target(own, runner)`` gives another target score than the rules'; it may use the row's
    exact, collisions, path and ``support``, which is added for it.
    """
    if target is not None:
        counted = support(proposals) if "mention_id" not in group else None
        proposals = proposals.withColumn("support", F.lit(1)) if counted is None else proposals.join(counted, ["adm_party_id", "root_id"])
    best = Window.partitionBy(*group, "root_id").orderBy(F.desc("score"), F.desc("name"), "party_id", "mention_id")
    whole = Window.partitionBy(*group)
    r = proposals.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    r = r.withColumn("identity_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "root_id")))
    r = r.withColumn("first", F.max("score").over(whole)).withColumn("second", F.coalesce(F.max(F.when(F.col("identity_rank") == 2, F.col("score"))).over(whole), F.lit(0.0)))
    r = r.withColumn("target", (target or scoring.target)(F.col("score"), F.when(F.col("identity_rank") == 1, F.col("second")).otherwise(F.col("first")))).withColumn("guard", scoring.guard())
    r = r.withColumn("any_free", F.max(F.col("guard").isNull()).over(whole)).withColumn("pool", F.col("guard").isNull() | ~F.col("any_free"))
    order = Window.partitionBy(*group).orderBy(F.desc("pool"), F.desc("target"), "root_id")
    r = r.withColumn("place", F.row_number().over(order))
    for name, source in (("runner_up_id", "root_id"), ("runner_up_score", "target")):
        r = r.withColumn(name, F.lead(F.when(F.col("pool"), F.col(source))).over(order))
    return r.withColumn("margin", F.col("target") - F.coalesce("runner_up_score", F.lit(0.0)))


def retrieved(proposals: DataFrame) -> DataFrame:
    best = proposals.groupBy("adm_party_id", "root_id").agg(F.max("score").alias("s"))
    return best.groupBy("adm_party_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "root_id"))), lambda x: x["root_id"]).alias("retrieved_roots"))


def as_match(confidence: Column, reason: Column, method: Column, tier: Column) -> dict[str, Column]:
    """Decision columns from the winning proposal."""
    return {
        "decision": F.lit("MATCH"), "reason": reason, "confidence": confidence, "method": method, "tier": tier, "member_id": F.col("party_id"), "member_name": F.col("owner_name"),
        "matched_name": F.col("name"), "matched_type": F.col("type"), "matched_mention": F.col("mention_text"), "graph_path": F.col("path"), "party_id": F.col("root_id"), "party_name": F.col("root_name"),
    }


def decided(winners: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Decision rows from winning proposals: ``columns`` replace proposal columns of the same name."""
    rest = [c for c in winners.columns if c not in columns]
    return shaped(winners.select(*rest, *[v.alias(k) for k, v in columns.items()]))


def plain(records: DataFrame, proposals: DataFrame, policy: Policy, target=None) -> DataFrame:
    """One decision for each record of ``records`` (adm_party_id, raw_name, plain, parse_warning)."""
    top = ranked(proposals, "adm_party_id", target=target).filter("place = 1")
    mine = records.select("adm_party_id", "raw_name", "plain", "parse_warning")
    joined = mine.join(top.drop("raw_name", "plain", "parse_warning"), "adm_party_id").join(retrieved(proposals), "adm_party_id")
    limit = F.when(F.col("plain"), F.lit(policy.plain)).otherwise(F.lit(policy.system))
    contained = F.col("plain") & F.lit(policy.containment) & (F.col("target") < limit) & scoring.containment() & (F.col("margin") >= policy.short_margin)
    joined = settle(joined.withColumn("contained", F.coalesce(contained, F.lit(False))))
    limit = F.when(F.col("contained"), F.least(limit, F.lit(policy.floor))).otherwise(limit)
    reason = (
        F.when(F.col("guard").isNotNull(), F.col("guard"))
        .when(F.col("runner_up_id").isNotNull() & (F.col("margin") < policy.margin), F.when(F.col("collisions") > 1, "CANDIDATE_COLLISION").otherwise("AMBIGUOUS_FINAL_TARGETS"))
        .when(F.col("target") < limit, "INSUFFICIENT_SUPPORT")
        .otherwise("MATCH")
    )
    joined = joined.withColumn("why", reason)
    is_match = F.col("why") == "MATCH"
    contained = is_match & F.col("contained")
    columns = as_match(F.col("target"), F.col("why"), F.when(contained, "rules:unique_containment").otherwise(scoring.method()), F.when(contained, "RULES_UNIQUE_CONTAINMENT").otherwise(scoring.tier()))
    columns["decision"] = F.when(is_match, "MATCH").otherwise("NO_MATCH")
    columns["graph_path"] = F.when(is_match, F.col("path"))
    found = decided(joined, columns)
    missing = mine.join(found.select("adm_party_id"), "adm_party_id", "left_anti")
    none = shaped(missing.select("adm_party_id", "raw_name", "parse_warning", F.lit("NO_MATCH").alias("decision"), F.when(F.trim("raw_name") == "", "EMPTY_NAME").otherwise("NO_CANDIDATES").alias("reason"), F.lit(0.0).alias("confidence")))
    return found.unionByName(none)


def owners(parties: DataFrame, key: Column, explode: bool = False) -> DataFrame:
    """``key, owner, owners``: how many roots have each key, and one of them."""
    named = parties.select((F.explode(key) if explode else key).alias("key"), "root_id").filter("key is not null and key != ''")
    return named.groupBy("key").agg(F.countDistinct("root_id").alias("owners"), F.min("root_id").alias("owner"))


def short_name_indexes(parties: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners of distinctive tokens, and of the prefixes (two words or more) that ``wanted`` (key) names."""
    words = F.filter(X.meaningful(F.col("party_norm")), lambda t: F.length(t) >= 5)
    by_token = owners(parties, words, explode=True)
    t = X.tokens(F.col("party_norm"))
    prefixes = F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(t))), lambda n: F.array_join(F.slice(t, F.lit(1), n), " ")))
    by_prefix = owners(parties.withColumn("k", F.explode(prefixes)).join(wanted.select(F.col("key").alias("k")).distinct(), "k", "left_semi"), F.col("k"))
    return by_token, by_prefix


def with_short_name(proposals: DataFrame, parties: DataFrame, policy: Policy) -> DataFrame:
    """Add ``short_name`` (the mention is a unique short form of this official name) and ``prefix_owners``."""
    by_token, by_prefix = short_name_indexes(parties, proposals.select(F.col("mention_norm").alias("key")))
    p = proposals.join(by_token.select(F.col("key").alias("mention_norm"), F.col("owner").alias("token_owner"), F.col("owners").alias("token_owners")), "mention_norm", "left")
    p = p.join(by_prefix.select(F.col("key").alias("mention_norm"), F.col("owner").alias("prefix_owner"), F.col("owners").alias("prefix_owners")), "mention_norm", "left")
    words, official = X.tokens(F.col("mention_norm")), X.tokens(F.col("norm_name"))
    one = (F.size(words) == 1) & (F.length("mention_norm") >= 5) & (F.col("token_owners") == 1) & (F.col("token_owner") == F.col("root_id")) & F.array_contains(official, F.col("mention_norm"))
    many = (
        (F.size(words) > 1) & F.lit(policy.multiword) & (F.col("collisions") == 1) & (F.concat(F.col("norm_name"), F.lit(" ")).startswith(F.concat(F.col("mention_norm"), F.lit(" "))))
        & (F.length(X.compact(F.col("mention_norm"))) >= 8) & (F.size(official) - F.size(words) <= 2) & (F.col("prefix_owners") == 1) & (F.col("prefix_owner") == F.col("root_id"))
    )
    p = settle(p)
    good = (F.col("type") == "official") & (F.greatest("char", "word") >= policy.lexical)
    return p.withColumn("short_name", F.coalesce(good & (one | many), F.lit(False)))


def connectors(records: DataFrame, mentions: DataFrame, proposals: DataFrame, parties: DataFrame, policy: Policy, target=None) -> DataFrame:
    """Decisions of names joined by OBO or VIA: each segment on its own, the left one preferred."""
    ids = records.select("adm_party_id", "raw_name")
    kinds = mentions.groupBy("adm_party_id").agg(F.collect_set("connector_before").alias("kinds"), F.max(F.coalesce(F.col("parse_warning") == "MALFORMED_CONNECTOR", F.lit(False))).alias("malformed"))
    kinds = ids.join(kinds, "adm_party_id")
    forced = F.when(F.col("malformed"), "MALFORMED_CONNECTOR").when(F.size("kinds") != 1, "MIXED_CONNECTORS_UNSUPPORTED")
    refused = shaped(kinds.withColumn("reason", forced).filter("reason is not null").select("adm_party_id", "raw_name", F.lit("NO_MATCH").alias("decision"), "reason", F.lit(0.0).alias("confidence"), F.col("reason").alias("parse_warning"), F.col("reason").alias("resolution")))
    open_ = kinds.filter(forced.isNull()).select("adm_party_id", "raw_name", F.element_at("kinds", 1).alias("kind"))
    segments = mentions.join(open_, "adm_party_id").select("adm_party_id", "raw_name", "kind", "mention_id", "position", "text")
    tops = ranked(with_short_name(proposals.join(open_.select("adm_party_id"), "adm_party_id", "left_semi"), parties, policy), "adm_party_id", "mention_id", target=target).filter("place = 1")
    tops = settle(tops.drop("raw_name", "position", "plain", "parse_warning", "text"))
    s = segments.join(tops, ["adm_party_id", "mention_id"], "left")
    short = F.coalesce(F.lit(policy.short_names) & F.col("guard").isNull() & (F.col("target") < policy.system) & (F.col("target") >= policy.floor) & (F.col("margin") >= policy.short_margin) & F.col("short_name"), F.lit(False))
    s = s.withColumn("short", short)
    reason = (
        F.when(F.col("root_id").isNull(), "NO_CANDIDATES").when(F.col("guard").isNotNull(), F.col("guard"))
        .when(F.col("runner_up_id").isNotNull() & (F.col("margin") < policy.margin), "AMBIGUOUS_FINAL_TARGETS")
        .when((F.col("target") < policy.system) & ~F.col("short"), "INSUFFICIENT_SUPPORT").otherwise("MATCH")
    )
    s = s.withColumn("why", reason).withColumn("target", F.coalesce("target", F.lit(0.0)))
    special = F.when(F.col("short") & (F.col("why") == "MATCH"), F.when(F.size(X.tokens(F.col("mention_norm"))) > 1, "RULES_ROOT_UNIQUE_CONNECTOR_PREFIX").otherwise("RULES_ROOT_UNIQUE_CONNECTOR_SHORT_NAME"))
    how = F.when(special.isNull(), scoring.method()).when(special == "RULES_ROOT_UNIQUE_CONNECTOR_PREFIX", "rules:root_unique_connector_prefix").otherwise("rules:root_unique_connector_short_name")
    row = F.struct(
        "position", F.col("text").alias("mention"), F.col("why").alias("reason"), F.col("target").alias("confidence"), "root_id", "root_name", F.col("party_id").alias("member_id"), F.col("owner_name").alias("member_name"),
        F.col("name").alias("matched_name"), F.col("type").alias("matched_type"), F.col("runner_up_id"), F.col("runner_up_score"), F.col("margin"), F.col("path"), special.alias("special"), F.coalesce(special, scoring.tier()).alias("tier"), how.alias("method"),
        F.coalesce((F.size(X.tokens(F.col("mention_norm"))) >= 2) & (F.col("prefix_owners") > 1) & (F.col("type") == "official") & (F.greatest("char", "word") >= policy.lexical), F.lit(False)).alias("shared_prefix"),
    )
    g = s.groupBy("adm_party_id", "raw_name", "kind").agg(F.array_sort(F.collect_list(row), lambda a, b: a["position"] - b["position"]).alias("m"))
    valid = F.filter("m", lambda x: x["reason"] == "MATCH")
    g = settle(g.withColumn("valid", valid).withColumn("left", F.element_at("m", 1)))
    left_fails = (F.size("valid") > 0) & (F.col("left.reason") != "MATCH")
    shared = F.lit(policy.short_names and policy.multiword) & left_fails & F.col("left.shared_prefix")
    near = left_fails & F.col("left.reason").isin("INSUFFICIENT_SUPPORT", "AMBIGUOUS_FINAL_TARGETS") & (F.col("left.confidence") >= policy.system - policy.near_band)
    one_root = F.size(F.array_distinct(F.transform("valid", lambda x: x["root_id"]))) == 1
    better = lambda best, x: F.when(best.isNull() | (x["confidence"] > best["confidence"]), x).otherwise(best)
    kind_of = g.schema["m"].dataType.elementType
    strongest = lambda array: F.aggregate(array, F.lit(None).cast(kind_of), better)
    rejected = F.filter("m", lambda x: (x["reason"] != "MATCH") & x["root_id"].isNotNull())
    reasons = F.transform("m", lambda x: x["reason"])
    none_reason = F.when(F.array_contains(reasons, "AMBIGUOUS_FINAL_TARGETS"), "AMBIGUOUS_FINAL_TARGETS").when(F.array_contains(reasons, "INSUFFICIENT_SUPPORT"), "INSUFFICIENT_SUPPORT").otherwise("NO_MENTION_MATCH")
    g = g.withColumn("resolution", F.when(shared, "PREFERRED_NAME_AMBIGUOUS").when(near, "PREFERRED_NEAR_CUTOFF").when(F.size("valid") == 0, "NONE").when(one_root, F.when(F.size("valid") == 1, "ONLY_MATCH").otherwise("SAME_ROOT")).otherwise(F.concat("kind", F.lit("_LEFT"))))
    g = g.withColumn("reason", F.when(shared, "AMBIGUOUS_PREFERRED_VERIFIED_NAME").when(near, "PREFERRED_SEGMENT_NEAR_CUTOFF").when(F.size("valid") == 0, none_reason).otherwise("MATCH"))
    g = g.withColumn("w", F.when(shared | near, F.col("left")).when(F.size("valid") == 0, strongest(rejected)).when(one_root, strongest(F.col("valid"))).otherwise(F.element_at("valid", 1)))
    match = F.col("reason") == "MATCH"
    out = g.join(retrieved(proposals), "adm_party_id", "left").select(
        "adm_party_id", "raw_name", F.when(match, "MATCH").otherwise("NO_MATCH").alias("decision"), "reason", F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"),
        F.col("w.root_id").alias("party_id"), F.col("w.root_name").alias("party_name"), "w.member_id", "w.member_name", "w.matched_name", "w.matched_type", F.col("w.mention").alias("matched_mention"),
        F.col("w.method"), F.col("w.tier"), F.when(match, F.col("w.margin")).alias("margin"), F.when(match, F.col("w.runner_up_id")).alias("runner_up_id"), F.when(match, F.col("w.runner_up_score")).alias("runner_up_score"),
        "retrieved_roots", F.when(match, F.col("w.path")).alias("graph_path"), "resolution",
        F.to_json(F.transform("m", lambda x: F.struct(x["position"].alias("position"), x["mention"].alias("text"), x["reason"].alias("reason"), x["confidence"].alias("confidence"), x["root_id"].alias("root_id"), x["margin"].alias("margin"), x["special"].alias("decision_tier")))).alias("mention_results"),
    )
    return refused.unionByName(shaped(out))


def request_cutoff(decisions: DataFrame, jobs: DataFrame, system: float = 0.0) -> DataFrame:
    """Matches below their job's cutoff (job of the matched member, else the first) are withdrawn.

    ``jobs``: party_id, cutoff, job_order. One job for each party (the last one wins).
    """
    latest = jobs.groupBy("party_id").agg(F.max_by("cutoff", "job_order").alias("cutoff"))
    default = jobs.agg(F.min_by("cutoff", "job_order").alias("c")).first()["c"] or 0.0
    joined = decisions.join(latest.withColumnRenamed("party_id", "job_party"), F.coalesce("member_id", "party_id") == F.col("job_party"), "left")
    limit = F.greatest(F.lit(system), F.coalesce("cutoff", F.lit(float(default))))
    low = (F.col("decision") == "MATCH") & (F.col("confidence") < limit)
    return shaped(joined.withColumns({"decision": F.when(low, "NO_MATCH").otherwise(F.col("decision")), "reason": F.when(low, "BELOW_REQUEST_CUTOFF").otherwise(F.col("reason"))}))
