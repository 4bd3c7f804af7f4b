"""Read-only suggestions: the name-only engine, scopes, snapshots and family audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions import text as X
from onomast.functions import vocab


def intake(records: DataFrame) -> DataFrame:
    """``records`` (eligible, is_verified, raw_name) with ``why`` they are left out; null: they take part."""
    out = ~F.coalesce("eligible", F.lit(False)) | F.coalesce("is_verified", F.lit(False))
    return records.withColumn("why", F.when(out, "INELIGIBLE_OR_VERIFIED").when(F.trim(F.coalesce("raw_name", F.lit(""))) == "", "BLANK"))


def family_index(mentions: DataFrame) -> DataFrame:
    """``token, adm_party_id, mention_text``: records by the first meaningful word of their preferred mention.

    The preferred mention is the first; names with a parse warning or several kinds of
    connectors are left out. Narrower than a fuzzy search: a party that stands behind a
    connector only is not found.
    """
    kinds = F.size(F.collect_set("connector_before"))
    g = mentions.groupBy("adm_party_id").agg(F.min_by("text", "position").alias("mention_text"), kinds.alias("kinds"), F.count("parse_warning").alias("warnings"))
    first = F.try_element_at(X.name_tokens(F.col("mention_text")), F.lit(1))
    return g.filter("kinds <= 1 and warnings = 0").select(first.alias("token"), "adm_party_id", "mention_text").filter("token is not null")


def indexed(verified: DataFrame) -> DataFrame:
    """``party_id, party_name, words, form, anchor``, ready to join on the anchor."""
    return verified.select("party_id", "party_name", X.name_tokens(F.col("party_name")).alias("words"), X.stated_form(F.col("party_name")).alias("form")).withColumn("anchor", F.try_element_at("words", F.lit(1))).filter("anchor is not null")


def _telling(word: Column) -> Column:
    return (F.length(word) >= 5) & ~word.isin(vocab.GENERIC)


def evidence(raw: Column, raw_form: Column, words: Column, form: Column) -> tuple[Column, Column]:
    """(score, reason) of two token arrays with the same first word."""
    same = F.array_join(raw, " ") == F.array_join(words, " ")
    starts = F.concat(F.array_join(raw, " "), F.lit(" ")).startswith(F.concat(F.array_join(words, " "), F.lit(" "))) & (F.size(raw) > F.size(words))
    first = F.try_element_at(words, F.lit(1))
    longer = starts & ((F.size(words) > 1) | _telling(first))
    score = F.when(same & (raw_form != "") & (raw_form == form), 105).when(same, 100).when(longer, 85).when(_telling(first), 55).otherwise(0)
    reason = F.when(score == 105, "same meaningful name and stated legal form").when(score == 100, "same meaningful name (legal form/punctuation may differ)").when(score == 85, "full verified name followed by extra words").when(score == 55, "shared distinctive leading name; relationship unverified")
    return score, reason


def suggest(names: DataFrame, verified: DataFrame) -> DataFrame:
    """``adm_party_id, status, party_id, party_name, evidence, alternatives`` for each name.

    An equi-join on the first meaningful word; scores are added up per record, so no tie is
    broken by chance and at most five alternatives are kept.
    """
    asked = names.select("adm_party_id", X.name_tokens(F.col("raw_name")).alias("raw"), X.stated_form(F.col("raw_name")).alias("raw_form")).withColumn("anchor", F.try_element_at("raw", F.lit(1)))
    pairs = asked.filter("anchor is not null").join(indexed(verified), "anchor")
    score, reason = evidence(F.col("raw"), F.col("raw_form"), F.col("words"), F.col("form"))
    scored = pairs.withColumn("score", score).filter("score > 0").withColumn("reason", reason)
    place = Window.partitionBy("adm_party_id").orderBy(F.desc("score"), F.lower("party_name"), "party_id")
    top = scored.withColumn("best", F.max("score").over(Window.partitionBy("adm_party_id"))).filter("score = best").withColumn("rn", F.row_number().over(place))
    g = top.groupBy("adm_party_id").agg(F.count(F.lit(1)).alias("ties"), F.max(F.when(F.col("rn") == 1, F.col("party_id"))).alias("p"), F.max(F.when(F.col("rn") == 1, F.col("party_name"))).alias("n"), F.max(F.when(F.col("rn") == 1, F.col("reason"))).alias("r"), F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "party_name")))).alias("names"))
    out = names.select("adm_party_id").join(g, "adm_party_id", "left")
    tie, none = F.col("ties") > 1, F.col("ties").isNull()
    return out.select(
        "adm_party_id", F.when(none, "NONE").when(tie, "AMBIGUOUS").otherwise("SUGGESTED").alias("status"),
        F.when(~none & ~tie, F.col("p")).otherwise("").alias("party_id"), F.when(~none & ~tie, F.col("n")).otherwise("").alias("party_name"),
        F.when(none, "No supported name anchor").when(tie, "Multiple verified names have equal name evidence").otherwise(F.col("r")).alias("evidence"),
        F.when(tie, F.transform("names", lambda x: x["party_name"])).otherwise(F.array().cast("array<string>")).alias("alternatives"),
    )


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """How each record's suggestion changed when the catalog grew."""
    b = before.select("adm_party_id", F.col("status").alias("s0"), F.col("party_id").alias("p0"))
    a = after.select("adm_party_id", F.col("status").alias("s1"), F.col("party_id").alias("p1"))
    was, now = F.col("s0"), F.col("s1")
    label = (
        F.when((was == "NONE") & (now == "SUGGESTED"), "NEW_SUGGESTION").when((was == "SUGGESTED") & (now == "SUGGESTED") & (F.col("p0") != F.col("p1")), "MOVED_SUGGESTION")
        .when((was == "SUGGESTED") & (now == "AMBIGUOUS"), "NOW_AMBIGUOUS").when((was == "SUGGESTED") & (now == "NONE"), "WITHDRAWN").when((was == "AMBIGUOUS") & (now == "SUGGESTED"), "AMBIGUITY_RESOLVED").otherwise("UNCHANGED")
    )
    return b.join(a, "adm_party_id").withColumn("change", label)


def verified_relations(verified: DataFrame) -> DataFrame:
    """Pairs of verified names that look like duplicates, and name families by anchor.

    Equal names are joined by their tokens; a family is one row with its members counted,
    not all its pairs.
    """
    x = indexed(verified).withColumn("key", F.array_join("words", " "))
    dup = x.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("party_id").alias("first_id"), F.max("party_id").alias("last_id")).filter("members > 1").select(F.lit("POSSIBLE_DUPLICATE_NAME").alias("relation"), "key", "members", "first_id", "last_id")
    family = x.filter(_telling(F.col("anchor"))).groupBy(F.col("anchor").alias("key")).agg(F.countDistinct(F.array_join("words", " ")).alias("names"), F.count(F.lit(1)).alias("members"), F.min("party_id").alias("first_id"), F.max("party_id").alias("last_id")).filter("names > 1").select(F.lit("POSSIBLE_NAME_FAMILY").alias("relation"), "key", "members", "first_id", "last_id")
    return dup.unionByName(family)


def scope(names: DataFrame, smallest: int = 2, groups: int = 50, focus: list[str] | None = None) -> DataFrame:
    """The records of the largest leading-word groups, or of those of focus names."""
    keyed = names.withColumn("anchor", F.try_element_at(X.name_tokens(F.col("raw_name")), F.lit(1))).filter("anchor is not null")
    if focus:
        wanted = sorted({X.plain(f).split()[0] for f in focus if X.plain(f)})
        return keyed.filter(F.col("anchor").isin(wanted))
    top = keyed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= smallest).orderBy(F.desc("n"), "anchor").limit(groups)
    return keyed.join(top.select("anchor"), "anchor", "left_semi")


def representatives(names: DataFrame) -> DataFrame:
    """For each family the name with the fewest, then shortest words."""
    keyed = names.withColumn("words", X.name_tokens(F.col("raw_name"))).withColumn("anchor", F.try_element_at("words", F.lit(1))).filter("anchor is not null")
    first = Window.partitionBy("anchor").orderBy(F.size("words"), F.length("raw_name"), F.lower("raw_name"), "adm_party_id")
    return keyed.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("anchor", "adm_party_id", "raw_name")


def review(proposals: DataFrame, decisions: DataFrame, score: float = 0.45, lexical: float = 0.45, band: float = 0.08, most: int = 3) -> DataFrame:
    """Candidates worth a look for records without a match: near the top and above the floors."""
    open_ = proposals.join(decisions.filter("decision != 'MATCH'").select("adm_party_id"), "adm_party_id", "left_semi")
    best = open_.groupBy("adm_party_id", "root_id", "root_name").agg(F.max("score").alias("score"), F.max(F.greatest("char", "word")).alias("lexical"), F.max("digit_conflict").alias("digits"))
    best = best.filter((F.col("score") >= score) & (F.col("lexical") >= lexical) & (F.col("digits") == 0))
    best = best.withColumn("top", F.max("score").over(Window.partitionBy("adm_party_id"))).filter(F.col("score") >= F.col("top") - band)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("adm_party_id").orderBy(F.desc("score"), "root_id"))).filter(F.col("place") <= most).drop("top", "digits")


def transition(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two snapshots' decisions by record: MOVED, LOST_STRONG, NEW_STRONG, REVIEW_CHANGED, UNCHANGED."""
    pick = lambda d, s: d.select("adm_party_id", F.when(F.col("decision") == "MATCH", F.col("party_id")).alias(f"strong{s}"), F.col("party_id").alias(f"any{s}"))
    both = pick(before, 0).join(pick(after, 1), "adm_party_id", "full")
    s0, s1 = F.col("strong0"), F.col("strong1")
    label = F.when(s0.isNotNull() & s1.isNotNull() & (s0 != s1), "MOVED").when(s0.isNotNull() & s1.isNull(), "LOST_STRONG").when(s0.isNull() & s1.isNotNull(), "NEW_STRONG").when(s0.isNull() & ~F.col("any0").eqNullSafe(F.col("any1")), "REVIEW_CHANGED").otherwise("UNCHANGED")
    return both.withColumn("transition", label)


def withhold(verified: DataFrame, withheld: DataFrame) -> DataFrame:
    """The catalog as it was before the parties of ``withheld`` (party_id) came."""
    return verified.join(withheld.select("party_id").distinct(), "party_id", "left_anti")


def coverage(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many names have a strong suggestion, only candidates for review, or nothing."""
    strong = F.col("decision") == "MATCH"
    some = decisions.select("adm_party_id", "decision").join(candidates.select("adm_party_id").distinct().withColumn("review", F.lit(True)), "adm_party_id", "left")
    only = ~strong & F.coalesce("review", F.lit(False))
    g = some.agg(F.count(F.lit(1)).alias("n_names"), F.count_if(strong).alias("strong_names"), F.count_if(only).alias("review_only_names"))
    rest = F.col("n_names") - F.col("strong_names") - F.col("review_only_names")
    return g.withColumn("no_suggestion_names", rest).withColumn("suggestion_coverage", F.when(F.col("n_names") > 0, 1 - rest / F.col("n_names")))


def two_snapshots(names: DataFrame, verified: DataFrame, withheld: DataFrame, build) -> dict[str, DataFrame]:
    """The same names against the catalog without the withheld parties, then with them.

    ``build(names, verified)`` gives (decisions, review candidates). Returned: ``changes`` by
    record, ``movements`` (their counts), ``before`` and ``after`` (coverage).
    """
    early, early_review = build(names, withhold(verified, withheld))
    late, late_review = build(names, verified)
    moved = transition(early, late)
    return {"changes": moved.filter("transition != 'UNCHANGED'"), "movements": moved.groupBy("transition").agg(F.count(F.lit(1)).alias("n")), "before": coverage(early, early_review), "after": coverage(late, late_review)}


def label_gaps(candidates: DataFrame, indexed_: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pairs (adm_party_id, party_id) that are no candidates: never indexed, or indexed and not qualified."""
    known = labels.filter("scorable").select("adm_party_id", F.col("expected").alias("party_id"), "split")
    missed = known.join(candidates.select("adm_party_id", "party_id"), ["adm_party_id", "party_id"], "left_anti")
    seen = indexed_.select("adm_party_id", "party_id").distinct().withColumn("seen", F.lit(True))
    return missed.join(seen, ["adm_party_id", "party_id"], "left").select("adm_party_id", "party_id", "split", F.when(F.col("seen"), "INDEXED_BUT_NOT_FAMILY_QUALIFIED").otherwise("NOT_RETRIEVED_FOR_PARTY").alias("reason"))


def audit(pairs: DataFrame, indexed_: DataFrame, labels: DataFrame, verified: DataFrame) -> DataFrame:
    """Each party's figures: pairs by status, known labels and their gaps, held-out precision and recall.

    ``pairs``: adm_party_id, party_id, status; ``labels``: adm_party_id, expected, split, scorable.
    """
    from onomast.operators.evaluate import HELD_OUT, ratio

    known = labels.filter("scorable").select("adm_party_id", F.col("expected").alias("party_id"), F.col("split").isin(*HELD_OUT).alias("held"))
    heldout_rows = labels.filter(F.col("scorable") & F.col("split").isin(*HELD_OUT)).select("adm_party_id", F.lit(True).alias("judged"))
    strong = F.col("status") == "STRONG"
    j = pairs.join(known, ["adm_party_id", "party_id"], "left").join(heldout_rows, "adm_party_id", "left")
    g = j.groupBy("party_id").agg(
        F.count(F.lit(1)).alias("candidate_pairs"), *[F.count_if(F.col("status") == x).alias(f"n_{x.lower()}") for x in ("STRONG", "REVIEW", "DROPPED")],
        F.count_if(F.col("held")).alias("held_out_found"), F.count_if(strong & F.col("held")).alias("held_out_right"), F.count_if(strong & F.coalesce("judged", F.lit(False))).alias("held_out_strong"),
    )
    have = known.groupBy("party_id").agg(F.count(F.lit(1)).alias("known_labels"), F.count_if("held").alias("held_out_labels"))
    gaps = label_gaps(pairs, indexed_, labels).groupBy("party_id").agg(F.count_if(F.col("reason") == "NOT_RETRIEVED_FOR_PARTY").alias("index_misses"), F.count_if(F.col("reason") != "NOT_RETRIEVED_FOR_PARTY").alias("gate_exclusions"))
    out = verified.select("party_id", "party_name").join(g, "party_id", "left").join(have, "party_id", "left").join(gaps, "party_id", "left")
    out = out.fillna(0, [c for c in out.columns if c not in ("party_id", "party_name")])
    return out.withColumns({"held_out_candidate_recall": ratio(F.col("held_out_found"), F.col("held_out_labels")), "held_out_strong_precision": ratio(F.col("held_out_right"), F.col("held_out_strong")), "held_out_strong_recall": ratio(F.col("held_out_right"), F.col("held_out_labels"))}).drop("held_out_found", "held_out_right", "held_out_strong")


def independent(proposals: DataFrame, records: DataFrame, decisions: DataFrame, policy) -> DataFrame:
    """Each party judged on its own: ``adm_party_id, party_id, status, why``.

    One plan over all parties: proposals are grouped by owner instead of competing roots,
    then compared with where the record finally went.
    """
    from onomast.operators import decide

    own = proposals.withColumn("root_id", F.col("party_id")).withColumn("root_name", F.col("owner_name")).withColumn("collisions", F.lit(1).cast("long")).withColumn("pair", F.concat_ws("|", "adm_party_id", "party_id"))
    best = decide.ranked(own, "pair").filter("place = 1")
    final = decisions.select("adm_party_id", F.col("decision").alias("d"), F.coalesce("member_id", "party_id").alias("assigned"), F.col("party_id").alias("final_root"))
    j = best.select("adm_party_id", "party_id", "target", "guard", "score", "mention_norm", "norm_name", "exact", "base_exact", F.greatest("char", "word").alias("lexical")).join(final, "adm_party_id").withColumn("similarity", X.sequence_ratio(X.compact(F.col("mention_norm")), X.compact(F.col("norm_name"))))
    accepted = F.col("target") >= policy.plain
    proof = (F.col("exact") == 1) | (F.col("base_exact") == 1) | ((F.col("score") >= 0.85) & (F.col("lexical") >= 0.70))
    here = (F.col("d") == "MATCH") & ((F.col("assigned") == F.col("party_id")) | (F.col("final_root") == F.col("party_id")))
    status = F.when(here | (accepted & proof & (F.col("d") != "MATCH")), "STRONG").when(F.col("d") == "MATCH", "DROPPED").when(F.col("guard").isNotNull(), "DROPPED").when(accepted, "REVIEW").when((F.col("score") >= 0.45) & (F.col("lexical") >= 0.45), "REVIEW").when(F.col("similarity") >= 0.42, "REVIEW").otherwise("DROPPED")
    why = F.when(status == "STRONG", "ACCEPTED").when((F.col("d") == "MATCH") & ~here, "ASSIGNED_TO_OTHER_PARTY").when(F.col("guard").isNotNull(), F.col("guard")).when(status == "REVIEW", "REVIEW_EVIDENCE").otherwise("BELOW_REVIEW_EVIDENCE")
    return j.select("adm_party_id", "party_id", status.alias("status"), why.alias("why"), "score", "lexical")


def party_counts(pairs: DataFrame, verified: DataFrame) -> DataFrame:
    """How many names each party has strong, for review and dropped, zero rows included."""
    g = pairs.groupBy("party_id").agg(F.count_if(F.col("status") == "STRONG").alias("n_strong"), F.count_if(F.col("status") == "REVIEW").alias("n_review"), F.count_if(F.col("status") == "DROPPED").alias("n_dropped"))
    return verified.select("party_id", "party_name").join(g, "party_id", "left").fillna(0, ["n_strong", "n_review", "n_dropped"])
