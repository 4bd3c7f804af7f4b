"""Evaluation: metric packs by cohort, bins, funnels, sweeps and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.operators.settle import numbered


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share; null without trials."""
    p, n = hits / total, total.cast("double")
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), low)), F.when(total > 0, F.least(F.lit(1.0), high))


def judged(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Decisions with ``expected`` (root id), ``scorable``, ``matched``, ``correct`` and ``retrieved``."""
    d = decisions.join(labels.drop("raw_name"), "adm_party_id", "left").withColumn("scorable", F.coalesce("scorable", F.lit(False)))
    d = d.withColumn("matched", F.col("decision") == "MATCH")
    d = d.withColumn("correct", F.col("matched") & F.col("scorable") & F.coalesce(F.col("party_id") == F.col("expected"), F.lit(False)))
    return d.withColumn("retrieved", F.col("scorable") & F.coalesce(F.array_contains("retrieved_roots", F.col("expected")), F.lit(False)))


def pack(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, matches, precision, recall, F1, coverage, retrieval recall and the interval of precision."""
    count = lambda c: F.count_if(c)
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), count(F.col("scorable")).alias("n_scorable"), count(F.col("matched")).alias("n_matched"), count(F.col("matched") & F.col("scorable")).alias("n_judged"), count(F.col("correct")).alias("n_correct"), count(F.col("retrieved")).alias("n_retrieved"))
    p, r = ratio(F.col("n_correct"), F.col("n_judged")), ratio(F.col("n_correct"), F.col("n_scorable"))
    low, high = wilson(F.col("n_correct"), F.col("n_judged"))
    return g.withColumns({"precision_": p, "recall_": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)), "coverage": ratio(F.col("n_matched"), F.col("n_rows")), "retrieval_recall": ratio(F.col("n_retrieved"), F.col("n_scorable")), "precision_low": low, "precision_high": high})


def pack_by_tags(rows: DataFrame, tags: Column) -> DataFrame:
    """The same for multi-valued cohort tags."""
    return pack(rows.withColumn("cohort", F.explode(tags)), "cohort")


def cohorts() -> Column:
    """The connector cohorts of a decided row: found_case, decision, reason, resolution; several may hold."""
    obo, via = F.col("found_case").isin("OBO", "MIXED"), F.col("found_case").isin("VIA", "MIXED")
    way = F.coalesce("resolution", F.lit(""))
    tags = {
        "ALL_HELD_OUT": F.lit(True), "NO_OBO": ~obo, "NO_VIA": ~via, "PLAIN": ~obo & ~via, "OBO_ONLY": obo & ~via, "VIA_ONLY": via & ~obo, "OBO_AND_VIA": obo & via,
        "CONNECTOR_ONE_VALID": way == "ONLY_MATCH", "CONNECTOR_SAME_ROOT": way == "SAME_ROOT", "CONNECTOR_CONFLICT": way.startswith("OBO_") | way.startswith("VIA_"),
        "CONNECTOR_ABSTAINED": (obo | via) & (F.col("decision") == "NO_MATCH"), "PREFERRED_NEAR_CUTOFF": F.coalesce(F.col("reason") == "PREFERRED_SEGMENT_NEAR_CUTOFF", F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(c, name) for name, c in tags.items()]))


def case_types(raw: Column, found_case: Column) -> Column:
    """Tags of a raw name; GENERAL if there is none."""
    tags = F.array_compact(F.array(F.when(found_case != "PLAIN", found_case), F.when(raw.rlike("[0-9]"), "DIGITS"), F.when(raw.contains("("), "PARENTHESES"), F.when(raw.rlike(r"\s-\s|\|"), "SEGMENTS"), F.when(~raw.contains(" "), "ONE_WORD"), F.when(F.upper(raw) == raw, "UPPER_CASE")))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("GENERAL")))


def bins(rows: DataFrame, width: float = 0.1) -> DataFrame:
    """Matches by confidence bin; the last one is closed."""
    top = round(1 / width) - 1
    return rows.filter("matched").withColumn("bin", F.least(F.floor(F.round(F.col("confidence") / width, 9)), F.lit(top)).cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if(F.col("scorable")).alias("n_judged"), F.count_if("correct").alias("n_correct"))


def funnel(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("scorable").alias("n_scorable"), F.count_if("retrieved").alias("n_retrieved"), F.count_if(F.col("scorable") & (F.col("matched"))).alias("n_decided"), F.count_if("correct").alias("n_correct"))


def expected_rank() -> Column:
    """The place (from 1) of the expected root among those retrieved; null if it is not there."""
    place = F.array_position("retrieved_roots", F.col("expected"))
    return F.when(F.col("scorable") & (place > 0), place.cast("int"))


def unknown_stats(rows: DataFrame) -> DataFrame:
    """How often and how surely rows without a known label are matched."""
    hit = F.col("decision") == "MATCH"
    g = rows.filter(~F.col("scorable")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_matches"), F.avg(F.when(hit, F.coalesce("confidence", F.lit(0.0)))).alias("average_confidence"))
    return g.withColumn("n_no_matches", F.col("n_rows") - F.col("n_matches")).withColumn("prediction_rate", ratio(F.col("n_matches"), F.col("n_rows")))


def no_match_reasons(rows: DataFrame) -> DataFrame:
    return rows.filter("decision = 'NO_MATCH'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def counterfactuals(rules: DataFrame, prior: DataFrame, labels: DataFrame) -> DataFrame:
    """What the rules would reach without a stage: a row each for all of them, without the core
    anchor, for the prior rules, and for these without containment. ``labels`` are the scorable rows."""
    known = labels.filter("scorable").select("adm_party_id", "expected")
    total = known.agg(F.count(F.lit(1)).alias("n_scorable"))
    tier = F.coalesce("tier", F.lit(""))
    variants = {"RULES_ONLY": rules, "BEFORE_CORE_ANCHOR": rules.filter(tier != "RULES_SAFE_VIEW_CORE_ANCHOR"), "PRIOR_RULES": prior, "WITHOUT_CONTAINMENT": prior.filter(tier != "RULES_UNIQUE_CONTAINMENT")}
    every = None
    for name, df in variants.items():
        one = df.filter("decision = 'MATCH'").select(F.lit(name).alias("variant"), "adm_party_id", "party_id")
        every = one if every is None else every.unionByName(one)
    named = rules.sparkSession.createDataFrame([(n,) for n in variants], "variant string")
    g = every.join(known, "adm_party_id").groupBy("variant").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(F.col("party_id") == F.col("expected")).alias("n_correct"))
    g = named.join(g, "variant", "left").fillna(0, ["n_matches", "n_correct"]).join(F.broadcast(total))  # one row
    p, r = ratio(F.col("n_correct"), F.col("n_matches")), ratio(F.col("n_correct"), F.col("n_scorable"))
    return g.withColumns({"precision_": p, "recall_": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r))})


def containment(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """Matches by unique containment and how many are right, by split of the scorable rows."""
    hit = rules.filter("decision = 'MATCH' and tier = 'RULES_UNIQUE_CONTAINMENT'").join(labels.filter("scorable").select("adm_party_id", "expected", "split"), "adm_party_id")
    g = hit.groupBy("split").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(F.col("party_id") == F.col("expected")).alias("n_correct"))
    return g.withColumn("precision_", ratio(F.col("n_correct"), F.col("n_matches")))


HELD_OUT = ("TEST_KNOWN", "TEST_UNSEEN")


def held_out_check(strong: DataFrame, review: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of strong suggestions (adm_party_id, party_id), and precision of review
    candidates, on the held-out scorable rows of ``labels``; labels select nothing else."""
    known = labels.filter(F.col("scorable") & F.col("split").isin(*HELD_OUT)).select("adm_party_id", "expected")
    right = F.col("party_id") == F.col("expected")
    one = strong.join(known, "adm_party_id").agg(F.count(F.lit(1)).alias("strong_matches"), F.count_if(right).alias("strong_correct"))
    two = review.join(known, "adm_party_id").agg(F.count(F.lit(1)).alias("review_rows"), F.count_if(right).alias("review_correct"), F.count_distinct(F.when(right, F.col("adm_party_id"))).alias("review_names"))
    g = known.agg(F.count(F.lit(1)).alias("labeled_rows")).join(F.broadcast(one)).join(F.broadcast(two))  # one row each
    return g.withColumns({"strong_precision": ratio(F.col("strong_correct"), F.col("strong_matches")), "strong_recall": ratio(F.col("strong_correct"), F.col("labeled_rows")), "review_precision": ratio(F.col("review_correct"), F.col("review_rows"))})


def macro_recall(rows: DataFrame) -> DataFrame:
    each = rows.filter("scorable").groupBy("expected").agg((F.count_if("correct") / F.count(F.lit(1))).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("n_entities"), F.avg("r").alias("macro_recall"))


def error_bucket() -> Column:
    return (
        F.when(~F.col("scorable"), "NOT_SCORABLE").when(F.col("correct"), "CORRECT").when(F.col("matched"), "WRONG_MATCH")
        .when(~F.col("retrieved"), "RETRIEVAL_MISS").when(F.col("reason").isin("DIGIT_CONFLICT", "DISTINCTIVE_TOKEN_CONFLICT"), "EXPECTED_GUARDED")
        .when(F.col("reason").isin("AMBIGUOUS_FINAL_TARGETS", "CANDIDATE_COLLISION"), "AMBIGUITY").when(F.col("reason") == "INSUFFICIENT_SUPPORT", "SUPPORT_REJECTION").otherwise("OTHER")
    )


def sweep(rows: DataFrame, start: float = 0.60, stop: float = 0.90, step: float = 0.05) -> DataFrame:
    """What each lower cutoff would add: a cumulative sum over the scores' bins, no join."""
    count = round((stop - start) / step)
    cut = F.least(F.floor(F.round((F.col("confidence") - start) / step, 9)), F.lit(count))
    by = rows.filter((F.col("confidence") >= start) & F.col("party_id").isNotNull()).withColumn("cut", cut.cast("int")).groupBy("cut").agg(F.count_if("scorable").alias("n"), F.count_if(F.col("scorable") & (F.col("party_id") == F.col("expected"))).alias("c"))
    down = Window.orderBy(F.desc("cut"))  # a row for each cutoff
    return by.select(F.round(F.col("cut") * step + start, 4).alias("cutoff"), F.sum("n").over(down).alias("n_emitted"), F.sum("c").over(down).alias("n_correct")).withColumn("precision_", ratio(F.col("n_correct"), F.col("n_emitted")))


def threshold(scores: DataFrame, target: float, minimum: int, fallback: float) -> float:
    """The cutoff with most correct rows at a precision of ``target``; ties to the lower one.

    ``scores``: score, correct, copies (optional: how many a row stands for). Scores are first added up by rounded value, so the running
    sums pass over distinct scores only.
    """
    copies = F.col("copies") if "copies" in scores.columns else F.lit(1)
    by = scores.groupBy(F.round("score", 4).alias("s")).agg(F.sum(copies).alias("n"), F.sum(F.when(F.col("correct"), copies).otherwise(0)).alias("c"))
    down = Window.orderBy(F.desc("s"))
    best = by.select("s", F.sum("n").over(down).alias("n"), F.sum("c").over(down).alias("c")).filter((F.col("n") >= minimum) & (F.col("c") >= target * F.col("n"))).orderBy(F.desc("c"), "s").first()
    return float(best["s"]) if best else fallback


def compare(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall before and after a stage, and which matches it changed."""
    b = judged(before, labels).select("adm_party_id", F.col("matched").alias("bm"), F.col("correct").alias("bc"), F.col("party_id").alias("bp"))
    a = judged(after, labels).join(b, "adm_party_id")
    changed = F.col("matched") & ~(F.col("bm") & F.col("party_id").eqNullSafe(F.col("bp")))
    g = a.groupBy("split").agg(F.count_if("scorable").alias("n_scorable"), F.count_if(F.col("bm") & F.col("scorable")).alias("before_judged"), F.count_if("bc").alias("before_correct"), F.count_if(F.col("matched") & F.col("scorable")).alias("after_judged"), F.count_if("correct").alias("after_correct"), F.count_if(changed & F.col("correct")).alias("new_correct"), F.count_if(changed & F.col("scorable") & ~F.col("correct")).alias("new_wrong"))
    for stage in ("before", "after"):
        p, r = ratio(F.col(f"{stage}_correct"), F.col(f"{stage}_judged")), ratio(F.col(f"{stage}_correct"), F.col("n_scorable"))
        g = g.withColumns({f"{stage}_precision": p, f"{stage}_recall": r, f"{stage}_f1": F.when(p + r > 0, 2 * p * r / (p + r))})
    return g


def disagreements(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records whose decisions differ, nulls compared as values."""
    pick = lambda d, p: d.select("adm_party_id", F.when(F.col("decision") == "MATCH", F.col("party_id")).alias(p))
    return pick(left, "left_id").join(pick(right, "right_id"), "adm_party_id").filter(~F.col("left_id").eqNullSafe(F.col("right_id")))


def party_summary(rows: DataFrame) -> DataFrame:
    """For each party how many names belong to it, were matched to it, and are right."""
    truth = rows.filter("scorable").groupBy(F.col("expected").alias("party_id")).agg(F.count(F.lit(1)).alias("n_truth"))
    found = rows.filter("matched").groupBy("party_id").agg(F.count(F.lit(1)).alias("n_found"), F.count_if("correct").alias("n_correct"))
    return truth.join(found, "party_id", "full").select("party_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_truth", "n_found", "n_correct")])


def name_chunks(rows: DataFrame, chunk: int = 32_000) -> DataFrame:
    """``party_id, chunk, names``: the names matched to each party, sorted and joined by a line end,
    in cells of about ``chunk`` characters. A running length deals names to cells, by ranges of
    (party, name), so no party's names meet in one row but those of a cell."""
    hits = rows.filter("matched").select("party_id", "raw_name", "adm_party_id")
    placed = numbered(hits, [F.col("party_id"), F.col("raw_name"), F.col("adm_party_id")], "onomast place")
    # sums by blocks of places, then within: the length of all names before
    block = F.floor(F.col("onomast place") / 4096)
    sized = placed.withColumn("block", block).withColumn("size", F.length("raw_name") + 1)
    sums = sized.groupBy("party_id", "block").agg(F.sum("size").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("party_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = F.coalesce(F.sum("size").over(Window.partitionBy("party_id", "block").orderBy("onomast place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sized.withColumn("within", within).join(before, ["party_id", "block"])
    cell = at.withColumn("chunk", F.floor((F.col("before") + F.col("within")) / chunk).cast("int"))
    names = F.array_sort(F.collect_list(F.struct("onomast place", "raw_name")))
    return cell.groupBy("party_id", "chunk").agg(F.array_join(F.transform(names, lambda x: x["raw_name"]), "\n").alias("names"))


def trace_counts(traced: DataFrame, *by: str) -> DataFrame:
    """How many misses of ``trace`` fall into each bucket, by whatever else."""
    return traced.groupBy("bucket", *by).agg(F.count(F.lit(1)).alias("n"))


def trace_candidates(proposals: DataFrame, most: int = 5) -> DataFrame:
    """The best roots of each record, best first: ``adm_party_id, root_id, place, score``."""
    best = proposals.groupBy("adm_party_id", "root_id").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("adm_party_id").orderBy(F.desc("score"), "root_id"))).filter(F.col("place") <= most)


def trace(proposals: DataFrame, decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Why each scorable record has not its expected root: the first that holds."""
    ranked = proposals.groupBy("adm_party_id", "root_id").agg(F.max("score").alias("score"), F.max(F.when((F.col("exact") != 1) & ((F.col("digit_conflict") == 1) | (F.col("distinctive_conflict") == 1)), 1).otherwise(0)).alias("guarded"))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("adm_party_id").orderBy(F.desc("score"), "root_id")))
    mine = labels.filter("scorable").select("adm_party_id", "expected").join(ranked.withColumnRenamed("root_id", "expected"), ["adm_party_id", "expected"], "left").join(decisions.select("adm_party_id", "decision", "reason", "party_id"), "adm_party_id")
    miss = mine.filter(~((F.col("decision") == "MATCH") & F.col("party_id").eqNullSafe(F.col("expected"))))
    bucket = F.when(F.col("place").isNull(), "RETRIEVAL_MISS").when(F.col("guarded") == 1, "EXPECTED_GUARDED").when(F.col("place") > 1, "RANKING_LOSS").when(F.col("reason").isin("AMBIGUOUS_FINAL_TARGETS", "CANDIDATE_COLLISION"), "AMBIGUITY").when(F.col("reason") == "INSUFFICIENT_SUPPORT", "SUPPORT_REJECTION").otherwise("OTHER")
    return miss.withColumn("bucket", bucket)
