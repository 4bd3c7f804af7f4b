"""Recovery stages for plain names that were refused, in their order.

Each is (decisions, ...) -> decisions; it reviews records still without a match (the
multipart stage also matches) and overrides a decision only on evidence that a single
verified root has. Indexes are group-bys on the keys the remaining records ask for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions import text as X
from onomast.operators import decide, retrieval, scoring
from onomast.operators.settle import settle


@dataclass(frozen=True)
class Context:
    """What the stages share: records (adm_party_id, raw_name, plain, parse_warning), proposals,
    parties (party_id, party_name, party_norm, root_id, root_name, path), fitted grams, token idf.
    Where a record stands for ``copies`` of a name, ``members`` (one, adm_party_id) has its ids."""

    records: DataFrame
    proposals: DataFrame
    parties: DataFrame
    grams: dict[str, DataFrame]
    idf: DataFrame
    policy: decide.Policy
    cutoff: float = 0.0
    members: DataFrame | None = None


def waiting(decisions: DataFrame, ctx: Context) -> DataFrame:
    """Refused plain records: adm_party_id, raw_name, norm, and what was decided."""
    plain = ctx.records.filter("plain and parse_warning is null").select("adm_party_id")
    old = decisions.filter("decision = 'NO_MATCH'").join(plain, "adm_party_id", "left_semi")
    return old.select("adm_party_id", "raw_name", X.normalize(F.col("raw_name")).alias("norm"), F.col("reason").alias("old_reason"), F.col("confidence").alias("old_confidence"), F.col("party_id").alias("old_root"), F.col("margin").alias("old_margin"), F.col("runner_up_id").alias("old_runner"), "retrieved_roots")


def candidates(decisions: DataFrame, ctx: Context) -> DataFrame:
    return waiting(decisions, ctx).join(ctx.proposals.drop("raw_name", "plain", "parse_warning"), "adm_party_id")


def _pick(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("adm_party_id").orderBy(*order))).filter("rn = 1").drop("rn")


def unique_short_name(decisions: DataFrame, ctx: Context) -> DataFrame:
    """The whole name is a unique short form of the provisional root's official name."""
    p = decide.with_short_name(candidates(decisions, ctx).filter("root_id = old_root"), ctx.parties, ctx.policy)
    many = F.size(X.tokens(F.col("norm"))) > 1
    calm = (F.col("digit_conflict") == 0) & (F.col("distinctive_conflict") == 0)
    ok = F.col("short_name") & (F.col("old_margin") >= 0.08) & (F.col("old_confidence") >= ctx.cutoff) & (~many | ((F.col("old_reason") == "INSUFFICIENT_SUPPORT") & (F.col("old_confidence") >= ctx.policy.floor) & calm))
    ids = p.filter(ok).select("adm_party_id", many.alias("many")).distinct()
    new = decisions.join(ids, "adm_party_id")
    new = new.withColumns({"decision": F.lit("MATCH"), "reason": F.lit("MATCH"), "tier": F.when(F.col("many"), "RULES_ROOT_UNIQUE_OFFICIAL_PREFIX").otherwise("RULES_ROOT_UNIQUE_SHORT_NAME"), "method": F.when(F.col("many"), "rules:root_unique_official_prefix").otherwise("rules:root_unique_short_name")})
    return decide.override(decisions, new)


def _unsafe(removed: DataFrame, ctx: Context, whole_names: bool = False) -> DataFrame:
    """Keys (adm_party_id, removed) whose removed text names a brand or another candidate."""
    brand = removed.filter(X.brand_case(F.col("removed"))).select("adm_party_id", "removed")
    others = removed.filter("removed != ''").select("adm_party_id", "removed", "chosen").distinct().join(ctx.proposals.select("adm_party_id", "root_id", "norm_name", "type", "idf"), "adm_party_id").filter("root_id != chosen")
    r = X.normalize(F.col("removed"))
    others = others.withColumn("r", r)
    covered = others.withColumn("c", X.soft_coverage(F.col("r"), F.col("norm_name"), F.col("idf"))).filter("c.mine >= 0.75 and c.theirs >= 0.75").select("adm_party_id", "removed")
    bad = brand.unionByName(covered)
    if whole_names:
        words = X.meaningful(F.col("norm_name"))
        inside = (F.col("type") == "official") & (F.size(words) >= 2) & F.contains(F.concat(F.lit(" "), F.col("r"), F.lit(" ")), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
        bad = bad.unionByName(others.filter(inside).select("adm_party_id", "removed"))
    return bad.distinct()


def rescored(clones: DataFrame, ctx: Context) -> DataFrame:
    """Proposals under another mention text: pair cosines, features and score anew."""
    base = [c for c in ctx.proposals.columns if c not in {*scoring.FEATURES, "mention_norm", "norm_name", "idf", "score", "char", "word", "lexical", "rrf", "embedding", "exact"}]
    keep = settle(clones.select(*[c for c in base if c in clones.columns], *[c for c in clones.columns if c.startswith("x_")], F.lit(0.0).alias("rrf"), F.lit(None).cast("double").alias("embedding")))
    for kind in ("char", "word"):
        keep = keep.join(retrieval.pair_cosine(keep, kind, ctx.grams[kind], "mention_text", "name", kind), ["mention_text", "name"])
    return settle(scoring.score(settle(scoring.named(keep.withColumn("lexical", F.greatest("char", "word")))), ctx.idf))


def _redecide(clones: DataFrame, decisions: DataFrame, ctx: Context, accept: Column, tier: str, method: str) -> DataFrame:
    """Add clones to their records' proposals, decide again, accept if a clone wins for the same root."""
    ids = clones.select("adm_party_id").distinct()
    old = ctx.proposals.join(ids, "adm_party_id", "left_semi")
    both = old.unionByName(clones.select(*[c for c in clones.columns if not c.startswith("x_")]), allowMissingColumns=True)
    both = settle(both)
    again = decide.plain(ctx.records.join(ids, "adm_party_id", "left_semi"), both, replace(ctx.policy, containment=False))
    before = decisions.select("adm_party_id", F.col("party_id").alias("old_root"))
    marks = clones.select("adm_party_id", F.col("mention_text").alias("matched_mention"), F.col("name").alias("matched_name"), *[c for c in clones.columns if c.startswith("x_")]).dropDuplicates(["adm_party_id", "matched_mention", "matched_name"])
    won = again.filter("decision = 'MATCH'").join(before, "adm_party_id").filter("party_id = old_root").join(marks, ["adm_party_id", "matched_mention", "matched_name"])
    won = won.filter(F.col("confidence") >= max(ctx.policy.plain, ctx.cutoff)).withColumn("kind", F.upper(F.col("x_kind"))).filter(accept)
    won = won.withColumn("tier", F.concat(F.lit(tier), F.col("kind"))).withColumn("method", F.concat(F.lit(method), F.lower("kind")))
    return decide.override(decisions, won)


def safe_views(decisions: DataFrame, ctx: Context) -> DataFrame:
    """A part or another writing of the name, scored as the name, for the same root."""
    w = waiting(decisions, ctx).filter("old_root is not null")
    views = w.select("adm_party_id", "raw_name", "old_root", F.explode(X.name_views(F.col("raw_name"))).alias("v")).select("adm_party_id", "old_root", F.col("v.kind").alias("x_kind"), F.col("v.view").alias("view"), F.col("v.removed").alias("removed")).filter("x_kind != 'last_segment'")
    bad = _unsafe(views.select("adm_party_id", "removed", F.col("old_root").alias("chosen")), ctx)
    views = views.join(bad, ["adm_party_id", "removed"], "left_anti")
    two = Window.partitionBy("adm_party_id").orderBy(F.desc("score"), "name", "party_id")
    p = ctx.proposals.join(w.select("adm_party_id", "old_root"), "adm_party_id").filter("root_id = old_root").withColumn("rn", F.row_number().over(two)).filter("rn <= 2").drop("old_root", "rn")
    clones = p.join(views.drop("old_root"), "adm_party_id").withColumn("mention_text", F.col("view")).withColumn("mention_id", F.concat("adm_party_id", F.lit(":view:"), F.col("x_kind")))
    clones = rescored(clones, ctx)
    cover = X.soft_coverage(F.col("mention_norm"), F.col("norm_name"), F.col("idf"))
    clones = clones.withColumn("x_cover", cover)
    return _redecide(clones, decisions, ctx, F.col("x_cover.mine").between(0.75, 9) & F.col("x_cover.theirs").between(0.75, 9), "RULES_SAFE_VIEW_", "rules:safe_view_")


def core_anchor(decisions: DataFrame, ctx: Context) -> DataFrame:
    """The name begins with the whole official name, and what follows is harmless."""
    w = waiting(decisions, ctx).filter("old_root is not null and old_margin >= 0.08")
    two = Window.partitionBy("adm_party_id").orderBy(F.desc(F.length("norm_name")), F.desc("score"), "party_id")
    p = ctx.proposals.drop("raw_name").join(w.select("adm_party_id", "raw_name", "old_root"), "adm_party_id").filter("root_id = old_root and type = 'official' and collisions = 1").withColumn("rn", F.row_number().over(two)).filter("rn <= 2").drop("rn")
    p = settle(p.withColumn("a", X.anchored(F.col("raw_name"), F.col("norm_name")))).filter("a.prefix is not null").withColumn("removed", F.col("a.remainder")).withColumn("chosen", F.col("old_root"))
    p = p.join(_unsafe(p.select("adm_party_id", "removed", "chosen"), ctx, whole_names=True), ["adm_party_id", "removed"], "left_anti")
    clones = rescored(p.withColumn("mention_text", F.col("a.prefix")).withColumn("x_kind", F.lit("core_anchor")).withColumn("mention_id", F.concat("adm_party_id", F.lit(":core"))), ctx)
    return _redecide(clones, decisions, ctx, F.lit(True), "RULES_SAFE_VIEW_", "rules:safe_view_")


def second_pass(decisions: DataFrame, ctx: Context) -> DataFrame:
    """Structural evidence over all retrieved roots; the strongest must stand alone."""
    p = decide.with_short_name(candidates(decisions, ctx), ctx.parties, ctx.policy)
    raw, official = F.col("norm"), F.col("norm_name")
    bases = decide.owners(ctx.parties, X.base(F.col("party_norm")))
    articles, labs = decide.owners(ctx.parties, X.article_base(F.col("party_norm"))), decide.owners(ctx.parties, X.laboratory_base(F.col("party_norm")))
    ands = decide.owners(ctx.parties.filter(F.contains("party_name", F.lit("&")) | F.contains(F.concat(F.lit(" "), "party_norm", F.lit(" ")), F.lit(" and "))), X.and_equivalent(F.col("party_name")))
    forms = decide.owners(ctx.parties, F.concat_ws("|", X.legal_form(F.col("party_norm"))["base"], X.legal_form(F.col("party_norm"))["form"]))

    def keyed(df: DataFrame, index: DataFrame, name: str, key: Column) -> DataFrame:
        return df.withColumn(f"k_{name}", key).join(index.select(F.col("key").alias(f"k_{name}"), F.col("owner").alias(f"o_{name}"), F.col("owners").alias(f"n_{name}")), f"k_{name}", "left")

    p = keyed(p, bases, "base", X.base(raw))
    p = keyed(p, articles, "article", X.article_base(raw))
    p = keyed(p, labs, "lab", X.laboratory_base(raw))
    p = keyed(p, ands, "and", X.and_equivalent(F.col("raw_name")))
    p = keyed(p, forms, "form", F.concat_ws("|", X.legal_form(raw)["base"], X.legal_form(raw)["form"]))
    sole = lambda name: (F.col(f"n_{name}") == 1) & (F.col(f"o_{name}") == F.col("root_id"))
    clean = (F.col("type") == "official") & (F.col("collisions") == 1) & (F.col("digit_conflict") == 0)
    lexical = F.greatest("char", "word")
    p = settle(p.withColumn("a", X.anchored(F.col("raw_name"), official)))
    risky = _unsafe(p.filter("a.prefix is not null").select("adm_party_id", F.col("a.remainder").alias("removed"), F.col("root_id").alias("chosen")), ctx, whole_names=True).withColumn("risky", F.lit(True)).withColumnRenamed("removed", "k_rest")
    p = p.withColumn("k_rest", F.col("a.remainder")).join(risky, ["adm_party_id", "k_rest"], "left")
    anchored = F.col("a.prefix").isNotNull() & F.col("risky").isNull() & (F.col("score") >= 0.25)
    suffix = (X.base(raw) != "") & (X.base(raw) == X.base(official)) & (raw != official) & (F.length(X.compact(X.base(raw))) >= 8) & sole("base") & (F.col("score") >= 0.55)
    short = (F.col("distinctive_conflict") == 0) & (F.col("score") >= 0.40) & F.col("short_name")
    x, y = X.tokens(X.base(raw)), X.tokens(X.base(official))
    differ = F.filter(F.arrays_zip(x.alias("l"), y.alias("r")), lambda d: d["l"] != d["r"])
    one = F.try_element_at(differ, F.lit(1))
    typo = (F.size(x) == F.size(y)) & (F.size(x) > 0) & (F.size(differ) == 1) & (F.least(F.length(one["l"]), F.length(one["r"])) >= F.when(F.size(x) == 1, 8).otherwise(5))
    near = F.greatest(X.levenshtein_similarity(one["l"], one["r"]), F.when(X.singular(one["l"]) == X.singular(one["r"]), 0.94).otherwise(0.0)) >= 0.80
    p = settle(p.withColumn("typo", F.coalesce(clean & typo & near & (F.col("score") >= 0.35), F.lit(False))))
    spelled = p.filter("typo").select("norm", "norm_name", "idf").dropDuplicates(["norm", "norm_name"]).withColumn("c", X.soft_coverage(F.col("norm"), F.col("norm_name"), F.col("idf"))).filter("c.mine >= 0.88 and c.theirs >= 0.88").select("norm", "norm_name", F.lit(True).alias("spelled"))
    p = p.join(spelled, ["norm", "norm_name"], "left")
    article = (F.size(X.tokens(F.col("k_article"))) >= 2) & sole("article") & (raw.startswith("the ") != official.startswith("the ")) & (X.article_base(official) == F.col("k_article")) & (F.col("score") >= 0.55) & (lexical >= 0.55)
    has = lambda c, *ws: F.arrays_overlap(X.tokens(c), X.lits(ws))
    abbreviated = (has(raw, "lab", "labs") & has(official, "laboratory", "laboratories")) | (has(official, "lab", "labs") & has(raw, "laboratory", "laboratories"))
    lab = (F.size(X.tokens(F.col("k_lab"))) >= 2) & sole("lab") & abbreviated & (raw != official) & (X.laboratory_base(official) == F.col("k_lab")) & (F.col("score") >= 0.35) & (lexical >= 0.55)
    several = F.col("n_base") > 1
    stated = (F.col("old_reason") == "AMBIGUOUS_FINAL_TARGETS") & (F.col("k_form") != "") & several
    form = stated & sole("form") & ((F.col("root_id") == F.col("old_root")) | (F.col("root_id") == F.col("old_runner"))) & (official == raw) & (F.col("score") >= ctx.policy.plain)
    words = F.filter(X.meaningful(F.col("k_and")), lambda t: F.length(t) >= 3)
    ampersand = (F.size(words) >= 2) & sole("and") & (raw != official) & F.contains(F.concat("raw_name", "name"), F.lit("&")) & (X.and_equivalent(F.col("name")) == F.col("k_and")) & (F.col("score") >= 0.55)
    kinds = [(5, "EXPLICIT_LEGAL_FORM", form), (4, "LEADING_ARTICLE_EQUIVALENCE", article), (4, "LABORATORY_ABBREVIATION", lab), (4, "AND_EQUIVALENCE", ampersand), (4, "OFFICIAL_NAME_WITH_CONTEXT", anchored), (3, "LEGAL_SUFFIX_VARIANT", suffix), (3, "DISTINCTIVE_SHORT_NAME", short), (2, "MINOR_SPELLING_VARIANT", F.col("spelled") & F.col("typo"))]
    kind, strength = F.lit(None).cast("string"), F.lit(None).cast("int")
    for s, name, found in reversed(kinds):
        ok = F.coalesce(clean & found, F.lit(False))
        kind, strength = F.when(ok, name).otherwise(kind), F.when(ok, s).otherwise(strength)
    p = p.withColumn("kind", kind).withColumn("strength", strength)
    record = Window.partitionBy("adm_party_id")
    tied_form = F.max(F.coalesce(stated & ~F.coalesce(form, F.lit(False)), F.lit(False))).over(record) & ~F.max(F.coalesce(form & clean, F.lit(False))).over(record)
    tied_and = F.max(F.coalesce(F.col("old_reason").isin("AMBIGUOUS_FINAL_TARGETS", "CANDIDATE_COLLISION") & (F.col("n_and") > 1), F.lit(False))).over(record)
    p = p.withColumn("blocked", tied_form | tied_and)
    rooted = Window.partitionBy("adm_party_id", "root_id").orderBy(F.desc_nulls_last("strength"), F.desc("score"), "name")
    exact = F.max(F.when(F.col("exact") == 1, F.col("root_id"))).over(record), F.min(F.when(F.col("exact") == 1, F.col("root_id"))).over(record)
    p = p.withColumn("exact_max", exact[0]).withColumn("exact_min", exact[1])
    best = p.withColumn("rn", F.row_number().over(rooted)).filter("rn = 1 and strength is not null and not blocked").drop("rn")
    order = Window.partitionBy("adm_party_id").orderBy(F.desc("strength"), F.desc("score"), "root_id")
    best = best.withColumn("place", F.row_number().over(order)).withColumn("rival", F.lead("strength").over(order)).withColumn("rival_root", F.lead("root_id").over(order)).withColumn("rival_score", F.lead("score").over(order))
    won = best.filter("place = 1 and (rival is null or rival < strength - 1)").filter(F.coalesce(F.col("exact_max") == F.col("root_id"), F.lit(True)) & F.coalesce(F.col("exact_min") == F.col("root_id"), F.lit(True))).filter(F.col("score") >= ctx.cutoff)
    columns = decide.as_match(F.col("score"), F.lit("MATCH"), F.concat(F.lit("rules:second_pass_"), F.lower("kind")), F.concat(F.lit("RULES_SECOND_PASS_"), "kind"))
    columns |= {"runner_up_id": F.col("rival_root"), "runner_up_score": F.col("rival_score"), "margin": F.when(F.col("rival").isNotNull(), F.col("score") - F.col("rival_score")).otherwise(F.col("old_margin"))}
    return decide.override(decisions, decide.decided(won, columns))


def regional(decisions: DataFrame, ctx: Context) -> DataFrame:
    """A unique core plus nothing but geography: a text heuristic, no proof of ownership."""
    p = candidates(decisions, ctx).filter("type = 'official' and collisions = 1 and digit_conflict = 0 and distinctive_conflict = 0 and score >= 0.35").filter(F.greatest("char", "word") >= 0.55)
    p = p.withColumn("core", X.regional_core(F.col("norm_name"))).filter((F.size("core") > 1) | ((F.size("core") == 1) & (F.length(F.array_join("core", " ")) >= 4))).withColumn("key", F.array_join("core", " "))
    t = X.regional_core(F.col("party_norm"))
    prefixes = F.when(F.size(t) >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t))), lambda n: F.array_join(F.slice(t, F.lit(1), n), " ")))
    asked = ctx.parties.withColumn("k", F.explode(prefixes)).join(p.select(F.col("key").alias("k")).distinct(), "k", "left_semi")
    sole = decide.owners(asked, F.col("k")).filter("owners = 1").select("key", F.col("owner").alias("root_id"))
    p = settle(p.join(sole, ["key", "root_id"]).withColumn("rc", X.regional_core(F.col("norm"))).withColumn("ok", X.regional_match(F.col("rc"), F.col("core")))).filter("ok")
    whole = Window.partitionBy("adm_party_id")
    best = p.withColumn("rn", F.row_number().over(Window.partitionBy("adm_party_id", "root_id").orderBy(F.desc("score"), "name"))).filter("rn = 1").withColumn("roots", F.count(F.lit(1)).over(whole)).filter("roots = 1 and rn = 1").drop("rn")
    exact = ctx.proposals.filter("exact = 1").select("adm_party_id", F.col("root_id").alias("other")).distinct()
    rival = best.select("adm_party_id", "root_id").join(exact, "adm_party_id").filter("root_id != other").select("adm_party_id").distinct()
    won = best.join(rival, "adm_party_id", "left_anti").filter(F.col("score") >= ctx.cutoff)
    columns = decide.as_match(F.col("score"), F.lit("REGIONAL_HEURISTIC_NOT_PROVEN_OWNERSHIP"), F.lit("rules:regional_heuristic_not_proven_ownership"), F.lit("RULES_REGIONAL_HEURISTIC"))
    return decide.override(decisions, decide.decided(won, columns | {"margin": F.col("old_margin")}))


def multipart(decisions: DataFrame, ctx: Context, retrieve, labels: DataFrame | None = None, minimum: float = 0.80) -> DataFrame:
    """A forced choice between parts of a name that are strong for different roots.

    ``retrieve(mentions)`` gives scored proposals of synthetic mentions, fitted on them
    alone. ``labels`` (adm_party_id, root_id) of training rows give the prior of positions.
    """
    minimum = max(minimum, ctx.policy.plain)
    copies = [c for c in ("copies",) if c in ctx.records.columns]
    parts = ctx.records.filter("plain and parse_warning is null").select("adm_party_id", *copies, F.explode(X.fragments(F.col("raw_name"))).alias("f")).select("adm_party_id", *copies, "f.delimiter", F.col("f.position").alias("part"), F.col("f.text").alias("text"))
    parts = settle(parts.withColumn("mention_id", F.concat("adm_party_id", F.lit(":multipart:"), F.col("part").cast("string"))))
    found = retrieve(parts.select("mention_id", F.col("mention_id").alias("adm_party_id"), "text", *copies))
    strong = found.filter((F.col("score") >= minimum) & (F.col("digit_conflict") == 0) & (F.col("distinctive_conflict") == 0) & (F.greatest("char", "word", "exact") >= 0.55))
    first = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.desc("exact"), "root_id", "name")
    strong = strong.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "adm_party_id").join(parts.select("mention_id", "adm_party_id", "delimiter", "part"), "mention_id")
    strong = settle(strong)
    competing = strong.groupBy("adm_party_id").agg(F.countDistinct("root_id").alias("roots")).filter("roots >= 2")
    strong = strong.join(competing.select("adm_party_id"), "adm_party_id", "left_semi")
    known = strong if ctx.members is None else strong.withColumnRenamed("adm_party_id", "one").join(ctx.members, "one")
    strong = strong.withColumn("prior", F.lit(0.0)) if labels is None else strong.join(position_prior(known, labels), ["delimiter", "part"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    chosen = _pick(strong, F.desc(F.col("score") + 0.08 * F.col("prior")), F.desc("score"), F.col("part"), F.col("root_id"))
    old = decisions.select("adm_party_id", "raw_name", F.col("decision").alias("d"), F.col("party_id").alias("old_root"), F.col("matched_mention").alias("om"), F.col("matched_type").alias("ot"), F.col("matched_name").alias("on"), F.col("confidence").alias("oc"), "retrieved_roots")
    joined = chosen.drop("raw_name").join(old, "adm_party_id")
    settled = (F.col("d") == "MATCH") & ((F.col("old_root") == F.col("root_id")) | ((F.col("om") == F.col("raw_name")) & (F.col("ot") == "official") & (F.col("oc") >= 0.93) & (X.normalize(F.col("raw_name")) == X.normalize(F.col("on")))))
    won = joined.filter(~F.coalesce(settled, F.lit(False))).filter(F.col("score") >= max(minimum, ctx.cutoff))
    columns = decide.as_match(F.col("score"), F.lit("MULTIPART_FORCED_CHOICE"), F.lit("rules:multipart_forced_choice"), F.lit("RULES_MULTIPART_FORCED_CHOICE"))
    return decide.override(decisions, decide.decided(won, columns))


def position_prior(strong: DataFrame, labels: DataFrame) -> DataFrame:
    """``delimiter, part, prior``: Laplace share of positions of the labelled root, from 20 rows on."""
    hit = strong.join(labels.select("adm_party_id", F.col("root_id").alias("expected")), "adm_party_id").filter("root_id = expected")
    sole = hit.groupBy("adm_party_id", "delimiter").agg(F.countDistinct("part").alias("n"), F.min("part").alias("part")).filter("n = 1")
    counts = sole.groupBy("delimiter", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = sole.groupBy("delimiter").agg(F.count(F.lit(1)).alias("total")).filter("total >= 20").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return totals.join(counts, ["delimiter", "part"], "left").select("delimiter", "part", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + 4)).alias("prior"))


def name_anchor(decisions: DataFrame, ctx: Context) -> DataFrame:
    """The raw name begins with one root's verified name or base; more specific or exact rivals veto."""
    w = waiting(decisions, ctx)
    w = settle(w)
    pre = w.select("adm_party_id", "raw_name", "norm", F.explode(X.raw_prefixes(F.col("raw_name"))).alias("p")).select("adm_party_id", "raw_name", "norm", F.col("p.written").alias("written"), F.col("p.norm").alias("key"), F.col("p.remainder").alias("rest"))
    pre = settle(pre)
    asked = pre.select("key").unionByName(w.select(F.col("norm").alias("key"))).distinct()

    def index(key: Column) -> DataFrame:
        named = ctx.parties.withColumn("key", key).filter("key != ''").join(asked, "key", "left_semi")
        one = named.groupBy("key", "root_id").agg(F.min("party_id").alias("member"))
        return one.groupBy("key").agg(F.count(F.lit(1)).alias("owners"), F.min("root_id").alias("root_id"), F.min("member").alias("member"))

    full_rows = ctx.parties.select(F.col("party_norm").alias("key"), "root_id").filter("key != ''").join(asked, "key", "left_semi").distinct()
    full = pre.join(index(F.col("party_norm")).filter("owners = 1"), "key").filter("rest != ''").withColumn("tier_no", F.lit(3)).withColumn("kind", F.lit("OFFICIAL_PREFIX"))
    by_base = pre.join(index(X.official_base(F.col("party_norm"))).filter("owners = 1"), "key").withColumn("tier_no", F.when(F.col("rest") == "", 2).otherwise(1)).withColumn("kind", F.when(F.col("rest") == "", "LEGAL_BASE").otherwise("BASE_WITH_CONTEXT"))
    v = full.unionByName(by_base)
    core, rest = X.compact(X.normalize(F.col("written"))), X.tokens(X.normalize(F.col("rest")))
    context = (F.size(rest).between(1, 8)) & ~F.exists(rest, lambda t: t.rlike("^[0-9]+$")) & ((F.length(core) > 4) | ((F.length(core) >= 3) & (F.upper("written") == F.col("written")) & (F.lower("written") != F.col("written"))))
    v = v.filter(F.when(F.col("kind") == "LEGAL_BASE", F.length(core) >= 3).otherwise(context))
    longer = pre.select("adm_party_id", F.col("key").alias("k2"), "norm").join(full_rows.select(F.col("key").alias("k2"), F.col("root_id").alias("r2")), "k2").filter((F.col("norm") == F.col("k2")) | F.col("norm").startswith(F.concat("k2", F.lit(" ")))).select("adm_party_id", "k2", "r2").distinct()
    v = settle(v.withColumn("vid", F.concat_ws("|", "adm_party_id", "key", "kind")))
    veto = v.join(longer, "adm_party_id").filter((F.col("r2") != F.col("root_id")) & (F.length("k2") > F.length("key"))).select("vid").distinct()
    same = v.filter("kind != 'OFFICIAL_PREFIX'").join(full_rows.select(F.col("key").alias("norm"), F.col("root_id").alias("r2")), "norm").filter("r2 != root_id").select("vid").distinct()
    v = v.join(veto.unionByName(same).distinct(), "vid", "left_anti")
    owners = ctx.parties.select(F.col("party_id").alias("member"), F.col("party_name").alias("owner_name"), "root_name", "path", F.col("party_id"))
    is_full = F.col("kind") == "OFFICIAL_PREFIX"
    p = v.join(owners, "member").withColumns({"mention_text": F.col("written"), "name": F.when(is_full, F.col("owner_name")).otherwise(F.col("key")), "type": F.when(is_full, "official").otherwise("anchor_view"), "source": F.when(is_full, "official").otherwise("derived_legal_base"), "confidence": F.when(is_full, F.lit(None).cast("double")).otherwise(F.lit(0.90)), "collisions": F.lit(1).cast("long"), "sources": F.array(F.lit("rules_anchor:verified_catalog")), "mention_id": F.col("vid"), "position": F.lit(0), "x_kind": F.col("kind"), "x_tier": F.col("tier_no")})
    s = rescored(p, ctx).join(w.select("adm_party_id", "raw_name", "norm", "retrieved_roots"), "adm_party_id")
    s = s.withColumn("top", F.max("x_tier").over(Window.partitionBy("adm_party_id"))).filter("x_tier = top")
    whole = Window.partitionBy("adm_party_id")
    s = s.withColumn("r0", F.min("root_id").over(whole)).withColumn("r1", F.max("root_id").over(whole)).filter("r0 = r1")
    won = _pick(s, F.desc("score"), F.desc(F.length("mention_norm")), F.desc("name")).filter("digit_conflict = 0 and distinctive_conflict = 0")
    exact = ctx.proposals.filter("exact = 1").select("adm_party_id", F.col("root_id").alias("other"), F.col("mention_norm").alias("norm")).distinct()
    rival = won.select("adm_party_id", "root_id", "norm").join(exact, ["adm_party_id", "norm"]).filter("root_id != other").select("adm_party_id").distinct()
    won = won.join(rival, "adm_party_id", "left_anti").withColumn("conf", F.least("score", F.when(F.col("x_kind") == "OFFICIAL_PREFIX", 0.95).otherwise(0.90))).filter(F.col("conf") >= max(ctx.policy.plain, ctx.cutoff))
    columns = decide.as_match(F.col("conf"), F.lit("VERIFIED_NAME_ANCHOR"), F.concat(F.lit("rules:verified_name_anchor_"), F.lower("x_kind")), F.concat(F.lit("RULES_VERIFIED_NAME_ANCHOR_"), "x_kind"))
    columns |= {"matched_name": F.col("owner_name"), "matched_type": F.lit("official"), "retrieved_roots": F.array_distinct(F.concat(F.coalesce("retrieved_roots", F.array().cast("array<string>")), F.array("root_id")))}
    return decide.override(decisions, decide.decided(won, columns))
