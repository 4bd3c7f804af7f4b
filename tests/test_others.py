"""Graph, preparation, suggestions, training, sources, streaming and the driver contract."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from onomast.operators import decide, evaluate, graph, prepare, scoring, suggest, train
from onomast.operators.settle import numbered, settle
from onomast.plans import matcher, views
from onomast.sources import io
from onomast.streaming import incremental


def test_closure(spark):
    p = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None)], "party_id string, parent_id string")
    assert {r["party_id"]: (r["root_id"], r["depth"], r["path"]) for r in graph.closure(p).collect()} == {"a": ("a", 1, ["a"]), "b": ("a", 2, ["b", "a"]), "c": ("a", 3, ["c", "b", "a"]), "x": ("x", 1, ["x"])}
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "party_id string, parent_id string"))


def test_closure_of_any_depth(spark):
    rows = [(f"p{i:03}", f"p{i - 1:03}" if i else None) for i in range(150)] + [("orphan", "nobody")]
    got = {r["party_id"]: r for r in graph.closure(spark.createDataFrame(rows, "party_id string, parent_id string").repartition(5)).collect()}
    assert all(got[f"p{i:03}"]["root_id"] == "p000" and got[f"p{i:03}"]["depth"] == i + 1 and got[f"p{i:03}"]["path"] == [f"p{j:03}" for j in range(i, -1, -1)] for i in range(150))
    assert (got["orphan"]["root_id"], got["orphan"]["path"]) == ("nobody", ["orphan", "nobody"])
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([("x", "a"), ("a", "b"), ("b", "c"), ("c", "a")], "party_id string, parent_id string"))


def test_parents_in_order(spark):
    """Against taking suggestions one by one in the order of child ids."""
    import random

    rng = random.Random(4)
    for n in (6, 25):
        ids_ = [f"p{i:02}" for i in range(n)]
        old = {x: None for x in ids_}
        for i, x in enumerate(ids_):
            if i and rng.random() < 0.3:
                old[x] = rng.choice(ids_[:i])
        asked = {x: rng.choice(ids_) for x in ids_ if rng.random() < 0.9}
        parent, want = dict(old), []
        for x in sorted(asked):
            at, seen = asked[x], []
            while at is not None:
                seen.append(at)
                at = parent[at]
            if parent[x] is None and x not in seen:
                parent[x] = asked[x]
                want.append((x, asked[x]))
        p = spark.createDataFrame([(x, f"Name {x}", old[x]) for x in ids_], "party_id string, party_name string, parent_id string")
        got = graph.reconcile_parents(spark, p, spark.createDataFrame([(x, f"name {y} Inc") for x, y in asked.items()] , "party_id string, parent_name string"))
        assert sorted((r[0], r[1]) for r in got.collect()) == want
        whole = {r["party_id"]: r["parent_id"] for r in graph.with_parents(p, got).collect()}
        assert whole == parent


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "graph")
    none = graph.load_snapshot(spark, path, "acc")
    assert none.count() == 0
    one = graph.add_parties(none, spark.createDataFrame([("a", "Alpha")], "party_id string, party_name string"))
    assert graph.save_snapshot(one, path, "acc") and not graph.save_snapshot(graph.load_snapshot(spark, path, "acc"), path, "acc")
    two = graph.add_parties(graph.load_snapshot(spark, path, "acc"), spark.createDataFrame([("a", "Alpha Inc"), ("b", "Beta")], "party_id string, party_name string"))
    assert graph.save_snapshot(two, path, "acc")
    assert {(r["party_id"], r["party_name"]) for r in graph.load_snapshot(spark, path, "acc").collect()} == {("a", "Alpha Inc"), ("b", "Beta")}
    with pytest.raises(ValueError):
        graph.load_snapshot(spark, path, "other")
    p = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b")], "party_id string, party_name string, parent_id string")
    assert [tuple(r) for r in graph.one_party(p, "b").collect()] == [("b", "B", None)]
    scoped = graph.in_scope(p, p.filter("party_id != 'a'"))
    assert {(r["party_id"], r["parent_id"]) for r in scoped.collect()} == {("b", None), ("c", "b")}


def test_expansions(spark):
    requests = spark.createDataFrame([("r1", "a"), ("r2", "b")], "ref string, party_id string")
    answers = spark.createDataFrame([("r1", 2, "late"), ("r1", 1, "first"), ("r3", 1, "stray"), ("r2", 1, "two")], "ref string, at int, name string")
    assert {tuple(r) for r in graph.correlate(requests, answers).select("party_id", "name").collect()} == {("a", "first"), ("b", "two")}
    raw = spark.createDataFrame([("a", "Big Parent", "Big Parent", "alias", "0.9"), ("a", "AKA", "Big Parent", "alias", "1.7"), ("a", "Odd", None, "place", "0.9"), ("a", "Low", None, "alias", "x")], "party_id string, name string, parent_name string, type string, confidence string")
    assert [(r["name"], r["confidence"]) for r in graph.validate_expansions(raw).collect()] == [("AKA", 1.0)]


def test_parents_do_not_close_cycles(spark):
    p = spark.createDataFrame([("a", "Alpha Inc", None), ("b", "Beta Inc", None), ("c", "Beta Inc", None)], "party_id string, party_name string, parent_id string")
    got = graph.reconcile_parents(spark, p, spark.createDataFrame([("b", "Alpha"), ("a", "Alpha Inc"), ("c", "Beta")], "party_id string, parent_name string")).collect()
    assert sorted((r[0], r[1]) for r in got) == [("b", "a"), ("c", "b")]  # its own name is not counted for c
    two = spark.createDataFrame([("a", "Alpha Inc", None), ("b", "Beta Inc", None)], "party_id string, party_name string, parent_id string")
    got = graph.reconcile_parents(spark, two, spark.createDataFrame([("a", "Beta"), ("b", "Alpha")], "party_id string, parent_name string")).collect()
    assert [(r[0], r[1]) for r in got] == [("a", "b")]


def test_prepare(spark):
    rows = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", "B", 3), ("C", "z", 4), ("C", "z", 5), ("D", None, 6)], "raw_name string, label string, source_row int")
    assert [r["cleaning"] for r in prepare.clean(rows).orderBy("source_row").collect()] == ["CONFLICTING_LABELS", "CONFLICTING_LABELS", "VERIFIED_SELF_ROW", None, "EXACT_DUPLICATE", None]
    assert prepare.find_column(["Raw  Name", "x"], None, ["raw name"]) == "Raw  Name"
    with pytest.raises(ValueError):
        prepare.find_column(["x"], "y", [], True)
    assert prepare.frame_hash(rows) == prepare.frame_hash(rows.orderBy(F.desc("source_row"))) != prepare.frame_hash(rows.limit(3))


def test_suggestions(spark):
    v = spark.createDataFrame([("l", "Abbott Laboratories"), ("m", "Abbott Molecular"), ("t", "Tock, Inc."), ("u", "Tock, LLC"), ("b", "Bank One")], "party_id string, party_name string")
    n = spark.createDataFrame([("1", "Abbott Molecular Inc"), ("2", "Abbott Nutrition"), ("3", "Tock Incorporated"), ("4", "Bank Two"), ("5", "Abbott Labs"), ("6", "")], "adm_party_id string, raw_name string")
    got = {r["adm_party_id"]: (r["status"], r["party_id"]) for r in suggest.suggest(n, v).collect()}
    assert got == {"1": ("SUGGESTED", "m"), "2": ("AMBIGUOUS", ""), "3": ("SUGGESTED", "t"), "4": ("NONE", ""), "5": ("SUGGESTED", "l"), "6": ("NONE", "")}
    before = suggest.suggest(n, v.filter("party_id != 'm'"))
    changes = {r["adm_party_id"]: r["change"] for r in suggest.change(before, suggest.suggest(n, v)).collect()}
    assert changes["1"] == "MOVED_SUGGESTION" and changes["2"] == "NOW_AMBIGUOUS" and changes["4"] == "UNCHANGED"


def test_wilson_and_threshold(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("lh", evaluate.wilson(F.lit(8), F.lit(10)), strict=True)]).first()
    assert row["l"] == pytest.approx(0.4902, abs=1e-3) and row["h"] == pytest.approx(0.9433, abs=1e-3)
    scores = spark.createDataFrame([(0.9, True)] * 8 + [(0.8, True)] * 4 + [(0.7, False)] * 9, "score double, correct boolean")
    assert evaluate.threshold(scores, 0.95, 5, 0.5) == 0.8 and evaluate.threshold(scores, 1.1, 5, 0.5) == 0.5


def test_training(spark, tmp_path):
    """All training pairs fit the identity model; calibration records, by their id, the rest."""
    feature = lambda noise: [((F.col("id") % 2) * 0.5 + (F.col("id") % 7) / 20 + noise).alias(c) for c in ("exact", "char_ratio", "inverse_collisions")]
    shape = lambda n, noise: spark.range(n).select(F.sha2((F.col("id") / 2).cast("int").cast("string"), 256).alias("adm_party_id"), F.col("id").cast("string").alias("party_id"), (F.col("id") % 2).cast("int").alias("label"), *feature(noise), ((F.col("id") % 2) * 0.6 + 0.2).alias("score"))
    rows, held = shape(240, F.lit(0.0)), shape(300, (F.col("id") % 11) / 30)
    model = train.fit(rows, held, rounds=5, version="v1")
    assert model.identity.stages[-1].getNumTrees == 5 and model.target is not None and 0 < model.threshold <= 1
    train.save(spark, model, str(tmp_path / "m"))
    back = train.load(spark, str(tmp_path / "m"), "v1")
    assert back.threshold == model.threshold and (back.calibrator is None) == (model.calibrator is None)
    with pytest.raises(RuntimeError):
        train.load(spark, str(tmp_path / "m"), "v2")
    assert train.load(spark, str(tmp_path / "none")) is None
    rules = train.fit(rows.limit(5))
    assert rules.identity is None
    train.save(spark, rules, str(tmp_path / "rules"))
    assert train.load(spark, str(tmp_path / "rules")).identity is None
    # the target as one expression is what the fitted model says
    judged = train.with_rivals(train.probability(model.identity, held.drop("score"), "score")).withColumn("collisions", F.lit(1)).withColumn("path", F.array(F.lit("x")))
    pair = train.probability(model.target, judged, "p").withColumn("q", train.target(train.Model(None, model.target, None, 0, 0, ""))(F.col("score"), F.col("runner")))
    assert pair.filter("abs(p - q) > 1e-9").count() == 0


def test_calibration_is_the_regression(spark):
    from pyspark.ml.regression import IsotonicRegression

    points = spark.createDataFrame([(0.1, 0.0), (0.3, 1.0), (0.3, 0.0), (0.5, 0.0), (0.7, 1.0), (0.9, 1.0)], "p double, label double")
    fitted = IsotonicRegression(featuresCol="p", labelCol="label").fit(points)
    some = spark.range(101).select((F.col("id") / 100).alias("p"))
    assert fitted.transform(some).withColumn("q", train.calibrated(fitted, F.col("p"))).filter("abs(q - prediction) > 1e-9").count() == 0


def test_learning_in_the_matcher(spark, sf):
    p = settle(views.parties(spark, sf).limit(40))
    w = settle(views.written(spark, sf).join(p.select(F.col("party_id").alias("expected")), "expected", "left_semi").limit(80))
    labels = w.withColumns({"scorable": F.lit(True), "split": F.when(F.crc32("adm_party_id") % 3 == 0, "CALIBRATION").otherwise("TRAIN")})
    model = train.learn(labels, p, w.select(F.col("raw_name").alias("text")), rounds=3)
    ctx, mentions = matcher.context(p.limit(8), w.limit(8), decide.Policy())
    learned = train.apply(model, ctx.proposals)
    assert learned.filter("score < 0 or score > 1 or rules_score is null").count() == 0
    got = matcher.baseline(ctx.records, mentions, settle(learned), ctx.parties, decide.Policy(), train.target(model))
    assert got.count() == ctx.records.count()
    pairs = train.synthetic(p)
    n = p.select("party_name").distinct().count()
    assert {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()} == {1: 3 * n, 0: 2 * n}


def test_rerank(spark):
    rows = [("r", "a", "m", "A", 0.7), ("r", "b", "m", "B", 0.69), ("s", "a", "m", "A", 0.999), ("s", "b", "m", "B", 0.1)]
    p = spark.createDataFrame(rows, "adm_party_id string, root_id string, mention_text string, name string, score double")
    got = {(r["adm_party_id"], r["root_id"]): round(r["score"], 6) for r in scoring.rerank(p, spark.createDataFrame([("m", "A", 0.2), ("m", "B", 0.9)], "mention_text string, name string, ce double")).collect()}
    assert got == {("r", "a"): 0.475, ("r", "b"): 0.7845, ("s", "a"): 0.999, ("s", "b"): 0.1}


def test_training_pairs(spark, sf):
    p = settle(views.parties(spark, sf))
    w = views.written(spark, sf).withColumns({"scorable": F.lit(True), "split": F.lit("TRAIN")})
    got = train.pairs(w, p).groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in got}
    assert n[1] > 50 and n[1] < n[0] <= 3 * n[1]


def test_training_pairs_are_not_capped(spark):
    """120,000 pairs are all there: their number is carried by the few that differ."""
    v = spark.createDataFrame([("a", "Alpha Tools Inc"), ("b", "Alpha Works Ltd"), ("c", "Alpha Pumps Corp"), ("d", "Alpha Cranes LLC")], "party_id string, party_name string")
    even = F.col("id") % 2 == 0
    labels = spark.range(30_000).select(F.concat(F.lit("u"), "id").alias("adm_party_id"), F.when(even, "Alpha Tools").otherwise("Alpha Works Limited").alias("raw_name"), F.when(even, "a").otherwise("b").alias("expected"), F.lit(True).alias("scorable"), F.lit("TRAIN").alias("split"))
    got = train.pairs(labels, v).collect()
    assert len(got) == 8 and {r["copies"] for r in got} == {15_000}
    assert sum(r["copies"] for r in got if r["label"] == 1) == 30_000 and sum(r["copies"] for r in got) == 120_000


def test_training_sees_every_row(spark):
    """Three rows in 60,000 that differ are split off, though Spark looks for splits in a sample of 10,000."""
    rare = F.col("id") - 59_996  # 1, 2 and 3, labelled 1, 0 and 1
    rows = spark.range(60_000).select(((rare > 0) & (rare != 2)).cast("int").alias("label"), F.when(rare > 0, rare.cast("double")).otherwise(F.col("id") % 2 * 0.5).alias("char"), F.lit(0.0).alias("word"))
    of = lambda model: [r["p"] for r in train.probability(model.identity, rows.select("char", "word").distinct(), "p").orderBy("char").collect()]
    found = of(train.fit(rows, rounds=2))
    assert [p > 0.5 for p in found] == [False, False, True, False, True]
    assert of(train.fit(rows.groupBy("label", "char", "word").agg(F.count(F.lit(1)).alias("copies")), rounds=2)) == pytest.approx(found)


def test_calibration_counts_every_record(spark):
    """Records of one part that write a party alike are one with their number, and weigh as many in the threshold."""
    v = spark.createDataFrame([("a", "Alpha Tools Inc"), ("b", "Alpha Works Ltd")], "party_id string, party_name string")
    labels = spark.range(900).select(F.concat(F.lit("u"), "id").alias("adm_party_id"), F.lit("Alpha Tools").alias("raw_name"), F.lit("a").alias("expected"), F.lit(True).alias("scorable"), F.lit("CALIBRATION").alias("split"))
    wanted = {r["part"]: r["count"] for r in labels.groupBy(train.partition(F.col("adm_party_id")).alias("part")).count().collect()}
    got = train.candidates(labels, v).withColumn("part", train.partition(F.col("adm_party_id"))).collect()
    assert len(got) == 6 and {(r["part"], r["party_id"], r["label"]): r["copies"] for r in got} == {(part, party, int(party == "a")): n for part, n in wanted.items() for party in "ab"}
    scores = spark.createDataFrame([(0.9, True, 8), (0.8, True, 4), (0.7, False, 9)], "score double, correct boolean, copies long")
    assert evaluate.threshold(scores, 0.95, 5, 0.5) == 0.8 and evaluate.threshold(scores, 0.95, 13, 0.5) == 0.5


def test_threshold_reaches_what_it_counted(spark):
    """A level of 7/15 chosen as 0.4667 is not itself below the threshold."""
    scores = spark.createDataFrame([(7 / 15, True)] * 8 + [(0.9, True)] * 4, "score double, correct boolean")
    chosen = evaluate.threshold(scores, 0.98, 5, 0.9)
    assert chosen > 7 / 15 and train.reached(scores, chosen) == 7 / 15
    assert train.reached(scores, 0.9) == 0.9 and train.reached(scores, 0.5) == 0.5


def test_cuts(spark):
    """Between all values if there are few, else at quantiles by weight; none for one value."""
    rows = spark.range(1000).select(F.col("id").cast("double").alias("many"), (F.col("id") % 3).cast("double").alias("few"), F.lit(1.0).alias("one"), F.when(F.col("id") < 500, 1).otherwise(3).alias("copies"))
    got = train.cuts(rows, ["many", "few", "one"], bins=4)
    assert got["few"] == [0.5, 1.5] and got["one"] == []
    assert got["many"] == pytest.approx([499.5, 666.5, 833.5], abs=1)


def test_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text("﻿name,aliases\nAcme,A|B\nBeta,\n", encoding="utf-8")
    got = io.read_names(spark, str(tmp_path / "u.csv"), "name", "id", "v").collect()
    assert [(r["id"], r["name"], r["aliases"]) for r in got] == [("v1", "Acme", "A|B"), ("v2", "Beta", None)]
    (tmp_path / "bad.csv").write_text("name\n \n")
    for column in ("name", "other"):
        with pytest.raises(ValueError):
            io.read_names(spark, str(tmp_path / "bad.csv"), column, "id", "v")
    (tmp_path / "ids.txt").write_text("a\n\nb\na\n")
    assert sorted(r[0] for r in io.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "c.toml").write_text("[a]\nb = 1\n")
    assert io.read_config(str(tmp_path / "c.toml")) == {"a": {"b": 1}}
    default = spark.createDataFrame([(1,)], "x int")
    assert io.read_json(spark, str(tmp_path / "none.json"), "x int", default).count() == 1
    d = spark.createDataFrame([("a", "MATCH", "p", 0.9, "r", "t"), ("b", "NO_MATCH", None, 0.1, "r", "t")], "adm_party_id string, decision string, party_id string, confidence double, reason string, tier string")
    for _ in range(2):
        io.append_ledger(d, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1
    io.write_stages({"one": d, "two": d}, str(tmp_path / "stages"))
    assert spark.read.parquet(str(tmp_path / "stages")).groupBy("stage").count().count() == 2
    io.write_csv(d, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_csv(d, str(tmp_path / "out"))
    assert io.changes(d, d.withColumn("reason", F.when(F.col("adm_party_id") == "a", "x").otherwise(F.col("reason")))).count() == 1


def test_streaming_ledger(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", "Acme Inc"), ("2", "Nobody"), ("3", "ACME, inc.")], "adm_party_id string, raw_name string").write.parquet(src)
    catalog = spark.createDataFrame([("p", "Acme Inc.")], "party_id string, party_name string")

    def match(batch):
        m = incremental.exact_stream(batch, catalog)
        return m.withColumn("decision", F.when(F.col("party_id").isNotNull(), "MATCH").otherwise("NO_MATCH")).withColumn("confidence", F.lit(0.999))

    for n in (2, 2):
        q = incremental.match_batches(spark.readStream.schema("adm_party_id string, raw_name string").parquet(src), match, str(tmp_path / "ledger"), str(tmp_path / f"cp{n}"))
        q.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "ledger")).count() == n


def test_contract(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.oracle_sql()) > 45


@pytest.mark.parametrize("name", ["x04_normalize", "x07_mentions", "x25_soft_coverage", "x26_name_views", "x27_anchored", "x31_regional", "x33_fragments", "j17_raw_prefixes", "f06_split", "g04_closure", "j02_char_cosine", "j03_word_cosine", "j04_vector_top", "a10_metrics", "d23_name_only", "d17_request_cutoff", "w04_rrf", "w08_runner_up"])
def test_oracle(spark, sf, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(e.oracle_sql()[name]).fetchdf()
    got = e.queries()[name](spark, sf).toPandas()[list(want.columns)]
    key = lambda f: sorted(repr([round(x, 5) if isinstance(x, float) else None if x != x else x for x in r]) for r in f.astype(object).where(f.notna(), None).values.tolist())
    assert key(got) == key(want)


def test_reports(spark):
    rules = spark.createDataFrame([("1", "MATCH", "a", "T"), ("2", "MATCH", "b", "RULES_SAFE_VIEW_CORE_ANCHOR"), ("3", "NO_MATCH", "a", None), ("4", "MATCH", "b", "RULES_UNIQUE_CONTAINMENT")], "adm_party_id string, decision string, party_id string, tier string")
    labels = spark.createDataFrame([("1", "a", True, "TEST_KNOWN"), ("2", "b", True, "TRAIN"), ("3", "a", True, "TEST_UNSEEN"), ("4", "a", True, "CALIBRATION"), ("5", None, False, "UNKNOWN")], "adm_party_id string, expected string, scorable boolean, split string")
    got = {r["variant"]: (r["n_matches"], r["n_correct"], r["n_scorable"]) for r in evaluate.counterfactuals(rules, rules.filter("adm_party_id != '2'"), labels).collect()}
    assert got == {"RULES_ONLY": (3, 2, 4), "BEFORE_CORE_ANCHOR": (2, 1, 4), "PRIOR_RULES": (2, 1, 4), "WITHOUT_CONTAINMENT": (1, 1, 4)}
    assert [tuple(r) for r in evaluate.containment(rules, labels).collect()] == [("CALIBRATION", 1, 0, 0.0)]
    check = evaluate.held_out_check(rules.filter("decision = 'MATCH'"), rules.filter("decision != 'MATCH'"), labels).first()
    assert (check["labeled_rows"], check["strong_matches"], check["strong_correct"], check["review_names"], check["strong_recall"]) == (2, 1, 1, 1, 0.5)
    rows = spark.createDataFrame([("x", False, "MATCH", 0.8, None, "PLAIN", None, ["a"], "b"), ("y", False, "NO_MATCH", 0.1, "LOW", "OBO", "NONE", ["a", "b"], "b"), ("z", True, "NO_MATCH", 0.1, "LOW", "MIXED", "OBO_LEFT", ["a", "b"], "b")], "adm_party_id string, scorable boolean, decision string, confidence double, reason string, found_case string, resolution string, retrieved_roots array<string>, expected string")
    assert tuple(evaluate.unknown_stats(rows).select("n_rows", "n_matches", "n_no_matches", "prediction_rate", "average_confidence").first()) == (2, 1, 1, 0.5, 0.8)
    assert [tuple(r) for r in evaluate.no_match_reasons(rows).collect()] == [("LOW", 2)]
    tags = {r["adm_party_id"]: r["t"] for r in rows.select("adm_party_id", evaluate.cohorts().alias("t")).collect()}
    assert tags == {"x": ["ALL_HELD_OUT", "NO_OBO", "NO_VIA", "PLAIN"], "y": ["ALL_HELD_OUT", "NO_VIA", "OBO_ONLY", "CONNECTOR_ABSTAINED"], "z": ["ALL_HELD_OUT", "OBO_AND_VIA", "CONNECTOR_CONFLICT", "CONNECTOR_ABSTAINED"]}
    assert [r[0] for r in rows.orderBy("adm_party_id").select(evaluate.expected_rank()).collect()] == [None, None, 2]
    names = spark.createDataFrame([("p", f"name {i:03}", f"u{i}", True) for i in range(300)] + [("q", "one", "v", True)], "party_id string, raw_name string, adm_party_id string, matched boolean").repartition(6)
    cells = evaluate.name_chunks(names, 500).orderBy("party_id", "chunk").collect()
    assert "\n".join(c["names"] for c in cells if c["party_id"] == "p") == "\n".join(f"name {i:03}" for i in range(300)) and max(len(c["names"]) for c in cells) < 520
    assert io.markdown(spark.createDataFrame([("a|b", 0.5)], "x string, y double"), "T").splitlines()[-1] == "| a\\|b | 0.5000 |"


def test_audit_and_snapshots_of_suggestions(spark):
    verified = spark.createDataFrame([("l", "Abbott Laboratories"), ("m", "Abbott Molecular")], "party_id string, party_name string")
    pairs = spark.createDataFrame([("1", "l", "STRONG"), ("2", "m", "STRONG"), ("3", "l", "REVIEW"), ("4", "m", "DROPPED")], "adm_party_id string, party_id string, status string")
    labels = spark.createDataFrame([("1", "l", "TEST_KNOWN", True), ("2", "l", "TEST_KNOWN", True), ("3", "l", "TRAIN", True), ("5", "m", "TEST_UNSEEN", True)], "adm_party_id string, expected string, split string, scorable boolean")
    index = spark.createDataFrame([("2", "l"), ("1", "l")], "adm_party_id string, party_id string")
    assert {(r["adm_party_id"], r["party_id"], r["reason"]) for r in suggest.label_gaps(pairs, index, labels).collect()} == {("2", "l", "INDEXED_BUT_NOT_FAMILY_QUALIFIED"), ("5", "m", "NOT_RETRIEVED_FOR_PARTY")}
    got = {r["party_id"]: r for r in suggest.audit(pairs, index, labels, verified).collect()}
    assert (got["l"]["n_strong"], got["l"]["n_review"], got["l"]["known_labels"], got["l"]["gate_exclusions"], got["l"]["held_out_strong_recall"], got["l"]["held_out_strong_precision"]) == (1, 1, 3, 1, 0.5, 1.0)
    assert (got["m"]["index_misses"], got["m"]["held_out_strong_precision"], got["m"]["held_out_strong_recall"]) == (1, 0.0, 0.0)

    names = spark.createDataFrame([("1", "Abbott Molecular Inc"), ("2", "Abbott Nutrition"), ("3", "Zebra")], "adm_party_id string, raw_name string")

    def build(n, v):
        found = suggest.suggest(n, v)
        decided = found.select("adm_party_id", F.when(F.col("status") == "SUGGESTED", "MATCH").otherwise("NO_MATCH").alias("decision"), F.when(F.col("status") == "SUGGESTED", F.col("party_id")).alias("party_id"))
        return decided, found.filter("status = 'AMBIGUOUS'").select("adm_party_id")

    both = suggest.two_snapshots(names, verified, verified.filter("party_id = 'm'"), build)
    assert {r["transition"]: r["n"] for r in both["movements"].collect()} == {"MOVED": 1, "LOST_STRONG": 1, "UNCHANGED": 1}
    assert both["before"].first()["strong_names"] == 2 and both["after"].first()["review_only_names"] == 1
    records = spark.createDataFrame([(True, False, "A"), (False, False, "B"), (True, True, "C"), (True, False, " ")], "eligible boolean, is_verified boolean, raw_name string")
    assert [r["why"] for r in suggest.intake(records).collect()] == [None, "INELIGIBLE_OR_VERIFIED", "INELIGIBLE_OR_VERIFIED", "BLANK"]
    mentions = matcher.mentions(spark.createDataFrame([("1", "Abbott Labs"), ("2", "Other OBO Abbott"), ("3", "A OBO B VIA C"), ("4", "OBO Abbott")], "adm_party_id string, raw_name string"))
    assert {(r["token"], r["adm_party_id"]) for r in suggest.family_index(mentions).collect()} == {("abbott", "1"), ("other", "2")}


def test_sample_and_sheet(spark, tmp_path):
    rows = prepare.sample(spark, ["Acme Widgets Inc", "Zeta Corp"])
    cleaned = prepare.clean(rows)
    assert rows.count() == 14 and cleaned.filter("cleaning = 'VERIFIED_SELF_ROW'").count() == 3
    assert {r["category"]: r["n"] for r in prepare.sample_summary(rows).collect()}["plain"] == 2
    assert prepare.prefix(rows, 3).count() == 3
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Names" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Raw Name</t></si><si><r><t>Ac</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Id</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7.0</v></c></row><row/><row><c r="C4" t="b"><v>1</v></c></row></sheetData></worksheet>')
    got = io.read_sheet(spark, str(tmp_path / "b.xlsx"), "Names")
    assert got.columns == ["Raw Name", "Id"] and [tuple(r) for r in got.collect()] == [("Acme", "7"), (None, "TRUE")]
    with pytest.raises(ValueError):
        io.read_sheet(spark, str(tmp_path / "b.xlsx"), "Other")
    d = spark.createDataFrame([("a",), ("b",)], "adm_party_id string")
    assert io.checked({"x": d.limit(1), "y": d.exceptAll(d.limit(1))}, d) == {"x": 1, "y": 1}
    for parts in ({"x": d, "y": d.limit(1)}, {"x": d.limit(1)}):
        with pytest.raises(ValueError):
            io.checked(parts, d)


def test_numbering_by_ranges(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(13), [F.col("x")]).collect()
    assert sorted((r["x"], r["index"]) for r in got) == [(i, i) for i in range(1000)]


def test_left_out_subpackage_is_optional():
    import __spark_entry__ as e

    names = set(e.queries())
    there = importlib.util.find_spec("onomast.llm") is not None and importlib.util.find_spec("onomast.llm.queries") is not None
    assert ("pipeline" in names) == (there and importlib.util.find_spec("corpus_pipeline") is not None)
    assert any(n.startswith("op1_") for n in names) == there
