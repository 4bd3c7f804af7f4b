"""The flat matcher and the recovery stages on small catalogs."""

import pytest
from pyspark.sql import functions as F

from onomast.functions import text as X
from onomast.operators import decide, recovery, train
from onomast.operators.settle import settle
from onomast.plans import catalog, matcher, views

CATALOG = [dict(id="carahsoft", name="Carahsoft Technology Corp."), dict(id="afrl", name="Air Force Research Laboratory"), dict(id="acme_root", name="Acme Holdings Inc."), dict(id="acme_child", name="Acme Services LLC", aliases="Acme Services")]


def flat(spark, names, catalog=CATALOG):
    v, u = matcher.spark_frames(spark, catalog, [dict(id=f"u{i}", name=n) for i, n in enumerate(names)])
    return {r["unverified_name"]: r for r in matcher.match_flat(v, u).collect()}


def test_flat_names(spark):
    got = flat(spark, ["Acme Services LLC", "Unknown Organization", "Carahsoft Technology Corp. OBO Air Force Research Laboratory", "Carahsoft Technology - Partner", "Carahsoft Technologies", "", "OBO Acme", "Carahsoft Technology Corp. LATAM Export Division"])
    assert {n: r["verified_id"] for n, r in got.items()} == {
        "Acme Services LLC": "acme_child", "Unknown Organization": None, "Carahsoft Technology Corp. OBO Air Force Research Laboratory": "carahsoft", "Carahsoft Technology - Partner": "carahsoft",
        "Carahsoft Technologies": "carahsoft", "": None, "OBO Acme": None, "Carahsoft Technology Corp. LATAM Export Division": "carahsoft",
    }
    assert got["Carahsoft Technology - Partner"]["decision_tier"] == "RULES_SAFE_VIEW_FIRST_SEGMENT" and got["Carahsoft Technologies"]["decision_tier"] == "RULES_SAFE_VIEW_PLURAL_IES"
    assert (got[""]["reason"], got["OBO Acme"]["reason"]) == ("EMPTY_NAME", "MALFORMED_CONNECTOR")


def test_flat_errors(spark):
    v, u = matcher.spark_frames(spark, CATALOG, [dict(id="u", name="x")])
    with pytest.raises(ValueError):
        matcher.match_flat(v.unionByName(v), u)
    assert matcher.match_flat(v.limit(0), u).first()["reason"] == "NO_VERIFIED_PARTIES"
    with pytest.raises(ValueError):
        matcher.spark_frames(spark, [dict(id="a", name="A", parent_id="b")], [])


def proposal(adm, mention, position, root, score, **more):
    return dict(adm_party_id=adm, mention_id=f"{adm}:m{position}", mention_text=mention, mention_norm=mention.lower(), party_id=root, owner_name=root, root_id=root, root_name=root, name=root, norm_name=root.lower(), type="official", collisions=1, exact=0.0, char=0.9, word=0.9, digit_conflict=0.0, distinctive_conflict=0.0, candidate_coverage=0.5, token_jaccard=0.2, score=score, sources=["char"], path=[root], parties=10, idf={"x": 1.0}, **more)


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], "adm_party_id string, mention_id string, mention_text string, mention_norm string, party_id string, owner_name string, root_id string, root_name string, name string, norm_name string, type string, collisions long, exact double, char double, word double, digit_conflict double, distinctive_conflict double, candidate_coverage double, token_jaccard double, score double, sources array<string>, path array<string>, parties long, idf map<string,double>")


def connectors(spark, left, right, kind="OBO"):
    records = matcher.prepared(spark.createDataFrame([("r", f"Alpha {kind} Beta")], "adm_party_id string, raw_name string"))
    parties = spark.createDataFrame([("Alpha", "Alpha", "alpha", "Alpha"), ("Beta", "Beta", "beta", "Beta")], "party_id string, party_name string, party_norm string, root_id string")
    props = frame(spark, [proposal("r", "Alpha", 0, "Alpha", left), proposal("r", "Beta", 1, "Beta", right)])
    return decide.connectors(records, matcher.mentions(records), props, parties, decide.Policy(system=0.80, short_names=False)).first()


@pytest.mark.parametrize("kind,left,right,party,resolution", [("OBO", 0.95, 0.90, "Alpha", "OBO_LEFT"), ("VIA", 0.90, 0.95, "Alpha", "VIA_LEFT"), ("OBO", 0.40, 0.95, "Beta", "ONLY_MATCH"), ("OBO", 0.79, 0.95, "Alpha", "PREFERRED_NEAR_CUTOFF"), ("VIA", 0.3, 0.2, "Alpha", "NONE")])
def test_connector_preference(spark, kind, left, right, party, resolution):
    got = connectors(spark, left, right, kind)
    assert (got["party_id"], got["resolution"]) == (party, resolution)
    assert (got["decision"] == "MATCH") == (resolution not in ("PREFERRED_NEAR_CUTOFF", "NONE"))


def test_plain_margin_and_guards(spark):
    records = matcher.prepared(spark.createDataFrame([("a", "Alpha"), ("b", "Alpha"), ("c", "Alpha"), ("d", "Alpha"), ("e", "Alpha")], "adm_party_id string, raw_name string"))
    rows = [proposal("a", "Alpha", 0, "Alpha", 0.95), proposal("a", "Alpha", 0, "Beta", 0.5), proposal("b", "Alpha", 0, "Alpha", 0.95), proposal("b", "Alpha", 0, "Beta", 0.94), proposal("c", "Alpha", 0, "Alpha", 0.95), proposal("d", "Alpha", 0, "Alpha", 0.5)]
    rows[4] = {**rows[4], "digit_conflict": 1.0}
    got = {r["adm_party_id"]: r["reason"] for r in decide.plain(records, frame(spark, rows), decide.Policy()).collect()}
    assert got == {"a": "MATCH", "b": "AMBIGUOUS_FINAL_TARGETS", "c": "DIGIT_CONFLICT", "d": "INSUFFICIENT_SUPPORT", "e": "NO_CANDIDATES"}


def test_full_matcher(spark):
    parties = spark.createDataFrame([("abbott", "Abbott Laboratories", None), ("tock_inc", "Tock, Inc.", None), ("tock_llc", "Tock, LLC", None), ("acme", "Acme Robotics Corp.", None), ("love", "Loveday & Partners Ltd", None), ("mc", "The Mastercard Foundation", None), ("child", "Acme Robotics Services Pty", "acme")], "party_id string, party_name string, parent_id string")
    names = ["Abbott Labs", "Tock Inc", "Acme Robotics Brazil Corp", "Acme Robotics Brazil Analytics", "Loveday and Partners Ltd", "Mastercard Foundation", "Acme Robotics Services", "Zebra Union"]
    records = spark.createDataFrame([(f"u{i}", n) for i, n in enumerate(names)] + [("done", "Acme Robotics Corp.")], "adm_party_id string, raw_name string")
    got = {r["raw_name"]: r for r in matcher.match(parties, records, ledger=spark.createDataFrame([("done",)], "adm_party_id string"))["final"].collect()}
    assert len(got) == 9 and got["Acme Robotics Corp."]["reason"] == "ALREADY_MAPPED"
    found = {n: got[n]["party_id"] for n in names if got[n]["decision"] == "MATCH"}
    assert found["Tock Inc"] == "tock_inc" and found["Loveday and Partners Ltd"] == "love" and found["Mastercard Foundation"] == "mc" and found["Acme Robotics Services"] == "acme"
    assert found["Acme Robotics Brazil Corp"] == "acme" and "Zebra Union" not in found
    # here retrieval gives too little score for the abbreviation rule (0.35); test_second_pass feeds it one that has it
    assert got["Abbott Labs"]["reason"] == "DISTINCTIVE_TOKEN_CONFLICT"


def reviewed(spark, stage, cases):
    """What a recovery stage makes of refused names, each with one direct proposal: tiers, or None."""
    records = matcher.prepared(spark.createDataFrame([(f"r{i}", c[0]) for i, c in enumerate(cases)], "adm_party_id string, raw_name string"))
    parties = [(f"root{i}", c[1], None) for i, c in enumerate(cases)] + [(f"other{i}", c[3], None) for i, c in enumerate(cases) if c[3]]
    p = settle(matcher.rooted(spark.createDataFrame(parties, "party_id string, party_name string, parent_id string"), flat=True))
    rows = [{**proposal(f"r{i}", raw, 0, f"root{i}", score), "name": name, "norm_name": X.plain(name), "mention_norm": X.plain(raw), "root_name": name, "owner_name": name} for i, (raw, name, score, _, _) in enumerate(cases)]
    props = settle(frame(spark, rows).withColumn("idf", F.create_map().cast("map<string,double>")))
    old = [(f"r{i}", c[0], "NO_MATCH", "INSUFFICIENT_SUPPORT", c[2], f"root{i}", 0.5, None) for i, c in enumerate(cases)]
    decisions = decide.shaped(spark.createDataFrame(old, "adm_party_id string, raw_name string, decision string, reason string, confidence double, party_id string, margin double, runner_up_id string"))
    found = {r["adm_party_id"]: r for r in stage(decisions, recovery.Context(records, props, p, {}, props, decide.Policy())).collect()}
    assert len(found) == len(cases) and all(r["party_id"] == f"root{k[1:]}" for k, r in found.items())
    return [found[f"r{i}"]["tier"] if found[f"r{i}"]["decision"] == "MATCH" else None for i in range(len(cases))]


def test_second_pass(spark):
    cases = [
        ("Abbott Labs", "Abbott Laboratories", 0.65, None, "LABORATORY_ABBREVIATION"),
        ("Cabot Labs", "Cabot Laboratories", 0.65, "Cabot Labs Inc", None),
        ("Dorset Molecular", "Dorset Laboratories", 0.65, None, None),
        ("Mastercard Foundation", "The Mastercard Foundation", 0.799, None, "LEADING_ARTICLE_EQUIVALENCE"),
        ("Loveday and Partners", "Loveday & Partners", 0.6, None, "AND_EQUIVALENCE"),
        ("Acme Robotics GmbH", "Acme Robotics Inc", 0.6, None, "LEGAL_SUFFIX_VARIANT"),
        ("Bolton Robotics GmbH", "Bolton Robotics Inc", 0.6, "Bolton Robotics Ltd", None),
        ("Zeta Widgetz", "Zeta Widgets", 0.4, None, "MINOR_SPELLING_VARIANT"),
        ("Ingram Micro Inc. LATAM Export Division", "Ingram Micro Inc", 0.3, None, "OFFICIAL_NAME_WITH_CONTEXT"),
        ("Tech Data Corp. LATAM Export Division", "Tech Data Corp", 0.2, None, None),
    ]
    assert reviewed(spark, recovery.second_pass, cases) == [c[4] and f"RULES_SECOND_PASS_{c[4]}" for c in cases]


def test_regional_stage(spark):
    hit = "RULES_REGIONAL_HEURISTIC"
    cases = [("Acme Brazil", "Acme", 0.5, None, hit), ("Bolt Brazil Analytics", "Bolt", 0.5, None, None), ("Corex North America Division", "Corex Inc", 0.5, None, hit), ("Dynax Brazil", "Dynax", 0.3, None, None), ("Ergon Brazil", "Ergon", 0.5, "Ergon Tools", None)]
    assert reviewed(spark, recovery.regional, cases) == [c[4] for c in cases]


def test_pooled_segments(spark):
    """The older way: all segments of a name compete for one root, and their support is counted."""
    records = matcher.prepared(spark.createDataFrame([("r", "Alpha OBO Beta")], "adm_party_id string, raw_name string"))
    props = frame(spark, [proposal("r", "Alpha", 0, "Alpha", 0.95), proposal("r", "Beta", 1, "Beta", 0.80), proposal("r", "Alpha B", 1, "Alpha", 0.7)])
    got = matcher.baseline(records, matcher.mentions(records), props, None, decide.Policy(system=0.8), pooled=True).first()
    assert (got["decision"], got["party_id"]) == ("MATCH", "Alpha")
    assert {(r["root_id"], r["support"]) for r in decide.support(props).collect()} == {("Alpha", 2), ("Beta", 1)}


def test_events(spark):
    d = decide.shaped(spark.createDataFrame([("a", "n", "MATCH", "p", 0.9), ("b", "m", "NO_MATCH", None, 0.1)], "adm_party_id string, raw_name string, decision string, party_id string, confidence double"))
    assert [r["adm_party_id"] for r in matcher.events(d, "acc").collect()] == ["a"]
    jobs = spark.createDataFrame([("p", 0.95, 0)], "party_id string, cutoff double, job_order int")
    cut = {r["adm_party_id"]: r["reason"] for r in decide.request_cutoff(d, jobs).collect()}
    assert cut["a"] == "BELOW_REQUEST_CUTOFF"
    assert decide.override(d, d.filter("adm_party_id = 'a'").withColumn("reason", F.lit("X"))).filter("reason = 'X'").count() == 1


def test_registered_matchers_take_every_record(spark, sf):
    """Records with one written name each get their own decision and proposals, and weigh in by their number."""
    written = {r["adm_party_id"]: r["raw_name"] for r in views.written(spark, sf).collect()}
    assert len(set(written.values())) < len(written)
    flat_rows = catalog.d24_flat_matcher(spark, sf).collect()
    assert sorted(r["unverified_id"] for r in flat_rows) == sorted(written)
    by_name, found = {}, {}
    for r in flat_rows:
        by_name.setdefault(r["unverified_name"], set()).add((r["decision"], r["verified_id"], r["reason"]))
    assert all(len(same) == 1 for same in by_name.values())
    for r in catalog.d01_proposals(spark, sf).collect():
        found.setdefault(r["adm_party_id"], set()).add((r["mention_id"].rpartition(":")[2], r["party_id"], r["name"], r["score"]))
    alike = {}
    for key, name in written.items():
        alike.setdefault(name, []).append(found.get(key))
    assert all(x == group[0] for group in alike.values() for x in group) and len(found) > len(alike) / 2


def test_plain_decisions_round_as_their_sql(spark, tmp_path):
    """A target or margin whose printed decimals end in a half while the scaled double lies just below it."""
    import duckdb

    lines = [(77878, 40793, 2, 4.0, 1634.77, 0.09, 0.0), (327652, 37733, 3, 11.0, 86189.08, 0.08, 0.07), (426700, 56218, 4, 29.0, 33194.99, 0.08, 0.05), (441096, 50684, 5, 26.0, 51532.36, 0.07, 0.06), (514737, 14963, 5, 8.0, 68441.62, 0.1, 0.0), (609699, 48681, 6, 14.0, 8140.36, 0.06, 0.01), (717087, 15289, 7, 35.0, 30718.74, 0.09, 0.07)]
    spark.createDataFrame([(1098121, *r) for r in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1098121,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    for name in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    wanted = db.execute(catalog.SQL["d03_plain_decisions"]).fetchall()
    assert [tuple(r) for r in catalog.d03_plain_decisions(spark, str(tmp_path)).collect()] == wanted


def test_names_are_decided_once(spark, monkeypatch):
    """Written names that repeat are matched once, weighing as often as they are written; each record has the decision."""
    seen, whole = [], matcher.context

    def watched(parties, records, *args, **more):
        seen.extend(records.collect())
        return whole(parties, records, *args, **more)

    monkeypatch.setattr(matcher, "context", watched)
    v, u = matcher.spark_frames(spark, CATALOG, [dict(id=f"u{i}", name=n) for i, n in enumerate(["Acme Services", "Unknown Organization", "Acme Services", None, "", "Acme Services"])])
    got = {r["unverified_id"]: (r["unverified_name"], r["verified_id"], r["reason"]) for r in matcher.match_flat(v, u).collect()}
    assert {(r["raw_name"], r["copies"]) for r in seen} == {("Acme Services", 3), ("Unknown Organization", 1), ("", 2)} and len(seen) == 3
    assert len(got) == 6 and got["u0"] == got["u2"] == got["u5"] and got["u0"][1] == "acme_child" and got["u3"] == got["u4"] == ("", None, "EMPTY_NAME")


def test_position_prior_counts_all_records_of_a_name(spark):
    """Twenty labelled records with one name give the prior of its second part, which then wins between equal parts."""
    ids = [f"r{i:02}" for i in range(20)]
    single, members = matcher.names(spark.createDataFrame([(i, "Alpha Tools - Beta Tools") for i in ids], "adm_party_id string, raw_name string"))
    decisions = decide.shaped(single.select("adm_party_id", "raw_name", F.lit("NO_MATCH").alias("decision")))
    labels = spark.createDataFrame([(i, "Beta") for i in ids], "adm_party_id string, root_id string")

    def retrieve(mentions):
        found = [(r["mention_id"], "Alpha" if "Alpha" in r["text"] else "Beta") for r in mentions.collect() if r["copies"] == 20]
        return frame(spark, [{**proposal(m, root, 0, root, 0.9), "mention_id": m} for m, root in found])

    ctx = recovery.Context(matcher.prepared(single), None, None, {}, None, decide.Policy(), members=members)
    assert recovery.multipart(decisions, ctx, retrieve, labels).first()["party_id"] == "Beta"
    assert recovery.multipart(decisions, ctx, retrieve).first()["party_id"] == "Alpha"


def test_learned_matcher_repeats_no_work(spark, sf, monkeypatch):
    """Candidates are found once for all that reads them, and each written name is decided once, for all its records."""
    fed, kept, seen, whole = [], [], [], matcher.context

    def watched(parties, records, *args, **more):
        seen.extend(records.collect())
        return whole(parties, records, *args, **more)

    monkeypatch.setattr(matcher, "context", watched)
    monkeypatch.setattr(train, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    monkeypatch.setattr(train, "matrix", lambda rows, idf, grams: fed.append(rows) or rows)
    monkeypatch.setattr(train, "fit", lambda rows, held, **more: train.Model(None, None, None, 0.9, 0.9, ""))
    written = {r["adm_party_id"]: r["raw_name"] for r in views.written(spark, sf).collect()}
    got = {r["adm_party_id"]: r for r in catalog.l08_learned_matcher(spark, sf).collect()}
    assert len(fed) == 2 and all(any(rows is k for k in kept) for rows in fed)
    assert got.keys() == written.keys() and sorted(r["raw_name"] for r in seen) == sorted(set(written.values()))
