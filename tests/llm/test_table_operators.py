"""Packing, top-k, near-dedup, URL filters, mixing and the pipeline against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from onomast.llm import minhash, mixing, packing, queries, topk, urlfilter

PATH = public_tokenizers.path("byte_bpe_50k.json")


def layout_is_valid(rows, limit=1024):
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


@given(st.lists(st.integers(1, 1024), max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_and_bound(lengths):
    where, offset, fill = packing.best_fit(np.array(lengths, np.int64))
    assert layout_is_valid([{"sequence_id": w, "offset": o, "length": n} for w, o, n in zip(where, offset, lengths, strict=True)]) == len(fill)
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025) if lengths else np.zeros(1025, int))
    assert -(-sum(lengths) // 1024) <= bound <= len(fill)


def test_bound_sees_halves():
    assert packing.lower_bound(np.bincount([513] * 5, minlength=1025)) == 5
    assert packing.lower_bound(np.bincount([342] * 9 + [1], minlength=1025)) == 5


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 700, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    got = packing.pack(df, group_rows=500).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == rows
    assert layout_is_valid(got) <= packing.lower_bound(np.bincount([n for _, n in rows], minlength=1025)) + 3


def test_packing_query(spark, sf):
    got = queries.op1_packing(spark, sf).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], i] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert layout_is_valid(got) <= -(-sum(v[1] for v in want.values()) // 1024) + 4


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", None), (3, "word " * 3000, "z")], "doc_id long, text string, offset string")
    got = packing.pack(packing.pieces(docs, PATH, keep=["doc_id", "offset"])).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 2, None: 1, 3: 3}
    layout_is_valid(got)
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "doc_id long, length long"))


def brute(vectors, k=10):
    out = {}
    for q, a in vectors:
        if q % 100 == 0:
            scored = sorted(((-int(np.dot(a, b)), i) for i, b in vectors if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(700, 16)) * rng.choice([0.02, 0.3, 1.0], size=(700, 1))
    base[300:500] = base[7]  # a very common vector: only ids decide
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(800, None), (900, [None] * 16), (1000, [float("nan")] * 16), (1100, [float("inf")] * 16), (None, [0.1] * 16), (1200, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = topk.integers(df)
    ints = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows[:700]]
    for group in (16_384, 3):
        got: dict = {}
        for r in topk.search(index, index.filter("vec_id % 100 = 0"), group=group).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == brute(ints)
    few = topk.integers(df.filter("vec_id < 3"))
    assert [(r["vec_id"], r["rank"]) for r in topk.search(few, few.filter("vec_id = 0")).collect()] == [(i, n + 1) for n, (i, _) in enumerate(brute(ints[:3])[0])]
    none = topk.integers(df.limit(0))
    assert topk.search(none, none).count() == 0


def test_topk_of_odd_tables(spark):
    """Lengths apart, empty vectors, one id with several vectors, numbers beyond 64 bits; no case depends on the order of rows."""
    rows = [(0, []), (100, []), (3, []), (200, [0.5]), (4, [1.0]), (5, [2.0]), (300, [1.0, 0.0]), (300, [-1.0, 0.0]), (300, [3.0, 1.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0]), (7, [4.0, 0.0])]
    rows += [(400, [1e16, 1e16, 1.0]), (8, [1e16, 1e16, 0.0]), (9, [-1e300, 1.0, 0.0]), (10, [1.0, 1.0, 1.0])]
    for seed in range(2):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3 + seed)
        index = topk.integers(df)
        got: dict = {}
        for r in topk.search(index, index.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        most, k = 2**63 - 1, 1024 * 1024
        assert got[0] == [(3, 0), (100, 0)] and got[100] == [(0, 0), (3, 0)] and got[200] == [(5, k), (4, k // 2)]
        assert got[300] == [(6, -2 * k), (7, -2 * k), (7, -4 * k)]
        assert got[400] == [(8, most), (10, most), (9, -most - 1)]


def test_many_rules_are_joined(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, "x"), (-3, "http://example.com")], "page_id long, url string"))
    rules = [*queries.RULES, ("example.com", "", "allow"), ("com", "/en/", "allow")]
    listed = pages.filter("page_id % 3 = 0").select(urlfilter.canonical(F.col("url")))
    few = urlfilter.judge(pages, listed, rules)
    many = urlfilter.judge(pages, listed, rules + [(f"h{i}.test", f"/{i}", "block") for i in range(urlfilter.MAX_RULES)])
    assert sorted(map(str, few.collect())) == sorted(map(str, many.select(few.columns).collect()))


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def linked_components(docs):
    sets = {}
    for i, text in docs:
        sets.setdefault(i, []).append(shingles(text))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_minhash_against_brute_force(spark):
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(300)])
    docs = []
    for g in range(12):
        base = rng.choice(words, 120)
        for c in range(14):
            copy = base.copy()
            copy[rng.choice(120, rng.integers(0, 8), replace=False)] = rng.choice(words, 1)
            docs.append((g * 100 + c, " ".join(copy) if c % 3 else " ".join(copy).upper()))
    docs += [(5000, "a b"), (5001, "A  B"), (5002, "a b c"), (5003, None), (5004, ""), (5005, " \t\n"), (5006, "x\u00a0y z"), (5007, docs[0][1]), (5007, docs[0][1]), (None, "gone")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = minhash.cluster(df).collect()
    kept = [d for d in docs if d[0] is not None]
    want = linked_components(kept)
    assert len(got) == len(kept)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in kept}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.cluster(df.limit(0)).count() == 0


def test_signatures_estimate():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = round(2000 * share / (1 + share))  # common ones of 1000 each
        a, b = both[:1000], both[1000 - n : 2000 - n]
        x, y = (np.frombuffer(minhash.signature(minhash.minima(s)), np.uint8) for s in (a, b))
        assert abs(minhash.similar((x == y).sum()) - n / (2000 - n)) < 0.08


def test_minhash_blocks_of_a_bucket(spark, monkeypatch):
    """Buckets larger than a block are split into pairs of blocks, and nothing is lost."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):  # a chain: neighbours are near, the ends are not
        copy = list(base)
        copy[: 3 * i] = [f"x{j}" for j in range(3 * i)]
        docs.append((int(rng.integers(0, 10**6)) * 100 + i, " ".join(copy)))
    got = minhash.cluster(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == linked_components(docs)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_url_rules_and_filter(spark):
    rows = [(1, "HTTP://WWW.Bad.Example.COM/en/7?x=1#y"), (2, "https://a.example.net/de/8/z"), (3, "https://x.example.net/de/9"), (4, "http://b.example.org/es/1"), (5, "http://spam.io/p.html?ref=1&b=2&a=1"), (6, "http://www.spam.io/p/?a=1&b=2#q"), (7, None), (8, "no scheme"), (9, "http://ok.io"), (10, "http://notexample.com/en/7"), (11, "x://com/en/"), (5, "http://spam.io/p.html?ref=1&b=2&a=1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("spam.io/p?a=1&b=2",), (None,), ("other",), ("spam.io/p?a=1&b=2",)], "u string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, listed, queries.RULES).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == {
        1: ("example.com/en/7", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "block"), 4: ("org/es/", "block"), 5: (None, "block"), 6: (None, "block"),
        7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: ("com/en/", "block"), 11: ("com/en/", "block"),
    }
    assert (got[1]["host"], got[1]["path"]) == ("www.bad.example.com", "/en/7") and (got[7]["host"], got[7]["path"], got[9]["path"]) == ("", "", "")
    assert urlfilter.judge(pages, listed).count() == len(rows)
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_url_query_lists_every_bad_host(spark, sf):
    rows = {r["page_id"]: r for r in queries.op9_urlfilter(spark, sf).collect()}
    bad = [r for r in rows.values() if any(f".{name}." in "." + r["host"] for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"))]
    assert any("ads-track" in r["host"] for r in bad) and all(r["listed"] and r["verdict"] == "block" for r in bad if r["rule"] is None)
    own = queries.op9_urlfilter(spark, sf, hosts=["ads-track"]).filter("listed").collect()
    assert {r["host"] for r in own} == {r["host"] for r in bad if "ads-track" in r["host"] and r["rule"] is None}
    assert queries.op9_urlfilter(spark, sf, hosts=[]).filter("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    urls = spark.range(3000).select(F.concat(F.lit("h.example/"), "id").alias("canon"))
    pages = spark.range(6000).select("id", F.concat(F.lit("http://h.example/"), "id").alias("url"))
    assert {r["id"] for r in urlfilter.judge(pages, urls).filter("verdict = 'block'").collect()} == set(range(3000))


def test_mixing(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "cold", f"t{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("replica", F.lit("clash"))
    got = mixing.mix(docs, {"hot": 1.0, "cold": 4.0}, default=0.0).toPandas()
    assert got.source.isna().sum() == 0
    share = got.source.value_counts() / 6000
    assert abs(share["cold"] - 0.8) < 0.06 and abs(share["hot"] - 0.2) < 0.03
    per = got[got.source == "cold"].groupby("doc_id").replica.agg(["count", "max"])
    assert (per["count"] == per["max"] + 1).all() and abs(got[got.source == "cold"].groupby("doc_id").size().reindex([r[0] for r in rows if r[1] == "cold"], fill_value=0).var() - 4.8) < 1.2
    again = mixing.mix(docs.repartition(3), {"hot": 1.0, "cold": 4.0}, default=0.0).toPandas()
    assert sorted(zip(got.doc_id, got.replica, strict=True)) == sorted(zip(again.doc_id, again.replica, strict=True))
    assert mixing.mix(docs, {}, default=0.0).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"hot": -1.0})


def test_mixing_high_rates(spark):
    docs = spark.createDataFrame([(i, "s") for i in range(50)], "doc_id long, source string")
    n = mixing.mix(docs, {"s": 1.0}, total=50 * 130.0).groupBy("doc_id").count().toPandas()["count"]
    assert len(n) == 50 and abs(n.mean() - 130) < 6 and 60 < n.var() < 260


def test_pipeline_against_plain_python(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = [(r["doc_id"], r["text"], r["source"]) for r in docs if r["text"] and any(c.isalpha() for c in r["text"])]
    comp = linked_components([(i, t) for i, t, _ in kept])
    kept = [d for d in kept if comp[d[0]] == d[0]]
    n = Counter(s for _, _, s in kept)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    import hashlib
    import math

    want: Counter = Counter()
    for i, text, source in kept:
        rate = len(kept) / len(n) / n[source]
        parts = max(1, math.ceil(rate / mixing.PART))
        copies = 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"mix|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u and k < mixing.ENTRIES:
                copies += 1
                k += 1
                p = p * (rate / parts) / k
                c += p
        size = len(t.encode(text, add_special_tokens=False).ids) + 1
        for piece in range(-(-size // 1024)):
            want[i, piece] += copies
    assert Counter((r["doc_id"], r["piece"]) for r in got) == Counter({k: v for k, v in want.items() if v})
    layout_is_valid(got)


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing columns, empty tables."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, score string, Replica string, lang_pred int, length int"
    english, german = "the cat and the dog sat on the mat with another cat", "der hund und die katze sind heute alle zusammen hier"
    rows = [(i, f"{english} {i} {chr(97 + i) * 5}", "en", "a", 1, "kept", f"r{i}", i, 7) for i in range(12)] + [(20 + i, f"{german} {i} {chr(97 + i) * 5}", "de", "b", 1, "kept", f"r{20 + i}", 20 + i, 7) for i in range(12)]
    same = "one and the same text that comes again and again in this very table of ours"
    rows += [(50, same, None, None, None, "kept", "r50", 50, 7), (51, same, None, "a", None, "kept", "r51", 51, 7), (52, same, "en", "a", 1, "kept", "r52", 52, 7), (52, same, "en", "a", 1, "kept", "r52", 52, 7)]
    rows += [(60, None, "en", "a", 1, "kept", "r60", 60, 7), (61, "", "en", "a", 1, "kept", "r61", 61, 7), (62, "12 %", None, "a", 1, "kept", "r62", 62, 7), (None, "no id but the words and letters of a text", None, "a", 1, "kept", "r0", 0, 7), (70, "word " * 30_000, "en", "a", 1, "kept", "r70", 70, 7)]
    docs = spark.createDataFrame(rows, shape).repartition(3)
    one = corpus_pipeline.language(spark, docs, "")
    assert one.columns == docs.columns
    got = one.collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((r[0] or 0) for r in rows if r[0] not in (60, 61, 62))
    assert all(r["score"] == "kept" and r["Replica"] == f"r{r['doc_id'] or 0}" and r["lang_pred"] == (r["doc_id"] or 0) and r["lang"] is not None for r in got)
    two = corpus_pipeline.near_duplicates(spark, one, "")
    assert two.columns == docs.columns and sorted((r["doc_id"] or 0) for r in two.collect()) == sorted((r[0] or 0) for r in rows if r[0] not in (51, 52, 60, 61, 62))
    three = corpus_pipeline.mixture(spark, two, "")
    assert three.columns == docs.columns and all(r["Replica"] == f"r{r['doc_id'] or 0}" for r in three.collect())
    four = corpus_pipeline.sequences(spark, two, "").collect()
    layout_is_valid(four)
    assert {r["doc_id"] for r in four} == {r["doc_id"] for r in two.collect()} and max(r["piece"] for r in four if r["doc_id"] == 70) > 20
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "").count() == len(rows) - 3


def test_minhash_query_finds_all_links(spark):
    """The registered query against an inverted index of all shingles: no link is lost."""
    sf = "/root/testdata/sf0.01"
    sets = {r["doc_id"]: frozenset(shingles(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    by: dict = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    got = {r["doc_id"]: r for r in queries.op3_minhash(spark, sf).collect()}
    links = 0
    for i, s in sets.items():
        assert got[i]["n_shingles"] == len(s)
        shared = Counter(j for g in s for j in by[g] if j < i)
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                links += 1
                assert got[i]["component_id"] == got[j]["component_id"]
    assert links > 50
