"""Language ID, token counts, chat formatting, fingerprints and HTML against plain Python."""

import base64
import functools
import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from onomast.llm import _common, chat, fingerprint, html, langid, minhash, queries, tokencount, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", "a", "  two  spaces\n\n and\ttabs \n", "it's we'll I'd", "<|endoftext|> x", "naïve ß 漢字 🙂", "x" * 5000, "\u00a0\u2003 odd \x1c spaces", "end \n", "don't  'S"]


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab C'\n\t.,1é ") for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode(PATH, texts) == want
    assert tokens.encode(PATH, [None]) == [[]]
    assert tokens.counts(PATH, [*texts, None]).tolist() == [*map(len, want), 0]


def test_histogram(spark):
    lengths = [0, 0, 3, 3, 3, 7, 1024, 1025, 5000]
    h = {r["n_tokens"]: r for r in tokencount.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")).collect()}
    assert set(h) == set(lengths)
    for n, r in h.items():
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["docs_longer"] == sum(x > n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["tokens_cut_here"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
    full = tokencount.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    assert tokencount.cut_total(full, 100).first()[0] == sum(min(x, 100) for x in lengths)
    assert tokencount.quantile(full, 0.5).first()[0] == 3
    assert tokencount.histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_lengths_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a b", 3)], "text string, n_tokens int")
    assert sorted(r[0] for r in tokencount.lengths(df, PATH).collect()) == [0, 0, 2]


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97


def ppm(train, order):
    """Probability of a byte after a context, by language, straight from the definition."""
    counts: dict[tuple, dict[int, int]] = {}
    for lang, texts in train.items():
        for text in texts:
            for i, byte in enumerate(text):
                for k in range(min(i, order) + 1):
                    followers = counts.setdefault((lang, text[i - k : i]), {})
                    followers[byte] = followers.get(byte, 0) + 1

    @functools.cache
    def left(lang, context):
        """What the bytes not seen here have in the shorter context, all together."""
        return sum(p(lang, context[1:], b) if context else 1 / 256 for b in range(256) if b not in counts[lang, context])

    @functools.cache
    def p(lang, context, byte):
        seen = counts.get((lang, context))
        below = p(lang, context[1:], byte) if context else 1 / 256
        if not seen:
            return below
        total, distinct = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (total + (distinct if left(lang, context) > 0 else 0))
        return distinct / (total + distinct) * below / left(lang, context)

    return p


def test_langid_query_against_brute_force(spark, sf):
    """The registered query on all short texts: code lengths straight from the definition."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op6_langid(spark, sf).collect()}
    train: dict[str, list[bytes]] = {}
    rows = docs.collect()
    sizes: dict[str, int] = {}
    learn = [r for r in rows if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    for r in learn:
        sizes[r["lang"]] = sizes.get(r["lang"], 0) + 1
    for r in learn:
        if int(hashlib.md5(f"langid|{r['doc_id']}".encode()).hexdigest()[:13], 16) < (1 << 52) * min(1.0, 400 / sizes[r["lang"]]):
            train.setdefault(r["lang"], []).append(r["text"].encode())
    p, langs = ppm(train, 3), sorted(train)
    checked = 0
    for r in rows:
        text = (r["text"] or "").encode()
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
        elif len(text) < 300:
            bits = [-sum(np.log2(p(lang, text[max(0, i - 3) : i], text[i])) for i in range(len(text))) for lang in langs]
            checked += 1
            assert got[r["doc_id"]]["lang_pred"] == langs[int(np.argmin(bits))]
            assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(2 ** -(b - min(bits)) for b in bits), abs=0.05)
    assert checked > 5 and len(got) == len(rows)


def test_language_groups_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (langid.train(docs, most_bytes=n) for n in (1 << 30, 1))
    assert len(one.groups) == 1 and len(many.groups) == len(one.langs) > 1
    result = lambda m: {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs, m, keep=["doc_id"]).collect()}
    assert result(one) == result(many)


def test_code_lengths_by_hand():
    """The automaton's sums against a direct evaluation of the tree."""
    train = {"x": b"abracadabra", "y": b"banana bandana"}
    order = 2
    grams: dict[tuple[str, int], int] = {}
    for lang, text in train.items():
        line = [langid.START] * order + list(text)
        for i in range(order, len(line)):
            code = sum(line[i - b] * langid.BASE**b for b in range(order + 1))
            grams[lang, code] = grams.get((lang, code), 0) + 1
    model = langid.build(np.array([k[0] for k in grams], object), np.array([k[1] for k in grams]), np.array(list(grams.values()), float), order)
    p = ppm({lang: [text] for lang, text in train.items()}, order)
    for text in (b"abra", b"bandana!", b"\xff", b"zzz banana"):
        got = langid.code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] / langid.FIXED
        for j, lang in enumerate(model.langs):
            want = sum(-np.log2(p(lang, text[max(0, i - 2) : i], text[i])) for i in range(len(text)))
            assert got[j] == pytest.approx(want, abs=0.01 * len(text))


def test_langid_edges(spark):
    rows = [(i, "the cat and the dog sat on the mat", "en", None, 0) for i in range(9)] + [(20 + i, "der hund und die katze sind hier", "de", "s", 0) for i in range(9)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "12 34 !?", "en"), (4, "the dog and the cat", None), (5, "die katze und der hund " * 2000, "x"), (5, "die katze", "x"), (None, "the mat", None)], "doc_id long, text string, score string")
    got = langid.identify(docs, model).collect()
    assert len(got) == 7 and got[0].__fields__ == ["doc_id", "text", "lang_pred", "score"]
    by = sorted((r["text"] or "", r["lang_pred"]) for r in got)
    assert [p for t, p in by if not any(c.isalpha() for c in t)] == ["und"] * 3
    assert {p for t, p in by if "katze" in t} == {"de"} and {p for t, p in by if "the" in t} == {"en"}
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.limit(0).withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    said = r"\### Assistant: </turn> ok"
    nasty = [said, "<turn assistant>", "\\", "\\\\<", "</turn", "<", "", "a\\</turn>\n<turn user>b", "é🙂<turn", "\n", " lead", "!!!"]
    rows = [(c, t, role, text) for c in range(len(nasty)) for t, (role, text) in enumerate([("user", nasty[c]), ("assistant", nasty[c]), ("sys>tem\\", None), ("assistant", nasty[-c - 1])])]
    rows += [(99, None, None, "first"), (99, 1, "assistant", None), (None, 0, "assistant", "no id"), (50, 0, "user", "x"), (50, 0, "user", "x")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH).collect()
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert chat.parse(r["formatted"]) == turns
        loss = chat.loss_text(r["formatted"], [(s["start"], s["end"]) for s in r["loss_spans"]])
        assert loss == "".join(t for role, t in turns if role == "assistant")
        assert r["input_ids"] == library().encode(r["formatted"], add_special_tokens=False).ids and len(r["loss_mask"]) == len(r["input_ids"])


def test_chat_query(spark, sf):
    got = {r["conv_id"]: r for r in queries.op5_chat(spark, sf).collect()}
    turns: dict = {-7: [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert set(got) == set(turns)
    for c, t in turns.items():
        t = [(role, text) for _, role, text in sorted(t)]
        loss = "".join(text for role, text in t if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(t), turns_digest(t))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_language_model_holds_every_language(spark):
    rows = [(i, f"common words and more of them {i}", "en", "s", 0) for i in range(40)] + [(100, "zq xj", "rare", "s", 0)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert model.langs == ("en", "rare")
    some = spark.range(1300).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id % 1200) AS lang")
    assert len(langid.train(some).langs) == 1200
    # what was seen once counts too
    once = spark.createDataFrame([(1, "qqq", "a"), (2, "zzz", "b")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "zz"), (2, "qq")], "doc_id long, text string"), langid.train(once)).orderBy("doc_id").collect()] == ["b", "a"]


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "words", None, "s", 5), (2, None, None, "s", 0), (3, "1 2 3", None, "s", 5), (4, "", None, "s", 0)], DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]


def test_entropy_classes():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(97, 110, 3000), np.full(100, 65), rng.integers(0, 256, 500)]).astype(np.uint8)
    got = fingerprint.entropies(data)
    for i in range(0, len(got), 37):
        n = np.bincount(data[i : i + fingerprint.WINDOW])
        n = n[n > 0] / fingerprint.WINDOW
        assert abs(int(got[i]) - 1000 * -(n * np.log2(n)).sum() / np.log2(fingerprint.WINDOW)) < 1.5


def test_fingerprints(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    long = text(900)
    docs = [(1, "short"), (2, None), (3, ""), (5, long), (7, long), (9, text(400)), (11, long[: len(long) // 2]), (13, "ß🙂" * 30), (13, "tie"), (None, "no id"), (15, text(60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rank = fingerprint.rarity(df)
    got = fingerprint.neighbours(df, rank).collect()
    assert len(got) == len(docs)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
    for i, (key, body) in enumerate(order):
        if key == 13:
            continue
        r, nxt = texts[key][0], order[(i + 1) % len(order)]
        if nxt[0] != 13:
            want = fingerprint.edited(body or "", nxt[1] or "")
            assert r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_chars"] == len(body or "") and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert texts[5][0]["fingerprint"] == texts[7][0]["fingerprint"] != texts[9][0]["fingerprint"]
    assert texts[7][0]["near_next"] == 1 and texts[9][0]["near_next"] < 0.2 and texts[9][0]["near_edited"] > 0.3
    chain = lambda key: base64.b64decode(texts[key][0]["fingerprint"])
    assert fingerprint.likeness(chain(11), chain(5)) > 0.8 and texts[2][0]["fingerprint"] == ""
    assert dict(fingerprint.neighbours(df, rank).dtypes)["fingerprint"] == "string"
    assert fingerprint.neighbours(df.limit(0), rank).count() == 0
    one = fingerprint.neighbours(df.filter("doc_id = 5"), rank).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(fingerprint.edited(long, long).encode()).hexdigest()


def test_fingerprint_neighbours_of_hot_and_large_ids(spark):
    """Rows of one id, of none, and of ids beyond what doubles hold: each row has the next one, once."""
    big = 2**53
    docs = [(big + i, f"text {i}") for i in range(40)] + [(5, f"hot {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(-3, "low"), (-(2**63), "least"), (2**63 - 1, "most"), (5, "hot 7")]
    rng = random.Random(1)
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashed[d[1]]))
    want = sorted((str(key), hashlib.sha256(fingerprint.edited(text, nxt).encode()).hexdigest()) for (key, text), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True))
    got = fingerprint.neighbours(df, fingerprint.rarity(df)).collect()
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == want


def test_fingerprint_query_against_brute_force(spark, sf):
    """The registered query: digests and likeness from plain Python, one window at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    entropy = lambda w: int(np.rint(1000 * (1 - sum(np.rint(c * np.log2(c) * 4096) if c > 1 else 0 for c in Counter(w).values()) / (16 * 4 * 4096))))
    classes = {}

    def windows(data):
        if data not in classes:
            classes[data] = [entropy(data[i : i + 16]) for i in range(len(data) - 15)]
        return classes[data]

    total = Counter(c for t in texts.values() for c in windows(t.encode()))
    key = lambda c: (2**63 if c < 250 else total.get(c, 0), c)
    rank = {c: i for i, c in enumerate(sorted(range(1001), key=key))}
    mix = lambda x: int(fingerprint.mix64(np.array([x], np.uint64))[0])

    def digest(text):
        data = text.encode()
        if not data:
            return b""
        ranks = [rank[c] for c in windows(data)]
        if not ranks:
            chosen = [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")]
        else:
            places = range(len(ranks))
            if len(ranks) > 64:
                votes = Counter(min(range(i, i + 32), key=lambda j: (ranks[j], j)) for i in range(len(ranks) - 31))
                places = sorted(i for i, n in votes.items() if n > 5) or sorted(sorted(places, key=lambda j: (ranks[j], j))[:64])
            chosen = [mix(mix(int.from_bytes(data[i : i + 8], "little")) ^ (int.from_bytes(data[i + 8 : i + 16], "little") * 0x9E3779B97F4A7C15 % 2**64)) for i in places]
        out = b""
        for lo in range(0, len(chosen), 160):
            bits = 0
            for h in chosen[lo : lo + 160]:
                for i in range(5):
                    place = (h >> 11 * i) % 2048
                    bits |= 1 << (place ^ 7)  # the first bit is a byte's highest
            out += bits.to_bytes(256, "little")
        return out

    def like(x, y):
        if x == y or not x or not y:
            return float(x == y)
        a, b = sorted(([int.from_bytes(v[i : i + 256], "little") for i in range(0, len(v), 256)] for v in (x, y)), key=len)
        best = []
        for f in a:
            scores = []
            for g in b:
                chance = f.bit_count() * g.bit_count() / 2048
                scores.append(min(1, max(0, ((f & g).bit_count() - chance) / max(min(f.bit_count(), g.bit_count()) - chance, 1e-9))))
            best.append((max(scores), f.bit_count()))
        return sum(s * n for s, n in best) / sum(n for _, n in best)

    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    assert set(got) == set(texts)
    some = sorted(order, key=lambda i: len(texts[i]))[:120]  # the classes above are of all texts; digests of the shorter ones
    for key_ in some:
        following = texts[order[(order.index(key_) + 1) % len(order)]]
        r, new = got[key_], fingerprint.edited(texts[key_], following)
        assert base64.b64decode(r["fingerprint"]) == digest(texts[key_]) and base64.b64decode(r["edited_fingerprint"]) == digest(new)
        assert r["near_edited"] == pytest.approx(like(digest(texts[key_]), digest(new))) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        if len(following) < 4000:
            assert r["near_next"] == pytest.approx(like(digest(texts[key_]), digest(following)))


def test_token_count_query_against_the_library(spark, sf):
    lengths = sorted(len(e.ids) for e in library().encode_batch([r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()], add_special_tokens=False))
    got = {r["n_tokens"]: r for r in queries.op8_tokencount(spark, sf).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["n_docs"] == lengths.count(n) and r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["tokens_cut_here"] == sum(min(x, n) for x in lengths) and r["total_tokens"] == sum(lengths) and r["total_docs"] == len(lengths)


def test_fingerprints_of_even_texts():
    """Runs of one character and repeated units have features of their own."""
    texts = [b"", b"a" * 500, b"b" * 500, b"abcdefgh" * 60, b"ijklmnop" * 60, b"a" * 3000]
    rank = np.arange(fingerprint.CLASSES)
    got = fingerprint.digests(*fingerprint._flat(texts), rank)
    assert got[0] == b"" and all(got[1:]) and got[1] == got[5]
    for i in range(1, 5):
        assert got[i] == fingerprint.digests(*fingerprint._flat([texts[i]]), rank)[0]
        assert all(fingerprint.likeness(got[i], got[j]) < 0.5 for j in range(5) if j != i)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a="</p>";</script><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><aside>Side</aside><article><h1>Title {0}</h1><p>First&nbsp;&eacute;  {0}
 line<br>more<p>Unclosed <b>bold {0}<div class="share">Share</div><form><input value="x">Send</form><ul><li>one {0}</li><li>two</li></ul></article><div id=comments><p>Nice</p></div><footer>&copy; me</footer>"""


def test_html_article(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(6)] + [(10, None, None), (11, "no scheme", ""), (12, "http://h.example/x", "plain &lt;text&gt;"), (13, "http://one.example/", PAGE.format(0)), (0, "http://h.example/0", PAGE.format(0))]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    for i in (*range(6), 13):
        n = 0 if i == 13 else i
        assert by[i]["text"] == f"Title {n}\nFirst é {n} line more\nUnclosed bold {n}\none {n}\ntwo"
    assert by[10]["text"] == by[11]["text"] == "" and by[12]["text"] == "plain <text>" and by[12]["n_chars"] == 12
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_removes_what_repeats(spark):
    """Without any telling markup, what all pages of a host share is noise."""
    page = "<html><body><div><p>Same links on all pages</p></div><section><p>Body {0}</p><p>More {0} of it</p></section></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)] + [(100, "http://alone.example/", page.format(100))]
    by = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i] == f"Body {i}\nMore {i} of it" for i in range(8))
    assert by[100].startswith("Same links")


def test_html_marks_are_whole_names():
    text = lambda body: html.Page(f"<html>{body}</html>").text(frozenset())
    for body in ('<body class="has-sidebar">{}', '<div id="content-with-nav">{}</div>', '<body class="search">{}', '<div class="widget">{}</div>', '<my-app class="widget">{}</my-app>', '<div class="promo"><p>Not this</p>{}</div>'):
        for tag in ("article", 'article class="post comments-open ad-free"', "main class=widget", "div role=main"):
            end = tag.split()[0]
            assert text(body.format(f"<{tag}><p>All of it</p></{end}>")).split("\n")[-1] == "All of it"
    assert text('<article><p>One</p><div class="cookie-notice box">a</div><div id="ad-slot-3">b</div><span class="adBox">c</span></article>') == "One"
    assert text('<article><p>One</p></article><div id=comments><article><p>Nice</p></article></div>') == "One"
    assert text('<main><p>One</p><div id=comments><article><p>Nice</p></article></div></main>') == "One"
    assert text('<article><div class="banner">In</div><div class="masthead"><p>two</p></div><p>three</p></article>') == "In\ntwo\nthree"
    assert text('<div class="header">Out</div><div class="banner">Out</div><p>In</p>') == "In"


def test_style_tree_counts_copies_once_and_keeps_branches(spark):
    plain = "<html><body><div><p>Only copies {0}</p></div></body></html>"
    rows = [(i, "http://two.example/", plain.format("two")) for i in range(2)]
    rows += [(10 + i, "http://most.example/", plain.format("a" if i < 20 else i)) for i in range(23)]
    # the section's own text is the same on all pages, what stands below it differs; the menu is low throughout
    page = "<html><body><ul><li>Menu<li>Links</ul><section>Lead<p>Body {0}</p></section></body></html>"
    rows += [(100 + i, "http://branch.example/", page.format(i)) for i in range(8)]
    by = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(by) == len(rows)
    assert all(by[i] == "Only copies two" for i in range(2))
    assert all(by[10 + i] == f"Only copies {'a' if i < 20 else i}" for i in range(23))
    assert all(by[100 + i] == f"Lead\nBody {i}" for i in range(8))


def article(page):
    """The text of the article of the test pages, by the library's parser: their markup is regular."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        blocks, now, inside = None, "", False

        def cut(self):
            if self.now.split():
                self.blocks.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.now += " " if tag == "br" else ""
            if tag in ("p", "h1", "article"):
                self.cut()

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article"):
                self.cut()
            self.inside &= tag != "article"

        def handle_data(self, data):
            self.now += data if self.inside else ""

    reader = Reader()
    reader.blocks = []
    reader.feed(page)
    reader.close()
    return "\n".join(reader.blocks)


def test_html_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op4_html(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        assert got[r["page_id"]]["text"] == article(r["html"]) and got[r["page_id"]]["n_chars"] == len(article(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def test_style_tree_needs_no_markup(spark):
    """The pages with all telling names taken away: the trees find the articles."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1)).filter("host like 'm.%' or host like 'www.%'").select("page_id", "url", "html")
    bare = F.col("html")
    for i, tag in enumerate(("nav", "article", "footer")):
        bare = F.regexp_replace(F.regexp_replace(bare, f"<{tag}>", f'<div class="k{chr(97 + i)}">'), f"</{tag}>", "</div>")
    bare = F.regexp_replace(bare, 'class="ad"', 'class="kd"')
    want = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    got = {r["page_id"]: r["text"] for r in html.extract(pages.withColumn("html", bare)).collect()}
    trees = html.plans(pages.withColumn("html", bare)).count()
    assert trees > 5 and sum(got[i] == want[i] for i in want) >= 0.97 * len(want) > 100


def test_html_is_read_in_linear_time():
    n = 200_000
    for page in ("<div>" * n, "<div>x" * n, '<a "' * n, "<span class=ad>x" * n, "<b class=ad><p>x" * n, "<ul><li>" + "<div>" * n + "<li></li>" * n, "<div>" * n + "</p></section>" * n, "<!--" * n, "<div class=ad>x" * n):
        began = time.process_time()
        html.Page(page).text()
        assert time.process_time() - began < 60
    assert html.Page("a<b class=ad>x<p>y").text() == "ax\ny" and html.Page("a<b class=ad>x<p>y</b>c").text() == "a\nc" and html.Page("a<b class=ad>x<article>m</article></b>c").text() == "m"
    assert html.Page('a <i "b>c').text() == "a c" and html.Page("1 < 2 <").text() == "1 < 2 <"


def test_workers_hold_little(monkeypatch):
    """The arrays a worker works with stay small next to its batch, and results do not depend on where it is cut."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, int(n), np.uint8)).decode() for n in rng.integers(2, 9, 3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 3000, 400)) for _ in range(1500)]
    texts[7:9] = [texts[6]] * 2  # copies
    batch = pa.record_batch([pa.array(range(1500)), pa.array(texts), pa.array([("en", "de")[i % 2] for i in range(1500)])], ["doc_id", "text", "lang"])
    assert batch.nbytes > 3_000_000
    judged = pa.record_batch([batch.column(1), pa.nulls(1500, pa.string()), pa.array([float("inf")] * 1500), pa.array([0.0] * 1500)], ["text", "best", "bits", "mass"])
    counts: Counter = Counter()
    for b in langid._grams([batch.slice(0, 200)], 2):
        for lang, gram, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counts[lang, gram] += n
    model = langid.build(np.array([k[0] for k in counts], object), np.array([k[1] for k in counts]), np.array(list(counts.values()), float), 2)
    assert model.cost.nbytes <= model.step.nbytes  # two languages at two bytes
    shared = type("Shared", (), {"value": model})

    def peak(run, given):
        rows = 0
        tracemalloc.start()
        for out in run([given]):
            rows += out.num_rows
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows
        return most / 1e6

    most = {"grams": peak(lambda it: langid._grams(it, 2), batch), "pass": peak(langid._pass(shared, "text"), judged), "sign": peak(minhash._sign, batch)}
    assert max(most.values()) < 30, most

    def results():
        signed = pa.Table.from_batches(list(minhash._sign([batch]))).to_pylist()
        passed = pa.Table.from_batches(list(langid._pass(shared, "text")([judged]))).to_pylist()
        return signed, passed

    as_is = results()
    for module in (langid, minhash):
        monkeypatch.setattr(module, "CUT_BYTES", 1 << 20)
    assert results() == as_is


def test_workers_give_memory_back():
    """What a task has freed does not stay with its worker."""
    import psutil

    def run(batches):
        for _ in batches:
            held = [bytes(2000) for _ in range(60_000)]  # below what the C library maps by itself
            last = [bytes(2000)]
            del held
            yield last

    before = psutil.Process().memory_info().rss
    kept = [x for x in _common.lean(run)(range(2))]
    assert len(kept) == 2 and psutil.Process().memory_info().rss - before < 40 << 20


def test_pipeline_bounds_batches(spark):
    """Long texts go to the workers a few at a time, and a session that asks for less keeps that."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word and "), 12_000).alias("text"))
        corpus_pipeline.sequences(spark, docs.limit(0).coalesce(1), "")
        sizes = docs.mapInArrow(lambda it: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in it), "n long").collect()
        assert max(r["n"] for r in sizes) <= _common.BATCH_BYTES + 200_000
        spark.conf.set(key, "1m")
        _common.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
