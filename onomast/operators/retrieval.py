"""Candidate retrieval: exact names and TF-IDF similarity top-k, fused by reciprocal rank.

All of it runs on *distinct* mention texts that carry how many mentions have them: ranks
and scores depend on the text alone, while document counts weigh by mentions. The
similarity join is an equi-join of the postings of rare grams, with a prefix filter that
loses nothing, exact cosines of the candidates and a top-k window (``WindowGroupLimit``);
nothing is broadcast by hand and AQE splits the postings of frequent grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions import text as X
from onomast.operators.settle import settle


@dataclass(frozen=True)
class Retrieval:
    """Limits of the shortlist; a root is a verified party at the top of its hierarchy."""

    roots: int = 50
    variants: int = 2
    k: int = 60
    word_floor: float = 0.18
    char_floor: float = 0.28
    vector_floor: float = 0.42
    vector_top: int = 100


def char_grams(text: Column) -> Column:
    """Character 3- to 5-grams within words padded by a space, with repeats."""
    padded = F.transform(X.tokens(F.regexp_replace(F.lower(text), r"\s+", " ")), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda w: F.flatten(F.transform(F.sequence(F.lit(3), F.least(F.lit(5), F.length(w))), lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))
    return F.flatten(F.transform(padded, cut))


def word_grams(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


GRAMS = {"char": char_grams, "word": word_grams}


def postings(texts: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``gram``, ``tf``: how often each text has each gram."""
    return texts.select(*keep, F.explode(GRAMS[kind](F.col("text"))).alias("gram")).groupBy(*keep, "gram").agg(F.count(F.lit(1)).alias("tf"))


def fit(texts: DataFrame, kind: str) -> DataFrame:
    """``gram, idf`` of the mentions: ln((1 + n) / (1 + df)) + 1. ``texts``: text, copies."""
    df = postings(texts, kind, ["text", "copies"]).groupBy("gram").agg(F.sum("copies").alias("df"))
    n = texts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    return df.select("gram", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(texts: DataFrame, kind: str, idf: DataFrame, key: str) -> DataFrame:
    """``key, gram, w``: sublinear TF-IDF, L2-normalised over the grams that ``idf`` knows."""
    w = postings(texts, kind, [key]).join(idf, "gram").withColumn("w", (F.log("tf") + 1.0) * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("w"))


def _split(w: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(text, gram, w) and each text's rest (text, rest, tail): its commonest grams, of norm ``share`` at most together."""
    order = Window.partitionBy("text").orderBy("idf", F.desc("gram"))
    placed = w.withColumn("tail", F.sqrt(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    common = placed.filter(F.col("tail") <= share)
    rest = common.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("rest"), F.max("tail").alias("tail"))
    return placed.filter(F.col("tail") > share).select("text", "gram", "w"), rest


def cosine_top(mentions: DataFrame, names: DataFrame, kind: str, floor: float, top: int, idf: DataFrame) -> DataFrame:
    """``text, name, score, rank``: each text's best ``top`` names above ``floor``.

    Prefix filtering, without loss: of each mention the commonest grams, half the floor in
    norm together, are not joined, so what nearly all names have (a legal form) meets nothing.
    What they could add to a cosine is bounded by their norm; pairs that cannot reach the floor
    with it are dropped, and the others get the exact remainder from the name's weights.
    """
    known = settle(idf)
    left = weights(mentions, kind, known, "text").join(known, "gram")
    right = settle(weights(names.select(F.col("name"), F.col("name").alias("text")), kind, known, "name"))
    rare, rest = _split(settle(left), floor / 2)
    met = rare.withColumnRenamed("w", "wl").join(right.withColumnRenamed("w", "wr"), "gram").groupBy("text", "name").agg(F.sum(F.col("wl") * F.col("wr")).alias("part"))
    open_ = met.join(rest, "text", "left").filter(F.col("part") + F.coalesce("tail", F.lit(0.0)) > floor - 1e-9)
    whole = right.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("all"))
    both = open_.join(whole, "name")
    more = F.aggregate(F.map_entries("rest"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col("all"), e["key"]), F.lit(0.0)))
    scores = both.select("text", "name", F.round(F.col("part") + F.coalesce(more, F.lit(0.0)), 12).alias("score")).filter(F.col("score") > floor)
    best = Window.partitionBy("text").orderBy(F.desc("score"), "name")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


QUERY_ROWS = 4096


def vector_top(names: DataFrame, mentions: DataFrame, top: int, floor: float, digits: int = 12) -> DataFrame:
    """``name, text, score``: each name's ``top`` mentions by cosine of unit vectors (``v``).

    Names are the query side. They are dealt into groups of about ``QUERY_ROWS``, mentions into
    blocks, and each block meets each group in one task: what is held is one of each, and
    nothing passes through the driver. A block gives at most ``top`` rows for a name. Scores are
    rounded to ``digits`` before they are compared; ties go to the smaller text.
    """
    import numpy as np
    import pandas as pd

    size = lambda df: max(1, -(-df.count() // QUERY_ROWS))
    groups, blocks = size(names), size(mentions)
    slot = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = names.select(F.col("name").alias("id"), "v", F.lit(True).alias("asks"), slot("name", groups).alias("g")).withColumn("b", every(blocks))
    held = mentions.select(F.col("text").alias("id"), "v", F.lit(False).alias("asks"), slot("text", blocks).alias("b")).withColumn("g", every(groups))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        q, rows = frame[frame["asks"]], frame[~frame["asks"]]
        out = []
        if len(q) and len(rows):
            texts, v = rows["id"].to_numpy(), np.stack(rows["v"].to_list()).astype(np.float64)
            order = np.argsort(texts, kind="stable")
            texts, v = texts[order], v[order]
            for name, x in zip(q["id"], q["v"], strict=True):
                s = np.round(v @ np.asarray(x, np.float64), digits)
                at = np.argsort(-s, kind="stable")[:top]
                at = at[s[at] >= floor]
                out.append(pd.DataFrame({"name": name, "text": texts[at], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"name": [], "text": [], "score": []})

    found = asked.unionByName(held).groupBy("g", "b").applyInPandas(meet, "name string, text string, score double")
    best = Window.partitionBy("name").orderBy(F.desc("score"), "text")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("name", "text", "score")


def distinct_texts(mentions: DataFrame) -> DataFrame:
    n = F.sum("copies") if "copies" in mentions.columns else F.count(F.lit(1))
    return mentions.filter("text != ''").groupBy("text").agg(n.alias("copies"))


def hits(mentions: DataFrame, variants: DataFrame, cfg: Retrieval = Retrieval(), idf: dict[str, DataFrame] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """``text, name, exact, char, word, rrf, embedding, lexical, sources``: merged hits.

    ``mentions`` has text; ``variants`` has name and norm_name. ``vectors`` (name, text, score) are
    optional embedding hits.
    """
    texts = distinct_texts(mentions)
    names = variants.select("name", F.col("norm_name").alias("norm")).distinct()
    top = cfg.roots * cfg.variants
    parts = []
    same = texts.withColumn("norm", X.normalize(F.col("text"))).join(names, "norm").select("text", "name")
    parts.append(hit_rows(same, "exact"))
    for kind, floor in (("char", cfg.char_floor), ("word", cfg.word_floor)):
        own = idf[kind] if idf else fit(texts, kind)
        parts.append(hit_rows(cosine_top(texts, names, kind, floor, top, own), kind, cfg.k))
    if vectors is not None:
        parts.append(hit_rows(vectors, "embedding"))
    return merged(parts, top)


def hit_rows(found: DataFrame, source: str, k: int = 60) -> DataFrame:
    """Rows of one retriever as ``merged`` takes them: ``found`` has text, name, and score and rank where it ranks."""
    zero, one, none = F.lit(0.0), F.lit(1.0), F.lit(None).cast("double")
    exact = source == "exact"
    score = lambda kind: one if exact else F.col("score").cast("double") if kind == source else zero
    rrf = 1.0 / (k + F.col("rank")) if source in ("char", "word") else zero
    return found.select("text", "name", F.lit(source).alias("source"), (one if exact else zero).alias("exact"), score("char").alias("char"), score("word").alias("word"), rrf.alias("rrf"), (F.col("score").cast("double") if source == "embedding" else none).alias("embedding"))


def merged(parts: list[DataFrame], top: int) -> DataFrame:
    """Hits of all retrievers, one row for each (text, name); all exact ones and the ``top`` best others of a text."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = every.groupBy("text", "name").agg(*[F.max(c).alias(c) for c in ("exact", "char", "word")], F.sum("rrf").alias("rrf"), F.max("embedding").alias("embedding"), F.array_sort(F.collect_set("source")).alias("sources"))
    found = found.withColumn("lexical", F.greatest("char", "word"))
    order = Window.partitionBy("text").orderBy(F.desc("exact"), F.desc("rrf"), F.desc(F.greatest("lexical", F.coalesce("embedding", F.lit(0.0)))), "name")
    placed = found.withColumn("rn", F.row_number().over(order)).withColumn("same", F.sum(F.col("exact").cast("int")).over(Window.partitionBy("text")))
    return placed.filter((F.col("exact") == 1) | (F.col("rn") - F.col("same") <= top)).drop("rn", "same")


def root_percentiles(short: DataFrame) -> DataFrame:
    """How many roots a text has: median, 95th percentile (interpolated) and most. ``short``: text, root_id."""
    n = short.groupBy("text").agg(F.count_distinct("root_id").alias("n"))
    return n.agg(F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("most"))


def cap_counters(found: DataFrame, variants: DataFrame, closure: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    """How many texts met a cap: more roots than are kept, or a root with more variants than are kept."""
    owned = found.select("text", "name").join(variants.select("name", "party_id", "norm_name"), "name").join(closure.select("party_id", "root_id"), "party_id")
    per = owned.groupBy("text", "root_id").agg(F.count_distinct("party_id", "norm_name").alias("v")).groupBy("text").agg(F.count(F.lit(1)).alias("roots"), F.max("v").alias("most"))
    return per.agg(F.count_if(F.col("roots") > cfg.roots).alias("root_cap_hits"), F.count_if(F.col("most") > cfg.variants).alias("variant_cap_hits"))


def shortlist(found: DataFrame, variants: DataFrame, closure: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    """Hits with their owners and roots: the best variants of each root, the best roots of each text.

    ``variants``: party_id, name, norm_name, type, source, confidence. ``closure``: party_id, root_id, depth, path.
    """
    priority = F.when(F.col("exact") == 1, F.lit(2.0)).otherwise(F.greatest("lexical", F.coalesce("embedding", F.lit(0.0))) + F.least(F.lit(0.05), F.col("rrf")))
    owned = found.join(variants, "name").join(closure, "party_id").withColumn("priority", priority)
    same = Window.partitionBy("text", "root_id", "party_id", "norm_name").orderBy(F.desc("priority"), F.desc("name"))
    owned = owned.withColumn("rn", F.row_number().over(same)).filter("rn = 1")
    of_root = Window.partitionBy("text", "root_id").orderBy(F.desc("priority"), "party_id", "norm_name")
    owned = owned.withColumn("rn", F.row_number().over(of_root)).filter(F.col("rn") <= cfg.variants)
    owned = owned.withColumn("best", F.max("priority").over(Window.partitionBy("text", "root_id")))
    roots = Window.partitionBy("text").orderBy(F.desc("best"), "root_id")
    return owned.withColumn("rn", F.dense_rank().over(roots)).filter(F.col("rn") <= cfg.roots).drop("rn", "best")


def pair_cosine(pairs: DataFrame, kind: str, idf: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """``left, right, out``: the cosine of each given pair of texts under a fitted ``idf``."""
    texts = pairs.select(F.col(left).alias("text")).unionByName(pairs.select(F.col(right).alias("text"))).distinct()
    w = weights(texts.withColumn("t", F.col("text")), kind, idf, "t")
    unique = pairs.select(left, right).distinct()
    joined = unique.join(w.withColumnsRenamed({"t": left, "w": "wl"}), left).join(w.withColumnsRenamed({"t": right, "w": "wr"}), [right, "gram"])
    sums = joined.groupBy(left, right).agg(F.sum(F.col("wl") * F.col("wr")).alias(out))
    return unique.join(sums, [left, right], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
