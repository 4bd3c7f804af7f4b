"""URL filtering: a blocked Bloom filter in front of an exact hash join, and rules.

The listed canonical URLs set bits of a blocked Bloom filter: a URL's hash picks one
block of 512 bits and sets one bit in each of its eight 64-bit words. The filter is a
table of blocks, built by one aggregation. URLs whose bits are all set are possible
hits and only they are joined, by hash, with the list itself, which removes the false
positives. The blocks are broadcast if their counted size allows, else joined by block.

Rules (host, path prefix, verdict) come first: a rule fits its host and all subdomains
if the URL's path starts with the rule's path; the longest one (host and path together)
wins, ties to the later in the list. URLs that no rule fits get the list's verdict.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A null URL, or one without
``://``, has an empty host and path, fits no rule and is allowed. Repeated URLs are
judged alike, empty tables give empty results, an empty list blocks nothing. Other columns
are carried as they are; those called like a result are replaced. Up to ``MAX_RULES`` rules
are one CASE expression; more are a table that pages are joined with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm._common import materialise, maybe_broadcast, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, BITS_PER_URL = 8, 16
MAX_RULES = 200


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without ``/`` or ``.html`` at its end, and the sorted
    parameters without tracking ones (``utm_*``, ``ref``); scheme and fragment go."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_") & ~x.startswith("ref=")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"(\.html)?/*$", ""), tail)


def rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for at, prefix, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith(prefix)
        name = F.when(fits, F.lit(at + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``onomast rule`` and ``onomast verdict`` by a join, for any number of rules.

    A page's candidates are its host's suffixes with its path's beginnings of the lengths that
    rules have: an equi-join. It runs on distinct (host, path), of which a salt deals repeats.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, v, len(h) + len(p), i) for i, (h, p, v) in enumerate(rules)], "rh string, rp string, verdict string, size int, at int")
    lengths = sorted({len(p) for _, p, _ in rules})
    h, p = F.col("`onomast host`"), F.col("`onomast path`")
    parts = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(p)), lambda n: F.substring(p, F.lit(1), n))
    asked = materialise(pages.select(h, p).distinct())
    keys = asked.withColumn("rh", F.explode(suffixes)).withColumn("rp", F.explode(starts))
    best = keys.join(table, ["rh", "rp"]).groupBy(h, p).agg(F.max_by(F.struct(F.concat("rh", "rp").alias("name"), "verdict"), F.struct("size", "at")).alias("r"))
    best = materialise(best.select(h, p, F.col("r.name").alias("onomast rule"), F.col("r.verdict").alias("onomast verdict")))
    return pages.join(maybe_broadcast(best, 256), ["onomast host", "onomast path"], "left")


def _bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(url)
    g = F.xxhash64(url, F.lit(1))
    return F.pmod(h, F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's non-empty blocks: ``block`` and words ``w0`` to ``w7``. ``listed`` has ``canon``."""
    block, words = _bits(F.col("canon"), blocks)
    return listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), *, url: str = "url") -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``listed``.

    ``listed``: one column of canonical URLs (nulls and repeats are passed over).
    """
    exact = materialise(listed.toDF("canon").filter("canon is not null and canon != ''").distinct())
    n = exact.count()
    blocks = max(1, -(-n * BITS_PER_URL // 512))
    pages = without(pages, "host", "path", "rule", "verdict", "listed")
    names = [F.col(f"`{c}`") for c in pages.columns]
    u = F.col(f"`{url}`")
    parsed = pages.select(*names, host(u).alias("onomast host"), path(u).alias("onomast path"))
    if len(rules) > MAX_RULES:
        parsed = ruled(parsed, rules)
    else:
        says, verdict = rule(F.col("`onomast host`"), F.col("`onomast path`"), rules)
        parsed = parsed.withColumns({"onomast rule": says, "onomast verdict": verdict})
    block, words = _bits(F.col("`onomast canon`"), blocks)
    asked = parsed.withColumn("onomast canon", canonical(u)).withColumn("onomast block", block)
    small = maybe_broadcast(bloom(exact, blocks), 72, min(blocks, n)).alias("b")
    tested = asked.alias("a").join(small, F.col("a.`onomast block`") == F.col("b.block"), "left")
    passes = F.lit(True)
    for i, w in enumerate(words):
        passes = passes & (F.col(f"b.w{i}").bitwiseAND(w) != 0)
    tested = tested.select("a.*", F.coalesce(F.col("`onomast verdict`").isNull() & (F.col("`onomast canon`") != "") & passes, F.lit(False)).alias("onomast maybe"))
    # only possible hits can meet the list; the others get keys of their own, so that they are dealt evenly
    key = F.when(F.col("`onomast maybe`"), F.col("`onomast canon`")).otherwise(F.xxhash64(*names).cast("string"))
    met = exact.select(F.col("canon").alias("onomast key"), F.lit(True).alias("onomast possible"), F.lit(True).alias("onomast hit"))
    keyed = tested.withColumn("onomast key", key).withColumnRenamed("onomast maybe", "onomast possible")
    out = keyed.join(maybe_broadcast(met, 160, n), ["onomast key", "onomast possible"], "left").withColumn("onomast hit", F.coalesce(F.col("`onomast hit`"), F.lit(False)))
    return out.select(
        *names,
        F.col("`onomast host`").alias("host"),
        F.col("`onomast path`").alias("path"),
        F.col("`onomast rule`").alias("rule"),
        F.coalesce(F.col("`onomast verdict`"), F.when(F.col("`onomast hit`"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("`onomast hit`").alias("listed"),
    )
