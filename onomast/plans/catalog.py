"""Registered queries over the test tables, and their DuckDB SQL.

Query names begin with the operator they show: s sources, k sinks, f filters, j joins,
a aggregates, w windows, x scalar functions, d decisions, g graph, l learning, t state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.functions import ids, vocab
from onomast.functions import text as X
from onomast.operators import decide, evaluate, graph, prepare, recovery, retrieval, scoring, suggest, train
from onomast.operators.settle import settle
from onomast.plans import matcher, views
from onomast.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SUFFIX = "|".join(sorted(vocab.LEGAL_SUFFIXES))
CTE = f"WITH parties AS ({views.duck(views.PARTIES)}), written AS ({views.duck(views.WRITTEN)})"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def base(n: str) -> str:
    return f"trim(regexp_replace({n}, '((^| )({SUFFIX}))+$', ''))"


def words(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: t <> '')"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat matcher."""
    return d24_flat_matcher(spark, sf_dir)


# --- text ----------------------------------------------------------------------------

N = norm("raw_name")


@register("x04_normalize", f"{CTE} SELECT adm_party_id, {N} AS norm, {base(N)} AS base, replace({N}, ' ', '') AS compact FROM written")
def x04_normalize(spark, sf):
    n = X.normalize(F.col("raw_name"))
    return views.written(spark, sf).select("adm_party_id", n.alias("norm"), X.base(n).alias("base"), X.compact(n).alias("compact"))


@register(
    "x07_mentions",
    f"""{CTE}, s AS (SELECT adm_party_id, trim(raw_name) AS raw, regexp_split_to_array(trim(raw_name), '\\b(OBO|VIA)\\b') AS p, regexp_extract_all(trim(raw_name), '\\b(OBO|VIA)\\b', 1) AS c FROM written),
b AS (SELECT *, len(list_filter(p, lambda x: trim(x) = '')) > 0 AS bad FROM s),
e AS (SELECT adm_party_id, bad, CASE WHEN bad THEN [raw] ELSE p END AS q, CASE WHEN bad THEN [] ELSE c END AS d FROM b)
SELECT adm_party_id, (i - 1)::INTEGER AS position, trim(q[i]) AS text, CASE WHEN i > 1 THEN d[i - 1] END AS connector_before, d[i] AS connector_after, CASE WHEN bad THEN 'MALFORMED_CONNECTOR' END AS parse_warning
FROM e, unnest(range(1, len(q) + 1)) AS r(i)""",
)
def x07_mentions(spark, sf):
    return matcher.mentions(views.written(spark, sf)).drop("mention_id")


@register("f12_record_case", f"{CTE} SELECT adm_party_id, CASE WHEN raw_name LIKE 'OBO %' THEN 'MALFORMED' WHEN raw_name LIKE '% OBO %' THEN 'OBO' WHEN raw_name LIKE '% VIA %' THEN 'VIA' ELSE 'PLAIN' END AS record_case FROM written")
def f12_record_case(spark, sf):
    return views.written(spark, sf).select("adm_party_id", X.record_case(F.col("raw_name")).alias("record_case"))


PAIRS = f"{CTE}, pairs AS (SELECT w.adm_party_id, {norm('w.raw_name')} AS a, {norm('p.party_name')} AS b FROM written w JOIN parties p ON w.expected = p.party_id)"


def pairs(spark, sf):
    w, p = views.written(spark, sf), views.parties(spark, sf)
    return w.join(p, w.expected == p.party_id).select("adm_party_id", X.normalize(F.col("raw_name")).alias("a"), X.normalize(F.col("party_name")).alias("b"))


SETS = f"{PAIRS}, t AS (SELECT *, list_distinct({words('a')}) AS x, list_distinct({words('b')}) AS y FROM pairs), s AS (SELECT *, list_intersect(x, y) AS i, list_distinct(list_concat(x, y)) AS u FROM t)"


@register("x08_char_ratio")
def x08_char_ratio(spark, sf):
    """Longest-common-subsequence ratio; tested against dynamic programming."""
    p = pairs(spark, sf)
    d = p.select("a", "b").distinct().withColumn("char_ratio", X.char_ratio(F.col("a"), F.col("b")))
    return p.join(d, ["a", "b"]).select("adm_party_id", "char_ratio")


@register("x09_jaro_winkler", f"{PAIRS} SELECT adm_party_id, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM pairs")
def x09_jaro_winkler(spark, sf):
    p = pairs(spark, sf)
    d = p.select("a", "b").distinct().withColumn("jaro_winkler", F.round(X.jaro_winkler(F.col("a"), F.col("b")), 6))
    return p.join(d, ["a", "b"]).select("adm_party_id", "jaro_winkler")


@register("x10_levenshtein", f"{PAIRS} SELECT adm_party_id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS levenshtein FROM pairs")
def x10_levenshtein(spark, sf):
    return pairs(spark, sf).select("adm_party_id", F.round(X.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("levenshtein"))


@register("x11_token_overlap", f"{SETS} SELECT adm_party_id, round(len(i) / greatest(1, len(u)), 6) AS jaccard, round(len(i) / greatest(1, len(x)), 6) AS raw_coverage, round(len(i) / greatest(1, len(y)), 6) AS candidate_coverage FROM s")
def x11_token_overlap(spark, sf):
    return pairs(spark, sf).select("adm_party_id", *[F.round(f(F.col("a"), F.col("b")), 6).alias(n) for n, f in (("jaccard", X.jaccard), ("raw_coverage", X.raw_coverage), ("candidate_coverage", X.candidate_coverage))])


IDF = f"toks AS (SELECT party_id, unnest(list_distinct({words(norm('party_name'))})) AS token FROM parties), idf AS (SELECT token, count(*) AS df, ln((1.0 + (SELECT count(*) FROM parties)) / (1.0 + count(*))) + 1.0 AS idf FROM toks GROUP BY token)"


@register("x12_weighted_overlap", f"{SETS}, {IDF}, e AS (SELECT adm_party_id, x, y, unnest(u) AS token FROM s), g AS (SELECT e.*, coalesce(idf, 1.0) AS w, list_contains(x, e.token) AND list_contains(y, e.token) AS hit, list_contains(y, e.token) AS cand FROM e LEFT JOIN idf ON e.token = idf.token) SELECT adm_party_id, round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS weighted_overlap, round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(CASE WHEN cand THEN w ELSE 0 END), 6) AS weighted_coverage FROM g GROUP BY adm_party_id")
def x12_weighted_overlap(spark, sf):
    idf = scoring.token_idf(views.parties(spark, sf).select(F.col("party_name").alias("name")))
    p = scoring.with_weights(pairs(spark, sf).withColumnsRenamed({"a": "mention_norm", "b": "norm_name"}), idf)
    a, b, w = F.col("mention_norm"), F.col("norm_name"), F.col("idf")
    return p.select("adm_party_id", F.round(X.weighted_overlap(a, b, w), 6).alias("weighted_overlap"), F.round(X.weighted_candidate_coverage(a, b, w), 6).alias("weighted_coverage"))


D = "list_sort(list_filter({0}, lambda t: regexp_matches(t, '[0-9]')))"


@register("x13_digit_conflict", f"{SETS}, d AS (SELECT adm_party_id, {D.format('x')} AS dx, {D.format('y')} AS dy FROM s) SELECT adm_party_id, len(dx) > 0 AND len(dy) > 0 AND dx <> dy AS digit_conflict FROM d")
def x13_digit_conflict(spark, sf):
    return pairs(spark, sf).select("adm_party_id", X.digit_conflict(F.col("a"), F.col("b")).alias("digit_conflict"))


EX = "[" + ", ".join(f"'{w}'" for w in X.EXEMPT) + "]"
SHORT = "len(list_filter({0}, lambda t: NOT list_contains({1}, t) AND NOT list_contains({2}, t) AND length(t) <= 4)) > 0"


@register("x14_distinctive_conflict", f"{SETS} SELECT adm_party_id, len(list_filter(i, lambda t: NOT list_contains({EX}, t))) > 0 AND {SHORT.format('x', 'y', EX)} AND {SHORT.format('y', 'x', EX)} AS distinctive_conflict FROM s")
def x14_distinctive_conflict(spark, sf):
    return pairs(spark, sf).select("adm_party_id", X.distinctive_conflict(F.col("a"), F.col("b")).alias("distinctive_conflict"))


LEGAL = "[" + ", ".join(f"'{w}'" for w in sorted(vocab.LEGAL_SUFFIXES)) + "]"


@register("x15_acronym", f"{CTE}, n AS (SELECT party_id, list_filter({words(norm('party_name'))}, lambda t: NOT list_contains({LEGAL}, t)) AS w FROM parties) SELECT party_id, array_to_string(list_transform(w, lambda t: t[1]), '') AS initials, NOT list_contains({LEGAL}, array_to_string(list_transform(w, lambda t: t[1]), '')) AS related FROM n")
def x15_acronym(spark, sf):
    p = views.parties(spark, sf).withColumn("n", X.normalize(F.col("party_name")))
    w = F.filter(X.tokens(F.col("n")), lambda t: ~t.isin(vocab.LEGAL_SUFFIXES))
    return p.withColumn("initials", F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), "")).select("party_id", "initials", X.acronym(F.col("initials"), F.col("n")).alias("related"))


@register("x16_length_and_suffix", f"{PAIRS} SELECT adm_party_id, round(least(length(a), length(b)) / greatest(1, length(a), length(b)), 6) AS length_ratio, a <> b AND {base('a')} <> '' AND {base('a')} = {base('b')} AS suffix_only FROM pairs")
def x16_length_and_suffix(spark, sf):
    return pairs(spark, sf).select("adm_party_id", F.round(X.length_ratio(F.col("a"), F.col("b")), 6).alias("length_ratio"), ((F.col("a") != F.col("b")) & (X.base(F.col("a")) != "") & (X.base(F.col("a")) == X.base(F.col("b")))).alias("suffix_only"))


@register("x29_legal_form", f"{CTE}, n AS (SELECT adm_party_id, {N} AS n FROM written), t AS (SELECT *, {words('n')} AS w, {base('n')} AS b FROM n) SELECT adm_party_id, b AS base, CASE w[-1] WHEN 'incorporated' THEN 'inc' WHEN 'limited' THEN 'ltd' WHEN 'corporation' THEN 'corp' WHEN 'company' THEN 'co' ELSE w[-1] END AS form FROM t WHERE len(w) >= 2 AND list_contains({LEGAL}, w[-1]) AND NOT list_contains({LEGAL}, w[-2]) AND length(replace(b, ' ', '')) >= 4")
def x29_legal_form(spark, sf):
    form = X.legal_form(X.normalize(F.col("raw_name")))
    return views.written(spark, sf).withColumn("f", form).filter("f is not null").select("adm_party_id", "f.base", "f.form")


ENDS = "|".join(sorted(vocab.ENDINGS))
TOKENS = f"regexp_replace(regexp_replace({norm('replace({0}, chr(38), chr(32) || chr(97) || chr(110) || chr(100) || chr(32))')}, '^the ', ''), '(( )({ENDS}))+$', '')"


@register("x38_name_tokens", f"{CTE} SELECT party_id, {TOKENS.replace('{0}', 'party_name')} AS meaningful FROM parties")
def x38_name_tokens(spark, sf):
    return views.parties(spark, sf).select("party_id", F.array_join(X.name_tokens(F.col("party_name")), " ").alias("meaningful"))


SINGULAR = "CASE WHEN length({0}) >= 6 AND ends_with({0}, 'ies') THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) >= 5 AND ends_with({0}, 's') THEN left({0}, length({0}) - 1) ELSE {0} END"
ALIKE = f"CASE WHEN t = u THEN 1.0 WHEN {SINGULAR.format('t')} = {SINGULAR.format('u')} THEN 0.94 WHEN least(length(t), length(u)) >= 5 AND 1 - levenshtein(t, u) / greatest(length(t), length(u)) >= 0.78 THEN 1 - levenshtein(t, u) / greatest(length(t), length(u)) ELSE 0.0 END"


@register("x24_token_similarity", f"{SETS}, e AS (SELECT DISTINCT unnest(x) AS t, y FROM s), f AS (SELECT DISTINCT t, unnest(y) AS u FROM e) SELECT t, u, round({ALIKE}, 6) AS similarity FROM f")
def x24_token_similarity(spark, sf):
    p = pairs(spark, sf).select("a", "b").distinct()
    t = p.select(F.explode(F.array_distinct(X.tokens(F.col("a")))).alias("t"), F.col("b")).select("t", F.explode(F.array_distinct(X.tokens(F.col("b")))).alias("u")).distinct()
    return t.select("t", "u", F.round(X.token_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


MEANT = f"list_filter({words('{0}')}, lambda t: NOT list_contains([{', '.join(repr(w) for w in X.NOT_WORDS)}], t))"


@register(
    "x25_soft_coverage",
    f"""WITH RECURSIVE {SETS[5:]}, {IDF}, m AS (SELECT DISTINCT a, b, {MEANT.replace('{0}', 'a')} AS x, {MEANT.replace('{0}', 'b')} AS y FROM pairs),
c AS (SELECT a, b, i, j, x[i] AS t, y[j] AS u FROM m, unnest(range(1, len(x) + 1)) AS p(i), unnest(range(1, len(y) + 1)) AS q(j)),
w AS (SELECT c.*, {ALIKE} AS sim, greatest(1.0, coalesce(k.idf, 1.0)) AS l, greatest(1.0, coalesce(n.idf, 1.0)) AS r FROM c LEFT JOIN idf k ON k.token = t LEFT JOIN idf n ON n.token = u),
o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY sim DESC, i DESC, j DESC) AS k FROM w WHERE sim > 0),
g(a, b, k, ui, uj, gl, gr) AS (SELECT a, b, 0::BIGINT, []::BIGINT[], []::BIGINT[], 0.0::DOUBLE, 0.0::DOUBLE FROM m
  UNION ALL SELECT g.a, g.b, o.k, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN ui ELSE list_append(ui, o.i) END, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN uj ELSE list_append(uj, o.j) END,
    CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN gl ELSE gl + o.sim * o.l END, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN gr ELSE gr + o.sim * o.r END
  FROM g JOIN o ON o.a = g.a AND o.b = g.b AND o.k = g.k + 1),
z AS (SELECT a, b, arg_max(gl, k) AS gl, arg_max(gr, k) AS gr FROM g GROUP BY a, b),
sl AS (SELECT a, b, sum(greatest(1.0, coalesce(idf, 1.0))) AS n FROM (SELECT a, b, unnest(x) AS token FROM m) LEFT JOIN idf USING (token) GROUP BY a, b),
sr AS (SELECT a, b, sum(greatest(1.0, coalesce(idf, 1.0))) AS n FROM (SELECT a, b, unnest(y) AS token FROM m) LEFT JOIN idf USING (token) GROUP BY a, b)
SELECT z.a, z.b, round(coalesce(CASE WHEN sr.n IS NULL THEN 0 ELSE gl / sl.n END, 0), 6) AS mine, round(coalesce(CASE WHEN sl.n IS NULL THEN 0 ELSE gr / sr.n END, 0), 6) AS theirs FROM z LEFT JOIN sl ON sl.a = z.a AND sl.b = z.b LEFT JOIN sr ON sr.a = z.a AND sr.b = z.b""",
)
def x25_soft_coverage(spark, sf):
    """Greedy one-to-one coverage, both ways."""
    idf = scoring.token_idf(views.parties(spark, sf).select(F.col("party_name").alias("name")))
    d = scoring.with_weights(pairs(spark, sf).select(F.col("a").alias("mention_norm"), F.col("b").alias("norm_name")).distinct(), idf)
    a, b = F.col("mention_norm"), F.col("norm_name")
    return d.withColumn("c", X.soft_coverage(a, b, F.col("idf"))).select(a.alias("a"), b.alias("b"), F.round("c.mine", 6).alias("mine"), F.round("c.theirs", 6).alias("theirs"))


SEGMENTS = "list_filter(list_transform(regexp_split_to_array({0}, '{1}'), lambda p: trim(p)), lambda p: p <> '')"
_DASH = "[-–—|/]"
VIEW_SEP, PART_SEP = f"-{{2,}}|\\s+{_DASH}\\s*|\\s*{_DASH}\\s+", f"\\s+{_DASH}\\s+|\\s+{_DASH}\\s*|\\s*{_DASH}\\s+"
PAREN = "^(.+?)\\s*\\(([^()]+)\\)\\s*\\.?$"


@register(
    "x26_name_views",
    f"""{CTE}, r AS (SELECT adm_party_id, trim(raw_name) AS raw, {N} AS whole FROM written),
p AS (SELECT *, {SEGMENTS.replace('{0}', 'raw').replace('{1}', VIEW_SEP)} AS seg, {words('whole')} AS w FROM r),
v AS (SELECT adm_party_id, whole, unnest(list_filter([
  CASE WHEN len(seg) > 1 THEN {{'o': 1, 'kind': 'first_segment', 'view': seg[1], 'removed': array_to_string(seg[2:], ' ')}} END,
  CASE WHEN len(seg) > 1 THEN {{'o': 2, 'kind': 'last_segment', 'view': seg[-1], 'removed': array_to_string(seg[:len(seg) - 1], ' ')}} END,
  CASE WHEN regexp_matches(raw, '{PAREN}') THEN {{'o': 3, 'kind': 'without_parenthetical', 'view': trim(regexp_extract(raw, '{PAREN}', 1)), 'removed': trim(regexp_extract(raw, '{PAREN}', 2))}} END,
  CASE WHEN len(w) = 2 AND len(list_filter(w, lambda t: length(t) BETWEEN 3 AND 12)) = 2 THEN {{'o': 4, 'kind': 'compact_spacing', 'view': array_to_string(w, ''), 'removed': ''}} END,
  CASE WHEN len(list_filter(w, lambda t: length(t) >= 6 AND ends_with(t, 'ies'))) > 0 THEN {{'o': 5, 'kind': 'plural_ies', 'view': array_to_string(list_transform(w, lambda t: CASE WHEN length(t) >= 6 AND ends_with(t, 'ies') THEN left(t, length(t) - 3) || 'y' ELSE t END), ' '), 'removed': ''}} END], lambda x: x IS NOT NULL)) AS v FROM p),
n AS (SELECT *, {norm('v.view')} AS n FROM v), u AS (SELECT *, row_number() OVER (PARTITION BY adm_party_id, n ORDER BY v.o) AS again FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY adm_party_id ORDER BY v.o) - 1 AS place FROM u WHERE again = 1 AND length(n) >= 3 AND n <> whole)
SELECT adm_party_id, place::INTEGER AS place, v.kind AS kind, v.view AS view, v.removed AS removed FROM k WHERE place < 3""",
)
def x26_name_views(spark, sf):
    """At most three other writings of each name."""
    return views.written(spark, sf).select("adm_party_id", F.posexplode(X.name_views(F.col("raw_name"))).alias("place", "v")).select("adm_party_id", "place", "v.kind", "v.view", "v.removed")


CUTS = "regexp_extract_all({0}, '[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]+')"
_EDGES = "' ' || chr(9) || '.,:;-/' || chr(8211) || chr(8212) || '|()'"
PREFIXES = f"""c AS (SELECT *, {CUTS.replace('{0}', 'raw_name')} AS cut FROM written_),
b AS (SELECT c.* EXCLUDE (cut), k, array_to_string(cut[1:k], '') AS written, cut[k] AS last FROM c, unnest(range(1, least({{most}}, len(cut)) + 1)) AS x(k)),
q AS (SELECT *, trim(written) AS prefix, {norm('written')} AS norm, trim(substr(raw_name, length(written) + 1), {_EDGES}) AS remainder FROM b)"""


@register("x27_anchored", f"{CTE}, written_ AS (SELECT adm_party_id, raw_name, {norm('party_name')} AS official FROM written JOIN parties ON expected = party_id), {PREFIXES.replace('{most}', '1000000')}, t AS (SELECT *, {MEANT.replace('{0}', 'official')} AS told, len(list_filter({words('official')}, lambda t: list_contains({LEGAL}, t))) > 0 AS legal FROM q), h AS (SELECT *, row_number() OVER (PARTITION BY adm_party_id ORDER BY k) AS rn FROM t WHERE norm = official AND length({norm('remainder')}) > 1 AND (len(told) > 1 OR (legal AND len(told) = 1 AND length(told[1]) >= 8))) SELECT adm_party_id, prefix, remainder FROM h WHERE rn = 1")
def x27_anchored(spark, sf):
    """Names that begin with the whole official name of their party."""
    w, p = views.written(spark, sf), views.parties(spark, sf)
    j = w.join(p, w.expected == p.party_id).select("adm_party_id", X.anchored(F.col("raw_name"), X.normalize(F.col("party_name"))).alias("a"))
    return j.filter("a.prefix is not null").select("adm_party_id", "a.prefix", "a.remainder")


PLACES = "[" + ", ".join(repr(x) for x in sorted(set(vocab.LOCATIONS))) + "]"
KNOWN_PHRASES = "|".join(sorted({*vocab.STRUCTURE, *vocab.REGIONAL_LEGAL, *vocab.LOCATIONS}, key=lambda p: (-p.count(" "), p)))
REGIONAL = f"list_filter({words('{0}')}, lambda t: NOT list_contains([{', '.join(repr(w) for w in vocab.REGIONAL_LEGAL)}], t))"


@register(
    "x31_regional",
    f"""{CTE}, m AS (SELECT adm_party_id, {REGIONAL.replace('{0}', norm('raw_name'))} AS r, {REGIONAL.replace('{0}', norm('party_name'))} AS c FROM written JOIN parties ON expected = party_id),
e AS (SELECT adm_party_id, array_to_string(list_concat(r[:i - 1], r[i + len(c):]), ' ') || ' ' AS rest FROM m, unnest(range(1, len(r) - len(c) + 2)) AS x(i) WHERE len(c) > 0 AND len(r) > len(c) AND r[i:i + len(c) - 1] = c),
f AS (SELECT *, regexp_extract_all(rest, '({KNOWN_PHRASES}) ', 1) AS found FROM e)
SELECT DISTINCT adm_party_id FROM f WHERE array_to_string(found, ' ') || ' ' = rest AND len(list_filter(found, lambda t: list_contains({PLACES}, t))) > 0""",
)
def x31_regional(spark, sf):
    """Names that are their party's core and geography."""
    w, p = views.written(spark, sf), views.parties(spark, sf)
    core = lambda c: X.regional_core(X.normalize(F.col(c)))
    return w.join(p, w.expected == p.party_id).filter(X.regional_match(core("raw_name"), core("party_name"))).select("adm_party_id")


@register(
    "x33_fragments",
    f"""{CTE}, r AS (SELECT adm_party_id, trim(raw_name) AS raw, regexp_matches(trim(raw_name), '{PAREN}') AS par FROM written),
p AS (SELECT *, CASE WHEN par THEN 'parentheses' WHEN contains(raw, '|') THEN 'pipe' ELSE 'separator' END AS delimiter, list_filter(CASE WHEN par THEN [trim(regexp_extract(raw, '{PAREN}', 1)), trim(regexp_extract(raw, '{PAREN}', 2))] ELSE {SEGMENTS.replace('{0}', 'raw').replace('{1}', PART_SEP)} END, lambda x: length({norm('x')}) >= 3) AS pieces FROM r)
SELECT adm_party_id, delimiter, (i - 1)::INTEGER AS position, pieces[i] AS text FROM p, unnest(range(1, len(pieces) + 1)) AS q(i) WHERE len(pieces) BETWEEN 2 AND 4 AND len(list_distinct(list_transform(pieces, lambda x: {norm('x')}))) > 1""",
)
def x33_fragments(spark, sf):
    return views.written(spark, sf).select("adm_party_id", F.explode(X.fragments(F.col("raw_name"))).alias("f")).select("adm_party_id", "f.delimiter", "f.position", "f.text")


# --- ids and preparation --------------------------------------------------------------

NS = "from_hex('6ba7b8119dad11d180b400c04fd430c8')"


@register(
    "s00_stable_id",
    f"""{CTE}, h AS (SELECT party_id, sha1({NS} || encode('onomast:verified:acc|' || party_name)) AS h FROM parties)
SELECT party_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stable FROM h""",
)
def s00_stable_id(spark, sf):
    return views.parties(spark, sf).select("party_id", ids.stable_id("verified", F.lit("acc"), F.col("party_name")).alias("stable"))


def _bucket(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 8))::BIGINT % 100"


@register(
    "f06_split",
    f"""{CTE}, n AS (SELECT adm_party_id, {norm('party_name')} AS c, {N} AS t FROM written JOIN parties ON expected = party_id),
b AS (SELECT *, {_bucket('''concat('{{"canonical": "', c, '"}}')'''.replace('{{', '{').replace('}}', '}'))} AS f, {_bucket('''concat('{{"canonical": "', c, '", "template": "', t, '"}}')'''.replace('{{', '{').replace('}}', '}'))} AS g FROM n)
SELECT adm_party_id, CASE WHEN f < 15 THEN 'TEST_UNSEEN' WHEN g < 15 THEN 'TEST_KNOWN' WHEN g < 30 THEN 'CALIBRATION' ELSE 'TRAIN' END AS split FROM b""",
)
def f06_split(spark, sf):
    w, p = views.written(spark, sf), views.parties(spark, sf)
    return w.join(p, w.expected == p.party_id).select("adm_party_id", ids.split(X.normalize(F.col("party_name")), X.normalize(F.col("raw_name"))).alias("split"))


LABELLED = "rows_ AS (SELECT source_row, raw_name, CASE source_row % 7 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN NULL ELSE expected END AS label FROM written)"
KNOWN = "label IS NOT NULL AND trim(label) <> '' AND lower(trim(label)) <> 'unknown'"


def labelled(spark, sf):
    label = F.when(F.col("source_row") % 7 == 0, "UNKNOWN").when(F.col("source_row") % 7 == 1, F.lit(None).cast("string")).otherwise(F.col("expected"))
    return views.written(spark, sf).select("source_row", "raw_name", label.alias("label"))


@register(
    "f01_cleaning",
    f"""{CTE}, {LABELLED}, l AS (SELECT raw_name, count(DISTINCT CASE WHEN {KNOWN} THEN label END) AS n FROM rows_ GROUP BY raw_name),
r AS (SELECT rows_.*, l.n, row_number() OVER (PARTITION BY rows_.raw_name, label ORDER BY source_row) AS nth FROM rows_ JOIN l USING (raw_name))
SELECT source_row, CASE WHEN n > 1 THEN 'CONFLICTING_LABELS' WHEN {KNOWN} AND trim(raw_name) = trim(label) THEN 'VERIFIED_SELF_ROW' WHEN nth > 1 THEN 'EXACT_DUPLICATE' END AS cleaning FROM r""",
)
def f01_cleaning(spark, sf):
    return prepare.clean(labelled(spark, sf)).select("source_row", "cleaning")


@register("a02_cleaning_counts", f"SELECT cleaning, count(*) AS n FROM ({SQL['f01_cleaning']}) GROUP BY cleaning")
def a02_cleaning_counts(spark, sf):
    return f01_cleaning(spark, sf).groupBy("cleaning").agg(F.count(F.lit(1)).alias("n"))


@register("f03_eligibility", f"{CTE} SELECT party_id, parent_id IS NULL OR NOT exists(SELECT 1 FROM parties q WHERE q.party_id = parties.parent_id) AS eligible FROM parties")
def f03_eligibility(spark, sf):
    p = views.parties(spark, sf)
    rows = p.select(F.col("party_name").alias("raw_name"), F.col("party_id").alias("label"), "parent_id", F.monotonically_increasing_id().alias("source_row"), F.col("party_id").alias("own"))
    return prepare.records(rows, p, "acc").select(F.col("own").alias("party_id"), "eligible")


SAID = "CASE o_orderkey % 9 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' WHEN 3 THEN '1' WHEN 4 THEN 'verified' WHEN 5 THEN NULL WHEN 6 THEN 'y' WHEN 7 THEN '0' ELSE o_orderstatus END"


@register("f05_as_bool", f"SELECT o_orderkey, coalesce(lower(trim({SAID})) IN ('1', 'true', 'yes', 'y', 'verified'), false) AS flag FROM orders")
def f05_as_bool(spark, sf):
    return views.tables(spark, sf, "orders")["orders"].select("o_orderkey", prepare.as_bool(F.expr(SAID)).alias("flag"))


@register("w23_catalog_order", "WITH n AS (SELECT DISTINCT trim(p_name || ' ' || p_type) AS party_name FROM part) SELECT party_name, (row_number() OVER (ORDER BY lower(party_name), party_name) - 1)::BIGINT AS index FROM n")
def w23_catalog_order(spark, sf):
    rows = views.tables(spark, sf, "part")["part"].select(F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return prepare.catalog(rows, "acc").select("party_name", "index")


@register("s15_jobs", f"SELECT (index // 100)::INTEGER || '.us' AS shard_id, count(*) AS parties, min(party_name) AS first_name FROM ({SQL['w23_catalog_order']}) GROUP BY index // 100")
def s15_jobs(spark, sf):
    rows = views.tables(spark, sf, "part")["part"].select(F.concat_ws(" ", "p_name", "p_type").alias("label"))
    j = prepare.jobs(prepare.catalog(rows, "acc"), "acc")
    return j.select(F.col("shardId").alias("shard_id"), F.size("verifiedParties").cast("long").alias("parties"), F.array_min(F.transform("verifiedParties", lambda x: x["partyName"])).alias("first_name"))


# --- graph ---------------------------------------------------------------------------


@register("g04_closure", f"WITH RECURSIVE {CTE[5:]}, up(party_id, cur, path) AS (SELECT party_id, party_id, party_id FROM parties UNION ALL SELECT up.party_id, p.parent_id, up.path || '>' || p.parent_id FROM up JOIN parties p ON p.party_id = up.cur WHERE p.parent_id IS NOT NULL) SELECT up.party_id, cur AS root_id, len(string_split(path, '>'))::INTEGER AS depth, path FROM up JOIN parties p2 ON p2.party_id = up.cur WHERE p2.parent_id IS NULL")
def g04_closure(spark, sf):
    return graph.closure(views.parties(spark, sf)).withColumn("path", F.array_join("path", ">"))


@register("g09_rollup", f"SELECT root_id, count(*) AS members, max(depth)::INTEGER AS depth FROM ({SQL['g04_closure']}) GROUP BY root_id")
def g09_rollup(spark, sf):
    return graph.closure(views.parties(spark, sf)).groupBy("root_id").agg(F.count(F.lit(1)).alias("members"), F.max("depth").alias("depth"))


@register("g01_add_parties", f"{CTE}, old AS (SELECT party_id, lower(party_name) AS party_name FROM parties WHERE length(party_name) % 2 = 0) SELECT coalesce(p.party_id, old.party_id) AS party_id, coalesce(p.party_name, old.party_name) AS party_name FROM old FULL JOIN parties p ON old.party_id = p.party_id")
def g01_add_parties(spark, sf):
    p = views.parties(spark, sf).select("party_id", "party_name")
    return graph.add_parties(p.filter(F.length("party_name") % 2 == 0).withColumn("party_name", F.lower("party_name")), p)


@register("g02_expansions", f"{CTE}, a AS (SELECT party_id, {base(norm('party_name'))} AS name, 0.9 AS c FROM parties UNION ALL SELECT party_id, upper({base(norm('party_name'))}), 0.8 FROM parties UNION ALL SELECT party_id, party_name, 0.95 FROM parties) SELECT party_id, name FROM a WHERE c = 0.9")
def g02_expansions(spark, sf):
    p = views.parties(spark, sf)
    b = X.base(X.normalize(F.col("party_name")))
    one = lambda name, c: p.select("party_id", name.alias("name"), F.lit("alias").alias("type"), F.lit("cache").alias("source"), F.lit(c).alias("confidence"))
    raw = one(b, 0.9).unionByName(one(F.upper(b), 0.8)).unionByName(one(F.col("party_name"), 0.95)).unionByName(one(F.lit("too weak"), 0.2))
    return graph.apply_expansions(p, graph.validate_expansions(raw)).select("party_id", "name")


@register("j25_collisions", f"{CTE}, v AS (SELECT party_id, {base(norm('party_name'))} AS n FROM parties) SELECT n AS norm_name, count(DISTINCT party_id) AS collisions FROM v GROUP BY n")
def j25_collisions(spark, sf):
    return graph.collisions(views.parties(spark, sf).select("party_id", X.base(X.normalize(F.col("party_name"))).alias("name")))


@register(
    "g03_reconcile_parents",
    f"""{CTE}, k AS (SELECT DISTINCT party_id, unnest([{norm('party_name')}, {base(norm('party_name'))}]) AS key FROM parties),
w AS (SELECT c.party_id AS child, unnest([{norm('q.party_name')}, {base(norm('q.party_name'))}]) AS key FROM parties c JOIN parties q ON replace(c.party_id, '-promo', '-standard') = q.party_id WHERE c.party_id LIKE '%-promo' OR c.party_id LIKE '%-large'),
f AS (SELECT child, min(party_id) AS party_id, count(DISTINCT party_id) AS n FROM w JOIN k USING (key) WHERE child <> party_id AND key <> '' GROUP BY child)
SELECT child AS party_id, f.party_id AS parent_id FROM f JOIN parties c ON c.party_id = child WHERE n = 1 AND c.parent_id IS NULL""",
)
def g03_reconcile_parents(spark, sf):
    """Promotional parties are to hang under the standard one of their name; large ones name themselves, which counts for nothing."""
    p = settle(views.parties(spark, sf))
    wanted = p.alias("c").join(p.alias("q"), F.replace("c.party_id", F.lit("-promo"), F.lit("-standard")) == F.col("q.party_id")).filter("c.party_id like '%-promo' or c.party_id like '%-large'")
    return graph.reconcile_parents(spark, p, wanted.select(F.col("c.party_id").alias("party_id"), F.col("q.party_name").alias("parent_name")))


@register("g08_in_scope", f"{CTE}, s AS (SELECT party_id FROM parties WHERE length(party_name) % 3 > 0) SELECT p.party_id, CASE WHEN p.parent_id IN (SELECT party_id FROM s) THEN p.parent_id END AS parent_id FROM parties p JOIN s USING (party_id)")
def g08_in_scope(spark, sf):
    p = views.parties(spark, sf)
    return graph.in_scope(p, p.filter("length(party_name) % 3 > 0").select("party_id")).select("party_id", "parent_id")


@register("j26_correlate", "SELECT o_custkey AS party_id, arg_min(o_orderkey, o_orderkey) AS answer FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey")
def j26_correlate(spark, sf):
    """Of several answers to one request the first counts; answers to nobody are passed over."""
    o = views.tables(spark, sf, "orders")["orders"]
    requests = o.filter("o_custkey % 2 = 0").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("ref"), F.col("o_custkey").alias("party_id")).distinct()
    answers = o.select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("ref"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("answer"))
    return graph.correlate(requests, answers)


# --- joins and retrieval --------------------------------------------------------------

EXACT = f"{CTE}, w AS (SELECT adm_party_id, {N} AS n FROM written), v AS (SELECT party_id, {norm('party_name')} AS n FROM parties)"


@register("j01_exact_join", f"{EXACT} SELECT w.adm_party_id, v.party_id FROM w JOIN v ON w.n = v.n AND w.n <> ''")
def j01_exact_join(spark, sf):
    w = views.written(spark, sf).select("adm_party_id", X.normalize(F.col("raw_name")).alias("n")).filter("n != ''")
    v = views.parties(spark, sf).select("party_id", X.normalize(F.col("party_name")).alias("n"))
    return w.join(v, "n").select("adm_party_id", "party_id")


@register("a08_token_idf", f"{CTE}, {IDF} SELECT token, round(idf, 9) AS idf, df FROM idf")
def a08_token_idf(spark, sf):
    return scoring.token_idf(views.parties(spark, sf).select(F.col("party_name").alias("name"))).withColumn("idf", F.round("idf", 9))


def _tfidf(grams: str, floor: float) -> str:
    return f"""{CTE}, m AS (SELECT raw_name AS text, count(*) AS copies FROM written GROUP BY raw_name), q AS (SELECT DISTINCT party_name AS text FROM parties),
g AS (SELECT text, gram, count(*) AS tf FROM (SELECT text, unnest({grams}) AS gram FROM (SELECT text FROM m UNION SELECT text FROM q)) GROUP BY text, gram),
i AS (SELECT gram, ln((1.0 + (SELECT sum(copies) FROM m)) / (1.0 + sum(copies))) + 1.0 AS idf FROM g JOIN m USING (text) GROUP BY gram),
w AS (SELECT text, gram, (ln(tf) + 1.0) * idf AS w FROM g JOIN i USING (gram)), z AS (SELECT text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM w),
s AS (SELECT a.text, b.text AS name, round(sum(a.w * b.w), 6) AS score FROM z a JOIN z b USING (gram) JOIN m ON m.text = a.text JOIN q ON q.text = b.text GROUP BY a.text, b.text)
SELECT text, name, score FROM s WHERE score > {floor}"""


CHARS = "list_concat(list_concat([], {0}), [])".replace("{0}", "flatten(list_transform(list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda t: t <> ''), lambda t: flatten(list_transform([3, 4, 5], lambda n: CASE WHEN length(t) + 2 >= n THEN list_transform(range(1, length(t) + 4 - n), lambda i: substr(' ' || t || ' ', i, n)) ELSE [] END))))")
WORDS = "list_concat(regexp_extract_all(lower(text), '\\w\\w+'), list_transform(range(1, len(regexp_extract_all(lower(text), '\\w\\w+'))), lambda i: regexp_extract_all(lower(text), '\\w\\w+')[i] || ' ' || regexp_extract_all(lower(text), '\\w\\w+')[i + 1]))"


def _cosine(spark, sf, kind, floor):
    texts = views.written(spark, sf).groupBy(F.col("raw_name").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    names = views.parties(spark, sf).select(F.col("party_name").alias("name")).distinct()
    return retrieval.cosine_top(texts, names, kind, floor, 1_000_000, settle(retrieval.fit(texts, kind))).select("text", "name", F.round("score", 6).alias("score"))


@register("j02_char_cosine", _tfidf(CHARS, 0.5))
def j02_char_cosine(spark, sf):
    return _cosine(spark, sf, "char", 0.5).filter("score > 0.5")


@register("j03_word_cosine", _tfidf(WORDS, 0.4))
def j03_word_cosine(spark, sf):
    return _cosine(spark, sf, "word", 0.4).filter("score > 0.4")


@register("j04_vector_top", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.e, c.e) / (q.n * c.n), 6) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) SELECT query_id, vec_id, round(score, 4) AS score FROM r WHERE rn <= 5")
def j04_vector_top(spark, sf):
    """For each query its five nearest vectors, by cosine."""
    e = views.tables(spark, sf, "embeddings")["embeddings"]
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = e.withColumn("n", norm).select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("n")).alias("v"))
    key = F.lpad(F.col("vec_id").cast("string"), 20, "0")  # so that ties go to the smaller id
    found = retrieval.vector_top(unit.filter("vec_id % 20 = 0").select(key.alias("name"), "v"), unit.select(key.alias("text"), "v"), 5, -1.0, digits=6)
    return found.select(F.col("name").cast("long").alias("query_id"), F.col("text").cast("long").alias("vec_id"), F.round("score", 4).alias("score"))


@register("j08_anti_ledger", f"{CTE} SELECT adm_party_id FROM written WHERE adm_party_id NOT IN (SELECT adm_party_id FROM written WHERE expected LIKE '%large')")
def j08_anti_ledger(spark, sf):
    w = views.written(spark, sf)
    return matcher.fresh(w, w.filter("expected like '%large'").select("adm_party_id")).select("adm_party_id")


@register("j09_semi_ids", f"{CTE} SELECT adm_party_id FROM written WHERE expected IN (SELECT party_id FROM parties WHERE parent_id IS NOT NULL)")
def j09_semi_ids(spark, sf):
    w = views.written(spark, sf)
    wanted = w.withColumnRenamed("expected", "party_id").join(views.parties(spark, sf).filter("parent_id is not null"), "party_id", "left_semi").select("adm_party_id")
    return matcher.chosen(w, wanted).select("adm_party_id")


ROOTED = f"WITH RECURSIVE {CTE[5:]}, up(party_id, cur) AS (SELECT party_id, party_id FROM parties UNION ALL SELECT up.party_id, p.parent_id FROM up JOIN parties p ON p.party_id = up.cur WHERE p.parent_id IS NOT NULL), rooted AS (SELECT up.party_id, cur AS root_id, r.party_name AS root_name, o.party_name, {norm('o.party_name')} AS n FROM up JOIN parties r ON r.party_id = up.cur AND r.parent_id IS NULL JOIN parties o ON o.party_id = up.party_id)"


@register("j13_token_owners", f"{ROOTED}, t AS (SELECT unnest(list_distinct({words('n')})) AS key, root_id FROM rooted) SELECT key, count(DISTINCT root_id) AS owners, min(root_id) AS owner FROM t WHERE length(key) >= 5 AND NOT list_contains([{', '.join(repr(w) for w in X.NOT_WORDS)}], key) GROUP BY key")
def j13_token_owners(spark, sf):
    p = matcher.rooted(views.parties(spark, sf))
    return decide.owners(p, F.filter(X.meaningful(F.col("party_norm")), lambda t: F.length(t) >= 5), explode=True)


@register("j15_base_owners", f"{ROOTED} SELECT {base('n')} AS key, count(DISTINCT root_id) AS owners, min(root_id) AS owner FROM rooted WHERE {base('n')} <> '' GROUP BY 1")
def j15_base_owners(spark, sf):
    return decide.owners(matcher.rooted(views.parties(spark, sf)), X.base(F.col("party_norm")))


@register("j14_prefix_owners", f"{ROOTED}, q AS (SELECT DISTINCT {N} AS key FROM written), t AS (SELECT array_to_string({words('n')}[1:k], ' ') AS key, root_id FROM rooted, unnest(range(2, len({words('n')}) + 1)) AS r(k)) SELECT key, count(DISTINCT root_id) AS owners, min(root_id) AS owner FROM t WHERE key IN (SELECT key FROM q) GROUP BY key")
def j14_prefix_owners(spark, sf):
    wanted = views.written(spark, sf).select(X.normalize(F.col("raw_name")).alias("key"))
    return decide.short_name_indexes(matcher.rooted(views.parties(spark, sf)), wanted)[1]


OFFICIAL = f"trim(regexp_replace({base(norm('party_name'))}, '^((the|a|an)( |$))+', ''))"


@register("j17_raw_prefixes", f"{CTE}, written_ AS (SELECT adm_party_id, raw_name FROM written), {PREFIXES.replace('{most}', '25')}, l AS (SELECT *, lag(norm) OVER (PARTITION BY adm_party_id ORDER BY k) AS before FROM q), v AS (SELECT party_id, {OFFICIAL} AS norm FROM parties) SELECT l.norm, adm_party_id, party_id FROM l JOIN v ON l.norm = v.norm WHERE l.norm <> '' AND (before IS NULL OR before <> l.norm)")
def j17_raw_prefixes(spark, sf):
    p = views.written(spark, sf).select("adm_party_id", F.explode(X.raw_prefixes(F.col("raw_name"))).alias("p")).select("adm_party_id", F.col("p.norm").alias("norm"))
    v = views.parties(spark, sf).select("party_id", X.official_base(X.normalize(F.col("party_name"))).alias("norm"))
    return p.join(v, "norm")


# --- aggregates and windows over decisions ---------------------------------------------

DECISIONS = f"""{ROOTED}, w AS (SELECT adm_party_id, raw_name, expected, {N} AS n FROM written),
x AS (SELECT w.adm_party_id, min(r.root_id) AS root_id, count(DISTINCT r.root_id) AS k FROM w JOIN rooted r ON r.n = w.n GROUP BY 1),
y AS (SELECT w.adm_party_id, min(r.root_id) AS root_id, count(DISTINCT r.root_id) AS k FROM w JOIN rooted r ON {base('r.n')} = {base('w.n')} AND {base('w.n')} <> '' GROUP BY 1),
d AS (SELECT w.adm_party_id, w.raw_name, coalesce(x.root_id, y.root_id) AS party_id, CASE WHEN x.k = 1 THEN 0.999 WHEN y.k = 1 THEN 0.985 WHEN y.k > 1 THEN 0.6 ELSE 0.0 END AS confidence, CASE WHEN x.k = 1 OR y.k = 1 THEN 'MATCH' ELSE 'NO_MATCH' END AS decision, e.root_id AS expected, length(w.raw_name) % 5 <> 0 AS scorable, x.root_id AS xr, y.root_id AS yr
  FROM w LEFT JOIN x USING (adm_party_id) LEFT JOIN y USING (adm_party_id) LEFT JOIN rooted e ON e.party_id = w.expected),
j AS (SELECT *, decision = 'MATCH' AS matched, decision = 'MATCH' AND scorable AND coalesce(party_id = expected, false) AS correct, scorable AND coalesce(xr = expected OR yr = expected, xr = expected, yr = expected, false) AS retrieved FROM d)"""


def structural(spark, sf):
    """Decisions by unique exact, then unique base name, with labels: what the reports aggregate."""
    p = settle(matcher.rooted(views.parties(spark, sf)))
    w = views.written(spark, sf).withColumn("n", X.normalize(F.col("raw_name"))).withColumn("b", X.base(F.col("n")))
    exact = decide.owners(p, F.col("party_norm")).select(F.col("key").alias("n"), F.col("owner").alias("xo"), F.col("owners").alias("xn"))
    bases = decide.owners(p, X.base(F.col("party_norm"))).select(F.col("key").alias("b"), F.col("owner").alias("yo"), F.col("owners").alias("yn"))
    j = w.join(exact, "n", "left").join(bases, "b", "left").join(p.select(F.col("party_id").alias("expected"), F.col("root_id").alias("er")), "expected", "left")
    sure = F.when(F.col("xn") == 1, 0.999).when(F.col("yn") == 1, 0.985).when(F.col("yn") > 1, 0.6).otherwise(0.0)
    hit = F.coalesce(F.col("xn") == 1, F.lit(False)) | F.coalesce(F.col("yn") == 1, F.lit(False))
    return j.select("adm_party_id", "raw_name", F.coalesce("xo", "yo").alias("party_id"), sure.alias("confidence"), F.when(hit, "MATCH").otherwise("NO_MATCH").alias("decision"), F.col("er").alias("expected"), (F.length("raw_name") % 5 != 0).alias("scorable"), F.array_compact(F.array("xo", "yo")).alias("retrieved_roots"), F.lit("TRAIN").alias("split"))


def report(spark, sf):
    d = structural(spark, sf)
    return evaluate.judged(d.drop("expected", "scorable", "split"), d.select("adm_party_id", "expected", "scorable", "split"))


WIL = "CASE WHEN n_judged > 0 THEN round((n_correct / n_judged + 1.96 * 1.96 / (2 * n_judged) {0} 1.96 * sqrt(n_correct / n_judged * (1 - n_correct / n_judged) / n_judged + 1.96 * 1.96 / (4 * n_judged * n_judged::DOUBLE))) / (1 + 1.96 * 1.96 / n_judged), 6) END"
_P, _R = "CASE WHEN n_judged > 0 THEN n_correct / n_judged END", "CASE WHEN n_scorable > 0 THEN n_correct / n_scorable END"
PACK = f"SELECT {{0}}n_rows, n_scorable, n_matched, n_judged, n_correct, n_retrieved, round(CASE WHEN {_P} + {_R} > 0 THEN 2 * {_P} * {_R} / ({_P} + {_R}) END, 6) AS f1, round(CASE WHEN n_rows > 0 THEN n_matched / n_rows END, 6) AS coverage, round(CASE WHEN n_scorable > 0 THEN n_retrieved / n_scorable END, 6) AS retrieval_recall, round(CASE WHEN n_judged > 0 THEN n_correct / n_judged END, 6) AS precision_, round(CASE WHEN n_scorable > 0 THEN n_correct / n_scorable END, 6) AS recall_, {WIL.format('-')} AS precision_low, {WIL.format('+')} AS precision_high FROM (SELECT {{0}}count(*) AS n_rows, count(*) FILTER (scorable) AS n_scorable, count(*) FILTER (matched) AS n_matched, count(*) FILTER (matched AND scorable) AS n_judged, count(*) FILTER (correct) AS n_correct, count(*) FILTER (retrieved) AS n_retrieved FROM j {{1}})"
KEEP = ["n_rows", "n_scorable", "n_matched", "n_judged", "n_correct", "n_retrieved"]


def _pack(rows, *by):
    return evaluate.pack(rows, *by).select(*by, *KEEP, *[F.round(c, 6).alias(c) for c in ("precision_", "recall_", "f1", "coverage", "retrieval_recall", "precision_low", "precision_high")])


@register("a10_metrics", f"{DECISIONS} {PACK.format('', '')}")
def a10_metrics(spark, sf):
    return _pack(report(spark, sf))


CASE = "CASE WHEN raw_name LIKE 'OBO %' THEN 'MALFORMED' WHEN raw_name LIKE '% OBO %' THEN 'OBO' WHEN raw_name LIKE '% VIA %' THEN 'VIA' ELSE 'PLAIN' END"


@register("a11_metrics_by_case", f"{DECISIONS.replace('j AS (SELECT *,', 'j AS (SELECT *, ' + CASE + ' AS record_case,')} {PACK.format('record_case, ', 'GROUP BY record_case')}")
def a11_metrics_by_case(spark, sf):
    return _pack(report(spark, sf).withColumn("record_case", X.record_case(F.col("raw_name"))), "record_case")


@register("a12_confidence_bins", f"{DECISIONS} SELECT least(floor(round(confidence / 0.1, 9)), 9)::INTEGER AS bin, count(*) AS n_matched, count(*) FILTER (scorable) AS n_judged, count(*) FILTER (correct) AS n_correct FROM j WHERE matched GROUP BY 1")
def a12_confidence_bins(spark, sf):
    return evaluate.bins(report(spark, sf))


@register("a13_funnel", f"{DECISIONS} SELECT count(*) AS n_rows, count(*) FILTER (scorable) AS n_scorable, count(*) FILTER (retrieved) AS n_retrieved, count(*) FILTER (scorable AND matched) AS n_decided, count(*) FILTER (correct) AS n_correct FROM j")
def a13_funnel(spark, sf):
    return evaluate.funnel(report(spark, sf))


@register("a14_macro_recall", f"{DECISIONS}, e AS (SELECT expected, count(*) FILTER (correct) / count(*) AS r FROM j WHERE scorable GROUP BY expected) SELECT count(*) AS n_entities, round(avg(r), 9) AS macro_recall FROM e")
def a14_macro_recall(spark, sf):
    return evaluate.macro_recall(report(spark, sf)).withColumn("macro_recall", F.round("macro_recall", 9))


@register("a18_party_summary", f"{DECISIONS}, t AS (SELECT expected AS party_id, count(*) AS n_truth FROM j WHERE scorable GROUP BY 1), f AS (SELECT party_id, count(*) AS n_found, count(*) FILTER (correct) AS n_correct FROM j WHERE matched GROUP BY 1) SELECT coalesce(t.party_id, f.party_id) AS party_id, coalesce(n_truth, 0) AS n_truth, coalesce(n_found, 0) AS n_found, coalesce(n_correct, 0) AS n_correct FROM t FULL JOIN f ON t.party_id IS NOT DISTINCT FROM f.party_id")
def a18_party_summary(spark, sf):
    return evaluate.party_summary(report(spark, sf)).select("party_id", F.col("n_truth").cast("long").alias("n_truth"), F.col("n_found").cast("long").alias("n_found"), "n_correct")


@register("a21_threshold_sweep", f"{DECISIONS}, b AS (SELECT least(floor(round((confidence - 0.6) / 0.05, 9)), 6)::INTEGER AS cut, count(*) FILTER (scorable) AS n, count(*) FILTER (scorable AND party_id = expected) AS c FROM j WHERE confidence >= 0.6 AND party_id IS NOT NULL GROUP BY 1) SELECT round(cut * 0.05 + 0.6, 4) AS cutoff, (sum(n) OVER (ORDER BY cut DESC))::BIGINT AS n_emitted, (sum(c) OVER (ORDER BY cut DESC))::BIGINT AS n_correct, round(CASE WHEN sum(n) OVER (ORDER BY cut DESC) > 0 THEN sum(c) OVER (ORDER BY cut DESC) / sum(n) OVER (ORDER BY cut DESC) END, 6) AS precision_ FROM b")
def a21_threshold_sweep(spark, sf):
    return evaluate.sweep(report(spark, sf)).withColumn("precision_", F.round("precision_", 6))


@register("a27_threshold", f"{DECISIONS}, s AS (SELECT round(confidence, 4) AS s, count(*) AS n, count(*) FILTER (correct) AS c FROM j WHERE party_id IS NOT NULL GROUP BY 1), r AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS n, sum(c) OVER (ORDER BY s DESC) AS c FROM s) SELECT coalesce((SELECT s FROM r WHERE n >= 5 AND c >= 0.5 * n ORDER BY c DESC, s LIMIT 1), 0.9)::DOUBLE AS threshold")
def a27_threshold(spark, sf):
    rows = report(spark, sf).filter("party_id is not null").select(F.col("confidence").alias("score"), "correct")
    return spark.createDataFrame([(evaluate.threshold(rows, 0.5, 5, 0.9),)], "threshold double")


@register("a15_disagreements", f"{DECISIONS} SELECT adm_party_id, party_id AS left_id, NULL::VARCHAR AS right_id FROM j WHERE matched AND confidence < 0.99")
def a15_disagreements(spark, sf):
    d = structural(spark, sf)
    strict = d.withColumn("decision", F.when(F.col("confidence") > 0.99, F.col("decision")).otherwise("NO_MATCH"))
    return evaluate.disagreements(d, strict)


@register("x36_error_buckets", f"{DECISIONS} SELECT CASE WHEN NOT scorable THEN 'NOT_SCORABLE' WHEN correct THEN 'CORRECT' WHEN matched THEN 'WRONG_MATCH' WHEN NOT retrieved THEN 'RETRIEVAL_MISS' WHEN length(raw_name) % 3 = 0 THEN 'EXPECTED_GUARDED' WHEN length(raw_name) % 3 = 1 THEN 'AMBIGUITY' ELSE 'SUPPORT_REJECTION' END AS bucket, count(*) AS n FROM j GROUP BY 1")
def x36_error_buckets(spark, sf):
    """Buckets of errors; the reasons of refused rows are dealt by the length of their names."""
    n = F.length("raw_name") % 3
    reason = F.when(n == 0, "DIGIT_CONFLICT").when(n == 1, "CANDIDATE_COLLISION").otherwise("INSUFFICIENT_SUPPORT")
    return report(spark, sf).withColumn("reason", reason).groupBy(evaluate.error_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("w20_representatives", f"{CTE}, k AS (SELECT party_id, party_name, {TOKENS.replace('{0}', 'party_name')} AS t FROM parties), r AS (SELECT *, string_split(t, ' ')[1] AS anchor, row_number() OVER (PARTITION BY string_split(t, ' ')[1] ORDER BY len(string_split(t, ' ')), length(party_name), lower(party_name), party_id) AS rn FROM k) SELECT anchor, party_id AS adm_party_id, party_name AS raw_name FROM r WHERE rn = 1")
def w20_representatives(spark, sf):
    return suggest.representatives(views.parties(spark, sf).select(F.col("party_id").alias("adm_party_id"), F.col("party_name").alias("raw_name")))


@register("f14_scope", f"{CTE}, k AS (SELECT adm_party_id, string_split({TOKENS.replace('{0}', 'raw_name')}, ' ')[1] AS anchor FROM written), g AS (SELECT anchor FROM k GROUP BY anchor HAVING count(*) >= 2 ORDER BY count(*) DESC, anchor LIMIT 5) SELECT adm_party_id, anchor FROM k WHERE anchor IN (SELECT anchor FROM g)")
def f14_scope(spark, sf):
    """The five largest families: the limit is the feature."""
    return suggest.scope(views.written(spark, sf), 2, 5).select("adm_party_id", "anchor")


@register("k10_pages", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 4096)::INTEGER AS page FROM orders")
def k10_pages(spark, sf):
    from onomast.sources import io

    return io.pages(views.tables(spark, sf, "orders")["orders"].select("o_orderkey"), ["o_orderkey"], 4096)


@register("a07_root_percentiles", f"{CTE}, c AS (SELECT expected, count(*) AS n FROM written GROUP BY expected) SELECT quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, max(n) AS most FROM c")
def a07_root_percentiles(spark, sf):
    rows = views.written(spark, sf).select(F.col("expected").alias("text"), F.col("adm_party_id").alias("root_id"))
    return retrieval.root_percentiles(rows)


# --- decisions ------------------------------------------------------------------------


def _records(spark, sf):
    """Every written record, and the catalog; equal names are scored once inside and count as often as they are written."""
    return views.written(spark, sf).select("adm_party_id", "raw_name"), views.parties(spark, sf)


@register("d24_flat_matcher")
def d24_flat_matcher(spark, sf):
    records, parties = _records(spark, sf)
    return matcher.match_flat(parties.select("party_id", "party_name"), records)


@register("d16_full_matcher")
def d16_full_matcher(spark, sf):
    """All stages over the hierarchy."""
    records, parties = _records(spark, sf)
    return matcher.match(parties, records)["final"].select("adm_party_id", "decision", "reason", F.round("confidence", 6).alias("confidence"), "party_id", "tier", "resolution")


@register("d01_proposals")
def d01_proposals(spark, sf):
    records, parties = _records(spark, sf)
    ctx, _ = matcher.context(parties, records, decide.Policy())
    return ctx.proposals.select("adm_party_id", "mention_id", "party_id", "root_id", "name", F.round("char", 6).alias("char"), F.round("word", 6).alias("word"), F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"))


# lineitems as direct proposals: an order is a record, its parts are roots. Scores are rounded a
# little upward on both sides, as products of short decimals often lie just at the edge.

PROPOSED = """SELECT l_orderkey AS rec, l_partkey AS root, l_linenumber AS line, 'name ' || CAST(l_partkey AS VARCHAR(20)) AS name, round(least(0.999, l_extendedprice / 69997.0), 6) AS s,
  CASE WHEN l_quantity > 46 THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN l_linenumber % 5 = 0 THEN 1.0 ELSE 0.0 END AS digits, CASE WHEN l_quantity < 5 THEN 1.0 ELSE 0.0 END AS words, 1 + l_partkey % 2 AS collisions,
  CASE WHEN l_suppkey % 3 = 0 THEN 'alias' ELSE 'official' END AS type, round(l_tax * 12, 4) AS cover, round(l_discount * 10, 4) AS jaccard, round(l_discount * 9, 4) AS chars, round(l_tax * 11, 4) AS terms FROM {lineitem}"""
RANKED = f"""p AS ({PROPOSED.replace('{lineitem}', 'lineitem')}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec, root ORDER BY s DESC, name DESC, root, line) AS n FROM p) WHERE n = 1),
i AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s DESC, root) AS k, max(s) OVER (PARTITION BY rec) AS f FROM b),
j AS (SELECT *, coalesce(max(CASE WHEN k = 2 THEN s END) OVER (PARTITION BY rec), 0.0) AS g, CASE WHEN exact = 1 THEN NULL WHEN digits = 1 THEN 'DIGIT_CONFLICT' WHEN words = 1 THEN 'DISTINCTIVE_TOKEN_CONFLICT' END AS guard FROM i),
t AS (SELECT *, greatest(0.0, least(0.999, s * (0.92 + least(0.08, greatest(0.0, s - CASE WHEN k = 1 THEN g ELSE f END))))) AS target, guard IS NULL OR NOT bool_or(guard IS NULL) OVER (PARTITION BY rec) AS pool FROM j),
o AS (SELECT *, row_number() OVER w AS place, lead(CASE WHEN pool THEN root END) OVER w AS up, lead(CASE WHEN pool THEN target END) OVER w AS us FROM t WINDOW w AS (PARTITION BY rec ORDER BY pool DESC, target DESC, root))"""
TIER = "CASE WHEN exact = 1 AND type = 'official' THEN 'EXACT_OFFICIAL' WHEN exact = 1 THEN 'EXACT_CANDIDATE' WHEN cover >= 0.90 AND jaccard >= 0.45 THEN 'DIRECTIONAL_CONTAINMENT' ELSE 'MULTI_SIGNAL' END"


def proposed(spark, sf):
    """The proposals of ``PROPOSED`` as the decisions take them."""
    p = views.run(spark, sf, PROPOSED, "lineitem")
    text = lambda c: F.col(c).cast("string")
    return p.select(
        text("rec").alias("adm_party_id"), F.concat(text("rec"), F.lit(":"), F.lpad(text("line"), 2, "0")).alias("mention_id"), F.lit("x").alias("mention_text"), F.lit("x").alias("mention_norm"), F.col("name").alias("norm_name"), "name", "root", "line",
        F.col("root").alias("root_id"), F.col("root").alias("party_id"), F.col("name").alias("root_name"), F.col("name").alias("owner_name"), F.col("s").alias("score"), "exact", F.col("digits").alias("digit_conflict"), F.col("words").alias("distinctive_conflict"), "collisions", "type",
        F.col("cover").alias("candidate_coverage"), F.col("jaccard").alias("token_jaccard"), F.col("chars").alias("char"), F.col("terms").alias("word"), F.array(F.lit("char"), F.lit("word")).alias("sources"), F.array(F.col("root").cast("string")).alias("path"), F.create_map().cast("map<string,double>").alias("idf"), F.lit(1).alias("parties"),
    )


def half_up(x, digits: int):
    """``x`` rounded as the SQL rounds it: scaled, halves up, scaled back. ``F.round`` takes the decimals a double prints, which may end in a half where the scaled value is just below one."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


@register(
    "d03_plain_decisions",
    f"""WITH {RANKED}, d AS (SELECT *, target - coalesce(us, 0.0) AS margin FROM o WHERE place = 1),
r AS (SELECT *, CASE WHEN guard IS NOT NULL THEN guard WHEN up IS NOT NULL AND margin < 0.04 THEN CASE WHEN collisions > 1 THEN 'CANDIDATE_COLLISION' ELSE 'AMBIGUOUS_FINAL_TARGETS' END WHEN target < 0.8 THEN 'INSUFFICIENT_SUPPORT' ELSE 'MATCH' END AS reason FROM d)
SELECT o_orderkey::VARCHAR AS adm_party_id, CASE WHEN reason = 'MATCH' THEN 'MATCH' ELSE 'NO_MATCH' END AS decision, coalesce(reason, CASE WHEN o_orderkey % 4 = 0 THEN 'EMPTY_NAME' ELSE 'NO_CANDIDATES' END) AS reason, round(coalesce(target, 0.0) + 1e-9, 6) AS confidence, root::VARCHAR AS party_id, CASE WHEN reason IS NOT NULL THEN {TIER} END AS tier, CASE WHEN exact = 1 THEN 'exact:normalized' WHEN reason IS NOT NULL THEN 'feature:char_word' END AS method, round(margin + 1e-9, 6) AS margin, up::VARCHAR AS runner_up_id
FROM orders LEFT JOIN r ON rec = o_orderkey AND o_orderkey % 7 <> 0""",
)
def d03_plain_decisions(spark, sf):
    """Plain decisions over direct proposals; every seventh record has none."""
    key = F.col("o_orderkey")
    records = views.tables(spark, sf, "orders")["orders"].select(key.cast("string").alias("adm_party_id"), F.when(key % 4 == 0, "").otherwise("x").alias("raw_name"), F.lit(True).alias("plain"), F.lit(None).cast("string").alias("parse_warning"))
    props = proposed(spark, sf).filter(F.col("adm_party_id").cast("long") % 7 != 0).drop("root", "line")
    out = decide.plain(records, props, decide.Policy(containment=False))
    return out.select("adm_party_id", "decision", "reason", half_up(F.col("confidence") + 1e-9, 6).alias("confidence"), "party_id", "tier", "method", half_up(F.col("margin") + 1e-9, 6).alias("margin"), "runner_up_id")


@register(
    "d04_connector_decisions",
    f"""WITH {RANKED.replace("l_orderkey AS rec", "l_orderkey * 10 + l_linenumber AS rec").replace("FROM lineitem)", "FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_suppkey + 1000000, l_linenumber, 'name ' || (l_suppkey + 1000000), round(least(0.999, l_extendedprice / 79999.0), 6), 0.0, 0.0, 0.0, 1, 'official', 0.0, 0.0, 0.0, 0.0 FROM lineitem)")},
d AS (SELECT rec // 10 AS q, rec % 10 AS line, root, target, target - coalesce(us, 0.0) AS margin, CASE WHEN guard IS NOT NULL THEN guard WHEN up IS NOT NULL AND target - coalesce(us, 0.0) < 0.04 THEN 'AMBIGUOUS_FINAL_TARGETS' WHEN target < 0.9 THEN 'INSUFFICIENT_SUPPORT' ELSE 'MATCH' END AS why FROM o WHERE place = 1),
m AS (SELECT q, arg_min(why, line) AS lw, arg_min(target, line) AS lt, arg_min(root, line) AS lr, count(*) FILTER (why = 'MATCH') AS ok, count(DISTINCT CASE WHEN why = 'MATCH' THEN root END) AS roots, bool_or(why = 'AMBIGUOUS_FINAL_TARGETS') AS amb, bool_or(why = 'INSUFFICIENT_SUPPORT') AS weak,
  arg_min(root, line) FILTER (why = 'MATCH') AS fr, arg_min(target, line) FILTER (why = 'MATCH') AS ft, max(target) FILTER (why = 'MATCH') AS mt, max(target) FILTER (why <> 'MATCH') AS nt, count(*) AS n FROM d GROUP BY q),
x AS (SELECT m.*, arg_min(d.root, d.line) FILTER (d.why <> 'MATCH' AND d.target = nt) AS nr FROM m JOIN d USING (q) GROUP BY ALL),
r AS (SELECT *, ok > 0 AND lw IN ('INSUFFICIENT_SUPPORT', 'AMBIGUOUS_FINAL_TARGETS') AND lt >= 0.9 - 0.03 AS near FROM x)
SELECT q::VARCHAR AS adm_party_id, CASE WHEN q % 13 = 0 THEN 'MALFORMED_CONNECTOR' WHEN n = 1 OR (q % 11 = 0 AND n > 2) THEN 'MIXED_CONNECTORS_UNSUPPORTED' WHEN near THEN 'PREFERRED_NEAR_CUTOFF' WHEN ok = 0 THEN 'NONE' WHEN roots = 1 THEN CASE WHEN ok = 1 THEN 'ONLY_MATCH' ELSE 'SAME_ROOT' END ELSE CASE WHEN q % 2 = 0 THEN 'OBO' ELSE 'VIA' END || '_LEFT' END AS resolution,
  CASE WHEN q % 13 = 0 OR n = 1 OR (q % 11 = 0 AND n > 2) THEN 0.0 WHEN near THEN round(lt + 1e-9, 6) WHEN ok = 0 THEN round(nt + 1e-9, 6) WHEN roots = 1 THEN round(mt + 1e-9, 6) ELSE round(ft + 1e-9, 6) END AS confidence,
  CASE WHEN q % 13 = 0 OR n = 1 OR (q % 11 = 0 AND n > 2) THEN NULL WHEN near THEN lr WHEN ok = 0 THEN nr ELSE fr END::VARCHAR AS party_id FROM r""",
)
def d04_connector_decisions(spark, sf):
    """Connector names: each line number of an order is a segment with two candidates or more; some records are malformed or mixed."""
    l = views.tables(spark, sf, "lineitem")["lineitem"]  # noqa: E741
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    word = F.when(key % 2 == 0, "OBO").otherwise("VIA")
    mixed = F.when((key % 11 == 0) & (F.col("at") > 1), "AND").otherwise(word)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    m = l.select("l_orderkey", "l_linenumber").distinct().withColumn("at", place).select(key.cast("string").alias("adm_party_id"), F.concat(key.cast("string"), F.lit(":"), F.lpad(line.cast("string"), 2, "0")).alias("mention_id"), F.lit("x").alias("text"), F.col("at").alias("position"), F.when(F.col("at") > 0, mixed).alias("connector_before"), F.when((key % 13 == 0) & (F.col("at") == 0), "MALFORMED_CONNECTOR").alias("parse_warning"))
    one = proposed(spark, sf)
    two = l.select(key.cast("string").alias("adm_party_id"), F.concat(key.cast("string"), F.lit(":"), F.lpad(line.cast("string"), 2, "0")).alias("mention_id"), (F.col("l_suppkey") + 1_000_000).alias("root"), F.round(F.least(F.lit(0.999), F.col("l_extendedprice") / 79999.0), 6).alias("score"))
    zero = F.lit(0.0)
    name = F.concat(F.lit("name "), F.col("root").cast("string"))
    two = two.select("adm_party_id", "mention_id", F.lit("x").alias("mention_text"), F.lit("x").alias("mention_norm"), name.alias("norm_name"), name.alias("name"), F.col("root").alias("root_id"), F.col("root").alias("party_id"), name.alias("root_name"), name.alias("owner_name"), "score", *[zero.alias(c) for c in ("exact", "digit_conflict", "distinctive_conflict", "candidate_coverage", "token_jaccard", "char", "word")], F.lit(1).alias("collisions"), F.lit("official").alias("type"), F.array(F.lit("char")).alias("sources"), F.array(F.col("root").cast("string")).alias("path"), F.create_map().cast("map<string,double>").alias("idf"), F.lit(1).alias("parties"))
    props = one.drop("root", "line").unionByName(two)
    records = l.select(key.cast("string").alias("adm_party_id"), F.lit("x").alias("raw_name")).distinct()
    none = spark.createDataFrame([], "party_id string, party_name string, party_norm string, root_id string")
    out = decide.connectors(records, m, props, none, decide.Policy(system=0.9, short_names=False))
    return out.select("adm_party_id", "resolution", F.when(F.col("confidence") == 0, 0.0).otherwise(F.round(F.col("confidence") + 1e-9, 6)).alias("confidence"), "party_id")


_W = {c: n for c, n in zip(scoring.RULE_WEIGHTS, ("chars", "terms", "cover", "jaccard", "cover", "terms", "chars", "terms", "jaccard", "chars", "cover", "jaccard", "digits", "words"), strict=True)}
_SUM = "0.0 + " + " + ".join(f"{w} * {_W[c]}" for c, w in scoring.RULE_WEIGHTS.items())
_RULE = f"CASE WHEN exact = 1 THEN 0.999 WHEN line = 2 THEN 0.985 WHEN line = 3 THEN 0.975 ELSE greatest(0.001, least(0.97, {_SUM})) END"


@register(
    "x18_rule_score",
    f"""WITH p AS ({PROPOSED.replace('{lineitem}', 'lineitem')}), r AS (SELECT *, {_RULE} AS rule FROM p), c AS (SELECT *, CASE WHEN type <> 'official' THEN least(rule, coalesce(nullif(jaccard, 0.5), 1.0)) ELSE rule END AS capped FROM r)
SELECT rec, root, line, round(rule, 6) AS rule_score, round(CASE WHEN exact = 1 AND collisions = 1 THEN greatest(capped, CASE WHEN type = 'official' THEN 0.999 ELSE coalesce(nullif(jaccard, 0.5), 1.0) END) ELSE capped END, 6) AS score, CASE WHEN exact = 1 THEN NULL WHEN digits = 1 THEN 'DIGIT_CONFLICT' WHEN words = 1 THEN 'DISTINCTIVE_TOKEN_CONFLICT' END AS guard, {TIER} AS tier FROM c""",
)
def x18_rule_score(spark, sf):
    """The rule score of given features, what confidence caps and exactness raises, guards and tiers."""
    p = views.run(spark, sf, PROPOSED, "lineitem")
    p = p.withColumnsRenamed({"digits": "digit_conflict", "words": "distinctive_conflict"}).withColumns({"base_exact": (F.col("line") == 2).cast("double"), "compact_exact": (F.col("line") == 3).cast("double"), "candidate_coverage": F.col("cover"), "token_jaccard": F.col("jaccard"), "confidence": F.nullif("jaccard", F.lit(0.5))})
    for name, source in _W.items():
        if name not in p.columns:
            p = p.withColumn(name, F.col(source))
    score = scoring.rule_score()
    return p.select("rec", "root", "line", F.round(score, 6).alias("rule_score"), F.round(scoring.identity(score), 6).alias("score"), scoring.guard().alias("guard"), scoring.tier().alias("tier"))


@register(
    "w05_shortlist",
    """WITH h AS (SELECT l_orderkey AS text, l_partkey AS name, max(CASE WHEN l_quantity > 48 THEN 1.0 ELSE 0.0 END) AS exact, max(l_discount * 9) AS char_, max(l_tax * 11) AS word_, max(l_discount) AS rrf FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, name % 40 AS party, 'n' || (name % 60) AS norm, name % 20 AS root, CASE WHEN exact = 1 THEN 2.0 ELSE greatest(char_, word_) + least(0.05, rrf) END AS prio FROM h),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text, root, party, norm ORDER BY prio DESC, name DESC) AS n FROM o) WHERE n = 1),
v AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY text, root ORDER BY prio DESC, party, norm) AS n FROM a) WHERE n <= 1),
b AS (SELECT *, max(prio) OVER (PARTITION BY text, root) AS best FROM v), r AS (SELECT *, dense_rank() OVER (PARTITION BY text ORDER BY best DESC, root) AS k FROM b)
SELECT text, name, party AS party_id, root AS root_id, round(prio, 6) AS priority FROM r WHERE k <= 3""",
)
def w05_shortlist(spark, sf):
    """The best variant of each root, the three best roots of each text."""
    l = views.tables(spark, sf, "lineitem")["lineitem"]  # noqa: E741
    h = l.groupBy(F.col("l_orderkey").alias("text"), F.col("l_partkey").alias("name")).agg(F.max(F.when(F.col("l_quantity") > 48, 1.0).otherwise(0.0)).alias("exact"), F.max(F.col("l_discount") * 9).alias("char"), F.max(F.col("l_tax") * 11).alias("word"), F.max("l_discount").alias("rrf"))
    h = h.withColumn("lexical", F.greatest("char", "word")).withColumn("embedding", F.lit(None).cast("double"))
    names = l.select(F.col("l_partkey").alias("name")).distinct()
    variants = names.select("name", (F.col("name") % 40).alias("party_id"), F.concat(F.lit("n"), (F.col("name") % 60).cast("string")).alias("norm_name"))
    up = names.select((F.col("name") % 40).alias("party_id"), (F.col("name") % 20).alias("root_id")).distinct()
    return retrieval.shortlist(h, variants, up, retrieval.Retrieval(roots=3, variants=1)).select("text", "name", "party_id", "root_id", F.round("priority", 6).alias("priority"))


@register("w08_runner_up", "WITH p AS (SELECT o_custkey AS rec, o_orderkey AS root, round(o_totalprice / 600000.0, 6) AS s FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s DESC, root) AS k, max(s) OVER (PARTITION BY rec) AS f FROM p), q AS (SELECT *, coalesce(max(CASE WHEN k = 2 THEN s END) OVER (PARTITION BY rec), 0.0) AS g FROM r) SELECT rec, root, k::INTEGER AS place, round(greatest(0.0, least(0.999, s * (0.92 + least(0.08, greatest(0.0, s - CASE WHEN k = 1 THEN g ELSE f END))))), 4) AS target FROM q")
def w08_runner_up(spark, sf):
    o = views.tables(spark, sf, "orders")["orders"]
    p = o.select(F.col("o_custkey").alias("rec"), F.col("o_orderkey").alias("root_id"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("party_id"), F.lit("m").alias("mention_id"), F.round(F.col("o_totalprice") / 600000.0, 6).alias("score"), *[F.lit(0.0).alias(c) for c in ("exact", "digit_conflict", "distinctive_conflict")])
    return decide.ranked(p, "rec").select("rec", F.col("root_id").alias("root"), F.col("identity_rank").alias("place"), F.round("target", 4).alias("target"))


@register("w04_rrf", "WITH s AS (SELECT l_orderkey AS q, l_partkey AS d, max(l_quantity) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY 1, 2), r AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY a DESC, d) AS i, row_number() OVER (PARTITION BY q ORDER BY b DESC, d) AS k FROM s) SELECT q, d, round(1.0 / (60 + i) + 1.0 / (60 + k), 9) AS rrf FROM r")
def w04_rrf(spark, sf):
    s = views.tables(spark, sf, "lineitem")["lineitem"].groupBy(F.col("l_orderkey").alias("text"), F.col("l_partkey").alias("name")).agg(F.max("l_quantity").alias("a"), F.max("l_extendedprice").alias("b"))
    rank = lambda c: F.row_number().over(Window.partitionBy("text").orderBy(F.desc(c), "name"))
    found = retrieval.merged([retrieval.hit_rows(s.select("text", "name", (F.col(c) * 0).alias("score"), rank(c).alias("rank")), kind) for kind, c in (("char", "a"), ("word", "b"))], 1_000_000)
    return found.select(F.col("text").alias("q"), F.col("name").alias("d"), F.round("rrf", 9).alias("rrf"))


@register("d17_request_cutoff", f"{DECISIONS} SELECT adm_party_id, CASE WHEN matched AND confidence < 0.99 THEN 'NO_MATCH' ELSE decision END AS decision, CASE WHEN matched AND confidence < 0.99 THEN 'BELOW_REQUEST_CUTOFF' END AS reason FROM j")
def d17_request_cutoff(spark, sf):
    jobs = views.parties(spark, sf).select("party_id", F.lit(0.99).alias("cutoff"), F.lit(0).alias("job_order"))
    return decide.request_cutoff(decide.shaped(structural(spark, sf)), jobs).select("adm_party_id", "decision", "reason")


# --- suggestions and state --------------------------------------------------------------

TOK = "string_split({0}, ' ')"
SUG = f"""{CTE}, a AS (SELECT adm_party_id, {TOKENS.replace('{0}', 'raw_name')} AS t, list_last(string_split({norm('raw_name')}, ' ')) AS l FROM written), b AS (SELECT party_id, party_name, {TOKENS.replace('{0}', 'party_name')} AS t, list_last(string_split({norm('party_name')}, ' ')) AS l FROM {{0}}),
e AS (SELECT adm_party_id, party_id, party_name, CASE WHEN a.t = b.t AND a.l = b.l AND list_contains([{', '.join(repr(x) for x in vocab.ENDINGS)}], a.l) THEN 105 WHEN a.t = b.t THEN 100 WHEN starts_with(a.t, b.t || ' ') AND (contains(b.t, ' ') OR (length(b.t) >= 5)) THEN 85 WHEN length(string_split(b.t, ' ')[1]) >= 5 THEN 55 ELSE 0 END AS s FROM a JOIN b ON string_split(a.t, ' ')[1] = string_split(b.t, ' ')[1] AND a.t <> ''),
m AS (SELECT adm_party_id, max(s) AS s FROM e WHERE s > 0 GROUP BY 1), n AS (SELECT e.adm_party_id, count(*) AS k, min(party_id) AS p FROM e JOIN m ON e.adm_party_id = m.adm_party_id AND e.s = m.s GROUP BY 1)
SELECT w.adm_party_id, CASE WHEN k IS NULL THEN 'NONE' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'SUGGESTED' END AS status, CASE WHEN k = 1 THEN p ELSE '' END AS party_id FROM written w LEFT JOIN n USING (adm_party_id)"""


@register("d23_name_only", SUG.replace("{0}", "parties"))
def d23_name_only(spark, sf):
    return suggest.suggest(views.written(spark, sf), views.parties(spark, sf)).select("adm_party_id", "status", "party_id")


_EARLY = "(SELECT * FROM parties WHERE party_id NOT LIKE '%-economy')"


@register(
    "t04_growing_catalog",
    f"""WITH x AS ({SUG.replace('{0}', _EARLY)}), y AS ({SUG.replace('{0}', 'parties')})
SELECT CASE WHEN x.status = 'NONE' AND y.status = 'SUGGESTED' THEN 'NEW_SUGGESTION' WHEN x.status = 'SUGGESTED' AND y.status = 'SUGGESTED' AND x.party_id <> y.party_id THEN 'MOVED_SUGGESTION' WHEN x.status = 'SUGGESTED' AND y.status = 'AMBIGUOUS' THEN 'NOW_AMBIGUOUS' WHEN x.status = 'SUGGESTED' AND y.status = 'NONE' THEN 'WITHDRAWN' WHEN x.status = 'AMBIGUOUS' AND y.status = 'SUGGESTED' THEN 'AMBIGUITY_RESOLVED' ELSE 'UNCHANGED' END AS change, count(*) AS n FROM x JOIN y USING (adm_party_id) GROUP BY 1""",
)
def t04_growing_catalog(spark, sf):
    p = settle(views.parties(spark, sf))
    w = views.written(spark, sf)
    return suggest.change(suggest.suggest(w, p.filter("party_id not like '%-economy'")), suggest.suggest(w, p)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@register("j23_verified_relations", f"{CTE}, k AS (SELECT party_id, {TOKENS.replace('{0}', 'party_name')} AS t FROM parties), f AS (SELECT string_split(t, ' ')[1] AS key, * FROM k) SELECT 'POSSIBLE_NAME_FAMILY' AS relation, key, count(*) AS members, min(party_id) AS first_id, max(party_id) AS last_id FROM f WHERE length(key) >= 5 GROUP BY key HAVING count(DISTINCT t) > 1 UNION ALL SELECT 'POSSIBLE_DUPLICATE_NAME', t, count(*), min(party_id), max(party_id) FROM f GROUP BY t HAVING count(*) > 1")
def j23_verified_relations(spark, sf):
    return suggest.verified_relations(views.parties(spark, sf))


@register("x40_transition", f"{DECISIONS} SELECT adm_party_id, CASE WHEN matched AND confidence < 0.99 THEN 'LOST_STRONG' ELSE 'UNCHANGED' END AS transition FROM j")
def x40_transition(spark, sf):
    d = structural(spark, sf)
    strict = d.withColumn("decision", F.when(F.col("confidence") > 0.99, F.col("decision")).otherwise("NO_MATCH"))
    return suggest.transition(d, strict).select("adm_party_id", "transition")


@register("t01_event_windows", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def t01_event_windows(spark, sf):
    e = views.tables(spark, sf, "events")["events"].withColumn("t", F.col("ts").cast("timestamp"))
    return incremental.counts(e, "t").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("t01_exact_arrivals", f"{EXACT}, u AS (SELECT n, min(party_id) AS party_id FROM v WHERE n <> '' GROUP BY n HAVING count(DISTINCT party_id) = 1) SELECT w.adm_party_id, u.party_id FROM w LEFT JOIN u USING (n)")
def t01_exact_arrivals(spark, sf):
    return incremental.exact_stream(views.written(spark, sf), views.parties(spark, sf)).select("adm_party_id", "party_id")


@register("a22_position_prior", f"{CTE}, s AS (SELECT adm_party_id, CASE WHEN raw_name LIKE '%(%' THEN 'parentheses' ELSE 'separator' END AS delimiter, (length(raw_name) % 2)::INTEGER AS part FROM written), c AS (SELECT delimiter, part, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT delimiter, count(*) AS total FROM s GROUP BY 1 HAVING count(*) >= 20) SELECT t.delimiter, r.part::INTEGER AS part, round((coalesce(n, 0) + 1) / (total + 4), 9) AS prior FROM t CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS part) r LEFT JOIN c ON c.delimiter = t.delimiter AND c.part = r.part")
def a22_position_prior(spark, sf):
    s = views.written(spark, sf).select("adm_party_id", F.when(F.col("raw_name").contains("("), "parentheses").otherwise("separator").alias("delimiter"), (F.length("raw_name") % 2).alias("part"), F.col("expected").alias("root_id"))
    return recovery.position_prior(s, s.select("adm_party_id", "root_id")).withColumn("prior", F.round("prior", 9))


# --- reports over splits, audits, intake -------------------------------------------------

SPLITS = "CASE length(raw_name) % 4 WHEN 0 THEN 'TRAIN' WHEN 1 THEN 'CALIBRATION' WHEN 2 THEN 'TEST_KNOWN' ELSE 'TEST_UNSEEN' END"
TIERS = "CASE WHEN confidence > 0.99 THEN 'EXACT_OFFICIAL' WHEN length(raw_name) % 3 = 0 THEN 'RULES_SAFE_VIEW_CORE_ANCHOR' WHEN length(raw_name) % 3 = 1 THEN 'RULES_UNIQUE_CONTAINMENT' ELSE 'MULTI_SIGNAL' END"


def decided(spark, sf):
    """The structural decisions with tiers, and their labels with splits."""
    d = settle(structural(spark, sf).withColumn("tier", F.expr(TIERS)).withColumn("split", F.expr(SPLITS)))
    return d.drop("expected", "scorable", "split"), d.select("adm_party_id", "expected", "scorable", "split")


@register(
    "a16_counterfactuals",
    f"""{DECISIONS}, k AS (SELECT *, {TIERS} AS tier FROM j), m AS (SELECT 'RULES_ONLY' AS variant, true AS keep, * FROM k UNION ALL SELECT 'BEFORE_CORE_ANCHOR', tier <> 'RULES_SAFE_VIEW_CORE_ANCHOR', * FROM k UNION ALL SELECT 'PRIOR_RULES', confidence > 0.7, * FROM k UNION ALL SELECT 'WITHOUT_CONTAINMENT', confidence > 0.7 AND tier <> 'RULES_UNIQUE_CONTAINMENT', * FROM k),
g AS (SELECT variant, count(*) FILTER (keep AND matched) AS n_matches, count(*) FILTER (keep AND correct) AS n_correct, count(*) AS n_scorable FROM m WHERE scorable GROUP BY variant)
SELECT *, round(CASE WHEN n_matches > 0 THEN n_correct / n_matches END, 6) AS precision_, round(n_correct / n_scorable, 6) AS recall_, round(CASE WHEN n_correct > 0 THEN 2 * (n_correct / n_matches) * (n_correct / n_scorable) / (n_correct / n_matches + n_correct / n_scorable) END, 6) AS f1 FROM g""",
)
def a16_counterfactuals(spark, sf):
    d, labels = decided(spark, sf)
    return evaluate.counterfactuals(d, d.filter("confidence > 0.7"), labels).select("variant", "n_matches", "n_correct", "n_scorable", *[F.round(c, 6).alias(c) for c in ("precision_", "recall_", "f1")])


@register("a16_containment", f"{DECISIONS}, k AS (SELECT *, {TIERS} AS tier, {SPLITS} AS split FROM j) SELECT split, count(*) AS n_matches, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / count(*), 6) AS precision_ FROM k WHERE matched AND scorable AND tier = 'RULES_UNIQUE_CONTAINMENT' GROUP BY split")
def a16_containment(spark, sf):
    d, labels = decided(spark, sf)
    return evaluate.containment(d, labels).withColumn("precision_", F.round("precision_", 6))


@register("a19_unknown", f"{DECISIONS} SELECT count(*) AS n_rows, count(*) FILTER (matched) AS n_matches, round(avg(confidence) FILTER (matched), 6) AS average_confidence, count(*) FILTER (NOT matched) AS n_no_matches, round(count(*) FILTER (matched) / count(*), 6) AS prediction_rate FROM j WHERE NOT scorable")
def a19_unknown(spark, sf):
    return evaluate.unknown_stats(report(spark, sf)).select("n_rows", "n_matches", F.round("average_confidence", 6).alias("average_confidence"), "n_no_matches", F.round("prediction_rate", 6).alias("prediction_rate"))


@register(
    "a11_cohorts",
    f"""{DECISIONS}, k AS (SELECT *, {CASE} AS c FROM j), t AS (SELECT *, unnest(list_filter(['ALL_HELD_OUT', CASE WHEN c <> 'OBO' THEN 'NO_OBO' END, CASE WHEN c <> 'VIA' THEN 'NO_VIA' END, CASE WHEN c NOT IN ('OBO', 'VIA') THEN 'PLAIN' END, CASE WHEN c = 'OBO' THEN 'OBO_ONLY' END, CASE WHEN c = 'VIA' THEN 'VIA_ONLY' END, CASE WHEN c IN ('OBO', 'VIA') AND NOT matched THEN 'CONNECTOR_ABSTAINED' END], lambda x: x IS NOT NULL)) AS cohort FROM k) {PACK.format('cohort, ', 'GROUP BY cohort').replace('FROM j', 'FROM t')}""",
)
def a11_cohorts(spark, sf):
    rows = report(spark, sf).withColumns({"found_case": X.record_case(F.col("raw_name")), "resolution": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    return evaluate.pack_by_tags(rows, evaluate.cohorts()).select("cohort", *KEEP, *[F.round(c, 6).alias(c) for c in ("precision_", "recall_", "f1", "coverage", "retrieval_recall", "precision_low", "precision_high")])


@register(
    "a26_held_out",
    f"""{DECISIONS}, k AS (SELECT *, {SPLITS} IN ('TEST_KNOWN', 'TEST_UNSEEN') AND scorable AS held FROM j),
g AS (SELECT count(*) FILTER (held) AS labeled_rows, count(*) FILTER (held AND matched) AS strong_matches, count(*) FILTER (held AND correct) AS strong_correct, count(*) FILTER (held AND NOT matched AND party_id IS NOT NULL) AS review_rows, count(*) FILTER (held AND NOT matched AND party_id = expected) AS review_correct FROM k)
SELECT *, review_correct AS review_names, round(CASE WHEN strong_matches > 0 THEN strong_correct / strong_matches END, 6) AS strong_precision, round(CASE WHEN labeled_rows > 0 THEN strong_correct / labeled_rows END, 6) AS strong_recall, round(CASE WHEN review_rows > 0 THEN review_correct / review_rows END, 6) AS review_precision FROM g""",
)
def a26_held_out(spark, sf):
    d, labels = decided(spark, sf)
    out = evaluate.held_out_check(d.filter("decision = 'MATCH'"), d.filter("decision != 'MATCH' and party_id is not null"), labels)
    return out.select("labeled_rows", "strong_matches", "strong_correct", "review_rows", "review_correct", "review_names", *[F.round(c, 6).alias(c) for c in ("strong_precision", "strong_recall", "review_precision")])


STATUS = "CASE WHEN decision = 'MATCH' THEN 'STRONG' WHEN length(raw_name) % 2 = 0 THEN 'REVIEW' ELSE 'DROPPED' END"


@register(
    "a25_audit",
    f"""{DECISIONS}, k AS (SELECT *, {SPLITS} IN ('TEST_KNOWN', 'TEST_UNSEEN') AS held, {STATUS} AS status FROM j),
c AS (SELECT party_id, count(*) AS candidate_pairs, count(*) FILTER (status = 'STRONG') AS n_strong, count(*) FILTER (status = 'REVIEW') AS n_review, count(*) FILTER (status = 'DROPPED') AS n_dropped, count(*) FILTER (scorable AND held AND party_id = expected) AS hf, count(*) FILTER (scorable AND held AND party_id = expected AND status = 'STRONG') AS hr, count(*) FILTER (scorable AND held AND status = 'STRONG') AS hs FROM k WHERE party_id IS NOT NULL GROUP BY party_id),
l AS (SELECT expected AS party_id, count(*) AS known_labels, count(*) FILTER (held) AS held_out_labels, count(*) FILTER (coalesce(party_id <> expected, true) AND length(raw_name) % 3 <> 0) AS index_misses, count(*) FILTER (coalesce(party_id <> expected, true) AND length(raw_name) % 3 = 0) AS gate_exclusions FROM k WHERE scorable GROUP BY expected)
SELECT p.party_id, p.party_name, coalesce(candidate_pairs, 0) AS candidate_pairs, coalesce(n_strong, 0) AS n_strong, coalesce(n_review, 0) AS n_review, coalesce(n_dropped, 0) AS n_dropped, coalesce(known_labels, 0) AS known_labels, coalesce(held_out_labels, 0) AS held_out_labels, coalesce(index_misses, 0) AS index_misses, coalesce(gate_exclusions, 0) AS gate_exclusions,
  round(CASE WHEN held_out_labels > 0 THEN coalesce(hf, 0) / held_out_labels END, 6) AS held_out_candidate_recall, round(CASE WHEN hs > 0 THEN hr / hs END, 6) AS held_out_strong_precision, round(CASE WHEN held_out_labels > 0 THEN coalesce(hr, 0) / held_out_labels END, 6) AS held_out_strong_recall
FROM parties p LEFT JOIN c USING (party_id) LEFT JOIN l USING (party_id)""",
)
def a25_audit(spark, sf):
    """Each party's figures; pairs are the structural candidates, the index holds every third name's expected party."""
    d, labels = decided(spark, sf)
    pairs_ = d.filter("party_id is not null").select("adm_party_id", "party_id", F.expr(STATUS).alias("status"))
    index = d.filter("length(raw_name) % 3 = 0").join(labels.select("adm_party_id", F.col("expected").alias("e")), "adm_party_id").select("adm_party_id", F.col("e").alias("party_id"))
    out = suggest.audit(pairs_, index, labels, views.parties(spark, sf))
    rates = ("held_out_candidate_recall", "held_out_strong_precision", "held_out_strong_recall")
    return out.select(*[c for c in out.columns if c not in rates], *[F.round(c, 6).alias(c) for c in rates])


@register(
    "d21_two_snapshots",
    f"""WITH x AS ({SUG.replace('{0}', _EARLY)}), y AS ({SUG.replace('{0}', 'parties')}), z AS (SELECT CASE WHEN x.status = 'SUGGESTED' THEN x.party_id END AS p, CASE WHEN y.status = 'SUGGESTED' THEN y.party_id END AS q FROM x JOIN y USING (adm_party_id))
SELECT CASE WHEN p IS NOT NULL AND q IS NOT NULL AND p <> q THEN 'MOVED' WHEN p IS NOT NULL AND q IS NULL THEN 'LOST_STRONG' WHEN p IS NULL AND q IS NOT NULL THEN 'NEW_STRONG' ELSE 'UNCHANGED' END AS transition, count(*) AS n FROM z GROUP BY 1""",
)
def d21_two_snapshots(spark, sf):
    """Movements of all names when the withheld economy parties come."""
    p = settle(views.parties(spark, sf))

    def build(names, verified):
        found = settle(suggest.suggest(names, verified))
        strong = F.col("status") == "SUGGESTED"
        return found.select("adm_party_id", F.when(strong, "MATCH").otherwise("NO_MATCH").alias("decision"), F.when(strong, F.col("party_id")).alias("party_id")), found.filter("status = 'AMBIGUOUS'").select("adm_party_id")

    return suggest.two_snapshots(settle(views.written(spark, sf)), p, p.filter("party_id like '%-economy'"), build)["movements"]


@register("f13_intake", f"{CTE} SELECT CASE WHEN source_row % 5 = 0 OR source_row % 7 = 0 THEN 'INELIGIBLE_OR_VERIFIED' WHEN source_row % 11 = 0 THEN 'BLANK' END AS why, count(*) AS n FROM written GROUP BY 1")
def f13_intake(spark, sf):
    w = views.written(spark, sf)
    rows = w.select((F.col("source_row") % 5 != 0).alias("eligible"), (F.col("source_row") % 7 == 0).alias("is_verified"), F.when(F.col("source_row") % 11 == 0, " ").otherwise(F.col("raw_name")).alias("raw_name"))
    return suggest.intake(rows).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@register("j20_family_index", f"WITH m AS ({SQL['x07_mentions']}), g AS (SELECT adm_party_id, arg_min(text, position) AS mention_text, count(DISTINCT connector_before) AS kinds, count(parse_warning) AS w FROM m GROUP BY 1), t AS (SELECT string_split({TOKENS.replace('{0}', 'mention_text')}, ' ')[1] AS token, adm_party_id, mention_text FROM g WHERE kinds <= 1 AND w = 0) SELECT * FROM t WHERE token <> ''")
def j20_family_index(spark, sf):
    return suggest.family_index(matcher.mentions(matcher.prepared(views.written(spark, sf))))


@register("l02_synthetic_pairs", f"{CTE}, n AS (SELECT party_name AS name, row_number() OVER (ORDER BY party_name) - 1 AS at FROM (SELECT DISTINCT party_name FROM parties)) SELECT name, unnest([name, {norm('name')}, replace(name, ' ', '')]) AS mention_text, 1 AS label FROM n UNION ALL SELECT o.name, n.name, 0 FROM n, unnest([1, 2]) AS d(i), n o WHERE o.at = (n.at + d.i) % (SELECT count(*) FROM n)")
def l02_synthetic_pairs(spark, sf):
    return train.synthetic(views.parties(spark, sf)).select("name", "mention_text", "label")


@register("l05_partition", "SELECT o_orderkey, (('0x' || substr(CASE WHEN o_orderkey % 2 = 0 THEN lpad(printf('%x', o_orderkey * 2654435761 % 4294967296), 8, '0') ELSE sha256(o_orderkey::VARCHAR) END, 1, 8))::BIGINT % 3)::INTEGER AS part FROM orders")
def l05_partition(spark, sf):
    """Ids of eight hex digits tell their part themselves, others by a hash."""
    o = views.tables(spark, sf, "orders")["orders"]
    id_ = F.when(F.col("o_orderkey") % 2 == 0, F.lower(F.lpad(F.hex(F.col("o_orderkey") * 2654435761 % 4294967296), 8, "0"))).otherwise(F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", train.partition(id_).alias("part"))


@register("l08_learned_matcher")
def l08_learned_matcher(spark, sf):
    """Decisions by a model that learned from the labels, beside the rules'; saved and loaded in between."""
    p, w = settle(views.parties(spark, sf)), views.written(spark, sf)
    labels = w.withColumns({"scorable": F.lit(True), "split": F.when(F.crc32("adm_party_id") % 3 == 0, "CALIBRATION").otherwise("TRAIN")})
    model = train.learn(labels, p, w.select(F.col("raw_name").alias("text")))
    single, members = matcher.names(w)
    ctx, mentions = matcher.context(p, single, decide.Policy())
    policy = decide.Policy(system=model.threshold, plain=model.plain_threshold, containment=False, short_names=False)
    out = matcher.baseline(ctx.records, mentions, settle(train.apply(model, ctx.proposals)), ctx.parties, policy, train.target(model))
    return matcher.spread(out, members).select("adm_party_id", "decision", "reason", F.round("confidence", 6).alias("confidence"), "party_id")
