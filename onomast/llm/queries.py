"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm import chat, fingerprint, html, langid, minhash, mixing, packing, tokencount, topk, urlfilter
from onomast.llm._common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    parts = packing.pieces(docs, vocabulary()).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(parts)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(index, index.filter(F.col("vec_id") % 100 == 0))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns, loss = chat.parse(text), chat.loss_text(text, [(s["start"], s["end"]) for s in spans])
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(turns, vocabulary()).select("conv_id", "formatted", "loss_spans")
    return done.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    return langid.identify(docs, model, keep=["doc_id", held_out().alias("held_out")])


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprint.neighbours(docs, fingerprint.rarity(docs))


def op8_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.histogram(tokencount.lengths(table(spark, sf_dir, "documents"), vocabulary()))


RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Names of the hosts whose pages the list of the query and of its SQL is made of.
BAD_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op9_urlfilter(spark: SparkSession, sf_dir: str, hosts: Sequence[str] = BAD_HOSTS) -> DataFrame:
    """The list: canonical URLs of the pages there are on hosts with one of the names ``hosts``
    as a label; no table has such names, so other data need their own."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = F.concat(F.lit("."), urlfilter.host(F.col("url")))
    bad = reduce(or_, [F.instr(own, f".{name}.") > 0 for name in hosts], F.lit(False))
    listed = pages.filter(bad).select(urlfilter.canonical(F.col("url")))
    return urlfilter.judge(pages, listed, RULES).drop("url")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source the same share, as many rows in all as there are."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_topk, op3_minhash, op4_html, op5_chat, op6_langid, op7_fingerprints, op8_tokencount, op9_urlfilter, op10_mixing)}

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_KEPT = "list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref=')))"
_CANON = f"regexp_replace({_HOST}, '^www\\.', '') || regexp_replace({_PATH}, '(\\.html)?/*$', '') || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"


def _case(of: int) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[of]}'" for h, p, v in ordered) + " END"



SQL: dict[str, str] = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_urlfilter": f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_CANON} AS canon FROM pages),
listed AS (SELECT DISTINCT canon FROM p WHERE canon <> '' AND regexp_matches('.' || host, '\\.({"|".join(BAD_HOSTS)})\\.')),
j AS (SELECT p.page_id, p.host, p.path, {_case(0)} AS rule, {_case(1)} AS says, listed.canon IS NOT NULL AS hit FROM p LEFT JOIN listed ON p.canon = listed.canon)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict, rule IS NULL AND hit AS listed FROM j""",
    "op10_mixing": """
WITH RECURSIVE s AS (SELECT source AS mix_source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT count(*)::DOUBLE AS sources, sum(n)::DOUBLE AS total FROM s),
r AS (SELECT mix_source, t.total * 1.0::DOUBLE / t.sources / n AS rate FROM s, t),
m AS (SELECT mix_source, greatest(1, ceil(rate / 8.0))::BIGINT AS parts, rate / greatest(1, ceil(rate / 8.0)) AS mean FROM r),
c(mix_source, k, p, cum) AS (
  SELECT mix_source, 0, exp(-mean), exp(-mean) FROM m
  UNION ALL SELECT c.mix_source, c.k + 1, c.p * m.mean / (c.k + 1), c.cum + c.p * m.mean / (c.k + 1) FROM c JOIN m ON c.mix_source IS NOT DISTINCT FROM m.mix_source WHERE c.k < 60),
d AS (SELECT documents.*, m.mix_source, j, ('0x' || substr(md5('mix|' || doc_id || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents JOIN m ON documents.source IS NOT DISTINCT FROM m.mix_source, unnest(range(1, parts + 1)) AS x(j)),
n AS (SELECT doc_id, count(*)::BIGINT AS copies FROM d JOIN c ON c.mix_source IS NOT DISTINCT FROM d.mix_source AND c.cum <= d.u GROUP BY doc_id)
SELECT documents.doc_id, text, lang, source, n_chars, replica::INTEGER AS replica,
  ('0x' || substr(md5('mix|order|' || documents.doc_id || '|' || replica), 1, 13))::BIGINT AS mix_key
FROM documents JOIN n USING (doc_id), unnest(range(0, copies)) AS y(replica)""",
}
