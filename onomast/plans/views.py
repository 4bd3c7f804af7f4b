"""Party tables derived from the test tables, in SQL that both engines run.

There are no organisation names in the test data, so parts become verified parties (one
for each name and type) and written names (one for each part, by a template that depends
on its key). The generating keys give true labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORM = "CASE MIN(p_partkey) % 4 WHEN 0 THEN 'Inc' WHEN 1 THEN 'LLC' WHEN 2 THEN 'Ltd' ELSE 'Corp' END"
VERIFIED = f"""
SELECT 'v-' || replace(p_name, ' ', '-') || '-' || lower(p_type) AS party_id, p_name || ' ' || lower(p_type) || ' ' || {FORM} AS party_name,
  CASE p_type WHEN 'SMALL' THEN 'v-' || replace(p_name, ' ', '-') || '-medium' WHEN 'MEDIUM' THEN 'v-' || replace(p_name, ' ', '-') || '-large' END AS wanted_parent
FROM {{part}} GROUP BY p_name, p_type"""
PARTIES = f"""
SELECT v.party_id, v.party_name, p.party_id AS parent_id FROM ({VERIFIED}) v LEFT JOIN ({VERIFIED}) p ON v.wanted_parent = p.party_id"""
WRITTEN = """
SELECT 'u' || CAST(p_partkey AS VARCHAR(20)) AS adm_party_id, CAST(p_partkey AS INTEGER) + 2 AS source_row, 'v-' || replace(p_name, ' ', '-') || '-' || lower(p_type) AS expected,
  CASE CAST(p_partkey % 11 AS INTEGER)
    WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN p_name || ' ' || lower(p_type) || ' Inc' WHEN 2 THEN upper(p_name) || ' ' || p_type || ' LLC' WHEN 3 THEN p_name || ', ' || lower(p_type) || ' Ltd.'
    WHEN 4 THEN p_name || ' ' || lower(p_type) || ' Corp - Texas Division' WHEN 5 THEN p_name || ' ' || lower(p_type) || ' (' || p_brand || ')' WHEN 6 THEN p_name || ' ' || lower(p_type) || ' Inc OBO ' || p_brand || ' group'
    WHEN 7 THEN p_brand || ' group VIA ' || p_name || ' ' || lower(p_type) WHEN 8 THEN replace(p_name, 'l', 'll') || ' ' || lower(p_type) WHEN 9 THEN p_brand || ' unrelated ' || CAST(p_size AS VARCHAR(20)) ELSE 'OBO ' || p_name END AS raw_name
FROM {part}"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def run(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **tables(spark, sf_dir, *names))


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PARTIES, "part")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, WRITTEN, "part")


def duck(sql: str) -> str:
    """The same text for an engine where the tables are views of their names."""
    return sql.replace("{part}", "part")
