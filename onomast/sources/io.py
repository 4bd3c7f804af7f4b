"""Sources and sinks: CSV, JSON, JSON lines, TOML, text ids, ledgers and guarded outputs."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.operators.settle import numbered


def read_names(spark: SparkSession, path: str, name_column: str, id_column: str, prefix: str) -> DataFrame:
    """``id, name`` (and ``aliases`` if there) of a CSV file with a header.

    A missing id column gives ids ``prefix`` + row number; a missing name column or a blank
    name is an error. A byte order mark is passed over.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if name_column not in df.columns:
        raise ValueError(f"column {name_column} is missing")
    if not df.filter(F.coalesce(F.trim(name_column), F.lit("")) == "").isEmpty():
        raise ValueError(f"blank {name_column}")
    if id_column in df.columns:
        key = F.col(id_column)
    else:
        df = numbered(df.withColumn("_at", F.monotonically_increasing_id()), [F.col("_at")], "_n")
        key = F.concat(F.lit(prefix), (F.col("_n") + 1).cast("string"))
    extra = [F.col("aliases")] if "aliases" in df.columns else []
    return df.select(key.alias("id"), F.trim(name_column).alias("name"), *extra)


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet of a workbook (``.xlsx``) as text columns, its first row the header.

    A workbook is a zip of XML; the sheet is read by ``binaryFile`` and parsed on an executor
    row by row. Blank headers are left out; a missing sheet is an error.
    """
    from onomast.sources import workbook

    return workbook.read(spark, path, sheet)


def read_json(spark: SparkSession, path: str, schema: str | None = None, default: DataFrame | None = None) -> DataFrame:
    """One JSON document per file; ``default`` where the path does not exist."""
    reader = spark.read.option("multiLine", True)
    try:
        return (reader.schema(schema) if schema else reader).json(path)
    except Exception as e:  # noqa: BLE001
        if default is not None and "PATH_NOT_FOUND" in str(e):
            return default
        raise


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, unknown keys dropped."""
    return spark.read.schema(schema).json(path)


def read_config(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``adm_party_id`` of a text file, one to a line."""
    return spark.read.text(path).select(F.trim("value").alias("adm_party_id")).filter("adm_party_id != ''").distinct()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("errorifexists").option("header", True).csv(path)


def append_ledger(decisions: DataFrame, path: str) -> None:
    """Ids newly matched are appended; ids already there are not written again."""
    spark = decisions.sparkSession
    new = decisions.filter("decision = 'MATCH'").select("adm_party_id", "party_id", "confidence")
    try:
        old = spark.read.parquet(path).select("adm_party_id")
        new = new.join(old, "adm_party_id", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def write_stages(stages: dict[str, DataFrame], path: str) -> None:
    """Every stage's decisions in one table, partitioned by stage."""
    for i, (name, df) in enumerate(stages.items()):
        df.withColumn("stage", F.lit(name)).write.mode("overwrite" if i == 0 else "append").partitionBy("stage").parquet(path)


def write_run(stages: dict[str, DataFrame], events: DataFrame, path: str) -> None:
    """A run's tables: ``decisions`` by stage, ``events``, and ``comparisons`` of each stage with the next."""
    write_stages(stages, f"{path}/decisions")
    events.write.mode("overwrite").parquet(f"{path}/events")
    names = list(stages)
    for i, (before, after) in enumerate(zip(names, names[1:], strict=False)):
        changes(stages[before], stages[after]).withColumn("step", F.lit(f"{before}_{after}")).write.mode("overwrite" if i == 0 else "append").partitionBy("step").parquet(f"{path}/comparisons")


def pages(df: DataFrame, order: list[str], limit: int = 1_048_575) -> DataFrame:
    """``page`` of each row as spreadsheets split them; ``order`` must tell rows apart."""
    return numbered(df, [F.col(c) for c in order], "onomast place").withColumn("page", F.floor(F.col("onomast place") / limit).cast("int")).drop("onomast place")


def checked(parts: dict[str, DataFrame], rows: DataFrame, key: str = "adm_party_id") -> dict[str, int]:
    """Counts of an export's tables; an error unless together they hold each row of ``rows`` once."""
    counts = {name: df.count() for name, df in parts.items()}
    every = None
    for df in parts.values():
        every = df.select(key) if every is None else every.unionByName(df.select(key))
    twice = every.groupBy(key).count().filter("count > 1").select(key).head(1)
    if twice:
        raise ValueError(f"{twice[0][key]} is exported twice")
    lost = rows.select(key).exceptAll(every).head(1) or every.exceptAll(rows.select(key)).head(1)
    if lost:
        raise ValueError(f"{lost[0][key]} is in one of the rows and the export only")
    return counts


def markdown(df: DataFrame, title: str) -> str:
    """A table of figures (a report's, a few rows) as Markdown."""
    rows = df.collect()
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records whose decision, party or reason changed between two tables of decisions."""
    pick = lambda d, s: d.select("adm_party_id", *[F.col(c).alias(f"{c}_{s}") for c in ("decision", "party_id", "reason", "tier", "confidence")])
    both = pick(before, "before").join(pick(after, "after"), "adm_party_id", "full")
    same = F.lit(True)
    for c in ("decision", "party_id", "reason"):
        same = same & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    return both.filter(~same)
