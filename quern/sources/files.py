"""File sources: delimited files, workbooks as unions of sheets, whole files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; types are detected by one extra pass unless a schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def union_sheets(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """All sheets by column name, with __sheet_name; columns that a sheet lacks are null."""
    named = [df.withColumn("__sheet_name", F.lit(name)) for name, df in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def header_labels(labels: list[str | None]) -> list[str]:
    """Column labels without repeats (name, name_1, ...); blank ones get their column's letter."""
    seen: dict[str, int] = {}
    out = []
    for k, label in enumerate(labels):
        name = (label or "").strip() or _letters(k)
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}_{n}" if n else name)
    return out


def _letters(k: int) -> str:
    return (_letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def row_texts(df: DataFrame, order: list[str]) -> DataFrame:
    """`order` and text: each row as 'column: value,column: value', nulls left out; rows
    without any value are left out too."""
    cells = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in df.columns]))
    return df.select(*order, F.array_join(cells, ",").alias("text")).filter("text != ''")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, extension (lower case) and text of whole files."""
    name = F.col("path")
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).alias("extension"), F.decode("content", "UTF-8").alias("text"))
