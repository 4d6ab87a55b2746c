"""Reading and writing study tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..study import StudyError


def normalise(df: DataFrame) -> DataFrame:
    """Missing floating-point values are NULL, never NaN; infinities stay."""
    return df.select(*(
        F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields))


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
               columns=None) -> DataFrame:
    """One table; text formats need a schema, a given schema skips reading footers."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        if schema is None:
            raise StudyError(f"{fmt} tables need a schema")
        if fmt == "csv":
            reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return normalise(df.select(*columns) if columns else df)


def load_tables(spark: SparkSession, folder: str, names, fmt: str = "parquet",
                schemas: dict | None = None) -> dict[str, DataFrame]:
    missing = tables_missing(spark, folder, names, fmt)
    if missing:
        raise StudyError(f"tables not found in {folder}: {missing}")
    return {n: load_table(spark, f"{folder}/{n}.{fmt}", fmt, (schemas or {}).get(n)) for n in names}


def tables_missing(spark: SparkSession, folder: str, names, fmt: str = "parquet") -> list[str]:
    """Names whose files cannot be listed."""
    out = []
    for name in names:
        try:
            spark.read.format("binaryFile").load(f"{folder}/{name}.{fmt}").schema
        except AnalysisException:
            out.append(name)
    return out


def save_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    for name, df in tables.items():
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.save(f"{folder}/{name}.{fmt}")


def json_rows(df: DataFrame) -> DataFrame:
    """A released table as one JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
