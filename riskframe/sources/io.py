"""Read and write tables, bundles of tables, report folders and fitted models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.nulls import nan_to_null
from .schema import check_columns

MANIFEST = "tables.manifest"


def read_facts(spark: SparkSession, path: str, schema: StructType | None = None,
               text_ids: Iterable[str] = (), fmt: str = "parquet") -> DataFrame:
    """Case table with lower-case names, ids as text and NaN as NULL."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV case table needs a declared schema")
        reader = reader.option("header", True).option("enforceSchema", False).schema(schema)
    df = reader.load(path)
    df = nan_to_null(df.toDF(*[c.lower() for c in df.columns]))
    df = df.withColumns({c: F.col(c).cast("string") for c in text_ids})
    if schema is None:
        return df
    ids = {c.lower() for c in text_ids}
    return check_columns(df, StructType([StructField(f.name, StringType(), f.nullable) if f.name.lower() in ids else f
                                         for f in schema]))


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header line and a declared schema."""
    return nan_to_null(spark.read.csv(path, schema=schema, header=True, enforceSchema=False))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with header lines; no row index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_bundle(folder: str, tables: Mapping[str, DataFrame],
                partition_by: Mapping[str, list[str]] | None = None) -> None:
    """One parquet folder per table plus a list of the names."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{folder}/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        names = spark.createDataFrame([(n,) for n in tables], "name string")
        names.coalesce(1).write.mode("overwrite").json(f"{folder}/{MANIFEST}")


def load_bundle(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a bundle by name."""
    if names is None:
        names = [r.name for r in spark.read.schema("name string").json(f"{folder}/{MANIFEST}").collect()]
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_report(folder: str, tables: Mapping[str, DataFrame]) -> None:
    """One CSV folder per named report table."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
