"""The seven tables, and the tables beside them, with their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES


def load_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(path)


def save_table(df: DataFrame, name: str, path: str, partition_by: list[str] | None = None) -> None:
    """Writes the columns of the table's schema, cast to its types."""
    schema = df.sparkSession.createDataFrame([], TABLES[name]).schema
    out = df.select(*[df[f.name].cast(f.dataType) for f in schema], *[c for c in partition_by or [] if c not in schema.names])
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
