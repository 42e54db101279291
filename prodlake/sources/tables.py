"""Parquet tables addressed by path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class TablePaths:
    """Folders of the three layers under one root."""

    root: str

    def of(self, table: str) -> str:
        layer = table.split("_", 1)[0]
        return f"{self.root.rstrip('/')}/{layer}/{table}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for every file system Hadoop knows, not only for local files."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    rebalance: bool = False,
    only_touched_partitions: bool = False,
) -> None:
    """Replace a table, schema included.

    ``rebalance`` lets adaptive execution bring the rows of each partition value together
    in files of the advisory size: small ones are merged, a value holding much of the
    table is split over several tasks.  Without it every task writes a file per value.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        if only_touched_partitions:
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def scan_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """``schema`` saves the footer read that infers it and keeps partition values typed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def written_rows(spark: SparkSession, path: str) -> int:
    """Row count of a written table: no column is read, no plan runs a second time."""
    return scan_table(spark, path).count()


def read_csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A typed table exported as CSV with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def register_views(spark: SparkSession, paths: TablePaths, tables: list[str]) -> None:
    for table in tables:
        scan_table(spark, paths.of(table)).createOrReplaceTempView(table)
