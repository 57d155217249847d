"""Readers and writers: tables of a data folder, text dictionaries, JSON artefacts, latest-wins upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder, whatever file system it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictionary(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """A text dictionary of separated fields, one entry a line, as columns k0, k1, ..."""
    df = spark.read.csv(path, sep=sep)
    return df.toDF(*[f"k{i}" for i in range(len(df.columns))])


def artefact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document (such as a model's metadata) as one row."""
    return spark.read.json(path, multiLine=True)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """old with the rows of new: of rows with the same keys the one with the highest version stays, new before old.

    What ON CONFLICT DO UPDATE does to a table; the result is to be written beside the old table and swapped in.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row"))
    return picked.select(*keys, "_row.*").select(*old.columns)


def save_by_date(df: DataFrame, path: str, column: str = "d", mode: str = "overwrite") -> None:
    """Writes a table partitioned by date; only the partitions that df holds are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
