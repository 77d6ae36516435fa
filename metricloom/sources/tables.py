"""Tables, delimited files, databases, literals, extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.operators.cleaning import normalise_headers
from metricloom.sources.shared import shared_path, write_extract  # noqa: F401


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a directory."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def run_sql(spark: SparkSession, directory: str, text: str, names) -> DataFrame:
    """SQL text over tables of a directory, written ``{name}`` in it; the session's own views stay as they are."""
    return spark.sql(text, **{n: load(spark, directory, n) for n in names})


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", index: str | None = None,
             timestamp_format: str | None = None, tidy_headers: bool = False) -> DataFrame:
    """Delimited text with a header and a declared schema (never inferred: that is a second scan).

    ``index``: the first column of the file is a row index; ``"drop"`` removes it, any other
    text renames it. Compressed files are read by extension; zip archives must be unpacked first.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", True).schema(schema)
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    df = reader.csv(path)
    if index == "drop":
        df = df.drop(df.columns[0])
    elif index:
        df = df.withColumnRenamed(df.columns[0], index)
    return normalise_headers(df) if tidy_headers else df


def read_database(spark: SparkSession, url: str, table: str, split_on: str, low, high, partitions: int) -> DataFrame:
    """Table of a live database, read in parallel ranges of a numeric or date column."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", split_on).option("lowerBound", low).option("upperBound", high)
            .option("numPartitions", partitions).load())


def inline_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few literal rows, such as a price list."""
    return spark.createDataFrame(rows, schema)
