"""Small text inputs: samplesheets, allowlists, conversion tables, coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.parser import check_samplesheet


def read_samplesheet(spark: SparkSession, path: str) -> dict[str, str]:
    """Prefix -> sample of a sheet without a header (prefix, tab, sample); checked, at most a few thousand rows."""
    rows = spark.read.csv(path, sep="\t", schema="prefix string, sample string").where("prefix is not null and sample is not null").collect()
    return check_samplesheet([(r.prefix.strip(), r.sample.strip()) for r in rows])


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(seq): the distinct lines of a file, in upper case, without blanks and empty lines."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("seq")).where("seq <> ''").distinct()


def allowlist_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of an allowlist in order, for references whose order is part of the result; they are read by the driver, at most about seven million short lines."""
    return [x for r in spark.read.text(path, wholetext=True).toLocalIterator() for x in (line.strip() for line in r.value.splitlines()) if x]


def read_conversion_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with tabs and a header of source and destination names; all columns are strings."""
    t = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return t.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in t.columns])


def read_coordinates(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """(barcode, x, y) of a file of coordinates."""
    return spark.read.csv(path, sep=sep, header=header, schema="barcode string, x double, y double")
