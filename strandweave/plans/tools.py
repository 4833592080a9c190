"""Small tools beside the verbs: index reads from headers, nearest spots of beads, profiles of wells."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial, wells
from ..sources.fastq import read_fastq, write_fastq, write_table
from ..sources.tables import read_coordinates


def header_index(spark: SparkSession, path: str, out: str) -> None:
    """Writes the index reads that are kept in the headers of FASTQ files (FASTQ, a folder `I1`), a read in a folder for each file by its number; reads without one are left out."""
    seq, qual = wells.index_from_header(F.col("header"))
    reads = read_fastq(spark, path).select("file_idx", F.split("header", " ")[0].alias("header"), seq.alias("seq"), qual.alias("qual"))
    write_fastq(reads.where("seq is not null"), f"{out}/I1", by=["file_idx"])


def nearest_spots(spark: SparkSession, source: str, dest: str, out: str, expansion: float | None = None) -> None:
    """Writes the correspondence (TSV: bead, tx, ty, spot) of a file of source coordinates (with a header) and one of destinations (without)."""
    place = lambda path, header: read_coordinates(spark, path, header).withColumnRenamed("barcode", "spot")
    write_table(spatial.spot_correspondence(place(source, True), place(dest, False), expansion), f"{out}/nearest_spots")


def well_profile(table: DataFrame, well: Sequence[str], value: str, threshold: float = 0.7, expected: str | None = None) -> DataFrame:
    """`dominance` of a demultiplexed table, in the order of the wells; `-` is no value."""
    return wells.dominance(table.withColumn(value, F.when(F.col(value) != "-", F.col(value))), well, value, threshold, expected).orderBy(*well)


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m strandweave.plans.tools", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("header_index")
    v.add_argument("-i", required=True, help="FASTQ file, folder or glob")
    v = verbs.add_parser("nearest_spot")
    v.add_argument("-s", required=True, help="source coordinates: barcode, x, y, with a header")
    v.add_argument("-d", required=True, help="destination coordinates, without a header")
    v.add_argument("-expansion", type=float, help="the factor by which sources are spread; by their spacings without it")
    v = verbs.add_parser("well_profile")
    v.add_argument("-i", required=True, help="table with tabs and a header")
    v.add_argument("-well", action="append", required=True, help="column of the well, may be repeated")
    v.add_argument("-value", required=True)
    v.add_argument("-threshold", type=float, default=0.7)
    v.add_argument("-expected")
    for v in verbs.choices.values():
        v.add_argument("-out", required=True)
    o = p.parse_args(args)
    from .. import ship

    spark = SparkSession.builder.appName("strandweave tools").getOrCreate()
    ship(spark)
    if o.verb == "header_index":
        header_index(spark, o.i, o.out)
    elif o.verb == "nearest_spot":
        nearest_spots(spark, o.s, o.d, o.out, o.expansion)
    else:
        table = spark.read.csv(o.i, sep="\t", header=True)
        write_table(well_profile(table, o.well, o.value, o.threshold, o.expected), f"{o.out}/well_profile")


if __name__ == "__main__":
    main()
