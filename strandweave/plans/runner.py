"""Runs the verbs of a configuration and writes their results, with flags that let a run go on where it ended."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.parser import load
from ..sources.fastq import gathered, write_fastq, write_table
from .engine import DEST, CustomFunction, Pipeline

VERBS = ("value_extraction", "value_translation", "demultiplex", "annotate_header")
#: Intermediate tables that can be written for themselves.
STAGES = ("segment_counts", "correction_maps", "rank_curves", "value_tree", "size_info")


def _reads_of(df: DataFrame) -> list[str]:
    return [c[: -len("_seq")] for c in df.columns if c.endswith("_seq")]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _done(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _flag(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.create(p, True).close()


@contextmanager
def _stored(rows: DataFrame, out: str, name: str, by: Sequence[str] = ()) -> Iterator[DataFrame]:
    """The rows, written once under the results' folder, from where every sink reads its columns in the same order; removed at the end. With `by` those of a key are side by side."""
    spark, path = rows.sparkSession, f"{out}/_tmp/{name}"
    (gathered(rows, by) if by else rows).write.mode("overwrite").parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        fs, p = _path(spark, path)
        fs.delete(p, True)


def write_verb(pipeline: Pipeline, verb: str, out: str) -> None:
    """Writes one verb's result, in folders by sample: value_extraction: corrected_table (TSV), and rank_curves (TSV) if a segment is corrected; value_translation: translated_<read> (FASTQ),
    barcode_list (TSV) and size_info (TSV); demultiplex: demultiplex (TSV), or demultiplex_<read> (FASTQ), in folders by sample and key; annotate_header: annotate_header_<read> (FASTQ).

    What a verb computes is computed once: its sinks read one stored table.
    """
    by = ["sample"]
    if verb == "value_extraction":
        write_table(pipeline.extract(), f"{out}/corrected_table", by)
        if any(x.corrected for x in pipeline.config.extraction.lineages.values()):
            write_stage(pipeline, "rank_curves", out)
    elif verb == "value_translation":
        with _stored(pipeline.translated(), out, verb) as rows:
            complete = rows.where("complete")
            for read in _reads_of(rows):
                write_fastq(complete, f"{out}/translated_{read}", "header", f"{read}_seq", f"{read}_qual", by)
            dests = [c for c in rows.columns if c.startswith(DEST)]
            write_table(rows.select("sample", F.col("header").alias("Header"), *[F.col(f"`{c}`").alias(c[len(DEST) :]) for c in dests]), f"{out}/barcode_list", by)
    elif verb == "demultiplex":
        d = pipeline.config.demultiplex
        if d.format == "TSV":
            write_table(gathered(pipeline.demultiplex(), ["sample", "key"]), f"{out}/demultiplex", ["sample", "key"])
        else:
            by = ["sample", "key"] if d.key else by
            with _stored(pipeline.demultiplex(), out, verb, by if d.key else ()) as rows:
                for read in _reads_of(rows):
                    write_fastq(rows, f"{out}/demultiplex_{read}", f"{read}_header", f"{read}_seq", f"{read}_qual", by)
    elif verb == "annotate_header":
        with _stored(pipeline.annotate(), out, verb) as rows:
            for read in _reads_of(rows):
                write_fastq(rows, f"{out}/annotate_header_{read}", f"{read}_header", f"{read}_seq", f"{read}_qual", by)
    else:
        raise ValueError(f"unknown verb {verb}")


def write_stage(pipeline: Pipeline, stage: str, out: str) -> None:
    """Writes an intermediate table (TSV, in folders by sample): segment_counts (segment, seq, n); correction_maps (segment, raw, clean); rank_curves (segment, seq, n, rank, log_rank); value_tree
    (component, path, value, n, id), paths and combined values joined by `_`; size_info (component, size)."""
    if stage == "segment_counts":
        table = pipeline.counts()
    elif stage == "correction_maps":
        maps = {s: pipeline.correction_map(s) for s in pipeline.config.extraction.lineages}
        table = reduce(DataFrame.unionByName, [m.withColumn("segment", F.lit(s)) for s, m in maps.items() if m is not None])
    elif stage == "rank_curves":
        table = pipeline.rank_curves()
    elif stage == "value_tree":
        table = pipeline.value_tree().withColumns({c: F.array_join(c, "_", "-") for c in ("path", "value")})
    elif stage == "size_info":
        table = pipeline.size_info()
    else:
        raise ValueError(f"unknown stage {stage}")
    write_table(table, f"{out}/{stage}", ["sample"])


def run(spark: SparkSession, pipeline: Pipeline, out: str, verbs: Sequence[str] | None = None, again: bool = False) -> list[str]:
    """The verbs that were run now. Without `verbs` all that the configuration has; a verb whose flag is there is skipped unless `again`."""
    c = pipeline.config
    has = {"value_extraction": True, "value_translation": c.translation is not None, "demultiplex": c.demultiplex is not None, "annotate_header": c.annotation is not None}
    ran = []
    for verb in verbs or [v for v in VERBS if has[v]]:
        flag = f"{out}/_flg/_{verb}"
        if again or not _done(spark, flag):
            write_verb(pipeline, verb, out)
            _flag(spark, flag)
            ran.append(verb)
    return ran


def named_functions(given: Sequence[str]) -> dict[str, CustomFunction]:
    """Functions of `segment=module:function`, for segments corrected by a user's function."""
    out = {}
    for text in given:
        segment, _, name = text.partition("=")
        module, _, function = name.partition(":")
        if not (segment and module and function):
            raise ValueError(f"{text} is not segment=module:function")
        out[segment] = getattr(importlib.import_module(module), function)
    return out


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m strandweave", description="Runs the verbs of a configuration.")
    p.add_argument("-conf", required=True)
    p.add_argument("-out", help="folder of the results; PROJECT_DIR by default")
    p.add_argument("-verb", action="append", choices=VERBS)
    p.add_argument("-stage", action="append", choices=STAGES, default=[], help="write this intermediate table; without -verb nothing else")
    p.add_argument("-custom", action="append", default=[], metavar="SEGMENT=MODULE:FUNCTION", help="the function of a CUSTOM_CORRECTION or BARTENDER_CORRECTION")
    p.add_argument("-mode", choices=("random", "ordered"), default="random")
    p.add_argument("-metric", choices=("osa", "levenshtein"), default="osa")
    p.add_argument("-unique", action="store_true", help="pairs are merged only if headers are unique")
    p.add_argument("-aliases", action="store_true", help="understand old names of functions and options")
    p.add_argument("-again", action="store_true", help="run verbs that have run before")
    o = p.parse_args(args)
    from .. import ship

    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    ship(spark)
    config = load(o.conf, o.aliases)
    pipeline, out = Pipeline(spark, config, custom=named_functions(o.custom), mode=o.mode, metric=o.metric, unique=o.unique), o.out or config.general["PROJECT_DIR"]
    for stage in o.stage:
        write_stage(pipeline, stage, out)
    ran = run(spark, pipeline, out, o.verb, o.again) if o.verb or not o.stage else []
    print("ran", ", ".join([*o.stage, *ran]) or "nothing")
