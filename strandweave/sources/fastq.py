"""FASTQ files as DataFrames, through the filesystems that Spark reads, and sinks.

Lines are read by Spark's text source, so that any filesystem of the cluster will do, and plain files are split. Within a split lines keep their order; a task gathers four to a record in Arrow
batches. Compressed files are one split. For plain files the lines of each split are counted first: a split then knows the number of its first line, and a record that goes on in the next split is
completed with that split's first lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.common import once

SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
SCHEMA = "file string, file_idx int, row_idx bigint, header string, seq string, qual string"
#: Most splits of plain files: what is known of each (about 300 bytes) is sent to every task. For more data, raise spark.sql.files.maxPartitionBytes.
SPLITS = 200_000


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The FASTQ files of a path, which may be a file, a directory or a glob on any filesystem, in order of their names. All must have one kind of suffix."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[str] = []
    for status in fs.globStatus(p) or []:
        found += [s.getPath().toString() for s in (fs.listStatus(status.getPath()) if status.isDirectory() else [status]) if s.isFile()]
    files = sorted(f for f in found if f.endswith(SUFFIXES))
    if not files:
        raise FileNotFoundError(f"no FASTQ file in {path}")
    if len({f.endswith(".gz") for f in files}) > 1:
        raise ValueError(f"{path} has compressed and plain files")
    return files


def _spans(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """((file, start of the split), first row, end) of each run of a batch's lines that are of one split."""
    file, start = b.column("file_idx").to_numpy(), b.column("start").to_numpy()
    turns = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1 if len(b) else []
    edges = [0, *turns, len(b)]
    return (((int(file[a]), int(start[a])), int(a), int(z)) for a, z in zip(edges[:-1], edges[1:]) if z > a)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: its number of lines, and the first three."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([lines], pa.int64()), pa.array([head], pa.list_(pa.string()))], ["file_idx", "start", "lines", "head"])

    now, lines, head = None, 0, []
    for b in batches:
        for split, a, z in _spans(b):
            if split != now:
                if now is not None:
                    yield row()
                now, lines, head = split, 0, []
            head += b.column("value").slice(a, min(z - a, 3 - len(head))).to_pylist() if len(head) < 3 else []
            lines += z - a
    if now is not None:
        yield row()


class _Records:
    """Gathers the lines of one split to records."""

    def __init__(self, name: str, number: int, before: int, following: Sequence[str]):
        self.name, self.number, self.following = name, number, following
        self.skip = -before % 4  # lines that belong to a record of the split before
        self.record, self.held = (before + self.skip) // 4, []

    def add(self, lines: pa.Array) -> pa.RecordBatch | None:
        skipped = min(self.skip, len(lines))
        self.skip -= skipped
        self.held.append(lines.slice(skipped))
        if sum(map(len, self.held)) < 4:
            return None
        every = pa.concat_arrays(self.held)
        whole = len(every) // 4 * 4
        self.held = [every.slice(whole)]
        return self._batch(every.slice(0, whole))

    def finish(self) -> pa.RecordBatch | None:
        rest = [x for a in self.held for x in a.to_pylist()]
        if rest and any(rest + list(self.following)):  # blank lines may end a file
            rest += self.following[: 4 - len(rest)]
            if len(rest) < 4:
                raise ValueError(f"{self.name}: record {self.record} is no FASTQ record")
            return self._batch(pa.array(rest, pa.string()))
        return None

    def _batch(self, lines: pa.Array) -> pa.RecordBatch | None:
        header, seq, plus, qual = (lines.take(pa.array(np.arange(k, len(lines), 4))) for k in range(4))
        good = pc.and_(pc.starts_with(header, "@"), pc.starts_with(plus, "+")).to_numpy(zero_copy_only=False)
        if not good.all():
            at = int(np.flatnonzero(~good)[0])
            if any(lines.slice(4 * at).to_pylist()) or any(self.following):
                raise ValueError(f"{self.name}: record {self.record + at} is no FASTQ record")
            header, seq, qual = (c.slice(0, at) for c in (header, seq, qual))
        n = len(header)
        rows = pa.array(np.arange(self.record, self.record + n))
        self.record += n
        return pa.RecordBatch.from_arrays([pa.array([self.name] * n, pa.string()), pa.array(np.full(n, self.number), pa.int32()), rows, header, seq, qual], ["file", "file_idx", "row_idx", "header", "seq", "qual"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_idx, row_idx, header, seq, qual): the records of the files of a path, numbered from 0 within each file; files are numbered in order of their names. A record that is none raises when the
    rows are read."""
    files = list_files(spark, path)
    text = spark.read.text(files)
    uri = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f).toUri().toString()  # noqa: E731  # as the text source names a file
    numbers = spark.createDataFrame([(uri(f), k) for k, f in enumerate(files)], "file string, file_idx int")  # one row a file of the listing
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = lines.join(F.broadcast(numbers), "file", "left").select("file_idx", "start", "value")
    known = spark.sparkContext.broadcast(None if files[0].endswith(".gz") else _splits(lines))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gather = None, None
        for b in batches:
            for split, a, z in _spans(b):
                if split != now:
                    if gather is not None and (last := gather.finish()) is not None:
                        yield last
                    now, gather = split, _Records(files[split[0]], split[0], *(known.value[split] if known.value is not None else (0, ())))
                if (made := gather.add(b.column("value").slice(a, z - a))) is not None:
                    yield made
        if gather is not None and (last := gather.finish()) is not None:
            yield last

    return lines.mapInArrow(records, SCHEMA)


def _splits(lines: DataFrame) -> dict[tuple[int, int], tuple[int, list[str]]]:
    """(file, start) -> lines of the file before the split, and the first lines after it: one row for each split, of which there are at most SPLITS."""
    heads = lines.mapInArrow(_first_lines, "file_idx int, start bigint, lines bigint, head array<string>")
    along = W.partitionBy("file_idx").orderBy("start")
    before = F.coalesce(F.sum("lines").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.slice(F.flatten(F.collect_list("head").over(along.rowsBetween(1, 3))), 1, 3)
    rows = heads.select("file_idx", "start", before.alias("before"), after.alias("after")).limit(SPLITS + 1).collect()
    if len(rows) > SPLITS:
        raise ValueError(f"plain FASTQ in more than {SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    return {(r.file_idx, r.start): (r.before, list(r.after)) for r in rows}


def zip_mates(reads: dict[str, DataFrame], check: bool = True) -> DataFrame:
    """(file_idx, row_idx, header, <read>_seq, <read>_qual...): the N-th records of the mates' N-th files belong together; headers are never compared, the last read's is kept.

    `check`: a record without a mate raises when the rows are read; otherwise it is lost. Every file is read once.
    """
    names = list(reads)
    out, there = None, F.lit(True)
    for n in names:
        r = reads[n].select("file_idx", "row_idx", F.lit(True).alias(f"_{n}"), F.col("header").alias(f"_{n}_header"), F.col("seq").alias(f"{n}_seq"), F.col("qual").alias(f"{n}_qual"))
        out = r if out is None else out.join(r, ["file_idx", "row_idx"], "full" if check else "inner")
        there = there & F.col(f"_{n}").isNotNull()
    made = [*[f"{n}_{c}" for n in names for c in ("seq", "qual")]]
    if not check or len(names) == 1:
        return out.select("file_idx", "row_idx", *made, F.col(f"_{names[-1]}_header").alias("header"))
    alone = F.raise_error(F.concat(F.lit("records of each file differ: a mate is missing to record "), F.col("row_idx").cast("string"), F.lit(" of file "), F.col("file_idx").cast("string")))
    # A whole row at once, so that no later filter is taken for one of the join.
    return once(out.select("file_idx", F.when(there, F.col("row_idx")).otherwise(alone.cast("bigint")).alias("row_idx"), *made, F.col(f"_{names[-1]}_header").alias("header")))


def samples_of(files: Sequence[str], samplesheet: dict[str, str]) -> list[str | None]:
    """The sample of each file: that of the prefix in the samplesheet which the file's name contains (of several the last), None without one."""
    return [next((s for prefix, s in reversed(samplesheet.items()) if prefix in f.rsplit("/", 1)[-1]), None) for f in files]


def fastq_record(header: str = "header", seq: str = "seq", qual: str = "qual") -> Column:
    """The four lines of a record; the header begins with @ once."""
    at = F.when(F.col(header).startswith("@"), F.col(header)).otherwise(F.concat(F.lit("@"), F.col(header)))
    return F.concat_ws("\n", at, F.col(seq), F.lit("+"), F.col(qual))


def gathered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with those of a key side by side, so that a key is written in few files: small keys share a task, and a large one is split by its size when the rows are there."""
    return rows.hint("rebalance", *[F.col(c) for c in by])


def write_fastq(rows: DataFrame, path: str, header: str = "header", seq: str = "seq", qual: str = "qual", by: Sequence[str] = ()) -> None:
    """Writes gzipped FASTQ, one folder for each value of the `by` columns. Rows keep the partitions they have, so a frequent key is written by many tasks; see `gathered`."""
    writer = rows.select(*by, fastq_record(header, seq, qual).alias("value")).write.mode("overwrite").option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, missing: str = "-") -> None:
    """Writes a gzipped TSV with a header, null as `-`; one folder for each value of the `by` columns."""
    writer = rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", missing).option("emptyValue", missing).option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).csv(path)
