"""Helpers shared by the operators: table access, size-checked broadcasts, durable cuts of the lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: Most rows and bytes that a side may have to be broadcast by `broadcast_if_small`.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value: of strings and binaries what they hold, of arrays and structs that of their parts, else 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(16), lambda n, x: n + _width(x, kind.elementType).cast("int")), F.lit(8))
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def widths(df: DataFrame) -> Column:
    """Bytes of a row."""
    return sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks `df` for broadcast if counting shows at most `most` rows, and adding up at most BROADCAST_BYTES bytes; else returns it as it is, and the join shuffles. The count stops at `most` + 1 rows."""
    seen = df.limit(most + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(widths(df)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen.rows <= most and seen.bytes <= BROADCAST_BYTES else df


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder which the session names in spark.checkpoint.dir. Only a local session may leave it unset: it gets a folder that is removed at the end."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strandweave-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def once(df: DataFrame) -> DataFrame:
    """The same rows, computed once. Later filters and projections are not merged into the columns' expressions, which would compute costly ones again for every use; nor are columns pruned."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def blank_trimmed(c: Column) -> Column:
    """Without outer blanks and tabs."""
    return F.btrim(c, F.lit(" \t"))


def clean_value(c: Column) -> Column:
    """A segment's value: upper case, without outer blanks and tabs; `-`, empty and null are missing (null)."""
    value = F.upper(blank_trimmed(c))
    return F.when((value != "-") & (value != ""), value)


def free_name(wanted: str, taken: Sequence[str]) -> str:
    """`wanted`, with underscores in front until no column of `taken` has that name (Spark compares names without case)."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted


def dense_rank_all(rows: DataFrame, order: Sequence[Column], name: str, stored: bool = False) -> DataFrame:
    """`rows` with their place from 0 in an order over the whole table. Range partitions are sorted and numbered within, then moved by the sizes of those before: what meets in one task is
    one row a partition. The numbered rows are written once, so that a partition made again has the same numbers; rows equal in the order come in any order. The rows are read twice, to find the
    ranges and to sort: they are written first, unless they are `stored` or cheap."""
    rows = rows if stored else durable(rows)
    at, part, before = (free_name(n, rows.columns) for n in ("_at", "_part", "_before"))
    # The upper bits of this number are the partition, the lower 33 the row's place in it.
    numbered = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    which, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit(2**33 - 1))
    sizes = numbered.groupBy(which.alias(part)).agg(F.max(place + 1).alias("_size"))
    moved = sizes.select(part, F.coalesce(F.sum("_size").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return numbered.join(F.broadcast(moved), which == F.col(part)).withColumn(name, (F.col(before) + place).cast("bigint")).drop(at, part, before)


def differs(column: pa.Array) -> np.ndarray:
    """Where a value of an Arrow array differs from the one before it (the first: True); missing values are equal, and so are NaN."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(column.type):
            unlike = pc.and_not(unlike, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out[1:] = unlike.to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def same_rows(a: Sequence[pa.Array], i: int, b: Sequence[pa.Array], j: int) -> bool:
    """Whether a row of some arrays is that of others; missing values are equal, and so are NaN."""
    return all(not differs(pa.concat_arrays([x.slice(i, 1), y.slice(j, 1)]))[1] for x, y in zip(a, b))


def place_within(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, stored: bool = False) -> DataFrame:
    """`rows` with their place from 0 in an order within each group of the `by` columns, however large a group is.

    Range partitions by group and order are sorted and numbered within, in one pass over Arrow batches. A group that goes on in the next partitions has its first rows' number carried over: what
    meets in one task is one row a partition. The numbered rows are written once; rows equal in the order come in any order. A null group is one like any other. `stored` as in `dense_rank_all`.
    """
    rows = rows if stored else durable(rows)
    if not by:
        return dense_rank_all(rows, order, name, True)
    at, first, edge, where, part = (free_name(n, rows.columns) for n in ("_at", "_first", "_edge", "_where", "_part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, count, seen, leading = None, 0, 0, True  # the last batch's keys, rows of its last group so far, rows so far, whether that group is the partition's first
        for b in batches:
            if not len(b):
                continue
            keys = [b.column(k) for k in by]
            new = np.logical_or.reduce([differs(k) for k in keys])
            new[0] = before is not None and not same_rows(before, len(before[0]) - 1, keys, 0)
            place = np.arange(len(b))
            start = np.maximum.accumulate(np.where(new, place, -1))
            local = np.where(start >= 0, place - start, place + count)
            lead = (start < 0) & leading
            ends = (place + seen == 0) | (place == len(b) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (local, lead, ends, place + seen))], [*b.schema.names, at, first, edge, where])
            before, count, seen, leading = keys, int(local[-1]) + 1, seen + len(b), bool(lead[-1])

    keys = [F.col(k) for k in by]
    kinds = T.StructType([*rows.schema.fields, T.StructField(at, T.LongType()), T.StructField(first, T.BooleanType()), T.StructField(edge, T.BooleanType()), T.StructField(where, T.LongType())])
    numbered = durable(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(number, kinds).withColumn(part, F.spark_partition_id()))
    # One row a partition: its first and its last group, the last one's rows in it, and whether that is the only one.
    of = F.struct(*keys)
    edges = numbered.where(edge).groupBy(part).agg(F.min_by(of, where), F.max_by(of, where), F.max_by(F.col(at) + 1, where), F.max_by(first, where)).orderBy(part).collect()
    carried, group, total = [], None, 0
    for k, head, tail, n, only in edges:
        carry = total if repr(head) == group else 0
        carried.append((k, carry))
        group, total = repr(tail), n + (carry if only else 0)
    carries = rows.sparkSession.createDataFrame(carried, f"{part} int, _carry bigint")
    return numbered.join(F.broadcast(carries), part).withColumn(name, F.col(at) + F.when(F.col(first), F.col("_carry")).otherwise(0)).drop(at, first, edge, where, part, "_carry")
