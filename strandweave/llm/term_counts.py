"""Frequency of every distinct term or n-gram: occurrences over the collection, and the records it occurs in.

Suffix-sorted counting: each place of a record gives the suffix from there, truncated to the longest n-gram wanted. Suffixes are routed by
their scope and first term and sorted in reverse lexicographic order, so that all n-grams that begin alike are neighbours. One pass
with a stack of the open prefixes then has the count of every prefix when it closes. Record counts need no sets: a record marks
where one of its n-grams occurs for the first time (or, where a record is many rows, sorted order shows it), and the marks add up.

Equal suffixes are combined before they are sent. Heavy first terms, found by a sketch, are spread by what makes their parts disjoint
(the second term, or the record), and their partial counts are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import differs, durable
from ..operators.heavy_keys import heavy_keys

#: Parts into which a heavy first term is spread.
PARTS = 16
#: Terms whose suffixes are made and combined at once, or one record's: bounds the memory of a task.
TERMS = 2**20


def _row(columns: list[pa.Array], at: int) -> tuple:
    return tuple(None if (v := c[at].as_py()) is None or v != v else v for c in columns)


class PrefixStack:
    """Open prefixes, one for each length, over suffixes in reverse lexicographic order; works on whole Arrow batches, in which no term becomes an object of its own."""

    def __init__(self, longest: int):
        self.longest = longest
        self.open: list[tuple[pa.RecordBatch, int, int] | None] = [None] * longest  # keys and terms, occurrences, records of the open prefix of each length

    def push(self, keys: list[pa.Array], terms: list[pa.Array], count: np.ndarray, records: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
        """Adds a batch; yields the prefixes that it closes: (keys and terms up to the length, length, occurrences, records)."""
        changed = np.zeros(len(count), dtype=bool)
        for c in keys:
            changed |= differs(c)
        for n in range(1, self.longest + 1):
            changed = changed | differs(terms[n - 1])
            has = np.flatnonzero(terms[n - 1].is_valid().to_numpy(zero_copy_only=False))
            if not len(has):
                continue
            group = np.cumsum(changed)[has]
            at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sums, marks = np.add.reduceat(count[has], at), np.add.reduceat(records[n - 1][has], at)
            columns = [*keys, *terms[:n]]
            where = pa.array(has[at])
            found = pa.RecordBatch.from_arrays([c.take(where) for c in columns], [str(i) for i in range(len(columns))])
            if (before := self.open[n - 1]) is not None:
                if _row(before[0].columns, 0) == _row(found.columns, 0):
                    sums[0] += before[1]
                    marks[0] += before[2]
                else:
                    yield before[0], n, np.array([before[1]]), np.array([before[2]])
            last = len(at) - 1
            if last:
                yield found.slice(0, last), n, sums[:last], marks[:last]
            self.open[n - 1] = found.take(pa.array([last])), int(sums[last]), int(marks[last])

    def finish(self) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
        for n, x in enumerate(self.open, 1):
            if x is not None:
                yield x[0], n, np.array([x[1]]), np.array([x[2]])


def _count(suffixes: DataFrame, seen: DataFrame, scope: list[str], longest: int, record: bool, least: int) -> DataFrame:
    """scope..., t1..tn, n, cf, df of suffixes (s0.., t1.., c, d1.., or record). `seen` (s0.., t1) is sketched for heavy first terms. The suffixes are made, sorted and counted once."""
    keys, terms, marks = [f"s{i}" for i in range(len(scope))], [f"t{i}" for i in range(1, longest + 1)], [f"d{i}" for i in range(1, longest + 1)]
    route = F.xxhash64(*keys, "t1")
    heavy = heavy_keys(seen.select(route.alias("route")), "route")
    marked = suffixes.withColumn("route", route).join(F.broadcast(heavy), F.col("route") == F.col("heavy"), "left")
    part = F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64("record" if record else "t2" if longest > 1 else "t1"), F.lit(PARTS))).otherwise(F.lit(-1)).cast("int")
    routed = marked.withColumn("part", part).drop("route", "heavy").repartition(*keys, "t1", "part")
    order = [F.col("part"), *[F.col(k).asc_nulls_first() for k in keys], *[F.col(t).desc_nulls_last() for t in terms]] + ([F.col("record")] if record else [])
    kinds = dict(suffixes.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{t} string" for t in terms] + ["n int, cf bigint, df bigint, part int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, last = PrefixStack(longest), None

        def rows(found: pa.RecordBatch, n: int, c: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            size = len(c)
            columns = [*found.columns[1:], *[pa.nulls(size, pa.string())] * (longest - n), pa.array(np.full(size, n), pa.int32()), pa.array(c, pa.int64()), pa.array(r, pa.int64()), found.columns[0]]
            out = pa.RecordBatch.from_arrays(columns, [*keys, *terms, "n", "cf", "df", "part"])
            return out.filter(pc.or_(pc.greater_equal(out["cf"], least), pc.greater_equal(out["part"], 0)))

        for b in batches:
            if not len(b):
                continue
            ks, ts = [b["part"], *[b[k] for k in keys]], [b[t] for t in terms]
            if record:  # one row or more for each record: a change of the record within a term marks a new one
                own = [*ks, ts[0], b["record"]]
                new = np.logical_or.reduce([differs(c) for c in own])
                new[0] = last is None or _row(own, 0) != last
                last, records = _row(own, len(b) - 1), [new.astype(np.int64)]
            else:
                records = [b[m].to_numpy() for m in marks]
            yield from (rows(*x) for x in stack.push(ks, ts, b["c"].to_numpy(), records))
        yield from (rows(*x) for x in stack.finish())

    return durable(routed.sortWithinPartitions(*order).mapInArrow(run, schema))  # read for whole and for partial counts


def _merged(counted: DataFrame, scope: list[str], longest: int, least: int) -> DataFrame:
    keys, terms = [f"s{i}" for i in range(len(scope))], [f"t{i}" for i in range(1, longest + 1)]
    # Only a heavy first term's prefixes may lie in several parts: those are added up, the rest is whole.
    parts = counted.where("part >= 0").groupBy(*keys, *terms, "n").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).where(F.col("cf") >= least)
    return counted.where("part < 0").drop("part").unionByName(parts).select(*[F.col(k).alias(s) for k, s in zip(keys, scope)], *terms, "n", "cf", "df")


def value_counts(rows: DataFrame, scope: list[str], term: str, record: str, weight: str, sketch_over: DataFrame | None = None) -> DataFrame:
    """scope..., term, cf, df: of every distinct term of a scope the sum of the weights and the number of distinct records.

    A record may be any number of rows, also several with the same term. Rows without a term count for nothing; a null weight counts as 0; a null scope or record
    is a value like any other. `sketch_over`: rows (scope, term) to sketch for heavy terms instead of `rows` (the same ones before an expensive step); it never changes the result.
    """
    s = rows.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], F.col(term).alias("t1"), F.col(record).alias("record"), F.coalesce(F.col(weight).cast("bigint"), F.lit(0)).alias("c")).where(F.col("t1").isNotNull())
    keys = [f"s{i}" for i in range(len(scope))]
    seen = (rows if sketch_over is None else sketch_over).select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], F.col(term).alias("t1")).where(F.col("t1").isNotNull())
    names = [*keys, "t1", "record"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(names, use_threads=False).aggregate([("c", "sum")]).select([*names, "c_sum"]).rename_columns([*names, "c"]).to_batches()

    combined = s.mapInArrow(combine, s.schema)
    return _merged(_count(combined, seen, scope, 1, True, -(2**62)), scope, 1, -(2**62)).withColumnRenamed("t1", term).drop("n")


def _pieces(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """The lists in pieces of at most TERMS terms; a longer list is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + TERMS, "right")))
        yield lists.slice(at, end - at)
        at = end


def ngram_counts(records: DataFrame, terms: str, longest: int = 3, least: int = 1) -> DataFrame:
    """(ngram ARRAY<STRING>, n, cf, df): every n-gram of 1 to `longest` terms that occurs at least `least` times, with its occurrences and the number of records (rows) it occurs in.

    `terms` is an array of strings; null terms are left out, a null or empty array has no n-grams. Repeated rows are records of their own.
    """
    t, d = [f"t{i}" for i in range(1, longest + 1)], [f"d{i}" for i in range(1, longest + 1)]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms in (piece for b in batches for piece in _pieces(b.column(0))):
            sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
            flat = terms.flatten()
            record = np.repeat(np.arange(len(sizes)), sizes)[flat.is_valid().to_numpy(zero_copy_only=False)]
            if not len(record):
                continue
            sizes = np.bincount(record, minlength=len(sizes))
            named = flat.drop_null().dictionary_encode()  # terms stay in Arrow: no string of them becomes an object
            codes, words = named.indices.to_numpy().astype(np.int64), named.dictionary
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # terms from here to the end of the record
            gram = np.zeros(len(codes), dtype=np.int64)
            marks, at = [], []
            for n in range(longest):
                ok = left > n
                following = np.full(len(codes), len(words), dtype=np.int64)
                following[ok] = codes[np.flatnonzero(ok) + n]
                at.append(following)
                gram = np.unique(gram * (len(words) + 1) + following, return_inverse=True)[1].astype(np.int64)
                _, first = np.unique(record * (gram.max() + 1) + gram, return_index=True)
                mark = np.zeros(len(codes), dtype=bool)
                mark[first] = True
                marks.append(mark & ok)
            _, where, count = np.unique(gram, return_index=True, return_counts=True)
            out = [words.take(pa.array(x[where], mask=x[where] == len(words))) for x in at]
            out += [pa.array(count), *(pa.array(np.bincount(gram[m], minlength=len(where))) for m in marks)]
            yield pa.RecordBatch.from_arrays(out, [*t, "c", *d])

    schema = ", ".join([f"{x} string" for x in t] + ["c bigint"] + [f"{x} bigint" for x in d])
    r = records.select(F.col(terms).alias("terms"))
    seen = r.select(F.explode("terms").alias("t1")).where(F.col("t1").isNotNull())
    counted = _merged(_count(r.mapInArrow(suffixes, schema), seen, [], longest, False, least), [], longest, least)
    return counted.select(F.filter(F.array(*t), lambda x: x.isNotNull()).alias("ngram"), "n", "cf", "df")
