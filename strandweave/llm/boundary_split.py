"""Splitting oversized items at natural boundaries.

Lexical-cohesion segmentation: the similarity of the block before and the block after each gap is slid along the item; a valley marks a boundary, and
its depth says how marked it is. Pieces are cut greedily: of the valleys in the window that a piece may end in, the deepest is taken (of equally
deep ones the last), and the next piece starts `overlap` units before the cut. Without a valley the piece is as long as allowed.

Items may be rows (reads of a file, each with a term) or texts (one row each, units are characters). Rows are gathered in blocks of places, in which similarities and depths are
computed apart from each other; what a block must know of its neighbours are the few rows next to it.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.common import broadcast_if_small, durable, free_name

#: Consecutive rows of one item whose similarities are computed together; a long item is many such blocks, of any number of tasks.
ROWS_A_BLOCK = 65_536
#: The climb from a valley to its peaks is followed over so many widths of a block; one that has not turned by then counts as reaching similarity 1.
REACH = 4


class Cutter:
    """Cuts one item of `n` units. Valleys are pushed in order of place; memory is the valleys of one window that no later, deeper one hides."""

    def __init__(self, n: int, limit: int, overlap: int):
        self.n, self.limit, self.overlap, self.start = n, limit, min(overlap, limit - 1), 0
        self.valleys: deque[tuple[int, float]] = deque()

    def _until(self, place: int) -> Iterator[tuple[int, int]]:
        """The pieces whose windows end before `place`."""
        while place > self.start + self.limit < self.n:
            while self.valleys and self.valleys[0][0] <= self.start + self.overlap:
                self.valleys.popleft()
            end = self.valleys[0][0] if self.valleys else self.start + self.limit
            yield self.start, end - 1
            self.start = end - self.overlap

    def push(self, place: int, depth: float) -> Iterator[tuple[int, int]]:
        yield from self._until(place)
        while self.valleys and self.valleys[-1][1] <= depth:
            self.valleys.pop()
        self.valleys.append((place, depth))

    def finish(self) -> Iterator[tuple[int, int]]:
        yield from self._until(self.n)
        if self.n > self.start:
            yield self.start, self.n - 1


def row_blocks(rows: DataFrame, item: str, place: str, term: str) -> DataFrame:
    """(item, b, n, z, places, terms): the rows of every item in blocks of ROWS_A_BLOCK places: how many different places there are, the last one, and where the term changes, with the term from there on.
    Written once.

    A row without a term continues the term before it. Repeated (item, place) count once (of differing terms the greatest). Rows without item, or with a null or negative place, are left out. Grouping
    by (item, block of places), one item may hold most rows.
    """
    r = rows.select(F.col(item).alias("i"), F.col(place).cast("bigint").alias("p"), F.col(term).alias("t")).where(F.col("i").isNotNull() & (F.col("p") >= 0))
    r = r.withColumn("b", F.floor(F.col("p") / ROWS_A_BLOCK)).repartition("i", "b")
    r = r.groupBy("i", "b", "p").agg(F.max("t").alias("t"))
    before = F.last("t", ignorenulls=True).over(W.partitionBy("i", "b").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    starts = F.col("t").isNotNull() & (F.col("before").isNull() | (F.col("t") != F.col("before")))
    b = r.withColumn("before", before).groupBy("i", "b").agg(F.count("*").alias("n"), F.max("p").alias("z"), F.sort_array(F.collect_list(F.when(starts, F.struct("p", "t")))).alias("runs"))
    return durable(b.select(F.col("i").alias(item), "b", "n", "z", F.col("runs.p").alias("places"), F.col("runs.t").alias("terms")))


def row_counts(blocks: DataFrame, item: str) -> DataFrame:
    """(item, n): the number of different places of every item."""
    return blocks.groupBy(item).agg(F.sum("n").alias("n"))


def similarities(x: np.ndarray, block: int) -> np.ndarray:
    """For each gap between two units the cosine of the counts of terms (codes from 0) of the `block` units before and the `block` units after it, fewer at the ends."""
    gaps, padded = len(x) - 1, np.concatenate([np.full(block, -2), x, np.full(block, -3)])
    at = lambda k: padded[block + k : block + k + gaps]  # noqa: E731  # the unit k places from each gap's last unit before it
    back, ahead = [at(-k) for k in range(block)], [at(k + 1) for k in range(block)]
    dot = sum((u == v).astype(np.int64) for u in back for v in ahead)
    norm = lambda side: sum(((u == v) & (u >= 0)).astype(np.int64) for u in side for v in side)
    return dot / np.sqrt(norm(back) * norm(ahead))


def valleys_of(s: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(gaps, depths) of the local minima of similarities: the depth is the climb to the peaks on both sides, followed over REACH blocks. Outside of the item similarity is 1."""
    padded = np.concatenate([[1.0], s, [1.0]])
    low = np.flatnonzero((s < 1) & (s <= padded[:-2]) & (s <= padded[2:]))
    depth = np.zeros(len(low))
    for way in (-1, 1):
        now, climbing = s[low], np.ones(len(low), dtype=bool)
        peak = now.copy()
        for k in range(1, REACH * block + 1):
            place = low + 1 + way * k
            ahead = padded[np.clip(place, 0, len(padded) - 1)]
            climbing &= ahead >= now
            peak[climbing] = ahead[climbing]
            now = ahead
        peak[climbing] = 1.0
        depth += peak - s[low]
    return low[depth > 0], depth[depth > 0]


def row_valleys(blocks: DataFrame, item: str, block: int = 1) -> DataFrame:
    """(item, b, places, depths): the valleys of items that are rows, one row for each block (of `row_blocks`) that has any, in order of place.

    The similarity across a gap is that of the terms of the `block` rows before and after it. With blocks of one row it is 1 or 0, so every change of the term is a valley, and all are equally deep.
    """
    halo = block * (1 + REACH)
    if halo > ROWS_A_BLOCK:
        raise ValueError(f"blocks of {block} rows are too wide")
    first, end = F.col("b") * ROWS_A_BLOCK, (F.col("b") + 1) * ROWS_A_BLOCK
    runs = blocks.select(F.col(item).alias("i"), "b", "z", F.arrays_zip("places", "terms").alias("runs"))
    near = lambda keep: F.filter("runs", lambda r: keep(r.places))
    edge = runs.select(
        "i", "b", "z", near(lambda p: p < first + halo).alias("head"), near(lambda p: p >= end - halo).alias("tail"),
        F.try_element_at(near(lambda p: p < end - halo), F.lit(-1))["terms"].alias("before_tail"), F.try_element_at("runs", F.lit(-1))["terms"].alias("last"),
    )
    # Only these edges of the blocks meet in a window over an item.
    along = W.partitionBy("i").orderBy("b")
    edge = edge.withColumn("entry", F.last("last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))).withColumn("tail_entry", F.coalesce("before_tail", "entry"))
    edge = edge.withColumns({"left": F.lag(F.struct("b", "tail_entry", "tail")).over(along), "right": F.lead(F.struct("b", "head")).over(along), "top": F.max("z").over(W.partitionBy("i"))})
    beside = F.col("left.b") == F.col("b") - 1
    edge = edge.select(
        "i", "b", "top", F.when(beside, F.col("left.tail_entry")).otherwise(F.col("entry")).alias("entry"),
        F.when(beside, F.col("left.tail")).alias("left"), F.when(F.col("right.b") == F.col("b") + 1, F.col("right.head")).alias("right"),
    )
    none = F.array().cast(dict(runs.dtypes)["runs"])
    whole = runs.drop("z").join(broadcast_if_small(durable(edge)), ["i", "b"]).withColumn("all", F.concat(F.coalesce("left", none), "runs", F.coalesce("right", none)))
    whole = whole.select("i", "b", "top", "entry", F.col("all.places").alias("places"), F.col("all.terms").alias("terms"))

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, b, top, entry, places, terms in zip(rows["i"], rows["b"], rows["top"], rows["entry"], rows["places"], rows["terms"]):
                if not len(terms):
                    continue
                start = max(0, b * ROWS_A_BLOCK - halo)
                stop = min((b + 1) * ROWS_A_BLOCK + halo, top + 1)
                # Rows before the first known term have that term.
                codes = np.unique(np.array([terms[0] if entry is None else entry, *terms], dtype=object), return_inverse=True)[1]
                x = np.repeat(codes, np.diff([start, *places, stop]))
                gaps, depths = valleys_of(similarities(x, block), block)
                at = gaps + start + 1
                own = (at >= b * ROWS_A_BLOCK) & (at < (b + 1) * ROWS_A_BLOCK)
                if own.any():
                    out.append((i, b, at[own], depths[own]))
            yield pd.DataFrame(out, columns=["i", "b", "places", "depths"])

    kind = dict(runs.dtypes)["i"]
    return whole.mapInPandas(slide, f"i {kind}, b bigint, places array<bigint>, depths array<double>").withColumnRenamed("i", item)


def cut_rows(items: DataFrame, valleys: DataFrame, item: str) -> DataFrame:
    """(item, first, last): the pieces of every item. `items` has item, n (units), limit, overlap; `valleys` as of `row_valleys`.

    Items of at most `limit` units are one piece, items without units none. A limit under 1 counts as 1, an overlap from the limit on as limit - 1. As where a piece starts depends on the one
    before it, an item's blocks are streamed in order through one task with constant memory: a row for ROWS_A_BLOCK units, with the places of valleys alone; the units never meet.
    """
    size = items.select(F.col(item).alias("i"), "n", F.greatest("limit", F.lit(1)).alias("limit"), F.greatest(F.col("overlap"), F.lit(0)).alias("overlap")).where("n > 0")
    # The item's own row comes first, before its blocks.
    of_item = size.select("i", F.lit(-1).cast("bigint").alias("b"), F.lit(None).cast("array<bigint>").alias("places"), F.lit(None).cast("array<double>").alias("depths"), "n", "limit", "overlap")
    of_block = valleys.select(F.col(item).alias("i"), "b", "places", "depths", *[F.lit(None).cast("bigint").alias(c) for c in ("n", "limit", "overlap")])
    stream = of_item.unionByName(of_block).repartition("i").sortWithinPartitions("i", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cutter = None, None
        for rows in batches:
            out: list[tuple] = []
            for i, b, places, depths, n, limit, overlap in zip(*(rows[c].tolist() for c in ("i", "b", "places", "depths", "n", "limit", "overlap"))):
                if b < 0:
                    if cutter is not None:
                        out += ((now, *piece) for piece in cutter.finish())
                    now, cutter = i, Cutter(int(n), int(limit), int(overlap))
                elif cutter is not None and i == now:
                    for place, depth in zip(places.tolist(), depths.tolist()):
                        out += ((now, *piece) for piece in cutter.push(place, depth))
            yield pd.DataFrame(out, columns=["i", "first", "last"])
        if cutter is not None:
            yield pd.DataFrame([(now, *piece) for piece in cutter.finish()], columns=["i", "first", "last"])

    kind = dict(size.dtypes)["i"]
    return stream.mapInPandas(run, f"i {kind}, first bigint, last bigint").select(F.col("i").alias(item), "first", "last")


_SENTENCE = re.compile(r"[^.!?。！？\r\n]*(?:[.!?。！？]+[ \t]*|\r\n|\n|\r|$)")
_WORD = re.compile(r"\w+")


def text_valleys(text: str, block: int = 4) -> list[tuple[int, float]]:
    """(place, depth) of the gaps between sentences or lines: similarity is the cosine of the words of `block` units before and after, depth the climb to the peaks on both sides. A paragraph break adds 1, so it comes before any other."""
    starts = [m.start() for m in _SENTENCE.finditer(text) if m.end() > m.start()]
    if len(starts) < 2:
        return []
    ends = [*starts[1:], len(text)]
    words = [Counter(w.lower() for w in _WORD.findall(text, a, b)) for a, b in zip(starts, ends)]
    left, right = Counter(), Counter()
    for w in words[:block]:
        right.update(w)
    sims = []
    for gap in range(1, len(words)):  # both blocks slide by one unit
        left.update(words[gap - 1])
        right.subtract(words[gap - 1])
        if gap > block:
            left.subtract(words[gap - 1 - block])
        if gap - 1 + block < len(words):
            right.update(words[gap - 1 + block])
        dot = sum(v * right[k] for k, v in left.items() if v) if left and right else 0
        norm = sum(v * v for v in left.values()) * sum(v * v for v in right.values())
        sims.append(dot / norm**0.5 if norm else 0.0)
        if len(left) > 4096 or len(right) > 4096:
            left, right = +left, +right
    s = np.array(sims)
    before, after = np.empty_like(s), np.empty_like(s)
    peak = s[0]
    for k, v in enumerate(s):  # the peak reached by climbing to the left without going down
        peak = max(v, peak) if k and s[k - 1] >= v else v
        before[k] = peak
    peak = s[-1]
    for k in range(len(s) - 1, -1, -1):
        peak = max(s[k], peak) if k < len(s) - 1 and s[k + 1] >= s[k] else s[k]
        after[k] = peak
    depth = before - s + after - s
    blank = [i for i, (a, b) in enumerate(zip(starts, ends)) if text[a:b].strip() == ""]
    for i in blank:
        if i < len(depth):
            depth[i] += 1
    return [(starts[k + 1], float(d)) for k, d in enumerate(depth)]


def split_text(text: str, limit: int, overlap: int, block: int = 4) -> list[tuple[int, int]]:
    """(first, last) character of each piece of at most `limit` characters."""
    if len(text) <= limit:
        return [(0, len(text) - 1)] if text else []
    cutter, out = Cutter(len(text), limit, overlap), []
    for place, depth in text_valleys(text, block):
        out += cutter.push(place, depth)
    return out + list(cutter.finish())


def split_texts(docs: DataFrame, text: str = "text", limit: int = 2000, overlap: int = 100, block: int = 4) -> DataFrame:
    """The rows of `docs`, once for each piece of their text, with piece (from 0), first and last (characters, inclusive) and piece_text added, the text itself dropped.

    A text within the limit is one piece; an empty or null text has none. Columns of those names in `docs` are kept: the new ones get underscores in front.
    """
    names = [free_name(n, [c for c in docs.columns if c != text]) for n in ("piece", "first", "last", "piece_text")]

    @F.pandas_udf("array<struct<piece:int,first:int,last:int,piece_text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else [{"piece": k, "first": a, "last": b, "piece_text": t[a : b + 1]} for k, (a, b) in enumerate(split_text(t, limit, overlap, block))])

    inner = free_name("s", docs.columns)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(*kept, F.explode(cut(F.col(f"`{text}`"))).alias(inner))
    return rows.select(*kept, *[F.col(inner)[f].alias(n) for f, n in zip(("piece", "first", "last", "piece_text"), names)])
