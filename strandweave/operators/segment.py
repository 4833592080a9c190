"""Segmentation: reads are projected to named segments by (optionally fuzzy) patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"\(\?P<(\w+)>([^()]*)\)(?:\{s<=(\d+)\})?|([^(){}]*(?:\{\d+\}[^(){}]*)*)")
_ATOM = re.compile(r"\.\{(\d+)\}|\.\*|\.|[A-Z]+")


@dataclass(frozen=True)
class Layout:
    """A pattern of fixed widths: segments as (name, start from 1, length or None for the rest)."""

    segments: tuple[tuple[str, int, int | None], ...]
    literals: tuple[tuple[int, str], ...]  # (start, bases)
    width: int
    open_end: bool  # longer reads match too
    near: tuple[tuple[int, str, int], ...] = ()  # (start, bases, most that may differ)

    def matches(self, seq: Column) -> Column:
        ok = F.length(seq) >= self.width if self.open_end else F.length(seq) == self.width
        for start, bases in self.literals:
            ok = ok & (F.substring(seq, start, len(bases)) == bases)
        for start, bases, most in self.near:
            ok = ok & (sum((F.substring(seq, start + i, 1) != b).cast("int") for i, b in enumerate(bases)) <= most)
        return ok

    def slice(self, name: str, text: Column) -> Column:
        _, start, length = next(s for s in self.segments if s[0] == name)
        return F.substring(text, start, length if length is not None else 2**31 - 1)


def fixed_layout(pattern: str) -> Layout | None:
    """The layout of a pattern that is anchored at the start and made of `.{n}`, `.`, bases, groups of bases with a number of substitutions, and at most one `.*` at its end; else None."""
    if not pattern.startswith("^"):
        return None
    body, end = (pattern[1:-1], True) if pattern.endswith("$") else (pattern[1:], False)
    segments, literals, near, at, rest = [], [], [], 1, False
    pos = 0
    for m in _PART.finditer(body):
        if m.end() == m.start():
            continue
        if m.start() != pos or rest:
            return None
        pos = m.end()
        inner, start = m[2] if m[1] else m[4], at
        if m[3] is not None:
            if not re.fullmatch("[A-Z]+", inner):
                return None
            near.append((at, inner, int(m[3])))
            at += len(inner)
            segments.append((m[1], start, at - start))
            continue
        k = 0
        for a in _ATOM.finditer(inner):
            if a.start() != k or rest:
                return None
            k = a.end()
            if a[1]:
                at += int(a[1])
            elif a[0] == ".*":
                rest = True
            elif a[0] == ".":
                at += 1
            else:
                literals.append((at, a[0]))
                at += len(a[0])
        if k != len(inner):
            return None
        if m[1]:
            segments.append((m[1], start, None if rest else at - start))
    if pos != len(body):
        return None
    return Layout(tuple(segments), tuple(literals), at - 1, rest or not end, tuple(near))


def _names(patterns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(n for p in patterns for n in re.findall(r"\?P<(\w+)>", p)))


def extract_segments(reads: DataFrame, patterns: Sequence[str], seq: str = "seq", qual: str = "qual", wanted: Sequence[str] | None = None, structure: str | None = None) -> DataFrame:
    """The reads with a column struct<seq, qual> for each named group of the patterns, the first that matches.

    A group that does not belong to the matched pattern is null, as are all groups of a read that matches none, or is null; so is an empty group. The quality is the
    slice at the group's place (null if there is no quality). `wanted` limits the groups that are made; `structure` names a column for the number (from 1) of the pattern
    that matched, null for none. Patterns of fixed widths stay in generated code; others go to Python in Arrow batches.
    """
    names = [n for n in _names(patterns) if wanted is None or n in wanted]
    layouts = [fixed_layout(p) for p in patterns]
    if all(x is not None for x in layouts):
        return _by_layout(reads, layouts, names, seq, qual, structure)
    kind = "".join(f", s{i}: string, q{i}: string" for i in range(len(names)))
    sources = list(patterns)

    @F.pandas_udf(f"struct<k: int{kind}>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        compiled = [(k, p, [(i, p.groupindex[n]) for i, n in enumerate(names) if n in p.groupindex]) for k, p in enumerate(map(regex.compile, sources), 1)]
        for seqs, quals in batches:
            size = len(seqs)
            which: list[int | None] = [None] * size
            out: list[list[str | None]] = [[None] * size for _ in range(2 * len(names))]  # flat columns: structs of structs would be made row by row
            for row, (s, q) in enumerate(zip(seqs.tolist(), quals.tolist())):
                if s is None:
                    continue
                for k, p, groups in compiled:
                    m = p.search(s)
                    if m is not None:
                        which[row] = k
                        for i, g in groups:
                            a, z = m.span(g)
                            if z > a >= 0:
                                out[2 * i][row] = s[a:z]
                                out[2 * i + 1][row] = q[a:z] if q is not None else None
                        break
            frame = {"k": pd.array(which, dtype="Int32")}
            for i in range(len(names)):
                frame[f"s{i}"], frame[f"q{i}"] = out[2 * i], out[2 * i + 1]
            yield pd.DataFrame(frame)

    hit = "_hit"
    while hit in reads.columns:
        hit = "_" + hit
    found = reads.withColumn(hit, search(F.col(seq), F.col(qual)))
    cols = {n: F.when(F.col(hit)[f"s{i}"].isNotNull(), F.struct(F.col(hit)[f"s{i}"].alias("seq"), F.col(hit)[f"q{i}"].alias("qual"))) for i, n in enumerate(names)}
    return found.withColumns(cols | ({structure: F.col(hit)["k"]} if structure else {})).drop(hit)


def _by_layout(reads: DataFrame, layouts: Sequence[Layout], names: Sequence[str], seq: str, qual: str, structure: str | None) -> DataFrame:
    s, q = F.col(seq), F.col(qual)
    cols = {}
    for n in names:
        value = None
        for k, x in enumerate(layouts):
            part = F.lit(None).cast("struct<seq:string,qual:string>")
            if any(name == n for name, _, _ in x.segments):
                piece = x.slice(n, s)
                part = F.when(piece != "", F.struct(piece.alias("seq"), x.slice(n, q).alias("qual")))
            value = F.when(x.matches(s), part) if value is None else value.when(x.matches(s), part)
        cols[n] = value
    if structure:
        which = None
        for k, x in enumerate(layouts, 1):
            which = F.when(x.matches(s), k) if which is None else which.when(x.matches(s), k)
        cols[structure] = which
    return reads.withColumns(cols)
