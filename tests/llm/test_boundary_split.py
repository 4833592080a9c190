import random
from collections import Counter

import pytest

from strandweave.llm.boundary_split import REACH, Cutter, cut_rows, row_blocks, row_counts, row_valleys, split_text, split_texts
from strandweave.llm.queries import lane_tile, same_path, whole_number
from pyspark.sql import functions as F


def greedy(n, limit, overlap, marks):
    """The rule as it is stated."""
    out, s = [], 0
    while True:
        if n - s <= limit:
            return out + [(s, n - 1)]
        inside = [b for b in marks if s + overlap < b <= s + limit]
        end = max(inside) if inside else s + limit
        out.append((s, end - 1))
        s = end - overlap


def test_cutter_matches_the_stated_rule():
    rng = random.Random(5)
    for _ in range(300):
        n, limit = rng.randrange(1, 200), rng.randrange(3, 40)
        overlap = rng.randrange(0, (limit - 1) // 2 + 1)
        marks = sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(0, 30)))) if n > 1 else []
        c, got = Cutter(n, limit, overlap), []
        for b in marks:
            got += c.push(b, 1.0)
        assert got + list(c.finish()) == greedy(n, limit, overlap, marks)


def test_deepest_valley_wins():
    c = Cutter(30, 10, 0)
    got = [p for b, d in ((4, 0.9), (8, 0.2), (9, 0.2)) for p in c.push(b, d)] + list(c.finish())
    assert got[0] == (0, 3)  # the deepest, though later ones are in the window
    assert got[1] == (4, 8)  # of equals the last


def test_rows_over_blocks_with_gaps_in_terms_and_repeats(spark, monkeypatch):
    from strandweave.llm import boundary_split

    monkeypatch.setattr(boundary_split, "ROWS_A_BLOCK", 16)
    rng = random.Random(6)
    rows, want = [], {}
    for item, n in ((1, 100), (2, 37), (3, 5), (4, 64)):
        tile, tiles = 0, []
        for i in range(n):
            tile += rng.random() < 0.15
            tiles.append(tile % 3)
            rows.append((item, i, None if i and rng.random() < 0.4 else f"t{tile % 3}"))
        known = {}
        for r in rows:
            if r[0] == item and r[2] is not None:
                known[r[1]] = r[2]
        now, marks = known[0], []
        for i in range(1, n):
            if known.get(i, now) != now:
                marks.append(i)
                now = known[i]
        want[item] = set(greedy(n, 20, 3, marks))
    rows += rows[:30] + [(None, 1, "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "item int, place bigint, term string")
    items = spark.createDataFrame([(1, 100, 20, 3), (2, 37, 20, 3), (3, 5, 20, 3), (4, 64, 20, 3), (5, 0, 20, 3), (6, 50, 20, 3)], "item int, n bigint, limit bigint, overlap bigint")
    got: dict = {}
    blocks = row_blocks(df, "item", "place", "term")
    assert {tuple(r) for r in row_counts(blocks, "item").collect()} == {(1, 100), (2, 37), (3, 5), (4, 64)}
    for i, a, z in cut_rows(items, row_valleys(blocks, "item"), "item").collect():
        got.setdefault(i, set()).add((a, z))
    assert got == want | {6: set(greedy(50, 20, 3, []))}
    nothing = spark.createDataFrame([], "item int, place bigint, term string")
    assert cut_rows(items.where("false"), row_valleys(row_blocks(nothing, "item", "place", "term"), "item"), "item").count() == 0


def brute_valleys(terms, w):
    """Similarity and depth as they are stated, unit by unit; the first units without a term have the first known one."""
    known, now = [], next((t for t in terms if t is not None), None)
    for t in terms:
        now = now if t is None else t
        known.append(now)
    s = {}
    for g in range(1, len(known)):
        a, b = Counter(known[max(0, g - w) : g]), Counter(known[g : g + w])
        s[g] = sum(n * b[t] for t, n in a.items()) / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
    at = lambda g: s.get(g, 1.0)
    out = {}
    for g, v in s.items():
        if v < 1 and v <= at(g - 1) and v <= at(g + 1):
            peaks = []
            for way in (-1, 1):
                peak = v
                for k in range(1, REACH * w + 1):
                    if at(g + way * k) < at(g + way * (k - 1)):
                        break
                    peak = at(g + way * k)
                else:
                    peak = 1.0
                peaks.append(peak)
            if sum(peaks) > 2 * v:
                out[g] = sum(peaks) - 2 * v
    return out


@pytest.mark.parametrize("width", [1, 2, 3])
def test_valleys_of_wider_blocks_match_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr("strandweave.llm.boundary_split.ROWS_A_BLOCK", 16)
    rng = random.Random(width)
    items = {}
    for item, n in ((1, 150), (2, 90), (3, 16), (4, 1), (5, 70), (6, 33)):
        topic, terms = 0, []
        for _ in range(n):
            topic += rng.random() < 0.1
            terms.append(None if rng.random() < 0.2 else f"t{topic * 2 % 7 + rng.randrange(2)}" if item != 6 else rng.choice("abcdefghijk"))
        items[item] = terms
    items[5][10:60] = [None] * 50  # whole blocks without a term
    rows = [(i, p, t) for i, terms in items.items() for p, t in enumerate(terms)]
    rng.shuffle(rows)
    valleys = row_valleys(row_blocks(spark.createDataFrame(rows, "item int, place bigint, term string"), "item", "place", "term"), "item", width).collect()
    got = {(r.item, p): round(d, 9) for r in valleys for p, d in zip(r.places, r.depths)}
    want = {(i, g): round(d, 9) for i, terms in items.items() for g, d in brute_valleys(terms, width).items()}
    assert got == want and len(want) > 20
    assert width > 1 or set(want.values()) == {2.0}


def test_texts_are_covered_within_the_limit():
    rng = random.Random(7)
    words = ["read", "cell", "bead", "puck", "tile", "lane", "日本", "é"]
    for _ in range(40):
        text = "".join(rng.choice(words) + rng.choice([" ", ". ", "\n", "\r\n", "\n\n", ""]) for _ in range(rng.randrange(0, 300)))
        pieces = split_text(text, 120, 10)
        assert all(z - a < 120 for a, z in pieces)
        if text:
            assert pieces[0][0] == 0 and pieces[-1][1] == len(text) - 1
            assert all(b[0] == a[1] + 1 - 10 for a, b in zip(pieces, pieces[1:]))


def test_split_texts_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "short", 7), (2, "", 8), (3, None, 9), (4, "A sentence here. " * 400, 1), (4, "A sentence here. " * 400, 1)], "doc_id int, text string, piece int")
    got = split_texts(df, limit=500, overlap=20)
    assert got.columns == ["doc_id", "piece", "_piece", "first", "last", "piece_text"]
    rows = got.collect()
    assert {r.doc_id for r in rows} == {1, 4} and [r.piece for r in rows if r.doc_id == 1] == [7]
    assert all(len(r.piece_text) == r.last - r.first + 1 <= 500 for r in rows)
    assert split_texts(df.where("false")).count() == 0


def test_parsing_of_numbers_paths_and_headers(spark):
    numbers = {"2000": 2000, " 50 ": 50, "\t90": 90, "1_000": 1000, "1,200": 1200, "1E2": 100, "1.2e3": 1200, "0120": 120, "2 000 000": 2000000, "1.200.000": 1200000, "2k": 2000, "4M": 4000000, "": None, "many": None, None: None}
    rows = spark.createDataFrame([(k, v) for k, v in numbers.items()], "t string, want bigint").withColumn("got", whole_number(F.col("t"))).collect()
    assert all(r.got == r.want for r in rows), rows
    paths = {"/a/b/c.gz": "/a/b/c.gz", "/a//b/./c.gz": "/a/b/c.gz", "/a/x/../b/c.gz": "/a/b/c.gz", "/a/x/y/../../b/c.gz": "/a/b/c.gz", "a/./b": "a/b", "/../a": "/a"}
    rows = spark.createDataFrame(list(paths.items()), "t string, want string").withColumn("got", same_path(F.col("t"))).collect()
    assert all(r.got == r.want for r in rows), rows
    headers = {"@H:3:FC:2:1103:99:14 1:N:0:AC": "2:1103", "@HWX-033:2:1101:11:20#0/1": "2:1101", "@Z.0 M:3:FC:2:1102:11:29 length=34": "2:1102", "@M:1:F:2:1102:1:3|umi=NN": "2:1102", "@M:1:F:2:1102:1:3\t1:Y:18:7": "2:1102", "@x": None, "": None, None: None}
    rows = spark.createDataFrame(list(headers.items()), "t string, want string").withColumn("got", lane_tile(F.col("t"))).collect()
    assert all(r.got == r.want for r in rows), rows
