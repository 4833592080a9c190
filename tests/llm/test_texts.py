import random
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandweave.llm import encoding
from strandweave.llm.encoding import OWN, SHARED, Stitcher, Uses, chunk_ends, encode_texts, encoder
from strandweave.llm.lookalikes import ALIKE, canonical, canonical_column, look_classes, same_looking_pairs
from strandweave.llm.packing import balance, pack, pack_items


def random_text(rng, n):
    bits = ["cell ", "  ", "\n", "\r\n", "\t\t", "don't", " 12345", "日本語。\n", "é", "ACGT" * 9, "!!??", "　", "\xa0 ", "🧬", " x", "<|endoftext|>", "naïve ", "    \n"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_joins_are_repaired_exactly_wherever_texts_are_cut():
    enc, rng = encoder(), random.Random(1)
    stitcher = Stitcher(enc)
    for _ in range(300):
        data = random_text(rng, rng.randrange(1, 80)).encode()
        ends = sorted({e for e in (rng.randrange(1, len(data) + 1) for _ in range(rng.randrange(0, 9))) if e == len(data) or data[e] & 0xC0 != 0x80} | {len(data)})
        for a, z in zip([0, *ends], ends):
            stitcher.add(enc.encode_ordinary(data[a:z].decode()))
        assert stitcher.finish() == enc.encode_ordinary(data.decode())


def test_chunks_follow_the_content():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh \n") for _ in range(40_000)).encode()
    a, b = shared, b"another beginning, of another length" * 70 + shared
    cut = lambda d: {d[x:y] for x, y in zip([0, *chunk_ends(d)], chunk_ends(d))}
    assert len(cut(a) & cut(b)) > len(cut(a)) * 0.7
    for text in ("", "é" * 30_000, "a" * 100_000, "日" * 20_000):
        d = text.encode()
        ends = chunk_ends(d)
        assert (ends[-1] if d else 0) == (len(d) if d else 0) and "".join(d[x:y].decode() for x, y in zip([0, *ends], ends)) == text


def test_ids_equal_those_of_whole_texts(spark):
    rng = random.Random(3)
    boiler = random_text(rng, 900)
    texts = [random_text(rng, rng.randrange(0, 1500)) for _ in range(40)] + [boiler + random_text(rng, 50) for _ in range(20)] + ["", None, " ", "x" * 70_000, " " * 40_000, "\n" * 30_000, "日" * 9_000, boiler, boiler]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    enc = encoder()
    want = {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in encode_texts(df).collect()} == want
    assert encode_texts(df.where("false")).count() == 0
    # rows of one key, or of none, keep apart
    same = df.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.lit(7))).unionByName(df.where("doc_id < 3").withColumn("doc_id", F.lit(7)))
    rows = sorted((r.doc_id or 0, tuple(r.ids)) for r in encode_texts(same).collect())
    assert rows == sorted([(7 if i % 3 else 0, tuple(v)) for i, v in want.items()] + [(7, tuple(want[i])) for i in range(3)])


def test_chunks_of_very_many_texts_are_spread():
    uses = Uses(5)
    got = [uses.part(b"hot") for _ in range(SHARED + 2 * OWN + 1)]
    assert got[0] == (0, True) and got[1 : SHARED] == [(0, False)] * (SHARED - 1) and got[SHARED] == (6 * 2**32, True) and got[SHARED + 1] == (6 * 2**32, False)
    assert sum(first for _, first in got) == 4 and max(Counter(part for part, _ in got).values()) == OWN and uses.part(b"other") == (0, True)


def test_ids_of_a_text_in_very_many_parts(spark):
    text = "same words in every text. " * 20
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit(text)).otherwise(F.concat(F.lit(text * 4), F.col("id").cast("string"))).alias("text"))
    rows = encode_texts(df).collect()
    assert len(rows) == 9000 == len({r.doc_id for r in rows}) and all(tuple(r.ids) == tuple(encoder().encode_ordinary(text if r.doc_id % 3 < 2 else text * 4 + str(r.doc_id))) for r in rows)


def test_both_libraries_agree_on_the_ids():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(4)
    for _ in range(50):
        text = random_text(rng, 60)
        assert t.encode(text, add_special_tokens=False).ids == encoder().encode_ordinary(text)


def test_packing_fits_and_wastes_little(spark):
    rng = random.Random(5)
    sizes = [rng.choice([rng.randrange(1, 400), rng.randrange(1, 2049)]) for _ in range(3000)]
    containers, starts = pack(sizes, 2048)
    spans = {}
    for n, c, s in zip(sizes, containers, starts):
        assert s + n <= 2048
        spans.setdefault(c, []).append((s, s + n))
    for v in spans.values():
        assert all(a[1] <= b[0] for a, b in zip(sorted(v), sorted(v)[1:]))
    assert len(spans) <= -(-sum(sizes) // 2048) * 1.01 + 1


def test_packed_items_are_whole_or_cut_at_capacity(spark):
    rows = [(1, 5000), (2, 2048), (3, 0), (4, None), (5, 17), (5, 17), (6, -3)]
    got = pack_items(spark.createDataFrame(rows, "k int, n int").withColumn("size", F.lit("clash")), "k", "n").collect()
    assert sorted((r.k, r.piece, r["first"], r.size) for r in got) == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 904), (2, 0, 0, 2048), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 17), (5, 0, 0, 17), (6, 0, 0, 0)]
    assert len({r.container for r in got}) == 4
    assert pack_items(spark.createDataFrame([], "k int, n int"), "k", "n").count() == 0
    u = balance(spark.createDataFrame(got), 2048).first()
    assert u.containers == 4 == u.least_containers and u["units"] == 5000 + 2048 + 34 and u["items"] == 9 and abs(u.unused_share - (1 - 7082 / 8192)) < 1e-9
    assert u.greatest_cost == 4096.0 and u.least_cost <= u.mean_cost <= u.greatest_cost


def test_costs_are_balanced():
    """The spread of costs against that of a packing by room alone (descending items into the first container with room)."""
    rng = random.Random(8)
    sizes = [rng.choice([rng.randrange(1, 60), rng.randrange(100, 2049)]) for _ in range(4000)]

    def spread(containers):
        cost = {}
        for n, c in zip(sizes, containers):
            cost[c] = cost.get(c, 0) + n + n * n / 2048
        mean = sum(cost.values()) / len(cost)
        return (sum((v - mean) ** 2 for v in cost.values()) / len(cost)) ** 0.5

    rooms, first = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        first[i] = next((c for c, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
        if first[i] == len(rooms):
            rooms.append(2048)
        rooms[first[i]] -= sizes[i]
    containers, _ = pack(sizes, 2048)
    assert spread(containers) < spread(first) and len(set(containers)) <= len(rooms) + 1


@pytest.mark.parametrize("sizes", [[2048] * 5 + [1] * 3, [1] * 5000, [1025] * 9, [0] * 4, [2048, 1024, 1024, 512, 512, 512, 512], [7, 2041, 9, 2039]])
def test_packings_against_the_least_number(spark, sizes):
    rows = pack_items(spark.createDataFrame(list(enumerate(sizes)), "k int, n int"), "k", "n").collect()
    spans = {}
    for r in rows:
        assert r.size == sizes[r.k] and r.start + r.size <= 2048
        spans.setdefault(r.container, []).append((r.start, r.start + r.size))
    assert all(a[1] <= b[0] for v in spans.values() for a, b in zip(sorted(v), sorted(v)[1:]))
    least = 9 if sizes[0] == 1025 else max(1, -(-sum(sizes) // 2048))
    assert sorted(r.k for r in rows) == list(range(len(sizes))) and len(spans) <= max(least, 1) + (sum(sizes) == 0) * 3


SAME = [("Ａ１", "A1"), ("é", "é"), ("ё", "ë"), ("a­b", "ab"), ("a​b﻿", "ab"), ("a b", "a b"), ("　x", " x"), ("АС", "AC"), ("µm", "μm"), ("Å", "Å"), ("Ω", "Ω"), ("e​́", "é"), ("ｶﾞ", "ガ"), ("á̧", "á̧"), ("각", "각"), ("Ά", "Á"), ("x️", "x")]
DIFFERENT = [("a", "A"), ("e", "é"), ("x²", "x2"), ("O", "0"), ("l", "1"), ("a b", "a  b"), ("a\n", "a"), ("a\r\nb", "a\nb"), ("a\tb", "a b"), ("ß", "ss"), ("日", "本"), ("⁷", "7"), ("I", "l")]


def test_what_looks_the_same_and_what_does_not():
    for a, b in SAME:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in DIFFERENT:
        assert canonical(a) != canonical(b), (a, b)


def test_twins_of_one_letter_are_found():
    same = [("\u2f00", "一"), ("\u2fd5", "龠"), ("\u2e9f", "母"), ("\u3038", "十"), ("\u2135", "א"), ("\u03c1\u03b1\u03b9\u03c5", "paiu"), ("\u03ac", "á"), ("\u03f4", "Θ")]
    same += [("\U0001d400\U0001d41a", "Aa"), ("\U0001d6fc", "a"), ("\U0001d6b9", "Θ"), ("\u211d", "R"), ("\u2113", "l"), ("\U0001d41e\u0301", "é"), ("x\U0001d670", "xA")]
    for a, b in same:
        assert canonical(a) == canonical(b) == b, (a, b)
    same += [("\u2011", "\u2010"), ("Ⅱ", "II"), ("ⅷ", "viii"), ("ﬁ", "fi"), ("ﬁ\u0301", "fí"), ("ﬄx", "fflx"), ("ǆ", "dž"), ("ꓐꓳꓫ", "BOX"), ("Ⲟⲟ", "Oo")]
    for a, b in same[-9:]:
        assert canonical(a) == canonical(b) == b, (a, b)
    for a, b in [("№", "No"), ("℡", "TEL"), ("\U0001d7ce", "0"), ("\U0001d7d8", "0"), ("\u3131", "\u1100"), ("\u3131\u314f", "가"), ("\u03d5", "φ"), ("\u017f", "s"), ("\u2f00", "二"), ("\U0001d400", "a"), ("\u2207", "\U0001d6c1")]:
        assert canonical(a) != canonical(b), (a, b)
    assert not any(ALIKE.get(x, x) != x for x in ALIKE.values())
    for cp in [*range(0x80, 0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)]:
        assert canonical(once := canonical(f"e{chr(cp)}\u0301")) == once, hex(cp)


def test_segments_give_what_the_whole_text_would():
    rng = random.Random(6)
    pool = ["a", "e", "E", " ", "\n", "́", "̈", "̧", "​", "­", "é", "е", "и", "й", " ", "ａ", "ﾞ", "ｶ", "ᄀ", "ᅡ", "ᆨ", "가", "K", "µ", "日", "²", "ṩ", "אּ", "क़", "שׁ", "\U0001f9ec", "̈́"]
    from strandweave.llm.lookalikes import _tables

    fold = _tables()[0]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(fold)).translate(fold))
        assert canonical(text) == whole, [hex(ord(c)) for c in text]
        assert canonical(whole) == whole


def test_pairs_match_brute_force(spark):
    texts = [a for pair in SAME + DIFFERENT for a in pair] + ["A1", "A1", "Ａ" + "1", None, "", "", "​", "Ａ１"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("form", F.lit(1)).withColumn("id", F.lit(1))
    got = [tuple(r) for r in same_looking_pairs(df).collect()]
    want = {(i, j) for (i, a), (j, b) in combinations(list(enumerate(texts)), 2) if a is not None and b is not None and a != b and canonical(a) == canonical(b)}
    assert set(got) == want and len(got) == len(want)
    assert same_looking_pairs(df.where("false")).count() == 0
    rows = look_classes(df).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r.form, set()).add(r.doc_id)
    looks = {}
    for i, t in enumerate(texts):
        if t is not None:
            looks.setdefault(canonical(t), []).append(i)
    assert len(rows) == len({r.doc_id for r in rows}) and {frozenset(v) for v in classes.values()} == {frozenset(v) for v in looks.values() if len({texts[i] for i in v}) > 1}
    assert [r.c for r in df.select("doc_id", canonical_column(F.col("text")).alias("c")).orderBy("doc_id").collect()] == [None if t is None else canonical(t) for t in texts]


def test_sql_of_the_canonical_form():
    duckdb = pytest.importorskip("duckdb")
    from strandweave.llm.queries import _look

    rng = random.Random(9)
    pool = ["a", "e", "'", " ", "\n", "́", "̈", "​", "\xad", "\xe9", "е", "и", "й", "　", "＇", "ａ", "ℝ", "\U0001d400", "Ⅰ", "Ⅱ", "ﬁ", "‑", "ｶ", "ﾞ", "가", "ᆨ", "אָ", "क़", "ꓐ", "Ⲟ", "²"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(1500)] + [a for pair in SAME + DIFFERENT for a in pair]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = dict(con.execute(f"SELECT i, {_look('text')} FROM t").fetchall())
    assert [t for i, t in enumerate(texts) if got[i] != canonical(t)] == []
