import itertools
import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions.sequence import deletions, edit_distance, mean_quality_code, osa, quality_ok
from strandweave.operators import assign, correct, counts, demux, merge_pairs, spatial, translate, tree, wells
from strandweave.operators.common import place_within
from strandweave.operators.segment import extract_segments, fixed_layout


def test_layouts():
    x = fixed_layout("^(?P<a>.{3})AC(?P<b>.{2}).(?P<c>.*)$")
    assert x.segments == (("a", 1, 3), ("b", 6, 2), ("c", 9, None)) and x.literals == ((4, "AC"),) and x.width == 8 and x.open_end
    x = fixed_layout("^(?P<a>.{3})(?P<b>CAG){s<=1}.{2}$")
    assert x.segments == (("a", 1, 3), ("b", 4, 3)) and x.near == ((4, "CAG", 1),) and x.width == 8 and not x.open_end
    assert not fixed_layout("^(?P<a>.{3})$").open_end and fixed_layout("^(?P<a>.{3})").open_end
    for p in ("(?P<a>.{3})", "^(?P<a>.{2,3})$", "^(?P<a>CAG){e<=1}$", "^(?P<a>.{3}){s<=1}$", "^(?P<a>CAG){2}$", "^.*(?P<a>.{3})$", "^(?P<a>[AC]{3})$"):
        assert fixed_layout(p) is None


def test_both_ways_of_segmentation_agree(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 20))),) for _ in range(300)] + [(None,), ("",), ("ACAC",)]
    df = spark.createDataFrame(rows, "seq string").withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    patterns = ["^(?P<a>.{4})CA(?P<r>.*)$", "^(?P<b>.{2})(?P<r>.{3})$", "^(?P<a>.{3})G", "^(?P<a>AC)(?P<b>ACGT){s<=2}(?P<r>.*)$", "^(?P<b>GTG){s<=1}(?P<r>.{4})"]
    fast = extract_segments(df, patterns, structure="k").select("seq", "a", "b", "r", "k").collect()
    slow = extract_segments(df, [p.replace("^", "^(?:)") for p in patterns], structure="k").select("seq", "a", "b", "r", "k").collect()
    assert fast == slow and len({r.k for r in fast}) == 6
    assert all(r.a is None or len(r.a.seq) == len(r.a.qual) for r in fast)


def test_fuzzy_segments(spark):
    df = spark.createDataFrame([("AAAACAGAGCTTTT", "I" * 14), ("AAAACAGTTCTTTT", "I" * 14), ("AAAACTTTTCTTTT", "I" * 14), (None, None), ("AAAACAGAGCTTTT", None)], "seq string, qual string")
    got = [r.x and r.x.seq for r in extract_segments(df, ["^(?P<c>.{4})(?P<x>CAGAGC){s<=2}(?P<t>.*)$"]).collect()]
    assert got == ["CAGAGC", "CAGTTC", None, None, "CAGAGC"]


def test_quality_limits_are_included(spark):
    q = lambda *scores: "".join(chr(33 + s) for s in scores)
    rows = [(q(5, 35), True), (q(4, 40), False), (q(20, 20), True), (q(19, 20), False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "q string, want boolean")
    assert all(r.ok == r.want for r in df.withColumn("ok", quality_ok(F.col("q"), 5, 20)).collect())
    codes = spark.createDataFrame([(q(1, 2), 34), (q(2, 3), 36), ("", None), (None, None)], "q string, want int")  # halves go to the even number
    assert all(r.got == r.want for r in codes.withColumn("got", mean_quality_code(F.col("q"))).collect())


def full_osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ACG", max_size=9), st.text("ACG", max_size=9), st.integers(0, 4))
def test_bounded_distance(a, b, most):
    d = full_osa(a, b)
    assert osa(a, b, most) == (d if d <= most else -1)


def test_distance_columns(spark):
    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("ACG") for _ in range(rng.randrange(0, 6))) for _ in "ab") for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2):
        got = df.withColumn("d", edit_distance(F.col("a"), F.col("b"), most)).collect()
        assert all(r.d == (full_osa(r.a, r.b) if full_osa(r.a, r.b) <= most else -1) for r in got)
    one = spark.createDataFrame([("ACG",), ("A",), ("",)], "s string").select(deletions(F.col("s"), 1).alias("v")).collect()
    assert [sorted(r.v) for r in one] == [["AC", "ACG", "AG", "CG"], ["", "A"], [""]]


@pytest.mark.parametrize("distance", [1, 2])
def test_similarity_joins_match_brute_force(spark, monkeypatch, distance):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 8)))
    left, right = spark.createDataFrame([(word(),) for _ in range(150)] + [(None,)], "l string"), spark.createDataFrame([(word(),) for _ in range(150)] + [(None,)], "r string")
    every = {(a.l, b.r, d) for a in left.collect() for b in right.collect() if a.l and b.r and (d := full_osa(a.l, b.r)) <= distance}
    assert {tuple(r) for r in correct.similar(left, right, distance).collect()} == every and every
    monkeypatch.setattr("strandweave.operators.common.broadcast_if_small.__defaults__", (0,))
    assert {tuple(r) for r in correct.similar(left, right, distance).collect()} == every


def test_correction_maps(spark):
    c = spark.createDataFrame([("AAAA", 100), ("CCCC", 90), ("AAAT", 5), ("TTTT", 3), ("CACC", 2), ("GGGG", 1), (None, 50)], "seq string, n bigint")
    got = {r.raw: r.clean for r in correct.majority_map(c, 2).collect()}
    assert got == {"AAAA": "AAAA", "CCCC": "CCCC", "AAAT": "AAAA", "CACC": "CCCC"}
    allow = spark.createDataFrame([("AAAC",), ("CCCC",), ("CCCC",), (None,)], "seq string")
    assert {r.raw: r.clean for r in correct.allowlist_map(c, allow).collect()} == {"AAAA": "AAAC", "CCCC": "CCCC", "AAAT": "AAAC", "CACC": "CCCC"}
    assert {r.raw: r.clean for r in correct.majority_allowlist_map(c, allow, 2).collect()} == {"AAAA": "AAAC", "CCCC": "CCCC", "AAAT": "AAAC", "CACC": "CCCC"}
    assert {r.raw: r.clean for r in correct.allowlist_map(c, allow, least=5).collect()} == {"AAAA": "AAAC", "CCCC": "CCCC", "AAAT": "AAAC"}
    assert {r.raw: r.clean for r in correct.majority_map(c, 9).collect()} == {s: s for s in ("AAAA", "CCCC", "AAAT", "TTTT", "CACC", "GGGG")}  # no minority
    assert correct.majority_map(c.where("false"), 2).count() == 0
    assert correct.chained_map(correct.majority_map(c, 2), spark.createDataFrame([("AAAA", "X")], "raw string, clean string")).count() == 2


def test_ranks_keep_the_place_of_missing_ones(spark):
    c = spark.createDataFrame([("B", 5), ("A", 5), (None, 4), ("C", 1)], "seq string, n bigint")
    assert [(r.seq, r.rank) for r in counts.rank_counts(c).orderBy("rank").collect()] == [("A", 1), ("B", 2), ("C", 4)]


def test_knee_of_a_curve():
    tail = [(5, 500), (4, 600), (3, 900), (2, 2000), (1, 5000)]
    assert counts.knee([(1000 - 4 * i, 1) for i in range(50)] + tail, 10) == 51  # the majority is the fifty before it
    assert counts.knee([(1000, 20), *tail], 10) == 21
    assert counts.knee([(5, 10)]) is None and counts.knee([]) is None


def published_knee(values, sensitivity):
    """The knee by the algorithm as it is published, rank by rank, in exact numbers; but the first rank is no maximum."""
    n, high, low = len(values), max(values), min(values)
    if n < 3 or high == low:
        return None
    y = [Fraction(high - v, high - low) - Fraction(i, n - 1) for i, v in enumerate(values)]
    left, right = [y[max(i - 1, 0)] for i in range(n)], [y[min(i + 1, n - 1)] for i in range(n)]
    maxima = [i for i in range(1, n) if y[i] >= left[i] and y[i] >= right[i]]
    minima = {i for i in range(n) if y[i] <= left[i] and y[i] <= right[i]}
    threshold = at = None
    for i in range(maxima[0] if maxima else n, n - 1):
        if i in maxima:
            threshold, at = y[i] - Fraction(sensitivity) / (n - 1), i
        if i in minima:
            threshold = 0
        if y[i + 1] < threshold:
            return at + 1
    return None


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), min_size=1, max_size=14), st.sampled_from([0.5, 1.0, 3.0, 10.0]))
def test_knee_matches_the_published_algorithm(levels, sensitivity):
    levels = list(dict(levels).items())
    assert counts.knee(levels, sensitivity) == published_knee(sorted((c for c, m in levels for _ in range(m)), reverse=True), sensitivity)


def test_maps_of_groups_are_those_of_each_group(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("ACGT") for _ in range(6)) for _ in range(40)]
    rows = [(g, w, rng.choice([1, 2, 50, 60])) for g in "xy" for w in rng.sample(words, 25)] + [("x", None, 5), (None, words[0], 9)]
    df = spark.createDataFrame(rows, "g string, seq string, n bigint")
    allow = spark.createDataFrame([(w,) for w in words[:8]], "seq string")
    ways = {
        "m2a": lambda c, by: correct.allowlist_map(c, allow, 2, by=by), "auto": lambda c, by: correct.majority_map(c, "auto", 1, by=by),
        "both": lambda c, by: correct.majority_allowlist_map(c, allow, 5, 2, 2, by=by), "own": lambda c, by: correct.custom_map(c, lambda d: d.select("raw", F.reverse("raw").alias("clean")), by),
    }
    for name, way in ways.items():
        got = {tuple(r) for r in way(df, ["g"]).where("g is not null").collect()}
        assert got == {(g, r.raw, r.clean) for g in "xy" for r in way(df.where(F.col("g") == g).drop("g"), []).collect()}, name
    ranks = {(r.g, r.seq): r.rank for r in counts.rank_counts(df, by=["g"]).collect()}
    for g in ("x", "y", None):
        own = sorted(((-n, s is None, s) for h, s, n in rows if h == g))
        assert {k[1]: v for k, v in ranks.items() if k[0] == g} == {s: i + 1 for i, (_, _, s) in enumerate(own) if s is not None}


def test_a_distance_too_great_for_the_terms_is_an_error(spark):
    c = spark.createDataFrame([("AAA", 9), ("AAC", 1)], "seq string, n bigint")
    with pytest.raises(correct.DistanceError):
        correct.majority_map(c, 1, 1)
    assert correct.majority_map(c, 2, 1).count() == 2  # nothing is to be corrected
    assert correct.majority_map(spark.createDataFrame([("AAAA", 9), ("AAAC", 1)], "seq string, n bigint"), 1, 1).count() == 2


def test_plans_have_no_loops_and_no_single_task(spark):
    c = spark.range(1000).select(F.hex(F.col("id") * 7919 + 1_000_000).alias("seq"), F.lit(1).alias("n"))
    plan = correct.similar(c.select(F.col("seq").alias("l")), c.select(F.col("seq").alias("r")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    ranked = counts.rank_counts(c)
    assert "NestedLoop" not in (plan := ranked._jdf.queryExecution().executedPlan().toString()) and plan.count("SinglePartition") <= 1  # the offsets
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 1001)) and [r.seq for r in ranked.orderBy("rank").collect()] == sorted(r.seq for r in c.collect())


def test_tree_of_three_levels_and_samples(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("st"), rng.choice(["p", "q", None]), rng.choice(["a", "b"]), rng.choice(["x", "y", "z"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "sample string, p string, c string, v string")
    ids = tree.value_ids(tree.tree_counts(df, ["v"], ["p", "c"], "sample"), ["v"], ["p", "c"], "sample").collect()
    groups = {}
    for r in ids:
        groups.setdefault((r.sample, r.p, r.c), []).append((-r.n, r.v, r.id))
    assert all([x[2] for x in sorted(g)] == list(range(len(g))) for g in groups.values()) and all(k[1] for k in groups)
    wide = df.withColumn("v", F.concat("v", (F.monotonically_increasing_id() % 17).cast("string")))
    below = lambda: sorted(map(tuple, tree.value_ids(tree.tree_counts(wide, ["v"], ["p"], "sample"), ["v"], ["p"], "sample").collect()))
    small = below()
    sizes = {(r["sample"], r.p): r["count"] for r in tree.tree_counts(wide, ["v"], ["p"], "sample").groupBy("sample", "p").count().collect()}
    monkeypatch.setattr(tree, "LARGE", sorted(sizes.values())[len(sizes) // 2 - 1])  # some paths are numbered by ranges
    assert below() == small and len(set(sizes.values())) > 1
    whole = tree.value_ids(tree.tree_counts(df, ["c", "v"], (), "sample"), ["c", "v"], (), "sample").collect()
    assert [r.id for r in sorted(whole, key=lambda r: (-r.n, r.c, r.v, r.sample))] == list(range(len(whole)))
    assert tree.size_info(tree.tree_counts(df, ["v"], ["p"], "sample"), ["p"], "sample").count() == 2
    roots, alone, parent = tree.classify([(("u",), ("a", "b")), (("w",), ("u",))], [("w",), ("x",)])
    assert roots == [("a", "b")] and alone == [("x",)] and tree.ancestors(("w",), parent) == ["a", "b", "u"]
    with pytest.raises(ValueError):
        tree.ancestors(("a",), {("a",): ("b",), ("b",): ("a",)})


def test_words_and_references(spark):
    words = [r.w for r in spark.range(-1, 9).select(assign.word(F.col("id"), assign.alphabets("RW")).alias("w")).collect()]
    assert words == [None, "AA", "AT", "GA", "GT", None, None, None, None, None]
    random_words = {r.seq for r in assign.pattern_reference(spark, "NNN", 0, "random").collect()}
    assert len(random_words) == 64 and random_words == {r.seq for r in assign.pattern_reference(spark, "NNN", 64, "ordered").collect()}
    assert [r.seq for r in assign.pattern_reference(spark, "NNN", 0).orderBy("id").collect()] == [r.seq for r in assign.pattern_reference(spark, "NNN", 0).orderBy("id").collect()]
    with pytest.raises(ValueError):
        assign.alphabets("NXN")
    assert assign.overflow(spark.range(10), "id", 7).first() == (10, 3)


def test_only_wanted_words_of_a_shuffled_reference(spark):
    every = {r.id: r.seq for r in assign.pattern_reference(spark, "NNN", 0).collect()}
    assert {r.id: r.seq for r in assign.pattern_reference(spark, "NNN", 0, wanted=9).collect()} == {i: every[i] for i in range(9)}
    letters = assign.alphabets("NNN", True)
    order = list(range(64))
    random.Random(0).shuffle(order)
    words = ["".join(w) for w in itertools.product(*letters)]
    assert every == {i: words[k] for i, k in enumerate(order)} and assign.pattern_reference(spark, "NNN", 0, wanted=0).count() == 0


def test_places_within_groups_of_any_size(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, "a", "b", "c", "c", "c", "c"]), rng.choice([1.0, float("nan"), None]), i) for i in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "g string, h double, v int")
    want = {}
    for g, h, v in rows:
        want.setdefault((g, str(h)), []).append(v)
    want = {(k, v): i for k, vs in want.items() for i, v in enumerate(sorted(vs, reverse=True))}
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37", "spark.sql.shuffle.partitions": "12"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {((r.g, str(r.h)), r.v): r.place for r in place_within(df, ["g", "h"], [F.desc("v")], "place").collect()}
        alone = {r.v: r.place for r in place_within(df, [], [F.asc("v")], "place").collect()}
        assert place_within(df.where("false"), ["g"], [F.desc("v")], "place").count() == 0
    finally:
        for k in conf:
            spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want and alone == {v: i for i, v in enumerate(sorted(r[2] for r in rows))}


def test_seq2seq_strict_and_lenient(spark):
    t = spark.createDataFrame([("A", "B", "x"), ("A", "B", "w"), ("A", None, "y")], "s1 string, s2 string, d string")
    rows = spark.createDataFrame([("A", "B"), ("A", None), ("C", "D")], "a string, b string")
    got = translate.seq2seq(rows, t, {"s1": "a", "s2": "b"}, {"d": "dest"})
    assert [r.dest for r in got.collect()] == ["w", None, None]
    with pytest.raises(Exception, match="no entry for C D"):
        translate.seq2seq(rows, t, {"s1": "a", "s2": "b"}, {"d": "dest"}, strict=True).collect()


def test_passed_quality_fits_after_an_indel(spark):
    s, q = translate.passed(F.col("c"), F.col("q"))
    got = spark.createDataFrame([("ACG", "IIH"), ("ACGT", "III")], "c string, q string").select(s.alias("s"), q.alias("q")).collect()
    assert [r.q for r in got] == ["IIH", "IIII"]


def test_demux_and_headers(spark):
    rows = spark.createDataFrame([("@r1", "A", "B", None), ("@r2", None, "B", "t"), ("@r3", "A", "C", "t")], "header string, a string, b string, t string")
    assert [tuple(r) for r in demux.demux_table(rows, ["a", "b"], ["t"]).collect()] == [("A_B", "@r1", "-"), ("A_C", "@r3", "t")]
    assert [r.header for r in demux.annotate(rows, ["a"], ["t"]).collect()] == ["@r3_A"]
    heads = spark.createDataFrame([("@a|b c",), ("@a\tb",), ("@a",)], "h string").select(demux.normal_header(F.col("h")).alias("h")).collect()
    assert {r.h for r in heads} == {"@a"}


def test_pairs_are_merged_back():
    rng = random.Random(5)
    for _ in range(60):
        molecule = "".join(rng.choice("ACGT") for _ in range(150))
        n = rng.randrange(20, 60)
        first, second = molecule[: 75 + n // 2], merge_pairs.reverse_complement(molecule[75 + n // 2 - n :])
        got = merge_pairs.merge_pair(first, "I" * len(first), second, "I" * len(second), 20, 30)
        assert got is not None and got[0] == molecule and len(got[1]) == 150
    assert merge_pairs.merge_pair("A" * 30, "I" * 30, "A" * 30, "I" * 30) is None


def test_nearest_spot_matches_brute_force(spark):
    rng = random.Random(6)
    beads = [(f"b{i}", rng.uniform(-500, 3000), rng.uniform(-500, 500)) for i in range(150)] + [("nan", float("nan"), 1.0), ("null", None, 1.0)]
    spots = [(f"s{i:02d}", rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(40)]
    got = {r.bead: r.spot for r in spatial.nearest_spot(spark.createDataFrame(beads, "bead string, x double, y double"), spark.createDataFrame(spots, "spot string, x double, y double"), 30.0).collect()}
    assert got == {b: min(((x - u) ** 2 + (y - v) ** 2, s) for s, u, v in spots)[1] for b, x, y in beads if x is not None and x == x}
    spot_table = spark.createDataFrame(spots, "spot string, x double, y double")
    least = min(((u - w) ** 2 + (v - z) ** 2) ** 0.5 for s, u, v in spots for t, w, z in spots if s < t)
    assert abs(spatial.least_distance(spot_table, 30.0) - least) < 1e-9 and spatial.least_distance(spot_table.limit(1), 30.0) is None
    grid = [(f"g{i}{j}", i * 100.0 + 50 * (j % 2), j * 86.0) for i in range(6) for j in range(6)]
    grid_table = spark.createDataFrame([*grid, ("twin", 0.0, 0.0)], "spot string, x double, y double")
    all_d = {math.dist(a[1:], b[1:]) for a in grid for b in grid if a != b}
    ring = max(d for d in all_d if d < 1.5 * min(all_d))
    assert abs(spatial.greatest_below(grid_table, 1.5 * min(all_d)) - ring) < 1e-9
    assert abs(spatial.expansion_rate(spot_table, grid_table, 30.0, 100.0) - math.ceil(math.ceil(ring) * 2 / 3**0.5) / least) < 1e-9
    assert spatial.expansion_rate(spot_table.limit(1), grid_table, 30.0, 100.0) is None
    far = [(f"f{i}", rng.uniform(-1e5, 1e5), rng.uniform(-1e5, 1e5)) for i in range(60)]
    for cell in (3.0, 30.0, 1e6):
        reached = spatial.nearest_spot(spark.createDataFrame(beads + far, "bead string, x double, y double"), spot_table, cell)
        assert {r.bead: r.spot for r in reached.collect()} == {b: min(((x - u) ** 2 + (y - v) ** 2, s) for s, u, v in spots)[1] for b, x, y in beads + far if x is not None and x == x}
        own = spatial.nearest_spot(spot_table.withColumnRenamed("spot", "bead"), spot_table, cell, others=True).collect()
        assert {r.bead: r.spot for r in own} == {s: min(((u - w) ** 2 + (v - z) ** 2, t) for t, w, z in spots if t != s)[1] for s, u, v in spots}
    plan = reached._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = spark.createDataFrame([], "spot string, x double, y double")
    assert spatial.nearest_spot(spark.createDataFrame(beads, "bead string, x double, y double"), none, 30.0).count() == 0


def test_wells(spark):
    names = spark.createDataFrame([(1, 1, "TL"), (1, 1, "BR"), (8, 12, "BR"), (1, 1, "??")], "r int, c int, q string")
    got = names.select(wells.well_384(F.col("r"), F.col("c"), F.col("q"))[2].alias("w")).collect()
    assert [r.w for r in got] == ["A01", "B02", "P24", None]
    profile = wells.dominance(spark.createDataFrame([("w", "a"), ("w", "a"), ("w", "b"), ("v", "b"), ("v", "a"), ("v", None)], "well string, bc string"), ["well"], "bc", 0.5).orderBy("well").collect()
    assert [(r.top, r.top_count, r.passed) for r in profile] == [("a", 1, False), ("a", 2, True)]
    assert [r.passed for r in wells.dominance(spark.createDataFrame([("w", "a"), ("v", "b")], "well string, bc string"), ["well"], "bc", 0.5, "a").orderBy("well").collect()] == [False, True]
    h = spark.createDataFrame([("@x ACGT:12 z",), ("@x",), ("@x :1",)], "h string").select(wells.index_from_header(F.col("h"))[0].alias("s"), wells.index_from_header(F.col("h"))[1].alias("q")).collect()
    assert [tuple(r) for r in h] == [("ACGT", "????"), (None, None), (None, None)]
