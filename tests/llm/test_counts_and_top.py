import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandweave.llm import term_counts, top_items
from strandweave.llm.queries import p4_ngrams
from strandweave.llm.term_counts import ngram_counts, value_counts
from strandweave.llm.top_items import most_frequent


def test_value_counts_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["r1", "r2", None]), rng.choice(["s", "t"]), rng.choice(["A", "C", "G", None]), rng.choice([0, 1, 2, None]), rng.choice([1, 5, None]), "x") for _ in range(800)]
    rows += rows[:50]
    got = {(r.run, r.segment, r.seq): (r.cf, r.df) for r in value_counts(spark.createDataFrame(rows, "run string, segment string, seq string, chunk int, n int, cf string"), ["run", "segment"], "seq", "chunk", "n").collect()}
    cf, df = Counter(), defaultdict(set)
    for run, segment, seq, chunk, n, _ in rows:
        if seq is not None:
            cf[run, segment, seq] += n or 0
            df[run, segment, seq].add(chunk)
    assert got == {k: (cf[k], len(df[k])) for k in df}


def test_heavy_terms_are_spread_and_added_up(spark, monkeypatch):
    monkeypatch.setattr("strandweave.operators.heavy_keys.MOST_HEAVY", 4)
    rows = [("r", "hot" if i % 2 else f"t{i % 50}", i % 97, 1) for i in range(6000)]
    got = {r.seq: (r.cf, r.df) for r in value_counts(spark.createDataFrame(rows, "run string, seq string, chunk int, n int").repartition(8), ["run"], "seq", "chunk", "n").collect()}
    cf, df = Counter(), defaultdict(set)
    for _, seq, chunk, n in rows:
        cf[seq] += n
        df[seq].add(chunk)
    assert got == {k: (cf[k], len(df[k])) for k in df}


def brute_ngrams(records, longest, least):
    cf, df = Counter(), defaultdict(set)
    for i, r in enumerate(records):
        t = [w for w in r or [] if w is not None]
        for n in range(1, longest + 1):
            for k in range(len(t) - n + 1):
                cf[tuple(t[k : k + n])] += 1
                df[tuple(t[k : k + n])].add(i)
    return {k: (cf[k], len(df[k])) for k in cf if cf[k] >= least}


def test_ngrams_match_brute_force(spark):
    rng = random.Random(4)
    records = [[rng.choice("abcde") for _ in range(rng.randrange(0, 30))] for _ in range(120)] + [None, [], [None, "a", None], ["a"] * 40, ["a"] * 40]
    df = spark.createDataFrame([(r, 1) for r in records], "terms array<string>, n int")
    for least in (1, 4):
        got = {tuple(r.ngram): (r.cf, r.df) for r in ngram_counts(df, "terms", 3, least).collect()}
        assert got == brute_ngrams(records, 3, least)
    assert ngram_counts(df.where("false"), "terms").count() == 0


def test_heavy_first_terms_of_ngrams(spark):
    rng = random.Random(8)
    records = [["the", rng.choice("abcdefgh")] * 6 for _ in range(1500)]
    got = {tuple(r.ngram): (r.cf, r.df) for r in ngram_counts(spark.createDataFrame([(r,) for r in records], "terms array<string>").repartition(4), "terms", 3).collect()}
    assert got == brute_ngrams(records, 3, 1)


def test_every_ngram_has_a_row_and_rare_ones_are_marked(spark, tmp_path):
    rng = random.Random(10)
    texts = [f"of u{i} " + "of four " * (i % 10 == 0) + " ".join(rng.choice("abcdefgh") for _ in range(6)) for i in range(40)] + [None, "", " \t\n"]
    for name, docs in {"many": texts, "few": ["a b", "a", None]}.items():
        spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        want, total = set(), sum(t is not None for t in docs)
        for k, (cf, df) in brute_ngrams([t.split() if t else t for t in docs], 3, 1).items():
            marks = ["rare"] * (cf < 5) + ["common"] * (df * 10 > total) or ["kept"]
            want |= {(" ".join(k), len(k), cf, df, m) for m in marks}
        got = [tuple(r) for r in p4_ngrams(spark, str(tmp_path / name)).collect()]
        assert set(got) == want and len(got) == len(want)
        assert {r[4] for r in got} == ({"rare", "common", "kept"} if name == "many" else {"rare", "common"})


def test_ngrams_of_records_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "TERMS", 8)
    records = [["a", "b"] * (i % 7) for i in range(60)] + [None, [], [None], [None, "a", None, "b"]]
    got = {tuple(r.ngram): (r.cf, r.df) for r in ngram_counts(spark.createDataFrame([(r,) for r in records], "terms array<string>"), "terms", 3).collect()}
    assert got == brute_ngrams(records, 3, 1)
    import pyarrow as pa

    assert [p.to_pylist() for p in term_counts._pieces(pa.array([["a"] * 9, None, ["b"] * 5, [], ["c"] * 4], pa.list_(pa.string())))] == [[["a"] * 9], [None, ["b"] * 5, []], [["c"] * 4]]


def test_batches_cut_runs_anywhere():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    rows = sorted([(rng.choice([None, 1.5, float("nan")]), rng.choice("ab"), rng.choice(["x", "y", "z", None])) for _ in range(300)], key=lambda r: (r[0] is not None, r[0] == r[0], *[(x is not None, x or "") for x in r[1:]]), reverse=True)
    count = lambda r: (hash(r[1:]) % 5) + 1

    def counted(size):
        stack, out = term_counts.PrefixStack(2), Counter()
        closed = []
        for k in range(0, len(rows), size):
            chunk = rows[k : k + size]
            columns = [pa.array([r[i] for r in chunk], kind) for i, kind in enumerate((pa.float64(), pa.string(), pa.string()))]
            c = np.array([count(r) for r in chunk], dtype=np.int64)
            closed += stack.push(columns[:1], columns[1:], c, [np.ones(len(chunk), dtype=np.int64)] * 2)
        for found, n, c, r in [*closed, *stack.finish()]:
            for i in range(len(c)):
                key = tuple(str(x[i].as_py()) for x in found.columns)
                assert (n, key) not in out
                out[n, key] = (int(c[i]), int(r[i]))
        return dict(out)

    want = {}
    for n in (1, 2):
        for r in rows:
            if n == 1 or r[2] is not None:
                c, m = want.get((n, k := tuple(str(x) for x in r[: n + 1])), (0, 0))
                want[n, k] = (c + count(r), m + 1)
    assert counted(300) == counted(7) == counted(1) == want


def test_rows_without_an_id_are_deliveries_of_their_own(spark, tmp_path):
    from strandweave.llm.queries import p4_found, p5_found

    rows = [(1, "r", "umi", 0, "aa", 5, 1), (1, "r", "umi", 0, "AC", 7, 2), (None, "r", "umi", 1, " aa", 2, 1), (None, "r", "umi", 1, " aa", 2, 1), (2, "r", "umi", 2, "-", 9, 1), (None, "r", "umi", 3, None, 9, 1), (3, None, "umi", 1, "AA\t", 1, 1)]
    s = spark.createDataFrame(rows, "row_id bigint, run_id string, segment string, chunk int, seq string, seq_count bigint, t int").withColumn("loaded_at", F.timestamp_seconds("t"))
    s.write.parquet(str(tmp_path / "seqcountsummary.parquet"))
    spark.createDataFrame([("r", "umi", 5, 0)], "run_id string, segment string, min_num_reads int, max_num_chunks int").write.parquet(str(tmp_path / "bccorrect.parquet"))
    assert {tuple(r) for r in p4_found(spark, str(tmp_path)).collect()} == {("r", "umi", "AA", "rare"), ("r", "umi", "AA", "common"), ("r", "umi", "AC", "common")}  # AA: 2 + 2 in chunk 1
    assert sorted(tuple(r) for r in p5_found(spark, str(tmp_path)).collect()) == [("umi", "AA"), ("umi", "AC")]


def test_most_frequent_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["s", "t", None]), rng.choice(["A", "B", "é", None]) if rng.random() < 0.3 else f"v{rng.randrange(300):03d}", rng.choice([1, 2, 3, None]), "x") for _ in range(4000)]
    rows += [("few", "only", 0, "x")]
    df = spark.createDataFrame(rows, "segment string, seq string, w int, g string")
    for weight in ("w", None):
        sums = defaultdict(Counter)
        for g, v, w, _ in rows:
            if g is not None and v is not None:
                sums[g][v] += 1 if weight is None else (w or 0)
        want = {(g, v, n, k + 1) for g, c in sums.items() for k, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20])}
        assert {tuple(r) for r in most_frequent(df, "segment", "seq", weight, 20).collect()} == want
    assert most_frequent(df.where("false"), "segment", "seq").count() == 0
    monkeypatch.setattr(top_items, "RUN_ROWS", 10)
    assert most_frequent(df, "segment", "seq", "w", 3).count() == 7
