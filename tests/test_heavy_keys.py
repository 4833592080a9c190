from collections import Counter

from strandweave.operators.heavy_keys import heavy_keys, most_frequent_value

SCHEMA = "k string, v string, n int, heavy string"


def want(rows):
    counts = {}
    for k, v, *_ in rows:
        if k is not None and v is not None:
            counts.setdefault(k, Counter())[v] += 1
    return {(k, *min((-n, v) for v, n in c.items())[::-1]) for k, c in counts.items()}


def test_heavy_and_light_keys_give_one_result(spark):
    rows = [("hot", f"v{i % 7}", 1, "x") for i in range(4000)] + [(f"k{i % 300}", f"v{i % 11}", 1, "x") for i in range(3000)]
    rows += [(None, "v", 1, "x"), ("k1", None, 1, "x"), ("tie", "b", 1, "x"), ("tie", "a", 1, "x"), ("", "e", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.heavy for r in heavy_keys(df, "k").collect()] == ["hot"]
    got = most_frequent_value(df, "k", "v")
    assert got.columns == ["k", "v", "n"]
    assert {(k, v, -n) for k, v, n in got.collect()} == want(rows)


def test_empty_table(spark):
    assert most_frequent_value(spark.createDataFrame([], SCHEMA), "k", "v").count() == 0


def test_reads_without_an_id_are_reads_of_their_own(spark, tmp_path):
    from strandweave.queries.problems import p3_found

    rows = [(1, "r", "ac", "gg"), (1, "r", " AC\t", "GG"), (2, "r", "AC", "tt"), (None, "r", "AC", "TT"), (None, "r", "AC", "TT"), (3, "r", "-", "TT"), (None, "r", None, "TT"), (4, "r", "CC", "-"), (5, None, "AC", "GG"), (6, "r", "AC", "GG")]
    df = spark.createDataFrame([(i, run, bc1, None, None, umi) for i, run, bc1, umi in rows], "read_id bigint, run_id string, bc1 string, bc2 string, bc3 string, umi string")
    df.write.parquet(str(tmp_path / "corrected_table.parquet"))
    spark.createDataFrame([("r", " bc1 "), (None, "bc1")], "run_id string, demux_key string").write.parquet(str(tmp_path / "settings_demultiplex.parquet"))
    spark.createDataFrame([("r", "umi", "bc1\t"), ("r", "bc2", "bc1,umi")], "run_id string, child string, parent string").write.parquet(str(tmp_path / "config_extract_value_ext.parquet"))
    assert [tuple(r) for r in p3_found(spark, str(tmp_path)).collect()] == [("AC", "TT")]  # 3 reads against 2
