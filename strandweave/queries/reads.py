"""Queries over the engine's own operators, with SQL. Reads are synthesized from lineitem by the same formulas in Spark and SQL."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.parser import analyse
from ..functions.sequence import mean_quality_code, quality_ok
from ..operators import assign, correct, counts, demux, merge_pairs, spatial, translate, tree, wells
from ..operators.common import broadcast_if_small, dense_rank_all, durable, once, table
from ..operators.proximity import located
from ..operators.segment import extract_segments
from ..plans.engine import Pipeline
from ..sources.fastq import zip_mates

READ = "^(?P<cb>.{8})(?P<umi>.{6})(?P<insert>.*)$"
STRUCTURES = ["^(?P<cb>.{8})(?P<mark>CA)(?P<rest>.*)$", "^(?P<umi>.{6})(?P<mark>GT)(?P<rest>.*)$", "^(?P<rest>.*)$"]
FUZZY = ["^(?P<cb>.{8})(?P<anchor>CAGAGC){s<=2}(?P<rest>.*)$"]
ERRORS = ["^(?P<cb>.{8})(?P<anchor>CAGAGC){e<=2}(?P<rest>.*)$"]
MAJORITY = 60


def dna(x: Column) -> Column:
    return F.translate(F.md5(x), "0123456789abcdef", "ACGTACGTACGTACGT")


def quality(x: Column) -> Column:
    return F.translate(F.md5(x), "0123456789abcdef", "#+5:?DFGHIIIJJJI")


def barcode(supplier: str) -> Column:
    return F.substring(dna(F.col(supplier).cast("string")), 1, 8)


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, if they come in fewer files than there are cores (a small table is one row group, and so one task); tables of many files stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def synthetic_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(header, seq, qual, cb, umi, raw, l_linenumber, sample): a read of each lineitem; raw is its barcode with a planted error."""
    part = F.col("p_partkey").cast("string")
    # Bases are made once for each supplier and part, not for each of their lines.
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), barcode("s_suppkey").alias("cb"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring(dna(F.concat(F.lit("u"), part)), 1, 6).alias("umi"), F.substring(dna(F.concat(F.lit("c"), part)), 1, 20).alias("insert"))
    k = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"))
    r = lines.select("l_linenumber", "l_suppkey", "l_partkey", k.alias("k"), F.col("l_returnflag").alias("sample"))
    r = r.join(broadcast_if_small(suppliers), "l_suppkey").join(broadcast_if_small(parts), "l_partkey").withColumn("q", quality(F.col("k")))
    cb, n = F.col("cb"), F.col("l_linenumber")
    raw = F.when(n == 1, F.concat(F.lit("A"), F.substring(cb, 2, 9))).when(n == 2, F.substring(cb, 2, 9)).when(n == 3, F.concat(cb, F.lit("T"))).when(n == 4, F.concat(F.substring(cb, 2, 1), F.substring(cb, 1, 1), F.substring(cb, 3, 9))).otherwise(cb)
    qual = F.concat("q", F.substring("q", 1, 2))
    return r.select(F.concat(F.lit("@L"), F.col("k")).alias("header"), F.concat("cb", "umi", "insert").alias("seq"), qual.alias("qual"), "cb", "umi", raw.alias("raw"), "l_linenumber", "sample")


def _stored(reads: DataFrame) -> DataFrame:
    """As if the reads came from a table: what they are made of is not made again for each use."""
    return once(reads)


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(synthetic_reads(spark, sf_dir).select("header", "seq", "qual"))


def segment_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract_segments(_bare(spark, sf_dir), [READ])
    return s.select("header", *[F.col(c)["seq"].alias(c) for c in ("cb", "umi", "insert")], F.col("umi")["qual"].alias("umi_qual"))


def segment_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract_segments(_bare(spark, sf_dir), STRUCTURES, structure="matched")
    return s.select("header", "matched", *[F.col(c)["seq"].alias(c) for c in ("cb", "umi", "mark", "rest")])


def segment_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract_segments(_bare(spark, sf_dir), FUZZY)
    return s.select("header", *[F.col(c)["seq"].alias(c) for c in ("cb", "anchor", "rest")])


def segment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that allows up to two substitutions, insertions and deletions in its anchor. Where its errors lie is left to the pattern; whether it is found is not."""
    s = extract_segments(_bare(spark, sf_dir), ERRORS)
    return s.select("header", F.col("cb")["seq"].alias("cb"), F.col("anchor").isNotNull().alias("found"))


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract_segments(_bare(spark, sf_dir), [READ], wanted=["cb", "umi"])
    passed = lambda c, least, mean: F.when(quality_ok(F.col(c)["qual"], least, mean), F.col(c)["seq"]).alias(c)
    return s.select("header", passed("cb", 5, 20), passed("umi", 11, 33))


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.segment_counts(synthetic_reads(spark, sf_dir), ["cb", "umi"])


def _raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.segment_counts(synthetic_reads(spark, sf_dir), ["raw"]).select("seq", "n")


def rank_count_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.rank_counts(_raw_counts(spark, sf_dir)).select("seq", "n", "rank", F.round("log_rank", 6).alias("log_rank"))


def min_num_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.rank_counts(_raw_counts(spark, sf_dir), least=100).select("seq", "n", "rank")


def _allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(barcode("s_suppkey").alias("seq")).distinct()


def _corrected(spark: SparkSession, sf_dir: str, mapping: DataFrame) -> DataFrame:
    return correct.apply_map(synthetic_reads(spark, sf_dir), "raw", mapping, "clean").groupBy("raw", "clean").agg(F.count("*").alias("n"))


def correct_m2a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir, correct.allowlist_map(_raw_counts(spark, sf_dir), _allowlist(spark, sf_dir), 1))


def correct_m2a_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir, correct.allowlist_map(_raw_counts(spark, sf_dir), _allowlist(spark, sf_dir), 2, "levenshtein"))


def correct_i2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir, correct.majority_map(_raw_counts(spark, sf_dir), MAJORITY, 1))


def correct_i2m_m2a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir, correct.majority_allowlist_map(_raw_counts(spark, sf_dir), _allowlist(spark, sf_dir), MAJORITY, 1, 1))


def correct_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample is corrected by its own majority, then against the allowlist, all samples at once."""
    r = synthetic_reads(spark, sf_dir)
    c = durable(counts.segment_counts(r, ["raw"], ["sample"]).select("sample", "seq", "n"))
    mapping = correct.majority_allowlist_map(c, _allowlist(spark, sf_dir), MAJORITY, 1, 1, by=["sample"])
    return correct.apply_map(r, "raw", mapping, "clean", ["sample"]).groupBy("sample", "raw", "clean").agg(F.count("*").alias("n"))


def correct_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function: sequences that begin with A lose it, others of eight bases stay, the rest have no value."""
    own = lambda d: d.select("raw", F.when(F.col("raw").startswith("A"), F.substring("raw", 2, 9)).when(F.length("raw") == 8, F.col("raw")).otherwise("-").alias("clean"))
    return _corrected(spark, sf_dir, correct.custom_map(_raw_counts(spark, sf_dir), own))


def correct_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of an external clustering: here clusters of equal first five bases, their centre the first by name."""
    c = _raw_counts(spark, sf_dir).select(F.col("seq").alias("Unique.reads"), F.substring("seq", 1, 5).alias("Cluster.ID"))
    centres = c.groupBy("`Cluster.ID`").agg(F.min("`Unique.reads`").alias("Center"))
    return _corrected(spark, sf_dir, correct.cluster_map(c, centres))


def knee_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences before the knee, at the sensitivity that the engine uses."""
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("seq")).agg(F.count("*").alias("n"))
    return correct.majority(users, "auto", sensitivity=10.0)


def value_tree_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.value_ids(tree.tree_counts(synthetic_reads(spark, sf_dir), ["cb"]), ["cb"])


def value_tree_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.value_ids(tree.tree_counts(synthetic_reads(spark, sf_dir), ["umi"], ["cb"]), ["umi"], ["cb"])


def value_tree_3level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    return tree.value_ids(tree.tree_counts(o, ["priority"], ["nation", "customer"]), ["priority"], ["nation", "customer"])


def combinatorial_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.value_ids(tree.tree_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus"])


def multi_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global ids run over all samples together: equal values of two samples have ids of their own."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sample"), F.col("o_custkey").alias("value"))
    return tree.value_ids(tree.tree_counts(o, ["value"], sample="sample"), ["value"], sample="sample")


def size_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = synthetic_reads(spark, sf_dir)
    local = tree.size_info(tree.tree_counts(r, ["umi"], ["cb"], "sample"), ["cb"], "sample").select("sample", F.lit("umi").alias("component"), "size")
    whole = tree.size_info(tree.tree_counts(r, ["cb"], sample="sample")).select(F.lit("all").alias("sample"), F.lit("cb").alias("component"), "size")
    return local.unionByName(whole)


def value2seq_iupac(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = value_tree_global(spark, sf_dir)
    return ids.select("cb", "id", assign.word(F.col("id"), assign.alphabets("RNNNNN")).alias("dest"))


def value2seq_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to combinations of two references, in plain order; ids beyond their product have none."""
    ids = value_tree_local(spark, sf_dir).select("cb", "umi", "id")
    names = lambda t, c: dense_rank_all(table(spark, sf_dir, t).select(F.col(c).alias("seq")), [F.col("seq")], "id", stored=True)
    a, b = names("region", "r_name"), names("nation", "n_name")
    return assign.assign_sequences(ids, "id", [("dest1", a, 5), ("dest2", b, 25)])


def value2seq_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled reference of a pattern with fixed seeds, as far as ids need it."""
    ids = value_tree_global(spark, sf_dir)
    reference = assign.pattern_reference(spark, "NNNNNN", 0, "random")
    return assign.assign_sequences(ids, "id", [("dest", reference, assign.pattern_size("NNNNNN"))]).select("cb", "id", "dest")


def assignment_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.overflow(value_tree_global(spark, sf_dir), "id", 90)


def seq2seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = p.where("p_size > 25").select(F.col("p_brand").alias("s1"), F.col("p_type").alias("s2"), F.substring(dna(F.concat("p_brand", "p_type")), 1, 8).alias("d1"), F.substring(dna(F.concat("p_type", "p_brand")), 1, 6).alias("d2"))
    return translate.seq2seq(p.select("p_partkey", "p_brand", "p_type"), t, {"s1": "p_brand", "s2": "p_type"}, {"d1": "dest1", "d2": "dest2"})


def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract_segments(_bare(spark, sf_dir), [READ], wanted=["cb", "umi"])
    cb, umi = mean_quality_code(F.col("cb")["qual"]), mean_quality_code(F.col("umi")["qual"])
    return s.select("header", cb.alias("cb_code"), umi.alias("umi_code"), translate.mean_code([cb, umi]).alias("both_code"))


def read_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract_segments(_bare(spark, sf_dir), [READ])
    cb = translate.synthesized(F.col("cb")["seq"], mean_quality_code(F.col("cb")["qual"]))
    seq, qual = translate.assembled([cb, translate.constant("TCTC"), translate.passed(F.col("umi")["seq"], F.col("umi")["qual"]), (F.col("insert")["seq"], F.col("insert")["qual"])])
    return s.select("header", seq.alias("seq"), qual.alias("qual"))


def _mates(spark: SparkSession, sf_dir: str, read: str, order: Column) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.concat(F.lit(f"{read}-"), F.col("o_orderkey").cast("string"))
    r = dense_rank_all(o, [order], "row_idx", stored=True)
    return r.select(F.lit(0).alias("file_idx"), "row_idx", F.concat(F.lit("@"), key).alias("header"), dna(key).alias("seq"), quality(key).alias("qual"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mates of a read are found by position only: READ2 is in the opposite order, so headers don't fit."""
    z = zip_mates({"READ1": _mates(spark, sf_dir, "READ1", F.asc("o_orderkey")), "READ2": _mates(spark, sf_dir, "READ2", F.desc("o_orderkey"))})
    return z.select("row_idx", "header", "READ1_seq", "READ2_seq")


def complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.complete_cases(quality_filter(spark, sf_dir), ["cb", "umi"])


def demux_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.demux_counts(quality_filter(spark, sf_dir).select("cb"), ["cb"])


def demux_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("@E"), F.col("event_id").cast("string")).alias("header"), "event_type", F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("user"), F.when(F.col("event_id") % 5 != 0, F.lit("kept")).alias("state"))
    return demux.demux_table(e, ["event_type", "user"], ["state", "event_type"])


def annotate_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.annotate(quality_filter(spark, sf_dir), ["cb", "umi"], ["cb"]).select("header")


def dominance_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = wells.dominance(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", 0.4)
    return d.withColumn("ratio", F.round("ratio", 6))


def profile_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant flag of a supplier's lines of two statuses."""
    li = table(spark, sf_dir, "lineitem")
    of = lambda status: wells.dominance(li.where((F.col("l_linestatus") == status) & (F.col("l_quantity") < 12)), ["l_suppkey"], "l_returnflag")
    return wells.correspondence(of("O"), of("F"), ["l_suppkey"], ["top"])


def well_384(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(*[F.lit(x) for x in wells.QUADRANTS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    letter, column, name = wells.well_384((F.col("l_orderkey") % 8 + 1).cast("int"), (F.col("l_partkey") % 12 + 1).cast("int"), q)
    return table(spark, sf_dir, "lineitem").select(letter.alias("row"), column.alias("column"), name.alias("well")).groupBy("row", "column", "well").agg(F.count("*").alias("n"))


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot"), (k * 37 % 101 * 3072.0).alias("x"), (k * 53 % 103 * 128.0).alias("y"))


def nearest_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    beads = table(spark, sf_dir, "s_loc").where(located(F.col("x"), F.col("y"))).select(F.concat_ws("/", "puck", "barcode").alias("bead"), "x", "y").distinct()
    return spatial.nearest_spot(beads, _spots(spark, sf_dir), 2048.0).groupBy("bead").agg(F.min(F.struct("dist2", "spot")).alias("m")).select("bead", "m.spot", "m.dist2")


def spot_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as beads on a small field, which is spread over tiles of a hexagonal field of suppliers."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    beads = table(spark, sf_dir, "customer").select(c.alias("spot"), (c * 37 % 211).cast("double").alias("x"), (c * 53 % 199).cast("double").alias("y"))
    row = F.floor(s / 10)
    spots = table(spark, sf_dir, "supplier").select(s.alias("spot"), (s % 10 * 60 + row % 2 * 30).cast("double").alias("x"), (row * 52).cast("double").alias("y"))
    return spatial.spot_correspondence(beads, spots)


def spatial_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots aligned to their lower left corner, scaled by two, and counted by tile."""
    t = spatial.tiled(spatial.aligned(_spots(spark, sf_dir), 2.0), 65536.0, 4096.0)
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1"))


def header_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, qual = wells.index_from_header(F.col("header"))
    return table(spark, sf_dir, "fastq_record").select(seq.alias("seq"), qual.alias("qual")).groupBy("seq", "qual").agg(F.count("*").alias("n"))


def header_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fastq_record").select("read1_path", "row_idx", demux.normal_header(F.col("header")).alias("header")).distinct()


def bc_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ids = tree.value_ids(tree.tree_counts(p.select(F.col("p_brand").alias("value")), ["value"]), ["value"])
    t = p.where("p_size < 10").select(F.col("p_brand").alias("source"), F.substring(dna(F.col("p_brand")), 1, 8).alias("dest")).distinct()
    return wells.sorted_correspondence(ids, t, "source")


def union_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = synthetic_reads(spark, sf_dir)
    merged, other = r.where("l_linenumber <= 2").select("header", "cb"), r.where("l_linenumber > 2").select("header", "umi")
    return merged.unionByName(other, allowMissingColumns=True)


def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs cut from a molecule of 96 bases, which overlap in 24. By the key modulo 4: 0: both reads agree. 1: the first read has a wrong base of lower quality at place 40. 2: the second read has one at
    place 50. 3: the mate is of another molecule, and the pair must not merge. Where reads agree the better quality holds, where not the difference (at least 2)."""
    key = F.col("o_orderkey")
    strand = lambda salt: dna(F.concat(F.lit(salt), key.cast("string")))
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select((key % 4).alias("kind"), F.concat(F.lit("@"), key.cast("string")).alias("header"), F.concat(strand(""), strand("x"), strand("y")).alias("molecule"), F.concat(strand("p"), strand("q"), strand("z")).alias("other"))
    wrong = lambda place: F.concat(F.substring("molecule", 1, place - 1), F.translate(F.substring("molecule", place, 1), "ACGT", "CATG"), F.substring("molecule", place + 1, 96))
    first = F.substring(F.when(F.col("kind") == 1, wrong(40)).otherwise(F.col("molecule")), 1, 60)
    second = F.reverse(F.translate(F.substring(F.when(F.col("kind") == 2, wrong(50)).when(F.col("kind") == 3, F.col("other")).otherwise(F.col("molecule")), 37, 60), "ACGT", "TGCA"))
    first_qual = F.when(F.col("kind") == 1, "I" * 39 + "5" + "I" * 20).otherwise("I" * 60)
    second_qual = F.when(F.col("kind") == 2, F.reverse(F.lit("?" * 13 + "+" + "?" * 46))).otherwise("?" * 60)
    pairs = o.select("header", first.alias("READ1_seq"), first_qual.alias("READ1_qual"), second.alias("READ2_seq"), second_qual.alias("READ2_qual"))
    m = merge_pairs.merge_reads(pairs, "READ1", "READ2", 20, 30)
    return m.select("header", F.col("merged_seq").alias("seq"), F.col("merged_qual").alias("qual"), "is_merged")


TRANSLATION = """
[value_extraction]
READ1_STRUCTURE = ^(?P<cb>.{8})(?P<umi>.{6})(?P<insert>.*)$
umi = CHILD_OF(cb)
cb.value = QUALITY_FILTER(source: cb, min_nucleotide_Q-score: 5, min_avg_Q-score: 30) >> SEQ2VALUE()
umi.value = SEQ2VALUE(source: umi)
[value_translation]
dest_cb = VALUE2SEQ(source: cb.value, randseq_pattern: NNNNNNNN)
dest_umi = VALUE2SEQ(source: umi.value, randseq_pattern: NNNNNNNNN)
dest_insert = insert
READ1_STRUCTURE = dest_cb + dest_umi + "TCTC"
READ2_STRUCTURE = dest_insert
"""

DEMULTIPLEX = """
[value_extraction]
READ1_STRUCTURE = ^(?P<cb>.{8})(?P<umi>.{6})(?P<insert>.*)$
cb.filtered = QUALITY_FILTER(source: cb)
umi.value = SEQ2VALUE(source: umi)
[demultiplex]
FORMAT = FASTQ
KEY = cb.filtered
READ1_HEADER_ADDITION = umi.value
READ1_STRUCTURE = umi + "AC" + insert
"""

DEMULTIPLEX_TABLE = """
[value_extraction]
READ1_STRUCTURE = ^(?P<cb>.{8})(?P<umi>.{6})(?P<insert>.*)$
cb.filtered = QUALITY_FILTER(source: cb)
umi.filtered = QUALITY_FILTER(source: umi, min_nucleotide_Q-score: 11, min_avg_Q-score: 33)
[demultiplex]
FORMAT = TSV
KEY = cb.filtered
TARGET = umi.filtered,insert
"""


def _pipeline(spark: SparkSession, sf_dir: str, text: str) -> Pipeline:
    reads = _stored(synthetic_reads(spark, sf_dir).select("header", "sample", F.col("seq").alias("READ1_seq"), F.col("qual").alias("READ1_qual")))
    return Pipeline(spark, analyse(text), reads, mode="ordered")


def translate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: segments, quality, values with a hierarchy, dense ids, new sequences, new reads."""
    return _pipeline(spark, sf_dir, TRANSLATION).translate()


def demultiplex_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline(spark, sf_dir, DEMULTIPLEX).demultiplex()


def demultiplex_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a demultiplexed run of several samples that share all keys: each key belongs to a sample."""
    d = _pipeline(spark, sf_dir, DEMULTIPLEX_TABLE).demultiplex()
    return d.toDF(*[c.replace(".", "_") for c in d.columns])


def extract_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _pipeline(spark, sf_dir, TRANSLATION).extract()
    return e.toDF(*[c.replace(":", "__").replace(".", "_") for c in e.columns])


_ALL = (
    segment_fixed, segment_alternatives, segment_fuzzy, segment_errors, quality_filter, segment_counts, rank_count_curve, min_num_reads, correct_m2a, correct_m2a_levenshtein, correct_i2m, correct_i2m_m2a, correct_by_sample, correct_custom, correct_clusters,
    knee_majority, value_tree_global, value_tree_local, value_tree_3level, combinatorial_value, multi_sample_ids, size_info, value2seq_iupac, value2seq_multi, value2seq_random, assignment_overflow, seq2seq, mean_quality,
    read_assembly, positional_zip, complete_case, demux_counts, demux_tsv, annotate_header, dominance_profile, profile_correspondence, well_384, nearest_spot, spot_correspondence, spatial_tiles, header_to_index, header_normal, bc_sort, union_null_fill,
    merged_pairs, translate_reads, demultiplex_reads, demultiplex_samples, extract_reads,
)
QUERIES = {f.__name__: f for f in _ALL}

_DNA = lambda x: f"translate(md5({x}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_QUAL = lambda x: f"translate(md5({x}), '0123456789abcdef', '#+5:?DFGHIIIJJJI')"
_READS = f"""k AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, substr({_DNA('CAST(l_suppkey AS VARCHAR)')}, 1, 8) AS cb, substr({_DNA("concat('u', l_partkey)")}, 1, 6) AS umi FROM lineitem),
r AS (SELECT concat('@L', k) AS header, concat(cb, umi, substr({_DNA("concat('c', l_partkey)")}, 1, 20)) AS seq, concat({_QUAL("k")}, substr({_QUAL("k")}, 1, 2)) AS qual, cb, umi, l_linenumber, l_returnflag AS sample,
  CASE l_linenumber WHEN 1 THEN concat('A', substr(cb, 2)) WHEN 2 THEN substr(cb, 2) WHEN 3 THEN concat(cb, 'T') WHEN 4 THEN concat(substr(cb, 2, 1), substr(cb, 1, 1), substr(cb, 3)) ELSE cb END AS raw FROM k)"""
_SCORES = lambda q: f"list_transform(string_split({q}, ''), lambda c: unicode(c) - 33)"
_OK = lambda q, least, mean: f"list_min({_SCORES(q)}) >= {least} AND list_sum({_SCORES(q)}) >= {mean} * length({q})"
_FILTERED = f"""f AS (SELECT header, CASE WHEN {_OK('substr(qual, 1, 8)', 5, 20)} THEN substr(seq, 1, 8) END AS cb, CASE WHEN {_OK('substr(qual, 9, 6)', 11, 33)} THEN substr(seq, 9, 6) END AS umi FROM r)"""
_CODE = lambda q: f"CAST(round_even(list_sum(list_transform(string_split({q}, ''), lambda c: unicode(c))) / length({q}), 0) AS INTEGER)"
_OBS = f"{_READS}, o AS (SELECT raw, count(*) AS n FROM r GROUP BY raw)"
_ALLOW = f"a AS (SELECT DISTINCT substr({_DNA('CAST(s_suppkey AS VARCHAR)')}, 1, 8) AS seq FROM supplier)"


def _nearest(raws: str, terms: str, distance: int, function: str = "damerau_levenshtein", order: str = "d, seq") -> str:
    near = f"SELECT raw, seq, {function}(raw, seq) AS d, w FROM {raws} AS x, {terms} AS y WHERE abs(length(raw) - length(seq)) <= {distance} AND {function}(raw, seq) <= {distance}"
    return f"SELECT raw, seq AS clean FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY {order}) AS q FROM ({near})) WHERE q = 1"


_APPLIED = "SELECT r.raw, m.clean, count(*) AS n FROM r LEFT JOIN m ON r.raw = m.raw GROUP BY ALL"
_TOP = f"t AS (SELECT raw AS seq, n AS w FROM o ORDER BY n DESC, raw LIMIT {MAJORITY})"
_RANKS = "g AS (SELECT cb, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cb) - 1 AS id FROM r GROUP BY cb)"
_LOCAL = "l AS (SELECT cb, umi, count(*) AS n, row_number() OVER (PARTITION BY cb ORDER BY count(*) DESC, umi) - 1 AS id FROM r GROUP BY cb, umi)"


def _word(index: str, places: int, letters: str = "ATGC") -> str:
    return " || ".join(f"substr('{letters}', CAST(({index} // {len(letters) ** k}) % {len(letters)} + 1 AS INTEGER), 1)" for k in range(places - 1, -1, -1))


def _shuffled_words(places: int = 6) -> str:
    """All words of so many N as SQL values (id, word): each place's letters in the order of a sample seeded with the place, the last place fastest, then all shuffled with seed 0."""
    letters = [random.Random(i).sample(list("ATGC"), 4) for i in range(places)]
    words = ["".join(w) for w in itertools.product(*letters)]
    random.Random(0).shuffle(words)
    return ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))


SQL = {
    "segment_fixed": f"WITH {_READS} SELECT header, substr(seq, 1, 8) AS cb, substr(seq, 9, 6) AS umi, substr(seq, 15) AS insert, substr(qual, 9, 6) AS umi_qual FROM r",
    "segment_alternatives": f"""WITH {_READS}, m AS (SELECT *, CASE WHEN substr(seq, 9, 2) = 'CA' THEN 1 WHEN substr(seq, 7, 2) = 'GT' THEN 2 ELSE 3 END AS matched FROM r)
SELECT header, matched, CASE matched WHEN 1 THEN substr(seq, 1, 8) END AS cb, CASE matched WHEN 2 THEN substr(seq, 1, 6) END AS umi, CASE matched WHEN 1 THEN 'CA' WHEN 2 THEN 'GT' END AS mark, CASE matched WHEN 1 THEN substr(seq, 11) WHEN 2 THEN substr(seq, 9) ELSE seq END AS rest FROM m""",
    "segment_fuzzy": f"""WITH {_READS}, m AS (SELECT *, hamming(substr(seq, 9, 6), 'CAGAGC') <= 2 AS hit FROM r)
SELECT header, CASE WHEN hit THEN substr(seq, 1, 8) END AS cb, CASE WHEN hit THEN substr(seq, 9, 6) END AS anchor, CASE WHEN hit THEN substr(seq, 15) END AS rest FROM m""",
    "segment_errors": f"""WITH {_READS}, m AS (SELECT header, cb, list_min(list_transform(range(4, 9), lambda k: levenshtein(substr(seq, 9, k), 'CAGAGC'))) <= 2 AS found FROM r) SELECT header, CASE WHEN found THEN cb END AS cb, found FROM m""",
    "quality_filter": f"WITH {_READS}, {_FILTERED} SELECT * FROM f",
    "segment_counts": f"WITH {_READS} SELECT 'cb' AS segment, cb AS seq, count(*) AS n FROM r GROUP BY cb UNION ALL SELECT 'umi' AS segment, umi AS seq, count(*) AS n FROM r GROUP BY umi",
    "rank_count_curve": f"WITH {_OBS} SELECT raw AS seq, n, rank, round(log10(rank), 6) AS log_rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, raw) AS rank FROM o)",
    "min_num_reads": f"WITH {_OBS} SELECT raw AS seq, n, row_number() OVER (ORDER BY n DESC, raw) AS rank FROM o WHERE n >= 100",
    "correct_m2a": f"WITH {_OBS}, {_ALLOW}, m AS ({_nearest('o', '(SELECT seq, 0 AS w FROM a)', 1)}) {_APPLIED}",
    "correct_m2a_levenshtein": f"WITH {_OBS}, {_ALLOW}, m AS ({_nearest('o', '(SELECT seq, 0 AS w FROM a)', 2, 'levenshtein')}) {_APPLIED}",
    "correct_i2m": f"WITH {_OBS}, {_TOP}, m AS ({_nearest('o', 't', 1, order='d, w DESC, seq')}) {_APPLIED}",
    "correct_i2m_m2a": f"""WITH {_OBS}, {_ALLOW}, {_TOP}, m1 AS ({_nearest('o', 't', 1, order='d, w DESC, seq')}), j AS (SELECT DISTINCT clean AS raw FROM m1), m2 AS ({_nearest('j', '(SELECT seq, 0 AS w FROM a)', 1)}),
m AS (SELECT m1.raw, m2.clean FROM m1 JOIN m2 ON m1.clean = m2.raw) {_APPLIED}""",
    "correct_by_sample": f"""WITH {_READS}, o AS (SELECT sample, raw, count(*) AS n FROM r GROUP BY ALL), {_ALLOW}, t AS (SELECT sample, raw AS seq, n AS w FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, raw) AS k FROM o) WHERE k <= {MAJORITY}),
m1 AS (SELECT sample, raw, seq AS mid FROM (SELECT x.sample, raw, seq, row_number() OVER (PARTITION BY x.sample, raw ORDER BY damerau_levenshtein(raw, seq), w DESC, seq) AS q FROM o AS x JOIN t ON x.sample = t.sample AND damerau_levenshtein(raw, seq) <= 1) WHERE q = 1),
m2 AS (SELECT mid, seq AS clean FROM (SELECT mid, seq, row_number() OVER (PARTITION BY mid ORDER BY damerau_levenshtein(mid, seq), seq) AS q FROM (SELECT DISTINCT mid FROM m1) JOIN a ON damerau_levenshtein(mid, seq) <= 1) WHERE q = 1)
SELECT r.sample, r.raw, clean, count(*) AS n FROM r LEFT JOIN (SELECT sample, raw, clean FROM m1 JOIN m2 USING (mid)) m ON r.sample = m.sample AND r.raw = m.raw GROUP BY ALL""",
    "correct_custom": f"WITH {_READS} SELECT raw, CASE WHEN raw LIKE 'A%' THEN substr(raw, 2) WHEN length(raw) = 8 THEN raw END AS clean, count(*) AS n FROM r GROUP BY ALL",
    "correct_clusters": f"WITH {_OBS}, m AS (SELECT raw, min(raw) OVER (PARTITION BY substr(raw, 1, 5)) AS clean FROM o) {_APPLIED}",
    "knee_majority": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS seq, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS rank FROM events GROUP BY user_id),
b AS (SELECT max(n) AS high, max(n) - min(n) AS fall, count(*) AS m FROM r), y AS (SELECT rank AS i, (high - n) * (m - 1) - (rank - 1) * fall AS y, fall FROM r, b),
e AS (SELECT *, lag(y) OVER (ORDER BY i) AS before, lead(y) OVER (ORDER BY i) AS following FROM y),
k AS (SELECT *, i > 1 AND y >= before AND y >= coalesce(following, y) AS top, y <= coalesce(before, y) AND y <= coalesce(following, y) AS low FROM e),
s AS (SELECT *, last_value(CASE WHEN top THEN i END IGNORE NULLS) OVER (ORDER BY i) AS knee, last_value(CASE WHEN low THEN 0 WHEN top THEN y - 10 * fall END IGNORE NULLS) OVER (ORDER BY i) AS threshold FROM k),
t AS (SELECT arg_min(knee, i) AS knee FROM s WHERE knee IS NOT NULL AND following < threshold) SELECT seq, n, rank FROM r, t WHERE knee IS NULL OR rank < knee""",
    "value_tree_global": f"WITH {_READS}, {_RANKS} SELECT * FROM g",
    "value_tree_local": f"WITH {_READS}, {_LOCAL} SELECT * FROM l",
    "value_tree_3level": """SELECT c_nationkey AS nation, c_custkey AS customer, o_orderpriority AS priority, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey, c_custkey ORDER BY count(*) DESC, o_orderpriority) - 1 AS id
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "combinatorial_value": "SELECT l_returnflag, l_linestatus, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_returnflag, l_linestatus) - 1 AS id FROM lineitem GROUP BY 1, 2",
    "multi_sample_ids": "SELECT o_orderpriority AS sample, o_custkey AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey, o_orderpriority) - 1 AS id FROM orders GROUP BY 1, 2",
    "size_info": f"""WITH {_READS} SELECT sample, 'umi' AS component, max(c) AS size FROM (SELECT sample, cb, count(DISTINCT umi) AS c FROM r GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT 'all' AS sample, 'cb' AS component, count(*) AS size FROM (SELECT DISTINCT sample, cb FROM r)""",
    "value2seq_iupac": f"WITH {_READS}, {_RANKS} SELECT cb, id, CASE WHEN id < 2048 THEN substr('AG', CAST((id // 1024) % 2 + 1 AS INTEGER), 1) || {_word('id', 5)} END AS dest FROM g",
    "value2seq_multi": f"""WITH {_READS}, {_LOCAL}, a AS (SELECT r_name AS seq, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region), b AS (SELECT n_name AS seq, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation)
SELECT cb, umi, id, a.seq AS dest1, b.seq AS dest2 FROM l LEFT JOIN a ON id < 125 AND a.i = (id // 25) % 5 LEFT JOIN b ON id < 125 AND b.i = id % 25""",
    "value2seq_random": f"WITH {_READS}, {_RANKS}, w(i, word) AS (VALUES {_shuffled_words()}) SELECT cb, id, word AS dest FROM g LEFT JOIN w ON g.id = w.i",
    "assignment_overflow": f"WITH {_READS}, {_RANKS} SELECT count(*) AS rows, CAST(sum(CASE WHEN id >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS beyond FROM g",
    "seq2seq": f"""WITH t AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 25) SELECT p_partkey, p.p_brand, p.p_type, CASE WHEN t.p_brand IS NOT NULL THEN substr({_DNA('concat(p.p_brand, p.p_type)')}, 1, 8) END AS dest1,
CASE WHEN t.p_brand IS NOT NULL THEN substr({_DNA('concat(p.p_type, p.p_brand)')}, 1, 6) END AS dest2 FROM part p LEFT JOIN t ON p.p_brand = t.p_brand AND p.p_type = t.p_type""",
    "mean_quality": f"""WITH {_READS}, c AS (SELECT header, {_CODE('substr(qual, 1, 8)')} AS cb_code, {_CODE('substr(qual, 9, 6)')} AS umi_code FROM r) SELECT *, CAST(round_even((cb_code + umi_code) / 2, 0) AS INTEGER) AS both_code FROM c""",
    "read_assembly": f"""WITH {_READS} SELECT header, substr(seq, 1, 8) || 'TCTC' || substr(seq, 9) AS seq, repeat(chr({_CODE('substr(qual, 1, 8)')}), 8) || 'IIII' || substr(qual, 9) AS qual FROM r""",
    "positional_zip": f"""WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS i FROM orders)
SELECT a.i AS row_idx, concat('@READ2-', b.k) AS header, {_DNA("concat('READ1-', a.k)")} AS "READ1_seq", {_DNA("concat('READ2-', b.k)")} AS "READ2_seq" FROM a JOIN b ON a.i = b.i""",
    "complete_case": f"WITH {_READS}, {_FILTERED} SELECT * FROM f WHERE cb IS NOT NULL AND umi IS NOT NULL",
    "demux_counts": f"WITH {_READS}, {_FILTERED} SELECT cb AS key, count(*) AS n FROM f WHERE cb IS NOT NULL GROUP BY cb",
    "demux_tsv": """SELECT concat(event_type, '_', user_id) AS key, concat('@E', event_id) AS header, CASE WHEN event_id % 5 <> 0 THEN 'kept' ELSE '-' END AS state, event_type FROM events WHERE user_id % 7 <> 0 AND event_type IS NOT NULL""",
    "annotate_header": f"WITH {_READS}, {_FILTERED} SELECT concat(header, '_', cb, '_', umi) AS header FROM f WHERE cb IS NOT NULL AND umi IS NOT NULL",
    "dominance_profile": """WITH c AS (SELECT l_suppkey, l_returnflag AS v, count(*) AS c FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, CAST(sum(c) AS BIGINT) AS total FROM c GROUP BY 1),
b AS (SELECT l_suppkey, v AS top, c AS top_count FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, v) AS o FROM c) WHERE o = 1)
SELECT l_suppkey, total, top, top_count, round(top_count / total, 6) AS ratio, top_count / total > 0.4 AS passed FROM b JOIN t USING (l_suppkey)""",
    "profile_correspondence": """WITH c AS (SELECT l_linestatus AS s, l_suppkey, l_returnflag AS v, count(*) AS c FROM lineitem WHERE l_quantity < 12 GROUP BY 1, 2, 3),
b AS (SELECT s, l_suppkey, v AS top FROM (SELECT *, row_number() OVER (PARTITION BY s, l_suppkey ORDER BY c DESC, v) AS o FROM c) WHERE o = 1)
SELECT coalesce(x.l_suppkey, y.l_suppkey) AS l_suppkey, x.top AS top_1, y.top AS top_2, CASE WHEN x.top IS NULL OR y.top IS NULL THEN 'missing' WHEN x.top = y.top THEN 'same' ELSE 'different' END AS verdict
FROM (SELECT * FROM b WHERE s = 'O') x FULL JOIN (SELECT * FROM b WHERE s = 'F') y ON x.l_suppkey = y.l_suppkey""",
    "well_384": """WITH w AS (SELECT CAST(l_orderkey % 8 + 1 AS INTEGER) AS r, CAST(l_partkey % 12 + 1 AS INTEGER) AS c, l_suppkey % 4 AS q FROM lineitem),
x AS (SELECT chr(CAST(64 + r * 2 - 1 + (CASE WHEN q >= 2 THEN 1 ELSE 0 END) AS INTEGER)) AS row, CAST(c * 2 - 1 + q % 2 AS INTEGER) AS col FROM w)
SELECT row, col AS column, concat(row, lpad(CAST(col AS VARCHAR), 2, '0')) AS well, count(*) AS n FROM x GROUP BY row, col""",
    "nearest_spot": """WITH b AS (SELECT DISTINCT concat_ws('/', puck, barcode) AS bead, x, y FROM s_loc WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT (x = -9999 AND y = -9999)),
s AS (SELECT s_suppkey AS spot, CAST(s_suppkey * 37 % 101 * 3072 AS DOUBLE) AS sx, CAST(s_suppkey * 53 % 103 * 128 AS DOUBLE) AS sy FROM supplier),
d AS (SELECT bead, min(struct_pack(d := (x - sx) * (x - sx) + (y - sy) * (y - sy), spot := spot)) AS m FROM b, s GROUP BY bead)
SELECT bead, m.spot AS spot, m.d AS dist2 FROM d""",
    "spot_correspondence": """WITH s AS (SELECT c_custkey AS bead, CAST(c_custkey * 37 % 211 AS DOUBLE) AS x, CAST(c_custkey * 53 % 199 AS DOUBLE) AS y FROM customer),
d AS (SELECT s_suppkey AS spot, CAST(s_suppkey % 10 * 60 + s_suppkey // 10 % 2 * 30 AS DOUBLE) AS x, CAST(s_suppkey // 10 * 52 AS DOUBLE) AS y FROM supplier),
dd AS (SELECT (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM d a, d b WHERE a.x <> b.x OR a.y <> b.y), sd AS (SELECT min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM s a, s b WHERE a.x <> b.x OR a.y <> b.y),
ring AS (SELECT max(d2) AS d2 FROM dd WHERE d2 < (SELECT min(d2) FROM dd) * 2.25), rate AS (SELECT ceil(ceil(sqrt(ring.d2)) * 2 / sqrt(3)) / sqrt(sd.d2) AS r FROM ring, sd),
e AS (SELECT bead, x * r AS x, y * r AS y FROM s, rate), eb AS (SELECT min(x) AS x0, min(y) AS y0 FROM e), db AS (SELECT min(x) AS x0, min(y) AS y0 FROM d),
m AS (SELECT spot, x - (db.x0 - eb.x0) AS x, y - (db.y0 - eb.y0) AS y FROM d, db, eb), mb AS (SELECT min(x) AS x0, max(x) - min(x) AS w, min(y) AS y0, max(y) - min(y) AS h FROM m),
lx AS (SELECT list_sort(list(x)) AS xs FROM m, mb WHERE m.y < mb.y0 + 5), bl AS (SELECT (xs[2] - xs[1]) / 2 AS blank FROM lx),
t AS (SELECT bead, x, y, CAST(CASE WHEN w > 0 THEN floor((x - x0) / w) ELSE 0 END AS BIGINT) AS tx, CAST(CASE WHEN h > 0 THEN floor((y - y0) / h) ELSE 0 END AS BIGINT) AS ty FROM (SELECT e.*, eb.x0, eb.y0, w, h FROM e, eb, mb)),
u AS (SELECT bead, tx, ty, CASE WHEN tx = 0 THEN x ELSE x - (w * tx + blank) END AS x, CASE WHEN ty = 0 THEN y ELSE y - (h * ty + blank) END AS y FROM t, mb, bl)
SELECT bead, tx, ty, spot FROM (SELECT u.bead, tx, ty, spot, row_number() OVER (PARTITION BY u.bead ORDER BY (u.x - m.x) * (u.x - m.x) + (u.y - m.y) * (u.y - m.y), spot) AS o FROM u, m) WHERE o = 1""",
    "spatial_tiles": """WITH s AS (SELECT s_suppkey * 37 % 101 * 3072.0::DOUBLE AS x, s_suppkey * 53 % 103 * 128.0::DOUBLE AS y FROM supplier), b AS (SELECT min(x) AS x0, min(y) AS y0 FROM s),
a AS (SELECT (x - x0) * 2 AS x, (y - y0) * 2 AS y FROM s, b) SELECT CAST(floor(x / 65536) AS BIGINT) AS tx, CAST(floor(y / 4096) AS BIGINT) AS ty, count(*) AS n, min(x - floor(x / 65536) * 65536) AS x0, max(y - floor(y / 4096) * 4096) AS y1 FROM a GROUP BY 1, 2""",
    "header_to_index": """WITH s AS (SELECT nullif(regexp_replace(string_split(header, ' ')[2], ':.*$', ''), '') AS seq FROM fastq_record) SELECT seq, repeat('?', length(seq)) AS qual, count(*) AS n FROM s GROUP BY seq""",
    "header_normal": r"SELECT DISTINCT read1_path, row_idx, regexp_split_to_array(header, '[ |\t]+')[1] AS header FROM fastq_record",
    "bc_sort": f"""WITH i AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS reindex FROM part GROUP BY p_brand), t AS (SELECT DISTINCT p_brand, substr({_DNA('p_brand')}, 1, 8) AS dest FROM part WHERE p_size < 10)
SELECT p_brand AS source, dest, reindex FROM t JOIN i USING (p_brand)""",
    "union_null_fill": f"WITH {_READS} SELECT header, cb, NULL AS umi FROM r WHERE l_linenumber <= 2 UNION ALL SELECT header, NULL AS cb, umi FROM r WHERE l_linenumber > 2",
    "merged_pairs": f"""WITH k AS (SELECT o_orderkey % 4 AS kind, CAST(o_orderkey AS VARCHAR) AS k FROM orders) SELECT concat('@', k) AS header, CASE WHEN kind <> 3 THEN concat({_DNA('k')}, {_DNA("concat('x', k)")}, {_DNA("concat('y', k)")}) END AS seq,
CASE kind WHEN 0 THEN repeat('I', 60) || repeat('?', 36) WHEN 1 THEN repeat('I', 39) || '+' || repeat('I', 20) || repeat('?', 36) WHEN 2 THEN repeat('I', 49) || '?' || repeat('I', 10) || repeat('?', 36) END AS qual, kind <> 3 AS is_merged FROM k""",
    "translate_reads": f"""WITH {_READS}, s AS (SELECT header, sample, seq, qual, CASE WHEN {_OK('substr(qual, 1, 8)', 5, 30)} THEN cb END AS cb, umi FROM r), t AS (SELECT * FROM s WHERE cb IS NOT NULL),
g AS (SELECT sample, cb, row_number() OVER (ORDER BY count(*) DESC, cb, sample) - 1 AS id FROM t GROUP BY sample, cb), l AS (SELECT sample, cb, umi, row_number() OVER (PARTITION BY sample, cb ORDER BY count(*) DESC, umi) - 1 AS id FROM t GROUP BY sample, cb, umi)
SELECT s.sample, header, {_word('g.id', 8)} || {_word('l.id', 9)} || 'TCTC' AS "READ1_seq", repeat(chr({_CODE('substr(qual, 1, 8)')}), 8) || repeat(chr({_CODE('substr(qual, 9, 6)')}), 9) || 'IIII' AS "READ1_qual", substr(seq, 15) AS "READ2_seq", substr(qual, 15) AS "READ2_qual"
FROM s JOIN g ON s.sample = g.sample AND s.cb = g.cb JOIN l ON s.sample = l.sample AND s.cb = l.cb AND s.umi = l.umi""",
    "demultiplex_reads": f"""WITH {_READS}, s AS (SELECT *, CASE WHEN {_OK('substr(qual, 1, 8)', 5, 20)} THEN cb END AS key FROM r) SELECT sample, header, key, concat(header, '_', umi) AS "READ1_header", concat(umi, 'AC', substr(seq, 15)) AS "READ1_seq",
concat(repeat(chr({_CODE('substr(qual, 9, 6)')}), 6), 'II', substr(qual, 15)) AS "READ1_qual" FROM s WHERE key IS NOT NULL""",
    "demultiplex_samples": f"""WITH {_READS}, {_FILTERED.replace("SELECT header", "SELECT header, sample, substr(seq, 15) AS insert")} SELECT sample, cb AS key, header AS "Header", coalesce(umi, '-') AS umi_filtered, insert AS insert_clean1 FROM f WHERE cb IS NOT NULL""",
    "extract_reads": f"""WITH {_READS} SELECT sample, header AS "Header", CASE WHEN {_OK('substr(qual, 1, 8)', 5, 30)} THEN cb END AS cb__cb_value, substr(seq, 15) AS insert__insert_clean1, umi AS umi__umi_value FROM r""",
}
