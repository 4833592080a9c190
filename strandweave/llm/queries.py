"""Queries and SQL of the problems that prepare training data (2 and 4 to 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import broadcast_if_small, clean_value, durable, table
from .boundary_split import cut_rows, row_blocks, row_counts, row_valleys, split_texts
from .encoding import encode_texts
from .lookalikes import canonical, canonical_column, changing, look_classes, same_looking_pairs
from .packing import balance, pack_items
from .term_counts import ngram_counts, value_counts
from .top_items import most_frequent

DEFAULT_READS = 2_000_000
CONTAINER = 2048
#: An n-gram with fewer occurrences is rare.
RARE = 5


# 2: pieces of oversized READ1 files
def whole_number(c: Column) -> Column:
    """A whole number typed by hand: outer and inner blanks, thousands marks (, _ ' .), exponents, k and m; null if it is none of these."""
    t = F.lower(F.regexp_replace(c, r"[\s ,_']", ""))
    t = F.when(t.rlike(r"^\+?\d{1,3}(\.\d{3})+$"), F.regexp_replace(t, r"\.", "")).otherwise(t)
    unit = F.when(t.endswith("k"), 1_000).when(t.endswith("m"), 1_000_000).otherwise(1)
    return F.round(F.regexp_replace(t, "[km]$", "").try_cast("double") * unit).try_cast("bigint")


def same_path(c: Column) -> Column:
    """The path without empty parts, `.` and `x/..`: one name for a file, however it is written."""
    parts = F.filter(F.split(F.trim(c), "/"), lambda p: (p != "") & (p != "."))
    up = lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    return F.concat(F.when(F.trim(c).startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def lane_tile(header: Column) -> Column:
    """`lane:tile` of a read's header: the third and fourth field from the end of the first word with five fields or more; null without one."""
    word = r"^@?(?:[^ \t|#:]*[ \t]+)?(?:[^ \t|#]*:)?([^ \t|#:]+:[^ \t|#:]+):[^ \t|#:]+:[^ \t|#:]+(?:[ \t|#]|$)"
    found = F.regexp_extract(header, word, 1)
    return F.when(found != "", found)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "qsub").groupBy("run_id").agg(F.max(whole_number(F.col("num_reads"))).alias("limit"), F.max("overlap_reads").cast("bigint").alias("overlap"))
    files = table(spark, sf_dir, "value_extraction").where("file_id is not null").select("file_id", "run_id", same_path(F.col("read1_path")).alias("path")).distinct()
    files = files.join(runs, "run_id", "left").select("file_id", "path", F.coalesce("limit", F.lit(DEFAULT_READS)).cast("bigint").alias("limit"), F.coalesce("overlap", F.lit(0)).cast("bigint").alias("overlap"))
    reads = table(spark, sf_dir, "fastq_record").where("row_idx is not null")
    # No file has more different row_idx than rows, so only files with enough rows are looked into. One small row a file and task is sent; written paths are made one name after that.
    sizes = durable(reads.groupBy("read1_path").agg(F.count("*").alias("rows")).select("read1_path", "rows", same_path(F.col("read1_path")).alias("path")))
    long = durable(files.join(sizes.groupBy("path").agg(F.sum("rows").alias("rows")), "path").where(F.col("rows") > F.greatest("limit", F.lit(1))))
    written = long.join(sizes.select("path", "read1_path"), "path").select("file_id", "read1_path")
    rows = reads.select("read1_path", "row_idx", "header").join(broadcast_if_small(written), "read1_path").select("file_id", "row_idx", lane_tile(F.col("header")).alias("tile"))
    blocks = row_blocks(rows, "file_id", "row_idx", "tile")
    large = long.join(row_counts(blocks, "file_id"), "file_id").where(F.col("n") > F.greatest("limit", F.lit(1)))
    return cut_rows(large.select("file_id", "n", "limit", "overlap"), row_valleys(blocks, "file_id"), "file_id").select("file_id", F.col("first").alias("first_row"), F.col("last").alias("last_row"))


def p2_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=2000, overlap=100)


# 4 and 5: sequences over the chunks of a run, and over everything
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of seqcountsummary with the value of seq, and `own`: a number for each row without row_id, which can't be the repeat of another."""
    own = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id()).alias("own")
    return table(spark, sf_dir, "seqcountsummary").select("row_id", own, "loaded_at", "run_id", "segment", "chunk", clean_value(F.col("seq")).alias("seq"), "seq_count")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, segment, chunk, seq, seq_count): the last delivery of each row with a value; each row without row_id is a delivery of its own."""
    held = F.max(F.struct("loaded_at", "run_id", "segment", "chunk", "seq", "seq_count")).alias("h")
    return summaries(spark, sf_dir).repartition("row_id", "own").groupBy("row_id", "own").agg(held).select("h.*").where(F.col("seq").isNotNull()).drop("loaded_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = value_counts(deliveries(spark, sf_dir), ["run_id", "segment"], "seq", "chunk", "seq_count", sketch_over=summaries(spark, sf_dir))
    limits = table(spark, sf_dir, "bccorrect").groupBy("run_id", "segment").agg(F.max("min_num_reads").alias("least"), F.max("max_num_chunks").alias("most"))
    c = counts.join(broadcast_if_small(limits), ["run_id", "segment"], "left")
    marks = F.array_compact(F.array(F.when(F.col("cf") < F.coalesce("least", F.lit(1)), "rare"), F.when(F.col("df") > F.col("most"), "common")))
    return c.select("run_id", "segment", "seq", F.explode(marks).alias("mark"))


def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams of up to three words (between blanks, tabs and line breaks), marked `rare` below RARE occurrences, `common` in more than a tenth of the documents, else `kept`; one that is both has two rows."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "").alias("words"))
    total = docs.agg(F.count("text")).first()[0]  # one number
    grams = ngram_counts(words, "words", 3)
    rare, common = F.col("cf") < RARE, F.col("df") * 10 > total
    marks = F.array_compact(F.array(F.when(rare, "rare"), F.when(common, "common"), F.when(~rare & ~common, "kept")))
    return grams.select(F.array_join("ngram", " ").alias("ngram"), "n", "cf", "df", F.explode(marks).alias("mark"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_frequent(deliveries(spark, sf_dir), "segment", "seq", "seq_count", 20).select("segment", "seq")


# 6 to 8: texts
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("tokens"))
    packed = pack_items(sizes, "doc_id", "tokens", CONTAINER)
    return packed.select("doc_id", "piece", F.col("first").alias("first_token"), F.col("size").alias("tokens"), "container", F.col("start").alias("start_token"))


def p7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well p7_packed fills its containers, and how even their costs are."""
    return balance(p7_packed(spark, sf_dir).select("container", F.col("tokens").alias("size")), CONTAINER)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that looks like a different text, with its class: the digest of what they look like."""
    return look_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.hex("form").alias("look"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", canonical_column(F.col("text")).alias("canonical"))
    return d.select("doc_id", "canonical", (F.col("text") != F.col("canonical")).alias("changed"))


QUERIES = {f.__name__: f for f in (p2_found, p2_text_pieces, p4_found, p4_ngrams, p5_found, p6_ids, p7_packed, p7_balance, p8_found, p8_classes, p8_canonical)}

def _look(text: str) -> str:
    """SQL of the canonical form: each character that changes alone is replaced by what it becomes, then all is composed. (Segments, their context and their splicing are the operator's own.)"""
    one, gone, several = {}, [], {}
    for cp in changing():
        form = canonical(chr(cp))
        if len(form) == 1:
            one[chr(cp)] = form
        elif form:
            several[chr(cp)] = form
        else:
            gone.append(chr(cp))
    sql = text
    for c, form in several.items():
        sql = f"replace({sql}, '{c}', '{form}')"
    made = "".join(one.values()).replace("'", "''")
    return f"nfc_normalize(translate({sql}, '{''.join([*one, *gone])}', '{made}'))"


_HELD = """d AS (SELECT *, CASE WHEN row_id IS NULL THEN row_number() OVER () END AS own FROM seqcountsummary),
s AS (SELECT * FROM (SELECT run_id, segment, chunk, nullif(upper(trim(seq, ' \t')), '-') AS seq, seq_count, row_number() OVER (PARTITION BY row_id, own ORDER BY loaded_at DESC) AS o FROM d) WHERE o = 1 AND seq IS NOT NULL AND seq <> '')"""
_LOOKS = f"d AS (SELECT doc_id, text, {_look('text')} AS look FROM documents)"

SQL = {
    "p2_found": r"""WITH RECURSIVE q AS (SELECT DISTINCT run_id, CASE WHEN trim(coalesce(num_reads, ''), ' \t') = '' THEN 2000000 ELSE CAST(CAST(regexp_replace(num_reads, '[\s,_]', '', 'g') AS DOUBLE) AS BIGINT) END AS l, coalesce(overlap_reads, 0) AS o FROM qsub),
v AS (SELECT DISTINCT file_id, run_id, regexp_replace(regexp_replace(regexp_replace(read1_path, '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\./', '/', 'g') AS read1_path FROM value_extraction),
n AS (SELECT read1_path, count(DISTINCT row_idx) AS n FROM fastq_record GROUP BY 1),
f AS (SELECT v.file_id, v.read1_path, n.n, coalesce(q.l, 2000000) AS l, coalesce(q.o, 0) AS o FROM v JOIN n USING (read1_path) LEFT JOIN q USING (run_id) WHERE n.n > coalesce(q.l, 2000000)),
h AS (SELECT read1_path, row_idx, max(nullif(regexp_extract(header, '^@?(?:[^ \t|#:]*[ \t]+)?(?:[^ \t|#]*:)?([^ \t|#:]+:[^ \t|#:]+):[^ \t|#:]+:[^ \t|#:]+(?:[ \t|#]|$)', 1), '')) AS t FROM fastq_record GROUP BY 1, 2),
g AS (SELECT read1_path, row_idx, last_value(t IGNORE NULLS) OVER (PARTITION BY read1_path ORDER BY row_idx) AS t FROM h),
b AS (SELECT read1_path, row_idx, t <> lag(t) OVER (PARTITION BY read1_path ORDER BY row_idx) AS new FROM g),
k AS (SELECT read1_path, list(row_idx) AS bs FROM b WHERE new GROUP BY 1),
w AS (SELECT f.*, coalesce(k.bs, []) AS bs FROM f LEFT JOIN k USING (read1_path)),
p AS (SELECT file_id, n, l, o, bs, CAST(0 AS BIGINT) AS s, CASE WHEN n <= l THEN n ELSE coalesce(list_max(list_filter(bs, lambda x: x > o AND x <= l)), l) END AS e FROM w
  UNION ALL SELECT file_id, n, l, o, bs, e - o AS s, CASE WHEN n - (e - o) <= l THEN n ELSE coalesce(list_max(list_filter(bs, lambda x: x > e AND x <= e - o + l)), e - o + l) END AS e FROM p WHERE e < n)
SELECT file_id, s AS first_row, CAST(e - 1 AS BIGINT) AS last_row FROM p""",
    "p4_found": f"""WITH {_HELD}, c AS (SELECT run_id, segment, seq, sum(seq_count) AS cf, count(DISTINCT chunk) AS df FROM s GROUP BY ALL),
l AS (SELECT DISTINCT run_id, segment, min_num_reads, max_num_chunks FROM bccorrect), j AS (SELECT * FROM c LEFT JOIN l USING (run_id, segment))
SELECT run_id, segment, seq, 'rare' AS mark FROM j WHERE cf < coalesce(min_num_reads, 1) UNION ALL SELECT run_id, segment, seq, 'common' AS mark FROM j WHERE df > max_num_chunks""",
    "p4_ngrams": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, n, array_to_string(t[i:i + n - 1], ' ') AS ngram FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM w), (VALUES (1), (2), (3)) v(n) WHERE i + n - 1 <= len(t)),
c AS (SELECT ngram, n, count(*) AS cf, count(DISTINCT doc_id) AS df, count(*) < 5 AS rare, count(DISTINCT doc_id) * 10 > (SELECT count(*) FROM w) AS common FROM g GROUP BY ngram, n)
SELECT ngram, n, cf, df, 'rare' AS mark FROM c WHERE rare UNION ALL SELECT ngram, n, cf, df, 'common' AS mark FROM c WHERE common UNION ALL SELECT ngram, n, cf, df, 'kept' AS mark FROM c WHERE NOT rare AND NOT common""",
    "p8_found": f"WITH {_LOOKS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p8_classes": f"WITH {_LOOKS} SELECT doc_id, upper(sha256(look)) AS look FROM d WHERE look IN (SELECT look FROM d GROUP BY look HAVING count(DISTINCT text) > 1)",
    "p8_canonical": f"WITH {_LOOKS} SELECT doc_id, look AS canonical, text <> look AS changed FROM d",
    "p5_found": f"""WITH {_HELD} SELECT segment, seq FROM (SELECT segment, seq, row_number() OVER (PARTITION BY segment ORDER BY sum(seq_count) DESC, seq) AS o FROM s WHERE segment IS NOT NULL GROUP BY segment, seq) WHERE o <= 20""",
}
