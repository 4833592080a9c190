"""Queries and SQL of the general data problems (1 and 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import blank_trimmed, broadcast_if_small, clean_value, table
from ..operators.heavy_keys import most_frequent_value
from ..operators.proximity import located, pairs_within, points_in_regions

MICROMETRES = 10.0
SEGMENTS = ("bc1", "bc2", "bc3", "umi")


def beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(puck, barcode, x, y) in micrometres: the located rows of s_loc on pucks with a known unit."""
    unit = table(spark, sf_dir, "puck").select("puck", "um_per_unit").distinct()
    s = table(spark, sf_dir, "s_loc").select("puck", "barcode", "x", "y").where(located(F.col("x"), F.col("y")))
    return s.join(broadcast_if_small(unit), "puck").select("puck", "barcode", (F.col("x") * F.col("um_per_unit")).alias("x"), (F.col("y") * F.col("um_per_unit")).alias("y"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(beads(spark, sf_dir), MICROMETRES).select(F.col("point_a").alias("barcode_a"), F.col("point_b").alias("barcode_b"))


def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower left triangle of each puck's bounding box as its region; the located beads in it, counted."""
    b = beads(spark, sf_dir)
    box = b.groupBy("puck").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    regions = box.select("puck", F.concat(F.col("puck"), F.lit(":low")).alias("region"), F.array(at("x0", "y0"), at("x1", "y0"), at("x0", "y1")).alias("vertices"))
    return points_in_regions(b, regions, ["barcode"], "x", "y", group="puck").groupBy("region").agg(F.count("*").alias("rows"), F.countDistinct("barcode").alias("beads"))


def segment_list(c: Column) -> Column:
    """The names of a comma-separated list, without blanks and tabs; empty parts are dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda s: F.lower(blank_trimmed(s))), lambda s: s != "")


def key_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, parts, child): the KEY segments of each demultiplexed run in order, and the segment whose parents are exactly these."""
    s = table(spark, sf_dir, "settings_demultiplex").select("run_id", segment_list(F.col("demux_key")).alias("parts")).where(F.size("parts") > 0)
    c = table(spark, sf_dir, "config_extract_value_ext").select("run_id", F.lower(blank_trimmed(F.col("child"))).alias("child"), F.array_sort(F.array_distinct(segment_list(F.col("parent")))).alias("of"))
    return s.withColumn("of", F.array_sort(F.array_distinct("parts"))).distinct().join(c.distinct(), ["run_id", "of"]).select("run_id", "parts", "child").distinct()


def keyed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, own, demux_key, child), one row for each delivery of a read with a complete key and child. `own` is a number for each row without read_id, which can't be the repeat of another."""
    slots = range(len(SEGMENTS))
    rules = key_rules(spark, sf_dir).where(F.size("parts") <= len(SEGMENTS)).select("run_id", "child", F.size("parts").alias("size"), *[F.try_element_at("parts", F.lit(i + 1)).alias(f"part{i}") for i in slots])
    reads = table(spark, sf_dir, "corrected_table").withColumn("own", F.when(F.col("read_id").isNull(), F.monotonically_increasing_id()))
    rows = reads.join(broadcast_if_small(rules), "run_id")

    def pick(name: Column) -> Column:
        value = F.lit(None).cast("string")
        for s in SEGMENTS:
            value = F.when(name == s, F.col(s)).otherwise(value)
        return value

    # CASE expressions, not array functions: this is the hot path over the largest table and stays in generated code.
    got = rows.select("read_id", "own", "size", clean_value(pick(F.col("child"))).alias("child"), *[clean_value(pick(F.col(f"part{i}"))).alias(f"k{i}") for i in slots])
    whole = sum((F.col(f"k{i}").isNotNull().cast("int") for i in slots), F.lit(0)) == F.col("size")
    return got.where(F.col("child").isNotNull() & whole).select("read_id", "own", F.concat_ws("_", *[f"k{i}" for i in slots]).alias("demux_key"), "child")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = keyed_reads(spark, sf_dir)
    once = reads.repartition("read_id", "own").distinct()  # deliveries of a read are equal but for their time
    return most_frequent_value(once, "demux_key", "child", sketch_over=reads).select("demux_key", "child")


QUERIES = {"p1_found": p1_found, "p1_regions": p1_regions, "p3_found": p3_found}

_BEADS = """b AS (SELECT DISTINCT s.puck, s.barcode, s.x * p.um_per_unit AS x, s.y * p.um_per_unit AS y FROM s_loc s JOIN (SELECT DISTINCT puck, um_per_unit FROM puck) p USING (puck)
  WHERE s.x IS NOT NULL AND s.y IS NOT NULL AND NOT isnan(s.x) AND NOT isnan(s.y) AND NOT (s.x = -9999 AND s.y = -9999))"""

SQL = {
    "p1_found": f"""WITH {_BEADS}, g AS (SELECT *, floor(x / 10) AS gx, floor(y / 10) AS gy FROM b),
h AS (SELECT g.puck, g.barcode, g.x, g.y, g.gx + d.i AS gx, g.gy + e.i AS gy FROM g, (VALUES (-1), (0), (1)) d(i), (VALUES (-1), (0), (1)) e(i))
SELECT DISTINCT g.barcode AS barcode_a, h.barcode AS barcode_b FROM g JOIN h ON g.puck = h.puck AND g.gx = h.gx AND g.gy = h.gy
WHERE g.barcode < h.barcode AND (g.x - h.x) * (g.x - h.x) + (g.y - h.y) * (g.y - h.y) <= 100""",
    "p1_regions": """WITH b AS (SELECT s.puck, s.barcode, s.x * p.um_per_unit AS x, s.y * p.um_per_unit AS y FROM s_loc s JOIN (SELECT DISTINCT puck, um_per_unit FROM puck) p USING (puck)
  WHERE s.x IS NOT NULL AND s.y IS NOT NULL AND NOT isnan(s.x) AND NOT isnan(s.y) AND NOT (s.x = -9999 AND s.y = -9999)),
m AS (SELECT puck, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM b GROUP BY puck)
SELECT concat(puck, ':low') AS region, count(*) AS rows, count(DISTINCT barcode) AS beads FROM b JOIN m USING (puck)
WHERE (x - x0) * (y1 - y0) + (y - y0) * (x1 - x0) < (x1 - x0) * (y1 - y0) GROUP BY puck""",
    "p3_found": """WITH k AS (SELECT DISTINCT run_id, list_filter(list_transform(string_split(demux_key, ','), lambda s: lower(trim(s, ' \t'))), lambda s: s <> '') AS parts FROM settings_demultiplex WHERE demux_key IS NOT NULL),
c AS (SELECT DISTINCT run_id, lower(trim(child, ' \t')) AS child, list_sort(list_filter(list_transform(string_split(parent, ','), lambda s: lower(trim(s, ' \t'))), lambda s: s <> '')) AS of FROM config_extract_value_ext),
r AS (SELECT k.run_id, k.parts, c.child FROM k JOIN c ON k.run_id = c.run_id AND list_sort(k.parts) = c.of WHERE len(k.parts) > 0),
v AS (SELECT read_id, run_id, nullif(upper(trim(bc1, ' \t')), '-') AS bc1, nullif(upper(trim(bc2, ' \t')), '-') AS bc2, nullif(upper(trim(bc3, ' \t')), '-') AS bc3, nullif(upper(trim(umi, ' \t')), '-') AS umi, CASE WHEN read_id IS NULL THEN row_number() OVER () END AS own FROM corrected_table),
w AS (SELECT DISTINCT read_id, own, list_transform(parts, lambda s: CASE s WHEN 'bc1' THEN bc1 WHEN 'bc2' THEN bc2 WHEN 'bc3' THEN bc3 WHEN 'umi' THEN umi END) AS p,
  CASE child WHEN 'bc1' THEN bc1 WHEN 'bc2' THEN bc2 WHEN 'bc3' THEN bc3 WHEN 'umi' THEN umi END AS child FROM v JOIN r USING (run_id)),
n AS (SELECT array_to_string(p, '_') AS demux_key, child, count(*) AS n FROM w WHERE child IS NOT NULL AND len(list_filter(p, lambda s: s IS NULL)) = 0 GROUP BY ALL)
SELECT demux_key, child FROM (SELECT *, row_number() OVER (PARTITION BY demux_key ORDER BY n DESC, child) AS o FROM n) WHERE o = 1""",
}
