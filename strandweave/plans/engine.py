"""From an analysed configuration to lazy plans: extraction, translation, demultiplexing and annotation of reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.model import Assignment, Call, Config, ConfigError, Lineage
from ..config.parser import is_constant
from ..functions.sequence import constant_quality, mean_quality_code, quality_ok
from ..operators import assign, correct, demux, translate, tree
from ..operators.common import broadcast_if_small, durable, once
from ..operators.counts import rank_counts, segment_counts
from ..operators.merge_pairs import merge_reads
from ..operators.segment import extract_segments
from ..sources.fastq import list_files, read_fastq, samples_of, zip_mates
from ..sources.tables import allowlist_lines, read_allowlist, read_conversion_table, read_samplesheet

CustomFunction = Callable[[DataFrame], DataFrame]
#: Prefix of the destination segments' columns in the table of translated reads.
DEST = "dest:"


class Pipeline:
    """A configuration over reads.

    `reads` (sample, header, <READ>_seq, <READ>_qual) replaces the files that the configuration names; rows without a sample are not corrected. `custom` maps a segment to the function for its
    CUSTOM_CORRECTION or BARTENDER_CORRECTION: distinct sequences (sample, raw, n) -> (sample, raw, clean), or (raw, clean) for all samples alike; it is called once. mode: `random` gives references
    in the shuffled order of fixed seeds, `ordered` in plain order. `unique`: pairs are merged only if no header occurs twice in a sample (a shuffle of all headers, which merging itself doesn't need).
    """

    def __init__(self, spark: SparkSession, config: Config, reads: DataFrame | None = None, custom: dict[str, CustomFunction] | None = None, mode: str = "random", metric: str = "osa", words: int = assign.WORDS, strict: bool = False, unique: bool = False):
        self.spark, self.config, self._reads, self.custom = spark, config, reads, custom or {}
        self.mode, self.metric, self.words, self.strict, self.unique = mode, metric, words, strict, unique
        self._maps: dict[str, DataFrame | None] = {}
        self._counts: DataFrame | None = None

    # reads and segments
    def reads(self) -> DataFrame:
        e = self.config.extraction
        rows = self._reads
        if rows is None:
            if not e.paths:
                raise ConfigError("no READ path is given")
            rows = zip_mates({r: read_fastq(self.spark, p) for r, p in e.paths.items()})
            if sheet := self.config.general.get("SAMPLESHEET"):
                sheet = read_samplesheet(self.spark, sheet)
                found = {tuple(samples_of(list_files(self.spark, p), sheet)) for p in e.paths.values()}
                if len(found) > 1:
                    raise ConfigError(f"the files of the reads are of different samples: {found}")
                named = [(k, s) for k, s in enumerate(found.pop()) if s is not None]  # one short row a file
                rows = rows.join(F.broadcast(self.spark.createDataFrame(named, "file_idx int, sample string")), "file_idx")
            else:
                rows = rows.withColumn("sample", F.lit("sample1"))
        elif "sample" not in rows.columns:
            rows = rows.withColumn("sample", F.lit("sample1"))
        return rows.withColumn("header", demux.normal_header(F.col("header")))

    def segments(self) -> DataFrame:
        """sample, header and a struct<seq, qual> for each segment, its seq null where it fails the quality filter."""
        e, rows = self.config.extraction, self.reads()
        if e.flash:
            if self.unique and not (again := rows.groupBy("sample", "header").count().where("count > 1").limit(1)).isEmpty():
                raise ConfigError(f"headers must be unique to merge reads: {again.first().header}")
            rows = merge_reads(rows, *e.flash, e.min_overlap, e.max_overlap)
        parts: dict[str, list[Column]] = {}
        for read, patterns in e.structures.items():
            seq, qual = ("merged_seq", "merged_qual") if read == "READ_FLASH" else (f"{read}_seq", f"{read}_qual")
            if seq not in rows.columns:
                raise ConfigError(f"{read} has a structure but no reads")
            before = set(rows.columns)
            prefixed = extract_segments(rows, patterns, seq, qual)
            made = [c for c in prefixed.columns if c not in before]
            again = [s for s in e.segments if s in before and any(f"?P<{s}>" in p for p in patterns)]
            if again:
                raise ConfigError(f"{', '.join(again)}: a segment has the name of a column")
            rows = prefixed.withColumnsRenamed({c: f"_{read}_{c}" for c in made})
            for c in made:
                parts.setdefault(c, []).append(F.col(f"_{read}_{c}"))
        out = rows.select("sample", "header", *[F.coalesce(*parts[s]).alias(s) for s in e.segments])
        return out.withColumns({s: self._filtered(x, F.col(s)) for s, x in e.lineages.items() if x.call("QUALITY_FILTER")})

    @staticmethod
    def _filtered(lineage: Lineage, segment: Column) -> Column:
        o = lineage.call("QUALITY_FILTER").options
        ok = quality_ok(segment["qual"], float(o["min_nucleotide_Q-score"]), float(o["min_avg_Q-score"]))
        return F.when(segment.isNotNull(), F.struct(F.when(ok, segment["seq"]).alias("seq"), segment["qual"].alias("qual")))

    # correction
    def counts(self) -> DataFrame:
        """(sample, segment, seq, n): the distinct sequences of every corrected segment, from one pass over the reads whatever the number of samples and segments; written once."""
        if self._counts is None:
            corrected = [s for s, x in self.config.extraction.lineages.items() if x.corrected]
            if not corrected:
                raise ConfigError("no segment is corrected")
            rows = once(self.segments()).select("sample", *[F.col(s)["seq"].alias(s) for s in corrected])
            self._counts = durable(segment_counts(rows, corrected, ["sample"]))
        return self._counts

    def rank_curves(self) -> DataFrame:
        """(sample, segment, seq, n, rank, log_rank) of every corrected segment: what a rank-count plot shows."""
        return rank_counts(self.counts(), by=["sample", "segment"], stored=True)

    def correction_map(self, segment: str) -> DataFrame | None:
        """(sample, raw, clean) of a corrected segment, None for others. Samples are corrected apart, but all at once."""
        if segment not in self._maps:
            lineage = self.config.extraction.lineages[segment]
            self._maps[segment] = None
            if lineage.corrected:
                counts = self.counts().where((F.col("segment") == segment) & F.col("sample").isNotNull()).select("sample", "seq", "n")
                self._maps[segment] = self._map_of(segment, lineage, counts).select("sample", "raw", "clean")
        return self._maps[segment]

    def _map_of(self, segment: str, lineage: Lineage, counts: DataFrame) -> DataFrame:
        i2m, m2a, by = lineage.call("I2M_CORRECTION"), lineage.call("M2A_CORRECTION"), ["sample"]
        if lineage.call("CUSTOM_CORRECTION") or lineage.call("BARTENDER_CORRECTION"):
            if segment not in self.custom:
                raise ConfigError(f"{segment}: give the function of its correction in `custom`")
            return correct.custom_map(counts, self.custom[segment], by)
        distance = lambda c: int(c.options["levenshtein_distance"])
        least = lambda c: int(c.options["min_num_reads"])
        if m2a:
            allowlist = read_allowlist(self.spark, m2a.options["path"])
        if i2m and m2a:
            return correct.majority_allowlist_map(counts, allowlist, i2m.options["rank"], distance(i2m), distance(m2a), self.metric, max(least(i2m), least(m2a)), by)
        if i2m:
            return correct.majority_map(counts, i2m.options["rank"], distance(i2m), self.metric, least(i2m), by)
        return correct.allowlist_map(counts, allowlist, distance(m2a), self.metric, least(m2a), by)

    def clean(self) -> DataFrame:
        """sample, header, the segments, and for each its clean sequence as clean_<segment>."""
        rows = once(self.segments())  # patterns and quality sums are not to be computed again for every use of a segment
        for s in self.config.extraction.segments:
            mapping = self.correction_map(s)
            if mapping is None:
                rows = rows.withColumn(f"clean_{s}", F.col(s)["seq"])
            else:
                m = broadcast_if_small(mapping.select(F.col("sample").alias("_s"), F.col("raw").alias("_raw"), F.col("clean").alias(f"clean_{s}")))
                rows = rows.join(m, (F.col("sample") == F.col("_s")) & (F.col(s)["seq"] == F.col("_raw")), "left").drop("_s", "_raw")
        return rows

    def extract(self) -> DataFrame:
        """The corrected table: sample, Header, and a column `segment:terminal` for each segment; missing is null (the TSV sink writes `-`)."""
        e = self.config.extraction
        return self.clean().select("sample", F.col("header").alias("Header"), *[F.col(f"clean_{s}").alias(f"{s}:{e.lineages[s].terminal}") for s in e.segments])

    # translation
    def _segments_of(self, names: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(self.config.extraction.lineage(n).segment for n in names)

    def _group(self, a: Assignment) -> tuple[str, ...]:
        group = tuple(sorted(self._segments_of(a.call.sources)))
        for s in group:
            if not self.config.extraction.lineages[s].to_value:
                raise ConfigError(f"{', '.join(a.dests)}: {s} has no value; use SEQ2VALUE")
        return group

    def value_counts(self) -> DataFrame:
        """sample, all value columns and n: the rows without a missing value, combined. Every level of the tree adds these up, so the reads are gone through once for all levels."""
        every = [f"clean_{s}" for s, x in self.config.extraction.lineages.items() if x.to_value]
        return tree.tree_counts(self.clean(), every, (), "sample")

    def value_ids(self, group: tuple[str, ...], rows: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """The value tree's level of a (combined) value with dense ids, and the columns of its ancestors. `rows`: the result of `value_counts`, if it is there."""
        e = self.config.extraction
        rows = self.value_counts() if rows is None else rows
        _, _, parent = tree.classify(e.hierarchy, [group])
        path = [f"clean_{s}" for s in tree.ancestors(group, parent)]
        counts = tree.tree_counts(rows, [f"clean_{s}" for s in group], path, "sample", "n")
        return tree.value_ids(counts, [f"clean_{s}" for s in group], path, "sample"), path

    def value_tree(self) -> DataFrame:
        """(component, sample, path, value, n, id) of every VALUE2SEQ source."""
        out, combined = [], None
        for a in self.config.translation.assignments if self.config.translation else ():
            if a.call.name == "VALUE2SEQ":
                group = self._group(a)
                combined = durable(self.value_counts()) if combined is None else combined
                ids, path = self.value_ids(group, combined)
                out.append(ids.select(F.lit("+".join(group)).alias("component"), "sample", F.array(*path).cast("array<string>").alias("path"), F.array(*[f"clean_{s}" for s in group]).alias("value"), "n", "id"))
        if not out:
            raise ConfigError("no value is translated")
        return reduce(DataFrame.unionByName, out)

    def translate(self) -> DataFrame:
        """sample, header, and <READ>_seq and <READ>_qual of each destination read. A read with a missing component in any of them is dropped from all."""
        t = self.config.translation
        if t is None:
            raise ConfigError("value_translation is missing")
        rows, parts = self._destinations()
        return self._assembled(rows, t.structures, parts, ())

    def barcode_list(self) -> DataFrame:
        """sample, Header and every destination segment of all reads; null where a read has none."""
        if self.config.translation is None:
            raise ConfigError("value_translation is missing")
        rows, parts = self._destinations()
        return rows.select("sample", F.col("header").alias("Header"), *[seq.alias(d) for d, (seq, _) in parts.items()])

    def translated(self) -> DataFrame:
        """`translate` and `barcode_list` from one pass: sample, header, the destination reads, each destination segment as DEST + its name, and `complete`, whether the read survives."""
        t = self.config.translation
        if t is None:
            raise ConfigError("value_translation is missing")
        rows, parts = self._destinations()
        made = self._reads_made(t.structures, parts)
        out = once(rows.select("sample", "header", *[c.alias(n) for n, c in made.items()], *[seq.alias(f"{DEST}{d}") for d, (seq, _) in parts.items()]))
        return out.withColumn("complete", tree.complete(list(made)))

    def size_info(self) -> DataFrame:
        """(component, sample, size): how many sequences an assignment must provide: all values over all samples (sample `all`), or the most children of one parent in a sample."""
        out, combined = [], None
        for a in self.config.translation.assignments if self.config.translation else ():
            if a.call.name == "VALUE2SEQ":
                group = self._group(a)
                combined = durable(self.value_counts()) if combined is None else combined
                ids, path = self.value_ids(group, combined)
                size = tree.size_info(ids, path, "sample" if path else None)
                out.append(size.select(F.lit("+".join(group)).alias("component"), F.col("sample") if path else F.lit("all").alias("sample"), "size"))
        if not out:
            raise ConfigError("no value is translated")
        return reduce(DataFrame.unionByName, out)

    def _destinations(self) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
        """The clean reads with what the destination segments need, and sequence and quality of each."""
        t = self.config.translation
        rows, combined = self.clean(), None
        parts: dict[str, tuple[Column, Column]] = {}
        for k, a in enumerate(t.assignments):
            if a.call.name == "VALUE2SEQ":
                combined = durable(self.value_counts()) if combined is None else combined
                rows = self._value2seq(rows, combined, a, k)
                segments = self._segments_of(a.call.sources)
                code = translate.mean_code([mean_quality_code(F.col(s)["qual"]) for s in segments])
                parts |= {d: translate.synthesized(F.col(f"dest{k}_{i}"), code) for i, d in enumerate(a.dests)}
            elif a.call.name == "SEQ2SEQ":
                table = read_conversion_table(self.spark, a.call.options["conversion_table"])
                segments = self._segments_of(a.call.sources)
                sources = {self._table_name(table, n): f"clean_{s}" for n, s in zip(a.call.sources, segments)}
                rows = translate.seq2seq(rows, table, sources, {d: f"dest{k}_{i}" for i, d in enumerate(a.dests)}, self.strict)
                code = mean_quality_code(F.concat(*[F.col(s)["qual"] for s in segments]))
                parts |= {d: translate.synthesized(F.col(f"dest{k}_{i}"), code) for i, d in enumerate(a.dests)}
            elif a.call.name == "CONSTANT":
                parts[a.dests[0]] = translate.constant(a.call.options["seq"])
            else:
                parts[a.dests[0]] = self._passed(a.call.sources[0])
        return rows, parts

    def _table_name(self, table: DataFrame, name: str) -> str:
        """The table's column of a source: by the name used in the configuration, or any other of the same lineage."""
        e = self.config.extraction
        same = [name, *[n for n, terminal in e.names.items() if terminal == e.names[name]]]
        found = next((n for n in same if n in table.columns), None)
        if found is None:
            raise ConfigError(f"the conversion table has no column {name}")
        return found

    def _passed(self, name: str) -> tuple[Column, Column]:
        segment = self.config.extraction.lineage(name).segment
        return translate.passed(F.col(f"clean_{segment}"), F.col(segment)["qual"])

    def _value2seq(self, rows: DataFrame, combined: DataFrame, a: Assignment, k: int) -> DataFrame:
        group = self._group(a)
        ids, path = self.value_ids(group, combined)
        ids = durable(ids)  # the level of the tree is numbered once, then sized and joined
        size = tree.size_info(ids, path, "sample" if path else None).agg(F.max("size")).first()[0] or 0
        rows = tree.attach_ids(rows, ids, [f"clean_{s}" for s in group], path, "sample", f"id{k}")
        references = []
        for i, dest in enumerate(self._references(a.call, size)):
            references.append((f"dest{k}_{i}", *dest))
        return assign.assign_sequences(rows, f"id{k}", references, None if len(references) == 1 else max(size, assign.COMBINATIONS))

    def _references(self, call: Call, size: int) -> list[tuple[DataFrame | list[str], int]]:
        if call.options.get("allowlist_path"):
            lists = [allowlist_lines(self.spark, p) for p in call.options["allowlist_path"].split(",")]
            return [(assign.list_reference(self.spark, x, self.mode), len(dict.fromkeys(x))) for x in lists]
        patterns = call.options["randseq_pattern"].split(",")
        if self.mode == "ordered":
            return [(assign.alphabets(p), assign.pattern_size(p)) for p in patterns]
        return [(assign.pattern_reference(self.spark, p, size, self.mode, self.words, size), min(assign.pattern_size(p), max(size, self.words))) for p in patterns]

    def _reads_made(self, structures: dict[str, tuple[str, ...]], parts: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
        made = {}
        for read, components in structures.items():
            pieces = [translate.constant(c[1:-1]) if is_constant(c) else parts[c] if c in parts else self._passed(c) for c in components]
            made[f"{read}_seq"], made[f"{read}_qual"] = translate.assembled(pieces)
        return made

    def _assembled(self, rows: DataFrame, structures: dict[str, tuple[str, ...]], parts: dict[str, tuple[Column, Column]], extra: tuple[str, ...]) -> DataFrame:
        made = self._reads_made(structures, parts)
        out = once(rows.select("sample", "header", *extra, *[c.alias(n) for n, c in made.items()]))  # the filter is not to compute the reads again
        return translate.complete_cases(out, list(made))

    # demultiplexing and annotation
    def _terminals(self, rows: DataFrame, names: tuple[str, ...]) -> list[str]:
        return [f"clean_{self.config.extraction.lineage(n).segment}" for n in names]

    def _component(self, name: str) -> tuple[Column, Column]:
        """A corrected or value segment has its mean quality throughout, another its own."""
        lineage = self.config.extraction.lineage(name)
        if lineage.corrected or lineage.to_value:
            clean = F.col(f"clean_{lineage.segment}")
            return clean, constant_quality(mean_quality_code(F.col(lineage.segment)["qual"]), clean)
        return self._passed(name)

    def demultiplex(self) -> DataFrame:
        """TSV: sample, key, Header and the target segments. FASTQ: sample, key (null without KEY), and for each read its header, sequence and quality. Keys of samples are apart."""
        d = self.config.demultiplex
        if d is None:
            raise ConfigError("demultiplex is missing")
        rows = self.clean()
        if d.format == "TSV":
            out = demux.demux_table(rows, self._terminals(rows, d.key), self._terminals(rows, d.target), sample="sample")
            return out.toDF("sample", "key", "Header", *d.target)
        return self._headed(rows, d.structures, d.header, d.key)

    def annotate(self) -> DataFrame:
        """The reads with all segments present, their headers annotated: for each read of the structures, header, sequence and quality."""
        a = self.config.annotation
        if a is None:
            raise ConfigError("annotate_header is missing")
        rows = self.clean()
        rows = rows.where(tree.complete([f"clean_{s}" for s in self.config.extraction.segments]))
        return self._headed(rows, a.structures, a.header, ())

    def _headed(self, rows: DataFrame, structures: dict[str, tuple[str, ...]], header: dict[str, tuple[str, ...]], key: tuple[str, ...]) -> DataFrame:
        named = {n: self._component(n) for components in structures.values() for n in components if not is_constant(n)}
        rows = rows.withColumn("key", demux.key_column(self._terminals(rows, key)) if key else F.lit(None).cast("string"))
        rows = rows.withColumns({f"{r}_header": demux.tagged_header(F.col("header"), self._terminals(rows, header.get(r, ()))) for r in structures})
        heads = tuple(f"{r}_header" for r in structures)
        out = self._assembled(rows, structures, named, ("key", *heads))
        return translate.complete_cases(out, [*heads, *(["key"] if key else [])])
