import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandweave.config.model import ConfigError
from strandweave.config.parser import analyse
from strandweave.plans.engine import Pipeline
from strandweave.sources.fastq import list_files, read_fastq, samples_of, write_fastq, write_table, zip_mates
from strandweave.streaming.stateless import counting_batches, stream_corrected, stream_counts, stream_keyed, stream_segments


def write(path, records):
    path.write_bytes(gzip.compress("".join(f"{h}\n{s}\n+\n{q}\n" for h, s, q in records).encode()))


def make_reads(n, seed):
    rng = random.Random(seed)
    cells = ["ACGTACGT", "TTGGCCAA", "GATTACAG"]
    out = []
    for i in range(n):
        cb, umi = cells[min(rng.randrange(5), 2)], "".join(rng.choice("AC") for _ in range(4))
        seen = cb if rng.random() < 0.8 else "G" + cb[1:]
        out.append((f"@r{seed}_{i} 1:N", seen + umi, "I" * 12, "".join(rng.choice("ACGT") for _ in range(20)), "H" * 20))
    return out


@pytest.fixture
def project(tmp_path):
    for part, seed in (("heart_L1", 1), ("liver_L1", 2)):
        reads = make_reads(120, seed)
        (tmp_path / "R1").mkdir(exist_ok=True)
        (tmp_path / "R2").mkdir(exist_ok=True)
        write(tmp_path / "R1" / f"{part}_R1.fastq.gz", [r[:3] for r in reads])
        write(tmp_path / "R2" / f"{part}_R2.fastq.gz", [(r[0], r[3], r[4]) for r in reads])
    (tmp_path / "sheet.tsv").write_text("heart_L1\theart\nliver_L1\tliver\n")
    (tmp_path / "allow.txt").write_text("ACGTACGT\nTTGGCCAA\nGATTACAG\n")
    return tmp_path


FORWARD = """[general]
PROJECT_DIR={p}
SAMPLESHEET={p}/sheet.tsv
[value_extraction]
READ1_PATH={p}/R1
READ2_PATH={p}/R2/*.fastq.gz
READ1_STRUCTURE=^(?P<cb>.{{8}})(?P<umi>.{{4}})$
READ2_STRUCTURE=^(?P<ins>.*)$
umi=CHILD_OF(cb)
cb.v=QUALITY_FILTER(source:cb) >> M2A_CORRECTION(path:{p}/allow.txt) >> SEQ2VALUE()
umi.v=SEQ2VALUE(source:umi)
[value_translation]
d1=VALUE2SEQ(source:cb.v, randseq_pattern:NNNNNN)
d2=VALUE2SEQ(source:umi.v, randseq_pattern:NNNNN)
READ1_STRUCTURE=d1+"TT"+d2
READ2_STRUCTURE=ins
[demultiplex]
FORMAT=TSV
KEY=cb
TARGET=umi.v,ins
"""


def test_files_to_translation_and_back(spark, project):
    pipe = Pipeline(spark, analyse(FORWARD.format(p=project)), words=5000)
    rows = pipe.extract().collect()
    assert len(rows) == 240 and {r.sample for r in rows} == {"heart", "liver"} and all(r["cb:cb.v"] in ("ACGTACGT", "TTGGCCAA", "GATTACAG") for r in rows)
    assert all(" " not in r.Header for r in rows)
    out = pipe.translate()
    table = {r.header: r for r in out.collect()}
    assert len(table) == 240 and all(len(r.READ1_seq) == 13 == len(r.READ1_qual) and r.READ1_seq[6:8] == "TT" for r in table.values())
    # one new sequence for each (sample, cell), and for each molecule below it: the way back is a function
    source = {r.Header: (r.sample, r["cb:cb.v"], r["umi:umi.v"]) for r in rows}
    cell, molecule = {}, {}
    for h, r in table.items():
        s, cb, umi = source[h]
        assert cell.setdefault((s, cb), r.READ1_seq[:6]) == r.READ1_seq[:6]
        assert molecule.setdefault((s, cb, umi), r.READ1_seq[8:]) == r.READ1_seq[8:]
    assert len(set(cell.values())) == len(cell)
    for s, cb in cell:
        below = [v for (a, b, _), v in molecule.items() if (a, b) == (s, cb)]
        assert len(set(below)) == len(below)
    # the way back: the new reads are written, read again and translated into values that group the reads in the same way
    for sample in ("heart", "liver"):
        write_fastq(out.where(F.col("sample") == sample).coalesce(1), str(project / "out" / sample), "header", "READ1_seq", "READ1_qual")
    again = [r for sample in ("heart", "liver") for f in (project / "out" / sample).glob("*.txt.gz") for r in gzip.open(f, "rt").read().split("\n")]
    assert sum(x.startswith("@") for x in again) == 240
    tree = pipe.value_tree().collect()
    assert {r.component for r in tree} == {"cb", "umi"} and min(r.id for r in tree) == 0
    keyed = pipe.demultiplex()
    assert keyed.columns == ["sample", "key", "Header", "umi.v", "ins.clean1"] and keyed.count() == 240
    write_table(keyed.toDF("sample", "key", "Header", "umi", "ins"), str(project / "demux"), ["sample", "key"])
    assert len(list((project / "demux").glob("sample=*/key=*"))) == 6  # the keys of two samples keep apart


def test_runner_writes_and_goes_on(spark, project):
    from strandweave.plans.runner import STAGES, run, write_stage

    pipe = Pipeline(spark, analyse(FORWARD.format(p=project)), mode="ordered")
    out = str(project / "results")
    assert run(spark, pipe, out) == ["value_extraction", "value_translation", "demultiplex"]
    assert run(spark, pipe, out) == [] and run(spark, pipe, out, ["demultiplex"], again=True) == ["demultiplex"]
    table = spark.read.csv(f"{out}/corrected_table", sep="\t", header=True)
    assert table.count() == 240 and {"Header", "cb:cb.v", "sample"} <= set(table.columns)
    assert spark.read.csv(f"{out}/barcode_list", sep="\t", header=True).where("d1 is not null and d2 is not null").count() == 240
    assert spark.read.text(f"{out}/translated_READ1", lineSep="\n").where("value like '@%'").count() == 240
    assert {p.name for p in (project / "results" / "demultiplex").glob("sample=*")} == {"sample=heart", "sample=liver"} and not list((project / "results" / "_tmp").glob("*"))
    curves = spark.read.csv(f"{out}/rank_curves", sep="\t", header=True, inferSchema=True).collect()
    for sample in ("heart", "liver"):  # ranks run within a sample
        own = sorted((r["rank"], r.n) for r in curves if r["sample"] == sample)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and sum(x[1] for x in own) == 120 and own == sorted(own, key=lambda x: -x[1])
    for stage in STAGES:
        write_stage(pipe, stage, out)
    read = lambda stage: spark.read.csv(f"{out}/{stage}", sep="\t", header=True, inferSchema=True)
    assert {tuple(r) for r in read("size_info").where("component = 'cb'").select("sample", "size").collect()} == {("all", 6)}
    assert read("value_tree").where("component = 'umi'").groupBy("sample", "path").agg(F.max("id").alias("m")).groupBy("sample").agg((F.max("m") + 1).alias("size")).exceptAll(read("size_info").where("component = 'umi'").select("sample", "size")).count() == 0
    assert read("correction_maps").where("clean in ('ACGTACGT', 'TTGGCCAA', 'GATTACAG')").count() == read("correction_maps").count() > 3 and read("segment_counts").agg(F.sum("n")).first()[0] == 240


def test_correction_takes_as_many_jobs_for_many_samples_as_for_one(spark):
    rng = random.Random(4)
    cells = ["ACGTACGT", "TTGGCCAA", "GATTACAG"]
    rows = [(f"s{i % 30}", f"@r{i}", (c := cells[min(rng.randrange(5), 2)])[: rng.randrange(1, 9)] + rng.choice("ACGT") + c[8:] if i % 9 == 0 else cells[i // 30 % 3], "I" * 8) for i in range(900)]
    text = "[value_extraction]\nREAD1_STRUCTURE=^(?P<cb>.{8})(?P<end>.*)$\ncb.c=I2M_CORRECTION(source:cb, rank:%s)"
    jobs = {}
    for rank in ("2", "auto"):
        for samples in (1, 30):
            reads = spark.createDataFrame([(f"s{int(s[1:]) % samples}", *r) for s, *r in rows], "sample string, header string, READ1_seq string, READ1_qual string")
            spark.sparkContext.setJobGroup(f"{rank}{samples}", "correction")
            made = {(r.sample, r.raw): r.clean for r in Pipeline(spark, analyse(text % rank), reads).correction_map("cb").collect()}
            jobs[rank, samples] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{rank}{samples}"))
            if rank == "2":  # each sample has a majority of its own
                assert all(len({c for (s, _), c in made.items() if s == f"s{k}"}) == 2 for k in range(samples))
        assert jobs[rank, 1] == jobs[rank, 30] > 0, jobs
    spark.sparkContext.setJobGroup("", "")


def test_functions_by_name(spark):
    from strandweave.plans.runner import named_functions

    assert named_functions(["cb=os.path:join"])["cb"].__name__ == "join" and named_functions([]) == {}
    for bad in ("cb", "cb=os", "=os:path"):
        with pytest.raises(ValueError):
            named_functions([bad])


def test_fastq_source(spark, tmp_path):
    records = [(f"@r{i}", "ACGT", "IIII") for i in range(25)]
    write(tmp_path / "a.fastq.gz", records)
    write(tmp_path / "b c%.fastq.gz", records[:7])
    (tmp_path / "notes.txt").write_text("no reads")
    got = read_fastq(spark, str(tmp_path)).collect()
    assert len(got) == 32 and {(r.file_idx, r.row_idx, r.header) for r in got} == {(0, i, f"@r{i}") for i in range(25)} | {(1, i, f"@r{i}") for i in range(7)}
    (tmp_path / "c.fastq").write_text("@x\nA\n+\nI\n")
    with pytest.raises(ValueError):
        list_files(spark, str(tmp_path))
    assert read_fastq(spark, str(tmp_path / "c.fastq")).count() == 1
    for name, text in {"d.fq": "x\nA\n+\nI\n", "e.fq": "@x\nA\n+\nI\n@y\nA\n", "f.fq": "@x\nA\n+\nI\n\n@y\nA\n+\nI\n"}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="no FASTQ record"):
            read_fastq(spark, str(tmp_path / name)).collect()
    for name, text in {"g.fq": "@x\r\nA\r\n+\r\nI\r\n", "h.fq": "@x\nA\n+\nI\n\n\n", "i.fq": "@x\nA\n+\nI"}.items():
        (tmp_path / name).write_text(text)
        assert [tuple(r)[2:] for r in read_fastq(spark, str(tmp_path / name)).collect()] == [(0, "@x", "A", "I")]
    (tmp_path / "j.fq").write_text("")
    assert read_fastq(spark, str(tmp_path / "j.fq")).count() == 0
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "none*"))


@pytest.mark.parametrize("size", [23, 64, 300])
def test_plain_files_are_split_anywhere(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for k, n in enumerate((60, 1, 33)):
        records = [(f"@r{k}_{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 40)))) for i in range(n)]
        (tmp_path / f"{k}.fastq").write_text("".join(f"{h}\n{s}\n+\n{'@' * len(s)}\n" for h, s in records))
        want += [(k, i, h, s, "@" * len(s)) for i, (h, s) in enumerate(records)]
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = read_fastq(spark, f"{tmp_path}/*.fastq")
        assert sorted(tuple(r)[1:] for r in got.collect()) == want and got.rdd.getNumPartitions() > 3
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_mates_must_be_as_many(spark):
    side = lambda n: spark.range(n).select(F.lit(0).alias("file_idx"), F.col("id").alias("row_idx"), F.concat(F.lit("@"), F.col("id")).alias("header"), F.lit("A").alias("seq"), F.lit("I").alias("qual"))
    for a, b in ((3, 4), (4, 3)):
        with pytest.raises(Exception, match="records of each file differ"):
            zip_mates({"READ1": side(a), "READ2": side(b)}).where("READ1_seq is not null and READ2_seq is not null").count()
        assert zip_mates({"READ1": side(a), "READ2": side(b)}, check=False).count() == 3
    good = zip_mates({"READ1": side(4), "READ2": side(4)})
    assert good.columns == ["file_idx", "row_idx", "READ1_seq", "READ1_qual", "READ2_seq", "READ2_qual", "header"] and good.where("READ1_seq is not null").count() == 4


def test_samples_by_file_name():
    assert samples_of(["/x_L1/b_L1_R1.fq", "/y/a_L1.fq", "/b_L1/c.fq"], {"a_L1": "s", "b_L1": "t"}) == ["t", "s", None]


def test_other_functions_of_a_configuration(spark, project):
    reads = spark.createDataFrame([(f"@r{i}", ["ACGTACGT", "ACGTACGA", "TTTTTTTT", "ACGTACGT"][i % 4] + "AC", "I" * 10) for i in range(40)], "header string, READ1_seq string, READ1_qual string")
    (project / "table.tsv").write_text("cb\tnew\nACGTACGT\tGGGG\n")
    text = """[value_extraction]
READ1_STRUCTURE=^(?P<cb>.{8})(?P<end>.*)$
cb.c=%s(source:cb%s)
[value_translation]
new=SEQ2SEQ(source:cb.c, conversion_table:%s/table.tsv)
READ1_STRUCTURE=new+"A"+end
[demultiplex]
FORMAT=FASTQ
READ1_STRUCTURE=cb+end
READ1_HEADER_ADDITION=end
[annotate_header]
READ1_STRUCTURE=end
READ1_TAG=cb
"""
    pipe = Pipeline(spark, analyse(text % ("I2M_CORRECTION", ",rank:1", project)), reads.where("READ1_seq not like 'T%'"))
    out = pipe.translate().collect()
    assert len(out) == 30 and {r.READ1_seq for r in out} == {"GGGGAAC"} and {r.READ1_qual for r in out} == {"I" * 7}
    assert {r.READ1_header.split("_")[1] for r in pipe.demultiplex().collect()} == {"AC"}
    assert {tuple(r.READ1_header.split("_")[1:]) for r in pipe.annotate().collect()} == {("ACGTACGT",)}
    custom = Pipeline(spark, analyse(text % ("CUSTOM_CORRECTION", ",shell_script:x.sh", project)), reads, custom={"cb": lambda d: d.select("raw", F.when(F.col("raw").startswith("A"), "ACGTACGT").otherwise("-").alias("clean"))})
    assert custom.translate().count() == 30
    with pytest.raises(ConfigError):
        Pipeline(spark, analyse(text % ("CUSTOM_CORRECTION", ",shell_script:x.sh", project)), reads).translate()
    with pytest.raises(ConfigError):
        Pipeline(spark, analyse("[value_extraction]\nREAD1_STRUCTURE=^(?P<cb>.*)$"), reads).translate()


def test_merged_pairs_in_the_engine(spark):
    from strandweave.operators.merge_pairs import reverse_complement

    rng = random.Random(8)
    molecules = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(20)]
    rows = [(f"@m{i}", m[:45], "I" * 45, reverse_complement(m[20:]), "I" * 40) for i, m in enumerate(molecules)] + [("@no", "A" * 45, "I" * 45, "C" * 40, "I" * 40)]
    text = "[value_extraction]\nFLASH=READ1-READ2\nFLASH_MIN_OVERLAP=15\nREAD_FLASH_STRUCTURE=^(?P<all>.*)$\nREAD1_STRUCTURE=^(?P<head>.{10})(?P<all>.*)$\nREAD2_STRUCTURE=^(?P<mate>.*)$"
    reads = spark.createDataFrame(rows, "header string, READ1_seq string, READ1_qual string, READ2_seq string, READ2_qual string")
    got = {r.header: r for r in Pipeline(spark, analyse(text), reads).clean().collect()}
    assert all(got[f"@m{i}"].clean_all == m and got[f"@m{i}"].clean_mate is None for i, m in enumerate(molecules))
    twice = spark.createDataFrame(rows + rows[:1], reads.schema)
    with pytest.raises(ConfigError, match="unique"):
        Pipeline(spark, analyse(text), twice, unique=True).clean()
    assert Pipeline(spark, analyse(text), reads, unique=True).clean().count() == 21
    assert got["@no"].clean_all == "A" * 35 and got["@no"].clean_head == "A" * 10 and got["@no"].clean_mate == "C" * 40


def test_reads_as_a_stream(spark, tmp_path):
    reads = spark.createDataFrame([(f"@r{i}", "ACGTAC" if i % 2 else "TTTTAC", "I" * 6) for i in range(40)], "header string, seq string, qual string")
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    maps = {"cb": spark.createDataFrame([("ACGT", "ACGA")], "raw string, clean string")}
    keyed = stream_keyed(stream_corrected(stream_segments(stream, ["^(?P<cb>.{4})(?P<umi>.*)$"]), maps), ["clean_cb", "umi"])
    query = keyed.writeStream.foreachBatch(counting_batches(str(tmp_path / "counts"), "key")).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in stream_counts(spark, str(tmp_path / "counts"), "key").collect()] == [("ACGA_AC", 20)]


def test_every_query_and_its_sql_fit():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and "translate_reads" in queries


THERE = """[value_extraction]
READ1_STRUCTURE=^(?P<cb>.{6})(?P<umi>.{4})$
READ2_STRUCTURE=^(?P<bio>.*)$
INDEX1_STRUCTURE=^(?P<plate>.{4})$
INDEX2_STRUCTURE=^(?P<well>.{5})$
umi=CHILD_OF(cb)
cb=CHILD_OF(well)
well=CHILD_OF(plate)
plate.v=SEQ2VALUE(source:plate)
well.v=SEQ2VALUE(source:well)
cb.v=SEQ2VALUE(source:cb)
umi.v=SEQ2VALUE(source:umi)
[value_translation]
p1,p2=VALUE2SEQ(source:plate.v, randseq_pattern:NN,NN)
w1,w2,w3=VALUE2SEQ(source:well.v, randseq_pattern:NN,NN,NN)
c1,c2=VALUE2SEQ(source:cb.v, randseq_pattern:NNN,NNN)
u1,u2=VALUE2SEQ(source:umi.v, randseq_pattern:NN,NNN)
INDEX1_STRUCTURE=w2+w3+p1+p2+"TCTC"
INDEX2_STRUCTURE=w1+bio
READ1_STRUCTURE=u1+"ATAT"+u2
READ2_STRUCTURE=c1+"CCCC"+c2
"""

BACK = """[value_extraction]
INDEX1_STRUCTURE=^(?P<w2>.{2})(?P<w3>.{2})(?P<p1>.{2})(?P<p2>.{2})TCTC$
INDEX2_STRUCTURE=^(?P<w1>.{2})(?P<bio>.*)$
READ1_STRUCTURE=^(?P<u1>.{2})ATAT(?P<u2>.{3})$
READ2_STRUCTURE=^(?P<c1>.{3})CCCC(?P<c2>.{3})$
w1,w2,w3=CHILD_OF(p1,p2)
c1,c2=CHILD_OF(w1,w2,w3)
u1,u2=CHILD_OF(c1,c2)
p1.v=SEQ2VALUE(source:p1)
p2.v=SEQ2VALUE(source:p2)
w1.v=SEQ2VALUE(source:w1)
w2.v=SEQ2VALUE(source:w2)
w3.v=SEQ2VALUE(source:w3)
c1.v=SEQ2VALUE(source:c1)
c2.v=SEQ2VALUE(source:c2)
u1.v=SEQ2VALUE(source:u1)
u2.v=SEQ2VALUE(source:u2)
[value_translation]
plate=VALUE2SEQ(source:p1.v,p2.v, randseq_pattern:NNNN)
well=VALUE2SEQ(source:w1.v,w2.v,w3.v, randseq_pattern:NNNNN)
cb=VALUE2SEQ(source:c1.v,c2.v, randseq_pattern:NNNNNN)
umi=VALUE2SEQ(source:u1.v,u2.v, randseq_pattern:NNNN)
READ1_STRUCTURE=cb+umi
READ2_STRUCTURE=bio
INDEX1_STRUCTURE=plate
INDEX2_STRUCTURE=well
"""


def test_round_trip_of_three_levels_over_four_reads(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    plates, wells, cells, umis = [word(4) for _ in range(3)], [word(5) for _ in range(4)], [word(6) for _ in range(5)], [word(4) for _ in range(12)]
    rows = []
    for i in range(1500):
        cb, umi, bio = rng.choice(cells), rng.choice(umis), word(20)
        rows.append((f"s{i % 2}", f"@r{i}", cb + umi, "I" * 10, bio, "H" * 20, rng.choice(plates), "IIII", rng.choice(wells), "IIIII"))
    names = [f"{r}_{c}" for r in ("READ1", "READ2", "INDEX1", "INDEX2") for c in ("seq", "qual")]
    first = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["sample", "header", *names]))
    there = Pipeline(spark, analyse(THERE), first, words=5000).translate()
    there.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/there")
    there = spark.read.parquet(path)
    made = {r.header: r for r in there.collect()}
    assert len(made) == 1500 and {tuple(len(r[f"{n}_seq"]) for n in ("READ1", "READ2", "INDEX1", "INDEX2")) for r in made.values()} == {(9, 10, 12, 22)}
    back = {r.header: r for r in Pipeline(spark, analyse(BACK), there.select("sample", "header", *names), words=5000).translate().collect()}
    assert len(back) == 1500
    # at every level, below the same path, the way there and back is one to one
    for level in range(1, 5):
        pairs = set()
        for r in rows:
            b = back[r[1]]
            old, new = (r[6], r[8], r[2][:6], r[2][6:]), (b.INDEX1_seq, b.INDEX2_seq, b.READ1_seq[:6], b.READ1_seq[6:])
            pairs.add(((r[0], *old[:level]), (r[0], *new[:level])))
            assert b.READ2_seq == r[4] and b.READ2_qual == r[5] and b.READ1_qual == "I" * 10
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_tools(spark, tmp_path):
    from strandweave.plans import tools

    write(tmp_path / "a.fastq.gz", [(f"@r{i} {'ACGT'[i % 4] * 3}:{i}" if i % 5 else f"@r{i}", "A", "I") for i in range(20)])
    tools.main(["header_index", "-i", str(tmp_path / "a.fastq.gz"), "-out", str(tmp_path / "out")])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/I1").collect()]
    assert len(lines) == 16 * 4 and lines[0].startswith("@r") and " " not in lines[0] and set(lines[3]) == {"?"}
    (tmp_path / "source.csv").write_text("barcode,x,y\n" + "".join(f"b{i},{i},{i % 3}\n" for i in range(9)))
    (tmp_path / "dest.csv").write_text("".join(f"d{i},{100 + 4 * i},{50 + 3 * j}\n" for i in range(3) for j in range(2)))
    tools.main(["nearest_spot", "-s", str(tmp_path / "source.csv"), "-d", str(tmp_path / "dest.csv"), "-expansion", "1", "-out", str(tmp_path / "out")])
    got = {r.bead: (r.tx, r.spot) for r in spark.read.csv(f"{tmp_path}/out/nearest_spots", sep="\t", header=True).collect()}
    assert len(got) == 9 and got["b0"] == ("0", "d0") and got["b4"] == ("0", "d1") and got["b7"][0] == "0" and got["b8"] == ("1", "d0")  # the second tile begins at 8, moved on by 2
    (tmp_path / "wells.tsv").write_text("row\tbc\n" + "A\tx\n" * 3 + "A\ty\nA\t-\nB\ty\n")
    tools.main(["well_profile", "-i", str(tmp_path / "wells.tsv"), "-well", "row", "-value", "bc", "-out", str(tmp_path / "out")])
    assert [(r["row"], r.top, r.passed) for r in spark.read.csv(f"{tmp_path}/out/well_profile", sep="\t", header=True).orderBy("row").collect()] == [("A", "x", "true"), ("B", "y", "true")]
