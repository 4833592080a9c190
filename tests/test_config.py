import pytest

from strandweave.config.model import ConfigError
from strandweave.config.parser import analyse, check_samplesheet, parse_call, read_sections
from strandweave.queries.reads import DEMULTIPLEX, TRANSLATION

EXTRACT = """[value_extraction]
READ1_STRUCTURE=^(?P<cb>.{8})(?P<umi>.{6})(?P<ins>.*)$
"""


def test_whole_configuration():
    c = analyse(TRANSLATION)
    e = c.extraction
    assert e.segments == ("cb", "insert", "umi") and e.hierarchy == ((("umi",), ("cb",)),)
    assert e.lineages["cb"].terminal == "cb.value" and [x.name for x in e.lineages["cb"].calls] == ["QUALITY_FILTER", "SEQ2VALUE"]
    assert e.lineages["cb"].call("QUALITY_FILTER").options == {"min_nucleotide_Q-score": "5", "min_avg_Q-score": "30"}
    assert e.lineages["insert"].terminal == "insert.clean1"
    assert c.translation.structures["READ1"] == ("dest_cb", "dest_umi", '"TCTC"')
    assert analyse(DEMULTIPLEX).demultiplex.header == {"READ1": ("umi.value",)}


def test_chains_by_name_equal_pipes():
    a = analyse(EXTRACT + "cb.v = QUALITY_FILTER(source: cb) >> M2A_CORRECTION(path: /x/y.txt, levenshtein_distance: 2) >> SEQ2VALUE()")
    b = analyse(EXTRACT + "cb.f = QUALITY_FILTER(source: cb)\ncb.c = M2A_CORRECTION(source: cb.f, levenshtein_distance:2, path:/x/y.txt)\ncb.v = SEQ2VALUE(source:cb.c)")
    assert [(c.name, c.options) for c in a.extraction.lineages["cb"].calls] == [(c.name, c.options) for c in b.extraction.lineages["cb"].calls]
    assert b.extraction.names["cb.f"] == b.extraction.names["cb"] == "cb.v"


def test_lines_may_go_on_and_quotes_may_be_curly():
    c = analyse(EXTRACT + "cb.v = QUALITY_FILTER(source:cb)\n  >> SEQ2VALUE()\n[value_translation]\nd = VALUE2SEQ(source:cb.v, randseq_pattern:NN)\nk=“TCTC”\nREAD1_STRUCTURE = d + k")
    assert c.translation.assignments[1].call.options == {"seq": "TCTC"}


def test_lists_in_calls():
    c = parse_call("VALUE2SEQ(source:a,b,allowlist_path:/p/1.txt,/p/2.txt)", ("VALUE2SEQ",))
    assert c.sources == ("a", "b") and c.options["allowlist_path"] == "/p/1.txt,/p/2.txt"
    assert parse_call('"ACGT"', ()).name == "CONSTANT" and parse_call("seg1", ()).name == "PASS"


def test_implied_values_of_a_hierarchy():
    e = analyse(EXTRACT + "umi = CHILD_OF(cb)\ncb.c = I2M_CORRECTION(source:cb, rank:10)").extraction
    assert e.lineages["cb"].to_value and e.lineages["umi"].to_value and not e.lineages["ins"].to_value


@pytest.mark.parametrize(
    "text",
    [
        "[unknown]\na=1",
        "[general]\nNUM_CORES=2",
        "[value_extraction]\nREAD1_PATH=/x",
        EXTRACT + "cb.x = NO_SUCH(source:cb)",
        EXTRACT + "cb.x = WHITELIST_CORRECT(source:cb)",
        EXTRACT + "cb.x = M2A_CORRECTION(source:cb)",
        EXTRACT + "cb.x = QUALITY_FILTER(source:zz)",
        EXTRACT + "cb.x = QUALITY_FILTER()",
        EXTRACT + "cb.x = QUALITY_FILTER(source:cb, colour:red)",
        EXTRACT + "cb.x = QUALITY_FILTER(source:cb, min_avg_Q-score:much)",
        EXTRACT + "cb.x = QUALITY_FILTER(source:cb)\ncb.y = SEQ2VALUE(source:cb)",
        EXTRACT + "cb.x = CUSTOM_CORRECTION(source:cb, shell_script:a.sh) >> M2A_CORRECTION(path:p)",
        EXTRACT + "cb.x = I2M_CORRECTION(source:cb, rank:first)",
        EXTRACT + "umi = CHILD_OF(zz)",
        EXTRACT + "umi = CHILD_OF(umi)",
        EXTRACT + "FLASH = READ1-READ1",
        EXTRACT + "READ_FLASH_STRUCTURE = ^(?P<m>.*)$",
        EXTRACT + "[value_translation]\nd = VALUE2SEQ(source:cb)\nREAD1_STRUCTURE=d",
        EXTRACT + "[value_translation]\na,b = VALUE2SEQ(source:cb, randseq_pattern:NN)\nREAD1_STRUCTURE=a",
        EXTRACT + "[value_translation]\nd = cb\nREAD1_STRUCTURE=d+undefined",
        EXTRACT + '[value_translation]\nd = cb\nREAD1_STRUCTURE=d+"XYZ"',
        EXTRACT + "[value_translation]\nd = cb",
        EXTRACT + "[demultiplex]\nFORMAT=CSV\nKEY=cb",
        EXTRACT + "[demultiplex]\nFORMAT=TSV",
        EXTRACT + "[demultiplex]\nFORMAT=FASTQ\nKEY=cb",
        EXTRACT + "[qsub]\nQOPTION='-l mem'",
    ],
)
def test_rejected(text):
    with pytest.raises(ConfigError):
        analyse(text)


def test_old_names_on_request():
    e = analyse(EXTRACT + "cb.x = WHITELIST_CORRECT(source:cb, path:p)", aliases=True).extraction
    assert e.lineages["cb"].calls[0].name == "M2A_CORRECTION"


def test_percent_and_comments_survive():
    assert read_sections("# note\n[general]\nPROJECT_DIR=/a%20b\n")["general"] == {"PROJECT_DIR": "/a%20b"}


def test_samplesheet_rules():
    assert check_samplesheet([("a_L1", "s"), ("b_L1", "s"), ("a_L1", "s")]) == {"a_L1": "s", "b_L1": "s"}
    for rows in ([("a", "s"), ("a", "t")], [("a", "s"), ("aa", "t")]):
        with pytest.raises(ConfigError):
            check_samplesheet(rows)
