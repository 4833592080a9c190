"""Reads and analyses configurations: sections of `name = value`, functions chained by `>>`, read structures joined by `+`."""

from __future__ import annotations

import configparser
import re
from pathlib import Path

from .model import Annotation, Assignment, Call, Config, ConfigError, Demultiplex, Extraction, Lineage, Translation

READS = ("READ1", "READ2", "INDEX1", "INDEX2")
# The words of the configuration language.
SECTIONS = ("general", "value_extraction", "value_translation", "demultiplex", "annotate_header", "qsub")
EXTRACT = ("QUALITY_FILTER", "PASS", "I2M_CORRECTION", "M2A_CORRECTION", "BARTENDER_CORRECTION", "CUSTOM_CORRECTION", "SEQ2VALUE")
TRANSLATE = ("SEQ2SEQ", "VALUE2SEQ", "PASS", "CONSTANT")
OPTIONS = {
    "QUALITY_FILTER": ({"min_nucleotide_Q-score": "5", "min_avg_Q-score": "20"}, ()),
    "PASS": ({}, ()),
    "I2M_CORRECTION": ({"rank": "auto", "levenshtein_distance": "1", "min_num_reads": "1"}, ()),
    "M2A_CORRECTION": ({"path": None, "levenshtein_distance": "1", "min_num_reads": "1"}, ("path",)),
    "BARTENDER_CORRECTION": ({"-c": None, "-d": None, "-z": None, "-l": None, "-s": None}, ()),
    "CUSTOM_CORRECTION": ({"shell_script": None}, ("shell_script",)),
    "SEQ2VALUE": ({}, ()),
    "SEQ2SEQ": ({"conversion_table": None}, ("conversion_table",)),
    "VALUE2SEQ": ({"allowlist_path": None, "randseq_pattern": None}, ()),
    "CONSTANT": ({"seq": None}, ("seq",)),
}
LISTS = ("source", "allowlist_path", "randseq_pattern")
#: Old names of functions and options, for configurations written for earlier versions.
ALIASES = {"WHITELIST_CORRECT": "M2A_CORRECTION", "WHITELIST_CORRECTION": "M2A_CORRECTION", "KNEE_CORRECT": "I2M_CORRECTION"}
OPTION_ALIASES = {"whitelist_path": "allowlist_path"}


def read_sections(text: str) -> dict[str, dict[str, str]]:
    """Sections with their values, names in their case, white space removed from values (but in QOPTION, which loses its quotes)."""
    p = configparser.RawConfigParser(strict=False, delimiters=("=",), comment_prefixes=("#", ";"), empty_lines_in_values=True)
    p.optionxform = str  # type: ignore[assignment, method-assign]
    try:
        p.read_string(text)
    except configparser.Error as e:
        raise ConfigError(str(e)) from e
    out: dict[str, dict[str, str]] = {}
    for section in p.sections():
        if section not in SECTIONS:
            raise ConfigError(f"unknown section {section}")
        values = {}
        for name, value in p.items(section):
            value = (value or "").translate(str.maketrans("“”„‘’", "\"\"\"''"))
            values[re.sub(r"\s", "", name)] = value.strip().strip("\"'") if name == "QOPTION" else re.sub(r"\s", "", value)
        out[section] = values
    return out


def parse_call(text: str, allowed: tuple[str, ...], aliases: bool = False) -> Call:
    """`NAME(option:value,...)`; a value without a name goes on with the list before it. A quoted literal is CONSTANT, a bare name PASS."""
    if m := re.fullmatch(r"([\"'])(.*)\1", text):
        return Call("CONSTANT", (), {"seq": m[2]})
    m = re.fullmatch(r"([A-Za-z0-9_]+)\((.*)\)", text)
    if m is None:
        if re.fullmatch(r"[\w.\-]+", text):
            return Call("PASS", (text,))
        raise ConfigError(f"can't read {text!r}")
    name, body = m[1], m[2]
    if aliases:
        name = ALIASES.get(name, name)
    if name not in allowed:
        raise ConfigError(f"unknown function {name}")
    values: dict[str, list[str]] = {}
    last = None
    for part in filter(None, body.split(",")):
        option, colon, value = part.partition(":")
        if aliases:
            option = OPTION_ALIASES.get(option, option)
        if colon and (option == "source" or option in OPTIONS[name][0]):
            if option in values:
                raise ConfigError(f"{name}: {option} is given twice")
            values[option], last = [value], option
        elif colon and (last not in LISTS or re.fullmatch(r"-?[A-Za-z_][\w-]*", option)):
            raise ConfigError(f"{name} has no option {option}")
        elif last in LISTS:
            values[last].append(part)
        else:
            raise ConfigError(f"{name}: can't read {part!r}")
    sources = tuple(values.pop("source", []))
    defaults, required = OPTIONS[name]
    given = {k: ",".join(v) for k, v in values.items()}
    if missing := [k for k in required if not given.get(k)]:
        raise ConfigError(f"{name} needs {', '.join(missing)}")
    return Call(name, sources, {k: v for k, v in (defaults | given).items() if v is not None})


def _structures(section: dict[str, str], names: tuple[str, ...] = READS) -> dict[str, list[str]]:
    """Structures by read, alternatives in the order of their numbers."""
    out: dict[str, list[tuple[int, str]]] = {}
    for key, value in section.items():
        if (m := re.fullmatch(rf"({'|'.join(names)})_STRUCTURE(?:_(\d+))?", key)) and value:
            out.setdefault(m[1], []).append((int(m[2] or 0), value))
    return {k: [v for _, v in sorted(x, key=lambda y: y[0])] for k, x in out.items()}


def _is_setting(key: str) -> bool:
    return bool(re.fullmatch(r"(READ[12]|INDEX[12]|READ_FLASH)_(PATH|STRUCTURE(_\d+)?|HEADER_ADDITION|TAG)|FLASH(_MIN_OVERLAP|_MAX_OVERLAP)?|NUM_CORES|CHUNK_SIZE|SPLIT_CHUNKSIZE|FORCE|FORMAT|KEY|TARGET", key))


def _extraction(section: dict[str, str], aliases: bool) -> Extraction:
    structures = {k: tuple(v) for k, v in _structures(section, (*READS, "READ_FLASH")).items()}
    segments = tuple(sorted({s for patterns in structures.values() for p in patterns for s in re.findall(r"\?P<(\w+)>", p)}))
    if not segments:
        raise ConfigError("no structure defines a segment")
    statements: dict[str, list[Call]] = {}
    hierarchy = []
    for key, value in section.items():
        if _is_setting(key):
            continue
        if m := re.fullmatch(r"CHILD_OF\((.*)\)", value):
            children, parents = (tuple(sorted(filter(None, x.split(",")))) for x in (key, m[1]))
            if unknown := set(children + parents) - set(segments):
                raise ConfigError(f"CHILD_OF: {', '.join(sorted(unknown))} is no segment")
            if not parents or set(children) & set(parents):
                raise ConfigError(f"CHILD_OF: {key} can't be the child of {m[1]}")
            hierarchy.append((children, parents))
            continue
        calls = [parse_call(c, EXTRACT, aliases) for c in value.split(">>")]
        if not calls[0].sources:
            raise ConfigError(f"{key}: the first function needs a source")
        if len(calls[0].sources) != 1 or any(c.sources and c.sources != calls[0].sources for c in calls[1:]):
            raise ConfigError(f"{key}: a chain has one source")
        statements[key] = calls

    def chain(name: str, seen: tuple[str, ...] = ()) -> tuple[str, list[Call]]:
        """The segment that a result comes from, and all functions on the way."""
        source = statements[name][0].sources[0]
        if source in segments:
            return source, statements[name]
        if source not in statements or source in seen:
            raise ConfigError(f"{name}: source {source} is not defined")
        segment, calls = chain(source, (*seen, name))
        return segment, calls + statements[name]

    used = {calls[0].sources[0] for calls in statements.values()}
    lineages: dict[str, Lineage] = {}
    names: dict[str, str] = {}
    in_tree = {s for pair in hierarchy for group in pair for s in group}
    for name in statements:
        if name in used:
            continue
        segment, calls = chain(name)
        if segment in lineages:
            raise ConfigError(f"{segment} has two results, {lineages[segment].terminal} and {name}")
        _check_chain(name, calls)
        if segment in in_tree and not any(c.name == "SEQ2VALUE" for c in calls):
            calls = [*calls, Call("SEQ2VALUE")]
        lineages[segment] = Lineage(segment, name, tuple(calls))
    for name in statements:
        segment, _ = chain(name)
        if segment not in lineages:
            raise ConfigError(f"{name} leads to no result")
        names[name] = lineages[segment].terminal
    for k, segment in enumerate(s for s in segments if s not in lineages):
        lineages[segment] = Lineage(segment, f"{segment}.clean{k + 1}", (Call("SEQ2VALUE" if segment in in_tree else "PASS", (segment,)),))
    for segment, lineage in lineages.items():
        names[segment] = names[lineage.terminal] = lineage.terminal

    flash = None
    if pair := section.get("FLASH"):
        reads = pair.split("-")
        if len(reads) != 2 or reads[0] == reads[1] or set(reads) - set(READS):
            raise ConfigError(f"FLASH can't merge {pair}")
        flash = (reads[0], reads[1])
    if "READ_FLASH" in structures and flash is None:
        raise ConfigError("READ_FLASH_STRUCTURE needs FLASH")
    paths = {r: section[f"{r}_PATH"] for r in READS if section.get(f"{r}_PATH")}
    try:
        overlaps = int(section.get("FLASH_MIN_OVERLAP") or 20), int(section.get("FLASH_MAX_OVERLAP") or 30)
    except ValueError as e:
        raise ConfigError("FLASH overlaps must be whole numbers") from e
    return Extraction(paths, structures, flash, *overlaps, segments, tuple(hierarchy), lineages, names)


def _check_chain(name: str, calls: list[Call]) -> None:
    kinds = [c.name for c in calls]
    for kind in ("BARTENDER_CORRECTION", "CUSTOM_CORRECTION"):
        if kind in kinds and sum(k.endswith("_CORRECTION") for k in kinds) > 1:
            raise ConfigError(f"{name}: {kind} excludes other corrections")
    if "PASS" in kinds and len(kinds) > 1:
        raise ConfigError(f"{name}: PASS excludes other functions")
    if repeated := {k for k in kinds if kinds.count(k) > 1}:
        raise ConfigError(f"{name}: {', '.join(sorted(repeated))} occurs twice")
    for c in calls:
        for option in ("levenshtein_distance", "min_num_reads", "min_nucleotide_Q-score", "min_avg_Q-score"):
            if option in c.options:
                try:
                    float(c.options[option])
                except ValueError as e:
                    raise ConfigError(f"{name}: {option} is no number") from e
        if c.name == "I2M_CORRECTION" and c.options["rank"] != "auto" and not c.options["rank"].isdigit():
            raise ConfigError(f"{name}: rank is neither auto nor a number")


def _components(structure: str, known: set[str], what: str) -> tuple[str, ...]:
    out = tuple(structure.split("+"))
    for c in out:
        if m := re.fullmatch(r"([\"'])(.*)\1", c):
            if not re.fullmatch(r"[ATGCN]+", m[2]):
                raise ConfigError(f"{what}: constant {c} may have the letters ATGCN")
        elif c not in known:
            raise ConfigError(f"{what}: {c} is not defined")
    return out


def is_constant(component: str) -> bool:
    return component[:1] in "\"'"


def _translation(section: dict[str, str], e: Extraction, aliases: bool) -> Translation:
    assignments = []
    for key, value in section.items():
        if _is_setting(key):
            continue
        dests = tuple(filter(None, key.split(",")))
        call = parse_call(value, TRANSLATE, aliases)
        if call.name != "CONSTANT" and not call.sources:
            raise ConfigError(f"{key}: {call.name} needs a source")
        if unknown := [s for s in call.sources if s not in e.names]:
            raise ConfigError(f"{key}: {', '.join(unknown)} is not defined")
        if call.name == "VALUE2SEQ":
            given = call.options.get("allowlist_path") or call.options.get("randseq_pattern")
            if not given:
                raise ConfigError(f"{key}: VALUE2SEQ needs allowlist_path or randseq_pattern")
            if len(given.split(",")) != len(dests):
                raise ConfigError(f"{key}: {len(dests)} destinations but {len(given.split(','))} references")
        elif call.name in ("PASS", "CONSTANT") and len(dests) != 1:
            raise ConfigError(f"{key}: {call.name} makes one destination")
        assignments.append(Assignment(dests, call))
    known = {d for a in assignments for d in a.dests}
    structures = {}
    for read, alternatives in _structures(section).items():
        if len(alternatives) != 1:
            raise ConfigError(f"{read} has several destination structures")
        # a source segment may stand in a destination structure by itself
        structures[read] = _components(alternatives[0], known | set(e.names), f"{read}_STRUCTURE")
    if not structures:
        raise ConfigError("value_translation needs a read structure")
    return Translation(tuple(assignments), structures)


def _headers(section: dict[str, str], e: Extraction) -> dict[str, tuple[str, ...]]:
    out = {}
    for read in READS:
        value = section.get(f"{read}_HEADER_ADDITION") or section.get(f"{read}_TAG")
        if value:
            out[read] = _terminals(value, e, f"{read}_HEADER_ADDITION")
    return out


def _terminals(value: str, e: Extraction, what: str) -> tuple[str, ...]:
    names = tuple(filter(None, value.split(",")))
    if unknown := [n for n in names if n not in e.names]:
        raise ConfigError(f"{what}: {', '.join(unknown)} is not defined")
    return tuple(e.names[n] for n in names)


def _read_structures(section: dict[str, str], e: Extraction) -> dict[str, tuple[str, ...]]:
    out = {}
    for read, alternatives in _structures(section).items():
        parts = _components(alternatives[0], set(e.names), f"{read}_STRUCTURE")
        out[read] = tuple(p if is_constant(p) else e.names[p] for p in parts)
    return out


def analyse(text: str, aliases: bool = False) -> Config:
    """The analysed configuration. With `aliases` old names of functions and options are understood."""
    s = read_sections(text)
    if "value_extraction" not in s:
        raise ConfigError("value_extraction is missing")
    e = _extraction(s["value_extraction"], aliases)
    translation = _translation(s["value_translation"], e, aliases) if "value_translation" in s else None
    demultiplex = annotation = None
    if "demultiplex" in s:
        d = s["demultiplex"]
        kind = d.get("FORMAT", "")
        if kind not in ("FASTQ", "TSV"):
            raise ConfigError("demultiplex: FORMAT must be FASTQ or TSV")
        key = _terminals(d.get("KEY", ""), e, "KEY")
        if kind == "TSV" and not key:
            raise ConfigError("demultiplex: TSV needs KEY")
        target = _terminals(d.get("TARGET", ""), e, "TARGET") or tuple(sorted(x.terminal for x in e.lineages.values()))
        demultiplex = Demultiplex(kind, key, target, _read_structures(d, e), _headers(d, e))
        if kind == "FASTQ" and not demultiplex.structures:
            raise ConfigError("demultiplex: FASTQ needs a read structure")
    if "annotate_header" in s:
        annotation = Annotation(_read_structures(s["annotate_header"], e), _headers(s["annotate_header"], e))
    qsub = s.get("qsub", {})
    if "QOPTION" in qsub and not ("<mem>" in qsub["QOPTION"] and "<num_cores>" in qsub["QOPTION"]):
        raise ConfigError("QOPTION must contain <mem> and <num_cores>")
    general = {"NUM_CORES": "1"} | s.get("general", {})
    if "general" in s and "PROJECT_DIR" not in general:
        raise ConfigError("general: PROJECT_DIR is missing")
    return Config(general, e, translation, demultiplex, annotation, qsub)


def load(path: str, aliases: bool = False) -> Config:
    return analyse(Path(path).read_text(encoding="utf-8"), aliases)


def check_samplesheet(rows: list[tuple[str, str]]) -> dict[str, str]:
    """Prefix -> sample. A prefix may serve one sample only, and none may be found in another."""
    out: dict[str, str] = {}
    for prefix, sample in rows:
        if out.get(prefix, sample) != sample:
            raise ConfigError(f"prefix {prefix} serves two samples")
        out[prefix] = sample
    for a in out:
        for b in out:
            if a != b and re.search(re.escape(a), b):
                raise ConfigError(f"prefix {a} is part of prefix {b}")
    return out
