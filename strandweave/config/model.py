"""The analysed form of a configuration: plain frozen data, no Spark."""

from __future__ import annotations

from dataclasses import dataclass, field


class ConfigError(ValueError):
    """A configuration that cannot be run; the message names the statement."""


@dataclass(frozen=True)
class Call:
    """One function with its options; sources are names of segments or of earlier results."""

    name: str
    sources: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Lineage:
    """All that happens to one segment: the functions in order, and the name of the result."""

    segment: str
    terminal: str
    calls: tuple[Call, ...]

    @property
    def to_value(self) -> bool:
        return any(c.name == "SEQ2VALUE" for c in self.calls)

    @property
    def corrected(self) -> bool:
        return any(c.name.endswith("_CORRECTION") for c in self.calls)

    def call(self, name: str) -> Call | None:
        return next((c for c in self.calls if c.name == name), None)


@dataclass(frozen=True)
class Extraction:
    paths: dict[str, str]
    structures: dict[str, tuple[str, ...]]  # READ1, READ2, INDEX1, INDEX2, READ_FLASH -> patterns, tried in order
    flash: tuple[str, str] | None
    min_overlap: int
    max_overlap: int
    segments: tuple[str, ...]
    hierarchy: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]  # (children, parents), each sorted
    lineages: dict[str, Lineage]  # by segment
    names: dict[str, str]  # every name of a segment or an intermediate result -> terminal

    def lineage(self, name: str) -> Lineage:
        """The lineage that a segment's, an intermediate or a terminal name belongs to."""
        terminal = self.names.get(name)
        if terminal is None:
            raise ConfigError(f"{name} is not defined")
        return next(x for x in self.lineages.values() if x.terminal == terminal)


@dataclass(frozen=True)
class Assignment:
    """Destination segments with the function that makes them: VALUE2SEQ, SEQ2SEQ, PASS or CONSTANT."""

    dests: tuple[str, ...]
    call: Call


@dataclass(frozen=True)
class Translation:
    assignments: tuple[Assignment, ...]
    structures: dict[str, tuple[str, ...]]  # read -> components; constants keep their quotes


@dataclass(frozen=True)
class Demultiplex:
    format: str
    key: tuple[str, ...]
    target: tuple[str, ...]
    structures: dict[str, tuple[str, ...]]
    header: dict[str, tuple[str, ...]]


@dataclass(frozen=True)
class Annotation:
    structures: dict[str, tuple[str, ...]]
    header: dict[str, tuple[str, ...]]


@dataclass(frozen=True)
class Config:
    general: dict[str, str]
    extraction: Extraction
    translation: Translation | None = None
    demultiplex: Demultiplex | None = None
    annotation: Annotation | None = None
    qsub: dict[str, str] = field(default_factory=dict)
