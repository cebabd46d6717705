"""Options of a deduplication, parsed and checked on the driver before any job starts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

METHODS = ("highest_count", "adjacency", "directional")
METRICS = ("hamming", "levenshtein")
DEFAULT_PREFIX = "collapsed_R"
DEFAULT_OFFSET = 33
DEFAULT_DISTANCE = 1
DEFAULT_ERROR_RATE = 0.001


#: One file's slice: a stop by itself, or start and stop with an optional step.  A bound is an integer, or open (nothing, or the word None).
_BOUND = r"\s*(?:None|[+-]?\d+)?\s*"
_SLICE = re.compile(rf"(?P<only>{_BOUND})|(?P<start>{_BOUND}):(?P<stop>{_BOUND})(?::(?P<step>{_BOUND}))?")


def _slice(written: str) -> slice:
    found = _SLICE.fullmatch(written)
    if found is None:
        if written.count(":") > 2:
            raise TypeError(f"{written!r} has more than a start, a stop and a step")
        raise ValueError(f"{written!r} is no slice: its parts are integers or left open")
    bounds = {name: None if (value or "").strip() in ("", "None") else int(value) for name, value in found.groupdict().items()}
    return slice(bounds["only"]) if found["only"] is not None else slice(bounds["start"], bounds["stop"], bounds["step"])


def parse_slices(text: str) -> list[slice]:
    """Slices written as in Python, one for each file, with commas between files; `8` means the first eight.

    A part that is no integer raises ValueError, more than three parts raise TypeError.
    """
    return list(map(_slice, text.split(",")))


def output_names(count: int, given: list[str] | None = None, prefix: str = DEFAULT_PREFIX) -> list[str]:
    return list(given) if given else [f"{prefix}{i}.fastq.gz" for i in range(1, count + 1)]


@dataclass(frozen=True)
class DedupOptions:
    """max_distance is inclusive; an error rate of 1 or more turns the quality filter and its checks off."""

    slices: tuple[slice, ...] | None = None
    max_distance: int = DEFAULT_DISTANCE
    metric: str = "hamming"
    method: str = "directional"
    max_error_rate: float = DEFAULT_ERROR_RATE
    phred_offset: int = DEFAULT_OFFSET
    inputs: tuple[str, ...] = field(default=())
    outputs: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.max_distance < 0:
            raise ValueError("max_distance must not be negative")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if not 0 <= self.phred_offset <= 126:
            raise ValueError("phred_offset must be from 0 to 126")
        if self.inputs and self.outputs and len(self.inputs) != len(self.outputs):
            raise ValueError(f"{len(self.inputs)} input files need as many output files, not {len(self.outputs)}")
        if self.inputs and self.slices is not None and len(self.slices) != len(self.inputs):
            raise ValueError(f"{len(self.inputs)} input files need as many slices, not {len(self.slices)}")
        for s in self.slices or ():
            if s.step == 0:
                raise ValueError("a slice's step must not be 0")

    @property
    def filters(self) -> bool:
        return self.max_error_rate < 1.0
