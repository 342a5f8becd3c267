"""What a report can be asked for."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from weft.functions.hashing import hash_of

VERSION = "1"
#: (least nodes, least lines, findings) of each depth; fixed values.
DEPTHS = {1: (40, 10, 10), 2: (25, 6, 20), 3: (15, 4, 40), 4: (10, 3, 80), 5: (6, 2, 200)}
TYPES = ("include", "exclude", "only")


@dataclass(frozen=True)
class Options:
    min_nodes: int = 15
    min_lines: int = 4
    max_findings: int = 40
    granularity: str | int = "auto"
    budget_tokens: int | None = None
    max_locations: int | None = None
    include_generated: bool = False
    banner_scan: bool = True
    exclude: tuple[str, ...] = ()
    types: str = "include"
    cache: bool = True

    @classmethod
    def of_depth(cls, depth: int, **more) -> Options:
        nodes, lines, findings = DEPTHS[depth]
        return replace(cls(min_nodes=nodes, min_lines=lines, max_findings=findings), **more)

    def config_hash(self) -> str:
        """Of what decides which findings there are; not of how many are shown, nor in how many words."""
        of = [VERSION, self.min_nodes, self.min_lines, self.granularity, self.include_generated, self.banner_scan, sorted(self.exclude), self.types]
        return hash_of(json.dumps(of))[:8]

    def cap(self, section: str) -> int:
        """Findings of a section that are shown."""
        part = {"tests": 8, "types": 4}.get(section)
        return max(1, int(self.max_findings / part + 0.5)) if part else self.max_findings


class FlagError(ValueError):
    """A flag that can't be understood."""


def positive(flag: str, text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) == 0:
        raise FlagError(f"{flag} wants a positive whole number, not {text!r}")
    return int(text)


def granularity(text: str) -> str | int:
    if text in ("auto", "file", "dir"):
        return text
    try:
        return positive("--granularity", text)
    except FlagError:
        raise FlagError(f"--granularity wants auto, dir, file or a depth, not {text!r}") from None
