"""What differs between the copies of a finding, from their token streams. For the few findings that a report shows, and a bounded sample
of their copies, so plain Python."""

from __future__ import annotations

from dataclasses import dataclass

UNNAMED = "an unnamed literal"
#: Variations that are listed, and copies that are compared, at most.
MOST_VARIATIONS, MOST_COPIES = 6, 20
#: Kinds of nodes that give something a name within a type, class or object.
NAME_HOLDERS = {"TypeMember", "Member", "Property", "EnumMember"}
#: Tokens after a name holder among which its name is looked for.
LOOK_AHEAD = 6


@dataclass(frozen=True)
class Variation:
    label: str
    values: int
    saturated: bool


def is_identifier(token: str) -> bool:
    return token.startswith("Id:")


def varying(streams: list[list[str]]) -> list[int]:
    return [i for i in range(len(streams[0])) if len({s[i] for s in streams}) > 1] if streams else []


def comparable(streams: list[list[str]]) -> bool:
    return len(streams) >= 2 and len({len(s) for s in streams}) == 1


def variations(streams: list[list[str]], copies: int | None = None, most: int = MOST_VARIATIONS) -> list[Variation]:
    """Groups of positions at which copies differ in literals, in the order of the source, by the nearest identifier before that all copies
    share; how many different tuples of values the group has. Saturated: as many as the copies compared, unless all copies were.
    Streams of different lengths can't be compared."""
    if not comparable(streams):
        return []
    at = set(varying(streams))
    groups: dict[str, list[int]] = {}
    label = UNNAMED
    for i in range(len(streams[0])):
        if i in at:
            if not any(is_identifier(s[i]) for s in streams):
                groups.setdefault(label, []).append(i)
        elif is_identifier(streams[0][i]):
            label = streams[0][i][3:]
    everything = copies is None or copies <= len(streams)
    out = []
    for label, places in list(groups.items())[:most]:
        values = len({tuple(s[i] for i in places) for s in streams})
        out.append(Variation(label, values, values == len(streams) and not everything))
    return out


def field_positions(stream: list[str]) -> list[int]:
    """Where the names of fields stand: the first identifier soon after a name holder opens, unless another one opens before."""
    out = []
    for i, token in enumerate(stream):
        if token in NAME_HOLDERS:
            for j in range(i + 1, min(i + LOOK_AHEAD, len(stream))):
                if stream[j] in NAME_HOLDERS:
                    break
                if is_identifier(stream[j]):
                    out.append(j)
                    break
    return out


def field_drift(streams: list[list[str]]) -> tuple[int, int]:
    """(varying, total) over the positions of field names; (0, 0) if streams can't be compared."""
    if not comparable(streams):
        return 0, 0
    at = set(varying(streams))
    places = field_positions(streams[0])
    return sum(p in at for p in places), len(places)
