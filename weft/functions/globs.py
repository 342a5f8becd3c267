"""Globs over slash-separated paths as regular expressions: ``*`` and ``?`` within a segment, ``**`` over segments, ``{a,b}``, ``[...]``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_of(glob: str) -> str:
    """A pattern for whole paths, in syntax that Java and Python share."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
            continue
        if c == "{" and "}" in glob[i:]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or (re.escape(c) if not c.isalnum() else c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether some glob matches the whole path; false for none. A null path matches nothing."""
    return reduce(lambda a, b: a | b, (F.coalesce(path.rlike(regex_of(g)), F.lit(False)) for g in globs), F.lit(False))
