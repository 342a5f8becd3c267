"""Small tables for what the test tables have no like of, as rows and as SQL.

A project of five packages. ``app`` has from ``api`` only what api re-exports from ``core``; ``api`` and ``core`` import each other, and
through ``api`` a ring of three runs on to ``ui``; ``types`` and ``ui`` import only types from each other in one direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: path, target, name, local, erased, binds, reexport.
BINDINGS = [
    ("app/main", "api/index", "one", "one", False, True, False),
    ("app/main", "api/index", "two", "two", False, True, False),
    ("app/side", "api/index", "one", "uno", False, True, False),
    ("app/side", "api/extra", "x", "x", False, True, False),
    ("app/side", "ui/view", None, None, False, False, False),
    ("api/index", "core/a", "*", "*", False, True, True),
    ("api/extra", "core/b", "x", "x", False, True, True),
    ("api/extra", "core/b", "y", "z", False, True, True),
    ("api/local", "core/a", "one", "one", False, True, False),
    ("api/local", "ui/view", "show", "show", False, True, False),
    ("core/a", "api/local", "help", "help", False, True, False),
    ("core/a", "core/b", "y", "y", False, True, False),
    ("core/b", "core/a", "two", "two", False, True, False),
    ("core/b", "types/t", "T", "T", True, True, False),
    ("ui/view", "core/a", "one", "one", False, True, False),
    ("ui/view", "types/t", "T", "T", True, True, False),
    ("ui/view", "types/t", "U", "U", True, True, False),
    ("ui/view", "types/t", "make", "make", False, True, False),
    ("types/t", "ui/props", "P", "P", True, True, False),
    ("ui/props", "ui/view", "show", "show", False, True, False),
]
BINDING_COLUMNS = "path string, target string, name string, local string, erased boolean, binds boolean, reexport boolean"
#: node, parent, kind, text, depth, place: two equal branches and one that differs in a leaf.
TREE = [
    (0, -1, "root", None, 0, 0), (1, 0, "call", None, 1, 0), (2, 0, "call", None, 1, 1), (3, 0, "call", None, 1, 2),
    (4, 1, "name", "f", 2, 0), (5, 1, "number", "1", 2, 1), (6, 2, "name", "f", 2, 0), (7, 2, "number", "1", 2, 1), (8, 3, "name", "f", 2, 0), (9, 3, "number", "2", 2, 1),
]
TREE_COLUMNS = "node int, parent int, kind string, text string, depth int, place int"
#: id, doc_id, start_at, end_at, words: x and y are near, z overlaps x in one document, w is far.
STREAMS = [
    ("x", 1, 0, 9, "a b c d e f g h i j k l"), ("y", 2, 0, 9, "a b c d e f g h i j k z"), ("z", 1, 5, 20, "a b c d e f g h i j k l"), ("w", 3, 0, 9, "p q r s t u v"),
    ("v", 4, 0, 5, "a b c"), ("u", 5, 0, 9, "a b c d e f g h i j m n"),
]
#: src, dst, weight, type_only, n_files: a ring of four with a short cut, and a leaf.
EDGES = [("a", "b", 5, False, 2), ("b", "c", 2, False, 1), ("c", "d", 4, False, 1), ("d", "a", 9, False, 3), ("b", "d", 1, True, 1), ("d", "e", 1, False, 1)]
#: cluster_id, copy, words: copies that differ in two literals after one name, and one after another.
COPIES = [("c", 1, "width 3 4 deep 1"), ("c", 2, "width 5 4 deep 2"), ("c", 3, "width 5 6 deep 2"), ("d", 1, "9 same x"), ("d", 2, "8 same y")]
#: Files of a small project in code.
FILES = [
    ("src/a.ts", 'import { other } from "./b";\nexport function total(rows) {\n  let sum = 0;\n  for (const row of rows) {\n    sum += row.amount * 2 + other;\n  }\n  return sum;\n}\n'),
    ("src/b.ts", 'import { total } from "./a";\nexport function weigh(items) {\n  let all = 0;\n  for (const item of items) {\n    all += item.amount * 2 + total;\n  }\n  return all;\n}\nexport const other = 1;\n'),
    ("src/c.ts", 'export function total(rows) {\n  let sum = 0;\n  for (const row of rows) {\n    sum += row.amount * 2 + other;\n  }\n  return sum;\n}\n'),
]


def frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def values(rows: list[tuple], columns: str) -> str:
    """The rows as a SQL relation with these columns."""

    def literal(x: object) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names}))"
