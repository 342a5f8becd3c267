"""Front end for source code in the syntax of ECMAScript and its typed dialect: a fragment for each node of a light syntax tree, and the
imports of each file. Python scans; it runs in Arrow batches, a file at a time.

The tree follows brackets, commas and statements, not the full grammar: a statement is named by its leading keywords, a bracket
by what stands before it. Leaves are identifiers and literals. It is enough for what the engine asks of a tree: equal
code gives equal streams, renamed identifiers give equal streams after renaming, and nesting is nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from weft.functions.hashing import hash_of

#: Kinds that never become fragments, though their tokens count within parents.
IGNORED = {"Import", "Export", "ExportAssignment", "Specifiers", "Specifier", "Pattern", "PatternElement", "Parameters", "Parameter"}
#: Kinds that describe types.
TYPE_KINDS = {"Interface", "TypeAlias", "TypeLiteral", "TypeMember", "TypeArguments"}
#: Names that differ between versions of the front end, by what they are called now.
ALIASES = {"Function": "FunctionDeclaration", "Class": "ClassDeclaration", "Interface": "InterfaceDeclaration", "TypeAlias": "TypeAliasDeclaration", "Enum": "EnumDeclaration", "Variable": "VariableStatement"}

TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>\"(?:\\(?s:.)|[^\"\\\n])*\"?|'(?:\\(?s:.)|[^'\\\n])*'?)"
    r"|(?P<template>`(?:\\(?s:.)|[^`\\])*`?)|(?P<number>\d[\w.]*)|(?P<word>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>=>|\.\.\.|\?\.|[=!<>+\-*/%&|^]=+|&&|\|\||\?\?|.)",
    re.DOTALL,
)
LITERALS = {"string": "String", "template": "Template", "number": "Number"}
CLOSING = {"(": ")", "[": "]", "{": "}"}
#: Words that name the kind of a statement, behind any of the modifiers.
MODIFIERS = {"export", "default", "async", "declare", "abstract", "public", "private", "protected", "static", "readonly"}
NAMED = {"function": "Function", "class": "Class", "interface": "Interface", "enum": "Enum", "namespace": "Namespace", "module": "Namespace", "const": "Variable", "let": "Variable", "var": "Variable"}
KEYWORDS = {"if": "If", "for": "For", "while": "While", "do": "Do", "switch": "Switch", "try": "Try", "return": "Return", "throw": "Throw", "case": "Case", "break": "Break", "continue": "Continue"}
RESERVED = MODIFIERS | set(NAMED) | set(KEYWORDS) | {"import", "from", "as", "type", "extends", "implements", "new", "else", "catch", "finally", "of", "in", "typeof", "instanceof", "await", "yield", "void", "delete"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    text: str | None = None


def tokens(source: str) -> list[Token]:
    return [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(source) if m.lastgroup not in ("space", "comment")]


class Parser:
    """Nodes of a file. Brackets that don't match end where the file or an outer bracket ends."""

    def __init__(self, source: str) -> None:
        self.source, self.tokens, self.at = source, tokens(source), 0

    def peek(self, k: int = 0) -> Token | None:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else None

    def file(self) -> Node:
        root = Node("File", 0, len(self.source))
        while self.peek():
            before = self.at
            if statement := self.statement(None):
                root.children.append(statement)
            if self.at == before:  # a bracket without an opening one
                self.at += 1
        return root

    def statement(self, closing: str | None) -> Node | None:
        first = self.peek()
        node = Node(self.statement_kind(), first.start, first.end)
        lead = [t.text for t in self.tokens[self.at : self.at + 6]]
        previous = None
        while (t := self.peek()) and t.text != closing:
            if t.text == ";":
                node.end = t.end
                self.at += 1
                break
            if previous and self.breaks(node, previous, t):
                break
            if t.text in (")", "]", "}"):
                break
            if child := self.item(node, previous):
                node.children.append(child)
            previous = self.tokens[self.at - 1]
            node.end = previous.end
        if node.kind == "Export" and "{" not in lead and "*" not in lead:
            node.kind = "ExportAssignment"
        return node if node.children or node.kind not in ("Expression",) else None

    def statement_kind(self) -> str:
        k = 0
        seen = []
        while (t := self.peek(k)) and t.text in MODIFIERS:
            seen.append(t.text)
            k += 1
        word, after = t.text if t else "", self.peek(k + 1)
        if word == "import" and not seen and (after is None or after.text not in ("(", ".")):
            return "Import"
        if word in NAMED and not (word == "module" and (after is None or after.kind not in ("word", "string"))):
            return "Enum" if word == "const" and after and after.text == "enum" else NAMED[word]
        if word == "type" and after and after.kind == "word" and (nxt := self.peek(k + 2)) and nxt.text in ("=", "<"):
            return "TypeAlias"
        if seen[:1] == ["export"]:
            return "Export"
        return KEYWORDS.get(word, "Expression")

    def breaks(self, node: Node, previous: Token, t: Token) -> bool:
        """Whether a statement ends before t, without a semicolon."""
        if "\n" not in self.source[previous.end : t.start]:
            return False
        if previous.text == "}" and node.kind in ("Function", "Class", "Interface", "Enum", "Namespace", "If", "For", "While", "Switch", "Try"):
            return t.text not in ("else", "catch", "finally", "while")
        goes_on = previous.kind == "sign" and previous.text not in (")", "]", "}") or t.kind == "sign" and t.text not in ("(", "[", "{", "@")
        return not goes_on and not (previous.text in RESERVED and previous.text not in ("return", "break", "continue"))

    def item(self, parent: Node, previous: Token | None) -> Node | None:
        """A leaf, or a bracket with what is in it; None for a sign or keyword."""
        t = self.peek()
        if t.text in CLOSING:
            return self.group(parent, previous)
        self.at += 1
        if t.kind in LITERALS:
            return Node(LITERALS[t.kind], t.start, t.end, text=t.text)
        if t.kind == "word" and t.text not in RESERVED:
            return Node("Identifier", t.start, t.end, text=t.text)
        return None

    def group(self, parent: Node, previous: Token | None) -> Node:
        opening = self.peek()
        closing = CLOSING[opening.text]
        kind, part = self.group_kind(parent, previous, opening.text)
        node = Node(kind, opening.start, opening.end)
        self.at += 1
        while (t := self.peek()) and t.text != closing:
            before = self.at
            if t.text in (")", "]", "}"):  # belongs to an outer bracket
                return node
            child = self.statement(closing) if part is None else self.element(part, closing)
            if child:
                node.children.append(child)
            if self.at == before:
                self.at += 1
            node.end = self.tokens[self.at - 1].end
        if t:
            node.end = t.end
            self.at += 1
        return node

    def group_kind(self, parent: Node, previous: Token | None, opening: str) -> tuple[str, str | None]:
        """The kind of a bracket, and of its elements (None: statements)."""
        before = previous.text if previous else ""
        if parent.kind in ("Import", "Export") and opening == "{":
            return "Specifiers", "Specifier"
        if opening == "(":
            return ("Parameters", "Parameter") if parent.kind == "Function" and before not in ("=", "=>") and not any(c.kind == "Parameters" for c in parent.children) else ("Arguments", "Argument")
        if opening == "[":
            return ("Array", "Element") if parent.kind != "Variable" or parent.children else ("Pattern", "PatternElement")
        if parent.kind in ("Interface", "TypeAlias"):
            return "TypeLiteral", "TypeMember"
        if parent.kind == "Enum":
            return "EnumBody", "EnumMember"
        if parent.kind == "Variable" and not parent.children:
            return "Pattern", "PatternElement"
        if parent.kind == "Class":
            return "ClassBody", "Member"
        if before in ("=", "(", ",", ":", "?", "return", "[", "??", "||", "&&", "...") or parent.kind == "Argument" and before not in (")", "=>"):
            return "Object", "Property"
        return "Block", None

    def element(self, kind: str, closing: str) -> Node | None:
        first = self.peek()
        node, previous, ends = Node(kind, first.start, first.end), None, {"Member": ";", "TypeMember": ";,"}.get(kind, ",")
        while (t := self.peek()) and t.text != closing and t.text not in (")", "]", "}"):
            if t.text in ends:
                self.at += 1
                break
            if kind in ("Member", "TypeMember") and previous and "\n" in self.source[previous.end : t.start] and (previous.text == "}" or t.kind == "word" and previous.kind != "sign" or t.text == "@"):
                break
            if child := self.item(node, previous):
                node.children.append(child)
            previous = self.tokens[self.at - 1]
            node.end = previous.end
        return node if node.children else None


def fragment_rows(source: str, least_nodes: int = 1, least_lines: int = 0) -> list[tuple]:
    """(seq, kind, node_count, start, end, line, end_line, parent_id, literal_share, tokens_l0, tokens_l1) of every fragment, in post-order.
    parent_id counts nodes in pre-order, -1 at the top."""
    line_starts = [0, *(m.end() for m in re.finditer("\n", source))]
    out: list[tuple] = []
    ordinal = 0

    def line(at: int) -> int:
        low, high = 0, len(line_starts)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if line_starts[middle] <= at else (low, middle)
        return low + 1

    def visit(node: Node, parent: int) -> tuple[int, list[str], list[str], int, int]:
        nonlocal ordinal
        own, count = ordinal, 1
        ordinal += 1
        if node.text is not None:
            literal = node.kind != "Identifier"
            l0 = [f"{node.kind}:{node.text}" if literal else f"Id:{node.text}"]
            return 1, l0, [node.kind] if literal else l0, int(literal), int(not literal)
        l0, l1, literals, names = [node.kind], [node.kind], 0, 0
        for child in node.children:
            size, a, b, x, y = visit(child, own)
            count, literals, names = count + size, literals + x, names + y
            l0 += ["(", *a, ")"]
            l1 += ["(", *b, ")"]
        if node.kind not in IGNORED and node.kind != "File" and count >= least_nodes:
            first, last = line(node.start), line(max(node.start, node.end - 1))
            if last - first + 1 >= least_lines:
                share = literals / (literals + names) if literals + names else 0.0
                out.append((len(out), node.kind, count, node.start, node.end, first, last, parent, share, l0, l1))
        return count, l0, l1, literals, names

    for top in Parser(source).file().children:
        visit(top, -1)
    return out


def import_rows(source: str) -> list[tuple]:
    """(declaration_id, specifier, name, local, erased, binds, reexport) for every binding of an import or re-export, and one without a
    name for a declaration that binds nothing (side effects, dynamic imports). A star stands for all names."""
    t = tokens(source)
    out: list[tuple] = []
    declaration, i = 0, 0

    def specifier(k: int) -> tuple[str | None, int]:
        while k < len(t) and t[k].text not in ("from", ";"):
            k += 1
        return (t[k + 1].text[1:-1], k + 2) if k + 1 < len(t) and t[k].text == "from" and t[k + 1].kind == "string" else (None, k)

    depth = 0
    while i < len(t):
        word, following = t[i].text, t[i + 1] if i + 1 < len(t) else None
        if word == "import" and following and following.text == "(" and i + 2 < len(t) and t[i + 2].kind == "string" and (i == 0 or t[i - 1].text != "."):
            out.append((declaration, t[i + 2].text[1:-1], None, None, False, False, False))
            declaration += 1
        elif depth == 0 and word == "import" and following and following.kind == "string":
            out.append((declaration, following.text[1:-1], None, None, False, False, False))
            declaration += 1
            i += 1
        elif depth == 0 and word in ("import", "export") and following and (word == "import" and following.text != "." or following.text in ("{", "*", "type")):
            path, end = specifier(i + 1)
            if path is not None:
                found = list(_bindings(t[i + 1 : end - 2], word == "export"))
                out += [(declaration, path, *x, True, word == "export") for x in found] or [(declaration, path, None, None, False, False, word == "export")]
                declaration += 1
                i = end - 1
            elif word == "import":
                i = end
        elif word in CLOSING:
            depth += 1
        elif word in (")", "]", "}"):
            depth = max(0, depth - 1)
        i += 1
    return out


def _bindings(t: list[Token], export: bool) -> Iterator[tuple[str, str, bool]]:
    """(name, local, erased) of each binding between the keyword and ``from``."""
    erased = bool(t) and t[0].text == "type" and not (len(t) > 1 and t[1].text == ",") and len(t) > 1
    k = int(erased)
    while k < len(t):
        if t[k].text == "*":
            aliased = k + 2 < len(t) and t[k + 1].text == "as"
            yield "*", t[k + 2].text if aliased else "*", erased
            k += 3 if aliased else 1
        elif t[k].text == "{":
            k += 1
            while k < len(t) and t[k].text != "}":
                part = []
                while k < len(t) and t[k].text not in (",", "}"):
                    part.append(t[k].text)
                    k += 1
                alone = erased or len(part) > 1 and part[0] == "type" and part[1:2] != ["as"]
                names = part[1:] if alone and not erased else part
                if names:
                    yield names[0], names[-1], alone
                k += k < len(t) and t[k].text == ","
            k += 1
        elif t[k].kind == "word" and not export:
            yield "default", t[k].text, erased
            k += 1
        else:
            k += 1


FRAGMENTS = "path string, seq int, kind string, node_count int, start int, `end` int, line int, end_line int, parent_id int, literal_share double, tokens_l0 array<string>, tokens_l1 array<string>"
SHAPED = "path string, seq int, kind string, node_count int, start int, `end` int, line int, end_line int, parent_id int, literal_share double, l0 string, l1 string"
BINDINGS = "path string, declaration_id int, specifier string, name string, local string, erased boolean, binds boolean, reexport boolean"


def alpha_renamed(stream: list[str]) -> list[str]:
    """Identifiers by the order of their first appearance."""
    names: dict[str, str] = {}
    return [names.setdefault(x, f"Id#{len(names)}") if x.startswith("Id:") else x for x in stream]


def _rows_of(each, names: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                if rows := [(path, *r) for r in each(text or "")]:
                    yield pd.DataFrame(rows, columns=names)

    return run


def _names(schema: str) -> list[str]:
    return [part.split()[0].strip("`") for part in schema.split(", ")]


def fragments(files: DataFrame, least_nodes: int = 1, least_lines: int = 0) -> DataFrame:
    """path, seq (post-order), kind, size, place, parent and both token streams of every fragment of files (path, text)."""
    return files.select("path", "text").mapInPandas(_rows_of(lambda text: fragment_rows(text, least_nodes, least_lines), _names(FRAGMENTS)), FRAGMENTS)


def shaped_fragments(files: DataFrame, least_nodes: int = 1, least_lines: int = 0) -> DataFrame:
    """The same with hashes of the streams (l1 of the renamed one) in place of the streams, made where they are read."""

    def each(text: str) -> Iterator[tuple]:
        for *head, l0, l1 in fragment_rows(text, least_nodes, least_lines):
            yield *head, hash_of(" ".join(l0)), hash_of(" ".join(alpha_renamed(l1)))

    return files.select("path", "text").mapInPandas(_rows_of(each, _names(SHAPED)), SHAPED)


def import_bindings(files: DataFrame) -> DataFrame:
    """path, declaration_id, specifier, name, local, erased, binds, reexport of every binding of files (path, text)."""
    return files.select("path", "text").mapInPandas(_rows_of(import_rows, _names(BINDINGS)), BINDINGS)


def canonical_kind(kind: str) -> str:
    return ALIASES.get(kind, kind)
