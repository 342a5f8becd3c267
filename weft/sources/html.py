"""HTML front end: pages as trees, a fragment for each element. Python parses; it runs in Arrow batches.

An element's hashes are made from its tag, its words and its children's hashes, so a page costs as much as it is long, however deep it
nests. Equal subtrees have equal hashes, at L0 with their words and at L1 without.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that never become fragments, though their tokens count within parents.
IGNORED = {"a", "b", "i", "em", "strong", "span", "br", "img", "meta", "link"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end where one of their kind begins, unless one of the others has begun in between.
ENDED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "body"}
SCHEMA = "page_id long, seq int, parent_id int, kind string, node_count int, start_at int, end_at int, l0 string, l1 string"


class _Open:
    """An element that has not ended."""

    def __init__(self, tag: str, start: int, ordinal: int) -> None:
        self.tag, self.start, self.ordinal, self.count = tag, start, ordinal, 1
        self.l0, self.l1 = md5(tag.encode()), md5(tag.encode())


class _Tree(HTMLParser):
    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.size = len(text)
        self.rows: list[tuple] = []
        self.ordinal = 0
        self.open: list[_Open] = []

    def at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and tag in ENDED_BY.get(self.open[-1].tag, ()):
            self.close(self.at())
        for k in reversed(range(len(self.open))):  # inline elements may be open within what ends
            if self.open[k].tag in HOLDERS:
                break
            if tag in ENDED_BY.get(self.open[k].tag, ()):
                while len(self.open) > k:
                    self.close(self.at())
                break
        self.open.append(_Open(tag, self.at(), self.ordinal))
        self.ordinal += 1
        if tag in VOID:
            self.close(self.at() + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open):
            end = self.at() + len(tag) + 3
            while self.open[-1].tag != tag:
                self.close(self.at())
            self.close(end)

    def handle_data(self, data: str) -> None:
        if self.open and (words := data.split()):
            top = self.open[-1]
            top.count += len(words)
            top.l0.update("".join(f"\x01{w}" for w in words).encode())
            top.l1.update(b"\x01" * len(words))

    def close(self, end: int) -> None:
        node = self.open.pop()
        l0, l1 = node.l0.hexdigest(), node.l1.hexdigest()
        if self.open:
            parent = self.open[-1]
            parent.count += node.count
            parent.l0.update(f"\x02{l0}".encode())
            parent.l1.update(f"\x02{l1}".encode())
        if node.tag not in IGNORED:
            self.rows.append((len(self.rows), self.open[-1].ordinal if self.open else -1, node.tag, node.count, node.start, min(end, self.size), l0, l1))


COLUMNS = ["page_id", "seq", "parent_id", "kind", "node_count", "start_at", "end_at", "l0", "l1"]
#: Rows that are handed on at once, about; and pages that a worker gets at once.
ROWS, PAGES = 10_000, 200


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for frame in frames:
        for page, html in zip(frame["page_id"], frame["html"], strict=True):
            tree = _Tree(html or "")
            tree.feed(html or "")
            while tree.open:
                tree.close(tree.size)
            for r in tree.rows:
                rows.append((page, *r))
                if len(rows) == ROWS:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
    yield pd.DataFrame(rows, columns=COLUMNS)


def html_fragments(pages: DataFrame, least_nodes: int = 5) -> DataFrame:
    """page_id, seq (post-order), parent_id, kind, node_count, range and hashes of every element of enough nodes. Lowers the session's
    spark.sql.execution.arrow.maxRecordsPerBatch to PAGES, so that what a worker holds grows with neither the pages nor their elements."""
    conf = pages.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= PAGES:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES))
    return pages.select("page_id", "html").mapInPandas(_parse, SCHEMA).where(f"node_count >= {least_nodes}")
