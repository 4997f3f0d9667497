"""Publisher markup as ordered blocks: headings, paragraphs and tables (as markdown)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose text is not read, and those that end a block.
SKIPPED = frozenset({"script", "style", "head", "math", "svg"})
BREAKS = frozenset({"p", "para", "div", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "title", "abstract", "caption", "table", "article", "nav", "footer", "body"})


class _Table:
    """An open table: its rows, and the cell that is being read."""

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def end_cell(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None


class _Blocks(HTMLParser):
    """Blocks in order of their ends; a table inside a cell is a block before the table around it."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.words: list[str] = []
        self.kind, self.skip = "text", 0
        self.tables: list[_Table] = []

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.out.append((self.kind, text))
        self.words, self.kind = [], "text"

    def end_table(self) -> None:
        self.flush()
        table = self.tables.pop()
        table.end_cell()
        self.out += [("table", t)] if (t := markdown(table.rows)) else []

    def finish(self) -> None:
        """Whatever is open at the end of the page."""
        while self.tables:
            self.end_table()
        self.flush()

    def in_cell(self) -> bool:
        return bool(self.tables) and self.tables[-1].cell is not None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = tag.rpartition(":")[2]
        table = self.tables[-1] if self.tables else None
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.tables.append(_Table())
        elif table and tag in ("tr", "row"):
            self.flush()
            table.end_cell()
            table.rows.append([])
        elif table and tag in ("td", "th", "entry"):
            self.flush()
            table.end_cell()
            table.cell = []
        elif tag in BREAKS and self.in_cell():
            table.cell.append(" ")
        elif tag in BREAKS:
            self.flush()
            self.kind = "heading" if tag[0] == "h" and tag[1:].isdigit() or tag in ("title", "caption") else "text"

    def handle_endtag(self, tag: str) -> None:
        tag = tag.rpartition(":")[2]
        table = self.tables[-1] if self.tables else None
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif table and tag in ("td", "th", "entry", "tr", "row"):
            self.flush()
            table.end_cell()
        elif table and tag == "table":
            self.end_table()
        elif tag in BREAKS and not self.in_cell():
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.tables[-1].cell if self.in_cell() else self.words).append(data)


def markdown(rows: list[list[str]]) -> str:
    """A table with a rule under its first row; short rows are filled."""
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def blocks(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, pos, kind, text) of the blocks of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b[key], b[markup]):
                parser = _Blocks()
                parser.feed(page or "")
                parser.close()
                parser.finish()
                out += [(k, i, *x) for i, x in enumerate(parser.out)]
            yield pd.DataFrame(out, columns=[key, "pos", "kind", "text"])

    return pages.select(key, markup).mapInPandas(run, f"{key} {kind}, pos int, kind string, text string")
