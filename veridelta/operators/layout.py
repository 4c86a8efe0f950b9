"""Text runs of a page to paragraph, heading and table blocks.

Order decides almost every step, and rounding is Python's, so a page is folded in Python;
pages are independent, and the Spark side hands each worker whole pages.
"""

from __future__ import annotations

import bisect
import statistics
from dataclasses import dataclass, field
from itertools import pairwise

from veridelta.sources.pdf_text import Run


@dataclass
class Row:
    cells: list[Run]  # from left to right

    @property
    def y(self) -> float:
        return self.cells[0].y

    @property
    def size(self) -> float:
        return max(c.size for c in self.cells)


@dataclass
class Line:
    y: float
    x0: float
    size: float
    text: str


@dataclass
class Block:
    text: str
    page: int
    is_heading: bool
    x: float
    y: float
    size: float
    lines: list[Line] = field(default_factory=list)
    table: list[list[str]] | None = None


def rows_of(runs: list[Run]) -> list[Row]:
    """L1-L4: runs in reading order, joined while they stay near the row's drifting middle."""
    rows: list[list[Run]] = []
    middle = 0.0
    for r in sorted((r for r in runs if r.text and r.text.strip()), key=lambda r: (-round(r.y, 1), r.x)):
        if rows and abs(r.y - middle) <= max(2.0, 0.5 * (r.size or 10)):
            rows[-1].append(r)
            middle = (middle + r.y) / 2
        else:
            rows.append([r])
            middle = r.y
    return [Row(sorted(cells, key=lambda r: r.x)) for cells in rows]


def anchors(rows: list[Row], tolerance: float) -> list[float]:
    """Left edges, clustered where neighbours are at most the tolerance apart; each cluster's least."""
    xs = sorted(c.x for r in rows for c in r.cells)
    return xs[:1] + [b for a, b in pairwise(xs) if b - a > tolerance]


def column(x: float, columns: list[float]) -> int:
    """The nearest anchor, the left one of two."""
    i = bisect.bisect_left(columns, x)
    if i == 0 or i < len(columns) and columns[i] - x < x - columns[i - 1]:
        return i
    return i - 1


def tolerance_of(rows: list[Row]) -> float:
    return max(12.0, 1.2 * (rows[0].size or 10))


def is_table(rows: list[Row]) -> bool:
    """At least two rows whose cells stand in two columns or more."""
    columns = anchors(rows, tolerance_of(rows))
    if len(rows) < 2 or len(columns) < 2:
        return False
    return sum(len({column(c.x, columns) for c in r.cells}) >= 2 for r in rows) >= 2


def grid_of(rows: list[Row]) -> list[list[str]]:
    """Each cell in its nearest column; cells that meet are joined by a space."""
    columns = anchors(rows, tolerance_of(rows))
    grid = []
    for r in rows:
        cells = [""] * len(columns)
        for c in r.cells:
            i = column(c.x, columns)
            cells[i] = f"{cells[i]} {c.text}".strip() if cells[i] else c.text
        grid.append(cells)
    return grid


def segments(rows: list[Row]) -> list[tuple[bool, list[Row]]]:
    """(is a table, rows): the longest runs of close multi-cell rows that are tables, and the text between."""
    out: list[tuple[bool, list[Row]]] = []
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and len(rows[j].cells) >= 2 and (j == i or 0 <= rows[j - 1].y - rows[j].y <= 3.0 * max(rows[j].size, 1.0)):
            j += 1
        if j > i and is_table(rows[i:j]):
            out.append((True, rows[i:j]))
            i = j
            continue
        if not out or out[-1][0]:
            out.append((False, []))
        out[-1][1].append(rows[i])
        i += 1
    return out


def line_of(row: Row) -> Line:
    """Cells joined, with a space where a gap shows and none stands yet."""
    text, end = "", None
    for c in row.cells:
        em = c.size or 10
        if end is not None and c.x - end > 0.3 * em and not text.endswith(" ") and not c.text.startswith(" "):
            text += " "
        text += c.text
        end = c.x + 0.5 * em * len(c.text)
    return Line(row.y, row.cells[0].x, row.size, text.strip())


def paragraphs(lines: list[Line], page: int, body: float) -> list[Block]:
    """Lines that follow each other closely and at the first one's edge; a large line is a heading of its own."""
    groups: list[tuple[bool, list[Line]]] = []
    for x in lines:
        if not x.text:
            continue
        heading = x.size >= 1.2 * body
        if groups and not heading and not groups[-1][0]:
            own = groups[-1][1]
            height = max(own[-1].size, x.size, 1.0)
            if 0 <= own[-1].y - x.y <= 1.8 * height and abs(x.x0 - own[0].x0) <= 2.0 * height:
                own.append(x)
                continue
        groups.append((heading, [x]))
    return [Block(" ".join(x.text for x in g).strip(), page, heading, g[0].x0, g[0].y, g[0].size, g) for heading, g in groups]


def build_blocks(runs: list[Run], page: int) -> list[Block]:
    """A page's blocks in reading order."""
    rows = rows_of(runs)
    body = (statistics.median(r.size for r in rows) if rows else 0) or 10.0
    out: list[Block] = []
    for table, own in segments(rows):
        if table:
            grid = grid_of(own)
            out.append(Block(" ".join(c for r in grid for c in r if c), page, False, own[0].cells[0].x, own[0].y, own[0].size, table=grid))
        else:
            out += paragraphs([line_of(r) for r in own], page, body)
    return out
