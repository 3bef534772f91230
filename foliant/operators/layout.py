"""Words with boxes into lines in reading order, for scripts that run from right to left; one call for each page."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

ARABIC = re.compile("[؀-ۿ]")
LINES = "doc string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"


class Piece(NamedTuple):
    text: str
    x0: float
    y0: float
    x1: float
    y1: float


def bands(words: list[Piece]) -> list[list[Piece]]:
    """Words by line: a word joins the band that it overlaps by more than half of the lower height; bands grow as words join."""
    out: list[tuple[list[float], list[Piece]]] = []
    for w in sorted(words, key=lambda w: (w.y0 + w.y1, -w.x1)):
        for edges, members in reversed(out):
            shared = min(edges[1], w.y1) - max(edges[0], w.y0)
            if shared > 0.5 * min(edges[1] - edges[0], w.y1 - w.y0):
                edges[:] = [min(edges[0], w.y0), max(edges[1], w.y1)]
                members.append(w)
                break
        else:
            out.append(([w.y0, w.y1], [w]))
    return [members for _, members in sorted(out, key=lambda b: b[0])]


def reading_order(line: list[Piece], touch: float = 0.08) -> list[Piece]:
    """From right to left, fragments that touch joined, runs of words without Arabic script from left to right."""
    joined: list[Piece] = []
    for w in sorted(line, key=lambda w: -w.x1):
        last = joined[-1] if joined else None
        if last and last.x0 - w.x1 < touch * (w.y1 - w.y0) and bool(ARABIC.search(last.text)) == bool(ARABIC.search(w.text)):
            text = last.text + w.text if ARABIC.search(w.text) else w.text + last.text
            joined[-1] = Piece(text, w.x0, min(last.y0, w.y0), last.x1, max(last.y1, w.y1))
        else:
            joined.append(w)
    out: list[Piece] = []
    run: list[Piece] = []
    for w in joined:
        if ARABIC.search(w.text) or not re.search(r"\w", w.text):
            out += [*reversed(run), w]
            run = []
        else:
            run.append(w)
    return out + run[::-1]


def tightened(words: list[Piece]) -> list[Piece]:
    """Boxes of neighbours on a line no longer overlap: each ends where the one to its right begins."""
    out: list[Piece] = []
    for w in words:
        edge = out[-1].x0 if out else w.x1
        out.append(w._replace(x1=edge) if out and w.x0 < edge < w.x1 else w)
    return out


def same_row(a: Piece, b: Piece) -> bool:
    height = min(a.y1 - a.y0, b.y1 - b.y0)
    return min(a.y1, b.y1) - max(a.y0, b.y0) > 0.5 * height if height > 0 else abs(a.y0 + a.y1 - b.y0 - b.y1) < 0.01


def right_parts_first(lines: list[Piece], reach: int = 3) -> list[Piece]:
    """A line that is the left part of a row, and came before its right part, is moved behind it."""
    todo, out = list(lines), []
    while todo:
        head = todo[0]
        later = next((k for k, other in enumerate(todo[1 : reach + 1], 1) if same_row(head, other) and other.x0 >= head.x1 - 0.02), None)
        if later is None:
            out.append(todo.pop(0))
        else:
            todo.insert(later, todo.pop(0))
    return out


def page_lines(words: DataFrame) -> DataFrame:
    """Lines of pages; words: doc, page, text, x0, y0, x1, y1."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        pieces = [Piece(*r) for r in frame[["text", "x0", "y0", "x1", "y1"]].itertuples(index=False)]
        rows = []
        for band in bands(pieces):
            line = tightened(reading_order(band))
            rows.append(Piece(" ".join(w.text for w in line), min(w.x0 for w in line), min(w.y0 for w in line), max(w.x1 for w in line), max(w.y1 for w in line)))
        rows = right_parts_first(rows)
        head = frame.iloc[0]
        return pd.DataFrame([(head["doc"], head["page"], i, *r) for i, r in enumerate(rows)], columns=[c.split()[0] for c in LINES.split(", ")])

    return words.select("doc", "page", "text", "x0", "y0", "x1", "y1").groupBy("doc", "page").applyInPandas(one, LINES)
