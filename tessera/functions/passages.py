"""Cutting bodies into passages, and files into units (helpers that run inside a column expression)."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import pairwise

import numpy as np

# What counts as a heading line, a list item line, a token, a fence line.
HEADING = re.compile(r"^#{1,6}\s")
LIST_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s")
TOKEN = re.compile(r"\S+")
FENCE = re.compile(r"(`{3,}|~{3,})")
MOST_TOKENS = 512
OVERLAP = 64
UNIT_BYTES = 16 * 1024
_BLANK, _HEADING, _ITEM, _LINE = range(4)


def _kind(line: str) -> int:
    return _BLANK if not line.strip() else _HEADING if HEADING.match(line) else _ITEM if LIST_ITEM.match(line) else _LINE


def blocks(body: str) -> list[tuple[int, int, bool]]:
    """(start, end, is heading) of each block. Lines are typed first; a block begins at every line but an ordinary one that
    follows an ordinary one, and ends where the last of its lines does. Blank lines are no blocks."""
    lines = body.splitlines(keepends=True)
    if not lines:
        return []
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    shown = np.fromiter((len(x.rstrip("\r\n")) for x in lines), np.int64, len(lines))
    kind = np.fromiter((_kind(x) for x in lines), np.int8, len(lines))
    start = np.cumsum(size) - size
    begins = np.flatnonzero((kind != _LINE) | (np.roll(kind, 1) != _LINE) | (np.arange(len(lines)) == 0))
    final = np.append(begins[1:], len(lines)) - 1
    return [(a, b, k == _HEADING) for a, b, k in zip(start[begins].tolist(), (start + shown)[final].tolist(), kind[begins].tolist(), strict=True) if k != _BLANK]


def windows(text: str, most: int, step: int) -> list[tuple[int, int]]:
    """Spans of overlapping runs of tokens; the whole text if it has few enough. One window more than whole steps fit into
    what the first window leaves over."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    over = len(tokens) - most
    if over <= 0:
        return [(0, len(text))]
    firsts = [step * k for k in range(1 - (-over // step))]
    return [(tokens[i][0], tokens[min(i + most, len(tokens)) - 1][1]) for i in firsts]


def spans(body: str, most: int = MOST_TOKENS, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], list[int]]:
    """((start, end, number of the section) of a body's passages, in order; the edges of its sections). A section is the stretch
    between two headings."""
    found = blocks(body)
    edges = [0, *[start for start, _, heading in found if heading and start], len(body)]
    section = lambda start: bisect_right(edges, start, 0, len(edges) - 1) - 1
    return [(start + a, start + b, section(start)) for start, end, _ in found for a, b in windows(body[start:end], most, max(1, most - overlap))], edges


def passages(body: str | None, most: int = MOST_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str, str]]:
    """(ord, start, end, text, parent block) of a body's passages, in order; offsets count code points. The parent is the
    stretch between the headings around a passage."""
    body = body or ""
    found, edges = spans(body, most, overlap)
    sections = [body[a:b].strip() for a, b in pairwise(edges)]
    return [(k, a, b, body[a:b], sections[n]) for k, (a, b, n) in enumerate(found)]


def fenced(lines: list[str]) -> list[bool]:
    """For each line, if it is inside a code fence: the opening line isn't, the closing one is. A fence may be indented and
    ends at a line of nothing but its own mark, at least as long."""
    out, mark = [], ""
    for line in map(str.strip, lines):
        out.append(bool(mark))
        if not mark:
            mark = hit[1] if (hit := FENCE.match(line)) else ""
        elif len(line) >= len(mark) and not line.strip(mark[0]):
            mark = ""
    return out


def _cut(low: int, high: int, is_edge) -> list[tuple[int, int]]:
    edges = [low, *[i for i in range(low + 1, high) if is_edge(i)], high]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def units(text: str | None, most_bytes: int = UNIT_BYTES) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of a file's units, lines from 1: cut at headings of the deepest level that occurs
    outside code fences, else at top-level bullets; large units are cut again at bullets, what is still large at paragraphs."""
    lines = (text or "").splitlines()
    inside = fenced(lines)
    levels = [len(m[1]) if not f and (m := re.match(r"^(#{1,6})\s", line)) else 0 for line, f in zip(lines, inside, strict=True)]
    bullet = [not f and re.match(r"^-\s", line) is not None for line, f in zip(lines, inside, strict=True)]
    blank = [not line.strip() for line in lines]
    deepest = max(levels, default=0)

    def paragraph(i: int) -> bool:
        return not inside[i] and not blank[i] and blank[i - 1] and not inside[i - 1]

    def large(a: int, b: int) -> bool:
        return len("\n".join(lines[a:b]).encode("utf-8", "replace")) > most_bytes

    out = []
    for a, b in _cut(0, len(lines), lambda i: levels[i] == deepest if deepest else bullet[i]):
        for c, d in _cut(a, b, lambda i: bullet[i]) if deepest and large(a, b) else [(a, b)]:
            out += _cut(c, d, paragraph) if large(c, d) else [(c, d)]
    return [(a + 1, b, "\n".join(lines[a:b])) for a, b in out]
