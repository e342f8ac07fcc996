"""Splitting oversized texts at natural boundaries, by packing a structure tree.

A text is parsed into a tree: sections nested by the levels of their headings, paragraphs, list items nested by their
indents, lines, sentences, clauses, words. Sibling subtrees of one parent are merged up to the limit; only a node over
the limit is opened. A heading stays with the first body that follows it. Consecutive pieces share a stretch of text, set
back to a sentence or word start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS, OVERLAP_CHARS = 420, 200
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LINE = re.compile(r"[^\n\f]*[\n\f]|[^\n\f]+$")
_HASHES = re.compile(r"(#{1,6})\s+\S")
_NUMBERED = re.compile(r"(\d+(?:\.\d+)*)\.?\s+[^\W\d_a-z]")
_RULE = re.compile(r"([=-])\1{2,}$")
_ITEM = re.compile(r"[•*\-–]\s|\d+[.)]\s|\(?[a-z][.)]\s|[QA]\d*:")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+|(?<=[。！？])")
#: how a node without parsed children is opened, from the coarsest cut to the finest; each match ends a child
_INLINE = [_SENTENCE, re.compile(r"(?<=[;:,|])\s*"), re.compile(r"\s+")]
#: a line standing alone heads what follows it, below every heading whose level shows; a longer line is no heading
_ALONE, _HEADING_CHARS = 7, 90
#: list items nested deeper become siblings of the deepest
_NESTED = 40
PIECES = "piece_no int, piece_text string, char_from int, char_to int, new_from int, page_from int, page_to int, token_count int"


def token_count(text: Column) -> Column:
    """Tokens of a text: a word counts its length divided by 3, rounded up; another visible character 1.

    One match per up to three word characters, so it is a single native expression. Null gives null.
    """
    return F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{N}_]{1,3}|[^\p{L}\p{N}_\s\x1c-\x1f]"))


@dataclass
class Node:
    """The characters [a, b) of a text; `level` is a heading's level in a section, else the inline cut that opens the node."""

    kind: str  # section, heading, block, item, line, inline
    a: int
    b: int
    level: int = 0
    children: list[Node] = field(default_factory=list)

    def is_bare(self) -> bool:
        """Nothing but headings."""
        return self.kind == "heading" or (self.kind == "section" and all(c.is_bare() for c in self.children))


def _heading_level(lines: list[tuple[int, int, str]], i: int) -> int | None:
    """The level of line i as a heading (1 the highest), or None."""
    s = lines[i][2]
    m = _HASHES.match(s)
    if m:
        return len(m.group(1))
    if len(s) > _HEADING_CHARS or (i and lines[i - 1][2]) or _RULE.match(s):
        return None
    after = lines[i + 1][2] if i + 1 < len(lines) else ""
    rule = _RULE.match(after)
    if rule:
        return 1 if rule.group(1) == "=" else 2
    if s[-1] in ".!?;,:":
        return None
    m = _NUMBERED.match(s)
    if m and (not after or "." in m.group(1)):
        return min(6, m.group(1).count(".") + 1)
    if s.isupper() and sum(c.isalpha() for c in s) > 2:
        return 1
    if not after and i + 1 < len(lines) and not _ITEM.match(s) and (s[0].isupper() or s[0].isdigit()) and "\t" not in s:
        return _ALONE
    return None


def parse(text: str) -> Node:
    """The structure tree of a text; the children of every node follow each other without gaps and cover it."""
    lines = [(m.start(), m.end(), m.group().strip()) for m in _LINE.finditer(text)]
    root = Node("section", 0, len(text))
    path, i = [root], 0
    while i < len(lines):
        a, b, s = lines[i]
        level = _heading_level(lines, i) if s else None
        if level is not None:
            i += 1
            if i < len(lines) and _RULE.match(lines[i][2]) and not _HASHES.match(s):
                i += 1
            i = _blanks(lines, i)
            while len(path) > 1 and path[-1].level >= level:
                path.pop()
            section = Node("section", a, a, level, [Node("heading", a, _start(lines, i, text))])
            path[-1].children.append(section)
            path.append(section)
            continue
        first = i
        i += 1
        while i < len(lines) and lines[i][2] and not (text[lines[i][0] - 1] == "\f" and _ends(lines[i - 1][2])) and not _HASHES.match(lines[i][2]):
            i += 1
        last, i = i, _blanks(lines, i)
        path[-1].children.append(_block(text, lines, first, last, _start(lines, i, text)))
    _close(root, len(text))
    return root


def _start(lines: list[tuple[int, int, str]], i: int, text: str) -> int:
    return lines[i][0] if i < len(lines) else len(text)


def _blanks(lines: list[tuple[int, int, str]], i: int) -> int:
    while i < len(lines) and not lines[i][2]:
        i += 1
    return i


def _ends(s: str) -> bool:
    return not s or s[-1] in ".!?:;…)\"”"


def _close(node: Node, end: int) -> None:
    """Ends of sections: where the next sibling begins."""
    node.b = end
    for n, c in enumerate(node.children):
        if c.kind == "section":
            _close(c, node.children[n + 1].a if n + 1 < len(node.children) else end)


def _block(text: str, lines: list[tuple[int, int, str]], first: int, last: int, end: int) -> Node:
    """A paragraph: its list items, else its lines where they are no mere wrapping, else its sentences."""
    block = Node("block", lines[first][0], end)
    part = lines[first:last]
    starts = [a for a, _, _ in part] + [end]
    items = [n for n, (_, _, s) in enumerate(part) if _ITEM.match(s)]
    if items and len(part) > 1:
        path: list[tuple[int, Node]] = []
        if items[0]:
            block.children.append(Node("inline", starts[0], starts[items[0]]))
        for n, at in enumerate(items):
            a, b = starts[at], starts[items[n + 1]] if n + 1 < len(items) else end
            indent = len(text[part[at][0] : part[at][1]]) - len(text[part[at][0] : part[at][1]].lstrip())
            while path and (path[-1][0] >= indent or len(path) == _NESTED):
                path.pop()
            item = Node("item", a, b, 0, [Node("inline", a, b)])
            for _, above in path:  # an item reaches over the items it holds
                above.b = b
            (path[-1][1] if path else block).children.append(item)
            path.append((indent, item))
    elif len(part) > 1 and (any("\t" in s or "|" in s for _, _, s in part) or all(_ends(s) for _, _, s in part[:-1])):
        block.children = [Node("line", a, b) for a, b in zip(starts, starts[1:])]
    return block


class _Text:
    def __init__(self, text: str, limit: int, overlap: int):
        self.text, self.limit, self.overlap = text, limit, overlap
        ends = [0]
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            ends += range(a + 3, b, 3)
            ends.append(b)
        # one entry per three characters of a word: counts are exact from word starts on, and never too small
        self.ends = np.array(ends)
        self._back: dict[int, int] = {0: 0}

    def tokens(self, a: int, b: int) -> int:
        e = self.ends
        return int(np.searchsorted(e, b, "right") - np.searchsorted(e, a, "right"))

    def back(self, at: int) -> int:
        """Where a piece whose new text begins at `at` starts: about `overlap` characters earlier, by at most half the limit."""
        got = self._back.get(at)
        if got is None:
            got = _set_back(self.text, at, 0, self.overlap)
            while got < at and self.tokens(got, at) > self.limit // 2:
                got = min(at, got + max(1, (at - got) // 4))
            self._back[at] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether new text [a, b) makes a piece within the limit, with the overlap before it."""
        return self.tokens(self.back(a), b) <= self.limit

    def opened(self, node: Node) -> list[Node]:
        """The children of a node, parsed or cut inline; none if nothing cuts it but its length."""
        if node.kind == "inline" or not node.children:
            for level in range(node.level if node.kind == "inline" else 0, len(_INLINE)):
                cuts = [node.a, *(m.end() for m in _INLINE[level].finditer(self.text, node.a, node.b) if node.a < m.end() < node.b), node.b]
                if len(cuts) > 2:
                    return [Node("inline", x, y, level + 1) for x, y in zip(cuts, cuts[1:])]
            return []
        return node.children

    def by_length(self, a: int, b: int) -> list[tuple[int, int]]:
        """One endless word: cut wherever the limit is reached."""
        out = []
        while a < b:
            e = self.ends
            i = int(np.searchsorted(e, self.back(a), "right"))
            j = max(i + self.limit - 1, int(np.searchsorted(e, a, "right")))
            y = min(b, int(e[j])) if j < len(e) else b
            if not self.tokens(y, b):
                y = b
            out.append((a, y))
            a = y
        return out


def _pack(t: _Text, node: Node, start: int) -> list[tuple[int, int]]:
    """Pieces of a node whose first one begins at `start`, where the headings before it begin."""
    if t.fits(start, node.b):
        return [(start, node.b)]
    kids = t.opened(node)
    if not kids:
        return t.by_length(start, node.b)
    out: list[tuple[int, int]] = []
    growing, lead = False, start
    for n, kid in enumerate(kids):
        a = kid.a if lead is None else lead
        if kid.is_bare() and n + 1 < len(kids) and t.tokens(a, kid.b) <= t.limit // 4:
            lead = a  # waits for the body it heads
            continue
        lead = None
        if growing and t.fits(out[-1][0], kid.b):
            out[-1] = (out[-1][0], kid.b)
        elif t.fits(a, kid.b):
            out.append((a, kid.b))
            growing = True
        else:
            out += _pack(t, kid, a)
            growing = False
    return out


def _exact(text: str) -> int:
    return sum((m.end() - m.start() + 2) // 3 if m.group()[0].isalnum() or m.group()[0] == "_" else 1 for m in _TOKEN.finditer(text))


def _set_back(text: str, at: int, low: int, overlap: int) -> int:
    """About `overlap` characters before `at`, at a sentence start if there is one near, else at a word's."""
    want = max(low, at - overlap)
    if want <= low:
        return low
    near = [m.end() for m in _SENTENCE.finditer(text, max(low, want - overlap // 8), min(at, want + overlap // 8))]
    if near:
        return min(near, key=lambda p: abs(p - want))
    for p in range(want, min(at, want + overlap // 4)):
        if text[p - 1].isspace() and not text[p].isspace():
            return p
    return want


def split_text(text: str, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """(start with overlap, start of new text, end) per piece; the new texts joined give the text again."""
    t = _Text(text, limit, overlap)
    if t.tokens(0, len(text)) <= limit:
        return [(0, 0, len(text))] if text.strip() else []
    out: list[tuple[int, int, int]] = []
    for a, b in _pack(t, parse(text), 0):
        if out and not text[a:b].strip():
            out[-1] = (*out[-1][:2], b)
        else:
            out.append((max(out[-1][1], t.back(a)) if out else 0, a, b))
    return out


def _pages(text: str, a: int, b: int, first, last) -> tuple:
    if pd.isna(first):
        return None, None
    part = text[a:b]
    lead, trail = len(part) - len(part.lstrip()), len(part.rstrip())
    p = int(first) + text.count("\f", 0, a + lead)
    q = int(first) + text.count("\f", 0, a + trail)
    if not pd.isna(last) and last >= first:
        p, q = min(p, int(last)), min(q, int(last))
    return p, q


def split_oversized(
    items: DataFrame, item_id: str = "id", text: str = "text", page_from: str | None = "page_from", page_to: str | None = "page_to",
    limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Pieces of every item over `limit` tokens: item_id, then piece_no, piece_text, char_from, char_to, new_from, pages, token_count.

    No piece is over the limit; the overlap takes at most half of it. Texts within it, null and blank ones give no rows. Items that repeat an id are
    split each for themselves. A form feed is a page turn; pages are null where page_from is, and never pass
    page_to. Without spaces a word is cut inside. Every row stands for itself: no shuffle, whole texts, any length;
    further columns are not read.
    """
    no_page = F.lit(None).cast("int")
    over = items.filter((F.length(text) > limit)).select(
        F.col(item_id).alias("item_id"), F.col(text).alias("text"),
        (F.col(page_from).cast("int") if page_from else no_page).alias("first"), (F.col(page_to).cast("int") if page_to else no_page).alias("last"),
    ).filter(token_count(F.col("text")) > limit)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, x, first, last in zip(pdf["item_id"], pdf["text"], pdf["first"], pdf["last"]):
                for n, (start, new, end) in enumerate(split_text(x, limit, overlap)):
                    piece = x[start:end]
                    rows.append((i, n, piece, start, end, new, *_pages(x, start, end, first, last), _exact(piece)))
            out = pd.DataFrame(rows, columns=["item_id", "piece_no", "piece_text", "char_from", "char_to", "new_from", "page_from", "page_to", "token_count"])
            yield out.astype({"page_from": "Int32", "page_to": "Int32"})

    kind = dict(items.dtypes)[item_id]
    return over.mapInPandas(split, f"item_id {kind}, {PIECES}")
