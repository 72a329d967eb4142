"""One document cut into what rules look at: masked text, lines, blocks, sentences and markdown structure.

Offsets are code points of the original text; masking keeps lengths and line ends.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from functools import cached_property

from quillgrid.functions.dialect import compiled
from quillgrid.plans.lexicons import ABBREVIATIONS

# What counts as a word, what is hidden, and the shapes of markdown.
WORD = compiled(r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*")
FRONT = compiled(r"^(---|\+\+\+)\r?\n[\s\S]*?\n\1\r?(?:\n|$)")
HIDDEN = [
    ("```", compiled(r"```[\s\S]*?```")),
    ("~~~", compiled(r"~~~[\s\S]*?~~~")),
    ("`", compiled(r"`[^`\n]+`")),
    ("<!--", compiled(r"<!--[\s\S]*?-->")),
    ("{{", compiled(r"\{\{[\s\S]*?\}\}")),
    ("<", compiled(r"<\/?[a-zA-Z][^>]*>")),
]
HEADING_LINE = compiled(r"^\s{0,3}#{1,6}\s")
LIST_LINE = compiled(r"^\s*([-*+]|\d+[.)])\s")
HEADING = compiled(r"^(\s{0,3})(#{1,6})\s+(.*?)\s*#*\s*$")
ITEM = compiled(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
SENTENCE_END = compiled("[.!?]+[\"')\\]”’]?(\\s+|$)")
LAST_WORD = compiled(r"([A-Za-z.]+)$")
IMAGE = compiled(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
LINK = compiled(r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
BOLD = compiled(r"\*\*[^*\n]+\*\*|__[^_\n]+__")
BREAK = compiled(r"^\s{0,3}([-*_])(\s*\1){2,}\s*$")
TABLE_ROW = compiled(r"^\s*\|")
TABLE_RULE = compiled(r"^\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+$")
DEFINITION = compiled(r"^\s{0,3}\[([^\]]+)\]:\s+\S+", "m")
USE = compiled(r"\]\[([^\]]*)\]")
SHORT_USE = compiled(r"(?<!\!)\[([^\]]+)\](?!\s*[[(:])")
BEYOND = compiled("[\u3000-\u9fff\u3040-\u30ff\uac00-\ud7af\u0400-\u04ff\u0600-\u06ff\u0e00-\u0e7f]")

BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def count_words(text: str) -> int:
    return len(WORD.findall(text))


#: All of ASCII but letters.
NO_LETTERS = bytes(k for k in range(128) if not chr(k).isalpha())


def count_letters(text: str) -> int:
    """Letters A-Z and a-z."""
    return len(text.encode("ascii", "ignore").translate(None, NO_LETTERS))


def hidden(text: str) -> list[tuple[int, int]]:
    """Ranges of code, comments, templates, tags and front matter, each found in the original text."""
    out = []
    if text[:3] in ("---", "+++") and (m := FRONT.match(text)):
        out.append((0, m.end()))
    for sign, pattern in HIDDEN:
        if sign in text:
            out += [(m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def masked(text: str) -> str:
    """text with the hidden ranges blanked, line by line."""
    out, at = [], 0
    for start, end in hidden(text):
        start = max(start, at)
        if end > start:
            out += [text[at:start], "\n".join(" " * len(x) for x in text[start:end].split("\n"))]
            at = end
    return "".join(out) + text[at:] if out else text


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    text: str
    kind: str = ""


@dataclass(frozen=True)
class Heading:
    level: int
    text: str
    line: int
    start: int
    raw: str


@dataclass(frozen=True)
class Item:
    indent: int
    marker: str
    text: str
    line: int
    start: int


@dataclass(frozen=True)
class Link:
    text: str
    target: str
    start: int


class Document:
    """Parts are computed when first asked for."""

    def __init__(self, text: str, style: str = "microsoft", adverbs: frozenset[str] | None = None) -> None:
        self.text, self.style, self.adverbs = text, style, adverbs

    @cached_property
    def masked(self) -> str:
        return masked(self.text)

    @cached_property
    def lower(self) -> str:
        return self.masked.lower()

    @cached_property
    def lines(self) -> list[str]:
        return self.text.split("\n")

    @cached_property
    def masked_lines(self) -> list[str]:
        return self.masked.split("\n")

    @cached_property
    def starts(self) -> list[int]:
        out, at = [], 0
        for line in self.lines:
            out.append(at)
            at += len(line) + 1
        return out

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def place(self, offset: int) -> tuple[int, int]:
        """Line and column, from 1."""
        line = self.line(offset)
        return line, offset - self.starts[line - 1] + 1

    @cached_property
    def n_words(self) -> int:
        return count_words(self.masked)

    def per_thousand(self, n: float) -> float:
        return n / max(self.n_words, 1) * 1000

    @cached_property
    def blocks(self) -> list[Piece]:
        """Headings alone, list items and paragraphs with the lines that go on from them, cut at blank lines."""
        spans: list[list] = []
        growing = False
        for start, line in zip(self.starts, self.masked_lines, strict=True):
            if not line.strip(BLANKS):
                growing = False
            elif HEADING_LINE.match(line):
                spans.append([start, start + len(line), "heading"])
                growing = False
            elif LIST_LINE.match(line) or not growing:
                spans.append([start, start + len(line), "list" if LIST_LINE.match(line) else "para"])
                growing = True
            else:
                spans[-1][1] = start + len(line)
        return [Piece(a, b, self.masked[a:b], kind) for a, b, kind in spans]

    @cached_property
    def sentences(self) -> list[Piece]:
        out = []
        for block in self.blocks:
            if block.kind == "heading":
                continue
            last, text = 0, block.text
            for m in SENTENCE_END.finditer(text):
                word = LAST_WORD.search(text[last : m.start()][-64:])
                if word and word[1].lower().rstrip(".") in ABBREVIATIONS:
                    continue
                out.append(Piece(block.start + last, block.start + m.end(), text[last : m.end()]))
                last = m.end()
            if text[last:].strip(BLANKS):
                out.append(Piece(block.start + last, block.end, text[last:]))
        return out

    @cached_property
    def sentence_words(self) -> list[int]:
        return [count_words(s.text) for s in self.sentences]

    @cached_property
    def _marks(self) -> tuple[list[Heading], list[Item]]:
        headings, items = [], []
        for k, (start, line, shown) in enumerate(zip(self.starts, self.lines, self.masked_lines, strict=True), 1):
            if not shown.strip(BLANKS):
                continue
            if m := HEADING.match(line):
                headings.append(Heading(len(m[2]), m[3], k, start, line))
            elif m := ITEM.match(line):
                items.append(Item(len(m[1]), m[2], m[3], k, start))
        return headings, items

    @property
    def headings(self) -> list[Heading]:
        return self._marks[0]

    @property
    def items(self) -> list[Item]:
        return self._marks[1]

    @cached_property
    def images(self) -> list[Link]:
        return [Link(self.text[m.start() + 2 : m.start() + 2 + len(m[1])], m[2], m.start()) for m in IMAGE.finditer(self.masked)] if "![" in self.masked else []

    @cached_property
    def links(self) -> list[Link]:
        if "](" not in self.masked:
            return []
        return [Link(self.text[m.start() + 1 : m.start() + 1 + len(m[1])], m[2], m.start()) for m in LINK.finditer(self.masked) if self.masked[m.start() - 1 : m.start()] != "!"]

    @cached_property
    def bold(self) -> list[tuple[int, int]]:
        return [(m.start(), len(m[0])) for m in BOLD.finditer(self.masked)]

    @cached_property
    def breaks(self) -> list[tuple[int, int]]:
        """Line and start of thematic breaks."""
        return [(k, start) for k, (start, line) in enumerate(zip(self.starts, self.masked_lines, strict=True), 1) if BREAK.match(line)]

    @cached_property
    def table_lines(self) -> frozenset[int]:
        if "|" not in self.text:
            return frozenset()
        return frozenset(k for k, line in enumerate(self.lines, 1) if TABLE_ROW.match(line) or line.count("|") >= 2 or TABLE_RULE.match(line))

    def in_table(self, offset: int) -> bool:
        return bool(self.table_lines) and self.line(offset) in self.table_lines

    def opens_sentence(self, offset: int) -> bool:
        text = self.masked
        while offset and text[offset - 1] in " \t>*_#-":
            offset -= 1
        return not offset or text[offset - 1] in ".!?\n"

    @cached_property
    def definitions(self) -> list[tuple[str, int, int]]:
        """Id, start and length of reference definitions."""
        return [(m[1].lower(), m.start(), len(m[0])) for m in DEFINITION.finditer(self.masked)]

    @cached_property
    def uses(self) -> frozenset[str]:
        return frozenset([m[1].lower() for m in USE.finditer(self.masked)] + [m[1].lower() for m in SHORT_USE.finditer(self.masked)])


def beyond_latin(text: str) -> bool:
    """Whether prose is in another script than these rules are for: over 80 such characters and a quarter of the letters."""
    beyond = sum(1 for _ in BEYOND.finditer(text))
    return beyond > 80 and beyond * 3 > count_letters(text)
