"""Patterns written in the ECMAScript dialect, compiled for Python with the same meaning."""

from __future__ import annotations

import re
from functools import lru_cache

SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ENDS = "\n\r\u2028\u2029"


def translated(pattern: str, many: bool) -> str:
    """White space, dot and anchors spelled out; words, digits and case are ASCII by the flags of compiled()."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            if n == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif n == "S" and not inside:
                out.append(f"[^{SPACE}]")
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1] == "^":
                out.append("^")
                i += 1
        elif c == ".":
            out.append(f"[^{ENDS}]")
        elif c == "^":
            out.append(f"(?:(?<=[{ENDS}])|\\A)" if many else "\\A")
        elif c == "$":
            out.append(f"(?=[{ENDS}]|\\Z)" if many else "\\Z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def compiled(pattern: str, flags: str = "") -> re.Pattern[str]:
    return re.compile(translated(pattern, "m" in flags), re.ASCII | (re.I if "i" in flags else 0))


def escaped(word: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m[0], word)


def any_word(words) -> str:
    """The words in their order between word boundaries."""
    return r"\b(" + "|".join(map(escaped, words)) + r")\b"


def any_phrase(words) -> str:
    """The phrases, longest first, not inside a longer word; they may end in punctuation."""
    return "(?<![A-Za-z0-9_])(" + "|".join(map(escaped, sorted(words, key=len, reverse=True))) + ")(?![A-Za-z0-9_])"
