"""The rules, as data: what to look for, when it counts, and what to say.

A rule's search yields (offset, length, severity or None, values for the message).  Most are Scan: matches of
patterns in the masked text, with a condition on each and a gate on all.  needs names literals of which a
document must hold one for the rule to find anything; the engine looks for all rules' literals in one pass and
runs only the rules that can fire.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from quillgrid.functions.dialect import any_phrase, any_word, compiled
from quillgrid.functions.segment import BLANKS, Document, count_letters, count_words
from quillgrid.plans import lexicons as L

SLOP, CLARITY, STYLE, INCLUSIVE = "ai-slop", "clarity", "style", "inclusive"
WARN, ADVISORY, ERROR = "warn", "advisory", "error"
MICROSOFT, GOOGLE, AP, CHICAGO, PLAIN = "microsoft", "google", "ap", "chicago", "plain"
PACKS = (MICROSOFT, GOOGLE, AP, CHICAGO, PLAIN)
Hit = tuple[int, int, str | None, dict]


@dataclass(frozen=True)
class Rule:
    id: str
    family: str
    severity: str
    message: str
    search: Callable[[Document], Iterable[Hit]]
    pack: str | None = None
    needs: frozenset[str] = frozenset()
    #: The span is the name in the values, not the text at the offset.
    named: bool = False


@dataclass(frozen=True)
class Scan:
    """Matches of patterns (pattern, flags); where keeps a match; least of them and rate per 1000 words must be reached; once gives the first only."""

    patterns: tuple[tuple[str, str], ...]
    where: Callable[[Document, re.Match], bool] | None = None
    group: int = 0
    cap: int = 10**9
    least: int = 1
    once: bool = False
    size: int | None = None
    shift: int = 0
    swaps: dict[str, str] = field(default_factory=dict)
    level: Callable[[Document, list], str | None] | None = None

    def __call__(self, doc: Document) -> Iterable[Hit]:
        found = []
        for pattern, flags in self.patterns:
            for m in compiled(pattern, flags).finditer(doc.masked):
                if self.where is None or self.where(doc, m):
                    found.append(m)
        if len(found) < self.least:
            return
        level = self.level(doc, found) if self.level else None
        if level == "":
            return
        for m in found[:1] if self.once else found:
            start, end = (m.start(self.group), m.end(self.group)) if self.group else (m.start(), m.end())
            values = {"m0": m[0], "m1": m[1] if m.re.groups else m[0], "m2": m[2] if m.re.groups > 1 else "", "n": len(found), "rate": doc.per_thousand(len(found))}
            if self.swaps:
                values["to"] = self.swaps.get(m[0].lower(), self.swaps.get(m[0], ""))
            yield start + self.shift, self.size if self.size is not None else min(end - start, self.cap), level, values


def outside_tables(doc: Document, m: re.Match) -> bool:
    return not doc.in_table(m.start())


def unhidden(doc: Document, m: re.Match) -> bool:
    """The match does not span hidden text."""
    return doc.text[m.start() : m.end()] == m[0]


def literals(words: Iterable[str]) -> frozenset[str]:
    return frozenset(w.lower() for w in words)


def scan(id: str, family: str, severity: str, message: str, pattern: str, flags: str = "", pack: str | None = None, needs: str = "", table: bool = True, **more) -> Rule:
    """A rule of one pattern; table=False leaves out lines of tables; needs is separated by |."""
    if not table:
        more["where"] = (lambda w: lambda d, m: outside_tables(d, m) and w(d, m))(more["where"]) if "where" in more else outside_tables
    return Rule(id, family, severity, message, Scan(((pattern, flags),), **more), pack, literals(needs.split("|")) if needs else frozenset())


def listed(id: str, family: str, severity: str, message: str, words: Iterable[str], pack: str | None = None, build=any_phrase, **more) -> Rule:
    words = list(words)
    return Rule(id, family, severity, message, Scan(((build(words), "gi"),), **more), pack, literals(words))


def swapped(id: str, family: str, severity: str, label: str, table: dict[str, str], pack: str | None = None, build=any_phrase, same: bool = False, **more) -> Rule:
    """Avoid -> use; a match that is the preferred form already is left alone unless same."""
    if not same and "where" not in more:
        more["where"] = lambda d, m: m[0] != table.get(m[0].lower(), table.get(m[0]))
    return Rule(id, family, severity, label + ': "{m0}" → "{to}"', Scan(((build(list(table)), "gi"),), swaps=table, **more), pack, literals(table))


def joined(*rules: Callable[[Document], Iterable[Hit]]) -> Callable[[Document], Iterable[Hit]]:
    def search(doc: Document) -> Iterable[Hit]:
        for r in rules:
            yield from r(doc)

    return search


# --- searches that are not a scan ---------------------------------------------------------------------------


def overused(doc: Document) -> Iterable[Hit]:
    hits = list(compiled(any_word(L.OVERUSED), "gi").finditer(doc.masked))
    kinds = {m[1].lower() for m in hits}
    if len(kinds) < 2 and not (len(hits) >= 2 and doc.per_thousand(len(hits)) >= 4):
        return
    heavy = doc.per_thousand(sum(L.OVERUSED[m[1].lower()] for m in hits)) >= 20
    for m in hits:
        yield m.start(), len(m[1]), WARN if len(kinds) >= 3 or heavy else ADVISORY, {"m0": m[1], "n": len(kinds), "rate": doc.per_thousand(len(hits))}


SHAPED = compiled(r"^\s*\*\*[^*]+\*\*\s*[:—-]")


def bold_runs(doc: Document) -> Iterable[Hit]:
    """Runs of three or more list items on consecutive lines that begin with a bold label."""
    run: list = []
    for item in [*doc.items, None]:
        shaped = item is not None and SHAPED.match(item.text)
        if not (shaped and run and item.line == run[-1].line + 1):
            if len(run) >= 3:
                yield run[0].start, 0, None, {"n": len(run)}
            run = []
        if shaped:
            run.append(item)


def emoji(doc: Document) -> Iterable[Hit]:
    """Emoji at the start of lines, also after a list marker; most texts have none at all."""
    return EMOJI(doc) if compiled(f"[{EMOJIS}]").search(doc.masked) else ()


# What counts as emoji.
EMOJIS = "\\u2600-\\u27bf\\u2b00-\\u2bff\\ufe0f\\U0001f000-\\U0001faff"
EMOJI = Scan(((f"^\\s*(?:[-*+]\\s*)?([{EMOJIS}])", "gm"),), group=1)


def hedge_level(doc: Document, found: list) -> str:
    return "" if len(found) < 2 or len(found) < 3 and doc.per_thousand(len(found)) < 3 else WARN if len(found) >= 4 else ADVISORY


def passive_where(doc: Document, m: re.Match) -> bool:
    word = m[2].lower()
    if not unhidden(doc, m) or word in L.NOT_PARTICIPLES:
        return False
    after = doc.masked[m.end() : m.end() + 30]
    if compiled(r"^\s+by\b").match(after):
        return True
    return word not in L.ADJECTIVES and not compiled(r"^\s+(in|about|with|at|of|to|for)\b").match(after)


PASSIVE = r"\b(am|is|are|was|were|be|been|being)\s+(?:\w+ly\s+){0,2}([a-z]+(?:ed|en)|" + "|".join(L.IRREGULAR) + r")\b"


def passive(doc: Document) -> Iterable[Hit]:
    for m in compiled(PASSIVE, "gi").finditer(doc.masked):
        if passive_where(doc, m):
            agent = compiled(r"^\s+by\b").match(doc.masked[m.end() : m.end() + 30])
            yield m.start(), len(m[0]), WARN if agent else ADVISORY, {"m0": m[0].strip(BLANKS), "m2": m[2].lower()}


def long_sentences(least: int, most: float, cap: int):
    def search(doc: Document) -> Iterable[Hit]:
        for s, n in zip(doc.sentences, doc.sentence_words, strict=True):
            if least < n <= most:
                yield s.start, min(len(s.text), cap), None, {"n": n}

    return search


HEAD_WORD = compiled(r"[A-Za-z][A-Za-z'’-]*")


def title_case(doc: Document) -> Iterable[Hit]:
    for h in doc.headings:
        words = HEAD_WORD.findall(re.split("[:—]", h.text)[0])
        capped = [w for w in words[1:] if w.lower() not in L.SMALL_WORDS and not re.fullmatch("[A-Z]{2,}", w) and re.match("[A-Z][a-z]", w)]
        if len(words) >= 3 and len(capped) >= 2:
            yield h.start, len(h.raw), None, {"name": h.text}


def headings(test: Callable[[str], object]):
    def search(doc: Document) -> Iterable[Hit]:
        for h in doc.headings:
            if test(h.text):
                yield h.start, len(h.raw), None, {"name": h.text}

    return search


def in_headings(pattern: str):
    def search(doc: Document) -> Iterable[Hit]:
        for h in doc.headings:
            at = h.start + max(0, h.raw.find(h.text))
            for m in compiled(pattern).finditer(h.text):
                yield at + m.start(), len(m[0]), None, {"m0": m[0]}

    return search


def word_swap_where(doc: Document, m: re.Match) -> bool:
    covered = {MICROSOFT: ("e.g.", "i.e."), GOOGLE: ("e.g.", "i.e.", "etc")}.get(doc.style, ())
    return m[0].lower() not in covered


def gendered_where(doc: Document, m: re.Match) -> bool:
    return doc.style not in (MICROSOFT, GOOGLE) or m[0].lower() not in L.GENDERED_COVERED


def vague_links(doc: Document) -> Iterable[Hit]:
    for x in doc.links:
        if x.text.strip(BLANKS).lower() in L.VAGUE_LINKS:
            yield x.start, len(x.text) + 2, None, {"name": x.text}


def heading_jumps(doc: Document) -> Iterable[Hit]:
    for before, h in zip(doc.headings, doc.headings[1:], strict=False):
        if h.level > before.level + 1:
            yield h.start, len(h.raw), WARN, {"name": h.text, "what": f"jumps from h{before.level} to h{h.level}"}
    for h in [h for h in doc.headings if h.level == 1][1:2]:
        yield h.start, len(h.raw), ADVISORY, {"name": h.text, "what": "is a second h1"}


def bold_share(doc: Document) -> Iterable[Hit]:
    n = len(doc.bold)
    if n >= 4 and n / max(doc.n_words, 1) * 100 >= 3:
        yield *doc.bold[0], None, {"n": n}


def listicle(doc: Document) -> Iterable[Hit]:
    items = doc.items
    if len(items) >= 5 and sum(count_words(i.text) <= 4 for i in items) >= len(items) * 0.5:
        yield items[0].start, 0, None, {"n": len(items)}


def cadence(doc: Document) -> Iterable[Hit]:
    counts = [n for n in doc.sentence_words if n]
    if len(counts) >= 6 and (mean := sum(counts) / len(counts)) >= 4:
        cv = math.sqrt(sum((n - mean) ** 2 for n in counts) / len(counts)) / mean
        if cv < 0.25:
            yield doc.sentences[0].start, 0, None, {"cv": cv}


def adverbs(doc: Document) -> Iterable[Hit]:
    hits = [m for m in compiled(r"\b(\w{3,}ly)\b", "gi").finditer(doc.masked) if m[1].lower() not in L.NOT_ADVERBS]
    if len(hits) >= 5 and doc.per_thousand(len(hits)) >= 25:
        yield hits[0].start(), len(hits[0][0]), None, {"n": len(hits)}


def needless_adverbs(doc: Document) -> Iterable[Hit]:
    """Adverbs of the caller's list, or by the rule; two at least."""
    if doc.adverbs is None:
        found = [m for m in compiled(ADVERB, "gi").finditer(doc.masked) if m[0].lower() not in L.NOT_ADVERBS]
    else:
        found = list(compiled(any_word(sorted(doc.adverbs)), "gi").finditer(doc.masked)) if doc.adverbs else []
    for m in found if len(found) >= 2 else ():
        yield m.start(), len(m[0]), None, {"m0": m[0]}


def acronyms(doc: Document) -> Iterable[Hit]:
    seen = set()
    for m in compiled(r"\b([A-Z]{3,5})s?\b", "g").finditer(doc.masked):
        name = m[1]
        if name in L.ACRONYMS or name in seen or doc.masked[m.end() : m.end() + 1] == ".":
            continue
        seen.add(name)
        if not compiled(name + r"\s*\)|\(" + name + r"\)").search(doc.masked):
            yield m.start(), len(name), None, {"m0": name}


@lru_cache(maxsize=1 << 15)
def syllables(word: str) -> int:
    """Remembered: a few thousand words make most of any prose, and the patterns below cost more than all else that a grade needs."""
    w = re.sub("[^a-z]", "", word.lower())
    if not w:
        return 0
    if w in L.SYLLABLES:
        return L.SYLLABLES[w]
    heart = re.sub("^y", "", re.sub("(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", w))
    return max(1, len(re.findall("[aeiouy]{1,2}", heart)) + bool(re.search("[^aeiouy]le$", w)) + bool(re.search("ia|io|ua|eo", w)))


def grade(words: int, sentences: int, syllable_total: int, letters: int) -> float:
    """Mean of the Flesch-Kincaid and Coleman-Liau grades."""
    w, s = max(words, 1), max(sentences, 1)
    return ((0.39 * w / s + 11.8 * syllable_total / w - 15.59) + (0.0588 * (letters / w * 100) - 0.296 * (s / w * 100) - 15.8)) / 2


def reading(doc: Document) -> Iterable[Hit]:
    words = compiled("[A-Za-z]+(?:'[A-Za-z]+)?").findall(doc.masked)
    if len(words) >= 30:
        g = grade(len(words), len(doc.sentences), sum(map(syllables, words)), count_letters(doc.masked))
        if g > 8:
            yield 0, 0, None, {"grade": g}


def terminology(doc: Document) -> Iterable[Hit]:
    for variants in L.VARIANTS:
        found = [(v, m) for v in variants if v in doc.lower and (m := compiled(rf"\b{re.escape(v)}\b").search(doc.lower))]
        if len(found) >= 2:
            yield found[1][1].start(), len(found[1][0]), None, {"m0": " / ".join(v for v, _ in found)}


def inner_caps(doc: Document, m: re.Match) -> bool:
    w = m[0]
    return w not in L.BRANDS and len(w) <= 16 and not re.search("[0-9]", w) and not re.search("[A-Z].*[A-Z]", w)


def numeral_starts(doc: Document) -> Iterable[Hit]:
    lists = {i.start for i in doc.items}
    for s in doc.sentences:
        if s.start not in lists and "0" <= (s.text.lstrip(BLANKS + ">*_-")[:1] or "x") <= "9":
            yield s.start, 4, None, {}


FENCE = compiled("^([ \\t]*)```([^\\n`]*)$", "gm")


def bare_fences(doc: Document) -> Iterable[Hit]:
    if "```" in doc.text:
        for k, m in enumerate(FENCE.finditer(doc.text)):
            if k % 2 == 0 and not m[2].strip(BLANKS):
                yield m.start() + len(m[1]), 3, None, {}


def same_headings(doc: Document) -> Iterable[Hit]:
    seen = set()
    for h in doc.headings:
        key = h.text.strip(BLANKS).lower()
        if key and key in seen:
            yield h.start, len(h.raw), None, {"name": h.text}
        seen.add(key)


def acronym_case(doc: Document) -> Iterable[Hit]:
    upper = {w.lower() for w in compiled(r"\b[A-Z]{2,6}\b").findall(doc.masked) if w in L.ACRONYMS} - L.CASE_STOP
    if upper:
        for m in compiled(r"\b[a-z]{2,6}\b").finditer(doc.masked):
            if m[0] in upper:
                upper.discard(m[0])
                yield m.start(), len(m[0]), None, {"m0": m[0]}


def mixed_titles(doc: Document) -> Iterable[Hit]:
    """Phrases of capitalised words that also occur in lower case."""
    lines, seen = {h.line for h in doc.headings}, set()
    for m in compiled(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", "g").finditer(doc.masked):
        words, at = compiled(r"\s+").split(m[0]), m.start()
        while words and words[0].lower() in L.CAP_STOP:
            at += len(words.pop(0)) + 1
        phrase = " ".join(words)
        key = phrase.lower()
        if len(words) < 2 or key in seen or doc.line(at) in lines or doc.in_table(at):
            continue
        if key in doc.masked and compiled(rf"\b{key}\b").search(doc.masked):
            seen.add(key)
            yield at, len(phrase), None, {"m0": phrase}


EXEMPT = compiled(r"master'?s|scrum master|master class|native speaker|primitive type|native to", "i")


def historical(doc: Document) -> Iterable[Hit]:
    for m in compiled(any_phrase(L.HISTORICAL), "gi").finditer(doc.masked):
        yield m.start(), len(m[0]), WARN, {"m0": m[0], "to": L.HISTORICAL[m[0].lower()]}
    for m in compiled(any_word(L.HISTORICAL_ADVISORY), "gi").finditer(doc.masked):
        if not EXEMPT.search(doc.masked[max(0, m.start() - 12) : m.end() + 12]):
            yield m.start(), len(m[0]), ADVISORY, {"m0": m[0], "to": L.HISTORICAL_ADVISORY[m[0].lower()]}


def missing_alt(doc: Document) -> Iterable[Hit]:
    for x in doc.images:
        if not x.text.strip(BLANKS):
            yield x.start, 4, None, {"name": x.target}


def break_headings(doc: Document) -> Iterable[Hit]:
    lines = {h.line for h in doc.headings}
    for line, start in doc.breaks if lines else ():
        below = next((k for k in range(line + 1, len(doc.lines) + 1) if doc.lines[k - 1].strip(BLANKS)), 0)
        if below in lines:
            yield start, 3, None, {}


def bullets(doc: Document) -> Iterable[Hit]:
    if len(doc.items) >= 8 and len(doc.items) >= sum(bool(x.strip(BLANKS)) for x in doc.lines) * 0.5:
        yield doc.items[0].start, 0, None, {"n": len(doc.items)}


def article_where(doc: Document, m: re.Match) -> bool:
    if not unhidden(doc, m):
        return False
    word = m[2].lower()
    vowel = word[0] in "aeiou"
    wants_an = (vowel and word not in L.A_BEFORE_VOWEL) or (not vowel and word in L.AN_BEFORE_CONSONANT)
    return wants_an != (m[1].lower() == "an")


def bare_url_where(doc: Document, m: re.Match) -> bool:
    line = doc.masked.rfind("\n", 0, m.start()) + 1
    return not compiled(r"\]:\s*$").search(doc.masked[max(line, m.start() - 200) : m.start()])


def isbn(doc: Document, m: re.Match) -> bool:
    return len(re.sub("[^0-9Xx]", "", m[1])) not in (10, 13)


def unused(doc: Document) -> Iterable[Hit]:
    for name, start, length in doc.definitions:
        if name not in doc.uses:
            yield start, length, None, {"m0": name}


def serial_search(doc: Document) -> Iterable[Hit]:
    return () if doc.style == AP else SERIAL(doc)


SERIAL = Scan(((r"\b\w+,\s+\w+\s+(and|or)\s+\w+\b", "gi"),), where=lambda d, m: not d.opens_sentence(m.start()))


def ap_comma(doc: Document) -> Iterable[Hit]:
    for m in compiled(r"\b\w+,\s+\w+(,)\s+(and|or)\s+\w+\b", "gi").finditer(doc.masked):
        at = m[0].find(", " + m[2])
        yield m.start() + at, 1, None, {"m2": m[2]}


# Patterns that several rules share.
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)|May|Jun(?:e)|Jul(?:y)|Aug(?:ust)|Sep(?:tember)?|Oct(?:ober)|Nov(?:ember)?|Dec(?:ember)?"
GOOGLE_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
NUMBERS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred"
ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth|twentieth|twenty-first|twenty-second|twenty-third|twenty-fourth|twenty-fifth|twenty-sixth|twenty-seventh|twenty-eighth|twenty-ninth|thirtieth|thirty-first"
DIGIT = r"(?<![\w.$%/-])([0-9])(?![\w.,:%/-])"
FIRST_PERSON = r"\b(?:I'd|I'll|I'm|I've|I|me|my|mine)\b"
MONTH_NEEDS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
#: The adverbs of microsoft-adverbs, where no list is given: words in -ly that are no nouns or adjectives, and these.
ADVERB = r"\b(\w{3,}ly|quite|very)\b"


def bias(id: str, pack: str, table: dict[str, str]) -> Rule:
    searches = [Scan(((rf"\b(?:{p})\b", "gi"),), swaps=_Same(to)) for p, to in table.items()]
    stems = "air anchor camera door draft drafts fire fisher fresh garbage mail middle news police repair sales service tribes work".split()
    needs = [f"{x}{y}" for x in stems for y in ("man", "men", "woman", "women")]
    needs += ["alumn", "authoress", "lady lawyer", "ladylike", "man and wife", "man enough", "mankind", "manmade", "manpower", "ombuds", "oneupmanship", "poetess", "steward", "waitress", "woman doctor", "woman scientist"]
    return Rule(id, INCLUSIVE, WARN, 'Consider "{to}" for "{m0}"', joined(*searches), pack, literals(needs))


class _Same(dict):
    """One replacement for whatever is found."""

    def __init__(self, to: str) -> None:
        super().__init__({"": to})
        self.to = to

    def get(self, key, default=None):
        return self.to


# The patterns in the rules below, their thresholds, and which rules there are.
RULES: list[Rule] = [
    # machine prose
    Rule("overused-word", SLOP, WARN, '"{m0}" is overused ({n} such words, {rate:.1f}/1k)', overused, needs=literals(L.OVERUSED)),
    listed("marketing-buzzword", SLOP, WARN, 'Buzzword "{m0}"', L.BUZZWORDS, build=any_word),
    scan(
        "cliche-opener",
        SLOP,
        WARN,
        'Stock opener "{m0}"',
        r"(In today's (?:fast-paced|modern|digital) world|In the (?:ever-evolving|ever-changing|rapidly changing) (?:landscape|world) of|In the realm of|When it comes to|At its core|In the world of)",
        "gi",
        needs="in today's|in the |when it comes to|at its core",
        where=lambda d, m: d.opens_sentence(m.start()),
    ),
    scan(
        "filler-phrase",
        SLOP,
        WARN,
        'Filler "{m0}"',
        r"(It'?s important to note that|It is important to note|It'?s worth noting|It is worth noting|worth mentioning that|Needless to say|At the end of the day|That being said|It should be noted that)",
        "gi",
        needs="important to note|worth noting|worth mentioning|needless to say|end of the day|that being said|should be noted",
    ),
    Rule(
        "manufactured-contrast",
        SLOP,
        WARN,
        "Contrast made for effect",
        joined(Scan(((r"\bnot\s+(just|only|merely|simply)\b[^.!?\n]*?\b(it'?s|but|rather|they'?re|we'?re)\b", "gi"),)), Scan(((r"\bnot only\b[^.!?\n]*?\bbut(?:\s+also)?\b", "gi"),))),
        needs=frozenset(["not"]),
    ),
    scan("conclusion-restate", SLOP, WARN, 'Formula "{m2}"', r"^(\s{0,3}>?\s*)(In conclusion|In summary|To sum up|In essence|Overall|Ultimately|All in all)\b", "gim", needs="in conclusion|in summary|to sum up|in essence|overall|ultimately|all in all", group=2),
    scan(
        "vague-attribution",
        SLOP,
        WARN,
        '"{m0}" without a source',
        r"\b(studies show|research suggests|research shows|experts (?:say|argue|believe)|many believe|it is widely (?:regarded|believed|known)|industry reports|some say|critics argue)\b",
        "gi",
        needs="studies show|research s|experts |many believe|it is widely|industry reports|some say|critics argue",
        where=lambda d, m: not compiled(r"\]\(|https?:\/\/|\[\d+\]|\^\d").search(d.masked[m.start() : m.start() + 200]),
    ),
    scan("despite-challenges-closer", SLOP, WARN, "Despite-challenges ending", r"despite (?:its|these|the|ongoing|numerous)[^.!?\n]*?(?:challenges|difficulties|obstacles|setbacks)[^.!?\n]*?(?:continues to|remains|still)\s+(?:thrive|evolve|grow|serve|play|stand|endure)", "gi", needs="despite "),
    scan(
        "significance-boilerplate",
        SLOP,
        WARN,
        'Claimed significance "{m0}"',
        r"(stands as a testament|marking a pivotal moment|leaving an indelible mark|enduring legacy|key turning point|plays a (?:vital|crucial|pivotal|key|significant) role|rich (?:history|tapestry|tradition))",
        "gi",
        needs="stands as a|marking a|leaving an|enduring legacy|key turning|plays a |rich ",
    ),
    scan("em-dash-overuse", SLOP, WARN, "{n} dashes ({rate:.1f}/1k)", r"—|(?<=\s)--(?=\s)", "g", needs="—|--", least=3, once=True, size=1, level=lambda d, f: None if d.per_thousand(len(f)) > 4 else ""),
    Rule("emoji-decoration", SLOP, WARN, "Emoji as decoration", emoji),
    Rule("bold-lead-in-list", SLOP, WARN, "{n} list items in a row with bold labels", bold_runs, needs=frozenset(["**"])),
    scan(
        "assistant-meta",
        SLOP,
        ERROR,
        'Assistant phrase "{m0}"',
        r"(As an AI language model|as of my (?:knowledge cutoff|last (?:update|training))|I hope this helps|Certainly!|I'd be happy to|Let me know if you|Feel free to (?:ask|reach)|Here's a breakdown|\[insert [^\]]+\](?![([])|\[Your Name\]|\[Your Company\])",
        "gi",
        needs="as an ai|as of my|i hope this|certainly!|i'd be happy|let me know|feel free|here's a|[insert |[your ",
    ),
    scan("sycophancy", SLOP, WARN, 'Flattery "{m0}"', r"\b(Great question|You're absolutely right|That's a great point|Excellent question|What a fascinating)\b", "gi", needs="great question|absolutely right|great point|excellent question|a fascinating"),
    scan("smart-quotes", SLOP, ADVISORY, "{n} curly quotes", "[‘’“”]", "g", needs="‘|’|“|”", least=3, once=True, size=1),
    scan("unicode-artifact", SLOP, WARN, "Invisible character", "[  ​‌‍﻿]", "g", needs=" | |​|‌|‍|﻿", size=1),
    listed("hedge-overuse", SLOP, WARN, 'Hedge "{m0}"', L.HEDGES, level=hedge_level),
    # clarity
    Rule("passive-voice", CLARITY, ADVISORY, 'Passive "{m0}"', passive),
    Rule("long-sentence", CLARITY, WARN, "Sentence of {n} words", long_sentences(30, math.inf, 60)),
    swapped("wordy-phrase", CLARITY, WARN, "Wordy", L.WORDY, same=True),
    swapped("complex-word", CLARITY, ADVISORY, "Complex", L.COMPLEX, same=True),
    swapped("nominalization", CLARITY, ADVISORY, "Noun for a verb", L.NOMINAL, same=True),
    listed("weasel-word", CLARITY, ADVISORY, 'Weasel word "{m0}"', L.WEASELS, build=any_word, least=2, level=lambda d, f: "" if len(f) < 3 and d.per_thousand(len(f)) < 4 else None),
    listed("redundant-pair", CLARITY, WARN, 'Redundant "{m0}"', L.PAIRS),
    scan("repeated-word", CLARITY, WARN, 'Repeated "{m1}"', r"\b(\w++)\s+\1\b", "gi", where=lambda d, m: m[1].lower() not in ("that", "had")),
    scan("there-is-expletive", CLARITY, ADVISORY, 'Weak subject "{m1} … {m2}"', r"\b(There (?:is|are|was|were)|It is)\s+[^.!?\n]{3,40}?\b(that|who|which)\b", "gi", needs="there is|there are|there was|there were|it is|there\n", cap=40, where=lambda d, m: d.opens_sentence(m.start())),
    # style
    Rule("sentence-case-heading", STYLE, ADVISORY, 'Title case in "{name}"', title_case, named=True, needs=frozenset("#")),
    Rule("heading-end-punctuation", STYLE, WARN, "Heading ends in punctuation", headings(lambda t: t.strip(BLANKS)[-1:] in (".", ":", "!")), named=True, needs=frozenset("#")),
    swapped("word-swap", STYLE, ADVISORY, "Swap", L.WORD_SWAP, where=word_swap_where),
    # inclusive
    swapped("gendered-language", INCLUSIVE, WARN, "Gendered", L.GENDERED, build=any_word, where=gendered_where),
    Rule(
        "ableist-language",
        INCLUSIVE,
        WARN,
        'Ableist "{m0}" → "{to}"',
        joined(Scan(((any_phrase(L.ABLEIST_WARN), "gi"),), swaps=L.ABLEIST_WARN, level=lambda d, f: WARN), Scan(((any_phrase(L.ABLEIST_ADVISORY), "gi"),), swaps=L.ABLEIST_ADVISORY, level=lambda d, f: ADVISORY)),
        needs=literals([*L.ABLEIST_WARN, *L.ABLEIST_ADVISORY]),
    ),
    Rule("vague-link-text", INCLUSIVE, WARN, 'Link text "{name}" says nothing', vague_links, named=True, needs=frozenset(["]("])),
    Rule("skipped-heading", INCLUSIVE, WARN, "Heading {what}", heading_jumps, named=True, needs=frozenset("#")),
    # more machine prose
    Rule(
        "negative-parallelism",
        SLOP,
        ADVISORY,
        "Stacked negations",
        Scan(((r",\s+not\s+[^.,!?\n]{2,30}[.!?]", "gi"), (r"\bNot\s+\w+\.\s+Not\s+\w+", "g"), (r"\b\w+\s+rather than\s+\w+", "gi"), (r"(^|\n)\s*Rather,\s", "g")), least=2, cap=40),
        needs=frozenset(["not", "rather"]),
    ),
    scan("tricolon-overuse", SLOP, ADVISORY, "Series of three, {n} times", r"\b\w+,\s+\w+,\s+and\s+\w+\b", "gi", needs="and", least=3),
    listed("serves-as-copula", SLOP, ADVISORY, '"{m0}" for "is"', L.SERVES_AS, least=2),
    listed("media-coverage-boilerplate", SLOP, ADVISORY, 'Coverage phrase "{m0}"', L.MEDIA),
    listed("future-outlook-speculation", SLOP, ADVISORY, 'Outlook phrase "{m0}"', L.OUTLOOK),
    listed("conversational-scaffolding", SLOP, ADVISORY, 'Scaffolding "{m0}"', L.SCAFFOLDING),
    scan("superficial-ing-participle", SLOP, ADVISORY, 'Trailing "{m1}"', r",\s+(highlighting|underscoring|emphasizing|reflecting|symbolizing|showcasing|fostering|ensuring|contributing to|paving the way)\b", "gi", needs="ing", group=1, least=2),
    scan("transition-scaffolding", SLOP, ADVISORY, 'Opens with "{m2}"', r"(^|\n)\s*(Additionally|Moreover|Furthermore|However|Consequently|Nevertheless)\b", "g", needs="additionally|moreover|furthermore|however|consequently|nevertheless", group=2, least=2),
    Rule("interrogative-answer", SLOP, ADVISORY, "Question and fragment", lambda d: [(m.end(1), len(m[0]) - len(m[1]), None, {}) for m in compiled(r"(^|[.!?]\s)((?:The|Its|Their|His|Her|Our)\s+\w+)\?\s+[A-Z]\w+\.", "g").finditer(d.masked)], needs=frozenset("?")),
    Rule("excessive-bold", SLOP, ADVISORY, "{n} bold spans", bold_share, needs=frozenset(["**", "__"])),
    Rule("listicle-reflex", SLOP, ADVISORY, "{n} list items, most of them short", listicle),
    Rule("uniform-cadence", SLOP, ADVISORY, "Sentences of one length (variation {cv:.2f})", cadence),
    scan("emphasis-as-heading", SLOP, ADVISORY, "Bold line for a heading", r"^[ \t]*(\*\*|__)([^*_\n]{1,48}?[^*_\n\s.:!?,;])\1[ \t]*$", "gm", needs="**|__", table=False),
    listed("hype-intensifier", SLOP, ADVISORY, 'Hype "{m0}"', L.HYPE),
    scan("bare-url", INCLUSIVE, ADVISORY, "Bare address", r"""(?<![("'<=\]])\bhttps?:\/\/[^\s)>\]"']+""", "g", needs="http", cap=50, where=bare_url_where),
    Rule("fenced-code-language", STYLE, ADVISORY, "Code block without a language", bare_fences),
    Rule("duplicate-heading", STYLE, ADVISORY, 'Heading "{name}" again', same_headings, named=True, needs=frozenset("#")),
    Rule("acronym-case", STYLE, ADVISORY, '"{m0}" is in capitals elsewhere', acronym_case),
    scan("acronym-plural", STYLE, ADVISORY, '"{m0}" for a plural', r"\b([A-Z]{2,5})'s\b", "g", needs="'s"),
    Rule("inconsistent-capitalization", STYLE, ADVISORY, '"{m0}" also in lower case', mixed_titles),
    Rule("adverb-overuse", CLARITY, ADVISORY, "{n} adverbs", adverbs, needs=frozenset(["ly"])),
    Rule("undefined-acronym", CLARITY, ADVISORY, 'Acronym "{m0}" is never explained', acronyms),
    Rule("reading-grade", CLARITY, ADVISORY, "Reading grade {grade:.1f}", reading, PLAIN),
    Rule("serial-comma", STYLE, ADVISORY, 'No comma before "{m1}"', serial_search, needs=frozenset([","])),
    swapped("use-contractions", STYLE, ADVISORY, "Contract", L.CONTRACTIONS, same=True),
    scan("second-person", STYLE, ADVISORY, 'Third person "{m0}"', r"\b(the user|users)\s+(should|can|must|may|need to|needs to|will|might|have|has|access|get)\b", "gi", needs="user"),
    scan("present-tense", STYLE, ADVISORY, 'Future "{m0}"', r"\byou will\s+(\w+)\b", "gi", needs="you will"),
    swapped("singular-they", STYLE, WARN, "Singular they", L.PRONOUN_PAIRS),
    scan("no-please-instructions", STYLE, ADVISORY, '"please" in instructions', r"\bplease\b", "gi", needs="please"),
    Rule("terminology-consistency", STYLE, ADVISORY, "Variants {m0}", terminology, needs=literals(w for v in L.VARIANTS for w in v)),
    scan("no-space-em-dash", STYLE, ADVISORY, "{n} spaced dashes", r"\s—\s", "g", MICROSOFT, "—", once=True, size=1),
    scan("no-internal-caps", STYLE, ADVISORY, 'Capitals inside "{m0}"', r"\b[a-z]+[A-Z]\w*\b", "g", MICROSOFT, where=inner_caps),
    scan("omit-you-can", STYLE, ADVISORY, '"you can"', r"\byou can\b", "gi", MICROSOFT, "you can"),
    scan("avoid-we", STYLE, ADVISORY, '"we" {n} times', r"\b(we|we're|our|us)\b", "gi", MICROSOFT, "we|our|us", least=3, once=True, size=2),
    scan("spell-out-small-numbers", STYLE, ADVISORY, 'Spell out "{m1}"', DIGIT, "g", MICROSOFT, table=False, size=1),
    Rule("no-numeral-sentence-start", STYLE, ADVISORY, "Sentence starts with a numeral", numeral_starts, MICROSOFT),
    scan("large-number-grouping", STYLE, ADVISORY, 'Group the digits of "{m0}"', r"(?<![\w,.#/:=-])\d{5,}(?![\w,.])", "g", MICROSOFT, table=False),
    scan("no-k-m-b", STYLE, ADVISORY, 'Magnitude letter in "{m0}"', r"\$?\b\d+(?:\.\d+)?\s?[KMB]\b", "g", MICROSOFT),
    scan("leading-zero", STYLE, ADVISORY, "No zero before the point", r"(?<![\d.])\.\d", "g", MICROSOFT, "."),
    Rule("no-gerund-heading", STYLE, WARN, "Heading starts with a gerund", headings(lambda t: len(w := (re.findall("[A-Za-z]+", t) or [""])[0]) > 4 and w.lower().endswith("ing")), GOOGLE, named=True, needs=frozenset("#")),
    Rule("no-link-in-heading", STYLE, WARN, "Link in a heading", headings(lambda t: compiled(r"\[[^\]]+\]\([^)]+\)").search(t)), GOOGLE, named=True, needs=frozenset("#")),
    swapped("latinism-abbreviation", STYLE, WARN, "Spell out", L.LATINISMS, GOOGLE),
    listed("minimizing-words", STYLE, WARN, 'Minimizing "{m0}"', L.MINIMIZING, GOOGLE),
    scan("no-abbreviation-as-verb", STYLE, ADVISORY, '"{m1}" as a verb', r"(?<!use )(?<!using )\b(ssh|rsync|scp|ftp|chmod|grep)\s+(into|to)\b", "gi", GOOGLE, "ssh|rsync|scp|ftp|chmod|grep"),
    scan("no-periods-in-acronyms", STYLE, ADVISORY, 'Periods in "{m0}"', r"\b(?:[A-Za-z]\.){2,}", "g", GOOGLE, ".", where=lambda d, m: m[0].lower() not in ("e.g.", "i.e.", "etc.")),
    scan("no-exclamation", STYLE, WARN, "Exclamation mark", r"\w!(?!=)", "g", GOOGLE, "!", shift=1, size=1),
    swapped("american-spelling", STYLE, WARN, "American spelling", L.BRITISH, GOOGLE),
    listed("no-preannounce", STYLE, ADVISORY, 'Wording that dates "{m0}"', L.PREANNOUNCE, GOOGLE),
    swapped("no-directional", STYLE, ADVISORY, "Direction", L.DIRECTIONAL, GOOGLE),
    Rule("ap-serial-comma", STYLE, ADVISORY, 'Comma before "{m2}"', ap_comma, AP, frozenset([","])),
    scan("ap-number-style", STYLE, ADVISORY, 'Spell out "{m1}"', DIGIT, "g", AP, table=False, size=1),
    scan("chicago-number-style", STYLE, ADVISORY, 'Spell out "{m1}"', r"(?<![\w.$%/:-])(\d{1,3})(?![\w.,:%/-])", "g", CHICAGO, table=False, where=lambda d, m: int(m[1]) <= 100),
    Rule("plain-long-sentence", STYLE, ADVISORY, "Sentence of {n} words", long_sentences(20, 30, 40), PLAIN),
    swapped("person-first-language", INCLUSIVE, WARN, "Person first", L.PERSON_FIRST),
    scan("gendered-address", INCLUSIVE, ADVISORY, 'Address "{m0}"', r"\b(guys|gentlemen|ladies)\b", "gi", needs="guys|gentlemen|ladies"),
    Rule("tech-historical-terms", INCLUSIVE, WARN, 'Term "{m0}" → "{to}"', historical, needs=literals([*L.HISTORICAL, *L.HISTORICAL_ADVISORY])),
    swapped("violent-tech-metaphor", INCLUSIVE, ADVISORY, "Violent metaphor", L.VIOLENT, build=any_word, where=lambda d, m: not compiled(r"^\s*-?\d").match(d.masked[m.end() : m.end() + 8])),
    swapped("ageist-classist-cultural", INCLUSIVE, ADVISORY, "Reconsider", L.AGEIST),
    Rule("missing-alt-text", INCLUSIVE, WARN, "Image without a description", missing_alt, named=True, needs=frozenset(["!["])),
    scan("all-caps-shouting", INCLUSIVE, ADVISORY, "Run of capitals", r"\b[A-Z]{2,}(?:\s+[A-Z]{2,}){2,}\b", "g", cap=40),
    scan("markup-leak", STYLE, ADVISORY, 'No space after "#"', r"^\s{0,3}#{1,6}[^\s#]", "gm", needs="#"),
    Rule("thematic-break-before-heading", STYLE, ADVISORY, "Rule before a heading", break_headings, needs=frozenset("#")),
    Rule("bullet-overuse", STYLE, ADVISORY, "{n} list items make most of the lines", bullets),
    scan("double-space", STYLE, ADVISORY, "Two spaces", r"([^\s.!?:;])(  )(\S)", "g", needs="  ", table=False, shift=1, size=2),
    listed("redundant-acronym", STYLE, WARN, 'Redundant "{m0}"', L.REDUNDANT_ACRONYMS),
    scan("indefinite-article", STYLE, ADVISORY, 'Article in "{m0}"', r"(?<![&\w.])(a|an)\s+([a-z][a-z'-]*)", "gi", where=article_where),
    scan("placeholder-citation", STYLE, WARN, 'Placeholder "{m0}"', r"\[citation needed\]|\(Author,\s*Year\)|\(Year\)|\[REF\]|\[TODO\]|\[TK\]|\[\?\?\]", "gi", needs="[citation|(author,|(year)|[ref]|[todo]|[tk]|[??]"),
    scan("tracking-param-in-citation", STYLE, WARN, 'Tracking parameter "{m1}"', r"https?:\/\/\S*[?&](utm_[a-z]+|fbclid|gclid)=", "gi", needs="utm_|fbclid|gclid"),
    Rule(
        "malformed-doi-isbn",
        STYLE,
        ADVISORY,
        'Malformed "{m0}"',
        joined(Scan(((r"\bdoi:\s*(\S+)", "gi"),), where=lambda d, m: not compiled(r"^10\.\d{4,}\/\S+").match(m[1])), Scan(((r"\bISBN[:\s-]*([\d Xx-]{8,})", "g"),), where=isbn)),
        needs=frozenset(["doi:", "isbn"]),
    ),
    Rule("unused-named-ref", STYLE, ADVISORY, 'Reference "{m0}" is never used', unused, needs=frozenset(["]:"])),
    # Microsoft
    scan("microsoft-ampm", STYLE, ADVISORY, "Write AM or PM after a space", r"(?:\d{1,2}[AP]M|\d{1,2} ?[ap]m|\d{1,2} ?[aApP]\.[mM]\.)(?![a-zA-Z])", "g", MICROSOFT, "am|pm|a.m|p.m", table=False),
    listed("microsoft-accessibility", INCLUSIVE, ADVISORY, 'Defines people by "{m0}"', L.ACCESSIBILITY, MICROSOFT, any_word),
    Rule("microsoft-adverbs", CLARITY, ADVISORY, 'Is "{m0}" needed?', needless_adverbs, MICROSOFT),
    scan("microsoft-auto-hyphenation", STYLE, ADVISORY, 'Hyphen in "{m0}"', r"\bauto-\w+", "gi", MICROSOFT, "auto-"),
    scan("microsoft-avoid-words", STYLE, ADVISORY, 'Avoid "{m0}"', r"\babortion\b|\band so on\b|\bapp(?:lication)?s? (?:developer|program)\b|\bapp(?:lication)? file\b|\bbackbone\b|\bbackend\b|\bcontiguous selection\b", "gi", MICROSOFT, "abortion|and so on|app|backbone|backend|contiguous"),
    swapped("microsoft-contractions", STYLE, ADVISORY, "Contract", L.IS_CONTRACTIONS, MICROSOFT, any_word, same=True),
    scan("ms-date-format", STYLE, ADVISORY, 'Date "{m0}"', rf"\b\d{{1,2}} (?:{MONTHS}) \d{{4}}\b", "gi", MICROSOFT, MONTH_NEEDS, table=False),
    scan("ms-date-numbers", STYLE, ADVISORY, "Ordinal in a date", rf"\b(?:{MONTHS})\b\s*(?:{ORDINALS})\b", "gi", MICROSOFT, MONTH_NEEDS, table=False),
    scan("ms-date-order", STYLE, ADVISORY, "Name the month", r"\b\d{1,2}\/\d{1,2}\/(?:\d{4}|\d{m2})\b", "g", MICROSOFT, "/", table=False),
    scan("ms-ellipses", STYLE, ADVISORY, "Ellipsis", r"\.\.\.|…", "g", MICROSOFT, "...|…", table=False),
    scan("ms-first-person", STYLE, WARN, 'First person "{m0}"', FIRST_PERSON, "gi", MICROSOFT, least=2),
    scan("ms-foreign-abbrev", STYLE, ADVISORY, 'Abbreviation "{m0}" → "{to}"', r"\b(?:[eE]\.[gG]\.|[iI]\.[eE]\.|[vV]iz\.|eg|ie|ergo)(?=[\s,])", "g", MICROSOFT, "e.g.|i.e.|viz.|eg|ie|ergo", swaps=L.FOREIGN),
    listed("ms-gender-slash", INCLUSIVE, WARN, '"{m0}" for a person', ["he/she", "s/he"], MICROSOFT),
    bias("ms-gender-bias", MICROSOFT, L.GENDER_BIAS),
    scan("microsoft-general-url", STYLE, ADVISORY, '"{m0}" for address', r"\bURLs?\b", "g", MICROSOFT, "url"),
    Rule("microsoft-heading-acronyms", STYLE, ADVISORY, 'Acronym "{m0}" in a heading', in_headings(r"\b[A-Z]{2,4}\b"), MICROSOFT, frozenset("#")),
    Rule("microsoft-heading-colons", STYLE, ADVISORY, "Lower case after a colon in a heading", in_headings(r":\s[a-z]"), MICROSOFT, frozenset("#")),
    scan("ms-adverb-hyphen", STYLE, ADVISORY, 'Hyphen in "{m0}"', r"\b([A-Za-z]*ly)-(\w+)\b", "g", MICROSOFT, "ly-", where=lambda d, m: m[1].lower() not in L.LY_HYPHENS),
    scan("ms-negative-number-endash", STYLE, ADVISORY, "Hyphen for a minus sign", r"(?<=\s)-\d+(?:\.\d+)?\b", "g", MICROSOFT, "-", table=False),
    listed("ms-ordinal-ly", STYLE, ADVISORY, 'Ordinal "{m0}"', ["firstly", "secondly", "thirdly"], MICROSOFT),
    scan("ms-percentages", STYLE, ADVISORY, "Numeral with percent", rf"\b(?:{NUMBERS})\s+percent\b", "gi", MICROSOFT, "percent", table=False),
    scan("ms-plurals-parenthetical", STYLE, ADVISORY, 'Plural in "{m0}"', r"\((?:s|es)\)", "g", MICROSOFT, "(s)|(es)"),
    scan("microsoft-quotes-punctuation", STYLE, WARN, "Punctuation outside the quotes", "[“”][^“”\\n]+[“”][.,]", "g", MICROSOFT, "“|”"),
    scan("microsoft-range-time", STYLE, ADVISORY, 'Dash in "{m0}"', r"\b(?:AM|PM)\s?[-–]\s?.+?(?:AM|PM)\b", "g", MICROSOFT, "am|pm", table=False),
    scan("microsoft-semicolon", STYLE, ADVISORY, "Semicolon", ";", "g", MICROSOFT, ";", table=False, size=1, where=lambda d, m: not compiled(r"&#?\w*$").search(d.masked[max(0, m.start() - 12) : m.start()])),
    scan("ms-suspended-hyphen", STYLE, ADVISORY, 'Suspended hyphen "{m0}"', r"\w+- and \w+-", "gi", MICROSOFT, "- and "),
    swapped("ms-term-swaps", STYLE, ADVISORY, "Term", L.MS_TERMS, MICROSOFT),
    swapped("ms-url-of", STYLE, ADVISORY, "Address", {"url for": "URL of"}, MICROSOFT),
    scan(
        "ms-units-spelled-number",
        STYLE,
        WARN,
        'Spelled number in "{m0}"',
        rf"\b(?:{NUMBERS}|thousand|million)\s+(?:(?:centi|milli)?meters|(?:kilo)?grams|(?:kilo)?meters|(?:mega)?pixels|cm|inches|lb|miles|pounds)\b",
        "gi",
        MICROSOFT,
        "meters|grams|pixels|cm|inches|lb|miles|pounds",
        table=False,
    ),
    listed("ms-vocab-az-wordlist", STYLE, ADVISORY, 'Check "{m0}" in the word list', L.AZ_WORDS, MICROSOFT, any_word, least=2),
    swapped("ms-wordiness", STYLE, ADVISORY, "Wordy", L.MS_WORDINESS, MICROSOFT),
    # Google
    scan("google-ampm", STYLE, WARN, "Write AM or PM after a space", r"\b\d{1,2}(?:[AP]M|\s?[ap]m|\s?[aApP]\.[mM]\.)(?![a-zA-Z])", "g", GOOGLE, "am|pm|a.m|p.m", table=False),
    swapped("google-contractions", STYLE, ADVISORY, "Contract", L.IS_CONTRACTIONS, GOOGLE, any_word, same=True),
    scan("google-date-format", STYLE, ADVISORY, 'Date "{m0}"', rf"\b\d{{1,2}}(?:\.|\/)\d{{1,2}}(?:\.|\/)\d{{4}}\b|\b\d{{1,2}} (?:{GOOGLE_MONTHS}) \d{{4}}\b", "g", GOOGLE, table=False),
    scan("google-ellipses", STYLE, ADVISORY, "Ellipsis", r"\.\.\.", "g", GOOGLE, "...", table=False),
    scan("google-dash-spacing", STYLE, ADVISORY, "Space around a dash", r"\s[—–]\s", "g", GOOGLE, "—|–", table=False),
    scan("google-first-person", STYLE, WARN, 'First person "{m0}"', FIRST_PERSON, "gi", GOOGLE, least=2),
    scan("google-gender-neutral-pronoun", INCLUSIVE, WARN, '"{m0}" for a person', r"he\/she|s\/he|\(s\)he", "gi", GOOGLE, "he/she|s/he|(s)he"),
    bias("google-gender-bias", GOOGLE, L.GENDER_BIAS | {"mankind": "human kind or humanity"}),
    scan("google-ly-hyphen", STYLE, ADVISORY, 'Hyphen in "{m0}"', r"\b([A-Za-z]*ly)-(\w+)", "g", GOOGLE, "ly-", where=lambda d, m: m[1].lower() not in L.LY_HYPHENS),
    scan("google-optional-plurals", STYLE, ADVISORY, 'Plural in "{m0}"', r"\b\w+\(s\)", "g", GOOGLE, "(s)"),
    scan("google-ordinal", STYLE, WARN, 'Ordinal "{m0}"', r"\b\d+(?:st|nd|rd|th)\b", "g", GOOGLE, table=False),
    scan("google-quote-punctuation", STYLE, ADVISORY, "Punctuation outside the quotes", r'"[^"\n]+"[.,?]', "g", GOOGLE, '"'),
    scan("google-number-range-words", STYLE, ADVISORY, "Words around a range", r"(?:from|between)\s\d+\s?-\s?\d+", "gi", GOOGLE, "from|between"),
    scan("google-semicolons", STYLE, ADVISORY, "Semicolon", ";", "g", GOOGLE, ";", table=False, size=1),
    scan("google-slang", STYLE, WARN, 'Slang "{m0}"', r"\b(tl;dr|ymmv|rtfm|imo|fwiw)\b", "gi", GOOGLE, "tl;dr|ymmv|rtfm|imo|fwiw"),
    scan("google-units-nbsp", STYLE, ADVISORY, 'No space in "{m0}"', r"\b(\d+)(kB|MB|GB|TB|min|ns|ms)(?![A-Za-z])", "g", GOOGLE, "kb|mb|gb|tb|min|ns|ms", table=False),
    scan("avoid-first-person-plural", STYLE, ADVISORY, 'First person "{m0}"', r"\b(we|we'(?:ve|re)|ours?|us|let's)\b", "gi", GOOGLE, "we|our|us|let's", least=2),
    scan("avoid-will-future-tense", STYLE, ADVISORY, 'Future "{m0}"', r"\bwill\b", "gi", GOOGLE, "will", least=2, size=4),
    swapped("google-word-list", STYLE, ADVISORY, "Word list", L.GOOGLE_WORDS, GOOGLE),
    # AP
    scan("ap-percent", STYLE, ADVISORY, 'Sign in "{m0}"', r"\b(\d+(?:\.\d+)?)\s?%", "g", AP, "%", table=False),
    scan("ap-time-format", STYLE, ADVISORY, 'Time "{m0}"', r"\b\d{1,2}(:\d{m2})?\s?(AM|PM|am|pm|A\.M\.|P\.M\.)(?![a-zA-Z])", "g", AP, "am|pm|a.m.|p.m.", table=False),
    scan("ap-dollar-style", STYLE, ADVISORY, 'Sum "{m0}"', r"\b\d[\d,.]*\s+(?:(?:million|billion|trillion)\s+)?dollars\b", "gi", AP, "dollars", table=False),
    scan("ap-over-quantity", STYLE, ADVISORY, '"over" with a quantity', r"\bover\s+\$?\d", "gi", AP, "over", table=False),
    swapped("ap-toward", STYLE, ADVISORY, "Direction", L.AP_TOWARD, AP),
    scan("ap-ampersand", STYLE, ADVISORY, "Ampersand", r"\s&\s", "g", AP, "&", table=False, shift=1, size=1),
    # Chicago
    swapped("chicago-directional-s", STYLE, ADVISORY, "Direction", L.CHICAGO_TOWARD, CHICAGO),
    scan("chicago-percent-symbol", STYLE, ADVISORY, 'Sign in "{m0}"', r"\d\s?%", "g", CHICAGO, "%", table=False),
    scan("chicago-em-dash-spacing", STYLE, ADVISORY, "Spaces around a dash", " — ", "g", CHICAGO, "—"),
    scan("chicago-ellipsis", STYLE, ADVISORY, "Ellipsis sign", "…", "g", CHICAGO, "…", size=1),
    scan("chicago-united-states-noun", STYLE, ADVISORY, '"{m1}" as a noun', r"\b[Tt]he (U\.S\.|US)(?=\s+(?:is|are|was|were|has|have|had|will|would)\b|[.,;:])", "g", CHICAGO, "the us|the u.s.", group=1),
    listed("chicago-ibid", STYLE, ADVISORY, 'Citation "{m0}"', L.IBID, CHICAGO),
    # plain language
    swapped("plain-hidden-verb", STYLE, ADVISORY, "Hidden verb", L.HIDDEN_VERBS, PLAIN),
    listed("plain-shall", STYLE, ADVISORY, '"{m0}" for must', ["shall"], PLAIN, any_word),
    swapped("plain-required-to", STYLE, ADVISORY, "Say must", L.REQUIRED_TO, PLAIN),
    swapped("plain-legalese-phrase", STYLE, ADVISORY, "Legalese", L.LEGALESE_PHRASES, PLAIN),
    listed("plain-legalese-word", STYLE, ADVISORY, 'Legalese "{m0}"', L.LEGALESE, PLAIN, any_word),
    scan("plain-double-negative", STYLE, ADVISORY, 'Double negative "{m0}"', r"\bnot\s+(uncommon|unusual|unlikely|unreasonable|unimportant|insignificant|infrequent|inexpensive|unhelpful|impractical|unclear)\b", "gi", PLAIN, "not"),
]
BY_ID = {r.id: r for r in RULES}
