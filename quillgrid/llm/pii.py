"""Personal data: patterns, and a skip-chain conditional random field over what they leave.

Patterns find the base spans.  The field's nodes are the base spans, the words that hold a digit or an @ or that
are like a base span, and the words around each of these; short numbers next to each other that may be one number
are one node.  Chain edges join neighbours in a line.  Skip edges join distant nodes that are alike: numbers that
begin or end in the same digits, the same local part of an address, the same net; each with the one like it before,
and with the base span like it before.  Base spans are evidence; loopy belief propagation carries it along the
edges, so that a number first written in full and later in part, or one that fails a pattern by a slip, gets the
label that it has elsewhere in the document.  A node whose belief in a kind is at least CERTAIN is an added span.

The field is fitted by pseudo-likelihood on a bounded sample of documents whose base spans are the labels, a
share of them hidden: see lesson().

Edge cases: null and empty texts have no spans; very long texts take time in proportion to their length;
repeated rows get equal spans; with nothing to learn from no span is added; a null doc_id is a row like
others; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (12, 19), (9, 15), 255

IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HOLDS = re.compile("[0-9@]")
DIGIT = re.compile("[0-9]")
EDGE = "\"'!#%&$*.,;:?<>[]{}=~^`|/\\_"
NUMERIC = re.compile(r"[0-9().+/-]*[0-9][0-9().+/-]*")
AT = re.compile(r"@|[(\[]at[)\]]")
NET = re.compile(r"([0-9]+\.[0-9]+\.[0-9]+)(?:\.[^.]{1,3})?\Z")
#: Texts in which a base span is possible.
MAY_HOLD = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|\+[0-9]|[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"
#: Belief from which a node becomes a span; documents learned from; rounds of messages.
CERTAIN, SAMPLE, ROUNDS = 0.7, 2_000, 12
#: Digits that two like numbers share, letters of a local part, words on each side, hashed cues of a side.
SHARED, LOCAL, WINDOW, CUES = 7, 4, 3, 16
#: Share of base labels that are hidden, and words of each document without a label, in learning.
HIDDEN, OTHERS = 0.3, 16
STATES = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each @ that has a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in IN_LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= IP_PART for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= CARD_DIGITS[0]:
                digits = m[0].replace(" ", "").replace("-", "")
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= sum(map(str.isdigit, m[0])) <= PHONE_DIGITS[1]]
    return sorted(out)


@dataclass
class Graph:
    """Nodes of a text: spans, features, base labels (0: not known), keys of likeness, and edges by type."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    labels: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def digits_of(core: str) -> str:
    return "".join(c for c in core if "0" <= c <= "9")


def squeezed(core: str) -> str:
    return "".join(c for c in core.lower() if c.isalnum())


def keys(core: str) -> set[str]:
    """What a node may have in common with another one that means the same: the end or the beginning of a number, the local part of an address, the net of an ip."""
    d, out = digits_of(core), set()
    at = AT.search(core)
    if at:
        if len(local := squeezed(core[: at.start()])) >= LOCAL:
            out.add("m" + local)
        return out
    if len(d) >= SHARED:
        out.add("l" + d[-SHARED:])
    if len(d) >= CARD_DIGITS[0]:
        out.add("f" + d[: SHARED + 1])
    if (net := NET.match(core)) is not None:
        out.add("i" + net[1])
    if len(d) < len(core) and (d or "." in core or "_" in core) and len(local := squeezed(core)) >= LOCAL + 2:
        out.add("m" + local)
    return out


def hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower()) % CUES


def described(core: str, words: int, before: str, after: str) -> list[float]:
    """Features of a node: shape, and hashed words on both sides."""
    n = len(digits_of(core))
    steps = [float(low <= n < high) for low, high in ((0, 1), (1, 4), (4, 7), (7, 9), (9, 12), (12, 20), (20, 1 << 30))]
    letters = any(c.isalpha() for c in core)
    out = [1.0, *steps, float("@" in core), float(core.count(".") >= 2 and not letters), float(letters), float("-" in core), float("+" in core), float("(" in core), float(words > 1), float(n == len(core))]
    cues = [0.0] * (2 * CUES)
    if before:
        cues[hashed(before)] = 1.0
    if after:
        cues[CUES + hashed(after)] = 1.0
    return out + cues


N_FEATURES = len(described("", 1, "", ""))


def pieces(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, label, words) of the words of a text: base spans whole, the words between them, and runs of short numbers that may be one longer one."""
    out: list[tuple[int, int, int, int]] = []

    def between(low: int, high: int) -> None:
        run: list[tuple[int, int]] = []

        def close() -> None:
            if len(run) > 1 and SHARED <= len(digits_of(text[run[0][0] : run[-1][1]])) <= CARD_DIGITS[1]:
                out.append((run[0][0], run[-1][1], 0, len(run)))
            else:
                out.extend((a, b, 0, 1) for a, b in run)
            run.clear()

        for m in WORD.finditer(text, low, high):
            core = m[0].strip(EDGE)
            if not any(c.isalnum() for c in core):
                continue
            start = m.start() + m[0].find(core)
            end = start + len(core)
            if not NUMERIC.fullmatch(core) or len(digits_of(core)) > SHARED:
                close()
                out.append((start, end, 0, 1))
                continue
            if run and start - run[-1][1] > 1:
                close()
            run.append((start, end))
        close()

    at = 0
    for start, kind, end in found:
        if start < at:  # within another kind's span
            continue
        between(at, start)
        out.append((start, end, kind + 1, 1))
        at = end
    between(at, len(text))
    return out


def graph(text: str, found: list[tuple[int, int, int]]) -> Graph:
    """Nodes are base spans, words with a digit or an @ or like a base span, and the WINDOW words on both sides of each."""
    words = pieces(text, found)
    cores = [text[a:b] for a, b, *_ in words]
    known = [keys(c) if label or HOLDS.search(c) or "." in c or "_" in c else set() for c, (_, _, label, _) in zip(cores, words, strict=True)]
    of_base = {k for x, (_, _, label, _) in zip(known, words, strict=True) if label for k in x}
    near, last = [False] * len(words), -1
    for i, (core, (_, _, label, _)) in enumerate(zip(cores, words, strict=True)):
        if label or HOLDS.search(core) or known[i] & of_base:
            for j in range(max(last + 1, i - WINDOW), min(len(words), i + WINDOW + 1)):
                near[j] = True
            last = min(len(words), i + WINDOW + 1) - 1
    number = {i: n for n, i in enumerate(i for i, x in enumerate(near) if x)}
    spans, rows, labels, chain, skip = [], [], [], [], set()
    seen: dict[str, int] = {}
    base_of: dict[str, int] = {}
    for i, n in number.items():
        start, end, label, size = words[i]
        broken = i == 0 or "\n" in text[words[i - 1][1] : start]
        if not broken and i - 1 in number:
            chain.append((n - 1, n))
        rows.append(described(cores[i], size, "" if broken else cores[i - 1], cores[i + 1] if i + 1 < len(words) else ""))
        spans.append((start, end)), labels.append(label)
        for key in known[i]:
            skip |= {(d[key], n) for d in (seen, base_of) if key in d}
            seen[key] = n
            if label:
                base_of[key] = n
    return Graph(spans, np.array(rows).reshape(-1, N_FEATURES), np.array(labels, dtype=np.int64), chain, sorted(skip.difference(chain)))


def neighbours(n: int, labels: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """How many neighbours of each known label (not below 0) each node has."""
    out = np.zeros((n, STATES))
    for a, b in edges:
        if labels[b] >= 0:
            out[a, labels[b]] += 1
        if labels[a] >= 0:
            out[b, labels[a]] += 1
    return out


def rewritten(kind: int, span: str, rng: random.Random) -> str:
    """A base span as it may be written again: without its country code or domain, with other separators, or with a slip."""
    d = digits_of(span)
    if kind == 0:
        local, domain = span.split("@", 1)
        return rng.choice([f"{local}(at){domain}", f"{local}@{domain.split('.')[0]}", local])
    if kind == 1:
        return ".".join(span.split(".")[:3]) + rng.choice(["", ".*", ".x", ".999"])
    if kind == 2:
        k = rng.randrange(len(d))
        d = d[:k] + str((int(d[k]) + rng.randint(1, 9)) % 10) + d[k + 1 :]
        return rng.choice(["", " ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4)) if rng.random() < 0.5 else d
    d = d[-10:] if len(d) > 10 else d
    return rng.choice(["", "-", ".", " "]).join((d[:-7], d[-7:-4], d[-4:])).strip("-. ")


def lesson(text: str, found: list[tuple[int, int, int]], rng: random.Random) -> np.ndarray:
    """Rows of features, label, and counts of the labels of chain and skip neighbours to learn from.

    Every base span is written again at the end, between the words that it stands between, and its label there is
    hidden.  So are the labels of a share HIDDEN of the base spans.  Hidden nodes that have a known one for a
    neighbour along a skip edge are learned; words that are no base span but like one are not observed; a
    number of the other words are learned as no personal data."""
    more, at, truth = [text], len(text), []
    words = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    for start, kind, end in found:
        variant = rewritten(kind, text[start:end], rng)
        i, j = bisect.bisect_left(starts, start), bisect.bisect_left(starts, end)
        before = text[words[max(0, i - WINDOW)][0] : start].split("\n")[-1] if i else ""
        after = text[end : words[min(len(words), j + WINDOW) - 1][1]].split("\n")[0] if j < len(words) else ""
        before, after = (before and before.rstrip() + " "), (after and " " + after.lstrip())
        more.append("\n" + before + variant + after)
        truth.append((at + 1 + len(before), at + 1 + len(before) + len(variant), kind + 1))
        at += len(more[-1])
    whole = "".join(more)
    g = graph(whole, base(whole))
    n = len(g.labels)
    shown = np.where(g.labels > 0, g.labels, -1)
    like = neighbours(n, np.where(g.labels > 0, 1, -1), g.skip)[:, 1] > 0
    goal = shown.copy()
    ends = [b for _, b in g.spans]
    for a, b, label in truth:
        for i in range(bisect.bisect_right(ends, a), n):
            if g.spans[i][0] >= b:
                break
            if g.labels[i] == 0 and like[i]:
                goal[i] = label
    hide = np.array([rng.random() < HIDDEN for _ in range(n)], dtype=bool)
    shown[hide] = -1
    goal[(goal < 0) & ~like] = 0
    shown[(goal == 0) & (shown < 0)] = 0
    skip, chain = neighbours(n, shown, g.skip), neighbours(n, shown, g.chain)
    of_use = (goal > 0) & (skip[:, 1:].sum(axis=1) > 0)
    others = np.nonzero(goal == 0)[0].tolist()
    of_use[rng.sample(others, min(len(others), OTHERS))] = True
    return np.concatenate([g.features, goal[:, None], chain, skip], axis=1)[of_use]


@dataclass
class Field:
    """Log potentials: of features and label, and of the labels of chain and skip neighbours."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    fitted: bool = True

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals by loopy sum-product messages, damped; base labels are held."""
        own = g.features @ self.node
        held = g.labels > 0
        own[held] = -60.0
        own[held, g.labels[held]] = 0.0
        edges = g.chain + g.skip
        if edges:
            a, b = np.array(edges).T
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            kind = np.array([self.chain] * len(g.chain) + [self.skip] * len(g.skip))
            pair = np.concatenate([kind, kind.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            message = np.zeros((len(source), STATES))
            for _ in range(ROUNDS):
                total = own.copy()
                np.add.at(total, target, message)
                out = (total[source] - message[back])[:, :, None] + pair
                top = out.max(axis=1)
                new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            own = own.copy()
            np.add.at(own, target, message)
        own = np.exp(own - own.max(axis=1, keepdims=True))
        return own / own.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 400, decay: float = 1e-2) -> Field:
    """Pseudo-likelihood: each label given the features and the known labels of its neighbours, by Adam on all rows.  Features are held down, so that likeness decides."""
    if len(y) == 0 or (y == y[0]).all():
        return Field(np.zeros((N_FEATURES, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, STATES)), False)
    z = np.concatenate([x, chain, skip], axis=1)
    w = np.zeros((z.shape[1], STATES))
    moment, square = np.zeros_like(w), np.zeros_like(w)
    goal, hold = np.eye(STATES)[y], np.full((z.shape[1], 1), decay)
    hold[-STATES:] = decay / 100
    for t in range(1, steps + 1):
        p = z @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = z.T @ (p - goal) / len(y) + hold * w
        moment += 0.1 * (slope - moment)
        square += 0.001 * (slope**2 - square)
        w -= 0.1 * (1 - t / steps) * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    c, s = w[N_FEATURES : N_FEATURES + STATES], w[N_FEATURES + STATES :]
    return Field(w[:N_FEATURES], (c + c.T) / 2, (s + s.T) / 2)


def added(text: str, found: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans that the field finds beside the base ones.  Without a base span there is nothing to agree with, and nothing is added."""
    if not field.fitted or not found:
        return []
    g = graph(text, found)
    p = field.beliefs(g)
    kind = p.argmax(axis=1)
    sure = (g.labels == 0) & (kind > 0) & (p.max(axis=1) >= CERTAIN)
    return [(g.spans[i][0], int(kind[i]) - 1, g.spans[i][1]) for i in np.nonzero(sure)[0].tolist()]


def learned(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field of at most sample documents that may hold a base span, those of the lowest hash of their text."""
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    @lean
    def examples(texts: pa.Array) -> pa.Array:
        return pa.array([lesson(t, base(t), random.Random(xxhash.xxh3_64_intdigest(t))).astype("<f4").tobytes() for t in texts.to_pylist()], pa.binary())

    # the hashes first: texts of all tasks' candidates would not fit the driver; of equal texts one is learned from
    text = docs.select("text", F.xxhash64("text").alias("h")).filter(F.col("text").rlike(MAY_HOLD))
    chosen = text.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    text = text.filter(F.col("h") <= F.lit(chosen)).dropDuplicates(["h"])
    rows = b"".join(r[0] for r in text.select("h", examples("text").alias("e")).orderBy("h").select("e").collect())
    z = np.frombuffer(rows, dtype="<f4").reshape(-1, N_FEATURES + 1 + 2 * STATES).astype(np.float64)
    a, b = N_FEATURES + 1, N_FEATURES + 1 + STATES
    return fit(z[:, :N_FEATURES], z[:, N_FEATURES].astype(np.int64), z[:, a:b], z[:, b:])


def spans_udf(df: DataFrame, field: Field):
    """An Arrow function text -> base and added spans as arrays of kind, start, end."""
    shared = ship(df.sparkSession).sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("struct<base:array<struct<kind:string,start:bigint,end:bigint>>,added:array<struct<kind:string,start:bigint,end:bigint>>>")
    @lean
    def find(texts: pa.Array) -> pa.Array:
        first, more = [], []
        for t in texts.to_pylist():
            found = base(t) if t and HOLDS.search(t) else []
            first.append(found)
            more.append(added(t, found, shared.value) if t and HOLDS.search(t) else [])
        rows = [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in column] for column in (first, more)]
        return pa.StructArray.from_arrays([pa.array(r, pa.list_(span)) for r in rows], names=["base", "added"])

    return find


def found(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """The columns of carry, base and added: arrays of (kind, start, end) in code points, end exclusive, of every row of docs."""
    find = spans_udf(docs, learned(docs.select(docs[text].alias("text")), sample))
    return docs.select(*carry, find(F.coalesce(text, F.lit(""))).alias("x")).select(*carry, "x.base", "x.added")
