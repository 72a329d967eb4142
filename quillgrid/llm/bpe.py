"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is one token that ends its encoding.  A table of those last
tokens is all the encoder keeps: the encoding is read off backwards, bytes can be appended
exactly, and after an edit only the neighbourhood of the edit is computed again.  The tables of
many pieces are filled together, a byte of all of them at a time, and a prefix that pieces share once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import hold, lean

#: Pieces and token pairs that a worker remembers, of the last and the present generation each; full memories are emptied, which changes no result.
PIECES_KEPT = 150_000
PAIRS_KEPT = 100_000
LONGEST_KEPT = 64
#: Pieces that are looked up together, those that are encoded together, and places for pairs met then (a later pair takes an earlier one's place).
AT_ONCE = 1 << 17
TOGETHER = 1 << 14
PLACES = 1 << 17
NO_LIMIT = 1 << 62


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain BPE with the merges of a rank less than below."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Vocabulary:
    """Ranks of a byte-level vocabulary and, for each token, the two tokens that its last merge joins."""

    ranks: dict[bytes, int]
    pattern: str
    tokens: dict[int, bytes] = field(default_factory=dict)
    left: dict[int, int] = field(default_factory=dict)
    right: dict[int, int] = field(default_factory=dict)
    usable: dict[bytes, int] = field(default_factory=dict)
    longest: int = 1

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines with a base64 token and its rank; read on the driver only."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        out = cls(ranks, pattern, {r: t for t, r in ranks.items()})
        for token, rank in ranks.items():
            parts = merged(token, ranks, rank)
            if len(parts) == 1:
                out.left[rank] = out.right[rank] = rank
            elif len(parts) == 2:
                out.left[rank], out.right[rank] = ranks[parts[0]], ranks[parts[1]]
            else:  # no order of merges makes it
                continue
            out.usable[token] = rank
        out.longest = max(map(len, ranks))
        return out

    @cached_property
    def grid(self) -> Grid:
        return Grid.of(self)


@dataclass
class Grid:
    """A vocabulary as arrays, to encode many pieces together.

    Its automaton is edges (node and byte in one number, ascending) and to, fail (the node of the longest proper suffix) and best (the longest token that ends there, or -1);
    shorter is the next shorter token that ends as a token does, joins and joined are pairs of tokens (left * n + right, ascending) that make a token, and which."""

    edges: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    best: np.ndarray
    shorter: np.ndarray
    size: np.ndarray
    left: np.ndarray
    right: np.ndarray
    joins: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, v: Vocabulary) -> Grid:
        n, nodes = max(v.tokens) + 1, {b"": 0}
        for token in v.usable:
            for i in range(1, len(token) + 1):
                nodes.setdefault(token[:i], len(nodes))
        edges = sorted((nodes[p[:-1]] << 8 | p[-1], k) for p, k in nodes.items() if p)
        fail, best, shorter = np.zeros(len(nodes), np.int32), np.full(len(nodes), -1, np.int32), np.full(n, -1, np.int32)
        for p in sorted(nodes, key=len):
            k = nodes[p]
            fail[k] = next((nodes[p[i:]] for i in range(1, len(p)) if p[i:] in nodes), 0)
            best[k] = best[fail[k]] if p else -1
            if p in v.usable:
                shorter[v.usable[p]], best[k] = best[k], v.usable[p]
        numbers = lambda of: np.fromiter((of.get(k, -1) for k in range(n)), np.int64, n)
        joins = sorted((a * n + b, rank) for token, rank in v.ranks.items() for i in range(1, len(token)) if (a := v.usable.get(token[:i])) is not None and (b := v.usable.get(token[i:])) is not None)
        joins.append((NO_LIMIT, 0))
        size = numbers({r: len(t) for r, t in v.tokens.items()})
        return cls(
            *(np.array(c, k) for c, k in zip(zip(*edges, strict=True), (np.uint32, np.int32), strict=True)), fail, best, shorter, size, numbers(v.left), numbers(v.right), *(np.array(c, np.int64) for c in zip(*joins, strict=True))
        )

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes after one more byte."""
        out, live = np.zeros(len(node), np.int32), np.arange(len(node))
        while len(live):
            key = node.astype(np.uint32) << np.uint32(8) | byte
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[at] == key
            out[live[there]] = self.to[at[there]]
            more = ~there & (node != 0)
            live, node, byte = live[more], self.fail[node[more]], byte[more]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """PrefixEncoder._fits of many pairs."""
        out, live, limit = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), NO_LIMIT)
        while len(live):
            key = a * len(self.size) + b
            at = np.searchsorted(self.joins, key)
            across = np.where(self.joins[at] == key, self.joined[at], NO_LIMIT)
            left, right = self.left[b], self.right[a]
            whole_a, whole_b, fine = right == a, left == b, across >= limit
            out[live[fine & whole_a & whole_b]] = True
            undo_a = ~whole_a & (whole_b | (a > b))
            more = fine & ~(whole_a & whole_b)
            live, limit, a, b = live[more], np.where(undo_a, a, b + 1)[more], np.where(undo_a, right, a)[more], np.where(undo_a, b, left)[more]
        return out


class PrefixEncoder:
    """encode(piece), and tables that take appends and edits."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.pairs: dict[tuple[int, int], bool] = {}
        self.before: dict[tuple[int, int], bool] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for token, rank in self.v.usable.items():
            out.add_word(token.decode("latin-1"), rank)
        out.make_automaton()
        return out

    @cached_property
    def places(self) -> np.ndarray:
        """Pairs met and whether they fit, as one number each, so that the two never part."""
        return np.full(PLACES, -1, np.int64)

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is a, b; remembered in pairs, and until they are next full in the ones before."""
        known = self.before.get((a, b))
        if known is None:
            known = self._fits(a, b)
        if len(self.pairs) >= PAIRS_KEPT:
            self.before = dict(self.pairs)
            self.pairs.clear()
        self.pairs[a, b] = known
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Undoes the merges of both sides, latest first: a merge across the border that would have come earlier than one undone breaks the pair."""
        v, limit = self.v, 1 << 62
        while True:
            across = v.ranks.get(v.tokens[a] + v.tokens[b])
            if across is not None and across < limit:
                return False
            whole_a, whole_b = v.right[a] == a, v.left[b] == b
            if whole_a and whole_b:
                return True
            # the later of the two last merges is undone; of equal ones the right one, as merges run from the left
            if not whole_a and (whole_b or a > b):
                limit, a = a, v.right[a]
            else:
                limit, b = b + 1, v.left[b]

    def extend(self, piece: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Fills last, the last tokens of the prefixes of 1, 2, ... bytes, up to until.  The automaton names the tokens that end at each byte, longest first."""
        tokens, pairs, fits = self.v.tokens, self.pairs, self.fits
        done, until = len(last), until or len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1"), max(0, done - self.v.longest), until):
            if end < done:
                continue
            start = end - len(tokens[token])
            if start < 0 or pairs.get(pair := (last[start], token)) or pair not in pairs and fits(*pair):
                last.append(token)
                done += 1
        if done < until:
            raise ValueError("the vocabulary lacks a byte")
        return last

    def ids(self, last: list[int]) -> list[int]:
        out, at, tokens = [], len(last), self.v.tokens
        while at:
            out.append(last[at - 1])
            at -= len(tokens[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.v.ranks.get(piece)) is not None:
            return [whole]
        return self.ids(self.extend(piece, []))

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits() of many pairs."""
        key = a.astype(np.int64) * len(self.v.grid.size) + b
        at = (key * 0x9E3779B1 >> 13) & (PLACES - 1)
        held = self.places[at]
        out, new = (held & 1).astype(bool), np.flatnonzero(held >> 1 != key)
        if len(new):
            out[new] = self.v.grid.fits(a[new].astype(np.int64), b[new].astype(np.int64))
            self.places[at[new]] = key[new] << 1 | out[new]
        return out

    def extend_all(self, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
        """extend() of many pieces in ascending order, given as rows of bytes and their lengths: column k has the last tokens of the prefixes of piece k, by their length."""
        g, (n, width) = self.v.grid, chars.shape
        shared = np.zeros(n, np.int64)  # bytes that a piece shares with the one before
        shared[1:] = np.minimum(np.logical_and.accumulate(chars[1:] == chars[:-1], axis=1).sum(axis=1), np.minimum(size[1:], size[:-1]))
        last, node = np.full((width + 1, n), -1, np.int32), np.zeros(n, np.int32)
        for end in range(1, width + 1):
            rows = np.flatnonzero(size >= end)
            first = shared[rows] < end
            of, heads = np.cumsum(first) - 1, rows[first]
            nodes = g.step(node[heads], chars[heads, end - 1])
            token, open_ = g.best[nodes], np.arange(len(heads))
            while len(open_):
                t = token[open_]
                if t.min() < 0:
                    raise ValueError("the vocabulary lacks a byte")
                start = end - g.size[t]
                good = start == 0
                rest = np.flatnonzero(~good)
                good[rest] = self.fit(last[start[rest], heads[open_[rest]]], t[rest])
                open_ = open_[~good]
                token[open_] = g.shorter[token[open_]]
            node[rows], last[end, rows] = nodes[of], token[of]
        return last

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """encode() of many pieces in ascending order, none of them empty, as bytes of unsigned 32-bit integers."""
        out: list[bytes] = []
        for k in range(0, len(pieces), TOGETHER):
            some = pieces[k : k + TOGETHER]
            size = np.fromiter(map(len, some), np.int64, len(some))
            last = self.extend_all(np.array(some, f"S{size.max()}").view(np.uint8).reshape(len(some), -1), size)
            rows, at, read = np.arange(len(some)), size.copy(), []
            while len(rows):
                t = last[at[rows], rows]
                read.append((rows, t))
                at[rows] -= self.v.grid.size[t]
                rows = rows[at[rows] > 0]
            ends = np.cumsum(np.bincount(np.concatenate([r for r, _ in read]), minlength=len(some)))
            ids = np.zeros(ends[-1], np.uint32)
            for back, (r, t) in enumerate(read, 1):
                ids[ends[r] - back] = t
            data, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Piece and table with more bytes at the end; nothing before is computed again."""
        return piece + more, self.extend(piece + more, list(last))

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Piece and table with [start, end) replaced, and how many entries were computed.  Once as many entries in a row as a token can be long are the old ones, so are all later ones."""
        out, table = piece[:start] + new + piece[end:], list(last[:start])
        shift, same, done = len(new) - (end - start), 0, 0
        while len(table) < len(out):
            self.extend(out, table, len(table) + 1)
            done += 1
            old = len(table) - shift
            same = same + 1 if len(table) > start + len(new) and table[-1] == last[old - 1] else 0
            if same >= self.v.longest:
                table += last[old:]
        return out, table, done


#: The letters, numbers and white space below U+0250, for the standard library's faster matcher.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}
BEYOND_LATIN = re.compile("[^\0-\u024f]").search


def latin(pattern: str) -> str:
    """The pattern with its classes spelled out for texts below U+0250."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        for name, chars in LATIN.items():
            if pattern.startswith(name, i):
                out.append(chars if inside else f"[{chars}]")
                i += len(name)
                break
        else:
            if pattern[i] == "\\":
                if not inside and pattern[i + 1] == "S":
                    out.append(f"[^{LATIN[chr(92) + 's']}]")
                else:
                    out.append(pattern[i : i + 2])
                i += 2
                continue
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


class Pieces(dict):
    """Ids of pieces met before, as bytes: those since the last change of generation, and those of the one before."""

    def __init__(self, encoder: PrefixEncoder) -> None:
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        """Of pieces too long to be kept; learn() has met the others."""
        return array("I", self.encoder.encode(piece.encode())).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Has all pieces but very long ones at hand: what is not known is encoded together."""
        if len(self) >= PIECES_KEPT:
            self.old = dict(self)
            self.clear()
        new, ranks = [], self.encoder.v.ranks
        for piece in pieces:
            if piece not in self and len(piece) <= LONGEST_KEPT:
                ids = self.old.get(piece)
                if ids is None:
                    rank = ranks.get(piece.encode())
                    if rank is None:
                        new.append(piece)
                        continue
                    ids = array("I", (rank,)).tobytes()
                self[piece] = ids
        if new:
            new.sort()  # by code points, as their bytes are
            self.update(zip(new, self.encoder.encode_all([p.encode() for p in new]), strict=True))


class Codec:
    """Whole texts to ids and back, as one worker holds it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.find_latin = re.compile(latin(vocabulary.pattern)).findall

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(PrefixEncoder(self.v))

    @cached_property
    def tokens(self) -> np.ndarray:
        """Tokens by rank; None where there is none."""
        out = np.full(max(self.v.tokens) + 1, None, dtype=object)
        for rank, token in self.v.tokens.items():
            out[rank] = token
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text.  Runs of about AT_ONCE pieces are learned and looked up together, of several texts or of one."""
        out, held, n = [], [], 0
        for text in texts:
            pieces = (self.find if BEYOND_LATIN(text) else self.find_latin)(text) if text else []
            if n + len(pieces) > AT_ONCE:
                out += self._looked_up(held)
                held, n = [], 0
            if len(pieces) > AT_ONCE:
                out.append(np.concatenate([self._looked_up([pieces[k : k + AT_ONCE]])[0] for k in range(0, len(pieces), AT_ONCE)]))
            else:
                held.append(pieces)
                n += len(pieces)
        return out + self._looked_up(held)

    def _looked_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        self.pieces.learn(set().union(*texts))
        return [np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), dtype=np.int32) for pieces in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())


_codecs: dict[int, Codec] = {}


def codec(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary."""
    v = shared.value
    c = _codecs.get(id(v))
    if c is None:
        c = Codec(v)
        _codecs.clear()
        _codecs[id(v)] = c
    hold("bpe", _codecs.clear)
    return c


_read: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _read:
        _read[path, pattern] = Vocabulary.read(path, pattern)
        _read[path, pattern].grid  # once, on the driver: workers get it with the vocabulary
    return _read[path, pattern]


def udfs(spark: SparkSession, path: str, pattern: str):
    """Arrow functions encode(text) -> ids, decode(ids) -> bytes and digest(ids); the vocabulary, of fixed size, is broadcast."""
    shared = ship(spark).sparkContext.broadcast(vocabulary(path, pattern))

    @F.arrow_udf("array<int>")
    @partial(lean, owner="bpe")
    def encode(texts: pa.Array) -> pa.Array:
        c = codec(shared)
        rows = c.encode_all(t.as_py() for t in texts)
        at = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rows], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), type=pa.int32()))

    @F.arrow_udf("binary")
    @partial(lean, owner="bpe")
    def decode(ids: pa.Array) -> pa.Array:
        c = codec(shared)
        return pa.array([None if x is None else c.decode(x) for x in each(ids)], type=pa.binary())

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,ids:array<int>>")
    @partial(lean, owner="bpe")
    def digest(ids: pa.Array) -> pa.Array:
        """The ids again with their number and digests, so that one worker does it all."""
        c, rows = codec(shared), list(each(ids))
        return pa.StructArray.from_arrays(
            [
                pa.array([len(x) for x in rows], type=pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows]),
                pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in rows]),
                ids,
            ],
            names=["n_tokens", "ids_sha256", "decoded_sha256", "ids"],
        )

    return encode, decode, digest


def each(ids: pa.Array):
    """The lists of a list array as NumPy slices; None where null."""
    at, values = np.asarray(ids.offsets), np.asarray(ids.values)
    for k, null in enumerate(pc.is_null(ids).to_pylist()):
        yield None if null else values[at[k] : at[k + 1]]


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the token ids of each whole text (null: of the empty text) in out, which replaces a column of that name.

    Rows are independent: ties, repeated rows and extra columns pass through, an empty table stays empty,
    and a text of any length is encoded in time proportional to it."""
    encode, _, _ = udfs(df.sparkSession, path, pattern)
    return df.withColumn(out, encode(F.coalesce(F.col(text), F.lit(""))))
