"""Quality classifier: a factorisation machine.

Features of a whole text are hashed words (how often each bucket occurs, damped and normalised), structure
statistics, metadata (whether there is a text, and of each named column of numbers whether it holds one, its size
and how far it is from the text's length), and how they fall into steps.  The score is linear in them plus all
pairwise interactions through low-rank factors; by the sum-of-squares identity
  sum over i < j of <v_i, v_j> x_i x_j = 1/2 (|sum x_i v_i|^2 - sum x_i^2 |v_i|^2)
it takes time linear in the features.  The model is fitted by Adam on the log loss over a bounded sample of
labelled rows; its size is fixed, so it is broadcast.  Everything else covers all rows.

Edge cases: null texts count as empty, and as absent; a metadata column that is null, or that a table lacks, is absent;
empty and very long texts are scored like others; a label or key that is
null isn't learned from; with no rows of one label the score is the share of label 1 (0.5 without labels);
repeated rows get equal scores; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import IS_SPACE, MIX, hashes, lean, shingle_hashes, slices, utf8

#: Buckets of hashed words, factors, and the most labelled rows that are learned from (those of the lowest hash).
BUCKETS, RANK, SAMPLE = 1024, 8, 8_000
EPOCHS, BATCH, RATE, DECAY = 20, 256, 0.01, 1e-4
#: Rows that are dense at once.
ROWS = 64
#: Steps into which each statistic is cut, by its quantiles in the sample.
STEPS = 8


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text: lengths, shares of kinds of characters, repetition of words, windows and lines; of the whole and of its worst stretch."""
    data = np.frombuffer(text, dtype=np.uint8)
    n, m = max(1, len(data)), max(1, len(words))
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    other = (data < 128) & ~letters & ~digit & ~IS_SPACE[data]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    h = hashes(words)
    distinct = len(np.unique(h)) / m
    same = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    windows = shingle_hashes(h, 3)
    again = 1 - len(np.unique(windows)) / max(1, len(windows))
    size = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    stretch = 2048
    worst = [0.0, 0.0, 0.0]
    if len(data) > stretch:
        cuts = np.arange(0, len(data), stretch)
        width = np.diff(np.append(cuts, len(data)))
        worst = [float((np.add.reduceat(f, cuts, dtype=np.int64) / np.maximum(width, stretch // 2)).max()) for f in (upper, other, digit)]
    else:
        worst = [float(f.sum() / n) for f in (upper, other, digit)]
    local = 1.0
    for k in range(0, len(h), 256):
        part = h[k : k + 256]
        if len(part) >= 64 or k == 0:
            local = min(local, len(np.unique(part)) / max(1, len(part)))
    counts = [text.count(c) for c in (b"|", b"!", b"#", b"*", b"%", b"&", b"$", b"@", b"<", b"{", b"http", b".", b",")]
    return [
        np.log1p(len(words)),
        np.log1p(len(lines)),
        float(upper.sum() / max(1, letters.sum())),
        float(digit.sum() / n),
        float(other.sum() / n),
        float((data >= 128).sum() / n),
        distinct,
        same,
        again,
        local,
        1 - len(set(lines)) / max(1, len(lines)),
        float(size.mean()) if len(size) else 0.0,
        float(size.std()) if len(size) else 0.0,
        float(size.max()) if len(size) else 0.0,
        len(words) / max(1, len(lines)),
        *worst,
        *[c / m for c in counts],
    ]


#: Columns of numbers that a row's metadata holds; never lang, source, doc_id or labels.
METADATA = ("n_chars",)
N_STATISTICS = len(statistics(b"", [])) + 1 + 3 * len(METADATA)


def described(text: bytes, there: bool, known: list[float | None]) -> list[float]:
    """Metadata of a row: whether it has a text; of each number whether it is known, its size, and its ratio to the text's code points."""
    chars = int(((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80).sum())
    out = [float(there)]
    for x in known:
        sure = x is not None and np.isfinite(x)
        size = float(np.log1p(max(x, 0))) if sure else 0.0
        out += [float(sure), size, size - float(np.log1p(chars)) if sure else 0.0]
    return out


def features(texts: pa.Array, *metadata: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, and statistics with metadata, of each text, as dense rows."""
    data, at = utf8(texts)
    there = np.asarray(texts.is_valid())
    known = [m.to_pylist() for m in metadata] or [[None] * len(texts)] * len(METADATA)
    words = np.zeros((len(at) - 1, BUCKETS), dtype=np.float32)
    stats = np.zeros((len(at) - 1, N_STATISTICS), dtype=np.float64)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        text = data[a:b].tobytes()
        w = text.split()
        stats[k] = [*statistics(text, w), *described(text, bool(there[k]), [x[k] for x in known])]
        if w:
            lowered = np.fromiter((xxhash.xxh3_64_intdigest(x.lower()) for x in w), dtype=np.uint64, count=len(w))
            damped = np.log1p(np.bincount(((lowered * MIX) >> np.uint64(54)).astype(np.int64), minlength=BUCKETS))
            # in half precision, as the sample reaches the driver
            words[k] = (damped / np.sqrt((damped**2).sum())).astype(np.float16)
    return words, stats


@dataclass
class Machine:
    """w0 + <w, x> + 1/2 sum over factors of ((x V)^2 - x^2 V^2), for x of words, scaled statistics and steps."""

    mean: np.ndarray
    spread: np.ndarray
    cuts: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    base: float = 0.5
    fitted: bool = True

    def inputs(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
        steps = (stats[:, :, None] > self.cuts[None, :, :]).reshape(len(stats), -1) * 0.5
        return np.concatenate([words, scaled, steps], axis=1).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.base)
        pairs = ((x @ self.v) ** 2 - (x**2) @ (self.v**2)).sum(axis=1) / 2
        return 1 / (1 + np.exp(-np.clip(self.w0 + x @ self.w + pairs, -30, 30)))


def fit(words: np.ndarray, stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
    n, share = len(labels), float(labels.mean()) if len(labels) else 0.5
    if not n or not 0 < share < 1:
        zero = np.zeros((N_STATISTICS, STEPS - 1))
        return Machine(zero[:, 0], zero[:, 0] + 1, zero, 0.0, np.zeros(0), np.zeros((0, RANK)), share, False)
    cuts = np.quantile(stats, np.arange(1, STEPS) / STEPS, axis=0).T
    m = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-9, cuts, float(np.log(share / (1 - share))), np.zeros(0), np.zeros(0))
    x = m.inputs(words, stats)
    rng = np.random.default_rng(seed)
    p = [np.array([m.w0]), np.zeros(x.shape[1]), rng.normal(0, 0.02, (x.shape[1], RANK))]
    moment, square, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            b = x[order[k : k + BATCH]].astype(np.float64)
            m.w0, m.w, m.v = float(p[0][0]), p[1], p[2]
            xv = b @ m.v
            gap = (m.score(b) - labels[order[k : k + BATCH]]) / len(b)
            slopes = [np.array([gap.sum()]), b.T @ gap + DECAY * m.w, b.T @ (gap[:, None] * xv) - ((b**2).T @ gap)[:, None] * m.v + DECAY * m.v]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for q, g, a, s in zip(p, slopes, moment, square, strict=True):
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    m.w0, m.w, m.v = float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32)
    return m


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """The machine for docs (doc_id, text) and labels (doc_id, label); at most sample rows reach the driver, as features of fixed size."""
    ship(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))

    @F.arrow_udf("struct<words:binary,stats:binary>")
    @lean
    def taken(texts: pa.Array, *metadata: pa.Array) -> pa.Array:
        rows = [([r.astype("<f2").tobytes() for r in w], [r.tobytes() for r in s]) for k, n in slices(texts, ROWS) for w, s in [features(texts[k : k + n], *[m[k : k + n] for m in metadata])]]
        return pa.StructArray.from_arrays([pa.array([x for r in rows for x in r[c]], pa.binary()) for c in (0, 1)], names=["words", "stats"])

    text = docs.select("doc_id", "text", *fields(docs))
    rows = text.join(chosen, "doc_id").select("doc_id", "y", taken("text", *METADATA).alias("f")).select("doc_id", "y", "f.*").toPandas()
    rows = rows.sort_values(["doc_id", "y", "words", "stats"], kind="stable").head(sample)
    words = np.array([np.frombuffer(r, dtype="<f2") for r in rows["words"]], dtype=np.float32).reshape(-1, BUCKETS)
    stats = np.array([np.frombuffer(r, dtype=np.float64) for r in rows["stats"]]).reshape(-1, N_STATISTICS)
    return fit(words, stats, rows["y"].to_numpy(dtype=np.float64))


def fields(docs: DataFrame) -> list[Column]:
    """The metadata columns of docs as numbers; absent ones are null."""
    return [(F.expr(f"try_cast(`{c}` AS double)") if c in docs.columns else F.lit(None).cast("double")).alias(c) for c in METADATA]


def scored(docs: DataFrame, machine: Machine) -> Column:
    """The score of a row of docs (text and, where it has them, the columns of METADATA)."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    @lean
    def score(texts: pa.Array, *metadata: pa.Array) -> pa.Array:
        m, out = shared.value, [np.zeros(0)]
        for k, n in slices(texts, ROWS):
            out.append(m.score(m.inputs(*features(texts[k : k + n], *[x[k : k + n] for x in metadata]))))
        return pa.array(np.concatenate(out), type=pa.float64())

    return score(F.col("text"), *fields(docs))
