"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillgrid.llm import bpe, common, components, embdedup, fmquality, hostrules, htmltext, linededup, minhash, mix, pii, queries, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, DOCS + more)


def corpus(spark, texts, sources=("a", "b", None)):
    return docs(spark, [(k, t, "en", sources[k % len(sources)], len(t or "")) for k, t in enumerate(texts)])


ODD = [None, "", " \n\t", "one", "two words", "x " * 20_000, "same text of some words here now", "same text of some words here now", "é ñ 日本 🚀 \x00 end"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# --- mixing ---


def wanted(sizes: dict, weights, share, most):
    """Targets by rounds, as the words of the contract say."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(most * sizes[s] for s in full)
        out = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(0, 90), "en", rng.choice(["a"] * 6 + ["b", "c", "é", None]), 0) for k in range(400)] + [(1000, None, None, "z", None), (None, "u v", "en", "b", 1), (7, "q q", "en", "b", 1), (7, "q q", "en", "b", 1)]
    df = docs(spark, rows).withColumns({"size": F.lit("x"), "row": F.lit(1), "place": F.lit(2)})
    found, pieces = mix.mixed(df, [3.0, 1.0, 2.0], 1.5, 2, block=64)
    got = mix.taken(found, pieces).cache()
    assert got.count() == len(rows)
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + len((r[1] or "").split())
    aim = wanted(by, [3, 1, 2], 1.5, 2)
    source = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    took = Counter()
    for r in got.collect():
        s = source[r.doc_id, r["size"]]
        assert r.source_size == by[s] and math.isclose(r.target, aim[s], rel_tol=1e-9, abs_tol=1e-6) and r.taken <= 2 * r["size"]
        took[s] += r.taken
    assert all(took[s] == math.floor(aim[s] + 1e-9) for s in by)
    again = mix.taken(*mix.mixed(df.repartition(3), [3.0, 1.0, 2.0], 1.5, 2, block=64))
    key = lambda df: sorted((r.doc_id or -1, r["size"], r.taken) for r in df.select("doc_id", "size", "taken").collect())
    assert key(got) == key(again)
    # every slot holds one source's block; each block is whole words of that source
    assert pieces.groupBy("slot").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).filter("n > 64").count() == 0
    assert mix.taken(*mix.mixed(df.limit(0), [1.0])).count() == 0


def test_schedule_is_even(spark):
    shares = spark.createDataFrame([(0, 0, 50), (1, 50, 25), (2, 75, 5)], "place long, first long, count long")
    rows = mix.slots(shares, 80).orderBy("slot").collect()
    seen = Counter()
    for n, r in enumerate(rows, 1):
        assert r["rank"] == seen[r.place]
        seen[r.place] += 1
        assert all(abs(seen[p] - n * c / 80) <= 8 for p, c in ((0, 50), (1, 25), (2, 5)))
    assert seen == {0: 50, 1: 25, 2: 5}


def test_repeated_documents(spark):
    df = corpus(spark, ["a b c"] * 5 + ["d " * 30, None, ""])
    out = mix.repeated(df, [1.0, 1.0], 1.5, 2)
    assert out.columns == df.columns and set(r.text for r in out.collect()) <= {"a b c", "d " * 30}
    assert mix.repeated(df.limit(0), [1.0]).count() == 0


def test_whole_documents_come_near_their_targets(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([1, 5, 40, 300]), "en", "abcde"[k % 5], 0) for k in range(600)] + [(600, "w " * 30_000, "en", "a", 0)]
    df = docs(spark, rows).withColumns({"slot": F.lit(1), "row": F.lit("r")})
    by = Counter()
    for r in rows:
        by[r[3]] += len(r[1].split())
    aim = wanted(by, [3, 1, 2], 1.5, 2)
    out = mix.repeated(df, [3.0, 1.0, 2.0], 1.5, 2, block=512).collect()
    took, uses = Counter(), Counter(r.doc_id for r in out)
    for r in out:
        took[r.source] += len(r.text.split())
    assert max(uses.values()) <= 2 and all(r.text == rows[r.doc_id][1] for r in out)
    assert all(aim[s] * 0.99 - 5 <= took[s] <= aim[s] for s in by)
    # documents lie in the order of the schedule: every tenth of the mix holds each source by its share
    some = [s for s in by if s != "a"]
    n = sum(took[s] for s in some)
    part, done = Counter(), 0
    for r in out:
        if r.source != "a":
            done += len(r.text.split())
            part[r.source] += len(r.text.split())
            if done > n / 2:
                break
    assert all(abs(part[s] / took[s] - 0.5) < 0.15 for s in some)


# --- line dedup ---


def test_line_dedup(spark):
    base = [f"line {k} of it" for k in range(6)]
    texts = ["\n".join(base), "x\n" + "\n".join(base[1:4]) + "\ny", "\n".join([base[0], "", base[1], base[2], "z"]), "a\nb", None, "", "r\ns\nt\nr\ns\nt\n", "\n".join(base)]
    df = corpus(spark, texts).withColumns({"removed": F.lit("old"), "w": F.lit(1)})
    got = {r.doc_id: r for r in linededup.deduplicated(df).collect()}
    assert got[0].text == texts[0] and got[1].text == "x\ny" and got[2].text == "\nz" and got[3].text == "a\nb" and got[4].text is None and got[5].text == ""
    assert got[6].text == "r\ns\nt\n" and got[7].text == "" and [got[k].removed_ for k in (0, 1, 2, 6, 7)] == [0, 3, 3, 3, 6] and got[1].w == 1 and got[1].removed == "old"
    twice = linededup.deduplicated(df.union(df).withColumn("doc_id", F.when(F.col("doc_id") == 7, None).otherwise(F.col("doc_id"))))
    assert Counter((r.doc_id, r.text) for r in twice.collect()) == Counter({(None if k == 7 else k, r.text): 2 for k, r in got.items()})
    assert linededup.deduplicated(df.limit(0)).count() == 0


def test_long_passages_on_few_lines(spark):
    w = lambda k, n: " ".join(f"p{k}w{i}" for i in range(n))
    one, two, three = w(1, 60), [w(2, 30), w(3, 30)], w(4, 50)
    texts = [f"a\n{one}\nb\n{two[0]}\n{two[1]}\nc\n{three}", f"d\n{one} \ne", f"f\n\n{two[0]}\n\n{two[1]}\ng", f"h\n{three}\ni", one, "short\ntext", "short\ntext", f"j\n{two[0]}\nk"]
    got = {r.doc_id: (r.text, r.removed) for r in linededup.deduplicated(corpus(spark, texts), passage=50).collect()}
    assert got == {0: (texts[0], 0), 1: ("d\ne", 1), 2: ("f\n\n\ng", 2), 3: (texts[3], 0), 4: ("", 1), 5: (texts[5], 0), 6: ("", 2), 7: (texts[7], 0)}
    kept = corpus_pipeline.line_dedup(spark, corpus(spark, texts), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 7]


# --- sharding ---


def filled(names, slots):
    """The table by turns, each shard walking its whole permutation as a list."""
    digest = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    walks = [iter([(digest(f"start:{x}") % slots + j * (digest(f"step:{x}") % (slots - 1) + 1)) % slots for j in range(slots)]) for x in names]
    owner: dict[int, int] = {}
    while len(owner) < slots:
        for k, walk in enumerate(walks):
            slot = next((x for x in walk if x not in owner), None)
            if slot is not None:
                owner[slot] = k
    return [owner[k] for k in range(slots)]


@pytest.mark.parametrize("n, slots", [(1, 2), (3, 3), (7, 503), (100, 1009)])
def test_lookup_is_filled_by_turns(n, slots):
    names = [f"shard-{k:03d}" for k in range(n)]
    assert sharding.lookup(names, slots).tolist() == filled(names, slots)


def test_sharding(spark):
    names = [f"s{k}" for k in range(7)]
    table = np.array(filled(names, 503))
    assert max(Counter(table.tolist()).values()) - min(Counter(table.tolist()).values()) <= 1
    fewer = sharding.lookup(names[:-1], 503)
    assert ((table != fewer) & (table != 6)).mean() < 0.15  # few slots move but those of the shard that left
    with pytest.raises(ValueError):
        sharding.lookup(names, 500)
    df = corpus(spark, ODD).withColumn("shard", F.lit("x")).union(docs(spark, [(None, "t", "", "", 1), (None, None, "", "", 1), (3, "other", "", "", 1)]).withColumn("shard", F.lit("x")))
    got = sharding.sharded(df, names, 503).collect()
    assert len(got) == len(ODD) + 3 and all(r.shard == names[table[r.slot]] for r in got)
    assert all(r.slot == int(hashlib.md5(f"k{r.doc_id}".encode()).hexdigest()[:15], 16) % 503 for r in got if r.doc_id is not None)
    assert sharding.sharded(df.limit(0), names, 503).count() == 0


# --- byte-level BPE ---


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.text(alphabet="aeiou th'sré \n1!=日", max_size=60))
def test_bpe_like_tiktoken(vocabulary, a, b):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    c = _codec(vocabulary)
    for text in (a, b, a + b):
        text = text.encode("utf-8", "ignore").decode()
        ids = c.encode(text)
        assert ids.tolist() == plain.encode_ordinary(text) and c.decode(ids) == text.encode()


_held: dict = {}


def _codec(v):
    return _held.setdefault(id(v), bpe.Codec(v))


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=20), st.data())
def test_bpe_appends_and_edits(vocabulary, piece, more, data):
    e = _held.setdefault("encoder", bpe.PrefixEncoder(vocabulary))
    table = e.extend(piece, [])
    assert e.ids(table) == [vocabulary.ranks[p] for p in bpe.merged(piece, vocabulary.ranks, 1 << 60)]
    assert e.append(piece, table, more)[1] == e.extend(piece + more, [])
    a = data.draw(st.integers(0, len(piece)))
    b = data.draw(st.integers(a, len(piece)))
    new, got, _ = e.edit(piece, table, a, b, more)
    assert got == (e.extend(new, []) if new else [])


def test_bpe_edit_is_local(vocabulary):
    e = bpe.PrefixEncoder(vocabulary)
    piece = b"thequickbrownfox" * 200
    table = e.extend(piece, [])
    new, got, done = e.edit(piece, table, 1600, 1601, b"zz")
    assert got == e.extend(new, []) and done < 400


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=40) | st.text(alphabet=" aehnrt\0\u65e5", min_size=1, max_size=30).map(str.encode), min_size=1))
def test_bpe_many_pieces_as_one_by_one(vocabulary, pieces):
    e = _held.setdefault("encoder", bpe.PrefixEncoder(vocabulary))
    got = [np.frombuffer(x, np.uint32).tolist() for x in e.encode_all(sorted(pieces))]
    assert got == [e.ids(e.extend(p, [])) for p in sorted(pieces)]


def test_bpe_encodes_what_is_new_together(vocabulary, monkeypatch):
    """Only pieces too long to be kept are encoded alone; before, each new one was.  Small memories, runs and places of pairs change nothing."""
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng, alone = random.Random(3), []
    made = bpe.PrefixEncoder.encode
    monkeypatch.setattr(bpe.PrefixEncoder, "encode", lambda self, piece: alone.append(piece) or made(self, piece))
    word = lambda: "".join(rng.choice(["the", "on", "r", "sh", "ent", "\u00e9", "\u65e5\u672c"]) for _ in range(rng.randint(1, 6)))
    texts = ["", None, *(" ".join(word() for _ in range(n)) for n in (3, 400, 0, 70)), "x" * 300]
    for sizes in ({}, {"PIECES_KEPT": 40, "AT_ONCE": 50, "TOGETHER": 7, "PLACES": 8}):
        for name, size in sizes.items():
            monkeypatch.setattr(bpe, name, size)
        alone.clear()
        got = bpe.Codec(vocabulary).encode_all(texts)
        assert [x.tolist() for x in got] == [plain.encode_ordinary(t or "") for t in texts] and alone == [b"x" * 300]


def test_bpe_query(spark, vocabulary):
    encode, decode, digest = bpe.udfs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    df = bpe.encoded(corpus(spark, ODD).withColumn("ids", F.lit(1)), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in df.withColumns({"back": decode("ids"), "d": digest("ids")}).collect():
        ids = plain.encode_ordinary(r.text or "")
        assert r.ids == ids and bytes(r.back) == (r.text or "").encode()
        assert (r.d.n_tokens, r.d.ids_sha256, r.d.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert df.limit(0).count() == 0


def test_workers_forget(monkeypatch):
    """What an operator holds in a worker goes when another one runs there, and when it idles."""
    monkeypatch.setattr(common, "IDLE", 0.2)
    gone = []
    mine, other = common.lean(lambda x: x, "a"), common.lean(lambda x: x)
    common.hold("a", lambda: gone.append(1))
    assert mine(3) == 3 and not gone and other(4) == 4 and gone == [1] and not common.HELD
    common.hold("a", lambda: gone.append(2))
    mine(1)
    time.sleep(0.8)
    assert gone == [1, 2]


# --- embeddings ---


def links_of(vectors, labels, threshold=0.98):
    ok = [k for k, v in enumerate(vectors) if v and labels[k] is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(vectors[k]) / np.abs(vectors[k]).max() for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    pairs = [(a, b) for a in ok for b in ok if a < b and labels[a] == labels[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    n = Counter(k for p in pairs for k in p)
    return n, components.joined(pairs, len(vectors))


@pytest.mark.parametrize("block", [4, 4096])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    vectors = [(centres[k % 5] * (1 + k % 3) + rng.normal(size=16) * 0.06 * (k % 7)).tolist() for k in range(60)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[0]], None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [1.0, 0.001], [1e200, 1e200], [1.0, 1.0]]
    labels = [k % 2 for k in range(60)] + [0, 1, 0] + [0] * 10
    labels[7] = None
    df = spark.createDataFrame([(k, v, lab) for k, (v, lab) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    n, root = links_of(vectors, labels)
    got = embdedup.near_duplicates(df.union(spark.createDataFrame([(None, vectors[0], 0, "")], "vec_id long, embedding array<double>, label int, n_links string")), 0.98, block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (n[k], root[k]) for k in range(len(vectors))} | {None: (0, None)}
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_tiles_grow_with_the_vectors(spark):
    """Vectors in tight groups: twice as many have about twice as many pairs of blocks to multiply, not four times."""
    rng = np.random.default_rng(5)

    def count(groups):
        centres = rng.normal(size=(groups, 24))
        x = np.concatenate([c + rng.normal(size=(10, 24)) * 0.05 for c in centres]).astype(np.float64)
        df = spark.createDataFrame([(k, v.tolist(), 1, 1, hash(k), 24) for k, v in enumerate(x)], "id long, embedding array<double>, label int, copies long, h long, dim int")
        tiles, known = embdedup.tiled(df, 0.98, 20)
        return tiles.count(), known.select("block").distinct().count()

    (a, blocks_a), (b, blocks_b) = count(60), count(120)
    assert blocks_a >= 20 and blocks_b >= 1.6 * blocks_a and b <= 3 * a and a < blocks_a * (blocks_a + 1) / 4


def test_long_vectors_and_repeated_rows(spark):
    """Over 1,040 dimensions, where sums go by parts; rows that repeat a vec_id count as others."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 1500))
    vectors = [(base[k % 4] + rng.normal(size=1500) * 0.02 * (k % 3)).tolist() for k in range(16)]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    n, root = links_of(vectors, [1] * 16)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicates(df).collect()} == {k: (n[k], root[k]) for k in range(16)}
    twice = embdedup.near_duplicates(df.union(df)).collect()
    assert len(twice) == 32 and {(r.vec_id, r.n_links, r.component_id) for r in twice} == {(k, 2 * n[k] + 1, root[k]) for k in range(16)}


def test_quantisation_bounds():
    rng = np.random.default_rng(0)
    a, b = embdedup.unit(rng.normal(size=(50, 48))), embdedup.unit(rng.normal(size=(40, 48)))
    (qa, sa, ea), (qb, sb, eb) = embdedup.quantised(a), embdedup.quantised(b)
    rough = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb[None, :]
    assert (np.abs(a @ b.T - rough) <= ea[:, None] + (1 + ea)[:, None] * eb[None, :]).all()
    for t in (0.0, 0.2, 0.5):
        found = {(i, j) for r, c in embdedup.linked(a, b, t) for i, j in zip(r.tolist(), c.tolist(), strict=True)}
        assert found == set(zip(*[x.tolist() for x in np.nonzero(a @ b.T >= t)], strict=True))


# --- MinHash ---


def near(texts, percent=85, width=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], components.joined(pairs, len(sets))


@pytest.mark.parametrize("block", [6, 256])
def test_minhash(spark, block):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    bases = [[rng.choice(words) for _ in range(90)] for _ in range(4)]
    texts = list(ODD)
    for b in bases:
        for _ in range(14):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(c).replace("w1", rng.choice(["w1", "W1"])))
    texts += [texts[20].upper(), "One", "four words are here", "FOUR words\tare here"]
    n, root = near(texts)
    df = corpus(spark, texts).withColumns({"key": F.lit("k"), "id": F.lit(0), "band": F.lit(1)}).union(docs(spark, [(None, texts[20], "", "", 1)]).withColumns({"key": F.lit("k"), "id": F.lit(0), "band": F.lit(1)}))
    got = minhash.near_duplicates(df, 85, 5, block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {k: (n[k], root[k]) for k in range(len(texts))}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_of_repeated_ids(spark):
    """Rows of one doc_id are one document, whichever comes first; the one of the least hash of words speaks for it."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    key = lambda t: minhash.keyed(pa.array([t]))[0].as_py()
    low, high = sorted((a, b), key=key)
    rows = [(5, high, "", "", 1), (5, low, "", "", 1), (7, low + " end", "", "", 1), (8, high + " end", "", "", 1), (9, low, "", "", 1), (9, low, "", "", 1)]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(docs(spark, order), 85).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(5, 5): 2, (7, 5): 1, (8, 8): 1, (9, 5): 2})
    kept = corpus_pipeline.near_dedup(spark, docs(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8] and kept.columns == docs(spark, []).columns


def test_near_dedup_stage_from_four_fifths(spark):
    words = [f"w{k}" for k in range(104)]
    close = words[:30] + ["x"] + words[31:60] + ["y"] + words[61:]  # 90 of 110 shingles
    apart = words[:30] + ["x"] + words[31:60] + ["y"] + words[61:90] + ["z"] + words[91:]  # 85 of 115
    texts = [" ".join(w) for w in (words, close, apart)]
    assert near(texts[:2], 85)[1] == [0, 1] and near(texts[:2], 80)[1] == [0, 0] and near([texts[0], texts[2]], 80)[1] == [0, 1]
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, corpus(spark, texts[:2]), SF).collect()] == [0]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, corpus(spark, [texts[0], texts[2]]), SF).collect()) == [0, 1]


def test_large_sets_fill_the_circle():
    """Sets of more shingles than the circle has places are alike in all bands, and so are checked."""
    rng = np.random.default_rng(2)
    a, b = (minhash.signature(rng.integers(0, 2**63, 1 << 23).astype(np.uint64)) for _ in range(2))
    assert (a == b).mean() > 0.9 and set(minhash.bands(a)) & set(minhash.bands(b))


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:340], rng.integers(0, 2**63, 60).astype(np.uint64)])
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 340 / 460) < 0.12
    assert np.array_equal(minhash.signature(a), minhash.signature(a[::-1]))


# --- components ---


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    root = components.joined(pairs, 301)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: root[k] for p in pairs for k in p}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- host rules ---


def test_host_rules(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(k, good, "en", "good.org", 0) for k in range(40)] + [(100 + k, "short", "en", "bad.org", 0) for k in range(60)] + [(200, good, "en", "bad.org", 0), (201, "short", "en", "tiny.org", 0), (202, good, "en", "tiny.org", 0), (300, None, None, None, None), (301, "a b c d e f g " * 3 + "\nx y\n \nx y", "en", None, 0)]
    df = docs(spark, rows).withColumns({"host": F.lit(1), "kept": F.lit(2)})
    got = {r.doc_id: r for r in hostrules.judged(df, F.col("source")).collect()}
    assert got[0].kept and not got[200].kept and not got[200].base_failed and got[202].kept and not got[300].kept
    assert (got[301].n_words, got[301].n_repeat_words, got[301].n_dup_lines, got[300].n_words) == (25, 21, 1, 0)
    assert hostrules.judged(df.limit(0), F.col("source")).count() == 0


def moments(hosts):
    """Shrunk rates by the words of the method, from (documents, failing) of each host."""
    n, f = np.array(hosts, dtype=float).T
    mean = f.sum() / n.sum()
    spread = (n * (f / n) ** 2).sum() / n.sum() - mean**2 - mean * (1 - mean) / max(1, len(n) / (1 / n).sum())
    if spread <= 0:
        return [mean] * len(n)
    both = max(mean * (1 - mean) / spread - 1, 0)
    return ((f + mean * both) / (n + both)).tolist()


@pytest.mark.parametrize("hosts", [[(50, 5), (40, 20), (60, 12), (3, 3), (1, 0), (2, 1)], [(30, 30), (30, 0)], [(40, 4), (40, 4)], [(5, 5)]])
def test_host_prior_is_fitted(spark, hosts):
    df = spark.createDataFrame([(k, n, f) for k, (n, f) in enumerate(hosts)], "host long, n long, failed long")
    assert np.allclose([r.rate for r in hostrules.shrunk(df).orderBy("host").collect()], moments(hosts))
    assert hosts[0] != (50, 5) or 0.1 < moments(hosts)[3] < 0.9  # three documents, all failing, stay away from 1


def test_host_rules_on_odd_rows(spark):
    """Long texts and repeated rows count like others."""
    long_ = " ".join(f"w{k}" for k in range(60_000))
    rows = [(k, t, "en", "h", 0) for k, t in enumerate([*ODD, long_, long_ + " " + long_])]
    got = {r.doc_id: r for r in hostrules.judged(docs(spark, rows + rows), F.col("source")).collect()}
    n = len(rows)
    assert hostrules.judged(docs(spark, rows + rows), F.col("source")).count() == 2 * n and got[n - 2].n_words == 60_000 and got[n - 2].n_repeat_words == 0
    assert (got[n - 1].n_words, got[n - 1].n_repeat_words) == (120_000, 120_000) and got[5].n_repeat_words == 20_000 and got[n - 2].host_rate == got[0].host_rate


# --- HTML ---


def test_html(spark):
    page = lambda body, x: f"<html><head><title>t</title></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We bake</div>{body}<div id=sidebar>more</div><ul class=comments><li>Nice</li></ul><form>send</form><script>if (a < b) '</p>'</script><footer>&copy; {x}</footer>"
    rows = [
        (1, "http://a.org/x/1", page("<article><header><h1>A &amp; B</h1></header><p>One <b>t</b>wo<br>three<p>&lt;x&gt; &#233;<aside>ad</aside></article>", 1)),
        (2, "http://b.org/x/1", page("<div><p>Shared line here</p><p>Only one &eacute;</p><p><a href=y>all of it a link</a></p></div>", 2)),
        (3, "http://www.b.org/x/2#top", page("<div><p>Shared line here</p><p>Only two</p></div>", 3)),
        (4, None, "<p>No place"), (5, "http://c.org/", None), (6, "http://c.org/", ""), (7, "http://d.org/z", "<p>alone</p><p cut"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r.text for r in htmltext.extracted(df).collect()}
    assert got == {1: "A & B\nOne two three\n<x> é", 2: "Only one é", 3: "Only two", 4: "No place", 5: "", 6: "", 7: "alone"}
    assert htmltext.extracted(df.limit(0)).count() == 0
    twice = htmltext.extracted(df.union(df)).collect()
    assert len(twice) == 14 and {r.text for r in twice if r.page_id == 1} == {got[1]}


def test_html_site_lines_inside_articles(spark):
    page = lambda *p: "<nav>Menu</nav><article><h1>Guide</h1>" + "".join(f"<p>{x}" for x in p) + "</article>"
    long = [f"Line {k} of a text that two pages have in common" for k in range(4)]
    rows = [
        (1, "http://a.org/g/1", page("First of its own, long enough", "<div class=box>Ask the site", "More of the first page here")),
        (2, "http://a.org/g/2", page("The second has other words", "<div class=box>Ask the site")), (7, "http://a.org/g/3", page("The third has others again", "Yes.", "<div class=box>Ask the site")), (8, "http://a.org/g/4", page("The last is short but has words", "Yes.", "Ask the site")),
        (3, "http://b.org/1", page(*long, "ends one way")), (4, "http://b.org/2", page(*long, "ends another way")),
        (5, "http://c.org/1", "<p>Open page<p>Ask c"), (6, "http://c.org/2", page("Text of the page with an article", "Ask c")),
    ]
    got = {r.page_id: r.text for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Guide\nFirst of its own, long enough\nMore of the first page here" and got[2] == "Guide\nThe second has other words"
    assert got[7] == "Guide\nThe third has others again\nYes." and got[8] == "Guide\nThe last is short but has words\nYes."
    assert got[3] == "\n".join(["Guide", *long, "ends one way"]) and got[4] == "\n".join(["Guide", *long, "ends another way"])
    assert got[5] == "Open page" and got[6] == "Guide\nText of the page with an article\nAsk c"


def sites(rng):
    """Pages of known text, without any element or name that says what is text: (page_id, url, html) and texts."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, truth = [], {}
    for site in range(8):
        top, side, foot = [line(3) for _ in range(6)], [line(4) for _ in range(20)], [line(12) for _ in range(4)]
        ask = line(5)
        for k in range(rng.randint(6, 30)):
            text = [line(rng.randint(3, 40)) for _ in range(rng.randint(3, 12))]
            block = rng.sample(side, len(side) - 1)
            block.sort(key=side.index)
            cut = rng.randint(1, len(text) - 1)
            body = [*top, *text[:cut], ask, *text[cut:], *block, *foot]
            i = len(rows)
            rows.append((i, f"https://site{site}.org/{rng.choice(['a', 'b'])}/{rng.randint(1, 10**6)}?x={k}", "<html><body>" + "".join(rng.choice([f"<div>{x}</div>", f"<p>{x}", f"<section><span>{x}</span></section>"]) for x in body)))
            truth[i] = "\n".join(text)
    return rows, truth


def differenced(rows):
    """The same by brute force: of each host all pages sorted, and of each page the four next to it."""
    by, out = {}, {}
    for i, url, html in rows:
        m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:www\.|m\.)?([^/?#]*)([^?#]*)", url or "")
        by.setdefault(m[1].lower() if m else "", {}).setdefault(html, []).append((m[2] if m else "", i))
    for host, pages in by.items():
        listed = sorted((min(p for p, _ in v), h) for h, v in pages.items())
        found = [htmltext.blocks(h or "") for _, h in listed]
        text = [[t for t, *_ in f] for f, _ in found]
        kind = [htmltext.kinds(*f) for f in found]
        for k, (_, h) in enumerate(listed):
            near_ = [text[j] for d in range(1, 5) for j in (k - d, k + d) if host and 0 <= j < len(listed)][:4]
            gone = set(htmltext.goes(text[k], [len(t) for t in text[k]], kind[k], found[k][1], near_))
            kept = [t for t, x in zip(text[k], kind[k], strict=True) if x]
            for _, i in pages[h]:
                out[i] = "\n".join(t for n, t in enumerate(kept) if n not in gone)
    return out


@pytest.mark.parametrize("stretch", [7, 1_000])
def test_html_pages_of_known_text(spark, monkeypatch, stretch):
    monkeypatch.setattr(htmltext, "STRETCH", stretch)
    rows, truth = sites(random.Random(9))
    n = len(rows)
    # copies: exact ones, one with another line, one of the same path; they take nothing from each other
    rows += [(n + k, u.replace("?", "?again&"), h) for k, (_, u, h) in enumerate(rows[:10])] + [(n + 20 + k, u.replace("?", "/print?"), h + "<p>one line more of its own</p>") for k, (_, u, h) in enumerate(rows[:10])]
    got = {r.page_id: r.text for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == differenced(rows)
    assert sum(got[k] == t for k, t in truth.items()) >= 0.95 * len(truth)


def test_html_site_lines_outweigh_a_page(spark):
    """Twenty lines of the site and three of the page: the site's go, though they are most of it."""
    page = lambda k, tag: f"<{tag}>" + "".join(f"<p>Line {i} of every page here</p>" for i in range(20)) + "".join(f"<p>Own {k} line {i}</p>" for i in range(3)) + f"</{tag}>"
    rows = [(k, f"http://a.org/{k}", page(k, "div")) for k in range(5)] + [(9, "http://b.org/", page(9, "div")), (10, "http://c.org/", "<p>text</p>" * 30_000 + "<p>end</p>"), (11, "http://c.org/x", "<p>text</p>" * 20_000 + "<p>other</p>")]
    got = {r.page_id: r.text for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join(f"Own {k} line {i}" for i in range(3)) for k in range(5))
    assert got[9].count("\n") == 22 and got[10].endswith("end") and got[11].endswith("other")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_alignment_by_bits(a, b):
    got, rest = htmltext.by_bits(a, b), iter(b)
    assert len(got) == len(htmltext.aligned(a, b)) and all(any(a[k] == y for y in rest) for k in sorted(got))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = sorted(htmltext.aligned(a, b))
    rest = iter(b)
    assert len(got) == table[-1][-1] and all(any(a[k] == y for y in rest) for k in got)


# --- personal data ---


def test_pii_base():
    text = "Mail a.b+c@x-y.example.com, or @no or b@c; 1.2.3.4 and 1.2.3.400 and 01.002.3.4.5; card 4111 1111-1111 1111 not 4111111111111112; +1 (326) 555-7457 +12 34"
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base(text)] == [("email", "a.b+c@x-y.example.com"), ("ip", "1.2.3.4"), ("ip", "01.002.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (326) 555-7457")]
    assert pii.base("9" * 50_000) == [] and pii.base("") == []


def contract_base(text):
    """The patterns of the contract, as they are."""
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), kind, m.end()) for kind, (pattern, good) in enumerate(tests) for m in re.finditer(pattern, text) if good(m))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@+-_ 0123459()x\n", max_size=60), st.lists(st.sampled_from(["a.b@c.de", "@x.y", "1.2.3.4", "255.256.1.1", "1.22.333.4.5", "4111 1111-1111 1111", "4111111111111112", "+1 (326) 555-7457", "+12", " ", "-", "9", "."]), max_size=8))
def test_pii_base_is_the_contract(text, parts):
    for t in (text, "".join(parts), text + "".join(parts)):
        assert pii.base(t) == contract_base(t)


def number(rng):
    return f"+1 ({rng.randint(100, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"


def cards(rng):
    d = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(d + str(k) for k in range(10) if pii.luhn(d + str(k)))


def test_pii_field_carries_labels(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        n, card, net = number(rng), cards(rng), ".".join(str(rng.randint(1, 250)) for _ in range(4))
        rows.append((k, f"Call {n} now. In {rng.randint(1900, 2020)} he paid {rng.randint(1, 99)} for v{rng.randint(1, 9)}.{rng.randint(1, 9)}. Mail u{k}.{k}@x.org or u{k}.{k}@x.org, card {card} from {net}. Again {n}.", "en", "s", 0))
    for k, t in enumerate(ODD):
        rows.append((1000 + k, t, "en", "s", 0))
    for k in range(20):
        rows.append((1100 + k, f"No data: {rng.randint(10**11, 10**12)} parts of {rng.randint(10**6, 10**7)} in v{k}.2.3, see a@b and +12 34.", "en", "s", 0))
    wanted_ = {
        2000: ("Pay 4111111111111111 today. Then 12 4111111111111111 was seen, the year 1999 too.", [("card", "4111111111111111")]),
        2001: ("Pay 4111 1111 1111 1111. Or 4111111111111112 and 4111 1111 1111 1121, order 880011223344.", [("card", "4111111111111112"), ("card", "4111 1111 1111 1121")]),
        2002: ("Call +1 (743) 555-3824. Or 743-555-3824, or 7435553824, not 743-555-9999 in 1999.", [("phone", "743-555-3824"), ("phone", "7435553824")]),
        2003: ("Mail jane.33@x.org or jane.33(at)x.org, jane.33@x too; john.44@x is another.", [("email", "jane.33(at)x.org"), ("email", "jane.33@x")]),
        2004: ("Of 10.1.2.3 and of 10.1.2.999, with v3.4.5 of it.", [("ip", "10.1.2.999")]),
        2005: ("First 743-555-3824 stands, then +1 (743) 555-3824. " + "word " * 50_000 + "Last 7435553824.", [("phone", "743-555-3824"), ("phone", "7435553824")]),
    }
    rows += [(k, t, "en", "s", 0) for k, (t, _) in wanted_.items()]
    df = docs(spark, rows).withColumn("base", F.lit(1))
    got = {r.doc_id: r for r in pii.found(df).collect()}
    assert len(got) == len(rows)
    texts = {x[0]: x[1] for x in rows}
    for k, r in got.items():
        text = texts[k] or ""
        assert [(s.start, s.kind, s.end) for s in r.base] == [(a, pii.KINDS[q], b) for a, q, b in contract_base(text)]
        assert all(not any(s.start < b.end and b.start < s.end for b in r.base) for s in r.added)
        assert [(s.kind, text[s.start : s.end]) for s in r.added] == wanted_.get(k, (None, []))[1]
    twice = pii.found(df.union(df)).filter("doc_id = 2001 AND size(added) = 2").count()
    assert twice == 2 and pii.found(df.limit(0)).count() == 0


def test_field_spreads_along_skip_edges():
    node = np.zeros((pii.N_FEATURES, pii.STATES))
    node[0, 0] = 0.5
    field = pii.Field(node, np.zeros((pii.STATES, pii.STATES)), np.eye(pii.STATES) * 6)
    g = pii.graph("A +15557713444 b and 5557713444 c", [(2, 3, 14)])
    k = [g.spans.index(x) for x in ((2, 14), (21, 31))]
    assert g.skip == [tuple(k)] and field.beliefs(g)[k[1]].argmax() == 4 and field.beliefs(g)[k[1]].max() > 0.9


def test_beliefs_are_exact_on_trees():
    """Sum-product messages give the marginals of a chain, by brute force over all labels."""
    rng = np.random.default_rng(5)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, pii.STATES)), rng.normal(size=(pii.STATES, pii.STATES)), np.zeros((pii.STATES, pii.STATES)))
    field.chain = (field.chain + field.chain.T) / 2
    g = pii.Graph([(k, k + 1) for k in range(4)], rng.normal(size=(4, pii.N_FEATURES)) * 0.3, np.array([0, 2, 0, 0]), [(0, 1), (1, 2), (2, 3)], [])
    own, total = g.features @ field.node, np.zeros((4, pii.STATES))
    for y in itertools.product(range(pii.STATES), repeat=4):
        if y[1] == 2:
            weight = np.exp(own[[0, 2, 3], [y[0], y[2], y[3]]].sum() + sum(field.chain[y[a], y[b]] for a, b in g.chain))
            total[np.arange(4), y] += weight
    assert np.allclose(field.beliefs(g), total / total.sum(axis=1, keepdims=True), atol=0.01)


# --- quality ---


def test_factorisation_machine():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(12, 3))
    m = fmquality.Machine(np.zeros(1), np.ones(1), np.zeros((1, 1)), 0.1, rng.normal(size=12), v)
    x = rng.normal(size=(5, 12))
    slow = [0.1 + r @ m.w + sum((v[i] @ v[j]) * r[i] * r[j] for i in range(12) for j in range(i)) for r in x]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.array(slow))))
    assert fmquality.fit(np.zeros((0, fmquality.BUCKETS)), np.zeros((0, fmquality.N_STATISTICS)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    w, s = fmquality.features(pa.array(["", None, "é"]), pa.array([0.0, None, 5.0]))
    meta = s[:, -4:].tolist()
    assert w.shape == (3, fmquality.BUCKETS) and np.isfinite(s).all() and np.array_equal(s[0, :-4], s[1, :-4])
    assert meta[:2] == [[1, 1, 0, 0], [0, 0, 0, 0]] and np.allclose(meta[2], [1, 1, math.log(6), math.log(3)])


def test_quality_query(spark):
    got = {r.doc_id: r for r in queries.op10_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) >= 0.95
    odd = corpus(spark, ODD)
    score = fmquality.scored(odd, fmquality.learned(odd, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")))
    assert [r[0] for r in odd.select(score).collect()] == [0.5] * len(ODD)


def test_quality_of_odd_rows(spark):
    """Nulls, empty, long and repeated texts, clashing names and missing metadata go through a machine that has learned."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["fine", "prose", "of", "words"] if k % 2 else ["###", "$$$", "%%%"]) for _ in range(40)) for k in range(300)]
    df = corpus(spark, texts).withColumns({"y": F.lit("a"), "words": F.lit(1), "stats": F.lit(2), "f": F.lit(3)})
    labels = spark.createDataFrame([(k, k % 2, "z") for k in range(300)], "doc_id long, quality int, text string")
    machine = fmquality.learned(df, labels)
    odd = docs(spark, [(k, t, None, None, None if k % 2 else -5) for k, t in enumerate([*ODD, "fine prose of words " * 100_000, "### $$$ %%% " * 20, texts[1], texts[1]])])
    got = [r[0] for r in odd.select(fmquality.scored(odd, machine)).collect()]
    assert all(0 <= x <= 1 for x in got) and got[6] == pytest.approx(got[7], abs=0.2) and got[-3] < 0.5 < got[-2]
    same = odd.union(odd).filter("doc_id = 6").withColumn("n_chars", F.lit(7)).select("doc_id", fmquality.scored(odd.withColumn("n_chars", F.lit(7)), machine))
    assert len({r[1] for r in same.collect()}) == 1
    bare = odd.drop("n_chars")
    assert bare.select(fmquality.scored(bare, machine)).count() == 13 and odd.limit(0).select(fmquality.scored(odd, machine)).count() == 0
    assert not fmquality.learned(df.limit(0), labels).fitted and fmquality.learned(df.union(df), labels.union(labels)).fitted


# --- queries and pipeline ---


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run(spark, name):
    tables = {"op5_embedding_dedup": "embeddings", "op8_html": "pages", "op8_known_pages": "part"}
    n = spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet")
    n = n.select("source").distinct().count() if name == "op1_sources" else n.count()
    assert queries.QUERIES[name](spark, SF).count() == n


def without_repeats(rows, width=3, passage=50):
    """Line dedup by brute force over (doc_id, text) of different doc_ids: text without lines of runs that came before, and their number."""
    blank = lambda x: not x.strip(" \t\n\v\f\r")
    seen: dict = {}
    out = {}
    for i, text in sorted(rows):
        lines = [x for x in (text or "").split("\n") if not blank(x)]
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        runs = [(k, width) for k in range(len(lines) - width + 1)]
        if passage:
            runs += [(k, 1) for k in range(len(n)) if n[k] > passage]
            runs += [(k, 2) for k in range(len(n) - 1) if max(n[k : k + 2]) <= passage < sum(n[k : k + 2])]
            runs += [(0, len(lines))] if 0 < len(lines) < width else []
        runs, gone = sorted(set(runs)), set()
        for k, size in runs:
            key = (size, *[x.rstrip(" \t\r") for x in lines[k : k + size]])
            if seen.setdefault(key, (i, k)) != (i, k):
                gone |= set(range(k, k + size))
        kept, at = [], -1
        for x in (text or "").split("\n"):
            at += not blank(x)
            if blank(x) or at not in gone:
                kept.append(x)
        out[i] = ("\n".join(kept) if gone else text, len(gone))
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c ", "", " ", "d " * 30, "e " * 60]), max_size=8), max_size=6))
def test_line_dedup_by_brute_force(spark, texts):
    rows = [(k, "\n".join(t)) for k, t in enumerate(texts)]
    got = linededup.deduplicated(docs(spark, [(k, t, "", "", 0) for k, t in rows]), passage=50)
    assert {r.doc_id: (r.text, r.removed) for r in got.collect()} == without_repeats(rows)


def test_pipeline(spark, tmp_path):
    """Every stage on its own input, by brute force."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    of = {}
    rows = {"": d.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, SF).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert sorted(d.columns) == sorted(spark.read.parquet(f"{SF}/documents.parquet").columns)
        rows[name] = d.collect()
        of[name] = {r.doc_id for r in rows[name]}
    assert of["quality"] >= of["line_dedup"] >= of["near_dedup"] >= of["mixing"] == of["encoding"] > set()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, y in labels.items() if y == 1]
    assert sum(k in of["quality"] for k in good) >= 0.95 * len(good) and sum(k not in of["quality"] for k, y in labels.items() if y == 0) >= 0.6 * (len(labels) - len(good))
    cut = without_repeats([(r.doc_id, r.text) for r in rows["quality"]])
    assert {r.doc_id: r.text for r in rows["line_dedup"]} == {k: t for k, (t, n) in cut.items() if not n or t.strip()}
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"] if cut[r.doc_id][1])
    before = sorted((r.doc_id, r.text) for r in rows["line_dedup"])
    roots = near([t for _, t in before], 80)[1]
    assert of["near_dedup"] == {k for n, (k, _) in enumerate(before) if roots[n] == n}
    by, took = Counter(), Counter()
    for r in rows["near_dedup"]:
        by[r.source] += len((r.text or "").encode().split())
    for r in rows["mixing"]:
        took[r.source] += len(r.text.encode().split())
    aim = wanted(by, queries.WEIGHTS, queries.SHARE, queries.MOST)
    assert max(Counter(r.doc_id for r in rows["mixing"]).values()) <= 2 and {(r.doc_id, r.text) for r in rows["mixing"]} <= {(r.doc_id, r.text) for r in rows["near_dedup"]}
    assert all(took[s] <= aim[s] for s in by) and sum(took.values()) >= 0.8 * sum(aim.values())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in rows["mixing"]}
    assert all(list(r.ids) == plain.encode_ordinary(texts[r.doc_id]) for r in rows["encoding"]) and len(rows["encoding"]) == len(rows["mixing"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names, and a table without rows."""
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or "") if k % 2 else None) for k, t in enumerate([*ODD, " ".join(f"w{k}" for k in range(50_000))])]
    rows += [(None, None, None, None, None), (None, "three words here", None, "s", 1), (4, "same text of some words here now", "en", "s", 1)]
    df = docs(spark, rows + rows).withColumns({c: F.lit(c) for c in ("row", "removed", "__row", "id", "place", "size", "key", "band", "slot", "kept", "score", "d")})
    out = stage(spark, df, SF).collect()
    if name != "encoding":
        assert not out or list(out[0].asDict()) == df.columns and {r.removed for r in out} == {"removed"}
    ids = Counter(r.doc_id for r in out)
    if name == "quality":
        assert all(n % 2 == 0 for n in ids.values())
    elif name == "line_dedup":
        long_ = [r.text for r in out if r.doc_id == len(ODD)]
        assert long_ == [rows[len(ODD)][1]] * 2 and ids[0] == 2 and ids[None] == 4
    elif name == "near_dedup":
        assert all(n == 1 for k, n in ids.items() if k is not None) and ids[None] == 4 and 7 not in ids
    elif name == "mixing":
        words = lambda t: len((t or "").split())
        held = Counter(r[0] for r in rows + rows)
        assert all(words(r.text) for r in out) and all(n <= 2 * held[k] for k, n in ids.items())
    else:
        assert len(out) == 2 * len(rows)
    assert stage(spark, df.limit(0), SF).count() == 0
