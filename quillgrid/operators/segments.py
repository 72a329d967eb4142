"""The parts of documents as columns: blocks, sentences, headings, list items, links and the rest, each an array with places."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.dialect import compiled
from quillgrid.functions.segment import Document, count_letters
from quillgrid.plans.rules import grade, syllables
from quillgrid.plans.session import spread

PARTS = (
    "struct<masked:string,words:int,blocks:array<struct<start:int,end:int,kind:string>>,sentences:array<struct<start:int,end:int>>,headings:array<struct<level:int,text:string,line:int,start:int>>,"
    "items:array<struct<indent:int,marker:string,text:string,line:int,start:int>>,links:array<struct<text:string,target:string,start:int>>,images:array<struct<text:string,target:string,start:int>>,"
    "bold:array<struct<start:int,length:int>>,breaks:array<struct<line:int,start:int>>,tables:array<int>,definitions:array<struct<id:string,start:int,length:int>>,uses:array<string>>"
)
I, S = pa.int32(), pa.string()
SHAPES = {
    "blocks": {"start": I, "end": I, "kind": S},
    "sentences": {"start": I, "end": I},
    "headings": {"level": I, "text": S, "line": I, "start": I},
    "items": {"indent": I, "marker": S, "text": S, "line": I, "start": I},
    "links": {"text": S, "target": S, "start": I},
    "images": {"text": S, "target": S, "start": I},
    "bold": {"start": I, "length": I},
    "breaks": {"line": I, "start": I},
    "definitions": {"id": S, "start": I, "length": I},
}


def _cut(texts: pa.Array) -> pa.Array:
    docs = [Document(t or "") for t in texts.to_pylist()]
    columns = {"masked": pa.array([d.masked for d in docs], S), "words": pa.array([d.n_words for d in docs], I)}
    for name, shape in SHAPES.items():
        as_row = lambda x, names=tuple(shape): dict(zip(names, x, strict=True)) if isinstance(x, tuple) else {n: getattr(x, n) for n in names}
        columns[name] = pa.array([[as_row(x) for x in getattr(d, name)] for d in docs], pa.list_(pa.struct(list(shape.items()))))
    columns["tables"] = pa.array([sorted(d.table_lines) for d in docs], pa.list_(I))
    columns["uses"] = pa.array([sorted(d.uses) for d in docs], pa.list_(S))
    order = ["masked", "words", "blocks", "sentences", "headings", "items", "links", "images", "bold", "breaks", "tables", "definitions", "uses"]
    return pa.StructArray.from_arrays([columns[n] for n in order], names=order)


# The lines that queries to a model are cut at, and what ends a sentence or phrase there.
QUERY_HEADING, QUERY_ITEM, QUERY_QUOTE, QUERY_FENCE = compiled(r"^\s{0,3}(#{1,6})\s+(.+)$"), compiled(r"^(\s*)(?:[-*+]\s+|\d+[.)]\s+).+\S.*$"), compiled(r"^\s{0,3}>\s*\S.*$"), compiled(r"^\s{0,3}(```|~~~)")
QUERY_STOP = re.compile(r"""[.!?](?:["')\]}*_`]|[^\x00-\x7f])*(?=\s|\Z)""", re.ASCII)
PHRASE_ENDS = frozenset("\n.,;:!?)]")


def sentence_ranges(text: str) -> list[tuple[int, int]]:
    """(start, end) of a text's sentences, without white space around them; the whole of a text without any."""
    cuts, at = [], 0
    for m in QUERY_STOP.finditer(text):
        cuts.append((at, m.end()))
        at = m.end()
    cuts.append((at, len(text)))
    pieces = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in cuts]
    return [(a, b) for a, b in pieces if a < b] or ([(0, len(text))] if text else [])


def query_items(text: str, sentences: bool = False) -> list[tuple[str, str, int, int]]:
    """(prompt, text, start, end) of what a document asks of its context: paragraphs, list items, quotes and code blocks (or sentences of all but code), each with the headings and list items that it stands under."""
    out: list[tuple[str, str, int, int]] = []
    headings: list[str] = []
    above: list[tuple[int, str]] = []
    lines, starts, k = text.split("\n"), [0], 0
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    lines = [x.rstrip("\r") for x in lines]
    special = lambda x: not x.strip() or QUERY_FENCE.match(x) or QUERY_HEADING.match(x) or QUERY_ITEM.match(x) or QUERY_QUOTE.match(x)

    def put(first: int, last: int, whole: bool = False) -> None:
        a, b = starts[first], starts[last] + len(lines[last])
        for x, y in [(0, b - a)] if whole or not sentences else sentence_ranges(text[a:b]):
            body = text[a + x : a + y]
            out.append(("\n".join([*headings, *[line for _, line in above], body]) + "\n", body, a + x, a + y))

    while k < len(lines):
        line, first = lines[k], k
        k += 1
        if QUERY_FENCE.match(line):
            while k < len(lines) and not QUERY_FENCE.match(lines[k]):
                k += 1
            k = min(k + 1, len(lines))
            put(first, k - 1, True)
        elif not line.strip():
            above.clear()
        elif m := QUERY_HEADING.match(line):
            del headings[len(m[1]) - 1 :]
            headings.append(line)
            above.clear()
        elif (m := QUERY_ITEM.match(line)) or QUERY_QUOTE.match(line):
            indent = len(m[1].expandtabs(4)) if m else 0
            while above and above[-1][0] >= indent:
                above.pop()
            put(first, first)
            above.append((indent, line))
        else:
            while k < len(lines) and not special(lines[k]):
                k += 1
            put(first, k - 1)
            above.clear()
    return out


def phrases(text: str, tokens: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    """(start, end) of runs of a text's tokens (start, end): at least target of them up to one that ends a phrase, at most twice as many."""
    out, first, n, end = [], None, 0, 0
    for a, b in tokens:
        a, b = max(0, min(a, len(text))), max(0, min(b, len(text)))
        if b <= a:
            continue
        first, n, end = a if first is None else first, n + 1, b
        if n >= 2 * max(1, target) or n >= max(1, target) and PHRASE_ENDS & set(text[a:b]):
            out.append((first, end))
            first, n = None, 0
    return out if first is None else [*out, (first, end)]


def queries(docs: DataFrame, sentences: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, prompt, text, start, end of query_items() of every document."""
    ship(docs.sparkSession)
    shape = pa.struct([("prompt", S), ("text", S), ("start", I), ("end", I)])

    @F.arrow_udf("array<struct<prompt:string,text:string,start:int,end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(shape.names, x, strict=True)) for x in query_items(t or "", sentences)] for t in texts.to_pylist()], pa.list_(shape))

    return spread(docs.select(key, text)).select(key, F.posexplode(run(F.coalesce(text, F.lit("")))).alias("n", "x")).select(key, "n", "x.*")


def segmented(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and a column for each kind of part; offsets are code points of the text."""
    ship(docs.sparkSession)
    cut = F.arrow_udf(_cut, PARTS)
    return spread(docs.select(key, text)).select(key, cut(F.coalesce(text, F.lit(""))).alias("x")).select(key, "x.*")


def readability(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, words, sentences, syllables, grade (mean of Flesch-Kincaid and Coleman-Liau)."""
    ship(docs.sparkSession)
    word = compiled("[A-Za-z]+(?:'[A-Za-z]+)?")

    @F.arrow_udf("struct<words:int,sentences:int,syllables:int,grade:double>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            d = Document(t or "")
            w = word.findall(d.masked)
            n = sum(map(syllables, w))
            out.append({"words": len(w), "sentences": len(d.sentences), "syllables": n, "grade": grade(len(w), len(d.sentences), n, count_letters(d.masked))})
        return pa.array(out, pa.struct([("words", I), ("sentences", I), ("syllables", I), ("grade", pa.float64())]))

    return spread(docs.select(key, text)).select(key, run(F.coalesce(text, F.lit(""))).alias("x")).select(key, "x.*")


def line_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), start of every line of every document."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("k", "x"))
    order = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, (F.col("k") + 1).alias("line"), F.coalesce(F.sum(F.length("x") + 1).over(order), F.lit(0)).alias("start"))
