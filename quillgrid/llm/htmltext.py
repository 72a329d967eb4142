"""Main text of web pages: the difference from the pages of the nearest URLs, with structure as what is likely before.

Structure names what is surely not text (menus, scripts, forms ...), and where a page has an article or main
element what is likely to be.  All pages lie in order of host and path, across all borders of tasks; each is
paired with the NEAR pages of its host that are next to it, and all its lines are aligned with all lines of
each of these by longest common subsequence.  Lines shared with two of them, or with the only one there is,
are the site's and not the page's, and are deleted; inside an article or main element all of them have to share a line
(and two at least), as short lines are alike by chance.  One neighbour alone does not tell a site's lines from those of a copy; two do.  Two copies of a page next to it would still take its text away, so where deletion would leave
nothing of a page (or, inside an article or main element, where text is likely, the lesser part of its characters)
lines stay.  A title (h1) inside such an element always stays.

Pages of equal html on a host are one page here, so exact copies are never paired with each other.

Edge cases: null and empty pages give an empty text; tags cut off at the end are dropped; a null URL has no
host and is paired with no page; a page that is alone on its host keeps all that structure leaves; ties in path go by a
hash of the html; repeated rows get equal texts; very long pages are aligned in time that grows with their lines times
the places of equal lines, or by bits; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import bisect
import html as html_
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import lean, parted, settled

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements whose content is never text of the page.
NEVER = frozenset("head nav footer aside form script style noscript template iframe object svg math button select textarea menu dialog canvas audio video".split())
#: Words of class, id and role that mark the same.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav rail widget widgets footer masthead topbar toolbar comment comments commentlist disqus replies respond share sharing social related recommended recommendations teaser pagination pager skip search contentinfo complementary".split()
)
MARK = re.compile("[a-z0-9]+")
SPLIT = re.compile("(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")
#: Inside an article or main element lines stay if more than this share of its characters would go.
MOST_GOES = 0.5
#: Neighbours of a page, and how many of them must share a line that goes (or the only one there is); inside an article or main element, where lines are likely to be text, all of two or more.
NEAR, SUPPORT = 4, 2
#: Matching pairs of lines up to which an alignment goes by pairs; then by bits.
MOST_PAIRS = 200_000
#: Pages in a row that one task pairs, more than NEAR.
STRETCH = 1_000
SKETCH = "struct<lines:array<bigint>,sizes:array<int>,kinds:array<tinyint>,main:boolean>"
#: Kinds of lines: no text by structure, may be text, title.
NO_TEXT, TEXT, TITLE = 0, 1, 2


def marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether the attributes say that an element isn't text of the page."""
    if name in ("html", "body", "main"):
        return False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("aria-hidden") == "true" or re.search(r"\shidden(?=[\s=/]|$)", " " + attributes) or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    said = {w.lower() for key in ("class", "id", "role", "aria-label") if key in found for w in SPLIT.split(found[key])}
    if name == "article":
        return bool(said & {"comment", "comments", "teaser", "related", "ad", "advert"})
    if not inside and said & {"header"}:
        return True
    return bool(said & MARKS)


def blocks(page: str) -> tuple[list[tuple[str, bool, bool, bool]], bool]:
    """Blocks (text, whether inside article or main, whether mostly links, whether a title), and whether there is such an element."""
    out: list[tuple[str, bool, bool, bool]] = []
    pieces: list[str] = []
    stack: list[str] = []
    cut, home, found, linked, chars = 0, 0, False, 0, 0  # depths at which a dropped or a main element began

    def flush() -> None:
        nonlocal linked, chars
        if pieces:
            if text := " ".join("".join(pieces).split()):
                out.append((text, bool(home), 2 * linked > chars, "h1" in stack))
            pieces.clear()
        linked = chars = 0

    at, links = 0, 0
    while True:
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not cut:
            piece = page[at:end]
            if "&" in piece:
                piece = html_.unescape(piece)
            pieces.append(piece)
            chars += len(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS and not cut:
                flush()
            if name in stack:
                while stack:
                    top = stack.pop()
                    if top == "a" and not cut:
                        links = max(0, links - 1)
                    if len(stack) < cut:
                        cut = 0
                    if len(stack) < home:
                        home = 0
                    if top == name:
                        break
            continue
        if name in BLOCKS and not cut:
            flush()
        elif name in ("br", "td", "th") and not cut:
            pieces.append(" ")
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if m[3].endswith("/") and name in ("svg", "path", "iframe"):
            continue
        if name == "p" and stack and stack[-1] == "p":
            stack.pop()
        stack.append(name)
        if not cut:
            if name in NEVER or name == "header" and not home or m[3] and marked(name, m[3], bool(home)):
                cut = len(stack)
            elif name in ("article", "main") and not home:
                home, found = len(stack), True
            elif name == "a":
                links += 1
    if not cut:
        flush()
    return out, found


def kinds(found: list[tuple[str, bool, bool, bool]], main: bool) -> list[int]:
    """Of blocks, which may be text: with an article or main element those inside, else those that are not mostly links."""
    return [(TITLE if main and title else TEXT) if (home if main else not links) else NO_TEXT for _, home, links, title in found]


def parsed(pages: pa.Array) -> pa.Array:
    out = []
    for page in pages:
        found, main = blocks(page.as_py() or "")
        out.append("\n".join(text for (text, *_), kind in zip(found, kinds(found, main), strict=True) if kind))
    return pa.array(out, pa.string())


def sketched(pages: pa.Array) -> pa.Array:
    """Of each page: hashes, sizes and kinds of all its lines, and whether it has article or main."""
    number = xxhash.xxh3_64_intdigest
    rows = []
    for page in pages:
        found, main = blocks(page.as_py() or "")
        rows.append(([number(t) - (1 << 63) for t, *_ in found], [len(t) for t, *_ in found], kinds(found, main), main))
    types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.bool_()]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["lines", "sizes", "kinds", "main"])


def aligned(a: list, b: list) -> set[int]:
    """Positions of a on a longest common subsequence of a and b: the longest rising run of matching positions of b."""
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    if sum(len(places.get(line, ())) for line in a) > MOST_PAIRS:
        return by_bits(a, b)
    ends: list[int] = []
    tops: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, tops[k - 1] if k else None)
            if k == len(ends):
                ends.append(j), tops.append(link)
            else:
                ends[k], tops[k] = j, link
    out, at = set(), tops[-1] if tops else None
    while at:
        out.add(at[0])
        at = at[1]
    return out


def by_bits(a: list, b: list) -> set[int]:
    """The same where lines repeat so often that pairs would be too many: rows of the table of lengths as bits, 0 where a length rises."""
    masks: dict = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, table = full, []
    for line in a:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        table.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or table[i - 1] >> (j - 1) & 1:
            out.add(i)
            j -= 1
    return out


def goes(lines: list[int], sizes: list[int], kind: list[int], main: bool, near: list[list[int]]) -> list[int]:
    """Places among the lines that may be text of those that go, given the lines of the neighbours."""
    votes = [0] * len(lines)
    for other in near:
        for k in aligned(lines, other):
            votes[k] += 1
    need = max(2, len(near)) if main else max(1, min(SUPPORT, len(near)))
    text = [k for k, x in enumerate(kind) if x]
    gone = [k for k in text if kind[k] == TEXT and votes[k] >= need]
    if len(gone) == len(text) or main and sum(sizes[k] for k in gone) > MOST_GOES * sum(sizes[k] for k in text):
        return []
    place = {k: n for n, k in enumerate(text)}
    return [place[k] for k in gone]


def compared(lines: pa.Array, sizes: pa.Array, kind: pa.Array, main: pa.Array, near: pa.Array) -> pa.Array:
    return pa.array([goes(*row) for row in zip(*[x.to_pylist() for x in (lines, sizes, kind, main, near)], strict=True)], pa.list_(pa.int32()))


def in_order(pages: DataFrame) -> DataFrame:
    """pages (host, path, a, b ...) with place, their rank by host, path, a and b.  Ranges of the order are sorted apart; ranks follow from the sizes of the ranges before."""
    order = ["host", "path", "a", "b"]
    rows = settled(pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(heads), "range").withColumn("place", F.col("before") + (F.col("at") - F.shiftleft("range", 33))).drop("range", "at", "before")


def paired(pages: DataFrame) -> DataFrame:
    """pages (host, path, a, b, lines ...) with near: the lines of the NEAR pages that are next to each in order on its host, on both sides by turns.

    Stretches of the order go to one task each; pages next to a border are sent to both sides."""
    rows = in_order(pages).withColumn("own", F.floor(F.col("place") / STRETCH))
    also = F.array_distinct(F.array("own", F.floor((F.col("place") - NEAR) / STRETCH), F.floor((F.col("place") + NEAR) / STRETCH)))
    rows = rows.withColumn("stretch", F.explode(also))
    order = Window.partitionBy("stretch").orderBy("place")
    other = [f(F.struct("host", "lines"), k).over(order) for k in range(1, NEAR + 1) for f in (F.lag, F.lead)]
    near = F.transform(F.slice(F.filter(F.array(*other), lambda x: x["host"] == F.col("host")), 1, NEAR), lambda x: x["lines"])
    return rows.withColumn("near", near).filter("own = stretch").drop("own", "stretch", "place")


def extracted(df: DataFrame, page: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, url and text of every row of df."""
    ship(df.sparkSession)
    read, sketch, compare = F.arrow_udf(lean(parsed), "string"), F.arrow_udf(lean(sketched), SKETCH), F.arrow_udf(lean(compared), "array<int>")
    html = F.coalesce("html", F.lit(""))
    place = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:www\.|m\.)?([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    rows = rows.withColumns({"host": F.coalesce(place, F.lit("")), "a": F.xxhash64(html), "b": F.xxhash64(F.lit("b"), html)})
    # lines travel as hashes; texts are read again at the end
    pages = rows.filter("host <> ''").select("host", path.alias("path"), "a", "b", sketch(html).alias("x")).select("host", "path", "a", "b", "x.*").filter("size(lines) > 0")
    first = [F.first(c).alias(c) for c in ("lines", "sizes", "kinds", "main")]
    pages = settled(pages.groupBy("host", "a", "b").agg(F.min("path").alias("path"), *first))
    lost = paired(pages).filter("size(near) > 0").select(F.xxhash64("host", "a", "b").alias("found"), F.col("host").alias("h"), F.col("a").alias("c"), F.col("b").alias("d"), compare("lines", "sizes", "kinds", "main", "near").alias("lost"))
    lost = settled(lost.filter("size(lost) > 0"))
    some, rest = parted(rows.withColumn("wanted", F.xxhash64("host", "a", "b")), "wanted", lost, "found")
    some = some.select("page_id", "url", "host", "a", "b", read(html).alias("text"))
    some = some.join(lost, (F.col("host") == F.col("h")) & (F.col("a") == F.col("c")) & (F.col("b") == F.col("d")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("lost", k)), "\n")
    return some.select("page_id", "url", F.when(F.col("lost").isNull(), F.col("text")).otherwise(left).alias("text")).union(rest.select("page_id", "url", read(html).alias("text")))
