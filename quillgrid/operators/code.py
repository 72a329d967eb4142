"""Source files: their public names, where documents mention them, and the text in them that people read."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.dialect import compiled

# Definitions by language, names too common to follow, and which paths are no surface.
DEFINITIONS = {
    "js": [r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+([A-Za-z_$][\w$]*)", r"^\s*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)", r"^(?:async\s+)?function\*?\s+([A-Za-z_$][\w$]*)", r"^class\s+([A-Za-z_$][\w$]*)"],
    "py": [r"^(?:async\s+)?def\s+([A-Za-z_]\w*)", r"^class\s+([A-Za-z_]\w*)"],
    "go": [r"^func\s+(?:\([^)]*\)\s+)?([A-Za-z_]\w*)", r"^type\s+([A-Za-z_]\w*)"],
    "rs": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)"],
    "jvm": [r"^\s*(?:public|internal)?\s*(?:abstract\s+|final\s+|data\s+|sealed\s+)*(?:class|interface|enum|object)\s+([A-Za-z_]\w*)"],
}
FAMILIES = {"js": "js jsx mjs cjs ts tsx", "py": "py", "go": "go", "rs": "rs", "jvm": "java kt kts scala cs"}
BY_ENDING = {e: f for f, names in FAMILIES.items() for e in names.split()}
COMMON = frozenset("main test tests init setup index error errors data config value values result results name type types file files list item items node text line lines read write load save run build update check parse render start stop close open state".split())
DOCUMENTS = r"(?i)\.(md|mdx|mdc|markdown|txt|rst|adoc)\z"
LONGEST, APART, PARAGRAPH = 200, 6, 16
SURFACE = {
    r"\.(mjs|cjs|js|jsx|ts|tsx)$": [
        (r"^export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+([A-Za-z_$][\w$]*)[^\n]*", "function"),
        (r"^export\s+(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^\n]*", "const"),
        (r"^export\s*\{([^}]+)\}", "list"),
        (r"^(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=[^\n]*", "function"),
        (r"^export\s+(?:interface|type|enum)\s+([A-Za-z_$][\w$]*)[^\n]*", "type"),
    ],
    r"\.py$": [(r"^(?:async\s+)?def\s+([A-Za-z]\w*)\s*\([^\n]*", "function"), (r"^class\s+([A-Za-z]\w*)[^\n]*", "class")],
    r"\.go$": [(r"^func\s+(?:\([^)]*\)\s+)?([A-Z]\w*)\s*\([^\n]*", "function"), (r"^type\s+([A-Z]\w*)\s+[^\n]*", "type")],
    r"\.rs$": [(r"^\s*pub\s+(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|type|const|static|mod)\s+([A-Za-z_]\w*)[^\n]*", "item")],
}
NOT_SURFACE = r"(?i)(^|/)(tests?|__tests__|fixtures?|examples?|benchmarks?|scripts?|dist|build|vendor|vendored|3rdparty|third[-_]?party|node_modules|\.[^/]+)(/|\z)|(\.|_)(test|spec)\.[a-z]+\z|\.d\.ts\z|\.min\.js\z"
C_LIKE, HASH_LIKE = "mjs cjs js jsx ts tsx go rs java kt kts scala swift c h cc cpp hpp cs php".split(), "py rb sh bash zsh yaml yml toml r jl".split()
LICENSE = compiled(r"\blicen[sc]ed?\b|\bcopyright\b|\ball rights reserved\b|warranties or conditions|as is\b|spdx-license|apache\.org\/licenses|governing permissions", "i")


def ending(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def extent(lines: list[str], at: int, family: str) -> int:
    """Last line of the definition at line at: by indentation in Python, by braces elsewhere."""
    last = min(len(lines) - 1, at + LONGEST)
    if family == "py":
        depth = lambda s: len(s) - len(s.lstrip())
        end = at
        for k in range(at + 1, last + 1):
            if lines[k].strip():
                if depth(lines[k]) <= depth(lines[at]):
                    break
                end = k
        return end
    open_, begun = 0, False
    for k in range(at, last + 1):
        begun |= "{" in lines[k]
        open_ += lines[k].count("{") - lines[k].count("}")
        if begun and open_ <= 0:
            return k
        if not begun and k >= at + 2:
            break
    return last if begun else min(at + (0 if lines[at].rstrip().endswith(";") else 12), len(lines) - 1)


def symbols_of(path: str, text: str) -> list[tuple[str, int, int]]:
    """(name, line, last line) of the definitions worth following, each name once."""
    family = BY_ENDING.get(ending(path))
    lines, seen, out = text.split("\n"), set(), []
    for k, line in enumerate(lines if family else ()):
        m = next((m for p in DEFINITIONS[family] if (m := compiled(p).search(line))), None)
        if m and len(m[1]) >= 4 and m[1].lower() not in COMMON and m[1] not in seen:
            seen.add(m[1])
            out.append((m[1], k + 1, extent(lines, k, family) + 1))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """path, name, start, end of the definitions in files (path, text)."""
    ship(files.sparkSession)

    @F.arrow_udf("array<struct<name:string,start:int,end:int>>")
    def run(paths: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [[{"name": n, "start": a, "end": b} for n, a, b in symbols_of(p or "", t or "")] for p, t in zip(paths.to_pylist(), texts.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return files.filter(~F.col("path").rlike(DOCUMENTS)).select("path", F.inline(run("path", "text")))


def proposals(files: DataFrame) -> DataFrame:
    """Edges from a definition to the paragraphs of documents that mention it.

    Names defined in one file only are joined by equality with the words of documents' lines; mentions at most
    APART lines from the last are one (a sum over lag), and grow to their paragraph."""
    defs = symbols(files)
    single = defs.groupBy("name").agg(F.count("*").alias("n"), F.first("path").alias("src_file"), F.first("start").alias("src_start"), F.first("end").alias("src_end")).filter("n = 1").drop("n")
    docs = files.filter(F.col("path").rlike(DOCUMENTS)).select(F.col("path").alias("doc"), F.split("text", "\n", -1).alias("all"))
    lines = docs.select("doc", F.posexplode("all").alias("k", "line"))
    words = lines.select("doc", (F.col("k") + 1).alias("at"), "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    met = words.join(single, "name").filter("doc <> src_file")
    quoted = F.concat(F.lit(r"\Q"), "name", F.lit(r"\E"))
    edge, open_ = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
    marked = F.expr(f"line rlike concat('`[^`]*{open_}', q, '{edge}[^`]*`|{open_}', q, '\\\\s*\\\\(')")
    plain = F.col("name").rlike(r"^[a-z]+\z") & (F.length("name") < 8)
    met = met.withColumn("q", quoted).withColumn("score", F.when(marked, 0.95).when(~plain, 0.75)).filter("score IS NOT NULL")
    order = Window.partitionBy("doc", "name").orderBy("at")
    met = met.withColumn("new", (F.col("at") - F.lag("at").over(order) > APART).cast("int")).withColumn("group", F.sum(F.coalesce("new", F.lit(1))).over(order))
    found = met.groupBy("doc", "name", "group", "src_file", "src_start", "src_end").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.max("score").alias("score"))
    blank = lambda x: F.trim(x) == ""
    gaps = docs.select("doc", F.size("all").alias("n"), F.filter(F.transform("all", lambda x, k: F.when(blank(x), k + 1)), lambda k: k.isNotNull()).alias("gaps"))
    rows = found.join(gaps, "doc")
    start = F.coalesce(F.array_max(F.filter("gaps", lambda g: g < F.col("a"))) + 1, F.lit(1))
    # from a blank last line the paragraph ends where it is
    end = F.coalesce(F.array_min(F.filter("gaps", lambda g: g >= F.col("b"))), F.col("n"))
    end = F.when(F.array_contains("gaps", F.col("b") + 1), F.col("b") + 1).otherwise(F.least(end, F.col("n")))
    rows = rows.withColumns({"s": start, "e": end})
    wide = F.col("e") - F.col("s") > PARAGRAPH
    return rows.select(
        "src_file", "src_start", "src_end", F.col("doc").alias("dst_file"), F.when(wide, F.col("a")).otherwise(F.col("s")).cast("int").alias("dst_start"), F.when(wide, F.least(F.col("b") + 1, F.col("n"))).otherwise(F.col("e")).cast("int").alias("dst_end"),
        F.col("name").alias("src_symbol"), F.col("name").alias("dst_symbol"), F.lit("documents").alias("rel"), "score", F.lit("symbol").alias("via"), F.xxhash64("name", "doc", "a").alias("seq"),
    )


def exported(names: str) -> list[str]:
    """Names of an export list, as they are known outside."""
    return [x.split(" as ")[-1].strip() for x in (" ".join(part.split()) for part in names.split(",")) if x]


def shown(match: str) -> str:
    """A signature on one line, without what opens its body."""
    line = " ".join(match.split())
    for opener in ("{", "=>", "="):
        line = line.removesuffix(opener).rstrip()
    return line


def surface_of(path: str, text: str) -> list[tuple[str, str, str, int]]:
    """(name, kind, signature, line) of what a file offers, in order of lines; of equal names the first pattern's."""
    patterns = next((found for name, found in SURFACE.items() if re.search(name, path, re.I)), [])
    first: dict[str, tuple[str, str, str, int]] = {}
    for pattern, kind in patterns:
        for m in compiled(pattern, "gm").finditer(text):
            line = text.count("\n", 0, m.start()) + 1
            offered = [(n, "export", f"export {n}") for n in exported(m[1])] if kind == "list" else [(m[1], kind, shown(m[0]))]
            for name, what, signature in offered:
                if name and name[0] != "_":
                    first.setdefault(name, (name, what, signature, line))
    return sorted(first.values(), key=lambda x: x[3])


def surface(files: DataFrame, folder: str = "") -> DataFrame:
    """path, name, kind, signature, line of the public names of files (path, text), tests and builds left out."""
    ship(files.sparkSession)

    @F.arrow_udf("array<struct<name:string,kind:string,signature:string,line:int>>")
    def run(paths: pa.Array, texts: pa.Array) -> pa.Array:
        kind = pa.struct([("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("line", pa.int32())])
        return pa.array([[dict(zip(kind.names, x, strict=True)) for x in surface_of(p or "", t or "")] for p, t in zip(paths.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(kind))

    rows = files.filter(~F.col("path").rlike(NOT_SURFACE))
    rows = rows.filter(F.col("path").startswith(folder.rstrip("/") + "/")) if folder else rows
    return rows.select("path", F.inline(run("path", "text")))


#: Characters of a chunk, of a signature in it, and what a file's heading takes.
CHUNK, SIGNATURE, HEADING = 8000, 160, 12


def _packed(most: int):
    def run(table: pa.Table) -> pa.Table:
        """Numbers the files of a folder (in order of path) by chunk: a new one begins where the next file would not fit."""
        rows = sorted(zip(table["folder"].to_pylist(), table["path"].to_pylist(), table["cost"].to_pylist(), strict=True))
        out, chunk, size = [], 0, 0
        for folder, path, cost in rows:
            if size and size + cost > most:
                chunk, size = chunk + 1, 0
            size += cost
            out.append({"folder": folder, "path": path, "chunk": chunk})
        return pa.Table.from_pylist(out, pa.schema([("folder", pa.string()), ("path", pa.string()), ("chunk", pa.int32())]))

    return run


def rendered(items: DataFrame, most: int = CHUNK) -> DataFrame:
    """folder, chunk, path, first, text, items of surface items (path, name, signature, line).

    Files of a top folder are gathered, in order of path, in chunks of at most so many characters, none cut; a larger file is a chunk of
    its own, and folders are independent.  first is the line of the chunk that a file's heading has, text its part of the chunk, and
    items its (name, line) in the order of the lines below the heading."""
    row = F.struct("line", "name", F.substring("signature", 1, SIGNATURE).alias("s"))
    per = items.groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("all")).withColumn("folder", F.regexp_extract("path", "^(?:([^/]*)/)?", 1))
    cost = F.length("path") + HEADING + F.aggregate("all", F.lit(0), lambda n, x: n + F.length(x["s"]) + 1)
    placed = per.select("folder", "path", cost.alias("cost")).groupBy("folder").applyInArrow(_packed(most), "folder string, path string, chunk int")
    text = F.concat(F.lit("// === "), "path", F.lit(" ===\n"), F.array_join(F.transform("all", lambda x: x["s"]), "\n"))
    out = per.join(placed, ["folder", "path"]).select("folder", "chunk", "path", text.alias("text"), F.transform("all", lambda x: F.struct(x["name"], x["line"])).alias("items"))
    # blocks of a chunk stand one empty line apart
    before = Window.partitionBy("folder", "chunk").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("first", F.coalesce(F.sum(F.size("items") + 2).over(before), F.lit(0)) + 1)


def chunk_texts(rows: DataFrame) -> DataFrame:
    """folder, chunk, text, map of what rendered() gives: the whole text of each chunk, and for each of its lines the item that it shows (null: none)."""
    part = F.struct("first", "path", "text", "items")
    per = rows.groupBy("folder", "chunk").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    none = F.lit(None).cast("struct<path:string,name:string,line:int>")
    of = lambda p: F.concat(F.array(none), F.transform(p["items"], lambda i: F.struct(p["path"].alias("path"), i["name"].alias("name"), i["line"].cast("int").alias("line"))), F.array(none))
    return per.select("folder", "chunk", F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"), F.lit("\n")).alias("text"), F.flatten(F.transform("parts", of)).alias("map"))


def items_of_span(text: str, lines: list[dict | None], span: str) -> list[dict]:
    """The items of a chunk's text that a span of it covers.  The span's first 16 words are looked for in order, with up to 16 other characters between two."""
    words = compiled(r"^/[\s\S]*?===\s*").sub("", span).split()[:16]
    m = re.search(r"[\s\S]{0,16}?".join(map(re.escape, words)), text) if words else None
    if m is None:
        return []
    touched = lines[text.count("\n", 0, m.start()) : text.count("\n", 0, m.end()) + 1]
    found: dict[tuple, dict] = {}
    for item in filter(None, touched):
        found.setdefault((item["path"], item["name"]), item)
    return list(found.values())


def unexplained(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """path, name, line, score of items of chunks (folder, chunk, text, map) that flags (folder, chunk, text, score) of a scan of the documents name as hardly attended to: the least score of each, least first."""
    ship(chunks.sparkSession)
    item = pa.struct([("path", pa.string()), ("name", pa.string()), ("line", pa.int32())])

    @F.arrow_udf("array<struct<path:string,name:string,line:int>>")
    def run(texts: pa.Array, maps: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([items_of_span(*x) for x in zip(texts.to_pylist(), maps.to_pylist(), spans.to_pylist(), strict=True)], pa.list_(item))

    met = flags.select("folder", "chunk", F.col("text").alias("span"), "score").join(chunks, ["folder", "chunk"])
    rows = met.select("score", F.explode(run("text", "map", "span")).alias("i")).select("i.*", "score")
    return rows.groupBy("path", "name", "line").agg(F.min("score").alias("score")).orderBy("score", "path", "name")


#: Pages that do not describe an interface, and those that come first.
# Fixed values.
NOT_API_PAGE = r"(?i)(^|/)(_sidebar|_navbar|_coverpage|SUMMARY|CHANGELOG|CODE_OF_CONDUCT|LICENSE|GOVERNANCE|PRODUCT|STYLE|FACTS)\.(md|mdx|markdown)\z|(^|/)(blog|news|_posts|vendor|vendored|3rdparty|third[-_]?party)/|\.api\.mdx\z"
PAGE = r"(?i)\.(md|mdx|markdown)\z"


def api_pages(pages: DataFrame) -> DataFrame:
    """The pages (path, text) that should describe an interface, those of the documentation folder first, then the readme."""
    rank = F.when(F.col("path").rlike("(?i)^docs?/"), 0).when(F.col("path").rlike(r"(?i)^readme\."), 1).otherwise(2)
    return pages.filter(F.col("path").rlike(PAGE) & ~F.col("path").rlike(NOT_API_PAGE)).orderBy(rank, "path")


BEFORE_PATTERN = frozenset("(=:,[!&|?{};+-*%<>~^\n")
KEYWORD = compiled(r"(?:^|[^A-Za-z0-9_$.])(return|typeof|case|in|of|instanceof|new|delete|void|do|else|yield|await)$")


def _string_end(text: str, at: int, quote: str, many: bool, escapes: bool = True) -> int:
    """Place of the closing quote, or where the string breaks off."""
    k = at
    while k < len(text):
        if escapes and text[k] == "\\":
            k += 2
        elif text.startswith(quote, k) or text[k] == "\n" and not many:
            return k
        else:
            k += 1
    return len(text)


def pieces(text: str, kind: str) -> list[tuple[str, int, int, int]]:
    """(what, start, body start, end) of comments, strings and patterns of a source text."""
    line = {"js": "//", "c": "//", "py": "#", "hash": "#", "sql": "--", "lua": "--"}[kind]
    block = {"js": ("/*", "*/"), "c": ("/*", "*/"), "sql": ("/*", "*/"), "lua": ("--[[", "]]")}.get(kind)
    quotes = "\"'`" if kind in ("js", "c") else "\"'"
    triples = ('"""', "'''") if kind in ("py", "hash") else ()
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if block and text.startswith(block[0], k):
            end = text.find(block[1], k + len(block[0]))
            end = len(text) if end < 0 else end
            out.append(("comment", k, k + len(block[0]), end))
            k = end + len(block[1])
        elif text.startswith(line, k):
            end = text.find("\n", k)
            end = len(text) if end < 0 else end
            out.append(("comment", k, k + len(line), end))
            k = end
        elif t := next((t for t in triples if text.startswith(t, k)), None):
            end = text.find(t, k + 3)
            end = len(text) if end < 0 else end
            out.append(("string", k, k + 3, end))
            k = end + 3
        elif kind == "js" and c == "/" and _pattern_may_start(text, k):
            k = _pattern_end(text, k)
        elif c in quotes:
            end = _string_end(text, k + 1, c, c == "`", kind != "sql")
            out.append(("string", k, k + 1, end))
            k = end + 1 if end < len(text) and text[end] == c else end
        else:
            k += 1
    return out


def _pattern_may_start(text: str, at: int) -> bool:
    before = text[:at].rstrip(" \t") if at < 200 else text[at - 200 : at].rstrip(" \t")
    return not before or before[-1] in BEFORE_PATTERN or bool(KEYWORD.search(before[-13:]))


def _pattern_end(text: str, at: int) -> int:
    k, inside = at + 1, False
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        if c == "\n":
            return k
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "/":
            return k + 1 + len(re.match("[A-Za-z]*", text[k + 1 :])[0])
        k += 1
    return k


def human_text(text: str, kind: str) -> str:
    """Strings and comments in place, all else blanked; license comments go, and each piece starts after a full stop."""
    out = ["\n" if c == "\n" else " " for c in text]
    for what, start, body, end in pieces(text, kind):
        out[start] = "."
        if what == "string" or not LICENSE.search(text[body:end]):
            out[body:end] = text[body:end]
    return "".join(out)


def without_comments(text: str, path: str) -> str:
    """Comments blanked, lengths and lines kept."""
    e = ending(path)
    kind = "c" if e in C_LIKE else "hash" if e in HASH_LIKE else e if e in ("sql", "lua") else None
    out = list(text)
    for what, start, _, end in pieces(text, kind) if kind else ():
        if what == "comment":
            stop = min(len(text), end + (2 if text[start : start + 2] in ("/*", "--") and text[end : end + 2] in ("*/", "]]") else 0))
            out[start:stop] = re.sub("[^\n]", " ", text[start:stop])
    return "".join(out)


def uncommented(files: DataFrame) -> DataFrame:
    """path, text of source files with their comments blanked, lengths and lines kept."""
    ship(files.sparkSession)

    @F.arrow_udf("string")
    def run(paths: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([without_comments(t or "", p or "") for p, t in zip(paths.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return files.select("path", run("path", "text").alias("text"))


def readable(files: DataFrame) -> DataFrame:
    """path, text of source files of known languages with only their strings and comments, for the detector."""
    ship(files.sparkSession)

    @F.arrow_udf("string")
    def run(paths: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([human_text(t or "", BY_ENDING[ending(p)]) for p, t in zip(paths.to_pylist(), texts.to_pylist(), strict=True)])

    return files.filter(F.col("path").rlike(r"(?i)\.(js|jsx|ts|tsx|mjs|cjs|py)\z")).select("path", run("path", "text").alias("text"))


# Paths that suggest a rule, and what it says.
EXCLUDED = ["**/*.test.*", "**/*.spec.*", "**/*_test.*", "**/*.snap"]
COUPLINGS = (
    ("api-docs", r"(?i)(^|/)(api|controllers?|routes|handlers|endpoints|resolvers)\z", r"(?i)(^|/)(openapi|swagger)[^/]*\.(ya?ml|json)\z|\.proto\z", "The API changed: update its reference"),
    ("schema-docs", r"(?i)(^|/)(migrations?|migrate)\z", r"(?i)(^|/)schema\.sql\z|\.prisma\z", "The schema changed: update the data model pages"),
    ("cli-docs", r"(?i)(^|/)(commands?|cli|bin)\z", r"^\z", "A command changed: update its usage page"),
    ("config-docs", r"(?i)(^|/)configs?\z", r"(?i)(^|/)\.env\.(example|sample)\z", "A setting changed: update the configuration page"),
)


def discovered(paths: DataFrame, deepest: int | None = 5) -> DataFrame:
    """name, paths, notify: edit rules that the tree paths (path) suggests, at most 6 folders and 4 files each, by name; folders below a depth are not looked into (None: all are)."""
    parts, most = F.split("path", "/"), F.lit(1 << 20 if deepest is None else deepest + 1)
    folders = paths.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.least(most, F.greatest(F.lit(1), F.size(parts) - 1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))).select(F.col("col").alias("path"), F.lit(True).alias("folder"))
    tree = folders.union(paths.filter(F.size(parts) <= most).select("path", F.lit(False))).distinct()

    def kind(folder: str, file: str) -> Column:
        return F.when(F.col("folder"), F.col("path").rlike(folder)).otherwise(F.col("path").rlike(file))

    rows = tree.select("path", "folder", F.explode(F.array(*[F.when(kind(a, b), F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(say).alias("notify"))) for k, (n, a, b, say) in enumerate(COUPLINGS)])).alias("r")).filter("r IS NOT NULL")
    take = lambda yes, n: F.slice(F.sort_array(F.collect_set(F.when(F.col("folder") == yes, F.concat("path", F.lit("/**")) if yes else F.col("path")))), 1, n)
    found = rows.groupBy("r.k", "r.name", "r.notify").agg(F.concat(take(True, 6), take(False, 4)).alias("paths"))
    packages = folders.filter(F.col("path").rlike(r"^(packages|apps|libs)/[^/]+\z")).distinct()
    roots = packages.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.concat(F.regexp_extract("path", "^([^/]*)", 1), F.lit("/*/src/**")))).alias("paths")).filter("n >= 2")
    mono = roots.select(F.lit(len(COUPLINGS)).alias("k"), F.lit("package-readme").alias("name"), F.lit("A package changed: update its README").alias("notify"), "paths")
    return found.unionByName(mono).orderBy("k").select("name", "paths", "notify")
