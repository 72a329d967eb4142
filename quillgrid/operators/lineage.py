"""A curated graph of spans that belong together, kept as a table: proposals, curation, and what an edit breaks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.functions.text import span_hash
from quillgrid.plans.session import accumulated

# The columns, relations and states of edges, and how much text one keeps.
RELATIONS = ("documents", "implements", "describes", "duplicates", "derives-from", "related")
STATUSES = ("proposed", "confirmed", "rejected")
KEPT = 1200
#: Lines of a cell in which overlaps are looked for.
CELL = 50
SIDES = ("src", "dst")
SCHEMA = (
    "id int, src_file string, src_start int, src_end int, dst_file string, dst_start int, dst_end int, src_symbol string, dst_symbol string, rel string, score double, via string, status string, note string, curated_by string, src_hash string, dst_hash string, src_text string, dst_text string, created_at timestamp, updated_at timestamp"
)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def span_text(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text; null if it has no line start."""
    lines = F.split(text, "\n", -1)
    return F.when(start <= F.size(lines), F.array_join(F.slice(lines, start, F.greatest(F.lit(0), F.least(end, F.size(lines)) - start + 1)), "\n"))


def with_spans(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges with src_now and dst_now (text of the spans today) and src_there, dst_there (the files' texts)."""
    for side in SIDES:
        there = files.select(F.col("path").alias(f"{side}_file"), F.col("text").alias(f"{side}_there"))
        edges = edges.join(there, f"{side}_file", "left").withColumn(f"{side}_now", span_text(F.col(f"{side}_there"), F.col(f"{side}_start"), F.col(f"{side}_end")))
    return edges


def _first_ones(table: pa.Table) -> pa.Table:
    """Proposals of one pair of files, in order, without those that overlap an edge or an earlier proposal on both sides, of the same symbol.

    Kept spans lie in the cells of a grid of lines by symbol, so that a proposal meets only those near it."""
    rows = sorted(table.to_pylist(), key=lambda r: (not r["old"], r["seq"]))
    grid: dict[tuple, list[dict]] = {}
    out = []
    meet = lambda a, b, s: a[s + "_start"] <= b[s + "_end"] and b[s + "_start"] <= a[s + "_end"]
    for r in rows:
        cells = [(r["src_symbol"], c) for c in range(r["src_start"] // CELL, r["src_end"] // CELL + 1)]
        if not r["old"]:
            if any(meet(k, r, "src") and meet(k, r, "dst") for cell in cells for k in grid.get(cell, ())):
                continue
            out.append({"seq": r["seq"]})
        for cell in cells:
            grid.setdefault(cell, []).append(r)
    return pa.Table.from_pylist(out, pa.schema([("seq", pa.int64())]))


def proposed(edges: DataFrame, proposals: DataFrame, files: DataFrame) -> DataFrame:
    """edges and what proposals (src_file, src_start, src_end, dst_*, src_symbol, dst_symbol, rel, score, via, seq) add: pairs that no edge of any status knows, in either direction.

    Proposals of a pair of files are looked at in order, as each may stand in the way of later ones; pairs are independent."""
    ship(edges.sparkSession)
    swap = F.col("src_file") > F.col("dst_file")
    ends = {f"{a}_{c}": F.when(swap, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")) for a, b in (("src", "dst"), ("dst", "src")) for c in ("file", "start", "end")}
    pick = lambda df, old: df.select(*[c.alias(n) for n, c in ends.items()], "src_symbol", F.col("seq").cast("long").alias("seq"), F.lit(old).alias("old"))
    live = with_spans(proposals, files).filter("src_now IS NOT NULL AND dst_now IS NOT NULL")
    both = pick(edges.withColumn("seq", F.col("id")), True).union(pick(live, False))
    new = live.join(both.groupBy("src_file", "dst_file").applyInArrow(_first_ones, "seq long"), "seq")
    made = new.withColumns({"status": F.lit("proposed"), "rel": F.coalesce("rel", F.lit("related")), "via": F.coalesce("via", F.lit("manual"))})
    return appended(edges, made, [F.col("seq")])


def appended(edges: DataFrame, made: DataFrame, order: list[Column]) -> DataFrame:
    """edges and the rows of made, numbered on in an order, with hash and text of their spans as they are now (src_now, dst_now)."""
    top = edges.agg(F.max("id")).first()[0] or 0
    made = accumulated(made, order, __before=F.lit(1))
    made = made.withColumn("id", F.col("__before") + (top + 1))
    for side in SIDES:
        made = made.withColumns({f"{side}_hash": span_hash(F.col(f"{side}_now")), f"{side}_text": F.substring(f"{side}_now", 1, KEPT)})
    return edges.unionByName(made.select(*[made[c].cast(t) if c in made.columns else _default(c).cast(t).alias(c) for c, t in edges.dtypes]))


def _default(name: str) -> Column:
    return F.current_timestamp() if name.endswith("_at") else F.lit(None)


def from_associations(assoc: DataFrame, least: float = 0.0) -> DataFrame:
    rows = assoc.filter(F.col("score") >= least)
    return rows.select(
        F.col("a.path").alias("src_file"), F.col("a.start").alias("src_start"), F.col("a.end").alias("src_end"), F.col("b.path").alias("dst_file"), F.col("b.start").alias("dst_start"), F.col("b.end").alias("dst_end"),
        F.lit(None).cast("string").alias("src_symbol"), F.lit(None).cast("string").alias("dst_symbol"), F.lit("related").alias("rel"), "score", "via", F.xxhash64("a", "b").alias("seq"),
    )


def all_proposals(symbols: DataFrame, assoc: DataFrame, least: float = 0.0) -> DataFrame:
    """Proposals by symbols and by associations, those by symbols first in seq."""
    first = lambda df, k: df.withColumn("seq", F.shiftrightunsigned("seq", 2) + F.lit(k << 62))
    return first(symbols, 0).unionByName(first(from_associations(assoc, least), 1), allowMissingColumns=True)


def listed(edges: DataFrame, status: str | None = None, file: str | None = None, most: int | None = None) -> DataFrame:
    """Proposed ones first, then by score."""
    out = edges if status is None else edges.filter(F.col("status") == status)
    out = out if file is None else out.filter((F.col("src_file") == file) | (F.col("dst_file") == file))
    out = out.orderBy((F.col("status") == "proposed").desc(), F.col("score").desc_nulls_last(), "id")
    return out.limit(most) if most else out


def curated(edges: DataFrame, decisions: DataFrame, files: DataFrame) -> DataFrame:
    """edges after decisions (id, status, rel, note, by); a confirmed edge takes hash and text of its spans as they are now."""
    d = decisions.select(F.col("id").alias("of"), *[F.col(c).alias(f"new_{c}") for c in ("status", "rel", "note", "by")])
    rows = with_spans(edges, files).join(d, F.col("id") == F.col("of"), "left")
    confirmed = F.col("new_status") == "confirmed"
    changed = {"status": F.coalesce("new_status", "status"), "rel": F.coalesce("new_rel", "rel"), "note": F.coalesce("new_note", "note"), "curated_by": F.coalesce("new_by", "curated_by"), "updated_at": F.when(F.col("of").isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at"))}
    for side in SIDES:
        fresh = confirmed & F.col(f"{side}_now").isNotNull()
        changed |= {f"{side}_hash": F.when(fresh, span_hash(F.col(f"{side}_now"))).otherwise(F.col(f"{side}_hash")), f"{side}_text": F.when(fresh, F.substring(f"{side}_now", 1, KEPT)).otherwise(F.col(f"{side}_text"))}
    return rows.withColumns(changed).select(*edges.columns)


def linked(edges: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """edges and links (src_file, src_start, src_end, dst_*, rel, note, by) that a curator states: confirmed at once."""
    rows = with_spans(links, files).filter("src_now IS NOT NULL AND dst_now IS NOT NULL")
    made = rows.withColumns({"status": F.lit("confirmed"), "via": F.lit("manual"), "curated_by": F.col("by"), "rel": F.coalesce("rel", F.lit("related"))})
    return appended(edges, made, [F.col(c) for c in ("src_file", "src_start", "dst_file", "dst_start")])


def moved_to(text: Column, start: Column, end: Column, hash_: Column) -> Column:
    """First line of the first window of as many lines whose hash is the stored one; null if none is."""
    lines = F.split(text, "\n", -1)
    n = end - start + 1
    starts = F.when((n > 0) & (n <= F.size(lines)), F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(lines) - n + 1)))
    return F.get(F.filter(starts, lambda s: span_hash(F.array_join(F.slice(lines, s, n), "\n")) == hash_), F.lit(0))


def sides(edges: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each side of each confirmed edge: edge, side, file, span, counterpart, and where it stands now."""
    rows = with_spans(edges.filter("status = 'confirmed'"), files)
    out = None
    for side, other in (("src", "dst"), ("dst", "src")):
        c = lambda name, s=side: F.col(f"{s}_{name}")
        same = c("now").isNotNull() & (span_hash(c("now")) == c("hash"))
        at = F.when(~F.coalesce(same, F.lit(False)), moved_to(c("there"), c("start"), c("end"), c("hash")))
        state = F.when(same, "same").when(at.isNotNull(), "moved").when(c("there").isNull(), "missing").otherwise("impact")
        part = rows.select(
            F.col("id").alias("edge"), F.lit(side).alias("side"), c("file").alias("file"), c("start").alias("start"), c("end").alias("end"), F.col("rel"), F.col("note"),
            F.col(f"{other}_file").alias("other_file"), F.col(f"{other}_start").alias("other_start"), F.col(f"{other}_end").alias("other_end"), F.col(f"{other}_text").alias("other_text"), state.alias("state"), at.alias("at"),
        )
        out = part if out is None else out.union(part)
    return out


def impact(edges: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Sides in the changed files (path) whose span is not what was confirmed: moved, missing, or changed (impact).  Edges are found by two joins on keys, not one with OR."""
    near = edges.join(changed.select(F.col("path").alias("src_file")), "src_file", "left_semi").unionByName(edges.join(changed.select(F.col("path").alias("dst_file")), "dst_file", "left_semi")).dropDuplicates(["id"])
    return sides(near.select(*edges.columns), files).join(changed.select(F.col("path").alias("file")), "file", "left_semi").filter("state <> 'same'")


def stamped(edges: DataFrame, files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """edges with confirmed ones (of the changed files, or all) moved to where their spans are and hashed anew; those with a side gone stay as they are."""
    rows = with_spans(edges, files)
    for side in SIDES:
        c = lambda name, s=side: F.col(f"{s}_{name}")
        at = F.when(~F.coalesce(span_hash(c("now")) == c("hash"), F.lit(False)), moved_to(c("there"), c("start"), c("end"), c("hash")))
        rows = rows.withColumn(f"{side}_at", F.coalesce(at, c("start"))).withColumn(f"{side}_new", span_text(c("there"), F.col(f"{side}_at"), F.col(f"{side}_at") + c("end") - c("start")))
    due = (F.col("status") == "confirmed") & F.col("src_new").isNotNull() & F.col("dst_new").isNotNull()
    if changed is not None:
        touched = edges.join(changed.select(F.col("path").alias("src_file")), "src_file", "left_semi").select("id").union(edges.join(changed.select(F.col("path").alias("dst_file")), "dst_file", "left_semi").select("id")).distinct()
        rows = rows.join(touched.select(F.col("id").alias("t")), F.col("id") == F.col("t"), "left")
        due &= F.col("t").isNotNull()
    out = {"updated_at": F.when(due, F.current_timestamp()).otherwise(F.col("updated_at"))}
    for side in SIDES:
        at = F.col(f"{side}_at")
        new = {"start": at, "end": at + F.col(f"{side}_end") - F.col(f"{side}_start"), "hash": span_hash(F.col(f"{side}_new")), "text": F.substring(f"{side}_new", 1, KEPT)}
        out |= {f"{side}_{name}": F.when(due, value).otherwise(F.col(f"{side}_{name}")) for name, value in new.items()}
    return rows.withColumns(out).select(*edges.columns)


def respanned(edges: DataFrame, narrower: DataFrame, files: DataFrame) -> DataFrame:
    """edges with the spans of narrower (id, src_start, src_end, dst_start, dst_end; null: as before), hashed anew where the lines exist."""
    n = narrower.select(F.col("id").alias("of"), *[F.col(f"{s}_{c}").alias(f"new_{s}_{c}") for s in SIDES for c in ("start", "end")])
    rows = edges.join(n, F.col("id") == F.col("of"), "left")
    for s in SIDES:
        rows = rows.withColumns({f"{s}_from": F.coalesce(f"new_{s}_start", f"{s}_start"), f"{s}_to": F.coalesce(f"new_{s}_end", f"{s}_end")})
        rows = rows.join(files.select(F.col("path").alias(f"{s}_file"), F.col("text").alias(f"{s}_there")), f"{s}_file", "left").withColumn(f"{s}_new", F.when(F.col(f"new_{s}_start").isNotNull(), span_text(F.col(f"{s}_there"), F.col(f"{s}_from"), F.col(f"{s}_to"))))
        ok = F.col(f"{s}_new").isNotNull()
        new = {"start": F.col(f"{s}_from"), "end": F.col(f"{s}_to"), "hash": span_hash(F.col(f"{s}_new")), "text": F.substring(f"{s}_new", 1, KEPT)}
        rows = rows.withColumns({f"{s}_{c}": F.when(ok, v).otherwise(F.col(f"{s}_{c}")) for c, v in new.items()})
    return rows.select(*edges.columns)


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("status", "via").agg(F.count("*").alias("n")).orderBy("status", "via")
