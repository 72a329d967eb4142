"""Edit events as a stream: every payload becomes rows of notices; nothing is kept between events, so no state or watermark is needed.

A payload that cannot be read gives no notice and never stops the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.config import edit_rules
from quillgrid.operators.detect import Settings, findings_udf, rank

# Tools that edit, endings that are prose, and the floor of what is said after an edit.
TOOLS = ("Edit", "Write", "MultiEdit")
PROSE = r"(?i)\.(md|mdx|mdc|markdown)\z"
PAYLOAD = "struct<tool_name:string,file_path:string,path:string,file:string,cwd:string,tool_input:struct<file_path:string,path:string,content:string,new_string:string,new_text:string,edits:array<struct<new_string:string,new_text:string>>>>"
FLOOR, MOST = "warn", 10


def read(payload: Column) -> Column:
    return F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE"})


def edited(p: Column) -> Column:
    """Path of an edit, whatever the payload's shape; null if a tool is named that does not edit."""
    tool = p["tool_name"]
    return F.when(tool.isNull() | tool.isin(*TOOLS), F.coalesce(p["tool_input"]["file_path"], p["tool_input"]["path"], p["file_path"], p["path"], p["file"]))


def fragments(p: Column) -> Column:
    """Proposed texts, each looked at alone: the whole content, one new text, or one per edit."""
    t = p["tool_input"]
    one = F.coalesce(t["new_string"], t["new_text"])
    edits = F.transform(t["edits"], lambda e: F.coalesce(e["new_string"], e["new_text"], F.lit("")))
    return F.when(t["content"].isNotNull(), F.array(t["content"])).when(one.isNotNull(), F.array(one)).otherwise(F.coalesce(edits, F.array().cast("array<string>")))


def parsed(events: DataFrame, payload: str = "value") -> DataFrame:
    """events with p, file, whole (the payload has the whole file) and fragments."""
    rows = events.withColumn("p", read(F.col(payload)))
    return rows.withColumns({"file": edited(F.col("p")), "whole": F.col("p.tool_input.content").isNotNull(), "fragments": fragments(F.col("p"))})


def lints(events: DataFrame, settings: Settings = Settings(), floor: str = FLOOR, payload: str = "value") -> DataFrame:
    """A row for each finding of at least the floor in the fragments of prose files, with its place in the edit."""
    rows = parsed(events, payload).filter(F.col("file").rlike(PROSE))
    each = rows.select(*events.columns, "file", "whole", F.posexplode("fragments").alias("fragment", "text"))
    find = findings_udf(settings)
    out = each.select(*events.columns, "file", "whole", "fragment", F.inline(find("text"))).filter(rank(F.col("severity")) <= rank(F.lit(floor)))
    label = F.when(F.col("whole"), F.concat(F.lit("L"), "line")).otherwise(F.concat(F.lit("edit #"), F.col("fragment") + 1, F.lit(" L"), "line"))
    return out.withColumn("label", label)


def gated(events: DataFrame, settings: Settings = Settings(), payload: str = "value") -> DataFrame:
    """events with file, errors and decision: deny if any fragment of a prose file has an error, else allow.  The findings stay an array, so nothing is shuffled."""
    rows = parsed(events, payload)
    find = findings_udf(settings)
    joined = find(F.coalesce(F.array_join("fragments", "\n\n"), F.lit("")))
    errors = F.when(F.col("file").rlike(PROSE), F.size(F.filter(joined, lambda f: f["severity"] == "error"))).otherwise(0)
    return rows.select(*events.columns, "file", F.coalesce(errors, F.lit(0)).alias("errors")).withColumn("decision", F.when(F.col("errors") > 0, "deny").otherwise("allow"))


def notices(events: DataFrame, rules: list[dict], translations: DataFrame | None = None, impacts: Callable[[DataFrame], DataFrame] | None = None, associations: DataFrame | None = None, payload: str = "value") -> DataFrame:
    """file, kind, text: what an edit asks for: rules that match, translations that may be stale (translations: path, is_source, siblings), curated links that it breaks, and, where there are none of those, associations (path, other)."""
    rows = parsed(events, payload).filter("file IS NOT NULL").select("file")
    out = rows.select("file", F.lit("rule").alias("kind"), F.explode(F.transform(edit_rules(F.col("file"), rules), lambda r: F.concat(F.lit("["), r["name"], F.lit("] "), r["notify"]))).alias("text"))
    if translations is not None:
        t = translations.filter("is_source").select(F.col("path").alias("file"), F.array_join(F.transform("siblings", lambda s: F.concat_ws(" ", s["locale"], s["path"])), "\n").alias("text"))
        out = out.union(rows.join(t, "file").select("file", F.lit("translation"), "text"))
    said = impacts(rows.select(F.col("file").alias("path"))) if impacts else None
    if said is not None:
        out = out.union(said.select("file", F.lit("lineage"), F.concat_ws(" ", F.concat(F.lit("edge #"), "edge"), "state", F.concat("other_file", F.lit(":"), "other_start"))))
    if associations is not None:
        near = rows.join(associations.select(F.col("path").alias("file"), "other"), "file")
        near = near if said is None else near.join(said.select("file").distinct(), "file", "left_anti")
        out = out.union(near.select("file", F.lit("association"), "other"))
    return out


def started(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = Settings(), floor: str = FLOOR, payload: str = "value"):
    """A running query that hands each batch's findings to sink; with a trigger of availableNow it ends when the input does."""
    return lints(events, settings, floor, payload).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
