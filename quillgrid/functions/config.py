"""Project settings: two JSON layers, globs and edit rules."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.operators.detect import Settings


def merged(base: dict, over: dict) -> dict:
    """over wins; objects are merged key by key."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def glob_pattern(glob: str) -> str:
    """**/ is any number of folders, ** anything, * and ? stay within a name."""
    out, i = [], 0
    while i < len(glob):
        for sign, pattern in (("**/", "(?:[^/]+/)*"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(sign, i):
                out.append(pattern)
                i += len(sign)
                break
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + r"\z"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether the path or its last part matches any of the globs."""
    clean = F.regexp_replace(path, r"\\", "/")
    base = F.element_at(F.split(clean, "/"), -1)
    out = F.lit(False)
    for g in globs:
        out = out | clean.rlike(glob_pattern(g)) | base.rlike(glob_pattern(g))
    return out


def listed(value) -> list:
    return value if isinstance(value, list) else [value] if value else []


def edit_rules(path: Column, rules: list[dict]) -> Column:
    """Array of (name, notify) of the rules with a glob for the path, none against it, and something to say."""
    found = [F.when(matches(path, listed(r["paths"])) & ~matches(path, listed(r.get("exclude"))), F.struct(F.lit(r.get("name") or "rule").alias("name"), F.lit(r["notify"]).alias("notify"))) for r in rules or [] if listed(r.get("paths")) and r.get("notify")]
    return F.filter(F.array(*found), lambda r: r.isNotNull()) if found else F.array().cast("array<struct<name:string,notify:string>>")


def settings(base: str = "{}", local: str = "{}") -> tuple[Settings, dict]:
    """Settings of the detector and the whole configuration, from two JSON texts; unreadable ones count as empty."""
    layers = []
    for text in (base, local):
        try:
            layers.append(json.loads(text))
        except ValueError:
            layers.append({})
    whole = merged(*layers)
    d = whole.get("detector") or {}
    values = tuple((rule, tuple(map(str, v))) for rule, v in (d.get("ignoreValues") or {}).items())
    return Settings(d.get("styleGuide") or "microsoft", frozenset(d.get("ignoreRules") or ()), values), whole


def changed(config: dict, *, rule: str | None = None, file: str | None = None, value: tuple[str, str] | None = None, reason: str | None = None, add: dict | None = None, remove: str | None = None, hook: bool | None = None) -> dict:
    """A copy of config with a rule, file glob or (rule, value) ignored, an edit rule added or removed by name, or the hook switched."""
    out = json.loads(json.dumps(config))
    d = out.setdefault("detector", {})

    def put(where: list, what) -> None:
        if what not in where:
            where.append(what)

    if rule:
        put(d.setdefault("ignoreRules", []), rule)
    if file:
        put(d.setdefault("ignoreFiles", []), file)
    if value:
        put(d.setdefault("ignoreValues", {}).setdefault(value[0], []), value[1])
    if reason and (rule or file or value):
        d.setdefault("ignoreReasons", {})[rule or file or ":".join(value)] = reason
    if add or remove:
        name = remove or add["name"]
        out["rules"] = [r for r in out.get("rules", []) if r.get("name") != name] + ([add] if add else [])
    if hook is not None:
        out.setdefault("hook", {})["enabled"] = hook
    return out
