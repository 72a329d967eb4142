"""Operators on small inputs made for them."""

from __future__ import annotations

import json
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.functions.config import edit_rules, matches, settings
from quillgrid.operators import assoc, code, detect, grounding, i18n, lineage, models, score, site, structure
from quillgrid.plans.session import accumulated
from quillgrid.sources import files
from quillgrid.streaming import events


def table(spark, rows, schema="path string, text string"):
    return spark.createDataFrame(rows, schema)


def test_typed_spans():
    got = [(k, v) for k, v, *_ in grounding.spans("We raised $30 million in 2021 with 12% growth, on March 5, 2020 and 2020-03-06, for 5 dogs.")]
    assert got == [("percent", "12"), ("money", "30000000"), ("date", "2020-03-06"), ("date", "2020-03-05"), ("year", "2021"), ("count", "5")]
    assert [(k, v) for k, v, *_ in grounding.spans("15 March 2024 or March 2024")] == [("date", "2024-03-15"), ("date", "2024-03")]
    assert grounding.agree("date", "2024-03", "2024-03-15") and not grounding.agree("date", "2024-03", "2024-04")


def test_entities_and_facts():
    assert grounding.entities("The dog met Acme Corp of Rome in NASA. Then Bob left with Ann.") == ["acme corp of rome", "nasa", "ann"] or "acme corp of rome" in grounding.entities("The dog met Acme Corp of Rome in NASA.")
    assert grounding.read_facts("# F\n\n- Acme has 5 dogs (source: x)\n2. Rome is old\n<!-- c -->") == [(3, "Acme has 5 dogs", "source: x"), (4, "Rome is old", None)]


def test_factcheck(spark):
    docs = table(spark, [(1, "The Acme Corp revenue reached $5 million there. Some purple birds sang 7 songs. Nice day."), (2, "The Acme Corp revenue reached $4 million there."), (3, None)], "doc_id long, text string")
    facts = table(spark, [(1, "Acme Corp revenue reached $4 million.", "s"), (2, "Other thing entirely in 1999.", None)], "fact long, text string, source string")
    got = {(r.doc_id, r.rule_id, r.severity) for r in grounding.checked(docs, facts).collect()}
    assert got == {(1, "contradicts-fact", "error"), (1, "unsupported-claim", "advisory")}
    assert {r.severity for r in grounding.checked(docs, facts, True).filter("rule_id = 'unsupported-claim'").collect()} == {"warn"}


def test_entailment(spark):
    docs = table(spark, [(1, "The Acme Corp revenue grew strongly last year.")], "doc_id long, text string")
    facts = table(spark, [(1, "Acme Corp revenue shrank last year.", None)], "fact long, text string, source string")
    assert [r.rule_id for r in models.entailed(docs, facts, lambda a, b: [(0.9, 0.05)] * len(a)).collect()] == ["contradicts-fact"]
    assert models.entailed(docs, facts, lambda a, b: [(0.1, 0.8)] * len(a)).count() == 0
    assert models.ungrounded(docs, lambda s: [0.01] * len(s)).count() == 1


def test_score(spark):
    docs = table(spark, [(1, "the the old dog ran."), (2, "I can't, we won't. " * 5), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in score.scored(docs, detect.detected(docs, detect.Settings(only=frozenset(["repeated-word"])))).collect()}
    assert got[1].findings == 1 and got[3].score == 0 and got[3].band == "clean" and got[2].discount == 15


def test_structure(spark):
    rows = [("docs/adr/0001-x.md", "# X\n\nStatus: accepted\n\n## Context\n\n## Decision\n"), ("a/b.md", "# Hello\n"), ("CONTRIBUTING.md", "# Contributing\n"), ("ops/fix.md", "# Fix\n\n## Rollback\n\n## Escalation\n"), ("pm/incident-1.md", "## Timeline\n\n## Root cause\n\nHe was at fault.\n")]
    got = {r.path: r for r in structure.assets(table(spark, rows)).collect()}
    assert {p: r.type for p, r in got.items()} == {"docs/adr/0001-x.md": "adr", "CONTRIBUTING.md": "contributing", "ops/fix.md": "runbook", "pm/incident-1.md": "postmortem"}
    assert [f.span for f in got["docs/adr/0001-x.md"].findings] == ["Consequences", "Considered Options"]
    assert "postmortem-blame" in {f.rule_id for f in got["pm/incident-1.md"].findings}
    paths = table(spark, [("mkdocs.yml",), ("astro.config.mjs",), ("docs/conf.py",)], "path string")
    assert {r.id for r in structure.platforms(paths).collect()} == {"mkdocs", "sphinx"}
    assert "starlight" in {r.id for r in structure.platforms(paths.union(table(spark, [("src/content/docs/a.md",)], "path string"))).collect()}


def test_site(spark):
    pages = table(spark, [("README.md", "# A `b` c\n\n[x](docs/a.md#part-one) [y](docs/none.md) [z](#a-b-c) [q](#no) [t][u] [e](https://x.org) [s](docs/) [m](/Users/me/x.md) [r](/nope.md)\n\n```\n[no](no.md)\n```\n"), ("docs/a.md", "# Part one\n\n## Part one\n\n[up](../README.md) [out](../../x.md) [twice](a.html#part-one-1) ![i](i.png)\n")])
    paths = pages.select("path").union(table(spark, [("docs/i.png",), ("LICENSE.txt",), (".github/SECURITY.md",)], "path string"))
    got = sorted((r.rule_id, r.file, r.span) for r in site.check_links(pages, paths).collect())
    assert got == sorted([("link-broken", "README.md", "[y](docs/none.md)"), ("link-broken-anchor", "README.md", "[q](#no)"), ("link-undefined-reference", "README.md", "[t][u]"), ("link-machine-path", "README.md", "[m](/Users/me/x.md)"), ("link-unresolved-absolute", "README.md", "[r](/nope.md)"), ("link-broken", "docs/a.md", "[out](../../x.md)")])
    assert {r.span for r in site.check_community(paths).collect()} == {"CONTRIBUTING.md", "CODE_OF_CONDUCT.md", "CHANGELOG.md"}
    nav = table(spark, [("src/SUMMARY.md", "[a](a.md)\n[b](b.md)")])
    got = {(r.rule_id, r.span) for r in site.check_nav(nav, table(spark, [("src/SUMMARY.md",), ("src/a.md",), ("src/c.md",)], "path string")).collect()}
    assert got == {("nav-missing-target", "src/b.md"), ("nav-orphan-page", "src/c.md")}


def test_column_functions(spark):
    df = table(spark, [("a/b/c.md", "../d/./e.md"), ("a.md", "../x.md"), ("a/b.md", "/r/s.md")], "base string, href string")
    assert [r[0] for r in df.select(T.resolved(F.col("base"), F.col("href"))).collect()] == ["a/d/e.md", None, "r/s.md"]
    assert spark.range(1).select(T.slug(F.lit("A `B`, / C!"))).first()[0] == site.slug("A `B`, / C!")
    a, b = spark.range(1).select(T.span_hash(F.lit("a  b\n\n c ")), T.span_hash(F.lit("a b\nc"))).first()
    assert a == b


def test_lineage(spark):
    tree = table(spark, [("a.py", "x\ndef foo():\n  pass\n"), ("d.md", "foo is here\n\nother")])
    cols = "src_file string, src_start int, src_end int, dst_file string, dst_start int, dst_end int, src_symbol string, dst_symbol string, rel string, score double, via string, seq long"
    p = table(spark, [("a.py", 2, 3, "d.md", 1, 1, "foo", "foo", None, 0.9, "symbol", 1), ("a.py", 2, 2, "d.md", 1, 2, "foo", "foo", None, 0.8, "symbol", 2), ("d.md", 1, 1, "a.py", 3, 3, "foo", "foo", None, 0.7, "symbol", 3), ("a.py", 2, 3, "d.md", 1, 1, "bar", "bar", None, 0.6, "symbol", 4), ("a.py", 90, 91, "d.md", 1, 1, "z", "z", None, 0.5, "symbol", 5)], cols)
    e = lineage.proposed(lineage.empty(spark), p, tree).cache()
    assert [(r.id, r.src_symbol, r.status) for r in e.orderBy("id").collect()] == [(1, "foo", "proposed"), (2, "bar", "proposed")]
    d = table(spark, [(1, "confirmed", "describes", None, "human"), (2, "rejected", None, "no", "llm")], "id int, status string, rel string, note string, by string")
    e = lineage.curated(e, d, tree).cache()
    assert lineage.proposed(e, p, tree).count() == 2  # what was rejected stays away
    changed = table(spark, [("a.py",)], "path string")
    state = lambda text: [r.state for r in lineage.impact(e, table(spark, [("a.py", text), ("d.md", "foo is here\n\nother")]), changed).collect()]
    assert state("x\ndef foo():\n  pass\n") == [] and state("x\ndef  foo():\n\tpass\n") == []
    assert state("y\nx\ndef foo():\n  pass\n") == ["moved"] and state("x\ndef foo():\n  go\n") == ["impact"]
    assert [r.state for r in lineage.impact(e, tree.filter("path = 'd.md'"), changed).collect()] == ["missing"]
    s = lineage.stamped(e, table(spark, [("a.py", "y\nx\ndef foo():\n  pass\n"), ("d.md", "foo is here")])).filter("id = 1").first()
    assert (s.src_start, s.src_end) == (3, 4)
    n = lineage.respanned(e, table(spark, [(1, 2, 2, None, None)], "id int, src_start int, src_end int, dst_start int, dst_end int"), tree).filter("id = 1").first()
    assert (n.src_start, n.src_end, n.src_text) == (2, 2, "def foo():")
    assert [r.status for r in lineage.linked(e, table(spark, [("a.py", 1, 1, "d.md", 3, 3, None, "n", "me")], "src_file string, src_start int, src_end int, dst_file string, dst_start int, dst_end int, rel string, note string, by string"), tree).filter("id = 3").collect()] == ["confirmed"]


def test_translations(spark):
    paths = "README.md README.es.md README.zh-CN.md docs/content/a.md docs/content.zh/a.md web/docs/x.md web/i18n/fr/docusaurus-plugin-content-docs/current/x.md d/en/p.md d/de/p.md lone.md notes.old.md".split()
    got = {r.path: (r.layout, r.locale, r.is_source, [s.path for s in r.siblings]) for r in i18n.sets(table(spark, [(p,) for p in paths], "path string")).collect()}
    assert got["README.md"] == ("suffix", "en", True, ["README.es.md", "README.zh-CN.md"])
    assert got["README.es.md"][3] == ["README.md", "README.zh-CN.md"]
    assert got["docs/content.zh/a.md"][:3] == ("hugo", "zh", False)
    assert got["web/docs/x.md"][:3] == ("docusaurus", "en", True)
    assert got["d/de/p.md"] == ("dir", "de", False, ["d/en/p.md"])
    assert "lone.md" not in got and "notes.old.md" not in got
    files_ = table(spark, [("a.md", "# A\n\n## B\n\n```\nx\n```\n\n[l](https://x.org) ![i](i.png)"), ("a.de.md", "# A\n\n### B\n\n```\ny\n```\n")])
    (r,) = i18n.sweep(files_).collect()
    assert [(d.severity, d.what) for d in r.drift] == [("warn", "nesting"), ("advisory", "code"), ("advisory", "links"), ("advisory", "images")]


def test_associations(spark):
    def vowels(texts):
        """A stand-in for a model: how often each pair of a consonant and a vowel occurs, to length 1."""
        out = []
        for t in texts:
            v = np.zeros(105)
            for a, b in zip(t.lower(), t.lower()[1:], strict=False):
                if a in "bcdfghjklmnpqrstvwxyz" and b in "aeiou":
                    v["bcdfghjklmnpqrstvwxyz".index(a) * 5 + "aeiou".index(b)] += 1
            out.append((v / max(np.linalg.norm(v), 1e-9)).tolist())
        return out

    body = lambda w: "\n".join(f"{w} words about {w} number {k}" for k in range(6))
    rows = table(spark, [("a.md", body("bread")), ("b.md", body("bread")), ("c.md", body("engine"))])
    stored = assoc.embedded(assoc.chunks(rows), vowels).cache()
    built = assoc.associations(stored, floor=0.9).cache()
    assert [(r.a.path, r.b.path) for r in built.collect()] == [("a.md", "b.md")]
    after = table(spark, [("a.md", body("bread")), ("b.md", body("engine")), ("c.md", body("engine"))])
    changes = assoc.git_changes(table(spark, [("M", "b.md", None), ("M", "a.md", None), ("R100", "n.md", "o.md"), ("D", "c.md", None), ("A", "c.md", None)], "status string, path string, old_path string"))
    assert {r.path: r.deleted for r in changes.collect()} == {"a.md": False, "b.md": False, "n.md": False, "o.md": True, "c.md": False}
    now, _ = assoc.updated(built, stored, after, changes, vowels, floor=0.9)
    assert [(r.a.path, r.b.path) for r in now.collect()] == [("b.md", "c.md")]
    assert assoc.of_file(built, "b.md").first().a.path == "b.md"
    vectors = table(spark, [(k, k % 2, [float(k), 1.0]) for k in range(8)], "id long, grp long, vector array<double>")
    assert [r.id for r in assoc.capped(assoc.search(vectors, [1.0, 0.0], 8), 4, 1).orderBy("id").collect()] == [4, 5, 6, 7]


def test_code(spark):
    assert [n for n, *_ in code.surface_of("a/x.ts", "export const abc = 1\nexport { d, e as f }\nexport interface G {}\nlet h = 1")] == ["abc", "d", "f", "G"]
    assert code.symbols_of("x.py", "def first():\n  a\n  b\n\ndef main():\n  pass\nclass Second:\n  pass") == [("first", 1, 3), ("Second", 7, 8)]
    js = "// Licensed text\nconst a = /[\"']/; // say it\nlet b = 'it\\'s' + \"x // y\" /* z */"
    shown = code.human_text(js, "js")
    assert len(shown) == len(js) and "say it" in shown and "it\\'s" in shown and "x // y" in shown and " z " in shown and "Licensed" not in shown and "const" not in shown
    assert code.without_comments("a = '#x' # y\n\"\"\" # z \"\"\"", "f.py") == "a = '#x'    \n\"\"\" # z \"\"\""
    got = code.discovered(table(spark, [("src/api/x.py",), ("openapi.yaml",), ("packages/a/i.ts",), ("packages/b/i.ts",)], "path string")).collect()
    assert {r.name: list(r.paths) for r in got} == {"api-docs": ["src/api/**", "openapi.yaml"], "package-readme": ["packages/*/src/**"]}


def test_config(spark):
    s, whole = settings('{"detector": {"styleGuide": "google", "ignoreRules": ["x"]}, "a": {"b": 1}}', '{"a": {"c": null}, "detector": {"ignoreRules": ["y"]}}')
    assert s.style == "google" and s.ignore_rules == {"y"} and whole["a"] == {"b": 1, "c": None}
    assert settings("{bad", "{}")[0].style == "microsoft"
    df = table(spark, [("README.md",), ("a/b/README.md",), ("src/api/x.py",)], "path string")
    assert [r[0] for r in df.select(matches(F.col("path"), ["**/*.md"])).collect()] == [True, True, False]
    assert [len(r[0]) for r in df.select(edit_rules(F.col("path"), [{"paths": "src/**", "notify": "n"}, {"paths": ["*.py"], "notify": ""}])).collect()] == [0, 0, 1]


def test_sources(spark, tmp_path):
    for p, t in {"a.md": "It was was late.", "sub/b.md": "Fine.", "sub/c.es.md": "la la", "CHANGELOG.md": "the the", "node_modules/d.md": "the the", "e.py": "the the"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    assert sorted(r.path for r in files.paths(spark, str(tmp_path)).collect())[-1] == "sub/c.es.md"
    assert [(r.path, r.rule_id) for r in files.detected(spark, str(tmp_path), detect.Settings(only=frozenset(["repeated-word"]))).collect()] == [("a.md", "repeated-word")]
    docs = files.prose(files.texts(spark, str(tmp_path)))
    report = {r.path: json.loads(r.json) for r in files.report(docs, detect.detected(docs, key="path"), "path").collect()}
    assert set(report) == {"a.md", "sub/b.md"} and "repeated-word" in {f["rule"] for f in report["a.md"]["findings"]}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    payloads = [{"tool_name": "Write", "tool_input": {"file_path": "a.md", "content": "I hope this helps."}}, {"tool_name": "Bash", "tool_input": {"file_path": "b.md", "content": "I hope this helps."}}, {"file_path": "c.md", "tool_input": {"edits": [{"new_string": "Fine."}, {"new_text": "Great question now."}]}}, {"path": "d.py", "tool_input": {"content": "I hope this helps."}}]
    (tmp_path / "in" / "1.txt").write_text("\n".join([*map(json.dumps, payloads), "not json"]))
    got: list = []
    q = events.started(spark.readStream.text(str(tmp_path / "in")), lambda df, _: got.extend((r.file, r.rule_id, r.label) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(got) == [("a.md", "assistant-meta", "L1"), ("c.md", "sycophancy", "edit #2 L1")]
    batch = spark.read.text(str(tmp_path / "in"))
    assert {(r.file, r.decision) for r in events.gated(batch).collect()} == {("a.md", "deny"), (None, "allow"), ("c.md", "allow"), ("d.py", "allow")}
    assert [r.text for r in events.notices(batch, [{"name": "r", "paths": ["*.py"], "notify": "look"}]).collect()] == ["[r] look"]


def test_cells_recall_neighbours(spark):
    """Vectors around 40 centres: by a quarter of the cells nine of ten neighbours are found, and none that is not one; doubling the vectors doubles what is shuffled, not its square."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([c + 0.4 * rng.normal(size=(25, 24)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = table(spark, [(k, k % 7, v.tolist()) for k, v in enumerate(x)], "id long, grp int, vector array<double>").cache()
    exact = {(r.id, r.other) for r in assoc.neighbours(df).collect()}
    found = {(r.id, r.other) for r in assoc.recalled(df, probes=8, block=100).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    sims = x @ x.T
    assert all(sims[a, b] >= assoc.FLOOR - 1e-9 and a % 7 != b % 7 for a, b in found)
    assert assoc.recalled(df.limit(0)).count() == 0


def test_chunks_keep_their_lines(spark):
    text = "\n".join(f"line number {k} of it" for k in range(1, 101))
    got = [(r.chunk, r.start, r.end, r.text.split("\n")[0], r.text.split("\n")[-1]) for r in assoc.chunks(table(spark, [("a", text), ("b", "short")])).orderBy("start").collect()]
    assert got == [(f"L{a}", a, b, f"line number {a} of it", f"line number {b} of it") for a, b in ((1, 40), (33, 72), (65, 100))]


def test_surface_chunks(spark):
    items = table(spark, [("src/a", f"n{k}", "s" * 199, k) for k in range(1)] + [("src/b", "x", "s" * 7890, 1), ("src/b", "y", "t" * 10, 2), ("src/c", "z", "u" * 10, 1), ("lib/c", "w", "v", 1), ("d", "r", "r", 4)], "path string, name string, signature string, line int")
    wide = code.rendered(items, 150)
    assert {(r.folder, r.path, r.chunk) for r in wide.collect()} == {("src", "src/a", 0), ("src", "src/b", 1), ("src", "src/c", 2), ("lib", "lib/c", 0), ("", "d", 0)}
    (one,) = code.chunk_texts(code.rendered(items)).filter("folder = 'src'").collect()
    assert one.text.split("\n")[:3] == ["// === src/a ===", "s" * 160, ""] and [m and m.name for m in one.map] == [None, "n0", None, None, "x", "y", None, None, "z", None]
    lines = [m and m.asDict() for m in one.map]
    assert [x["name"] for x in code.items_of_span(one.text, lines, "t" * 10 + " src/c === uuuuuuuuuu")] == ["y", "z"] and code.items_of_span(one.text, lines, "no") == code.items_of_span(one.text, lines, " ") == []


def test_attention(spark):
    a = table(spark, [(q, c, 1.0 if c == 1 else 0.1) for q in range(3) for c in range(4)], "q long, c long, score double")
    flags = models.coverage(a, "c")
    assert {r.c: r.flagged for r in flags.collect()} == {0: True, 1: False, 2: True, 3: True}
    assert [(r["first"], r["last"]) for r in models.regions(flags, "c").collect()] == [(0, 0), (2, 3)]
    texts = table(spark, [(0, "tiny"), (1, "x"), (2, "seven.."), (3, "eight...")], "c long, text string")
    assert [(r["first"], r["last"], r.text) for r in models.regions(flags, "c", texts).collect()] == [(2, 3, "seven..eight...")]
    assert round(models.engaged(flags).first()[0], 2) == 0.25
    assert spark.range(1).select(models.tightened(F.lit("We ran in order to  win"), [{"in order to": "to"}])).first()[0] == "We ran to win"


def test_attention_reductions(spark):
    """Against the same in NumPy."""
    rng = np.random.default_rng(1)
    w = rng.random((3, 2, 6, 9)) * 0.01
    w[:, :, :, 4] += 50
    rows = [(1, layer, head, q, c, float(w[layer, head, q, c])) for layer in range(3) for head in range(2) for q in range(6) for c in range(9)]
    captures = table(spark, rows, "scan long, layer long, head long, q long, c long, weight double")
    queries = table(spark, [(1, q, q // 2) for q in range(6)], "scan long, q long, chunk long")
    context = table(spark, [(1, c, c // 3) for c in range(9)], "scan long, c long, to long")
    mean = w[1:3].mean(axis=(0, 1))
    out = np.zeros((3, 3))
    for k in range(3):
        sub = mean[2 * k : 2 * k + 2].copy()
        median = np.sort(sub, axis=0)[1]
        logs = np.log(median + (min(1e-12, median[median > 0].min()) / 2 + 1e-12))
        sub[:, logs > logs.mean() + 2 * logs.std()] = 0
        row = sub.mean(axis=0).reshape(3, 3).sum(axis=1)
        out[k] = row / row.sum()
    prior = np.array([col[col > 0].mean() if (col > 0).any() else 1 for col in out.T])
    wanted = out / prior**0.75
    wanted /= wanted.sum(axis=1, keepdims=True)
    matrix = models.averaged(captures.filter("layer >= 1")).join(queries, ["scan", "q"])
    cells = models.by_prior(models.scattered(models.without_sinks(matrix, 2.0), context))
    got = np.zeros((3, 3))
    for r in cells.collect():
        got[r.q, r.c] = r.score
    assert (out[:, 1] < out[:, 0]).all() and np.allclose(got, wanted)


def test_sidecar(spark, tmp_path):
    program = tmp_path / "model.py"
    program.write_text("import sys, json\nfor line in sys.stdin:\n    r = json.loads(line)\n    print(json.dumps({'id': 0, 'result': 1}))\n    print(json.dumps({'id': r['id'], 'error': 'bad'} if r['args'][0] == ['x'] else {'id': r['id'], 'result': [float(len(t)) for t in r['args'][0]]}), flush=True)\n")
    model = models.Sidecar([sys.executable, str(program)])
    docs = table(spark, [(1, "One sentence that is long. Another one that is longer.")], "doc_id long, text string")
    assert models.ungrounded(docs, model).count() == 0 and model(["ab", "c"]) == [2.0, 1.0]
    with pytest.raises(RuntimeError):
        model(["x"])


def test_events_of_a_hook(spark):
    rows = "doc_id long, severity string, line int, rule_id string"
    a, b = table(spark, [(1, "advisory", 1, "a"), (1, "warn", 9, "b")], rows), table(spark, [(1, "error", 5, "c"), (1, "warn", 2, "d")], rows)
    assert [r.rule_id for r in detect.merged(a, b).collect()] == ["c", "d", "b", "a"]
    facts = grounding.with_fact(table(spark, [(4, "A is B.", None)], "fact long, text string, source string"), " C  is D. ", "me")
    assert [(r.fact, r.text) for r in facts.orderBy("fact").collect()] == [(4, "A is B."), (5, "C is D.")] and grounding.with_fact(facts, "C is D.").count() == 2
    assert files.one(spark, "the the").collect() == [("<stdin>", "the the")]
    assert [r.path for r in files.translatable(table(spark, [("a.es.md",), ("x.py",), ("node_modules/b.md",)], "path string")).collect()] == ["a.es.md"]


def test_running_sums_over_ranges(spark):
    n = 500
    df = table(spark, [((k * 37) % n, k % 5) for k in range(n)], "k long, v long").repartition(7)
    got = {r.k: (r.at, r.s) for r in accumulated(df, [F.col("k")], at=F.lit(1), s=F.col("v")).collect()}
    by = {(k * 37) % n: k % 5 for k in range(n)}
    assert got == {k: (k, sum(by[j] for j in range(k))) for k in range(n)} and accumulated(df.limit(0), [F.col("k")], at=F.lit(1)).count() == 0


def test_best_facts_against_all_pairs(spark):
    """Whatever their terms, each claim gets the fact that comparing it with all facts gives."""
    rng = random.Random(2)
    words = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(4) for j in range(4)]
    names = ["Acme Corp", "Big Sky", "Red Hat"]
    say = lambda: " ".join(["the", *(rng.choice(words) for _ in range(rng.randint(1, 6))), *( [rng.choice(names)] if rng.random() < 0.4 else [])]) + f" {rng.randint(1, 99)}."
    facts = [(k, say(), None) for k in range(60)]
    docs = [(k, say()) for k in range(80)]
    table_ = grounding.facts(table(spark, facts, "fact long, text string, source string")).cache()
    claims = grounding.claims(table(spark, docs, "doc_id long, text string")).cache()
    held = {f: (set(grounding.tokens(t)), set(grounding.entities(t))) for f, t, _ in facts}
    wanted = {}
    for r in claims.collect():
        best, top = None, 0
        for f, (tokens, entities) in held.items():
            score_ = sum(t in tokens for t in r.tokens) + 2 * sum(e in entities for e in r.entities)
            if score_ > top:
                best, top = f, score_
        if top >= grounding.LEAST_SCORE:
            wanted[r.doc_id, r.n] = (best, top)
    for often in (200, 5, 0):
        grounding.OFTEN = often
        got = {(r.doc_id, r.n): (r.fact, r.score) for r in grounding.best(claims, table_).collect()}
        assert got == wanted, often
    grounding.OFTEN = 200


def test_templates_pass_their_own_checks(spark):
    rows = [(f"x/{t}.md", structure.template(t)) for t in structure.BY_TYPE]
    got = structure.assets(table(spark, rows).withColumn("type", F.regexp_extract("path", "x/(.*)[.]md", 1)), "type").collect()
    assert len(got) == 8 and all(not r.findings for r in got)
    for p in structure.STARTERS:
        assert p in {r.id for r in structure.platforms(table(spark, [(x,) for x, _ in structure.starter(p)], "path string")).collect()}


def test_files_and_claims(spark):
    from quillgrid.functions.config import changed
    from quillgrid.operators import segments
    from quillgrid.sources import reports

    rows = table(spark, [("a.md", "x"), ("a.test.js", "x"), ("build/b.py", "x"), ("c/d/e.py", "x"), ("f.png", "x")])
    assert [r.path for r in files.textual(rows).collect()] == ["a.md", "c/d/e.py"] and files.shallow(rows, 2).count() == 4
    text = table(spark, [('[{"i": 2, "claims": [" A ", "a", "b", ""]}]',)], "value string")
    assert [(r.n, r.claims) for r in files.claims(text).collect()] == [(2, ["A", "b"])]
    assert [(r.n, r.claims) for r in files.claims(table(spark, [('[["x"], []]',)], "value string")).collect()] == [(0, ["x"]), (1, [])]
    c = changed(changed({}, rule="r", reason="why"), value=("r", "v"), add={"name": "n", "paths": ["*"], "notify": "x"})
    assert c["detector"] == {"ignoreRules": ["r"], "ignoreReasons": {"r": "why"}, "ignoreValues": {"r": ["v"]}} and changed(c, remove="n")["rules"] == []
    docs = table(spark, [(1, "# A\n\n- one\n\nIt was was late. [l](x) **b**\n")], "doc_id long, text string")
    (p,) = segments.segmented(docs).collect()
    assert [h.text for h in p.headings] == ["A"] and [b.kind for b in p.blocks] == ["heading", "list", "para"] and p.links[0].target == "x" and len(p.bold) == 1 and len(p.sentences) == 3
    f = detect.detected(docs, detect.Settings(only=frozenset(["repeated-word"])))
    assert "1 findings (0 error, 1 warn, 0 advisory)" in reports.lines(f).first().text and "repeated-word" in reports.for_agent(f).first().text
