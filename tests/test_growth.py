"""What must not grow faster than the input: joins and passes of the reports, tasks, tiles."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillgrid.operators import detect
from quillgrid.plans.queries import QUERIES
from quillgrid.sources import files

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "It was was late.  Needless to say, they utilize numerous things. They won!"), (2, "Fine."), (3, ""), (4, None), (5, "They delve with a robust tool. The chairman had had his tea - - and it was was cold.")]


def documents(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_json_reports_neither_broadcast_findings_nor_find_twice(spark):
    for name in ("json_report", "json_report_counts"):
        p = plan(QUERIES[name](spark, SF))
        assert "Broadcast" not in p and p.count("ArrowEvalPython") == 1
    docs = documents(spark)
    apart = files.report(docs, detect.detected(docs))
    assert "Broadcast" not in plan(apart)
    rows = lambda df: {r.doc_id: json.loads(r.json) for r in df.collect()}
    got = rows(files.documents_report(docs))
    assert got == rows(apart) and len(got) == 5 and len(got[1]["findings"]) > 3 and got[4]["findings"] == []


def test_tasks_are_bounded_however_large_the_table(spark):
    """512 MB in one partition, as a file of one row group is; before, a table over 32 MB a core was left as it lay."""
    from quillgrid.plans.session import spread

    assert spread(spark.range(0, 1 << 26, 1, 1)).rdd.getNumPartitions() >= 128
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(spark.range(0, 1000, 1, 1)).collect()) == list(range(1000))


def test_grades_remember_words_and_deal_documents(spark):
    from quillgrid.functions.segment import count_letters
    from quillgrid.operators import segments
    from quillgrid.plans.rules import syllables

    words = ["Table", "it's", "radio", "created", "Yes", "", "the", "UNIVERSITIES", "rhythm", "y"] * 50
    syllables.cache_clear()
    assert [syllables(w) for w in words] == [syllables.__wrapped__(w) for w in words] and syllables.cache_info().misses == 10
    assert count_letters("aZ é–9_\ud83d[`{@k") == 3
    for made in (segments.readability, segments.segmented, segments.queries):
        out = made(documents(spark).coalesce(1))
        assert out.rdd.getNumPartitions() > 1 and (made is segments.queries or out.count() == 5)


def test_all_findings_are_dealt_out(spark):
    for name in ("findings_all", "findings_google"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF)) and "hashpartitioning" in plan(QUERIES[name](spark, SF))


def test_reports_of_documents_are_made_where_findings_are_found(spark):
    from quillgrid.sources import reports

    for name in ("human_report", "agent_report", "human_report_heads", "agent_report_counts"):
        p = plan(QUERIES[name](spark, SF))
        assert p.count("Exchange hashpartitioning") == 1 and p.count("ArrowEvalPython") == 1 and "Window" not in p and "SortMergeJoin" not in p
    docs = documents(spark).union(spark.createDataFrame([(6, "It was was late. " * 14)], "doc_id long, text string"))
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    got = rows(reports.documents_lines(docs))
    assert got == rows(reports.lines(detect.detected(docs))) and set(got) >= {1, 5, 6} and 4 not in got
    shown = spark.createDataFrame([("repeated-word", "a a", "a"), ("repeated-word", "b b", "b"), ("no-such", "c", "d")], "rule_id string, bad string, good string")
    got = rows(reports.documents_for_agent(docs, exemplars=shown))
    assert got == rows(reports.for_agent(detect.detected(docs), shown))
    assert got[6].count("\n  L") == 9 and " more)\n\n  repeated-word\n    - a a\n    + a\n  repeated-word\n    - b b\n    + b" in got[6] and "no-such" not in got[6]


def test_tiles_of_cells_are_bounded_on_both_sides(spark, monkeypatch):
    """Tiles fail beyond 80 rows of a side, a piece of 40 and chance; before, every query of a cell was in one tile."""
    from pyspark.sql import functions as F

    from quillgrid.operators import assoc

    df = spark.range(1, 401).select("id", (F.col("id") % 7).alias("grp"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(4)]).alias("vector")).withColumn("vector", F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y * y))))
    exact = sorted((r.id, r.other, round(r.sim, 9)) for r in assoc.neighbours(df).collect())
    made = assoc._products

    def bounded(*a):
        run = made(*a)

        def checked(table):
            sides = table["side"].to_pylist()
            assert max(sides.count(0), sides.count(1)) <= 80
            return run(table)

        return checked

    monkeypatch.setattr(assoc, "_products", bounded)
    monkeypatch.setattr(assoc, "AT_ONCE", 1)
    assert sorted((r.id, r.other, round(r.sim, 9)) for r in assoc.recalled(df, centres=5, probes=5, block=40).collect()) == exact
    assert sorted((r.id, r.other, round(r.sim, 9)) for r in assoc.neighbours(df, block=40).collect()) == exact


def test_blocks_keep_copies_of_vectors_few():
    from quillgrid.operators import assoc

    assert 2 * -(-600_000 // assoc.BLOCK) <= 80 and assoc.AT_ONCE * 8 <= 1 << 25


def test_windows_of_lines_are_not_checkpointed(spark, monkeypatch):
    """Only what repeats goes to the checkpoint folder; before, every window of every text did.  Blocks of windows are gone afterwards."""
    from quillgrid.llm import linededup

    settled, seen = linededup.settled, []
    monkeypatch.setattr(linededup, "settled", lambda df: seen.append(out := settled(df)) or out)
    held = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    lines = "\n".join(f"line {k} of a text" for k in range(40))
    docs = spark.createDataFrame([(1, lines), (2, "other\n" + lines), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed) for r in linededup.deduplicated(docs, passage=50).collect()}
    assert got == {1: (lines, 0), 2: ("other", 40), 3: (None, 0)}
    assert [df.count() for df in seen] == [1] and set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= held


def test_tiles_find_exactly_the_nearest_and_copies_do_not_grow(spark, monkeypatch):
    """Equal vectors are equally near wherever they stand, the least ids come first; twice the vectors are twice the copies, where blocks of a fixed size made it four times."""
    import numpy as np

    from quillgrid.operators import assoc

    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 24))
    x[200:260], x[260], x[261, 0] = x[3], 0, np.nan
    for scale in (1.0, 1e-9):
        rows = [(int(i) * 3, int(i) % 5, (v * scale).astype("float32").tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "id long, grp int, vector array<float>")
        floor = 0.5 * scale * scale

        def sim(a, b):
            total = 0.0
            for p, q in zip(a, b, strict=True):
                total += float(p) * float(q)
            return total

        v = [np.float32(r[2]).astype(float).tolist() for r in rows]
        truth = []
        for i, (a, g, _) in enumerate(rows):
            found = [(-s, b) for j, (b, h, _) in enumerate(rows) if g != h and (s := sim(v[i], v[j])) >= floor]
            truth += [(a, b, -s) for s, b in sorted(found)[:8]]
        for block in (assoc.BLOCK, 70):
            assert sorted((r.id, r.other, r.sim) for r in assoc.neighbours(df, floor=floor, block=block).collect()) == sorted(truth)
        if scale == 1.0:
            assert sorted((r.id, r.other, r.sim) for r in assoc.recalled(df, floor=floor, centres=3, probes=3, block=70).collect()) == sorted(truth)

    made = assoc._dealt

    def copies(n):
        seen = []
        monkeypatch.setattr(assoc, "_dealt", lambda tiles, *a: seen.append(tiles.count()) or made(tiles, *a))
        assoc.neighbours(spark.range(n).select("id", F.lit(0).alias("grp"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")))
        return seen[0]

    assert copies(200_000) == 2 * copies(100_000) > 0
    assert assoc._number(df) == "array<float>" and assoc._most(spark.range(1).select(F.array_repeat(F.lit(1.0), 1 << 16).alias("vector")), assoc.BLOCK) == 128
