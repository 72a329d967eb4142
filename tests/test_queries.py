"""Every registered query of the engine against its SQL, over whole tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from quillgrid.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr) == rows


def test_every_document_is_a_version(spark):
    from quillgrid.plans.queries import translations

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    files = translations(spark, SF)
    assert files.count() == n == files.select("path").distinct().count()
    found = QUERIES["translation_sets"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").filter("lang <> 'en'").count()  # English has the most
