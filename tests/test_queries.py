"""Every registered catalogue query against its SQL in DuckDB, and the shape of its plan."""

import os
from collections import Counter

import duckdb
import pytest

from stratafile import catalogue_queries as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries whose work is done in Python by design.
PYTHON = {"blake3_hash", "blake3_in_parts", "classify_by_many_rules", "media_types", "fs_scan", "fs_scan_counts"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_plans_stay_in_the_engine(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert "CartesianProduct" not in plan


#: What the rows of ordered queries are sorted by; a minus sign means falling.
ORDERS = {
    "large_files": ["-size_bytes"], "duplicate_groups": ["-total_waste_bytes"], "cross_drive_groups": ["-total_waste_bytes"], "files_by_drive": ["path"], "audit_entries": ["-timestamp"],
    "category_statistics": ["-total_bytes"], "category_page": ["id"], "review_batches": ["-file_count"], "list_drives_online": ["id"],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    for sign, column in ((k[0] == "-", k.lstrip("-")) for k in ORDERS[name]):
        values = [r[column] for r in rows]
        assert len(values) > 1 and values == sorted(values, reverse=sign)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["files_by_drive"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema: ")[1].split(">")[0]
    plan = QUERIES["plan_by_id"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,33)" in plan
    top = QUERIES["large_files"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_no_query_reads_its_sql_for_another_scale():
    assert not any("testdata" in s for s in SQL.values()) and os.path.isdir(SF)
