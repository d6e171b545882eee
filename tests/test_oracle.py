"""Every query with SQL against DuckDB over the smallest tables; plans of the main ones."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("FOLIOSCAN_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p if p.is_file() else p / "*.parquet"}'")
    return c


def told(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, bool):
        return int(v)
    return int(v) if hasattr(v, "as_integer_ratio") and float(v).is_integer() else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    cols = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == cols
    at = [x[0] for x in want.description]
    theirs = sorted([repr(tuple(told(r[at.index(c)]) for c in cols)) for r in want.fetchall()])
    ours = sorted([repr(tuple(told(r[c]) for c in cols)) for r in got.collect()])
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    if Path("/root/testdata/sf0.001").is_dir():
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bm25_scores", "topic_page_chunks", "chunk_image_range_join", "retrieve_end_to_end", "hybrid_top15", "images_fallback", "images_subparts", "align_fold"])
def test_no_crossed_joins(spark, plan_of, name):
    plan = plan_of(entry.queries()[name](spark, str(DATA)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_what_a_page_says_is_not_shuffled_for_each_chapter(spark, plan_of):
    lines = plan_of(entry.queries()["align_fold"](spark, str(DATA))).splitlines()
    assert not [b for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning(q_id" in a and "tokens" in b]


def test_pushdown(spark, plan_of):
    plan = plan_of(entry.queries()["distinct_subjects"](spark, str(DATA)))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "ReadSchema: struct<lang:string,source:string>" in plan
