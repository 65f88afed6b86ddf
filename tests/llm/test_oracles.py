"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from loamwork.llm import queries

ODD_DOCS = [(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (2, None, None, None), (None, "d e", "en", None), (None, "d e", "en", "\U0001f600"), (3, "", "en", "é"), (4, " \t\x0b\x0c\r\n ", "en", "￿"), (5, "w " * 5000, "de", "z"), (6, "x\x1cy\xa0z\x85q", "en", "z")]
ODD_TURNS = [(1, 0, "user", 'say "hi" \\ é'), (1, 1, "assistant", "ok\n\ttab"), (1, 2, "user", None), (1, 4, "user", ""), (1, 5, "assistant", None), (2, 0, "user", "w " * 60), (2, 2, "user", "no answer"), (None, 0, "user", "x"), (2, None, "assistant", "x"), (3, 0, None, "x"), (4, 0, "user", "twice"), (4, 0, "user", "again"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (5, 3, "user", "late"), *((c, k, "user" if k % 2 == 0 else "assistant", f"text {k} of {c}") for c in range(-3, 29) for k in range(8) if c > 5 or c < 1)]


def same(df, sql, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if 'testdata' not in folder else ''}'")
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_driver_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    same(queries.queries()[name](spark, folder), queries.oracle_sql()[name], folder, ["documents", "conversations"])


def test_mixing_odd_rows(spark, docs, as_table):
    folder = as_table(docs(*ODD_DOCS))
    same(queries.queries()["op1_source_mixing"](spark, folder), queries.oracle_sql()["op1_source_mixing"], folder, ["documents"])


def test_tool_calls_odd_rows(spark, as_table):
    folder = as_table(spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string"), "conversations")
    same(queries.queries()["op4_tool_calls"](spark, folder), queries.oracle_sql()["op4_tool_calls"], folder, ["conversations"])


@pytest.mark.parametrize("name", ["op1_source_mixing", "op4_tool_calls"])
def test_empty(spark, docs, as_table, name):
    folder = as_table(docs((1, "a")).limit(0)) if name == "op1_source_mixing" else as_table(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), "conversations")
    assert queries.queries()[name](spark, folder).count() == 0
