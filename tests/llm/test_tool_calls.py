import random

import pytest
from pyspark.sql import functions as F

from loamwork.llm import tool_calls

CALLS = "conv_id long, turn long, ordinal int, call_id string, name string, arguments string, depends_on string"
GOOD = '{"query":"q","limit":1}'


@pytest.fixture
def link(spark):
    def run(calls, results=()):
        c = spark.createDataFrame([(*x[:4], "lookup", GOOD, x[4]) for x in calls], CALLS)
        return tool_calls.link_tool_calls(c, spark.createDataFrame(list(results), "conv_id long, call_id string, content string")).collect()

    return run


def test_identifiers_recur_across_conversations(link):
    got = link([(1, 0, 0, "call_1", None), (2, 0, 0, "call_1", None), (3, 0, 0, "call_1", None)], [(1, "call_1", "one"), (2, "call_1", "two")])
    assert sorted((r.conv_id, r.status, '"result":"one"' in r.json, '"result":"two"' in r.json) for r in got) == [(1, "ok", True, False), (2, "ok", False, True), (3, "missing_result", False, False)]


def test_no_call_or_result_vanishes(link):
    calls = [(1, 0, 0, "a", None), (1, 1, 0, "a", None), (1, 2, 0, "b", None), (None, 0, 0, "a", None), (1, 0, 0, None, None), (1, 0, 0, None, None)]
    results = [(1, "a", "x"), (1, "a", "y"), (1, "a", "z"), (1, "c", "lost"), (None, "a", "n"), (1, None, "m")]
    got = link(calls, results)
    rows = sorted((str(r.conv_id), str(r.call_id), r.nth, r.status, r.n_calls, r.n_results) for r in got if r.status != "null_id")
    assert rows == [("1", "a", 1, "ok", 2, 3), ("1", "a", 2, "duplicate_id", 2, 3), ("1", "a", 3, "extra_result", 2, 3), ("1", "b", 1, "missing_result", 1, 0), ("1", "c", 1, "missing_call", 0, 1)]
    assert sum(r.status == "null_id" for r in got) == 5
    assert all(sum(f'"result":"{t}"' in r.json for r in got) == 1 for t in ("x", "y", "z", "lost", "n", "m"))


def test_order_is_by_dependencies_and_only_cycles_and_missing_ids_break(link):
    calls = [(1, 0, 0, "a", "b"), (1, 0, 1, "b", "c"), (1, 5, 0, "c", None), (1, 6, 0, "self", "self"), (1, 7, 0, "p", "q"), (1, 8, 0, "q", "r"), (1, 9, 0, "r", "p"), (1, 1, 0, "hang", "q"), (1, 1, 1, "far", "hang"), (1, 2, 0, "none", "nowhere"), (2, 0, 0, "x", "a")]
    got = {(r.conv_id, r.call_id): (r.after, r.broken_dependency, r.level) for r in link(calls)}
    assert got == {
        (1, "c"): (None, False, 0), (1, "b"): ("c", False, 1), (1, "a"): ("b", False, 2), (1, "self"): (None, True, 0), (1, "p"): (None, True, 0), (1, "q"): (None, True, 0), (1, "r"): (None, True, 0),
        (1, "hang"): ("q", False, 1), (1, "far"): ("hang", False, 2), (1, "none"): (None, True, 0), (2, "x"): (None, True, 0),
    }


def test_levels_of_long_chains(link):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(100)]
    up = {n: names[rng.randrange(max(0, i - 3), i)] if i else None for i, n in enumerate(names)}
    order = rng.sample(names, len(names))
    level = {}
    for n in names:
        level[n] = level[up[n]] + 1 if up[n] else 0
    assert {r.call_id: r.level for r in link([(1, k, 0, n, up[n]) for k, n in enumerate(order)])} == level


def checked(spark, *texts, name="lookup"):
    rows = spark.createDataFrame([(i, name, t) for i, t in enumerate(texts)], "i int, name string, arguments string")
    got = rows.select("i", tool_calls.argument_errors(F.col("name"), F.col("arguments")).alias("e"), tool_calls.canonical(F.col("arguments")).alias("c")).orderBy("i").collect()
    return [r.e for r in got], [r.c for r in got]


def test_every_error(spark):
    cases = {
        '{"query":"q","limit":1}': [], '{"limit":1.0,"query":"q"}': [], '{"query":"q","limit":1e0}': [], '{"query":"q","limit":5E1,"exact":true}': [],
        '{"query":"q","limit":10000000000000000000}': ["high:limit"], '{"query":"q","limit":1e300}': ["high:limit"], '{"query":"q","limit":0}': ["low:limit"], '{"query":"q","limit":-3.0}': ["low:limit"],
        '{"query":"q","limit":1.5}': ["type:limit"], '{"query":"q","limit":"1"}': ["type:limit"], '{"query":"q","limit":null}': ["type:limit"], '{"query":7,"limit":[1]}': ["type:limit", "type:query"],
        '{"query":"","limit":1}': ["short:query"], '{"limit":1}': ["missing:query"], "{}": ["missing:limit", "missing:query"], '{"query":"q","limit":1,"exact":"yes"}': ["type:exact"],
        '{"query":"q","limit":1,"z":0,"a":{}}': ["extra:a", "extra:z"], '{"query":"q","limit":1': ["invalid_json"], "[1]": ["invalid_json"], "7": ["invalid_json"], "": ["invalid_json"], "null": ["invalid_json"],
    }
    errors, _ = checked(spark, *cases, None)
    assert errors == [*cases.values(), ["invalid_json"]]
    assert checked(spark, '{"query":"q","limit":1}', name="fetch")[0] == [["unknown_tool"]]


def test_canonical_json(spark):
    cases = {
        '{"b":1.0,"a":1e0}': '{"a":1,"b":1}', '{"x":[1.50, -0.0, -0, 1E2, 2.5e-7, 0.00000025]}': '{"x":[1.5,0,0,100,2.5E-7,2.5E-7]}', '{"n":12345678901234567890}': '{"n":12345678901234567890}',
        '{"s":"1.0 \\"2.0\\" e5","t":"\\\\","u":3.0}': '{"s":"1.0 \\"2.0\\" e5","t":"\\\\","u":3}', '{"d":{"z":true,"a":null,"k-1.0":2.0}}': '{"d":{"a":null,"k-1.0":2,"z":true}}', "[]": "[]", '"a1.0"': '"a1.0"', "{": None,
    }
    assert checked(spark, *cases)[1] == list(cases.values())


def test_columns_that_clash_and_very_long_texts(spark):
    long = "w " * 2_000_000
    calls = spark.createDataFrame([(1, 0, 0, "a", "lookup", '{"query":"' + long + '","limit":1}', None)], CALLS).selectExpr("*", "1 AS nth", "2 AS level", "3 AS n_calls", "4 AS content", "5 AS called")
    results = spark.createDataFrame([(1, "a", long)], "conv_id long, call_id string, content string").selectExpr("*", "1 AS turn", "2 AS nth", "3 AS name")
    got = tool_calls.link_tool_calls(calls, results).collect()
    assert len(got) == 1 and got[0].status == "ok" and len(got[0].json) > 8_000_000
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0)).count() == 0


def test_hash_joins_and_native(spark):
    plan = tool_calls.op4_tool_calls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_registered_query_of_every_row(spark, as_table):
    """Each user turn is a row, each assistant turn's text is in just one, whatever repeats or has no identifier; the rows of
    the query with an SQL twin are among them."""
    from loamwork.llm import queries

    from .test_oracles import ODD_TURNS

    extra = [(4, 1, "assistant", "surplus"), (7, 0, "user", "again"), (7, 1, "assistant", "third"), (9, 101, "assistant", "of no call"), (None, 1, "assistant", "of none")]
    turns = [*ODD_TURNS, *extra]
    folder = as_table(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), "conversations")
    got = queries.queries()["op4_all_tool_calls"](spark, folder).collect()
    assert sum(r.name is not None for r in got) == sum(x[2] == "user" for x in turns)
    for text in ("a", "b", "x", "surplus", "third", "of no call", "of none"):
        assert sum(r.json.endswith(f'"result":"{text}"}}') for r in got) == sum(x[2:] == ("assistant", text) for x in turns) == 1
    assert {"duplicate_id", "extra_result", "missing_call", "null_id", "ok", "missing_result"} <= {r.status for r in got}
    first = queries.queries()["op4_tool_calls"](spark, folder)
    assert {tuple(r[c] for c in first.columns) for r in got} >= set(map(tuple, first.collect())) and first.count() < len(got)
