"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are hash-joined (after a shuffle) by conversation and identifier, dependencies are resolved the same way, arguments are
validated against the tool's schema, and each linked call is serialised as canonical JSON (keys sorted at every level, no
white space). Topological order: a call's level is one more than that of the call it depends on, or 0, so (level, turn,
ordinal) puts every call after what it depends on. Levels come from pointer doubling, in as many joins as a chain's length
has binary digits. A dependency on an identifier that is missing, or of a call on a cycle, is broken, is reported and
carries no order.

An identifier that occurs more than once in a conversation has its calls and its results numbered, and the nth call is
linked with the nth result, so a join never multiplies rows and none is lost; dependencies mean the first call.

Statuses: the first error of the arguments, `unknown_tool`, `missing_result`, `ok`; `duplicate_id` (a call that is not the
first with its identifier), `extra_result` (more results than calls), `missing_call` (results without a call), `null_id`.

Numbers are validated and written by value: 1.0 and 1e0 are the integer 1, and 10^19 is a number that is too high.

Defined results: null identifiers link nothing; null or malformed arguments are `invalid_json`, and so are those longer
than a variant can be (128 MB); rows that occur twice are numbered like any others; extra columns are not read, whatever
they are called; an empty table gives an empty result. The registered query op4_tool_calls returns the first call of each
identifier only, as its SQL does; op4_all_tool_calls returns every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Tools and their arguments: type, and whether required; bounds hold for numbers, min_length for strings.
TOOLS = {
    "lookup": {
        "query": {"type": "string", "required": True, "min_length": 1},
        "limit": {"type": "integer", "required": True, "minimum": 1, "maximum": 50},
        "exact": {"type": "boolean", "required": False},
    }
}
#: How Spark names the type of a JSON value.
_TYPES = {"string": ["STRING"], "integer": ["BIGINT", "DECIMAL", "DOUBLE"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "boolean": ["BOOLEAN"], "null": ["VOID"]}


def argument_errors(name: Column, arguments: Column, tools: dict = TOOLS) -> Column:
    """The errors of a call's arguments (a JSON text) as an ordered array of strings; empty if it is valid. A number is an
    integer if it is whole, however it is written."""
    value = F.try_parse_json(F.coalesce(arguments, F.lit("")))
    found = F.coalesce(F.json_object_keys(F.when(value.isNotNull(), arguments)), F.array().cast("array<string>"))
    keys = F.array_sort(found)
    out = F.when(value.isNull() | F.json_object_keys(F.when(value.isNotNull(), arguments)).isNull(), F.array(F.lit("invalid_json")))
    for tool, schema in sorted(tools.items()):
        errors = []
        for key, rule in sorted(schema.items()):
            there = F.array_contains(found, key)
            kind = F.regexp_extract(F.schema_of_variant(F.variant_get(value, f"$['{key}']", "variant")), r"^[A-Z]+", 0)
            text = F.try_variant_get(value, f"$['{key}']", "string")
            number = text.try_cast("double")
            typed = F.coalesce(kind.isin(_TYPES[rule["type"]]), F.lit(False))
            if rule["type"] == "integer":
                typed = typed & F.coalesce(F.rint(number) == number, F.lit(False))
            if rule.get("required"):
                errors.append(F.when(~there, F.lit(f"missing:{key}")))
            errors.append(F.when(there & ~typed, F.lit(f"type:{key}")))
            if "min_length" in rule:
                errors.append(F.when(there & typed & (F.length(text) < rule["min_length"]), F.lit(f"short:{key}")))
            if "minimum" in rule:
                errors.append(F.when(there & typed & (number < rule["minimum"]), F.lit(f"low:{key}")))
            if "maximum" in rule:
                errors.append(F.when(there & typed & (number > rule["maximum"]), F.lit(f"high:{key}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(schema)))), lambda k: F.concat(F.lit("extra:"), k))
        out = out.when(name == tool, F.concat(F.array_compact(F.array(*errors)), extra))
    return out.otherwise(F.array(F.lit("unknown_tool")))


#: The pieces of a JSON text without white space: strings, numbers, and what stands between them.
_PIECES = r'"(?:[^"\\]|\\.)*+"|-?\d[\d.eE+-]*+|[^"\d-]++'


def canonical_number(x: Column) -> Column:
    """Equal numbers alike: whole ones of up to 15 digits as such, whatever is a double exactly enough as Spark writes a
    double, and what has more digits without a fraction's last zeros."""
    as_double = x.try_cast("double")
    whole = (F.abs(as_double) < 1e15) & (F.floor(as_double) == as_double)
    digits = F.length(F.regexp_replace(F.regexp_replace(x, r"[eE].*$", ""), r"^-?[0.]*|\.", ""))
    return (
        F.when(whole, as_double.cast("bigint").cast("string")).when(x.rlike(r"^-?\d+$"), x)
        .when((digits > 17) & ~x.rlike("[eE]"), F.regexp_replace(x, r"\.?0+$", "")).otherwise(as_double.cast("string"))
    )


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys, no white space and equal numbers written alike, or null if it is malformed."""
    sorted_ = F.to_json(F.try_parse_json(text))
    parts = F.transform(F.regexp_extract_all(sorted_, F.lit(_PIECES), F.lit(0)), lambda x: F.when(x.rlike(r"^-?\d"), canonical_number(x)).otherwise(x))
    # most texts have only whole numbers, which stay as they are
    return F.when(sorted_.rlike(r"\d[.eE]|-0"), F.array_join(parts, "")).otherwise(sorted_)


def _numbered(rows: DataFrame, order: list[Column], count: str) -> tuple[DataFrame, DataFrame]:
    """The rows with nth, their number among those of the same conversation and identifier, and how many those are; and
    the rows without either."""
    w = Window.partitionBy("conv_id", "call_id")
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    numbered = rows.filter(known).withColumns({"nth": F.row_number().over(w.orderBy(*order)), count: F.count("*").over(w)})
    return numbered, rows.filter(~known).withColumns({"nth": F.lit(1), count: F.lit(1).cast("long")})


def _hashed(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A hash join after a shuffle; `right` has one row for each key, of which a task's hash table holds its share."""
    return left.join(right.hint("shuffle_hash"), on, how)


def _doubled(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, up, depth): the calls of `edges(conv_id, call_id, depends_on)`, up null, depth the number of
    steps to the top; who never gets there has an `up` that lies on a cycle. Calls that are at the top meet no join."""
    state = written(edges.select("conv_id", "call_id", F.col("depends_on").alias("up"), F.lit(1).cast("long").alias("depth")), "call_steps")
    total, reach = state.count(), 1
    while reach <= total and not state.filter("up is not null").isEmpty():
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        step = _hashed(state.filter("up is not null"), above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("higher").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state, reach = written(step.union(state.filter("up is null")), "call_steps"), 2 * reach
    return state


def call_levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `calls(conv_id, call_id, depends_on)` with distinct identifiers: (conv_id, call_id, level) of each, and
    (conv_id, call_id) of those on a cycle, whose dependencies do not count."""
    nodes = written(calls.select("conv_id", "call_id", "depends_on"), "calls")
    edges = _hashed(nodes.filter("depends_on is not null"), nodes.select("conv_id", F.col("call_id").alias("depends_on")), ["conv_id", "depends_on"], "left_semi")
    state = _doubled(edges)
    cycles = written(state.filter("up is not null").select("conv_id", F.col("up").alias("call_id")).distinct(), "call_cycles")
    if not cycles.isEmpty():
        state = _doubled(_hashed(edges, cycles, ["conv_id", "call_id"], "left_anti"))
    return _hashed(nodes, state, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("depth", F.lit(0)).alias("level")), cycles


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """`calls(conv_id, turn, ordinal, call_id, name, arguments, depends_on)` and `results(conv_id, call_id, content)` to
    one row for each call, and for each result without one; in order within a conversation by (level, turn, ordinal)."""
    place = F.struct("turn", "ordinal", "name", "arguments", "depends_on")
    calls = calls.select("conv_id", "turn", "ordinal", "call_id", "name", "arguments", "depends_on")
    called, loose_calls = _numbered(calls, [place], "n_calls")
    answered, loose_results = _numbered(results.select("conv_id", "call_id", "content"), [F.asc_nulls_last("content")], "n_results")
    called = written(called, "numbered_calls").withColumn("called", F.lit(True))
    ids = ["conv_id", "call_id"]
    count_calls = called.filter("nth = 1").select(*ids, F.col("n_calls").alias("all_calls"))
    count_results = answered.filter("nth = 1").select(*ids, F.col("n_results").alias("all_results"))
    answers = _hashed(_hashed(answered.drop("n_results"), count_calls, ids, "left"), count_results.withColumnRenamed("all_results", "n_results"), ids, "inner")
    linked = _hashed(_hashed(called, count_results, ids, "left"), answers, [*ids, "nth"], "full")
    linked = linked.withColumns({"n_calls": F.coalesce("n_calls", "all_calls"), "n_results": F.coalesce("n_results", "all_results")}).drop("all_calls", "all_results")
    linked = linked.unionByName(loose_calls.withColumn("called", F.lit(True)), allowMissingColumns=True).unionByName(loose_results, allowMissingColumns=True)
    levels, cycles = call_levels(called.filter("nth = 1"))
    linked = written(linked, "linked_calls")
    # what depends on nothing, often most calls, would all meet in one task
    bound = _hashed(linked.filter("depends_on is not null"), levels.select("conv_id", F.col("call_id").alias("depends_on"), "level"), ["conv_id", "depends_on"], "left")
    bound = _hashed(bound, cycles.withColumns({"nth": F.lit(1), "cyclic": F.lit(True)}), [*ids, "nth"], "left")
    linked = bound.unionByName(linked.filter("depends_on is null"), allowMissingColumns=True)
    holds = F.col("level").isNotNull() & F.col("cyclic").isNull() & F.col("call_id").isNotNull()
    there = F.coalesce("called", F.lit(False))
    errors = F.when(there, argument_errors(F.col("name"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>"))
    linked = linked.withColumns({"errors": errors, "after": F.when(holds, F.col("depends_on"))})
    first = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.lit("null_id")).when(there & (F.col("nth") > 1), F.lit("duplicate_id"))
    first = first.when(~there, F.when(F.col("n_calls").isNull(), F.lit("missing_call")).otherwise(F.lit("extra_result")))
    status = first.when(F.size("errors") > 0, F.element_at("errors", 1)).when(F.col("n_results").isNull(), F.lit("missing_result")).otherwise(F.lit("ok"))
    arguments = F.coalesce(canonical(F.col("arguments")), F.lit("null"))
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    bare = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2))
    line = F.concat(
        F.lit('{"after":'), bare(F.col("after")), F.lit(',"arguments":'), arguments, F.lit(',"id":'), bare(F.col("call_id")),
        F.lit(',"name":'), bare(F.col("name")), F.lit(',"result":'), bare(F.col("content")), F.lit("}"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return linked.select(
        "conv_id", "turn", "ordinal", "call_id", "nth", "name", "after", (F.col("depends_on").isNotNull() & F.col("after").isNull()).alias("broken_dependency"),
        F.when(there, F.when(holds, F.col("level") + 1).otherwise(F.lit(0))).cast("long").alias("level"), count("n_calls"), count("n_results"), F.array_join("errors", ",").alias("errors"), status.alias("status"), line.alias("json"),
    )


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain turns. Each user turn is a call and the assistant turn after it its result. The
    tool is `lookup`, for every fourth user turn of a conversation `fetch`, which is unknown; its query is the text and its
    limit the number of words. By conversation, the arguments are cut short, hold the limit as a string, have a key too
    many, write the limit as a fraction, or are in order; and a call depends on the user turn two before it, on the one two
    after it, or in such a way that there are cycles of two calls and of one, and a call that hangs on one."""
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn, nth, kind, way = F.col("turn"), F.floor(F.col("turn") / 2), F.pmod("conv_id", F.lit(7)), F.pmod("conv_id", F.lit(4))
    limit = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("string")
    limit = F.when(kind == 1, F.concat(F.lit('"'), limit, F.lit('"'))).when(kind == 3, F.concat(limit, F.lit(".0"))).otherwise(limit)
    query = F.to_json(F.struct(F.col("text").alias("query")))
    head = F.when(F.col("text").isNull(), F.lit("{")).otherwise(F.concat(F.substring(query, F.lit(1), F.length(query) - 1), F.lit(",")))
    arguments = F.concat(head, F.lit('"limit":'), limit, F.when(kind == 2, F.lit(',"page":1')).otherwise(F.lit("")), F.when(kind == 0, F.lit("")).otherwise(F.lit("}")))
    back, on = F.when(turn >= 2, turn - 2), turn + 2
    depends = F.when(way < 2, back).when(way == 2, on).when((way == 3) & (nth == 0), on).when((way == 3) & (nth == 3), turn).when(way == 3, back)
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("ordinal"), name(turn).alias("call_id"), F.when(nth == 3, F.lit("fetch")).otherwise(F.lit("lookup")).alias("name"), arguments.alias("arguments"), name(depends).alias("depends_on")
    )
    results = turns.filter("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op4_all_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Every call and every result, with nth: repeated calls, results too many or without a call, and rows without ids too."""
    return link_tool_calls(*from_turns(table(spark, sf_dir, "conversations")))


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    """The rows that OP4_SQL has: the first call of each identifier."""
    linked = op4_all_tool_calls(spark, sf_dir)
    return linked.filter("nth = 1 and status not in ('null_id', 'missing_call')").drop("nth")


OP4_SQL = r"""
WITH RECURSIVE c0 AS (
  SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, CASE WHEN turn // 2 = 3 THEN 'fetch' ELSE 'lookup' END AS name, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS lim, ((conv_id % 7) + 7) % 7 AS kind, ((conv_id % 4) + 4) % 4 AS way
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
c1 AS (
  SELECT *, 'call_' || conv_id || '_' || CASE WHEN way < 2 AND turn >= 2 THEN turn - 2 WHEN way = 2 OR way = 3 AND turn // 2 = 0 THEN turn + 2
                                              WHEN way = 3 AND turn // 2 = 3 THEN turn WHEN way = 3 AND turn >= 2 THEN turn - 2 END AS depends_on,
         '{' || CASE WHEN text IS NULL THEN '' ELSE '"query":' || to_json(text)::VARCHAR || ',' END || '"limit":' || lim AS sorting FROM c0),
c2 AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n_calls, row_number() OVER (PARTITION BY call_id ORDER BY sorting) AS k FROM c1),
c AS (SELECT * FROM c2 WHERE k = 1),
e AS (SELECT c.call_id AS a, c.depends_on AS b FROM c JOIN c d ON d.call_id = c.depends_on),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
v AS (SELECT a, b FROM e WHERE a NOT IN (SELECT a FROM reach WHERE a = b)),
above AS (SELECT a, b FROM v UNION SELECT above.a, v.b FROM above JOIN v ON v.a = above.b),
levels AS (SELECT a, count(*) AS level FROM above GROUP BY a),
r AS (SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1),
l AS (SELECT c.*, r.content, r.n_results, v.b AS after, coalesce(levels.level, 0)::BIGINT AS level,
             CASE WHEN kind = 0 THEN 'invalid_json' WHEN name = 'fetch' THEN 'unknown_tool'
                  ELSE concat_ws(',', CASE WHEN kind = 1 THEN 'type:limit' WHEN lim < 1 THEN 'low:limit' WHEN lim > 50 THEN 'high:limit' END,
                                 CASE WHEN text IS NULL THEN 'missing:query' WHEN length(text) < 1 THEN 'short:query' END, CASE WHEN kind = 2 THEN 'extra:page' END) END AS errors
      FROM c LEFT JOIN r USING (call_id) LEFT JOIN v ON v.a = c.call_id LEFT JOIN levels ON levels.a = c.call_id)
SELECT conv_id, turn, 0 AS ordinal, call_id, name, after, depends_on IS NOT NULL AND after IS NULL AS broken_dependency, level,
       n_calls, coalesce(n_results, 0)::BIGINT AS n_results, errors,
       CASE WHEN errors <> '' THEN split_part(errors, ',', 1) WHEN n_results IS NULL THEN 'missing_result' ELSE 'ok' END AS status,
       '{"after":' || coalesce(to_json(after)::VARCHAR, 'null') || ',"arguments":'
       || CASE WHEN kind = 0 THEN 'null' ELSE '{"limit":' || CASE WHEN kind = 1 THEN '"' || lim || '"' ELSE lim::VARCHAR END || CASE WHEN kind = 2 THEN ',"page":1' ELSE '' END
               || CASE WHEN text IS NULL THEN '' ELSE ',"query":' || to_json(text)::VARCHAR END || '}' END
       || ',"id":' || to_json(call_id)::VARCHAR || ',"name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM l
"""
