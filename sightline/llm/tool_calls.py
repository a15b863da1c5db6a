"""Chat formatting of tool calls: links calls and results, orders calls after those they refer to, checks arguments
against the tools' schemas and writes canonical JSON.

Method. Calls and results meet in a hash join on (conversation, identifier). A call refers to another one by a string value
``$identifier`` among its arguments. Calls without open references form layer 1; a call's layer is one more than the
highest of those it refers to, found layer by layer. Arguments are parsed as variants and their members compared with
the tool's parameters. Messages are JSON without blanks, with sorted keys.

Scale. DataFrame functions only. Each layer is one join of the open references with the layer before it, written to the shared folder,
so the number of jobs is the length of the longest chain of references and the work of each is what is still open. A
conversation with a third of all calls is never gathered: a row is one call, and positions are counted within
(layer, ``BLOCK`` turns) and shifted by the sizes of the blocks before.

References to unknown calls, and of a call to itself, do not hold a call back; they are counted as dangling. Calls in a circle, and calls
that wait for them, have no layer, come last, and are marked. Of several calls with one identifier in a conversation the first by
turn, name and arguments counts, of several results the first by turn and text; both are marked as repeated. Results without a call are
rows of their own. Null conversations form one conversation; calls and results with a null identifier are never linked. Null or malformed
arguments are invalid and written as text. Calls of unknown tools are invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import written
from sightline.operators.skew import ordinal

BLOCK = 64
#: parameter type -> what a variant of that type is called
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def _first(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each (conv_id, call_id) by ``order``, with the number of rows; null identifiers stay apart."""
    rest = [c for c in df.columns if c not in ("conv_id", "call_id")]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    named = df.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(pick, F.count(F.lit(1)).alias("copies"))
    return named.select("conv_id", "call_id", "_row.*", "copies").unionByName(df.filter("call_id IS NULL").withColumn("copies", F.lit(1).cast("long")))


def layers(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, layer, dangling) of every named call; layer is null in and behind circles."""
    named = calls.filter("call_id IS NOT NULL")
    nodes = named.select("conv_id", "call_id")
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'"\$([^"\\]+)"'), F.lit(1))))
    refs = named.select("conv_id", "call_id", found.alias("to"))
    known = nodes.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_to"))
    marked = written(refs.join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("to") == F.col("_to")), "left").select(
        "conv_id", "call_id", "to", (F.col("_to").isNotNull() & (F.col("to") != F.col("call_id"))).alias("real")
    ), "references")
    dangling = marked.groupBy("conv_id", "call_id").agg(F.count_if(~F.col("real")).alias("dangling"), F.count_if("real").alias("open"))
    on = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["call_id"] == b["call_id"])
    state = nodes.join(dangling, on(nodes, dangling), "left").select(
        nodes["conv_id"], nodes["call_id"], F.coalesce("dangling", F.lit(0)).alias("dangling"), F.coalesce("open", F.lit(0)).alias("open")
    )
    edges = marked.filter("real").select(F.col("conv_id").alias("_c"), F.col("to").alias("_to"), "call_id")
    done = written(state.filter("open = 0").select("conv_id", "call_id", F.lit(1).alias("layer")), "layer")
    waiting = written(state.filter("open > 0").select("conv_id", "call_id", "open"), "waiting")
    parts, last, layer = [done], done, 1
    while waiting.limit(1).count():
        freed = last.select("conv_id", F.col("call_id").alias("to")).join(edges, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("to") == F.col("_to"))).groupBy("conv_id", "call_id").agg(
            F.count(F.lit(1)).alias("freed")
        )
        rest = written(waiting.join(freed, on(waiting, freed), "left").select(waiting["conv_id"], waiting["call_id"], (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")), "waiting")
        layer += 1
        last = rest.filter("open = 0").select("conv_id", "call_id", F.lit(layer).alias("layer"))
        if not last.limit(1).count():
            break
        parts.append(last)
        waiting = rest.filter("open > 0")
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    return state.join(ranked, on(state, ranked), "left").select(state["conv_id"], state["call_id"], "layer", "dangling")


def faults(members: Column, parameters: Column) -> Column:
    """What is wrong with the members of a call (map of variants), by parameter (array of name, type, required)."""
    value = lambda p: F.get(F.map_values(members), F.array_position(F.map_keys(members), p["name"]).cast("int") - 1)
    pattern = lambda p: F.coalesce(*[F.when(p["type"] == k, F.lit(f"^({v})$")) for k, v in TYPES.items()], F.lit(".*"))
    kind = lambda p: F.coalesce(F.schema_of_variant(value(p)), F.lit("VOID"))
    has = lambda p: F.array_contains(F.map_keys(members), p["name"])
    wrong = F.transform(parameters, lambda p: F.when(has(p) & ~F.regexp_like(kind(p), pattern(p)), F.concat(F.lit("type:"), p["name"])).when(
        ~has(p) & p["required"], F.concat(F.lit("missing:"), p["name"])
    ))
    unknown = F.transform(F.array_except(F.map_keys(members), F.transform(parameters, lambda p: p["name"])), lambda k: F.concat(F.lit("unknown:"), k))
    return F.array_sort(F.concat(F.filter(wrong, lambda x: x.isNotNull()), unknown))


def linked(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each call, in order, and for each result without a call.

    ``calls`` (conv_id, call_id, turn, name, arguments: JSON text), ``results`` (conv_id, call_id, turn, content), ``tools`` (name,
    parameters: array of struct of name, type, required). Columns: conv_id, call_id, position (from 1, null for lone
    results), layer, status (linked, pending, orphan), repeated, dangling, valid, faults, message (canonical JSON).
    """
    calls = _first(calls.select("conv_id", "call_id", "turn", "name", "arguments"), ["turn", "name", "arguments"])
    results = _first(results.select("conv_id", "call_id", "turn", "content"), ["turn", "content"])
    order = layers(calls)
    r = results.select(F.col("conv_id").alias("_rc"), F.col("call_id").alias("_ri"), "content", F.col("copies").alias("_rn"))
    o = order.select(F.col("conv_id").alias("_oc"), F.col("call_id").alias("_oi"), "layer", "dangling")
    match = lambda c, i: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("call_id") == F.col(i))
    both = calls.join(r, match("_rc", "_ri"), "left").join(o, match("_oc", "_oi"), "left")
    params = tools.select("name", "parameters").dropDuplicates(["name"]).select(F.col("name").alias("_tool"), "parameters")
    both = both.join(params, F.col("name") == F.col("_tool"), "left").withColumn("members", F.from_json("arguments", "map<string,variant>"))
    wrong = F.when(F.col("_tool").isNull(), F.array(F.lit("tool"))).when(F.col("members").isNull(), F.array(F.lit("malformed"))).otherwise(faults(F.col("members"), F.col("parameters")))
    parsed = F.try_parse_json(F.coalesce("arguments", F.lit("")))
    member = lambda key, json: F.when(json.isNotNull(), F.concat(F.lit(f'"{key}":'), json))
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    message = F.concat(F.lit("{"), F.concat_ws(
        ",", member("arguments", F.coalesce(F.to_json(parsed), F.when(F.col("arguments").isNotNull(), text(F.col("arguments"))))),
        member("id", F.when(F.col("call_id").isNotNull(), text(F.col("call_id")))), member("name", F.when(F.col("name").isNotNull(), text(F.col("name")))),
        member("result", F.when(F.col("content").isNotNull(), text(F.col("content")))),
    ), F.lit("}"))
    placed = both.select(
        "conv_id", "call_id", F.coalesce("layer", F.when(F.col("call_id").isNull(), 1), F.lit(2147483647)).alias("_layer"), "turn", "layer",
        F.when(F.col("_rn").isNotNull(), "linked").otherwise("pending").alias("status"),
        ((F.col("copies") > 1) | (F.coalesce("_rn", F.lit(1)) > 1)).alias("repeated"), F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"),
        F.array_join(wrong, ",").alias("faults"), message.alias("message"),
    ).withColumn("valid", F.col("faults") == "")
    block = F.struct("_layer", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    numbered = ordinal(placed, ["conv_id"], ["_layer", "turn", "call_id", "message"], "position", block)
    c = calls.select(F.col("conv_id").alias("_cc"), F.col("call_id").alias("_ci"))
    lone = results.join(c, match("_cc", "_ci"), "left_anti").select(
        "conv_id", "call_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("int").alias("layer"), F.lit("orphan").alias("status"),
        (F.col("copies") > 1).alias("repeated"), F.lit(0).cast("long").alias("dangling"), F.lit(False).alias("valid"), F.lit("call").alias("faults"),
        F.concat(F.lit("{"), F.concat_ws(",", member("id", F.when(F.col("call_id").isNotNull(), text(F.col("call_id")))), member("result", F.when(F.col("content").isNotNull(), text(F.col("content"))))), F.lit("}")).alias("message"),
    )
    columns = ["conv_id", "call_id", "position", "layer", "status", "repeated", "dangling", "valid", "faults", "message"]
    return numbered.withColumn("position", F.col("position").cast("long")).select(*columns).unionByName(lone.select(*columns))


# ---- calls and results in plain conversations -----------------------------------------------------------------

TOOLS = {
    "search": (("query", "string", True), ("limit", "integer", False)),
    "lookup": (("query", "string", True), ("after", "string", True), ("limit", "integer", False)),
    "count": (("query", "string", True), ("limit", "number", True), ("exact", "boolean", True)),
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that turns (conv_id, turn, role, text) stand for: an assistant's turn is a call whose query is its whole text,
    the user's turn after it brings the result. Name, limit and reference to the call two turns before follow from the text's length."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    own = turns.select("conv_id", "turn", "role", "text", n.alias("n"))
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("n") % 3 + 1).cast("int"))
    quoted = F.regexp_extract(F.to_json(F.array(F.coalesce("text", F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    limit = F.when(F.col("n") % 7 == 0, F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('"'))).otherwise(F.col("n").cast("string"))
    after = F.when((F.col("n") % 2 == 0) & (F.col("turn") >= 2), F.concat(F.lit(', "after": "$c'), (F.col("turn") - 2).cast("string"), F.lit('"')))
    arguments = F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": '), limit, F.coalesce(after, F.lit("")), F.lit("}"))
    calls = own.filter("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"))
    results = own.filter("role = 'user' AND turn >= 1").select("conv_id", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def tool_table(spark) -> DataFrame:
    param = lambda p: F.struct(*[F.lit(x).alias(c) for c, x in zip(("name", "type", "required"), p, strict=True)])
    rows = [F.struct(F.lit(name).alias("name"), F.array(*map(param, params)).alias("parameters")) for name, params in TOOLS.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("tool")).select("tool.*")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, length(coalesce(text, '')) AS n FROM conversations),
a AS (SELECT conv_id, turn, n, 'c' || turn AS call_id, ['search', 'lookup', 'count'][n % 3 + 1] AS name, to_json(coalesce(text, ''))::VARCHAR AS q,
  CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END AS lim, CASE WHEN n % 2 = 0 AND turn >= 2 THEN '$c' || (turn - 2) END AS ref FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text FROM t WHERE role = 'user' AND turn >= 1),
b AS (SELECT a.*, d.call_id AS dep FROM a LEFT JOIN a AS d ON d.conv_id = a.conv_id AND '$' || d.call_id = a.ref),
l AS (SELECT conv_id, call_id, 1 AS layer FROM b WHERE dep IS NULL UNION ALL SELECT b.conv_id, b.call_id, l.layer + 1 FROM b JOIN l ON l.conv_id = b.conv_id AND l.call_id = b.dep),
c AS (SELECT b.*, l.layer, r.call_id IS NOT NULL AS has, r.text AS result,
  list_sort(list_filter([CASE WHEN name <> 'count' AND n % 7 = 0 THEN 'type:limit' END, CASE WHEN name = 'count' AND n % 7 = 0 THEN 'type:limit' END,
    CASE WHEN name = 'lookup' AND ref IS NULL THEN 'missing:after' END, CASE WHEN name <> 'lookup' AND ref IS NOT NULL THEN 'unknown:after' END,
    CASE WHEN name = 'count' THEN 'missing:exact' END], lambda x: x IS NOT NULL)) AS wrong
  FROM b JOIN l USING (conv_id, call_id) LEFT JOIN r ON r.conv_id = b.conv_id AND r.call_id = b.call_id)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY layer, turn) AS position, layer, CASE WHEN has THEN 'linked' ELSE 'pending' END AS status,
  false AS repeated, (ref IS NOT NULL AND dep IS NULL)::BIGINT AS dangling, len(wrong) = 0 AS valid, array_to_string(wrong, ',') AS faults,
  '{"arguments":{' || coalesce('"after":"' || ref || '",', '') || '"limit":' || lim || ',"query":' || q || '},"id":"' || call_id || '","name":"' || name || '"' ||
  coalesce(',"result":' || to_json(result)::VARCHAR, '') || '}' AS message FROM c
UNION ALL SELECT conv_id, call_id, NULL, NULL, 'orphan', false, 0, false, 'call', '{"id":"' || call_id || '"' || coalesce(',"result":' || to_json(text)::VARCHAR, '') || '}'
FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = r.conv_id AND a.call_id = r.call_id)
"""
