import json

from sightline.llm import tool_calls as T

CALLS = "conv_id long, call_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def run(spark, calls, results):
    c = spark.createDataFrame(calls, CALLS)
    r = spark.createDataFrame(results, RESULTS)
    return T.linked(c, r, T.tool_table(spark)).collect()


def args(**members):
    return json.dumps(members)


def test_links_layers_and_positions(spark):
    calls = [
        (1, "a", 9, "search", args(query="x", limit=3)), (1, "b", 1, "lookup", args(query="x", after="$a")), (1, "c", 2, "lookup", args(query="$b", after="$a")),
        (1, "d", 0, "search", args(query="$nobody $a")), (1, "e", 0, "search", args(query="$e")),
        (2, "a", 0, "lookup", args(query="y", after="$b")), (2, "b", 1, "lookup", args(query="y", after="$a")), (2, "c", 0, "lookup", args(query="z", after="$b")),
        (None, "a", 0, "search", args(query="n")),
    ]
    results = [(1, "a", 3, "found\n\"it\""), (1, "zz", 4, "nobody asked"), (None, "a", 1, None), (2, "a", 1, "r")]
    got = {(r.conv_id, r.call_id): r for r in run(spark, calls, results)}
    order = {k[1]: (r.position, r.layer) for k, r in got.items() if k[0] == 1}
    assert order == {"d": (1, 1), "e": (2, 1), "a": (3, 1), "b": (4, 2), "c": (5, 3), "zz": (None, None)}
    assert {k[1]: (r.position, r.layer) for k, r in got.items() if k[0] == 2} == {"a": (1, None), "c": (2, None), "b": (3, None)}
    assert got[1, "a"].status == "linked" and got[1, "b"].status == "pending" and got[1, "zz"].status == "orphan"
    assert got[None, "a"].status == "linked" and got[None, "a"].position == 1
    assert got[1, "e"].dangling == 1 and got[1, "d"].dangling == 1 and got[1, "c"].dangling == 0
    assert got[1, "a"].message == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"found\\n\\"it\\""}'
    assert all(json.loads(r.message) == json.loads(json.dumps(json.loads(r.message), sort_keys=True)) for r in got.values())


def test_faults(spark):
    cases = {
        args(query="x"): "", args(query="x", limit="3"): "type:limit", args(limit=3): "missing:query", args(query=None): "type:query",
        args(query="x", more=1): "unknown:more", "[1]": "malformed", "{broken": "malformed", None: "malformed", '{"query": 1.5, "z": {"b": 1, "a": [true]}}': "type:query,unknown:z",
    }
    calls = [(k, "a", 0, "search", a) for k, a in enumerate(cases)] + [(50, "a", 0, "nothing", "{}"), (51, "a", 0, None, "{}"), (52, None, 0, "search", args(query="x"))]
    calls += [(53, "a", 0, "count", args(query="x", limit=1.5, exact=True)), (54, "a", 0, "count", args(query="x", limit=2, exact=False))]
    got = {r.conv_id: r for r in run(spark, calls, [])}
    assert [got[k].faults for k in range(len(cases))] == list(cases.values())
    assert got[50].faults == got[51].faults == "tool" and got[52].valid and got[53].valid and got[54].valid and not got[50].valid
    assert got[8].message == '{"arguments":{"query":1.5,"z":{"a":[true],"b":1}},"id":"a","name":"search"}'
    assert json.loads(got[6].message)["arguments"] == "{broken"


def test_repeats_long_chains_and_empty_tables(spark):
    calls = [(1, "a", 2, "search", args(query="late")), (1, "a", 1, "search", args(query="first")), (1, "b", 3, "search", args(query="q")), (1, "b", 3, "search", args(query="q"))]
    results = [(1, "a", 9, "second"), (1, "a", 5, "first"), (1, "o", 1, "x"), (1, "o", 1, "x"), (1, None, 0, "n")]
    got = {(r.call_id): r for r in run(spark, calls, results)}
    assert len(got) == 4 and got["a"].repeated and got["b"].repeated and got["o"].repeated and got[None].status == "orphan"
    assert json.loads(got["a"].message) == {"arguments": {"query": "first"}, "id": "a", "name": "search", "result": "first"}
    chain = [(3, f"k{i}", 500 - i, "lookup", args(query="q", after=f"$k{i - 1}")) for i in range(1, 7)] + [(3, "k0", 900, "search", args(query="q"))]
    assert {r.call_id: r.position for r in run(spark, chain, [])} == {f"k{i}": i + 1 for i in range(7)}
    assert run(spark, [], []) == []
