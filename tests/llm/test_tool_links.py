"""Tool-call linking: order, cycles, schemas, null and repeated rows."""

import random

from glyphmill.llm import tool_links

CALLS = "conv_id string, call_id string, position long, name string, arguments string, parents array<string>"
RESULTS = "conv_id string, call_id string, position long, content string"


def level_of(parents: dict[str, list[str]]) -> dict[str, int]:
    """Longest chains by repeated relaxation; -1 on and behind cycles."""
    known: dict[str, int] = {}
    while True:
        ready = [c for c, up in parents.items() if c not in known and all(p in known for p in up)]
        if not ready:
            return {c: known.get(c, -1) for c in parents}
        known |= {c: max([known[p] + 1 for p in parents[c]], default=0) for c in ready}


def linked(spark, parents: dict[str, list[str]]) -> dict[str, int]:
    rows = [("c", c, i, "t", "{}", up) for i, (c, up) in enumerate(parents.items())]
    got = tool_links.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {})
    found = {r.call_id: (r.level, r.errors) for r in got.collect()}
    assert all(("cycle" in e) == (lv < 0) for lv, e in found.values())
    return {c: lv for c, (lv, _) in found.items()}


def test_every_call_of_a_cycle_through_a_second_parent(spark):
    graph = {"a": [], "p": ["a", "q"], "q": ["p"], "behind": ["a", "q"], "apart": ["a"]}
    assert linked(spark, graph) == {"a": 0, "p": -1, "q": -1, "behind": -1, "apart": 1}


def test_random_graphs(spark):
    rng = random.Random(3)
    for back in (0.0, 0.03):
        graph: dict[str, list[str]] = {}
        for i in range(150):
            up = {f"n{rng.randrange(max(0, i - 9), i)}" for _ in range(rng.randrange(4))} if i else set()
            if rng.random() < back:
                up.add(f"n{rng.randrange(i, 150)}")
            graph[f"n{i}"] = sorted(up)
        assert linked(spark, graph) == level_of(graph)


def test_long_chain_of_two_parents_takes_few_jobs(spark):
    n = 10_000
    rows = [("c", str(i), i, "t", "{}", [str(j) for j in (i - 1, i - 3) if j >= 0]) for i in range(n)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = tool_links.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {}).collect()
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {int(r.call_id): r.level for r in got} == {i: i for i in range(n)} and jobs < 500


def test_nested_schemas(spark):
    schema = {
        "type": "object",
        "required": ["where", "tags"],
        "properties": {
            "where": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "zip": {"type": "integer"}}},
            "tags": {"type": "array", "items": {"type": "string"}},
            "unit": {"type": "string", "enum": ["c", "f"]},
            "limit": {"type": "number"},
        },
    }
    cases = {
        '{"where": {"city": "x"}, "tags": []}': "",
        '{"where": {"city": "x", "zip": 5}, "tags": ["a"], "unit": "c", "limit": 1.5}': "",
        '{"where": {"zip": "5"}, "tags": ["a", 1]}': "tags[] is no string; missing where.city; where.zip is no integer",
        '{"where": 3, "unit": "k", "limit": "no"}': "limit is no number; missing tags; unit is none of its values; where is no object",
        '{"tags": {}}': "tags is no array; missing where",
        "[1]": "not an object",
        "nonsense": "not an object",
    }
    calls = spark.createDataFrame([("c", str(i), i, "t", a, []) for i, a in enumerate(cases)] + [("c", "null", 99, "t", None, None)], CALLS)
    got = {r.call_id: r for r in tool_links.link_calls(calls, spark.createDataFrame([], RESULTS), {"t": schema}).collect()}
    for i, want in enumerate(cases.values()):
        assert got[str(i)].errors == want and got[str(i)].valid == (not want), (i, got[str(i)].errors)
    assert got["null"].errors == "not an object" and got["null"].json.startswith('{"arguments":null')


def test_null_empty_and_repeated_results(spark):
    calls = spark.createDataFrame([("c", "a", 0, "t", "{}", None), ("c", "b", 1, "t", "{}", [None, "a"]), ("c", "e", 2, "t", "{}", [])], CALLS).selectExpr("*", "1 AS node", "2 AS level", "'x' AS json")
    long = "word " * 200_000
    results = spark.createDataFrame([("c", "a", 3, "later"), ("c", "a", 1, "z"), ("c", "a", 1, "y"), ("c", "b", 2, None), ("c", "e", 5, long)], RESULTS)
    got = {r.call_id: r for r in tool_links.link_calls(calls, results, {}).collect()}
    assert got["a"].json.endswith('"result":"y"}') and got["b"].linked and got["b"].json.endswith('"result":null}') and got["b"].level == 1
    assert long in got["e"].json
