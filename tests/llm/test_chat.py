"""Linking, order, validation and JSON on cases with known results."""

import random

from facsimile.llm.chat import link_tools

CALLS = "conv_id long, turn long, position int, call_id string, name string, arguments string, depth string"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"
SCHEMAS = "name string, argument string, type string, required boolean"
TOOLS = [("find", "query", "string", True), ("find", "limit", "integer", False), ("find", "ratio", "number", False), ("list", None, None, None)]


def run(spark, calls, results):
    frames = (
        spark.createDataFrame([(*c, "x") for c in calls], CALLS),
        spark.createDataFrame([(*r, "y") for r in results], RESULTS),
        spark.createDataFrame(TOOLS, SCHEMAS),
    )
    found = link_tools(*frames)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return {(r.conv_id, r.call_id): r for r in found.collect()}


def test_linking(spark):
    calls = [
        (1, 0, 0, "a", "find", '{ "query" : "é\\"x", "limit":3 , "ratio": 2}'),
        (1, 0, 1, "b", "find", '{"query":{"$ref":"a"},"ratio":0.5}'),
        (1, 2, 0, "c", "find", '{"query":{"$ref":"b"},"limit":{"$ref":"a"}}'),
        (1, 2, 0, "c", "find", '{"query":{"$ref":"b"},"limit":{"$ref":"a"}}'),
        (1, 3, 0, "open", "list", "{}"),
        (2, 0, 0, "a", "find", '{"limit":"3","more":[1, {"z":1,"y":null}]}'),
        (2, 0, 1, "p", "find", '{"query":{"$ref":"q"}}'),
        (2, 0, 2, "q", "find", '{"query":{"$ref":"p"}}'),
        (2, 0, 3, "behind", "find", '{"query":{"$ref":"q"}}'),
        (2, 0, 4, "gone", "find", '{"query":{"$ref":"nobody"}}'),
        (2, 1, 0, "broken", "find", '{"query":'),
        (2, 1, 1, "list", "find", "[1]"),
        (2, 1, 2, "none", "find", None),
        (2, 1, 3, "tool", "what", "{}"),
        (2, 1, 4, "noname", None, "{}"),
        (None, 1, 0, "a", "find", "{}"),
        (3, 1, 0, None, "find", "{}"),
        (4, None, None, "n", "list", "{}"),
    ]
    results = [(1, 1, "a", "found"), (1, 3, "a", "again"), (1, 1, "b", ""), (1, 4, "c", None), (2, 1, "a", "r" * 100_000), (1, 9, "lost", "z"), (None, 1, "a", "")]
    got = run(spark, calls, results)
    assert {k: r.depth for k, r in got.items()} == {
        (1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "open"): 0, (1, "lost"): None, (2, "a"): 0, (2, "p"): None, (2, "q"): None,
        (2, "behind"): None, (2, "gone"): 0, (2, "broken"): 0, (2, "list"): 0, (2, "none"): 0, (2, "tool"): 0, (2, "noname"): 0, (4, "n"): 0,
    }
    assert {k for k, r in got.items() if r.status == "linked"} == {(1, "a"), (1, "b"), (1, "c"), (2, "a")}
    assert got[1, "lost"].status == "orphan" and got[1, "open"].status == "open"
    assert (got[1, "a"].n_results, got[1, "c"].n_calls) == (2, 2)
    problems = {k: r.problems for k, r in got.items() if r.problems}
    assert problems == {
        (2, "a"): ["missing:query", "type:limit", "unknown:more"], (2, "broken"): ["json", "missing:query"], (2, "list"): ["json", "missing:query"],
        (2, "none"): ["json", "missing:query"], (2, "tool"): ["tool"], (2, "noname"): ["tool"],
    }
    assert got[1, "a"].json == '{"arguments":{"limit":3,"query":"é\\"x","ratio":2},"depth":0,"id":"a","name":"find","result":"found","turn":0}'
    assert '"arguments":{"limit":"3","more":[1,{"y":null,"z":1}]}' in got[2, "a"].json
    assert got[1, "lost"].json == '{"id":"lost","result":"z"}'


def test_depths_of_random_graphs(spark):
    rng = random.Random(6)
    calls, needs = [], {}
    for conv in range(6):
        for i in range(40):
            if conv < 3:  # forwards only; conversation 0 is one chain
                targets = [i - 1] * (i > 0) if conv == 0 else rng.sample(range(i), min(i, rng.choice([0, 1, 1, 2, 3])))
            else:
                targets = rng.sample(range(45), rng.choice([0, 1, 1, 1, 2]))
            needs[conv, i] = {t for t in targets if t < 40}
            values = ", ".join(f'"a{n}": {{"$ref": "c{t}"}}' for n, t in enumerate(targets))
            calls.append((conv, i, 0, f"c{i}", "find", "{" + values + "}"))

    def depth(node, above=()):
        if node in above:
            return None
        below = [depth((node[0], t), (*above, node)) for t in needs[node]]
        return None if None in below else 1 + max(below, default=-1)

    rng.shuffle(calls)
    got = run(spark, calls, [])
    assert {k: r.depth for k, r in got.items()} == {(c, f"c{i}"): depth((c, i)) for c, i in needs}
    assert got[0, "c39"].depth == 39


def test_no_rows(spark):
    assert run(spark, [], []) == {}
    assert len(run(spark, [], [(1, 1, "a", "x")])) == 1
