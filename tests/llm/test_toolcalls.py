"""Levels of tool calls against brute force, and long chains."""

import json
import random
import time

from mendlake.llm import toolcalls


def brute(rows):
    """Level by repeated passes over all calls; calls on or behind a cycle get none."""
    deps = {(c, i): [(c, d) for d in ds or () if (c, d) in {(a, b) for a, b, _ in rows if a == c}] for c, i, ds in rows}
    level = {}
    while True:
        new = {k: 1 + max((level[d] for d in ds), default=-1) for k, ds in deps.items() if k not in level and all(d in level for d in ds)}
        if not new:
            return level
        level |= new


def levels(spark, rows):
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends array<string>")
    return {(r["conv_id"], r["call_id"]): r["level"] for r in toolcalls.levels(calls).collect()}


def test_random_graphs(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        n = rng.randrange(1, 14)
        for i in range(n):
            before = [f"k{rng.randrange(n if conv % 3 == 0 else max(1, i))}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
            rows.append((conv, f"k{i}", None if conv % 7 == 0 and not before else before + ["nowhere"] * (i % 2)))
    want = brute(rows)
    assert levels(spark, rows) == want and 0 < len(want) < len(rows)


def test_long_chain_ladder_and_hub(spark):
    chain = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(2000)]
    loop = [(2, f"l{i}", [f"l{(i + 1) % 50}"]) for i in range(50)] + [(2, "behind", ["l3"])]
    ladder = [(3, f"d{i}", [f"d{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(8)]
    hub = [(4, "hub", [])] + [(4, f"h{i}", ["hub"]) for i in range(500)] + [(4, "all", [f"h{i}" for i in range(500)])]
    began = time.perf_counter()
    got = levels(spark, chain + loop + ladder + hub)
    assert time.perf_counter() - began < 120
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, f"c{i}"): i for i in range(2000)}
    assert not [k for k in got if k[0] == 2]
    assert [got[3, f"d{i}"] for i in range(8)] == list(range(8))
    assert got[4, "all"] == 2 and got[4, "h7"] == 1


def test_arguments_are_strict_json(spark):
    """One value and nothing else; integers by value; what doesn't come back is refused."""
    cases = [
        ('{"q": "a"}', "", '{"q":"a"}'), ('{"q":"a"} x', "json", None), ('{"q":"a"}]', "json", None), ('{"q":"a"}}', "json", None), ('{"q":"a"},{"q":"b"}', "json", None),
        ('{"q":"a"},"y":{"q":"b"}', "json", None), (' {"q" : "a" } \n', "", '{"q":"a"}'), ('{"q":"a","n":1e400}', "json", None), ('{"q":"a","n":1.0}', "", '{"n":1,"q":"a"}'),
        ('{"q":"a","n":3e0}', "", None), ('{"q":"a","n":1.5}', "type:n", '{"n":1.5,"q":"a"}'), ('{"q":"a","n":"1"}', "type:n", '{"n":"1","q":"a"}'), ('{"q":"Infinity"}', "", '{"q":"Infinity"}'),
        ('{"q":"a","n":' + "1" * 1500 + "}", "json", None), ("[" * 1500 + "]" * 1500, "json", None), ("[1]", "json", None), ("", "json", None), (None, "json", None), ('{"q":1}', "type:q", '{"q":1}'),
        ('{"q":"a","n":12345678901234567890}', "", '{"n":12345678901234567890,"q":"a"}'), ('{"q":"] } \\" x"}', "", '{"q":"] } \\" x"}'),
    ]
    calls = spark.createDataFrame([(1, f"c{i}", i, "t", a, []) for i, (a, _, _) in enumerate(cases)], "conv_id long, call_id string, turn long, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r["turn"]: r for r in toolcalls.link(calls, results, {"t": [toolcalls.Param("q", "string"), toolcalls.Param("n", "integer", required=False)]}).collect()}
    for i, (given, errors, kept) in enumerate(cases):
        assert got[i]["errors"] == errors, (given, got[i]["errors"])
        if kept is not None:
            assert f'"arguments":{kept},' in got[i]["json"], (given, got[i]["json"])
        elif errors == "json" and given:
            assert json.loads(got[i]["json"])["arguments"] == given or given.startswith("[1")
