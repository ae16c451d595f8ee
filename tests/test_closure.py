from __future__ import annotations

import random

from docgraph.operators.graph import closure


def brute(pairs: list[tuple]) -> dict[tuple, int]:
    above: dict = {}
    for c, p in pairs:
        if c is not None and p is not None:
            above.setdefault(c, set()).add(p)
    out = {}
    for start in above:
        level, seen, k = set(above[start]), {}, 1
        while level - set(seen):
            for x in level - set(seen):
                seen[x] = k
            level, k = {p for x in level for p in above.get(x, ())}, k + 1
        out |= {(start, x): n for x, n in seen.items()}
    return out


def of(spark, pairs: list[tuple]) -> dict[tuple, int]:  # noqa: ANN001
    rows = closure(spark.createDataFrame(pairs, "child string, parent string")).collect()
    assert len({(r.child, r.ancestor) for r in rows}) == len(rows)
    return {(r.child, r.ancestor): r.steps for r in rows}


def test_a_chain_of_a_thousand(spark) -> None:  # noqa: ANN001
    found = closure(spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(1000)], "child string, parent string"))
    assert found.count() == 1000 * 1001 // 2
    assert found.filter("child = 't0' AND ancestor = 't1000'").first().steps == 1000


def test_cycles_branches_and_nulls(spark) -> None:  # noqa: ANN001
    assert of(spark, [("a", "b"), ("b", "c"), ("c", "a")]) == brute([("a", "b"), ("b", "c"), ("c", "a")])
    r = random.Random(6)
    pairs = [(str(r.randrange(40)), str(r.randrange(40))) for _ in range(70)] + [("x", None), (None, "y"), ("0", "1"), ("0", "1")]
    assert of(spark, pairs) == brute(pairs)
    assert of(spark, []) == {}


def test_one_parent_each_needs_no_comparison(spark, monkeypatch) -> None:  # noqa: ANN001
    from docgraph.operators import graph

    plans, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label))
    tree = [(f"{k}", f"{k // 3}") for k in range(1, 200)]
    assert of(spark, tree) == brute(tree)
    assert len(plans) > 3 and not any("LeftAnti" in p for p in plans)
    for tail in ([("0", "199")], [("0", "0"), ("x", "0")]):  # cycles of two lengths, with ways into them
        assert of(spark, tree + tail) == brute(tree + tail)
