"""Matching that stays linear: hot blocks, the index of similar values, and paths between entities."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docgraph.operators import build, graph, resolve
from tests.test_resolve import COLUMNS, people


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def clusters_of(ids, links) -> set:  # noqa: ANN001
    root = {i: i for i in ids}

    def find(x):  # noqa: ANN001, ANN202
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out: dict = {}
    for i in ids:
        out.setdefault(find(i), set()).add(i)
    return {frozenset(v) for v in out.values() if len(v) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_those_of_all_pairs(spark, seed: int) -> None:  # noqa: ANN001
    rng = random.Random(seed)
    names = [f"{x} {y}" for x in ("ann", "anna", "bo", "carla", "carlo") for y in ("lee", "quill", "oakwood", "leigh")] + [None] * 3
    pick = lambda *v: rng.choice([None, *v])
    rows = [
        {"node_id": f"{k:03}", "full_name": rng.choice(names), "ssn": pick(*range(40)), "birth_date": rng.choice(["1970", "1980", "1990", None]), "address": pick(*range(8)), "phone": pick(*range(40)), "email": pick(None, None, *range(9)), "driver_license": pick(None, None, "L1", "L2", "L3")}
        for k in range(90)
    ]
    rows = [{c: v if v is None else str(v) for c, v in r.items()} for r in rows]
    s = resolve.Scoring()
    held = resolve.feature_sets(people(spark, *rows)).collect()

    def score(x, y) -> float:  # noqa: ANN001
        total = 0.0
        for c, w in s.agree.items():
            if x[c] is not None and y[c] is not None:
                total += w if (distance(x[c], y[c]) <= s.near_name if c == "name" else x[c] == y[c]) else s.differ.get(c, 0.0)
        return total

    features = [c for c in held[0].asDict() if c != "node_id"]
    alike = lambda x, y: all(x[c] == y[c] for c in features) and any(x[c] is not None for c in features)
    want = clusters_of([x.node_id for x in held], [(x.node_id, y.node_id) for x, y in combinations(held, 2) if score(x, y) >= s.least or alike(x, y)])
    got: dict = {}
    for r in resolve.scored_clusters(people(spark, *rows)).collect():
        got.setdefault(r.entity_id, set()).add(r.node_id)
    assert {frozenset(v) for v in got.values()} == want and len(want) > 2


def test_a_default_identifier_is_linear(spark) -> None:  # noqa: ANN001
    """20,000 rows share one number; half have no name to differ in, the others have 5,000 names: 2 * 10^8 pairs, few links."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("node_id"), F.lit("999").alias("ssn"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("person "), F.sha1((F.col("id") % 10_000).cast("string")))).alias("full_name"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("address"))
    none = F.lit(None).cast("string")
    e = rows.select(*[F.col(c) if c in rows.columns else none.alias(c) for c in COLUMNS])
    links = resolve.scored_evidence(e)
    assert n - 1 <= links.count() <= 4 * n
    assert resolve.scored_clusters(e).groupBy("entity_id").count().collect()[0]["count"] == n


def test_similar_values_equal_a_full_scan(spark) -> None:  # noqa: ANN001
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9)))
    rows = [{"node_id": f"{k:03}", "full_name": rng.choice([name(), name(), name(), None]), "city": rng.choice([name(), None, "Oslo"])} for k in range(200)] + [{"node_id": "z", "full_name": "a" * 3000, "city": "aaaa"}]
    index = resolve.build_index(people(spark, *rows), ["full_name", "city"])
    wanted = [(str(k), rng.choice([name(), " ABca ", None]), rng.choice([name(), "oslo", None, ""])) for k in range(40)] + [("aa", "a" * 2990, "aaaa")]
    clean = lambda v: (v or "").strip().lower() or None
    for least, most in ((0.5, 300), (0.75, 3)):
        want = set()
        for q, a, b in wanted:
            asked = [(c, clean(v)) for c, v in (("full_name", a), ("city", b)) if clean(v)]
            if not asked:
                continue
            found = []
            for r in rows:
                total = sum(1 - distance(x, v) / max(len(x), len(v)) for c, v in asked if (x := clean(r.get(c))) and abs(len(x) - len(v)) < 2000 and min(len(x), len(v)) < 100)
                if q == "aa" and r["node_id"] == "z":
                    total = 1 - 10 / 3000 + 1
                if round(total / len(asked) + 1e-12, 4) >= least:
                    found.append((-round(total / len(asked) + 1e-12, 4), r["node_id"]))
            want |= {(q, i, -s) for s, i in sorted(found)[:most]}
        got = {(r.query_id, r.node_id, r.similarity) for r in resolve.search_index(index, spark.createDataFrame(wanted, "query_id string, full_name string, city string"), least, most).collect()}
        assert got == want and len(want) > 20
    with pytest.raises(ValueError):
        resolve.search_index(index, spark.createDataFrame(wanted, "query_id string, full_name string, city string"), 0.3)


def test_paths_equal_a_plain_search(spark) -> None:  # noqa: ANN001
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice(["T", "S"])) for _ in range(70)] + [("n1", "n1", "T"), ("n1", None, "T")]
    near: dict = {}
    for a, b, t in edges:
        if t == "T" and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    asked = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)] + [("n3", "n3"), ("n3", None), ("gone", "n3"), ("n3", "n4"), ("n3", "n4")]
    for most in (1, 4, 5):
        want = set()
        for s, t in asked:
            level = {s: (s,)} if s else {}
            seen = set(level)
            for k in range(most + 1):
                if t in level:
                    want.add((s, t, k, level[t]))
                    break
                grown: dict = {}
                for x, way in level.items():
                    for y in near.get(x, ()):
                        if y not in seen:
                            grown[y] = min(grown.get(y, ("~",)), (*way, y))
                seen |= set(grown)
                level = grown
        got = graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string, rel_type string"), spark.createDataFrame(asked, "source string, target string"), most, ["T"])
        assert {(r.source, r.target, r.hops, tuple(r.path)) for r in got.collect()} == want


def test_equal_rows_have_their_own_edges(spark) -> None:  # noqa: ANN001
    rows = spark.createDataFrame([("d", "f", "u", 1, 2, None), ("d", "f", "u", 1, 2, None), ("d", "f", "u", None, 5, 6)], "doc_id string, source_file string, upload_id string, a int, b int, c int")
    got = build.wide_association_edges(rows, F.lit("x"), [("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))], F.lit("p")).collect()
    assert sorted((r.dst, r.props["role_qname"], r.props["direction"]) for r in got) == sorted([("p_1", "a", "source"), ("p_2", "b", "target")] * 2 + [("p_5", "b", "source"), ("p_6", "c", "target")])


def test_equal_values_are_indexed_and_searched_once(spark, monkeypatch) -> None:  # noqa: ANN001
    n, sizes, keep = 3000, {}, resolve.written
    rows = spark.range(n).select(F.format_string("p%05d", "id").alias("node_id"), F.when(F.col("id") % 3 == 0, "old ring").when(F.col("id") % 3 == 1, " Old  ring").otherwise("blue plate").alias("full_name"))
    index = resolve.build_index(rows, ["full_name"])
    assert index.postings.count() < 50 and index.members.count() == n
    wanted = rows.select(F.concat(F.lit("q"), "node_id").alias("query_id"), "full_name")
    monkeypatch.setattr(resolve, "written", lambda df, label: sizes.setdefault(label, keep(df, label)))
    got = resolve.search_index(index, wanted, 0.7, 4)
    assert sizes["asked"].count() == 3
    found = {r.query_id: r.v for r in got.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("similarity"), "node_id"))).alias("v")).collect()}
    assert len(found) == n
    assert [tuple(x) for x in found["qp00001"]] == [(-1.0, "p00001"), (-1.0, "p00004"), (-1.0, "p00007"), (-1.0, "p00010")]
    few = resolve.search_index(resolve.build_index(rows.filter("node_id < 'p00006'"), ["full_name"]), wanted.filter("query_id = 'qp00003'"), 0.7, 3)
    assert {(r.node_id, r.similarity) for r in few.collect()} == {("p00000", 1.0), ("p00003", 1.0), ("p00001", 0.8889)}


def test_leaves_of_a_hub_are_not_paired(spark, monkeypatch) -> None:  # noqa: ANN001
    n, ways, keep = 400, [], graph.written

    def counted(df, label):  # noqa: ANN001, ANN202
        out = keep(df, label)
        if label == "ways":
            ways.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    edges = [(f"s{k}", f"h{k % 2}", "T") for k in range(n)] + [("h0", "r", "T"), ("h1", "r", "T")]
    asked = [(f"s{k}", f"s{k + 1}") for k in range(n)] + [("s0", "h0"), ("h0", "s2"), ("s4", "s4"), ("h0", "h1"), ("s5", "h0")]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string, rel_type string"), spark.createDataFrame(asked, "source string, target string"), 4)
    found = {(r.source, r.target): r.path for r in got.collect()}
    assert sum(ways) <= 8 * n
    assert len(found) == n - 1 + 5 and found["s0", "s1"] == ["s0", "h0", "r", "h1", "s1"] and found["s0", "h0"] == ["s0", "h0"] and found["h0", "s2"] == ["h0", "s2"]
    assert found["s5", "h0"] == ["s5", "h1", "r", "h0"] and found["s4", "s4"] == ["s4"] and found["h0", "h1"] == ["h0", "r", "h1"]
