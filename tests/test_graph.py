from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import graph


def small(spark):  # noqa: ANN001, ANN201
    nodes = spark.createDataFrame([("a", ["A"], "u1"), ("b", ["B"], "u1"), ("c", ["B", "ResolvedEntity"], "u2"), ("d", ["C"], None)], "id string, labels array<string>, upload_id string").withColumn("props", F.create_map(F.lit("x_Key"), F.col("id")))
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T"), ("c", "a", "T"), ("c", "d", "RESOLVED_TO")], "src string, dst string, rel_type string")
    return nodes, edges


def test_paths_are_trails(spark) -> None:  # noqa: ANN001
    nodes, edges = small(spark)
    found = graph.paths(edges, 1, 5, ["T"])
    assert found.count() == 9 and found.agg(F.max("hops")).first()[0] == 3
    start = nodes.filter("id = 'a'")
    assert {(r.dst, r.hops) for r in graph.paths(edges, 2, 3, start=start).collect()} == {("c", 2), ("a", 3), ("d", 3)}


def test_hops_and_filters(spark) -> None:  # noqa: ANN001
    nodes, edges = small(spark)
    b = graph.with_label(nodes, "B")
    assert {(r.id, r.other) for r in graph.hop(b, edges, ["T"], "both").collect()} == {("b", "a"), ("b", "c"), ("c", "b"), ("c", "a")}
    assert {(r.id, r.other) for r in graph.hop(nodes, edges, ["RESOLVED_TO"], optional=True).collect()} == {("a", None), ("b", None), ("c", "d"), ("d", None)}
    assert nodes.filter(graph.any_key(lambda k: k.endswith("Key"))).count() == 4 and nodes.filter(graph.prop("none").isNull()).count() == 4
    assert {r.id for r in graph.orphans(nodes, edges, ["T"]).collect()} == {"d"}
    assert {r.id: r.degree for r in graph.degrees(edges).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1}


def test_results(spark) -> None:  # noqa: ANN001
    nodes, edges = small(spark)
    m = graph.GraphResult(nodes, edges).metadata().first()
    assert (m.node_labels, m.relationship_types, m.node_count, m.relationship_count) == (["A", "B", "C", "ResolvedEntity"], ["RESOLVED_TO", "T"], 4, 4)
    assert graph.full_graph(nodes, edges, 2).edges.count() == 2
    assert graph.full_graph(nodes, edges, include_resolved=False).edges.count() == 3
    assert {r.id for r in graph.induced(nodes, edges, F.col("id") == "d").nodes.collect()} == {"c", "d"}
    assert {(r.source, r.target, r.hops) for r in graph.shortest(edges, nodes.filter("id = 'd'"), nodes, 2).collect()} == {("d", "d", 0), ("d", "c", 1), ("d", "b", 2), ("d", "a", 2)}
    kept = graph.delete_upload(nodes, edges, "u1")
    assert kept.nodes.count() == 2 and {(r.src, r.dst) for r in kept.edges.collect()} == {("c", "d")}
    assert [tuple(r) for r in graph.graph_schema(nodes, edges).collect()] == [("label", "A"), ("label", "B"), ("label", "C"), ("label", "ResolvedEntity"), ("relationship", "RESOLVED_TO"), ("relationship", "T")]


def test_descendants_end_on_cycles_and_have_no_row_limit(spark) -> None:  # noqa: ANN001
    loop = spark.createDataFrame([("a", "b", "T"), ("b", "a", "T"), ("b", "c", "T"), ("c", "d", "U")], "src string, dst string, rel_type string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert {(r.root, r.id, r.depth) for r in graph.descendants(loop, ["T"], roots).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2)}
    n = 1_000_001
    wide = spark.range(n).select(F.lit("r").alias("src"), F.col("id").cast("string").alias("dst"), F.lit("T").alias("rel_type"))
    assert graph.descendants(wide, ["T"], spark.createDataFrame([("r",)], "id string")).count() == n + 1


def test_groups_counts_and_reports(spark) -> None:  # noqa: ANN001
    from docgraph.operators import reports

    nodes, edges = small(spark)
    names = nodes.select("id", F.lit("x").alias("qname"))
    both = edges.unionByName(spark.createDataFrame([("d", "b", "T")], edges.schema))
    assert {(r.target, r.id, r["first"]) for r in graph.same_target_groups(both, names, ["T"]).collect()} == {("b", "a", "a"), ("b", "d", "a")}
    assert tuple(graph.delete_counts(nodes, edges, "u1").first()) == (2, 3)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "source_file string")
    issues = spark.createDataFrame([("a", "error"), ("a", "warning"), ("b", "warning")], "file string, severity string")
    assert tuple(reports.batch_totals(reports.batch_outcomes(files, issues)).first()) == (3, 2, 1, 1, 2)
    tree = spark.createDataFrame([("R", "R", "R", 0, "object"), ("R", "R/Boat", "Boat", 1, "object"), ("R", "R/Boat/Name", "Name", 2, "property"), ("R", "R/Age", "Age", 1, "property")], "root string, path string, element string, depth int, kind string")
    assert {r.path for r in reports.search_tree(tree, "NAM").collect()} == {"R", "R/Boat", "R/Boat/Name"}
    assert {r.element: (r.properties, r.objects) for r in reports.type_shapes(tree).collect()} == {"R": (1, 1), "Boat": (1, 0)}
    assert reports.search_types(spark.createDataFrame([("x:Driver", "person"), ("x:Car", "vehicle")], "qname string, category string"), "PERS").count() == 1
    rows = spark.createDataFrame([("b", None), (None, "a"), ("b", "c")], "f string, g string")
    assert [r.file for r in reports.source_files(rows, "f", "g").collect()] == ["a", "b"]
    listing = spark.createDataFrame([("s1/a.xsd",), ("s1/b.XSD",), ("s2/c.xml",), ("d.json",)], "path string")
    assert tuple(reports.stored_counts(listing).first()) == (2, 4, 2, 1, 1)


def test_pairs_of_a_hub_are_spread(spark) -> None:  # noqa: ANN001
    n = 60
    edges = spark.createDataFrame([(f"s{k}", "hub" if k < n else "few", "T") for k in range(n + 5)] + [("s1", "hub", "S"), (None, "hub", "T"), ("s3", None, "T")], "src string, dst string, rel_type string")
    names = spark.createDataFrame([(f"s{k}", "ab"[k % 7 == 0]) for k in range(n + 5)], "id string, qname string")
    got = graph.same_target_pairs(edges, names, ["T"], block=8, task_pairs=50)
    want = sorted((t, a, b) for t, m in (("hub", range(n)), ("few", range(n, n + 5))) for x in m for y in m if (x % 7 == 0) == (y % 7 == 0) and (a := f"s{x}") < (b := f"s{y}"))
    assert sorted(map(tuple, got.collect())) == want
    spread = [r.n for r in got.filter("target = 'hub'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(spread) > 5 and max(spread) < len(want) / 3
