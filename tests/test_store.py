from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docgraph.operators import store as st
from docgraph.operators.build import build_graph
from docgraph.operators.store import Conflict, GraphStore, first_rows, merge_graph
from docgraph.sources.shred import shred
from docgraph.streaming.first_writer import STATE_STORE, first_writers
from docgraph.streaming.ingest import append_graph, ingest_stream, published

NODE = "label string, id string, upload_id string, ord int, v string"
EDGE = "src string, dst string, rel_type string, upload_id string, ord int"


def nodes(spark, *rows):  # noqa: ANN001, ANN002, ANN201
    return spark.createDataFrame(list(rows), NODE)


def edges(spark, *rows):  # noqa: ANN001, ANN002, ANN201
    return spark.createDataFrame(list(rows), EDGE)


def state(store: GraphStore, version: int | None = None) -> dict:
    return {(r.label, r.id): (r.upload_id, r.v) for r in store.table("nodes", version).collect()}


def test_first_writer_stays_over_uploads(spark, tmp_path) -> None:  # noqa: ANN001
    s = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    assert s.table("nodes") is None and s.commits().count() == 0
    one = nodes(spark, ("L", "a", "u1", 2, "late"), ("L", "a", "u1", 1, "first"), ("M", "a", "u1", 3, "other label"), ("L", None, "u1", 4, "no key"))
    s.merge(one, edges(spark, ("a", "b", "T", "u1", 1), ("a", "b", "T", "u1", 1), ("a", "b", "S", "u1", 2)))
    two = nodes(spark, ("L", "a", "u2", 0, "too late"), ("L", "b", "u2", 1, "new"))
    assert s.merge(two, edges(spark, ("a", "b", "T", "u2", 1), ("b", "a", "T", "u2", 1))) == 2
    want = {("L", "a"): ("u1", "first"), ("M", "a"): ("u1", "other label"), ("L", "b"): ("u2", "new")}
    assert state(s) == want
    assert s.merge(two, edges(spark, ("a", "b", "T", "u2", 1))) == 3  # a repeat
    assert state(s) == want and {(r.src, r.dst, r.rel_type, r.upload_id) for r in s.table("edges").collect()} == {("a", "b", "T", "u1"), ("a", "b", "S", "u1"), ("b", "a", "T", "u2")}
    assert {(r.upload_id, r.version) for r in s.commits().collect()} == {("u1", 1), ("u2", 3)}
    assert state(s, 1) == {k: v for k, v in want.items() if v[0] == "u1"}  # older versions stay readable
    assert [r.v for r in s.nodes_by_id(["b"]).collect()] == ["new"] and s.nodes_by_id([]).count() == 0
    s.compact()
    assert state(s) == want and len(s.manifest().folders["nodes"]) == 1
    assert s.vacuum() > 4 and state(s) == want
    s.delete_upload("u1")
    assert state(s) == {("L", "b"): ("u2", "new")}
    s.merge(nodes(spark, ("L", "a", "u3", 0, "now first")), edges(spark))
    assert state(s) == {("L", "b"): ("u2", "new"), ("L", "a"): ("u3", "now first")}
    s.merge(one, edges(spark))
    assert state(s)["M", "a"] == ("u1", "other label") and state(s)["L", "a"] == ("u3", "now first")  # u1 came again, after u3
    s.compact()
    assert state(s)["M", "a"] == ("u1", "other label") and len(state(s)) == 3


def test_look_ups_read_one_bucket(spark, tmp_path) -> None:  # noqa: ANN001
    s = GraphStore(spark, str(tmp_path / "g"), buckets=8)
    s.merge(nodes(spark, *[("L", f"n{i}", "u", i, "") for i in range(200)]), edges(spark))
    found = s.nodes_by_id(["n7"])
    assert found.count() == 1 and "PartitionFilters: [" in found._jdf.queryExecution().toString() and len(s.nodes_by_id(["n7"]).inputFiles()) >= 1


def test_a_run_that_dies_leaves_nothing_to_see(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    s = GraphStore(spark, str(tmp_path / "g"))
    s.merge(nodes(spark, ("L", "a", "u1", 1, "x")), edges(spark, ("a", "a", "T", "u1", 1)))
    before = state(s)
    write = GraphStore._write

    def dies(self, df, table):  # noqa: ANN001, ANN202
        if table == "edges":
            raise RuntimeError("lost")
        return write(self, df, table)

    monkeypatch.setattr(GraphStore, "_write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        s.merge(nodes(spark, ("L", "b", "u2", 1, "y")), edges(spark, ("a", "b", "T", "u2", 1)))
    monkeypatch.setattr(GraphStore, "_write", write)
    assert state(s) == before and s.manifest().version == 1 and s.commits().count() == 1
    assert s.vacuum() == 1  # the dead run's nodes
    s.merge(nodes(spark, ("L", "b", "u2", 1, "y")), edges(spark, ("a", "b", "T", "u2", 1)))
    assert set(state(s)) == {("L", "a"), ("L", "b")} and s.table("edges").count() == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    s = GraphStore(spark, str(tmp_path / "g"))
    s.merge(nodes(spark, ("L", "a", "u1", 1, "x")), edges(spark))
    held = s.manifest()
    s.merge(nodes(spark, ("L", "b", "u2", 1, "y")), edges(spark))
    monkeypatch.setattr(GraphStore, "manifest", lambda self, version=None: held)
    with pytest.raises(Conflict):
        s.merge(nodes(spark, ("L", "b", "u3", 1, "z")), edges(spark))
    monkeypatch.undo()
    assert state(s)["L", "b"] == ("u2", "y")


def test_rows_that_agree_in_order_are_told_apart_alike(spark) -> None:  # noqa: ANN001
    rows = [("L", "a", "u", 1, "x"), ("L", "a", "u", 1, "w"), ("L", "a", None, 1, "v")]
    for order in (rows, rows[::-1]):
        assert [r.v for r in first_rows(nodes(spark, *order), ("label", "id")).collect()] == ["w"]  # a null comes after
    assert first_rows(nodes(spark), ("label", "id")).count() == 0


def docs(spark, *rows):  # noqa: ANN001, ANN002, ANN201
    return spark.createDataFrame(list(rows), "doc_id string, source_file string, upload_id string, content string")


def test_issues_belong_to_documents_and_runs(spark, tmp_path) -> None:  # noqa: ANN001
    target = str(tmp_path / "g")
    good, bad = "<a><b><c>1</c></b></a>", "<a>"
    append_graph(docs(spark, ("1", "a.xml", "u1", bad), ("2", "x/b.xml", "u1", good), ("3", "y/b.xml", "u1", good)), target)
    append_graph(docs(spark, ("4", "a.xml", "u2", good)), target)
    commits = lambda: {r.upload_id: (r.files, r.failed) for r in GraphStore(spark, target).commits().collect()}
    assert commits() == {"u1": (3, 1), "u2": (1, 0)}
    assert [(r.doc_id, r.upload_id, r.file) for r in published(spark, target, "issues").collect()] == [("1", "u1", "a.xml")]
    append_graph(docs(spark, ("1", "a.xml", "u1", good), ("2", "x/b.xml", "u1", good), ("3", "y/b.xml", "u1", good)), target)  # mended
    assert commits() == {"u1": (3, 0), "u2": (1, 0)} and published(spark, target, "issues").count() == 0
    assert published(spark, target, "nodes").count() == 8


def test_files_of_one_name_have_their_own_nodes(spark, tmp_path) -> None:  # noqa: ANN001
    g = build_graph(shred(docs(spark, ("p/a.xml_u", "a.xml", "u", "<a><b><c>1</c></b></a>"), ("q/a.xml_u", "a.xml", "u", "<a><b><c>2</c></b></a>"))))
    assert g.nodes.select("id").distinct().count() == 4
    source = tmp_path / "in"
    for folder in ("p", "q"):
        (source / folder).mkdir(parents=True)
        (source / folder / "a.xml").write_text(f"<a><b><c>{folder}</c></b></a>")
    ingest_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    found = published(spark, str(tmp_path / "out"), "nodes")
    assert {r.source_file for r in found.collect()} == {"p/a.xml", "q/a.xml"} and found.select("id").distinct().count() == 4


def test_stored_graph_of_documents_keeps_unresolved_and_edges(spark, tmp_path) -> None:  # noqa: ANN001
    s = GraphStore(spark, str(tmp_path / "g"))
    text = '<a xmlns:s="http://e.org/structures/3.0/"><b s:id="X"/><r s:ref="gone"/></a>'
    d = docs(spark, ("1", "a.xml", "u", text), ("2", "b.xml", "u", None))
    merge_graph(s, build_graph(shred(d)), d)
    merge_graph(s, build_graph(shred(d)), d)
    assert s.table("nodes").count() == build_graph(shred(d)).nodes.count() and s.commits().first().failed == 1
    assert s.table("issues").filter("rule = 'parse'").count() == 1 and st.KEYS["edges"] == ("src", "dst", "rel_type")


def test_first_writers_of_a_stream(spark, tmp_path) -> None:  # noqa: ANN001
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    source, schema = tmp_path / "in", "label string, id string, ord int, v string"
    batches = [[("L", "a", 2, "x"), ("L", "a", 1, "y"), ("L", "b", 1, "z"), (None, "a", 1, "n")], [("L", "a", 0, "late"), ("M", "a", 5, "m")], [("L", "b", 1, "z"), ("L", "c", 1, "c"), ("L", "c", 1, "c")]]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = first_writers(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), ["label", "id"], ["ord", "v"])
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(240)
        got = sorted(((r.label or "", r.id, r.ord, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
        s = GraphStore(spark, str(tmp_path / "store"))  # the batch way to the same end
        s.merge(spark.createDataFrame(rows, schema).withColumn("upload_id", F.lit(f"b{k}")), edges(spark))
    assert got == [("", "a", 1, "n"), ("L", "a", 1, "y"), ("L", "b", 1, "z"), ("L", "c", 1, "c"), ("M", "a", 5, "m")]
    assert sorted((r.label, r.id, r.ord, r.v) for r in s.table("nodes").collect()) == [g for g in got if g[0]]
