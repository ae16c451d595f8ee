from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import export, mapping
from docgraph.operators.build import build_graph, document_stats, id_collisions, labelled_edges, resolved_edges
from docgraph.sources.shred import shred

HEAD = 'xmlns:l="http://example.org/library/1.0/" xmlns:s="http://example.org/model/structures/4.0/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'

#: A library: two shelves, a book on each that a loan refers to, a reader who is also a donor, and a note about the catalogue.
XML = f"""<l:Library {HEAD} l:city="Oslo">
 <l:Shelf s:id="A"><l:Label>maps</l:Label><l:Book s:id="B1"><l:Title>North</l:Title><l:Author>Eide</l:Author><l:Author>Lund</l:Author></l:Book></l:Shelf>
 <l:Shelf s:id="C"><l:Book s:id="B2"><l:Title>South</l:Title><l:BookAugmentation><l:Pages>90</l:Pages></l:BookAugmentation></l:Book></l:Shelf>
 <l:Reader s:uri="http://example.org/people#R9"><l:Card>77</l:Card></l:Reader>
 <l:Donor s:uri="http://example.org/people#R9"><l:Year>1999</l:Year></l:Donor>
 <l:LoanAssociation><l:Reader s:uri="#R9" xsi:nil="true"/><l:Book s:ref="B2" xsi:nil="true"/><l:Due>2021-05-01</l:Due></l:LoanAssociation>
 <l:Catalogue><l:Entry s:ref="B1" xsi:nil="true"/><l:Entry s:ref="ZZ" xsi:nil="true"/></l:Catalogue>
</l:Library>"""
# Nodes by hand: Library, two Shelves, two Books, Reader, Donor, Loan, Catalogue (9); the hub R9; the lost ZZ: 11.
# Contained: two shelves, two books, reader, donor, loan, catalogue (8), and the hub under the root: 9.

JSON = """{"l:Library": {"l:Shelf": [{"@id": "#A", "l:Label": "maps"}, {"@id": "#C", "l:Wide": true, "l:Lamp": {"nc:TextLiteral": "oil"}}],
 "l:Reader": {"@id": "#R9", "l:Age": 41}, "l:Donor": {"@id": "#R9", "l:Gift": {"l:Sum": 2.5}},
 "l:LoanAssociation": {"l:Who": {"@id": "#R9"}, "l:What": {"@id": "#C"}}}}"""
# Nodes by hand: Library, two Shelves, Reader, Donor, Gift, Loan (7) and the hub R9: 8.


def docs(spark, *rows):  # noqa: ANN001, ANN002, ANN201
    return spark.createDataFrame(list(rows), "doc_id string, source_file string, upload_id string, content string")


def counts(graph) -> dict:  # noqa: ANN001
    return {r[0]: r[1] for r in graph.edges.groupBy("rel_type").count().collect()}


def test_xml_counts_by_hand(spark) -> None:  # noqa: ANN001
    g = build_graph(shred(docs(spark, ("d", "a.xml", "u", XML))))
    rows = g.nodes.collect()
    by_label = {r["label"]: r for r in rows}
    assert len(rows) == 11 and sum(r["is_unresolved"] for r in rows) == 1
    assert counts(g) == {"CONTAINS": 9, "REPRESENTS": 2, "ASSOCIATED_WITH": 2, "REFERS_TO": 3}  # two entries, and the city that looks like an id
    titles = {r["sid"]: r for r in rows if r["label"] == "l_Book"}
    assert titles["B1"]["props"]["l_Title"] == "North" and titles["B1"]["list_props"]["l_Author"] == ["Eide", "Lund"]
    assert titles["B2"]["props"]["l_Pages"] == "90" and titles["B2"]["props"]["l_Pages_isAugmentation"] == "true"
    assert by_label["l_Reader"]["is_role"] and by_label["l_Donor"]["is_role"] and by_label["l_LoanAssociation"]["is_association"]
    assert by_label["l_LoanAssociation"]["props"] == {"l_Due": "2021-05-01"}
    hub = by_label["Entity_R9"]
    assert hub["list_props"]["role_types"] == ["l:Donor", "l:Reader"] and hub["props"]["role_count"] == "2"
    ends = {r["props"]["direction"]: r["dst"].split("_", 1)[1] for r in g.edges.filter("rel_type = 'ASSOCIATED_WITH'").collect()}
    assert ends == {"source": "R9", "target": "B2"}
    low = g.edges.filter("confidence = 'low'").collect()
    assert len(low) == 1 and low[0]["props"] == {"source_attribute": "l:city"}
    assert resolved_edges(g).count() == 15  # all 16 but the city: the lost ZZ has a placeholder
    (lost,) = g.issues.collect()
    assert (lost["severity"], lost["rule"]) == ("warning", "unresolved_reference") and lost["message"].endswith("ZZ") and lost["context"].startswith("REFERS_TO from")
    labels = {(r["src_label"], r["dst_label"]) for r in labelled_edges(g).filter("rel_type = 'REPRESENTS'").collect()}
    assert labels == {("l_Reader", "Entity_R9"), ("l_Donor", "Entity_R9")}
    stats = document_stats(g).first()
    assert (stats["nodes"], stats["contains"], stats["edges"]) == (11, 9, 7)


def test_json_counts_by_hand(spark) -> None:  # noqa: ANN001
    g = build_graph(shred(docs(spark, ("d", "a.json", "u", JSON))))
    labels = sorted(r[0] for r in g.nodes.select("label").collect())
    assert labels == sorted(["l_Library", "l_Shelf", "l_Shelf", "l_Reader", "l_Donor", "l_Gift", "l_LoanAssociation", "Entity_R9"])
    assert counts(g) == {"CONTAINS": 7, "REPRESENTS": 2, "ASSOCIATED_WITH": 2}
    wide = g.nodes.filter("label = 'l_Shelf' AND props['l_Wide'] = 'true'").first()
    assert wide["props"] == {"l_Wide": "true", "l_Lamp": "oil"}
    assert g.nodes.filter("label = 'l_Gift'").first()["props"] == {"l_Sum": "2.5"}


def test_documents_are_shredded_once(spark) -> None:  # noqa: ANN001
    g = build_graph(shred(docs(spark, ("d", "a.xml", "u", XML))))
    for table in (g.nodes, g.edges, g.props, g.issues):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan


def shuffled_rows(df) -> int:  # noqa: ANN001
    """Rows that the exchanges of a table's plan wrote while it was collected."""
    df.collect()

    def below(node) -> int:  # noqa: ANN001
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return below(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(below(node.children().apply(k)) for k in range(node.children().length()))

    return below(df._jdf.queryExecution().executedPlan())


def test_flat_documents_are_joined_once(spark) -> None:  # noqa: ANN001
    """Elements without uris, of which none is an association, are shuffled once to find their owners."""
    from docgraph.operators.build import classify, with_owner
    from docgraph.scratch import written

    flat = docs(spark, *[(str(i), "e.json", "u", f'{{"k": {i}}}') for i in range(500)])
    elements, kept = written(shred(flat), "elements"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = with_owner(classify(elements))
        assert shuffled_rows(found) <= 2 * elements.count() == 2000
        assert found.filter("owner_ord = 0 AND owner_depth = 0 AND ord = 1 AND NOT owner_assoc").count() == 500 == found.filter("owner IS NULL AND ord = 0").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_isolation_errors_and_siblings(spark) -> None:  # noqa: ANN001
    twins = '<a xmlns:s="http://e.org/structures/3.0/"><b><c>1</c></b><b><c>2</c></b><r s:ref="gone"/></a>'
    rows = [("1", "a.xml", "u1", twins), ("2", "a.xml", "u2", twins), ("3", "bad.xml", "u1", "<a><b></a>"), ("4", "dtd.xml", "u1", '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'), ("5", "null.xml", "u1", None)]
    e = shred(docs(spark, *rows))
    g = build_graph(e)
    assert {r[0] for r in g.issues.filter("severity = 'error'").select("file").collect()} == {"bad.xml", "dtd.xml", "null.xml"}
    assert g.nodes.count() == 2 * 4 and g.nodes.select("id").distinct().count() == 8  # a, b, b and the lost target of each upload
    assert g.nodes.filter("is_unresolved").count() == 2
    merged = build_graph(e, sibling_ids=False)
    assert merged.nodes.filter("label = 'b'").count() == 2
    assert merged.edges.filter(F.col("rel_type") == "CONTAINS").count() == 2
    mapped = build_graph(e, objects=[], associations=[])
    assert [r["list_props"] for r in mapped.nodes.filter("is_root").collect()] == [{"b__c": ["1", "2"]}] * 2


def test_large_documents_are_read_piece_by_piece(spark) -> None:  # noqa: ANN001
    """A document far larger than what is kept gives its rows while it is parsed, and the same ones; a broken one gives its error alone."""
    import tracemalloc

    from docgraph.sources import shred as sh

    text = ("<a>" + "".join(f"<b k='{i}'><c>{i % 7}</c><d/></b>" for i in range(400_000)) + "</a>").encode()
    assert len(text) > sh.KEPT
    tracemalloc.start()
    n = sum(r["text"] is not None for r in sh.shred_xml("1", "a.xml", "u", text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < 40 << 20  # 1,200,001 rows of some 1.5 KB each, were they kept
    assert [r["error"] is not None for r in sh.shred_xml("1", "a.xml", "u", text[:-4])] == [True]
    small = f"<a>{'<b><c>1</c></b>' * 50}</a>".encode()
    whole = list(sh.shred_xml("1", "a.xml", "u", small))
    kept, sh.KEPT = sh.KEPT, 10
    try:
        assert list(sh.shred_xml("1", "a.xml", "u", small)) == whole
    finally:
        sh.KEPT = kept
    e = shred(spark.createDataFrame([("1", "a.xml", "u", bytearray(text)), ("2", "b.xml", "u", None)], "doc_id string, source_file string, upload_id string, content binary"))
    assert e.filter("error IS NULL").count() == 1_200_001 and e.filter("error IS NOT NULL").count() == 1


def test_bytes_are_read_in_their_own_encoding(spark) -> None:  # noqa: ANN001
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><a><b><c>Bjørn</c></b></a>'
    rows = [("1", "l.xml", "u", latin.encode("latin-1")), ("2", "x.xml", "u", latin.replace("ISO-8859-1", "no-such").encode()), ("3", "w.json", "u", '{"r": {"q": {"t": "ø"}}}'.encode("utf-16"))]
    e = shred(spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "doc_id string, source_file string, upload_id string, content binary"))
    got = {r.doc_id: r for r in e.filter("text IS NOT NULL OR error IS NOT NULL").collect()}
    assert got["1"].text == "Bjørn" and got["2"].error and got["3"].text == "ø"
    assert shred(docs(spark, ("1", "l.xml", "u", latin))).filter("text = 'Bjørn'").count() == 1  # a string is what it says


def test_mapping_mode(spark) -> None:  # noqa: ANN001
    m = mapping.load_mapping('{"objects": [{"qname": "l:Book", "scalar_props": [{"path": "l:Title"}, {"path": "l:Author", "property": "author"}]}, {"qname": "l:Library", "scalar_props": [{"path": "@l:city", "property": "town"}, {"path": "l:Shelf/l:Label"}]}], "augmentations": [{"qname": "l:BookAugmentation", "properties": [{"qname": "l:Pages", "property": "pages"}]}]}')
    e = shred(docs(spark, ("d", "a.xml", "u", XML)))
    g = build_graph(e, m.objects, m.associations, extra_props=mapping.extra_props(m))
    nodes = {r["sid"] or r["label"]: r for r in g.nodes.collect()}
    assert nodes["B1"]["props"]["author"] == "Eide" and nodes["B1"]["props"]["l_Title"] and nodes["B2"]["props"]["pages"] == "90"
    assert (nodes["l_Library"]["props"]["town"], nodes["l_Library"]["props"]["l_Shelf_l_Label"]) == ("Oslo", "maps")
    known = spark.createDataFrame([("l:Library",), ("l:Shelf",), ("l:Book",), ("l:Reader",)], "qname string")
    classified = build_graph_elements(e)
    assert {r["key"]: r["values"] for r in mapping.unmapped_properties(classified, known).collect()} == {"aug_l_Due": ["2021-05-01"]}
    assert mapping.unknown_elements(e, known).filter("qname = 'l:Donor'").count() == 1
    assert {r.qname: r.n for r in mapping.element_names(e).collect()}["l:Book"] == 3


def build_graph_elements(e):  # noqa: ANN001, ANN201
    from docgraph.operators.build import classify, with_owner

    return with_owner(classify(e))


def test_collisions_and_statements(spark) -> None:  # noqa: ANN001
    twice = '<a xmlns:s="http://e.org/structures/3.0/"><b s:id="X"/><c s:id="X"/><d s:id="Y"/></a>'
    e = shred(docs(spark, ("1", "a.xml", "u", twice)))
    assert [(r.sid, r.n, r.qnames) for r in id_collisions(e).collect()] == [("X", 2, ["b", "c"])]
    assert build_graph(e).issues.filter("rule = 'id_collision'").count() == 1
    nodes = spark.createDataFrame([("i'1", "a b", {"k": "x\\y'z", "p q": "1"}), ("2", "N", {})], "id string, label string, props map<string,string>")
    got = [r.statement for r in export.node_statements(nodes).orderBy("label").collect()]
    assert got == ["MERGE (n:N {id: '2'});", "MERGE (n:`a b` {id: 'i\\'1'}) ON CREATE SET n.k = 'x\\\\y\\'z', n.`p q` = '1';"]
    edges = spark.createDataFrame([("a", "b", "T", {"k": "v"})], "src string, dst string, rel_type string, props map<string,string>")
    assert export.edge_statements(edges).first().statement == "MATCH (a {id: 'a'}), (b {id: 'b'}) MERGE (a)-[:T {k: 'v'}]->(b);"


def test_empty_table(spark) -> None:  # noqa: ANN001
    g = build_graph(shred(docs(spark)))
    assert g.nodes.count() == 0 and g.edges.count() == 0
