from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docgraph.operators import records
from docgraph.operators.store import GraphStore
from docgraph.plans import schema_model as sm
from docgraph.sources.files import list_files, namespaces, purge, read_documents
from docgraph.sources.shred import shred
from docgraph.streaming.ingest import ingest_stream, published, windowed_counts

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="t">
<xs:import namespace="n" schemaLocation="lib/core.xsd"/><xs:import namespace="m" schemaLocation="gone.xsd"/>
<xs:complexType name="BoatType"><xs:complexContent><xs:extension base="t:ThingType"><xs:sequence><xs:element ref="t:Sailor" maxOccurs="unbounded"/><xs:element name="Name" type="xs:string"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="SailorType"><xs:sequence><xs:element ref="t:Boat"/><xs:element ref="t:Age"/></xs:sequence></xs:complexType>
<xs:complexType name="TripAssociationType"><xs:sequence><xs:element ref="t:Boat"/><xs:element ref="t:Sailor"/></xs:sequence></xs:complexType>
<xs:complexType name="BoatAugmentationType"><xs:sequence><xs:element ref="t:Age"/></xs:sequence></xs:complexType>
<xs:simpleType name="AgeType"><xs:restriction base="t:SmallType"/></xs:simpleType><xs:simpleType name="SmallType"><xs:restriction base="xs:int"/></xs:simpleType>
<xs:element name="Fleet" type="t:FleetType"/><xs:complexType name="FleetType"><xs:sequence><xs:element ref="t:Boat"/><xs:element ref="t:TripAssociation"/></xs:sequence></xs:complexType>
<xs:element name="Boat" type="t:BoatType"/><xs:element name="Sailor" type="t:SailorType"/><xs:element name="Age" type="t:AgeType"/><xs:element name="TripAssociation" type="t:TripAssociationType"/>
<xs:element name="BoatAugmentation" type="t:BoatAugmentationType" substitutionGroup="t:BoatAugmentationPoint"/>
</xs:schema>"""


def rows(spark, *docs):  # noqa: ANN001, ANN002, ANN201
    return shred(spark.createDataFrame(list(docs), "doc_id string, source_file string, upload_id string, content string"), "xml")


def test_schema_tables(spark) -> None:  # noqa: ANN001
    e = rows(spark, ("1", "main.xsd", "u", XSD), ("2", "core.xsd", "u", "<xs:schema xmlns:xs='http://www.w3.org/2001/XMLSchema'/>")).cache()
    kinds = {r.name: r.kind for r in sm.classify_types(sm.types(e)).collect()}
    assert kinds["AgeType"] == "integer" and kinds["BoatType"] == "string"
    held, declared = sm.members(e), sm.declarations(e)
    assert {(r.type, r.element, r.max_occurs) for r in held.collect()} >= {("BoatType", "t:Sailor", "unbounded"), ("BoatType", "Name", "1")}
    tree = sm.element_tree(declared, held).cache()
    paths = {r.path: (r.kind, r.n_children) for r in tree.collect()}
    assert paths["Fleet/Boat/Sailor/Age"] == ("property", 0) and paths["Fleet/TripAssociation"] == ("association", 2) and "Fleet/Boat/Sailor/Boat" not in paths
    assert [tuple(r) for r in sm.augmentations(declared, held).collect()] == [("t:BoatType", "BoatAugmentation", "t:Age")]
    chosen = spark.createDataFrame([("Boat",), ("Sailor",), ("TripAssociation",)], "element string")
    objects, associations = sm.mapping(tree, chosen)
    assert {r.element for r in objects.collect()} == {"Boat", "Sailor"} and [r.roles for r in associations.collect()] == [["Boat", "Sailor"]]
    assert sm.validate_selection(tree, chosen).count() == 0
    assert [r.rule for r in sm.validate_selection(tree, chosen.limit(0)).collect()] == ["NO_SELECTIONS"]
    assert [r.rule for r in sm.validate_selection(tree, chosen.filter("element = 'TripAssociation'")).collect()] == ["INSUFFICIENT_ENDPOINTS"]
    assert {(r.location, r.status, r.matched) for r in sm.check_imports(e).collect()} == {("lib/core.xsd", "satisfied", "core.xsd"), ("gone.xsd", "missing", None)}


def test_closure_ends_on_cycles(spark) -> None:  # noqa: ANN001
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert sm.closure(pairs).count() == 9


def test_registry_and_reset(spark, tmp_path) -> None:  # noqa: ANN001
    reg = records.Registry(spark, str(tmp_path / "registry"))
    assert reg.list().count() == 0
    a, b = reg.add("one", "a.xsd", "x"), reg.add("two", "b.xsd", "y")
    assert {r.schema_id: r.active for r in reg.list().collect()} == {a: False, b: True}
    reg.activate(a)
    reg.select(b, {"t:Boat": True})
    state = {r.schema_id: r for r in reg.list().collect()}
    assert state[a].active and not state[b].active and state[b].selections == {"t:Boat": True}
    with pytest.raises(KeyError):
        reg.activate("none")
    nodes, reset = spark.range(3), records.Reset()
    counts, token = reset.dry_run(nodes, nodes)
    assert {(r.kind, r.n) for r in counts.collect()} == {("nodes", 3), ("edges", 3)}
    with pytest.raises(PermissionError):
        reset.run(nodes, nodes, "guess")
    assert reset.run(nodes, nodes, token)[0].count() == 0


def test_json_validation_and_conversion(spark) -> None:  # noqa: ANN001
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"enum": ["x"]}}}}
    docs = spark.createDataFrame([("ok", '{"a": 1}'), ("bad", '{"a": true, "b": ["x", "y"]}'), ("none", "{}"), ("text", "{"), ("null", None)], "source_file string, content string")
    issues = records.validate_json(docs, schema)
    assert {(r.file, r.rule, r.context) for r in issues.collect()} == {("bad", "type", "/a"), ("bad", "enum", "/b/1"), ("none", "required", ""), ("text", "syntax", ""), ("null", "syntax", "")}
    assert {r.file: r.errors for r in records.issue_counts(issues).collect()}["bad"] == 2
    assert records.first_messages(issues, 1).filter("file = 'bad'").first().summary.endswith("; ... and 1 more")
    e = rows(spark, ("1", "a.xml", "u", '<a k="v&quot;"><b>1</b><b>2</b><c><d/>t</c></a>'), ("2", "b.xml", "u", "<x>hi</x>"))
    got = {r.doc_id: json.loads(r.json) for r in records.xml_to_json(e).collect()}
    assert got == {"1": {"a": {"@k": 'v"', "b": ["1", "2"], "c": {"d": None, "#text": "t"}}}, "2": {"x": "hi"}}


def test_files_and_stream(spark, tmp_path) -> None:  # noqa: ANN001
    source = tmp_path / "in"
    source.mkdir()
    (source / "100_abc_one.xml").write_text('<a xmlns:p="urn:p"><p:b><c>1</c></p:b></a>')
    (source / "two.json").write_text('{"r": {"s": {"t": 1}}}')
    listed = {r.stored_name: r for r in list_files(spark, str(source)).collect()}
    assert listed["100_abc_one.xml"].name == "one.xml" and listed["two.json"].content_type == "application/json"
    docs = read_documents(spark, str(source), "u")
    assert shred(docs).filter("error IS NULL").count() == 6
    assert {(r.prefix, r.uri) for r in namespaces(docs).collect()} == {("p", "urn:p")}
    sub = tmp_path / "deep" / "a"
    sub.mkdir(parents=True)
    (tmp_path / "deep" / "same.xml").write_text("<a><b><c>1</c></b></a>")
    (sub / "same.xml").write_text("<a><b><c>2</c></b></a>")
    two = read_documents(spark, str(tmp_path / "deep"), "u")
    assert {r.source_file for r in two.collect()} == {"same.xml", "a/same.xml"} and two.select("doc_id").distinct().count() == 2
    (source / "broken.xml").write_text("<a>")
    target = str(tmp_path / "out")
    for _ in range(2):  # the second run has nothing new
        ingest_stream(spark, str(source), target, str(tmp_path / "check")).awaitTermination(120)
    nodes = published(spark, target, "nodes")
    assert {r.label for r in nodes.collect()} == {"a", "p_b", "r", "s"} and nodes.count() == 4
    assert published(spark, target, "edges").filter(F.col("rel_type") == "CONTAINS").count() == 2
    assert [r.file for r in published(spark, target, "issues").collect()] == ["broken.xml"] and published(spark, target, "nodes").count() == 4
    commit = GraphStore(spark, target).commits().first()
    assert (commit.files, commit.failed) == (3, 1)
    spark.range(1).select(F.lit("x").alias("label"), F.lit("unfinished").alias("upload_id")).write.mode("append").partitionBy("upload_id").parquet(f"{target}/nodes/dead")
    assert published(spark, target, "nodes").count() == 4
    assert purge(spark, str(source), "two") == 1 and {p.name for p in source.iterdir() if p.name[0] != "."} == {"100_abc_one.xml", "broken.xml"}


def test_windowed_counts_of_a_stream(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [("2020-01-01 00:10:00", "a"), ("2020-01-01 00:50:00", "a"), ("2020-01-01 01:10:00", "b")]
    spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert {(str(r.start), r.event_type, r.n) for r in spark.table("counted").collect()} == {("2020-01-01 00:00:00", "a", 2), ("2020-01-01 01:00:00", "b", 1)}


def test_settings(spark, tmp_path) -> None:  # noqa: ANN001
    s = records.Settings(spark, str(tmp_path / "settings"))
    assert s.get() == records.Settings.DEFAULTS
    assert s.update(skip_xml_validation=True) == {"skip_xml_validation": True, "skip_json_validation": False} == s.get()
    s.initialize()
    assert s.get()["skip_xml_validation"]
    with pytest.raises(KeyError):
        s.update(other=True)


def test_json_schema_keywords() -> None:
    root = {"definitions": {"name": {"type": "string", "pattern": "^[A-Z]", "maxLength": 4}}}
    check = lambda value, rule: sorted(i[0] for i in records.json_issues(value, rule, root | rule))
    cases = [
        ("Ada", {"$ref": "#/definitions/name"}, []), ("adana", {"$ref": "#/definitions/name"}, ["length", "pattern"]), (5, {"minimum": 5, "exclusiveMaximum": 5}, ["exclusiveMaximum"]), (2.5, {"type": "integer"}, ["type"]), (2.0, {"type": "integer"}, []),
        (True, {"type": "number"}, ["type"]), (7, {"multipleOf": 2}, ["multipleOf"]), ({"a": 1, "b": 2}, {"properties": {"a": {}}, "additionalProperties": False}, ["additionalProperties"]), ({"xa": 1}, {"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": False}, ["type"]),
        ([1, 1], {"uniqueItems": True, "maxItems": 1}, ["items", "uniqueItems"]), ([1, "a"], {"items": [{"type": "integer"}], "additionalItems": False}, ["false schema"]), ([1], {"contains": {"type": "string"}}, ["contains"]), (3, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, ["oneOf"]),
        (3, {"anyOf": [{"type": "string"}, {"minimum": 2}]}, []), (3, {"not": {"type": "integer"}}, ["not"]), (3, {"if": {"minimum": 2}, "then": {"const": 4}}, ["const"]), ({"a": 1}, {"dependencies": {"a": ["b"]}, "propertyNames": {"maxLength": 0}}, ["length", "required"]), (1, {"enum": [True]}, ["enum"]),
    ]
    for value, rule, want in cases:
        records.check_schema(rule)
        assert check(value, rule) == want, (value, rule, check(value, rule))
    for bad in ({"type": "strange"}, {"unheard": 1}, {"properties": {"a": {"no such": 1}}}):
        with pytest.raises(ValueError):
            records.check_schema(bad)


def test_no_document_ends_the_run(spark) -> None:  # noqa: ANN001
    deep, huge = "[" * 200_000, "9" * 400
    docs = [("deep", deep), ("huge", f'{{"a": {huge}}}'), ("longer", f'{{"a": {"7" * 9000}}}'), ("nan", '{"a": NaN}'), ("far", '{"a": 1e400}'), ("nested", '{"b": ' * 900 + "1" + "}" * 900), ("one", '{"c": 1.0}'), ("true", '{"c": true}'), ("fine", '{"a": 4.0, "c": 1}'), ("fine", '{"a": 4.0, "c": 1}'), ("null", None)]
    schema = {"type": "object", "properties": {"a": {"type": "number", "multipleOf": 2, "maximum": 100}, "b": {"$ref": "#"}, "c": {"const": 1}}}
    got = {}
    for r in records.validate_json(spark.createDataFrame(docs, "source_file string, content string"), schema).collect():
        got.setdefault(r.file, []).append(r.rule)
    assert {k: sorted(v) for k, v in got.items()} == {"deep": ["depth"], "huge": ["maximum", "multipleOf"], "longer": ["maximum", "multipleOf"], "nan": ["syntax"], "far": ["failed"], "nested": ["depth"], "true": ["const"], "null": ["syntax"]}


def test_bad_references_are_refused(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([("a", "1")], "source_file string, content string")
    for ref in ("#/definitions/gone", "other.json#/a", "#/definitions/loop", "#/allOf/7"):
        with pytest.raises(ValueError):
            records.validate_json(docs, {"definitions": {"loop": {"$ref": "#/definitions/loop"}}, "allOf": [{"$ref": ref}]})
    assert records.validate_json(docs, {"properties": {"$ref": {"type": "string"}}, "allOf": [{"minimum": 1}, {"$ref": "#/allOf/0"}]}).count() == 0


def test_values_are_equal_as_json() -> None:
    same, other = [(1, 1.0), ([1, {"a": 2}], [1.0, {"a": 2.0}]), ("a", "a"), (None, None)], [(1, True), (0, False), ("1", 1), (None, 0), ([], {}), ([1], [1, 1]), ({"a": 1}, {"b": 1}), (None, False)]
    assert all(records._same(a, b) and records._key(a) == records._key(b) for a, b in same)
    assert not any(records._same(a, b) or records._key(a) == records._key(b) for a, b in other)


def test_conversion_shreds_once(spark) -> None:  # noqa: ANN001
    out = records.xml_to_json(rows(spark, ("1", "a.xml", "u", "<a>" * 9 + "x" + "</a>" * 9)))
    assert "MapIn" not in out._jdf.queryExecution().optimizedPlan().toString() and json.loads(out.first().json)


def test_scratch_needs_a_shared_folder() -> None:
    from types import SimpleNamespace

    from docgraph.scratch import scratch_dir

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://there:7077")
    with pytest.raises(ValueError, match="share"):
        scratch_dir(SimpleNamespace(sparkContext=context))


def test_reference_objects() -> None:
    schema = {"definitions": {"exch:MessageType": {"properties": {"nc:Metadata": {"a": 1}, "x:Body": {}}}, "exch:Plain": {"properties": {"nc:Metadata": {}}}, "x:Other": {"properties": {"nc:Metadata": {}, "y": {}}}}}
    out = records.with_reference_objects(schema)
    assert set(out["definitions"]["exch:MessageType"]["properties"]) == {"x:Body", "exch:ReferenceObjects"} and out["definitions"]["exch:ReferenceObjectType"]["properties"] == {"nc:Metadata": {"a": 1}}
    assert "nc:Metadata" in out["definitions"]["x:Other"]["properties"] and "nc:Metadata" in schema["definitions"]["exch:MessageType"]["properties"]


CMF = """<Model xmlns="http://example.org/model/" xmlns:s="http://example.org/structures/6.0/">
<Namespace s:id="n1"><NamespaceURI>urn:t</NamespaceURI><NamespacePrefixText>t</NamespacePrefixText></Namespace>
<Class s:id="t.BoatType"><Name>BoatType</Name><SubClassOf s:ref="t.ThingType" /><ChildPropertyAssociation><DataProperty s:ref="t.Name"/><MinOccursQuantity>1</MinOccursQuantity></ChildPropertyAssociation><ChildPropertyAssociation><DataProperty s:ref="t.Size"/></ChildPropertyAssociation><ChildPropertyAssociation><ObjectProperty s:ref="t.Owner"/></ChildPropertyAssociation></Class>
<DataProperty s:id="t.Name"><Name>Name</Name><Datatype s:ref="xs.string"/></DataProperty><DataProperty s:id="t.Size"><Name>Size</Name><Datatype s:ref="t.SizeType"/></DataProperty><DataProperty s:id="t.Value"><Name>Value</Name><Datatype s:ref="xs.decimal"/></DataProperty><DataProperty s:id="t.Unit"><Name>Unit</Name><Datatype s:ref="t.UnitType"/></DataProperty><DataProperty s:id="t.Code"><Name>Code</Name><Datatype s:ref="xs.token"/></DataProperty>
<ObjectProperty s:id="t.Owner"><Name>Owner</Name><Class s:ref="t.PersonType"/></ObjectProperty>
<Datatype s:id="t.SizeType"><Name>SizeType</Name><ChildPropertyAssociation><DataProperty s:ref="t.Value"/></ChildPropertyAssociation><ChildPropertyAssociation><DataProperty s:ref="t.Unit"/></ChildPropertyAssociation></Datatype>
<Datatype s:id="t.UnitType"><ChildPropertyAssociation><DataProperty s:ref="t.Code"/></ChildPropertyAssociation></Datatype><Restriction s:id="t.GradeType"><RestrictionBase s:ref="xs.string"/></Restriction></Model>"""


def test_model_documents(spark) -> None:  # noqa: ANN001
    e = rows(spark, ("1", "model.xml", "u", CMF)).cache()
    assert [tuple(r) for r in sm.model_prefixes(e).collect()] == [("t", "urn:t")]
    assert {r.id: (r.is_object, r.type_id) for r in sm.model_properties(e).collect()}["t.Owner"] == (True, "t.PersonType")
    assert {r.id: r.kind for r in sm.datatype_classes(e).collect()} == {"t.SizeType": "COMPLEX", "t.UnitType": "WRAPPER", "t.GradeType": "SIMPLE"}
    assert {(r.class_id, r.path, r.depth) for r in sm.scalar_paths(e).collect()} == {("t.BoatType", "t:Name", 1), ("t.BoatType", "t:Size/t:Value", 2), ("t.BoatType", "t:Size/t:Unit/t:Code", 3)}
    (boat,) = sm.model_classes(e).collect()
    assert (boat.name, boat.base, boat.n_properties) == ("BoatType", "t.ThingType", 3)


MODEL = """<Model xmlns="http://example.org/model/" xmlns:s="http://example.org/structures/6.0/">
<Namespace s:id="t"><NamespaceURI>urn:t</NamespaceURI><NamespacePrefixText>t</NamespacePrefixText></Namespace>
<Class s:id="t.BoatType"><Name>BoatType</Name><SubClassOf s:ref="nc.ObjectType"/><ChildPropertyAssociation><DataProperty s:ref="t.Name"/></ChildPropertyAssociation><ChildPropertyAssociation><DataProperty s:ref="t.Size"/></ChildPropertyAssociation><ChildPropertyAssociation><ObjectProperty s:ref="t.Owner"/><MinOccursQuantity>1</MinOccursQuantity><MaxOccursQuantity>1</MaxOccursQuantity></ChildPropertyAssociation></Class>
<Class s:id="t.PersonType"><Name>PersonType</Name></Class>
<Class s:id="t.TripAssociationType"><Name>TripAssociationType</Name><SubClassOf s:ref="nc.AssociationType"/><ChildPropertyAssociation><ObjectProperty s:ref="t.Owner"/></ChildPropertyAssociation><ChildPropertyAssociation><ObjectProperty s:ref="t.Boat"/><MinOccursQuantity>1</MinOccursQuantity></ChildPropertyAssociation></Class>
<ObjectProperty s:id="t.Boat"><Class s:ref="t.BoatType"/></ObjectProperty><ObjectProperty s:id="t.Owner"><Class s:ref="t.PersonType"/></ObjectProperty><ObjectProperty s:id="t.TripAssociation"><Class s:ref="t.TripAssociationType"/></ObjectProperty>
<DataProperty s:id="t.Name"><Datatype s:ref="xs.string"/></DataProperty><DataProperty s:id="t.Size"><Datatype s:ref="t.SizeType"/></DataProperty><DataProperty s:id="t.Value"><Datatype s:ref="xs.decimal"/></DataProperty>
<Datatype s:id="t.SizeType"><ChildPropertyAssociation><DataProperty s:ref="t.Value"/></ChildPropertyAssociation></Datatype></Model>"""


def test_a_model_becomes_a_mapping_that_builds_a_graph(spark) -> None:  # noqa: ANN001
    from docgraph.operators import mapping
    from docgraph.operators.build import build_graph
    from docgraph.plans.model_mapping import model_mapping

    made = model_mapping(rows(spark, ("1", "model.xml", "u", MODEL))).document()
    assert made["namespaces"] == {"t": "urn:t"} and made["metadata"]["element_index"] == ["t:Boat", "t:Name", "t:Owner", "t:Size", "t:TripAssociation", "t:Value"]
    boat, owner = made["objects"]
    assert (boat["qname"], boat["label"], owner["qname"]) == ("t:Boat", "t_Boat", "t:Owner") and boat["scalar_props"] == [{"path": "t:Name", "property": "t_Name"}, {"path": "t:Size/t:Value", "property": "t_Size_t_Value"}]
    (trip,) = made["associations"]
    assert (trip["qname"], trip["rel_type"]) == ("t:TripAssociation", "T_TRIPASSOCIATION")
    assert [(e["role_qname"], e["maps_to_label"], e["direction"], e["cardinality"]) for e in trip["endpoints"]] == [("t:Owner", "t_Owner", "source", "0..*"), ("t:Boat", "t_Boat", "target", "1..*")]
    assert [(r["owner_object"], r["field_qname"], r["target_label"], r["rel_type"], r["cardinality"]) for r in made["references"]] == [("t:Boat", "t:Owner", "t_Owner", "T_OWNER", "1..1")]
    m = mapping.load_mapping(json.dumps(made))
    assert m.endpoints == {"t:TripAssociation": {"t:Owner": "source", "t:Boat": "target"}} and m.references == {("t:Boat", "t:Owner"): "T_OWNER"} and m.objects == ["t:Boat", "t:Owner"]
    text = """<t:Fleet xmlns:t="urn:t" xmlns:s="http://e.org/structures/6.0/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><t:Boat s:id="B"><t:Name>Gull</t:Name><t:Size><t:Value>9</t:Value></t:Size><t:Owner s:ref="P" xsi:nil="true"/></t:Boat>
    <t:Owner s:id="P"/><t:TripAssociation><t:Boat s:ref="B" xsi:nil="true"/><t:Owner s:ref="P" xsi:nil="true"/></t:TripAssociation></t:Fleet>"""
    g = build_graph(rows(spark, ("2", "a.xml", "u", text)), m.objects, m.associations, extra_props=mapping.extra_props(m), extra_edges=lambda e: mapping.mapped_edges(e, m))
    props = g.nodes.filter("sid = 'B'").first().props
    assert props["t_Name"] == "Gull" and props["t_Size_t_Value"] == "9"
    edges = {(r.rel_type, r.dst.split("_", 1)[1], r.props.get("direction")) for r in g.edges.collect()}
    assert {("T_OWNER", "P", None), ("ASSOCIATED_WITH", "B", "target"), ("ASSOCIATED_WITH", "P", "source")} <= edges


def test_elements_by_reach(spark) -> None:  # noqa: ANN001
    from docgraph.plans.model_mapping import element_pairs, nearest_selected, schema_rows

    e = rows(spark, ("1", "main.xsd", "u", XSD)).cache()
    declared, held = sm.declarations(e), sm.members(e)
    got = {r.element: r for r in schema_rows(declared, held).collect()}
    assert (got["Fleet"].depth, got["Boat"].depth, got["Sailor"].depth, got["Age"].depth) == (0, 1, 2, 1)  # Age: below BoatAugmentation, a root
    assert got["TripAssociation"].kind == "association" and got["TripAssociation"].endpoints == ["Boat", "Sailor"] and got["Boat"].augmented == ["t:Age"]
    chosen = spark.createDataFrame([("Fleet",), ("Sailor",), ("Boat",)], "element string")
    assert {(r.element, r.ancestor, r.steps) for r in nearest_selected(element_pairs(declared, held), chosen).collect()} >= {("Sailor", "Boat", 1), ("Boat", "Fleet", 1), ("Age", "Sailor", 1), ("TripAssociation", "Fleet", 1)}
    # Forty levels with two ways each: 2^40 paths, 81 elements.
    pairs = [(f"{k + 1}{s}", f"{k}{t}") for k in range(40) for s in "ab" for t in "ab"]
    deep = nearest_selected(spark.createDataFrame(pairs, "child string, parent string"), spark.createDataFrame([("0a",), ("0b",)], "element string"))
    assert deep.filter("element = '40b'").first()[1:] == ("0a", 40) and deep.count() == 80


def test_element_tree_is_cut_with_a_warning(spark) -> None:  # noqa: ANN001
    declared = spark.createDataFrame([(f"e{k}", f"T{k}") for k in range(15)], "name string, type string")
    held = spark.createDataFrame([(f"T{k}", f"e{k + 1}") for k in range(14)], "type string, element string")
    assert sm.element_tree(declared, held).agg(F.max("depth")).first()[0] == 14
    with pytest.warns(UserWarning, match="cut at 3"):
        assert sm.element_tree(declared, held, 3).agg(F.max("depth")).first()[0] == 3
