from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import scalars
from docgraph.operators import resolve

COLUMNS = ["node_id", "qname", "source_file", "upload_id", *resolve.FEATURES]


def people(spark, *rows: dict):  # noqa: ANN001, ANN201
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], ", ".join(f"{c} string" for c in COLUMNS))


ROWS = [
    {"node_id": "1", "source_file": "a.xml", "upload_id": "u1", "given_name": "Ada", "surname": "Quill", "middle_name": "B", "birth_date": "1970-01-02", "driver_license": "Z9"},
    {"node_id": "2", "source_file": "b.xml", "upload_id": "u2", "given_name": "ada ", "surname": "Quill", "birth_date": "1970-01-02", "driver_license": "Z9"},
    {"node_id": "3", "source_file": "c.xml", "upload_id": "u3", "given_name": "Bo", "surname": "Lark", "birth_date": "1980-03-04"},
    {"node_id": "4", "source_file": "d.xml", "upload_id": "u4", "full_name": "Cy Reed", "ssn": "1"},
    {"node_id": "5", "source_file": "e.xml", "upload_id": "u5", "full_name": "Cy Reid", "ssn": "1"},
    {"node_id": "6", "source_file": "f.xml", "upload_id": "u6", "ssn": "2"},
]


def test_text_clusters(spark) -> None:  # noqa: ANN001
    clusters, members = resolve.text_clusters(people(spark, *ROWS))
    (c,) = clusters.collect()
    assert (c.match_key, c.resolved_count, c.name, c.upload_ids, c.source_docs) == ("ada_quill", 2, "Ada B Quill", ["u1", "u2"], ["a.xml", "b.xml"])
    assert c.entity_id.startswith("RE_") and len(c.entity_id) == 15
    assert {(m.node_id, m.matched_on) for m in members.collect()} == {("1", "given_name+surname"), ("2", "given_name+surname")}
    assert resolve.text_clusters(people(spark))[0].count() == 0


def test_scored_clusters(spark) -> None:  # noqa: ANN001
    twins = [{**ROWS[0], "node_id": f"t{k}"} for k in range(30)]
    got = resolve.scored_clusters(people(spark, *ROWS, *twins)).groupBy("entity_id").agg(F.array_sort(F.collect_list("node_id")).alias("m")).collect()
    assert sorted(r.m for r in got) == [sorted(["1", "2", *(t["node_id"] for t in twins)]), ["4", "5"]]
    details = resolve.match_details(resolve.scored_links(people(spark, *ROWS))).collect()
    assert sum(r.n for r in details if r.kind == "quality") == 1  # 1 and 2 are one feature set


def test_features_and_lifting(spark) -> None:  # noqa: ANN001
    nodes = spark.createDataFrame([("p", "x:Driver", {"x_DriverLicenseIdentification": "L1"}), ("n", "nc:PersonName", {"nc_PersonGivenName": "Ada", "nc_PersonSurName": "Quill"}), ("q", "x:Driver", {"other": "1"}), ("a", "x:Driver", {"x_EmailAddress": "m", "x_HomeAddress": "Road 1"})], "id string, qname string, props map<string,string>")
    nodes = nodes.withColumn("source_file", F.lit("f")).withColumn("upload_id", F.lit("u"))
    edges = spark.createDataFrame([("p", "n", "CONTAINS"), ("p", "a", "KNOWS"), ("q", "p", "KNOWS")], "src string, dst string, rel_type string")
    got = {r.node_id: r for r in resolve.extract_features(nodes, edges, ["x:Driver"]).collect()}
    assert set(got) == {"p", "a"} and (got["p"].given_name, got["p"].surname, got["p"].driver_license) == ("Ada", "Quill", "L1") and got["a"].address == "Road 1"
    found = {r.qname: r for r in resolve.discover_types(nodes, edges).collect()}
    assert found["x:Driver"].category == "person" and found["x:Driver"].attributes >= 3 and found["x:Driver"].recommended
    members = spark.createDataFrame([("p", "R1"), ("a", "R2"), ("q", "R1")], "node_id string, entity_id string")
    lifted = {(r.src, r.dst, r.rel_type, r.n) for r in resolve.lift_edges(edges, members).collect()}
    assert lifted == {("R1", "R2", "KNOWS", 1), ("R1", "R1", "KNOWS", 1)}
    record = resolve.matcher_records(nodes.withColumn("list_props", F.create_map(F.lit("PhoneNo"), F.array(F.lit("1"), F.lit("2")))), {"nc_PersonGivenName": "NAME_FIRST", "nc_PhoneNo": "PHONE", "PersonSurName": "NAME_LAST"}, ["PHONE"])
    import json

    first = json.loads(record.filter("node_id = 'n'").first().record)
    assert (first["NAME_FIRST"], first["PHONE"], first["RECORD_TYPE"], first["RECORD_ID"]) == ("Ada", "1;2", "PERSON", "n") and "NAME_LAST" not in first
    top = resolve.search(people(spark, *ROWS), {"full_name": "cy reed"}, 2).collect()
    assert [r.node_id for r in top] == ["4", "5"]


def test_a_run_ends_early(spark) -> None:  # noqa: ANN001
    nodes = spark.createDataFrame([("1", "x:Driver", {"PersonFullName": "Ada Quill"}), ("2", "x:Driver", {"PersonFullName": "ada quill"}), ("3", "x:Car", {"Colour": "red"}), ("4", "x:Lone", {"PersonFullName": "Bo"})], "id string, qname string, props map<string,string>")
    nodes = nodes.withColumn("source_file", F.lit("f")).withColumn("upload_id", F.lit("u"))
    edges = spark.createDataFrame([("1", "2", "KNOWS"), ("2", "3", "OWNS")], "src string, dst string, rel_type string")
    run = lambda *q: resolve.run_resolution(nodes, edges, list(q))
    assert run().status == "error"
    assert (run("x:Car").counts["entities_extracted"], run("x:Lone").message) == (0, "all entities are unique")
    done = run("x:Driver", "x:Lone")
    assert done.counts == {"entities_extracted": 3, "duplicate_groups": 1, "clusters_created": 1, "relationships_created": 3, "entities_resolved": 2}
    assert tuple(resolve.status(nodes, done.clusters, done.members).first()) == (4, 1, 2)


def test_scalar_rules(spark) -> None:  # noqa: ANN001
    row = spark.range(1).select(
        scalars.normal_date(F.lit("01/15/2025")).alias("a"), scalars.normal_date(F.lit("1890-5-4")).alias("b"), scalars.normal_date(F.lit("soon")).alias("c"),
        scalars.confidence(F.lit(95.0)).alias("d"), scalars.confidence(F.lit(950.0)).alias("e"), scalars.confidence(F.lit(None).cast("double")).alias("f"),
        scalars.match_key_words(F.lit("+NAME+DOB")).alias("g"), scalars.entity_key(F.lit(" Jan  Ohl\t"), F.lit(None).cast("string"), F.lit("x")).alias("h"), scalars.category(F.lit("j:CrashDriver")).alias("i"),
        F.size(scalars.values_of(F.lit('["a","b"]'))).alias("k"), scalars.short_label(F.lit("x" * 40)).alias("l"), scalars.key_ends(F.lit("nc_Person-Given_Name"), "PersonGivenName").alias("m"),
    ).first()
    assert tuple(row)[:11] == ("2025-01-15", "1890-05-04", "soon", 0.95, 0.95, 0.0, "Name + Date Of Birth", "jan__ohl", "person", 2, "x" * 22 + "...") and row["m"]
    lines = spark.createDataFrame([("[error] a.xsd:3:7: bad thing",), ("WARN b.xsd:1:2 -- Rule 9-1: odd",), ("free text",), ("[Warning] no place here",)], "line string")
    got = [tuple(r) for r in lines.select(*[c.alias(k) for k, c in scalars.issue_fields(F.col("line"), F.when(F.col("line").startswith("[W"), "in.xml")).items()]).collect()]
    assert got == [("a.xsd", 3, 7, "error", None, "bad thing"), ("b.xsd", 1, 2, "warning", "Rule 9-1", "odd"), (None, None, None, "error", None, "free text"), ("in.xml", None, None, "warning", None, "no place here")]


def test_scored_links_equal_all_pairs(spark) -> None:  # noqa: ANN001
    """Every pair that the score links is found, whichever features bring it there."""
    import random

    rng = random.Random(3)
    names = ["ann lee", "an lee", "anna lee", "bann le", "a", "bc", "old_anvil", "cold_anvil", "gold anvils", "quite another", None]
    pick = lambda *v: rng.choice([None, *v])
    rows = [{"node_id": f"{k:03}", "full_name": rng.choice(names), "ssn": pick(None, None, "1", "2"), "driver_license": pick(None, None, "L1"), "birth_date": pick("1970", "1980"), "address": pick("r1", "r2"), "phone": pick("p1", "p2", "p3"), "email": pick(None, "e1", "e2")} for k in range(150)]
    sets = resolve.feature_sets(people(spark, *rows)).groupBy("name", "ssn", "driver_license", "birth_date", "address", "phone", "email").agg(F.min("node_id").alias("node_id")).collect()
    s = resolve.Scoring()

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    def score(x, y) -> float:  # noqa: ANN001
        total = 0.0
        for c, w in s.agree.items():
            if x[c] is not None and y[c] is not None:
                same = distance(x[c], y[c]) <= s.near_name if c == "name" else x[c] == y[c]
                total += w if same else s.differ.get(c, 0.0)
        return total

    want = {(x.node_id, y.node_id): score(x, y) for x in sets for y in sets if x.node_id < y.node_id and score(x, y) >= s.least}
    assert {(r.a, r.b): r.score for r in resolve.scored_links(people(spark, *rows)).collect()} == want
    assert any(x.ssn is None and x.email is None and x.birth_date is None and (x.node_id, y.node_id) in want for x in sets for y in sets)
