"""Element rows to a labelled property graph, as joins and groupings by document.

Order of decisions: augmentations are never nodes; associations come before objects; nil references are no nodes; the
root is one if it is complex; then mapped names, or, without a mapping, complex elements. A uri that two or more
elements carry becomes a hub node which its roles represent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.scratch import written


def to_label(qname: Column) -> Column:
    return F.translate(qname, ":.", "__")


def to_rel_type(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, r"\W", "_"))


def uri_to_id(uri: Column) -> Column:
    """The part after #, or else the last part of the path with : as _."""
    tail = F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.translate(tail, ":", "_"))


def prefix() -> Column:
    """What file and upload share: eight digits, as they are shown. Ids of a built graph go on with the document's own (``id_prefix``)."""
    return F.substring(F.sha1(F.concat_ws("_", "source_file", "upload_id")), 1, 8)


def id_prefix() -> Column:
    """Before the ids of a document's nodes: ``prefix`` and 96 bits of the whole document id, so that files of one name stay apart."""
    return F.concat(prefix(), F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 24))


def synthetic_id(spot: Column) -> Column:
    """Id of an element without one, from where it stands."""
    return F.concat(F.lit("syn_"), F.substring(F.sha1(spot), 1, 16))


def flat_key(names: Column) -> Column:
    """Property key of a value below its node: the names on the way, joined by two underscores."""
    return F.array_join(F.transform(names, to_label), "__")


@dataclass
class Graph:
    """``nodes``, ``props`` (one row a value), ``edges``; ``issues`` has documents that failed, ids that two elements carry, and
    references without a target."""

    nodes: DataFrame
    props: DataFrame
    edges: DataFrame
    issues: DataFrame


def detect_associations(elements: DataFrame) -> DataFrame:
    """(doc_id, ord) of elements named ...Association with two or more children that refer to others."""
    refs = elements.filter(F.col("sref").isNotNull() | F.col("suri").isNotNull() | F.col("sid").isNotNull()).groupBy("doc_id", F.col("parent_ord").alias("ord")).agg(F.count("*").alias("n"))
    return elements.filter(F.col("qname").endswith("Association")).select("doc_id", "ord").join(refs.filter("n >= 2"), ["doc_id", "ord"], "left_semi")


def find_hubs(elements: DataFrame) -> DataFrame:
    """(doc_id, uri_id, role_count, role_types) of uris on two or more elements that are not nil and have no id."""
    roles = elements.filter("uri_id IS NOT NULL AND sid IS NULL AND NOT is_nil")
    return roles.groupBy("doc_id", "uri_id").agg(F.count("*").alias("role_count"), F.array_sort(F.collect_set("qname")).alias("role_types")).filter("role_count >= 2")


def classify(elements: DataFrame, objects: list[str] | None = None, associations: list[str] | None = None, sibling_ids: bool = True) -> DataFrame:
    """Adds is_aug, is_assoc, is_role, is_node and id. ``objects``: the mapped names; None: every complex element.

    Only elements with a uri can be roles and only those named so associations: the others pass no join.
    """
    e = elements.filter("error IS NULL").withColumn("uri_id", uri_to_id(F.col("suri")))
    hubs = find_hubs(e.filter("suri IS NOT NULL")).select("doc_id", "uri_id", F.lit(True).alias("hubbed"))
    named = F.lit(False) if associations is not None else F.coalesce(F.col("qname").endswith("Association"), F.lit(False))
    known = F.lit(False) if not associations else F.col("qname").isin(associations)
    joined = e.filter(F.col("suri").isNotNull() | named)
    if associations is None:
        joined = joined.join(detect_associations(e).withColumn("is_assoc", F.lit(True)), ["doc_id", "ord"], "left")
    else:
        joined = joined.withColumn("is_assoc", known)
    rest = e.filter(F.col("suri").isNull() & ~named).withColumns({"is_assoc": known, "hubbed": F.lit(None).cast("boolean")})
    e = joined.join(hubs, ["doc_id", "uri_id"], "left").unionByName(rest).withColumn("is_assoc", F.coalesce("is_assoc", F.lit(False)))
    is_complex = F.col("sid").isNotNull() | F.col("suri").isNotNull() | (F.col("n_children") > 0) | (F.size("attrs") > 0)
    nil_ref = (F.col("sref").isNotNull() | F.col("suri").isNotNull()) & F.col("is_nil")
    is_aug = F.col("qname").endswith("Augmentation")
    wanted = is_complex if objects is None else (F.col("qname").isin(objects) if objects else F.lit(False))
    steps = F.concat_ws("/", F.col("qpath"), "qname")
    spot = F.concat_ws("|", steps, F.concat_ws(".", F.col("path").cast("array<string>")), F.col("sib_ord").cast("string")) if sibling_ids else steps
    role = F.col("hubbed").isNotNull() & F.col("sid").isNull() & ~F.col("is_nil")
    return e.select(
        "*", is_aug.alias("is_aug"), role.alias("is_role"),
        (~is_aug & ~nil_ref & (F.col("is_assoc") | F.when(F.col("parent_ord").isNull(), is_complex).otherwise(wanted))).alias("is_node"),
        F.concat_ws("_", id_prefix(), F.coalesce("sid", F.when(~role, F.col("uri_id")), synthetic_id(spot))).alias("id"),
    )


def with_owner(e: DataFrame) -> DataFrame:
    """Adds the nearest ancestor that is a node: owner (id), owner_ord, owner_depth, owner_assoc; null at the top.

    What stands right below a root takes it by the root's place, deeper elements look through all that is above them; the wide
    rows are joined once.
    """
    n_above, found = F.coalesce(F.size("path"), F.lit(0)), F.max(F.struct("a_depth", "a_ord", "a_id", "a_assoc")).alias("o")
    nodes = e.filter("is_node").select("doc_id", F.col("ord").alias("a_ord"), F.col("depth").alias("a_depth"), F.col("id").alias("a_id"), F.col("is_assoc").alias("a_assoc"), n_above.alias("n_above"))
    roots = nodes.filter("n_above < 1").groupBy("doc_id", "a_ord").agg(found).select("doc_id", F.lit(True).alias("by_root"), F.col("a_ord").alias("place"), "o")
    above = e.filter(n_above > 1).select("doc_id", "ord", F.explode("path").alias("a_ord"))
    near = above.join(nodes, ["doc_id", "a_ord"]).groupBy("doc_id", "ord").agg(found).select("doc_id", F.lit(False).alias("by_root"), F.col("ord").alias("place"), "o")
    placed = e.withColumns({"by_root": F.when(n_above > 0, n_above == 1), "place": F.when(n_above == 1, F.element_at("path", 1)).otherwise(F.col("ord"))})
    every = placed.join(roots.unionByName(near), ["doc_id", "by_root", "place"], "left").drop("by_root", "place")
    return every.select("*", F.col("o.a_id").alias("owner"), F.col("o.a_ord").alias("owner_ord"), F.col("o.a_depth").alias("owner_depth"), F.coalesce("o.a_assoc", F.lit(False)).alias("owner_assoc")).drop("o")


def flatten_props(e: DataFrame) -> DataFrame:
    """One row a value: leaves below their owner as a__b__c, attributes as ...__@name, a node's own text as _text."""
    below = F.filter(F.slice(F.col("qpath"), F.col("owner_depth") + 2, F.greatest(F.col("depth") - F.col("owner_depth") - 1, F.lit(0))), lambda q: ~q.endswith("Augmentation"))
    key = flat_key(F.concat(below, F.array("qname")))
    through = F.exists(F.slice(F.col("qpath"), F.col("owner_depth") + 2, F.greatest(F.col("depth") - F.col("owner_depth") - 1, F.lit(0))), lambda q: q.endswith("Augmentation"))
    plain = e.filter("NOT is_node AND NOT is_aug AND owner IS NOT NULL")
    leaves = plain.filter("text IS NOT NULL AND n_children = 0").select("doc_id", F.col("owner").alias("id"), key.alias("key"), "ord", F.col("text").alias("value"), through.alias("is_augmentation"))
    attributes = plain.select("doc_id", F.col("owner").alias("id"), key.alias("k"), "ord", through.alias("is_augmentation"), F.explode("attrs").alias("a", "value"))
    attributes = attributes.select("doc_id", "id", F.concat("k", F.lit("__@"), to_label(F.col("a"))).alias("key"), "ord", "value", "is_augmentation")
    own = e.filter("is_node").select("doc_id", "id", "ord", F.explode("attrs").alias("a", "value")).select("doc_id", "id", to_label(F.col("a")).alias("key"), "ord", "value", F.lit(False).alias("is_augmentation"))
    text = e.filter("is_node AND text IS NOT NULL").select("doc_id", "id", F.lit("_text").alias("key"), "ord", F.col("text").alias("value"), F.lit(False).alias("is_augmentation"))
    marks = leaves.filter("is_augmentation").groupBy("doc_id", "id", F.concat("key", F.lit("_isAugmentation")).alias("key")).agg(F.min("ord").alias("ord")).select("*", F.lit("true").alias("value"), F.lit(False).alias("is_augmentation"))
    return leaves.unionByName(attributes).unionByName(own).unionByName(text).unionByName(marks)


def id_collisions(e: DataFrame) -> DataFrame:
    """(doc_id, source_file, upload_id, sid, n, qnames) of ids that two or more elements carry; the first of them counts."""
    return e.filter("sid IS NOT NULL").groupBy("doc_id", "source_file", "upload_id", "sid").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("qname")).alias("qnames")).filter("n >= 2")


def represents(e: DataFrame, ids: Column | None = None) -> DataFrame:
    """Edges from roles to the hubs of their uris. ``ids``: what ids begin with, ``id_prefix`` by default."""
    return _edge(e.filter("is_role AND is_node"), "id", F.concat_ws("_", id_prefix() if ids is None else ids, "uri_id"), "REPRESENTS", F.create_map(F.lit("id_value"), F.col("uri_id"), F.lit("role_qname"), F.col("qname")))


def association_edges(e: DataFrame, ids: Column | None = None) -> DataFrame:
    """Edges from associations to what their children refer to; the first child in order is the source. ``ids`` as in ``represents``."""
    parents = e.filter("is_assoc AND is_node").select("doc_id", F.col("ord").alias("parent_ord"), F.col("id").alias("assoc_id"))
    ends = e.filter("sref IS NOT NULL OR suri IS NOT NULL OR sid IS NOT NULL").join(parents, ["doc_id", "parent_ord"])
    first = F.min("ord").over(Window.partitionBy("doc_id", "assoc_id"))
    ends = ends.withColumn("dst_id", F.concat_ws("_", id_prefix() if ids is None else ids, F.coalesce("sref", "uri_id", "sid"))).withColumn("direction", F.when(F.col("ord") == first, "source").otherwise("target"))
    return _edge(ends, "assoc_id", F.col("dst_id"), "ASSOCIATED_WITH", F.create_map(F.lit("role_qname"), F.col("qname"), F.lit("direction"), F.col("direction")))


def wide_association_edges(rows: DataFrame, assoc_id: Column, ends: list[tuple[str, Column]], ids: Column) -> DataFrame:
    """Edges of associations that come one a row with their ends in columns, in order: (role name, id of what it refers to).

    The same edges as ``association_edges`` gives, in one pass over the rows, without a join: equal rows keep their own edges.
    An end that is null is none; the first that isn't is the source.
    """
    each = F.filter(F.array(*[F.struct(F.lit(role).alias("role"), end.cast("string").alias("end")) for role, end in ends]), lambda x: x["end"].isNotNull())
    one = rows.select("*", assoc_id.alias("src"), F.posexplode(each).alias("place", "x"))
    direction = F.when(F.col("place") == 0, "source").otherwise("target")
    return _edge(one.withColumn("ord", F.col("place")), "src", F.concat_ws("_", ids, "x.end"), "ASSOCIATED_WITH", F.create_map(F.lit("role_qname"), F.col("x.role"), F.lit("direction"), direction))


def gather_props(props: DataFrame) -> DataFrame:
    """(doc_id, id, props, list_props): one value a key as a map, several as ordered lists."""
    one = props.groupBy("doc_id", "id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("v"))
    entry = F.struct("key", "v")
    got = one.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    single = F.filter("all", lambda x: F.size(x["v"]) == 1)
    many = F.filter("all", lambda x: F.size(x["v"]) > 1)
    return got.select("doc_id", "id", F.map_from_entries(F.transform(single, lambda x: F.struct(x["key"], x["v"][0]))).alias("props"), F.map_from_entries(many).alias("list_props"))


_EDGE = ["doc_id", "src", "dst", "rel_type", "props", "confidence", "source_file", "upload_id", "ord"]


def _edge(df: DataFrame, src: str, dst: Column, rel: str, props: Column | None = None, confidence: Column | None = None) -> DataFrame:
    return df.select("doc_id", F.col(src).alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), (props if props is not None else F.create_map().cast("map<string,string>")).alias("props"), (confidence if confidence is not None else F.lit(None).cast("string")).alias("confidence"), "source_file", "upload_id", "ord")


def reference_attributes(e: DataFrame) -> DataFrame:
    """Edges from attributes that refer: by name (medium confidence), or by a value that looks like ids (low)."""
    local = F.element_at(F.split("a", ":"), -1)
    named = local.rlike("[Rr]ef(erence)?$") | (F.lower(local).contains("metadata") & F.lower(local).contains("ref"))
    like_ids = F.col("v").rlike(r"^[A-Za-z0-9_-]+(\s+[A-Za-z0-9_-]+)*$")
    one = e.filter("is_node").select("*", F.explode("attrs").alias("a", "v")).filter(F.col("v") != "")
    one = one.withColumn("trust", F.when(named, "medium").when(like_ids, "low")).filter("trust IS NOT NULL")
    one = one.withColumn("target", F.explode(F.split(F.trim("v"), r"\s+"))).withColumn("dst_id", F.concat_ws("_", id_prefix(), "target")).filter("id <> dst_id")
    return _edge(one, "id", F.col("dst_id"), "REFERS_TO", F.create_map(F.lit("source_attribute"), F.col("a")), F.col("trust"))


def _issue(df: DataFrame, severity: str, rule: str, message: Column, context: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(F.col("source_file").alias("file"), none.cast("int").alias("line"), none.cast("int").alias("col"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"), (none if context is None else context).cast("string").alias("context"), "doc_id", "upload_id")


def build_graph(
    elements: DataFrame, objects: list[str] | None = None, associations: list[str] | None = None, sibling_ids: bool = True, close_containment: bool = True, extra_props: Callable[[DataFrame], DataFrame] | None = None,
    extra_edges: Callable[[DataFrame], DataFrame] | None = None,
) -> Graph:
    """The graph of all documents. All groupings and joins are by document, so equal ids of two uploads stay apart.

    ``sibling_ids=False`` gives siblings of one name and no id a common id, and they merge. ``extra_props`` gives more rows of
    ``props`` from the classified elements, as the functions of ``operators.mapping`` do, and ``extra_edges`` more edges, in
    whose place the same ones found without a mapping do not come. Documents are shredded once: the
    elements, and what they are found to be, are written before the tables are made of them.
    """
    elements = written(elements, "elements")
    failed = _issue(elements.filter("error IS NOT NULL"), "error", "parse", F.col("error"))
    e = written(with_owner(classify(elements, objects, associations, sibling_ids)), "classified")
    props = flatten_props(e)
    if extra_props is not None:  # a mapped value may have the key that it has as a flattened one
        props = props.unionByName(extra_props(e)).dropDuplicates(["doc_id", "id", "key", "ord", "value"])
    file_columns = ["source_file", "upload_id"]
    base = e.filter("is_node").select("doc_id", "id", to_label(F.col("qname")).alias("label"), "qname", "sid", "suri", "sref", F.col("parent_ord").isNull().alias("is_root"), "is_role", F.lit(False).alias("is_hub"), "is_assoc", F.lit(False).alias("is_unresolved"), *file_columns, "ord")
    roots = e.filter("parent_ord IS NULL").select("doc_id", F.col("id").alias("root_id"), *file_columns)
    hubs = find_hubs(e).join(roots, "doc_id").withColumn("hub", F.concat_ws("_", id_prefix(), "uri_id"))
    hub_nodes = hubs.select("doc_id", F.col("hub").alias("id"), F.concat(F.lit("Entity_"), "uri_id").alias("label"), F.lit(None).cast("string").alias("qname"), F.lit(None).cast("string").alias("sid"), F.col("uri_id").alias("suri"), F.lit(None).cast("string").alias("sref"), F.lit(False).alias("is_root"), F.lit(False).alias("is_role"), F.lit(True).alias("is_hub"), F.lit(False).alias("is_assoc"), F.lit(False).alias("is_unresolved"), *file_columns, F.lit(-1).alias("ord"))
    hub_props = hubs.select("doc_id", F.col("hub").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("role_count")), F.array(F.array(F.col("role_count").cast("string"))))).alias("key", "vs")).unionByName(hubs.select("doc_id", F.col("hub").alias("id"), F.lit("role_types").alias("key"), F.col("role_types").alias("vs")))
    hub_props = hub_props.select("doc_id", "id", "key", F.posexplode("vs").alias("ord", "value")).select("doc_id", "id", "key", "ord", "value", F.lit(False).alias("is_augmentation"))
    contains = _edge(e.filter("is_node AND owner IS NOT NULL"), "owner", F.col("id"), "CONTAINS")
    if not close_containment:
        contains = _edge(e.filter("is_node AND owner IS NOT NULL AND NOT is_assoc"), "owner", F.col("id"), "CONTAINS")
    else:
        contains = contains.unionByName(_edge(hubs.withColumn("ord", F.lit(-1)), "root_id", F.col("hub"), "CONTAINS"))
    associated = association_edges(e)
    refs = e.filter("sref IS NOT NULL AND owner IS NOT NULL AND NOT owner_assoc").withColumn("dst_id", F.concat_ws("_", id_prefix(), "sref")).filter("owner <> dst_id")
    referred = _edge(refs, "owner", F.col("dst_id"), "REFERS_TO")
    nodes = merge_nodes(base.unionByName(hub_nodes))
    wanted = associated.unionByName(referred).groupBy("doc_id", F.col("dst").alias("id"), "source_file", "upload_id").agg(F.min_by(F.concat_ws(" ", "rel_type", F.lit("from"), "src"), F.struct("ord", "src")).alias("context"))
    lost = wanted.join(nodes.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    unresolved = lost.select("doc_id", "id", F.lit("Unresolved").alias("label"), *[F.lit(None).cast("string").alias(c) for c in ("qname", "sid", "suri", "sref")], *[F.lit(v).alias(c) for c, v in (("is_root", False), ("is_role", False), ("is_hub", False), ("is_assoc", False), ("is_unresolved", True))], *file_columns, F.lit(-2).alias("ord"))
    found = contains
    if extra_edges is not None:
        mapped = written(extra_edges(e), "mapped-edges")
        keys = ["doc_id", "src", "dst", "rel_type"]
        found, associated, referred = contains.unionByName(mapped), *[x.join(mapped.select(keys), keys, "left_anti").select(x.columns) for x in (associated, referred)]
    edges = merge_edges(found.unionByName(represents(e)).unionByName(associated).unionByName(referred).unionByName(reference_attributes(e)))
    all_props = props.unionByName(hub_props)
    full = nodes.unionByName(unresolved).join(gather_props(all_props), ["doc_id", "id"], "left").withColumnRenamed("is_assoc", "is_association")
    twice = _issue(id_collisions(e), "warning", "id_collision", F.concat(F.lit("id "), "sid", F.lit(" is on "), F.array_join("qnames", ", ")))
    missing = _issue(lost, "warning", "unresolved_reference", F.concat(F.lit("no element "), "id"), F.col("context"))
    return Graph(full.withColumn("labels", F.array("label")), all_props, edges, failed.unionByName(twice).unionByName(missing))


def labelled_edges(graph: Graph) -> DataFrame:
    """Edges with the labels of the nodes at their ends; null where there is no node."""
    label = lambda c, name: graph.nodes.select("doc_id", F.col("id").alias(c), F.col("label").alias(name))
    return graph.edges.join(label("src", "src_label"), ["doc_id", "src"], "left").join(label("dst", "dst_label"), ["doc_id", "dst"], "left")


def merge_nodes(nodes: DataFrame, keys: tuple[str, ...] = ("doc_id", "id")) -> DataFrame:
    """One row a key: the first in document order wins. Combined before the shuffle."""
    rest = [c for c in nodes.columns if c not in keys]
    first = nodes.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col("ord"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest if c != "ord"])).alias("x"))
    return first.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*nodes.columns)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (document, source, target, type): the first in document order wins."""
    keys = ["doc_id", "src", "dst", "rel_type"]
    rest = [c for c in edges.columns if c not in keys]
    first = edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ord", F.coalesce("confidence", F.lit("")), F.to_json("props"))).alias("x"))
    return first.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*edges.columns)


def resolved_edges(graph: Graph) -> DataFrame:
    """Edges whose target is a node."""
    return graph.edges.join(graph.nodes.select("doc_id", F.col("id").alias("dst")), ["doc_id", "dst"], "left_semi")


def document_stats(graph: Graph) -> DataFrame:
    """Counts of nodes and of edges by type for each file."""
    n = graph.nodes.groupBy("source_file", "upload_id").agg(F.count("*").alias("nodes"))
    e = graph.edges.groupBy("source_file", "upload_id").agg(F.count_if(F.col("rel_type") == "CONTAINS").alias("contains"), F.count_if(F.col("rel_type") != "CONTAINS").alias("edges"))
    return n.join(e, ["source_file", "upload_id"], "left").fillna(0)
