"""Mapping mode: what a mapping names is taken from documents by path; what a model does not know is found.

A mapping is a plain document: objects with scalar properties by path, associations with endpoints, references, and
augmentations. Functions below take the classified elements of ``build`` (before or after they have owners).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.operators.build import id_prefix, to_label, uri_to_id

PROPS = ["doc_id", "id", "key", "ord", "value", "is_augmentation"]


@dataclass
class Mapping:
    """``scalars``: object -> path -> property key; ``augmentations``: augmentation element -> child element -> property key."""

    objects: list[str] = field(default_factory=list)
    associations: list[str] = field(default_factory=list)
    scalars: dict[str, dict[str, str]] = field(default_factory=dict)
    augmentations: dict[str, dict[str, str]] = field(default_factory=dict)
    #: association -> role -> direction; and (object, field) -> type of the edge to what the field refers to.
    endpoints: dict[str, dict[str, str]] = field(default_factory=dict)
    references: dict[tuple[str, str], str] = field(default_factory=dict)


def _key(entry: dict, otherwise: str) -> str:
    """The property's name: ``property``, or what a mapping of another origin calls ``..._property``."""
    return next((v for k, v in entry.items() if k == "property" or k.endswith("_property")), None) or otherwise


def default_key(path: str) -> str:
    return path.replace(":", "_").replace("/", "_").replace("@", "")


def load_mapping(text: str) -> Mapping:
    """From JSON, or from YAML where a parser for it is installed. Entries without a name are refused."""
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError("a mapping is an object")
    named = lambda part, key="qname": [x[key] for x in raw.get(part) or []]
    scalars = {o["qname"]: {p["path"]: _key(p, default_key(p["path"])) for p in o.get("scalar_props") or []} for o in raw.get("objects") or []}
    augmentations = {a["qname"]: {p["qname"]: _key(p, default_key(p["qname"])) for p in a.get("properties") or []} for a in raw.get("augmentations") or []}
    endpoints = {a["qname"]: {x["role_qname"]: x.get("direction") or "target" for x in a.get("endpoints") or []} for a in raw.get("associations") or []}
    references = {(r["owner_object"], r["field_qname"]): r["rel_type"] for r in raw.get("references") or []}
    return Mapping(named("objects"), named("associations"), {q: p for q, p in scalars.items() if p}, augmentations, {q: x for q, x in endpoints.items() if x}, references)


def mapped_scalars(e: DataFrame, scalars: dict[str, dict[str, str]]) -> DataFrame:
    """Rows of props: for each node of a mapped object the text at each path below it, taking the first child of a name at
    every step; ``@name`` takes an attribute. All paths go down together, one join a level."""
    spark = e.sparkSession
    rules = [(q, path, key) for q, paths in scalars.items() for path, key in paths.items()]
    table = spark.createDataFrame(rules, "qname string, path string, key string")
    nodes = e.filter("is_node").select("doc_id", "id", "qname", "ord", "attrs").join(table, "qname")  # as small as the mapping: Spark sends it if its size allows
    name = F.substring_index("path", "@", -1)
    value = F.coalesce(F.try_element_at("attrs", name), F.try_element_at("attrs", F.substring_index(name, ":", -1)))
    attributes = nodes.filter(F.col("path").startswith("@")).withColumn("value", value).filter("value IS NOT NULL")
    out = attributes.select("doc_id", "id", "key", "ord", "value", F.lit(False).alias("is_augmentation"))
    now = nodes.filter(~F.col("path").startswith("@")).select("doc_id", "id", "key", F.col("ord").alias("parent_ord"), F.split("path", "/").alias("steps"))
    child = e.filter("sib_ord = 1").select("doc_id", "parent_ord", F.col("qname").alias("step"), F.col("ord").alias("c_ord"), "text")
    for k in range(max([len(p.split("/")) for _, p, _ in rules if p[0] != "@"], default=0)):
        at = now.withColumn("step", F.col("steps")[k]).join(child, ["doc_id", "parent_ord", "step"])
        there = at.filter((F.size("steps") == k + 1) & F.col("text").isNotNull())
        out = out.unionByName(there.select("doc_id", "id", "key", F.col("c_ord").alias("ord"), F.col("text").alias("value"), F.lit(False).alias("is_augmentation")))
        now = at.filter(F.size("steps") > k + 1).select("doc_id", "id", "key", F.col("c_ord").alias("parent_ord"), "steps")
    return out


def mapped_augmentations(e: DataFrame, augmentations: dict[str, dict[str, str]]) -> DataFrame:
    """Rows of props: texts of the named children of augmentations, on the node that the augmentation belongs to."""
    rules = [(aug, child, key) for aug, children in augmentations.items() for child, key in children.items()]
    table = e.sparkSession.createDataFrame(rules, "aug string, qname string, key string")
    parents = e.select("doc_id", F.col("ord").alias("parent_ord"), F.col("qname").alias("aug"))
    child = e.filter("text IS NOT NULL AND owner IS NOT NULL").join(parents, ["doc_id", "parent_ord"]).join(table, ["aug", "qname"])
    return child.select("doc_id", F.col("owner").alias("id"), "key", "ord", F.col("text").alias("value"), F.lit(True).alias("is_augmentation"))


def _ends(e: DataFrame) -> DataFrame:
    """Elements that name another, with the id that they name."""
    return e.filter("sref IS NOT NULL OR suri IS NOT NULL").withColumn("end", F.concat_ws("_", id_prefix(), F.coalesce("sref", uri_to_id(F.col("suri")))))


def mapped_edges(e: DataFrame, mapping: Mapping) -> DataFrame:
    """Edges that a mapping names: from objects over their reference fields, and from associations over their roles, each with the
    type or direction that the mapping gives. Rules are joined as the small table they are."""
    spark = e.sparkSession
    rules = [(q, f, t, None) for (q, f), t in mapping.references.items()] + [(q, r, "ASSOCIATED_WITH", d) for q, roles in mapping.endpoints.items() for r, d in roles.items()]
    table = spark.createDataFrame(rules, "owner_qname string, qname string, rel string, direction string")
    owners = e.filter("is_node").select("doc_id", F.col("ord").alias("parent_ord"), F.col("qname").alias("owner_qname"), F.col("id").alias("from"))
    met = _ends(e).join(owners, ["doc_id", "parent_ord"]).join(table, ["owner_qname", "qname"])
    props = F.map_filter(F.create_map(F.lit("role_qname"), F.when(F.col("direction").isNotNull(), F.col("qname")), F.lit("direction"), F.col("direction")), lambda k, v: v.isNotNull())
    return met.select("doc_id", F.col("from").alias("src"), F.col("end").alias("dst"), F.col("rel").alias("rel_type"), props.alias("props"), F.lit(None).cast("string").alias("confidence"), "source_file", "upload_id", "ord")


def extra_props(mapping: Mapping):  # noqa: ANN201
    """For ``build_graph``: all that a mapping adds to the properties."""
    return lambda e: mapped_scalars(e, mapping.scalars).unionByName(mapped_augmentations(e, mapping.augmentations))


def unknown_elements(e: DataFrame, known: DataFrame) -> DataFrame:
    """Elements whose name is not in the model (``known``: qname)."""
    return e.filter("error IS NULL").join(known.select("qname").distinct(), "qname", "left_anti")


def unmapped_properties(e: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, id, key, values): what associations carry that the model does not know, as aug_ properties of their edges:
    attributes, and the texts of children without children, several as a list in order."""
    owners = e.filter("is_assoc AND is_node").select("doc_id", "id", F.col("ord").alias("parent_ord"), "attrs")
    names = known.select(F.col("qname").alias("name")).distinct()
    attributes = owners.select("doc_id", "id", F.lit(-1).alias("ord"), F.explode("attrs").alias("name", "value"))
    texts = e.filter("text IS NOT NULL AND n_children = 0").select("doc_id", "parent_ord", "ord", F.col("qname").alias("name"), F.col("text").alias("value")).join(owners.drop("attrs"), ["doc_id", "parent_ord"])
    rows = attributes.unionByName(texts.select(attributes.columns)).join(names, "name", "left_anti").withColumn("key", F.concat(F.lit("aug_"), to_label(F.col("name"))))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    return rows.groupBy("doc_id", "id", "key").agg(listed.alias("values"))


def element_names(e: DataFrame) -> DataFrame:
    """(qname, n) of the elements that documents use."""
    return e.filter("error IS NULL").groupBy("qname").agg(F.count("*").alias("n"))
