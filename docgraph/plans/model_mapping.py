"""A mapping from a model document: objects with flattened properties, associations with ends, references; and schema elements by reach.

The tables of ``schema_model`` are joined; nothing walks the model. A mapping is as large as its model and becomes a document
for people to edit, which ``operators.mapping.load_mapping`` reads back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.operators.build import to_label, to_rel_type
from docgraph.operators.graph import closure
from docgraph.plans import schema_model as sm
from docgraph.scratch import written

#: What a mapping says of every reference, and of types that stand beside declared ones.
VIA = "structures:ref"
POLYMORPHISM = {"strategy": "extraLabel", "store_actual_type_property": "xsiType"}


def qualified(ident: Column) -> Column:
    """prefix.Name as prefix:Name."""
    return F.regexp_replace(ident, r"^([^.:]+)\.", "$1:")


def cardinality() -> Column:
    return F.concat(F.coalesce("min_occurs", F.lit("0")), F.lit(".."), F.coalesce("max_occurs", F.lit("*")))


@dataclass
class ModelMapping:
    """``objects`` (qname, label), ``properties`` (qname, path, property), ``associations`` (qname, rel_type), ``endpoints`` (qname,
    role_qname, maps_to_label, direction, cardinality, ord), ``references`` (owner_object, field_qname, target_label, rel_type, cardinality, ord), ``names`` (qname of all that the model declares)."""

    objects: DataFrame
    properties: DataFrame
    associations: DataFrame
    endpoints: DataFrame
    references: DataFrame
    names: DataFrame
    prefixes: DataFrame

    def document(self) -> dict:
        """The mapping as one plain document, in a fixed order; it has as many rows as the model."""
        rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
        own: dict[str, list[dict]] = {}
        for r in rows(self.properties, "qname", "path"):
            own.setdefault(r["qname"], []).append({"path": r["path"], "property": r["property"]})
        ends: dict[str, list[dict]] = {}
        for r in rows(self.endpoints, "qname", "ord"):
            ends.setdefault(r["qname"], []).append({k: r[k] for k in ("role_qname", "maps_to_label", "direction", "cardinality")} | {"via": VIA})
        references = [{k: r[k] for k in ("owner_object", "field_qname", "target_label", "rel_type", "cardinality")} | {"via": VIA} for r in rows(self.references, "owner_object", "ord")]
        return {
            "namespaces": {r["prefix"]: r["uri"] for r in rows(self.prefixes, "prefix")},
            "objects": [{"qname": r["qname"], "label": r["label"], "carries_structures_id": True, "scalar_props": own.get(r["qname"], [])} for r in rows(self.objects, "qname")],
            "associations": [{"qname": r["qname"], "rel_type": r["rel_type"], "endpoints": ends.get(r["qname"], []), "rel_props": []} for r in rows(self.associations, "qname")],
            "references": references, "augmentations": [], "polymorphism": POLYMORPHISM, "metadata": {"element_index": [r["qname"] for r in rows(self.names, "qname")]},
        }


def model_mapping(elements: DataFrame) -> ModelMapping:
    """The mapping of a model document (shredded ``elements``).

    Objects are the object properties whose class is no association; their properties are those of the class, wrappers and
    complex datatypes followed down. Associations are classes below the association type, named by the property that has the
    class, or by the class; their object properties are their ends, the first the source. Object properties that other
    classes hold are references to what has the target's class. Classes without an element stand under their own name.
    """
    elements = written(elements, "model")
    classes = written(sm.model_classes(elements), "model-classes")
    members = written(sm.model_members(elements), "model-members")
    properties = written(sm.model_properties(elements), "model-properties")
    declared = properties.filter("is_object AND type_id IS NOT NULL").select(F.col("id").alias("element_id"), F.col("type_id").alias("class_id"))
    named = classes.select(F.col("id").alias("class_id"), "is_association").join(declared, "class_id", "full")
    named = named.select("class_id", F.coalesce("is_association", F.lit(False)).alias("is_association"), qualified(F.coalesce("element_id", "class_id")).alias("qname"), F.col("element_id").isNotNull().alias("is_element"))
    objects = named.filter("is_element AND NOT is_association")
    paths = sm.scalar_paths(elements).select("class_id", "path")
    scalars = objects.select("class_id", "qname").join(paths, "class_id").select("qname", "path", F.translate("path", ":/.", "___").alias("property")).distinct()
    holders = named.select(F.col("class_id").alias("owner_id"), "qname", "is_association")
    label_of = named.groupBy(F.col("class_id").alias("target_class")).agg(to_label(F.min("qname")).alias("target_label"))
    held = members.filter("owner_kind = 'Class' AND is_object").join(holders, "owner_id").join(declared.select(F.col("element_id").alias("property_id"), F.col("class_id").alias("target_class")), "property_id", "left").join(label_of, "target_class", "left")
    field = qualified(F.col("property_id"))
    held = held.select("qname", "is_association", field.alias("field"), F.coalesce("target_label", to_label(field)).alias("target_label"), cardinality().alias("cardinality"), "ord")
    first = held.groupBy("qname").agg(F.min("ord").alias("first"))
    ends = held.filter("is_association").join(first, "qname").select("qname", F.col("field").alias("role_qname"), F.col("target_label").alias("maps_to_label"), F.when(F.col("ord") == F.col("first"), "source").otherwise("target").alias("direction"), "cardinality", "ord")
    references = held.filter("NOT is_association").select(F.col("qname").alias("owner_object"), F.col("field").alias("field_qname"), "target_label", to_rel_type(F.col("field")).alias("rel_type"), "cardinality", "ord")
    associations = named.filter("is_association").select("qname", to_rel_type(F.col("qname")).alias("rel_type")).distinct()
    names = properties.select(qualified(F.col("id")).alias("qname")).distinct()
    return ModelMapping(objects.select("qname", to_label(F.col("qname")).alias("label")).distinct(), scalars, associations, ends, references, names, sm.model_prefixes(elements))


def element_pairs(declared: DataFrame, held: DataFrame) -> DataFrame:
    """(child, parent) of declared elements: what an element's type holds stands below it."""
    typed = declared.select(sm.local(F.col("name")).alias("parent"), sm.local(F.col("type")).alias("type"))
    below = held.select(sm.local(F.col("type")).alias("type"), sm.local(F.col("element")).alias("child"))
    return typed.join(below, "type").select("child", "parent").distinct()


def nearest_selected(pairs: DataFrame, selected: DataFrame) -> DataFrame:
    """(element, ancestor, steps): for each element the selected one (``selected``: element) that stands fewest steps above it.

    ``pairs`` (child, parent) may form any graph. What many elements share is reached once, no path is listed, and depth has
    no limit. Ties go to the first name; an element with no selected one above it has no row. An element on a cycle is not
    its own ancestor.
    """
    above = closure(pairs).filter("child <> ancestor").join(selected.select(F.col("element").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return above.groupBy(F.col("child").alias("element")).agg(F.min(F.struct("steps", "ancestor")).alias("x")).select("element", "x.ancestor", "x.steps")


def schema_rows(declared: DataFrame, held: DataFrame) -> DataFrame:
    """(element, type, depth, kind, n_children, endpoints, augmented): each declared element once, however many paths lead to it.

    depth: fewest steps from a root, an element that no other one holds; null on cycles that no root leads to. endpoints: what
    an association holds, in order of name; augmented: what augmentations add to the element's type.
    """
    pairs = written(element_pairs(declared, held), "element-pairs")
    elements = declared.select(sm.local(F.col("name")).alias("element"), sm.local(F.col("type")).alias("type")).distinct()
    roots = elements.select("element").join(pairs.select(F.col("child").alias("element")), "element", "left_anti").distinct()
    reached = closure(pairs).join(roots.select(F.col("element").alias("ancestor")), "ancestor", "left_semi").groupBy(F.col("child").alias("element")).agg(F.min("steps").alias("depth"))
    depth = roots.select("element", F.lit(0).alias("depth")).unionByName(reached)
    children = pairs.groupBy(F.col("parent").alias("element")).agg(F.array_sort(F.collect_set("child")).alias("children"))  # as many as the type names
    added = sm.augmentations(declared, held).groupBy(sm.local(F.col("base_type")).alias("type")).agg(F.array_sort(F.collect_set("element")).alias("augmented"))
    out = elements.join(depth, "element", "left").join(children, "element", "left").join(added, "type", "left")
    n, none = F.coalesce(F.size("children"), F.lit(0)), F.array().cast("array<string>")
    kind = F.when(F.col("element").endswith("Association"), "association").when(F.col("element").endswith("Augmentation"), "augmentation").when(n > 0, "object").otherwise("property")
    return out.select("element", "type", "depth", kind.alias("kind"), F.greatest(n, F.lit(0)).alias("n_children"), F.when(kind == "association", F.coalesce("children", none)).otherwise(none).alias("endpoints"), F.coalesce("augmented", none).alias("augmented"))
