"""XSD documents as tables of types, declarations and trees.

Schemas are XML, so they pass through the same shredder as data. ``elements`` below are the shredded rows of schema
documents; what a schema declares is then filters and joins, and closures double their reach a round.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.operators.graph import closure
from docgraph.scratch import written

#: Built-in types by the scalar kind they stand for.
SCALAR_KINDS = {
    "integer": ["integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"],
    "decimal": ["decimal", "double", "float"], "boolean": ["boolean"], "date": ["date", "dateTime", "time", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay", "duration"],
}


def local(name: Column) -> Column:
    return F.element_at(F.split(name, ":"), -1)


def attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def types(elements: DataFrame) -> DataFrame:
    """(doc_id, ord, name, is_simple, base): named type definitions with the type they extend or restrict."""
    named = elements.filter(local(F.col("qname")).isin("complexType", "simpleType") & attr("name").isNotNull())
    base = elements.filter(local(F.col("qname")).isin("extension", "restriction")).select("doc_id", F.explode("path").alias("ord"), attr("base").alias("base"), F.col("ord").alias("at"))
    first = base.groupBy("doc_id", "ord").agg(F.min_by("base", "at").alias("base"))
    return named.select("doc_id", "ord", attr("name").alias("name"), (local(F.col("qname")) == "simpleType").alias("is_simple")).join(first, ["doc_id", "ord"], "left")


def declarations(elements: DataFrame) -> DataFrame:
    """(doc_id, ord, name, type, abstract, substitution_group): global element declarations."""
    e = elements.filter((local(F.col("qname")) == "element") & (F.col("depth") == 1))
    return e.select("doc_id", "ord", attr("name").alias("name"), attr("type").alias("type"), (attr("abstract") == "true").alias("abstract"), attr("substitutionGroup").alias("substitution_group"))


def members(elements: DataFrame) -> DataFrame:
    """(type, element, min_occurs, max_occurs): the elements that a named type holds, by ref or by name. Qualified names pass as they are."""
    t = elements.filter(local(F.col("qname")).isin("complexType") & attr("name").isNotNull()).select("doc_id", F.col("ord").alias("t_ord"), attr("name").alias("type"))
    e = elements.filter((local(F.col("qname")) == "element") & (F.col("depth") > 1)).select("doc_id", F.explode("path").alias("t_ord"), F.coalesce(attr("ref"), attr("name")).alias("element"), F.coalesce(attr("minOccurs"), F.lit("1")).alias("min_occurs"), F.coalesce(attr("maxOccurs"), F.lit("1")).alias("max_occurs"))
    return e.join(t, ["doc_id", "t_ord"]).select("type", "element", "min_occurs", "max_occurs")


def classify_types(type_table: DataFrame) -> DataFrame:
    """(name, kind): string, integer, decimal, boolean or date from the built-in type at the end of the chain of bases."""
    pairs = type_table.filter("base IS NOT NULL").select(local(F.col("name")).alias("child"), local(F.col("base")).alias("parent"))
    out, value = None, F.col("ancestor")
    for kind, names in SCALAR_KINDS.items():
        test = value.isin(names)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    ends = closure(pairs).withColumn("kind", out).groupBy(F.col("child").alias("name")).agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("steps"))).alias("kind"))
    return type_table.select(local(F.col("name")).alias("name")).distinct().join(ends, "name", "left").select("name", F.coalesce("kind", F.lit("string")).alias("kind"))


def element_tree(declared: DataFrame, held: DataFrame, most: int = 100) -> DataFrame:
    """(root, path, element, depth, kind, n_children): declared roots and what is below them, without repeats along a path.

    One row a path, a written table a level. What lies more than ``most`` levels deep is left out, with a warning; where many
    elements are shared, paths are far more than elements, and ``model_mapping.schema_rows`` lists each element once.
    """
    typed = declared.select(local(F.col("name")).alias("element"), local(F.col("type")).alias("type"))
    below = held.select(local(F.col("type")).alias("type"), local(F.col("element")).alias("child")).distinct()
    pairs = typed.join(below, "type").select("element", "child").distinct()
    children = pairs.groupBy("element").agg(F.count("*").alias("n_children"))
    roots = typed.select("element").join(pairs.select(F.col("child").alias("element")).distinct(), "element", "left_anti")
    level = written(roots.select(F.col("element").alias("root"), F.array("element").alias("path"), "element", F.lit(0).alias("depth")), "tree-level")
    found = [level]
    pairs = written(pairs, "element-pairs")
    for k in range(1, most + 2):
        level = level.join(pairs, "element").filter(~F.array_contains("path", F.col("child"))).select("root", F.array_append("path", F.col("child")).alias("path"), F.col("child").alias("element"), F.lit(k).alias("depth"))
        if k > most:
            if not level.isEmpty():
                warnings.warn(f"the element tree is cut at {most} levels", stacklevel=2)
            break
        level = written(level, "tree-level")
        if level.isEmpty():
            break
        found.append(level)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    kind = F.when(F.col("element").endswith("Association"), "association").when(F.col("element").endswith("Augmentation"), "augmentation").when(F.coalesce("n_children", F.lit(0)) > 0, "object").otherwise("property")
    return out.join(children, "element", "left").select("root", F.array_join("path", "/").alias("path"), "element", "depth", kind.alias("kind"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def augmentations(declared: DataFrame, held: DataFrame) -> DataFrame:
    """(base_type, augmentation, element): what augmentations add, found by their substitution group ...AugmentationPoint."""
    a = declared.filter(F.col("substitution_group").endswith("AugmentationPoint"))
    base = F.regexp_replace("substitution_group", "AugmentationPoint$", "Type")
    return a.select(base.alias("base_type"), F.col("name").alias("augmentation"), local(F.col("type")).alias("type")).join(held.select(local(F.col("type")).alias("type"), "element"), "type").select("base_type", "augmentation", "element")


def mapping(tree: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, associations) from selected elements (element): associations need two or more selected children."""
    rows = tree.join(selected.select("element").distinct(), "element", "left_semi").select("element", "kind", "path").distinct()
    objects = rows.filter("kind = 'object'").select("element", F.translate("element", ":.", "__").alias("label")).distinct()
    parent = F.element_at(F.split("path", "/"), -2)
    ends = tree.filter("depth > 0").join(selected.select("element").distinct(), "element", "left_semi").select(parent.alias("association"), F.col("element").alias("role")).distinct()
    enough = ends.groupBy("association").agg(F.array_sort(F.collect_set("role")).alias("roles")).filter(F.size("roles") >= 2)
    return objects, rows.filter("kind = 'association'").select(F.col("element").alias("association")).distinct().join(enough, "association")


def validate_selection(tree: DataFrame, selected: DataFrame) -> DataFrame:
    """Issues (severity, rule, message): nothing selected, associations with fewer than two ends, objects without relations."""
    chosen = tree.join(selected.select("element").distinct(), "element", "left_semi").select("element", "kind").distinct()
    none = selected.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("error").alias("severity"), F.lit("NO_SELECTIONS").alias("rule"), F.lit("nothing is selected").alias("message"))
    _, whole = mapping(tree, selected)
    short = chosen.filter("kind = 'association'").join(whole.select(F.col("association").alias("element")), "element", "left_anti").select(F.lit("warning").alias("severity"), F.lit("INSUFFICIENT_ENDPOINTS").alias("rule"), F.concat("element", F.lit(" has fewer than two selected ends")).alias("message"))
    counts = chosen.agg(F.count_if(F.col("kind") == "object").alias("o"), F.count_if(F.col("kind") == "association").alias("a"))
    sparse = counts.filter("o > 3 AND a = 0").select(F.lit("warning").alias("severity"), F.lit("SPARSE_CONNECTIVITY").alias("rule"), F.lit("objects are selected but no association").alias("message"))
    return none.unionByName(short).unionByName(sparse)


def check_imports(elements: DataFrame) -> DataFrame:
    """(source_file, location, namespace, status, matched): each import with the uploaded file it means: by path, name or suffix."""
    wanted = elements.filter(local(F.col("qname")).isin("import", "include")).select("source_file", attr("schemaLocation").alias("location"), attr("namespace").alias("namespace")).filter("location IS NOT NULL")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    files = elements.select(F.col("source_file").alias("file")).distinct().withColumn("base", base(F.col("file")))
    met = wanted.withColumn("base", base(F.col("location"))).join(files, "base", "left")
    rank = F.when(F.col("file") == F.col("location"), 0).when(F.col("location").endswith(F.col("file")), 1).when(F.col("file").isNotNull(), 2)
    best = met.withColumn("rank", rank).groupBy("source_file", "location", "namespace").agg(F.min_by("file", F.struct("rank", "file")).alias("matched"))
    return best.select("source_file", "location", "namespace", F.when(F.col("matched").isNotNull(), "satisfied").otherwise("missing").alias("status"), "matched")


def model_classes(elements: DataFrame) -> DataFrame:
    """(id, name, base, is_association, n_properties) of the Class entries of a model document."""
    c = elements.filter((local(F.col("qname")) == "Class") & F.col("sid").isNotNull()).select("doc_id", "ord", F.col("sid").alias("id"))
    child = elements.select("doc_id", F.col("parent_ord").alias("ord"), local(F.col("qname")).alias("part"), "text", "sref", F.coalesce("sref", "text").alias("value"))
    own = c.join(child, ["doc_id", "ord"], "left").groupBy("doc_id", "ord", "id").agg(
        F.max(F.when(F.col("part") == "Name", F.col("text"))).alias("name"), F.max(F.when(F.col("part").isin("ExtensionOfClass", "SubClassOf"), F.col("value"))).alias("base"), F.count_if(F.col("part").isin("HasProperty", "ChildPropertyAssociation")).alias("n_properties")
    )
    return own.select("id", "name", "base", F.coalesce(F.col("base").endswith("AssociationType"), F.lit(False)).alias("is_association"), "n_properties")


def model_members(elements: DataFrame) -> DataFrame:
    """(owner_id, owner_kind, property_id, is_object, min_occurs, max_occurs): properties that classes, datatypes and restrictions
    of a model document hold, in order."""
    owners = elements.filter(local(F.col("qname")).isin("Class", "Datatype", "Restriction")).select("doc_id", F.col("ord").alias("o_ord"), F.col("sid").alias("owner_id"), local(F.col("qname")).alias("owner_kind"))
    held = elements.filter(local(F.col("qname")).isin("HasProperty", "ChildPropertyAssociation")).select("doc_id", F.col("ord").alias("m_ord"), F.explode("path").alias("o_ord"))
    parts = elements.select("doc_id", F.col("parent_ord").alias("m_ord"), local(F.col("qname")).alias("part"), F.coalesce("sref", "text").alias("value"))
    one = lambda *names: F.max(F.when(F.col("part").isin(*names), F.col("value")))
    got = held.join(owners, ["doc_id", "o_ord"]).join(parts, ["doc_id", "m_ord"]).groupBy("doc_id", "m_ord", "owner_id", "owner_kind").agg(one("DataProperty").alias("data"), one("ObjectProperty").alias("object"), one("MinOccursQuantity").alias("min_occurs"), one("MaxOccursQuantity").alias("max_occurs"))
    return got.select("owner_id", "owner_kind", F.coalesce("object", "data").alias("property_id"), F.col("object").isNotNull().alias("is_object"), "min_occurs", "max_occurs", F.col("m_ord").alias("ord")).filter("property_id IS NOT NULL")


def model_properties(elements: DataFrame) -> DataFrame:
    """(id, name, is_object, type_id): the data and object properties of a model document with their datatype or class."""
    p = elements.filter(local(F.col("qname")).isin("DataProperty", "ObjectProperty") & F.col("sid").isNotNull()).select("doc_id", F.col("ord").alias("p_ord"), F.col("sid").alias("id"), (local(F.col("qname")) == "ObjectProperty").alias("is_object"))
    parts = elements.select("doc_id", F.col("parent_ord").alias("p_ord"), local(F.col("qname")).alias("part"), F.coalesce("sref", "text").alias("value"))
    one = lambda *names: F.max(F.when(F.col("part").isin(*names), F.col("value")))
    return p.join(parts, ["doc_id", "p_ord"], "left").groupBy("doc_id", "id", "is_object").agg(one("Name").alias("name"), one("Datatype", "Class").alias("type_id")).drop("doc_id")


def model_prefixes(elements: DataFrame) -> DataFrame:
    """(prefix, uri) of the namespaces of a model document."""
    n = elements.filter(local(F.col("qname")) == "Namespace").select("doc_id", "ord")
    parts = elements.select("doc_id", F.col("parent_ord").alias("ord"), local(F.col("qname")).alias("part"), "text")
    one = lambda *names: F.max(F.when(F.col("part").isin(*names), F.col("text")))
    return n.join(parts, ["doc_id", "ord"]).groupBy("doc_id", "ord").agg(one("NamespacePrefixText", "NamespacePrefix").alias("prefix"), one("NamespaceURI").alias("uri")).select("prefix", "uri")


def datatype_classes(elements: DataFrame) -> DataFrame:
    """(id, n_children, kind) of datatypes and restrictions: COMPLEX with two properties or more, WRAPPER with one, else SIMPLE."""
    t = elements.filter(local(F.col("qname")).isin("Datatype", "Restriction") & F.col("sid").isNotNull()).select(F.col("sid").alias("id")).distinct()
    n = model_members(elements).filter("owner_kind <> 'Class'").groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.lit(0))
    return t.join(n, "id", "left").select("id", count.alias("n_children"), F.when(count > 1, "COMPLEX").when(count == 1, "WRAPPER").otherwise("SIMPLE").alias("kind"))


def scalar_paths(elements: DataFrame, most: int = 3) -> DataFrame:
    """(class_id, path, depth): the data properties of classes, those of wrappers and complex datatypes followed down to values
    in ``most`` steps; names are qualified, joined by /."""
    members_, props = model_members(elements), model_properties(elements).filter("NOT is_object")
    kinds = datatype_classes(elements).select(F.col("id").alias("type_id"), "kind")
    named = props.select(F.col("id").alias("property_id"), F.regexp_replace("id", r"^([^.]+)\.", "$1:").alias("step"), "type_id").join(kinds, "type_id", "left").withColumn("kind", F.coalesce("kind", F.lit("SIMPLE")))
    now = members_.filter("owner_kind = 'Class' AND NOT is_object").select(F.col("owner_id").alias("class_id"), "property_id").join(named, "property_id").select("class_id", F.col("step").alias("path"), "type_id", "kind")
    below = members_.filter("owner_kind <> 'Class' AND NOT is_object").select(F.col("owner_id").alias("type_id"), "property_id").join(named.select("property_id", "step", F.col("type_id").alias("next_id"), F.col("kind").alias("next_kind")), "property_id")
    out = now.filter("kind = 'SIMPLE'").select("class_id", "path", F.lit(1).alias("depth"))
    for depth in range(2, most + 1):
        now = now.filter("kind <> 'SIMPLE'").join(below, "type_id").select("class_id", F.concat_ws("/", "path", "step").alias("path"), F.col("next_id").alias("type_id"), F.col("next_kind").alias("kind"))
        out = out.unionByName(now.filter("kind = 'SIMPLE'").select("class_id", "path", F.lit(depth).alias("depth")))
    return out.distinct()
