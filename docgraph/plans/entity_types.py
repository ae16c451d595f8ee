"""Which types of a schema are entities and which wrap a value; categories by derivation and substitution.

``types`` below: name, base, is_simple, n_elements, all names qualified. ``declarations``: name, type, substitution_group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.operators.resolve import COMPONENTS
from docgraph.operators.graph import closure
from docgraph.plans.schema_model import local

#: Bases that make a complex type a value.
SIMPLE_BASES = [
    "xs:string", "xs:boolean", "xs:integer", "xs:decimal", "xs:double", "xs:float", "xs:date", "xs:dateTime", "xs:time", "xs:gYear", "xs:gYearMonth", "xs:gMonthDay", "xs:duration", "xs:anyURI", "xs:token", "xs:normalizedString",
    "niem-xs:string", "niem-xs:boolean", "niem-xs:integer", "niem-xs:decimal", "niem-xs:date", "niem-xs:dateTime", "niem-xs:time", "niem-xs:gYear", "xsd:string", "xsd:boolean", "xsd:integer", "xsd:decimal", "xsd:date",
]
#: Words in the names of types that wrap a value.
WRAPPER_WORDS = ["Date", "Time", "Text", "Indicator", "Boolean", "Code", "Category", "Amount", "Quantity", "Measure", "Numeric", "ID", "Identification", "Value", "Description", "Count", "Percent", "Rate", "Duration", "Abstract"]
#: Bases whose derived types are entities.
ENTITY_BASES = ["nc:PersonType", "nc:OrganizationType", "nc:LocationType", "nc:AddressType", "nc:ActivityType", "nc:ItemType", "nc:EntityType", "structures:ObjectType"]
#: Words in the names of elements that are entities.
ENTITY_WORDS = [
    "Person", "Organization", "Entity", "Location", "Address", "Activity", "Item", "Object", "Vehicle", "Facility", "Role", "Case", "Incident", "Event", "Document", "Subject", "Target", "Source", "Defendant", "Victim", "Charge", "Arrest",
    "Offense", "Crash", "Driver", "Property", "Evidence", "Weapon", "Substance", "Injury", "Contact", "Metadata", "Image", "Binary", "Biometric",
]
#: Category -> the element that others stand in for, and the type that others derive from.
CATEGORY_BASES = {"person": ("nc:Person", "nc:PersonType"), "organization": ("nc:Organization", "nc:OrganizationType"), "address": ("nc:Address", "nc:AddressType"), "vehicle": ("nc:Vehicle", "nc:VehicleType")}
ENOUGH_ELEMENTS = 3


def is_wrapper(name: Column, base: Column, is_simple: Column, n_elements: Column) -> Column:
    """Whether a type wraps a value: a simple one, one with a simple base, one that adds no element to its base, or one that is
    named like a value. A type that is not defined (null columns but for its name) goes by its name."""
    short = local(name)
    named = short.endswith("Type") & short.rlike("|".join(WRAPPER_WORDS))
    by_shape = F.coalesce(is_simple, F.lit(False)) | F.coalesce(base.isin(SIMPLE_BASES), F.lit(False)) | F.coalesce(base.isNotNull() & (n_elements == 0), F.lit(False))
    return F.when(F.coalesce(name, F.lit("")) == "", False).otherwise(by_shape | named)


def derived_types(types: DataFrame, bases: list[str]) -> DataFrame:
    """(name, base): types below one of ``bases``, over any number of steps."""
    pairs = types.filter("base IS NOT NULL").select(F.col("name").alias("child"), F.col("base").alias("parent"))
    return closure(pairs).filter(F.col("ancestor").isin(bases)).select(F.col("child").alias("name"), F.col("ancestor").alias("base")).distinct()


def entity_flags(declarations: DataFrame, types: DataFrame) -> DataFrame:
    """(name, type, is_wrapper, is_entity) of declared elements. In order: components are none; what derives from an entity's
    type is one; wrappers are none; what is named like one is one; else a type with three elements or more."""
    below = derived_types(types, ENTITY_BASES).select(F.col("name").alias("type"), F.lit(True).alias("derived")).distinct()
    defined = types.select(F.col("name").alias("type"), "base", "is_simple", "n_elements")
    rows = declarations.select("name", "type").join(defined, "type", "left").join(below, "type", "left")
    wrapper = is_wrapper(F.col("type"), F.col("base"), F.col("is_simple"), F.col("n_elements"))
    words = local(F.col("name")).rlike("|".join(ENTITY_WORDS))
    entity = F.when(F.col("name").isin(COMPONENTS), False).when(F.coalesce("derived", F.lit(False)), True).when(wrapper, False).otherwise(F.coalesce(words, F.lit(False)) | (F.coalesce("n_elements", F.lit(0)) >= ENOUGH_ELEMENTS))
    return rows.select("name", "type", wrapper.alias("is_wrapper"), entity.alias("is_entity"))


def auto_selection(used: DataFrame, declarations: DataFrame, types: DataFrame) -> DataFrame:
    """(qname, selected) for the names that documents use (``used``: qname): entities, and what the schema does not declare."""
    flags = entity_flags(declarations, types).select(F.col("name").alias("qname"), "is_entity")
    return used.select("qname").distinct().join(flags, "qname", "left").select("qname", F.coalesce("is_entity", F.lit(True)).alias("selected"))


def schema_categories(declarations: DataFrame, types: DataFrame, bases: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(name, category) of declared elements: the base element itself, what substitutes for it, and what has the base type or one
    derived from it. An element may be in several."""
    out = None
    groups = declarations.filter("substitution_group IS NOT NULL").select(F.col("name").alias("child"), F.col("substitution_group").alias("parent"))
    stands_for = closure(groups)
    for category, (head, base) in (bases or CATEGORY_BASES).items():
        of_type = derived_types(types, [base]).select(F.col("name").alias("type")).unionByName(types.sparkSession.createDataFrame([(base,)], "type string")).distinct()
        found = declarations.join(of_type, "type", "left_semi").select("name").unionByName(stands_for.filter(F.col("ancestor") == head).select(F.col("child").alias("name"))).unionByName(declarations.filter(F.col("name") == head).select("name"))
        part = found.distinct().select("name", F.lit(category).alias("category"))
        out = part if out is None else out.unionByName(part)
    return out
