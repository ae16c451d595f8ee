"""Nodes and edges as text, one statement a row, for loading into a graph database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: names that need no back-ticks.
SAFE_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"


def quoted(value: Column) -> Column:
    """A string literal: backslashes, then single quotes, are escaped."""
    return F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def identifier(name: Column) -> Column:
    """A name as it is, or between back-ticks where it is not safe."""
    return F.when(name.rlike(SAFE_NAME), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def _members(props: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.coalesce(props, F.create_map().cast("map<string,string>"))))
    return F.transform(entries, lambda x: F.concat(identifier(x["key"]), F.lit(": "), F.coalesce(quoted(x["value"]), F.lit("null"))))


def node_statements(nodes: DataFrame) -> DataFrame:
    """(id, statement): MERGE by id, first writer sets the properties."""
    body = F.array_join(F.transform(_members(F.col("props")), lambda m: F.concat(F.lit("n."), F.regexp_replace(m, r"^(`(?:[^`]|``)*`|[^:]*): ", "$1 = "))), ", ")
    head = F.concat(F.lit("MERGE (n:"), identifier(F.col("label")), F.lit(" {id: "), quoted(F.col("id")), F.lit("})"))
    return nodes.select("id", F.concat(head, F.when(body != "", F.concat(F.lit(" ON CREATE SET "), body)).otherwise(""), F.lit(";")).alias("statement"))


def edge_statements(edges: DataFrame) -> DataFrame:
    """(src, dst, rel_type, statement): MATCH both ends, MERGE the edge with its properties."""
    body = F.array_join(_members(F.col("props")), ", ")
    ends = F.concat(F.lit("MATCH (a {id: "), quoted(F.col("src")), F.lit("}), (b {id: "), quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), identifier(F.col("rel_type")))
    return edges.select("src", "dst", "rel_type", F.concat(ends, F.when(body != "", F.concat(F.lit(" {"), body, F.lit("}"))).otherwise(""), F.lit("]->(b);")).alias("statement"))
