"""Registries, settings, resets, validation of JSON documents, and conversion of XML to JSON."""

from __future__ import annotations

import json
import operator
import re
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.scratch import written
from docgraph.sources.files import exists


@dataclass
class Registry:
    """Schemas as an append-only Parquet table: the last entry of a schema is its state, the last activation is the active one."""

    spark: SparkSession
    path: str

    SCHEMA = "schema_id string, name string, primary_file string, at timestamp, active boolean, selections map<string,boolean>"

    def _rows(self) -> DataFrame:
        if exists(self.spark, self.path):
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return self.spark.createDataFrame([], self.SCHEMA)

    def _append(self, df: DataFrame) -> None:
        df.withColumn("at", F.current_timestamp()).select("schema_id", "name", "primary_file", "at", "active", F.col("selections").cast("map<string,boolean>")).coalesce(1).write.mode("append").parquet(self.path)

    def add(self, name: str, primary_file: str, content: str) -> str:
        row = self.spark.createDataFrame([(name, primary_file, content)], "name string, primary_file string, content string")
        row = row.select(F.sha2(F.concat_ws("|", "name", "content"), 256).alias("schema_id"), "name", "primary_file", F.lit(True).alias("active"), F.lit(None).alias("selections"))
        self._append(row)
        return row.first()["schema_id"]

    def list(self) -> DataFrame:
        """The newest state of each schema, newest first; one is active."""
        state = self._rows().groupBy("schema_id").agg(F.max_by(F.struct("name", "primary_file", "selections"), "at").alias("s"), F.max(F.when(F.col("active"), F.col("at"))).alias("activated"), F.max("at").alias("at"))
        newest = state.agg(F.max("activated").alias("newest")).first()["newest"]
        return state.select("schema_id", "s.*", "at", (F.col("activated") == F.lit(newest)).alias("active")).orderBy(F.desc("at"), "schema_id")

    def activate(self, schema_id: str) -> None:
        self._again(schema_id, F.lit(True), F.col("selections"))

    def select(self, schema_id: str, selections: dict[str, bool]) -> None:
        """Keep a selection; an empty one takes the schema back to dynamic mode."""
        values = F.create_map(*[F.lit(v) for kv in selections.items() for v in kv]) if selections else F.lit(None)
        self._again(schema_id, F.lit(False), values)

    def _again(self, schema_id: str, active, selections) -> None:  # noqa: ANN001
        row = self.list().filter(F.col("schema_id") == schema_id)
        if row.isEmpty():
            raise KeyError(schema_id)
        self._append(row.select("schema_id", "name", "primary_file", active.alias("active"), selections.alias("selections")))


class Reset:
    """Two steps: a dry run counts and issues a token; the reset runs with that token alone."""

    def __init__(self) -> None:
        self._token: str | None = None

    def dry_run(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, str]:
        self._token = secrets.token_hex(8)
        counts = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n"))
        return counts, self._token

    def run(self, nodes: DataFrame, edges: DataFrame, token: str) -> tuple[DataFrame, DataFrame]:
        if not self._token or token != self._token:
            raise PermissionError("the token is not the one issued")
        self._token = None
        return nodes.limit(0), edges.limit(0)


class Settings:
    """Settings as an append-only Parquet table whose newest row counts; without one, the defaults do."""

    SCHEMA = "skip_xml_validation boolean, skip_json_validation boolean, at timestamp"
    DEFAULTS = {"skip_xml_validation": False, "skip_json_validation": False}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _newest(self):  # noqa: ANN202
        if not exists(self.spark, self.path):
            return None
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).orderBy(F.desc("at")).first()

    def get(self) -> dict[str, bool]:
        row = self._newest()
        return {k: v if row is None or row[k] is None else row[k] for k, v in self.DEFAULTS.items()}

    def update(self, **values: bool) -> dict[str, bool]:
        """Set the named settings, keep the others."""
        unknown = set(values) - set(self.DEFAULTS)
        if unknown:
            raise KeyError(", ".join(sorted(unknown)))
        new = self.get() | values
        self.spark.range(1).select(*[F.lit(new[k]).alias(k) for k in self.DEFAULTS], F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(self.path)
        return new

    def initialize(self) -> None:
        """Write the defaults if there is no entry yet."""
        if self._newest() is None:
            self.update()


#: Keywords of JSON schemas that are read; those in the second set say nothing about a document.
KEYWORDS = {
    "type", "enum", "const", "required", "properties", "patternProperties", "additionalProperties", "propertyNames", "minProperties", "maxProperties", "items", "additionalItems", "contains", "minItems", "maxItems", "uniqueItems",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref", "dependencies",
}
SILENT = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "$defs", "format", "readOnly", "writeOnly", "contentEncoding", "contentMediaType"}
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
Issue = tuple[str, str, str]  # rule, message, path


def check_schema(rule: object, path: str = "#") -> None:
    """Refuse keywords and types that are not known, rather than pass over them."""
    if isinstance(rule, bool):
        return
    if not isinstance(rule, dict):
        raise ValueError(f"{path} is no schema")
    unknown = set(rule) - KEYWORDS - SILENT
    if unknown and "$ref" not in rule:
        raise ValueError(f"{path}: {', '.join(sorted(unknown))} not supported")
    types = rule.get("type", [])
    for kind in [types] if isinstance(types, str) else types:
        if kind not in KINDS:
            raise ValueError(f"{path}: no type {kind}")
    for word in ("properties", "patternProperties", "definitions", "$defs"):
        for name, below in rule.get(word, {}).items():
            check_schema(below, f"{path}/{word}/{name}")
    for word in ("allOf", "anyOf", "oneOf"):
        for k, below in enumerate(rule.get(word, [])):
            check_schema(below, f"{path}/{word}/{k}")
    for word in ("additionalProperties", "propertyNames", "contains", "not", "if", "then", "else", "additionalItems"):
        if word in rule:
            check_schema(rule[word], f"{path}/{word}")
    items = rule.get("items", True)
    for below in items if isinstance(items, list) else [items]:
        check_schema(below, f"{path}/items")


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, KINDS[kind])


def _same(a: object, b: object) -> bool:
    """Equal as JSON: numbers by value, but true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return type(a) is type(b) and a == b if isinstance(a, str) or isinstance(b, str) or a is None or b is None else not isinstance(a, dict | list) and not isinstance(b, dict | list) and a == b


def _key(value: object) -> object:
    """Equal for values that are the same, and hashable."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return type(value).__name__, value
    if isinstance(value, dict):
        return "dict", frozenset((k, _key(v)) for k, v in value.items())
    return ("list", tuple(map(_key, value))) if isinstance(value, list) else ("number", value)


def _is_multiple(value: float, of: float) -> bool:
    exact = lambda v: Fraction(v) if isinstance(v, int) else Fraction(str(v))
    return exact(value) % exact(of) == 0


def target_of(root: object, ref: str) -> object:
    """What a reference within the schema points to; KeyError if nothing is there."""
    below = root
    for part in ref.removeprefix("#").strip("/").split("/") if ref != "#" else []:
        name = part.replace("~1", "/").replace("~0", "~")
        below = below[int(name)] if isinstance(below, list) else below[name]  # type: ignore[index]
    return below


def check_references(root: dict) -> None:
    """Refuse references to other documents, to places that are not there, and those that come back to themselves alone."""
    waiting: list[object] = [root]
    while waiting:
        rule = waiting.pop()
        waiting += rule if isinstance(rule, list) else rule.values() if isinstance(rule, dict) else []
        seen, at = [], rule
        while isinstance(at, dict) and isinstance(at.get("$ref"), str):
            if at["$ref"] in seen:
                raise ValueError(f"{at['$ref']} refers to itself")
            seen.append(at["$ref"])
            try:
                if not at["$ref"].startswith("#"):
                    raise KeyError(at["$ref"])
                at = target_of(root, at["$ref"])
            except (KeyError, IndexError, TypeError, ValueError):
                raise ValueError(f"{seen[-1]} points to nothing in the schema") from None


def json_issues(value: object, rule: object, root: dict, path: str = "") -> Iterator[Issue]:
    """All issues of ``value`` against a Draft 7 schema. References are to places in the schema itself."""
    if isinstance(rule, bool):
        if not rule:
            yield "false schema", "is not allowed", path
        return
    if isinstance(rule.get("$ref"), str):
        yield from json_issues(value, target_of(root, rule["$ref"]), root, path)
        return
    passes = lambda v, r: next(json_issues(v, r, root), None) is None
    types = rule.get("type")
    if types and not any(_is(value, k) for k in ([types] if isinstance(types, str) else types)):
        yield "type", f"is not of type {types}", path
    if "enum" in rule and not any(_same(value, v) for v in rule["enum"]):
        yield "enum", "is not one of the listed values", path
    if "const" in rule and not _same(value, rule["const"]):
        yield "const", "is not the one value", path
    for r in rule.get("allOf", []):
        yield from json_issues(value, r, root, path)
    for word, fits in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if word in rule and not fits(sum(passes(value, r) for r in rule[word])):
            yield word, "is not valid under the given schemas", path
    if "not" in rule and passes(value, rule["not"]):
        yield "not", "is valid under a schema that must not hold", path
    if "if" in rule:
        yield from json_issues(value, rule.get("then" if passes(value, rule["if"]) else "else", True), root, path)
    if isinstance(value, dict):
        yield from _object_issues(value, rule, root, path)
    elif isinstance(value, list):
        yield from _array_issues(value, rule, root, path)
    elif isinstance(value, str):
        if len(value) < rule.get("minLength", 0) or len(value) > rule.get("maxLength", len(value)):
            yield "length", "is too short or too long", path
        if "pattern" in rule and not re.search(rule["pattern"], value):
            yield "pattern", f"does not match {rule['pattern']}", path
    elif isinstance(value, int | float) and not isinstance(value, bool):
        for word, holds in (("minimum", operator.ge), ("maximum", operator.le), ("exclusiveMinimum", operator.gt), ("exclusiveMaximum", operator.lt)):
            if word in rule and not holds(value, rule[word]):
                yield word, f"is against {word} {rule[word]}", path
        if "multipleOf" in rule and not _is_multiple(value, rule["multipleOf"]):
            yield "multipleOf", f"is no multiple of {rule['multipleOf']}", path


def _object_issues(value: dict, rule: dict, root: dict, path: str) -> Iterator[Issue]:
    for name in rule.get("required", []):
        if name not in value:
            yield "required", f"{name} is missing", path
    if not rule.get("minProperties", 0) <= len(value) <= rule.get("maxProperties", len(value)):
        yield "properties", "has too few or too many properties", path
    for name, needs in rule.get("dependencies", {}).items():
        if name in value:
            if isinstance(needs, list):
                needs = {"required": needs}
            yield from json_issues(value, needs, root, path)
    named, patterns = rule.get("properties", {}), rule.get("patternProperties", {})
    for name, v in value.items():
        here = f"{path}/{name}"
        if "propertyNames" in rule:
            yield from json_issues(name, rule["propertyNames"], root, here)
        if name in named:
            yield from json_issues(v, named[name], root, here)
        matched = [r for p, r in patterns.items() if re.search(p, name)]
        for r in matched:
            yield from json_issues(v, r, root, here)
        if name not in named and not matched and "additionalProperties" in rule:
            if rule["additionalProperties"] is False:
                yield "additionalProperties", f"{name} is not expected", path
            else:
                yield from json_issues(v, rule["additionalProperties"], root, here)


def _array_issues(value: list, rule: dict, root: dict, path: str) -> Iterator[Issue]:
    if not rule.get("minItems", 0) <= len(value) <= rule.get("maxItems", len(value)):
        yield "items", "has too few or too many items", path
    if rule.get("uniqueItems") and len({_key(v) for v in value}) < len(value):
        yield "uniqueItems", "has equal items", path
    if "contains" in rule and not any(next(json_issues(v, rule["contains"], root), None) is None for v in value):
        yield "contains", "has no item that fits", path
    items = rule.get("items", True)
    for k, v in enumerate(value):
        r = items if not isinstance(items, list) else items[k] if k < len(items) else rule.get("additionalItems", True)
        yield from json_issues(v, r, root, f"{path}/{k}")


def _integer(digits: str) -> int:
    """Of any length: Python's own reading stops at some thousands of digits."""
    if len(digits) < 4000:
        return int(digits)
    sign, digits = (-1, digits[1:]) if digits[0] == "-" else (1, digits)
    parts = [int(digits[max(0, k - 4000) : k]) for k in range(len(digits), 0, -4000)]
    total = 0
    for part in reversed(parts):
        total = total * 10**4000 + part
    return sign * total


def _all_issues(value: object, schema: dict) -> list[Issue]:
    try:
        return list(json_issues(value, schema, schema))
    except RecursionError:
        return [("depth", "is nested too deeply", "")]
    except (ArithmeticError, ValueError, TypeError, re.error) as e:
        return [("failed", f"{type(e).__name__}: {e}"[:500], "")]


def validate_json(docs: DataFrame, schema: dict) -> DataFrame:
    """All issues of JSON documents against a Draft 7 schema: file, severity, rule, message, context (path).

    Keywords that are not known are refused, and so are references that lead nowhere; formats are not checked. Text that is
    no JSON, null text included, gives one issue ``syntax``, and so does NaN; one that is nested too deeply to be walked gives
    ``depth``; whatever else goes wrong with one document is its issue ``failed``, and the others go on. Repeated documents
    have their issues each. One small function a document; Spark deals the documents out.
    """
    check_schema(schema)
    check_references(schema)

    def no_number(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d in b.itertuples(index=False):
                try:
                    value = json.loads(d.content or "", parse_constant=no_number, parse_int=_integer)
                except RecursionError:
                    found = [("depth", "is nested too deeply", "")]
                except ValueError as e:
                    found = [("syntax", str(e), "")]
                else:
                    found = _all_issues(value, schema)
                out += [(d.source_file, "error", rule, message, path) for rule, message, path in found]
            yield pd.DataFrame(out, columns=["file", "severity", "rule", "message", "context"])

    rows = docs.select("source_file", F.col("content").cast("string").alias("content"))
    return rows.mapInPandas(run, "file string, severity string, rule string, message string, context string")


#: Names of metadata elements, and of the parts of a message schema that hold objects which stand by reference.
METADATA = ["nc:Metadata", "priv:PrivacyMetadata"]
REFERENCES = "exch:ReferenceObjects"
REFERENCES_TYPE = "exch:ReferenceObjectType"
MESSAGE_PREFIX = "exch:"


def _misplaced(schema: dict) -> dict[str, dict[str, object]]:
    """The metadata of each message type that holds something else too, by type and name."""
    out = {}
    for name, properties in ((n, d.get("properties", {})) for n, d in schema.get("definitions", {}).items() if isinstance(d, dict)):
        held = {m: properties[m] for m in METADATA if m in properties}
        if held and held.keys() != properties.keys() and MESSAGE_PREFIX in name and name != REFERENCES_TYPE:
            out[name] = held
    return out


def with_reference_objects(schema: dict) -> dict:
    """A message's JSON schema in which metadata beside other properties stands in its reference objects instead; the given one stays as it is.

    Rule: a message type holds either metadata alone, or none. What breaks it is collected into the type of the reference
    objects, which the message and each type concerned then refer to. What is there of these parts already is kept.
    """
    moved = _misplaced(schema)
    if not moved:
        return json.loads(json.dumps(schema))
    note = "Objects that stand by reference alone."
    to_message, to_type = {"$ref": f"#/properties/{REFERENCES}"}, {"description": note, "$ref": f"#/definitions/{REFERENCES_TYPE}"}
    holder = {"description": note, "type": "object"} | schema["definitions"].get(REFERENCES_TYPE, {})
    gathered = {name: rule for held in moved.values() for name, rule in held.items()}

    def mended(name: str, definition: dict) -> dict:
        if name not in moved:
            return definition
        rest = {k: v for k, v in definition["properties"].items() if k not in moved[name]}
        return definition | {"properties": {REFERENCES: to_message} | rest}

    definitions = {name: mended(name, d) for name, d in schema["definitions"].items()}
    definitions[REFERENCES_TYPE] = holder | {"properties": holder.get("properties", {}) | gathered}
    whole = schema | {"definitions": definitions, "properties": {REFERENCES: to_type} | schema.get("properties", {})}
    return json.loads(json.dumps(whole))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def first_messages(issues: DataFrame, most: int = 5) -> DataFrame:
    """(file, summary): the first messages of each file in order, and how many more there are."""
    one = issues.groupBy("file").agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.nullif("context", F.lit("")), "message"))).alias("m"))
    more = F.when(F.size("m") > most, F.concat(F.lit("; ... and "), (F.size("m") - most).cast("string"), F.lit(" more"))).otherwise("")
    return one.select("file", F.concat(F.array_join(F.slice("m", 1, most), "; "), more).alias("summary"))


def xml_to_json(elements: DataFrame) -> DataFrame:
    """(doc_id, source_file, json) of shredded XML documents: built from the leaves up, one level a round of joins.

    An element is its text, or an object of its children by name (repeated names as lists) with attributes as @name.
    The elements are written first, so that documents are shredded once whatever their depth.
    """
    elements = written(elements, "elements")
    e = elements.filter("error IS NULL")
    deepest = e.agg(F.max("depth")).first()[0]
    if deepest is None:
        return elements.limit(0).select("doc_id", "source_file", F.lit("").alias("json"))
    done = None
    quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    for depth in range(deepest, -1, -1):
        level = e.filter(F.col("depth") == depth)
        ids = F.map_filter(F.create_map(F.lit("id"), F.col("sid"), F.lit("uri"), F.col("suri"), F.lit("ref"), F.col("sref")), lambda k, v: v.isNotNull())
        attrs = F.transform(F.map_entries(F.map_concat("attrs", ids)), lambda x: F.concat(quote(F.concat(F.lit("@"), x["key"])), F.lit(":"), quote(x["value"])))
        if done is not None:
            by_name = done.groupBy("doc_id", "parent_ord", "qname").agg(F.min("ord").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]).alias("j"))
            part = F.concat(quote(F.col("qname")), F.lit(":"), F.when(F.size("j") == 1, F.col("j")[0]).otherwise(F.concat(F.lit("["), F.array_join("j", ","), F.lit("]"))))
            kids = by_name.groupBy("doc_id", F.col("parent_ord").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]).alias("kids"))
            level = level.join(kids, ["doc_id", "ord"], "left")
        else:
            level = level.withColumn("kids", F.lit(None).cast("array<string>"))
        kids = F.coalesce("kids", F.array().cast("array<string>"))
        own_text = F.when(F.col("text").isNotNull() & ((F.size(attrs) > 0) | (F.size(kids) > 0)), F.array(F.concat(F.lit('"#text":'), quote(F.col("text"))))).otherwise(F.array().cast("array<string>"))
        members = F.concat(attrs, kids, own_text)
        value = F.when(F.size(members) > 0, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).when(F.col("text").isNotNull(), quote(F.col("text"))).otherwise("null")
        done = level.select("doc_id", "source_file", "ord", "parent_ord", "qname", value.alias("json"))
    return done.select("doc_id", "source_file", F.concat(F.lit("{"), quote(F.col("qname")), F.lit(":"), F.col("json"), F.lit("}")).alias("json"))
