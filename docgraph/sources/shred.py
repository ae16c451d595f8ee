"""Documents to element rows: the one place where Python touches documents. One row in, one row an element out.

XML and JSON-LD give the same table, so everything after it is the same DataFrame code. A document that can't be parsed
gives one row with ``error`` set, and the others go on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.model import ELEMENTS, STRUCTURES, XSI

_STRUCTURES = re.compile(STRUCTURES)
_COLUMNS = [c.split()[0] for c in re.sub(r"<[^>]*>", "", ELEMENTS).split(", ")]


#: Bytes that a parser is given at once, and from which on a document is read twice rather than kept: first to see that it can be
#: read at all, then for its rows.
FEED, KEPT = 64 << 10, 8 << 20


class _Rows:
    """Rows of one document, each given out when its element ends; what is held is the open elements."""

    def __init__(self, doc_id: str, source_file: str, upload_id: str) -> None:
        self.head, self.n, self.open, self.done = (doc_id, source_file, upload_id), 0, [], []
        self.siblings: list[dict[str, int]] = [{}]

    def begin(self, qname: str, json_type: str | None = None) -> dict:
        seen = self.siblings[-1]
        seen[qname] = seen.get(qname, 0) + 1
        doc_id, source_file, upload_id = self.head
        above = self.open[-1] if self.open else None
        row = {
            "doc_id": doc_id, "source_file": source_file, "upload_id": upload_id, "ord": self.n, "parent_ord": above and above["ord"], "depth": len(self.open),
            "path": [*above["path"], above["ord"]] if above else [], "qpath": [*above["qpath"], above["qname"]] if above else [],
            "sib_ord": seen[qname], "qname": qname, "text": None, "n_children": 0, "attrs": {}, "sid": None, "suri": None, "sref": None, "is_nil": False, "json_type": json_type, "error": None,
        }
        if above:
            above["n_children"] += 1
        self.n += 1
        self.open.append(row)
        self.siblings.append({})
        return row

    def end(self, text: str | None = None) -> None:
        row = self.open.pop()
        self.siblings.pop()
        row["text"] = text
        self.done.append(row)

    def taken(self) -> list[dict]:
        """The rows that are done, which are forgotten."""
        done, self.done = self.done, []
        return done

    def failed(self, message: str) -> dict:
        return dict.fromkeys(_COLUMNS) | dict(zip(_COLUMNS, self.head)) | {"ord": 0, "error": message}


def _refuse(*_: object) -> None:
    raise ValueError("document type declarations are not allowed")


def _fed(parser: expat.XMLParserType, content: bytes | memoryview) -> Iterator[None]:
    for at in range(0, len(content), FEED):
        parser.Parse(bytes(content[at : at + FEED]), False)
        yield
    parser.Parse(b"", True)
    yield


def shred_xml(doc_id: str, source_file: str, upload_id: str, content: bytes | memoryview, encoding: str | None = None) -> Iterator[dict]:
    """Rows of an XML document, in the order in which elements end. Document type declarations, and so entities, are refused; namespaces are scoped.

    Bytes are read in the encoding that the document declares, unless ``encoding`` names another. Memory does not grow
    with the document: it is parsed piece by piece, and a large one, whose rows can't be taken back, is first parsed for
    errors alone. One that can't be read gives its error row and no other.
    """
    out = _Rows(doc_id, source_file, upload_id)
    prefixes: dict[str, list[str]] = {}
    texts: list[list[str]] = []

    def name(tag: str) -> str:
        uri, _, local = tag.rpartition(" ")
        return f"{(prefixes.get(uri) or ['ns'])[-1]}:{local}" if uri else local

    def declared(prefix: str | None, uri: str) -> None:
        if prefix:
            prefixes.setdefault(uri, []).append(prefix)

    def start(tag: str, attributes: dict) -> None:
        row = out.begin(name(tag))
        texts.append([])
        for key, value in attributes.items():
            uri, _, local = key.rpartition(" ")
            if uri == XSI:
                row["is_nil"] |= local == "nil" and value.strip() in ("true", "1")
            elif _STRUCTURES.search(uri) and local in ("id", "uri", "ref"):
                row["s" + local] = value
            elif not _STRUCTURES.search(uri):
                row["attrs"][name(key)] = value

    def end(_: str) -> None:
        out.end("".join(texts.pop()).strip() or None)

    def parser_of(rows: bool) -> expat.XMLParserType:
        parser = expat.ParserCreate(encoding, namespace_separator=" ")
        parser.buffer_text = True
        parser.StartDoctypeDeclHandler = _refuse
        if rows:
            parser.StartNamespaceDeclHandler, parser.StartElementHandler, parser.EndElementHandler = declared, start, end
            parser.CharacterDataHandler = lambda t: texts and texts[-1].append(t)
        return parser

    large = len(content) > KEPT
    try:
        if large:
            for _ in _fed(parser_of(False), content):
                pass
        else:
            for _ in _fed(parser_of(True), content):
                pass
    except (expat.ExpatError, ValueError, LookupError) as e:  # LookupError: an encoding that is not known
        yield out.failed(str(e))
        return
    if large:
        for _ in _fed(parser_of(True), content):
            yield from out.taken()
    yield from out.taken()


_JSON_TYPES = {dict: "object", type(None): "null", bool: "boolean", int: "integer", float: "number"}


def _scalar(value: object) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def shred_json(doc_id: str, source_file: str, upload_id: str, content: bytes | memoryview) -> Iterator[dict]:
    """Rows of a JSON-LD document, which is held whole: objects as elements, an object with @id alone as a reference, text wrappers unwrapped.

    More than one object in @graph get a common root named ``@graph``. Objects carry @id as their uri, so that one that
    occurs in several places becomes a hub, as in XML.
    """
    out = _Rows(doc_id, source_file, upload_id)

    def walk(key: str, value: object) -> None:
        if isinstance(value, list):
            for v in value:
                walk(key, v)
            return
        if isinstance(value, dict) and len(value) == 1 and "nc:TextLiteral" in value:
            value = value["nc:TextLiteral"]
            if isinstance(value, (list, dict)):
                walk(key, value)
                return
        kind = _JSON_TYPES.get(type(value), "string")
        row = out.begin(key, kind)
        if not isinstance(value, dict):
            out.end(_scalar(value))
            return
        ident = value.get("@id")
        if isinstance(ident, str):
            if len(value) == 1:
                row["sref"], row["is_nil"] = ident.lstrip("#"), True
            else:
                row["suri"] = ident
        for k, v in value.items():
            if not k.startswith("@"):
                walk(k, v)
        out.end()

    def root_name(obj: dict) -> str:
        kind = obj.get("@type")
        kind = kind[0] if isinstance(kind, list) and kind else kind
        plain = [k for k in obj if not k.startswith("@")]
        return kind if isinstance(kind, str) else plain[0] if len(plain) == 1 and isinstance(obj[plain[0]], dict) else "@root"

    try:
        data = json.loads(bytes(content))
        if not isinstance(data, (dict, list)):
            raise ValueError("neither an object nor a list")
        objects = data if isinstance(data, list) else data.get("@graph", [data])
        objects = objects if isinstance(objects, list) else [objects]
        if len(objects) != 1:
            out.begin("@graph", "object")
        for obj in objects:
            if not isinstance(obj, dict):
                raise ValueError("an item of the graph is not an object")
            named = root_name(obj)
            walk(named, obj[named] if named in obj and "@type" not in obj else obj)
        if len(objects) != 1:
            out.end()
    except (ValueError, RecursionError) as e:
        yield out.failed(str(e))
        return
    yield from out.taken()


def shred(docs: DataFrame, dialect: str | None = None) -> DataFrame:
    """Elements of ``docs`` (doc_id, source_file, upload_id, content). Dialect: xml or json, or by the name's ending.

    Binary content is read in the document's own encoding, a string as it is. A document that can't be read gives an error row.

    Null content gives an error row; repeated documents keep apart only by their doc_id; an empty table gives an empty one.
    """

    encoding = None if docs.schema["content"].dataType.simpleString() == "binary" else "utf-8"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(ELEMENTS))
    maps, values = [f.name for f in arrow if pa.types.is_map(f.type)], itemgetter(*_COLUMNS)

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        heads, contents = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source_file", "upload_id"))), batch.column("content")
        for k, head in enumerate(heads):
            kind = dialect or ("json" if str(head[1]).lower().endswith((".json", ".jsonld")) else "xml")
            content = memoryview(contents[k].as_buffer()) if contents[k].is_valid else b""  # not a copy
            yield from shred_json(*head, content) if kind == "json" else shred_xml(*head, content, encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch)
            while piece := list(islice(rows, 5_000)):
                columns = dict(zip(_COLUMNS, zip(*map(values, piece))))
                columns |= {m: [v if v is None else tuple(v.items()) for v in columns[m]] for m in maps}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    chosen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source_file", "upload_id", F.col("content").cast("binary").alias("content"))
    return chosen.mapInArrow(run, ELEMENTS)
