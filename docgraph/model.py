"""Schemas of the graph tables, as Spark DDL."""

ELEMENTS = (
    "doc_id string, source_file string, upload_id string, ord int, parent_ord int, depth int, path array<int>, qpath array<string>, sib_ord int, qname string, "
    "text string, n_children int, attrs map<string,string>, sid string, suri string, sref string, is_nil boolean, json_type string, error string"
)
NODE_PROPS = "doc_id string, id string, key string, ord int, value string, is_augmentation boolean"
ISSUES = "file string, line int, col int, severity string, rule string, message string, context string, doc_id string, upload_id string"

#: Namespaces of the structural attributes id, uri and ref: any namespace whose last parts are structures/<version>.
STRUCTURES = r"/structures/\d+(\.\d+)*/?(#)?$"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
