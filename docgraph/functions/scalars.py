"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories with their patterns in lower-case qualified names, in order of precedence.
CATEGORIES = {
    "person": ["person", "driver", "passenger", "child", "parent", "guardian", "witness", "victim", "subject", "arrest", "defendant", "plaintiff", "juror"],
    "organization": ["organization", "org", "company", "agency", "department", "unit", "employer", "enforcement"],
    "address": ["address", "location", "place"],
    "vehicle": ["vehicle", "conveyance", "car", "aircraft", "vessel", "boat"],
}
#: The matcher's record types.
RECORD_TYPES = {"person": "PERSON", "organization": "ORGANIZATION", "address": "ADDRESS", "vehicle": "VEHICLE"}
#: Date formats, in the order they are tried.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX")


def strip(x: Column) -> Column:
    """Without white space at both ends, all kinds of it."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def entity_key(full: Column, given: Column, surname: Column) -> Column:
    """The full name, or given and surname where both are there, lower case, each space as _; else empty."""
    whole, first, last = (strip(F.coalesce(c, F.lit(""))) for c in (full, given, surname))
    norm = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    return F.when(whole != "", norm(whole)).when((first != "") & (last != ""), F.concat(norm(first), F.lit("_"), norm(last))).otherwise("")


def cluster_id(key: Column, prefix: str = "RE_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 12))


def display_name(full: Column, given: Column, middle: Column, surname: Column) -> Column:
    """The full name, else the parts that are there; an absent middle name leaves two spaces between the others."""
    parts = strip(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (given, middle, surname)]))
    return F.when(strip(F.coalesce(full, F.lit(""))) != "", full).otherwise(parts)


def normal_date(x: Column) -> Column:
    """yyyy-MM-dd from the first format that fits; other values unchanged."""
    parsed = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), x)


def confidence(score: Column) -> Column:
    """A share from a score in thousandths above 100, in hundredths above 1, or as it is; 0 for none."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s > 100, F.least(s / 1000, F.lit(1.0))).when(s > 1, s / 100).otherwise(s)


def category(qname: Column) -> Column:
    low, out = F.lower(qname), None
    for name, patterns in CATEGORIES.items():
        test = low.rlike("|".join(patterns))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def record_type(kind: Column) -> Column:
    out = None
    for name, value in RECORD_TYPES.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise("GENERIC")


def normal_key(key: Column) -> Column:
    """Lower case without separators, for tests of how a property key ends."""
    return F.regexp_replace(F.lower(key), "[_-]", "")


def key_ends(key: Column, field: str) -> Column:
    return normal_key(key).endswith("".join(c for c in field.lower() if c not in "_-"))


def values_of(x: Column) -> Column:
    """A list of strings from a JSON list, or a one-element list of the value; null gives an empty list."""
    listed = F.from_json(x, "array<string>")
    return F.when(x.isNull() | (strip(x) == ""), F.array().cast("array<string>")).when(x.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(x))


def conformance_target(x: Column) -> Column:
    """ref before ext before sub; sub where none is named."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(low.contains("#reference") | low.contains("/ref"), "ref").when(low.contains("#extension") | low.contains("/ext"), "ext").otherwise("sub")


def masked(x: Column, shown: int) -> Column:
    return F.concat(F.substring(x, 1, shown), F.lit("***"))


#: Abbreviations in match keys, and the sentences for keys without parts.
KEY_WORDS = {"DOB": "date of birth", "ADDR": "address"}
EXACTLY_SAME, SAME_ID, UNKNOWN_KEY = "Exact match (all attributes identical)", "Same identifier", "Unknown match criteria"


def match_key_words(key: Column) -> Column:
    """+NAME+DOB as Name + Date Of Birth; the keys without parts have sentences of their own."""
    def spelt(p: Column) -> Column:
        out = F.replace(p, F.lit("_"), F.lit(" "))
        for short, words in KEY_WORDS.items():
            out = F.when(F.upper(p) == short, words).otherwise(out)
        return F.initcap(out)

    parts = F.transform(F.filter(F.split(key, r"\+"), lambda p: p != ""), spelt)
    special = F.when(F.upper(key) == "EXACTLY_SAME", EXACTLY_SAME).when(key == "SAME_ID", SAME_ID).when(F.coalesce(key, F.lit("")) == "", UNKNOWN_KEY)
    return special.otherwise(F.array_join(parts, " + "))


def short_label(*choices: Column, most: int = 25) -> Column:
    label = F.coalesce(*choices)
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 3), F.lit("..."))).otherwise(label)


#: The two formats of a validator's lines, and its short words for severities.
ISSUE_LINE = r"^\[(\w+)\]\s+(?:([^:]+):(\d+):(\d+):\s*)?(.+)$"
RULE_LINE = r"^(\w+)\s+([^:]+):(\d+):(\d+)\s+--\s+(?:(Rule\s+\S+):\s*)?(.*)$"
SEVERITIES = {"warn": "warning", "err": "error", "fatal": "error"}


def issue_fields(line: Column, file: Column | None = None) -> dict[str, Column]:
    """Fields of ``[severity] file:line:col: message``, where the place may be absent, or ``SEVERITY file:line:col -- Rule r:
    message``; else the message alone, as an error. ``file``: the file that lines without a place are about."""
    one, two = line.rlike(ISSUE_LINE), line.rlike(RULE_LINE)
    pick = lambda i, j: F.when(one, F.regexp_extract(line, ISSUE_LINE, i)).when(two, F.regexp_extract(line, RULE_LINE, j))
    there = lambda c: F.nullif(c, F.lit(""))
    severity = F.lower(F.coalesce(pick(1, 1), F.lit("error")))
    for short, word in SEVERITIES.items():
        severity = F.when(severity == short, word).otherwise(severity)
    return {
        "file": F.coalesce(there(pick(2, 2)), file if file is not None else F.lit(None)), "line": there(pick(3, 3)).cast("int"), "col": there(pick(4, 4)).cast("int"), "severity": severity,
        "rule": F.when(two & ~one, there(F.regexp_extract(line, RULE_LINE, 5))), "message": F.coalesce(F.trim(pick(5, 6)), F.substring(line, 1, 500)),
    }


def dotted(qname: Column) -> Column:
    """p:Name as p.Name, the form of identifiers in models; ``from_dotted`` is the way back."""
    return F.replace(qname, F.lit(":"), F.lit("."))


def from_dotted(name: Column) -> Column:
    return F.regexp_replace(name, r"^([^.:]+)\.", "$1:")
