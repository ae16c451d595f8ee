"""Secret scans with structural confirmation.

Pattern kinds (assign, access, hex) are reported as found. Beyond them, runs that look like base64 or hex are
decoded, and reported only if the bytes have the structure of a key: DER sequences whose nested lengths fit
exactly, SSH key blobs whose length-prefixed fields end with the blob, SSH key containers whose every field, key and
section is parsed to the end, PEM armour around these (or around what its own headers say is enciphered), or a signed
token whose header and claims are JSON objects and whose header names an algorithm. Base64 may be the URL-safe one,
and may be broken into lines.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import map_slices

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal, so this is AKIA[A-Z0-9]+ of 20 characters and more
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that the structure confirms, in the order they are listed in.
CONFIRMED_KINDS = ("pem", "jwt", "ssh", "der")
RANK = {k: i for i, k in enumerate((*BASE_KINDS, *CONFIRMED_KINDS))}

PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,60}KEY)-----")
PEM_BODY = re.compile(r"\s*((?:[A-Za-z-]+:[^\n]*\n(?:[\x20\t][^\n]*\n)*)*)([A-Za-z0-9+/=\s]+)")
PEM_CIPHER = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*([A-Z0-9-]+),\s*([0-9A-Fa-f]{16,32})\s*")
#: Three parts, of which the first two can begin a JSON object: e and w or y stand for an opening brace and what follows it.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]++)\.(e[wy][A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
URL_SAFE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_-]{40,}+={0,2}(?![+/])")
#: Lines of one length after the first and a shorter last one.
BROKEN = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,80}+\r?\n[\x20\t]{0,40})++[A-Za-z0-9+/]*+={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length field at ``at`` and where the contents begin; None unless in the shortest form."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 128:
        return first, at + 1
    n = first & 127
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    length = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (length, at + 1 + n) if length >= 128 and data[at + 1] else None


#: Universal tags that key encodings hold: integer, bit string, octet string, null, object id, sequence, set, context 0 to 3.
_TAGS = {0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3}


def der_fields(data: bytes, begin: int, end: int, depth: int = 0) -> int:
    """Number of fields if ``data[begin:end]`` is exactly a run of well-formed DER fields, else -1."""
    found, at = 0, begin
    while at < end:
        if data[at] not in _TAGS or depth > 12 or (got := der_length(data, at + 1)) is None:
            return -1
        length, inner = got
        if inner + length > end or (data[at] == 0x05 and length) or (data[at] == 0x02 and not length):
            return -1
        if data[at] & 0x20:
            below = der_fields(data, inner, inner + length, depth + 1)
            if below < 0:
                return -1
            found += below
        found += 1
        at = inner + length
    return found


def is_der_key(data: bytes) -> bool:
    """A DER sequence that spans all bytes and holds at least an integer or object id and another field."""
    if len(data) < 24 or data[0] != 0x30 or (got := der_length(data, 1)) is None or got[1] + got[0] != len(data):
        return False
    return der_fields(data, got[1], len(data)) >= 2


def ssh_field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed field at ``at`` and where it ends."""
    if at + 4 > len(data):
        return None
    (n,) = struct.unpack_from(">I", data, at)
    return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) else None


_KEY_TYPE = re.compile(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+$")
_CONTAINER = b"openssh-key-v1\0"


def is_ssh_blob(data: bytes) -> bool:
    """Length-prefixed fields that end with the blob and begin with a key type."""
    at, fields, first = 0, 0, b""
    while got := ssh_field(data, at):
        first = first or got[0]
        at, fields = got[1], fields + 1
    return at == len(data) and fields >= 2 and _KEY_TYPE.match(first) is not None


def is_ssh_container(data: bytes) -> bool:
    """A private-key container: cipher, key derivation and its options, a count of public keys that are key blobs, and one private
    section that ends with the data and fills whole blocks; in plain, it begins with a number twice and names a key type."""
    if not data.startswith(_CONTAINER):
        return False
    at, head = len(_CONTAINER), []
    for _ in range(3):
        if not (got := ssh_field(data, at)):
            return False
        head.append(got[0])
        at = got[1]
    cipher, derivation, options = head
    plain = cipher == b"none"
    if not re.fullmatch(rb"[a-z0-9@.-]{3,40}", cipher) or derivation not in (b"none", b"bcrypt") or plain != (derivation == b"none") or bool(options) == plain or at + 4 > len(data):
        return False
    (keys,) = struct.unpack_from(">I", data, at)
    at += 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys):
        if not (got := ssh_field(data, at)) or not is_ssh_blob(got[0]):
            return False
        at = got[1]
    got = ssh_field(data, at)
    if not got or got[1] != len(data) or not got[0] or len(got[0]) % 8:
        return False
    section = got[0]
    if not plain:
        return len(section) % 16 == 0 or cipher.startswith((b"3des", b"blowfish", b"cast", b"chacha"))
    named = ssh_field(section, 8)
    return len(section) > 16 and section[:4] == section[4:8] and named is not None and _KEY_TYPE.match(named[0]) is not None


def from_base64(run: str, urlsafe: bool = False) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_container(data) or is_ssh_blob(data) else None


def is_armoured(body: str) -> bool:
    """What stands between the lines of an armour: a key, or, under headers that name a cipher, whole blocks of it."""
    m = PEM_BODY.fullmatch(body)
    if not m:
        return False
    data = from_base64("".join(m[2].split()))
    if not m[1]:
        return key_kind(data) is not None
    cipher = PEM_CIPHER.fullmatch(m[1])
    if cipher:
        block = len(cipher[2]) // 2
        return block in (8, 16) and bool(data) and len(data) % block == 0
    return key_kind(data) is not None


def is_token(header: str, claims: str) -> bool:
    try:
        head, body = (json.loads(from_base64(x, urlsafe=True) or b"") for x in (header, claims))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def armoured_spans(text: str) -> list[tuple[int, int]]:
    """Places of armoured keys; a label that no end line follows is looked for once."""
    found, gone, free = [], set(), 0
    for m in PEM_BEGIN.finditer(text):
        end = f"-----END {m[1]}-----"
        if m.start() < free or m[1] in gone:
            continue
        stop = text.find(end, m.end())
        if stop < 0:
            gone.add(m[1])
        elif (next_begin := text.find("-----BEGIN ", m.end(), stop)) < 0 and is_armoured(text[m.end() : stop]):
            found.append((m.start(), stop + len(end)))
            free = stop + len(end)
        elif next_begin < 0:
            free = stop
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that the structure of their bytes confirms; none lies within another of them."""
    pem = armoured_spans(text) if "-----BEGIN " in text else []
    found = [(a, b, "pem") for a, b in pem]
    if "." in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_token(m[1], m[2])]
    taken = sorted((a, b) for a, b, _ in found)
    begins = [a for a, _ in taken]

    def add(m: re.Match, data: bytes | None) -> None:
        at = bisect_right(begins, m.start()) - 1
        if at >= 0 and taken[at][1] >= m.end():
            return
        kind = key_kind(data)
        if kind:
            found.append((m.start(), m.end(), kind))
            k = bisect_right(begins, m.start())
            begins.insert(k, m.start())
            taken.insert(k, (m.start(), m.end()))

    if "\n" in text:
        for m in BROKEN.finditer(text):
            add(m, from_base64("".join(m[0].split())))
    for m in BASE64.finditer(text):
        add(m, from_base64(m[0]))
    for m in URL_SAFE.finditer(text):
        if "-" in m[0] or "_" in m[0]:
            add(m, from_base64(m[0], urlsafe=True))
    for m in HEX_ANY.finditer(text):
        add(m, bytes.fromhex(m[0]))
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], RANK[s[2]], s[1])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` with its spans (code points, end exclusive), ``kind:start:end`` by start.

    Null text: an empty one, so no spans. Repeated rows are scanned one by one; a null doc_id stays null; other
    columns are not read. An empty table gives an empty result. Very long texts are scanned whole, in linear time. Spans that
    begin together are in the order of their kinds, then by end.
    """

    def scan(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")}
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            more = confirmed_spans(text or "")
            for k in BASE_KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(base + more))
            out["n_confirmed"].append(len(more))
        return out | {"doc_id": batch.column("doc_id")}

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def mask(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each span, overlaps joined, replaced by ``mark``; null stays null."""
    if text is None:
        return None
    spans = sorted((a, b) for a, b, _ in base_spans(text) + confirmed_spans(text))
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` masked; all rows and columns stay. Null text stays null."""

    def scan(batch: pa.RecordBatch) -> dict:
        columns = {n: batch.column(n) for n in batch.schema.names}
        return columns | {"text": pa.array([mask(t) for t in batch.column("text").to_pylist()], pa.string())}

    return map_slices(docs, scan, docs.schema)
