from __future__ import annotations

import base64
import json
import os
import random
import struct

import pytest

from docgraph.llm import secrets
from tests.llm.test_operators import KEY


def field(data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + data


PUBLIC = field(b"ssh-ed25519") + field(bytes(range(32)))


def container(cipher: bytes = b"none", derivation: bytes = b"none", options: bytes = b"", keys: int = 1, public: bytes = PUBLIC, section: bytes | None = None) -> bytes:
    plain = b"\x01\x02\x03\x04" * 2 + PUBLIC + field(bytes(64)) + field(b"me@here")
    plain += bytes(range(1, 1 + -len(plain) % 8))
    return b"openssh-key-v1\0" + field(cipher) + field(derivation) + field(options) + struct.pack(">I", keys) + field(public) * keys + field(plain if section is None else section)


TRUE = [container(), container(keys=2), container(b"aes256-ctr", b"bcrypt", field(bytes(16)) + struct.pack(">I", 16), section=os.urandom(160)), container(public=field(b"ecdsa-sha2-nistp256") + field(b"nistp256") + field(bytes(65)))]
FALSE = [
    b"openssh-key-v1\0" + os.urandom(200), b"openssh-key-v1\0", container()[:-1], container() + b"x", container(section=os.urandom(15)), container(section=b""), container(section=os.urandom(64)),
    container(b"aes256-ctr", b"none", section=os.urandom(64)), container(b"none", b"bcrypt", b"o"), container(public=os.urandom(51)), container(keys=0), container(b"\xff\x00"),
]


@pytest.mark.parametrize("data", TRUE)
def test_containers_are_parsed_to_the_end(data: bytes) -> None:
    assert secrets.is_ssh_container(data) and secrets.key_kind(data) == "ssh"
    armoured = f"-----BEGIN OPENSSH PRIVATE KEY-----\n{base64.encodebytes(data).decode()}-----END OPENSSH PRIVATE KEY-----"
    assert secrets.confirmed_spans(f"x {armoured} y") == [(2, 2 + len(armoured), "pem")]


@pytest.mark.parametrize("data", FALSE)
def test_containers_of_garbage_are_none(data: bytes) -> None:
    assert not secrets.is_ssh_container(data)
    text = f"x {base64.b64encode(data).decode()} -----BEGIN OPENSSH PRIVATE KEY-----\n{base64.encodebytes(data).decode()}-----END OPENSSH PRIVATE KEY----- y"
    assert secrets.confirmed_spans(text) == []


def token(header: str, claims: str = '{"sub": "1"}') -> str:
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return f"{part(header.encode())}.{part(claims.encode())}.{part(bytes(range(32)))}"


def test_tokens_with_blanks_in_their_json() -> None:
    for header in ('{"alg":"HS256"}', '{ "alg": "HS256" }', '{\n  "alg" : "none"\n}', '{\t"typ":"JWT","alg":"RS256"}', '{\r\n"alg":"HS256"}'):
        one = token(header, json.dumps({"a": 1}, indent=1))
        assert secrets.confirmed_spans(f"a {one} b") == [(2, 2 + len(one), "jwt")]
    for bad in (token('{ "kid": "HS256" }'), token('{"alg": 5}'), token("[1, 2, 3]"), token('{"alg":"HS256"}', "[1]"), "eyJ.eyJ.x", "eyABCDEF.eyABCDEF.x", "e" * 50_000 + "." + "ey" * 50_000):
        assert secrets.confirmed_spans(f"a {bad} b") == []


def test_other_forms_of_base64() -> None:
    lines = base64.encodebytes(KEY).decode().strip()
    assert "\n" in lines and secrets.confirmed_spans(f"key:\n{lines}\nend") == [(5, 5 + len(lines), "der")]
    dos = "\r\n  ".join(lines.split("\n"))
    assert secrets.confirmed_spans(f"key:\n{dos}\nend") == [(5, 5 + len(dos), "der")]
    wide = next(d for k in range(256) if (d := base64.urlsafe_b64encode(field(b"ssh-ed25519") + field(bytes([k, 255, 190]) * 11)).decode()) and ("-" in d or "_" in d))
    assert secrets.confirmed_spans(f"a {wide} b") == [(2, 2 + len(wide), "ssh")]
    prose = "\n".join("".join(random.Random(k).choice("abcdefgh") for _ in range(64)) for k in range(40))
    assert secrets.confirmed_spans(prose) == []


def test_armour_with_headers() -> None:
    body = base64.encodebytes(os.urandom(64)).decode()
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    whole = lambda inner: f"-----BEGIN RSA PRIVATE KEY-----\n{inner}-----END RSA PRIVATE KEY-----"
    good = [whole(head + body), whole("Comment: mine\n\n" + base64.encodebytes(KEY).decode())]
    for text in good:
        assert secrets.confirmed_spans(f"a {text} b") == [(2, 2 + len(text), "pem")]
    for text in (whole(body), whole("Proc-Type: 4,ENCRYPTED\n\n" + body), whole(head + base64.encodebytes(os.urandom(63)).decode()), whole(head), whole("not base64 at all"), "-----BEGIN RSA PRIVATE KEY-----\n" * 20_000):
        assert secrets.confirmed_spans(text) == []
    assert secrets.confirmed_spans("-----BEGIN EC PRIVATE KEY-----\n" + good[0]) == [(31, 31 + len(good[0]), "pem")]


def test_long_texts_take_linear_time() -> None:
    for text in ("A" * 1_000_000, ("A" * 60 + "\n") * 20_000, "-" * 500_000, "ab" * 400_000 + ".", "-----BEGIN A KEY-----" * 20_000):
        assert secrets.confirmed_spans(text) == []
