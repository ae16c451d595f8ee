"""Brute-force versions of the operators' contracts, on small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simhash(text: str | None, k: int = 4) -> int:
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list[int], prints: list[int], limit: int) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= limit:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def removed_words(docs: dict[int, str | None], n: int = 13) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    for d, ws in words.items():
        for i in range(len(ws) - n + 1):
            key = tuple(ws[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_scores(docs: dict[int, str | None]) -> dict[int, tuple[int, int, int, float]]:
    import math
    import zlib
    from collections import Counter

    tokens = {d: [*WORD.findall(lower_ascii(t or "")), None] for d, t in docs.items()}
    count = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, kinds = sum(count.values()), len(count)
    return {d: (len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in ws)) for d, ws in tokens.items()}
