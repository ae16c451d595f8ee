from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docgraph.llm import hamerly, pii, queries, spelling
from docgraph.llm.common import materialize

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------------------------------- clusters


def brute_clusters(rows: list[tuple[int, list[float]]], k: int, dims: int, rounds: int = 5) -> tuple[dict, list[list[int]]]:
    """rows: ids are unique. Plain integers all the way."""
    import math

    kept = [(i, [math.floor(float(np.float32(x)) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in kept)[:k]]

    def nearest(v: list[int]) -> tuple[int, int]:
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [nearest(v)[0] for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return {i: nearest(v) for i, v in kept}, centres


@pytest.mark.parametrize("spread", [0.05, 1.0, 3e4])  # the last is beyond what doubles hold exactly
def test_clusters_equal_plain_lloyd(spark, spread: float) -> None:  # noqa: ANN001
    r = random.Random(5)
    middles = [[r.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = [(i, [x * spread + r.gauss(0, spread / 5) for x in middles[i % 9]]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a common vector
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [1.0] * 7 + [None]), (2004, [1.0] * 7 + [float("nan")]), (2005, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    found = hamerly.cluster_vectors(df, k=12, dims=8)
    want, centres = brute_clusters(rows, 12, 8)
    got = {x["vec_id"]: (x["cluster"], x["distance"]) for x in found.assigned.collect()}
    assert got == want and found.centroids == centres
    assert found.scans[0] == 460 and sum(found.scans[1:]) < 0.6 * 460 * (len(found.scans) - 1)  # bounds spare most scans


def test_cluster_query_has_totals_and_digests(spark) -> None:  # noqa: ANN001
    rows = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centres = brute_clusters(rows, 40, 64)
    got = {x["vec_id"]: x for x in queries.queries()["op11_centroid_clusters"](spark, SF).collect()}
    by = Counter()
    for c, d in want.values():
        by[c] += d
    assert set(got) == set(want)
    for i, (c, d) in want.items():
        x = got[i]
        assert (x["cluster"], x["distance"], x["cluster_inertia"], x["inertia"]) == (c, d, by[c], sum(by.values()))
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()


def test_cluster_edge_cases(spark) -> None:  # noqa: ANN001
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamerly.clusters_with_totals(hamerly.cluster_vectors(empty)).collect() == []
    few = spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (None, None)], "vec_id long, embedding array<double>")
    got = hamerly.cluster_vectors(few, k=2, dims=2)
    assert sorted((x["vec_id"] or 0, x["cluster"], x["distance"]) for x in got.assigned.collect()) == [(0, 0, 0), (3, 0, 0), (3, 1, 0), (3, 1, 0)]
    none = hamerly.cluster_vectors(spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>"), dims=2)
    assert none.assigned.collect() == [] and none.centroids == []
    far = hamerly.cluster_vectors(spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"), k=1, dims=2)
    assert max(x["distance"] for x in far.assigned.collect()) == (1 << 63) - 1
    whole = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "vec_id long, embedding array<int>")
    assert len(hamerly.cluster_vectors(whole, dims=2).assigned.collect()) == 2


# -------------------------------------------------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text: str) -> list[tuple[int, int, str]]:
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns() -> None:
    r = random.Random(3)
    pieces = ["@", ".", "a", "b-c", "1", "255", "256", "0012", "+", " ", "-", "(", ")", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "a_b", "%", "é", "\n", "+1 (212) 555-0100", "1.2.3.4", "..", "@@"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert sorted(pii.base_spans(text)) == sorted(brute_spans(text)), text
    long = "a" * 300_000 + " " + "1" * 300_000 + " " + "1." * 100_000 + "+" * 100_000 + "@" * 100_000
    assert pii.base_spans(long) is not None and pii.candidates(long) is not None  # in linear time


def noisy_corpus(n: int) -> tuple[list[tuple[int, str]], dict[int, list[str]]]:
    """Texts in which personal data stands where base patterns miss it, and texts with numbers that are none."""
    r = random.Random(8)

    def card() -> str:
        d = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def no_card() -> str:
        d = card()
        return d[:-1] + str((int(d[-1]) + 1 + r.randrange(8)) % 10)

    words = lambda k: " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(k))
    rows, planted = [], {}
    for i in range(n):
        phone, kind = f"+1 ({r.randint(212, 989)}) 555-{r.randint(1000, 9999)}", i % 8
        number, host, first = card(), f"{words(1)}@{words(1)}.example.com", r.choice(["Maria", "Peter", "Claire"])
        body = {
            0: f"{phone} {number}", 1: f"email {host} and ip 10.{r.randint(1, 250)}.3.9", 2: f"call {phone}", 3: f"order no {no_card()} ref", 4: f"version {r.randint(1, 9)}.{r.randint(300, 900)}.1.2",
            5: f"write to {words(1)} [at] {words(1)} [dot] com", 6: f"signed, Dr. {first} Garcia", 7: f"card {number}",
        }[kind]
        planted[i] = {0: [phone, number], 5: [body[9:]], 6: [f"{first} Garcia"]}.get(kind, [])
        rows.append((i, f"{words(12)} {body} {words(9)}."))
    return rows, planted


def test_added_spans_have_precision_and_recall(spark) -> None:  # noqa: ANN001
    rows, planted = noisy_corpus(800)
    got = {x["doc_id"]: x["spans"] for x in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = added = 0
    for i, text in rows:
        more = [text[s["begin"] : s["end"]] for s in got[i] if not s["base"]]
        assert sorted((s["begin"], s["end"], s["kind"]) for s in got[i] if s["base"]) == sorted(brute_spans(text))
        added += len(more)
        hit += sum(p in more for p in planted[i])
    assert hit >= 0.97 * sum(map(len, planted.values())) and hit >= 0.97 * added


def test_estimation_finds_reliabilities_and_never_turns_votes_round() -> None:
    r = np.random.default_rng(4)
    truth = r.random(40_000) < 0.7
    right = np.array([0.95, 0.9, 0.75, 0.6])
    votes = np.where(r.random((40_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int) + 1
    votes[r.random((40_000, 4)) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = pii.estimate(np.zeros(len(patterns), int), patterns, counts.astype(float), 1)
    said = found.given[0, :, :, 2] / found.given[0, :, :, 1:].sum(2)
    assert np.abs(said[:, 1] - right).max() < 0.03 and np.abs(1 - said[:, 0] - right).max() < 0.03 and abs(found.prior[0] - 0.7) < 0.03
    contrary = pii.estimate(np.zeros(2, int), np.array([[2, 2, 1], [1, 1, 2]]), np.array([1000.0, 1000.0]), 1)
    assert (contrary.given[0, :, 1, 2] >= contrary.given[0, :, 0, 2] - 1e-9).all()


def test_kinds_have_their_own_reliabilities() -> None:
    """Cards are half junk that a checksum tells, beside very many addresses that nothing speaks against."""
    code = lambda votes: [pii.OUTCOMES.index(v) for v in votes]
    rows = [("email", "1-1---1", 5000), ("card", "111---1", 160), ("card", "100---1", 90), ("card", "101---1", 60), ("card", "110---1", 12)]
    kinds, votes = np.array([pii.RANK[k] for k, _, _ in rows]), np.array([code(v) for _, v, _ in rows])
    p = pii.estimate(kinds, votes, np.array([float(n) for _, _, n in rows])).posterior(kinds, votes)
    assert p[0] > 0.95 and p[1] > 0.95 and (p[2:4] < 0.2).all()


def test_personal_edge_cases(spark) -> None:  # noqa: ANN001
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal(empty).collect() == [] and pii.mask_personal(empty).collect() == []
    rows = [(1, None, 2), (None, "a@b.de", 2), (3, "", 2), (4, "a@b.de", 2), (4, "a@b.de", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    assert sorted((x["doc_id"] or 0, len(x["spans"])) for x in pii.find_personal(df).collect()) == [(0, 1), (1, 0), (3, 0), (4, 1), (4, 1)]
    assert sorted((x["text"] or "", x["spans"]) for x in pii.mask_personal(df).collect()) == [("", 2), ("", 2), ("[email]", 2), ("[email]", 2), ("[email]", 2)]


def test_personal_query_digests(spark) -> None:  # noqa: ANN001
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op12_personal_data"](spark, SF).collect()
    assert len(got) == len(texts)
    rank = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    for x in got:
        base = sorted(brute_spans(texts[x["doc_id"]] or ""), key=lambda s: (s[0], rank[s[2]]))
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert x["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [x[f"n_{k}"] for k in rank] == [sum(s[2] == k for s in base) for k in rank]
        assert set(filter(None, line.split(","))) <= set(x["spans"].split(","))


# ------------------------------------------------------------------------------------------------------------- spelling


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    count: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                count[w] += 1
    n = {w: c for w, c in count.items() if c >= 5}
    neighbours = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(neighbours[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def last(w: str) -> str:
        return last(form[w]) if form[w] else w

    return {w: (form[w], last(w), n[w], len(neighbours[w]), n.get(form[w])) for w in n}


def variants(df) -> dict[str, tuple]:  # noqa: ANN001
    return {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.spelling_variants(df).collect()}


def test_variants_equal_all_pairs_on_documents(spark) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_variants([(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()])
    assert variants(docs) == want and len(want) > 100


def test_variants_equal_all_pairs_on_close_words(spark) -> None:  # noqa: ANN001
    r = random.Random(2)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(260)}
    docs = [(i, " ".join([w] * 5 * r.choice([1, 1, 1, 5, 26, 130]))) for i, w in enumerate(sorted(words))]
    docs += [(None, "ABABABA ×÷aaaaa null " * 7), (7, None), (8, ""), (9, "abcdefg" * 20_000), (9, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, word string").repartition(4)
    want = brute_variants(docs)
    assert variants(df) == want and sum(v[1] != (v[0] or w) for w, v in want.items()) > 3  # chains of two forms and more
    pairs = {(x["a"], x["b"]) for x in spelling.near_pairs(materialize(spelling.counted_words(df), "words")).collect()}
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in want for b in want if a < b and near(a, b)}


def test_variants_of_nothing(spark) -> None:  # noqa: ANN001
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
