"""Personal data by weak supervision: labelers vote on candidate spans, and their agreement alone says how far to trust each.

Candidates are the spans of the base patterns and of wider ones. Labelers of three sorts (patterns and checksums, gazetteers,
words around the span) vote for, against or not at all. Expectation-maximisation over the counts of vote patterns of the whole
corpus estimates how reliable each labeler is and how probable each pattern is to be personal data; with these probabilities
as labels, a logistic classifier over votes and shapes of spans is trained, and it decides on the wider candidates. Base
spans always stay.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.llm.common import arrow_schema, guarded, map_slices, materialize, to_batch

BASE_KINDS = ("email", "ip", "card", "phone")
#: All kinds in the order they are listed in.
KINDS = (*BASE_KINDS, "ssn", "iban", "person")
RANK = {k: i for i, k in enumerate(KINDS)}
ABSTAIN, AGAINST, FOR = "-", "0", "1"
OUTCOMES = ABSTAIN + AGAINST + FOR

# ---------------------------------------------------------------------------------------------------------------- base

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def digits_of(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def octets(quad: str) -> bool:
    return all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in quad.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans: from each @ back over the run before it (not into the last span), and on over the domain. Linear in the text."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        before = text[free:at]
        begin = free + len(before.rstrip(LOCAL_CHARS))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        free = at = m.end() if m else at + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in QUAD.finditer(text) if octets(m[0])]
    found += [(m.start(), m.end(), "card") for m in DIGITS.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), m.end(), "phone") for m in PLUS.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


# ---------------------------------------------------------------------------------------------------------- candidates

WORD = r"[A-ZÀ-Þ][a-zß-ÿ]+"
#: Wider candidates: those of numbers are found inside runs that the base patterns take whole and drop.
WIDER = {
    "email": [re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT)\x20?[\])])\x20?[A-Za-z0-9-]{1,63})+")],
    "ip": [re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")],
    "card": [
        re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
        re.compile(r"(?<![0-9])3[47][0-9]{2}([\x20.-])[0-9]{6}\1[0-9]{5}(?![0-9])"),
    ],
    "phone": [
        re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])"),
        re.compile(r"(?<![0-9+.-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])"),
    ],
    "ssn": [re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")],
    "iban": [re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")],
    "person": [re.compile(rf"(?<![A-Za-zÀ-ÿ]){WORD}(?:\x20{WORD}){{1,2}}(?![A-Za-zÀ-ÿ])")],
}
#: What a text must hold for the kind to be looked for at all.
HINT = {"email": re.compile(r"[\[(]\x20?(?:at|AT)\x20?[\])]"), "ip": re.compile(r"[0-9A-Fa-f]:"), "phone": re.compile(r"[0-9]{4}"), "card": re.compile(r"[0-9]{4}"), "ssn": re.compile(r"-[0-9]{2}-"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "person": re.compile(rf"{WORD}\x20{WORD}")}

# ------------------------------------------------------------------------------------------------------------ labelers

#: Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io ai app dev co uk de fr es it nl be ch at se no dk fi pl pt cz ru ua jp cn in br mx ar ca au nz us eu".split())
CARD_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[0689]|6")
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 351 352 353 354 358 380 420 421 971 972".split())
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen daniel matthew anthony mark donald steven paul andrew "
    "nancy lisa betty margaret sandra ashley emily anna emma olivia peter hans klaus jürgen wolfgang stefan andreas martin thomas sabine monika petra claudia julia katharina pierre jean michel philippe "
    "jacques françois nicolas marie isabelle sophie nathalie claire camille josé juan antonio manuel francisco carlos luis miguel maria carmen ana isabel lucía marta elena ahmed mohamed fatima ali wei".split()
)
TITLES = frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sr sra".split())
#: Words shortly before a span that speak for its kind, and before any that speak against all.
CUES = {
    "email": "email e-mail mail contact write reach correo courriel", "ip": "ip address host server client from adresse", "card": "card credit visa mastercard amex payment debit karte tarjeta carte",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon teléfono téléphone", "ssn": "ssn social security taxpayer", "iban": "iban account bank konto cuenta compte",
    "person": "name named mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sr sra signed author regards",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
COUNTER_CUES = frozenset("version release build isbn issn doi order invoice part serial sku model figure table page section chapter item ref reference commit hash line row id number no nr".split())
TOKENS = re.compile(r"[A-Za-zÀ-ÿ-]+")
#: Code points before a span in which cues count.
REACH = 40


def same_or_running(digits: str) -> bool:
    """Digits that someone typed as a placeholder: all alike, or each one more than the last."""
    steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:])}  # noqa: B905
    return len(digits) > 3 and (steps == {0} or steps == {1})


def strict_form(kind: str, span: str) -> str:
    """Pattern: the kind's usual written form."""
    if kind == "email":
        return FOR if re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", span) else FOR if "@" not in span else AGAINST
    if kind == "card":
        return FOR if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20-])[0-9]{6}\2[0-9]{5}", span) else AGAINST
    if kind == "phone":
        return FOR if re.fullmatch(r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){2,4}", span) else AGAINST
    if kind == "person":
        return ABSTAIN
    return FOR


def checksum(kind: str, span: str) -> str:
    """Pattern: what the kind's own rule says of the characters."""
    digits = digits_of(span)
    if kind == "card":
        return FOR if 12 <= len(digits) <= 19 and luhn(digits) else AGAINST
    if kind == "ip":
        try:
            return FOR if ipaddress.ip_address(".".join(p.lstrip("0") or "0" for p in span.split(".")) if ":" not in span else span) and len(span) > 6 else AGAINST
        except ValueError:
            return AGAINST
    if kind == "iban":
        plain = span.replace(" ", "")
        return FOR if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else AGAINST
    if kind == "ssn":
        return AGAINST if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else FOR
    if kind == "phone":
        return FOR if 9 <= len(digits) <= 15 else AGAINST
    return ABSTAIN


def gazetteer(kind: str, span: str) -> str:
    """Gazetteer: names, top domains, issuers, calling codes, countries."""
    digits = digits_of(span)
    if kind == "email":
        return FOR if re.split(r"[.\])\x20]+", span)[-1].lower() in TOP_DOMAINS else ABSTAIN
    if kind == "card":
        return FOR if CARD_ISSUERS.match(digits) else AGAINST
    if kind == "phone":
        return ABSTAIN if span[0] != "+" else FOR if any(digits[:n] in CALLING_CODES for n in (1, 2, 3)) else AGAINST
    if kind == "iban":
        return FOR if IBAN_LENGTHS.get(span[:2]) == len(span.replace(" ", "")) else AGAINST
    if kind == "person":
        words = span.lower().split()
        return FOR if words[0] in GIVEN_NAMES or words[0] in TITLES else ABSTAIN
    return ABSTAIN


def placeholder(kind: str, span: str) -> str:
    """Gazetteer: numbers and hosts that stand for none."""
    if kind in ("email", "person"):
        return ABSTAIN
    if kind == "ip":
        return AGAINST if span.startswith(("0.", "127.", "255.")) or span in ("::", "::1") else ABSTAIN
    return AGAINST if same_or_running(digits_of(span)) else ABSTAIN


def cue(kind: str, before: list[str]) -> str:
    """Context: a word of the kind shortly before."""
    return FOR if CUES[kind].intersection(before) else ABSTAIN


def counter_cue(kind: str, before: list[str]) -> str:
    """Context: the words just before name another sort of number."""
    return AGAINST if COUNTER_CUES.intersection(before[-2:]) else ABSTAIN


def edges(text: str, begin: int, end: int) -> str:
    """Context: whether the span stands alone, or letters, digits or joining signs go on from it."""
    left, right = text[begin - 1 : begin], text[end : end + 2]
    joined = left.isalnum() or left in tuple("_/=&#@") or right[:1].isalnum() or right[:1] in tuple("_/=&@") or (right[:1] in ("-", ".") and right[1:].isalnum())
    return AGAINST if joined and (left or right) else FOR


LABELERS = ("strict_form", "checksum", "gazetteer", "placeholder", "cue", "counter_cue", "edges")
#: Shapes of a span that no labeler looks at: length, separators, what stands before and behind.
SHAPES = (4, 3, 3, 3)


def votes_on(text: str, begin: int, end: int, kind: str) -> str:
    span = text[begin:end]
    before = [w.lower() for w in TOKENS.findall(text, max(0, begin - REACH), begin)]
    return strict_form(kind, span) + checksum(kind, span) + gazetteer(kind, span) + placeholder(kind, span) + cue(kind, before) + counter_cue(kind, before) + edges(text, begin, end)


def shape_of(text: str, begin: int, end: int) -> str:
    side = lambda c: 0 if not c or c.isspace() else 1 if not c.isalnum() else 2
    separators = sum(not c.isalnum() for c in text[begin:end])
    return f"{min(3, (end - begin) // 8)}{min(2, separators // 2)}{side(text[begin - 1 : begin])}{side(text[end : end + 1])}"


def candidates(text: str) -> list[tuple[int, int, str, bool, str, str]]:
    """(begin, end, kind, whether a base pattern found it, votes, shape) in order of kind and place.

    Wider candidates lie outside all base spans. Two words that look like a name count only if a labeler votes for them.
    """
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, np.int64)
    begins = [a for a, _ in taken]
    found = [(a, b, k, True) for a, b, k in base]
    seen = {(a, b, k) for a, b, k in base}
    for kind, patterns in WIDER.items():
        if not HINT[kind].search(text):
            continue
        for pattern in patterns:
            for m in pattern.finditer(text):
                a, b = m.span()
                at = int(np.searchsorted(begins, b)) if begins else 0  # base spans that begin before b
                if (at and ends[at - 1] > a) or (a, b, kind) in seen:
                    continue
                seen.add((a, b, kind))
                found.append((a, b, kind, False))
    out = []
    for a, b, kind, is_base in found:
        votes = votes_on(text, a, b, kind)
        if kind != "person" or FOR in votes[:-1]:
            out.append((a, b, kind, is_base, votes, shape_of(text, a, b)))
    return out


# ------------------------------------------------------------------------------------------ aggregation and classifier


@dataclass
class Reliabilities:
    """``given[k, l, y, v]``: probability that labeler l says v of a span of kind k that is (y=1) or isn't (y=0) personal; ``prior`` by kind."""

    given: np.ndarray
    prior: np.ndarray

    def posterior(self, kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
        each = np.log(self.given[kinds[:, None], np.arange(votes.shape[1])[None, :], :, votes]).sum(1)  # patterns x y
        odds = each[:, 1] - each[:, 0] + np.log(self.prior[kinds]) - np.log1p(-self.prior[kinds])
        return 1 / (1 + np.exp(-odds))


#: What is taken for granted of a labeler before it is seen, as counts of (abstain, against, for) among what isn't and what is personal.
TRUST = np.array([[3.0, 6.0, 1.0], [3.0, 1.0, 6.0]])
#: A kind's own checksum fails on what is personal by a slip of the pen alone: this often at most, whatever the counts say.
SLIPS = 0.01


def estimate(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, n_kinds: int = len(KINDS), rounds: int = 200, tolerance: float = 1e-7) -> Reliabilities:
    """Reliabilities of labelers, for each kind its own, from counts of vote patterns by expectation-maximisation (Dawid and Skene, 1979).

    Starts from the majority of votes. ``TRUST`` outweighs few counts and yields to many; a vote for never counts against,
    nor the other way round: where counts say so, both classes get the pooled share. An empty corpus gives even odds.
    """
    p = 1 / (1 + np.exp(-1.5 * ((votes == 2).sum(1) - 2.0 * (votes == 1).sum(1) - 0.5)))
    found = Reliabilities(np.zeros((n_kinds, votes.shape[1], 2, 3)), np.ones(n_kinds) / 2)
    for _ in range(rounds):
        for k in range(n_kinds):
            mine = kinds == k
            yes, no = p[mine] * counts[mine], (1 - p[mine]) * counts[mine]
            given = np.tile(TRUST, (votes.shape[1], 1, 1))
            for v in range(3):
                said = votes[mine] == v
                given[:, 1, v] += (said * yes[:, None]).sum(0)
                given[:, 0, v] += (said * no[:, None]).sum(0)
            total = given.sum(2)
            share, pooled = given / total[:, :, None], given.sum(1) / total.sum(1)[:, None]
            for v, sign in ((1, -1), (2, 1)):
                wrong = sign * (share[:, 1, v] - share[:, 0, v]) < 0
                share[wrong, :, v] = pooled[wrong, v][:, None]
            if votes.shape[1] == len(LABELERS):
                share[LABELERS.index("checksum"), 1, 1] = min(share[LABELERS.index("checksum"), 1, 1], SLIPS)
            found.given[k], found.prior[k] = share / share.sum(2, keepdims=True), (1 + yes.sum()) / (2 + counts[mine].sum())
        new = found.posterior(kinds, votes)
        if not len(new) or np.abs(new - p).max() < tolerance:
            break
        p = new
    return found


def features(kind: str, votes: str, shape: str) -> list[int]:
    """Places of the ones: the kind, each labeler's vote by kind, each shape."""
    at = len(KINDS) + RANK[kind] * len(LABELERS) * len(OUTCOMES)
    out = [RANK[kind], *(at + k * len(OUTCOMES) + OUTCOMES.index(v) for k, v in enumerate(votes))]
    at = len(KINDS) * (1 + len(LABELERS) * len(OUTCOMES))
    for s, n in zip(shape, SHAPES, strict=True):
        out.append(at + int(s))
        at += n
    return out


N_FEATURES = len(KINDS) * (1 + len(OUTCOMES) * len(LABELERS)) + sum(SHAPES)


def train(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic classifier (the last is the intercept) by Newton's steps on probabilistic labels."""
    x = np.zeros((len(rows), N_FEATURES + 1))
    for i, row in enumerate(rows):
        x[i, row] = 1
    x[:, -1] = 1
    w = np.zeros(N_FEATURES + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + ridge * w
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        w = w - step * min(1.0, 3.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


@dataclass
class Classifier:
    weights: np.ndarray

    def probability(self, kind: str, votes: str, shape: str) -> float:
        z = float(self.weights[features(kind, votes, shape)].sum() + self.weights[-1])
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def fit(found: DataFrame, most_patterns: int = 50_000) -> tuple[Reliabilities, Classifier]:
    """Reliabilities from the counts of all vote patterns (at most kinds x 3^labelers), and the classifier.

    The classifier sees each different pair of votes and shape with its count over all candidates as its weight; the
    ``most_patterns`` most frequent of them, if there are more.
    """
    each = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n"))
    counted = materialize(each, "votes")
    by_votes = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    code = lambda rows: np.array([[OUTCOMES.index(v) for v in r["votes"]] for r in rows], np.int64).reshape(len(rows), len(LABELERS))
    kind = lambda rows: np.array([RANK[r["kind"]] for r in rows], np.int64)
    reliabilities = estimate(kind(by_votes), code(by_votes), np.array([r["n"] for r in by_votes], np.float64))
    rows = counted.orderBy(F.desc("n"), "kind", "votes", "shape").limit(most_patterns).collect()
    labels = reliabilities.posterior(kind(rows), code(rows))
    weights = np.array([r["n"] for r in rows], np.float64)
    return reliabilities, Classifier(train([features(r["kind"], r["votes"], r["shape"]) for r in rows], labels, weights * (len(rows) / max(1.0, weights.sum())) + 1))


# -------------------------------------------------------------------------------------------------------------- running

FIELDS = ("begin", "end", "kind", "base", "votes", "shape")
CANDIDATES = "doc_id long, candidates array<struct<begin:int,end:int,kind:string,base:boolean,votes:string,shape:string>>"
SPANS = "doc_id long, spans array<struct<begin:int,end:int,kind:string,base:boolean,probability:double>>"


def all_candidates(docs: DataFrame) -> DataFrame:
    def scan(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "candidates": [[dict(zip(FIELDS, c, strict=True)) for c in candidates(t or "")] for t in batch.column("text").to_pylist()]}

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, CANDIDATES)


def chosen(found: list[dict], probability: Callable[[str, str, str], float], least: float) -> list[dict]:
    """Base spans, and of the others those that are probable enough: of two that overlap the longer, then the more probable, then the first."""
    scored = [{"begin": c["begin"], "end": c["end"], "kind": c["kind"], "base": c["base"], "probability": probability(c["kind"], c["votes"], c["shape"])} for c in found]
    kept, taken = [s for s in scored if s["base"]], []
    for s in sorted((s for s in scored if not s["base"] and s["probability"] >= least), key=lambda s: (s["begin"] - s["end"], -s["probability"], s["begin"], RANK[s["kind"]])):
        at = bisect_left(taken, (s["end"], 0))
        if not at or taken[at - 1][1] <= s["begin"]:
            taken.insert(at, (s["begin"], s["end"]))
            kept.append(s)
    return sorted(kept, key=lambda s: (s["begin"], RANK[s["kind"]], s["end"]))


def find_personal(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, spans) of each row of ``docs``: places in code points, end exclusive, by begin and then kind.

    A null text is an empty one and has no span. Repeated rows are judged one by one and alike; a null doc_id stays null;
    other columns are not read. An empty table gives an empty result. Very long texts are scanned whole, in linear time.
    """
    found = materialize(all_candidates(docs), "candidates")
    _, model = fit(found)

    def decide(batch: pa.RecordBatch) -> dict:
        known: dict[tuple[str, str, str], float] = {}

        def probability(*what: str) -> float:
            if what not in known:
                known[what] = model.probability(*what)
            return known[what]

        return {"doc_id": batch.column("doc_id"), "spans": [chosen(c, probability, least) for c in batch.column("candidates").to_pylist()]}

    arrow = arrow_schema(T.StructType.fromDDL(SPANS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield to_batch(decide(batch), arrow)

    return found.mapInArrow(guarded(run), SPANS)


def mask_personal(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with each span of ``text``, overlaps joined, replaced by the first one's kind in brackets; all rows and columns stay, null texts too."""
    _, model = fit(all_candidates(docs.select(F.lit(None).alias("doc_id"), "text")))

    def masked(text: str | None) -> str | None:
        found = [dict(zip(FIELDS, c, strict=True)) for c in candidates(text or "")]
        out, at = [], 0
        for s in chosen(found, model.probability, least):
            if s["begin"] >= at:
                out += [text[at : s["begin"]], f"[{s['kind']}]"]
            at = max(at, s["end"])
        return "".join(out) + text[at:] if found else text

    def scan(batch: pa.RecordBatch) -> dict:
        return {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array([masked(t) for t in batch.column("text").to_pylist()], pa.string())}

    return map_slices(docs, scan, docs.schema)
