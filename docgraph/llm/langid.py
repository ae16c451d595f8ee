"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a document's bytes as they are, white space included. For evaluation in batches a document is cut into
spans of SPAN bytes; each direction first runs over the LEAD bytes before (after) its span, so that the states at the
span's edge have the neighbouring text behind them, and marks stand where the document ends. Every byte position gets a
probability for each language from its forward and backward states; a document's probabilities are the means over all its
positions. Training is by backpropagation through time with Adam, over windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import bounds, doc_bucket, guarded, map_slices, utf8

EDGE = 256  # stands before and after a document
UNKNOWN = "und"
SPAN, LEAD = 192, 32
ROWS = 1024  # spans that are run side by side


@dataclass
class Model:
    """Weights by direction d (f, b): e<d> (3 hidden, 257) a byte's input to update gate, reset gate and candidate, u<d>
    (3 hidden, hidden) the state's, o<d> (languages, hidden); and bias (languages, 1). Gates are tanh(x) / 2 + 1 / 2."""

    langs: list[str]
    weights: dict[str, np.ndarray]


def step(w: dict, d: str, code: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New states (hidden, rows) after the bytes ``code``, and what backpropagation needs."""
    n = len(h)
    x = np.take(w[f"e{d}"], code, axis=1, mode="clip")
    a = w[f"u{d}"] @ h
    gates = x[: 2 * n]
    gates += a[: 2 * n]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    z, r, c = gates[:n], gates[n:], x[2 * n :]
    c += r * a[2 * n :]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return new, z, r, c, a[2 * n :]


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Over the languages, which are the axis before the last."""
    e = np.exp(logits - logits.max(-2, keepdims=True))
    e /= e.sum(-2, keepdims=True)
    return e


def positions(model: Model, codes: np.ndarray, lead: int = LEAD) -> np.ndarray:
    """(positions, languages, rows) from ``codes`` (lead + positions + lead, rows)."""
    w, n = model.weights, len(codes) - 2 * lead
    logits = np.empty((n, len(model.langs), codes.shape[1]), w["bias"].dtype)
    logits[:] = w["bias"]
    for d, order in (("f", range(lead + n)), ("b", range(len(codes) - 1, lead - 1, -1))):
        h = np.zeros((w[f"u{d}"].shape[1], codes.shape[1]), w["bias"].dtype)
        for t in order:
            h = step(w, d, codes[t], h)[0]
            if lead <= t < lead + n:
                logits[t - lead] += w[f"o{d}"] @ h
    return probabilities(logits)


def loss_and_gradients(model: Model, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean of the cross entropies of all positions of ``codes`` (positions, rows) that are no edge, and its gradients."""
    w, (n, rows) = model.weights, codes.shape
    tape: dict[str, list] = {"f": [None] * n, "b": [None] * n}
    logits = np.zeros((n, len(model.langs), rows), w["bias"].dtype)
    logits += w["bias"]
    for d in "fb":
        h = np.zeros((w[f"u{d}"].shape[1], rows), w["bias"].dtype)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            before = h
            h, *rest = step(w, d, codes[t], h)
            tape[d][t] = (before, h, *rest)
            logits[t] += w[f"o{d}"] @ h
    p = probabilities(logits)
    told = codes != EDGE
    count = max(1, int(told.sum()))
    loss = -float(np.log(np.maximum(p[:, gold, np.arange(rows)], 1e-30))[told].sum()) / count
    p[:, gold, np.arange(rows)] -= 1
    p *= told[:, None, :] / np.asarray(count, p.dtype)
    g = {name: np.zeros_like(v) for name, v in w.items()}
    g["bias"] = p.sum((0, 2))[:, None]
    for d in "fb":
        u, o = w[f"u{d}"], w[f"o{d}"]
        size = u.shape[1]
        dh = np.zeros((size, rows), p.dtype)
        inputs = np.empty((3 * size, n, rows), p.dtype)
        for t in range(n - 1, -1, -1) if d == "f" else range(n):
            h, new, z, r, c, ac = tape[d][t]
            dh += o.T @ p[t]
            g[f"o{d}"] += p[t] @ new.T
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * 2 * z * (1 - z)
            dr = dc * ac * 2 * r * (1 - r)
            inputs[:size, t], inputs[size : 2 * size, t], inputs[2 * size :, t] = dz, dr, dc
            da = np.concatenate([dz, dr, dc * r])
            g[f"u{d}"] += da @ h.T
            dh = dh * z + u.T @ da
        order = np.argsort(codes, axis=None, kind="stable")
        there, first = np.unique(codes.ravel()[order], return_index=True)
        g[f"e{d}"][:, there] = np.add.reduceat(inputs.reshape(3 * size, -1)[:, order], first, axis=1)
    return loss, g


def new_model(langs: list[str], hidden: int, rng: np.random.Generator, dtype: type = np.float32) -> Model:
    w = {"bias": np.zeros((len(langs), 1), dtype)}
    for d in "fb":
        w[f"e{d}"] = rng.normal(0, 0.3, (3 * hidden, EDGE + 1)).astype(dtype)
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(dtype)
        w[f"o{d}"] = rng.normal(0, 0.3, (len(langs), hidden)).astype(dtype)
    return Model(langs, w)


def train(windows: np.ndarray, gold: np.ndarray, langs: list[str], hidden: int = 16, epochs: int = 5, batch: int = 256, least_steps: int = 100, seed: int = 7) -> Model:
    """``windows``: (rows, positions) byte codes; ``gold``: the index of each row's language, the label of all its positions.
    Few windows are gone through more often, for ``least_steps`` steps at least."""
    rng = np.random.default_rng(seed)
    model = new_model(langs, hidden, rng)
    w, done = model.weights, 0
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in w.items()}
    epochs = max(epochs, -(-least_steps * batch // max(1, len(windows))))
    total = max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs if len(windows) else 0):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, g = loss_and_gradients(model, np.ascontiguousarray(windows[rows].T), gold[rows])
            done += 1
            rate = 0.02 * (1 - done / (total + 1)) + 0.0005
            for n, grad in g.items():
                m1, m2 = moments[n]
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                w[n] -= (rate * (m1 / (1 - 0.9**done)) / (np.sqrt(m2 / (1 - 0.999**done)) + 1e-8)).astype(w[n].dtype)
    return model


def buffer(texts: list[str | None], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with ``gap`` edge marks before, between and after them; and where each text's bytes are."""
    raw = [utf8(t) for t in texts]
    edges = bounds(map(len, raw))
    starts = edges[:-1] + gap * np.arange(1, len(raw) + 1)
    out = np.full(int(edges[-1]) + gap * (len(raw) + 1), EDGE, np.uint16)
    data = np.frombuffer(b"".join(raw), np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(starts - edges[:-1], np.diff(edges))] = data
    return out, np.stack([starts, np.diff(edges)])


def windows_of(texts: list[str | None], per_doc: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``per_doc`` windows of ``width`` codes of each text, evenly spaced over all of it; and each window's text."""
    codes, (starts, lengths) = buffer(texts, width)
    rows, owner = [], []
    for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        if n:
            first, last = s - width // 8, max(s - width // 8, s + n - width + width // 8)
            rows += sorted({first + (last - first) * j // max(1, per_doc - 1) for j in range(per_doc)}) if last - first >= width else [first]
            owner += [k] * (len(rows) - len(owner))
    view = np.lib.stride_tricks.sliding_window_view(codes, width)
    return view[np.array(rows, np.int64)] if rows else np.zeros((0, width), np.uint16), np.array(owner, np.int64)


def learnable(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())


def chosen(rows: DataFrame, per_lang: int) -> DataFrame:
    """The first ``per_lang`` different texts of each language by their hash. Only texts whose hash is below a bound, which
    leaves some eight times that many whatever the table's size, are moved, each once: no group meets whole in a task."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    bound = F.lit(0)
    for lang, n in sorted(counts.items()):
        bound = F.when(F.col("lang") == lang, int(min(2**63 - 1, 2**63 * 8 * per_lang / max(1, n)))).otherwise(bound)
    at = F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1))
    few = rows.withColumn("at", at).filter(F.col("at") <= bound).groupBy("lang", "at").agg(F.min("text").alias("text"))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).filter(F.col("rank") <= per_lang).select("lang", "text")


def fit(docs: DataFrame, per_lang: int = 150, per_doc: int = 8, width: int = 64) -> Model:
    """Train on at most ``per_lang`` documents a language and of each at most ``per_doc`` windows of ``width`` bytes, evenly
    spaced over the whole text and cut out in the tasks. These bounds hold for the fit alone; prediction takes whole
    texts. Rows with null text or lang, and languages with the name of the unknown mark, are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = windows_of(b.column("text").to_pylist(), per_doc, width)
            data = pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(owner)), data], names=["lang", "codes"])

    got = sorted((r["lang"], bytes(r["codes"])) for r in chosen(learnable(docs), per_lang).mapInArrow(guarded(cut), "lang string, codes binary").collect())
    langs = sorted({lang for lang, _ in got})
    windows = np.frombuffer(b"".join(c for _, c in got), "<u2").reshape(-1, width)
    place = {lang: k for k, lang in enumerate(langs)}
    gold = np.array([place[lang] for lang, _ in got], np.int64)
    loud = windows[::8].copy()  # an eighth is learnt in capitals too, which are rare else
    loud[(loud >= ord("a")) & (loud <= ord("z"))] -= ord("a") - ord("A")
    return train(np.concatenate([windows, loud]), np.concatenate([gold, gold[::8]]), langs)


def pooled(texts: list[str | None], model: Model) -> np.ndarray:
    """Mean of the position probabilities of each text; zeros for a text without a byte."""
    codes, (starts, lengths) = buffer(texts, SPAN + LEAD)
    n = -(-lengths // SPAN)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[owner] + SPAN * nth
    size = np.minimum(SPAN, lengths[owner] - SPAN * nth)
    view = np.lib.stride_tricks.sliding_window_view(codes, SPAN + 2 * LEAD) if len(owner) else None
    total = np.zeros((len(texts), len(model.langs)))
    order = np.argsort(-size, kind="stable")  # spans of like sizes together, so that short ones cost no full span
    for at in range(0, len(order), ROWS):
        mine = order[at : at + ROWS]
        width = int(size[mine[0]])
        p = positions(model, np.ascontiguousarray(view[begin[mine] - LEAD, : width + 2 * LEAD].T))
        if size[mine[-1]] < width:
            p *= (np.arange(width)[:, None] < size[mine])[:, None, :]
        np.add.at(total, owner[mine], p.sum(0, dtype=np.float64).T)
    return total / np.maximum(lengths, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``lang_score`` (earlier columns of these names are replaced).

    Null text and text without a letter: ``und``, score 0; so are all if nothing was learnt from. Of equal probabilities
    the first language by name is taken. Rows are judged one by one, repeated ones alike; texts of any length are read
    whole, in slices of bounded memory for all but a single longer text; an empty table stays empty.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "lang_score")])
    schema = kept.limit(0).selectExpr("*", "'' AS lang_pred", "0D AS lang_score").schema

    def label(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        p = pooled(texts, model) if model.langs else np.zeros((len(texts), 1))
        ok = np.array([has_letter(t) for t in texts], bool) & bool(model.langs)
        names = [*model.langs, UNKNOWN]
        best = p.argmax(1)
        out = {n: batch.column(n) for n in batch.schema.names}
        out["lang_pred"] = [names[k] if good else UNKNOWN for k, good in zip(best, ok)]
        out["lang_score"] = np.where(ok, np.clip(p.max(1), 0, 1), 0.0)
        return out

    return map_slices(kept, label, schema, limit=4 << 20)


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and whose predicted language has a probability of ``least`` or more."""

    def keep(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        good = np.array([has_letter(t) for t in texts], bool) & (pooled(texts, model).max(1) >= least)
        kept = batch.filter(pa.array(good))
        return {n: kept.column(n) for n in kept.schema.names}

    return map_slices(docs, keep, docs.schema, limit=4 << 20)


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.filter(doc_bucket(F.col("doc_id"), 3) != 1)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the training rows and label every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = predict(rows, fit(training_rows(docs)))
    return out.select("doc_id", (doc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
