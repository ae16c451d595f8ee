"""Quality rules: repetition coverage of documents by rolling hashes of several n-gram lengths.

For each length n, a word is covered when it lies in an n-gram that occurs twice or more in its document; the
measure is the share of word characters that are covered. Lines are measured alike. Hashes are 64 bits wide,
rolled in numpy over a slice of documents at once, and sorted per document, so no pair of n-grams is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import bounds, map_slices, mix64, rolling, split_words, sums, utf8, word_hashes

SYMBOLS = b"#*$%&|<>"
#: Most of the word characters that may be covered by repeated n-grams, by n; of lines, and of symbols for each word.
MAX_COVERED = {3: 0.50, 5: 0.25, 10: 0.15}
MAX_DUP_LINE_CHARS = 0.20
MAX_SYMBOLS_PER_WORD = 0.30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_chars long, " + ", ".join(f"covered_chars_{n} long" for n in MAX_COVERED)
)


def covered_words(hashes: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """Of all words of a slice: whether each lies in an n-gram that its document holds twice or more."""
    out = np.zeros(len(hashes) + 1, np.int64)
    grams = rolling(hashes, n)
    if not len(grams):
        return out[:0].astype(bool) if not len(hashes) else np.zeros(len(hashes), bool)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :])  # windows that do not cross documents
    keys = grams[inside] ^ mix64(doc[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = inside[twice]
    np.add.at(out, at, 1)
    np.add.at(out, at + n, -1)
    return np.cumsum(out)[:-1] > 0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The measures of each text, without the verdicts."""
    words = split_words(texts)
    edges = bounds(map(len, words))
    flat = [w for ws in words for w in ws]
    hashes = word_hashes().of(flat)
    joined = np.frombuffer(b"".join(flat), np.uint8)
    byte_edges = bounds(map(len, flat))
    chars = sums((joined & 0xC0) != 0x80, byte_edges)  # code points of each word
    covered = {n: covered_words(hashes, edges, n) for n in {3, *MAX_COVERED}}
    out = {"n_words": np.diff(edges), "word_chars": sums(chars, edges), "n_repeat_words": sums(covered[3].astype(np.int64), edges)}
    symbols, dup_lines, dup_chars = [], [], []
    for text in texts:
        raw = utf8(text)
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        seen: set[bytes] = set()
        lines = again = 0
        for line in raw.split(b"\n"):
            if line.strip():
                if line in seen:
                    lines += 1
                    again += len(b"".join(line.split()).decode("utf-8"))
                else:
                    seen.add(line)
        dup_lines.append(lines)
        dup_chars.append(again)
    out |= {"n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup_lines, np.int64), "dup_line_chars": np.array(dup_chars, np.int64)}
    for n in MAX_COVERED:
        out[f"covered_chars_{n}"] = sums(np.where(covered[n], chars, 0), edges)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    kept = ~base_failed & (m["dup_line_chars"] <= MAX_DUP_LINE_CHARS * m["word_chars"])
    kept &= m["n_symbols"] <= MAX_SYMBOLS_PER_WORD * m["n_words"]
    for n, most in MAX_COVERED.items():
        kept &= m[f"covered_chars_{n}"] <= most * m["word_chars"]
    return base_failed, kept


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``; rows are judged one by one, repeated rows alike.

    Null and blank texts have no words: counts are 0, base_failed is true, kept is false. A null doc_id stays null.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """

    def judge(batch: pa.RecordBatch) -> dict:
        m = measure(batch.column("text").to_pylist())
        base_failed, kept = verdicts(m)
        return m | {"doc_id": batch.column("doc_id"), "base_failed": base_failed, "kept": kept}

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), judge, SCHEMA)
