"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join (after Li et al., 2011).

Each word is cut into two segments whose places depend on its length alone. One edit leaves one of the two segments whole,
and by the same argument one half of what is left beside it. So a word is indexed under its length, a whole segment and a
whole half of the other, and a word of equal length or one longer probes with its substrings at the places, shifted by one
where a letter came in before them. A key spells three quarters of a word, so even a frequent ending makes no large group.
Candidates that meet are verified by their edit distance and deduplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import drop_scratch, materialize

#: Maximal runs of letters; only those of six code points and more can become words.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT, DROPPED_OF, TIMES = 6, 5, 199, 5


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct words of the texts with how often they occur. A null text has none; a null doc_id counts as empty."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{LEAST_CHARS},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.withColumn("h", h).select(F.when(F.col("h") % DROPPED_OF == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def _key(length: Column, where: str, *pieces: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), F.lit(where), *pieces)


def _keys(word: Column, length: Column, shift: int) -> Column:
    """Keys of ``word`` for indexed words of ``length``: its own, or, with ``shift`` 1, those of the words one shorter.

    a and b are where the first segment's halves end; the second segment is halved at c. Behind an inserted letter places move by one.
    """
    cut = lambda begin, end: F.substring(word, (begin + 1).cast("int"), (end - begin).cast("int"))
    zero, b = F.lit(0), F.floor(length / 2)
    a, c = F.floor(b / 2), b + F.floor((length - b) / 2)
    head, tail = cut(zero, b), cut(b + shift, length + shift)
    return F.array(
        _key(length, "h1", head, cut(b, c)), _key(length, "h2", head, cut(c + shift, length + shift)),
        _key(length, "t1", tail, cut(zero, a)), _key(length, "t2", tail, cut(a + shift, b + shift)),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n) that are exactly one insertion, deletion or replacement apart, once."""
    size = F.length("word")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(F.col("word"), size, 0)).alias("key"))
    both = F.concat(_keys(F.col("word"), size, 0), _keys(F.col("word"), size - 1, 1))
    probe = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(both).alias("key"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = index.join(probe, "key").filter(once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that following forms comes to. A form occurs more often than its word, so none comes back.

    Each round doubles how far ``root`` reaches, so a chain of d forms takes log2(d) rounds, each a written table.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_scratch(now)
        if not new.filter("moved").limit(1).count():
            return new.drop("moved")
        now = new.drop("moved")


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """One row a word: form (its near word with the largest count, if that is ``times`` its own or more), root, n, n_near, form_n.

    Ties of count go to the word that is smaller in code-point order. Texts that are null, empty or without a long run give no
    word, an empty table no row; repeated rows count again, and columns other than doc_id and text are not read. Very long
    texts are split where they are read; their words are counted before they are shuffled.
    """
    words = materialize(counted_words(docs), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    near = materialize(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best")).alias("best")), "variants")
    drop_scratch(pairs, words)
    out = near.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n"))
    roots = with_roots(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
