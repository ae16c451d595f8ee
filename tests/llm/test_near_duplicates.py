from __future__ import annotations

import random

import corpus_pipeline


def kept(spark, texts: dict[int, str]) -> set[int]:  # noqa: ANN001
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}


def test_a_shared_repeated_line_makes_no_copy(spark) -> None:  # noqa: ANN001
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(12))
    texts = {d: " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(150)), *[line] * 20]) for d in range(20)}
    assert kept(spark, texts) == set(texts)


def test_the_exact_similarity_decides(spark) -> None:  # noqa: ANN001
    """Pairs of 100 shingles each of which k are shared: similarity k / (200 - k), 0.8 at 89."""
    rng = random.Random(7)
    texts, alike = {}, {}
    for pair in range(300):
        shared = (84, 86, 88, 89, 90, 92)[pair % 6]
        words = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        texts[2 * pair] = " ".join(words)
        texts[2 * pair + 1] = " ".join(words[: shared + 4] + [f"v{rng.randrange(10**9)}" for _ in range(100 - shared)])
        alike[pair] = shared / (200 - shared) >= corpus_pipeline.SIMILARITY
    got = kept(spark, texts)
    one = {p for p in alike if len({2 * p, 2 * p + 1} & got) == 1}
    assert one <= {p for p, same in alike.items() if same}
    assert len(one) >= 0.99 * sum(alike.values())


def test_crowds_of_texts_that_are_almost_similar(spark) -> None:  # noqa: ANN001
    """Hundreds of variants of short texts, most pairs of which share bands and are not similar: candidates stay few, and the
    groups are those of all pairs."""
    from docgraph.llm import near_copies as nc

    rng = random.Random(9)
    base = [f"b{k}" for k in range(34)]
    texts = {}
    for d in range(700):
        words = list(base)
        for at in rng.sample(range(34), 1 if d % 3 else 2):
            words[at] = f"x{rng.randrange(40)}"
        texts[d] = " ".join(words)
    sets = {d: set(nc.shingle_set(t, 5).tolist()) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    similar = 0
    for a in texts:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                similar += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = nc.prefixes(docs.selectExpr("doc_id AS id"), docs, 5, 0.8)
    pairs = {(r.u, r.v) for r in nc.prefix_pairs(first.selectExpr("*", "id AS part"), 0.8).collect()}
    want = {(b, a) for a in texts for b in range(a) if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want <= pairs and len(pairs) < 30 * len(texts)
    assert similar and sorted(find(d) for d in kept(spark, texts)) == sorted(d for d in texts if find(d) == d)  # one of each group
