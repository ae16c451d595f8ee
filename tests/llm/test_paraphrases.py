from __future__ import annotations

import random

from docgraph.llm import decontaminate


def changed(rng: random.Random, words: list[str], rate: float) -> list[str]:
    """Each word replaced, dropped or followed by another with probability ``rate`` in all."""
    out = []
    for w in words:
        kind = rng.random()
        if kind < rate / 3:
            continue
        out.append(f"new{rng.randrange(10**6)}" if kind < 2 * rate / 3 else w)
        if 2 * rate / 3 <= kind < rate:
            out.append(f"put{rng.randrange(10**6)}")
    return out


def test_recall_of_paraphrases_at_several_rates(spark) -> None:  # noqa: ANN001
    """300 items, each in one document among others; of those that hold FULL_SHARE of their words in order, 0.9 are found at every rate."""
    rng = random.Random(12)
    common = [f"c{k}" for k in range(40)]
    rare = lambda: f"r{int(rng.paretovariate(0.6)) % 5000}"
    item = lambda: [rng.choice(common) if rng.random() < 0.5 else rare() for _ in range(rng.randrange(18, 60))]
    items = [(k, item()) for k in range(300)]
    docs, must = [], {}
    for k, words in items:
        rate = (0.0, 0.1, 0.2, 0.3, 0.4)[k % 5]
        copy = changed(rng, words, rate)
        around = [[rng.choice(common) if rng.random() < 0.6 else rare() for _ in range(rng.randrange(20, 200))] for _ in range(2)]
        docs.append((k, " ".join([*around[0], *copy, *around[1]])))
        ids = {w: n for n, w in enumerate(dict.fromkeys(words + copy))}
        share = decontaminate.lcs([ids[w] for w in words], [ids[w] for w in copy]) / len(words)
        if share >= decontaminate.FULL_SHARE:
            must.setdefault(rate, []).append(k)
    docs += [(1000 + k, " ".join(rng.choice(common) if rng.random() < 0.6 else rare() for _ in range(200))) for k in range(300)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    got = {r.doc_id for r in found if r.doc_id == r.item_id}
    recall = {rate: sum(k in got for k in ks) / len(ks) for rate, ks in must.items()}
    print("recall by share of changed words", recall, {rate: len(ks) for rate, ks in must.items()})
    assert min(recall.values()) >= 0.9 and len(must) == 5
    assert not [r for r in found if r.doc_id >= 1000]
    twice = decontaminate.find_leaks(spark.createDataFrame([docs[0], docs[0], (None, None)], "doc_id long, text string"), spark.createDataFrame([(0, " ".join(items[0][1]))], "item_id long, text string"))
    assert [r.doc_id for r in twice.collect()] == [0, 0]
