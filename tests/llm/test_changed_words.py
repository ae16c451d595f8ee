from __future__ import annotations

import random

import numpy as np

from docgraph.llm import decontaminate


def share(item: str, text: str) -> float:
    a, b = item.split(), text.split()
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1] / len(a)


def test_items_with_changed_names_and_numbers(spark) -> None:  # noqa: ANN001
    """Items of 40 words, 37 of them common: a copy in which all but one of the rarer words, or all, are changed is a leak."""
    rng = random.Random(4)
    common = [f"c{k}" for k in range(30)]
    text = lambda n: [rng.choice(common) for _ in range(n)]
    items, docs, want = [], [], set()
    for k in range(40):
        words = text(40)
        for at, name in zip((6, 19, 33), "abc"):
            words[at] = f"{name}{k}"
        items.append((k, " ".join(words)))
        for changed in (2, 3):
            copy = list(words)
            for at in (6, 19, 33)[:changed]:
                copy[at] = f"other{k}"
            docs.append((2 * k + changed - 2, " ".join([*text(50), *copy, *text(50)])))
            assert share(items[-1][1], " ".join(copy)) >= 0.9
            want.add((docs[-1][0], k))
    docs += [(1000 + k, " ".join(text(140))) for k in range(200)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got >= want
    texts, of = dict(docs), dict(items)
    assert all(share(of[i], texts[d]) >= decontaminate.ANSWERED_SHARE for d, i in got)
    assert not {d for d, _ in got} & {d for d, _ in docs if d >= 1000}


def test_the_space_is_fitted_to_the_blocks_of_all_documents(spark, monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)] + [f"x{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(120)))) for k in range(50)] + [(0, "w1 w1 w2 w1"), (0, "w1 w1 w2 w1"), (None, None), (7, "")]
    index = decontaminate.make_index([(1, " ".join(words[:20])), (2, " ".join(words[15:30]))])
    n = len(index.vocabulary)
    index.idf = np.array([rng.choice([0, 1.5, 2.0]) for _ in range(n)], np.float32)
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = decontaminate.pair_counts(table.repartition(5), index)
    want = np.zeros((n, n))
    for _, text in docs:
        ids = [index.vocabulary.get(w.encode(), -1) for w in (text or "").split()]
        for at in range(0, len(ids), decontaminate.HALF):
            x = np.zeros(n)
            for i in ids[at : at + decontaminate.HALF]:
                if i >= 0:
                    x[i] += index.idf[i]
            want += np.outer(x, x)
    assert np.allclose(decontaminate.gram_product(pairs, index, np.eye(n)), want)
