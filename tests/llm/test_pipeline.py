from __future__ import annotations

import shutil

import pytest

import corpus_pipeline
from docgraph.llm import secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):  # noqa: ANN001, ANN201
    """A folder with some documents, odd ones among them, and the benchmark."""
    d = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 90 OR doc_id = 1")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    base = docs.filter("n_chars > 1500").orderBy("doc_id").first()
    near = base.text.replace(base.text.split()[20], "changed")
    more = [(1001, base.text, base.lang, "x", len(base.text)), (1002, near, base.lang, "x", len(near)), (1003, f"{base.text[:40]} {item}", "en", "x", 10), (1004, None, None, None, None), (1005, "12345 !!", "en", "x", 8), (None, base.text[:700] + " password = hunter2222", base.lang, "x", 1)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(3).write.parquet(f"{d}/documents.parquet")
    shutil.copy(f"{SF}/benchmark.parquet", d)
    return str(d), base


def shingles(text: str | None) -> set:
    w = brute.WORD.findall(brute.lower_ascii(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline_equals_brute_force(spark, small) -> None:  # noqa: ANN001
    d, base = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, d).collect() or [], docs.schema) if name != "packing" else stage(spark, docs, d)
        assert name == "packing" or docs.columns == columns
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["start"] - ids["language_id"] == {1004, 1005}
    kept = seen["near_duplicates"]
    sets = [shingles(r.text) for r in kept]
    share = lambda a, b: len(a & b) / len(a | b)
    assert all(share(sets[i], sets[j]) < corpus_pipeline.SIMILARITY for i in range(len(kept)) for j in range(i))
    texts = [shingles(r.text) for r in seen["language_id"]]
    gone = [r for r in seen["language_id"] if r.doc_id not in ids["near_duplicates"]]
    assert all(sum(share(shingles(r.text), s) >= corpus_pipeline.SIMILARITY for s in texts) > 1 for r in gone)
    assert len({base.doc_id, 1001, 1002} & ids["near_duplicates"]) == 1
    items = [[w.strip(".,;:!?\"'()").lower() for w in r.text.split()] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    held = lambda t: any(" ".join(i) in " ".join(w.strip(".,;:!?\"'()").lower() for w in (t or "").split()) for i in items)
    assert {r.doc_id for r in kept if held(r.text)} == ids["near_duplicates"] - ids["decontamination"]
    assert 1003 not in ids["decontamination"]
    before = {(r.doc_id, secrets.mask(r.text)) for r in seen["decontamination"]}
    assert {(r.doc_id, r.text) for r in seen["secret_scan"]} == before and not any("hunter2222" in (r.text or "") for r in seen["secret_scan"])
    assert all(r.n_chars == len(r.text) for r in seen["secret_scan"])
    assert {r.doc_id for r in seen["packing"]} == ids["secret_scan"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in seen["packing"]), key=str)


def test_stages_on_an_empty_table(spark, small) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small[0]).count() == 0
