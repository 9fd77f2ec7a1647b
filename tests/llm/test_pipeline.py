from collections import Counter

import corpus_pipeline as cp
from lodeseek.llm import exact_dedup, nbsvm, substring_dedup


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = nbsvm.train(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i: t for i, t in rows.items() if model.score(t) >= nbsvm.THRESHOLD}
    stage = cp.quality(spark, docs, sf_dir)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(good)
    last = {}
    for i in sorted(good):
        last["".join(c.lower() if c.isascii() else c for c in good[i])] = i
    once = {i: good[i] for i in last.values()}
    stage = cp.exact(spark, docs.where(docs["doc_id"].isin(list(good))), sf_dir)
    assert {r["doc_id"] for r in stage.collect()} == set(once)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in once.items() for w in ["".join(c.lower() if c.isascii() else c for c in t).split()]}
    root = {i: i for i in sets}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(5):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    kept = {i for i in sets if root[i] == i}
    stage = cp.near(spark, docs.where(docs["doc_id"].isin(list(once))), sf_dir)
    got = {r["doc_id"] for r in stage.collect()}
    assert kept <= got and len(got - kept) <= max(1, 0.1 * (len(once) - len(kept)))  # candidates meet with a chance
    kept = got
    stage = cp.passages(spark, docs.where(docs["doc_id"].isin(list(kept))), sf_dir)
    assert stage.columns == docs.columns and stage.count() == len(kept)
    long = Counter(u for r in stage.collect() for u in {line.lower() for line in r["text"].split("\n") if len(line.split()) >= 50})
    assert not long or max(long.values()) == 1


def test_run(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality", "exact", "near", "passages", "pack"]
    assert exact_dedup and substring_dedup
