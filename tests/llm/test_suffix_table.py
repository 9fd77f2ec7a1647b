import pytest

from lodeseek.llm import suffix_tree

from .test_texts import corpus, plain_tree


@pytest.mark.parametrize(("head", "heavy", "home"), [(32, 20, 700), (32, 10**6, 10**6), (1 << 18, 100, 300), (4, 2, 500)])
def test_no_context_is_left_out_of_a_large_tree(spark, monkeypatch, head, heavy, home):
    """Words outside the head, rare contexts and rare next words count; frequent sequences, dealt to several tasks, as well."""
    monkeypatch.setattr(suffix_tree, "HEAD", head)
    for name, value in (("WHOLE", 0), ("HEAVY", heavy), ("HOME", home)):
        monkeypatch.setattr(suffix_tree, name, value, raising=False)
    rows = corpus() + [(i, text) for i in range(160, 180) for text in ["twice seen words lie here the quick brown fox", None, "", "the"][i % 4 :][:1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [(i, t) for i, t in rows if i % 2 or i > 160]
    tree, counts = suffix_tree.learn(docs.where("doc_id % 2 = 1 OR doc_id > 160").select("text"))
    kept, score = plain_tree(train, suffix_tree.DEPTH, suffix_tree.DISCOUNT)
    assert {len(g) for g in kept} == {1, 2, 3}
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, tree, counts).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        assert abs(got[i] - score([*suffix_tree.words(t or ""), b""])) < 1e-6
