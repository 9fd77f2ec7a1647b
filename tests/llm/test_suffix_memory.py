from pyspark.sql import functions as F

from lodeseek.llm import suffix_tree

from .test_texts import corpus


def test_a_large_tree_writes_no_row_for_each_sequence(spark, monkeypatch):
    """Texts and words are written, also of heavy contexts what follows them; sequences that occur twice are many more."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = set()
    for _, t in rows:
        ws = [*suffix_tree.words(t or ""), b""]
        seen |= set(ws)
    written = {}

    def counted(df, label, f=suffix_tree.materialise):
        out = f(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(suffix_tree, "materialise", counted)
    for name, value in (("WHOLE", 0), ("HEAVY", 10**6), ("HOME", 700)):
        monkeypatch.setattr(suffix_tree, name, value)
    tree, found = suffix_tree.learn_and_score(docs, F.col("doc_id") % 2 == 1)
    assert found.count() == len(rows) and not tree.whole
    assert written and max(written.values()) <= max(len(rows), len(seen)), written


def test_what_follows_heavy_contexts_grows_with_the_input(spark, monkeypatch):
    """Five times the texts: not many times the rows, as more contexts must be as frequent to be heavy."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=60)) for _ in range(500)]
    made = []
    for name, value in (("WHOLE", 0), ("HOME", 2000), ("SPAN", 20)):
        monkeypatch.setattr(suffix_tree, name, value)
    real = suffix_tree._heavy_values

    def seen(texts, tree, heavy, tables, homes):
        made.append(sum(t.count() for t in tables))
        return real(texts, tree, heavy, tables, homes)

    monkeypatch.setattr(suffix_tree, "_heavy_values", seen)
    for part in (texts[:100], texts):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(part)], "doc_id long, text string")
        _, found = suffix_tree.learn_and_score(docs, F.lit(True))
        assert found.count() == len(part)
    assert 0 < made[1] <= 12 * made[0], made
