import pytest
from pyspark.sql import functions as F

from lodeseek.llm import nbsvm


@pytest.mark.parametrize("most", [0, 3, 40, 700, 10_000])
def test_sample_is_the_lowest_hashes(spark, monkeypatch, most):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(nbsvm, "SAMPLE", most)
    monkeypatch.setattr(nbsvm, "fit", lambda rows, y: seen.append((len(rows), y.tolist())))
    nbsvm.train(docs, labels)
    usable = labels.where(nbsvm.fold() != 0).select("doc_id", "quality", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")).collect()
    lowest = sorted(usable, key=lambda r: (r["h"], r["doc_id"]))[:most]
    assert seen == [(min(most, len(usable)), [1 if r["quality"] == 1 else -1 for r in lowest])]
