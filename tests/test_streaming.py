from pyspark.sql import functions as F

from lodeseek.engine import SearchEngine
from lodeseek.streaming.ingest import ingest

SPEC = {"name": "live", "fields": [{"name": "id", "type": "Edm.String", "key": True}, {"name": "title", "type": "Edm.String", "searchable": True}, {"name": "n", "type": "Edm.Int64", "filterable": True}]}


def test_batches_of_actions(spark, tmp_path):
    e = SearchEngine(spark)
    e.create_index(SPEC)
    source = str(tmp_path / "in")
    steps = [[("1", "a", 1, "upload", 1), ("2", "b", 2, "upload", 2)], [("1", None, 5, "merge", 3), ("2", None, None, "delete", 4), ("3", "c", 3, "upload", 5), ("3", "d", None, "merge", 6)]]
    schema = "id string, title string, n long, __action string, at long"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = ingest(e, "live", stream, "at", str(tmp_path / "store"), str(tmp_path / "check"))
    assert q.awaitTermination(90)
    got = {r["id"]: (r["title"], r["n"]) for r in e.documents("live").collect()}
    assert got == {"1": ("a", 5), "3": ("d", 3)}
    assert [r["id"] for r in e.search("live", {"search": "d"}).hits.select(F.col("id")).collect()] == ["3"]
