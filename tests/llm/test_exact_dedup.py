import hashlib
from collections import defaultdict

import pytest

from lodeseek.llm import exact_dedup as ed

from .conftest import ROWS


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_mark_is_right(odd, clashing):
    groups = defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append(r[0])
    for docs in (odd, clashing):
        got = ed.mark(docs).collect()
        assert len(got) == len(ROWS)
        by = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by[bytes(r["digest"])]
            assert r["keep_id"] == max(i for i in ids if i is not None) and r["group_size"] == len(ids)
        assert sum(r["kept"] for r in got) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_dedup_keeps_columns_and_one_of_each(odd, clashing, none):
    for docs in (odd, clashing):
        got = ed.dedup(docs)
        assert got.columns == docs.columns
        assert sorted(norm(r["text"]) for r in got.collect()) == sorted({norm(r[1]) for r in ROWS})
    assert ed.dedup(none).collect() == [] and ed.mark(none).collect() == []


def test_later_batches_meet_the_index(spark, odd):
    index = ed.DigestIndex(spark, buckets=4)
    assert len(ed.dedup(odd.where("doc_id <= 4"), index).collect()) == 2
    later = {r["doc_id"] for r in ed.dedup(odd, index).collect()}
    assert later == {5, 6, 7, 8, 9, 10}
    again = ed.DigestIndex(spark, index.path, buckets=4)
    assert again.read().count() == index.read().count() == 8
    assert ed.dedup(odd, again).count() == 0


def test_hot_text(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('t', id) END AS text")
    got = ed.mark(docs)
    assert got.where("kept").count() == 20_000 - 6667 + 1
    assert got.where("kept AND group_size > 1").collect()[0]["doc_id"] == 19_998


def test_an_index_keeps_its_buckets(spark, odd, tmp_path):
    path, size = f"file://{tmp_path}/index", spark.conf.get("spark.sql.shuffle.partitions")
    first = ed.DigestIndex(spark, path, buckets=3)
    assert ed.dedup(odd, first).count() == 8
    first.close()
    try:
        for n in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            again = ed.DigestIndex(spark, path)
            assert again.buckets == 3 and ed.dedup(odd, again).count() == 0 and again.read().count() == 8
            again.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", size)
    with pytest.raises(ValueError):
        ed.DigestIndex(spark, path, buckets=4)
    odd.select("text").write.parquet(f"file://{tmp_path}/other")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_") and t.name == first.name]


def test_names_of_indexes_go(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    marked, kept = ed.mark(odd), ed.dedup(odd)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert marked.count() == len(ROWS) and kept.count() == 8


def test_a_named_batch_runs_again(spark, odd):
    """A job that fails between the index and its rows finds the same rows on its retry, and so does a batch before a later one."""
    index = ed.DigestIndex(spark, buckets=3)
    rows = lambda df: sorted(r["doc_id"] for r in df.collect())
    first, rest = odd.where("doc_id <= 5"), odd.where("doc_id > 3")
    with pytest.raises(ZeroDivisionError):
        ed.dedup(first, index, "2024-05-01")
        1 / 0  # noqa: B018
    kept = rows(ed.dedup(first, index, "2024-05-01"))
    assert kept == [2, 4, 5] and rows(ed.dedup(first, index, "2024-05-01")) == kept
    later = rows(ed.dedup(rest, index, "2024-05-02"))
    assert later == [6, 7, 8, 9, 10] and rows(ed.dedup(first, index, "2024-05-01")) == kept and rows(ed.dedup(rest, index, "2024-05-02")) == later
    marked = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in ed.mark(rest, index, "2024-05-02").collect()}
    assert marked[4] == (4, False) and marked[7] == (7, True)
    assert index.read().count() == len(kept + later) == index.read().select("digest").distinct().count()
    # other rows under the same name take the place of the first ones
    assert rows(ed.dedup(odd.where("doc_id = 7"), index, "2024-05-02")) == [7] and index.read().count() == len(kept) + 1
    assert rows(ed.dedup(odd.where("doc_id = 9"), index)) == [9]
    again = ed.DigestIndex(spark, index.path)
    assert rows(ed.dedup(first, again, "2024-05-01")) == kept and again.read().where("batch LIKE '2024-05-01@%'").count() == 3
    with pytest.raises(ValueError):
        ed.dedup(first, index, "a/b")
