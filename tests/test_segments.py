"""Segments, the log of actions over an index, and the text index that batches keep up to date."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.engine import SearchEngine
from lodeseek.plans import bm25, query_text
from lodeseek.plans.postings import TextIndex
from lodeseek.sources import segments
from lodeseek.sources.segments import Segments, Table

NOTES = {
    "name": "notes",
    "fields": [{"name": "no", "type": "Edm.Int64", "key": True}, {"name": "body", "type": "Edm.String", "searchable": True, "analyzer": "latin"}, {"name": "tags", "type": "Collection(Edm.String)", "searchable": True, "analyzer": "keyword"}, {"name": "stars", "type": "Edm.Double", "filterable": True}],
}
WORDS = "amber birch cedar dusk ember flint grove heath inlet jetty knoll lodge moor nook oxbow pond quay reed silt tern".split()


def note(i):
    return {"no": i, "body": " ".join(WORDS[(i * k + k) % 20] for k in range(1, 3 + i % 40)), "tags": [f"t{i % 3}"], "stars": float(i)}


def make(spark, n=60):
    e = SearchEngine(spark)
    e.create_index(NOTES)
    e.index_documents("notes", [note(i) for i in range(n)])
    return e


def relations(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("Relation")


def hits(e, request):
    return [(r["no"], round(r["@search.score"], 9)) for r in e.search("notes", request).hits.collect()]


def test_batches_keep_a_plan_of_constant_size_and_scores_of_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    e = make(spark)
    text = e.index_text("notes")
    state, sizes = {i: note(i) for i in range(60)}, set()
    for k in range(6):
        got = e.index_documents("notes", [{"@search.action": "merge", "no": k, "body": f"flint new{k} reed"}, {"@search.action": "delete", "no": 20 + k}, {"no": 100 + k % 4, "body": f"pond again{k} pond"}, {"@search.action": "delete", "no": 999}])
        assert [r["status"] for r in got.orderBy("__seq").collect()] == [200, 200, 201, 404]
        state[k]["body"] = f"flint new{k} reed"
        state.pop(20 + k)
        state[100 + k % 4] = {"no": 100 + k % 4, "body": f"pond again{k} pond", "tags": None, "stars": None}
        sizes.add(relations(e.documents("notes")))
        assert len(e.stores["notes"].segments) <= 2 * segments.FAN and len(text.held.segments) <= 2 * segments.FAN
    assert max(sizes) <= 4
    assert {r["no"]: (r["body"], r["tags"], r["stars"]) for r in e.documents("notes").collect()} == {k: (v["body"], v["tags"], v["stars"]) for k, v in state.items()}
    plain = SearchEngine(spark)
    plain.create_index(NOTES, e.data["notes"])
    for q in ("pond", "flint -reed", '"flint new3"', "again*", "embre~1", "/aga[i]n1?/", "body:[t TO u]", "tags:t1 OR new2"):
        assert hits(e, {"search": q, "queryType": "full"}) == hits(plain, {"search": q, "queryType": "full"}), q
    fresh = plain.index_text("notes")
    assert text.totals() == fresh.totals()
    rows = lambda t: sorted(map(tuple, t.terms().collect()))
    assert rows(text) == rows(fresh)


def test_a_batch_writes_its_own_postings_and_reads_no_other_documents(spark):
    e = make(spark)
    text = e.index_text("notes")
    before = {s.id for s in text.held.segments}
    e.index_documents("notes", [{"no": 7, "body": "amber amber dusk"}])
    (own,) = [s for s in text.held.segments if s.id not in before]
    written = spark.read.parquet(f"{text.held.path}/postings/{segments.SEGMENT}={own.id}")
    assert sorted((r["term"], r["__key"], r["times"], r["positions"]) for r in written.collect()) == [("amber", "7", 2, [0, 1]), ("dusk", "7", 1, [2])]
    less = spark.read.parquet(f"{text.held.path}/terms/{segments.SEGMENT}={own.id}").where("documents < 0")
    assert {r["term"] for r in less.collect()} == {*note(7)["body"].split(), "t1"} - {"amber", "dusk"}
    # the batch's keys are named in the scans of stored documents
    held = e._named(e.stores["notes"], spark.createDataFrame([(7,)], "no long"), e.resolve("notes"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(__hash," in plan and "(no,7)" in plan.replace("EqualTo(no,7)", "(no,7)").replace("In(no, [7])", "(no,7)")


def test_a_store_is_opened_again_and_numbered_batches_run_twice(spark, tmp_path):
    e = make(spark, 10)
    e.store("notes", f"file://{tmp_path}/docs")
    e.index_text("notes", f"file://{tmp_path}/text")
    batch = [{"no": 3, "body": "quay"}, {"@search.action": "delete", "no": 4}]
    from lodeseek.operators import mutate

    shape = T.StructType([T.StructField(f.name, f.dataType) for f in e.resolve("notes").schema()]).add("__action", "string").add("__seq", "long").add("__given", T.ArrayType(T.StringType())).add("__why", "string")
    for number in (0, 1, 1):  # the last one runs again
        for held in (e.stores["notes"], e.texts["notes"].held):
            held.before(number)
        e.apply_batch("notes", spark.createDataFrame(mutate.rows(e.resolve("notes"), batch if number else [{"no": 50, "body": "quay quay"}]), shape), number).collect()
    again = SearchEngine(spark)
    again.create_index(NOTES)
    assert again.store("notes", f"file://{tmp_path}/docs").batch == 1 and again.count("notes").first()[0] == 10
    text = again.index_text("notes", f"file://{tmp_path}/text")
    assert text.totals()[0] == 10 and sorted(n for n, _ in hits(again, {"search": "quay"})) == sorted({3, 50} | {i for i in range(10) if i != 4 and "quay" in note(i)["body"].split()})
    again.stores["notes"].vacuum()
    text.held.vacuum()
    assert again.count("notes").first()[0] == 10 and text.totals()[0] == 10
    again.stores["notes"].before(1)  # the last batch can run again, an earlier one can't
    assert again.stores["notes"].rows() == 11
    for impossible in (lambda: again.stores["notes"].open(0), lambda: again.stores["notes"].before(0)):
        with pytest.raises(ValueError):
            impossible()


def test_merging_keeps_what_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    held = Segments(spark, f"file://{tmp_path}/s", {"kv": Table(T.StructType().add("__key", "string").add("v", "long"), ("__key",)), "n": Table(T.StructType().add("g", "long").add("n", "long"), ("g",), ("n",))})
    state = {}
    for k in range(14):
        new = {f"k{(k * j) % 11}": 100 * k + j for j in range(1, 3)}
        gone = [x for x in new if x in state] + ([next(iter(state))] if k % 4 == 3 else [])
        state = {x: v for x, v in state.items() if x not in gone} | new
        rows = spark.createDataFrame(list(new.items()), "__key string, v long")
        held.append({"kv": rows, "n": spark.createDataFrame([(k % 2, 1), (7, -1), (7, 1)], "g long, n long")}, spark.createDataFrame([(x,) for x in gone], "__key string"), len(new), len(gone), {"x": 1})
        held.tidy()
        assert {r["__key"]: r["v"] for r in held.read("kv").collect()} == state
        assert dict(held.read("n").where("g < 7").groupBy("g").agg(F.sum("n")).collect()) == ({0: k // 2 + 1} | ({1: (k + 1) // 2} if k else {}))
    assert len(held.segments) < 9 and held.sums() == {"x": 14}
    assert json.loads((tmp_path / "s" / f"_live-{held.version}.json").read_text())["segments"][-1]["id"] == held.segments[-1].id


def test_a_log_is_laid_over_its_base(spark, monkeypatch):
    from lodeseek import engine

    base = spark.createDataFrame([(i, f"w{i}", None, 0.5) for i in range(8)], "no long, body string, tags array<string>, stars double")
    e = SearchEngine(spark)
    e.create_index(NOTES, base)
    e.index_documents("notes", [{"no": 1, "body": "new"}, {"@search.action": "merge", "no": 2, "stars": 9.0}])
    assert e.stores["notes"].base is not None and e.count("notes").first()[0] == 8
    monkeypatch.setattr(engine, "FOLDED", 0)
    e.index_documents("notes", [{"no": 3, "body": "newer"}])
    assert e.stores["notes"].base is None and len(e.stores["notes"].segments) == 1
    assert {r["no"]: (r["body"], r["stars"]) for r in e.documents("notes").where("no < 4").collect()} == {0: ("w0", 0.5), 1: ("new", None), 2: ("w2", 9.0), 3: ("newer", None)}


def test_terms_are_named_in_the_scan(spark):
    e = make(spark)
    text = e.index_text("notes")
    for q, term in (("ambre~1", "amber"), ("mo*", "moor"), ("/od?g.*/", None), ("/.*xbo.*/", "oxbow"), ("inletjettyknol~2", None)):
        found = e.search("notes", {"search": q, "queryType": "full"}).matched
        plan = found._jdf.queryExecution().executedPlan().toString()
        if term:
            assert any(f"{x}(term,{term})" in plan or f"{x}(term, [{term}" in plan for x in ("EqualTo", "In")), q
    # many terms are joined, with the same hits
    want = hits(e, {"search": "/[a-m].*/", "queryType": "full"})
    text.NAMED = 3
    assert hits(e, {"search": "/[a-m].*/", "queryType": "full"}) == want and want


@pytest.mark.parametrize("word", ["heather", "jettyknoll", "oxbow", "quaysreeds", "moorlodgepo"])
@pytest.mark.parametrize("distance", [1, 2])
def test_pieces_of_a_fuzzy_word_miss_nothing(word, distance):
    """Every word within the distance, swaps included, holds one of the sets of three characters."""
    def edits(w):
        for i in range(len(w) + 1):
            yield w[:i] + "z" + w[i:]
            if i < len(w):
                yield w[:i] + w[i + 1 :]
                yield w[:i] + "z" + w[i + 1 :]
            if i + 1 < len(w):
                yield w[:i] + w[i + 1] + w[i] + w[i + 2 :]

    found = bm25.literals(query_text.Clause("fuzzy", word, distance=distance))
    if found is None:
        assert len(word) < 3 * (2 * distance + 1)
        return
    near = set(edits(word))
    near |= {y for x in near for y in edits(x)} if distance == 2 else set()
    assert all(any(all(g in x for g in some) for some in found) for x in near)


def test_patterns_know_their_literals():
    of = lambda t: bm25.literals(query_text.Clause("regex", t))
    assert of("Abcd.*xyz") == [["abc", "bcd", "xyz"]] and of("ab.cd") is None and of("abc|abd") is None and of("a(bcd)?e") is None and of("(") is None and of("\\p{L}abc") is None and of("abcd*") == [["abc"]]


def test_few_blocks_are_read_for_a_page(spark, monkeypatch):
    from lodeseek.plans import postings

    monkeypatch.setattr(postings, "BLOCK", 4)
    e = make(spark, 200)
    e.index_text("notes")
    e.index_documents("notes", [{"@search.action": "delete", "no": 11}, {"@search.action": "merge", "no": 12, "body": "pond pond quay"}])
    asked = [{"search": "pond"}, {"search": "pond quay^2", "queryType": "full"}, {"search": "flint quay", "searchMode": "all"}, {"search": "pond -quay"}, {"search": "pond reed", "filter": "stars ge 30"}, {"search": "body:tern OR tags:t1", "queryType": "full"}]
    fewer = 0
    for k, request in enumerate(asked):
        for page in ({"top": 5} if k % 2 else {"top": 3, "skip": 4},):
            monkeypatch.setattr(bm25, "PRUNED_FROM", 10**9)
            want = e.search("notes", request | page)
            monkeypatch.setattr(bm25, "PRUNED_FROM", 0)
            monkeypatch.setattr(bm25, "FIRST", 64)
            got = e.search("notes", request | page)
            assert [(r["no"], round(r["@search.score"], 9)) for r in got.hits.collect()] == [(r["no"], round(r["@search.score"], 9)) for r in want.hits.collect()], request
            assert got.total() == want.total() and "blocks" not in want.debug
            fewer += got.debug["blocks"]["read"] < got.debug["blocks"]["blocks"]
    assert fewer >= 4
    monkeypatch.setattr(bm25, "FIRST", 5)  # more blocks than may be named
    assert [r["no"] for r in e.search("notes", {"search": "pond", "top": 5}).hits.collect()] == [r["no"] for r in e.search("notes", {"search": "pond", "top": 5, "orderby": "search.score() desc"}).hits.collect()]


def test_an_index_without_texts(spark):
    e = SearchEngine(spark)
    e.create_index({"name": "bare", "fields": [{"name": "no", "type": "Edm.Int64", "key": True}]})
    assert isinstance(e.index_text("bare"), TextIndex)
    e.index_documents("bare", [{"no": 1}])
    assert e.search("bare", {"search": "x"}).total() == 0 and e.search("bare", {}).total() == 1


def test_first_segments_are_sorted_runs_with_blocks_of_their_own(spark, monkeypatch):
    """Postings, grams and blocks are written where they are made: each file is sorted, and no range shuffle deals them."""
    monkeypatch.setattr(segments, "SMALL", 10)
    ranged = []
    plain = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, *a: ranged.append(a) or plain(self, *a))
    e = SearchEngine(spark)
    e.create_index(NOTES, spark.createDataFrame([(i, note(i)["body"], note(i)["tags"], float(i)) for i in range(300)], "no long, body string, tags array<string>, stars double"))
    text = e.index_text("notes")
    assert not ranged and len(text.held.segments) == 1
    for t in ("postings", "terms", "grams", "blocks"):
        rows, order = text.held.read(t), text.held.tables[t].order
        files: dict = {}
        for r in rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), *order).orderBy("at").collect():
            files.setdefault(r["file"], []).append(tuple(r[c].encode() if isinstance(r[c], str) else r[c] for c in order))
        assert files and all(x == sorted(x) for x in files.values()), t
    rows = text.postings()
    want = rows.groupBy("path", "term", "block").agg(F.max("times").alias("most"), F.min("size").alias("least"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, text.held.read("blocks").select("path", "term", "block", "most", "least").collect()))
