"""Requests on small indexes."""

import pytest

from lodeseek import schema
from lodeseek.engine import SearchEngine
from lodeseek.errors import SearchError
from lodeseek.functions import analyzers, vectors
from lodeseek.functions.stems import english
from lodeseek.operators import semantic
from lodeseek.plans import query_text as qt


def f(name, kind, flags="", **more):
    on = {"K": "key", "S": "searchable", "F": "filterable", "O": "sortable", "C": "facetable"}
    return {"name": name, "type": kind, **{on[x]: True for x in flags}, **more}


ITEMS = {"name": "items", "fields": [f("id", "Edm.String", "K"), f("title", "Edm.String", "S"), f("price", "Edm.Double", "FOC")]}
VECS = {
    "name": "vecs",
    "fields": [f("id", "Edm.String", "KFO"), f("title", "Edm.String", "SF"), f("category", "Edm.String", "FC"), f("v", "Collection(Edm.Single)", "S", dimensions=3, vectorSearchProfile="p")],
    "vectorSearch": {"algorithms": [{"name": "a", "kind": "hnsw"}], "profiles": [{"name": "p", "algorithm": "a"}]},
}


def ids(engine, request, index="items"):
    return [r["id"] for r in engine.search(index, request).hits.collect()]


def test_text_scores_stay_where_no_vector_list_is_left(spark):
    e = SearchEngine(spark)
    spec = VECS | {"fields": [x | {"vectorizer": "h"} if x["name"] == "v" else x for x in VECS["fields"]], "vectorSearch": VECS["vectorSearch"] | {"vectorizers": [{"name": "h"}]}}
    e.create_index(spec)
    e.index_documents("vecs", [{"id": "x", "title": "plum jam", "v": [1.0, 0.0, 0.0]}, {"id": "y", "title": "plum tart with plum", "v": [0.0, 1.0, 0.0]}])
    plain = [(r["id"], r["@search.score"]) for r in e.search("vecs", {"search": "plum"}).hits.collect()]
    nothing = {"kind": "text", "text": "the", "fields": "v", "k": 2}  # stopwords alone give no vector
    assert [(r["id"], r["@search.score"]) for r in e.search("vecs", {"search": "plum", "vectorQueries": [nothing]}).hits.collect()] == plain


def test_actions(spark):
    e = SearchEngine(spark)
    e.create_index(ITEMS)
    got = e.index_documents("items", [{"id": "m", "title": "a", "price": 1.0}, {"@search.action": "merge", "id": "m", "price": 2}, {"action": "merge", "document": {"id": "z"}}, {"@search.action": "mergeOrUpload", "id": "n", "title": "b"}])
    assert [r["status"] for r in got.orderBy("__seq").collect()] == [201, 200, 404, 201]
    e.index_documents("items", [{"@search.action": "delete", "id": "n"}, {"@search.action": "delete", "id": "m"}, {"@search.action": "merge", "id": "m", "title": "c"}])
    assert [tuple(r) for r in e.data["items"].select("id", "title", "price").collect()] == [("m", "c", 2.0)]
    assert e.get_document("items", "m").first()["title"] == "c" and e.count("items").first()[0] == 1


def test_a_null_in_a_merge_is_laid(spark):
    e = SearchEngine(spark)
    e.create_index(ITEMS)
    e.index_documents("items", [{"id": "m", "title": "a", "price": 1.0}, {"id": "n", "title": "b", "price": 2.0}])
    e.index_documents("items", [{"@search.action": "merge", "id": "m", "price": None}, {"@search.action": "mergeOrUpload", "id": "n", "title": None}])
    assert sorted(tuple(r) for r in e.data["items"].select("id", "title", "price").collect()) == [("m", "a", None), ("n", None, 2.0)]


def test_bad_documents_stop_no_others(spark):
    e = SearchEngine(spark)
    e.create_index(ITEMS)
    given = [{"id": "a", "nope": 1}, {"id": "b", "price": "dear"}, {"id": "c", "title": "good", "price": 3}, {"title": "no key"}, {"id": 7}, {"id": "d", "title": ["x"]}, {"@search.action": "merge", "id": "c", "price": True}]
    got = {r["__seq"]: (r["key"], r["status"]) for r in e.index_documents("items", given).collect()}
    assert got == {0: ("a", 400), 1: ("b", 400), 2: ("c", 201), 3: (None, 400), 4: (None, 400), 5: ("d", 400), 6: ("c", 400)}
    assert [tuple(r) for r in e.data["items"].select("id", "title", "price").collect()] == [("c", "good", 3.0)]
    with pytest.raises(SearchError):
        e.index_documents("items", [{"@search.action": "burn", "id": "c"}])


def test_rows_that_break_rules(spark):
    e = SearchEngine(spark)
    e.create_index({"name": "typed", "fields": [f("id", "Edm.String", "K"), f("at", "Edm.Time", "F"), f("dur", "Edm.Duration", "F"), f("blob", "Edm.Binary", "F")]})
    good, bad = {"at": "13:07:59.5", "dur": "P3DT4H", "blob": "b3dscw=="}, [{"at": "13:60:00"}, {"dur": "P"}, {"blob": "b3d?"}]
    got = e.index_documents("typed", [{"id": "0"} | good, *[{"id": str(i + 1)} | good | b for i, b in enumerate(bad)]])
    assert [r["status"] for r in got.orderBy("__seq").collect()] == [201, 400, 400, 400]


def test_catalog(spark):
    e = SearchEngine(spark)
    e.create_index(ITEMS)
    e.index_documents("items", [{"id": "1", "title": "a spanner for the wheel"}])
    e.put_resource("alias", "al", {"indexes": ["items"]})
    assert e.count("al").first()[0] == 1
    e.put_resource("synonymMap", "m", {"synonyms": "wrench, spanner\nhub => wheel"})
    e.put_index({"name": "items", "fields": [f("id", "Edm.String", "K"), f("title", "Edm.String", "S", synonymMaps=["m"]), f("price", "Edm.Double", "FO"), f("more", "Edm.String", "S")]})
    assert ids(e, {"search": "wrench"}) == ids(e, {"search": "HUB"}) == ["1"] and ids(e, {"search": "screw"}) == []
    tag = e.get_resource("synonymMap", "m")["@odata.etag"]
    assert tag == '"0x00000002"'
    with pytest.raises(SearchError):
        e.put_resource("synonymMap", "m", {"synonyms": ""}, if_match='"0x1"')
    with pytest.raises(SearchError):
        e.create_index(ITEMS)
    e.put_index({"name": "items", "fields": [f("id", "Edm.String", "K"), f("title", "Edm.Int32", "F")]})
    assert e.count("items").first()[0] == 0
    e.delete_index("items")
    with pytest.raises(SearchError):
        e.search("items", {})


@pytest.mark.parametrize("fields", [[f("id", "Edm.String")], [f("id", "Edm.String", "K"), f("id", "Edm.String")], [f("id", "Edm.Double", "K")], [f("id", "Edm.String", "K"), f("x", "Edm.Byte")], [f("id", "Edm.String", "K"), f("x", "Edm.Duration", "O")], [f("id", "Edm.String", "K"), f("x", "Collection(Edm.Time)")], [f("id", "Edm.String", "K"), f("v", "Collection(Edm.Single)", "S", dimensions=5000, vectorSearchProfile="p")]])
def test_bad_definitions(fields):
    with pytest.raises(SearchError):
        schema.parse({"name": "x", "fields": fields})


def test_analyzers():
    assert analyzers.tokens("Boiling the kettles copper-pan", None) == ["boil", "kettl", "copper", "pan"]
    assert [english(w) for w in "generously national relational happily hopping hoping skies flies conditional".split()] == ["generous", "nation", "relat", "happili", "hop", "hope", "sky", "fli", "condit"]
    assert analyzers.tokens("日本語 abc 東", "ja") == ["日本", "本語", "abc", "東"]
    got = analyzers.analyze("Été rocks", "latin")
    assert [(t["token"], t["startOffset"], t["endOffset"], t["position"]) for t in got] == [("été", 0, 5, 0), ("rocks", 6, 11, 1)]


def test_text_vectors_follow_overlap():
    a, b, c = (vectors.text_vector(t, 64) for t in ("copper kettle", "copper kettle whistles", "grey heron"))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, b) > dot(a, c) and vectors.text_vector("the", 64) is None and abs(dot(a, a) - 1) < 1e-5


def test_sentences_and_highlights():
    text = "One. This is a longer sentence of the text! Is it? Yes; it is the last sentence here."
    assert semantic.sentences(text)[0].startswith("One. This is")
    assert all(len(s) <= 500 for s in semantic.sentences("word " * 400))
    assert semantic._fragments("The fox ran. No match here.", {"fox"}, None, ("<em>", "</em>")) == ["The <em>fox</em> ran."]


def test_query_trees():
    assert qt.simple("a -b").never[0].text == "b" and qt.simple('"a ""b"""').should[0].text == 'a "b"'
    assert qt.synonyms(["a, b c", "d => e"], "A") == ["b", "c"] and qt.synonyms(["d => e"], "e") == []


def test_semantic_search(spark):
    e = SearchEngine(spark)
    e.create_index({"name": "sem", "fields": [f("id", "Edm.String", "K"), f("title", "Edm.String", "S"), f("content", "Edm.String", "S")], "semantic": {"configurations": [{"name": "default", "prioritizedFields": {"titleField": {"fieldName": "title"}, "prioritizedContentFields": [{"fieldName": "content"}]}}]}})
    e.index_documents("sem", [{"id": "1", "title": "Foxes and their dens", "content": "A fox digs a den in spring. The den is warm and dry inside."}, {"id": "2", "title": "Birds in the garden", "content": "Birds build their nests in spring. They sing in the morning."}])
    got = e.search("sem", {"search": "fox den", "queryType": "semantic", "semanticConfiguration": "default", "answers": "extractive", "captions": "extractive|highlight-true"})
    best = got.answers.collect()
    assert best[0]["__key"] == "1" and best[0]["score"] == 1.0
    hit = got.hits.first()
    assert hit["@search.captions"] and 0 < hit["@search.rerankerScore"] < 1
    with pytest.raises(SearchError):
        e.search("sem", {"search": "x", "queryType": "semantic"})


def test_semantic_requests(spark):
    e = SearchEngine(spark)
    own = {"name": "roles", "priorities": {"answers": ["content", "title"], "captions": ["title"]}, "sources": [{"name": "s", "field": "content"}], "reranker": {"name": "standard"}, "rescorers": []}
    spec = {"name": "sem", "fields": [f("id", "Edm.String", "K"), f("title", "Edm.String", "S"), f("content", "Edm.String", "S"), f("hidden", "Edm.String", "S", retrievable=False)]}
    index = e.create_index(spec | {"semantic": {"configurations": [own]}})
    assert index.semantic == {"roles": {"answers": ["content", "title"], "captions": ["title"]}}
    e.index_documents("sem", [{"id": "a", "title": "Herons by the weir", "content": "A heron waits at the weir all day. It eats small fish and frogs."}, {"id": "b", "title": "Kettles made of copper", "content": "Copper kettles boil water quickly. They need polish every month."}])
    nested = {"semanticConfiguration": "roles", "queryContext": {"questions": ["what do herons eat"]}, "answers": {"count": 1}, "captions": {"count": 2, "type": "extractive"}}
    got = e.search("sem", {"search": "weir", "semantic": nested})
    assert [r["__key"] for r in got.answers.collect()] == ["a"] and got.hits.first()["@search.captions"] == ["Herons by the weir"]
    assert e.search("sem", {"search": "weir", "semantic": {"semanticConfiguration": "roles"}}).answers is None
    with pytest.raises(SearchError):
        e.search("sem", {"search": "weir", "queryType": "full", "semantic": nested})
    for change in ({"answers": {"count": 6}}, {"answers": {"count": 0}}, {"answers": 3}, {"captions": {"count": 4}}, {"captions": {"type": "abstract"}}, {"semanticConfiguration": ""}, {"semanticConfiguration": "none"}, {"queryContext": {"questions": "x"}}, {"semanticErrorHandling": "shrug"}):
        with pytest.raises(SearchError):
            e.search("sem", {"search": "weir", "semantic": nested | change})
    assert e.search("sem", {"search": "weir", "semantic": nested | {"semanticConfiguration": "none", "semanticErrorHandling": "partial"}}).answers is None
    for bad in ([own, own], [own | {"rescorers": [1]}], [own | {"reranker": {"name": "x"}}], [own | {"priorities": {}}], [own | {"priorities": {"answers": []}}], [own | {"priorities": {"answers": ["hidden"]}}], [own | {"sources": [{"name": "s", "field": "id"}]}], [own | {"sources": [{"name": "s", "type": "audio", "field": "title"}]}], [{"priorities": {"answers": ["title"]}}]):
        with pytest.raises(SearchError):
            schema.parse(spec | {"semantic": {"configurations": bad}})


def test_resources_and_statistics(spark):
    e = SearchEngine(spark)
    e.create_index(ITEMS)
    e.index_documents("items", [{"id": "a", "title": "x"}])
    for kind, bad in (("alias", {"indexes": ["none"]}), ("synonymMap", {}), ("knowledgeSource", {}), ("knowledgeBase", {"knowledgeSources": [{"name": "none"}]})):
        with pytest.raises(SearchError) as caught:
            e.put_resource(kind, "r", bad)
        assert caught.value.code == f"Invalid{kind[0].upper()}{kind[1:]}"
    e.put_resource("alias", "al", {"indexes": ["items"]})
    with pytest.raises(SearchError) as caught:
        e.put_resource("alias", "al", {"indexes": ["items"]}, create=True)
    assert caught.value.code == "AliasAlreadyExists" and [x["name"] for x in e.list_resources("alias")] == ["al"] and [x.name for x in e.list_indexes()] == ["items"]
    got = e.service_statistics()["counters"]
    assert got["documentCounter"] == {"usage": 1, "limit": 10_000_000} and got["aliasCounter"]["usage"] == 1 and got["indexCounter"] == {"usage": 1, "limit": 100}


def test_lists_of_vectors(spark, sf_dir):
    from lodeseek.sources import tables

    spec = tables.VECS | {"vectorSearch": {"algorithms": [{"name": "a", "kind": "hnsw", "hnswParameters": {"efSearch": 40}}], "profiles": [{"name": "p", "algorithm": "a"}]}}
    e = SearchEngine(spark)
    e.create_index(spec, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = e.data["vecs"].orderBy("vec_id").limit(10).collect()
    ask = lambda v, **more: {r["vec_id"] for r in e.search("vecs", {"vectorQueries": [{"fields": "embedding", "vector": list(v), "k": 10, **more}]}).hits.collect()}
    exact = [ask(r["embedding"]) for r in rows]
    lists = e.index_vectors("vecs", "embedding")
    assert sum(lists.sizes) == e.data["vecs"].count() == lists.n
    found = [ask(r["embedding"]) for r in rows]
    assert sum(len(a & b) for a, b in zip(exact, found)) >= 0.9 * sum(map(len, exact))
    assert [ask(r["embedding"], exhaustive=True) for r in rows[:2]] == exact[:2]


def test_clustered_vectors_need_few_lists():
    import numpy as np

    from lodeseek.operators import ann

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 5 + rng.normal(size=(3000, 16))
    for metric in ("cosine", "euclidean"):
        made = ann.centroids(x, 55, metric)
        assert ann.probes(x, made, metric) <= 12


def test_number_texts(spark):
    from pyspark.sql import functions as F

    from lodeseek.plans.bm25 import number_text

    want = {10.0: "10.0", 0.5: "0.5", 12345678.5: "12345678.5", 1e7: "10000000.0", 9.5e15: "9500000000000000.0", 1e16: "1e16", 1.5e21: "1.5e21", 0.0005: "0.0005", 0.000012: "0.000012", 1.5e-7: "1.5e-7", -2e8: "-200000000.0", -3e-4: "-0.0003", 1e-9: "1e-9"}
    rows = spark.createDataFrame([(x,) for x in want], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == want


def test_what_has_no_text_and_what_is_replaced(spark):
    e = SearchEngine(spark)
    e.create_index({"name": "bare", "fields": [f("id", "Edm.String", "KF"), f("n", "Edm.Int32", "F")]})
    e.index_documents("bare", [{"id": "a", "n": 1}])
    assert e.search("bare", {"search": "a"}).total() == 0 and e.search("bare", {"search": "*"}).total() == 1
    e.create_index(VECS)
    e.index_documents("vecs", [{"id": "a", "title": "x", "v": [1.0, 0.0, 0.0]}])
    e.index_documents("vecs", [{"id": "a", "title": "y"}])  # an upload replaces all, the vector too
    assert e.search("vecs", {"vectorQueries": [{"fields": "v", "vector": [1.0, 0.0, 0.0], "k": 1}]}).total() == 0
    e.reset()
    assert e.list_indexes() == []
    with pytest.raises(SearchError) as caught:
        e.count("bare")
    assert caught.value.code == "ResourceNotFound" and caught.value.status == 404


def test_other_stemmers():
    from lodeseek.functions import stems

    cases = {
        stems.german: "aufeinander aufeinand kategorien kategori häuser haus freundlichkeit freundlich bedeutung bedeut", stems.spanish: "chicas chic torneados torn cheques chequ rápidamente rapid",
        stems.french: "continuellement continuel contradictoirement contradictoir majestueusement majestu principaux principal chevaux cheval maîtresses maîtress fréquemment fréquent",
        stems.italian: "abbandoneranno abbandon abbassamento abbass abbassarla abbass pronunciò pronunc proporzione proporzion proprietà propriet",
        stems.portuguese: "bobalhões bobalhõ bocadinho bocadinh quilométricas quilométr químico químic quinhentos quinhent quintessência quintessent",
        stems.dutch: "lichamelijkheden licham lichamen licham lichtgevoelige lichtgevoel opglimpingen opglimp opgroeiende opgroei", stems.russian: "важнейшими важн важности важност падение паден поднялся подня вагонов вагон",
        stems.swedish: "jakten jakt", stems.norwegian: "havnedistriktene havnedistrikt", stems.danish: "undersøgelse undersøg indtage indtag",
    }
    for stem, words in cases.items():
        words = words.split()
        assert [stem(w) for w in words[::2]] == words[1::2]


def test_ranks_are_dense_and_ordered(spark):
    from lodeseek.operators import ranking

    rows = [(str(i), float((i * 7) % 50) / 7) for i in range(500)]
    got = {r["__key"]: r["rank"] for r in ranking.numbered(ranking.dealt(spark.createDataFrame(rows, "__key string, __score double").repartition(7))).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [k for k, _ in sorted(rows, key=lambda x: (-x[1], x[0]))]
    assert sorted(got.values()) == list(range(1, 501))


def test_generated_vectors_and_text_queries(spark):
    e = SearchEngine(spark)
    spec = {
        "name": "gen",
        "fields": [f("id", "Edm.String", "KFO"), f("title", "Edm.String", "S"), f("content", "Edm.String"), f("v", "Collection(Edm.Single)", "S", dimensions=64, vectorSearchProfile="p", vectorizer="h")],
        "vectorSearch": {"algorithms": [{"name": "a", "kind": "exhaustiveKnn"}], "profiles": [{"name": "p", "algorithm": "a"}], "vectorizers": [{"name": "h", "sourceContext": {"fields": ["title", "content"]}}]},
    }
    e.create_index(spec)
    e.index_documents("gen", [{"id": "1", "title": "copper kettle", "content": "copper kettle whistles"}, {"id": "2", "title": "grey heron", "content": "heron nests"}, {"id": "3", "title": "copper pans", "content": "polished copper"}, {"id": "4", "title": "the", "content": ""}])
    got = e.search("gen", {"vectorQueries": [{"kind": "text", "text": "copper kettle", "fields": "v", "k": 3}]}).hits.collect()
    assert [r["id"] for r in got][:2] == ["1", "3"] and e.data["gen"].where("v IS NULL").first()["id"] == "4"


def test_debug_and_visibility(spark):
    e = SearchEngine(spark)
    e.create_index({"name": "vis", "fields": [f("id", "Edm.String", "K"), f("title", "Edm.String", "S", synonymMaps=["m"]), f("secret", "Edm.String", "S", retrievable=False), f("brief", "Edm.String", "S", stored=False)]})
    e.put_resource("synonymMap", "m", {"synonyms": "lx, lisbon"})
    e.index_documents("vis", [{"id": "1", "title": "ferries to lisbon", "secret": "oak", "brief": "short"}])
    got = e.search("vis", {"search": "lx"})
    assert got.debug["synonyms"] == {"lx": ["lisbon"]} and got.hits.columns == ["@search.score", "id", "title", "brief"]
    assert e.search("vis", {"search": "oak", "select": "secret"}).hits.first()["secret"] == "oak"
    assert e.get_document("vis", "1").columns == ["id", "title", "secret"]


def test_retrieve(spark):
    e = SearchEngine(spark)
    e.create_index(ITEMS)
    e.index_documents("items", [{"id": str(i), "title": f"fox {i}"} for i in range(5)])
    e.put_resource("knowledgeSource", "k", {"searchIndexParameters": {"searchIndexName": "items"}})
    e.put_resource("knowledgeBase", "b", {"knowledgeSources": [{"name": "k"}]})
    assert [r["key"] for r in e.retrieve("b", "fox", 2).collect()] == ["0", "1"]
    with pytest.raises(SearchError):
        e.retrieve("b", "fox", 0)


def test_runs_clear_their_own_intermediates(spark):
    import threading

    from lodeseek import storage

    made = {}

    def work(name):
        run = storage.mark()
        first = storage.materialise(spark.range(3), name)
        storage.discard(first)
        made[name] = (run, storage.materialise(spark.range(5), name), storage.materialise(spark.range(7), name))

    for name in ("a", "b"):
        t = threading.Thread(target=work, args=(name,))
        t.start()
        t.join()
    (a, a1, a2), (_, b1, b2) = made["a"], made["b"]
    assert storage.clear(spark, a, keep=[a2]) == 1 and (a2.count(), b1.count(), b2.count()) == (7, 5, 7)
    with pytest.raises(Exception):
        a1.count()
