"""Vector lists that last, the sentence index, and flat semantic options."""

import math
from collections import Counter

import numpy as np
import pytest

from lodeseek import semantics
from lodeseek.engine import SearchEngine
from lodeseek.errors import SearchError
from lodeseek.functions import analyzers, stems
from lodeseek.operators import ann
from lodeseek.operators.semantic import sentences

DIM = 8
VECTORS = {
    "name": "vecs",
    "fields": [{"name": "no", "type": "Edm.Int64", "key": True}, {"name": "v", "type": "Collection(Edm.Single)", "searchable": True, "dimensions": DIM, "vectorSearchProfile": "p"}],
    "vectorSearch": {"algorithms": [{"name": "a", "kind": "hnsw", "hnswParameters": {"metric": "euclidean", "efSearch": 20}}], "profiles": [{"name": "p", "algorithm": "a"}]},
}
RNG = np.random.default_rng(11)
POINTS = (RNG.normal(size=(12, DIM)) * 6)[RNG.integers(0, 12, 900)] + RNG.normal(size=(900, DIM))
POINTS[300:600] = POINTS[5] + RNG.normal(size=(300, DIM)) * 0.3  # a third lies in one place


def engine(spark, rows=POINTS):
    e = SearchEngine(spark)
    e.create_index(VECTORS, spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rows)], "no long, v array<float>"))
    return e


def near(points, q, k):
    return [i for i, _ in sorted(points.items(), key=lambda x: (np.float32(1 / (1 + np.linalg.norm(np.float32(x[1]).astype(float) - q))) * -1, str(x[0])))[:k]]


def ask(e, q, k=5):
    return [r["no"] for r in e.search("vecs", {"vectorQueries": [{"fields": "v", "vector": [float(x) for x in q], "k": k}]}).hits.collect()]


def test_lists_last_and_take_batches(spark, tmp_path):
    e = engine(spark)
    lists = e.index_vectors("vecs", "v", f"file://{tmp_path}/lists")
    assert lists.n == 900 and lists.sizes.sum() == 900 and lists.sizes.max() <= ann.HOT * 900 / 30  # the hot place is split
    points, asked = dict(enumerate(POINTS)), RNG.normal(size=(12, DIM)) * 5
    found = [len(set(ask(e, q)) & set(near(points, q, 5))) for q in asked]
    assert sum(found) >= 0.9 * 5 * len(asked)
    # upserts and removals are seen at once, by this engine and by one that opens the lists
    q = asked[0]
    gone, fresh = near(points, q, 2), [float(x) for x in np.float32(q + 0.01)]
    e.index_documents("vecs", [{"no": 5000, "v": fresh}, {"@search.action": "delete", "no": gone[0]}, {"@search.action": "merge", "no": gone[1], "v": [100.0] * DIM}])
    points = {k: v for k, v in points.items() if k != gone[0]} | {5000: np.array(fresh), gone[1]: np.array([100.0] * DIM)}
    assert ask(e, q)[0] == 5000 and not set(gone) & set(ask(e, q)) and ask(e, [100.0] * DIM, 1) == [gone[1]]
    again = SearchEngine(spark)
    again.create_index(VECTORS, e.data["vecs"])
    opened = again.index_vectors("vecs", "v", f"file://{tmp_path}/lists")
    assert (opened.n, opened.probes, opened.generation) == (900, lists.probes, 0) and np.array_equal(opened.centroids, lists.centroids)
    assert ask(again, q) == ask(e, q)


def test_lists_are_made_anew_once_they_have_doubled(spark):
    e = engine(spark, POINTS[:40])
    lists = e.index_vectors("vecs", "v")
    lists.first, before = 1, ann.SAMPLE
    e.index_documents("vecs", [{"no": 100 + i, "v": [float(x) for x in p]} for i, p in enumerate(POINTS[100:130])])
    assert lists.generation == 0 and lists.n == 70 and before == ann.SAMPLE
    lists.held.segments[0].rows = 3000  # as if there had been many
    e.index_documents("vecs", [{"no": 7, "v": [0.0] * DIM}])
    assert lists.generation == 1 and lists.n == 70 == lists.sizes.sum() and len(lists.held.segments) == 1 and ask(e, [0.0] * DIM, 1) == [7]


def test_many_queries_meet_their_lists(spark):
    e = engine(spark)
    lists = e.index_vectors("vecs", "v")
    asked = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(POINTS[::90])], "query long, vector array<float>")
    got = {}
    for r in lists.nearest(asked, 4, lists.n).collect():
        got.setdefault(r["query"], set()).add(int(r["__key"]))
    assert got == {i: set(near(dict(enumerate(POINTS)), np.float32(p).astype(float), 4)) for i, p in enumerate(POINTS[::90])}
    empty = engine(spark, POINTS[:0])
    assert empty.index_vectors("vecs", "v").nearest(asked, 3, 10).count() == 0 and ask(empty, [0.0] * DIM) == []
    empty.index_documents("vecs", [{"no": 1, "v": [1.0] * DIM}])
    assert ask(empty, [0.0] * DIM) == [1]


TALKS = {
    "name": "talks",
    "fields": [{"name": "no", "type": "Edm.Int64", "key": True}, {"name": "head", "type": "Edm.String", "searchable": True}, {"name": "body", "type": "Edm.String", "searchable": True}],
    "semantic": {"configurations": [{"name": "c", "prioritizedFields": {"titleField": {"fieldName": "head"}, "prioritizedContentFields": [{"fieldName": "body"}]}}]},
}
ROWS = [(i, [f"On tides number {i}", None, "Lamps at sea"][i % 3], " ".join(f"{['Tides rise', 'A lamp glows', 'Sailors sleep', 'Lamps and tides meet lamps'][(i * k + k) % 4]} at the {['quay', 'pier', 'strand'][(i + k) % 3]} on day {k}." for k in range(i % 7))) for i in range(40)]


def plain(rows, terms, top):
    """Sentence BM25 over all of rows."""
    held = [(str(i), f, at, s, Counter(analyzers.tokens(s, None))) for i, h, b in rows for f, t in (("head", h), ("body", b)) for at, s in enumerate(sentences(t))]
    n, mean = len(held), sum(sum(c.values()) for *_, c in held) / max(1, len(held))
    df = {t: sum(c[t] > 0 for *_, c in held) for t in terms}
    scored = []
    for key, f, at, s, c in held:
        size = sum(c.values())
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in terms)
        if score > 0:
            scored.append((-score, key, f == "body", at, f, s))
    scored = sorted(scored)[:top]
    return [(key, f, s, pytest.approx(x / scored[0][0])) for x, key, _, _, f, s in scored]


@pytest.mark.parametrize("indexed", [False, True])
def test_answers_are_the_best_sentences_of_all_matches(spark, indexed):
    e = SearchEngine(spark)
    e.create_index(TALKS, spark.createDataFrame(ROWS, "no long, head string, body string"))
    rows = {r[0]: r for r in ROWS}
    if indexed:
        e.index_sentences("talks")
    request = {"search": "lamp tide", "semanticConfiguration": "c", "answers": "extractive|count-4"}
    match = lambda r: {"lamp", "tide"} & {t for x in r[1:] for t in analyzers.tokens(x or "", None)}
    got = lambda q: [tuple(r) for r in e.search("talks", request | q).answers.collect()]
    assert got({}) == plain([r for r in rows.values() if match(r)], ["lamp", "tide"], 4)
    assert got({"search": "lamp lamp tide"}) == plain([r for r in rows.values() if match(r)], ["lamp", "lamp", "tide"], 4)
    e.index_documents("talks", [{"@search.action": "delete", "no": 5}, {"@search.action": "merge", "no": 6, "body": "Lamps, lamps and nothing but lamps here."}, {"no": 77, "head": "Tide and lamp by the lamp"}])
    rows = {k: r for k, r in rows.items() if k != 5} | {6: (*rows[6][:2], "Lamps, lamps and nothing but lamps here."), 77: (77, "Tide and lamp by the lamp", None)}
    assert got({}) == plain([r for r in rows.values() if match(r)], ["lamp", "tide"], 4)
    assert got({"search": "zebra"}) == [] and e.search("talks", {"search": "lamp"}).answers is None


@pytest.mark.parametrize(
    ("request_", "want"),
    [
        ({"answers": "extractive"}, (3, None)), ({"answers": "extractive|count-2"}, (2, None)), ({"answers": "extractive|count-2,threshold-0.7"}, (2, None)), ({"answers": "extractive|threshold-0.7,count-4"}, (4, None)),
        ({"answers": "extractive|count-99"}, (5, None)), ({"answers": "extractive|count-0"}, (1, None)), ({"answers": "extractive|count-many"}, (3, None)), ({"answers": "none"}, (None, None)), ({"answers": "generative|count-2"}, (None, None)),
        ({"captions": "extractive|highlight-false"}, (None, 1)), ({"captions": "none"}, (None, None)), ({"captions": "extractive", "answers": "extractive|count-1"}, (1, 1)),
        ({"queryAnswer": "extractive", "queryAnswerCount": 2, "queryCaption": "extractive"}, (2, 1)), ({"queryAnswer": "extractive", "queryAnswerCount": "2"}, (3, None)), ({"queryAnswer": "none", "queryAnswerCount": 2}, (None, None)),
        ({"answers": "none", "queryAnswer": "extractive"}, (None, None)), ({"answers": 7, "captions": 7}, (None, None)), ({}, (None, None)),
    ],
)
def test_flat_options(request_, want):
    for named in ({"semanticConfiguration": "c"}, {"semanticConfigurationName": "c", "queryType": "simple"}):
        got = semantics.wanted(request_ | named)
        assert (got.configuration, got.answers, got.captions, got.questions) == ("c", *want, ())
    assert semantics.wanted(request_) is None and semantics.wanted(request_ | {"queryType": "semantic"}).configuration is None


def test_what_flat_options_refuse_and_count(spark):
    e = SearchEngine(spark)
    e.create_index(TALKS, spark.createDataFrame(ROWS, "no long, head string, body string"))
    for bad in ({"semanticConfiguration": ""}, {"semanticConfiguration": 3}, {"queryType": "semantic"}, {"semanticConfiguration": "none"}, {"semanticConfiguration": "c", "semanticErrorHandling": "maybe"}):
        with pytest.raises(SearchError):
            e.search("talks", {"search": "tide"} | bad)
    assert e.search("talks", {"search": "tide", "semanticConfiguration": "none", "semanticErrorMode": "partial"}).answers is None
    got = e.search("talks", {"search": "tide", "filter": "no ge 0", "debug": "all"} if e.resolve("talks").at("no").filterable else {"search": "tide", "debug": "all"}).debug["execution"]
    assert got["totalCandidates"] == 40 and got["matchedDocuments"] == e.search("talks", {"search": "tide"}).total() and got["vectorQueries"] == 0
    assert "execution" not in e.search("talks", {"search": "tide"}).debug


@pytest.mark.parametrize("metric", ["cosine", "dotProduct", "euclidean"])
def test_cells_of_many_queries_give_what_a_plain_scan_gives(metric, monkeypatch):
    """Copies, multiples and zero vectors tie; scores are those of functions.vectors to the last bit."""
    monkeypatch.setattr(ann, "CHUNK", 50)
    rng = np.random.default_rng(3)
    x = np.float32(rng.normal(size=(120, DIM)))
    x[20:60], x[60:70], x[70:74] = x[0], x[1] * 3, 0
    q, own = np.vstack([x[:3], x[70:71], np.float32(rng.normal(size=(5, DIM)))]), rng.integers(0, 4, 120)
    own[20:60] = own[0]
    lists = [sorted(set(rng.integers(0, 4, 3).tolist())) for _ in q[:-1]] + [[0, 1, 2, 3]]
    got: dict = {}
    for i, j, s in zip(*ann._best(q, x, lists, own, 6, metric)):
        got.setdefault(int(i), []).append((int(j), float(s)))
    for i, ls in enumerate(lists):
        rows = np.flatnonzero(np.isin(own, ls))
        score = ann._exact(np.repeat(q[i : i + 1].astype(float), len(rows), axis=0), x[rows].astype(float), metric)
        assert got[i] == [(int(j), float(s)) for s, j in sorted(zip(-score, rows)) for s in [-s]][:6]


def test_nearest_gives_no_row_for_each_query_and_list(spark, monkeypatch):
    """Pairs are compared in cells: no plan joins queries with rows one by one; cells of several groups and blocks give the same."""
    lists = engine(spark).index_vectors("vecs", "v")
    asked = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(POINTS[::30])], "query long, vector array<float>")
    whole = sorted(map(tuple, lists.nearest(asked, 5, lists.n).collect()))
    for name, n in (("GROUP", 64), ("ASKED", 7)):
        monkeypatch.setattr(ann, name, n)
    cut = lists.nearest(asked, 5, lists.n)
    assert sorted(map(tuple, cut.collect())) == whole and len(whole) == 5 * 30
    assert "FlatMapCoGroups" in (plan := cut._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan


def test_words_that_no_rule_changes_are_left_at_once(monkeypatch):
    parts = ["", "y", "tr", "ay", "bo", "'k", "ss", "99", "é"]
    ends = [*stems.CHANGED, "ator", "ll", "l", "nt", "k", "qu", "x9", "ü", "bb", "er", "ism", "u", "sses", "eedly"]
    made = [a + b + e for a in parts for b in ("", "at", "gly", "ner") for e in ends]
    fast = [stems.english(w) for w in made]
    assert stems.english("zqxv") == "zqxv" and not "zqxv".endswith(stems.CHANGED)
    monkeypatch.setattr(stems, "CHANGED", ("",))  # all words go through all rules
    assert fast == [stems.english(w) for w in made]
