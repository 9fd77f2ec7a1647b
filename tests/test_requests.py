"""Requests on one index of walks, held against what a few lines of Python say about its rows."""

import re

import pytest

from lodeseek.engine import SearchEngine
from lodeseek.errors import SearchError
from lodeseek.functions.stems import english


def f(name, kind, flags="", **more):
    on = {"K": "key", "S": "searchable", "F": "filterable", "O": "sortable", "C": "facetable"}
    return {"name": name, "type": kind, **{on[x]: True for x in flags}, **more}


SPEC = {
    "name": "walks",
    "fields": [
        f("walk", "Edm.Int64", "KFO"), f("route", "Edm.String", "SF"), f("report", "Edm.String", "S"), f("km", "Edm.Double", "FO"), f("grade", "Edm.Int32", "FOC"),
        f("region", "Edm.ComplexType", fields=[f("land", "Edm.String", "FOC"), f("valleys", "Collection(Edm.String)", "FC")]),
        f("stops", "Collection(Edm.ComplexType)", fields=[f("place", "Edm.String", "SFC"), f("hut", "Edm.ComplexType", fields=[f("beds", "Edm.Int32", "F"), f("open", "Edm.Boolean", "FC")])]),
        f("bearing", "Collection(Edm.Single)", "S", dimensions=2, vectorSearchProfile="p"),
    ],
    "suggesters": [{"name": "names", "searchFields": ["route", "stops/place"]}],
    "vectorSearch": {"algorithms": [{"name": "x", "kind": "exhaustiveKnn", "exhaustiveKnnParameters": {"metric": "euclidean"}}], "profiles": [{"name": "p", "algorithm": "x"}]},
}


def walk(n, route, report, km, grade, land=None, valleys=(), stops=(), bearing=None):
    made = [{"place": p, "hut": None if beds is None else {"beds": beds, "open": beds % 2 == 0}} for p, beds in stops]
    return {"walk": n, "route": route, "report": report, "km": km, "grade": grade, "region": land and {"land": land, "valleys": list(valleys)}, "stops": made, "bearing": bearing}


WALKS = [
    walk(11, "Ridge above the tarn", "We climbed quickly; climbing again after rain was slow.", 12.5, 3, "Cumbria", ["Esk", "Duddon"], [("Brackenrigg", 6), ("Stony Tarn", None)], [1.0, 0.0]),
    walk(12, "Round the reservoir", "A flat path. Herons fish by the weir, and the weir hums.", 7.0, 1, "Powys", ["Elan"], [("Weir House", 11)], [0.0, 2.0]),
    walk(13, "Climbers' traverse", "Loose rock above the tarn, ropes advised.", 9.25, 5, "Cumbria", ["Langdale"], [("Brackenrigg", 6), ("Mickleden", 4)], [1.5, 0.5]),
    walk(14, "Old railway path", None, 21.0, 1, "Devon", [], [("Meldon", None), ("Okehampton", 30)], None),
    walk(15, "Three peaks in the rain", "Rain. More rain, then a rainbow over the third peak.", 38.6, 5, "Yorkshire", ["Ribble", "Wharfe", "Dee"], [], [-1.0, -1.0]),
    walk(16, None, "Slow going over wet rock, a path of sorts.", 9.25, 4, None, (), [("Nameless", 3)], [0.9, 0.1]),
    walk(17, "Path of the herons", "Reeds, reeds and a heronry; the reservoir path was closed.", 5.5, None, "Powys", ["Elan", "Claerwen"], [("Weir House", 11), ("Reed Hide", None)], [0.1, 1.9]),
]
BY = {w["walk"]: w for w in WALKS}
STOP = {"the", "a", "and", "in", "by", "of", "was", "then", "no"}


def stems(text):
    return [english(x) for x in re.findall(r"[a-z]+", (text or "").lower()) if x not in STOP]


def has(*words, fields=("route", "report", "stops/place")):
    """Whether a walk holds all of words, as stems."""
    def test(w):
        texts = {"route": w["route"], "report": w["report"], "stops/place": " ".join(s["place"] for s in w["stops"])}
        held = {x for k in fields for x in stems(texts[k])}
        return all(english(x) in held for x in words)

    return test


def word(pattern):
    """Whether one of a walk's stems is matched."""
    return lambda w: any(re.fullmatch(pattern, x) for t in (w["route"], w["report"], *[s["place"] for s in w["stops"]]) for x in stems(t))


def any_of(*tests):
    return lambda w: any(t(w) for t in tests)


def both(a, b):
    return lambda w: a(w) and b(w)


def no(t):
    return lambda w: not t(w)


@pytest.fixture(scope="module")
def engine(spark):
    e = SearchEngine(spark)
    e.create_index(SPEC)
    e.index_documents("walks", WALKS)
    return e


@pytest.fixture(scope="module")
def indexed(engine):
    return engine.index_text("walks")


def found(engine, request):
    return [r["walk"] for r in engine.search("walks", request).hits.collect()]


CASES = [
    ({"search": "herons"}, has("heron")), ({"search": "climbing"}, has("climb")), ({"search": "The"}, lambda w: False), ({"search": "tarn reeds"}, any_of(has("tarn"), has("reed"))),
    ({"search": "rock slow", "searchMode": "all"}, has("rock", "slow")), ({"search": "path -weir"}, both(has("path"), no(has("weir")))), ({"search": "-rain"}, no(has("rain"))),
    ({"search": "weir", "searchFields": "report"}, has("weir", fields=("report",))), ({"search": "weir", "searchFields": "stops/place"}, has("weir", fields=("stops/place",))),
    ({"search": '"wet rock"'}, lambda w: "wet rock" in (w["report"] or "")), ({"search": '"path flat"'}, lambda w: False), ({"search": '"flat path" | tarn'}, any_of(lambda w: w["walk"] == 12, has("tarn"))),
    ({"search": "tran~1"}, has("tarn")), ({"search": "ridgr~"}, word("ridg|ridge")), ({"search": "rezervior~2"}, word("reservoir")), ({"search": "rezervior~1"}, lambda w: False),
    ({"search": "*"}, lambda w: True), ({"search": None}, lambda w: True), ({"search": "route:path", "queryType": "full"}, has("path", fields=("route",))), ({"search": "reser*", "queryType": "full"}, word("reser.*")),
    ({"search": "rain AND NOT peak", "queryType": "full"}, both(has("rain"), no(has("peak")))), ({"search": "(weir OR tarn) -ropes", "queryType": "full"}, both(any_of(has("weir"), has("tarn")), no(has("rope")))),
    ({"search": "/r[aeo]+[a-z]+/", "queryType": "full"}, word("r[aeo]+[a-z]+")), ({"search": "/.*eser.+/", "queryType": "full"}, word(".*eser.+")), ({"search": "report:[rop TO row]", "queryType": "full"}, lambda w: any("rop" <= x <= "row" for x in stems(w["report"]))),
    ({"search": "+path herons", "queryType": "full"}, has("path")), ({"search": "rain rock tarn", "minimumCoverage": 0.6}, lambda w: sum(has(x)(w) for x in ("rain", "rock", "tarn")) >= 2),
    ({"search": "path", "filter": "km lt 10"}, both(has("path"), lambda w: w["km"] < 10)), ({"filter": "grade ge 4 or grade eq null"}, lambda w: w["grade"] is None or w["grade"] >= 4),
    ({"filter": "region/land eq 'Powys' and stops/any(s: s/hut/beds gt 10)"}, lambda w: (w["region"] or {}).get("land") == "Powys"), ({"filter": "stops/all(s: s/hut/open eq true)"}, lambda w: all((s["hut"] or {}).get("open") for s in w["stops"])),
    ({"filter": "region/valleys/any(v: v eq 'Elan')"}, lambda w: "Elan" in (w["region"] or {}).get("valleys", [])), ({"search": "house Mickleden"}, lambda w: any(s["place"] in ("Weir House", "Mickleden") for s in w["stops"])),
]


@pytest.mark.parametrize(("request_", "test"), CASES, ids=[str(r) for r, _ in CASES])
def test_search(engine, indexed, request_, test):
    """The same documents, order and scores with a text index and without."""
    rows = {}
    for own in (None, indexed):
        engine.texts.pop("walks", None)
        if own:
            engine.texts["walks"] = own
        rows[own] = [(r["walk"], round(r["@search.score"], 9)) for r in engine.search("walks", request_).hits.collect()]
    engine.texts.pop("walks", None)
    assert sorted(n for n, _ in rows[None]) == [n for n, w in BY.items() if test(w)] and rows[None] == rows[indexed]


def test_pages(engine):
    rising = sorted(BY, key=lambda n: (BY[n]["km"], str(n)))
    request, seen = {"orderby": "km asc", "top": 3}, []
    while request:
        page = engine.search("walks", request)
        seen.append([r["walk"] for r in page.hits.collect()])
        assert (page.next_link("walks", "1") is None) == (page.next_page is None)
        request = page.next_page
    assert seen == [rising[:3], rising[3:6], rising[6:]]
    assert found(engine, {"orderby": "grade desc,km asc", "skip": 1, "top": 2}) == [15, 16] and found(engine, {"top": 0}) == []
    assert found(engine, {"orderby": "grade asc", "top": 1}) == [17]  # nulls come first when rising
    for token in ("?", "e30="):
        with pytest.raises(SearchError):
            engine.search("walks", {"token": token})


@pytest.mark.parametrize("bad", [{"search": 'the "tarn'}, {"search": "tarn~7"}, {"search": "- "}, {"search": "depth:3", "queryType": "full"}, {"search": "tarn)", "queryType": "full"}, {"orderby": "report"}, {"select": "region/county"}, {"facets": ["km"]}, {"skip": -2}, {"searchMode": "most"}, {"scoringParameters": ["x"]}])
def test_refused(engine, bad):
    with pytest.raises(SearchError):
        engine.search("walks", bad)


def test_facets_and_boosts(engine):
    got = engine.search("walks", {"filter": "km gt 6", "facets": ["stops/place,count:1", "region/land", "region/valleys", "grade"]}).facets
    rows = {k: [tuple(r) for r in v.collect()] for k, v in got.items()}
    far = [w for w in WALKS if w["km"] > 6]
    assert rows["stops/place"] == [("Brackenrigg", 2)] and dict(rows["region/land"]) == {"Cumbria": 2, "Powys": 1, "Devon": 1, "Yorkshire": 1}
    assert sum(n for _, n in rows["region/valleys"]) == sum(len(w["region"]["valleys"]) for w in far if w["region"]) and dict(rows["grade"]) == {1: 2, 5: 2, 3: 1, 4: 1}
    plain, double = ({r["walk"]: r["@search.score"] for r in engine.search("walks", {"search": "rain", "searchFields": s}).hits.collect()} for s in ("report", "report^2"))
    assert plain.keys() == double.keys() == {11, 15} and all(abs(double[k] - 2 * plain[k]) < 1e-9 for k in plain)


def test_nested_selection(engine):
    rows = {r["walk"]: r for r in engine.search("walks", {"select": "walk,region/land,stops/hut/beds"}).hits.collect()}
    for n, w in BY.items():
        assert (rows[n]["region"] and rows[n]["region"].asDict()) == (w["region"] and {"land": w["region"]["land"]})
        assert [s["hut"]["beds"] for s in rows[n]["stops"] or ()] == [s["hut"]["beds"] for s in w["stops"] if s["hut"]]  # objects with nothing of what is asked for go


def test_bearings(engine):
    far = lambda n, v: sum((a - b) ** 2 for a, b in zip(BY[n]["bearing"], v)) ** 0.5
    near = lambda v, k, ok=lambda w: True: sorted((n for n, w in BY.items() if w["bearing"] and ok(w)), key=lambda n: far(n, v))[:k]
    q = {"fields": "bearing", "vector": [1.0, 0.2], "k": 3}
    got = engine.search("walks", {"vectorQueries": [q]}).hits.collect()
    assert [r["walk"] for r in got] == near(q["vector"], 3) and all(abs(r["@search.score"] - 1 / (1 + far(r["walk"], q["vector"]))) < 1e-6 for r in got)
    steep = lambda w: (w["grade"] or 0) >= 4
    assert found(engine, {"vectorQueries": [q], "filter": "grade ge 4"}) == [n for n in near(q["vector"], 3) if steep(BY[n])]
    assert found(engine, {"vectorQueries": [q], "filter": "grade ge 4", "vectorFilterMode": "preFilter"}) == near(q["vector"], 3, steep)
    # ranks of words and of vectors are fused
    words = [r["walk"] for r in engine.search("walks", {"search": "rain"}).hits.collect()]
    mixed = {}
    for weight, ranked in ((1, words), (2, near(q["vector"], 3))):
        for k, n in enumerate(ranked, 1):
            mixed[n] = mixed.get(n, 0) + weight / (60 + k)
    got = engine.search("walks", {"search": "rain", "vectorQueries": [q | {"weight": 2}]}).hits.collect()
    assert [r["walk"] for r in got] == sorted(mixed, key=lambda n: (-mixed[n], str(n))) and all(abs(r["@search.score"] - mixed[r["walk"]]) < 1e-9 for r in got)
    for bad in (q | {"k": 1001}, q | {"vector": [1.0, 2.0, 3.0]}, q | {"fields": "route"}, q | {"weight": -1}):
        with pytest.raises(SearchError):
            engine.search("walks", {"vectorQueries": [bad]})


def spoken(w):
    return [x for t in (w["route"], *[s["place"] for s in w["stops"]]) for x in (t or "").split()]


@pytest.fixture(params=["read", "looked up"])
def suggesting(engine, request, made=[]):  # noqa: B006
    """With a word index and without."""
    engine.words.pop("walks", None)
    if request.param == "looked up":
        made = made or [engine.index_words("walks")]
        engine.words["walks"] = made[0]
    yield engine
    engine.words.pop("walks", None)


def test_suggestions(suggesting):
    engine = suggesting
    ask = lambda **more: [(r["walk"], r["@search.text"]) for r in engine.suggest("walks", {"suggesterName": "names", "top": 20} | more).collect()]
    want = lambda part: [(n, next(x for x in spoken(w) if part in x.lower())) for n, w in BY.items() if any(part in x.lower() for x in spoken(w))]
    assert ask(search="TAR") == want("tar") and ask(search="eir") == want("eir") and ask(search="path") == want("path")
    assert ask(search="mickledan", fuzzy=True) == [(13, "Mickleden")] and ask(search="mickledan") == []
    assert ask(search="hide", highlightPreTag="[", highlightPostTag="]") == [(17, "[Hide]")] and ask(search="rid", highlightPreTag="[", highlightPostTag="]") == [(11, "[Rid]ge")]
    assert ask(search="brack ridge") == [(11, "Brackenrigg")] and ask(search="path", filter="km gt 20") == [(14, "path")]


def test_completions(suggesting):
    engine = suggesting
    ask = lambda search, mode: [(r["text"], r["queryPlusText"]) for r in engine.autocomplete("walks", {"suggesterName": "names", "search": search, "autocompleteMode": mode, "top": 20}).collect()]
    each = list(dict.fromkeys(x for w in WALKS for x in spoken(w) if "ro" in x.lower()))
    assert [t for t, _ in ask("ro", "oneTerm")] == each
    assert ask("weir h", "twoTerms") == [("Weir House", "Weir House")] and ask("ho", "twoTerms") == ask("ho", "oneTerm")
    assert ask("tarn br", "twoTerms") == [("tarn Brackenrigg", "tarn Brackenrigg")]  # from one field to the next
    assert ask("herons ree", "oneTermWithContext") == [("Reed", "herons Reed")]
    for bad in ({"suggesterName": "none", "search": "x"}, {"suggesterName": "names", "search": " "}, {"suggesterName": "names", "search": "x", "searchFields": "report"}):
        with pytest.raises(SearchError):
            engine.suggest("walks", bad)


@pytest.mark.parametrize("clauses", ["grade asc", "grade desc", "region/land desc,grade asc", "km desc", "walk desc", "", "grade asc,km desc,region/land asc"])
def test_every_page_goes_on_where_the_last_one_ended(engine, clauses):
    """Pages of each size, over nulls and ties, make up the whole order, and no page but the first skips rows."""
    base = {"orderby": clauses} if clauses else {"search": "rain path rock tarn weir"}
    whole = found(engine, base)
    for size in (2, 5):
        request, seen, plans = base | {"top": size}, [], []
        while request:
            page = engine.search("walks", request)
            seen += [r["walk"] for r in page.hits.collect()]
            plans.append(page.hits._jdf.queryExecution().optimizedPlan().toString())
            request = page.next_page
        assert seen == whole and not any("Offset" in p for p in plans)


def test_a_page_starts_in_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS no", "cast(id % 10 AS double) AS v").write.parquet(str(tmp_path / "t"))
    e = SearchEngine(spark)
    e.create_index({"name": "t", "fields": [f("no", "Edm.Int64", "KFO"), f("v", "Edm.Double", "FO")]}, spark.read.parquet(str(tmp_path / "t")))
    page = e.search("t", {"orderby": "v desc", "top": 250})
    second = e.search("t", page.next_page)
    rows = [(r["no"], r["v"]) for r in page.hits.collect() + second.hits.collect()]
    assert rows == sorted(((i, float(i % 10)) for i in range(1000)), key=lambda r: (-r[1], str(r[0])))[:500]
    assert "LessThanOrEqual(v,7.0)" in second.hits._jdf.queryExecution().executedPlan().toString()


def test_a_word_index_takes_batches(spark):
    e = SearchEngine(spark)
    e.create_index(SPEC)
    e.index_documents("walks", WALKS)
    own = e.index_words("walks")
    e.index_documents("walks", [{"@search.action": "delete", "walk": 12}, {"@search.action": "merge", "walk": 14, "route": "Tarnished rails"}, walk(99, "Reservoir road", None, 1.0, 1, stops=[("Rail Bridge", None)])])
    plain = SearchEngine(spark)
    plain.create_index(SPEC, e.data["walks"])
    for search in ("tarn", "reserv", "rail", "path", "rai bri", "zzz", "e"):
        asked = [{"search": search, "suggesterName": "names", "top": 30, "fuzzy": fuzzy} for fuzzy in (False, True)]
        assert [[(r["walk"], r["@search.text"]) for r in e.suggest("walks", q).collect()] for q in asked] == [[(r["walk"], r["@search.text"]) for r in plain.suggest("walks", q).collect()] for q in asked], search
        for mode in ("oneTerm", "twoTerms"):
            q = asked[0] | {"autocompleteMode": mode}
            assert list(map(tuple, e.autocomplete("walks", q).collect())) == list(map(tuple, plain.autocomplete("walks", q).collect()))
    assert sorted(map(tuple, own.held.read("terms").groupBy("path", "term").sum("documents").where("`sum(documents)` > 0").collect())) == sorted(map(tuple, plain.index_words("walks").held.read("terms").select("path", "term", "documents").collect()))
    plan = e.suggest("walks", {"search": "tarn", "suggesterName": "names"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(low,tarn)" in plan or "In(low, [tarn" in plan
