"""Filters against the rules in plain Python, and fixture cases."""

from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek import schema
from lodeseek.errors import SearchError
from lodeseek.functions import filters

SPEC = {
    "name": "mixed",
    "fields": [
        {"name": "id", "type": "Edm.String", "key": True, "filterable": True}, {"name": "s", "type": "Edm.String", "filterable": True}, {"name": "n", "type": "Edm.Double", "filterable": True},
        {"name": "b", "type": "Edm.Boolean", "filterable": True}, {"name": "tags", "type": "Collection(Edm.String)", "filterable": True}, {"name": "d", "type": "Edm.DateTimeOffset", "filterable": True},
        {"name": "hidden", "type": "Edm.String"}, {"name": "rooms", "type": "Collection(Edm.ComplexType)", "filterable": True, "fields": [{"name": "kind", "type": "Edm.String", "filterable": True}, {"name": "rate", "type": "Edm.Double", "filterable": True}]},
    ],
}
INDEX = schema.parse(SPEC)
ROWS = [
    ("1", "abc", 1.0, True, ["red", "blue"], "2024-03-08T11:22:33Z", None, [("suite", 300.0), ("basic", 80.0)]),
    ("2", "", -2.5, False, [], "2023-11-05T06:00:00Z", None, []),
    ("3", None, None, None, None, None, None, None),
    ("4", "Abc  ", 10.0, True, ["green", None], "2024-01-31", None, [("basic", None)]),
    ("5", "xyz", 1.0, None, ["red"], "no date", None, [("attic", 80.0)]),
    ("6", "été", 0.0, False, ["", ""], "2024-12-30T23:59:59.999Z", None, [(None, 10.0)]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, INDEX.schema()).cache()


def ids(docs, text):
    return "".join(sorted(r["id"] for r in docs.where(filters.compile_filter(text, INDEX, docs.schema)).collect()))


@pytest.mark.parametrize(
    "text,want",
    [
        ("n ge 1", "145"), ("n lt 0 or n gt 5", "24"), ("not (n lt 5)", "34"), ("s eq null", "3"), ("s ne null", "12456"), ("s ne 'abc'", "23456"), ("s ne 5", "3"), ("s gt 5", ""), ("5 lt n", "4"),
        ("b eq true", "14"), ("not (b eq true)", "2356"), ("b ne true", "2356"), ("tags eq 'red'", "15"), ("tags ne 'red'", "2346"), ("tags eq null", "34"), ("tags ne 7", "123456"),
        ("s in ('abc', 'xyz')", "15"), ("s in (null, 'abc')", "13"), ("tags in ('blue','green')", "14"), ("startswith(s, 'ab')", "1"), ("endswith(s,'  ')", "4"), ("contains(tags, 'e')", "145"),
        ("length(s) eq 3", "156"), ("indexof(s, 'c') eq 2", "14"), ("indexof(s,'q') eq -1", "12456"), ("substring(s, 1) eq 'bc'", "1"), ("substring(s, 0, 1) eq 'x'", "5"), ("substring(s, 9) eq ''", "12456"),
        ("substring(s,-1,2) eq ''", "12456"), ("tolower(s) eq 'abc  '", "4"), ("trim(s) eq 'Abc'", "4"), ("toupper(s) eq 'ÉTÉ'", "6"), ("length(s) ne null", "12456"), ("length(s) eq null", ""), ("length(s) eq 'x'", ""),
        ("year(d) eq 2024", "146"), ("datepart('week', d) eq 1", "6"), ("datepart(dayofweek, d) eq 5", "1"), ("month(d) lt 4", "14"), ("date(d) eq '2024-01-31T00:00:00.000Z'", "4"), ("date(d) eq '2024-01-31'", ""),
        ("time(d) eq '0001-01-01T06:00:00.000Z'", "2"), ("dateadd(month, 1, d) eq '2024-02-29T00:00:00.000Z'", "4"), ("datediff(month, d, utcdatetime('2024-03-01')) eq 2", "4"),
        ("datediff(year, utcdatetime('2024-02-01'), d) eq -1", "24"), ("datediff(day, utcdatetime('2024-01-01'), d) eq 29", ""), ("datediff(day, utcdatetime('2024-01-01'), d) eq 30", "4"),
        ("d gt utcdatetime('2024-02-01')", "16"), ("utcdatetime('2024-02-01') gt d", "24"), ("d lt now()", "1246"), ("d gt '2024-02-01'", "156"), ("rooms/any(r: r/rate ge 80)", "15"), ("rooms/all(r: r/rate ge 80)", "125"),
        ("rooms any r r/kind eq 'basic'", "14"), ("tags/any(t: t eq 'red')", "15"), ("tags/all(t: t ne 'red')", "246"), ("rooms/kind eq 'basic'", "14"), ("rooms/rate lt 50", "6"), ("rooms/kind ne 'basic'", "2356"),
        ("search.ismatch('^A', s)", "14"), ("search.ismatchscoring('b|x', 's, tags')", "145"), ("search.isempty(s)", "23"), ("search.isempty(tags)", "236"), ("search.isnull(tags)", "34"), ("s eq 'it''s'", ""), ("n eq 1e0 and s ge 'b'", "5"),
    ],
)
def test_filter(docs, text, want):
    assert ids(docs, text) == want


@pytest.mark.parametrize(
    "text",
    [
        "x eq 1", "hidden eq 'a'", "n", "n eq", "n like 1", "(n eq 1", "n eq 1)", "b gt true", "length(n) eq 1", "year(s) eq 1", "startswith(n, 'a')", "search.ismatch('(', s)", "search.ismatch('a(?=b)', s)", "s/any(x: x eq 1)", "rooms/any(r: r eq 1)",
        "rooms/any(r: r/none eq 1)", "tags/any(t: u eq 1)", "datepart('era', d) eq 1", "utcdatetime('soon') lt d", "s eq 'open", "foo(s) eq 1", "n eq 1 and", "rooms gt 1",
    ],
)
def test_refused(text):
    with pytest.raises(SearchError) as e:
        filters.compile_filter(text, INDEX)
    assert e.value.code == "InvalidQuery" and e.value.status == 400


def test_now_is_fixed_at_parsing():
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert filters.parse("d lt now()", at).args[2] == filters.Instant(at)


# random filters against the rules, row by row

LEAF = st.one_of(
    st.tuples(st.just("n"), st.sampled_from(filters.OPS), st.sampled_from([None, 1.0, 0.0, -2.5, "abc"])),
    st.tuples(st.just("s"), st.sampled_from(filters.OPS), st.sampled_from([None, "abc", "", "xyz", 1.0])),
    st.tuples(st.just("tags"), st.sampled_from(("eq", "ne", "gt")), st.sampled_from(["red", "", "green", 3.0])),
)
TREE = st.recursive(LEAF, lambda x: st.one_of(st.tuples(st.just("not"), x), st.tuples(st.sampled_from(("and", "or")), x, x)), max_leaves=5)


def show(t):
    if t[0] == "not":
        return f"not ({show(t[1])})"
    if t[0] in ("and", "or"):
        return f"({show(t[1])}) {t[0]} ({show(t[2])})"
    v = "null" if t[2] is None else f"'{t[2]}'" if isinstance(t[2], str) else str(t[2])
    return f"{t[0]} {t[1]} {v}"


def plain(t, row):
    if t[0] == "not":
        return not plain(t[1], row)
    if t[0] in ("and", "or"):
        return (all if t[0] == "and" else any)(plain(x, row) for x in t[1:])
    name, op, v = t
    x = row[name]
    test = lambda y: type(y) is type(v) and {"eq": y == v, "ne": y != v, "gt": y > v, "ge": y >= v, "lt": y < v, "le": y <= v}[op]
    if name == "tags":
        hit = any(test(y) if op != "ne" else y == v for y in x or () if y is not None)
        return not hit if op == "ne" else hit
    if v is None:
        return op == "eq" and x is None or op == "ne" and x is not None
    if x is None:
        return op == "ne"
    return test(x)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TREE, min_size=8, max_size=8))
def test_random_filters(docs, trees):
    cols = [filters.compile_filter(show(t), INDEX, docs.schema).alias(f"t{i}") for i, t in enumerate(trees)]
    for r in docs.select("n", "s", "tags", *cols).collect():
        for i, t in enumerate(trees):
            assert r[f"t{i}"] is plain(t, r.asDict()), show(t)


TYPED = schema.parse({"name": "typed", "fields": [
    {"name": "id", "type": "Edm.String", "key": True, "filterable": True}, {"name": "s", "type": "Edm.String", "filterable": True}, {"name": "n", "type": "Edm.Double", "filterable": True},
    {"name": "k", "type": "Edm.Int64", "filterable": True}, {"name": "b", "type": "Edm.Boolean", "filterable": True}, {"name": "at", "type": "Edm.DateTimeOffset", "filterable": True},
]})


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("typed") / "x")
    rows = [("a", "abc", 1.5, 2**62 + 1, True, "2023-05-06 07:08:09.0101"), ("b", None, None, None, None, None), ("c", "b", 2.0, 5, False, "2023-05-06 07:08:09.0109"), ("d", "abd", 0.0, -7, True, "2021-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id string, s string, n double, k long, b boolean, at string")
    df.withColumn("at", F.to_timestamp("at")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "text,pushed,want",
    [
        ("n ge 1", "GreaterThanOrEqual(n,1.0)", "ac"), ("k gt 4", "GreaterThan(k,4)", "ac"), ("k eq 4611686018427387905", "EqualTo(k,4611686018427387905)", "a"), ("k eq 4611686018427387904", "EqualTo(k", ""),
        ("k gt 4.5", "GreaterThanOrEqual(k,5)", "ac"), ("k le 4.5", "LessThanOrEqual(k,4)", "d"), ("s eq 'abc'", "EqualTo(s,abc)", "a"), ("s ne 'abc'", "IsNull(s)", "bcd"), ("s in ('b', 'abd')", "In(s", "cd"), ("s in (null, 'b')", "IsNull(s)", "bc"),
        ("startswith(s, 'ab')", "StringStartsWith(s,ab)", "ad"), ("contains(s, 'b')", "StringContains(s,b)", "acd"), ("b eq true", "EqualTo(b,true)", "ad"), ("k eq null", "IsNull(k)", "b"), ("n lt 1 or s eq 'b'", "Or(LessThan(n,1.0),EqualTo(s,b))", "cd"),
        ("at gt utcdatetime('2022-01-01')", "GreaterThanOrEqual(at,", "ac"), ("at eq utcdatetime('2023-05-06T07:08:09.010Z')", "GreaterThanOrEqual(at,", "ac"), ("at le utcdatetime('2023-05-06T07:08:09.009Z')", "LessThan(at,", "d"), ("at ne null", "IsNotNull(at)", "acd"),
        ("not (k gt 4)", "", "bd"), ("k eq 4.5", "", ""), ("k ne 4.5", "", "abcd"), ("k lt 1e30", "", "acd"), ("not (s ne 'abc')", "", "a"), ("at ne utcdatetime('2021-01-01')", "", "abc"),
    ],
)
def test_filters_reach_the_scan(typed, text, pushed, want):
    found = typed.where(filters.compile_filter(text, TYPED, typed.schema, bare=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.partition("PushedFilters")[2]  # a filter that nothing passes has no scan
    assert "".join(sorted(r["id"] for r in found.collect())) == want
    assert "".join(sorted(r["id"] for r in typed.where(filters.compile_filter(text, TYPED, typed.schema)).collect())) == want
