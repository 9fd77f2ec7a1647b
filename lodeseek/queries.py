"""A query for each operator over the provided tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analyzers, vectors
from .operators import facets
from .sources import tables
from .storage import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _engine(spark: SparkSession, sf_dir: str, index: str, request: dict):
    """Searches for words read the session's text index."""
    if request.get("search") in (None, "", "*"):
        return tables.engine(spark, sf_dir, index)
    spec, table, load = {"docs": (tables.DOCS, "documents", tables.docs), "parts": (tables.PARTS, "part", lambda s, d: tables.read(s, d, "part"))}[index]
    return tables.text_engine(spark, sf_dir, spec, table, load, request.get("queryType") == "semantic")


def _hits(index: str, request: dict, *columns: str, score: bool = False) -> Query:
    """The hits of a request: columns, and the score to six digits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _engine(spark, sf_dir, index, request).search(index, request).hits
        out = [F.col(c) for c in columns]
        return found.select(*out, *([F.round("`@search.score`", 6).alias("score")] if score else []))

    return run


DOCS = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
ORDERS = "(SELECT o.*, (SELECT list({'q': l_quantity, 'd': l_discount, 'r': l_returnflag, 's': l_linestatus} ORDER BY l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey) AS ln FROM orders o)"
CUSTOMERS = "(SELECT c.*, n_name, r_name FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"
EVENT_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_ms(ts) % 1000)::VARCHAR, 3, '0') || 'Z'"


def _filter(name: str, index: str, text: str, where: str) -> None:
    """A filter query that returns the keys that pass."""
    key, source = {
        "docs": ("doc_id", DOCS), "events": ("event_id", "events"), "parts": ("p_partkey", "part"), "orders": ("o_orderkey", ORDERS), "customers": ("c_custkey", CUSTOMERS),
        "sales": ("o_orderkey", "orders"),
    }[index]
    _add(name, _hits(index, {"filter": text}, key), f"SELECT {key} FROM {source} AS t WHERE {where}")


# scans, sources, projection, ordering
_add("s01_scan", _hits("parts", {}, "p_partkey", "p_name", "p_size"), "SELECT p_partkey, p_name, p_size FROM part")
_add(
    "s02_point_lookup", lambda s, d: tables.engine(s, d, "docs").get_document("docs", "42").select("doc_id", "lang", "n_chars"), "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42"
)
_add("s03_count", lambda s, d: tables.engine(s, d, "docs").count("docs"), "SELECT count(*) AS count FROM documents")
_add("s13_statistics", lambda s, d: tables.engine(s, d, "parts", "events").statistics().select("name", "documents"), "SELECT 'events' AS name, count(*) AS documents FROM events UNION ALL SELECT 'parts', count(*) FROM part")
_add(
    "p01_select_order_top",
    _hits("docs", {"filter": "lang eq 'en' and n_chars gt 500", "orderby": "n_chars desc", "select": "doc_id,lang,n_chars", "top": 20}, "doc_id", "lang", "n_chars"),
    "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY n_chars DESC, doc_id::VARCHAR LIMIT 20",
)
_add(
    "p02_nested_select", lambda s, d: tables.engine(s, d, "customers").search("customers", {"select": "c_custkey,Address/Region"}).hits.select("c_custkey", F.col("Address.Region").alias("region")),
    f"SELECT c_custkey, r_name AS region FROM {CUSTOMERS} t",
)
_add(
    "p02_nested_array_select",
    lambda s, d: tables.engine(s, d, "orders").search("orders", {"select": "o_orderkey,Lines/returnflag"}).hits.select("o_orderkey", F.concat_ws("", F.col("Lines.returnflag")).alias("flags")),
    f"SELECT o_orderkey, coalesce(list_aggregate(list_transform(ln, lambda x: x.r), 'string_agg', ''), '') AS flags FROM {ORDERS} t",
)
_add(
    "o02_nulls", _hits("docs", {"orderby": "quality asc,n_chars desc", "select": "doc_id,quality", "top": 50}, "doc_id", "quality"),
    f"SELECT doc_id, quality FROM {DOCS} t ORDER BY quality ASC NULLS FIRST, n_chars DESC NULLS LAST, doc_id::VARCHAR LIMIT 50",
)
_add(
    "l01_skip_top", _hits("docs", {"orderby": "source desc", "skip": 30, "top": 25}, "doc_id"), "SELECT doc_id FROM documents ORDER BY source DESC NULLS LAST, doc_id::VARCHAR LIMIT 25 OFFSET 30"
)


def _second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.engine(spark, sf_dir, "docs")
    request = {"filter": "lang eq 'fr'", "orderby": "n_chars asc", "top": 15}
    token = e.search("docs", request).next_token
    return e.search("docs", {"token": token, "top": 15}).hits.select("doc_id")


_add("l02_continuation", _second_page, "SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY n_chars ASC NULLS FIRST, doc_id::VARCHAR LIMIT 15 OFFSET 15")

# filters
_filter("f01_boolean", "docs", "(lang eq 'en' or lang eq 'fr') and not (n_chars lt 1000)", "lang IN ('en', 'fr') AND n_chars >= 1000")
_filter("f02_eq_null", "docs", "quality eq null", "quality IS NULL")
_filter("f02_ne_missing", "docs", "quality ne 1", "quality IS NULL OR quality <> 1")
_filter("f02_not_missing", "docs", "not (quality ge 1)", "NOT coalesce(quality >= 1, false)")
_filter("f02_mismatch", "docs", "lang ne 7 or lang eq 'es'", "lang = 'es'")
_filter("f02_mismatch_not", "docs", "not (lang ne 7) and lang eq 'en'", "lang = 'en'")
_filter("f02_fraction", "docs", "n_chars gt 1000.5 and n_chars le 20000.25", "n_chars > 1000 AND n_chars <= 20000")
_filter("f03_collection_eq", "orders", "Lines/returnflag eq 'R'", "len(list_filter(ln, lambda x: x.r = 'R')) > 0")
_filter("f03_collection_ne", "orders", "Lines/returnflag ne 'R'", "ln IS NULL OR len(list_filter(ln, lambda x: x.r = 'R')) = 0")
_filter("f03_collection_order", "orders", "Lines/quantity gt 49", "len(list_filter(ln, lambda x: x.q > 49)) > 0")
_filter("f04_in", "docs", "lang in ('de', 'es')", "lang IN ('de', 'es')")
_filter("f04_in_null", "docs", "quality in (0, null)", "quality = 0 OR quality IS NULL")
_filter("f05_startswith", "docs", "startswith(source, 'src1')", "starts_with(source, 'src1')")
_filter("f05_endswith", "docs", "endswith(source, '7')", "suffix(source, '7')")
_filter("f05_contains", "docs", "contains(text, 'Th')", "contains(text, 'Th')")
_filter("f06_length", "docs", "length(text) gt 2000", "length(text) > 2000")
_filter("f07_indexof", "docs", "indexof(text, 'the') ge 10", "instr(text, 'the') - 1 >= 10")
_filter("f08_substring", "docs", "substring(source, 3, 1) eq '1'", "substring(source, 4, 1) = '1'")
_filter("f08_substring_negative", "docs", "substring(source, -1) eq '' and lang eq 'fr'", "lang = 'fr'")
_filter("f08_substring_negative_ne", "docs", "substring(source, -1, 2) ne '' or lang eq 'fr'", "lang = 'fr'")
_filter("f09_case", "docs", "toupper(lang) eq 'EN' and tolower(lang) eq 'en' and trim(lang) eq 'en'", "lang = 'en'")
_filter("f10_function_null", "docs", "length(text) ne null and lang eq 'de'", "lang = 'de'")
_filter("f10_function_null_not", "docs", "not (length(text) ne null) or lang eq 'de'", "lang = 'de'")
for _part, (_index, _least) in {
    "year": ("sales", 1998), "quarter": ("sales", 3), "month": ("sales", 4), "week": ("sales", 20), "dayofyear": ("sales", 200), "day": ("events", 12), "hour": ("events", 4), "minute": ("events", 4), "second": ("events", 4),
    "dayofweek": ("events", 4),
}.items():
    _at = "o_orderdate" if _index == "sales" else "ts"
    _filter(f"f11_datepart_{_part}", _index, f"datepart('{_part}', {_at}) ge {_least}", f"{'weekofyear' if _part == 'week' else _part}({_at}) >= {_least}")
_filter("f12_year_month", "sales", "year(o_orderdate) eq 1997 and month(o_orderdate) lt 6", "year(o_orderdate) = 1997 AND month(o_orderdate) < 6")
_filter("f13_date", "events", "date(ts) le '2024-01-15T00:00:00.000Z'", "strftime(ts, '%Y-%m-%dT00:00:00.000Z') <= '2024-01-15T00:00:00.000Z'")
_filter("f13_time", "events", "time(ts) ge '0001-01-01T12:00:00.000Z'", "ts::TIME >= TIME '12:00:00'")
_filter("f14_dateadd", "events", "dateadd(month, 1, ts) lt utcdatetime('2024-02-15')", "ts + INTERVAL 1 MONTH < TIMESTAMP '2024-02-15'")
_filter("f14_dateadd_clamp", "events", "dateadd(month, 1, ts) ge utcdatetime('2024-02-29')", "ts + INTERVAL 1 MONTH >= TIMESTAMP '2024-02-29'")
_filter("f15_datediff_month", "sales", "datediff(month, utcdatetime('1998-01-31'), o_orderdate) ge 2", "(year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 1 >= 2")
_filter("f15_datediff_year", "sales", "datediff(year, utcdatetime('1998-06-15'), o_orderdate) lt 0", "floor(((year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 6) / 12) < 0")
_filter("f15_datediff_day", "events", "datediff(day, utcdatetime('2024-01-01'), ts) gt 20", "trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) > 20")
_filter("f16_utcdatetime", "events", "utcdatetime('2024-01-20T06:00:00Z') le ts", "ts >= TIMESTAMP '2024-01-20 06:00:00'")
_filter("f16_equal_to_the_millisecond", "events", "ts eq utcdatetime('2024-01-01T00:00:07.179Z') or ts lt utcdatetime('2024-01-01T00:03:52.825Z')", "date_trunc('millisecond', ts) = TIMESTAMP '2024-01-01 00:00:07.179' OR date_trunc('millisecond', ts) < TIMESTAMP '2024-01-01 00:03:52.825'")
_filter("f17_now", "sales", "dateadd(year, 27, o_orderdate) lt now()", "o_orderdate + INTERVAL 27 YEAR < now()::TIMESTAMP")
_filter("f18_any_space", "orders", "Lines any l l/discount gt 0.09", "len(list_filter(ln, lambda x: x.d > 0.09)) > 0")
_filter("f19_any", "orders", "Lines/any(l: l/quantity le 2)", "len(list_filter(ln, lambda x: x.q <= 2)) > 0")
_filter("f19_all", "orders", "Lines/all(l: l/linestatus eq 'O')", "ln IS NOT NULL AND len(list_filter(ln, lambda x: x.s <> 'O')) = 0")
_filter("f20_ismatch", "docs", "search.ismatch('th(an|at)\\b', text)", "regexp_matches(text, '(?i)th(an|at)\\b')")
_filter("f21_isempty", "docs", "search.isempty(quality)", "quality IS NULL")
_filter("f22_isnull", "docs", "not search.isnull(toxic)", "toxic IS NOT NULL")
_filter("f03_path", "customers", "Address/Region eq 'ASIA' and c_acctbal gt 0", "r_name = 'ASIA' AND c_acctbal > 0")

# full text
TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: octet_length(encode(x)) < 40)"


def _bm25(words: list[str], mode: str = "any", where: str = "true", never: str | None = None, boost: float = 1.0, least: int = 1) -> str:
    """The score of words over documents; statistics come before where."""
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(words)))
    tf = ", ".join(f"len(list_filter(tok, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * 2.2 * tf{i} / (tf{i} + 1.2 * 0.25 + dl * 1.2 * 0.75 / avgdl) ELSE 0 END" for i in range(len(words)))
    hits = " + ".join(f"(tf{i} > 0)::INT" for i in range(len(words)))
    need = len(words) if mode == "all" else least
    out = f"AND NOT list_contains(tok, '{never}')" if never else ""
    return f"""
WITH t AS (SELECT doc_id, lang, text, {TOKENS} AS tok FROM documents),
f AS (SELECT doc_id, lang, text, tok, len(tok) AS dl, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM f)
SELECT doc_id, round(({score}) * {boost}, 6) AS score FROM f, s WHERE ({hits}) >= {need} {out} AND {where}"""


_add("t01_term", _hits("docs", {"search": "avec", "searchFields": "text"}, "doc_id", score=True), _bm25(["avec"]))
_add("t02_any", _hits("docs", {"search": "tion eres von", "searchFields": "text"}, "doc_id", score=True), _bm25(["tion", "eres", "von"]))
_add("t02_all", _hits("docs", {"search": "tion with", "searchMode": "all", "searchFields": "text"}, "doc_id", score=True), _bm25(["tion", "with"], "all"))
_add("t02_excluded", _hits("docs", {"search": "tion -with", "searchFields": "text"}, "doc_id", score=True), _bm25(["tion"], never="with"))
_add("t03_several_tokens", _hits("docs", {"search": "tion-with", "searchFields": "text"}, "doc_id", score=True), _bm25(["tion", "with"]))
_add("t04_boost", _hits("docs", {"search": "der und", "searchFields": "text^2.5"}, "doc_id", score=True), _bm25(["der", "und"], boost=2.5))
_add(
    "t05_phrase", _hits("docs", {"search": '"of the"', "searchFields": "text"}, "doc_id", score=True),
    f"""
WITH f AS (SELECT doc_id, tok, len(tok) AS dl, list_contains(tok, 'of')::INT AS h0, list_contains(tok, 'the')::INT AS h1,
  len(list_filter(range(1, len(tok)), lambda i: tok[i] = 'of' AND tok[i + 1] = 'the')) AS tf FROM (SELECT doc_id, {TOKENS} AS tok FROM documents)),
s AS (SELECT count(*) AS n, avg(dl) AS a, sum(h0) AS d0, sum(h1) AS d1 FROM f)
SELECT doc_id, round((ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5))) * 2.2 * tf / (tf + 0.3 + dl * 0.9 / a), 6) AS score FROM f, s WHERE tf > 0""",
)
_add("t06_fuzzy", _hits("docs", {"search": "thta~1", "searchFields": "text"}, "doc_id"), f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda x: damerau_levenshtein(x, 'thta') <= 1)) > 0")
_add("t08_stats_before_filter", _hits("docs", {"search": "tion", "searchFields": "text", "filter": "lang eq 'en'"}, "doc_id", score=True), _bm25(["tion"], where="lang = 'en'"))
_add("t09_match_all", _hits("docs", {"search": "*"}, "doc_id", score=True), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
_add("t13_coverage", _hits("docs", {"search": "tion with der", "searchFields": "text", "minimumCoverage": 0.6}, "doc_id", score=True), _bm25(["tion", "with", "der"], least=2))
_add("t14_full_and", _hits("docs", {"search": "text:tion AND text:with", "queryType": "full"}, "doc_id", score=True), _bm25(["tion", "with"], "all"))
_add("t14_full_not", _hits("docs", {"search": "text:tion NOT text:with", "queryType": "full"}, "doc_id", score=True), _bm25(["tion"], never="with"))
_add("t14_full_boost", _hits("docs", {"search": "text:der^3", "queryType": "full"}, "doc_id", score=True), _bm25(["der"], boost=3))
_add("t14_full_range", _hits("docs", {"search": "text:[zu TO zw]", "queryType": "full"}, "doc_id"), f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda x: x >= 'zu' AND x <= 'zw')) > 0")
_add("t15_prefix", _hits("docs", {"search": "text:einge*", "queryType": "full"}, "doc_id"), f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda x: starts_with(x, 'einge'))) > 0")
_add("t15_regex", _hits("docs", {"search": "text:/ein.?ge/", "queryType": "full"}, "doc_id"), f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda x: regexp_full_match(x, 'ein.?ge'))) > 0")


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a plural, in a text index of stems. The words of parts have no endings, so that in SQL stems are the words."""
    spec = tables.PARTS | {"fields": [{k: v for k, v in f.items() if k != "analyzer"} for f in tables.PARTS["fields"]]}
    e = tables.text_engine(spark, sf_dir, spec, "part", lambda s, d: tables.read(s, d, "part"))
    return e.search("parts", {"search": "reds", "searchFields": "p_name"}).hits.select("p_partkey")


_add("a01_english", _english, "SELECT p_partkey FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), 'red')")


def _ordered(index: str, request: dict, *columns: str) -> Query:
    """A page's rows with their places: the page is one partition, in order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _engine(spark, sf_dir, index, request).search(index, request).hits
        return found.select(*columns, F.monotonically_increasing_id().alias("place"))

    return run


_add(
    "o04_score_order", _ordered("docs", {"search": "avec", "searchFields": "text", "top": 30}, "doc_id"),
    f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR) - 1 AS place FROM ({_bm25(['avec'])}) ORDER BY place LIMIT 30",
)
_add(
    "o02_null_order", _ordered("docs", {"orderby": "quality asc,n_chars desc", "top": 60}, "doc_id"),
    f"SELECT doc_id, row_number() OVER (ORDER BY quality ASC NULLS FIRST, n_chars DESC NULLS LAST, doc_id::VARCHAR) - 1 AS place FROM {DOCS} t ORDER BY place LIMIT 60",
)
_add(
    "o02_null_order_falling", _ordered("docs", {"orderby": "quality desc,source asc", "top": 700}, "doc_id"),
    f"SELECT doc_id, row_number() OVER (ORDER BY quality DESC NULLS LAST, source ASC NULLS FIRST, doc_id::VARCHAR) - 1 AS place FROM {DOCS} t ORDER BY place LIMIT 700",
)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tables.text_engine(spark, sf_dir, tables.DOCS, "documents", tables.docs).texts["docs"]
    return text.terms().where("path = 'text'").select("term", "documents", "times")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tables.text_engine(spark, sf_dir, tables.DOCS, "documents", tables.docs).texts["docs"]
    rows = text.postings().where("path = 'text'")
    return rows.select(F.col("__key").cast("long").alias("doc_id"), "term", F.col("size").cast("long").alias("size"), F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


_add("s08_vocabulary", _vocabulary, f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS times FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
_add(
    "a11_positions", _positions,
    f"""SELECT doc_id, term, any_value(size) AS size, string_agg(place::VARCHAR, ' ' ORDER BY place) AS positions
FROM (SELECT doc_id, len(tok) AS size, unnest(tok) AS term, unnest(range(len(tok))) AS place FROM (SELECT doc_id, {TOKENS} AS tok FROM documents)) GROUP BY doc_id, term""",
)


def _synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import schema

    spec = tables.DOCS | {"fields": [f | {"synonymMaps": ["m"]} if f["name"] == "text" else f for f in tables.DOCS["fields"]]}
    e = tables.engine(spark, sf_dir)
    e.create_index(schema.parse(spec), tables.docs(spark, sf_dir))
    e.put_resource("synonymMap", "m", {"synonyms": "whither, avec\nfoo => bar"})
    return e.search("docs", {"search": "whither", "searchFields": "text"}).hits.select("doc_id")


_add("t12_synonyms", _synonyms, f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'avec') OR list_contains({TOKENS}, 'whither')")


def _analyzed(column: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = tables.read(spark, sf_dir, "part").select("p_partkey", F.posexplode(analyzers.column(F.col(column), name)).alias("pos", "token"))
        return made.select("p_partkey", F.col("pos").cast("long").alias("pos"), "token")

    return run


def _token_sql(expression: str) -> str:
    return f"SELECT p_partkey, unnest(range(len(tok))) AS pos, unnest(tok) AS token FROM (SELECT p_partkey, {expression} AS tok FROM part)"


_add("a02_keyword", _analyzed("p_name", "keyword"), _token_sql("[p_name]"))
_add("a03_whitespace", _analyzed("p_type", "whitespace"), _token_sql("regexp_extract_all(p_type, '\\S+')"))
_add("a04_alphanum", _analyzed("p_brand", "alphanum"), _token_sql("regexp_extract_all(p_brand, '[\\p{L}\\p{N}]+')"))
_add("a05_latin", _analyzed("p_type", "latin"), _token_sql("regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+')"))
_add("a06_ngram", _analyzed("p_brand", "ngram"), _token_sql("flatten(list_transform(range(1, length(p_brand) + 1), lambda i: list_transform(range(1, least(15, length(p_brand) - i + 1) + 1), lambda g: lower(substring(p_brand, i, g)))))"))
_add("a07_edge_ngram", _analyzed("p_name", "edgeNGram_v2"), _token_sql("list_transform(range(1, least(15, length(p_name)) + 1), lambda n: lower(p_name[1:n]))"))
_CJK = "零一二三四五六七八九"
_add(
    "a08_cjk",
    lambda s, d: tables.read(s, d, "part").select("p_partkey", F.posexplode(analyzers.column(F.concat(F.col("p_type"), F.translate(F.col("p_partkey").cast("string"), "0123456789", _CJK), F.lit(" end")), "chinese")).alias("pos", "token"))
    .select("p_partkey", F.col("pos").cast("long").alias("pos"), "token"),
    f"""SELECT p_partkey, unnest(range(len(tok))) AS pos, unnest(tok) AS token FROM (
SELECT p_partkey, list_concat(list_concat([p_type], CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END), ['end']) AS tok
FROM (SELECT p_partkey, p_type, translate(p_partkey::VARCHAR, '0123456789', '{_CJK}') AS r FROM part))""",
)
_add("a09_french", _analyzed("p_name", "fr"))  # stems have no SQL
_add("a09_language", _analyzed("p_name", "fi"), _token_sql("regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')"))

_add(
    "a10_analyze", lambda s, d: tables.read(s, d, "part").select("p_partkey", F.inline(analyzers.analyzed(F.col("p_name"), "whitespace"))),
    """SELECT p_partkey, tok[k] AS token, len(array_to_string(tok[1:k - 1], ' ')) + CASE WHEN k > 1 THEN 1 ELSE 0 END AS "startOffset",
  len(array_to_string(tok[1:k], ' ')) AS "endOffset", k - 1 AS position
FROM (SELECT p_partkey, tok, unnest(range(1, len(tok) + 1)) AS k FROM (SELECT p_partkey, string_split(p_name, ' ') AS tok FROM part))""",
)

# vectors
QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_LIST = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_E = "embedding::DOUBLE[]"


def _knn(metric: str, k: int = 10, **more) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = tables.engine(spark, sf_dir)
        e.create_index(tables.with_metric(metric), tables.read(spark, sf_dir, "embeddings"))
        found = e.search("vecs", {"vectorQueries": [{"fields": "embedding", "vector": QUERY, "k": k}], **more}).hits
        return found.select("vec_id", F.round("`@search.score`", 4).alias("score"))

    return run


def _knn_sql(score: str, k: int = 10, where: str = "true", after: str = "true") -> str:
    return f"SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, label, ({score})::FLOAT::DOUBLE AS s FROM embeddings WHERE {where} ORDER BY s DESC, vec_id::VARCHAR LIMIT {k}) WHERE {after}"


_COS, _DOT = f"list_cosine_similarity({_E}, {_LIST})", f"list_inner_product({_E}, {_LIST})"
_add("v01_cosine", _knn("cosine"), _knn_sql(_COS))
_add("v02_dot", _knn("dotProduct"), _knn_sql(_DOT))
_add("v03_euclidean", _knn("euclidean"), _knn_sql(f"1 / (1 + list_distance({_E}, {_LIST}))"))
_add("v04_top_100", _knn("cosine", 100), _knn_sql(_COS, 100))
_add("v10_post_filter", _knn("cosine", 20, filter="label eq 3"), _knn_sql(_COS, 20, after="label = 3"))
_add("v10_pre_filter", _knn("cosine", 20, filter="label eq 3", vectorFilterMode="preFilter"), _knn_sql(_COS, 20, "label = 3"))
_add("v08_text_vector", lambda s, d: tables.read(s, d, "part").select("p_partkey", vectors.embed(F.col("p_name"), 64).alias("v")))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector its ten nearest, by looking at all lists, and whether looking at few finds nine in ten of all these."""
    spec = tables.VECS | {"vectorSearch": {"algorithms": [{"name": "a", "kind": "hnsw"}], "profiles": [{"name": "p", "algorithm": "a"}]}}
    e = tables.engine(spark, sf_dir)
    e.create_index(spec, tables.read(spark, sf_dir, "embeddings"))
    lists = e.index_vectors("vecs", "embedding")
    asked = e.data["vecs"].where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    exact, some = (materialise(lists.nearest(asked, 10, n), "nearest") for n in (lists.n, 40))
    both = exact.join(some, ["query", "__key"], "left_semi").count()
    rows = exact.groupBy(F.col("query").alias("vec_id")).agg(F.array_join(F.sort_array(F.collect_list("__key")), " ").alias("nearest"))
    return rows.withColumn("recall_reached", F.lit(both >= 0.9 * exact.count()))


_add(
    "v05_lists", _lists,
    f"""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT q.vec_id, e.vec_id AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity({_E}, x)::FLOAT DESC, e.vec_id::VARCHAR) AS k FROM q, embeddings e)
SELECT vec_id, string_agg(other::VARCHAR, ' ' ORDER BY other::VARCHAR) AS nearest, true AS recall_reached FROM r WHERE k <= 10 GROUP BY vec_id""",
)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import schema

    spec = tables.VECS | {"name": "both", "fields": [*tables.VECS["fields"], {"name": "text", "type": "String", "searchable": True, "analyzer": "latin"}]}
    both = tables.read(spark, sf_dir, "embeddings").join(tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "full")
    e = tables.engine(spark, sf_dir)
    e.create_index(schema.parse(spec), both)
    found = e.search("both", {"search": "tion with", "vectorQueries": [{"fields": "embedding", "vector": QUERY, "k": 50, "weight": 2.0}]}).hits
    return found.select("vec_id", F.round("`@search.score`", 6).alias("score"))


_add(
    "h01_hybrid_rrf", _hybrid,
    f"""
WITH b AS (SELECT coalesce(vec_id, doc_id) AS vec_id, embedding, coalesce({TOKENS}, []) AS tok FROM embeddings FULL JOIN documents ON doc_id = vec_id),
f AS (SELECT vec_id, len(tok) AS dl, len(list_filter(tok, lambda x: x = 'tion')) AS t0, len(list_filter(tok, lambda x: x = 'with')) AS t1 FROM b),
s AS (SELECT count(*) AS n, avg(dl) AS a, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1 FROM f),
t AS (SELECT vec_id, CASE WHEN t0 > 0 THEN ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * 2.2 * t0 / (t0 + 0.3 + dl * 0.9 / a) ELSE 0 END
  + CASE WHEN t1 > 0 THEN ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * 2.2 * t1 / (t1 + 0.3 + dl * 0.9 / a) ELSE 0 END AS s FROM f, s WHERE t0 + t1 > 0),
v AS (SELECT vec_id, ({_COS})::FLOAT::DOUBLE AS s FROM b WHERE embedding IS NOT NULL ORDER BY s DESC, vec_id::VARCHAR LIMIT 50),
r AS (SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY round(s, 10) DESC, vec_id::VARCHAR)) AS x FROM t
  UNION ALL SELECT vec_id, 2.0 / (60 + row_number() OVER (ORDER BY s DESC, vec_id::VARCHAR)) FROM v)
SELECT vec_id, round(sum(x), 6) AS score FROM r GROUP BY vec_id""",
)


def _max_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.engine(spark, sf_dir, "vecs")
    two = [{"fields": "embedding", "vector": QUERY, "k": 8}, {"fields": "embedding", "vector": QUERY[::-1], "k": 8}]
    return e.search("vecs", {"vectorQueries": two}).hits.select("vec_id", F.round("`@search.score`", 4).alias("score"))


_UNION = f"""WITH a AS (SELECT vec_id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id::VARCHAR LIMIT 8),
b AS (SELECT vec_id, list_cosine_similarity({_E}, list_reverse({_LIST})) AS s FROM embeddings ORDER BY s DESC, vec_id::VARCHAR LIMIT 8)
SELECT vec_id, round(max(s), 4) AS score FROM (FROM a UNION ALL FROM b) GROUP BY vec_id"""
_add("u01_vector_union", _max_union, _UNION)


def _two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query over two fields, the second one the first in reverse."""
    e = tables.engine(spark, sf_dir)
    fields = [*tables.VECS["fields"], next(f for f in tables.VECS["fields"] if f["name"] == "embedding") | {"name": "mirrored"}]
    e.create_index(tables.VECS | {"fields": fields}, tables.read(spark, sf_dir, "embeddings").withColumn("mirrored", F.reverse("embedding")))
    found = e.search("vecs", {"vectorQueries": [{"fields": "embedding,mirrored", "vector": QUERY, "k": 8}]}).hits
    return found.select("vec_id", F.round("`@search.score`", 4).alias("score"))


_add("v07_two_fields", _two_fields, _UNION)


# facets and aggregates


def _facet(index: str, path: str, request: dict | None = None, limit: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark, sf_dir, index, request or {})
        return facets.counts(e.search(index, request or {}).matched, e.resolve(index), path, limit)

    return run


_add("g01_facet", _facet("docs", "lang", {"filter": "n_chars gt 800"}), "SELECT lang AS value, count(*) AS count FROM documents WHERE n_chars > 800 GROUP BY lang")
_add("g01_facet_nulls", _facet("docs", "quality"), f"SELECT quality AS value, count(*) AS count FROM {DOCS} t WHERE quality IS NOT NULL GROUP BY quality")
_add("g01_facet_limit", _facet("parts", "p_size", limit=7), "SELECT p_size AS value, count(*) AS count FROM part GROUP BY p_size ORDER BY count DESC, p_size::VARCHAR LIMIT 7")
_add("g01_facet_array", _facet("orders", "Lines/returnflag"), "SELECT l_returnflag AS value, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
_add("g01_facet_nested", _facet("customers", "Address/Nation"), f"SELECT n_name AS value, count(*) AS count FROM {CUSTOMERS} t WHERE n_name IS NOT NULL GROUP BY n_name")
_add("g02_facet_count", _facet("docs", "$count", {"search": "tion", "searchFields": "text"}), f"SELECT '$count' AS value, count(*) AS count FROM documents WHERE list_contains({TOKENS}, 'tion')")
_add("g04_total", lambda s, d: tables.engine(s, d, "events").search("events", {"filter": "event_type eq 'click'"}).matched.agg(F.count(F.lit(1)).alias("total")), "SELECT count(*) AS total FROM events WHERE event_type = 'click'")

# suggestions
_WORDS = "regexp_extract_all(p_name, '\\S+')"


def _word_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.word_engine(spark, sf_dir).words["parts"].held.read("terms").groupBy("term").agg(F.sum("documents").alias("times"))


_add("c01_words", _word_terms, f"SELECT lower(w) AS term, count(*) AS times FROM (SELECT unnest({_WORDS}) AS w FROM part) GROUP BY ALL")


def _suggested(search: str, fuzzy: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tables.word_engine(spark, sf_dir).suggest("parts", {"suggesterName": "sg", "search": search, "fuzzy": fuzzy, "top": 40})
        return found.select("p_partkey", F.col("`@search.text`").alias("text"))

    return run


_add(
    "c03_suggest", _suggested("re", False),
    f"SELECT p_partkey, list_filter({_WORDS}, lambda w: contains(lower(w), 're'))[1] AS text FROM part WHERE len(list_filter({_WORDS}, lambda w: contains(lower(w), 're'))) > 0 ORDER BY p_partkey::VARCHAR LIMIT 40",
)
_fz = f"list_filter({_WORDS}, lambda w: contains(lower(w), 'reed') OR levenshtein(lower(w), 'reed') <= 1)"
_add("c02_suggest_fuzzy", _suggested("reed", True), f"SELECT p_partkey, ({_fz})[1] AS text FROM part WHERE len({_fz}) > 0 ORDER BY p_partkey::VARCHAR LIMIT 40")


def _completed(search: str, mode: str) -> Query:
    return lambda s, d: tables.word_engine(s, d).autocomplete("parts", {"suggesterName": "sg", "search": search, "autocompleteMode": mode, "top": 20})


_add(
    "c05_autocomplete", _completed("bl", "oneTerm"),
    f"""SELECT text, 'bl ' || text AS "queryPlusText" FROM (SELECT text, min(row(k, pos)) AS f FROM (SELECT p_partkey::VARCHAR AS k, unnest(range(len({_WORDS}))) AS pos, unnest({_WORDS}) AS text FROM part)
WHERE contains(lower(text), 'bl') GROUP BY text ORDER BY f LIMIT 20)""",
)
_add(
    "c05_autocomplete_many", _completed("l", "oneTerm"),
    f"""SELECT text, 'l ' || text AS "queryPlusText" FROM (SELECT text, min(row(k, pos)) AS f FROM (SELECT p_partkey::VARCHAR AS k, unnest(range(len({_WORDS}))) AS pos, unnest({_WORDS}) AS text FROM part)
WHERE contains(lower(text), 'l') GROUP BY text ORDER BY f LIMIT 20)""",
)
_add(
    "c06_two_terms", _completed("small r", "twoTerms"),
    f"""SELECT text, text AS "queryPlusText" FROM (SELECT text, min(row(k, pos)) AS f FROM (SELECT p_partkey::VARCHAR AS k, unnest(range(1, len({_WORDS}))) AS pos,
unnest(list_transform(range(1, len({_WORDS})), lambda i: {_WORDS}[i] || ' ' || {_WORDS}[i + 1])) AS text FROM part)
WHERE starts_with(lower(text), 'small r') GROUP BY text ORDER BY f LIMIT 20)""",
)

# semantic answers, captions and highlights have no SQL


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = {"search": "tion with", "searchFields": "text", "queryType": "semantic", "semanticConfiguration": "default", "answers": "extractive|count-3", "captions": "extractive", "top": 20}
    return _engine(spark, sf_dir, "docs", request).search("docs", request).hits.select("doc_id", "`@search.captions`", F.round("`@search.rerankerScore`", 6).alias("reranker"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = {"search": "tion with", "searchFields": "text", "queryType": "semantic", "semanticConfiguration": "default", "answers": "extractive|count-3", "captions": "extractive", "top": 20}
    return _engine(spark, sf_dir, "docs", request).search("docs", request).answers.select("__key", "field", "text", F.round("score", 6).alias("score"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.text_engine(spark, sf_dir, tables.DOCS, "documents", tables.docs, True, texts=False).sentences["docs"].held
    return held.read("sizes").select(F.col("__key").cast("long").alias("doc_id"), "sentences", "tokens")


_add("h04_sentences", _sentences)
_add("h06_answers", _answers)
_add("h08_captions", _semantic)
_add("h13_highlights", lambda s, d: tables.engine(s, d, "docs").search("docs", {"search": "tion", "searchFields": "text", "highlight": "text", "top": 10}).hits.select("doc_id", "`@search.highlights`"))

# mutations


NEW = 10_000_000  # added to an event's id for a key that isn't stored


def _batch(events: DataFrame) -> DataFrame:
    """Two actions or three for each event: what the SQL below says, with explicit nulls and rows that break a rule."""
    texts, nulls = F.concat("event_type", F.lit("!")), F.lit(None).cast("string")

    def one(order: int, key, action: str, given: list[str], event_type=nulls, ts=nulls, value=F.lit(None).cast("double"), why: str | None = None):
        columns = {"event_id": key, "ts": ts, "user_id": F.col("user_id"), "event_type": event_type, "value": value, "props": nulls}
        more = {"__action": F.lit(action), "__seq": F.col("event_id") * 4 + order, "__given": F.array(*map(F.lit, ["event_id", *given])), "__why": F.lit(why).cast("string")}
        return F.struct(*[c.alias(n) for n, c in (columns | more).items()])

    own = F.col("event_id")
    kinds = [
        [one(0, own, "delete", []), one(1, own, "merge", ["event_type"], texts)],
        [one(0, own, "merge", ["event_type", "value"], texts), one(1, own, "merge", ["event_type"], F.concat("event_type", F.lit("?")))],
        [one(0, own + NEW, "upload", ["event_type", "value"], texts, value=F.col("value")), one(1, own + NEW, "merge", ["ts"], ts=F.lit("2030-01-01"))],
        [one(0, own + 2 * NEW, "merge", ["event_type"], texts), one(1, own + 2 * NEW, "mergeOrUpload", ["event_type"], texts), one(2, own, "upload", [], why="of another type")],
    ]
    chosen = F.when(own % 4 == 0, F.array(*kinds[0])).when(own % 4 == 1, F.array(*kinds[1])).when(own % 4 == 2, F.array(*kinds[2])).otherwise(F.array(*kinds[3]))
    return events.select(F.inline(chosen))


def _mutated(which: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        state = tables.read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "user_id", "event_type", "value", "props")
        e = tables.engine(spark, sf_dir)
        e.create_index(tables.EVENTS, state)
        found = e.apply_batch("events", _batch(state))
        return e.documents("events").select("event_id", "ts", "event_type", "value") if which == 0 else found.select("key", "status")

    return run


_MUT = f"WITH e AS (SELECT event_id AS i, event_id % 4 AS a, strftime(ts, '%Y-%m-%d') AS ts, event_type AS t, value FROM events)"
_add(
    "m02_mutate", _mutated(0),
    _MUT + f"""
SELECT i AS event_id, ts, CASE a WHEN 0 THEN t || '!' WHEN 1 THEN t || '?' ELSE t END AS event_type, CASE WHEN a = 1 THEN NULL ELSE value END AS value FROM e
UNION ALL SELECT i + {NEW}, '2030-01-01', t || '!', value FROM e WHERE a = 2
UNION ALL SELECT i + {2 * NEW}, NULL, t || '!', NULL FROM e WHERE a = 3""",
)
_add(
    "m06_results", _mutated(1),
    _MUT + f""", r AS (
SELECT i, 200 AS s FROM e WHERE a < 2 UNION ALL SELECT i, 200 FROM e WHERE a < 2 UNION ALL SELECT i + {NEW}, 201 FROM e WHERE a = 2 UNION ALL SELECT i + {NEW}, 200 FROM e WHERE a = 2
UNION ALL SELECT i + {2 * NEW}, 404 FROM e WHERE a = 3 UNION ALL SELECT i + {2 * NEW}, 201 FROM e WHERE a = 3 UNION ALL SELECT i, 400 FROM e WHERE a = 3)
SELECT i::VARCHAR AS key, s AS status FROM r""",
)


def _retrieved(spark: SparkSession, sf_dir: str, search: str = "*") -> DataFrame:
    e = tables.engine(spark, sf_dir, "docs", "parts")
    for n in ("docs", "parts"):
        e.put_resource("knowledgeSource", f"k-{n}", {"searchIndexParameters": {"searchIndexName": n}})
    e.put_resource("knowledgeBase", "kb", {"knowledgeSources": [{"name": "k-docs"}, {"name": "k-parts"}]})
    return e.retrieve("kb", search, 4).select("source", "key")


_add(
    "u02_retrieve", _retrieved,
    "(SELECT 'k-docs' AS source, doc_id::VARCHAR AS key FROM documents ORDER BY key LIMIT 4) UNION ALL (SELECT 'k-parts', p_partkey::VARCHAR AS key FROM part ORDER BY key LIMIT 4)",
)
_add("u02_retrieve_words", lambda s, d: _retrieved(s, d, "avec"), f"SELECT 'k-docs' AS source, doc_id::VARCHAR AS key FROM ({_bm25(['avec'])}) ORDER BY score DESC, key LIMIT 4")
