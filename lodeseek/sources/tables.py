"""Logical indexes over the star-schema and document tables, and Parquet snapshots of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import SearchEngine
from ..operators.sentences import SentenceIndex
from ..operators.word_index import WordIndex
from ..plans.postings import TextIndex
from ..storage import file_system, materialise


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _f(name: str, kind: str, flags: str = "", **more) -> dict:
    """flags: K key, S searchable, F filterable, O sortable, C facetable."""
    on = {"K": "key", "S": "searchable", "F": "filterable", "O": "sortable", "C": "facetable"}
    return {"name": name, "type": kind, **{on[x]: True for x in flags}, **more}


DOCS = {
    "name": "docs",
    "fields": [
        _f("doc_id", "Int64", "KFO"), _f("text", "String", "SF", analyzer="latin"), _f("lang", "String", "FCS", analyzer="keyword"), _f("source", "String", "FCO"), _f("n_chars", "Int64", "FO"),
        _f("quality", "Int32", "FOC"), _f("toxic", "Int32", "FC"),
    ],
    "semantic": {"configurations": [{"name": "default", "prioritizedFields": {"prioritizedContentFields": [{"fieldName": "text"}]}}]},
}
EVENTS = {
    "name": "events",
    "fields": [_f("event_id", "Int64", "KFO"), _f("ts", "DateTimeOffset", "FO"), _f("user_id", "Int64", "FC"), _f("event_type", "String", "FCS"), _f("value", "Double", "FO"), _f("props", "String", "F")],
}
PARTS = {
    "name": "parts",
    "fields": [
        _f("p_partkey", "Int64", "KFO"), _f("p_name", "String", "SF", analyzer="latin"), _f("p_brand", "String", "FC"), _f("p_type", "String", "FC"), _f("p_size", "Int32", "FOC"), _f("p_retailprice", "Double", "FO"),
    ],
    "suggesters": [{"name": "sg", "searchFields": ["p_name"]}],
}
ORDERS = {
    "name": "orders",
    "fields": [
        _f("o_orderkey", "Int64", "KFO"), _f("o_orderstatus", "String", "FC"), _f("o_totalprice", "Double", "FO"), _f("o_orderpriority", "String", "FC"),
        _f("Lines", "Collection(ComplexType)", "F", fields=[_f("linenumber", "Int32", "F"), _f("quantity", "Double", "FC"), _f("discount", "Double", "F"), _f("returnflag", "String", "FC"), _f("linestatus", "String", "FC")]),
    ],
}
SALES = {
    "name": "sales",
    "fields": [_f("o_orderkey", "Int64", "KFO"), _f("o_orderdate", "DateTimeOffset", "FO"), _f("o_orderstatus", "String", "FC"), _f("o_totalprice", "Double", "FO")],
}
CUSTOMERS = {
    "name": "customers",
    "fields": [
        _f("c_custkey", "Int64", "KFO"), _f("c_name", "String", "S", analyzer="keyword"), _f("c_mktsegment", "String", "FC"), _f("c_acctbal", "Double", "FO"),
        _f("Address", "ComplexType", "F", fields=[_f("Nation", "String", "FCO"), _f("Region", "String", "FCO")]),
    ],
}
VECS = {
    "name": "vecs",
    "fields": [_f("vec_id", "Int64", "KFO"), _f("embedding", "Collection(Edm.Single)", "S", dimensions=64, vectorSearchProfile="p"), _f("label", "Int32", "FC")],
    "vectorSearch": {"algorithms": [{"name": "a", "kind": "exhaustiveKnn", "exhaustiveKnnParameters": {"metric": "cosine"}}], "profiles": [{"name": "p", "algorithm": "a"}]},
}


def with_metric(metric: str) -> dict:
    """VECS under another metric."""
    return VECS | {"vectorSearch": {"algorithms": [{"name": "a", "kind": "exhaustiveKnn", "exhaustiveKnnParameters": {"metric": metric}}], "profiles": [{"name": "p", "algorithm": "a"}]}}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").cast("long").alias("linenumber"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("Lines"))
    return read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "Lines")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.struct(F.col("n_name").alias("Nation"), F.col("r_name").alias("Region")).alias("Address"))


def engine(spark: SparkSession, sf_dir: str, *names: str) -> SearchEngine:
    """An engine with the named logical indexes."""
    made = {
        "docs": (DOCS, docs), "events": (EVENTS, lambda s, d: read(s, d, "events")), "parts": (PARTS, lambda s, d: read(s, d, "part")), "orders": (ORDERS, orders),
        "sales": (SALES, lambda s, d: read(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")),
        "customers": (CUSTOMERS, customers), "vecs": (VECS, lambda s, d: read(s, d, "embeddings")),
    }
    out = SearchEngine(spark)
    for n in names:
        spec, load = made[n]
        out.create_index(spec, _taken(spark, sf_dir, n, load) if n in JOINED else load(spark, sf_dir))
    return out


#: Indexes whose documents are put together from several tables: taken once a session, as an index takes its documents.
JOINED = {"orders": ("orders", "lineitem"), "customers": ("customer", "nation", "region")}
_snapshots: dict[tuple, DataFrame] = {}


def _taken(spark: SparkSession, sf_dir: str, name: str, load) -> DataFrame:
    """The written documents of a joined index, for the state that its tables' files are in."""
    key = (spark.sparkContext.applicationId, name, sf_dir, *(_state_of(spark, f"{sf_dir}/{t}.parquet") for t in JOINED[name]))
    if key not in _snapshots:
        _snapshots[key] = materialise(load(spark, sf_dir), f"index-{name}")
    return _snapshots[key]


_texts: dict[tuple, TextIndex] = {}
_sentences: dict[tuple, SentenceIndex] = {}
_words: dict[tuple, WordIndex] = {}


def _state_of(spark: SparkSession, path: str) -> tuple:
    """When a table's files were last written, and their sizes."""
    fs, p = file_system(spark, path)
    found = fs.listStatus(p) if fs.exists(p) else []
    return tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in found))


def text_engine(spark: SparkSession, sf_dir: str, spec: dict, table: str, load, sentences: bool = False, texts: bool = True) -> SearchEngine:
    """An engine with one index over a table, and its text index (and sentence index), which the session builds once for a state of the table's files."""
    out = SearchEngine(spark)
    index = out.create_index(spec, load(spark, sf_dir))
    key = (spark.sparkContext.applicationId, sf_dir, repr([(f.name, f.analyzer, f.searchable) for f in index.fields]), _state_of(spark, f"{sf_dir}/{table}.parquet"))
    if texts and key in _texts:
        out.texts[index.name] = _texts[key]
    elif texts:
        _texts[key] = out.index_text(index.name)
    if sentences and key in _sentences:
        out.sentences[index.name] = _sentences[key]
    elif sentences:
        _sentences[key] = out.index_sentences(index.name)
    return out


def word_engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """An engine with the index of parts, and its word index, which the session builds once for a state of the table's files."""
    out = engine(spark, sf_dir, "parts")
    key = (spark.sparkContext.applicationId, sf_dir, _state_of(spark, f"{sf_dir}/part.parquet"))
    if key in _words:
        out.words["parts"] = _words[key]
    else:
        _words[key] = out.index_words("parts")
    return out


def save(engine_: SearchEngine, name: str, path: str) -> None:
    """Writes an index's documents as a Parquet snapshot."""
    engine_.data[engine_.resolve(name).name].write.mode("overwrite").parquet(path)


def load(engine_: SearchEngine, spec: dict, path: str) -> None:
    """Opens a snapshot under a definition."""
    engine_.create_index(spec, engine_.spark.read.parquet(path))
