"""Indexes over DataFrames, and the requests that run on them.

Requests are compiled on the driver; results are lazy DataFrames that Catalyst plans as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as schemas
from . import semantics
from .errors import SearchError, invalid
from .functions import analyzers, filters, vectors
from .operators import ann, facets, mutate, ranking, semantic, suggest
from .operators.sentences import SentenceIndex
from .operators.word_index import WordIndex
from .paths import project
from .plans import bm25, query_text
from .plans.postings import TextIndex
from .schema import Index
from .sources.segments import Segments, Table
from .storage import materialise, new_path

#: Static limits that the statistics name; 100 for the rest.
LIMITS = {"documentCounter": 10_000_000, "storageCounter": 10_240}
#: Keys of a batch that are named in a filter; documents of more are found by a join. Rows of a log that is never laid over its base.
NAMED, FOLDED = 256, 100_000


@dataclass
class Result:
    """hits: the page, in order; matched: all matches with __key and __score, for counts and facets."""

    hits: DataFrame
    matched: DataFrame
    facets: dict[str, DataFrame] = field(default_factory=dict)
    answers: DataFrame | None = None
    debug: dict = field(default_factory=dict)
    _request: dict = field(default_factory=dict)
    _more: Callable[[], tuple[str, int] | None] = lambda: None

    def total(self) -> int:
        return self.matched.count()

    @cached_property
    def _next(self) -> tuple[str, int] | None:
        return self._more()

    @property
    def next_token(self) -> str | None:
        """Where the next page goes on; null where this one is the last. Looks for one more match when it is first asked for."""
        return self._next and self._next[0]

    @property
    def next_page(self) -> dict | None:
        """The request for the next page: this one with the token and skip."""
        return self._next and self._request | {"token": self._next[0], "skip": self._next[1]}

    def next_link(self, name: str, version: str | None = None) -> str | None:
        """The path of the next page, as clients follow it."""
        if not self._next:
            return None
        given = ([f"api-version={version}"] if version else []) + [f"continuation={self._next[0]}"]
        return f"/indexes('{name}')/docs/search.post.search?{'&'.join(given)}"


def _list(value: Any) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        return [x.strip() for x in value.split(",") if x.strip()]
    return [str(x) for x in value]


def _number(value: Any, name: str) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise invalid(f"{name} must be a whole number")
    return value


class SearchEngine:
    """A catalog of indexes, aliases, synonym maps and knowledge sources, and their requests."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.indexes: dict[str, Index] = {}
        self.data: dict[str, DataFrame] = {}
        self.stores: dict[str, Segments] = {}
        self.texts: dict[str, TextIndex] = {}
        self.sentences: dict[str, SentenceIndex] = {}
        self.words: dict[str, WordIndex] = {}
        self.lists: dict[tuple[str, str], ann.Lists] = {}
        self.resources: dict[str, dict[str, dict]] = {k: {} for k in ("alias", "synonymMap", "knowledgeSource", "knowledgeBase")}
        self._version = 0

    # catalog

    def create_index(self, spec: dict | Index, docs: DataFrame | None = None) -> Index:
        index = spec if isinstance(spec, Index) else schemas.parse(spec)
        if index.name in self.indexes or index.name in self.resources["alias"]:
            raise SearchError("IndexAlreadyExists", index.name)
        self.indexes[index.name] = index
        self._put(index, self.spark.createDataFrame([], index.schema()) if docs is None else docs)
        return index

    def put_index(self, spec: dict) -> Index:
        """Creates or replaces; documents stay where the new definition is compatible."""
        new = schemas.parse(spec)
        old = self.indexes.get(new.name)
        if old is None:
            return self.create_index(new)
        docs = self.data[new.name]
        keep = schemas.compatible(old, new)
        self.indexes[new.name] = new
        self.stores.pop(new.name, None)
        self.texts.pop(new.name, None)
        self.sentences.pop(new.name, None)
        self.words.pop(new.name, None)
        if keep:
            have = set(docs.columns)
            self._put(new, docs.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.spark_type()).alias(f.name) for f in new.fields]))
        else:
            self._put(new, self.spark.createDataFrame([], new.schema()))
        return new

    def delete_index(self, name: str) -> None:
        if self.indexes.pop(name, None) is None:
            raise SearchError("ResourceNotFound", name)
        for own in (self.data, self.stores, self.texts, self.sentences, self.words):
            own.pop(name, None)

    def reset(self) -> None:
        self.__init__(self.spark)

    def put_resource(self, kind: str, name: str, body: dict, if_match: str | None = None, create: bool = False) -> dict:
        """Stores an alias, synonym map, knowledge source or base; the etag rises with every write. create: it must be new."""
        own = self.resources[kind]
        if create and name in own or kind == "alias" and name in self.indexes:
            raise SearchError(f"{kind[0].upper()}{kind[1:]}AlreadyExists", name)
        if if_match and own.get(name, {}).get("@odata.etag") != if_match:
            raise SearchError("PreconditionFailed", name)
        if not isinstance(body, dict):
            raise SearchError("InvalidRequest", f"{name} is no object")
        if kind == "synonymMap" and not isinstance(body.get("synonyms"), str):
            raise SearchError("InvalidSynonymMap", name)
        if kind == "alias" and (not isinstance(body.get("indexes"), list) or len(body["indexes"]) != 1 or body["indexes"][0] not in self.indexes):
            raise SearchError("InvalidAlias", f"{name} needs one index that exists")
        if kind == "knowledgeSource" and not (body.get("searchIndexParameters") or {}).get("searchIndexName"):
            raise SearchError("InvalidKnowledgeSource", f"{name} names no index")
        if kind == "knowledgeBase" and (not body.get("knowledgeSources") or any(s.get("name") not in self.resources["knowledgeSource"] for s in body["knowledgeSources"])):
            raise SearchError("InvalidKnowledgeBase", f"{name} needs sources that exist")
        self._version += 1
        own[name] = body | {"name": name, "@odata.etag": f'"0x{self._version:08X}"'}
        return own[name]

    def list_resources(self, kind: str) -> list[dict]:
        return [own for _, own in sorted(self.resources[kind].items())]

    def list_indexes(self) -> list[Index]:
        return [own for _, own in sorted(self.indexes.items())]

    def get_resource(self, kind: str, name: str) -> dict:
        if name not in self.resources[kind]:
            raise SearchError("ResourceNotFound", name)
        return self.resources[kind][name]

    def delete_resource(self, kind: str, name: str) -> None:
        self.get_resource(kind, name)
        del self.resources[kind][name]

    def resolve(self, name: str) -> Index:
        if name in self.resources["alias"]:
            name = (self.resources["alias"][name].get("indexes") or [""])[0]
        if name not in self.indexes:
            raise SearchError("ResourceNotFound", name)
        return self.indexes[name]

    def _put(self, index: Index, docs: DataFrame) -> None:
        for k in [k for k in self.lists if k[0] == index.name]:
            del self.lists[k]
        self.data[index.name] = docs

    def _hashed(self, index: Index, docs: DataFrame) -> DataFrame:
        """docs with __key and __hash, the order of stored documents."""
        key = F.col(f"`{index.key.name}`").cast("string")
        return docs.withColumns({"__key": key, "__hash": F.xxhash64(key)})

    def _segments(self, index: Index, path: str, base: DataFrame | None) -> Segments:
        own = self.data[index.name].schema  # as they are: dates may be timestamps
        schema = T.StructType([*[own[f.name] for f in index.fields], T.StructField("__key", T.StringType()), T.StructField("__hash", T.LongType())])
        return Segments(self.spark, path, {"documents": Table(schema, ("__hash", "__key"))}, base)

    def store(self, name: str, path: str) -> Segments:
        """Keeps the index's documents under path from now on, in segments that batches add; opens those that path holds."""
        index = self.resolve(name)
        held = self._segments(index, path, None)
        if held.version < 0:
            docs = self._hashed(index, self.data[index.name])
            held.append({"documents": docs}, None, docs.count(), 0)
        self.stores[index.name] = held
        self.data[index.name] = self._read(index, held)
        return held

    def _read(self, index: Index, held: Segments) -> DataFrame:
        return held.read("documents").select(*[F.col(f"`{f.name}`") for f in index.fields])

    def _log(self, index: Index) -> Segments:
        """The store, or a log over the DataFrame that the index was made of."""
        if index.name not in self.stores:
            self.stores[index.name] = self._segments(index, new_path(self.spark, f"log-{index.name}"), self._hashed(index, self.data[index.name]))
        return self.stores[index.name]

    def index_text(self, name: str, path: str | None = None) -> TextIndex:
        """Builds the text index, or opens one that path holds; searches then read postings, and batches keep them up to date."""
        index = self.resolve(name)
        text = TextIndex(self.spark, index, path or new_path(self.spark, f"text-{index.name}"))
        if text.held.version < 0:
            text.build(self.documents(name))
        self.texts[index.name] = text
        return text

    def documents(self, name: str) -> DataFrame:
        """All documents, with the key as text in __key."""
        index = self.resolve(name)
        return self.data[index.name].withColumn("__key", F.col(f"`{index.key.name}`").cast("string"))

    def statistics(self) -> DataFrame:
        """name, documents, bytes for each index."""
        out = None
        for name in sorted(self.indexes):
            d = self.data[name]
            one = d.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in d.columns])))), F.lit(0)).alias("bytes"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "name string, documents long, bytes long")

    def service_statistics(self) -> dict:
        """Counts of what there is, each with its static limit; storage in KB."""
        row = self.statistics().agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
        used = {"indexCounter": len(self.indexes), "documentCounter": row["n"], "storageCounter": row["b"] // 1024}
        used |= {f"{k}Counter": len(self.resources[k]) for k in ("synonymMap", "alias", "knowledgeBase", "knowledgeSource")}
        return {"counters": {k: {"usage": n, "limit": LIMITS.get(k, 100)} for k, n in used.items()}, "limits": {"maxVectorIndexSizePerIndexInBytes": 1 << 30}}

    def index_sentences(self, name: str, path: str | None = None) -> SentenceIndex:
        """Builds the sentence index of the fields that answers come from, or opens one that path holds; batches keep it up to date."""
        index = self.resolve(name)
        held = SentenceIndex(self.spark, index, path or new_path(self.spark, f"sentences-{index.name}"))
        if held.held.version < 0:
            held.build(self.documents(name))
        self.sentences[index.name] = held
        return held

    def index_words(self, name: str, path: str | None = None) -> WordIndex:
        """Builds the word index of the suggesters' fields, or opens one that path holds; suggestions then read words, and batches keep them up to date."""
        index = self.resolve(name)
        held = WordIndex(self.spark, index, path or new_path(self.spark, f"words-{index.name}"))
        if held.held.version < 0:
            held.build(self.documents(name))
        self.words[index.name] = held
        return held

    def index_vectors(self, name: str, path: str, folder: str | None = None) -> ann.Lists:
        """Deals a field's vectors to lists, or opens those that folder holds: queries that may be approximate read a few of them. Batches keep them up to date."""
        index = self.resolve(name)
        f = index.at(path)
        if f is None or not f.vector:
            raise invalid(f"{path} is no vector")
        self.lists[index.name, path] = ann.Lists(self.spark, index, f, folder or new_path(self.spark, f"lists-{index.name}-{path}"), self.documents(name))
        return self.lists[index.name, path]

    def kept(self, name: str) -> list[Segments]:
        """What batches keep up to date beside the documents."""
        return [x.held for x in self._beside(self.resolve(name))]

    def _beside(self, index: Index) -> list:
        own = [self.texts.get(index.name), self.sentences.get(index.name), self.words.get(index.name), *(x for (of, _), x in self.lists.items() if of == index.name)]
        return [x for x in own if x is not None]

    def _near(self, base: DataFrame, index: Index, path: str, query: dict, filtered: bool) -> DataFrame:
        """The k best of a field: from the lists where the index and the query allow approximation, else from all."""
        held, own = self.lists.get((index.name, path)), index.algorithms.get(index.at(path).profile or "") or {}
        ef = own.get("efSearch", 500)
        may = held and own.get("kind") == "hnsw" and own["metric"] != "dotProduct" and not filtered and not query["exhaustive"] and held.n > max(ef, query["k"])
        return ranking.nearest(held.probed(query["vector"], max(ef, query["k"])) if may else base, index, path, query["vector"], query["k"])

    # documents

    def get_document(self, name: str, key: str) -> DataFrame:
        """The stored fields of a document."""
        index = self.resolve(name)
        shown = [f.name for f in index.fields if f.stored or f.key]
        own = F.col(f"`{index.key.name}`")
        if index.key.type != "String" and key.lstrip("-").isdigit():
            found = self.data[index.name].where(own == int(key))  # reaches the scan
        else:
            found = self.documents(name).where(F.col("__key") == key)
        return found.select(*shown).limit(1)

    def count(self, name: str) -> DataFrame:
        return self.documents(name).agg(F.count(F.lit(1)).alias("count"))

    def index_documents(self, name: str, actions: list[dict]) -> DataFrame:
        """Applies a request's actions; returns __seq, key, status. A document that can't be taken is 400 and stops no other."""
        index = self.resolve(name)
        shape = T.StructType([T.StructField(f.name, f.dataType) for f in index.schema()])
        full = shape.add("__action", T.StringType()).add("__seq", T.LongType()).add("__given", T.ArrayType(T.StringType())).add("__why", T.StringType())
        return self.apply_batch(name, self.spark.createDataFrame(mutate.rows(index, actions), full))

    def apply_batch(self, name: str, batch: DataFrame, number: int | None = None) -> DataFrame:
        """The same for a DataFrame of the index's columns, __action and __seq; with __given, fields that a merge lays.

        The batch is written, and so is what it makes of the documents that it names: a segment of the store, or of a log
        over the DataFrame that the index was made of, and one of the text index and vector lists. Other documents are neither read nor
        written. number: of the batch, where batches are numbered (see Segments.before).
        """
        index = self.resolve(name)
        made, held = materialise(self._vectorize(index, batch), "batch"), self._log(index)
        folded = materialise(mutate.fold(self._named(held, made, index), made, index), "folded")
        row = folded.agg(F.count("doc").alias("n"), F.count("old").alias("gone")).first()
        new, old = mutate.documents(folded, "doc", index), mutate.documents(folded, "old", index)
        if row["n"] or row["gone"]:
            for own in self._beside(index):
                own.update(new, old, row["n"], row["gone"], number)
        if row["n"] or row["gone"] or number is not None:
            held.append({"documents": self._hashed(index, new)}, old, row["n"], row["gone"], batch=number)
            held.tidy()
        if held.base is not None and held.rows() > FOLDED and held.rows() > (n := held.base.count()) // 4:
            held.merge(base_rows=n)
        self.data[index.name] = self._read(index, held)
        return mutate.results(folded, made, index)

    def _named(self, held: Segments, batch: DataFrame, index: Index) -> DataFrame:
        """Stored documents with the keys of a batch."""
        key = F.col(f"`{index.key.name}`")
        keys = batch.where(key.isNotNull()).select(key.alias("k"), F.xxhash64(key.cast("string")).alias("h")).distinct()
        found, docs = keys.limit(NAMED + 1).collect(), held.read("documents")
        if len(found) > NAMED:
            return docs.join(keys.select(F.col("h").alias("__hash"), F.col("k").cast("string").alias("__key")), ["__hash", "__key"], "left_semi")
        return docs.where(_any([F.col("__hash") == r["h"] for r in found]) & key.isin([r["k"] for r in found]))  # both reach scans: of segments, and of a base

    def _vectorize(self, index: Index, batch: DataFrame) -> DataFrame:
        """Vectors of fields with a vectorizer, where a row brings none: from its source texts."""
        for f in index.fields:
            v = index.vectorizers.get(f.vectorizer or (index.algorithms.get(f.profile or "") or {}).get("vectorizer") or "")
            if f.vector and v:
                source = (v.get("sourceContext") or {}).get("fields") or [x.name for x in index.fields if x.searchable and x.type == "String" and not x.collection]
                text = F.concat_ws(" ", *[F.when(F.col(f"`{s}`") != "", F.col(f"`{s}`")) for s in source])
                batch = batch.withColumn(f.name, F.coalesce(F.col(f"`{f.name}`"), vectors.embed(text, f.dimensions)))
        return batch

    # search

    def _fields(self, index: Index, request: dict) -> dict[str, float]:
        given = _list(request.get("searchFields"))
        allowed = index.searchable()
        if not given:
            return {p: 1.0 for p in allowed}
        out = {}
        for g in given:
            path, _, boost = g.partition("^")
            if path not in allowed:
                raise invalid(f"{path} isn't searchable")
            try:
                out[path] = float(boost or 1)
            except ValueError:
                raise invalid(f"boost {boost!r}") from None
        return out

    def _vector_queries(self, index: Index, request: dict) -> list[dict]:
        given = request.get("vectorQueries") or []
        if len(given) > 5:
            raise invalid("more than 5 vector queries")
        out = []
        for q in given:
            fields, k, weight = _list(q.get("fields")), q.get("k", 3), q.get("weight", 1.0)
            if not fields or not isinstance(k, int) or not 1 <= k <= 1000 or not weight > 0:
                raise invalid("a vector query needs fields, k from 1 to 1000 and a positive weight")
            sizes = set()
            for p in fields:
                f = index.at(p)
                if f is None or not f.vector:
                    raise invalid(f"{p} is no vector")
                sizes.add(f.dimensions)
            if len(sizes) > 1:
                raise invalid("the fields of a vector query have one dimension")
            if q.get("kind", "vector") == "text":
                vector = vectors.text_vector(q.get("text") or "", sizes.pop()) or []
            else:
                vector = q.get("vector")
                if not isinstance(vector, list) or len(vector) not in sizes:
                    raise invalid("the vector's length doesn't suit its fields")
            out.append({"fields": fields, "k": k, "weight": float(weight), "vector": vector, "exhaustive": bool(q.get("exhaustive"))})
        return out

    def search(self, name: str, request: dict) -> Result:
        """search, queryType, searchMode, searchFields, filter, facets, orderby, select, top, skip, count,
        highlight, minimumCoverage, vectorQueries, vectorFilterMode, semanticConfiguration, answers, captions, token, debug."""
        index = self.resolve(name)
        for k in ("scoringProfile", "scoringParameters", "scoringStatistics"):
            if request.get(k):
                raise SearchError("UnsupportedQuery", k)
        docs = self.documents(name)
        mode, full = request.get("searchMode", "any"), request.get("queryType") == "full"
        if mode not in ("any", "all"):
            raise invalid(f"searchMode {mode!r}")
        queries = self._vector_queries(index, request)
        state = ranking.read_token(request["token"], queries) if request.get("token") else {}
        skip = state.get("skip", _number(request.get("skip"), "skip") or 0)
        top = _number(request.get("top"), "top")
        filter_text = state.get("filter", request.get("filter"))
        orderby = state.get("orderby", _list(request.get("orderby")))
        asked = semantics.wanted(request)
        if asked:
            if queries:
                raise invalid("semantic search and vectors don't go together")
            if full:
                raise invalid("semantic search and the full syntax don't go together")
            if asked.configuration not in index.semantic:
                if not asked.partial:
                    raise invalid(f"no semantic configuration {asked.configuration}")
                asked = None
        fields = self._fields(index, request)
        text = request.get("search")
        tree = query_text.full(text, mode, index.searchable()) if full else query_text.simple(text, mode)
        keep = filters.compile_filter(filter_text, index, docs.schema, check=not state, bare=True) if filter_text else None
        rules = {m: (b["synonyms"] if isinstance(b["synonyms"], str) else "").splitlines() for m, b in self.resources["synonymMap"].items()}
        plan = bm25.Plan(index, tree, fields, rules)

        everything = isinstance(tree, query_text.Clause) and tree.kind == "all" and not (full and (text or "").strip() == "*")
        pre = request.get("vectorFilterMode", "postFilter") == "preFilter"
        lists = []
        for q in queries:
            base = docs.where(keep) if pre and keep is not None else docs
            per_field = [self._near(base, index, p, q, pre and keep is not None) for p in q["fields"]] if q["vector"] else []
            if per_field:
                found = ranking.best(per_field) if len(per_field) > 1 else per_field[0]
                if keep is not None and not pre:
                    found = found.join(docs.where(keep).select("__key"), "__key", "left_semi")
                lists.append((found, q["weight"]))
        coverage = request.get("minimumCoverage")
        scored = None
        if not (queries and everything):
            scored = plan.scored(docs, coverage if coverage and mode == "any" else None, self.texts.get(index.name), keep).where("__match")
        if not queries:
            matched = scored.drop("__match")
        else:
            texts = scored.select("__key", "__score") if scored is not None else None
            ranges = ranking.dealt(texts) if texts is not None and lists else None  # scored once, however often it is looked at
            if texts is not None and not lists:
                fused = texts
            elif texts is None or ranges.isEmpty():
                fused = ranking.best([df for df, _ in lists]) if lists else docs.select("__key", F.lit(0.0).alias("__score")).where("false")
            else:
                fused = ranking.fuse([(ranking.numbered(ranges), 1.0), *((ranking.numbered_few(df), w) for df, w in lists)])
            matched = docs.join(fused, "__key")
        by, found, pruned = ranking.keys(index, orderby), matched, None
        past = state.get("after")  # the last row of the page before: where it is known, nothing before it is sorted again
        offset = 0 if past else skip
        if past:
            try:
                found = matched.where(ranking.after(matched, by, past))
            except ValueError:
                raise invalid("the token can't be read") from None
        elif top and not queries and not orderby and not coverage and index.name in self.texts:
            pruned = bm25.Plan(index, tree, fields, rules).best(docs, self.texts[index.name], skip + top, keep)
            if pruned:  # the page's documents alone
                few = pruned[0].orderBy(F.desc("__score"), "__key").limit(skip + top)
                found = docs.join(F.broadcast(few), "__key")
        page = found.orderBy(*ranking.order(index, orderby))
        page = page.offset(offset) if offset else page
        page = page.limit(top) if top is not None else page
        hits = page.select(*self._shown(index, request, plan, tree))
        made = {p: facets.counts(matched, index, p, n) for p, n in facets.parse(index, _as_list(request.get("facets") or request.get("facet"))).items()}
        result = Result(hits, matched, made, debug=self._debug(index, tree, fields, rules, queries, filter_text) | ({"blocks": pruned[1]} if pruned else {}))
        if request.get("debug") not in (None, False, "disabled"):  # counts are jobs, and so come only where they are asked for
            result.debug["execution"] = {"totalCandidates": docs.count(), "matchedDocuments": result.total(), "filterApplied": keep is not None, "vectorQueries": len(queries)}
        if asked:
            conf = index.semantic[asked.configuration]
            if asked.answers is not None:
                result.answers = semantic.answers(matched, index, conf["answers"], semantic.query_terms(text or "", list(asked.questions)), asked.answers, self.sentences.get(index.name))
            more = [semantic.captions(index, conf["captions"], asked.captions).alias("@search.captions")] if asked.captions is not None else []
            result.hits = page.select(*self._shown(index, request, plan, tree), *more, semantic.reranked(F.col("__score")).alias("@search.rerankerScore"))
        if top:
            result._more = lambda: self._cursor(matched if pruned else found, by, offset, top, {"skip": skip + top, "filter": filter_text, "orderby": orderby, "vectors": ranking.vector_hash(queries)})
            result._request = request
        return result

    def _cursor(self, found: DataFrame, by: list, offset: int, top: int, state: dict) -> tuple[str, int] | None:
        """The token of the next page and what it skips, or null where there is none."""
        rows = found.select(*ranking.numbers(by), *[c.alias(f"s{i}") for i, (c, _) in enumerate(by)])
        rows = rows.orderBy(*[F.asc_nulls_first(f"s{i}") if rising else F.desc_nulls_last(f"s{i}") for i, (_, rising) in enumerate(by)])
        last = rows.offset(offset + top - 1).limit(2).select(*[f"k{i}" for i in range(len(by))]).collect()  # the page's last row and the one after it
        if len(last) < 2:
            return None
        # ranks that are fused are summed in no fixed order, so that such pages go by their number
        return ranking.token(state if state["vectors"] else state | {"after": list(last[0])}), state["skip"]

    def _debug(self, index: Index, tree, fields: dict[str, float], rules: dict[str, list[str]], queries: list[dict], filter_text: str | None) -> dict:
        """What was made of a request: the query tree, boosts, synonyms, vector queries and the filter's tree."""
        maps = {m for p in fields for m in index.at(p).synonyms}
        words = {c.text: [w for m in sorted(maps) for w in query_text.synonyms(rules.get(m, []), c.text)] for c in query_text.terms(tree) if c.kind == "term"}
        return {
            "query": tree, "fields": fields, "synonyms": {k: v for k, v in words.items() if v}, "filter": filters.parse(filter_text) if filter_text else None,
            "vectors": [{k: q[k] for k in ("fields", "k", "weight")} for q in queries],
        }

    def _shown(self, index: Index, request: dict, plan: bm25.Plan, tree) -> list[Column]:
        select = [s for s in _list(request.get("select")) if s != "*"]
        for p in select:
            if index.at(p) is None:
                raise invalid(f"no field {p}")
        if select:
            paths = [p for p in select if (f := index.at(p.split("/")[0])).retrievable or f.stored and p == f.name]
        else:
            paths = [f.name for f in index.fields if f.retrievable or f.key]
        out = [F.col("__score").alias("@search.score"), *project(index.fields, paths)]
        marked = _list(request.get("highlight"))
        if marked:
            tags = (request.get("highlightPreTag", "<em>"), request.get("highlightPostTag", "</em>"))
            words = [c.text for c in query_text.terms(tree)]
            cols = []
            for p in marked:
                f = index.at(p.split("-")[0])
                if f is None or not f.searchable:
                    raise invalid(f"{p} isn't searchable")
                cols += [F.lit(p), semantic.highlights(index, p, words, tags)]
            out.append(F.create_map(*cols).alias("@search.highlights"))
        return out

    # suggestions

    def _candidates(self, name: str, request: dict) -> tuple[Index, DataFrame, list[str]]:
        index = self.resolve(name)
        docs = self.documents(name)
        if request.get("filter"):
            docs = docs.where(filters.compile_filter(request["filter"], index, docs.schema, check=False, bare=True))
        return index, docs, suggest.scope(index, request.get("suggesterName") or "", _list(request.get("searchFields")))

    def suggest(self, name: str, request: dict) -> DataFrame:
        index, docs, paths = self._candidates(name, request)
        pre, post = request.get("highlightPreTag"), request.get("highlightPostTag")
        found = suggest.suggest(
            docs, index, paths, request.get("search") or "", ranking.order(index, _list(request.get("orderby")), score=False),
            _number(request.get("top"), "top") or 5, bool(request.get("fuzzy")), (pre, post) if pre and post else None, self.words.get(index.name),
        )
        select = _list(request.get("select"))
        return found.select(F.col("__text").alias("@search.text"), *project(index.fields, list(dict.fromkeys([index.key.name, *select]))))

    def autocomplete(self, name: str, request: dict) -> DataFrame:
        index, docs, paths = self._candidates(name, request)
        return suggest.complete(docs, index, paths, request.get("search") or "", request.get("autocompleteMode", "oneTerm"), _number(request.get("top"), "top") or 5, bool(request.get("fuzzy")), self.words.get(index.name))

    def analyze(self, text: str, analyzer: str | None = None) -> list[dict]:
        return analyzers.analyze(text, analyzer)

    def retrieve(self, base: str, search: str, top: int = 3) -> DataFrame:
        """The best documents of each of a knowledge base's sources, as JSON, tagged with the source."""
        if not 1 <= top <= 1000:
            raise invalid("top goes from 1 to 1000")
        out = None
        for s in self.get_resource("knowledgeBase", base).get("knowledgeSources") or []:
            source = self.get_resource("knowledgeSource", s["name"])
            target = (source.get("searchIndexParameters") or {}).get("searchIndexName") or ""
            index = self.resolve(target)
            found = self.search(target, {"search": search, "top": top}).hits
            shown = [c for c in found.columns if c != "@search.score"]
            one = found.select(F.lit(s["name"]).alias("source"), F.col(f"`{index.key.name}`").cast("string").alias("key"), F.col("`@search.score`").alias("score"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown])).alias("document"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "source string, key string, score double, document string")


def _any(tests: list[Column]) -> Column:
    """One of tests, as a balanced tree."""
    if len(tests) < 2:
        return tests[0] if tests else F.lit(False)
    return _any(tests[: len(tests) // 2]) | _any(tests[len(tests) // 2 :])


def _as_list(value: Any) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)
