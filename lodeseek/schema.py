"""Index definitions: typed fields with flags, checked once, mapped to Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from . import semantics
from .errors import SearchError

SCALARS = {
    "String": T.StringType(), "Int32": T.LongType(), "Int64": T.LongType(), "Int8": T.ByteType(), "SByte": T.ByteType(), "Int16": T.ShortType(),
    "Single": T.DoubleType(), "Double": T.DoubleType(), "Half": T.FloatType(), "Boolean": T.BooleanType(), "DateTimeOffset": T.StringType(), "Guid": T.StringType(),
    "Time": T.StringType(), "Duration": T.StringType(), "Binary": T.StringType(),
    "GeographyPoint": T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))]),
}
NUMBERS = {"Int8", "SByte", "Int16", "Int32", "Int64", "Single", "Double", "Half"}
#: Only equality is defined on these.
EQUALITY = {"Boolean", "Duration", "Binary", "GeographyPoint", "ComplexType"}
IN_COLLECTIONS = {"String", "Int8", "SByte", "Int16", "Int32", "Int64", "Single", "Double", "Half", "Boolean", "DateTimeOffset", "Guid", "Binary", "ComplexType"}
MAX_DIMENSIONS, MAX_VECTORS = 3072, 16


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # element type of a collection
    collection: bool = False
    key: bool = False
    searchable: bool = False
    filterable: bool = False
    sortable: bool = False
    facetable: bool = False
    retrievable: bool = True
    stored: bool = True
    dimensions: int | None = None
    profile: str | None = None
    vectorizer: str | None = None
    analyzer: str | None = None
    synonyms: tuple[str, ...] = ()
    fields: tuple["Field", ...] = ()

    @property
    def vector(self) -> bool:
        return self.dimensions is not None

    @property
    def complex(self) -> bool:
        return self.type == "ComplexType"

    def spark_type(self) -> T.DataType:
        if self.vector:
            return T.ArrayType(T.FloatType(), False)
        one = T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields]) if self.complex else SCALARS[self.type]
        return T.ArrayType(one) if self.collection else one


@dataclass(frozen=True)
class Index:
    name: str
    fields: tuple[Field, ...]
    suggesters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    algorithms: dict[str, dict] = field(default_factory=dict)  # by profile: metric and its parameters
    vectorizers: dict[str, dict] = field(default_factory=dict)
    semantic: dict[str, dict] = field(default_factory=dict)

    @property
    def key(self) -> Field:
        return next(f for f in self.fields if f.key)

    def at(self, path: str) -> Field | None:
        """The field at A/B/C."""
        fields, found = self.fields, None
        for part in path.split("/"):
            found = next((f for f in fields if f.name == part), None)
            if found is None:
                return None
            fields = found.fields
        return found

    def leaves(self) -> list[tuple[str, Field]]:
        """All paths in schema order, complex fields before their own."""

        def walk(fields, prefix):
            for f in fields:
                yield prefix + f.name, f
                yield from walk(f.fields, f"{prefix}{f.name}/")

        return list(walk(self.fields, ""))

    def searchable(self) -> list[str]:
        return [p for p, f in self.leaves() if f.searchable and not f.vector]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type(), not f.key) for f in self.fields])

    def metric(self, f: Field) -> str:
        return self.algorithms.get(f.profile or "", {}).get("metric", "cosine")


def known(names: set[str], given: dict) -> None:
    """ValueError where given has a name that isn't among names."""
    for n in given:
        if n not in names:
            raise ValueError(f"no field {n}")


def _bad(message: str) -> SearchError:
    return SearchError("InvalidIndex", message)


def _field(spec: dict, top: bool) -> Field:
    name, kind = spec.get("name"), spec.get("type", "")
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name):
        raise _bad(f"field name {name!r}")
    m = re.fullmatch(r"(?:Edm\.)?(?:(Collection)\((?:Edm\.)?(\w+)\)|(\w+))", kind)
    if not m:
        raise _bad(f"{name}: type {kind!r}")
    collection, one = bool(m[1]), m[2] or m[3]
    flags = {k: bool(spec.get(k, False)) for k in ("key", "searchable", "filterable", "sortable", "facetable")}
    flags |= {k: bool(spec.get(k, True)) for k in ("retrievable", "stored")}
    dimensions = spec.get("dimensions")
    if one not in SCALARS and one != "ComplexType" or collection and one not in IN_COLLECTIONS or one == "Half" and not collection:
        raise _bad(f"{name}: type {kind!r} isn't supported")
    if one == "ComplexType":
        if not spec.get("fields"):
            raise _bad(f"{name}: a complex field needs fields")
        if any(flags[k] for k in ("key", "searchable", "sortable", "facetable")):
            raise _bad(f"{name}: a complex field can't be key, searchable, sortable or facetable")
    if flags["key"] and (not top or collection or one not in ("String", "Int32", "Int64")):
        raise _bad(f"{name}: a key is a top-level string or integer")
    if flags["sortable"] and (collection or one in ("Duration", "Binary", "GeographyPoint")):
        raise _bad(f"{name}: {kind} can't be sorted")
    if dimensions is not None:
        if not (collection and one in ("Single", "Half")) or not top:
            raise _bad(f"{name}: a vector is a top-level collection of singles")
        if not isinstance(dimensions, int) or not 1 <= dimensions <= MAX_DIMENSIONS:
            raise _bad(f"{name}: dimensions go from 1 to {MAX_DIMENSIONS}")
        if not flags["searchable"] or any(flags[k] for k in ("filterable", "sortable", "facetable")):
            raise _bad(f"{name}: a vector is searchable and nothing else")
        if not spec.get("vectorSearchProfile"):
            raise _bad(f"{name}: a vector names a profile")
    subs = tuple(_field(s, False) for s in spec.get("fields") or ())
    _unique(s.name for s in subs)
    return Field(
        name, one, collection, **flags, dimensions=dimensions, profile=spec.get("vectorSearchProfile"), vectorizer=spec.get("vectorizer"),
        analyzer=spec.get("analyzer"), synonyms=tuple(spec.get("synonymMaps") or ()), fields=subs,
    )


def _unique(names) -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise _bad(f"field {n} is there twice")
        seen.add(n)


def parse(spec: dict) -> Index:
    """An index from its JSON form; InvalidIndex where it breaks a rule."""
    if not re.fullmatch(r"[a-z0-9](?:[a-z0-9-]{0,126}[a-z0-9])?", spec.get("name") or ""):
        raise SearchError("InvalidIndexName", f"index name {spec.get('name')!r}")
    fields = tuple(_field(s, True) for s in spec.get("fields") or ())
    _unique(f.name for f in fields)
    if sum(f.key for f in fields) != 1:
        raise _bad("exactly one field is the key")
    if sum(f.vector for f in fields) > MAX_VECTORS:
        raise _bad(f"more than {MAX_VECTORS} vectors")
    vs = spec.get("vectorSearch") or {}
    algorithms = {}
    for a in vs.get("algorithms") or []:
        kind = a.get("kind")
        if kind not in ("hnsw", "exhaustiveKnn"):
            raise _bad(f"vector algorithm {kind!r}")
        own = a.get(f"{kind}Parameters") or {}
        metric, m = own.get("metric", "cosine"), own.get("m", 4)
        if metric not in ("cosine", "dotProduct", "euclidean"):
            raise _bad(f"vector metric {metric!r}")
        if kind == "hnsw" and not 1 <= m <= 256:
            raise _bad("m goes from 1 to 256")
        algorithms[a["name"]] = {"kind": kind, "metric": metric, "m": m, "efConstruction": own.get("efConstruction", 400), "efSearch": own.get("efSearch", 500)}
    profiles = {}
    for p in vs.get("profiles") or []:
        if p.get("algorithm") not in algorithms:
            raise _bad(f"profile {p.get('name')} names no algorithm")
        profiles[p["name"]] = algorithms[p["algorithm"]] | {"vectorizer": p.get("vectorizer")}
    vectorizers = {v["name"]: v for v in vs.get("vectorizers") or spec.get("vectorizers") or []}
    for f in fields:
        if f.vector and f.profile not in profiles:
            raise _bad(f"{f.name}: no profile {f.profile}")
        if f.vectorizer and f.vectorizer not in vectorizers:
            raise _bad(f"{f.name}: no vectorizer {f.vectorizer}")
    out = Index(spec["name"], fields, {}, profiles, vectorizers, {})
    for s in spec.get("suggesters") or []:
        paths = tuple(s.get("searchFields") or s.get("sourceFields") or ())
        for p in paths:
            f = out.at(p)
            if f is None or not f.searchable or f.vector:
                raise _bad(f"suggester field {p} isn't searchable")
        out.suggesters[s["name"]] = paths
    out.semantic.update(semantics.configurations(out, spec.get("semantic") or spec.get("semanticSearch")))
    return out


def compatible(old: Index, new: Index) -> bool:
    """Whether documents of old can stay under new: each old top-level field is there with the same type and dimensions."""
    return all((n := new.at(f.name)) and (n.type, n.collection, n.dimensions, n.key) == (f.type, f.collection, f.dimensions, f.key) for f in old.fields)
