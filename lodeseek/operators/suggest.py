"""Suggestions and completions from the words of suggester fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..paths import resolve
from ..schema import Index


def words(index: Index, paths: list[str]) -> Column:
    """Words of the fields in field, value and word order."""
    parts = []
    for p in paths:
        col, many, _ = resolve(index, p)
        split = lambda x: F.regexp_extract_all(x.cast("string"), F.lit(r"((?U)\S+)"), F.lit(1))
        found = F.flatten(F.transform(F.filter(col, lambda x: x.isNotNull()), split)) if many else split(col)
        parts.append(F.coalesce(found, F.array().cast("array<string>")))
    return F.concat(*parts)


def like(word: Column, term: str, fuzzy: bool) -> Column:
    """A word matches a term that it holds, or that is one edit away."""
    low = F.lower(word)
    hit = low.contains(term)
    return hit | (F.levenshtein(low, F.lit(term), 1) >= 0) if fuzzy else hit


def scope(index: Index, suggester: str, fields: list[str] | None) -> list[str]:
    own = index.suggesters.get(suggester)
    if own is None:
        raise invalid(f"no suggester {suggester}")
    for p in fields or ():
        if p not in own:
            raise invalid(f"{p} isn't in suggester {suggester}")
    return list(fields or own)


def _terms(search: str) -> list[str]:
    out = search.lower().split()
    if not out:
        raise invalid("there is nothing to complete")
    return out


def suggest(docs: DataFrame, index: Index, paths: list[str], search: str, order: list[Column], top: int = 5, fuzzy: bool = False, tags: tuple[str, str] | None = None, held=None) -> DataFrame:
    """Documents in which each term matches some word, and the first word that matches the first term, as __text.

    held: a word index (operators.word_index.WordIndex), whose vocabulary is looked up; without one the documents' words are read.
    """
    terms = _terms(search)
    found = _looked_up(held, paths, terms, fuzzy) if held is not None else None
    if found is not None:
        rows = docs.join(found, "__key")
    else:
        rows = docs.withColumn("__words", words(index, paths))
        for t in terms:
            rows = rows.where(F.exists("__words", lambda w: like(w, t, fuzzy)))
        rows = rows.withColumn("__first", F.get(F.filter("__words", lambda w: like(w, terms[0], fuzzy)), F.lit(0))).drop("__words")
    first = F.col("__first")
    if tags:
        at = F.instr(F.lower(first), terms[0])
        n = len(terms[0])
        cut = F.concat(F.substring(first, F.lit(1), at - 1), F.lit(tags[0]), F.substring(first, at, F.lit(n)), F.lit(tags[1]), F.substring(first, at + n, F.length(first)))
        marked = F.when(at > 0, cut).otherwise(F.concat(F.lit(tags[0]), first, F.lit(tags[1])))
    else:
        marked = first
    return rows.withColumn("__text", marked).drop("__first").orderBy(*order).limit(top)


def _looked_up(held, paths: list[str], terms: list[str], fuzzy: bool) -> DataFrame | None:
    """__key and __first of the documents that hold a match for each term; null where too many words match to be named."""
    hits = [held.matching(paths, t, fuzzy) for t in terms]
    if any(h is None for h in hits):
        return None
    some = hits[0]
    for h in hits[1:]:
        some = some | h
    first = F.min(F.when(hits[0], F.struct("order", "place", "word")))
    keyed = held.rows(paths, some).groupBy("__key").agg(first.alias("first"), *[F.max(h).alias(f"h{i}") for i, h in enumerate(hits)])
    return keyed.where(" AND ".join(f"h{i}" for i in range(len(hits)))).select("__key", F.col("first.word").alias("__first"))


def complete(docs: DataFrame, index: Index, paths: list[str], search: str, mode: str = "oneTerm", top: int = 5, fuzzy: bool = False, held=None) -> DataFrame:
    """text, queryPlusText: completions of the last term, each once, in the order of documents and words. held: as in suggest()."""
    if mode not in ("oneTerm", "twoTerms", "oneTermWithContext"):
        raise invalid(f"mode {mode!r}")
    terms = _terms(search)
    two = mode == "twoTerms" and len(terms) > 1
    found = (_pairs if two else _lasts)(held, docs, paths, terms, fuzzy) if held is not None else None
    rows = docs.select("__key", words(index, paths).alias("w")) if found is None else None
    if two:
        prefix = " ".join(terms[:-2])
        if found is None:
            pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))
            rows = rows.where(F.size("w") >= 2).select("__key", F.posexplode(pairs).alias("at", "p"))
            found = rows.where((F.lower("p.a") == terms[-2]) & _second(F.col("p.b"), terms[-1], fuzzy)).select("__key", "at", F.concat_ws(" ", "p.a", "p.b").alias("text"))
    else:
        prefix = " ".join(terms[:-1]) if len(terms) > 1 else search.strip()
        if found is None:
            for t in terms[:-1]:
                rows = rows.where(F.exists("w", lambda w: F.lower(w).contains(t)))
            found = rows.select("__key", F.posexplode("w").alias("at", "text")).where(like(F.col("text"), terms[-1], fuzzy))
    once = found.groupBy("text").agg(F.min(F.struct("__key", "at")).alias("first"))
    return once.orderBy("first.__key", "first.at").limit(top).select("text", F.concat_ws(" ", *([F.lit(prefix)] if prefix else []), "text").alias("queryPlusText"))


def _second(word: Column, last: str, fuzzy: bool) -> Column:
    begins = F.lower(word).startswith(last)
    return begins | (F.levenshtein(F.lower(word), F.lit(last), 1) >= 0) if fuzzy else begins


def _lasts(held, docs: DataFrame, paths: list[str], terms: list[str], fuzzy: bool) -> DataFrame | None:
    """__key, at, text of the words that match the last term, in documents that hold the others, looked up."""
    last, others = held.matching(paths, terms[-1], fuzzy), [held.matching(paths, t, False) for t in terms[:-1]]
    if last is None or any(h is None for h in others):
        return None
    rows = held.rows(paths, last).select("__key", F.struct("order", "place").alias("at"), F.col("word").alias("text")).join(docs.select("__key"), "__key", "left_semi")
    for h in others:
        rows = rows.join(held.rows(paths, h).select("__key"), "__key", "left_semi")
    return rows


def _pairs(held, docs: DataFrame, paths: list[str], terms: list[str], fuzzy: bool) -> DataFrame:
    """The same for two words side by side: the second is the next one in the field, or after its last one the first of the next field that has any."""
    rows = held.rows(paths, F.col("low") == terms[-2]).join(docs.select("__key"), "__key", "left_semi")
    pairs = rows.where("next IS NOT NULL").select("__key", "order", "place", "word", "next")
    if len(paths) > 1:
        ends = rows.where("next IS NULL").select("__key", "order", "place", "word")
        firsts = held.rows(paths, F.col("place") == 0).select("__key", F.col("order").alias("later"), F.col("word").alias("other"))
        over = ends.join(firsts, "__key").where("later > order").groupBy("__key", "order", "place", "word").agg(F.min(F.struct("later", "other")).alias("x"))
        pairs = pairs.unionByName(over.select("__key", "order", "place", "word", F.col("x.other").alias("next")))
    return pairs.where(_second(F.col("next"), terms[-1], fuzzy)).select("__key", F.struct("order", "place").alias("at"), F.concat_ws(" ", "word", "next").alias("text"))
