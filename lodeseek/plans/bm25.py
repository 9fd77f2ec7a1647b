"""Full-text matching and BM25 as columns.

With a text index, a query reads the postings of its terms: statistics come from the vocabulary, the
postings are gathered by document, and matches are joined with the documents. Without one, documents
are tokenised as they are read: one aggregate over the whole index gives the number of documents, average lengths and document
frequencies: a single row, whatever the data's size, that enters the scores as literals. Scores
then are arithmetic in place, without a shuffle. A filter comes after, so it never changes them.
"""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyzers
from ..paths import resolve
from ..schema import Index
from ..storage import materialise
from .query_text import Clause, Group, synonyms

K1, B = 1.2, 0.75
#: Matches that may be broadcast to be joined with documents; more are joined by their key.
BROADCAST_ROWS = 200_000
#: Blocks that may be named in a filter, and the largest page that is looked for block by block; postings from which that is done.
FIRST, PRUNED_FROM = 4096, 1_000_000


def text_column(index: Index, path: str) -> Column:
    """Text of a field: texts as they are, numbers and booleans as texts, collections joined by breaks."""
    col, many, f = resolve(index, path)
    as_text = number_text if f.type in ("Single", "Double", "Half") else lambda x: x.cast("string")
    if many:
        return F.array_join(F.transform(col, as_text), "\n")
    return col if f.type == "String" else as_text(col)


def number_text(col: Column) -> Column:
    """The shortest form of a floating number: plain from 0.00001 up to below 10 ** 16, else with an exponent as in 1.5e-7 and 1e21."""
    plain = col.cast("double").cast("string")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    head, power = F.regexp_extract(plain, r"^-?([^E]+)E", 1), F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(head, r"\.", ""), r"(?<=.)0+$", "")
    whole = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    rest = F.substr(digits, power + 2)
    large = F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    powered = F.concat(sign, F.regexp_replace(head, r"\.0$", ""), F.lit("e"), power.cast("string"))
    return F.when(power.isNull(), plain).when((power >= 7) & (power < 16), large).when((power < 0) & (power >= -5), small).otherwise(powered)


def _swaps(word: str) -> list[str]:
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def near(token: Column, word: str, distance: int) -> Column:
    """Whether a token is within distance edits of word; a swap of neighbours is one edit."""
    out = F.levenshtein(token, F.lit(word), distance) >= 0
    swapped = _swaps(word)
    if distance >= 1 and swapped:
        out = out | token.isin(swapped)
    if distance == 2:
        twice = sorted({x for s in swapped for x in _swaps(s)})
        for s in swapped:
            out = out | (F.levenshtein(token, F.lit(s), 1) >= 0)
        if twice:
            out = out | token.isin(twice)
    return out


def literals(c: Clause, size: int = 3) -> list[list[str]] | None:
    """Sets of three characters of which a term that the clause hits holds at least one whole; null where nothing is known.

    A fuzzy word is cut in pieces: an edit spoils one, a swap two at most, so that one of 2 * distance + 1 stays whole.
    Of a regular expression, runs of plain letters that stand in no group or alternative are in every hit.
    """
    runs: list[str] = []
    if c.kind == "fuzzy":
        word, n = c.text.lower(), 2 * c.distance + 1
        if len(word) < size * n:
            return None
        cuts = [len(word) * i // n for i in range(n + 1)]
        return [[word[i : i + size] for i in range(a, b - size + 1)] for a, b in zip(cuts, cuts[1:])]
    if c.kind == "regex":
        try:
            parsed = list(re._parser.parse(c.text))
        except (re.error, OverflowError):
            return None
        run = ""
        for op, value in [*parsed, (None, None)]:
            plain = str(op) == "LITERAL" and chr(value).isascii() and chr(value).isalnum()
            if plain:
                run += chr(value).lower()
            else:
                runs, run = [*runs, run], ""
    found = [g for r in runs for g in (r[i : i + size] for i in range(len(r) - size + 1))]
    return [found] if found else None


def _minus(k: int):
    return lambda x: x - k


def _clauses(node) -> list[Clause]:
    return [node] if isinstance(node, Clause) else [c for n in (*node.must, *node.should, *node.never) for c in _clauses(n)]


class Plan:
    """A query over an index: adds the columns __match, __score and what they need."""

    def __init__(self, index: Index, query: Group | Clause, fields: dict[str, float], rules: dict[str, list[str]] | None = None):
        self.index, self.query, self.fields, self.rules = index, query, fields, rules or {}
        self.names = {p: f"__tokens{i}" for i, p in enumerate(fields)}
        self.wanted: dict[tuple[str, str], int] = {}
        self.indexed = self.bounding = False
        self._gather(query)

    def _scope(self, c: Clause) -> dict[str, float]:
        return {c.field: self.fields.get(c.field, 1.0)} if c.field else self.fields

    def analyzed(self, c: Clause, path: str) -> list[str]:
        f = self.index.at(path)
        found = analyzers.tokens(c.text, f.analyzer)
        if c.kind == "term":
            for m in f.synonyms:
                for w in synonyms(self.rules.get(m, []), c.text):
                    found += analyzers.tokens(w, f.analyzer)
        return list(dict.fromkeys(found)) if c.kind == "term" else found

    def _gather(self, node) -> None:
        if isinstance(node, Group):
            for n in (*node.must, *node.should, *node.never):
                self._gather(n)
            return
        for path in self._scope(node) if node.kind != "all" else ():
            if path not in self.names:
                self.names[path] = f"__tokens{len(self.names)}"
            for t in self.analyzed(node, path) if node.kind in ("term", "phrase") else ():
                self.wanted.setdefault((path, t), len(self.wanted))

    def _count(self, path: str, token: str) -> Column:
        col = F.col(f"__times{self.wanted[path, token]}")
        return F.coalesce(col, F.lit(0)) if self.indexed else col

    def _size(self, path: str) -> Column:
        return F.coalesce(F.col(f"__size{self.sizes[path]}"), F.lit(0)) if self.indexed else self._length(path)

    def _length(self, path: str) -> Column:
        """Tokens of a field, without the gaps."""
        tokens = F.col(self.names[path])
        return F.size(F.array_remove(tokens, analyzers.GAP) if analyzers.gapped(self.index.at(path).analyzer) else tokens)

    def _open(self, node) -> bool:
        """Whether a document without any of the query's terms can match."""
        if isinstance(node, Clause):
            return node.kind == "all"
        if node.must:
            return all(self._open(n) for n in node.must)
        return not node.should or any(self._open(n) for n in node.should)

    def _expansions(self, node) -> list[tuple[Clause, str]]:
        if isinstance(node, Clause):
            return [(node, p) for p in self._scope(node)] if node.kind not in ("all", "term", "phrase") else []
        return [x for n in (*node.must, *node.should, *node.never) for x in self._expansions(n)]

    def _expand(self, text) -> dict[tuple[Clause, str], Any]:
        """Terms of the vocabulary that each clause hits which isn't a term itself."""
        out = {}
        for c, p in dict.fromkeys(self._expansions(self.query)):
            low = analyzers.lowered(self.index.at(p).analyzer)
            start = c.text.lower() if c.kind == "prefix" and low else None
            grams = literals(c) if low else None
            out[c, p] = text.expand(p, self._test(c), grams, start)
        return out

    def _open_index(self, text) -> None:
        """Statistics of the terms asked for, from the vocabulary."""
        self.indexed = True
        self.n, tokens = text.totals()
        self.length = {p: tokens.get(p, 0) / max(1, self.n) for p in self.names}
        found = text.frequencies(list(self.wanted))
        self.frequency = {k: found.get(k, 0) for k in self.wanted}
        self.sizes = {p: i for i, p in enumerate(self.names)}

    def _keyed(self, rows: DataFrame, hits: list[Column], phrases: bool) -> DataFrame:
        """A row for each document of postings: what _eval asks for."""
        aggs = [F.max(F.when(F.col("path") == p, F.col("size"))).alias(f"__size{i}") for p, i in self.sizes.items()]
        for (p, t), i in self.wanted.items():
            mine = (F.col("path") == p) & (F.col("term") == t)
            aggs.append(F.max(F.when(mine, F.col("times"))).alias(f"__times{i}"))
            if phrases:
                aggs.append(F.max(F.when(mine, F.col("positions"))).alias(f"__at{i}"))
        aggs += [F.max(hit).alias(f"__hit{i}") for i, hit in enumerate(hits)]
        return rows.groupBy("__key").agg(*aggs)

    def _looked_up(self, docs: DataFrame, text, least: float | None) -> DataFrame:
        """scored() by a text index (plans.postings.TextIndex)."""
        from .postings import either

        self._open_index(text)
        expanded = self._expand(text)
        self.hits = {x: i for i, x in enumerate(expanded)}
        phrases = any(c.kind == "phrase" for c in _clauses(self.query))
        columns = ["__key", "path", "term", "times", "size", *(["positions"] if phrases else [])]
        named = [(x.path, t) for x in expanded.values() if x.terms is not None for t in x.terms]
        rows = text.postings().where(either([*self.wanted, *named])).select(*columns, F.lit(None).cast("int").alias("hit"))
        hits = []
        for i, x in enumerate(expanded.values()):
            if x.terms is None:  # more than can be named: their postings by a join
                more = text.postings().where(F.col("path") == x.path).join(x.rows, "term", "left_semi")
                rows = rows.unionByName(more.select(*columns, F.lit(i).alias("hit")))
                hits.append(F.coalesce(F.col("hit") == i, F.lit(False)))
            else:
                hits.append((F.col("path") == x.path) & F.col("term").isin(x.terms) if x.terms else F.lit(False))
        keyed = self._keyed(rows, hits, phrases)
        match, score = self._eval(self.query)
        if least:
            match = match & self._covered(least)
        done = {"__match": match, "__score": F.when(match, score).otherwise(0.0)}
        if self._open(self.query):
            out = docs.join(keyed, "__key", "left").withColumns(done)
            return out.select(*docs.columns, "__match", "__score")
        few = keyed.withColumns(done).where("__match").select("__key", "__match", "__score")
        if not self.hits and sum(self.frequency.values()) <= BROADCAST_ROWS:
            few = F.broadcast(few)  # as many rows at most as the terms have documents
        return docs.join(few, "__key").select(*docs.columns, "__match", "__score")

    def best(self, docs: DataFrame, text, k: int, keep: Column | None = None) -> tuple[DataFrame, dict] | None:
        """__key and __score of documents that hold the k best by score and key, and how many blocks were read; null where the query can't be pruned.

        A block's bound is its score with each term's largest count and smallest size in it. The blocks with the best
        bounds are scored first; of the others only those are read whose bound reaches the k-th best score.
        """
        from .postings import either

        if not 0 < k <= FIRST or self._open(self.query) or any(c.kind != "term" or c.boost < 0 for c in _clauses(self.query)) or not self.wanted:
            return None
        self._open_index(text)
        self.hits = {}
        if sum(self.frequency.values()) < PRUNED_FROM:
            return None
        aggs = []
        for (p, t), i in self.wanted.items():
            mine = (F.col("path") == p) & (F.col("term") == t)
            aggs += [F.max(F.when(mine, F.col("most"))).alias(f"__times{i}"), F.min(F.when(mine, F.col("least"))).alias(f"__least{i}")]
        self.bounding = True
        match, bound = self._eval(self.query)
        self.bounding = False
        blocks = text.held.read("blocks").where(either(list(self.wanted))).groupBy("block").agg(*aggs).where(match).select("block", bound.alias("bound"))
        blocks = materialise(blocks, "block-bounds")
        all_, first = blocks.count(), [r["block"] for r in blocks.orderBy(F.desc("bound"), "block").limit(max(FIRST // 16, k // 4)).collect()]
        match, score = self._eval(self.query)

        def scored(rows: DataFrame) -> DataFrame:
            found = self._keyed(rows, [], False).where(match).select("__key", score.alias("__score"))
            return found if keep is None else found.join(docs.where(keep).select("__key"), "__key", "left_semi")

        postings = text.postings().where(either(list(self.wanted)))
        top = scored(postings.where(F.col("block").isin(first))).orderBy(F.desc("__score"), "__key").limit(k).collect()
        least = top[-1]["__score"] * (1 - 1e-9) if len(top) == k else -1.0
        left = [r["block"] for r in blocks.where(F.col("bound") >= least).limit(FIRST + 1).collect()]
        read = len(set(first) | set(left)) if len(left) <= FIRST else blocks.where(F.col("bound") >= least).count()
        info = {"blocks": all_, "read": read}
        if set(left) <= set(first):
            return blocks.sparkSession.createDataFrame([tuple(r) for r in top], "__key string, __score double"), info
        if len(left) <= FIRST:
            return scored(postings.where(F.col("block").isin(left))), info
        return scored(postings.join(blocks.where(F.col("bound") >= least).select("block"), "block", "left_semi")), info

    def scored(self, docs: DataFrame, least: float | None = None, text=None, keep: Column | None = None) -> DataFrame:
        """docs with __match and __score, of those that pass keep; with a text index perhaps matches only.

        least: the share of optional clauses that a match needs. keep never changes a score: statistics come
        from the index, or without one from a pass over the searched columns of all documents.
        """
        passed = docs if keep is None else docs.where(keep)
        if isinstance(self.query, Clause) and self.query.kind == "all":
            return passed.withColumns({"__match": F.lit(True), "__score": F.lit(1.0)})
        if not self.fields and not self.names:
            return passed.withColumns({"__match": F.lit(False), "__score": F.lit(0.0)})
        if text is not None:
            return self._looked_up(passed, text, least)
        made = [F.coalesce(analyzers.column(text_column(self.index, p), self.index.at(p).analyzer), F.array().cast("array<string>")).alias(n) for p, n in self.names.items()]
        # as a row of a generator, tokens are made once; as a column they would be made anew wherever a clause or filter names them
        tokenised = lambda df: df.select("*", F.inline(F.array(F.struct(*made))))
        held = tokenised(docs)
        aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(self._length(p)).alias(f"l{i}") for i, p in enumerate(self.names)]
        aggs += [F.sum(F.array_contains(self.names[p], t).cast("long")).alias(f"d{i}") for (p, t), i in self.wanted.items()]
        row = held.agg(*aggs).first()
        self.n = row["n"]
        self.length = {p: row[f"l{i}"] or 0.0 for i, p in enumerate(self.names)}
        self.frequency = {k: row[f"d{i}"] or 0 for k, i in self.wanted.items()}
        held = tokenised(passed)
        if self.wanted:  # counted once for each row, too; without a lambda, which would not be compiled
            counted = [(F.size(self.names[p]) - F.size(F.array_remove(self.names[p], t))).alias(f"__times{i}") for (p, t), i in self.wanted.items()]
            held = held.select("*", F.inline(F.array(F.struct(*counted))))
        match, score = self._eval(self.query)
        if least:
            match = match & self._covered(least)
        out = held.withColumns({"__match": match, "__score": F.when(match, score).otherwise(0.0)})
        return out.drop(*self.names.values(), *[f"__times{i}" for i in self.wanted.values()])

    def _weight(self, path: str, token: str, times: Column) -> Column:
        frequency = self.frequency[path, token]
        idf = math.log(1 + (self.n - frequency + 0.5) / (frequency + 0.5))
        mean = self.length[path] or 1.0
        size = F.col(f"__least{self.wanted[path, token]}") if self.bounding else self._size(path)
        return F.lit(idf * (K1 + 1)) * times / (times + F.lit(K1 * (1 - B)) + size * F.lit(K1 * B / mean))

    def _eval(self, node) -> tuple[Column, Column]:
        if isinstance(node, Clause):
            match, score = self._clause(node)
            return match, score * F.lit(node.boost) if node.boost != 1 else score
        made = {k: [self._eval(n) for n in getattr(node, k)] for k in ("must", "should", "never")}
        match, score = F.lit(True), F.lit(0.0)
        for m, s in made["must"]:
            match, score = match & m, score + s
        some = F.lit(False)
        for m, s in made["should"]:
            some, score = some | m, score + F.when(m, s).otherwise(0.0)
        if made["should"] and not made["must"]:
            match = match & some
        for m, _ in made["never"] if not self.bounding else ():  # a block may hold others
            match = match & ~m
        return match, score * F.lit(node.boost)

    def _clause(self, c: Clause) -> tuple[Column, Column]:
        if c.kind == "all":
            return F.lit(True), F.lit(1.0)
        match, score = F.lit(False), F.lit(0.0)
        for path, boost in self._scope(c).items():
            if c.kind == "term":
                parts = []
                for t in self.analyzed(c, path):
                    times = self._count(path, t)
                    parts.append((times > 0, F.when(times > 0, self._weight(path, t, times)).otherwise(0.0)))
            elif c.kind == "phrase":
                parts = self._phrase(path, self.analyzed(c, path))
            else:
                hit = F.coalesce(F.col(f"__hit{self.hits[c, path]}"), F.lit(False)) if self.indexed else F.exists(F.col(self.names[path]), self._word_test(c))
                parts = [(hit, F.when(hit, 1.0).otherwise(0.0))]
            for m, s in parts:
                match, score = match | m, score + s * F.lit(boost)
        return match, score

    def _phrase(self, path: str, words: list[str]) -> list[tuple[Column, Column]]:
        if not words:
            return []
        if self.indexed:
            at = [F.coalesce(F.col(f"__at{self.wanted[path, w]}"), F.array().cast("array<int>")) for w in words]
            places = at[0]
            for k, p in enumerate(at[1:], 1):
                places = F.array_intersect(places, F.transform(p, _minus(k)))
            times = F.size(places)
        else:
            joined = F.concat(F.lit("\x01"), F.array_join(F.col(self.names[path]), "\x01"), F.lit("\x01"))
            quoted = "".join(re.escape(w) + "\x01" for w in words)
            times = F.regexp_count(joined, F.lit(f"(?=\x01{quoted})"))  # places may overlap
        idf = sum(math.log(1 + (self.n - self.frequency[path, w] + 0.5) / (self.frequency[path, w] + 0.5)) for w in words)
        mean = self.length[path] or 1.0
        weight = F.lit(idf * (K1 + 1)) * times / (times + F.lit(K1 * (1 - B)) + self._size(path) * F.lit(K1 * B / mean))
        return [(times > 0, F.when(times > 0, weight).otherwise(0.0))]

    def _word_test(self, c: Clause):
        test = self._test(c)
        return lambda t: (t != analyzers.GAP) & test(t)

    def _test(self, c: Clause):
        word = c.text.lower()
        if c.kind == "fuzzy":
            return lambda t: near(t, word, c.distance)
        if c.kind == "prefix":
            return lambda t: F.lower(t).startswith(word)
        if c.kind == "regex":
            return lambda t: t.rlike(f"(?iu)^(?:{c.text})$")

        def within(t: Column) -> Column:
            test = F.lit(True)
            if c.text != "*":
                test = test & ((t >= word) if c.inclusive[0] else (t > word))
            if c.upper != "*":
                test = test & ((t <= c.upper.lower()) if c.inclusive[1] else (t < c.upper.lower()))
            return test

        return within

    def _covered(self, least: float) -> Column:
        """Whether at least a share of the optional clauses match."""
        wanted = self.query.should if isinstance(self.query, Group) else ()
        if len(wanted) < 2:
            return F.lit(True)
        return sum((self._eval(c)[0].cast("int") for c in wanted), F.lit(0)) >= math.ceil(least * len(wanted))
