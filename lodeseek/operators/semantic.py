"""Extractive answers, captions, reranker scores and highlights."""

from __future__ import annotations

import re
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import analyzers
from ..plans.bm25 import B, K1, text_column
from ..schema import Index
from ..storage import materialise

SHORT, LONG, CAPTION = 20, 500, 200


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: short ones join the next, long ones are cut between words."""
    if not text:
        return []
    raw = [s.strip() for s in re.split(r"(?<=[.!?;])(?=\s)|[\r\n]+", text)]
    out: list[str] = []
    held = ""
    for s in filter(None, raw):
        held = f"{held} {s}" if held else s
        if len(held) >= SHORT:
            out.append(held)
            held = ""
    if held:
        if out:
            out[-1] = f"{out[-1]} {held}"
        else:
            out.append(held)
    cut = []
    for s in out:
        while len(s) > LONG:
            at = s.rfind(" ", 0, LONG + 1)
            at = at if at > 0 else LONG
            cut.append(s[:at].strip())
            s = s[at:].strip()
        if s:
            cut.append(s)
    return cut


def _mapped(col: Column | str, made) -> Column:
    """made of each text, a list of texts."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(made)

    return F.pandas_udf(of, "array<string>")(col)


def query_terms(search: str, questions: list[str] = ()) -> list[str]:
    return [t for s in (search or "", *questions) for t in analyzers.tokens(s, None)]


def sentence_at(text: Column, at: Column) -> Column:
    """The sentence of that number."""

    def of(texts: pd.Series, ats: pd.Series) -> pd.Series:
        return pd.Series([sentences(t)[k] for t, k in zip(texts, ats)], dtype=object)

    return F.pandas_udf(of, "string")(text, at)


def answers(matched: DataFrame, index: Index, paths: list[str], terms: list[str], top: int = 3, held=None) -> DataFrame:
    """__key, field, text, score of the best sentences over all matches; scores are divided by the best one.

    held: a sentence index (operators.sentences.SentenceIndex), in which the terms are looked up; without one all matches are read.
    """
    schema = "__key string, field string, text string, score double"
    spark = matched.sparkSession
    if not terms or not paths:
        return spark.createDataFrame([], schema)
    if held is not None:
        found = held.answers(matched, paths, terms, top).withColumnRenamed("path", "field")
        best = F.max("score").over(Window.partitionBy())  # over top rows at most
        return found.orderBy(F.desc("score"), "__key", "order", "at").select("__key", "field", "text", (F.col("score") / best).alias("score"))
    distinct = list(dict.fromkeys(terms))

    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [_sentence(x, distinct) for x in sentences(t)])

    # tokenised once and written: sizes and counts of all sentences, and the texts of those that hold a term
    of = F.pandas_udf(counted, "array<struct<size:int,times:array<int>,text:string>>")
    per_field = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(p).alias("field"), of(text_column(index, p)).alias("s")) for i, p in enumerate(paths)])
    rows = matched.select("__key", F.explode(per_field).alias("f")).select("__key", "f.order", "f.field", F.posexplode("f.s").alias("at", "x"))
    held = materialise(rows.select("__key", "order", "field", "at", "x.*"), "sentences")
    times = [F.col("times")[i] for i in range(len(distinct))]
    row = held.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("l"), *[F.sum((x > 0).cast("long")).alias(f"d{i}") for i, x in enumerate(times)]).first()
    n, mean, score = row["n"], row["l"] or 1.0, F.lit(0.0)
    for i, t in enumerate(distinct):
        idf = F.log(F.lit(1 + (n - (row[f"d{i}"] or 0) + 0.5) / ((row[f"d{i}"] or 0) + 0.5)))
        score = score + terms.count(t) * idf * times[i] * (K1 + 1) / (times[i] + K1 * (1 - B + B * F.col("size") / mean))
    found = held.where("text IS NOT NULL").select("__key", "order", "field", "at", "text", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "__key", "order", "at").limit(top)
    best = F.max("score").over(Window.partitionBy())  # over top rows at most
    return found.select("__key", "field", "text", (F.col("score") / best).alias("score"))


def _sentence(text: str, terms: list[str]) -> dict:
    """Tokens of a sentence, how often each term is among them, and the text if one is."""
    tokens = analyzers.tokens(text, None)
    times = [tokens.count(t) for t in terms]
    return {"size": len(tokens), "times": times, "text": text if any(times) else None}


def shorten(text: str) -> str:
    if len(text) <= CAPTION:
        return text
    at = text.rfind(" ", 0, CAPTION + 1)
    return text[: at if at > 0 else CAPTION].rstrip() + "..."


def captions(index: Index, paths: list[str], n: int) -> Column:
    """The first n sentences of the caption fields, shortened."""

    def first(fields: list[str]) -> list[str]:
        return [shorten(s) for t in fields for s in sentences(t)][:n]

    return _mapped(F.array(*[F.coalesce(text_column(index, p), F.lit("")) for p in paths]), first)


def reranked(score: Column) -> Column:
    return F.when(score > 0, score / (score + 1)).otherwise(0.0)


def _fragments(text: str | None, wanted: set[str], analyzer: str | None, tags: tuple[str, str]) -> list[str]:
    out = []
    for s in re.split(r"(?<=[.!?])\s+|[\r\n]+", text or ""):
        spans = [m.span() for m in re.finditer(r"\S+", s) if wanted & set(analyzers.tokens(m[0], analyzer))]
        if not spans:
            continue
        windows = [(0, len(s))]
        if len(s.encode()) > 200:
            windows = []
            for a, b in spans:
                lo, hi = max(0, a - 100), min(len(s), b + 100)
                if windows and lo <= windows[-1][1]:
                    windows[-1] = (windows[-1][0], hi)
                else:
                    windows.append((lo, hi))
        for lo, hi in windows:
            piece, at = [], lo
            for a, b in spans:
                if lo <= a and b <= hi:
                    piece += [s[at:a], tags[0], s[a:b], tags[1]]
                    at = b
            out.append("".join([*piece, s[at:hi]]).strip())
            if len(out) == 3:
                return out
    return out


def highlights(index: Index, path: str, words: list[str], tags: tuple[str, str] = ("<em>", "</em>")) -> Column:
    """Up to three fragments of a field with its matching words in tags; meant for a page, not a corpus."""
    analyzer = index.at(path).analyzer
    made = partial(_fragments, wanted={t for w in words for t in analyzers.tokens(w, analyzer)}, analyzer=analyzer, tags=tags)

    return _mapped(text_column(index, path), made)
