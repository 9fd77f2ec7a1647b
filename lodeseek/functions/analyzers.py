"""Analyzers: texts to tokens, the same way for documents (a column) and for queries (in Python).

Analyzers without stemming are built-in expressions. Those with stopwords and stems are Arrow
UDFs that remember each word's stem.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stems import LANGUAGES, english

# The classic short English stopword list.
ENGLISH_STOPWORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
LONGEST = 40  # bytes; longer tokens are dropped
GRAMS = 15
GAP = "\x00"  # stands where a stopword stood, so that the words around it aren't neighbours
_alnum, _cjk = re.compile(r"[^\W_]+"), re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]+")

#: Language codes, before the dot of an analyzer's name, that are split without stems, or by pairs of characters.
LATIN = {"latin", "thai", "vietnamese", "th", "vi"}
CJK = {"chinese", "japanese", "korean", "zh-Hans", "zh-Hant", "ja", "ko"}


def kind(name: str | None) -> str:
    """keyword, whitespace, alphanum, latin, ngram, edge, cjk, or a language's code."""
    name = name or "english"
    if name in ("keyword", "whitespace", "alphanum"):
        return name
    code = name.split(".")[0]
    if code in LATIN:
        return "latin"
    if code in CJK:
        return "cjk"
    if name.lower().startswith("edgengram"):
        return "edge"
    if name.lower().startswith("ngram"):
        return "ngram"
    return code if code in LANGUAGES and code != "en" else "en"


def _words(text: str) -> list[str]:
    return [w for w in _alnum.findall(text) if len(w.encode()) < LONGEST]


def split(text: str) -> list[str]:
    """Words of a text as they are, long ones too: those of raw() for an analyzer with stems."""
    return _alnum.findall(text)


@lru_cache(maxsize=1 << 16)
def _stem(code: str, word: str) -> str | None:
    stop, stem = (ENGLISH_STOPWORDS, english) if code == "en" else LANGUAGES[code]
    return None if word in stop else stem(word)


def _cjk_tokens(text: str) -> list[str]:
    out = []
    for m in re.finditer(r"[぀-ヿ㐀-䶿一-鿿가-힯]+|[^\W_぀-ヿ㐀-䶿一-鿿가-힯]+", text):
        run = m[0]
        if not _cjk.match(run):
            out.append(run)
        else:
            out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def tokens(text: str, name: str | None) -> list[str]:
    """Tokens of a query's text."""
    k = kind(name)
    if k == "keyword":
        return [text]
    if k == "whitespace":
        return text.split()
    if k == "alphanum":
        return _alnum.findall(text)
    if k == "latin":
        return [w.lower() for w in _words(text)]
    if k == "edge":
        return [text[:n].lower() for n in range(1, min(GRAMS, len(text)) + 1)]
    if k == "ngram":
        return [text[i : i + n].lower() for i in range(len(text)) for n in range(1, min(GRAMS, len(text) - i) + 1)]
    if k == "cjk":
        return _cjk_tokens(text)
    return [t for w in _words(text) if (t := _stem(k, w.lower())) is not None]


def placed(text: str, name: str | None) -> list[str]:
    """tokens() of a document's text, with GAP for each stopword."""
    if not gapped(name):
        return tokens(text, name)
    return [GAP if (t := _stem(kind(name), w.lower())) is None else t for w in _words(text)]


def gapped(name: str | None) -> bool:
    """Whether column() can hold GAP."""
    return kind(name) == "en" or kind(name) in LANGUAGES


def lowered(name: str | None) -> bool:
    """Whether all tokens are lower-cased."""
    return kind(name) not in ("keyword", "whitespace", "alphanum", "cjk")


def _udf(name: str | None) -> Callable:
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else placed(t, name))

    return F.pandas_udf(of, "array<string>")


def column(col: Column, name: str | None) -> Column:
    """Tokens of a text column, in order, with GAP for stopwords; null for null."""
    k = kind(name)
    alnum = F.regexp_extract_all(col, F.lit(r"[\p{IsAlphabetic}\p{N}]++"), F.lit(0))
    if k == "keyword":
        return F.when(col.isNotNull(), F.array(col))
    if k == "whitespace":
        return F.regexp_extract_all(col, F.lit(r"((?U)\S+)"), F.lit(1))
    if k == "alphanum":
        return alnum
    if k == "latin":
        return F.filter(F.regexp_extract_all(F.lower(col), F.lit(r"[\p{IsAlphabetic}\p{N}]++"), F.lit(0)), lambda t: F.octet_length(t) < LONGEST)
    if k == "edge":
        upto = F.least(F.lit(GRAMS), F.char_length(col))
        return F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda n: F.lower(F.substring(col, F.lit(1), n)))).when(col.isNotNull(), F.array().cast("array<string>"))
    if k == "ngram":
        n = F.char_length(col)
        grams = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAMS), n - i + 1)), lambda g: F.lower(F.substring(col, i, g)))))
        return F.when(n > 0, grams).when(col.isNotNull(), F.array().cast("array<string>"))
    return _udf(name)(col)


def words(col: Column) -> Column:
    """Runs of letters and digits of a text, as they are."""
    return F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def raw(col: Column, name: str | None) -> Column:
    """Tokens of which finished() makes those of column(), each distinct one once."""
    if gapped(name):
        return words(col)
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{IsAlphabetic}\p{N}]++"), F.lit(0)) if kind(name) == "latin" else column(col, name)


def finished(distinct: list[str], name: str | None) -> list[str | None] | None:
    """What becomes of each of raw() (see stemmed()); null where they are tokens as they are."""
    if gapped(name):
        return stemmed(distinct, name)
    return [w if len(w.encode()) < LONGEST else None for w in distinct] if kind(name) == "latin" else None


def stemmed(distinct: list[str], name: str | None) -> list[str | None]:
    """What becomes of each of words(): its stem, GAP for a stopword, null for one that is too long."""
    code = kind(name)
    made = ((w, _stem(code, w.lower())) if len(w.encode()) < LONGEST else (w, "") for w in distinct)
    return [GAP if t is None else t or None for _, t in made]


def analyze(text: str, name: str | None) -> list[dict]:
    """token, startOffset, endOffset (UTF-8 bytes) and position of each token."""
    k = kind(name)
    byte = lambda i: len(text[:i].encode())
    if k in ("keyword", "edge", "ngram"):
        found = tokens(text, name)
        spans = [(0, len(text))] * len(found)
        return [{"token": t, "startOffset": byte(s), "endOffset": byte(e), "position": 0 if k != "keyword" else i} for i, (t, (s, e)) in enumerate(zip(found, spans))]
    out, position = [], 0
    for m in (re.finditer(r"\S+", text) if k == "whitespace" else _alnum.finditer(text)):
        word = m[0]
        if k in ("whitespace", "alphanum"):
            made: list[str] = [word]
        elif k == "cjk":
            made = _cjk_tokens(word)
        else:
            made = tokens(word, name)
        for t in made:
            out.append({"token": t, "startOffset": byte(m.start()), "endOffset": byte(m.end()), "position": position})
        position += 1
    return out


def analyzed(col: Column, name: str | None) -> Column:
    """analyze() of a text column: an array of token, startOffset, endOffset, position."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else analyze(t, name))

    return F.pandas_udf(of, "array<struct<token:string,startOffset:bigint,endOffset:bigint,position:bigint>>")(col)
