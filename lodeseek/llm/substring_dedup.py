"""Substring dedup by hashing paragraphs, lines and sentences.

Units are paragraphs of several lines (blocks between blank lines), lines of LINE_WORDS words or
more, and sentences (what ends in . ! ? before white space, or with the line). A unit is lower-cased and its white space collapsed before it is hashed to 128
bits. Of equal units the one ranked earliest stays: ranks go by doc_id (null last), then by the
row's hash, then by place in the text. A repeated paragraph or line goes as a whole. A run of repeated sentences
is extended over the words of the sentences beside it as far as they equal those beside an earlier
holder of the run's first or last sentence, as passages seldom start and end with sentences. It goes
where it then has RUN_WORDS words or more, so that common short sentences alone stay. Thereby all
words that go stay at an earlier place. Removed spans are kept as offsets into the original text.

Null texts count as empty and stay empty; rows with the same doc_id and text are one row to the
ranks and fare alike; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import free, lookup, materialise, table, text_of

LINE_WORDS, RUN_WORDS = 5, 10
SLICE, COMMON = 2000, 50_000
#: A unit's place is KINDS * its number among its kind, and SENTENCE, LINE or PARAGRAPH.
KINDS, SENTENCE, LINE, PARAGRAPH = 3, 0, 1, 2
_sentences = re.compile(r"[^\n.!?]+(?:[.!?]+(?=[^\s.!?])[^\n.!?]+)*[.!?]*").finditer
_words = re.compile(r"\S+").finditer


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _sentences(text)]


def lines(text: str) -> list[tuple[int, int]]:
    """Spans of lines with the line break that ends them."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        out.append((at, end))
        at = end
    return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans of two neighbouring lines or more that aren't blank, with the line break that ends them."""
    out: list[tuple[int, int]] = []
    first, n = 0, 0
    for s, e in [*lines(text), (len(text), len(text))]:
        if text[s:e].strip():
            first, n = (first, n + 1) if n else (s, 1)
        else:
            if n > 1:
                out.append((first, s))
            n = 0
    return out


def lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # some characters are lower-cased to two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def beside(low: str, spans: list[tuple[int, int]], k: int, after: bool) -> list[tuple[int, int]]:
    """Words of the sentence that stands before or after sentence k, the nearest to k first."""
    step = 1 if after else -1
    k += step
    while 0 <= k < len(spans) and not low[spans[k][0] : spans[k][1]].strip():
        k += step
    if not 0 <= k < len(spans):
        return []
    s, e = spans[k]
    return [(s + m.start(), s + m.end()) for m in _words(low[s:e])][::step]


def units(text: str) -> list[tuple[int, bytes]]:
    """(place, digest) of each unit."""
    low = lowered(text)
    out = []
    for kind, least, mark, spans in ((SENTENCE, 1, "s", sentences(text)), (LINE, LINE_WORDS, "l", lines(text)), (PARAGRAPH, LINE_WORDS, "p", paragraphs(text))):
        for k, (s, e) in enumerate(spans):
            words = low[s:e].split()
            if len(words) >= least:
                out.append((KINDS * k + kind, xxhash.xxh3_128_digest(mark + " ".join(words))))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of each SLICE of rows. In a slice only the earliest of equal units stands for them; the others
    are lost already and go on under a digest of their own, so that no common unit meets in one task; they
    name the earliest one's row and place. Up to COMMON units that a slice repeated are remembered for the
    slices after it, so that a common unit stands for a task about once."""
    import numpy as np

    common: dict[bytes, tuple] = {}
    for b in (x.slice(at, SLICE) for x in batches for at in range(0, x.num_rows, SLICE)):
        first: dict[bytes, tuple] = {}
        again: set[bytes] = set()
        rows = []
        for key, doc_id, text in zip(b.column("row_key").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
            for place, digest in units(text.as_py()):
                rank = (doc_id is None, doc_id or 0, key, place)
                rows.append((digest, rank))
                held = first.get(digest) or common.get(digest)
                if held is not None and held < rank:
                    again.add(digest)
                    first[digest] = held
                else:
                    first[digest] = rank
        if not rows:
            continue
        lost = np.array([first[d] != r for d, r in rows])
        digest = np.frombuffer(b"".join(d for d, _ in rows), dtype="<i8").reshape(-1, 2).copy()
        none, ids, keys, places = (np.array(x) for x in zip(*(r for _, r in rows)))
        held = [first[d] if x else None for (d, _), x in zip(rows, lost.tolist())]
        digest[lost, 0], digest[lost, 1] = keys[lost], places[lost]
        cols = [pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(lost), pa.array(ids.astype("i8"), mask=none.astype(bool)), pa.array(keys.astype("i8")), pa.array(places.astype("i8"))]
        cols += [pa.array([h and h[k] for h in held], pa.int64()) for k in (2, 3)]
        yield pa.record_batch(cols, names=["d0", "d1", "lost", "doc_id", "row_key", "place", "from_key", "from_place"])
        if len(common) > COMMON:
            common.clear()
        common.update((d, first[d]) for d in again)


def removed(docs: DataFrame) -> DataFrame:
    """row_key, the places of the units that aren't the earliest of their kind, and those with an earlier holder's row and place, for rows that have any."""
    rows = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = rows.mapInArrow(_units, "d0 long, d1 long, lost boolean, doc_id long, row_key long, place long, from_key long, from_place long")
    order = Window.partitionBy("d0", "d1", "lost").orderBy(F.asc_nulls_last("doc_id"), "row_key", "place")
    again = found.withColumns({"rank": F.rank().over(order), "first": F.first(F.struct("row_key", "place")).over(order)}).where("lost OR rank > 1")
    held = F.struct("place", F.coalesce("from_key", "first.row_key").alias("from_key"), F.coalesce("from_place", "first.place").alias("from_place"))
    return again.groupBy("row_key").agg(F.collect_set("place").alias("places"), F.collect_set(held).alias("units"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where runs of repeated sentences start and end: row_key, place, after, and the row and place of an earlier holder."""
    for b in batches:
        out = []
        for key, found in zip(b.column("row_key").to_pylist(), b.column("units").to_pylist()):
            held = {}  # of equal rows' holders one
            for place, *at in sorted((u["place"], u["from_key"], u["from_place"]) for u in found):
                held.setdefault(place, at)
            out += [(key, p, after, *at) for p, at in held.items() if p % KINDS == SENTENCE for after in (False, True) if p + (KINDS if after else -KINDS) not in held]
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["row_key", "place", "after", "from_key", "from_place"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beside the sentences that a row is asked for."""
    for b in batches:
        out = []
        for key, text, asked in zip(b.column("row_key").to_pylist(), b.column("text"), b.column("asked").to_pylist()):
            t = text.as_py()
            low, spans = lowered(t), sentences(t)
            for a in asked:
                words = " ".join(low[s:e] for s, e in beside(low, spans, a["from_place"] // KINDS, a["after"]))
                if words:
                    out.append((key, a["from_place"], a["after"], a["n"], words))
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["from_key", "from_place", "after", "n", "words"])


def surroundings(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row_key and, for each edge of its runs, what stands beside an earlier holder (place, after, words: the nearest first)."""
    edges = materialise(gone.select("row_key", "units").mapInArrow(_edges, "row_key long, place long, after boolean, from_key long, from_place long"), "substring-edges")
    asked = edges.groupBy("from_key", "from_place", "after").agg(F.count("*").alias("n"))
    asked = asked.groupBy(F.col("from_key").alias("row_key")).agg(F.collect_list(F.struct("from_place", "after", "n")).alias("asked"))
    texts = docs.select(row_key().alias("row_key"), text_of().alias("text"))
    told = texts.join(asked.hint("merge"), "row_key").select("row_key", "text", "asked").mapInArrow(_told, "from_key long, from_place long, after boolean, n long, words string")
    ask = F.struct("from_key", "from_place", "after").alias("ask")
    told = materialise(told.groupBy(ask).agg(F.min("n").alias("n"), F.min("words").alias("words")), "substring-told")  # equal rows tell the same
    return lookup(edges.select("row_key", "place", "after", ask), told, "ask", "n").groupBy("row_key").agg(F.collect_list(F.struct("place", "after", "words")).alias("told"))


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def spans_of(text: str, places: list[int], told: dict[tuple[int, bool], str] | None = None) -> list[tuple[int, int]]:
    """What goes: merged spans of repeated paragraphs and lines and of long runs of repeated sentences; told: words beside earlier holders by (place, after)."""
    gone = set(places)
    low, all_ = lowered(text), sentences(text)
    out = [s for kind, spans in ((LINE, lines(text)), (PARAGRAPH, paragraphs(text))) for k, s in enumerate(spans) if KINDS * k + kind in gone]

    def equal(k: int, after: bool) -> list[tuple[int, int]]:
        theirs = (told or {}).get((KINDS * k, after), "").split()
        mine = beside(low, all_, k, after) if theirs else []
        n = next((i for i, ((s, e), w) in enumerate(zip(mine, theirs)) if low[s:e] != w), min(len(mine), len(theirs)))
        return mine[:n]

    run: list[int] = []
    for k, s in enumerate([*all_, None]):
        if s and KINDS * k in gone:
            run.append(k)
            continue
        if s and not text[s[0] : s[1]].strip():
            continue
        if run:
            left, right = equal(run[0], False), equal(run[-1], True)
            if len(left) + sum(len(text[a:b].split()) for a, b in (all_[i] for i in run)) + len(right) >= RUN_WORDS:
                out.append((left[-1][0] if left else all_[run[0]][0], right[-1][1] if right else all_[run[-1]][1]))
        run = []
    merged: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text (what stays) and a last column __spans: start, stop and words of each removed span in the original text.

    Where docs has a column of that name, the new one has more underscores.
    """
    names = docs.columns
    key, places, told, spans_ = (free(names, n) for n in ("__key", "__places", "__told", "__spans"))
    keyed = docs.withColumn("text", text_of()).withColumn(key, row_key())
    again = materialise(removed(docs), "substring-again")
    gone = again.join(surroundings(docs, again), "row_key", "left").select(F.col("row_key").alias(key), F.col("places").alias(places), F.col("told").alias(told))
    joined = keyed.join(gone.hint("merge"), key, "left").select(*[F.col(f"`{c}`") for c in names], places, told)
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "stop", "words")])
    schema = T.StructType([f for f in joined.schema if f.name not in (places, told)] + [T.StructField(spans_, T.ArrayType(span))])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "words")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for t, p, w in zip(b.column("text"), b.column(places).to_pylist(), b.column(told).to_pylist()):
                t = t.as_py()
                cut = spans_of(t, p, {(x["place"], x["after"]): x["words"] for x in w or []}) if p else []
                at, kept = 0, []
                for s, e in cut:
                    kept.append(t[at:s])
                    at = e
                texts.append("".join([*kept, t[at:]]) if cut else t)
                spans.append([{"start": s, "stop": e, "words": len(t[s:e].split())} for s, e in cut])
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.record_batch([*cols, pa.array(spans, kind)], names=[*names, spans_])

    return joined.mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed (spans), removed, text (what stays), words_removed in all and longest_removed, the words of the longest span.

    Most removed spans are repeated lines of a few words; longest_removed tells passages from these.
    """
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = F.aggregate("__spans.words", F.lit(0).cast("long"), lambda a, x: a + x)
    longest = F.coalesce(F.array_max("__spans.words"), F.lit(0).cast("long"))
    return found.select("doc_id", F.size("__spans").alias("n_removed"), F.col("__spans").alias("removed"), "text", total.alias("words_removed"), longest.alias("longest_removed"))
