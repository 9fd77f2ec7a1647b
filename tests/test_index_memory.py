"""What a task holds while it builds an index is bounded by bytes and tokens, not by how many documents come in a batch."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodeseek.engine import SearchEngine
from lodeseek.functions import analyzers
from lodeseek.operators import sentences
from lodeseek.plans import postings
from lodeseek.sources.segments import Segments
from lodeseek.storage import BATCH_CONF, small_batches

FIELDS = [{"name": "id", "type": "Edm.String", "key": True}, {"name": "text", "type": "Edm.String", "searchable": True, "analyzer": "latin"}]
INDEX = {"name": "d", "fields": FIELDS, "semantic": {"configurations": [{"name": "c", "prioritizedFields": {"prioritizedContentFields": [{"fieldName": "text"}]}}]}}
RNG = np.random.default_rng(5)


class Rows:
    """Stands for a DataFrame: keeps what mapInArrow() is given."""

    def select(self, *_):
        return self

    def mapInArrow(self, make, _):
        self.make = make
        return self


@pytest.fixture
def index(spark):
    return SearchEngine(spark).create_index(INDEX, spark.createDataFrame([], "id string, text string"))


def peak(make, batch):
    """Rows that make() gives for a batch, only counted, and the most bytes of Python's and numpy's that it holds, less what it gave."""
    tracemalloc.start()
    rows = sum(b.num_rows for b in make(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most


def text_maker(index, monkeypatch):
    rows = Rows()
    monkeypatch.setattr(postings, "tokenised", lambda *_: rows)
    monkeypatch.setattr(postings.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda _: 3})()))
    postings.postings(rows, index, ["text"])
    return rows.make


def test_a_large_batch_of_tokens_is_counted_in_slices(index, monkeypatch):
    make, n, each = text_maker(index, monkeypatch), 6000, 300
    words = pa.array([f"w{i}" for i in range(5000)])
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), words.take(pa.array(RNG.integers(0, 5000, n * each))))
    rows, most = peak(make, pa.record_batch([pa.array([str(i) for i in range(n)]), tokens], names=["__key", "t0"]))
    assert rows > n * each * 0.9 and most < 60e6  # 1.8 million tokens at once take 180 MB


def test_slices_give_every_posting_once(index, monkeypatch):
    make = text_maker(index, monkeypatch)
    texts = [[f"w{w}" for w in RNG.integers(0, 40, k)] for k in [0, 500, *RNG.integers(0, 90, 300)]]
    keys = [str(i) for i in range(len(texts))]
    batch = pa.record_batch([pa.array(keys), pa.array([*texts[:-1], None], pa.list_(pa.string()))], names=["__key", "t0"])
    want = sorted((k, w, tuple(i for i, x in enumerate(t) if x == w), len(t)) for k, t in zip(keys, texts[:-1]) for w in set(t))
    for slice_, some in ((100, 50), (1 << 18, 1)):
        monkeypatch.setattr(postings, "SLICE", slice_, raising=False)
        made = [b.to_pylist() for b in make(iter([batch]))]
        assert len(made) >= some and all(x == sorted(x, key=lambda r: (r["term"].encode(), r["block"], r["__key"].encode())) for x in made)
        rows = [r for x in made for r in x]
        assert sorted((r["__key"], r["term"], tuple(r["positions"]), r["size"]) for r in rows) == want and all(r["times"] == len(r["positions"]) for r in rows)
        per = defaultdict(list)
        for r in rows:
            per[r["term"], r["block"]].append(r)
        assert all([(r["most"], r["least"]) for r in x if r["most"] is not None] == [(max(r["times"] for r in x), min(r["size"] for r in x))] for x in per.values())
        assert max(Counter(b for b, _ in {(r["block"], r["__key"]) for r in rows}).values()) <= postings.BLOCK


def sentence_maker(spark, index, monkeypatch):
    rows = Rows()

    class Stop(Exception):
        pass

    def ahead(*_):
        raise Stop

    monkeypatch.setattr(sentences, "dealt", lambda *_: rows)
    made = sentences.SentenceIndex(spark, index, "file:///tmp/none")
    monkeypatch.setattr(made.held, "ahead", ahead)
    with pytest.raises(Stop):
        made.update(rows, None, 1, 0)
    return rows.make


def test_large_texts_are_split_in_slices_of_bytes(spark, index, monkeypatch):
    make, n = sentence_maker(spark, index, monkeypatch), 700
    words = np.array([f"wort{i}" for i in range(3000)])
    texts = [" ".join(words[RNG.integers(0, 3000, 1200)]) + "." for _ in range(n)]  # 7 MB in fewer documents than one slice was
    rows, most = peak(make, pa.record_batch([pa.array([str(i) for i in range(n)]), pa.array(texts)], names=["__key", "t0"]))
    assert rows > 100 * n and most < 50e6


def test_slices_of_texts_give_every_sentence_once(spark, index, monkeypatch):
    make = sentence_maker(spark, index, monkeypatch)
    texts = [None, "", *[". ".join(f"Wort{w} und noch ein wort{w} am ende" for w in RNG.integers(0, 30, k)) for k in RNG.integers(0, 6, 60)]]
    keys = [str(i) for i in range(len(texts))]
    batch = pa.record_batch([pa.array(keys), pa.array(texts, pa.string())], names=["__key", "t0"])
    found = []
    for slice_ in (200, 1 << 20):
        monkeypatch.setattr(sentences, "SLICE", slice_)
        made = list(make(iter([batch])))
        found.append(sorted(map(repr, (r for b in made for r in b.to_pylist()))))
    assert found[0] == found[1] and sum("'term': None" in r for r in found[0]) == len(texts)
    monkeypatch.setattr(sentences, "SLICE", 200)
    assert len(list(make(iter([batch])))) > 10


def test_stems_that_are_remembered_are_few():
    assert analyzers._stem.cache_info().maxsize <= 1 << 16


def test_builds_send_python_small_batches(spark, monkeypatch):
    before, seen, write = spark.conf.get(BATCH_CONF), {}, Segments._write

    def watched(self, table, *more):
        seen[table] = spark.conf.get(BATCH_CONF)
        return write(self, table, *more)

    monkeypatch.setattr(Segments, "_write", watched)
    e = SearchEngine(spark)
    e.create_index(INDEX, spark.createDataFrame([("1", "a fox"), ("2", "a dog")], "id string, text string"))
    for build in (e.index_text, e.index_sentences):
        seen.clear()
        build("d")
        assert seen["postings"] == "8388608b" and spark.conf.get(BATCH_CONF) == before
    with pytest.raises(ZeroDivisionError), small_batches(spark), small_batches(spark):
        assert spark.conf.get(BATCH_CONF) == "8388608b"
        1 / 0
    assert spark.conf.get(BATCH_CONF) == before
