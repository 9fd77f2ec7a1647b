import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodeseek.llm import byte_bpe, packing, training_order
from lodeseek.llm._tokens import ids_of

from .conftest import ROWS


@pytest.fixture(scope="module")
def reference():
    with open(P.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_matches_and_round_trips(odd, none, reference):
    path = P.path(byte_bpe.RANKS)
    got = byte_bpe.encode(odd, path).collect()
    assert len(got) == len(ROWS)
    texts = {i: t or "" for i, t, *_ in ROWS}
    for r in got:
        assert r["ids"] == reference.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    for r in byte_bpe.digests(odd, path).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert byte_bpe.encode(none, path).collect() == []


def test_json_vocabulary_gives_the_tokenizers_ids():
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    more = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "<|endoftext|>\n\n é<|endoftext|>x"]
    for text in [r[1] for r in ROWS] + more:
        assert ids_of(P.path(packing.VOCABULARY), P.PATTERN, text or "").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_packing_holds_each_id_once(odd, clashing, none):
    path = P.path(packing.VOCABULARY)
    for docs in (odd, clashing):
        got = packing.pack(docs, path).collect()
        sequences, whole = {}, {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            whole.setdefault(r["doc_id"], []).append((r["start"], bytes(r["payload"]), r["doc_tokens"]))
        for parts in sequences.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        for i, text, *_ in ROWS:
            want = np.append(ids_of(path, P.PATTERN, text or ""), np.uint32(0)).astype("<u4").tobytes()
            parts = sorted(set(whole[i]))
            assert b"".join(p for _, p, _ in parts) == want and all(n * 4 == len(want) for *_, n in parts)
    digested = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.digested(odd).collect()}
    assert digested == {(r["doc_id"], r["start"], zlib.crc32(bytes(r["payload"]))) for r in packing.pack(odd, path).collect()}
    assert all(len(r["ids"]) == 1024 for r in packing.sequences(packing.pack(odd, path)).collect())
    assert packing.pack(none, path).collect() == []


def test_packing_fills_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = spark.range(5000).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'one' ELSE 'one two three four' END AS text")
    for table, least in ((docs, 0.97), (short, 0.97)):
        got = packing.pack(table, P.path(packing.VOCABULARY)).selectExpr("sum(length) AS n", "count(DISTINCT sequence_id) AS s").first()
        assert got["s"] <= max(-(-got["n"] // 1024), got["n"] / 1024 / least)


def test_plan_uses_each_rank_once_with_little_padding():
    rng = np.random.default_rng(3)
    for n in (1, 7, 500, 20_000):
        sizes, counts = np.unique(rng.integers(1, 129, n), return_counts=True)
        p = packing.plan(dict(zip(sizes.tolist(), counts.tolist())), 128)
        fill = np.zeros(p.sequences, int)
        for s, a, b, each, first in zip(p.size, p.start, p.stop, p.each, p.first):
            for rank in range(a, b):
                fill[first + (rank - a) // each] += s
        assert fill.max() <= 128 and fill.sum() == (sizes * counts).sum()
        assert p.sequences <= max(-(-fill.sum() // 128) + 2, 1.02 * fill.sum() / 128) or n <= 500
    assert packing.plan({}, 128).sequences == 0


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 65_537):
        p = training_order.Permutation(n, 99)
        slots = p.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and p.indexes(slots).tolist() == list(range(n))
    assert training_order.Permutation(1000, 1).slots(np.arange(1000)).tolist() != training_order.Permutation(1000, 2).slots(np.arange(1000)).tolist()


def test_shards_hold_every_sequence_in_order(spark, odd, none, tmp_path):
    out, path = f"file://{tmp_path}/shards", P.path(training_order.VOCABULARY)
    made = training_order.write(odd, path, out, stride=64, shard=50)
    assert len(list((tmp_path / "shards").glob("shard-*.bin"))) == -(-made.count() // 50)  # written before rows are asked for
    got = made.collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    rows = training_order.read(spark, out, 0, len(got) + 9, 64, 50)
    assert len(rows) == len(got)
    for r in got:
        ids = rows[r["slot"]]
        assert zlib.crc32(ids[: r["length"]].tobytes()) == r["ids_crc32"] and not ids[r["length"] :].any()
    texts = {i: t or "" for i, t, *_ in ROWS}
    for r in got:
        want = np.append(ids_of(path, P.PATTERN, texts[r["doc_id"]]), np.uint32(0))[r["start"] : r["start"] + r["length"]]
        assert rows[r["slot"]][: r["length"]].tolist() == want.tolist()
    assert (training_order.read(spark, out, 45, 10, 64, 50) == rows[45:55]).all()
    assert training_order.write(none, path, f"file://{tmp_path}/none").collect() == []


def test_unfinished_shards_are_not_read(spark, odd, tmp_path):
    out, path = f"file://{tmp_path}/s", P.path(training_order.VOCABULARY)
    training_order.write(odd, path, out, stride=64, shard=50)
    with pytest.raises(ValueError):
        training_order.read(spark, out, 0, 1, 64, 49)
    with pytest.raises(ValueError):
        training_order.write(odd, path, out, stride=64, shard=50, key=1)
    (tmp_path / "s" / training_order.DONE).unlink()
    with pytest.raises(ValueError):
        training_order.read(spark, out, 0, 1, 64, 50)
    training_order.write(odd, path, out, stride=64, shard=50)
    assert len(training_order.read(spark, out, 0, 3, 64, 50)) == 3


def test_shards_take_clashing_columns(spark, clashing, tmp_path):
    n = training_order.write(clashing, P.path(training_order.VOCABULARY), f"file://{tmp_path}/c").count()
    assert n > len(ROWS) and byte_bpe.encode(clashing, P.path(byte_bpe.RANKS)).count() == len(ROWS)


def test_byte_bpe_takes_long_pre_tokens(spark, reference):
    text = "x" * 3_000_00 + " " + "é" * 20_000 + " " * 50_000 + "end"
    got = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), P.path(byte_bpe.RANKS)).first()
    assert bytes(got["decoded"]).decode() == text
