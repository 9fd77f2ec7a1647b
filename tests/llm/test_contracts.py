"""What each opN_ query returns, against its contract in plain Python, on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodeseek.llm import registry, simhash


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    made = {}

    def of(name):
        if name not in made:
            made[name] = registry.QUERIES[name](spark, sf_dir).collect()
        return made[name]

    return of


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(texts, found):
    rows = found("op1_suffix_tree")
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for t in train.values() for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ws = [*words(texts[r["doc_id"]]), None]
        assert r["held_out"] == (r["doc_id"] not in train) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(c[w] > 0 for w in ws))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r["score"] < 0


def test_op2(texts, found):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[lower(t)].append(i)
    for r in found("op2_exact_dedup"):
        own = groups[lower(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(own), len(own), r["doc_id"] == max(own), sha(lower(texts[r["doc_id"]]).encode()))


def test_op4(texts, found):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found("op4_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def test_op6(texts, found):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    rows = {r["doc_id"]: r for r in found("op6_fingerprints")}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        t, n = texts[i], texts[after[i]]
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited.encode())) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert t != edited or r["near_edited"] == 1
    by = defaultdict(set)
    for i, t in texts.items():
        by[t].add(rows[i]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    long = [r for i, r in rows.items() if len(texts[i]) > 500 and len(texts[after[i]]) > 500 and texts[i] != texts[after[i]]]
    assert len(long) > 20 and sum(r["near_edited"] > r["near_next"] for r in long) >= 0.95 * len(long)


def test_op7(texts, found):
    for r in found("op7_substring_dedup"):
        t, at, kept = texts[r["doc_id"]], 0, ""
        for s in r["removed"]:
            assert at <= s["start"] < s["stop"] <= len(t) and s["words"] == len(t[s["start"] : s["stop"]].split())
            kept, at = kept + t[at : s["start"]], s["stop"]
        assert kept + t[at:] == r["text"] and r["n_removed"] == len(r["removed"])
        assert (r["words_removed"], r["longest_removed"]) == (sum(s["words"] for s in r["removed"]), max([s["words"] for s in r["removed"]], default=0))


def test_op8(texts, found):
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in found("op8_byte_bpe"):
        t = texts[r["doc_id"]]
        ids = own.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))


def test_op9(texts, found):
    for r in found("op9_quality"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (1 if r["score"] >= 0.3 else 0)


def test_op10(texts, found):
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}
    distinct = defaultdict(list)
    for i, x in fps.items():
        distinct[x].append(i)
    low = {x: min(ids) for x, ids in distinct.items()}
    near = [(x, y) for x in low for y in low if x < y and (x ^ y).bit_count() <= 3]
    while any(low[x] != low[y] for x, y in near):
        for x, y in near:
            low[x] = low[y] = min(low[x], low[y])
    root = {i: low[x] for i, x in fps.items()}
    for r in found("op10_simhash"):
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", root[r["doc_id"]])
