"""Byte-level BPE by a sentencepiece model that is made from a rank file.

The model has one piece for each rank: the token's bytes, each mapped to a printable
character, scored by the negative rank, so that the merge with the lowest rank comes first.
Its normaliser is the identity. A text is split by the public pattern; each pre-token's UTF-8
bytes are mapped, encoded, and the piece ids are the ranks. Decoding maps ids back to bytes.
Nothing is trained. Null and empty texts have no tokens; repeated rows come out as often as they go
in; columns other than doc_id and text are not looked at; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, text_of
from ._tokens import Pieces

RANKS = "byte_bpe_50k.tiktoken"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        found = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must go from 0 on without gaps")
    return [found[i] for i in range(len(found))]


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; the unknown piece comes after the ranks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    m = pb.ModelProto()
    for rank, t in enumerate(tokens):
        m.pieces.add(piece="".join(chars[b] for b in t), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(m.pieces)
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = len(tokens), -1, -1, -1
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return m.SerializeToString()


class ByteBpe:
    """Encodes texts to ranks and decodes ranks to bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.map = dict(enumerate(byte_characters()))
        self.ids = list(range(len(self.tokens)))  # one object for each id, however often it is remembered
        self.pieces = Pieces(pattern, self._encode)

    def _mapped(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.map[32])  # the only one of these that isn't itself
        return word.encode("utf-8", "replace").decode("latin-1").translate(self.map)

    def _encode(self, words: list[str]) -> list[tuple[int, ...]]:
        one = self.ids.__getitem__
        return [tuple(map(one, x)) for x in self.model.encode(list(map(self._mapped, words)), num_threads=1)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces.of(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [c.encode(t.as_py()) for t in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode(), with its columns digested where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        decimal = [str(i) for i in range(len(c.tokens))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, a, d = [], [], []
            for t in b.column("text"):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                a.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()))
                d.append(sha(c.decode(ids)))
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
