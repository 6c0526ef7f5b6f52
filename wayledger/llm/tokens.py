"""Encoding of a corpus with a public byte-level BPE vocabulary.

The vocabulary is serialised as a sentencepiece BPE model: every token is a piece in the
byte-mapped alphabet, scored by its negative rank, with identity normalisation. sentencepiece
merges the neighbouring pair whose joint piece scores best, which is the lowest rank, so it
makes the merges of the vocabulary in their order. Texts are first split into pre-tokens, as the vocabulary
demands; each distinct pre-token of a batch is encoded once.
"""

from __future__ import annotations

import base64
import json
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.runtime import spread

#: Fixed value: how byte-level BPE vocabularies split text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE = 200_000  # distinct pre-tokens a worker remembers
CACHED_LENGTH = 64  # longer pre-tokens are encoded anew each time
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it prints, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> list[str]:
    """Byte-mapped tokens by id, from a .tiktoken rank file or a tokenizers .json file."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            ids = json.load(f)["model"]["vocab"]
        else:
            letters = byte_alphabet()
            ids = {"".join(letters[b] for b in base64.b64decode(token)): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    tokens = sorted(ids, key=ids.__getitem__)
    if [ids[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ids of the vocabulary have gaps")
    if missing := set(byte_alphabet()) - ids.keys():
        raise ValueError(f"{len(missing)} bytes have no token")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _int(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def bpe_model(tokens: list[str]) -> bytes:
    """A sentencepiece model (protocol buffer) of ``tokens``; the unknown piece, never used, follows them."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int(3, kind))

    pieces = b"".join(piece(t, -rank, _NORMAL) for rank, t in enumerate(tokens))
    trainer = _int(3, _BPE) + _int(4, len(tokens) + 1) + _int(40, len(tokens))
    normalizer = _block(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return pieces + piece("<unk>", -len(tokens), _UNKNOWN) + _block(2, trainer) + _block(3, normalizer)


class Encoder:
    """Texts to ids and back, with a model of ``bpe_model``."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(PRE_TOKENS).findall
        self._letters = {b: c for b, c in enumerate(byte_alphabet())}
        self._bytes = {c: b for b, c in self._letters.items()}
        self._known: dict[str, list[int]] = {}

    def _mapped(self, token: str) -> str:
        # latin-1 decoding gives the character numbered as the byte, which the alphabet then replaces
        return token.encode().decode("latin-1").translate(self._letters)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for an empty or null one."""
        split = [self._split(t) if t else [] for t in texts]
        known = self._known
        if len(known) > CACHE:
            known.clear()
        fresh = [t for t in set(chain.from_iterable(split)) if t not in known]
        new = dict(zip(fresh, self._pieces.encode([self._mapped(t) for t in fresh], num_threads=1))) if fresh else {}
        known.update((t, ids) for t, ids in new.items() if len(t) <= CACHED_LENGTH)
        get = known.get
        return [list(chain.from_iterable([get(t) or new[t] for t in tokens])) for tokens in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8, as of a cut list, become U+FFFD."""
        text = "".join(self._pieces.id_to_piece(list(ids))) if len(ids) else ""
        return bytes(self._bytes[c] for c in text).decode("utf-8", "replace")


@lru_cache(2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encoder_of(spark: SparkSession, path: str):
    """Column functions (encode, decode) for the vocabulary at ``path``, a file the driver can read.

    The model travels to the executors as a broadcast; its size is that of the vocabulary, about 1 MB,
    and independent of the data.
    """
    model = spark.sparkContext.broadcast(bpe_model(read_vocabulary(path)))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids = _encoder(model.value).encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        e = _encoder(model.value)
        return pa.array([None if x is None else e.decode(x) for x in lists.to_pylist()], pa.string())

    return encode, decode


def encode_corpus(documents: DataFrame, text: str, keep: list[str], vocabulary: str, name: str = "ids") -> DataFrame:
    """The columns ``keep`` of every row and the ids of its whole text.

    Null and empty texts get an empty list; blank text is encoded as it is; special tokens' strings are
    ordinary text; bytes that are no UTF-8 count as U+FFFD. No shuffle, but for inputs of few splits. Repeated rows stay,
    an empty table stays empty.
    """
    encode, _ = encoder_of(documents.sparkSession, vocabulary)
    column: Column = F.make_valid_utf8(F.col(text))
    return spread(documents.select(*keep, column.alias(name))).select(*keep, encode(name).alias(name))
