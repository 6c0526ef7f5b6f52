"""Evaluation texts that leak into training text.

A document leaks an item if it contains 13 successive words of it (all words of a shorter item), a
window. All five-word shingles of a window are in such a document, so it is enough to look where one of
them occurs: a set join with a prefix of one token.

1. Shingles of all items are ordered by rarity, their number of occurrences in the whole corpus. The rarest
   of each window is its prefix; a window with a shingle that occurs nowhere drops out.
2. Documents give only the places of prefixes, with the words around them. These are joined
   with the windows by the prefix.
3. Where they meet, the window can start at one place only (positional bound), which must leave room
   for all of its words (length bound); its words are compared with those there.

Shingles are 64-bit hashes. Two that collide cost a comparison or a worse prefix, never a result.
Documents drop shingles that no item has by a bit map of fixed size, so the number of passes over the
corpus is two for any number of items; what passes the map is joined, by broadcast only if Spark
finds the windows small enough.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.runtime import spread, stage

WINDOW = 13
SHINGLE = 5
MAP_BITS = 25  # the bit map holds 2**25 bits: 4 MB, whatever the number of items
CHUNK_WORDS = 200_000  # words numbered at once; a longer text is one chunk

_HIDDEN = re.compile("[\u00ad\u200b-\u200d\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in NFKC and lower case, without hidden characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return _WORD.findall(text.lower())


class Chunk:
    """The words of some texts in one row, with their hashes."""

    def __init__(self, split: list[list[str]]) -> None:
        self.words = [w for ws in split for w in ws]
        self.sizes = np.array([len(ws) for ws in split], np.int64)
        self.ends = np.cumsum(self.sizes)
        coded = pa.array(self.words, pa.string()).dictionary_encode()
        each = hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
        self._hashes = each[coded.indices.to_numpy()] if self.words else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(split)), self.sizes)  # of each word

    def shingles(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the runs of ``level`` words that stay in one text."""
        n = max(0, len(self.words) - level + 1)
        h = np.full(n, np.uint64(level))
        for k in range(level):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self._hashes[k : k + n]
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)  # the map takes the upper bits
        at = np.arange(n)
        inside = at + level <= self.ends[self.text[:n]]
        return at[inside], h[inside]


def _chunks(column: pa.Array) -> Iterator[tuple[int, Chunk]]:
    """(row of the first text, chunk) of a column of texts."""
    first, split, n = 0, [], 0
    for value in column:
        split.append(words(value.as_py()))
        n += len(split[-1])
        if n >= CHUNK_WORDS:
            yield first, Chunk(split)
            first, split, n = first + len(split), [], 0
    if split:
        yield first, Chunk(split)


def _windows(window: int, shingle: int):
    """(item, text) rows to (item, words, level, shingles) of each window; the words are joined by spaces."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, chunk in _chunks(batch.column(1)):
                rows: dict[str, list] = {"at": [], "words": [], "level": [], "shingles": []}
                hashes = {level: dict(zip(*(x.tolist() for x in chunk.shingles(level)))) for level in {min(shingle, int(n)) for n in chunk.sizes} - {0}}
                for i, (size, end) in enumerate(zip(chunk.sizes.tolist(), chunk.ends.tolist())):
                    n = min(window, size)
                    level = min(shingle, n)
                    for at in range(end - size, end - n + 1) if n else ():
                        rows["at"].append(first + i)
                        rows["words"].append(" ".join(chunk.words[at : at + n]))
                        rows["level"].append(level)
                        rows["shingles"].append([hashes[level][at + k] for k in range(n - level + 1)])
                values = [pa.array(rows["words"], pa.string()), pa.array(rows["level"], pa.int32()), pa.array([np.array(s, np.uint64).view(np.int64) for s in rows["shingles"]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows["at"], pa.int64())), *values], names=["item", "words", "level", "shingles"])

    return split


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """2**MAP_BITS bits, those of the upper bits of the ``shingle`` hashes set. They are set on the executors; the driver gets 64 a row."""
    bit = F.shiftrightunsigned("shingle", 64 - MAP_BITS)
    found = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _mapped(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bit map has."""
    bit = hashes >> np.uint64(65 - (len(held) * 64).bit_length())
    return np.flatnonzero(held[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))


def _count(held: Broadcast, levels: list[int]):
    """Texts to (shingle, n) of the shingles that the map has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in _chunks(batch.column(0)):
                for level in levels:
                    _, h = chunk.shingles(level)
                    found, n = np.unique(h[_mapped(h, held.value)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return count


def _places(held: Broadcast, levels: list[int], window: int, shingle: int):
    """(doc, text) rows to the places of prefixes: (doc, shingle, place, size, from, around).

    ``around`` holds the words that any window with this shingle could cover, from the word numbered ``from``.
    Shingles shorter than ``shingle`` are whole windows, so their first place in a text will do.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, chunk in _chunks(batch.column(1)):
                for level in levels:
                    at, h = chunk.shingles(level)
                    kept = _mapped(h, held.value)
                    if level < shingle:
                        kept = kept[np.unique(np.stack([chunk.text[at[kept]].view(np.uint64), h[kept]]), axis=1, return_index=True)[1]]
                    place, text = at[kept], chunk.text[at[kept]]
                    start = (chunk.ends - chunk.sizes)[text]
                    low, high = np.maximum(start, place - (window - level)), np.minimum(chunk.ends[text], place + window)
                    around = [" ".join(chunk.words[a:b]) for a, b in zip(low.tolist(), high.tolist())]
                    columns = [batch.column(0).take(pa.array(text + first)), pa.array(h[kept].view(np.int64)), pa.array(place - start), pa.array(chunk.sizes[text]), pa.array(low - start), pa.array(around, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "shingle", "place", "size", "from", "around"])

    return find


def leaked_items(documents: DataFrame, document: str, text: str, items: DataFrame, item: str, item_text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct (document, item) of all documents that contain a window of an item.

    Null, empty and wordless texts, of either side, match nothing; null items do not come out; repeated rows count
    once; empty tables give no rows. Texts are whole however long they are, and other columns of the tables are ignored.
    """
    item_type, doc_type = (t.schema[c].dataType.simpleString() for t, c in ((items, item), (documents, document)))
    texts = items.select(F.col(item).alias("item"), F.make_valid_utf8(F.col(item_text)).alias("text")).where("item is not null and text is not null").distinct()
    corpus = spread(documents.select(F.col(document).alias("doc"), F.make_valid_utf8(F.col(text)).alias("text")).where("text is not null"))

    every = stage(texts.mapInArrow(_windows(window, shingle), f"item {item_type}, words string, level int, shingles array<bigint>"), "item-windows")
    windows = every.groupBy("words").agg(F.first("level").alias("level"), F.first("shingles").alias("shingles"))  # equal words have equal shingles
    windows = stage(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    levels = sorted(r.level for r in windows.select("level").distinct().collect())  # at most ``shingle``

    sc = documents.sparkSession.sparkContext
    of_items = sc.broadcast(_bit_map(windows.select(F.explode("shingles").alias("shingle"))))
    counts = corpus.select("text").mapInArrow(_count(of_items, levels), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    tokens = windows.select("window", F.size("shingles").alias("tokens"), F.posexplode("shingles").alias("offset", "shingle"))
    rarest = tokens.join(counts, "shingle").groupBy("window").agg(F.min(F.struct("n", "offset", "shingle")).alias("rarest"), F.count("*").alias("found"), F.first("tokens").alias("tokens"))
    rarest = rarest.where("found = tokens").select("window", "rarest.offset", "rarest.shingle")
    prefixes = stage(rarest.join(windows.select("window", "words", F.size(F.split("words", " ")).alias("length")), "window"), "prefixes")
    of_items.destroy()

    of_prefixes = sc.broadcast(_bit_map(prefixes))
    places = corpus.mapInArrow(_places(of_prefixes, levels, window, shingle), f"doc {doc_type}, shingle bigint, place bigint, size bigint, `from` bigint, around string")
    start = F.col("place") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("length") <= F.col("size"))
    here = F.array_join(F.slice(F.split("around", " "), (start - F.col("from") + 1).cast("int"), F.col("length")), " ")
    proven = F.when(bounds, here == F.col("words"))
    found = places.join(prefixes, "shingle").where(proven).select("doc", "window").distinct()
    owners = every.join(windows.select("window", "words"), "words").select("window", "item").distinct()
    return found.join(owners, "window").select(F.col("doc").alias(document), F.col("item").alias(item)).distinct()
