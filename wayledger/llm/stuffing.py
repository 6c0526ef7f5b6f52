"""Keyword-stuffed and link-list pages.

A page is stuffed if more than half of its words and more than half of its characters lie in stuffed pieces. A piece is
a line, or a part of a long one. All verdicts come from neighbouring words:

1. Counts of all words and all neighbouring word pairs of the corpus, also across line ends, give the pointwise mutual
   information (PMI) of each pair. Along with it goes the pair's excess: its occurrences on pages that repeat it all
   the time, outside of sentences and of lines full of numbers.
2. A pair whose words attract each other and of whose occurrences more than a small share is excess is an excessively
   repeated collocation. A piece is stuffed if many of its words are in such pairs.
3. So is a piece of word salad: the page repeats its words all the time, but the mean PMI of its neighbours is low.
4. So is a line that is mostly links.

The corpus is split into words twice, once for the counts and once for the verdicts; only counts are shuffled.
Words and pairs are 64-bit hashes there: of a billion different pairs, one in thousands of corpora would be
taken for another. Only pairs with an excess are candidates, and only pieces that may be salad need the PMI
of all their pairs, so neither the verdicts nor their texts meet the table of all pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.runtime import spread, stage

COLLOCATIONS = 4_000_000  # excessively repeated collocations a broadcast may hold, 8 bytes each; more are joined
CHUNK_WORDS = 200_000  # words numbered at once; a longer text is one chunk

_UPPER = "A-ZÀ-ÖØ-Þ"
# words, joined names taken apart; numbers; ends of sentences; ends of lines
_TOKEN = re.compile(rf"[{_UPPER}]*[^\W\d_{_UPPER}]+|[{_UPPER}]+|\d+|[.!?]+(?=[\s\"'»”)])|\n")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[a-z][\w-]*(?:\.[a-z][\w-]+)+/\S*", re.IGNORECASE)
_NUMBERED = re.compile(r"\s*(?:\[\d+\]|\d+[.)])\s")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the verdicts."""

    repeated: int = 3  # times a page must have a word or pair, at least, to repeat it all the time
    repeated_share: float = 0.02  # and of the page's words or pairs
    numbers: float = 0.25  # share of numbers from which a line is a table, a log or a list of references
    sentence: int = 8  # words from which an ended sentence counts as prose
    prose: float = 0.5  # share of a line's words in such sentences from which it is prose
    links: float = 0.4  # share of a line's characters in links beyond which it is a link
    excess: float = 0.05  # share of a pair's occurrences that are excess
    pmi: float = 1.0  # PMI from which a pair is a collocation
    covered: float = 0.35  # share of a stuffed piece's words in excessively repeated collocations
    salad_repeated: float = 0.5  # share of a salad's words that the page repeats all the time
    salad_pmi: float = 2.5  # mean PMI below which it is salad
    salad_length: int = 8  # words a salad has at least
    piece: int = 64  # words after which a line goes on in another piece


def lines_of(text: str) -> list[str]:
    """The lines that are not blank, in NFKC."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return [x for x in text.splitlines() if x and not x.isspace()]


def tokens_of(lines: list[str]) -> list[str]:
    """Words, numbers, ends of sentences and of lines."""
    return _TOKEN.findall("\n".join(lines) + "\n") if lines else []


def link_share(line: str) -> float:
    if "/" not in line and "www." not in line:
        return 0.0
    return sum(map(len, _LINK.findall(line))) / len(line)


class Chunk:
    """The words of some texts in one row, with their lines, pieces and pairs."""

    def __init__(self, texts: list[str | None], rules: Rules) -> None:
        lines = [lines_of(t or "") for t in texts]
        tokens = [tokens_of(x) for x in lines]
        flat = [x for t in tokens for x in t]
        coded = pa.array(" ".join(flat).lower().split(" ") if flat else [], pa.string()).dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self.hashes = hash_array(np.array(names, object), categorize=False) if names else np.zeros(0, np.uint64)
        kind = np.array(["\n" if x == "\n" else "." if x[0] in ".!?" else "0" if x[0].isdigit() else "a" for x in names], "U1")[code] if names else np.zeros(0, "U1")
        length = np.array(list(map(len, names)), np.int64)[code] if names else np.zeros(0, np.int64)

        # lines
        every = [x for t in lines for x in t]
        self.n_texts, n_lines = len(texts), len(every)
        text_of_line = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
        chars = np.array(list(map(len, every)), np.int64)
        line = np.cumsum(kind == "\n") - (kind == "\n")
        is_word, is_counted = kind == "a", (kind == "a") | (kind == "0")
        words = np.bincount(line[is_counted], minlength=n_lines)
        numbers = np.bincount(line[kind == "0"], minlength=n_lines) / np.maximum(words, 1)
        ends = np.flatnonzero((kind == ".") | (kind == "\n"))
        sentence = np.diff(np.cumsum(is_counted)[ends], prepend=0)
        in_prose = (kind[ends] == ".") & (sentence >= rules.sentence)
        prose = np.bincount(line[ends], sentence * in_prose, n_lines) / np.maximum(words, 1)
        few_numbers = numbers < rules.numbers
        self.linked = few_numbers & np.array([link_share(x) > rules.links and not _NUMBERED.match(x) for x in every], bool)
        self.plain_line = few_numbers & (prose < rules.prose) & ~self.linked
        self.words = np.bincount(text_of_line, words, self.n_texts)
        self.chars = np.bincount(text_of_line, chars, self.n_texts)

        # pieces: a line's words and numbers, at most so many at a time
        line_of = line[is_counted]
        within = np.arange(len(line_of)) - (np.cumsum(words) - words)[line_of]
        piece = np.cumsum(within % rules.piece == 0) - 1
        n_pieces = int(piece[-1]) + 1 if len(piece) else 0
        self.line_of_piece = np.zeros(n_pieces, np.int64)
        self.line_of_piece[piece] = line_of
        self.text_of_piece = text_of_line[self.line_of_piece]
        self.piece_words = np.bincount(piece, minlength=n_pieces)
        letters = np.bincount(piece, length[is_counted], n_pieces)
        self.piece_chars = letters / np.maximum(np.bincount(self.line_of_piece, letters, n_lines), 1)[self.line_of_piece] * chars[self.line_of_piece]

        # words without numbers, and the pairs of those next to each other in a text
        self.word = code[is_word].astype(np.int64)
        self.piece = piece[is_word[is_counted]]
        text = self.text_of_piece[self.piece]
        self.first = np.flatnonzero(text[:-1] == text[1:]) if len(text) else np.zeros(0, np.int64)
        self.pair = self.word[self.first] * len(names) + self.word[self.first + 1]
        self.repeated_word = self._repeated(text, self.word, len(names), rules)
        self.repeated_pair = self._repeated(text[self.first], self.pair, len(names) ** 2, rules)

    def _repeated(self, text: np.ndarray, codes: np.ndarray, n: int, rules: Rules) -> np.ndarray:
        """Whether the text of each occurrence has its code all the time."""
        _, back, times = np.unique(text * n + codes, return_inverse=True, return_counts=True)
        many = np.maximum(rules.repeated, rules.repeated_share * np.bincount(text, minlength=self.n_texts))
        return times[back] >= many[text]

    def keys(self) -> np.ndarray:
        """A hash of each pair."""
        n = max(1, len(self.hashes))
        return pair_key(self.hashes[self.pair // n], self.hashes[self.pair % n])


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two; the order counts."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h + b) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _chunks(column: pa.Array, rules: Rules) -> Iterator[tuple[int, Chunk]]:
    """(row of the first text, chunk) of a column of texts."""
    first, texts, size = 0, [], 0
    for value in column.to_pylist():
        texts.append(value)
        size += len(value or "")
        if size >= 6 * CHUNK_WORDS:
            yield first, Chunk(texts, rules)
            first, texts, size = first + len(texts), [], 0
    if texts:
        yield first, Chunk(texts, rules)


_COUNTS = "a bigint, b bigint, key bigint, n bigint, excess bigint"


def _count(rules: Rules):
    """Texts to the words (a, and no b) and pairs (a, b) of each chunk, with their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in _chunks(batch.column(0), rules):
                n = len(c.hashes)
                of_word = np.bincount(c.word, minlength=n)
                seen = np.flatnonzero(of_word)
                pairs, back = np.unique(c.pair, return_inverse=True)
                plain = c.plain_line[c.line_of_piece][c.piece]
                over = c.repeated_pair & plain[c.first] & plain[c.first + 1]
                a, b = c.hashes[pairs // max(1, n)], c.hashes[pairs % max(1, n)]
                signed = lambda x: pa.array(x.view(np.int64))
                none, zero = pa.nulls(len(seen), pa.int64()), pa.array(np.zeros(len(seen), np.int64))
                for columns in ([signed(c.hashes[seen]), none, none, pa.array(of_word[seen]), zero], [signed(a), signed(b), signed(pair_key(a, b)), pa.array(np.bincount(back, minlength=len(pairs))), pa.array(np.bincount(back, over, len(pairs)).astype(np.int64))]):
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "n", "excess"])

    return count


_JUDGED = "words double, chars double, stuffed_words double, stuffed_chars double, salad array<struct<words: double, chars: double, a: array<bigint>, b: array<bigint>>>"
_SALAD = pa.list_(pa.struct([("words", pa.float64()), ("chars", pa.float64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))


def _judge(held, rules: Rules):
    """(doc, text) rows to the sizes of pages and of their stuffed pieces, and the pieces that may be salad.

    Pages that are not stuffed, with salad or without, do not come out. Without ``held`` each row brings the collocations of its text.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, c in _chunks(batch.column(1), rules):
                keys = c.keys()
                if held is not None:
                    known = held.value
                    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                    bad = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                else:
                    known = [set(x or ()) for x in batch.column(2).slice(first, c.n_texts).to_pylist()]
                    bad = np.array([k in known[t] for k, t in zip(keys.view(np.int64).tolist(), c.text_of_piece[c.piece[c.first]].tolist())], bool)
                in_pair = np.zeros(len(c.word), bool)
                in_pair[c.first[bad]] = in_pair[c.first[bad] + 1] = True
                n = len(c.piece_words)
                plain = np.bincount(c.piece, minlength=n)
                stuffed = c.linked[c.line_of_piece] | (plain > 0) & (np.bincount(c.piece, in_pair, n) >= rules.covered * plain)
                salad = c.plain_line[c.line_of_piece] & ~stuffed & (plain >= rules.salad_length) & (np.bincount(c.piece, c.repeated_word, n) >= rules.salad_repeated * plain)
                sizes = [np.bincount(c.text_of_piece, size * flag, c.n_texts) for flag in (stuffed, salad) for size in (c.piece_words, c.piece_chars)]
                half = (sizes[0] + sizes[2] > c.words / 2) & (sizes[1] + sizes[3] > c.chars / 2)
                pages = np.flatnonzero(half)
                out: dict[int, list] = {p: [] for p in pages.tolist()}
                if salad[half[c.text_of_piece]].any():
                    piece = c.piece[c.first]
                    inside = piece == c.piece[c.first + 1]
                    by_piece = np.argsort(piece[inside], kind="stable")
                    ordered, pairs = piece[inside][by_piece], c.pair[inside][by_piece]
                    for p in np.flatnonzero(salad & half[c.text_of_piece]).tolist():
                        own = pairs[np.searchsorted(ordered, p) : np.searchsorted(ordered, p, "right")]
                        a, b = c.hashes[own // len(c.hashes)].view(np.int64), c.hashes[own % len(c.hashes)].view(np.int64)
                        out[int(c.text_of_piece[p])].append({"words": float(c.piece_words[p]), "chars": float(c.piece_chars[p]), "a": a, "b": b})
                columns = [pa.array(x[pages].astype(float)) for x in (c.words, c.chars, sizes[0], sizes[1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pages + first)), *columns, pa.array(list(out.values()), _SALAD)], names=["doc", "words", "chars", "stuffed_words", "stuffed_chars", "salad"])

    return judge


def _keys(rules: Rules):
    """(k1, k2, text) rows to the distinct pairs of each text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, c in _chunks(batch.column(2), rules):
                text = c.text_of_piece[c.piece[c.first]].astype(np.uint64)
                found = np.unique(np.stack([text, c.keys()]), axis=1)
                rows = pa.array(found[0].astype(np.int64) + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found[1].view(np.int64))], names=["k1", "k2", "key"])

    return keys


def excess_collocations(counts: DataFrame, rules: Rules) -> DataFrame:
    """(key) of the excessively repeated collocations among all pairs."""
    total = counts.where("b is not null").agg(F.sum("n")).first()[0] or 1
    words = counts.where("b is null")
    pairs = counts.where(F.col("b").isNotNull() & (F.col("excess") > 0) & (F.col("excess") >= F.lit(rules.excess) * F.col("n")))
    return _with_pmi(pairs, words, total).where(F.col("pmi") >= rules.pmi).select("key")


def _with_pmi(pairs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    of = lambda c: words.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"))
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b")))
    return pairs.join(of("a"), "a").join(of("b"), "b").withColumn("pmi", pmi)


def stuffed_pages(documents: DataFrame, document: str, text: str, rules: Rules = Rules(), broadcast: int = COLLOCATIONS) -> DataFrame:
    """(document, word_share, char_share) of the pages whose stuffed pieces hold more than half of words and characters.

    Null, empty, blank and wordless texts are no cases. A repeated row counts as another page
    in the statistics and comes out once, and so does a null document. An empty table gives no rows.
    Texts are whole, however long they are. More than ``broadcast`` collocations are joined to the pages, with the same result.
    """
    spark = documents.sparkSession
    pages = spread(documents.select(F.col(document).alias("doc"), F.make_valid_utf8(F.col(text)).alias("text")).where(F.col("text").isNotNull()))
    counted = pages.select("text").mapInArrow(_count(rules), _COUNTS)
    counts = stage(counted.groupBy("a", "b", "key").agg(F.sum("n").alias("n"), F.sum("excess").alias("excess")), "counts")
    bad = stage(excess_collocations(counts, rules), "collocations")
    schema = f"doc {pages.schema['doc'].dataType.simpleString()}, {_JUDGED}"
    if bad.count() <= broadcast:
        found = np.sort(bad.toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))
        judged = pages.mapInArrow(_judge(spark.sparkContext.broadcast(found), rules), schema)
    else:
        keyed = pages.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})  # 128 bits name a text
        own = keyed.select("k1", "k2", "text").mapInArrow(_keys(rules), "k1 bigint, k2 bigint, key bigint").join(bad, "key")
        own = own.groupBy("k1", "k2").agg(F.collect_set("key").alias("bad"))  # at most the text's pairs
        judged = keyed.join(own, ["k1", "k2"], "left").select("doc", "text", "bad").mapInArrow(_judge(None, rules), schema)
    judged = stage(judged.withColumn("page", F.monotonically_increasing_id()), "judged")

    salad = _salad(judged, counts, rules)
    if salad is not None:
        judged = judged.join(salad, "page", "left")
        more = lambda c: F.col(f"stuffed_{c}") + F.coalesce(f"salad_{c}", F.lit(0.0))
    else:
        more = lambda c: F.col(f"stuffed_{c}")
    shares = judged.select("doc", (more("words") / F.col("words")).alias("word_share"), (more("chars") / F.col("chars")).alias("char_share"))
    return shares.where("word_share > 0.5 and char_share > 0.5").dropDuplicates(["doc"]).withColumnRenamed("doc", document)


def _salad(judged: DataFrame, counts: DataFrame, rules: Rules) -> DataFrame | None:
    """(page, salad_words, salad_chars) of the pages with pieces of low mean PMI; None if no piece may be salad."""
    pieces = judged.where(F.size("salad") > 0).select("page", F.posexplode("salad").alias("at", "piece"))
    if pieces.isEmpty():
        return None
    pairs = pieces.select("page", "at", "piece.words", "piece.chars", F.inline(F.arrays_zip("piece.a", "piece.b"))).toDF("page", "at", "words", "chars", "a", "b")
    pairs = pairs.groupBy("page", "at", "words", "chars", "a", "b").agg(F.count("*").alias("times"))
    total = counts.where("b is not null").agg(F.sum("n")).first()[0] or 1
    known = counts.where("b is not null").select("a", "b", "n").join(pairs.select("a", "b").distinct(), ["a", "b"], "left_semi")
    known = _with_pmi(known, counts.where("b is null"), total).select("a", "b", "pmi")
    means = pairs.join(known, ["a", "b"]).groupBy("page", "at", "words", "chars").agg((F.sum(F.col("pmi") * F.col("times")) / F.sum("times")).alias("pmi"))
    return means.where(F.col("pmi") < rules.salad_pmi).groupBy("page").agg(F.sum("words").alias("salad_words"), F.sum("chars").alias("salad_chars"))
