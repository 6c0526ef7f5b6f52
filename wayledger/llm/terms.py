"""Frequency of every distinct term, counted in burst tries.

1. Rows are reduced to distinct (field, term, record) with their number of occurrences. The
   reduction combines map-side and is spread over all three columns, so neither a hot
   term nor a hot record makes a hot task; from here on record counts add up.
2. Each task counts its share in a burst trie and emits it as compact subtrees.
3. Prefixes that carry too many entries over all tasks are burst to twice their length, until
   every prefix left carries a bounded number: these adaptive prefixes are the routes.
4. Subtrees are cut at the routes, and matching ones of all tasks merge in one task per route. They are
   sorted, so a merge holds a few terms of each subtree it is in, never a whole route.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.text import term_column
from wayledger.runtime import spread, stage

CONTAINER = 256  # terms a container holds before it bursts
CHUNK = 4096  # terms in one emitted subtree
SPILL = 200_000  # terms a task's trie holds before it is emitted
ROUTE_ENTRIES = 200_000  # entries a route may carry before its prefix bursts
MAX_ROUTES = 1024  # no more prefixes of a length burst than this; with more entries in all, routes are larger
READ = 64  # terms a merge reads of a subtree at a time

SUBTREE = "field string, route string, first string, shared array<int>, suffix array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Terms with two counters. Inner nodes branch by character; a leaf is a small table of suffixes."""

    def __init__(self) -> None:
        self.size = 0
        self._root: dict = {}
        self._inner = False

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at, inner = self._root, 0, self._inner
        # an inner node maps a character to [is inner, child]; '' holds the term that ends here
        while inner and at < len(term):
            slot = node.get(term[at])
            if slot is None:
                slot = node[term[at]] = [False, {}]
            inner, node, parent = slot[0], slot[1], slot
            at += 1
            if not inner and len(node) > CONTAINER:
                self._burst(node)
                parent[0] = inner = True
        rest = term[at:]
        if inner:
            rest = ""
        found = node.get(rest)
        if found is None:
            node[rest] = [occurrences, records]
            self.size += 1
        else:
            found[0] += occurrences
            found[1] += records
        if not self._inner and len(self._root) > CONTAINER:
            self._burst(self._root)
            self._inner = True

    @staticmethod
    def _burst(container: dict) -> None:
        old = dict(container)
        container.clear()
        for suffix, counts in old.items():
            if suffix:
                container.setdefault(suffix[0], [False, {}])[1][suffix[1:]] = counts
            else:
                container[""] = counts

    def items(self) -> Iterator[tuple[str, int, int]]:
        """(term, occurrences, records) in order."""
        stack: list[tuple[str, bool, dict]] = [("", self._inner, self._root)]
        while stack:
            prefix, inner, node = stack.pop()
            if inner:
                if "" in node:
                    yield (prefix, *node[""])
                stack += [(prefix + c, *node[c]) for c in sorted(node, reverse=True) if c]
            else:
                for suffix in sorted(node):
                    yield (prefix + suffix, *node[suffix])


def _pack(field: str, route: str, items: Iterable[tuple[str, int, int]]) -> Iterator[dict]:
    """Subtrees with each term as the length it shares with the one before, and the rest."""
    row: dict | None = None
    before = ""
    for term, occurrences, records in items:
        if row is None:
            row, before = {"field": field, "route": route, "first": term, "shared": [], "suffix": [], "occurrences": [], "records": []}, ""
        shared = 0
        for a, b in zip(before, term):
            if a != b:
                break
            shared += 1
        row["shared"].append(shared)
        row["suffix"].append(term[shared:])
        row["occurrences"].append(occurrences)
        row["records"].append(records)
        before = term
        if len(row["shared"]) >= CHUNK:
            yield row
            row = None
    if row:
        yield row


def _unpack(row: dict) -> Iterator[tuple[str, int, int]]:
    term = ""
    for shared, suffix, occurrences, records in zip(row["shared"], row["suffix"], row["occurrences"], row["records"]):
        term = term[:shared] + suffix
        yield term, occurrences, records


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_SUBTREE_SCHEMA = pa.schema([("field", pa.string()), ("route", pa.string()), ("first", pa.string()), ("shared", pa.list_(pa.int32())), ("suffix", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_TERM_SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
_PREFIX_SCHEMA = pa.schema([("field", pa.string()), ("prefix", pa.string()), ("entries", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, term, n, counted) rows to the subtrees of the task's tries."""
    tries: dict[str, BurstTrie] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for field, trie in tries.items():
            for row in _pack(field, "", trie.items()):
                yield _batch([row], _SUBTREE_SCHEMA)
        tries.clear()

    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by(["field", "term"]).aggregate([("n", "sum"), ("counted", "sum")])
        for field, term, n, counted in zip(*(grouped.column(c).to_pylist() for c in ("field", "term", "n_sum", "counted_sum"))):
            tries.setdefault(field, BurstTrie()).add(term, n, counted)
        if sum(t.size for t in tries.values()) > SPILL:
            yield from emit()
    yield from emit()


def _prefixes(depth: int, burst: frozenset):
    """Entries per prefix of ``depth`` characters, of terms whose prefix of half that length burst. Shorter terms have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for row in batch.to_pylist():
                for term, _, _ in _unpack(row):
                    if len(term) >= depth and (depth < 2 or (row["field"], term[: depth // 2]) in burst):
                        key = row["field"], term[:depth]
                        found[key] = found.get(key, 0) + 1
            yield _batch([{"field": f, "prefix": p, "entries": n} for (f, p), n in found.items()], _PREFIX_SCHEMA)

    return count


def _route(field: str, term: str, burst: frozenset) -> str:
    """The shortest prefix of ``term``, of 0, 1, 2, 4, ... characters, that did not burst; the whole of a shorter term."""
    depth = 0
    while depth < len(term) and (field, term[:depth]) in burst:
        depth = 2 * depth or 1
    return term[:depth]


def _cut(burst: frozenset):
    """Subtrees cut again at the routes."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts: dict[str, list] = {}
                for item in _unpack(row):
                    parts.setdefault(_route(row["field"], item[0], burst), []).append(item)
                for prefix, items in parts.items():
                    yield _batch(list(_pack(row["field"], prefix, items)), _SUBTREE_SCHEMA)

    return route


def _read(row: dict) -> Iterator[tuple[str, int, int]]:
    """The terms of a subtree whose arrays are still in Arrow, a few at a time."""
    term = ""
    for at in range(0, len(row["shared"]), READ):
        for shared, suffix, occurrences, records in zip(*(row[c].values[at : at + READ].to_pylist() for c in ("shared", "suffix", "occurrences", "records"))):
            term = term[:shared] + suffix
            yield term, occurrences, records


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees sorted by (field, route, first term) to the terms of the merged subtree of each route."""
    out: dict[str, list] = {"field": [], "term": [], "occurrences": [], "records": []}

    def rows() -> Iterator[dict]:
        names = ("field", "route", "first", "shared", "suffix", "occurrences", "records")
        for batch in batches:
            columns = [batch.column(names.index(n)) for n in names]
            for i in range(batch.num_rows):
                yield {n: c[i].as_py() if n in names[:3] else c[i] for n, c in zip(names, columns)}

    def merged() -> Iterator[tuple[str, str, int, int]]:
        at, heap, order = None, [], 0  # (term, order of arrival, counts, reader) of the subtrees under way

        def pull(below: str | None) -> Iterator[tuple[str, str, int, int]]:
            while heap and (below is None or heap[0][0] < below):
                term, occurrences, records = heap[0][0], 0, 0
                while heap and heap[0][0] == term:
                    _, number, counts, reader = heap[0]
                    occurrences, records = occurrences + counts[0], records + counts[1]
                    following = next(reader, None)
                    if following is None:
                        heapq.heappop(heap)
                    else:
                        heapq.heapreplace(heap, (following[0], number, following[1:], reader))
                yield at[0], term, occurrences, records

        for row in rows():
            if at != (row["field"], row["route"]):
                yield from pull(None)
                at = row["field"], row["route"]
            yield from pull(row["first"])
            reader = _read(row)
            first = next(reader)
            order += 1
            heapq.heappush(heap, (first[0], order, first[1:], reader))
        yield from pull(None)

    for found in merged():
        for column, value in zip(out.values(), found):
            column.append(value)
        if len(out["term"]) >= 10_000:
            yield pa.RecordBatch.from_pydict(out, _TERM_SCHEMA)
            for column in out.values():
                column.clear()
    yield pa.RecordBatch.from_pydict(out, _TERM_SCHEMA)


def _burst_prefixes(subtrees: DataFrame, route_entries: int) -> frozenset:
    """Prefixes that carry more than their limit. There are at most MAX_ROUTES of each length, and lengths double with each pass."""
    total = subtrees.agg(F.sum(F.size("shared"))).first()[0] or 0
    limit = max(route_entries, total // MAX_ROUTES)
    burst: set[tuple[str, str]] = set()
    depth = 0
    while total > limit:
        heavy = (
            subtrees.mapInArrow(_prefixes(depth, frozenset(b for b in burst if len(b[1]) == depth // 2)), "field string, prefix string, entries bigint")
            .groupBy("field", "prefix")
            .agg(F.sum("entries").alias("entries"))
            .where(F.col("entries") > limit)
            .collect()
        )
        if not heavy:
            break
        burst |= {(r.field, r.prefix) for r in heavy}
        depth = 2 * depth or 1
    return frozenset(burst)


def _subtrees(rows: DataFrame, fields: list[str], record: str) -> DataFrame:
    """Staged subtrees of the terms of all fields. Those of the null field hold the number of distinct records."""
    each = spread(rows.select(F.col(record).alias("record"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]))
    terms = [F.struct(F.lit(f).alias("field"), term_column(F.col(f"f{i}")).alias("term")) for i, f in enumerate(fields)]
    every = F.struct(F.lit(None).cast("string").alias("field"), F.lit("").alias("term"))
    distinct = (
        each.select("record", F.inline(F.array(*terms, every)))
        .where(F.col("term").isNotNull())
        .groupBy("field", "term", "record")
        .agg(F.count("*").alias("n"))
        .select("field", "term", "n", F.col("record").isNotNull().cast("bigint").alias("counted"))
    )
    return stage(distinct.mapInArrow(_count, SUBTREE), "subtrees")


def _merged(subtrees: DataFrame, route_entries: int) -> DataFrame:
    subtrees = subtrees.where("field is not null")
    return (
        subtrees.mapInArrow(_cut(_burst_prefixes(subtrees, route_entries)), SUBTREE)
        .repartition("field", "route")
        .sortWithinPartitions("field", "route", "first")
        .mapInArrow(_merge, "field string, term string, occurrences bigint, records bigint")
    )


def term_frequencies(rows: DataFrame, fields: list[str], record: str, route_entries: int = ROUTE_ENTRIES) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term of ``fields``.

    Spellings are one term if ``text.plain_term`` gives the same; null, empty and blank values
    are no terms. ``occurrences`` counts rows, repeated ones too; ``records`` counts
    distinct non-null values of ``record``. A very long value is a term like any other.
    Empty tables give no rows; other columns of ``rows`` are ignored, whatever their names.
    """
    return _merged(_subtrees(rows, fields, record), route_entries)


def marked_terms(rows: DataFrame, fields: list[str], record: str, rare_below: int = 5, common_above: float = 0.25, route_entries: int = ROUTE_ENTRIES) -> DataFrame:
    """``term_frequencies`` with ``mark``: 'rare' below ``rare_below`` records, else 'common' above
    the share ``common_above`` of all distinct records, else null. All records count, those without terms too."""
    subtrees = _subtrees(rows, fields, record)
    total = subtrees.where("field is null").agg(F.coalesce(F.sum(F.col("records")[0]), F.lit(0))).first()[0]
    mark = F.when(F.col("records") < rare_below, F.lit("rare")).when(F.col("records") > F.lit(common_above) * F.lit(total), F.lit("common"))
    return _merged(subtrees, route_entries).withColumn("mark", mark)


