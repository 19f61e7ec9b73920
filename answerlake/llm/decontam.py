"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A window is
`window` consecutive words of an item; a shorter item is one window. The automaton of a block of items
is built once and sent to the tasks; a block is bounded by `block_words`, so its size is, and more
items mean more blocks, each scanned in turn. Null and empty texts have no words and no hits; items
without words are ignored; repeated items and documents each count as a row of their own; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.llm.common import LOWER_BYTES, giving_back

#: Words of test items in one automaton: at most twice as many states, about 100 MB in a task.
BLOCK_WORDS = 200_000
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_SPACED = bytes(b if b in _WORD_BYTES else 0x20 for b in LOWER_BYTES)
_SPAN = T.StructType().add("start", "integer").add("end", "integer")
#: Columns of what was found; the names keep clear of the documents' own.
_FOUND = T.StructType().add("__words", "long").add("__spans", T.ArrayType(_SPAN)).add("__items", T.ArrayType(T.StringType()))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPACED).split()


class Automaton:
    """Suffix automaton over the words of several items, each inserted from the initial state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length, self.found = [{}], [-1], [0], [set()]
        #: per state, (length, item) of short items that end in it
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.ids = [i for i, _ in items]
        self.least = min((min(len(w), window) for _, w in items), default=window)
        ends = []
        for number, (_, item) in enumerate(items):
            last = 0
            for word in item:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                ends.append((last, number))
            if len(item) < window:
                self.short.setdefault(last, []).append((len(item), number))
        # items of a state: those that end in it or in a state whose suffix it is
        for state, number in ends:
            while state > 0 and number not in self.found[state]:
                self.found[state].add(number)
                state = self.link[state]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.found.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of a step, cut down to the strings that are one word longer than `state`'s."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Occurrences of windows as (first word, end word), merged, and the items they belong to."""
        numbers = np.array(list(map(self.vocabulary.get, text, [-1] * len(text))), np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], numbers >= 0, [False]))))
        spans: list[list[int]] = []
        items: set[int] = set()

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1][1] = end
            else:
                spans.append([start, end])

        # between unknown words, only runs as long as the shortest window can hold one
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin < self.least:
                continue
            state = matched = 0
            for at, word in enumerate(numbers[begin:end].tolist(), begin + 1):
                while state and word not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if word in self.next[state]:
                    state, matched = self.next[state][word], matched + 1
                if matched < self.least:
                    continue
                if matched >= self.window:
                    hit(at - self.window, at)
                    holder = state
                    while self.length[self.link[holder]] >= self.window:
                        holder = self.link[holder]
                    items |= self.found[holder]
                if self.short:
                    holder = state
                    while holder > 0:
                        for length, number in self.short.get(holder, ()):
                            if length <= matched:
                                hit(at - length, at)
                                items.add(number)
                        holder = self.link[holder]
        return [tuple(s) for s in spans], items


def automata(items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """One automaton per block of items; items pass through the driver a block at a time."""
    block, size = [], 0
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        item = words(text)
        if block and size + len(item) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        if item:
            block.append((item_id, item))
            size += len(item)
    if block:
        yield Automaton(block, window)


def matches(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with __words (their number), __spans (merged occurrences, words from start to before end) and __items (sorted ids)."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(a) for a in automata(items, window, block_words)]
    schema = T.StructType([*docs.schema.fields, *_FOUND.fields])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, ids = [], [], []
            for text in batch.column(place):
                tokens = words(text.as_py())
                marked, found = [], set()
                for block in blocks:
                    automaton = block.value
                    more, items_of = automaton.scan(tokens)
                    marked += more
                    found.update(automaton.ids[i] for i in items_of)
                merged: list[list[int]] = []
                for start, end in sorted(marked):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                counts.append(len(tokens))
                spans.append([{"start": s, "end": e} for s, e in merged])
                ids.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(ids, pa.list_(pa.string()))],
                names=schema.names,
            )

    return docs.mapInArrow(giving_back(run), schema)


def n_hit():
    return F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The counts and the digest of the items of every document."""
    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window)
    return found.select(
        "doc_id", F.col("__words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5) -> DataFrame:
    """docs without the passages of test items: spans of hit words are cut out of a text (and n_chars
    follows, if there is such a column); a document of which more than `coverage` of the words are hit goes."""
    found = matches(docs, items, window).where(n_hit() <= coverage * F.col("__words"))
    columns = docs.columns
    place = columns.index("text")

    def cut(text: str, spans) -> str:
        places = [m.span() for m in _WORD.finditer(text)]
        kept, at = [], 0
        for span in spans:
            kept.append(text[at : places[span["start"]][0]])
            at = places[span["end"] - 1][1]
        return "".join([*kept, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut(t, s) if s else t for t, s in zip(batch.column(place).to_pylist(), batch.column(len(columns)).to_pylist())
            ]
            out = list(batch.columns[: len(columns)])
            out[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=columns)

    cleaned = found.select(*columns, "__spans").mapInArrow(giving_back(run), docs.schema)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(*columns)
    return cleaned


#: The same rows by grouping every window of words; DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
    FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
          FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.gram = x.gram),
marked AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM
    (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
