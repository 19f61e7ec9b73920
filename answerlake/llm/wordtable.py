"""Chunks of documents as numbered words: each word of a chunk once, texts as sequences of numbers.

Work on distinct words is shuffled by word, results come back by chunk, and texts are put together
by position. A chunk is about CHUNK bytes of consecutive documents of one task (a longer text is a
chunk of its own). Its key is a digest of its content, so both sides of the join find the same chunk
even if a task runs again, and equal chunks may share a key.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.common import give_back, giving_back
from answerlake.session import hand_over

CHUNK = 32 << 20
_ROWS = 1 << 15
#: Numbers packed at a time.
_PIECE = 1 << 18


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**28 as bytes, seven bits each, high bits first, the last byte of a number below 128."""
    return b"".join(_pack(numbers[at : at + _PIECE]) for at in range(0, len(numbers), _PIECE))


def _pack(numbers: np.ndarray) -> bytes:
    n = numbers.astype(np.uint32)
    size = 1 + (n >= 1 << 7).astype(np.int64) + (n >= 1 << 14) + (n >= 1 << 21)
    last = np.cumsum(size) - 1
    out = np.empty(int(size.sum()), np.uint8)
    out[last] = n & 0x7F
    for back in (1, 2, 3):
        more = size > back
        out[last[more] - back] = (n[more] >> np.uint32(7 * back)) & 0x7F | 0x80
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw, parts, at = np.frombuffer(data, np.uint8), [np.empty(0, np.int32)], 0
    while at < len(raw):
        piece = raw[at : at + _PIECE]
        last = np.flatnonzero(piece < 0x80)
        n = piece[last].astype(np.int32)
        size = np.diff(last, prepend=-1)
        for back in (1, 2, 3):
            more = size > back
            n[more] |= (piece[last[more] - back].astype(np.int32) & 0x7F) << (7 * back)
        parts.append(n)
        at += int(last[-1]) + 1
    return np.concatenate(parts)


def _chunks(batches: Iterator[pa.RecordBatch], split: Callable, limit: int) -> Iterator[tuple]:
    """(key, words, counts in flagged documents, ids, flags, lengths, packed numbers); batches hold id, flag, text."""

    def empty():
        known: dict = defaultdict()
        known.default_factory = known.__len__
        return known, [], [], [], 0

    def ended():
        # frequent words get small numbers
        every = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        order = np.argsort(-np.bincount(every, minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        words, every = list(known), rank[every]
        words = [words[i] for i in order.tolist()]
        lengths = [len(x) for x in numbers]
        flagged = np.repeat(np.array(flags, bool), lengths)
        codes = pack(every)
        key = xxhash.xxh64(codes)
        key.update("\n".join(words).encode() if words and isinstance(words[0], str) else b"\n".join(words))
        key.update(repr((ids, lengths, flags)).encode())
        counts = np.bincount(every[flagged], minlength=len(words))
        return key.intdigest() - (1 << 63), words, counts, ids, flags, lengths, codes

    known, numbers, ids, flags, size = empty()
    for batch in batches:
        for at, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py() or ""
            if ids and size + len(text) > limit:
                yield ended()
                known, numbers, ids, flags, size = empty()
            numbers.append(np.array(list(map(known.__getitem__, split(text))), np.int32))
            ids.append(at)
            flags.append(flag)
            size += len(text)
    if ids:
        yield ended()


def word_rows(docs: DataFrame, split: Callable, limit: int = CHUNK) -> DataFrame:
    """chunk, number, word (bytes) and n (occurrences in flagged documents); docs has doc_id, flag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, words, counts, *_ in _chunks(batches, split, limit):
            for at in range(0, len(words), _ROWS):
                some = words[at : at + _ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), key)), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                     pa.array([w if isinstance(w, bytes) else w.encode() for w in some], pa.binary()), pa.array(counts[at : at + _ROWS])],
                    ["chunk", "number", "word", "n"],
                )

    return docs.select("doc_id", "flag", "text").mapInArrow(giving_back(run), "chunk long, number int, word binary, n long")


def sequences(docs: DataFrame, split: Callable, limit: int = CHUNK) -> DataFrame:
    """One row per chunk: its documents' ids, flags, lengths in words, and the numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, ids, flags, lengths, codes in _chunks(batches, split, limit):
            yield pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([zlib.compress(codes, 1)], pa.binary())],
                ["chunk", "ids", "flags", "lengths", "codes"],
            )

    return docs.select("doc_id", "flag", "text").mapInArrow(
        giving_back(run), "chunk long, ids array<long>, flags array<boolean>, lengths array<int>, codes binary"
    )


def read_once(docs: DataFrame, split: Callable, limit: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """`word_rows` and `sequences` by one reading of the documents, written to the shared folder; chunks are numbered."""
    schema = "chunk long, number int, word binary, n long, ids array<long>, flags array<boolean>, lengths array<int>, codes binary"
    kinds = pa.schema([
        ("chunk", pa.int64()), ("number", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())),
        ("flags", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()),
    ])

    def batch_of(size: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds]
        return pa.RecordBatch.from_arrays(arrays, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for key, (_, words, counts, ids, flags, lengths, codes) in enumerate(_chunks(batches, split, limit), task):
            for at in range(0, len(words), _ROWS):
                some = [w if isinstance(w, bytes) else w.encode() for w in words[at : at + _ROWS]]
                yield batch_of(
                    len(some), chunk=np.full(len(some), key), number=np.arange(at, at + len(some), dtype=np.int32), word=some, n=counts[at : at + _ROWS]
                )
            yield batch_of(1, chunk=[key], ids=[ids], flags=[flags], lengths=[lengths], codes=[zlib.compress(codes, 1)])

    both = hand_over(docs.select("doc_id", "flag", "text").mapInArrow(giving_back(run), schema), "words", compression="zstd")
    found = both.where("word IS NOT NULL").select("chunk", "number", "word", "n")
    return found, both.where("word IS NULL").select(F.col("chunk").alias("chunk"), "ids", "flags", "lengths", "codes")


class Replies:
    """Results of words on their way back, gathered by chunk: numbers as packed steps, and values as bytes."""

    SCHEMA = "chunk long, numbers binary, sizes binary, data binary"

    def __init__(self, limit: int = 16 << 20):
        self.limit, self.held, self.chunks = limit, 0, {}

    def add(self, chunk: int, number: int, value: bytes) -> None:
        numbers, sizes, data = self.chunks.get(chunk) or self.chunks.setdefault(chunk, (array("I"), array("I"), bytearray()))
        numbers.append(number)
        sizes.append(len(value))
        data += value
        self.held += len(value) + 8

    def full(self) -> bool:
        return self.held > self.limit

    def batch(self) -> pa.RecordBatch:
        """All that is held, a row for each chunk."""
        rows = []
        for chunk, (numbers, sizes, data) in self.chunks.items():
            numbers, sizes = np.frombuffer(numbers, np.uint32).astype(np.int64), np.frombuffer(sizes, np.uint32)
            ends, order = np.cumsum(sizes, dtype=np.int64), np.argsort(numbers, kind="stable")
            data = b"".join([data[e - n : e] for e, n in zip(ends[order].tolist(), sizes[order].tolist())])
            steps = np.diff(numbers[order], prepend=0)
            rows.append((chunk, *(zlib.compress(x, 1) for x in (pack(steps), pack(sizes[order]), data))))
        self.chunks, self.held = {}, 0
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [list(c) for c in zip(*rows)] or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "numbers", "sizes", "data"])

    @staticmethod
    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Numbers, sizes and joined values of the rows of a chunk."""
        of = lambda name: [zlib.decompress(x) for x in rows.column(name).to_pylist()]
        none = [np.empty(0, np.int64)]
        numbers = [np.cumsum(unpack(x), dtype=np.int64) for x in of("numbers")]
        return np.concatenate(none + numbers), np.concatenate(none + [unpack(x).astype(np.int64) for x in of("sizes")]), b"".join(of("data"))


def by_word(words: DataFrame) -> DataFrame:
    """The rows of a word next to each other in one task; a word has one row per chunk at most."""
    return words.repartition("word").sortWithinPartitions("word")


def assemble(results: DataFrame, texts: DataFrame, arrange: Callable, build: Callable, schema: str) -> DataFrame:
    """Rows made by build(results of a chunk's words, ids, flags, numbers, starts of the documents).

    results has a chunk and more columns; arrange(their Arrow table) gives the number of words and the results
    by number.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, left = arrange(left)
        tables = []
        for row in range(right.num_rows):
            ids, flags, lengths, codes = (right.column(c)[row].as_py() for c in ("ids", "flags", "lengths", "codes"))
            starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
            numbers = unpack(zlib.decompress(codes))
            if n <= (int(numbers.max()) if len(numbers) else -1):
                raise ValueError("a chunk has lost words: its input gave other rows when it was read again")
            tables.append(build(left, ids, flags, numbers, starts))
        give_back()
        return pa.concat_tables(tables) if tables else build(left, [], [], np.empty(0, np.int64), np.zeros(1, np.int64))

    return results.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(run, schema)


def by_number(results: pa.Table) -> tuple[int, pa.Table]:
    """Rows of words in the order of their numbers, each once."""
    order = np.unique(results.column("number").to_numpy(), return_index=True)[1]
    return len(order), results.take(pa.array(order))


def flagged(docs: DataFrame, flag=None) -> DataFrame:
    """doc_id, flag and text as the functions above take them."""
    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("flag"), "text")
