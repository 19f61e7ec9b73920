"""Byte-level BPE: words are encoded once over all documents, and ids are joined back by position.

A text is cut at single spaces, where no match of the pattern can reach across, into words with
their space; texts with other runs of white space around a space are cut by the pattern itself. Each
distinct word of a chunk of documents is shuffled to one task, which encodes it once, match by match;
the ids go back to the chunk and the texts are put together by position. Decoding joins the table of
token bytes, whose size the vocabulary sets.

Null and empty texts have no ids. Repeated rows give equal rows. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import wordtable
from answerlake.llm.common import giving_back, in_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A cut at a space could split a run of white space that the pattern takes as one match.
_RUNS = re.compile(r"  |\s (?:\s|\Z)")
#: Bytes from which merges are taken from a heap instead of looked for in a scan.
_LONG = 64
#: Words put together at a time.
PIECE = 1 << 18


def words(text: str) -> list[str]:
    """Pieces that the pattern never matches across; joined they are the text."""
    if _RUNS.search(text):
        return _pattern().findall(text)
    first, *rest = text.split(" ")
    rest = [" " + w for w in rest]
    return [first, *rest] if first else rest


@lru_cache(1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, as published: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one match: the adjacent pair of the lowest rank is merged until none is left."""
    if word in table:
        return [table[word]]
    if len(word) >= _LONG:
        return _merge_long(word, table)
    parts = [word[i : i + 1] for i in range(len(word))]
    costs = [table.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
    while costs:
        least = min(costs)
        if least == 1 << 40:
            break
        at = costs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del costs[at]
        if at < len(costs):
            costs[at] = table.get(parts[at] + parts[at + 1], 1 << 40)
        if at:
            costs[at - 1] = table.get(parts[at - 1] + parts[at], 1 << 40)
    return [table[p] for p in parts]


def _merge_long(word: bytes, table: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(table[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in table]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := table.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        # an entry counts only while both parts are still as they were
        if middle < 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(table[word[i : end[i]]])
        i = end[i]
    return out


def encode_words(rows: DataFrame, path: str) -> DataFrame:
    """The ids of word rows, gathered by chunk; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split, last, packed = ranks(path), _pattern(), None, b""
        remembered: dict[str, list[int]] = {}
        replies = wordtable.Replies()
        for batch in batches:
            for chunk, number, word in zip(*(c.to_pylist() for c in batch.columns)):
                if word != last:
                    last, ids = word, []
                    for match in split.findall(word.decode()):
                        known = remembered.get(match)
                        if known is None:
                            if len(remembered) >= 1 << 14:
                                remembered.clear()
                            known = remembered[match] = merge(match.encode(), table)
                        ids += known
                    packed = np.array(ids, np.uint16 if len(table) < 1 << 16 else np.uint32).tobytes()
                replies.add(chunk, number, packed)
            if replies.full():
                yield replies.batch()
        yield replies.batch()

    return wordtable.by_word(rows.select("chunk", "number", "word")).mapInArrow(giving_back(run), wordtable.Replies.SCHEMA)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False, chunk: int = wordtable.CHUNK) -> DataFrame:
    """doc_id and ids (array of int) of every document; and the bytes they decode to, where the ids are at hand.

    A task holds one chunk of texts of about `chunk` bytes at a time: smaller ones take less memory and send more words.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = np.uint16 if len(ranks(path)) < 1 << 16 else np.uint32
    rows = wordtable.flagged(docs)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *([("decoded", pa.binary())] if decoded else [])])
    shared = _token_bytes(docs.sparkSession, path)

    def arrange(results: pa.Table):
        numbers, sizes, data = wordtable.Replies.read(results)
        ends = np.cumsum(sizes) // kind().itemsize
        at = np.unique(numbers, return_index=True)[1]
        size = sizes[at] // kind().itemsize
        return len(at), (np.frombuffer(data, kind), ends[at] - size, size)

    def build(results, doc_ids, _, numbers: np.ndarray, starts: np.ndarray) -> pa.Table:
        ids, first, size = results
        tables, lengths = [], np.diff(starts).tolist()
        for some in in_slices(list(range(len(doc_ids))), lengths, PIECE):
            own = numbers[starts[some[0]] : starts[some[-1] + 1]]
            sizes = size[own]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            # every word's ids, at the places of its occurrences
            at = np.repeat((first[own] - ends[:-1]).astype(np.int32), sizes)
            at += np.arange(len(at), dtype=np.int32)
            offsets = ends[starts[some[0] : some[-1] + 2] - starts[some[0]]].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[at].astype(np.int32)))
            columns = [pa.array(doc_ids[some[0] : some[-1] + 1], pa.int64()), lists]
            tables.append(pa.Table.from_arrays([*columns, *([decode_lists(lists, shared.value)] if decoded else [])], schema=out))
        return pa.concat_tables(tables) if tables else out.empty_table()

    encoded = encode_words(wordtable.word_rows(rows, words, chunk), path)
    return wordtable.assemble(encoded, wordtable.sequences(rows, words, chunk), arrange, build, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def _token_bytes(spark: SparkSession, path: str):
    """The token table for every task: one entry per id of the vocabulary."""
    return spark.sparkContext.broadcast({i: t for t, i in ranks(path).items()})


def decode_lists(lists: pa.Array, table: dict[int, bytes]) -> pa.Array:
    """Every id of every list meets its row of the token table."""
    texts = (b"".join(map(table.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else None for ids in lists)
    return pa.array(texts, pa.binary())


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with the decoded bytes: every id meets its row of the token table, which each task has whole."""
    shared = _token_bytes(encoded.sparkSession, path or public_tokenizers.path(VOCABULARY))
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, decode_lists(batch.column(place), shared.value)], [*batch.schema.names, "decoded"]
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(giving_back(run), f"{schema}, decoded binary")


def tokenised(docs: DataFrame, chunk: int = wordtable.CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded bytes of every document."""
    return encode(docs, decoded=True, chunk=chunk).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Per document: number of tokens, digest of the ids and digest of the bytes they decode to."""
    return encode(docs, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
