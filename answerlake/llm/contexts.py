"""Contexts of preceding words: which are kept, and what they make of the probability of the next word.

A document is a begin, its words and an end. A context is the last 1 to `DEPTH` symbols before a word (the begin may be
the oldest). Training occurrences are counted for every context that occurs `LEAST` times or more; it is kept if
naming its next words by its own counts, each new one named once by the parent (the context without its oldest word),
saves at least `GAIN` nats: sum of n ln p - (n - 1) ln q over its next words. Neither limit depends on the size of the
corpus. A kept context with N occurrences and T different next words gives a word it saw n times the probability
(n + T P) / (N + T), P being what its longest kept suffix gives, in the end the probability without a context; so what
it gives sums to what that sums to.

Chunks of documents send the distinct pairs (context, next word) to buckets by context, depth by depth, as packed
arrays; a bucket adds them up and answers each chunk in the order it was asked. Contexts with a share of the corpus of a
bucket's size (HOT) are spread over all buckets by their next words; the few sums of each are added up apart. How often
a context occurs is known from the depth before: it is the count of its last word after the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.common import give_back, giving_back
from answerlake.llm.wordtable import pack, unpack
from answerlake.session import hand_over

DEPTH, LEAST, GAIN = 3, 16, 4.0
#: Training symbols of a bucket, and the least occurrences of a context that is spread.
BUCKET, HOT = 1 << 20, 1 << 16
_SALT, _TURN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as compressed bytes."""
    parts = []
    for a in arrays:
        small = not len(a) or (a.min() >= 0 and a.max() < 1 << 28)
        data = pack(a) if small else a.astype(np.int64).tobytes()
        parts += [struct.pack("<?q", small, len(data)), data]
    return zlib.compress(b"".join(parts), 1)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    data, at, out = memoryview(zlib.decompress(data)), 0, []
    while at < len(data):
        small, size = struct.unpack_from("<?q", data, at)
        part = data[at + 9 : at + 9 + size]
        out.append(unpack(part).astype(np.int64) if small else np.frombuffer(part, np.int64))
        at += 9 + size
    return out


def mix(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys.view(np.uint64) + _TURN) * _SALT ^ (words.view(np.uint64) + np.uint64(1)) * _TURN
        x = (x ^ (x >> np.uint64(29))) * _SALT
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def in_order(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Places in the order of keys and, for one key, of symbols."""
    if len(keys) and (keys.min() < 0 or keys.max() >= 1 << 35):
        by_key = np.argsort(keys)
        dense = np.empty(len(keys), np.int64)
        dense[by_key] = np.cumsum(np.diff(keys[by_key], prepend=keys[by_key[0]]) != 0)
        keys = dense
        del by_key, dense
    if len(symbols) and symbols.max() >= 1 << 28:
        return np.lexsort((symbols, keys))
    both = keys << 28
    both |= symbols
    return _small(np.argsort(both))


def _small(places: np.ndarray) -> np.ndarray:
    """Places in 32 bits where they fit, as a task holds several for every symbol of its chunk."""
    return places.astype(np.int32) if len(places) < 1 << 31 else places


def changes(keys: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where another key begins, and where another pair does."""
    key = np.ones(len(keys), bool)
    key[1:] = keys[1:] != keys[:-1]
    pair = key.copy()
    pair[1:] |= symbols[1:] != symbols[:-1]
    return key, pair


class Facts:
    """What every task knows: counts of words by their rank, the symbols of begin and end, and the limits."""

    def __init__(self, firsts: np.ndarray, counts: np.ndarray, size: int, ends: int, depth: int, least: int, gain: float, hot: int = 0):
        """Words from rank firsts[i] on occur counts[i] times, most frequent first; `size` words in all."""
        self.firsts, self.counts, self.ends = firsts, counts, ends
        self.end, self.begin = size, size + 1
        self.total = int((np.diff(np.append(firsts, size)) * counts).sum()) + ends
        self.depth, self.least, self.gain = depth, least, gain
        self.buckets = 1 + self.total // BUCKET
        self.hot = hot or max(HOT, self.total >> 12)
        self._cut = int(firsts[counts < least].min(initial=size))

    def count(self, symbols: np.ndarray) -> np.ndarray:
        out = np.full(len(symbols), self.ends, np.int64)
        words = symbols < self.end
        out[words] = self.counts[np.searchsorted(self.firsts, symbols[words], "right") - 1]
        return out

    def often(self, symbols: np.ndarray) -> np.ndarray:
        """Which symbols occur `least` times or more; the end comes before nothing."""
        return (symbols < self._cut) | ((symbols == self.begin) & (self.ends >= self.least))

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        found = (hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        return found.astype(np.uint16 if self.buckets < 1 << 16 else np.int64)


class Text:
    """The symbols of a chunk of documents and, for the depth last looked at, what is known of each one's context."""

    def __init__(self, facts: Facts, lengths: np.ndarray, flags: np.ndarray, words: np.ndarray):
        sizes = lengths + 2
        first = np.cumsum(sizes) - sizes
        self.facts = facts
        self.codes = np.full(int(sizes.sum()), facts.end, np.int64)
        self.codes[first] = facts.begin
        self.codes[np.arange(len(words)) + np.repeat(2 * np.arange(len(lengths)) + 1, lengths)] = words
        self.inside = (np.arange(len(self.codes)) - np.repeat(first, sizes)).astype(np.int32)
        self.flags = np.repeat(flags.astype(bool), sizes)
        self.first, self.depth = first, 0

    def ask(self) -> None:
        """Goes one depth on: the distinct pairs of contexts that occur often enough, in the order of their buckets."""
        self.depth += 1
        facts = self.facts
        if self.depth == 1:
            use = facts.often(self.codes[:-1])
        else:
            use = self.n[:-1] >= facts.least
        # what the depth before has left is freed before as much again is made
        self.of = self.bucket = self.pair_keys = self.pair_symbols = self.pair_total = self.seen = self.at = self.at_keys = None
        use &= self.inside[1:] >= self.depth
        at = _small(np.flatnonzero(use)) + 1
        symbols, older = self.codes[at], self.codes[at - self.depth]
        keys = older if self.depth == 1 else mix(self.keys[at], older)
        del use, older
        order = in_order(keys, symbols)
        new_key, new = changes(keys[order], symbols[order])
        of = np.empty(len(at), np.int32)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        context = np.cumsum(new_key[new]) - 1
        one = order[new_key]
        total = facts.count(keys[one]) if self.depth == 1 else self.n[at[one] - 1]
        bucket = facts.bucket(mix(keys[one], np.zeros(len(one), np.int64)))[context]
        many = np.flatnonzero((total >= facts.hot)[context])
        bucket[many] = facts.bucket(mix(keys[first[many]], symbols[first[many]]))
        by_bucket = np.argsort(bucket, kind="stable")
        place = np.empty(len(first), np.int32)
        place[by_bucket] = np.arange(len(first))
        self.of, first, self.bucket = place[of], first[by_bucket], bucket[by_bucket]
        self.pair_keys, self.pair_symbols, self.pair_total = keys[first], symbols[first], total[context[by_bucket]]
        self.seen = np.bincount(self.of, self.flags[at], len(first)).astype(np.int64)
        self.above = np.empty((2, 0), np.int64) if self.depth == 1 else np.stack((self.n[at[first]], self.total[at[first]]))
        self.starts = np.flatnonzero(changes(self.bucket, self.pair_keys)[1])
        self.at, self.at_keys = at, keys

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, contexts with their occurrences and next words)"""
        edges = np.flatnonzero(np.diff(self.bucket.astype(np.int64), prepend=-1, append=-1)) if len(self.bucket) else []
        for s, e in zip(edges[:-1], edges[1:]):
            a, b = np.searchsorted(self.starts, (s, e))
            starts = self.starts[a:b]
            parts = [self.pair_keys[starts], self.pair_total[starts], np.diff(np.append(starts, e)), self.pair_symbols[s:e], self.seen[s:e]]
            if self.depth > 1:
                parts += [self.above[1][starts], self.above[0][s:e]]
            yield int(self.bucket[s]), squeeze(*parts)

    def hear(self, answers: list[bytes], hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Takes the answers in the order of the buckets; gives the places of kept contexts, n, N and T of each."""
        told = [unsqueeze(a) for a in answers]
        none = [np.empty(0, np.int64)]
        n, kinds = np.concatenate(none + [t[0] for t in told]), np.concatenate(none + [t[1] for t in told])
        if len(n) != len(self.bucket) or len(kinds) != len(self.starts):
            raise ValueError("a chunk has other answers than questions: its input gave other rows when it was read again")
        kinds = np.repeat(kinds, np.diff(np.append(self.starts, len(n))))
        many = np.flatnonzero(self.pair_total >= self.facts.hot)
        kinds[many] = hot[1][np.searchsorted(hot[0], self.pair_keys[many])] if len(many) else 0
        size = len(self.codes)
        self.n, self.total, self.keys = (np.zeros(size, np.int64) for _ in range(3))
        self.n[self.at], self.total[self.at], self.keys[self.at] = n[self.of], self.pair_total[self.of], self.at_keys
        kept = np.flatnonzero((kinds > 0)[self.of])
        pair = self.of[kept]
        return self.at[kept], n[pair], self.pair_total[pair], kinds[pair]


def gains(n: np.ndarray, above: np.ndarray) -> np.ndarray:
    """What each next word adds to the gain of its context; `totals_gain` is what the totals add."""
    some = np.maximum(n, 1)
    return np.where(n > 0, some * np.log(some) - (some - 1) * np.log(np.maximum(above, 1)), 0.0)


def totals_gain(total: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    return (total - kinds) * np.log(np.maximum(above, 1)) - total * np.log(np.maximum(total, 1))


ANSWERS = "bucket int, part long, payload binary, context long, total long, above long, kinds long, gain double"


def settle(facts: Facts, depth: int, table: pa.Table) -> pa.Table:
    """The answers of a bucket to every chunk: n of each pair, and T of each context (0 if it is not kept)."""
    asked = [unsqueeze(p) for p in table.column("payload").to_pylist()]
    sizes = [a[2] for a in asked]
    key, total = (np.concatenate([np.repeat(a[k], a[2]) for a in asked]) for k in (0, 1))
    symbol, seen = (np.concatenate([a[k] for a in asked]) for k in (3, 4))
    if depth == 1:
        above_all, above = np.full(len(key), facts.total), facts.count(symbol)
    else:
        above_all, above = np.concatenate([np.repeat(a[5], a[2]) for a in asked]), np.concatenate([a[6] for a in asked])
    order = in_order(key, symbol)
    new_key, new = changes(key[order], symbol[order])
    pair = np.flatnonzero(new)
    n = np.add.reduceat(seen[order], pair)
    context = np.flatnonzero(new_key[pair])
    one = order[pair[context]]
    kinds = np.add.reduceat((n > 0).astype(np.int64), context)
    gain = np.add.reduceat(gains(n, above[order[pair]]), context)
    hot = total[one] >= facts.hot
    kept = ~hot & (gain + totals_gain(total[one], kinds, above_all[one]) >= facts.gain)
    count, t = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    count[order] = n[np.cumsum(new) - 1]
    t[order] = np.where(kept, kinds, 0)[np.cumsum(new_key) - 1]
    ends = np.cumsum([s.sum() for s in sizes])
    payloads = [
        squeeze(count[e - s.sum() : e], t[e - s.sum() + np.cumsum(s) - s]) for s, e in zip(sizes, ends.tolist())
    ]
    k, many = len(asked), np.flatnonzero(hot)
    pad = lambda values, kind: pa.concat_arrays([pa.nulls(k, kind), pa.array(values, kind)])
    give_back()
    return pa.table({
        "bucket": pa.array([*table.column("bucket").to_pylist(), *[None] * len(many)], pa.int32()),
        "part": pa.array([*table.column("part").to_pylist(), *[None] * len(many)], pa.int64()),
        "payload": pa.array([*payloads, *[None] * len(many)], pa.binary()),
        "context": pad(key[one][many], pa.int64()), "total": pad(total[one][many], pa.int64()),
        "above": pad(above_all[one][many], pa.int64()), "kinds": pad(kinds[many], pa.int64()), "gain": pad(gain[many], pa.float64()),
    })


def _known(facts: Facts, row: dict, answers: pa.Table | None, hot: list) -> Iterator[tuple]:
    """Depth by depth what `hear` gives, with the text; after the last answered depth the text alone, to be asked."""
    text = Text(facts, *unsqueeze(row["sizes"]), unsqueeze(row["words"])[0])
    held: dict[int, list] = {}
    for depth, bucket, payload in zip(*(answers.column(c).to_pylist() for c in ("depth", "bucket", "payload"))) if answers else ():
        held.setdefault(depth, []).append((bucket, payload))
    for depth in range(1, len(hot) + 1):
        text.ask()
        yield text, text.hear([p for _, p in sorted(held.get(depth, []))], hot[depth - 1])
    yield text, None


def _answered(state: DataFrame, answers: DataFrame | None, shared, hot: list) -> DataFrame:
    """The answers of the depth after those in `hot`, and the sums of the contexts that are spread."""
    depth = len(hot) + 1

    def asked(row: dict, table: pa.Table | None) -> pa.Table:
        *_, (text, _) = _known(shared.value, row, table, hot)
        text.ask()
        rows = list(text.questions())
        parts = [pa.array([r[0] for r in rows], pa.int32()), pa.array([row["part"]] * len(rows), pa.int64())]
        return pa.table([*parts, pa.array([r[1] for r in rows], pa.binary())], ["bucket", "part", "payload"])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from asked(batch.slice(at, 1).to_pylist()[0], None).to_batches()

    def by_part(left, right):
        out = asked(left.to_pylist()[0], right)
        give_back()
        return out

    def settled(table):
        return settle(shared.value, depth, table)

    own, schema = state.select("part", "sizes", "words"), "bucket int, part long, payload binary"
    if answers is None:
        sent = own.mapInArrow(giving_back(by_row), schema)
    else:
        sent = own.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(by_part, schema)
    return hand_over(sent.groupBy("bucket").applyInArrow(settled, ANSWERS), f"contexts{depth}", tidy=True)


def learn(state: DataFrame, facts: Facts) -> tuple[DataFrame, list]:
    """The answers of all depths (part, depth, bucket, payload) to the chunks of `state` (part, sizes, words), and the
    kept ones of the contexts that are spread, by depth."""
    shared = state.sparkSession.sparkContext.broadcast(facts)
    answers, hot = None, []
    for depth in range(1, facts.depth + 1):
        told = _answered(state, answers, shared, hot)
        # at most 4096 contexts hold as large a share of the corpus
        sums = told.where("part IS NULL").groupBy("context").agg(F.max("total"), F.max("above"), F.sum("kinds"), F.sum("gain")).collect()
        columns = [np.array(c) for c in zip(*sorted(tuple(r) for r in sums))] or [np.empty(0, np.int64)] * 5
        kept = columns[4] + totals_gain(columns[1], columns[3], columns[2]) >= facts.gain
        hot = [*hot, (columns[0], np.where(kept, columns[3], 0))]
        told = told.where("part IS NOT NULL").select("part", F.lit(depth).alias("depth"), "bucket", "payload")
        answers = told if answers is None else answers.union(told)
    return answers, hot


def smoothed(n, total, kinds, below: np.ndarray) -> np.ndarray:
    """log10 of (n + kinds * P) / (total + kinds), from log10 P; P may be too small for a double."""
    with np.errstate(divide="ignore"):
        return np.where(n > 0, np.log10(n + kinds * 10.0**below), below + np.log10(kinds)) - np.log10(total + kinds)


def follow(facts: Facts, row: dict, answers: pa.Table, hot: list, alone: Callable) -> tuple[Text, np.ndarray]:
    """The text of a chunk and the log10 probability of each of its symbols; `alone` gives it without a context."""
    steps = _known(facts, row, answers, hot)
    text, heard = next(steps)
    p = alone(text.codes)
    while heard is not None:
        at, n, total, kinds = heard
        p[at] = smoothed(n, total, kinds, p[at])
        text, heard = next(steps)
    return text, p
