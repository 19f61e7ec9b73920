"""Language-model scores by a probabilistic suffix tree over the words of a text.

A word (or the end) is predicted by the longest kept suffix of the words before it (`contexts.py`). Without a kept
context, words are predicted by their counts, smoothed towards their spelling, which has a suffix tree of its own.

The tree of the spelling predicts the next character of a word from the characters before it (a boundary comes first and
the space after a word ends it); the end of a text is one more symbol, predicted where a word could begin. A context
of characters is kept if its next-symbol distribution diverges from that of its parent (the context without its
oldest character) by enough: count times divergence of at least EPSILON times all symbols. Since the
divergence is at most the logarithm of that total, the number of contexts of a depth is bounded by
ln(total) / EPSILON, whatever the corpus. Distributions are smoothed towards the parent's by the number of
different symbols seen. A symbol is predicted by the longest kept suffix of what precedes it. Counts of whole words (and the end)
are smoothed in the same way towards what this tree gives their spelling.

Counts come from all training documents: words are counted where they are read, added up by word and ranked by
count; the spelling is counted from the table of distinct words. A word's probability without a context is computed
once and joined back, with its rank, to the documents by word; contexts are counted by position.

Null and empty texts hold only their end. Repeated rows count as often as they occur; rows with a null id
are training rows. Extra columns are ignored; an empty table gives no rows, and with no training
document every count is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm import contexts, wordtable
from answerlake.llm.common import LOWER_BYTES, codes_of, crc_mod, give_back, grams_of
from answerlake.session import hand_over

DEPTH = 6
EPSILON = 2e-6
#: The symbol for the end of a text, beyond all characters.
END = 0x110000
#: Rows of counts a task holds before it adds them up.
HELD = 1 << 21
#: Bytes of text of a chunk.
CHUNK = 16 << 20
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER_BYTES).split()


def _with_symbol(contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (contexts ^ (symbols + np.uint64(1))) * _SALT
        return mixed ^ (mixed >> np.uint64(31))


def _positions(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Per predicted symbol of the words: word, symbol, and for each depth the context's hash (0: leaves the word)."""
    codes, lengths = codes_of([w.decode("utf-8", "replace") for w in group])
    first = np.cumsum(lengths) - lengths
    predicted = np.ones(len(codes), bool)
    predicted[first] = False
    at = np.flatnonzero(predicted)
    contexts = [np.ones(len(at), np.uint64)] + [g[at - 1] for g in grams_of(codes, lengths, DEPTH)]
    return np.repeat(np.arange(len(group)), lengths)[at], codes[at], contexts, first


def _end_positions() -> tuple[np.ndarray, list[np.ndarray]]:
    codes, lengths = codes_of([""])
    contexts = [np.ones(1, np.uint64)] + [g[:1] for g in grams_of(codes, lengths, DEPTH)]
    return np.array([END], np.uint64), contexts


def symbol_counts(vocabulary: DataFrame, ends: int) -> DataFrame:
    """depth, context, parent, symbol and n from distinct words with their counts c."""

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        key = _with_symbol(rows["context"] ^ rows["depth"].astype(np.uint64), rows["symbol"].astype(np.uint64))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        out = rows[first]
        out["n"] = np.bincount(of, rows["n"]).astype(np.int64)
        return out

    kind = [("depth", np.int32), ("context", np.uint64), ("parent", np.uint64), ("symbol", np.int32), ("n", np.int64)]

    def rows_of(contexts, symbols, n) -> Iterator[np.ndarray]:
        for depth in range(DEPTH + 1):
            use = contexts[depth] != 0
            rows = np.empty(int(use.sum()), kind)
            rows["depth"], rows["context"] = depth, contexts[depth][use]
            rows["parent"] = contexts[max(0, depth - 1)][use]
            rows["symbol"], rows["n"] = symbols[use], n[use]
            yield rows

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        columns = [np.ascontiguousarray(rows[name]) for name, _ in kind]
        columns = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [name for name, _ in kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                word, symbols, contexts, _ = _positions(part.column(0).to_pylist())
                held.append(summed(list(rows_of(contexts, symbols, part.column(1).to_numpy()[word]))))
                size += len(held[-1])
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield batch_of(held[0])
                        held, size = [], 0
        if held:
            yield batch_of(summed(held))

    schema = "depth int, context long, parent long, symbol int, n long"
    symbols, contexts = _end_positions()
    last = np.concatenate(list(rows_of(contexts, symbols, np.array([ends]))))
    ended = vocabulary.sparkSession.createDataFrame(
        [tuple(int(x) for x in (r["depth"], r["context"].view(np.int64), r["parent"].view(np.int64), r["symbol"], r["n"])) for r in last], schema
    )
    counted = vocabulary.where("c > 0").select("word", "c").mapInArrow(run, schema)
    return counted.union(ended.where("n > 0")).groupBy("depth", "context", "parent", "symbol").agg(F.sum("n").alias("n"))


class Tree:
    """Kept contexts with their back-off, and (context, symbol) pairs with log10 probabilities, as sorted arrays."""

    def __init__(self, rows: dict[str, np.ndarray], keep: np.ndarray):
        """rows: depth, context, parent, symbol, n, total, kinds of the pairs of all contexts that may be kept;
        keep: hashes of the contexts that passed the test."""
        depth, context, parent = rows["depth"], rows["context"], rows["parent"]
        # a kept context brings its suffixes along
        kept = set(keep.tolist())
        up = {}
        for d in range(DEPTH, 0, -1):
            at = depth == d
            up = dict(zip(context[at].tolist(), parent[at].tolist()))
            kept |= {up[c] for c in up if c in kept}
        kept.add(1)
        use = np.isin(context, np.fromiter(kept, np.uint64, len(kept)))
        rows = {k: v[use] for k, v in rows.items()}
        order = np.argsort(rows["depth"], kind="stable")
        rows = {k: v[order] for k, v in rows.items()}
        pair = _with_symbol(rows["context"], rows["symbol"].astype(np.uint64))
        self.states, first = np.unique(rows["context"], return_index=True)
        total, kinds = rows["total"].astype(float), rows["kinds"].astype(float)
        self.back = np.log10(kinds[first] / (total[first] + kinds[first])) if len(first) else np.empty(0)
        root = rows["depth"] == 0
        known = float(root.sum())
        #: an unseen symbol at the root
        self.floor = float(np.log10(1 / (total[root][0] + known + 1))) if known else -6.0
        logs = np.empty(len(pair))
        logs[root] = np.log10((rows["n"][root] + 1) / (total[root] + known + 1))
        by_pair, by_log = np.sort(pair[root]), logs[root][np.argsort(pair[root])]
        for d in range(1, DEPTH + 1):
            at = rows["depth"] == d
            below = _with_symbol(rows["parent"][at], rows["symbol"][at].astype(np.uint64))
            # what a context has seen its suffix has seen too
            lower = 10 ** by_log[np.searchsorted(by_pair, below)] if at.any() else np.empty(0)
            logs[at] = np.log10((rows["n"][at] + kinds[at] * lower) / (total[at] + kinds[at]))
            by_pair, by_log = np.concatenate((by_pair, pair[at])), np.concatenate((by_log, logs[at]))
            order = np.argsort(by_pair)
            by_pair, by_log = by_pair[order], by_log[order]
        self.pairs, self.logs = by_pair, by_log

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return place, keys[place] == wanted

    def _predict(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        out, todo = np.zeros(len(symbols)), np.arange(len(symbols))
        for depth in range(DEPTH, -1, -1):
            if not len(todo):
                break
            place, is_state = self._at(self.states, contexts[depth][todo])
            inside = todo[is_state]
            found, hit = self._at(self.pairs, _with_symbol(contexts[depth][inside], symbols[inside]))
            out[inside[hit]] += self.logs[found[hit]]
            missed = inside[~hit]
            if depth:
                out[missed] += self.back[place[is_state][~hit]]
                todo = np.concatenate((todo[~is_state], missed))
            else:
                out[missed] += self.floor
                out[todo[~is_state]] += self.floor
        return out

    def scores(self, group: list[bytes]) -> np.ndarray:
        """log10 probability of each word with the space that ends it."""
        if not group:
            return np.empty(0)
        word, symbols, contexts, _ = _positions(group)
        return np.bincount(word, self._predict(symbols, contexts), len(group))

    def end(self) -> float:
        return float(self._predict(*_end_positions())[0])


def grow(vocabulary: DataFrame, ends: int, epsilon: float = EPSILON) -> Tree:
    """The tree of a table of distinct words; only pairs of contexts that can pass the test are looked at."""
    counts = hand_over(symbol_counts(vocabulary, ends), "symbols", tidy=True)
    whole = counts.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    totals = counts.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    # n(context) / n(parent) bounds the ratio of the distributions, so smaller contexts cannot pass
    least = epsilon * whole / max(1.0, float(np.log(max(2, whole))))
    totals = totals.where((F.col("depth") == 0) | (F.col("total") >= least))
    pairs = hand_over(counts.join(totals, ["depth", "context"]), "pairs", tidy=True)
    above = pairs.select(
        (F.col("depth") + 1).alias("depth"), F.col("context").alias("parent"), "symbol", (F.col("n") / F.col("total")).alias("q")
    )
    p = F.col("n") / F.col("total")
    kept = (
        pairs.join(above, ["depth", "parent", "symbol"])
        .groupBy("context").agg(F.sum(F.col("n") * F.log(p / F.col("q"))).alias("gain"))
        .where(F.col("gain") >= epsilon * whole).select("context")
    )
    names = ("depth", "context", "parent", "symbol", "n", "total", "kinds")
    keep = np.array([r[0] for r in kept.toLocalIterator()], np.int64).view(np.uint64)
    rows = pairs.select(*names).toArrow()
    columns = {k: rows.column(k).to_numpy() for k in names}
    for k in ("context", "parent"):
        columns[k] = np.ascontiguousarray(columns[k]).view(np.uint64)
    return Tree(columns, keep)


def _ranked(words: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The words (word, c) with an id, most frequent first; the first id and the rank it stands for, per task that wrote them."""
    ids = F.monotonically_increasing_id()
    vocabulary = hand_over(words.orderBy(F.desc("c"), F.xxhash64("word")).select("word", "c", ids.alias("id")), "vocabulary", tidy=True)
    tasks = vocabulary.groupBy(F.shiftright("id", 33).alias("task")).agg(F.min("id"), F.count("*")).sort("task").collect()
    sizes = np.array([t[2] for t in tasks], np.int64)
    return vocabulary, np.array([t[1] for t in tasks], np.int64), np.cumsum(sizes) - sizes


def score(docs: DataFrame, training, depth: int = contexts.DEPTH, least: int = contexts.LEAST, gain: float = contexts.GAIN, hot: int = 0) -> DataFrame:
    """Counts and scores of every document by what the documents where `training` holds have taught."""
    rows = wordtable.flagged(docs, training)
    found, texts = wordtable.read_once(rows, words, CHUNK)
    vocabulary, first, rank = _ranked(found.groupBy("word").agg(F.sum("n").alias("c")))
    # as many rows as there are different counts: fewer than the square root of twice the corpus
    steps = vocabulary.groupBy("c").agg(F.min("id").alias("id"), F.count("*").alias("n")).sort("id").collect()
    ends = rows.where("flag").count()
    kinds = sum(s["n"] for s in steps if s["c"]) + (ends > 0)

    def ranks(ids: np.ndarray) -> np.ndarray:
        task = np.searchsorted(first, ids, "right") - 1
        return ids - first[task] + rank[task]

    starts = ranks(np.array([s["id"] for s in steps], np.int64)) if steps else np.empty(0, np.int64)
    size = sum(s["n"] for s in steps)
    facts = contexts.Facts(starts, np.array([s["c"] for s in steps], np.int64), size, ends, depth, least, gain, hot)
    n = facts.total
    tree = grow(vocabulary, ends)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    scale = n + 0.5 * (kinds + 1)

    def blended(c, log):
        return contexts.smoothed(c, n, max(1, kinds), log)

    end_alone = float(blended(ends, tree.end()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_pylist()
            logs = [shared.value.scores(group[at : at + 4096]) for at in range(0, len(group), 4096)]
            p = blended(batch.column(1).to_numpy(), np.concatenate(logs) if logs else np.empty(0))
            at = ranks(batch.column(2).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(p)], ["word", "rank", "p"])

    ranked = vocabulary.mapInArrow(run, "word binary, rank int, p double")
    results = found.select("chunk", "number", "word").join(ranked, "word").select("chunk", "number", "rank", "p")

    def build(results: pa.Table, ids, flags, numbers: np.ndarray, starts: np.ndarray) -> pa.Table:
        at, p = results.column("rank").to_numpy(), results.column("p").to_numpy()
        order = np.argsort(at)
        # ids come again as they were; a chunk without documents gives no row
        some = slice(0, int(len(ids) > 0))
        return pa.table({
            "ids": pa.array([ids][some], pa.list_(pa.int64())),
            "sizes": pa.array([contexts.squeeze(np.diff(starts), np.array(flags, np.int64))][some], pa.binary()),
            "words": pa.array([contexts.squeeze(at[numbers])][some], pa.binary()),
            "known": pa.array([contexts.squeeze(np.diff(at[order], prepend=0))][some], pa.binary()),
            "alone": pa.array([p[order].tobytes()][some], pa.binary()),
        })

    state = wordtable.assemble(results, texts, wordtable.by_number, build, "ids array<long>, sizes binary, words binary, known binary, alone binary")
    state = hand_over(state.withColumn("part", F.monotonically_increasing_id()), "texts", tidy=True)
    answers, hot_ones = contexts.learn(state, facts)
    model = spark.sparkContext.broadcast(facts)
    end_base = float(np.log10((ends + 0.5) / scale))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        known, alone = np.cumsum(contexts.unsqueeze(row["known"])[0]), np.frombuffer(row["alone"])

        def root(codes: np.ndarray) -> np.ndarray:
            p = np.full(len(codes), end_alone)
            inner = codes < model.value.end
            p[inner] = alone[np.searchsorted(known, codes[inner])]
            return p

        text, p = contexts.follow(model.value, row, right, hot_ones, root)
        c = model.value.count(text.codes)
        # a begin is no token
        c[text.first], p[text.first] = 0, 0.0
        bases = np.log10((c + 0.5) / scale)
        bases[text.first] = 0
        total = lambda x: np.add.reduceat(x, text.first)
        edges = np.append(text.first, len(c))
        base = [float(np.sum(bases[s + 1 : e - 1])) + end_base for s, e in zip(edges[:-1], edges[1:])]
        flags = text.flags[text.first].astype(bool)
        out = pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "flag": pa.array(flags), "n_tokens": pa.array(np.diff(edges) - 1),
            "n_known": pa.array(total((c > 0).astype(np.int64))), "base_score": pa.array(base, pa.float64()), "score": pa.array(total(p)),
        })
        give_back()
        return out

    schema = "doc_id long, flag boolean, n_tokens long, n_known long, base_score double, score double"
    found = state.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(scored, schema)
    return found.withColumn("train_tokens", F.lit(n).cast("long"))


def held_out(docs: DataFrame) -> DataFrame:
    """Scores by the documents whose crc32(doc_id) mod 5 is not 1."""
    return score(docs, F.coalesce(crc_mod("doc_id", 5) != 1, F.lit(True))).select(
        "doc_id", (~F.col("flag")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
