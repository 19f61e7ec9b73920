"""Language identification with interpolated Kneser-Ney character models, one per language.

A model sees words (runs of letters, lower-cased, with a boundary on both sides) and contexts that do not
leave the word, so a word's cost is computed once per batch of documents. The models are kept as
sorted arrays of n-gram hashes with one column of log probabilities per language. The language with the
lowest cost per character wins; the score is the share of its probability per character, and a document is
rejected when even the best model finds it more unlikely than nearly all training text.

Null texts and texts without letters are `und` with the score 0 and are rejected. Repeated rows get equal
predictions; ties go to the language that sorts first. Extra columns are ignored; an empty table gives no
rows; without a labelled row every document is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerlake.llm.common import codes_of, crc_mod, giving_back, grams_of

#: The models are fitted on at most this many labelled documents of each language, the first by a hash.
SAMPLE = 400
#: and on at most so many characters of each, in the same order.
SAMPLE_CHARACTERS = 8 << 20
#: Every so many-th of them is not fitted on: the limits of the rejection come from these.
HOLD = 5
ORDER = 4
DISCOUNT = 0.75
#: Rejected: cost per character above the mean of training documents by so many of their deviations, by
#: LEAST_GAP, and by SHORT over the root of the number of characters, as few characters vary more.
DEVIATIONS = 8.0
LEAST_GAP = 1.5
SHORT = 6.0
#: Words kept in a task's table of known costs.
REMEMBER = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters; numbers like \u00b2 or \u00bd are no letters, though a pattern's word class holds them."""
    found = _WORD.findall((text or "").lower())
    if all(w.isalpha() for w in found):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in w + " ").split()


class Models:
    """Fitted from (language, text) rows; holds sorted hash arrays per order."""

    def __init__(self, rows: list[tuple[str, str]], order: int = ORDER):
        self.order = order
        self.languages = sorted({lang for lang, _ in rows})
        counts = {lang: Counter() for lang in self.languages}
        for at, (lang, text) in enumerate(rows):
            if at % HOLD or len(rows) < 2 * HOLD:
                counts[lang].update(words(text))
        # every language spreads its rest over the same characters: those of all languages, and one for all others
        self.alphabet = {c for found in counts.values() for w in found for c in w} | {" "}
        tables = [self._fit(counts[lang]) for lang in self.languages]
        self.keys, self.logs, self.contexts, self.rests = [], [], [], []
        for n in range(order):
            keys = np.unique(np.concatenate([t[n][0] for t in tables])) if tables else np.empty(0, np.uint64)
            self.keys.append(keys)
        # a language's probability of an n-gram it has not seen is that of its back-off
        columns = [self._complete(t) for t in tables]
        for n in range(order):
            self.logs.append(np.stack([c[n] for c in columns], axis=1) if columns else np.empty((0, 0)))
            # the weight of the back-off of every context that any language has, 1 for a language without it
            contexts = np.unique(np.concatenate([t[n][2] for t in tables])) if tables else np.empty(0, np.uint64)
            rests = np.zeros((len(contexts), len(tables)))
            for at, t in enumerate(tables):
                rests[np.searchsorted(contexts, t[n][2]), at] = t[n][3]
            self.contexts.append(contexts)
            self.rests.append(rests)
        self._parents = None
        self.unseen = np.array([t[order] for t in tables])
        self.gap = self.mean = self.spread = None
        self._calibrate([r for at, r in enumerate(rows) if at % HOLD == 0 or len(rows) < 2 * HOLD])

    def _fit(self, counts: Counter) -> list:
        """Per order: n-gram hashes with (probability, back-off weight of the n-gram as a context)."""
        vocabulary = sorted(counts)
        kinds_of_all = len(self.alphabet) + 1
        if not vocabulary:
            none = np.empty(0, np.uint64), np.empty(0)
            self._parents = getattr(self, "_parents", [{} for _ in range(self.order)])
            return [*[(*none, *none)] * self.order, float(-np.log(kinds_of_all))]
        codes, lengths = codes_of(vocabulary)
        weight = np.repeat(np.array([counts[w] for w in vocabulary], float), lengths)
        first = np.zeros(len(codes), bool)
        first[np.cumsum(lengths) - lengths] = True
        grams = list(grams_of(codes, lengths, self.order))
        self._parents = getattr(self, "_parents", [{} for _ in range(self.order)])
        table, lower = [], None
        for n in range(1, self.order + 1):
            here = grams[n - 1]
            use = (here != 0) & ~first
            last = n == self.order
            # counts at the highest order and of n-grams that begin a word, else numbers of different left neighbours
            keys, at = np.unique(here[use], return_inverse=True)
            if last:
                c = np.bincount(at, weight[use])
            else:
                longer = grams[n]
                known = longer[use]
                starts = known == 0
                c = np.bincount(at, np.where(starts, weight[use], 0))
                pairs = np.unique(np.stack((at[~starts].astype(np.uint64), known[~starts])), axis=1)[0]
                c = c + np.bincount(pairs.astype(np.int64), minlength=len(keys))
            # the context is the n - 1 codes before, the shorter n-gram drops the oldest code
            context = np.zeros(len(keys), np.uint64)
            where = np.flatnonzero(use)
            first_at = np.full(len(keys), -1)
            first_at[at[::-1]] = where[::-1]
            if n > 1:
                context = grams[n - 2][first_at - 1]
            shorter = grams[n - 2][first_at] if n > 1 else None
            groups, of = np.unique(context, return_inverse=True)
            total = np.bincount(of, c)
            kinds = np.bincount(of)
            rest = DISCOUNT * kinds / total
            if n == 1:
                below = np.full(len(keys), 1.0 / kinds_of_all)
                self_unseen = float(np.log(rest[0] / kinds_of_all))
            else:
                below = np.exp(lower[1][np.searchsorted(lower[0], shorter)])
            p = np.maximum(c - DISCOUNT, 0) / total[of] + rest[of] * below
            table.append((keys, np.log(p), groups, np.log(rest)))
            lower = (keys, table[-1][1])
            order = np.argsort(keys)
            for k, s, x in zip(keys[order], (shorter if n > 1 else keys)[order], context[order]):
                self._parents[n - 1][int(k)] = (int(s), int(x))
        return [*table, self_unseen]

    def _complete(self, table: list) -> list[np.ndarray]:
        """A language's log probabilities of the n-grams that any language has."""
        out, below = [], None
        for n in range(self.order):
            keys, logs, groups, rest = table[n]
            all_keys = self.keys[n]
            full = np.full(len(all_keys), table[self.order])
            if n:
                links = [self._parents[n][int(k)] for k in all_keys]
                shorter = np.array([s for s, _ in links], np.uint64)
                context = np.array([x for _, x in links], np.uint64)
                full = below[np.searchsorted(self.keys[n - 1], shorter)]
                if len(groups):
                    at = np.minimum(np.searchsorted(groups, context), len(groups) - 1)
                    full = full + np.where(groups[at] == context, rest[at], 0.0)
            full[np.searchsorted(all_keys, keys)] = logs
            out.append(full)
            below = full
        return out

    def costs(self, group: list[str]) -> np.ndarray:
        """Negative log probability of each word (with its end) under each language."""
        lengths = np.array([len(w) + 2 for w in group])
        return -np.add.reduceat(self.logs_of(group), np.cumsum(lengths) - lengths, axis=0)

    def logs_of(self, group: list[str]) -> np.ndarray:
        """Log probabilities of every character of the words and of their ends (0 for the boundary before a word).

        Orders go down; where an n-gram is new to all languages, the back-off of its context is paid on the way.
        """
        codes, lengths = codes_of(group)
        todo = np.ones(len(codes), bool)
        todo[np.cumsum(lengths) - lengths] = False
        result = np.zeros((len(codes), len(self.languages)))
        grams = list(grams_of(codes, lengths, self.order))
        for n in range(self.order - 1, -1, -1):
            at = np.flatnonzero(todo & (grams[n] != 0))
            keys, contexts = self.keys[n], self.contexts[n]
            if not len(at) or not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, grams[n][at]), len(keys) - 1)
            hit = keys[place] == grams[n][at]
            result[at[hit]] += self.logs[n][place[hit]]
            todo[at[hit]] = False
            if n:
                at = at[~hit]
                before = grams[n - 1][at - 1]
                place = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
                known = contexts[place] == before
                result[at[known]] += self.rests[n][place[known]]
        result[todo] += self.unseen
        return result

    def _calibrate(self, rows: list[tuple[str, str]]) -> None:
        found = [(self.languages.index(lang), self.score(Counter(words(text)))) for lang, text in rows]
        self.mean, self.spread = np.zeros(len(self.languages)), np.ones(len(self.languages))
        for at in range(len(self.languages)):
            own = np.array([s[at] for lang, s in found if lang == at and s is not None])
            if len(own):
                self.mean[at], self.spread[at] = own.mean(), own.std()

    def score(self, counts: Counter) -> np.ndarray | None:
        """Cost per character of a document under each language."""
        if not counts:
            return None
        group = list(counts)
        n = np.array(list(counts.values()), float)
        return n @ self.costs(group) / (n @ np.array([len(w) + 1 for w in group]))

    def decide(self, cost: np.ndarray | None, characters: float) -> tuple[str, float, bool]:
        if cost is None or not self.languages:
            return "und", 0.0, True
        best = int(np.argmin(cost))
        share = float(1 / np.exp(cost[best] - cost).sum())
        limit = self.mean[best] + max(LEAST_GAP, DEVIATIONS * self.spread[best]) + SHORT / characters**0.5
        return self.languages[best], share, bool(cost[best] > limit)


def fit(docs: DataFrame, training, sample: int = SAMPLE) -> Models:
    """Models of the rows where `training` holds, from a bounded sample of each language."""
    labelled = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("at")
    )
    # keys first, so that a text counts once and no language's texts meet in one task
    first = Window.partitionBy("lang").orderBy("at")
    chosen = labelled.select("lang", "at").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)
    texts = labelled.join(F.broadcast(chosen.select("lang", "at")), ["lang", "at"]).select("lang", "at", "text").dropDuplicates(["lang", "at"])
    rows, size = [], Counter()
    for r in texts.orderBy("lang", "at").toLocalIterator():
        size[r["lang"]] += len(r["text"])
        if size[r["lang"]] <= SAMPLE_CHARACTERS:
            rows.append((r["lang"], r["text"]))
    return Models(rows)


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """docs with __lang, __score and __rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, known, costs = shared.value, {}, np.empty((0, len(shared.value.languages)))
        for batch in batches:
            found = []
            for text in batch.column(place):
                counts = Counter(words(text.as_py()))
                new = [w for w in counts if w not in known]
                if new:
                    if len(known) + len(new) > REMEMBER:
                        known, costs, new = {}, costs[:0], list(counts)
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    if len(known) > len(costs):  # the table grows by doubling
                        costs = np.concatenate((costs, np.empty((len(known), costs.shape[1]))))
                    costs[len(known) - len(new) : len(known)] = models.costs(new)
                cost, characters = None, 0.0
                if counts:
                    n = np.fromiter(counts.values(), float, len(counts))
                    at = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
                    size = np.fromiter(map(len, counts), float, len(counts)) + 1
                    characters = float(n @ size)
                    cost = n @ costs[at] / characters
                found.append(models.decide(cost, characters))
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*batch.schema.names, "__lang", "__score", "__rejected"],
            )

    schema = StructType(list(docs.schema.fields)).add("__lang", "string").add("__score", "double").add("__rejected", "boolean")
    return docs.mapInArrow(giving_back(run), schema)


def held_out(docs: DataFrame) -> DataFrame:
    """Predictions of every document by models of the documents whose crc32(doc_id) mod 4 is not 2."""
    models = fit(docs, crc_mod("doc_id", 4) != 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, models).select(
        "doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected")
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those the identifier rejects; the columns stay."""
    models = fit(docs, F.lit(True))
    return predict(docs, models).where(~F.col("__rejected")).select(*docs.columns)
