"""Toxicity scores by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings, so that inflected and unseen
forms share what is known of their stem. Filters of one, two and three words run over the whole text, each keeps
its largest response (max pooling), and a logistic layer turns these into a logit. Training starts the first
dimension from the smoothed log-odds of the training rows and then follows the gradient of the weighted
log-loss, which reaches only the windows that won the pooling. A second hashed table of log-frequencies guesses the
language of a text from its words; each language has its own threshold, taken on training rows the fit did not see,
and a score is the logistic of the distance to it, so that 0.5 is the threshold in every language.

The fit reads every labelled row that may be learnt; equal texts of a label are one row of their joint weight. Counts of
buckets are added up by Spark. An epoch runs over the rows where they are: each task follows the gradient on its own
share from the same parameters, and what the tasks changed is averaged, for a bucket over the tasks that met it. Every
fifth text is left out of the gradient and sets the thresholds (all do if fewer than `LEAST` of a label are left out).
Texts of more than `PIECE` characters are learnt from piece by piece. What passes the driver, a few megabytes of parameters and histograms, does not grow with the rows.

Handling: a null or empty text, or one without words, is scored from the biases. Texts of any length are pooled
piece by piece (a word of more than `PIECE` characters is cut). Repeated rows are scored like any others; of several
labels of a document the highest counts, and null labels are left out. Without rows of both labels every score is the
smoothed share of toxic rows, below one half unless there are any. Other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.llm.common import crc_mod, give_back, in_slices
from answerlake.session import hand_over, tidied

BITS, WIDTH, FILTERS = 16, 16, 8
SPANS = (1, 2, 3)
STARTS = (3, 4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.05, 1e-4
#: Rows of either label a language needs for a threshold of its own.
LEAST = 15
PIECE, SLICE = 1 << 19, 1 << 20
#: Labelled rows of a written part of the table that is learnt from; a task reads one or more.
SHARE = 8000
#: Buckets whose parameters are averaged together, and steps of a logit in the histograms of the thresholds.
BLOCK, STEPS = 1 << 11, 1024
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’…¿¡"
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def buckets(words: pa.Array) -> np.ndarray:
    """Hash buckets of each word: the word and its beginnings of 3 to 6 characters; 0 where there is none."""
    words = pc.utf8_trim(words, _TRIM)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _powers(_BASE, len(codes)))))
        back = _powers(_BACK, len(codes) + 1)
        start = np.cumsum(lengths) - lengths
        out = np.zeros((len(words), 1 + len(STARTS)), np.int64)
        for k, size in enumerate((None, *STARTS)):
            some = np.flatnonzero(lengths >= (size or 1))
            s = start[some]
            e = s + (lengths[some] if size is None else size)
            h = (upto[e] - upto[s]) * back[s] + np.uint64(k * 0x51ED27)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out[some, k] = np.maximum((h >> np.uint64(64 - BITS)).astype(np.int64), 1)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words, the words of all texts one after another, and how many each text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.not_equal(words, "")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = real.to_numpy(zero_copy_only=False)
    coded = words.filter(real).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return buckets(coded.dictionary), ids, np.bincount(owner[keep], minlength=len(sizes))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut after white space where there is some."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            gap = max(text.rfind(c, at, end) for c in " \n\t")
            end = gap + 1 if gap >= at else end
        yield text[at:end]
        at = end


class Net:
    """Embedding table, filters of each span, output layer, language table and thresholds."""

    def __init__(self, languages: Sequence[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (1 << BITS, WIDTH)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.3 / span, (span, WIDTH, FILTERS)).astype(np.float32) for span in SPANS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in SPANS]
        self.out = np.full(len(SPANS) * FILTERS, 0.1, np.float32)
        self.offset = np.zeros(1, np.float32)
        self.languages = list(languages)
        self.speech = np.zeros((1 << BITS, len(self.languages)), np.float32)
        self.limits = np.zeros(len(self.languages) + 1)
        self.squares: list[np.ndarray] | None = None

    def embed(self, hashed: np.ndarray) -> np.ndarray:
        return self.table[hashed].sum(1)

    def respond(self, x: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Responses of every window, span by span, and the rows of each text (its words and three blanks)."""
        starts = np.cumsum(sizes + 3) - (sizes + 3)
        rows = np.full(int((sizes + 3).sum()), len(x), np.int64)
        rows[np.arange(len(ids)) + np.repeat(3 * np.arange(len(sizes)), sizes)] = ids
        ends = starts + sizes + 3
        x = np.concatenate((x, np.zeros((1, WIDTH), np.float32)))
        out = []
        for filters, bias in zip(self.filters, self.bias):
            total = (x @ filters[0])[rows]
            for step in range(1, len(filters)):
                total[:-step] += (x @ filters[step])[rows[step:]]
            total += bias
            # windows that reach into the next text
            total[ends - 1] = total[ends - 2] = -np.inf
            out.append(total)
        return out, starts, rows

    def pooled(self, hashed: np.ndarray, ids: np.ndarray, sizes: np.ndarray, goes_on: bool = False) -> np.ndarray:
        """Largest response of each filter; where the (first) text goes on, windows beyond its words do not count."""
        found, starts, _ = self.respond(self.embed(hashed), ids, sizes)
        if goes_on:
            for span, f in zip(SPANS, found):
                f[max(0, sizes[0] - span + 1) : sizes[0] + 3] = -np.inf
        return np.concatenate([np.maximum.reduceat(f, starts) for f in found], axis=1) if len(sizes) else np.zeros((0, len(self.out)))

    def spoken(self, hashed: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Summed log-frequencies of each text under each language."""
        x = self.speech[hashed].sum(1)[ids]
        upto = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=float)))
        end = np.cumsum(sizes)
        return upto[end] - upto[end - sizes]

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.offset[0]

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pooled responses and language sums of whole texts."""
        texts = pc.fill_null(texts, "")
        lengths = pc.utf8_length(texts).to_pylist()
        pooled, spoken = np.full((len(texts), len(self.out)), -np.inf), np.zeros((len(texts), len(self.languages)))
        short = [k for k, n in enumerate(lengths) if n <= PIECE]
        for part in in_slices(short, [lengths[k] + 1 for k in short], SLICE):
            hashed, ids, sizes = sequences(texts.take(pa.array(part, pa.int64())))
            pooled[part], spoken[part] = self.pooled(hashed, ids, sizes), self.spoken(hashed, ids, sizes)
        for k in (k for k, n in enumerate(lengths) if n > PIECE):
            tail: list[str] = []
            left = lengths[k]
            for piece in pieces(texts[k].as_py()):
                words, left = piece.split(), left - len(piece)
                hashed, ids, sizes = sequences(pa.array([" ".join([*tail, *words]), " ".join(tail)]))
                found, said = self.pooled(hashed, ids, sizes, left > 0), self.spoken(hashed, ids, sizes)
                pooled[k] = np.maximum(pooled[k], found[0])
                spoken[k] += said[0] - said[1]
                tail = [*tail, *words][-(max(SPANS) - 1) :]
        return pooled, spoken

    def language(self, spoken: np.ndarray) -> np.ndarray:
        """Which language each text looks like; the place after the last if none stands out."""
        if not self.languages:
            return np.zeros(len(spoken), np.int64)
        return np.where(np.ptp(spoken, axis=1) > 0, spoken.argmax(1), len(self.languages))

    def score(self, texts: pa.Array) -> np.ndarray:
        pooled, spoken = self.features(texts)
        return _logistic(self.logit(pooled) - self.limits[self.language(spoken)])

    # fitting

    def learn_speech(self, counts: np.ndarray) -> None:
        counts = counts + 0.1
        logs = np.log(counts / counts.sum(0))
        self.speech[:] = logs - logs.mean(1, keepdims=True)
        self.speech[0] = 0

    def start(self, hashed, ids, sizes, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Log-odds of every bucket over the texts that hold it, as first dimension and first filter."""
        self.begin(*held(hashed, ids, sizes, toxic, weight), (weight * toxic).sum() / weight.sum(), hashed.shape[1])

    def begin(self, yes: np.ndarray, no: np.ndarray, base: float, columns: int = 1 + len(STARTS)) -> None:
        rate = (yes + 5 * base) / (yes + no + 5)
        self.table[:, 0] = (np.log(rate / (1 - rate)) - np.log(base / (1 - base))) / columns
        self.table[0] = 0
        self.filters[0][:, :, 0] = 0
        self.filters[0][0, 0, 0] = 1
        self.out[0] = 1
        self.offset[0] = np.log(base / (1 - base)) - 1

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.table, *self.filters, *self.bias, self.out, self.offset

    def fit(self, hashed, ids, sizes, toxic: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adagrad over shuffled batches; only windows that won the pooling have a gradient."""
        rng = np.random.default_rng(seed)
        begin = np.cumsum(sizes) - sizes
        if self.squares is None:
            self.squares = [np.full_like(p, 0.1) for p in self.parts()]
        seen = {id(p): squares for p, squares in zip(self.parts(), self.squares)}

        def step(p: np.ndarray, gradient: np.ndarray, at=...) -> None:
            seen[id(p)][at] += gradient**2
            p[at] -= RATE * gradient / np.sqrt(seen[id(p)][at])

        for _ in range(epochs):
            order = rng.permutation(len(sizes))
            for part in np.array_split(order, max(1, len(order) // BATCH)):
                n = sizes[part]
                words = ids[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                distinct, words = np.unique(words, return_inverse=True)
                x = self.embed(hashed[distinct])
                found, starts, rows = self.respond(x, words, n)
                won = [np.stack([f[a : a + m + 3].argmax(0) + a for a, m in zip(starts, n)]) for f in found]
                pooled = np.concatenate([np.take_along_axis(f, w, 0) for f, w in zip(found, won)], axis=1)
                error = (_logistic(self.logit(pooled)) - toxic[part]) * weight[part] / len(part)
                back = error[:, None] * self.out * (pooled > 0)
                step(self.out, np.maximum(pooled, 0).T @ error + DECAY * self.out)
                step(self.offset, error.sum(keepdims=True))
                x = np.concatenate((x, np.zeros((1, WIDTH), np.float32)))
                change = np.zeros_like(x)
                for k, (filters, bias) in enumerate(zip(self.filters, self.bias)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                    gradient = np.empty_like(filters)
                    for j in range(len(filters)):
                        at = rows[won[k] + j]
                        gradient[j] = np.einsum("df,dfw->wf", g, x[at])
                        np.add.at(change, at.reshape(-1), (g[:, :, None] * filters[j].T[None]).reshape(-1, WIDTH))
                    step(filters, gradient)
                    step(bias, g.sum(0))
                moved = np.flatnonzero(np.abs(change[:-1]).sum(1))
                at, place = np.unique(hashed[distinct[moved]], return_inverse=True)
                total = np.zeros((len(at), WIDTH), np.float32)
                np.add.at(total, place.reshape(len(moved), -1), change[moved][:, None, :])
                step(self.table, total[at > 0], at[at > 0])

    def calibrate(self, rows: list[tuple]) -> None:
        """Thresholds of the best weighted F1 of rows (language, toxic, logit, weight, how many), of each guessed
        language with enough rows of either label."""
        of, toxic, logit, weight, many = (np.array(c) for c in zip(*rows)) if rows else (np.empty(0),) * 5
        toxic = toxic.astype(bool)
        self.limits[:] = threshold(logit, toxic, weight) if len(logit) else 0
        for k in range(len(self.languages) + 1):
            mine = of == k
            if min(many[toxic & mine].sum(), many[~toxic & mine].sum()) >= LEAST:
                self.limits[k] = threshold(logit[mine], toxic[mine], weight[mine])


def held(hashed, ids, sizes, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the toxic and of the other texts that hold each bucket."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pairs = np.unique(np.concatenate([np.unique(owner * (1 << BITS) + hashed[ids, c]) for c in range(hashed.shape[1])]))
    text, at = pairs >> BITS, pairs & ((1 << BITS) - 1)
    return np.bincount(at, (weight * toxic)[text], 1 << BITS), np.bincount(at, (weight * ~toxic)[text], 1 << BITS)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def threshold(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between two logits that gives the best weighted F1; the widest of equal ones."""
    order = np.argsort(-logit, kind="stable")
    z, w, t = logit[order], weight[order], toxic[order]
    if not t.any() or t.all():
        return 0.0
    hit = np.cumsum(w * t)
    f1 = 2 * hit / (np.cumsum(w) + hit[-1])
    gap = z[:-1] - z[1:]
    f1, middle = f1[:-1][gap > 0], ((z[:-1] + z[1:]) / 2)[gap > 0]
    gap = gap[gap > 0]
    if not len(f1):
        return 0.0
    best = f1 >= f1.max() - 1e-9
    return float(middle[best][gap[best].argmax()])


def learnt(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """Rows (text, toxic, lang, weight, seen) of all documents whose label may be learnt, each text of a label once.

    Texts that are not `seen` set the thresholds.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") >= 1).alias("toxic")).where(training)
    # written, so that Spark knows their size and need not shuffle the texts to meet a few of them
    marks = hand_over(marks, "marks", tidy=True)
    own = docs.where(training & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    shares = 1 + marks.count() // SHARE
    rows = own.join(marks, "doc_id").repartition(shares, "text").groupBy("text", "toxic")
    rows = rows.agg(F.min("lang").alias("lang"), F.count("*").cast("double").alias("weight"))
    return rows.withColumn("seen", F.pmod(F.xxhash64("text"), F.lit(5)) != 0).sortWithinPartitions(F.xxhash64("text"), "toxic")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Texts of some megabytes with label, language and weight; longer ones as pieces that share their weight."""
    for batch in batches:
        rows = []
        for text, *rest, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "lang", "weight"))):
            parts = list(pieces(text)) or [""]
            rows += [(part, *rest, weight / len(parts)) for part in parts]
        for some in in_slices(rows, [len(r[0]) + 1 for r in rows], 4 * SLICE):
            texts, toxic, langs, weight = zip(*some)
            yield sequences(pa.array(texts, pa.string())), np.array(toxic, bool), langs, np.array(weight)


def _added(rows: DataFrame, run: Callable, width: int) -> np.ndarray:
    """The sum over all tasks of the array (buckets, width) that each makes of its batches, block by block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        at = range(0, len(total), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([total[k : k + BLOCK].tobytes() for k in at], pa.binary())], ["block", "sums"])
        give_back()

    def added(table):
        sums = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "block int, sums binary"
    with tidied(rows.sparkSession):
        found = rows.mapInArrow(blocks, schema).groupBy("block").applyInArrow(added, schema).collect()
    if not found:
        return np.zeros((1 << BITS, width))
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(found)]).reshape(-1, width)


def _counted(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """By bucket: weights of seen toxic and other texts that hold it, then its words in each language, of all texts."""
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((1 << BITS, 2 + len(languages)))
        for batch in batches:
            for seen in (True, False):
                for (hashed, ids, sizes), toxic, langs, weight in _slices([batch.filter(pc.equal(batch.column(4), seen))]):
                    if seen:
                        yes, no = held(hashed, ids, sizes, toxic, weight)
                        total[:, 0] += yes
                        total[:, 1] += no
                    owner = np.repeat(np.array([number.get(x, -1) for x in langs], np.int64), sizes)
                    for column in range(hashed.shape[1]):
                        at = hashed[ids, column]
                        known = (owner >= 0) & (at > 0)
                        np.add.at(total, (at[known], 2 + owner[known]), 1)
        return total

    return _added(rows, run, 2 + len(languages))


def _epoch(net: Net, rows: DataFrame, scale: float, epoch: int) -> None:
    """One run over the seen rows in every task, and the average of what the tasks changed."""
    sizes = [p.size for p in net.parts()[1:]]
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        net, count = copy.deepcopy(shared.value), 0
        net.squares = net.squares or [np.full_like(p, 0.1) for p in net.parts()]
        before = copy.deepcopy((net.parts(), net.squares))
        for (hashed, ids, n), toxic, _, weight in _slices(batches):
            net.fit(hashed, ids, n, toxic, weight * scale, epochs=1, seed=11 + epoch)
            count += len(n)
        changed = [[a.astype(float) - b for a, b in zip(x, y)] for x, y in zip((net.parts(), net.squares), before)]
        # a task without rows has no say
        met = (changed[1][0] != 0).any(1)
        out = np.zeros((len(met) + -(-sum(sizes) // WIDTH), 2 * WIDTH + 1))
        out[: len(met)] = np.column_stack((changed[0][0], changed[1][0], met))
        for k in (0, 1):
            rest = np.concatenate([c.reshape(-1) for c in changed[k][1:]])
            out[len(met) :, k * WIDTH : (k + 1) * WIDTH] = np.resize(np.append(rest, np.zeros(-len(rest) % WIDTH)), (len(out) - len(met), WIDTH))
        out[len(met) :, -1] = count > 0
        return out

    total = _added(rows, run, 2 * WIDTH + 1)
    mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
    net.squares = net.squares or [np.full_like(p, 0.1) for p in net.parts()]
    for k, parts in enumerate((net.parts(), net.squares)):
        own = mean[:, k * WIDTH : (k + 1) * WIDTH]
        parts[0][:] += own[: 1 << BITS]
        rest = own[1 << BITS :].reshape(-1)
        for part, end in zip(parts[1:], np.cumsum(sizes)):
            part += rest[end - part.size : end].reshape(part.shape)


def learn(rows: DataFrame) -> Net | float:
    """A network of rows (text, toxic, lang, weight, seen), or the smoothed share of toxic rows if a label is missing."""
    rows = hand_over(rows, "toxic", tidy=True)
    found = rows.groupBy("toxic", "seen").agg(F.count("*"), F.sum("weight")).collect()
    toxic, clean = (sum(r[2] for r in found if r["toxic"] is t) for t in (True, False))
    if not toxic or not clean:
        return (float(toxic) + 0.5) / (toxic + clean + 2.0) if found else 0.25
    # texts of a rare label are learnt from even if all would be left out
    if {r["toxic"] for r in found if r["seen"]} != {True, False}:
        rows = rows.withColumn("seen", F.lit(True))
    net = Net([r[0] for r in rows.where("lang <> ''").select("lang").distinct().sort("lang").collect()])
    counts = _counted(rows, net.languages)
    net.learn_speech(counts[:, 2:])
    seen = rows.where("seen")
    sums = {r["toxic"]: (r[1], r[2]) for r in seen.groupBy("toxic").agg(F.sum("weight"), F.count("*")).collect()}
    whole = sums[True][0] + sums[False][0]
    net.begin(counts[:, 0], counts[:, 1], sums[True][0] / whole)
    for epoch in range(EPOCHS):
        _epoch(net, seen, (sums[True][1] + sums[False][1]) / whole, epoch)
    net.squares = None
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled, spoken = shared.value.features(batch.column(0))
            steps = np.round(np.clip(shared.value.logit(pooled), -60, 60) * STEPS).astype(np.int32)
            columns = [pa.array(shared.value.language(spoken)), batch.column(1), pa.array(steps), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["language", "toxic", "step", "weight"])

    # with too few left out, all rows set the thresholds
    few = min((r[2] for r in found if not r["seen"]), default=0) < LEAST or len(found) < 4
    aside = (rows if few else rows.where("NOT seen")).mapInArrow(judged, "language long, toxic boolean, step int, weight double")
    steps = aside.groupBy("language", "toxic", "step").agg(F.sum("weight"), F.count("*")).collect()
    net.calibrate(sorted((r[0], r[1], r[2] / STEPS, r[3], r[4]) for r in steps))
    return net


def predict(docs: DataFrame, model: Net | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            score = net.score(batch.column(2)) if isinstance(net, Net) else np.full(batch.num_rows, net)
            columns = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document by a model of the labels of documents whose crc32(doc_id) mod 5 is not 0."""
    out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = learn(learnt(docs, labels, crc_mod("doc_id", 5) != 0))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text")), model)
