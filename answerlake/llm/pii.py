"""Personal data: exact patterns, and spans added by a character BiLSTM with CRF transitions.

The patterns (email, ip, card, phone) are matched in the whole text. The network is trained in numpy on
texts with labelled spans made here. It reads overlapping windows; where windows overlap, a character's scores are
averaged with weights that favour the middle of a window, and one Viterbi pass decodes each stretch of
windows as a whole. Every labelled span holds a digit or an @, and the decoder allows no span without one,
so windows without such a character are all outside and need no network.

Null and empty texts have no spans. Very long texts are read window by window. Repeated rows give equal
rows; extra columns are ignored by the report and kept by `mask`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.common import giving_back, in_slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a start within a run of digits fails or matches as the start of the run does
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


# ---- the network ----

WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 16, 10
_OWN = "@.+-()_% :=\"/,#\n\t"
_CLASSES = len(_OWN) + 6
#: label 0 is outside; of kind k, 1 + 2k begins a span and 2 + 2k goes on
LABELS = 1 + 2 * len(KINDS)


def _class_of(c: int) -> int:
    ch = chr(c)
    if ch in _OWN:
        return 6 + _OWN.index(ch)
    if ch.isdigit():
        return 1
    if ch.islower():
        return 2 if ch in "abcdef" else 3
    return 4 if ch.isupper() else 5


_TABLE = np.array([_class_of(c) for c in range(128)] + [0], np.int8)


def _encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.minimum(codes, 128)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _allowed() -> np.ndarray:
    """0 where a label may follow another, very low where a span would go on without its beginning."""
    step = np.zeros((LABELS, LABELS))
    for b in range(2, LABELS, 2):
        step[:, b] = -1e4
        step[b - 1, b] = step[b, b] = 0
    return step


class Network:
    """Embedding, one LSTM in each direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"embed": draw(_CLASSES, EMBED) * 2, "out": draw(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS), "step": np.zeros((LABELS, LABELS))}
        for d in "fb":
            self.p |= {f"x{d}": draw(EMBED, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.allowed = _allowed()

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x (T, N, EMBED) in reading order; hidden states (T, N, HIDDEN)."""
        wx, wh, bias = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"]
        pre = x @ wx + bias
        h = c = np.zeros((x.shape[1], HIDDEN))
        out = np.empty((*x.shape[:2], HIDDEN))
        for t in range(len(x)):
            g = pre[t] + h @ wh
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            u = np.tanh(g[:, 3 * HIDDEN :])
            before, c = c, f * c + i * u
            tc = np.tanh(c)
            if keep is not None:
                keep.append((i, f, o, u, before, tc, h))
            h = o * tc
            out[t] = h
        return out

    def scores(self, codes: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Label scores (N, T, LABELS) of windows (N, T) of character classes."""
        x = self.p["embed"][codes.T]
        keep = {d: [] if kept is not None else None for d in "fb"}
        both = np.concatenate((self._lstm(x, "f", keep["f"]), self._lstm(x[::-1], "b", keep["b"])[::-1]), axis=2)
        if kept is not None:
            kept |= {"x": x, "both": both, **keep}
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def _crf(self, scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the likelihood: of the scores and of the transitions."""
        n, length, _ = scores.shape
        step = self.p["step"] + self.allowed
        total = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, length):
            forward[:, t] = scores[:, t] + total(forward[:, t - 1, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            backward[:, t] = total(step + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        z = total(forward[:, -1], 1)
        up = -np.exp(forward + backward - z[:, None, None])
        np.put_along_axis(up, labels[:, :, None], np.take_along_axis(up, labels[:, :, None], 2) + 1, 2)
        step_up = np.zeros_like(step)
        for t in range(length - 1):
            after = (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
            step_up -= np.exp(forward[:, t, :, None] + step + after - z[:, None, None]).sum(axis=0)
            np.add.at(step_up, (labels[:, t], labels[:, t + 1]), 1)
        return up / n, step_up / n

    def _back(self, d: str, x: np.ndarray, up: np.ndarray, keep: list, grad: dict) -> np.ndarray:
        wh, wx = self.p[f"h{d}"], self.p[f"x{d}"]
        dx = np.empty_like(x)
        dh = dc = np.zeros((x.shape[1], HIDDEN))
        for t in range(len(x) - 1, -1, -1):
            i, f, o, u, before, tc, h = keep[t]
            dh = dh + up[t]
            dc = dc + dh * o * (1 - tc**2)
            g = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)), axis=1)
            grad[f"x{d}"] += x[t].T @ g
            grad[f"h{d}"] += h.T @ g
            grad[f"c{d}"] += g.sum(axis=0)
            dx[t], dh, dc = g @ wx.T, g @ wh.T, dc * f
        return dx

    def train(self, codes: np.ndarray, labels: np.ndarray, rounds: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for turn in range(1, rounds + 1):
            at = rng.choice(len(codes), batch, replace=False)
            kept: dict = {}
            scores = self.scores(codes[at], kept)
            grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            up, grad["step"] = self._crf(scores, labels[at])
            up = up.transpose(1, 0, 2)
            both = kept["both"]
            grad["out"] = both.reshape(-1, 2 * HIDDEN).T @ up.reshape(-1, LABELS)
            grad["bias"] = up.sum(axis=(0, 1))
            down = up @ self.p["out"].T
            dx = self._back("f", kept["x"], down[:, :, :HIDDEN], kept["f"], grad)
            dx = dx + self._back("b", kept["x"][::-1], down[::-1, :, HIDDEN:], kept["b"], grad)[::-1]
            np.add.at(grad["embed"], codes[at].T, dx)
            # ascent with momentum and a scale per weight
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                scale = rate * (1 - turn / (rounds + 1)) * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn)
                self.p[k] = self.p[k] + scale * first[k] / (np.sqrt(second[k]) + 1e-8)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best labels (N, T) of chains of equal length, scores (N, T, LABELS)."""
        step = self.p["step"] + self.allowed
        n, length, _ = scores.shape
        best, back = scores[:, 0] + self.allowed[0], np.empty((length, n, LABELS), np.int8)
        for t in range(1, length):
            through = best[:, :, None] + step
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[:, t]
        labels = np.empty((n, length), np.int8)
        labels[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            labels[:, t - 1] = back[t, np.arange(n), labels[:, t]]
        return labels


def labelled_texts(count: int = 1600, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made texts with spans: personal data as the patterns know it and in other spellings, and look-alikes."""
    rng = random.Random(seed)
    sounds = "the on er ing ch ou è ver ci ó und ge la men ä st".split()

    def word() -> str:
        w = "".join(rng.choices(sounds, k=rng.randint(1, 4)))
        return (w.capitalize() if rng.random() < 0.15 else w) + rng.choice(["", "", "", "", ",", ".", "!!", "###"])

    def digits(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        gap = rng.choice(["", "", " ", "-", "."])
        return gap.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1.{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}"])

    def email() -> str:
        name = "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) + rng.choice(["", f".{digits(2)}", f"_{digits(1)}"])
        host = f"{rng.choice(['mail', 'post', 'x'])}{digits(1)}"
        return rng.choice([f"{name}@{host}.example.com", f"{name}@{host}.org", f"{name} @ {host}.com", f"{name}@{host}. org"])

    def ip() -> str:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".", ".", ".", " . "]).join(parts)

    def other() -> str:
        hexes = "".join(rng.choices("0123456789abcdef", k=40))
        return rng.choice([f'token = "{hexes}"', f"password={hexes[:18]}", "AKIA" + "".join(rng.choices("ABCDEFGHIJ234567", k=16)), f"{rng.randint(1, 9)}.0",
                           f"Version {rng.randint(1, 3)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}", digits(rng.randint(1, 6)), f"20{digits(2)}-{digits(2)}-{digits(2)}",
                           f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"@{word()}", hexes])

    made = (email, ip, card, phone)
    texts = []
    for _ in range(count):
        text, spans = "", []
        while len(text) < 2 * WINDOW:
            draw = rng.random()
            if draw < 0.22:
                kind = rng.randrange(4)
                piece = made[kind]()
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = other() if draw < 0.36 else word()
            text += piece + rng.choice([" ", " ", " ", "\n", " | ", "### ", ". "])
        texts.append((text, spans))
    return texts


@lru_cache(1)
def trained(rounds: int = 260) -> Network:
    codes, labels = [], []
    rng = random.Random(1)
    for text, spans in labelled_texts():
        row, own = _encode(text), np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            own[start], own[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
        # windows begin outside of spans, as a span is read whole by some window
        starts = [s for s in range(len(text) - WINDOW) if own[s] % 2 or not own[s]]
        at = rng.choice(starts)
        codes.append(row[at : at + WINDOW])
        labels.append(own[at : at + WINDOW])
    network = Network()
    network.train(np.stack(codes), np.stack(labels), rounds)
    return network


#: Windows in one pass of the network.
BATCH = 256
_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)
_HINT = re.compile(r"[0-9@]")
#: What an added span has to hold besides its label: digits at least and at most, and a part of its text.
_NEEDS = {0: (0, 40, re.compile(r"[^\s@]\s?@\s?[^\s@]+\.")), 1: (4, 12, re.compile(r"\d\s?\.\s?\d+\s?\.\s?\d+\s?\.\s?\d")),
          2: (13, 19, re.compile(r"\A\d.*\d\Z", re.S)), 3: (7, 15, re.compile(r"[\s().-]"))}


def stretches(text: str) -> list[tuple[int, int]]:
    """Unions of the overlapping windows that hold a digit or an @: start and number of windows."""
    found: list[list[int]] = []
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    for m in _HINT.finditer(text):
        low = max(0, -(-(m.start() - WINDOW + 1) // STRIDE))
        high = min(last, m.start() // STRIDE)
        low = min(low, high)
        if found and low <= found[-1][1] + 1:
            found[-1][1] = max(found[-1][1], high)
        else:
            found.append([low, high])
    return [(low * STRIDE, high - low + 1) for low, high in found]


def _labels(pieces: list[str], network: Network) -> Iterator[tuple[int, np.ndarray]]:
    """(place, labels) of every piece of text; scores of overlapping windows are merged before the decoding."""
    ready: dict[int, list[tuple[int, np.ndarray]]] = {}
    # pieces with few windows share the network's batches; a longer one has its own
    for group in in_slices(list(enumerate(pieces)), [_count(p) for p in pieces], BATCH):
        codes = [np.concatenate((_encode(p), np.zeros(STRIDE * (_count(p) - 1) + WINDOW - len(p), np.int8))) for _, p in group]
        windows = [np.lib.stride_tricks.sliding_window_view(c, WINDOW)[::STRIDE] for c in codes]
        several = np.concatenate(windows)
        scored = np.concatenate([network.scores(several[at : at + BATCH]).astype(np.float32) for at in range(0, len(several), BATCH)])
        at = 0
        for (place, piece), code in zip(group, codes):
            scores, weight = np.zeros((len(code), LABELS)), np.zeros((len(code), 1))
            for k in range(_count(piece)):
                scores[k * STRIDE : k * STRIDE + WINDOW] += scored[at + k] * _WEIGHT[:, None]
                weight[k * STRIDE : k * STRIDE + WINDOW] += _WEIGHT[:, None]
            at += _count(piece)
            ready.setdefault(len(piece), []).append((place, (scores / weight)[: len(piece)]))
    for same in ready.values():
        for start in range(0, len(same), BATCH):
            some = same[start : start + BATCH]
            yield from zip((place for place, _ in some), network.decode(np.stack([x for _, x in some])))


def _count(piece: str) -> int:
    return 1 + max(0, -(-(len(piece) - WINDOW) // STRIDE))


def find(texts: list[str | None], network: Network) -> Iterator[tuple[list, list]]:
    """(pattern spans, all spans) of every text; added spans touch no pattern's span."""
    texts = [t or "" for t in texts]
    bases = [base_spans(t) for t in texts]
    places = [(i, s, s + STRIDE * (n - 1) + WINDOW) for i, t in enumerate(texts) for s, n in stretches(t)]
    added: list[list] = [[] for _ in texts]
    for at, labels in _labels([texts[i][s:e] for i, s, e in places], network):
        i, begin, _ = places[at]
        for start in np.flatnonzero(labels % 2 == 1).tolist():
            end, kind = start + 1, (int(labels[start]) - 1) // 2
            while end < len(labels) and labels[end] == 2 + 2 * kind:
                end += 1
            span = (kind, begin + start, begin + end)
            if _plausible(texts[i], *span) and not any(s < span[2] and span[1] < e for _, s, e in bases[i]):
                added[i].append(span)
    for base, more in zip(bases, added):
        yield base, sorted([*base, *more])


def _plausible(text: str, kind: int, start: int, end: int) -> bool:
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    least, most, part = _NEEDS[kind]
    if kind == 2 and not luhn("".join(_DIGITS.findall(text[start:end]))):
        return False
    return least <= len(_DIGITS.findall(text[start:end])) <= most and bool(part.search(text, start, end))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame) -> DataFrame:
    """Per document: numbers of pattern spans by kind, their digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, more = [[] for _ in KINDS], [], [], []
            for base, every in find(batch.column(1).to_pylist(), shared.value):
                for k, column in enumerate(counts):
                    column.append(sum(1 for x in base if x[0] == k))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                more.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    longs = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        giving_back(run), f"doc_id long, {longs}, base_sha256 string, spans string, n_added long"
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of spans replaced by the name of its first kind."""
    parts, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with all spans masked; n_chars follows the text if there is such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            texts = [t and masked(t, every) for t, (_, every) in zip(texts, find(texts, shared.value))]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(giving_back(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out
