"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text not broken by a block element) with the tags, classes and ids of
their ancestors. Each block gets features of its ancestors and its text; weights of features and label
transitions are trained by gradient ascent on the likelihood of labelled pages, and Viterbi picks the
best labels. The labelled pages are made from templates here, as the tables hold no labels.

Null and empty pages have an empty text. Unclosed and truncated markup is read as far as it goes. Repeated
rows give equal texts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML
BLOCKS = frozenset(
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; it ends only at their own end tag.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object".split())
#: Elements that an opening tag of the same group closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "title", "option", "button", "td", "tr", "th", "tbody", "thead", "tfoot"}
_TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>|[a-zA-Z!?/][^>]*\Z)", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, marks of the ancestors, characters inside links) of every leaf block, in page order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    found, parts, linked, at = [], [], 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append((text, tuple(m for _, marks in stack for m in marks), min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if any(name == "a" for name, _ in stack):
            linked += len(text.strip())

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    while True:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name, attributes, end = m[1], m[2], m[3]
        if name:
            name = name.lower()
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = len(page) if not stop else page.find(">", stop.start()) + 1 or len(page)
                if name in BLOCKS:
                    flush()
                continue
            if name in BLOCKS:
                flush()
                shut = {"p"} if name in CLOSES_P else set()
                shut = shut | SELF_CLOSING.get(name, set())
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in shut:
                        close(depth)
                        break
                    if stack[depth][0] in BLOCKS and stack[depth][0] not in ("p",):
                        break
            if name not in VOID and not attributes.rstrip().endswith("/"):
                stack.append((name, _marks(name, attributes)))
        elif end:
            end = end.lower()
            if end == "br":
                flush()
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == end:
                    if end in BLOCKS:
                        close(depth)
                    else:
                        del stack[depth]
                    break
    flush()
    return found


@lru_cache(4096)
def _marks(name: str, attributes: str) -> tuple[str, ...]:
    marks = [f"tag={name}"]
    for groups in _NAME.findall(attributes):
        marks += [f"name={w}" for w in _SPLIT.split("".join(groups).lower()) if w]
    if _HIDDEN.search(attributes):
        marks.append("hidden")
    return tuple(marks)


@lru_cache(65536)
def _size_marks(words: int, links: int, end: str, start: str) -> tuple[str, ...]:
    return (f"words={min(6, words.bit_length())}", f"links={links}", f"end={end}", f"start={start}")


def features(block: tuple[str, tuple[str, ...], int]) -> list[str]:
    text, marks, linked = block
    last = text[-1]
    kind = "stop" if last in ".!?…\"”»" else "letter" if last.isalpha() else "other"
    start = "copy" if text[0] == "©" else "letter" if text[0].isalpha() else "other"
    return ["bias", *dict.fromkeys(marks), *_size_marks(text.count(" ") + 1, round(2 * linked / len(text)), kind, start)]


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """The best labels of a chain for scores (n, 2) and transitions (2, 2)."""
    (a, b), (c, d) = step.tolist()
    back, (u, v) = [], scores[0].tolist()
    for x, y in scores[1:].tolist():
        back.append((u + a < v + c, u + b < v + d))
        u, v = x + max(u + a, v + c), y + max(u + b, v + d)
    label, labels = int(v > u), []
    for choice in reversed(back):
        labels.append(label)
        label = int(choice[label])
    return [label, *reversed(labels)]


class Field:
    """Weights of features and transitions for the labels 0 (other) and 1 (main text)."""

    def __init__(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4):
        names = sorted({f for page, _ in pages for block in page for f in block})
        self.index = {f: i for i, f in enumerate(names)}
        weights, step = np.zeros((len(names), 2)), np.zeros((2, 2))
        coded = [([np.array([self.index[f] for f in b]) for b in page], labels) for page, labels in pages]
        sums, step_sums = np.full_like(weights, 1e-6), np.full_like(step, 1e-6)
        for _ in range(rounds):
            up, step_up = -decay * weights * len(coded), -decay * step * len(coded)
            for page, labels in coded:
                scores = np.stack([weights[b].sum(axis=0) for b in page])
                marginal, pairs = self._expect(scores, step)
                for b, p, label in zip(page, marginal, labels):
                    gap = -p
                    gap[label] += 1
                    np.add.at(up, b, gap)
                step_up -= pairs
                np.add.at(step_up, (labels[:-1], labels[1:]), 1)
            # steps shrink with the squares of earlier gradients
            sums, step_sums = sums + up**2, step_sums + step_up**2
            weights = weights + rate * up / np.sqrt(sums)
            step = step + rate * step_up / np.sqrt(step_sums)
        self.weights, self.step = weights, step
        self.gap = {f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in self.index.items()}

    @staticmethod
    def _expect(scores: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the labels and expected transitions, by forward and backward sums."""
        n = len(scores)
        forward, backward = np.empty((n, 2)), np.zeros((n, 2))
        forward[0] = scores[0]
        for t in range(1, n):
            forward[t] = scores[t] + np.logaddexp(forward[t - 1, 0] + step[0], forward[t - 1, 1] + step[1])
        for t in range(n - 2, -1, -1):
            after = scores[t + 1] + backward[t + 1]
            backward[t] = np.logaddexp(step[:, 0] + after[0], step[:, 1] + after[1])
        total = np.logaddexp(*forward[-1])
        pairs = np.zeros((2, 2))
        for t in range(n - 1):
            pairs += np.exp(forward[t][:, None] + step + (scores[t + 1] + backward[t + 1])[None] - total)
        return np.exp(forward + backward - total), pairs

    def labels(self, page: list[list[str]]) -> list[int]:
        gap = self.gap
        scores = np.zeros((len(page), 2))
        for i, block in enumerate(page):
            u = v = 0.0
            for f in block:
                if f in gap:
                    x, y = gap[f]
                    u, v = u + x, v + y
            scores[i] = u, v
        return viterbi(scores, self.step)


# What parts of pages are commonly called
ASIDE = {
    "nav": "nav menu navbar breadcrumb breadcrumbs navigation toc pagination tabs".split(),
    "header": "header masthead topbar banner branding logo".split(),
    "footer": "footer copyright colophon legal".split(),
    "aside": "sidebar aside related widget widgets recommended promo teaser".split(),
    "div": "ad ads advert advertisement sponsored sponsor banner cookie consent notice popup modal newsletter subscribe share "
    "social sharing alert disclaimer".split(),
    "section": "comments comment replies discussion respond reviews disqus".split(),
    "form": "search login signup form subscribe contact".split(),
}
MAIN = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<main><article class="post">',
        '<div class="article">', '<section class="story">', '<div class="entry-content">']


def labelled_pages(count: int = 240, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages made from templates and the texts of their main blocks."""
    rng = random.Random(seed)
    sounds = "an el sta ri on ver mi che ou ti dra len so ka".split()

    def words(least: int, most: int) -> str:
        return " ".join("".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(rng.randint(least, most)))

    def sentence(least: int, most: int) -> str:
        return words(least, most).capitalize() + rng.choice(["."] * 6 + ["!", "?", ""])

    def aside(kind: str) -> str:
        name = rng.choice(ASIDE[kind])
        mark = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {words(1, 1)}"', "" if kind not in ("div", "section") else f' class="{name}"'])
        tag = kind if kind in ("div", "section") or rng.random() < 0.7 else "div"
        if tag == "div" and not mark:
            mark = f' class="{name}"'
        inner = {
            "nav": lambda: "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(1, 7))) + "</ul>",
            "header": lambda: f"<h1>{words(1, 3)}</h1><p>{sentence(1, 6)}</p>",
            "footer": lambda: f"&copy; {words(1, 2)} &middot; {sentence(1, 12)}",
            "section": lambda: "".join(f'<div class="{rng.choice(["comment", "reply"])}"><b>{words(1, 1)}</b><p>{sentence(3, 30)}</p></div>' for _ in range(rng.randint(1, 4))),
            "form": lambda: f"<label>{words(1, 2)}</label><button>{words(1, 1)}</button>",
        }.get(kind, lambda: "".join(f"<p>{sentence(2, 20)}</p>" if rng.random() < 0.5 else sentence(2, 20) for _ in range(rng.randint(1, 2))))()
        return f"<{tag}{mark}>{inner}</{tag}>"

    pages = []
    for _ in range(count):
        texts, main = [], []
        opening = rng.choice(MAIN)
        title = words(2, 9).capitalize()
        main.append(f"<h1>{title}</h1>")
        texts.append(title)
        for _ in range(rng.randint(1, 9)):
            text = sentence(1, 60)
            texts.append(text)
            shape = rng.random()
            if shape < 0.7:
                main.append(f"<p>{text}</p>")
            elif shape < 0.8:
                main.append(f"<p><b>{text}<br>")
            elif shape < 0.87:
                main.append(f"<ul><li>{text}</li></ul>")
            elif shape < 0.94:
                main.append(f"<h2>{text}</h2>")
            else:
                main.append(f"<blockquote>{text}</blockquote>")
            if rng.random() < 0.08:
                main.append(aside(rng.choice(["div", "aside", "form"])))
        if rng.random() < 0.15:
            main.append(aside("section"))
        closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
        before = "".join(aside(k) for k in ("header", "nav", "div") if rng.random() < 0.7)
        after = "".join(aside(k) for k in ("aside", "section", "div", "form", "footer") if rng.random() < 0.5)
        pages.append((f"<html><head><title>{title}</title></head><body>{before}{opening}{''.join(main)}{closing}{after}</body></html>", texts))
    return pages


@lru_cache(1)
def trained() -> Field:
    pages = []
    for page, texts in labelled_pages():
        found, rest = blocks(page), list(texts)
        labels = []
        for text, marks, _ in found:
            hit = bool(rest) and text == rest[0] and not any(m in ("tag=header", "name=header") for m in marks)
            labels.append(int(hit))
            if hit:
                rest.pop(0)
        pages.append(([features(b) for b in found], labels))
    return Field(pages)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    labels = field.labels([features(b) for b in found])
    return "\n\n".join(b[0] for b, label in zip(found, labels) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), shared.value) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
