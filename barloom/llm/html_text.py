"""Main text of web pages: a bidirectional LSTM labels every block with the whole page as context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import ALNUM, word_hashes
from barloom.llm.html_blocks import Block, Element, blocks, inherited

PATH_SIZE, WORD_SIZE, NUMBERS, HIDDEN = 96, 64, 8, 20
SIZE = PATH_SIZE + WORD_SIZE + NUMBERS
#: pages sampled for training at most, those with the smallest hashes
TRAINING_PAGES = 200
#: characters of a page in that sample at most
TRAINING_CHARS = 200_000
BATCH = 128


@lru_cache(maxsize=20_000)
def place(word: str) -> int:
    return crc32(word.encode()) % PATH_SIZE


def words_above(above: np.ndarray, element: Element) -> np.ndarray:
    own = above.copy()
    for k, word in enumerate(element.name.split()):
        own[place(f"{k > 0}{word}")] = True
    return own


def path_vector(element: Element | None) -> np.ndarray:
    """Hashed elements of a tag path and the words of their names; the innermost element and its parent count apart."""
    v = inherited(element, "words", np.zeros(PATH_SIZE, bool), words_above).astype(np.float32)
    for back, e in ((1, element), (2, element.parent if element else None)):
        if e:
            v[place(f"{back}:{e.tag}")] = 1
    return v


def features(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), SIZE), np.float32)
    texts = [b.text.encode() for b in page]
    flat, counts = word_hashes(texts, ALNUM)
    row = np.repeat(np.arange(len(page)), counts)
    np.add.at(x, (row, PATH_SIZE + (flat % np.uint64(WORD_SIZE)).astype(np.int64)), 1)
    x[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] /= np.sqrt(np.maximum(1, counts))[:, None]
    for i, (b, t, n) in enumerate(zip(page, texts, counts.tolist(), strict=True)):
        x[i, :PATH_SIZE] = path_vector(b.element)
        size = max(1, len(b.text))
        x[i, -NUMBERS:] = (np.log1p(n) / 4, b.linked / size, t.count(b".") / (n + 1), t.count(b",") / (n + 1), b.text.endswith((".", "!", "?", ":")), i / len(page), 1 / (1 + i), b.depth / 8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Labeller:
    """Bidirectional LSTM with one hidden layer in each direction and a logistic output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.1, (SIZE, 4 * HIDDEN))
            self.p[f"U{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p["V"], self.p["v"] = rng.normal(0, 0.2, (2 * HIDDEN,)), np.zeros(1)

    def run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of direction d over padded pages x (pages, blocks, SIZE); padding leaves the state as it is."""
        n, steps, _ = x.shape
        u, order = self.p[f"U{d}"], range(steps) if d == "f" else range(steps - 1, -1, -1)
        inputs = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, tape = np.zeros((n, steps, HIDDEN)), []
        for t in order:
            z = inputs[:, t] + h @ u
            gates = sigmoid(z[:, :3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            live = mask[:, t, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, squashed, live))
            c = np.where(live, new, c)
            h = np.where(live, o * squashed, h)
            out[:, t] = h
        return out, tape

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.run(d, x, mask, False)[0] for d in "fb"], axis=2)
        return sigmoid(h @ self.p["V"] + self.p["v"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self.run(d, x, mask, True) for d in "fb"}
        h = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        error = (sigmoid(h @ self.p["V"] + self.p["v"]) - y) * mask / mask.sum()
        grad = {"V": np.einsum("nt,nth->h", error, h), "v": np.array([error.sum()])}
        for k, d in enumerate("fb"):
            back = error[:, :, None] * self.p["V"][k * HIDDEN:(k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc, du = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)), np.zeros_like(self.p[f"U{d}"])
            for t, h0, c0, i, f, o, g, squashed, live in reversed(runs[d][1]):
                dh = dh + back[:, t]
                dnew = np.where(live, dc + dh * o * (1 - squashed**2), 0)
                dz = np.hstack([dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), np.where(live, dh * squashed, 0) * o * (1 - o), dnew * i * (1 - g**2)])
                dz_all[:, t] = dz
                du += h0.T @ dz
                dh = dz @ self.p[f"U{d}"].T + np.where(live, 0, dh)
                dc = np.where(live, dnew * f, dc)
            grad[f"W{d}"] = np.einsum("nts,ntz->sz", x, dz_all, optimize=True)
            grad[f"U{d}"], grad[f"c{d}"] = du, dz_all.sum((0, 1))
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, SIZE), np.float32), np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, :len(p)], mask[i, :len(p)] = p, True
    return x, mask


def fitted(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.02, seed: int = 5) -> Labeller:
    """pages: (features, labels). Adam over batches of pages of like length."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for _ in range(epochs):
        for start in rng.permutation(range(0, len(pages), 16)):
            part = pages[start:start + 16]
            x, mask = padded([f for f, _ in part])
            y = np.zeros(mask.shape)
            y[mask] = np.concatenate([labels for _, labels in part])
            t += 1
            for k, g in model.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


# Training pages. Layouts are composed at random, so that the label of every block is known; names of classes are
# sometimes telling and sometimes not, so that the model has to use links, lengths, words and neighbours as well.

#: fixed values: words by which web pages name their parts
MAIN_NAMES = ["content", "post", "entry", "article body", "story", "main", "text"]
SIDE = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "toc"], "header": ["header", "masthead", "banner", "top", "site header"], "footer": ["footer", "bottom", "site footer", "copyright"],
    "aside": ["sidebar", "related", "widget", "aside", "recommended", "popular", "tags"], "ad": ["ad", "ads", "advert", "sponsored", "promo", "advertisement"],
    "notice": ["cookie", "consent", "notice", "alert", "gdpr", "newsletter", "popup", "modal", "paywall"], "form": ["form", "login", "search", "subscribe", "signup"],
    "comments": ["comments", "comment", "reply", "discussion", "respond"], "share": ["share", "social", "follow", "meta", "byline"],
}
SAYINGS = {
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter today.", "This site uses cookies. Read our privacy policy.", "Please disable your ad blocker."],
    "footer": ["© 2024 All rights reserved.", "Terms of use", "Privacy policy", "Contact us", "© example.com", "Powered by"], "form": ["Your email address", "Submit", "Log in", "Search", "Password", "Send"],
    "comments": ["Reply", "Leave a comment", "Great post, thanks!", "says:", "3 comments"], "share": ["Share", "Tweet", "Print this page", "Follow us", "Posted by admin"], "ad": ["Advertisement", "Sponsored", "Buy now and save!"],
    "aside": ["Related articles", "Most read", "Popular posts", "Read more"], "nav": ["Home", "About", "Next", "Previous", "News"], "header": ["Skip to content", "Menu", "Welcome"],
}


class Writer:
    """One made-up page as (html, label) pieces, one piece a block."""

    def __init__(self, seed: int):
        self.r, self.out = Random(seed), []
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouéöñ") for _ in range(2)) for _ in range(40)]

    def words(self, low: int, high: int, stops: bool = True) -> str:
        w = ["".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2)))) for _ in range(self.r.randint(low, high))]
        for i in range(len(w)):
            if stops and self.r.random() < 0.12:
                w[i] += self.r.choice((".", ",", ","))
        return " ".join(w).capitalize() + ("." if stops else "")

    def tag(self, kind: str, inner, plain: str = "div") -> None:
        named = self.r.random() < 0.85
        name = self.r.choice(SIDE.get(kind, MAIN_NAMES)) if named else self.words(1, 1, False).lower()
        native = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "main": self.r.choice(("article", "main", "section")), "comments": "section"}.get(kind)
        element = native if native and self.r.random() < 0.6 else plain
        attribute = f' {self.r.choice(("class", "id", "role"))}="{name}"' if element == plain or self.r.random() < 0.5 else ""
        self.out.append((f"<{element}{attribute}>", None))
        inner()
        self.out.append((f"</{element}>", None))

    def block(self, element: str, text: str, label: int, link: bool = False) -> None:
        self.out.append((f"<{element}>" + (f'<a href="/x">{text}</a>' if link else text) + ("" if element == "p" and self.r.random() < 0.2 else f"</{element}>"), label))

    def links(self, n: int) -> None:
        self.out.append(("<ul>", None))
        for _ in range(n):
            self.block("li", self.words(1, 4, False), 0, True)
        self.out.append(("</ul>", None))

    def side(self, kind: str) -> None:
        def inner() -> None:
            shape = self.r.random()
            if kind in ("nav", "aside", "header") and shape < 0.7 or kind == "footer" and shape < 0.3:
                self.links(self.r.randint(1, 8))
            elif shape < 0.6:
                for _ in range(self.r.randint(1, 4)):
                    self.block(self.r.choice(("p", "div", "span", "label", "li")), self.r.choice(SAYINGS[kind]), 0, self.r.random() < 0.4)
            if kind == "comments" or kind in ("ad", "footer", "notice", "aside", "header") and shape > 0.5:
                for _ in range(self.r.randint(1, 6) if kind == "comments" else self.r.randint(1, 2)):
                    bare = self.r.random() < 0.5
                    text = self.words(2, 30)
                    self.out.append((text + "<br>" if bare and kind in ("ad", "footer") else f"<p>{text}</p>", 0))
                    if bare and kind in ("ad", "footer"):
                        self.out.append(("<hr>", None))
        self.tag(kind, inner)

    def main(self) -> None:
        def inner() -> None:
            if self.r.random() < 0.8:
                self.block("h1", self.words(2, 12, self.r.random() < 0.5), 1)
            if self.r.random() < 0.15:
                self.side("share")
            for _ in range(self.r.choice((1, 2, 3, 5, 8, 14))):
                kind = self.r.random()
                if kind < 0.75:
                    text = self.words(1, self.r.choice((3, 8, 40, 120)))
                    self.block("p", "<b>" + text + "<br>" if self.r.random() < 0.1 else text.replace(" ", ' <a href="/y">', 1) + "</a>" if self.r.random() < 0.1 else text, 1)
                elif kind < 0.83:
                    self.block(self.r.choice(("h2", "h3")), self.words(1, 7, False), 1)
                elif kind < 0.9:
                    for _ in range(self.r.randint(2, 5)):
                        self.block("li", self.words(2, 14, self.r.random() < 0.5), 1)
                elif kind < 0.95:
                    self.block(self.r.choice(("blockquote", "pre", "td", "figcaption", "dd")), self.words(3, 30), 1)
                else:
                    self.side(self.r.choice(("ad", "aside", "share", "form")))
        self.tag("main", inner)

    def page(self) -> list[tuple[str, int | None]]:
        before = self.r.sample(["nav", "header", "notice", "ad", "form", "aside"], self.r.randint(0, 4))
        after = self.r.sample(["aside", "comments", "share", "ad", "notice", "form", "nav"], self.r.randint(0, 4))
        for kind in before:
            self.side(kind)
        self.main()
        for kind in after:
            self.side(kind)
        if self.r.random() < 0.8:
            self.side("footer")
        return self.out


MARK = "\x02"


def made_up(n: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of n made-up pages. Labels ride along as marks in the text while the page is cut into blocks."""
    out = []
    for k in range(n):
        source = ""
        for piece, label in Writer(seed * 100_003 + k).page():
            if label is None:
                source += piece
            else:
                at = piece.rfind(">", 0, piece.find("</") if "</" in piece else len(piece) - 4) + 1 if piece.startswith("<") else 0
                source += piece[:at] + MARK * (label + 1) + piece[at:]
        page = blocks(source)
        labels = np.array([b.text.count(MARK) - 1 for b in page])
        ok = [i for i in range(len(page)) if labels[i] in (0, 1)]
        out.append((features([Block(page[i].text.replace(MARK, ""), page[i].element, page[i].linked) for i in ok]), labels[ok].astype(float)))
    return out


#: fixed values: elements and names that mark a block of a real page as surely outside the text
OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "comment", "comments", "sidebar", "ad", "ads", "cookie", "share", "related", "advert"}


def surely_labelled(source: str) -> tuple[np.ndarray, np.ndarray] | None:
    """A real page whose own elements tell what is its article; None if it has no such element."""
    page = blocks(source)
    inside = [inherited(b.element, "inside", False, lambda above, e: above or e.tag in ("article", "main")) for b in page]
    if not any(inside):
        return None
    outside = [inherited(b.element, "outside", False, lambda above, e: above or any(w in OUTSIDE for w in e.name.split())) for b in page]
    return features(page), np.array([float(i and not o) for i, o in zip(inside, outside, strict=True)])


def learned(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most_pages: int = TRAINING_PAGES, most_chars: int = TRAINING_CHARS) -> Labeller:
    """Trained on made-up layouts and on real pages that mark their article themselves.

    The real pages are a sample: of all pages with at most most_chars characters, the most_pages with the smallest hashes of their
    id and html, repeated rows once. Both bounds are for training alone, every page is labelled.
    """
    key = [F.xxhash64(F.lit(7), id_col, html_col).alias("key"), F.xxhash64(html_col).alias("text_key")]
    usable = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= most_chars))
    keys = [tuple(r) for r in usable.select(*key).distinct().orderBy("key", "text_key").limit(most_pages).collect()]
    sample = usable.select(*key, F.col(html_col).alias("source")).where(F.col("key").isin([k for k, _ in keys])).dropDuplicates(["key", "text_key"])
    found = sorted((r.key, r.text_key, r.source) for r in sample.collect() if (r.key, r.text_key) in keys)
    return fitted(made_up(1000) + [x for _, _, source in found if (x := surely_labelled(source)) is not None])


def extracted(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, kept_blocks: one row for each row of pages.

    The text is the blocks that the model calls main text, in page order, joined by line ends. References are decoded, white space in a
    block is one space. Very long and deeply nested pages are labelled like others, in time that grows with their length. A null, empty or text-free page gives an empty text. Extra columns are ignored, no pages give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                part = whole.slice(i, BATCH)
                parsed = [blocks(h or "") for h in part.column(2).to_pylist()]
                texts, kept = [""] * len(parsed), [0] * len(parsed)
                some = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
                for group in grouped(some, [len(p) for p in parsed]):
                    x, mask = padded([features(parsed[k]) for k in group])
                    for k, p in zip(group, shared.value.chances(x, mask), strict=True):
                        own = [b.text for b, q in zip(parsed[k], p, strict=False) if q >= 0.5]
                        texts[k], kept[k] = "\n".join(own), len(own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in parsed], pa.int64()), pa.array(kept, pa.int64())],
                                                 ["page_id", "url", "text", "n_chars", "n_blocks", "kept_blocks"])

    slim = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, kept_blocks long")


def grouped(order: list[int], sizes: list[int], most: int = 20_000) -> Iterator[list[int]]:
    """Pages of like length together, so that padding stays small; a longer page is alone."""
    group: list[int] = []
    for k in order:
        if group and (len(group) + 1) * sizes[k] > most:
            yield group
            group = []
        group.append(k)
    if group:
        yield group
