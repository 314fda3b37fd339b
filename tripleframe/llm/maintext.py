"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks, the runs of text between tags that break lines.  A block's features
are the tags, classes, ids and roles of its ancestors and the form of its text (length, share of links, sentence
marks, place on the page).  The field has two labels, main and other, scores for every feature and label, and for every
pair of neighbouring labels; Viterbi finds the best labels of a page.

It is trained on labelled pages: at most ``sample`` pages of the table, those with the smallest hashes.  A page labels itself where its
markup says what is what: blocks in an article or main element that are not in a menu, form, aside, notice, advert
or comment part.  Each labelled page is also learnt in other wrappings (``MAIN_NAMES`` and ``OTHER_NAMES`` as classes, or none at
all, and with sentences in comments, sidebars and notices), so that the field knows pages without such markup.

Edge cases: NULL, empty and tag-only pages have an empty text; broken markup is read as far as it goes; texts of any
length are read whole; repeated rows get equal results; without labelled pages, blocks of sentences with few links count as main in
training; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

DIMENSIONS = 1 << 14
SAMPLE = 150

# fixed values: elements by their part in a page
SILENT = ("script", "style", "template", "noscript", "iframe", "object", "svg", "head", "title", "textarea", "select", "button", "canvas", "audio", "video")
# what may stand in a head
HEAD = "html head base basefont bgsound link meta noframes noscript script style template title"
# mathematics is text of the line
MATH = "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml"
INLINE = frozenset(
    f"{MATH} a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER_TAGS = frozenset("nav header footer aside form fieldset dialog menu".split())
MAIN_TAGS = frozenset(("article", "main"))
# fixed values: words in class names and ids
OTHER_NAMES = (
    "ad ads advert advertisement adsense banner promo promotion sponsor sponsored comment comments reply replies respond disqus discussion sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom copyright cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup login search form share sharing social related recommended widget pagination pager toolbar legal disclaimer"
).split()
MAIN_NAMES = "content article post entry story main body text maincontent articlebody postbody entrycontent prose".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>])(?P<inside>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[\"'].*)?\Z|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass(frozen=True)
class Block:
    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    linked: int  # signs of the text inside links


@lru_cache(1 << 14)
def _names_of(rest: str) -> frozenset[str]:
    found = " ".join(next(filter(None, m), "") for m in _NAMES.findall(rest))
    return frozenset(x for x in _SPLIT.split(found.lower()) if x)


_HEAD_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|noframes|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>"
    r"|(?P<end></head(?=[\s/>])[^>]*>)|(?P<body><(?!(?:" + HEAD.replace(" ", "|") + r")(?=[\s/>]))[a-z])|[^<]++|<",
    re.S | re.I,
)


def _after_head(page: str, at: int) -> int:
    """Where an open head ends: after its end tag or before the first tag that may not stand in it."""
    while m := _HEAD_PART.match(page, at):
        if m["end"]:
            return m.end()
        if m["body"]:
            return m.start()
        at = m.end()
    return len(page)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, their character references decoded and white space single."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    held: list[str] = []
    linked = links = at = 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, tuple(t for t, _ in stack), frozenset().union(*(n for _, n in stack)), min(linked, len(text))))
        held.clear()
        linked = 0

    page = page or ""
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m["text"]:
            text = html.unescape(m["text"]) if "&" in m["text"] else m["text"]
            held.append(text)
            linked += len(text) if links else 0
        elif m["silent"]:
            tag = m["silent"].lower()
            if tag == "svg" and m["inside"].endswith("/"):
                continue
            if tag == "head":
                at = _after_head(page, at)
                continue
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in INLINE:
                if tag == "br":
                    held.append(" ")
                elif tag == "a":
                    links = 0 if m["close"] else 1
                continue
            end()
            links = 0
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            # paragraphs, list items and cells end where the next begins
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
                stack.pop()
            if tag not in VOID and not m["rest"].endswith("/"):
                stack.append((tag, _names_of(m["rest"])))
    end()
    return out


def weak_labels(page: list[Block]) -> list[int] | None:
    """1 for main, 0 for other, where the page's markup says so."""
    other = OTHER_TAGS, frozenset(OTHER_NAMES)
    labels = [int(bool(MAIN_TAGS & {*b.tags}) and not (other[0] & {*b.tags}) and not (other[1] & b.names)) for b in page]
    return labels if any(labels) else None


@lru_cache(1 << 16)
def _slot(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) % DIMENSIONS


@lru_cache(1 << 14)
def _markup_slots(tags: tuple[str, ...], names: frozenset[str]) -> tuple[int, ...]:
    found = {f"in:{t}" for t in tags if t not in ("html", "body", "div", "section")} | {f"name:{n}" for n in names}
    return tuple(_slot(x) for x in (*sorted(found), f"own:{tags[-1] if tags else ''}"))


def _text_slots(b: Block, place: float) -> tuple[int, ...]:
    words = b.text.count(" ") + 1
    size, share = min(words.bit_length(), 7), int(4 * b.linked / len(b.text))
    return tuple(
        _slot(x)
        for x in (
            "any", f"size:{size}", f"linked:{share}", f"both:{size}:{share > 1}", f"end:{b.text[-1] in '.!?:;…'}:{size > 2}",
            f"commas:{min(b.text.count(','), 3)}", f"sign:{'©' in b.text}", f"place:{int(place * 5)}",
        )
    )


def features(page: list[Block]) -> list[tuple[int, ...]]:
    n = max(len(page) - 1, 1)
    return [_markup_slots(b.tags, b.names) + _text_slots(b, i / n * 0.999) for i, b in enumerate(page)]


@dataclass
class Field:
    score: np.ndarray  # feature, label
    step: np.ndarray  # label, next label
    first: np.ndarray

    def labels(self, page: list[tuple[int, ...]]) -> list[int]:
        """The best labels of a page by Viterbi."""
        if not page:
            return []
        sizes = [len(f) for f in page]
        own = np.add.reduceat(self.score[np.concatenate([*page]).astype(np.int64)], np.cumsum([0, *sizes[:-1]]))
        a, b = (own[0] + self.first).tolist()
        (aa, ab), (ba, bb) = self.step.tolist()
        back = []
        for x, y in own[1:].tolist():
            to_a, to_b = a + aa >= b + ba, a + ab >= b + bb
            back.append((0 if to_a else 1, 0 if to_b else 1))
            a, b = (a + aa if to_a else b + ba) + x, (a + ab if to_b else b + bb) + y
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 250, shrink: float = 1e-6) -> Field:
    """Greatest likelihood of the labels of whole pages, by adaptive gradient steps; forward and backward run over all pages at once."""
    score, step, first = np.zeros((DIMENSIONS, 2)), np.zeros((2, 2)), np.zeros(2)
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    if not pages:
        return Field(score, step, first)
    n, longest = len(pages), len(pages[0][0])
    length = np.array([len(p[0]) for p in pages])
    place = np.arange(longest)
    there = place[None, :] < length[:, None]
    rows = [(i, j, s) for i, (f, _) in enumerate(pages) for j, slots in enumerate(f) for s in slots]
    page, at, slot = np.array(rows).T
    cell = page * longest + at
    gold = np.zeros((n, longest, 2))
    for i, (_, labels) in enumerate(pages):
        gold[i, np.arange(len(labels)), labels] = 1
    pairs = np.einsum("ijk,ijl->kl", gold[:, :-1], gold[:, 1:])
    total = length.sum()
    values = [score, step, first]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for t in range(1, rounds + 1):
        own = np.stack([np.bincount(cell, score[slot, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = own[:, 0] + first
        for j in range(1, longest):
            forward[:, j] = own[:, j] + np.logaddexp.reduce(forward[:, j - 1, :, None] + step, axis=1)
        for j in range(longest - 2, -1, -1):
            after = np.logaddexp.reduce(step + (own[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(there[:, j + 1, None], after, 0)
        whole = np.logaddexp.reduce(forward[np.arange(n), length - 1], axis=1)
        expected = np.exp(forward + backward - whole[:, None, None]) * there[:, :, None]
        joint = forward[:, :-1, :, None] + step + (own + backward)[:, 1:, None, :] - whole[:, None, None, None]
        joint = (np.exp(np.minimum(joint, 0)) * there[:, 1:, None, None]).sum(axis=(0, 1))
        error = (expected - gold * there[:, :, None]).reshape(-1, 2)
        slopes = [
            np.stack([np.bincount(slot, error[cell, k], DIMENSIONS) for k in (0, 1)], axis=1) / total + shrink * score,
            (joint - pairs) / total,
            (expected[:, 0] - gold[:, 0]).sum(axis=0) / total,
        ]
        for v, s, (m, q) in zip(values, slopes, moments):
            m += 0.1 * (s - m)
            q += 0.01 * (s**2 - q)
            v -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
    return Field(score.astype(np.float32), step, first)


def labelled(pages: list[str], seed: int = 7) -> list[tuple[list[tuple[int, ...]], list[int]]]:
    """Training pages: those that label themselves, each also in other wrappings."""
    rng = np.random.default_rng(seed)
    cut = [b for b in map(blocks, pages) if b]
    known = [(b, y) for b in cut if (y := weak_labels(b))]
    if not known:
        known = [(b, [int(x.text.count(" ") >= 8 and 4 * x.linked < len(x.text)) for x in b]) for b in cut]
    sentences = [x for b, y in known for x, k in zip(b, y) if k and len(x.text) > 40]
    pick = lambda names: names[rng.integers(len(names))]

    owns = ("p", "p", "p", "p", "h1", "h2", "h3", "li", "td", "dd", "pre", "blockquote", "figcaption", "div")

    def wrapped(b: Block, around: tuple[str, ...], name: str | None) -> Block:
        text = b.text
        if rng.random() < 0.5 and len(text) > 40:  # blocks of a few sentences too
            parts = re.findall(r"[^.!?]+[.!?]*", text)
            text = "".join(parts[: rng.integers(1, 4)]).strip() or text
        elif rng.random() < 0.3:  # and of a few words
            text = " ".join(text.split()[: rng.integers(1, 5)]).rstrip(".,") or text
        own = b.tags[-1] if b.tags and b.tags[-1] not in MAIN_TAGS | OTHER_TAGS and rng.random() < 0.6 else pick(owns)
        held = {"li": ("ul",), "td": ("table", "tr"), "dd": ("dl",), "figcaption": ("figure",)}.get(own, ())
        return Block(text, ("html", "body", *around, *held, own), frozenset([name] if name else []), min(b.linked, len(text)))

    def aside(tags: tuple[str, ...]) -> tuple[tuple[str, ...], str | None]:
        """Wrappings of a part that is not the article: by its element, or by a name."""
        if tags and rng.random() < 0.5:
            return (*tags, pick(sorted(OTHER_TAGS))), None
        return (*tags[: rng.integers(0, 2)], pick(("div", "section", "aside", "ul"))), pick(OTHER_NAMES)

    out = []
    for page, labels in known:
        out.append((features(page), labels))
        for style in ("semantic", "semantic", "named", "named", "plain"):
            left = rng.integers(1, 4) if rng.random() < 0.3 else 12  # short articles too
            tags = (pick(sorted(MAIN_TAGS)),) if style == "semantic" else ("div",)
            name = pick(MAIN_NAMES) if style == "named" and rng.random() < 0.8 else None
            new, y = [], []
            for b, k in zip(page, labels):
                if k and left:
                    new.append(wrapped(b, tags, name))
                    left -= 1
                elif not k:
                    new.append(wrapped(b, *(("div",), None) if style == "plain" else aside(())))
                else:
                    continue
                y.append(k)
            for _ in range(0 if style == "plain" or not sentences else 4):
                around, part_name = aside(tags if style == "semantic" else ())
                part = [wrapped(pick(sentences), around, part_name) for _ in range(rng.integers(1, 5))]
                where = rng.integers(0, len(new) + 1)
                new[where:where], y[where:where] = part, [0] * len(part)
            out.append((features(new), y))
    return out


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, k in zip(found, field.labels(features(found))) if k)


def fitted(pages: DataFrame, sample: int = SAMPLE) -> Field:
    hashed = pages.where("html IS NOT NULL").select("html", F.xxhash64("html").alias("h"))
    # only distinct hashes are ranked, so that copies of a page don't take the places of others and, so that pages beyond the sample stay in their tasks
    cut = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(cut)).groupBy("h").agg(F.min("html").alias("html"))
    return train(labelled([r["html"] for r in chosen.collect()]))  # at most ``sample`` pages


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    field = fitted(pages, sample)
    id_type = dict(pages.dtypes)["page_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), field) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {id_type}, url string, text string, n_chars long")
