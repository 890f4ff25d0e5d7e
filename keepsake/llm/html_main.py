"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of visible text between block-level tags. Each block has features of its
ancestors (tags and what their class, id and role speak of) and of its text (length, links, punctuation, place). The
field labels the blocks of a page together (main or not) with weights for features and for neighbouring labels, found
by maximum likelihood with forward-backward sums; pages are decoded by Viterbi inside the scan. No shuffle.

Training pages: at most ``TRAIN_PAGES`` pages of the table (those with the smallest hash of their id; a bounded,
documented parameter). A page that marks its article says itself which blocks are main; and each page's paragraphs are
laid out anew in other, usual ways (without an article tag, with side bars, notices, forms, reader comments), with
labels known from the making.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K
from keepsake.llm.ranks import smallest_hashes

TRAIN_PAGES, LAYOUTS, STEPS = 80, 4, 150
SLICE_BYTES = 4 << 20

# How HTML groups its elements.
HIDDEN = frozenset("script style noscript template head title svg iframe object select textarea canvas button annotation "
                   "annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript".split())
IN_HEAD = frozenset("html head base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul caption legend hr".split())
# What class, id and role names speak of.
TOPICS = {
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs topbar pagination pager tabs toc skip",
    "head": "header head masthead banner site-header topbar logo branding",
    "foot": "footer foot contentinfo copyright colophon legal imprint",
    "side": "sidebar side aside widget complementary related recommended recommendations more trending popular rail",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner-ad adsense outbrain taboola",
    "comment": "comment comments reply replies respond discussion disqus reader-comments thread",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription gdpr paywall",
    "share": "share sharing social follow tags tag-list byline meta author date",
    "form": "form login search signup register contact",
    "content": "content article post entry story main body text articlebody post-content entry-content page-content",
}
_TOPIC_OF = {word: topic for topic, words in TOPICS.items() for word in words.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_PLAIN = re.compile(r"[^a-z0-9-]+")
# Elements that end others of their kind.
_IMPLIED = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"),
            "dd": ("dt", "dd")}


class Place:
    """An open element: its tag, what its names speak of, and the features of it and all elements around it.

    Elements share what is around them, so a deep page costs no more than a flat one.
    """

    __slots__ = ("parent", "tag", "topics", "found")

    def __init__(self, parent: Place | None, tag: str, topics: tuple[str, ...] = ()):
        self.parent, self.tag, self.topics = parent, tag, topics
        own = {f for f in (f"in:{tag}", *(f"of:{t}" for t in topics)) if f in _FEATURES}
        above = parent.found if parent else frozenset()
        self.found = above if own <= above else above | own

    def path(self) -> list[tuple[str, tuple[str, ...]]]:
        """(tag, topics) of the elements from the outermost one on."""
        found, place = [], self
        while place:
            found.append((place.tag, place.topics))
            place = place.parent
        return found[::-1]


def place_of(path) -> Place | None:
    place = None
    for tag, topics in path:
        place = Place(place, tag, topics)
    return place


@dataclass
class Block:
    place: Place | None
    text: str
    linked: int

    @property
    def path(self) -> list[tuple[str, tuple[str, ...]]]:
        return self.place.path() if self.place else []


def _names(attributes: str) -> tuple[str, ...]:
    """Topics of an element's class, id and role."""
    found = []
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        for word in _PLAIN.split((a or b or c).lower()):
            if topic := _TOPIC_OF.get(word) or next((_TOPIC_OF[w] for w in word.split("-") if w in _TOPIC_OF), None):
                found.append(topic)
    return tuple(sorted(set(found)))


def leaf_blocks(page: str) -> list[Block]:
    """Visible leaf blocks of a page in order; broken mark-up is read as far as it goes.

    An open head ends with the first text or element that can't be in one. Hidden elements inside a paragraph leave
    out their own content and don't end it.
    """
    blocks: list[Block] = []
    stack: list[Place] = []
    opened: Counter = Counter()
    pieces: list[str] = []
    hidden = linked = links = at = 0
    size = len(page)

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                around = next((i for i, p in enumerate(stack) if p.tag in HIDDEN), len(stack)) if hidden else len(stack)
                blocks.append(Block(stack[around - 1] if around else None, text, linked))
            pieces.clear()
        linked = 0

    def cut(depth: int) -> None:
        nonlocal hidden
        for place in stack[depth:]:
            opened[place.tag] -= 1
            hidden -= place.tag in HIDDEN
        del stack[depth:]

    while at < size:
        match = _TOKEN.search(page, at)
        stop = match.start() if match else size
        if stop > at:
            if hidden and stack[-1].tag == "head" and page[at:stop].strip():
                cut(len(stack) - 1)
            if not hidden:
                text = html.unescape(page[at:stop])
                pieces.append(text)
                if links:
                    linked += len(text.strip())
        if not match:
            break
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag in HIDDEN:
                depth = len(stack)
                if opened[tag]:
                    depth = next(i for i in range(depth - 1, -1, -1) if stack[i].tag == tag)
                leaving = sum(p.tag in HIDDEN for p in stack[depth:])
                if tag in BLOCK and leaving == hidden:
                    close()
                cut(depth)
            continue
        if hidden and stack[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links += 1
        elif tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
        elif tag in BLOCK or tag in HIDDEN:
            if tag == "body" and hidden:
                cut(next(i for i, p in enumerate(stack) if p.tag in HIDDEN))
            if tag in BLOCK and not hidden:
                close()
                links = 0
            if tag in VOID or match[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in BLOCK:
                implied = ("p", *_IMPLIED.get(tag, ()))
                while stack and stack[-1].tag in implied:
                    cut(len(stack) - 1)
            stack.append(Place(stack[-1] if stack else None, tag, _names(match[3])))
            opened[tag] += 1
            hidden += tag in HIDDEN
    close()
    return blocks


# ---- features -------------------------------------------------------------------------------------------------------

_TAGS = ("article main section div p li ul ol nav header footer aside form table td blockquote pre figure figcaption "
         "fieldset dl h1 h2 h3 h4 address").split()
_FEATURES = {name: i for i, name in enumerate(
    [f"in:{t}" for t in _TAGS] + [f"of:{t}" for t in TOPICS] + [f"near:{t}" for t in TOPICS]
    + [f"last:{t}" for t in _TAGS]
    + [f"words:{n}" for n in range(8)] + [f"links:{n}" for n in range(4)]
    + ["stop", "rights", "first", "early", "late", "last", "plain", "bias"])}
N_FEATURES = len(_FEATURES)
_PATHS: dict[tuple, tuple[int, ...]] = {}


def _path_features(place: Place | None) -> tuple[int, ...]:
    around = place.parent if place else None
    key = (place.found, place.tag, place.topics, around.topics if around else ()) if place else ()
    known = _PATHS.get(key)
    if known is None:
        found = set(place.found) if place else set()
        if place:
            found |= {f"last:{place.tag}", *(f"near:{t}" for t in (*key[2], *key[3]))}
        if not any(f.startswith("of:") or f in ("in:article", "in:main", "in:nav", "in:footer") for f in found):
            found.add("plain")
        known = tuple(sorted(_FEATURES[f] for f in found if f in _FEATURES))
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        _PATHS[key] = known
    return known


def block_features(blocks: list[Block]) -> list[list[int]]:
    out, n = [], len(blocks)
    for i, block in enumerate(blocks):
        text = block.text
        words = min(7, (text.count(" ") + 1).bit_length())
        share = block.linked / len(text)
        own = [*_path_features(block.place), _FEATURES["bias"], _FEATURES[f"words:{words}"],
               _FEATURES[f"links:{0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]]
        if text[-1] in ".!?…\"'”»。":
            own.append(_FEATURES["stop"])
        if "©" in text or "(c)" in text:
            own.append(_FEATURES["rights"])
        own.append(_FEATURES["first" if i == 0 else "last" if i == n - 1 else "early" if 4 * i < n else
                             "late" if 4 * i > 3 * n else "bias"])
        out.append(own)
    return out


# ---- the field ------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    """Weights of features by label (not main, main), of label pairs, and of first and last labels."""

    features: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray


def fit_field(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; gradients from forward-backward sums over all pages at once."""
    n, longest = len(pages), max(len(f) for f, _ in pages)
    x = np.zeros((n, longest, N_FEATURES), np.float32)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (features, labels) in enumerate(pages):
        for t, own in enumerate(features):
            x[i, t, own] = 1
        y[i, :len(labels)] = labels
        live[i, :len(labels)] = True
    size = live.sum(1)
    flat = x[live]
    label = np.eye(2)[y]
    ends = (np.arange(n), size - 1)
    both = live[:, 1:, None, None] * label[:, :-1, :, None] * label[:, 1:, None, :]
    seen = (flat.T @ label[live], both.sum((0, 1)), label[:, 0].sum(0), label[ends].sum(0))
    weights = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    add = lambda a, axis: np.logaddexp.reduce(a, axis=axis)     # noqa: E731
    for step in range(1, steps + 1):
        w, pair, first, last = weights
        unary = np.zeros((n, longest, 2))
        unary[live] = flat @ w
        unary[:, 0] += first
        unary[ends] += last
        ahead, back = unary.copy(), np.zeros_like(unary)
        for t in range(1, longest):
            on = live[:, t]
            ahead[on, t] = unary[on, t] + add(ahead[on, t - 1, :, None] + pair, 1)
        for t in range(longest - 2, -1, -1):
            on = live[:, t + 1]
            back[on, t] = add(pair + (unary[on, t + 1] + back[on, t + 1])[:, None, :], 2)
        total = add(ahead[ends], 1)
        one = np.exp(ahead + back - total[:, None, None]) * live[:, :, None]
        two = np.exp(ahead[:, :-1, :, None] + pair + (unary + back)[:, 1:, None, :] - total[:, None, None, None])
        two *= live[:, 1:, None, None]
        expected = (flat.T @ one[live], two.sum((0, 1)), one[:, 0].sum(0), one[ends].sum(0))
        for k in range(4):
            g = (expected[k] - seen[k]) / n + penalty * weights[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            weights[k] = weights[k] - 0.1 * (mean[k] / (1 - 0.9 ** step)) / (
                np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
    return Field(*weights)


def decode(field: Field, features: list[list[int]]) -> list[int]:
    """Most likely labels of a page's blocks (Viterbi)."""
    if not features:
        return []
    margin = np.zeros((len(features), 2))
    flat = np.fromiter((f for own in features for f in own), np.int64)
    begin = np.r_[0, np.cumsum([len(own) for own in features])[:-1]]
    margin = np.add.reduceat(field.features[flat], begin, axis=0)
    margin[0] += field.first
    margin[-1] += field.last
    (aa, ab), (ba, bb) = field.pairs.tolist()
    rows = margin.tolist()
    a, b = rows[0]
    back = []
    for u, v in rows[1:]:
        from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = u + (a + aa if from_a else b + ba), v + (a + ab if from_b else b + bb)
    label = 0 if a >= b else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


# ---- training pages -------------------------------------------------------------------------------------------------

_ASIDE = ("navigation", "head", "foot", "side", "advert", "comment", "notice", "share", "form")
_OUTER = ("nav", "footer", "aside", "form", "header", "button", "label")
# Usual short texts around an article.
_STOCK = ("Home", "About us", "Contact", "Log in", "Search", "Read more", "Share this", "Subscribe to our newsletter",
          "We use cookies to improve your experience.", "Accept all", "All rights reserved.", "© 2024 Example",
          "Privacy policy", "Related articles", "Leave a comment", "Advertisement", "Follow us", "Posted by admin",
          "Menü", "Impressum", "Mentions légales", "Aviso legal", "Nous utilisons des cookies.", "Kontakt")


def self_labelled(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article: inside it, but not inside something that surrounds articles."""
    if not any(tag == "article" for block in blocks for tag, _ in block.path):
        return None
    out = []
    for block in blocks:
        at = [i for i, (tag, _) in enumerate(block.path) if tag == "article"]
        inner = block.path[at[-1] + 1:] if at else ()
        odd = any(tag in _OUTER or any(t in _ASIDE for t in topics) for tag, topics in inner)
        out.append(int(bool(at) and not odd))
    return out


def laid_out(texts: list[str], others: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page of the given paragraphs in a random usual layout, with labels."""
    blocks: list[Block] = []
    labels: list[int] = []
    root: list[tuple[str, tuple[str, ...]]] = [("html", ()), ("body", ())]
    if rng.random() < 0.4:
        root.append(("div", ()))
    pick = lambda items: items[int(rng.integers(len(items)))]     # noqa: E731
    short = lambda: pick(_STOCK) if rng.random() < 0.6 or not others else " ".join(
        pick(others).split()[:int(rng.integers(1, 12))]) or "Home"
    long = lambda: pick(others) if others else pick(_STOCK)     # noqa: E731

    def put(path, text, label, link=0.0):
        if text:
            blocks.append(Block(place_of(root + path), text, int(len(text) * link)))
            labels.append(label)

    def links(path, n):
        for _ in range(n):
            put(path, short(), 0, 1.0)

    def chance(p):
        return rng.random() < p

    if chance(0.1):     # nothing but the article
        bare = pick([[], [("html", ()), ("body", ())], [("body", ())]])
        root[:] = bare
        for i, text in enumerate(texts[:int(rng.integers(1, 9))]):
            put([("h1" if i == 0 and chance(0.3) else "p", ())] if chance(0.9) else [], text, 1)
        return blocks, labels
    if chance(0.5):
        put(pick([[("header", ("head",))], [("header", ())], [("div", ("head",))]]) + [("p", ())], short(), 0)
    if chance(0.8):
        links(pick([[("nav", ())], [("div", ("navigation",))], [("header", ()), ("nav", ())]])
              + [("ul", ()), ("li", ())], int(rng.integers(2, 9)))
    if chance(0.3):
        put([("div", ("notice",)), ("p", ())], short() if chance(0.5) else long(), 0)
        links([("div", ("notice",))], 1)
    if chance(0.3):
        put([("div", ("advert",))], long(), 0, float(chance(0.3)))
    side = pick([[("aside", ())], [("div", ("side",))], [("aside", ("side",))]])
    first_side = chance(0.2)

    def put_side():
        put([*side, (pick(["h2", "h3"]), ())], short(), 0)
        links([*side, ("ul", ()), ("li", ())], int(rng.integers(1, 6)))
        if chance(0.4):
            put([*side, ("p", ())], long(), 0)

    if first_side:
        put_side()
    main = pick([[("article", ())], [("article", ("content",))], [("main", ()), ("article", ())], [("main", ())],
                 [("div", ("content",))], [("div", ("content",)), ("div", ("content",))], [("section", ("content",))],
                 [("main", ()), ("div", ("content",))], [("div", ())], [("main", ("content",)), ("section", ())]])
    if chance(0.8):
        put([*main, *([("header", ())] if chance(0.15) else []), (pick(["h1", "h1", "h2"]), ())],
            " ".join(texts[0].split()[:9]), 1)
    if chance(0.2):
        put([*main, ("div", ("share",))], short(), 0, float(chance(0.5)))
    for text in texts:
        tail = pick([[("p", ())]] * 8 + [[("ul", ()), ("li", ())], [("blockquote", ()), ("p", ())], [("pre", ())],
                                       [("h2", ())], [("h3", ())], [("div", ())], [],
                                       [("table", ()), ("tr", ()), ("td", ())]])
        if tail and tail[-1][0] in ("h2", "h3"):
            text = " ".join(text.split()[:6])
        put([*main, *tail], text, 1, 0.1 if chance(0.1) else 0.0)
        if chance(0.06):
            put([*main, ("div", (pick(["advert", "share", "side", "notice"]),))], long(), 0)
        if chance(0.03):
            put([*main, ("aside", ()), ("p", ())], long(), 0)
        if chance(0.02):
            put([*main, ("form", ())], short(), 0)
    if chance(0.25):
        links([*main, ("div", ("share",)), ("ul", ()), ("li", ())], 2)
    if chance(0.35) and not first_side:
        put_side()
    if chance(0.35):
        where = pick([[("section", ("comment",))], [("div", ("comment",))], [*main, ("div", ("comment",))],
                      [("div", ("comment",)), ("article", ("comment",))]])
        put([*where, ("h3", ())], short(), 0)
        for _ in range(int(rng.integers(1, 5))):
            put([*where, ("div", ("comment",) if chance(0.5) else ()), ("p", ())], long(), 0)
        if chance(0.5):
            put([*where, ("form", ())], short(), 0)
    if chance(0.2):
        put([("form", ("form",))], short(), 0)
    if chance(0.85):
        foot = pick([[("footer", ())], [("div", ("foot",))], [("footer", ("foot",))]])
        put([*foot, *([("p", ())] if chance(0.5) else [])], "© " + long() if chance(0.5) else short(), 0)
        if chance(0.4):
            links([*foot, ("ul", ()), ("li", ())], 2)
    return blocks, labels


def training_pages(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> Iterator:
    """Feature and label sequences from page sources, as they are and laid out anew."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(leaf_blocks, pages) if b]
    marked = [(b, self_labelled(b)) for b in parsed]
    mains = [[x.text for x, y in zip(b, labels or [1] * len(b)) if y] for b, labels in marked]
    mains = [m for m in mains if m] or [["A page has some text.", "It goes on here for a while, and then it ends."]]
    others = [t for m in mains for t in m]
    for blocks, labels in marked:
        if labels:
            yield block_features(blocks), labels
    for texts in mains:
        for _ in range(layouts):
            blocks, labels = laid_out(texts[:40], others, rng)
            if blocks:
                yield block_features(blocks), labels


def train(pages: DataFrame, id: str = "page_id", source: str = "html", sample: int = TRAIN_PAGES) -> Field:
    """Fit the field on a bounded sample of pages; an empty table leaves the usual layouts alone."""
    known = pages.filter(F.col(source).isNotNull()).select(F.xxhash64(id).alias("h"), F.col(source).alias("html"))
    rows = smallest_hashes(known, "h", sample, F.col("html")).collect()
    return fit_field(list(training_pages([r["html"] for r in rows])))


def main_text(field: Field, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, decode(field, block_features(blocks))) if keep)


def extract_main(pages: DataFrame, field: Field | None = None, id: str = "page_id", url: str = "url",
                 source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line break.
    Pages of any length or depth are read whole, one at a time, in time proportional to their length. A null or empty page
    gives an empty text; null ids, null addresses and repeated rows come back each; other columns
    are ignored; an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or train(pages, id, source))
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"),
                        F.col(source).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "html", SLICE_BYTES):
                texts = [main_text(shared.value, page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
