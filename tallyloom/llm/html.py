"""Main text of raw web pages by a linear-chain conditional random field over the leaf
blocks of the page's element tree.

A block is the text between two block-level tags. Its features are the tags and the words
of classes and ids on its ancestors, its own tag, and its text (length, share of link
text, closing punctuation, cue words). The field labels the blocks of a page jointly,
article or not, and is decoded by Viterbi. It is trained on labelled pages that
`labelled_pages` builds from the layouts below, once, on the driver; every page of the
table is then decoded in one pass without a shuffle.

Defined cases: a null or empty page has an empty text; text outside any element is a
block of its own; tags that never close end with their parent; a page whose blocks are
all labelled as other than article has an empty text; scripts, styles, comments and
everything in <head> are never blocks; repeated rows are each extracted; labels of equal
weight go to other than article; an empty table gives none. Very long and deeply nested
pages take time in proportion to their length: paths are read to PATH elements from the
outside and the innermost one. Other columns of the input, whatever their names, are ignored."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import held

#: Names of HTML elements.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template iframe textarea svg math object canvas audio video head title".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript template svg math object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of classes, ids and roles that tell parts of a page apart.
CUES = {
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner outbrain taboola adbox adslot dfp",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager masthead",
    "side": "sidebar side aside related recommended recommend popular trending widget rail more tags tagcloud toc",
    "talk": "comment comments reply replies disqus respond discussion reviews commentlist",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall message disclaimer",
    "form": "form newsletter subscribe signup login search register contact",
    "foot": "footer foot copyright colophon legal bottom",
    "head": "header head top branding logo",
    "share": "share social sharing follow byline meta author date credits",
    "text": "article content post entry story main body text maincontent prose richtext paragraph lead intro",
}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
TALK = re.compile(r"cookie|©|copyright|all rights reserved|subscribe|newsletter|sign up|log ?in|advert|sponsored|share (?:this|on)|read more|related|privacy|terms of|repl(?:y|ies)|comments?\b|posted by|search|menu", re.I)

#: Elements of a path that make features, from the outside; its last one does besides.
PATH = 64
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_MARKS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_ENDS: dict[str, re.Pattern] = {t: re.compile(f"</{t}", re.I) for t in RAW_TAGS}
#: An open element of the left kind ends where one of the right kind begins.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}


@lru_cache(50_000)
def _marks(attributes: str) -> tuple[str, ...]:
    found = [w for m in _MARKS.finditer(attributes) for w in _WORDS.findall(next((x for x in m.groups() if x), "").lower())]
    return tuple(dict.fromkeys(_CUE[w] for w in found if w in _CUE))


class _Tags:
    """The tags of a page in order. Each search goes on where the last one ended, and what
    a page doesn't hold any more is looked for only once, so the whole is linear."""

    def __init__(self, page: str):
        self.page, self.lacking = page, {}

    def find(self, what: str, at: int) -> int:
        """Where what stands next, or -1."""
        if self.lacking.get(what, len(self.page) + 1) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.lacking[what] = at
        return found

    def after(self, what: str, at: int) -> int:
        found = self.find(what, at)
        return found + len(what) if found >= 0 else len(self.page)

    def closed(self, at: int) -> int:
        """Behind the > that ends the tag whose name ends at a place, or -1. A quote behind = hides a > up to the same quote, if there is one."""
        page = self.page
        while True:
            end = self.find(">", at)
            if end < 0:
                return -1
            marks = [x for x in (self.find('"', at), self.find("'", at)) if 0 <= x < end]
            if not marks:
                return end + 1
            mark = min(marks)
            close = self.find(page[mark], mark + 1) if page[at:mark].rstrip().endswith("=") else mark
            if close < 0:
                return end + 1
            at = close + 1

    def __iter__(self):
        """(begin, end, whether it is an end tag, name or None, attributes)."""
        page, at = self.page, 0
        while m := _OPEN.search(page, at):
            begin, at = m.span()
            name = m.group(2)
            if name is not None:
                end = self.closed(at)
                if end < 0:  # no tag is closed from here on
                    return
                inside = page[at : end - 1]
                at = end
            else:
                opened, inside = m.group(0), ""
                if opened == "<!--":
                    at = self.after("-->", at)
                elif opened == "<![CDATA[":
                    at = self.after("]]>", at)
                elif (at := self.find(">", at) + 1) == 0:
                    return
            skipped = yield begin, at, bool(m.group(1)), name.lower() if name else None, inside
            if skipped is not None:
                at = skipped
                yield None


def blocks(page: str) -> list[tuple[str, tuple[tuple[str, tuple[str, ...]], ...], float]]:
    """(text, path of (tag, cues), share of link text) of each leaf block in page order."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, tuple[str, ...]]] = []
    outer: list[tuple[str, tuple[str, ...]]] = []  # the block elements of the stack
    above: list[int] = []  # where they stand in it
    places: dict[str, list[int]] = {}  # where each tag stands in the stack
    links, muted, at, n = 0, 0, 0, len(page)
    tags = _Tags(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, tuple(outer) if len(outer) <= PATH else (*outer[: PATH - 1], outer[-1]), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, muted
        while len(stack) > to:
            tag, _ = stack.pop()
            places[tag].pop()
            if above and above[-1] == len(stack):
                above.pop()
                outer.pop()
            links -= tag == "a"
            muted -= tag in SILENT_TAGS

    def text_of(begin: int, end: int) -> None:
        nonlocal linked
        if end > begin and not muted:
            piece = page[begin:end]
            # References end with the text that they stand in: a tag splits them for good.
            parts.append(entities.unescape(piece) if "&" in piece else piece)
            if links:
                linked += end - begin

    walk = iter(tags)
    for begin, end, closing, tag, inside in walk:
        text_of(at, begin)
        at = end
        if tag is None:
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if places.get(tag):
                i = places[tag][-1]
                if tag in BLOCK_TAGS or not above or above[-1] < i:  # an inline end tag doesn't close blocks
                    pop(i)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            # an open paragraph or heading, and the inline elements in it, end here
            while above:
                t = stack[above[-1]][0]
                if t == "p" or t in HEADINGS:
                    pop(above[-1])
                    continue
                if tag in _IMPLIED.get(t, ()):
                    pop(above[-1])
                break
            if tag == "body" and places.get("head"):
                pop(places["head"][0])
        if tag in VOID_TAGS or inside.endswith("/"):
            continue
        if tag in RAW_TAGS:
            close = _raw_end(tags, tag, at)
            walk.send(close)
            at = close
            continue
        if tag in BLOCK_TAGS:
            above.append(len(stack))
            outer.append((tag, _marks(inside) if inside else ()))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, ()))
        links += tag == "a"
        muted += tag in SILENT_TAGS
    text_of(at, n)
    flush()
    return out


def _raw_end(tags: _Tags, tag: str, at: int) -> int:
    """Behind the end tag of an element whose content is no markup, or the page's end."""
    if tags.lacking.get(tag, len(tags.page) + 1) <= at:
        return len(tags.page)
    end = _ENDS[tag].search(tags.page, at)
    if not end:
        tags.lacking[tag] = at
        return len(tags.page)
    return tags.after(">", end.end())


@lru_cache(20_000)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    own = path[-1][0] if path else "none"
    return tuple({f"own={own}", f"up={path[-2][0] if len(path) > 1 else 'none'}", *(f"in={t}" for t, _ in path), *(f"cue={c}" for _, cs in path for c in cs), *(f"near={c}" for c in (path[-1][1] if path else ()))})


def features(block: tuple, place: int, count: int) -> list[str]:
    text, path, links = block
    n = len(text)
    out = [*_path_features(path), f"long={0 if n < 25 else 1 if n < 80 else 2 if n < 250 else 3}", f"links={0 if links == 0 else 1 if links < 0.5 else 2}"]
    out.append(f"ends={text[-1] in '.!?…\"”»:;'}")
    if n < 300 and TALK.search(text):
        out.append("talk")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    return out


class Field:
    """Two labels, weights a feature and label, weights a pair of labels."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.names, self.unary, self.pair = names, unary, pair
        self.difference = dict(zip(names, (unary[:, 1] - unary[:, 0]).tolist(), strict=True))

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks together (Viterbi)."""
        get = self.difference.get
        (aa, ab), (ba, bb) = self.pair.tolist()
        best0 = best1 = 0.0
        back = []
        for i, row in enumerate(rows):
            s = sum(get(f, 0.0) for f in row)
            if i:
                from0, from1 = best0 + aa >= best1 + ba, best0 + ab >= best1 + bb
                best0, best1 = (best0 + aa if from0 else best1 + ba), (best0 + ab if from1 else best1 + bb) + s
                back.append((not from0, not from1))
            else:
                best1 = s
        label = int(best1 > best0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1][: len(rows)]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 250, rate: float = 0.2, ridge: float = 0.002) -> Field:
    """Maximum likelihood with a ridge, by gradient steps; the sums over label sequences
    (forward and backward) run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                names.setdefault(f, len(names))
    longest, count = max(len(p[0]) for p in pages), len(pages)
    flat = [(i, j, names[f]) for i, (rows, _) in enumerate(pages) for j, row in enumerate(rows) for f in row]
    pi, bi, fi = (np.array(x) for x in zip(*flat, strict=True))
    gold = np.zeros((count, longest), int)
    mask = np.zeros((count, longest), bool)
    for i, (_, ys) in enumerate(pages):
        gold[i, : len(ys)], mask[i, : len(ys)] = ys, True
    onehot = np.eye(2)[gold] * mask[..., None]
    pairs = np.einsum("pia,pib->ab", onehot[:, :-1], onehot[:, 1:])
    unary, pair = np.zeros((len(names), 2)), np.zeros((2, 2))
    speed = [np.zeros_like(unary), np.zeros_like(pair)]
    moment = [np.zeros_like(unary), np.zeros_like(pair)]
    for step in range(1, rounds + 1):
        score = np.zeros((count, longest, 2))
        np.add.at(score, (pi, bi), unary[fi])
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for j in range(1, longest):
            x = ahead[:, j - 1, :, None] + pair
            ahead[:, j] = np.where(mask[:, j, None], np.logaddexp(x[:, 0], x[:, 1]) + score[:, j], ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            x = pair + (score[:, j + 1] + behind[:, j + 1])[:, None, :]
            behind[:, j] = np.where(mask[:, j + 1, None], np.logaddexp(x[..., 0], x[..., 1]), 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        marginal = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        both = np.exp(ahead[:, :-1, :, None] + pair + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        slope = np.zeros_like(unary)
        np.add.at(slope, fi, (onehot - marginal)[pi, bi])
        for k, (w, g) in enumerate(((unary, slope), (pair, pairs - both.sum(axis=(0, 1))))):
            g = g / count - ridge * w
            moment[k] = 0.9 * moment[k] + 0.1 * g
            speed[k] = 0.99 * speed[k] + 0.01 * g * g
            w += rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(speed[k] / (1 - 0.99**step)) + 1e-6)
    return Field(names, unary, pair)


#: Layouts of the labelled pages. {a}: a block of the article, {x}: other text, {k}: a link; * repeats what stands before it in brackets.
LAYOUTS = (
    '<body><nav><ul>[<li><a href="#">{k}</a></li>]*</ul></nav><div class="ad">{x}</div><article><h1>{a}</h1>[<p>{a}</p>]*</article><footer>&copy; {x}</footer>',
    '<body><header><div class="logo">{x}</div><nav>[<a href="#">{k}</a> ]*</nav></header><main><article><header><h1>{a}</h1></header>[<p>{a}</p>]*<aside class="related"><h3>{x}</h3><ul>[<li><a href="#">{k}</a></li>]*</ul></aside>[<p>{a}</p>]*</article><section class="comments"><h2>{x}</h2>[<div class="comment"><p>{x}</p></div>]*</section></main><footer><p>{x}</p></footer>',
    '<body><div id="header"><ul class="menu">[<li><a href="#">{k}</a></li>]*</ul></div><div class="cookie-notice">{x} <button>{k}</button></div><div id="content"><div class="post"><h1>{a}</h1>[<p>{a}</p>]*<blockquote>{a}</blockquote>[<p>{a}</p>]*<div class="share">[<a href="#">{k}</a> ]*</div></div></div><div id="sidebar"><h3>{x}</h3>[<p>{x}</p>]*</div><div id="footer">{x}</div>',
    '<body><div class="banner">{x}</div><div class="main-content"><h1>{a}</h1><h2>{a}</h2>[<p>{a}</p>]*<ul>[<li>{a}</li>]*</ul>[<p>{a}</p>]*<form class="newsletter"><label>{x}</label><p>{x}</p><button>{k}</button></form>[<p>{a}</p>]*</div><div class="comments">[<div><p>{x}</p></div>]*<form><p>{x}</p><textarea>x</textarea></form></div><div class="copyright">{x}</div>',
    '<body><table><tr><td><a href="#">{k}</a></td></tr></table><article>[<p>{a}]*<div class="ad"><p>{x}</p></div>[<p>{a}]*<h2>{a}</h2><table><tr><td>{a}</td><td>{a}</td></tr></table><ol>[<li>{a}</li>]*</ol></article><aside>[<p>{x}</p>]*</aside><footer>[<p>{x}</p>]*</footer>',
    '<body><header><h1>{x}</h1><p>{x}</p></header><div role="alert">{x}</div><article><h2>{a}</h2><div>{a}</div><div>{a}</div><pre>{a}</pre><figure><img><figcaption>{a}</figcaption></figure><section>[<p>{a}</p>]*</section></article><div class="widget"><h4>{x}</h4><p>{x}</p></div><nav>[<a href="#">{k}</a>]*</nav><footer>{x}</footer>',
    '<body><nav><ul>[<li><a href="#">{k}</a></li>]*</ul></nav><main><h1>{a}</h1>[<p>{a}</p>]*<section id="comments"><h3>{x}</h3><ol>[<li><p>{x}</p></li>]*</ol></section></main><aside><div class="sponsored">{x}</div>[<p>{x}</p>]*</aside><form><p>{x}</p><input><button>{k}</button></form><footer><nav>[<a href="#">{k}</a>]*</nav><p>{x}</p></footer>',
    '<body><div class="nav">[<a href="#">{k}</a> ]*</div><article><h1>{a}</h1><p><b>{a}<br>[<p>{a}</p>]*<p><b>{a}<br>[<p>{a}</p>]*</article><footer>&copy; {x} &middot; {x}</footer></body></html>',
    '<body><article><h1>{a}</h1>[<p>{a}</p>]*<div class="ad">{x}</div>[<p>{a}</p>]*<div class="advert"><p>{x}</p></div><p>{a}</p><aside>{x}</aside><p>{a}</p><div class="social">{x}</div><p>{a}</p><form><label>{x}</label><button>{k}</button></form>[<p>{a}</p>]*<nav><a href="#">{k}</a></nav></article><section class="comments">[<p>{x}</p>]*</section><footer>{x}</footer>',
    '<body><div class="menu">[<span>{x}</span>]*</div><main><div class="breadcrumb">{x}</div><h1>{a}</h1>[<p>{a}</p>]*<div class="notice">{x}</div>[<p>{a}</p>]*<div class="banner"><p>{x}</p></div><h2>{a}</h2>[<p>{a}</p>]*<div class="comment"><p>{x}</p></div></main><div id="sidebar"><p>{x}</p><p>{x}</p></div><footer><div>{x}</div></footer>',
    '<body><p class="notice">{x}</p><div class="ads">{x}</div><article><p>{a}</p>[<p>{a}</p>]*<p class="disclaimer">{x}</p><div class="popup"><p>{x}</p></div></article><div class="comments"><p>{x}</p>[<article class="comment"><p>{x}</p></article>]*</div><div class="sidebar"><ul>[<li>{x}</li>]*</ul></div>',
)


def labelled_pages(count: int = 180, seed: int = 5) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages from the layouts in turn with made-up words; each block's text and label."""
    rng = random.Random(seed)
    letters = "abcdefghilmnoprstuvz"

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))

    out = []
    for i in range(count):
        layout = re.sub(r"\[([^\]]*)\]\*", lambda m: m.group(1) * rng.choice((0, 1, 2, 3, 5, 9)), LAYOUTS[i % len(LAYOUTS)])
        seen: list[tuple[str, int]] = []

        def filled(m: re.Match, seen: list = seen) -> str:
            kind = m.group(1)
            if kind == "k":
                text = words(rng.randint(1, 3))
            elif kind == "x":
                text = (words(rng.choice((1, 3, 6, 15, 40))) + rng.choice(("", ".", ". All rights reserved", "."))).strip()
            else:
                text = words(rng.choice((1, 4, 8, 20, 60, 120))).capitalize() + rng.choice((".", ".", "", "!"))
            seen.append((text, int(kind == "a")))
            return text

        out.append((f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head>{re.sub(r'{([axk])}', filled, layout)}", seen))
    return out


@lru_cache(1)
def trained() -> Field:
    pages = []
    for page, texts in labelled_pages():
        found = blocks(page)
        labels, at = [], 0
        for text, _, _ in found:  # the block's label is that of the first filled text in it
            while at < len(texts) and texts[at][0] not in text:
                at += 1
            labels.append(texts[at][1] if at < len(texts) else 0)
        pages.append(([features(b, i, len(found)) for i, b in enumerate(found)], labels))
    return train(pages)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    labels = field.decode([features(b, i, len(found)) for i, b in enumerate(found)])
    return "\n\n".join(b[0] for b, y in zip(found, labels, strict=False) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in held(batch, "html"):
                texts = [main_text(p, field) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def log_likelihood(field: Field, rows: list[list[str]], labels: list[int]) -> float:
    """log P(labels | blocks), by listing every labelling; for tests on short pages."""
    def weight(ys):
        s = sum(field.difference.get(f, 0.0) for r, y in zip(rows, ys, strict=True) if y for f in r)
        return s + sum(field.pair[a, b] for a, b in zip(ys, ys[1:], strict=False))

    every = [[(k >> i) & 1 for i in range(len(rows))] for k in range(1 << len(rows))]
    return weight(labels) - math.log(sum(math.exp(weight(y)) for y in every))
