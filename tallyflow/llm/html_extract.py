"""Main-text extraction with a tree-structured graphical model.

Each block element of a page is a node with a binary variable (main content or
not). Unary potentials come from the tag, class and id tokens, text length, link
density and punctuation; pairwise potentials connect parent and child. One
upward and one downward sum-product pass give exact marginals, and a block is
kept where the marginal of its node exceeds one half. Weights are learned by
maximum likelihood, with the same passes, from labelled pages: a generator
writes pages in many layouts whose main parts are marked (``data-main``). The
mark is read only in training.

Pages are handled in Arrow batches, row by row independent, so nothing is
shuffled; messages of all pages in a batch are passed level by level in numpy.

Defined cases: null and empty html give an empty text; a truncated page is read
as far as it goes, an unended script or style reaches to the page's end; elements that are
self-closing, or have no end tag further on, hide no text after them; drawings, players,
buttons and lists of choices are no text, formulas and the text of objects are; white space is what ``str.split`` removes, so no-break spaces
count; character references that are not complete stay as they are; repeated
rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never markup nor text of the page.
RAW = frozenset("script style template iframe title textarea xmp noembed noframes".split())
#: Without an end tag the rest of the page is code.
CODE = frozenset("script style".split())
#: Their content is markup but no text of the page.
DEAD = frozenset("svg canvas video audio select button annotation annotation-xml".split())
#: Of these, the ones that a block's start tag ends.
LEFT = frozenset("svg select button".split())
#: They neither break a block nor make a node.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of these ends an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An open element of the second kind ends where one of the first kind starts.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table html body div section article".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())

#: Comments, declarations, tags, tags with a quote that never ends, and a tag cut off by the page's end.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")

TABLE = 1 << 14


@dataclass
class Page:
    """Nodes in document order (a parent before its children) and blocks of text."""

    tags: list[str] = field(default_factory=lambda: [""])
    marks: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links
    truth: list[int] = field(default_factory=lambda: [0])


def parse(html: str | None, labelled: bool = False) -> Page:
    """Elements and text blocks of a page; tolerant of unclosed and stray tags."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]  # open elements, each with its nearest block node
    texts: list[str] = []
    links, link_chars, dead, at, html = 0, 0, 0, 0, html or ""
    ignored: dict[str, int] = {}  # open elements inside a dead one

    last_end: dict[str, int] = {}  # of a dead element's tag

    def has_end(tag: str) -> bool:
        """Whether the page has an end tag for it further on; without one nothing after it is hidden."""
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s/>]", html, re.I)), default=-1)
        return last_end[tag] >= at

    def flush() -> None:
        nonlocal link_chars
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            texts.clear()
            if text:
                page.blocks.append((stack[-1][1], text, min(link_chars, len(text))))
        link_chars = 0

    def close(depth: int) -> None:
        nonlocal links, dead
        if any(t not in INLINE and t not in DEAD for t, _ in stack[depth:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[depth:])
        dead -= sum(t in DEAD for t, _ in stack[depth:])
        if not dead:
            ignored.clear()
        del stack[depth:]

    def nearest(tags, within=frozenset()) -> int | None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return depth
            if stack[depth][0] in within:
                return None
        return None

    while True:
        match = _TAG.search(html, at)
        text = html[at : match.start()] if match else html[at:]
        if text and not dead:
            texts.append(text)
            if links:
                link_chars += len(text)
        if not match:
            break
        at = match.end()
        ending, name, rest = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if name is None:
            continue
        tag = name.lower()
        if ending:
            if ignored.get(tag):
                ignored[tag] -= 1
            elif depth := nearest((tag,)):
                close(depth)
            continue
        closed = rest.endswith("/")
        if tag in RAW:
            if not (closed and tag not in CODE):
                end = re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I).search(html, at)
                at = end.end() if end else len(html) if tag in CODE else at
            if not dead:
                texts.append(" ")
            continue
        if dead and tag not in INLINE and tag not in DEAD and tag not in VOID:
            depth = nearest(DEAD)
            if stack[depth][0] not in LEFT:
                ignored[tag] = ignored.get(tag, 0) + 1
                continue
            if tag in CLOSES_P or tag in SIBLINGS and tag != "option":
                close(depth)
            else:  # a part of the drawing or the list of choices
                if not closed:
                    ignored[tag] = ignored.get(tag, 0) + 1
                continue
        if tag in DEAD:
            if not dead:
                texts.append(" ")
            if not closed and (tag in LEFT or has_end(tag)):
                stack.append((tag, stack[-1][1]))
                dead += 1
            continue
        if dead and tag in VOID:
            continue
        if tag in INLINE:
            if tag == "br":
                texts.append(" ")
            if tag not in VOID and not (closed and tag in ("math", "object")):
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
            continue
        if tag in CLOSES_P and (depth := nearest(("p",), SCOPES)):
            close(depth)
        if tag in SIBLINGS and (depth := nearest(SIBLINGS[tag], SCOPES)):
            close(depth)
        flush()
        if tag in VOID:
            continue
        parent = stack[-1][1]
        if tag == "noscript":  # its text is its parent's
            stack.append((tag, parent))
            continue
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        page.tags.append(tag)
        page.marks.append(" ".join(found.get(k, "") for k in ("class", "id", "role")) if found else "")
        page.parents.append(parent)
        if labelled:
            page.truth.append(int(found["data-main"]) if "data-main" in found else page.truth[parent])
        stack.append((tag, len(page.tags) - 1))
    flush()
    return page


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % TABLE


@lru_cache(maxsize=50_000)
def _element_features(tag: str, marks: str, parent: str) -> tuple[int, ...]:
    out = [_number(f"t{tag}"), _number(f"p{parent}>{tag}")]
    out += [_number(f"m{t}") for t in set(_TOKEN.findall(marks))]
    return tuple(out)


@lru_cache(maxsize=50_000)
def _text_features(size: int, share: int, stops: int, depth: int, tag: str) -> tuple[int, ...]:
    return _number(f"n{size}"), _number(f"l{share}"), _number(f"n{size}l{share}"), _number(f"s{stops}"), _number(f"d{depth}"), _number(f"l{share}{tag}")


@dataclass
class Forest:
    """The nodes of many pages side by side."""

    first: list[int]
    parents: np.ndarray
    depths: np.ndarray
    kinds: np.ndarray
    owner: np.ndarray
    feature: np.ndarray

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        first, parents, depths, kinds, owner, feature = [], [], [], [], [], []
        for page in pages:
            base, n = len(parents), len(page.tags)
            first.append(base)
            chars, linked, stops = [0] * n, [0] * n, [0] * n
            for node, text, in_links in page.blocks:
                chars[node] += len(text)
                linked[node] += in_links
                stops[node] += text.count(".") + text.count(",")
            for i in range(n - 1, 0, -1):
                p = page.parents[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                stops[p] += stops[i]
            for i, (tag, marks, p) in enumerate(zip(page.tags, page.marks, page.parents, strict=True)):
                depth = 0 if p < 0 else depths[base + p] + 1
                parents.append(base + p if p >= 0 else -1)
                depths.append(depth)
                kinds.append(int(tag in TEXTUAL))
                own = _element_features(tag, marks, page.tags[p] if p >= 0 else "")
                own += _text_features(min(10, chars[i].bit_length()), 5 * linked[i] // (chars[i] + 1), min(8, stops[i].bit_length()), min(depth, 8), tag)
                owner += [base + i] * len(own)
                feature += own
        return Forest(first, np.array(parents, np.int64), np.array(depths, np.int64), np.array(kinds, np.int64), np.array(owner, np.int64), np.array(feature, np.int64))


@dataclass
class Weights:
    unary: np.ndarray = field(default_factory=lambda: np.zeros(TABLE))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))  # kind of child, parent's state, child's state


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))


def sum_product(forest: Forest, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for each node, and of (parent, child) states for each edge."""
    n = len(forest.parents)
    inner = np.zeros((n, 2))
    inner[:, 1] = np.bincount(forest.owner, weights.unary[forest.feature], minlength=n)
    pair = weights.pair[forest.kinds]
    order = np.argsort(forest.depths, kind="stable")
    bounds = np.searchsorted(forest.depths[order], np.arange(forest.depths.max() + 2)) if n else np.array([0, 0])
    levels = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    for level in levels[:0:-1]:
        up[level] = _log_sum(pair[level] + inner[level][:, None, :], 2)
        np.add.at(inner, forest.parents[level], up[level])
    for level in levels[1:]:
        p = forest.parents[level]
        above = inner[p] - up[level] + down[p]
        above -= above.max(axis=1, keepdims=True)
        down[level] = _log_sum(pair[level] + above[:, :, None], 1)
    belief = inner + down
    one = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
    child = forest.parents >= 0
    p = forest.parents[child]
    both = (inner[p] - up[child] + down[p])[:, :, None] + pair[child] + inner[child][:, None, :]
    both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
    return one, both / both.sum(axis=(1, 2), keepdims=True)


def train(pages: list[Page], rounds: int = 80) -> Weights:
    """Maximum likelihood by gradient steps with per-weight rates."""
    forest, weights = Forest.of(pages), Weights()
    truth = np.array([t for page in pages for t in page.truth])
    child = forest.parents >= 0
    kinds, n = forest.kinds[child], len(truth)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kinds, truth[forest.parents[child]], truth[child]), 1)
    unary_rate, pair_rate = np.full(TABLE, 1e-6), np.full((2, 2, 2), 1e-6)
    for _ in range(rounds):
        one, both = sum_product(forest, weights)
        unary = np.bincount(forest.feature, (truth - one)[forest.owner], minlength=TABLE) / n - 1e-6 * weights.unary
        pair = (seen - np.stack([both[kinds == k].sum(axis=0) for k in (0, 1)])) / n
        unary_rate += unary**2
        pair_rate += pair**2
        weights.unary += 0.3 * unary / np.sqrt(unary_rate)
        weights.pair += 0.3 * pair / np.sqrt(pair_rate)
    return weights


#: Share of the generator's pages whose article is not told by a tag or a known name.
OWN_NAMES = 0.5


def labelled_page(rng: random.Random) -> str:
    """One page in a random layout; parts of the article carry ``data-main="1"``."""

    def word() -> str:
        return "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(1, 10)))

    def sentence(least: int = 3, most: int = 18) -> str:
        return " ".join(word() + "," * (rng.random() < 0.1) for _ in range(rng.randint(least, most))).capitalize() + "."

    def prose(most: int = 6) -> str:
        out = " ".join(sentence() for _ in range(rng.randint(1, most)))
        if rng.random() < 0.15:
            out += f' <a href="/{word()}">{word()} {word()}</a> {sentence()}'
        return out + " &amp; more" * (rng.random() < 0.05)

    def named(tag: str, names: str, inner: str) -> str:
        name = rng.choice(names.split())
        name = rng.choice((name, f"{name} {word()}", f"{word()}-{name}", f"{name}-{rng.choice('box wrap area list 1'.split())}"))
        return f'<{tag} {rng.choice(("class", "id"))}="{name}">{inner}</{tag}>'

    def link_list(n: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>"

    def paragraph() -> str:
        draw = rng.random()
        if draw < 0.05:  # long text without punctuation, or one word again and again
            return f"<p>{' '.join([word()] * rng.randint(20, 400) if rng.random() < 0.5 else [word() for _ in range(rng.randint(20, 200))])}</p>"
        if draw < 0.1:  # a word or two
            return f"<p>{' '.join(word() for _ in range(rng.randint(1, 4)))}</p>"
        if draw < 0.6:
            return f"<p>{prose()}</p>"
        if draw < 0.7:
            return f"<p><b>{sentence()}<br>"
        if draw < 0.76:
            return f"<h{rng.randint(2, 4)}>{sentence(1, 6)}</h2>"
        if draw < 0.82:
            items = "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5)))
            return f"<{(tag := rng.choice(('ul', 'ol')))}>{items}</{tag}>"
        if draw < 0.86:
            return f"<blockquote><p>{prose(2)}</p></blockquote>"
        if draw < 0.89:
            return f"<pre>{sentence()}\n{sentence()}</pre>"
        if draw < 0.92:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        if draw < 0.95:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{prose(2)}</div>"

    def advert() -> str:
        return named(rng.choice(("div", "div", "aside", "section")), "ad ads advert advertisement sponsored sponsor promo promotion banner", rng.choice((prose(2), f"<p>{prose(2)}</p>", f'<a href="/x">{sentence()}</a>')))

    def notice() -> str:
        return named(rng.choice(("div", "section")), "notice cookie cookies consent alert gdpr popup modal subscribe newsletter", rng.choice((prose(2), f"<p>{prose(2)}</p>")))

    def form() -> str:
        return rng.choice((f'<form action="/{word()}"><label>{word()}</label><input name=q><p>{sentence()}</p></form>', named("div", "search login signup", f"<form><p>{sentence()}</p><input></form>")))

    def menu() -> str:
        return rng.choice((f"<nav>{link_list(rng.randint(3, 9))}</nav>", named("div", "nav menu navigation navbar breadcrumb breadcrumbs topbar", link_list(rng.randint(3, 9)))))

    def sidebar() -> str:
        inner = f"<h3>{sentence(1, 3)}</h3>" + rng.choice((link_list(rng.randint(2, 8)), f"<p>{prose(2)}</p>", f"<p>{prose(3)}</p><p>{prose(2)}</p>"))
        return rng.choice((f"<aside>{inner}</aside>", named("div", "sidebar side related recommended widget share social more trending popular", inner)))

    def comments() -> str:
        each = "".join(named("div", "comment reply", f"<p>{prose(3)}</p>") for _ in range(rng.randint(1, 5)))
        return rng.choice((named("section", "comments discussion responses", f"<h3>{sentence(1, 2)}</h3>{each}"), named("div", "comments discussion", each)))

    def header() -> str:
        inner = rng.choice((f"<h1>{sentence(1, 3)}</h1>", f"<p>{sentence(1, 5)}</p>", f'<a href="/">{word()}</a>')) + (menu() if rng.random() < 0.4 else "")
        return rng.choice((f"<header>{inner}</header>", named("div", "header masthead site-header top", inner)))

    def footer() -> str:
        inner = rng.choice((f"&copy; {word()}.example &middot; {prose(2)}", f"<p>&copy; {word()} {sentence()}</p>", link_list(4)))
        return rng.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", named("div", "footer bottom copyright legal", inner)))

    def extra() -> str:
        return rng.choice((advert, notice, form, menu, sidebar))()

    inside = [f"<h1>{sentence(1, 9)}</h1>"] * (rng.random() < 0.9) + [paragraph() for _ in range(rng.randint(1, 14))]
    for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
        part = rng.choice((advert, notice, form, sidebar))()
        inside.insert(rng.randint(0, len(inside)), re.sub(r"^<(\w+)", r'<\1 data-main="0"', part))
    body = "".join(inside)
    if rng.random() < 0.15:  # a page that is little more than its article
        parts = [paragraph() for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            return "".join(re.sub(r"^<(\w+)", r'<\1 data-main="1"', part) for part in parts)
        own = rng.choice(("", f' id="{word()}"', f' class="{word()}"'))
        form_of = rng.choice(('<article data-main="1">{}</article>', '<body><main data-main="1">{}</main></body>', '<body data-main="1">{}</body>', f'<div{own} data-main="1">{{}}</div>', f'<html><body><div{own}><div data-main="1">{{}}</div></div></body></html>'))
        return form_of.format(f"<h1>{sentence(1, 6)}</h1>" * (rng.random() < 0.4) + "".join(parts))
    draw = rng.random()
    if draw < 0.5:
        article = f'<article data-main="1">{body}</article>'
    elif draw < 0.6:
        article = f'<main><article data-main="1" class="{word()}">{body}</article></main>'
    elif draw < 0.7:
        article = f'<main data-main="1">{body}</main>'
    else:
        name = rng.choice("content post entry story article article-body post-content entry-content main-content text body-text".split())
        article = f'<{(tag := rng.choice(("div", "div", "section")))} {rng.choice(("class", "id"))}="{name}" data-main="1">{body}</{tag}>'
    layout = rng.random()
    if layout < OWN_NAMES:  # containers whose names say nothing, or none at all
        neutral = "wrap box area list inner outer wrapper container page".split()
        name = rng.choice(("", f' class="{word()}"', f' id="{word()}"', f' class="{word()} {word()}"', f' class="{rng.choice(neutral)}"'))
        article = f'<{(tag := rng.choice(("div", "div", "section", "td")))}{name} data-main="1">{body}</{tag}>'
        for _ in range(rng.choice((0, 1, 1, 2))):
            article = f'<div{rng.choice(("", f" id={word()}", f" class={word()}", f" class={rng.choice(neutral)}", f" id={rng.choice(neutral)}"))}>{article}</div>'
    before = [header()] * (rng.random() < 0.6) + [menu()] * (rng.random() < 0.7) + [extra() for _ in range(rng.randint(0, 2))]
    after = [extra() for _ in range(rng.randint(0, 2))] + [comments()] * (rng.random() < 0.5) + [footer()] * (rng.random() < 0.85)
    if rng.random() < 0.3:
        article = f'<div class="{rng.choice(("container", "wrapper", "page", "row", "layout"))}">{article}{sidebar() if rng.random() < 0.5 else ""}</div>'
    if layout < OWN_NAMES and rng.random() < 0.4:
        before, after = before[: rng.choice((0, 0, 1))], after[len(after) - rng.choice((0, 0, 1)) :]
    if layout < OWN_NAMES / 3:  # the article is what is left in the body, between its other parts
        before, after = ([re.sub(r"^<(\w+)", r'<\1 data-main="0"', part) for part in parts] for parts in (before[: rng.choice((0, 2, 9))], after[: rng.choice((0, 2, 9))]))
        return f"<html><head><title>{sentence()}</title></head><body data-main=\"1\">{''.join(before)}{body}{''.join(after)}</body></html>"
    if layout < OWN_NAMES / 2:  # columns of a table
        side = rng.choice((link_list(rng.randint(1, 6)), f'<a href="/">{word()}</a><br><a href="/{word()}">{word()}</a>', f'<a href="/">{word()}</a>'))
        cells = rng.choice((f"<td>{side}</td>{{}}", f"{{}}<td>{side}</td>")).format(f'<td data-main="1">{body}</td>')
        return f"<html><body>{''.join(before[:1])}<table><tr>{cells}</tr></table>{''.join(after[-1:])}</body></html>"
    return f"<!DOCTYPE html><html><head><title>{sentence()}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 11) -> Weights:
    rng = random.Random(seed)
    return train([parse(labelled_page(rng), labelled=True) for _ in range(pages)])


def main_texts(pages: list[Page], weights: Weights) -> list[str]:
    if not pages:
        return []
    forest = Forest.of(pages)
    one, _ = sum_product(forest, weights)
    return ["\n".join(text for node, text, _ in page.blocks if one[base + node] > 0.5) for base, page in zip(forest.first, pages, strict=True)]


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: Weights | None = None) -> DataFrame:
    """The ``keep`` columns with text and n_chars of each page."""
    bounded_batches(df.sparkSession, 500)
    shared = df.sparkSession.sparkContext.broadcast(weights or trained())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts([parse(h) for h in batch["__tf_html"].to_pylist()], shared.value)
        names = [n for n in batch.schema.names if n != "__tf_html"]
        return pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    slim = df.select(*keep, F.col(html_col).alias("__tf_html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(by_batch(run), f"{kept}, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
