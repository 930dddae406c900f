"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of its block-level elements. Each node has features of its subtree (text and link density), its
attribute tokens and those of its ancestors, depth, position and siblings. The trees give each node the log odds that
its subtree holds main text. Decoding maximises the sum of log probabilities under one constraint, that nothing below a
dropped node is kept, by one bottom-up and one top-down pass, so ancestors and descendants never contradict each other.

The model is trained here, on pages that page_of() makes from a seed (articles with and without semantic tags, in boxes
or right in the body, alone or among menus, headers, footers, sidebars, notices, adverts, forms and comments); no row of
the input is used for it, so a page always gives the same text. Training is bounded by TRAIN_PAGES.

Text: character references decoded, scripts, styles and comments left out, white space within a block turned into one
space, blocks trimmed and joined by two line feeds in page order, nothing else dropped or capped; text that an attribute
hides from the eye is text like any other. Null and empty pages give an empty text, empty tables an empty result.
Repeated rows each give their text, so there are no ties. Pages of any length are read whole, in time proportional to it,
broken markup as far as it goes. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, SEED, TREES, DEPTH, RATE, BINS, COLUMNS = 1600, 7, 200, 4, 0.25, 32, 0.5

#: Elements by what they do to the text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
#: Where such an element has no end tag, what follows it is read on.
OPEN_RAW = frozenset("svg template noscript iframe noembed noframes".split())
CLOSES_P = BLOCKS - {"body", "html", "button", "label", "option", "select", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag ends an open element of the same group, up to its container.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "button", "body", "dl", "label")
INSIDE = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table")
#: Attribute tokens (class, id, role) by what they name.
TOKENS = {
    "content": "article content post entry main story text body page markdown prose blog news detail",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar tabs toc links skip",
    "head": "header masthead banner logo brand hero top sitename",
    "foot": "footer foot bottom copyright colophon legal contentinfo credits",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more complementary secondary teaser",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion dfp adsense banner300 outbrain taboola commercial",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread responses reader reviews",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription paywall message privacy warning toast",
    "form": "form search login signup signin register contact input field poll survey",
    "share": "share sharing social follow tools meta byline author tags tagcloud pagination pager prev next rating print",
}
GROUP = {t: g for g, ts in enumerate(TOKENS.values()) for t in ts.split()}
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: The rest of a tag, with ">" inside quotes; a page in which it fails FAILURES times is read without regard to quotes.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
FAILURES = 8
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Page:
    """Block-level nodes in page order: a parent comes before its children. blocks: (node, text) in page order."""

    __slots__ = ("tag", "parent", "groups", "blocks", "linked", "tags_in")

    def __init__(self) -> None:
        self.tag, self.parent, self.groups = ["#root"], [-1], [0]
        self.blocks: list[tuple[int, str]] = []
        self.linked: list[int] = []
        self.tags_in = [0]


def pieces(source: str) -> Iterator[tuple[str, str, str]]:
    """(text before, name, attributes) of each tag in order, the name with / in end tags; empty names for comments and
    the end. Each place of the source is looked at a bounded number of times."""
    at, look, failed, last, endless = 0, 0, 0, source.rfind(">"), set()
    while True:
        start = source.find("<", look)
        if start < 0 or start > last and not source.startswith("<!--", start):
            yield source[at:], "", ""
            return
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            yield source[at:start], "", ""
            if end < 0:
                return
            at = look = end + 3
            continue
        if source.startswith("<![CDATA[", start):
            yield source[at:start], "", ""
            at = look = start + 9
            continue
        if source.startswith(("<!", "<?"), start):
            yield source[at:start], "", ""
            at = look = source.find(">", start) + 1
            continue
        name = NAME.match(source, start + 1)
        if not name:
            look = start + 1
            continue
        end = None
        if failed < FAILURES:
            end = REST.match(source, name.end())
            failed += end is None
        stop = end.end() if end else source.find(">", name.end()) + 1
        if not stop:
            yield source[at:], "", ""
            return
        tag = name[0].lower()
        yield source[at:start], tag, source[name.end() : stop - 1]
        at = look = stop
        if tag in RAW and not source.endswith("/", name.end(), stop - 1):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(source, at) if tag not in endless else None
            if close:
                at = look = close.end()
            elif tag in OPEN_RAW:
                endless.add(tag)
            else:
                return


def parse(source: str | None) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # all open elements with their block node
    places: dict[str, list[int]] = {}  # of each open name
    blocks: list[int] = []  # places of open blocks
    run: list[str] = []
    link_chars, links = 0, 0

    def flush() -> None:
        nonlocal link_chars
        if run:
            text = SPACE.sub(" ", "".join(run)).strip()
            run.clear()
            if text:
                page.blocks.append((stack[-1][1], text))
                page.linked.append(min(link_chars, len(text)))
        link_chars = 0

    def last(names) -> int:
        """The innermost open element of these names; 0 if none is."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def pop_to(place: int) -> None:
        nonlocal links
        if blocks and blocks[-1] >= place:
            flush()
        for name, _ in stack[place:]:
            places[name].pop()
            links -= name == "a"
        del stack[place:]
        while blocks and blocks[-1] >= place:
            blocks.pop()

    for before, name, attributes in pieces(source or ""):
        if before:
            text = entities.unescape(before)
            run.append(text)
            if links:
                link_chars += len(text.strip())
        if not name:
            continue
        if name[0] == "/":
            place = last((name[1:],))
            if place and (name[1:] in BLOCKS or place > last(("table", "body"))):
                pop_to(place)
            continue
        if name in RAW:
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                run.append(" ")
            page.tags_in[stack[-1][1]] += 1
            continue
        if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            pop_to(blocks[-1])
        if name in SAME:
            same, within = SAME[name]
            outside, place = last(within), last(same)
            while place > outside:
                pop_to(place)
                place = last(same) if name == "tr" else 0
        node = stack[-1][1]
        page.tags_in[node] += 1
        if name in BLOCKS:
            flush()
            mask = 0
            for a in ATTRIBUTE.finditer(attributes):
                for token in WORD.findall((a[2] or a[3] or a[4] or "").lower()):
                    if token in GROUP:
                        mask |= 1 << GROUP[token]
            page.tag.append(name)
            page.parent.append(node)
            page.groups.append(mask)
            page.tags_in.append(0)
            node = len(page.tag) - 1
            blocks.append(len(stack))
        elif name == "a":
            links += 1
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node))
    flush()
    return page


_TAG = {t: i for i, t in enumerate(TAGS)}
_INSIDE = {t: i for i, t in enumerate(INSIDE)}
_PUNCTUATION = re.compile(r"[.,;:!?]")


def features(page: Page) -> np.ndarray:
    """A row per node."""
    n, g = len(page.tag), len(TOKENS)
    parent = page.parent
    own, chars, linked, marks, words, parts, tags = ([0.0] * n for _ in range(7))
    first = [math.inf] * n
    seen = 0
    for (node, text), link in zip(page.blocks, page.linked):
        own[node] += len(text)
        chars[node] += len(text)
        linked[node] += link
        marks[node] += len(_PUNCTUATION.findall(text))
        words[node] += text.count(" ") + 1
        parts[node] += 1
        first[node] = min(first[node], seen)
        seen += len(text)
    total = max(seen, 1)
    for i in range(n):
        tags[i] += page.tags_in[i]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for column in (chars, linked, marks, words, parts, tags):
            column[p] += column[i]
        first[p] = min(first[p], first[i])
    kids, kid_chars, kid_links = [0] * n, [0.0] * n, [0.0] * n
    place = [0] * n
    depth, up, inside, apart = [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        p = parent[i]
        place[i] = kids[p]
        kids[p] += 1
        kid_chars[p] += chars[i]
        kid_links[p] += linked[i]
        depth[i] = depth[p] + 1
        up[i] = up[p] | page.groups[p]
        apart[i] = apart[p] or page.tag[i] in ("nav", "footer", "aside", "form") or page.groups[i] > 1
        inside[i] = inside[p] | (1 << _INSIDE[page.tag[p]] if page.tag[p] in _INSIDE else 0)
    boxed = any(t in ("article", "main") or m & 1 for t, m in zip(page.tag, page.groups))  # content is the first group
    aside = math.log1p(sum(t in ("nav", "header", "footer", "aside", "form") or m > 1 for t, m in zip(page.tag, page.groups)))
    scalar = np.zeros((n, 20), np.float32)
    for i in range(n):
        p = max(parent[i], 0)
        c, k = chars[i], kids[p] or 1
        others = kid_chars[p] - c
        scalar[i] = (
            math.log1p(c), math.log1p(own[i]), linked[i] / (c + 1), math.log1p(tags[i]), c / (tags[i] + 1), marks[i] / (words[i] + 1), c / (words[i] + 1), math.log1p(parts[i]),
            min(depth[i], 30), k, place[i] / k, others / (k - 1 or 1), (kid_links[p] - linked[i]) / (others + 1), c / total, (first[i] if first[i] < math.inf else total) / total, kids[i], boxed, aside, apart[i], own[i] / (c + 1),
        )
    tag = np.zeros((n, 2 * len(TAGS)), np.float32)
    for i, t in enumerate(page.tag):
        if t in _TAG:
            tag[i, _TAG[t]] = 1
        above = page.tag[max(parent[i], 0)]
        if above in _TAG:
            tag[i, len(TAGS) + _TAG[above]] = 1
    bits = lambda values, k: ((np.array(values, np.int64)[:, None] >> np.arange(k)) & 1).astype(np.float32)
    return np.hstack([scalar, tag, bits(page.groups, g), bits(up, g), bits(inside, len(INSIDE))])


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict:
    """Gradient-boosted trees of fixed depth on the logistic loss, over histograms of at most BINS cuts a feature."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(d)]
    code = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]).astype(np.int64)
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score = np.full(n, base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, value = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, leaves), np.float32)
    draw = np.random.default_rng(SEED)
    for t in range(TREES):
        columns = np.sort(draw.choice(d, max(1, int(COLUMNS * d)), replace=False))
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width = 2**level
            best = np.full(width, 1e-6)
            pick = [(-1, 0)] * width
            for f in columns.tolist():
                b = len(cuts[f]) + 1
                if b < 2:
                    continue
                at = node * b + code[f]
                gs = np.bincount(at, grad, width * b).reshape(width, b)
                hs = np.bincount(at, hess, width * b).reshape(width, b)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < 1) | (ha - hl < 1)] = 0
                k = gain.argmax(1)
                for w in range(width):
                    if gain[w, k[w]] > best[w]:
                        best[w], pick[w] = gain[w, k[w]], (f, int(k[w]))
            right = np.zeros(n, np.int64)
            for w, (f, k) in enumerate(pick):
                if f >= 0:
                    feature[t, width - 1 + w], cut[t, width - 1 + w] = f, cuts[f][k]
                    mine = node == w
                    right[mine] = code[f][mine] > k
            node = node * 2 + right
        value[t] = RATE * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + 1)
        score += value[t][node]
    return {"base": base, "feature": feature, "cut": cut, "value": value}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    score, every = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"]):
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            at = node + 2**level - 1
            node = node * 2 + (x[every, feature[at]] >= cut[at])
        score += value[node]
    return score


def decode(parent: list[int], odds: list[float]) -> list[bool]:
    """Which nodes to keep: the best sum of log probabilities with nothing kept below a dropped node."""
    n = len(parent)
    keep = [-math.log1p(math.exp(-o)) if o > -30 else o for o in odds]
    drop = [-math.log1p(math.exp(o)) if o < 30 else -o for o in odds]
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] > drop[i]
    return kept


def extract(sources: list[str | None], model: dict) -> list[str]:
    """Main text of each page."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    odds = log_odds(model, np.vstack([features(p) for p in pages])).tolist()
    out, at = [], 0
    for page in pages:
        kept = decode(page.parent, odds[at : at + len(page.tag)])
        at += len(page.tag)
        out.append("\n\n".join(text for node, text in page.blocks if kept[node]))
    return out


def page_of(rng: random.Random) -> tuple[str, set[str]]:
    """A made page and the texts of its main blocks."""
    main: set[str] = set()
    serial = 0
    vowels, consonants = "aeiouéä", "bcdfghklmnprstvwzñß"
    noise = rng.random() < 0.2
    tail = rng.choice(["***", "###", " |", "!!"]) if noise else ""

    def word() -> str:
        return "".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        nonlocal serial
        serial += 1
        body = [word() + ("," if rng.random() < 0.08 else "") + (tail if rng.random() < 0.7 else "") for _ in range(rng.randint(a, b))]
        return f"{' '.join(body).capitalize()} q{serial}" + ("." if rng.random() < 0.8 else "")

    def of_main(tag: str, a: int, b: int, attributes: str = "") -> str:
        text = words(a, b)
        main.add(text)
        inner = text
        if rng.random() < 0.25:
            inner = f"<b>{text}<br>" if rng.random() < 0.5 else f"<b>{text}</b>"
        if rng.random() < 0.15:
            inner = f'<a href="/{word()}">{text}</a>'
        return f"<{tag}{attributes}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>")

    def named(*groups: str) -> str:
        if rng.random() < 0.04:
            return ""
        key = rng.choice(["class", "class", "id", "role"])
        tokens = [rng.choice(TOKENS[rng.choice(groups)].split()) for _ in range(rng.choice([1, 1, 2]))]
        return f' {key}="{rng.choice(["", "site-", "c-", ""])}{"-".join(tokens)}"'

    def link_list(k: int, a: int = 1, b: int = 2) -> str:
        links = "".join(f'<li><a href="/{word()}">{words(a, b)}</a></li>' for _ in range(k))
        return f"<ul>{links}</ul>" if rng.random() < 0.7 else "".join(f'<a href="/{word()}">{words(a, b)}</a> ' for _ in range(k))

    def prose(k: int) -> str:
        return "".join(f"<p>{words(4, 40)}</p>" for _ in range(k))

    def aside_part(kind: str) -> str:
        if kind == "nav":
            tag = rng.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{named('menu')}>{link_list(rng.randint(3, 9))}</{tag}>" if tag != "ul" else f"<div{named('menu')}>{link_list(rng.randint(3, 9))}</div>"
        if kind == "header":
            tag = rng.choice(["header", "div"])
            return f"<{tag}{named('head')}><{rng.choice(['div', 'h1', 'p', 'h2'])}>{words(1, 4)}</div>{link_list(rng.randint(0, 4))}</{tag}>".replace("</div>", "", 1)
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            body = words(3, 25) if rng.random() < 0.5 else prose(rng.randint(1, 3)) + link_list(rng.randint(0, 5))
            return f"<{tag}{named('foot') if tag == 'div' else ''}>&copy; {body}</{tag}>"
        if kind == "side":
            tag = rng.choice(["aside", "div", "section"])
            return f"<{tag}{named('side') if tag != 'aside' else rng.choice(['', named('side')])}><h3>{words(1, 3)}</h3>{link_list(rng.randint(2, 6), 2, 6)}{prose(rng.randint(0, 2))}</{tag}>"
        if kind == "note":
            box = rng.choice(["aside", "aside", "div"])
            return f"<{box}{named('side', 'notice') if box == 'aside' else named('notice') or ' class=note'}>{words(3, 30) if rng.random() < 0.4 else prose(rng.randint(1, 2))}</{box}>"
        if kind == "ad":
            tag = rng.choice(["div", "div", "aside", "section"])
            return f'<{tag} class="{rng.choice(TOKENS["ad"].split())}">{words(3, 25) if rng.random() < 0.6 else prose(rng.randint(1, 3))}</{tag}>'
        if kind == "notice":
            return f"<div{named('notice') or ' class=notice'}>{words(4, 30) if rng.random() < 0.5 else prose(rng.randint(1, 2))}{rng.choice(['', '<button>' + words(1, 1) + '</button>'])}</div>"
        if kind == "form":
            return f"<form{named('form', 'notice')}><label>{words(1, 4)}</label><input name=q>{rng.choice(['', '<p>' + words(4, 20) + '</p>'])}<button>{words(1, 2)}</button></form>"
        if kind == "comment":
            tag = rng.choice(["section", "div", "ol"])
            item = rng.choice(["div", "article", "li"]) if tag != "ol" else "li"
            each = "".join(f"<{item}{named('comment') or ' class=comment'}><p>{words(1, 2)}</p>{prose(rng.randint(1, 3))}</{item}>" for _ in range(rng.randint(1, 6)))
            return f"<{tag}{named('comment') or ' id=comments'}><h3>{words(1, 2)}</h3>{each}</{tag}>"
        return f"<div{named('share') or ' class=share'}>{link_list(rng.randint(2, 5))}</div>"

    def article() -> str:
        k = rng.choice([0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 4, 5, 8, 14])
        parts = [of_main(rng.choice(["h1", "h1", "h2"]), 1, 10)] if rng.random() < 0.85 else []
        if parts and rng.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(k):
            r = rng.random()
            if r < 0.74:
                short = rng.random() < 0.3
                parts.append(of_main("p", 1, 4) if short else of_main("p", 5, 90))
            elif r < 0.8:
                parts.append(of_main(rng.choice(["h2", "h3"]), 1, 6))
            elif r < 0.86:
                tag = rng.choice(["ul", "ol"])
                parts.append(f"<{tag}>{''.join(of_main('li', 1, 20) for _ in range(rng.randint(1, 6)))}</{tag}>")
            elif r < 0.9:
                parts.append(of_main(rng.choice(["blockquote", "pre"]), 4, 40))
            elif r < 0.93:
                parts.append(f"<table><tr>{''.join(of_main('td', 1, 5) for _ in range(rng.randint(1, 4)))}</tr></table>")
            elif r < 0.95:
                parts.append(f"<figure><img src=x>{of_main('figcaption', 2, 12)}</figure>")
            elif r < 0.97:
                parts.append(f"<section>{of_main('h3', 1, 5)}{of_main('p', 5, 50)}</section>")
            else:
                parts.append(f"<div>{of_main('p', 5, 50)}</div>")
            if rng.random() < 0.14:
                parts.append(aside_part(rng.choice(["ad", "ad", "side", "share", "form", "notice", "note", "note"])))
        body = "".join(parts)
        shape = rng.random()
        if shape < 0.4:
            return f"<article{rng.choice(['', named('content')])}>{body}</article>"
        if shape < 0.58:
            inner = rng.choice(["article", "div", "section", ""])
            return f"<main{rng.choice(['', named('content')])}>" + (f"<{inner}{named('content')}>{body}</{inner}></main>" if inner else f"{body}</main>")
        if shape < 0.8:
            named_box = f"<div{named('content') or ' class=content'}>{body}</div>"
            return named_box if rng.random() < 0.6 else f"<div><div>{named_box}</div></div>"
        return f"<div>{body}</div>" if shape < 0.86 else body

    before = [aside_part(k) for k in ("notice", "header", "nav", "ad", "share", "form") if rng.random() < {"nav": 0.85, "header": 0.5, "ad": 0.5}.get(k, 0.2)]
    after = [aside_part(k) for k in ("share", "side", "ad", "form", "comment", "nav", "footer") if rng.random() < {"footer": 0.85, "comment": 0.35, "side": 0.4}.get(k, 0.2)]
    if rng.random() < 0.2:
        rng.shuffle(before)
    if rng.random() < 0.2:  # the article and nothing else
        before, after = [], []
    body = "".join([*before, article(), *after])
    if rng.random() < 0.3:
        body = f"<div{rng.choice(['', ' id=wrapper', ' class=container'])}>{body}</div>"
    if rng.random() < 0.15:  # a fragment
        return body, main
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{body}" + rng.choice(["</body></html>", ""]), main


@functools.cache
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> dict:
    """The model, from so many made pages; the same each time."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, main = page_of(rng)
        page = parse(source)
        good = [False] * len(page.tag)
        for node, text in page.blocks:
            good[node] = good[node] or text in main
        for i in range(len(good) - 1, 0, -1):
            good[page.parent[i]] = good[page.parent[i]] or good[i]
        xs.append(features(page))
        ys.append(np.array(good, float))
    return fit_trees(np.vstack(xs), np.concatenate(ys))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): a row per page."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = extract(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
