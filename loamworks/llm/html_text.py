"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deviations of the fused ratios from which a path is content.
LEVEL = 0.5
#: Characters of text in one Arrow batch, about.
BATCH = 4 << 20

# Elements by role, and words of class, id and role that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select option textarea button datalist".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MARKED = frozenset(
    "ad ads adv advert advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments commentlist cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "outbrain pager pagination popup promo promotion related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toc toolbar widget complementary contentinfo".split()
)
#: Words that say nothing beside a marked one; any other word in a name means that it is about something else.
BESIDE = frozenset("area bar block body bottom box button buttons container count icons inner items left link links list main module outer page panel post posts primary right row secondary section site slot text title top unit user wrap wrapper".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p li dd dt blockquote pre td th figcaption caption summary".split()) | HEADING
LISTED = frozenset("ul ol dl li dt dd".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？।؟،")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Tree:
    """Elements by number, parents first: tag, parent, nearest block, path, depth, and whether something else than article text."""

    def __init__(self):
        self.tag, self.up, self.block, self.path, self.depth, self.hidden, self.marked = [""], [-1], [0], [0], [0], [False], [False]
        self.names: dict[tuple[int, str], int] = {}
        self.paths: list[tuple[int, str]] = [(-1, "")]

    def add(self, tag: str, up: int, name: str, hidden: bool, marked: bool) -> int:
        step = (self.path[up], name)
        if step not in self.names:  # a path is its parent's number and a name, so deep pages stay small
            self.names[step] = len(self.paths)
            self.paths.append(step)
        self.tag.append(tag)
        self.up.append(up)
        self.block.append(len(self.block) if tag in BLOCK else self.block[up])
        self.path.append(self.names[step])
        self.depth.append(self.depth[up] + 1)
        self.hidden.append(hidden or self.hidden[up])
        self.marked.append(marked or self.marked[up])
        return len(self.tag) - 1

    def path_name(self, path: int) -> str:
        steps = []
        while path > 0:
            path, name = self.paths[path]
            steps.append(name)
        return "/".join(reversed(steps))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def _hidden(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element shows no text of its page, or by its kind none of an article."""
    if tag in HIDDEN or tag in ASIDE:
        return True
    gone = "hidden" in attributes and attributes["hidden"].lower() != "until-found"
    return gone or attributes.get("aria-hidden", "").lower() == "true" or UNSEEN.search(attributes.get("style", "")) is not None


def _marked(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a name in class, id or role consists of words that mark what is no article."""
    if tag in ("html", "body", "article", "main"):
        return False
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if any(w in MARKED for w in words) and all(w in MARKED or w in BESIDE for w in words):
                return True
    return False


def blocks(html: str) -> tuple[_Tree, list[tuple[str, int, int]]]:
    """The page's elements, and its visible blocks in page order: (text, block element, characters inside links)."""
    tree = _Tree()
    node, out, parts, linked, links = 0, [], [], 0, 0
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append((text, tree.block[node], min(linked, len(text))))
        parts, linked = [], 0

    def pop(to: int) -> None:
        nonlocal node, links
        while node != tree.up[to]:
            tag = tree.tag[node]
            if tag in BLOCK:
                flush()
            links -= tag == "a"
            opened[tag] -= 1
            node = tree.up[node]

    def within(tags: tuple[str, ...], stop: frozenset | tuple) -> int | None:
        if not any(opened.get(t) for t in tags):
            return None
        at = node
        while at and tree.tag[at] not in stop:
            if tree.tag[at] in tags:
                return at
            at = tree.up[at]
        return None

    at = 0
    while at < len(html):
        m = TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece and not tree.hidden[node]:
            piece = unescape(piece)
            parts.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            found = within((tag,), () if tag in BLOCK else BLOCK)
            if found is not None:
                pop(found)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if (open_p := within(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "button"))) is not None and tag != "caption":
                pop(open_p)
        while tag in SAME and (same := within(SAME[tag], SCOPE[tag])) is not None:
            pop(same)
        attributes = _attributes(m[3])
        name = f"{tag}.{attributes.get('class', '').strip()}" if attributes.get("class") else tag
        node = tree.add(tag, node, name, _hidden(tag, attributes), _marked(tag, attributes))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            pop(node)
    while node:
        pop(node)
    flush()
    return tree, out


def path_ratios(tree: _Tree, found: list[tuple[str, int, int]]) -> dict[int, tuple[float, float]]:
    """Per root-to-leaf tag path of the blocks its fused ratio and the share of its text inside links.

    Text length and punctuation marks for each block of a path, smoothed over the paths next to it in the page's order
    of first use, are multiplied and weighed by the text outside links.
    """
    sums: dict[int, list[float]] = {}
    for text, node, linked in found:
        each = sums.setdefault(tree.path[node], [0, 0, 0, 0])
        each[0] += len(text)
        each[1] += sum(c in PUNCTUATION for c in text)
        each[2] += 1
        each[3] += linked
    table = np.array(list(sums.values()), float)
    smooth = lambda v: np.convolve(np.pad(v, 1, "edge"), [0.25, 0.5, 0.25], "valid") * 0.5 + v * 0.5
    linked = table[:, 3] / table[:, 0]
    fused = smooth(table[:, 0] / table[:, 2]) * (1 + smooth(table[:, 1] / table[:, 2])) * (1 - linked)
    return {p: (float(x), float(y)) for p, x, y in zip(sums, fused, linked, strict=True)}


def content_paths(ratios: dict[int, tuple[float, float]]) -> set[int]:
    """Paths whose fused ratio is LEVEL deviations or more, the best one always."""
    fused = np.array([x for x, _ in ratios.values()])
    level = min(LEVEL * fused.std(), fused.max())
    return {p for p, (x, _) in ratios.items() if x >= level}


def _around(tree: _Tree, node: int) -> int:
    """The element that a block stands in, the lists around it left out."""
    node = tree.up[node]
    while tree.tag[node] in LISTED:
        node = tree.up[node]
    return node


def main_text(html: str) -> str:
    """The article of a page: blocks joined by line feeds; empty if there is none.

    Paths with a high ratio are content. The article's element is the innermost article or main element, else the
    innermost element, around the largest part of their text. In it the blocks on content paths are taken; of the
    others those on paths of links go, and those between content blocks stay. Before the first content block
    headings stay, and behind the last one lists that stand beside content; where an article or main element says so, short
    prose at either end stays too. Elements that a tag or name marks as something else don't count, unless nothing else is there.
    """
    tree, every = blocks(html)
    found = [b for b in every if not tree.marked[b[1]]] or every
    if not found:
        return ""
    ratios = path_ratios(tree, found)
    good = content_paths(ratios)
    mass, size = [0] * len(tree.tag), 0
    for text, node, _ in found:
        if tree.path[node] in good:
            mass[node] += len(text)
            size += len(text)
    for node in range(len(mass) - 1, 0, -1):
        mass[tree.up[node]] += mass[node]
    named = [n for n in range(len(mass)) if mass[n] and tree.tag[n] in ("article", "main")]
    if named:
        root = max(named, key=lambda n: (mass[n], tree.depth[n]))
    else:
        root = max((n for n in range(len(mass)) if mass[n] >= 0.75 * size), key=lambda n: tree.depth[n])
        while root and (tree.tag[root] not in BLOCK or tree.tag[root] in ("p", "li", "td", "tr", "tbody", "pre", "dd", "dt")):
            root = tree.up[root]
    inside = [False] * len(mass)
    for node in range(len(mass)):
        inside[node] = node == root or node > 0 and inside[tree.up[node]]
    own = [b for b in found if inside[b[1]]]
    taken = [i for i, (_, node, _) in enumerate(own) if tree.path[node] in good]
    beside = {_around(tree, own[i][1]) for i in taken}
    out = []
    for i, (text, node, _) in enumerate(own):
        path, tag = tree.path[node], tree.tag[node]
        if path not in good:
            if ratios[path][1] > 0.5 or not taken:
                continue
            edge = i < taken[0] or i > taken[-1]
            listed = tag in LISTED and i > taken[-1] and _around(tree, node) in beside
            if edge and not listed and not (tag in HEADING and i < taken[0]) and not (named and tag in PROSE):
                continue
        out.append(text)
    return "\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, size, first = [], 0, 0
        for i, html in enumerate(batch.column(0)):
            texts.append(main_text(html.as_py() or ""))
            size += len(texts[-1])
            if size >= BATCH or i + 1 == batch.num_rows:
                rest = [c.slice(first, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*batch.schema.names[1:], "__lw_text"])
                texts, size, first = [], 0, i + 1


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """pages (the columns named in keep, or all but html) with text and n_chars; columns of these two names are replaced.

    Null and empty pages, and pages of markup only, give empty text; all rows stay, repeated ones too. Long and deep
    pages are read whole, in time and memory that grow with their length.
    """
    names = list(keep if keep is not None else [c for c in pages.columns if c != html])
    names = [n for n in names if n not in ("text", "n_chars")]
    lean = pages.select(F.col(html).alias("__lw_html"), *names)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in lean.schema if f.name != "__lw_html")
    out = lean.mapInArrow(_extracted, f"{kinds}__lw_text string")
    return out.select(*names, F.col("__lw_text").alias("text"), F.length("__lw_text").cast("long").alias("n_chars"))


def digest(pages: DataFrame) -> DataFrame:
    """Per page page_id, url, text and n_chars (extract)."""
    return extract(pages, keep=("page_id", "url"))
