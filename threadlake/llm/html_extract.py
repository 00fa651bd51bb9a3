"""Main text of web pages by wrapper induction: pages of one host are aligned by simple tree matching."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threadlake.llm.common import packed, prepared
from threadlake.session import materialize

#: A table of pivot pages or templates up to this size is broadcast; a larger one is joined on the host.
BROADCAST_BYTES = 32 << 20
#: Different titles a constant text must be seen with, and its share of them, to be template.
MIN_TITLES, MIN_SHARE = 5, 0.5
#: Elements nested deeper are placed beside each other; no text is lost.
DEPTH = 200
#: Sizes of matchings that an alignment remembers; what is beyond is counted again.
KNOWN = 1 << 18

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg math xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split())
#: An opening tag ends open elements of these kinds, up to the nearest of the limits.
IMPLIED = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
    "tbody": ("tr td th thead tbody tfoot", ("table",)), "thead": ("tr td th thead tbody tfoot", ("table",)), "tfoot": ("tr td th thead tbody tfoot", ("table",)),
}
IMPLIED = {tag: (frozenset(ends.split()), frozenset(limits)) for tag, (ends, limits) in IMPLIED.items()}
APART_TAGS = frozenset("nav aside footer form button select input object canvas dialog menu audio video map datalist".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class and id names that mark what is not the article.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promoted promotion banner sidebar sidebars "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup "
    "signin login share sharing social related recommended recommendations widget widgets toolbar pagination pager search skip copyright".split())
#: Those of them that are meant whatever an element holds; the others may stand in the name of a wrapper of the article.
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promoted promotion comment comments disqus "
    "reply replies respond discussion cookie cookies consent gdpr newsletter popup modal nav navbar navigation breadcrumb breadcrumbs".split())
#: Words that make a header that of an article.
ENTRY_WORDS = frozenset("entry post article story".split())
ARTICLE_WORDS = frozenset("content article post entry story main articlebody".split())
MARKUP = re.compile(
    r"""<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|[!?/][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "rest", "parent", "parts", "depth", "shape", "size", "number")

    def __init__(self, tag: str, rest: str, parent: "Node | None"):
        self.tag, self.rest, self.parent, self.parts = tag, rest, parent, []
        self.depth = parent.depth + 1 if parent is not None else 0
        self.shape, self.size, self.number = 0, 1, -1

    def elements(self) -> list["Node"]:
        return [x for x in self.parts if isinstance(x, Node)]


def parse(source: str) -> tuple[Node, str]:
    """The tree of a page, however broken its markup, and its title."""
    root = Node("html", "", None)
    at, here, title = 0, root, ""
    end = len(source)
    while at < end:
        m = MARKUP.search(source, at)
        if m is None:
            tail = source[at:]
            cut = re.search(r"<[a-zA-Z/!][^<]*\Z", tail)
            here.parts.append(tail[:cut.start()] if cut else tail)
            break
        if m.start() > at:
            here.parts.append(source[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            inside = source[at:close.start()] if close else source[at:]
            if tag == "title" and not title:
                title = " ".join(html.unescape(inside).split())
            at = close.end() if close else end
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                root.rest += " " + m["rest"]
            continue
        if tag in CLOSES_P:
            up = here
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        elif tag in IMPLIED:
            ends, limits = IMPLIED[tag]
            up, found = here, None
            while up is not None and up.tag not in limits:
                if up.tag in ends:
                    found = up
                up = up.parent
            if found is not None:
                here = found.parent
        node = Node(tag, m["rest"], here)
        here.parts.append(node)
        if tag not in VOID and not m["rest"].endswith("/") and node.depth < DEPTH:
            here = node
    return root, title


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack.extend(reversed(node.elements()))
    return out


def shape(nodes: list[Node]) -> None:
    """Fingerprint of the element structure below each node, and nothing of its text, and the number of its elements."""
    for node in reversed(nodes):
        inside = node.elements()
        node.shape = hash((node.tag, tuple(x.shape for x in inside)))
        node.size = 1 + sum(x.size for x in inside)


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(node.rest)} if node.rest.strip(" /") else {}


def names(found: dict[str, str]) -> set[str]:
    text = found.get("class", "") + " " + found.get("id", "")
    return set(NAME.findall(CAMEL.sub(" ", text).lower())) if text != " " else set()


def is_apart(node: Node, in_article: bool) -> int:
    """Menu, header, footer, sidebar, notice, advert, form, comments: 2 by element, role or sure name, 1 by another name."""
    if node.tag in APART_TAGS or (node.tag == "header" and not in_article):
        return 2
    found = attributes(node)
    if not found:
        return 0
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return 2
    if found.get("role", "").lower() in APART_ROLES:
        return 2
    named = names(found)
    marks = named & APART_WORDS
    if node.tag in ("main", "article") or (node.tag == "header" and in_article) or node.tag in ("h1", "h2", "h3"):
        marks &= {"comment", "comments", "reply", "sponsored", "related", "ad", "ads"}
    if in_article or named & ENTRY_WORDS:
        marks = marks - {"header"}
    return 2 if marks & SURE_WORDS else int(bool(marks))


class Block:
    """Text with its element, characters in links, whether it is surely apart, regions around it, and elements apart by name."""

    __slots__ = ("node", "text", "linked", "apart", "owners", "named")

    def __init__(self, node, text, linked, apart, owners, named):
        self.node, self.text, self.linked, self.apart, self.owners, self.named = node, text, linked, apart, owners, named


def blocks(root: Node) -> list[Block]:
    """Runs of text between block elements, in page order."""
    out: list[Block] = []
    run: list[str] = []
    linked = 0

    def close(state):
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            out.append(Block(state[0], text, linked, state[1], state[3], state[4]))
        run.clear()
        linked = 0

    # (block element, apart, in a link, enclosing article or main elements, enclosing elements that are apart by name)
    stack: list = [("open", root, (root, False, False, (), ()))]
    while stack:
        kind, item, state = stack.pop()
        if kind == "text":
            run.append(item)
            if state[2]:
                linked += len(item.strip())
        elif kind == "close":
            close(state)
        elif item.tag in INLINE:
            if item.tag == "br":
                run.append("\n")
            inner = state if item.tag != "a" else (*state[:2], True, *state[3:])
            if is_apart(item, bool(state[3])):
                continue
            for part in reversed(item.parts):
                stack.append(("text", part, inner) if isinstance(part, str) else ("open", part, inner))
        else:
            if item is not root:
                close(state)
                owners = state[3]
                if item.tag in ("article", "main") or (item.rest and is_region(item)):
                    owners = (*owners, item)
                level = is_apart(item, bool(state[3]))
                inner = (item, state[1] or level == 2, state[2], owners, (*state[4], item) if level == 1 else state[4])
            else:
                inner = state
            stack.append(("close", None, inner))
            for part in reversed(item.parts):
                stack.append(("text", part, inner) if isinstance(part, str) else ("open", part, inner))
    return out


def is_region(node: Node) -> bool:
    found = attributes(node)
    return found.get("role", "").lower() in ("main", "article") or "articlebody" in found.get("itemprop", "").lower() or (
        node.tag in ("div", "section", "td") and bool(names(found) & ARTICLE_WORDS) and not names(found) & APART_WORDS)


def align(page: Node, pivot: Node) -> dict[int, int]:
    """Page node number to pivot node number by simple tree matching.

    The largest matching that keeps order and parents, whatever the length of the child lists.  Subtrees of one shape match as
    they are; equal ends of two child lists are matched before the table over the rest is filled.  Time grows with the
    product of two lists; memory with the longer one and a root of the other, as only some rows of a table are kept and
    the ones between are filled again on the way back.
    """
    known: dict[tuple[int, int], int] = {}

    def inner(a: Node, b: Node) -> tuple[list[Node], list[Node], list[tuple[Node, Node]]]:
        """Child lists without their equal ends, and the pairs of those."""
        left, right = a.elements(), b.elements()
        short, low, high = min(len(left), len(right)), 0, 0
        while low < short and left[low].shape == right[low].shape:
            low += 1
        while high < short - low and left[-1 - high].shape == right[-1 - high].shape:
            high += 1
        ends = [*zip(left[:low], right[:low]), *zip(left[len(left) - high:], right[len(right) - high:])]
        return left[low:len(left) - high], right[low:len(right) - high], ends

    def size(a: Node, b: Node) -> int:
        """Pairs of the largest matching of two subtrees."""
        if a.tag != b.tag:
            return 0
        if a.shape == b.shape:
            return a.size
        key = (a.shape, b.shape)
        if key not in known:
            left, right, ends = inner(a, b)
            total = 1 + sum(x.size for x, _ in ends)
            if left and right:
                for row in filled(left, right, {}, np.zeros(len(right) + 1, np.int32)):
                    pass
                total += int(row[-1])
            if len(known) >= KNOWN:
                known.clear()
            known[key] = total
        return known[key]

    def filled(left: list[Node], right: list[Node], lines: dict[int, np.ndarray], row: np.ndarray):
        """Rows of the table after ``row``, one a node of ``left``: sizes for the first nodes of ``right``."""
        kinds = {y.shape: y for y in right}
        places = {shape: i for i, shape in enumerate(kinds)}
        codes = np.fromiter((places[y.shape] for y in right), np.int64, len(right))
        for x in left:
            if x.shape not in lines:
                if len(lines) * len(right) >= KNOWN:
                    lines.clear()
                lines[x.shape] = np.array([size(x, y) for y in kinds.values()], np.int32)[codes]
            before, row = row, np.zeros_like(row)
            np.maximum.accumulate(np.maximum(before[1:], before[:-1] + lines[x.shape]), out=row[1:])
            yield row

    def chosen(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """Pairs of two child lists in the largest matching."""
        step, lines = math.isqrt(len(left)) + 1, {}
        kept = [np.zeros(len(right) + 1, np.int32)]
        kept.extend(row for i, row in enumerate(filled(left, right, lines, kept[0]), 1) if i % step == 0)
        pairs, i, j = [], len(left), len(right)
        while i and j:
            start = (i - 1) // step * step
            rows = [kept[start // step], *filled(left[start:i], right, lines, kept[start // step])]
            while i > start and j:
                here, above = rows[i - start], rows[i - start - 1]
                if here[j] == above[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((left[i], right[j]))
        return pairs

    out: dict[int, int] = {}
    stack = [(page, pivot)]
    while stack:
        a, b = stack.pop()
        out[a.number] = b.number
        if a.shape == b.shape:
            stack.extend(zip(a.elements(), b.elements()))
            continue
        left, right, ends = inner(a, b)
        stack.extend(ends)
        if left and right:
            stack.extend(chosen(left, right))
    return out


def read(source: str):
    root, title = parse(source)
    nodes = preorder(root)
    shape(nodes)
    return root, title, blocks(root)


def outside_names(kept: list[Block]) -> list[Block]:
    """Blocks outside elements that are apart by name.

    A name does not count where it is that of a wrapper: of an element around the article or main element that holds at
    least half of the text, when no other such element stands free.  Names never empty a page.
    """
    free = [b for b in kept if not b.named]
    strong = lambda part: [x for b in part for x in b.owners if x.tag in ("article", "main")]
    if not strong(free):
        held: dict[int, int] = {}
        known = {}
        for b in kept:
            for owner in strong([b]):
                held[owner.number] = held.get(owner.number, 0) + len(b.text)
                known[owner.number] = owner
        if held:
            largest = max(held, key=held.get)
            if 2 * held[largest] >= sum(len(b.text) for b in kept):
                around, node = set(), known[largest]
                while node is not None:
                    around.add(node.number)
                    node = node.parent
                free = [b for b in kept if all(x.number in around for x in b.named)]
    return free or kept


def main_text(found: list[Block], template: set[int]) -> str:
    """Blocks of the article; ``template`` has the places of blocks that are constant for the host."""
    open_ = outside_names([b for i, b in enumerate(found) if not b.apart and i not in template])
    regions: OrderedDict[int, list[Block]] = OrderedDict()
    kinds: dict[int, Node] = {}
    for b in open_:
        for owner in b.owners:
            regions.setdefault(owner.number, []).append(b)
            kinds[owner.number] = owner
    size = lambda part: sum(len(b.text) for b in part)
    total = size(open_)
    chosen: list[Block] = []
    articles = {k: v for k, v in regions.items() if kinds[k].tag == "article"}
    mains = {k: v for k, v in regions.items() if kinds[k].tag == "main"}
    if articles:
        largest = max(size(v) for v in articles.values())
        keep = {id(b) for v in articles.values() if 2 * size(v) >= largest for b in v}
        chosen = [b for b in open_ if id(b) in keep]
    if not chosen and mains:
        chosen = max(mains.values(), key=size)
    if not chosen and regions:
        best = [v for v in regions.values() if 2 * size(v) >= total]
        if best:
            chosen = min(best, key=size)
    if not chosen:
        chosen = [b for b in open_ if 2 * b.linked <= len(b.text)]
    return "\n\n".join(b.text for b in chosen)


class Pivots:
    """Parsed pivot pages a worker has used last."""

    def __init__(self):
        self.held: OrderedDict[str, tuple] = OrderedDict()

    def of(self, host: str, source: str):
        if host not in self.held:
            if len(self.held) >= 256:
                self.held.popitem(last=False)
            self.held[host] = read(source)
        self.held.move_to_end(host)
        return self.held[host]


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _places(found: list[Block], placed: dict[int, int]):
    """(place in the page, pivot place) of the blocks whose parent has a partner: the partner and the block's tag.

    Children that look alike can be matched in several ways, their parent can't; so a constant text counts anywhere in it.
    """
    for i, b in enumerate(found):
        partner = placed.get((b.node.parent or b.node).number)
        if partner is not None:
            yield i, partner * 4096 + zlib.crc32(b.node.tag.encode()) % 4096


def extract_pages(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    r"""Every page with its main text: ``doc`` (the input columns without the html) and ``text``.

    The tree of each page is aligned with that of its host's pivot page by simple tree matching.  A text that stands at
    one place of the pivot (an element, and the tag in it) in at least half of the host's pages that have the place
    (counted by different titles, five at least) is template; what varies is content.  Of the content, the article is kept: blocks inside article or main regions,
    or else those that are not mostly links, without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments.  Elements that are apart by their name only vote too, and the name does not count where it
    is that of a wrapper around the article or would leave a page empty (``outside_names``).  Character references are decoded, white space in a block becomes one space, blocks
    are joined in page order by two \n.

    * null and empty html, and pages without such text, give the empty string;
    * a null or hostless url belongs to the nameless host; repeated rows stay repeated and vote once;
    * long pages are read whole; an empty table gives an empty table; other columns may have any name.

    A host's pivot is one page, so a host with a third of all pages costs one small row; votes are added up before they
    are shuffled.  Pivots and templates are broadcast up to ``BROADCAST_BYTES`` and joined beyond.
    """
    prepared(pages.sparkSession)
    rows = packed(pages, (html_column,), html=html_column, url=url_column).withColumn("host", F.lower(F.regexp_extract(
        F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))).withColumn("html", F.coalesce("html", F.lit(""))).drop("url")

    def beside(table: DataFrame, size) -> DataFrame:
        return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table

    # any page can be the pivot; the choice must only be the same in every run
    order = F.struct(F.xxhash64("html"), F.length("html"))
    pivots = materialize(rows.where("html <> ''").groupBy("host").agg(F.min_by("html", order).alias("pivot")), "pivots")
    pivots = beside(pivots, F.length("pivot") + F.length("host"))

    def votes(batches):
        held = Pivots()
        for batch in batches:
            seen = set()
            for host, source, pivot in zip(*(batch.column(x).to_pylist() for x in ("host", "html", "pivot"))):
                root, title, found = read(source)
                vote = _digest(title or (found[0].text if found else ""))
                for i, place in _places(found, align(root, held.of(host, pivot)[0])):
                    if not found[i].apart:
                        seen.add((host, place, _digest(found[i].text), vote))
            if seen:
                columns = list(zip(*seen))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["host", "place", "content", "vote"])

    cast = rows.where("html <> ''").join(pivots, "host").select("host", "html", "pivot").mapInArrow(votes, "host string, place long, content long, vote long").distinct()
    cast = materialize(cast, "votes")
    there = cast.groupBy("host", "place").agg(F.countDistinct("vote").alias("all"))
    constant = cast.groupBy("host", "place", "content").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TITLES)
    constant = constant.join(there, ["host", "place"]).where(F.col("n") >= F.col("all") * MIN_SHARE)
    template = materialize(constant.groupBy("host").agg(F.collect_list(F.struct("place", "content")).alias("template")), "template")
    template = beside(template, F.size("template") * 16 + 16)

    def extract(batches):
        held = Pivots()
        for batch in batches:
            texts = []
            for host, source, pivot, constant in zip(*(batch.column(x).to_pylist() for x in ("host", "html", "pivot", "template"))):
                if not source:
                    texts.append("")
                    continue
                root, _, found = read(source)
                gone = set()
                if constant:
                    known = {(x["place"], x["content"]) for x in constant}
                    gone = {i for i, place in _places(found, align(root, held.of(host, pivot)[0])) if (place, _digest(found[i].text)) in known}
                texts.append(main_text(found, gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    joined = rows.join(template, "host", "left")
    # a page's pivot is only needed where its host has a template
    joined = joined.join(pivots.join(template.select("host"), "host", "left_semi"), "host", "left").select("doc", "host", "html", "pivot", "template")
    return joined.mapInArrow(extract, T.StructType([rows.schema["doc"], T.StructField("text", T.StringType())]))
