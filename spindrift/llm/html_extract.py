"""Main text of web pages by equivalence-class template deduction.

A page is read into elements and texts.  Its tokens are the block elements, told
apart by the path of elements that they stand in (with a number among those of
one name that hold blocks themselves), and the texts with their path.  A token's
occurrence vector holds how often it occurs in each page of its host; tokens
with equal vectors form a class.  Vectors are never built: each (host, token)
keeps the sum of a hash of (page, count), which is aggregated before it is
shuffled, so neither a host nor a token is ever gathered into one task.

Classes that most pages of the host have are its template, where they are
valid: in a page, the stretches of two classes must lie apart or one within the
other.  What the template's elements hold are its slots, and they nest.  The
slot of the main text is found from the outside inwards: from an element to the
one of its slots that holds at least ``inner`` of its text over all pages of the
host (links don't count), as long as there is one, and as long as there are
links before it or anything behind it (text alone before it is a headline).  An
``article``, a ``main`` or an element with a headline isn't entered further.  On a page, the
texts in that slot are the main text, less those that are template themselves
(unless they are most of it: then the pages are copies of one another).

Hosts of fewer than ``least_pages`` pages, pages without a host and pages
without their host's slot are read alone: by an ``article`` or ``main`` element,
else by the container with the most text outside links.

Left out are elements that by name, class, id or role are menus, headers,
footers, sidebars, notices, adverts, forms or comments, hidden ones, scripts and
styles; headers within the article stay.

Character references are decoded; white space in a block (``br`` too) is one
space; blocks are joined by line feeds.  A null page is an empty one and its
text is empty.  Repeated pages get equal texts, whichever rows repeat; extra
columns are ignored; broken markup, open elements and cut pages are read as far
as they go, and a quote opens a value only behind an equals sign.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, written

#: One attribute: its name, then perhaps a value that is quoted, or runs to white space or the tag's end.
_ATTRIBUTE = r"[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+)?+"
PIECE = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*>?|</(?:[^a-zA-Z][^>]*)?>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)|([^\s/>=]++)")

#: Element names by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
LEFT_OUT = frozenset("head nav header footer aside form menu dialog button select option input fieldset".split())
MAIN = frozenset("article main".split())
HEADLINE = frozenset("h1 h2".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORD = r"(?:^|[\s_]|(?<!has)(?<!no)(?<!with)(?<!without)-)(?:{})(?:$|[\s_-])"
LEFT_OUT_CLASS = re.compile(
    _WORD.format(r"ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|sidebar|aside|widget\w*|nav\w*|menu\w*|breadcrumbs?|toolbar|topbar|pagination|pager|footer|comments?|commentlist|replies|reply|respond|disqus"),
    re.I,
)
HEADER_CLASS = re.compile(_WORD.format("masthead|header"), re.I)
LEFT_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


@dataclass
class Element:
    """A block element: the number of the one it stands in, and its step of the path."""

    parent: int
    step: str
    main: int
    blocks: int = 0  # block elements directly in it
    headline: bool = False  # one of them is a headline


@dataclass
class Text:
    """A stretch of text: its block's number, its element, and what it stands in."""

    block: int
    element: int
    words: str
    link: bool
    out: bool
    token: int = 0


@dataclass
class Page:
    """Elements and texts; ``order`` has a number for each, in the page's order (texts from ``~0`` downwards)."""

    elements: list[Element] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)  # hashes of numbered paths: the elements' tokens
    plain: list[int] = field(default_factory=list)  # hashes of paths without numbers


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if source.strip(" /"):
        for m in ATTRIBUTE.finditer(source):
            value = m[2] or ""
            found.setdefault((m[1] or m[3]).lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _hash(above: int, step: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), above)


def parse(source: str, by_class: bool = True) -> Page:
    """Elements and texts of a page, in order; with ``by_class`` elements are also left out by their class or id."""
    page = Page([Element(-1, "", 0)])
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # name, block element, left out, number of the main element
    opened: Counter = Counter()
    block, mains, at, blocks_open = 0, 0, 0, 0
    n = len(source)

    def close() -> str:
        nonlocal blocks_open
        name = stack.pop()[0]
        opened[name] -= 1
        blocks_open -= name in CLOSED_BY_BLOCK
        return name

    def add(words: str, link: bool) -> None:
        page.order.append(~len(page.texts))
        page.texts.append(Text(block, stack[-1][1], words, link, stack[-1][2]))

    while at < n:
        m = PIECE.match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[4] is not None and (text := entities.unescape(m[4])):
                add(text, opened["a"] > 0)
            continue
        name = name.lower()
        if m[1]:
            if opened[name] > 0:
                while close() != name:
                    pass
                block += name not in INLINE
            elif name not in INLINE:
                block += 1
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if name == "br":
            add(" ", False)
            continue
        attributes = _attributes(m[3])
        inline = name in INLINE
        if not inline:
            block += 1
            while len(stack) > 1 and (stack[-1][0] in CLOSED_BY_BLOCK or stack[-1][0] in INLINE and blocks_open > 0 or stack[-1][0] in SIBLINGS.get(name, ())):
                close()
        _, element, out, main = stack[-1]
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        role = attributes.get("role", "").lower()
        out = out or "hidden" in attributes or role in LEFT_OUT_ROLE or "display:none" in attributes.get("style", "").replace(" ", "").lower() or attributes.get("aria-hidden") == "true"
        if not out and name not in ("html", "body"):
            if name in MAIN:
                out = by_class and bool(re.search(r"comment|reply|teaser", marks, re.I))
            else:
                out = name in LEFT_OUT and not (name == "header" and main) or by_class and not inline and bool(marks.strip()) and bool(LEFT_OUT_CLASS.search(marks) or not main and HEADER_CLASS.search(marks))
        if not inline:
            if not out and not main and (name in MAIN or role == "main"):
                mains += 1
                main = mains
            above = page.elements[element]
            above.blocks += 1
            above.headline = above.headline or name in HEADLINE and not out
            element = len(page.elements)
            page.order.append(element)
            page.elements.append(Element(stack[-1][1], name + ("." + ".".join(sorted(attributes["class"].split())) if attributes.get("class") else ""), main))
        if name in VOID or m[3].rstrip().endswith("/") and name not in INLINE and not re.search(r"=\s*[^\s\"'>]*/\s*$", m[3]):
            continue
        stack.append((name, element, out, main))
        opened[name] += 1
        blocks_open += name in CLOSED_BY_BLOCK
    _name_tokens(page)
    return page


def _name_tokens(page: Page) -> None:
    """Hashes of the elements' paths and of the texts with their path."""
    page.paths, page.plain = [0], [0]
    number: Counter = Counter()
    for e in page.elements[1:]:
        above, step = page.paths[e.parent], e.step
        if e.blocks:
            number[above, step] += 1
            step = f"{step}#{number[above, step]}"
        page.paths.append(_hash(above, step))
        page.plain.append(_hash(page.plain[e.parent], e.step))
    for t in page.texts:
        if words := " ".join(t.words.split()):
            t.token = _hash(page.paths[t.element], "\x01" + words)


def tokens_of(page: Page) -> list[int]:
    """The page's tokens in order: elements and texts."""
    return [page.paths[k] if k >= 0 else page.texts[~k].token for k in page.order if k >= 0 or page.texts[~k].token]


def text_sizes(page: Page) -> list[int]:
    """Characters of text in each element, but for links and what is left out."""
    sizes = [0] * len(page.elements)
    for t in page.texts:
        if t.token and not t.link and not t.out:
            sizes[t.element] += len(t.words.strip())
    for k in range(len(sizes) - 1, 0, -1):
        sizes[page.elements[k].parent] += sizes[k]
    return sizes


def beside(page: Page) -> list[int]:
    """Characters of links before each element, and of any text behind it, within the element that it stands in."""
    n = len(page.elements)
    start, end = [0] * n, [0] * n
    text, links = [0], [0]
    for k in page.order:
        if k >= 0:
            start[k] = end[k] = len(text) - 1
        else:
            t = page.texts[~k]
            size = len(t.words.strip()) if not t.out else 0
            text.append(text[-1] + size)
            links.append(links[-1] + size * t.link)
            end[t.element] = len(text) - 1
    for k in range(n - 1, 0, -1):
        above = page.elements[k].parent
        end[above] = max(end[above], end[k])
    return [0, *(text[end[e.parent]] - text[end[k]] + links[start[k]] - links[start[e.parent]] for k, e in enumerate(page.elements[1:], 1))]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


HOST, ELEMENT, TEXT = 0, 1, 2  # kinds of rows of the token table


def token_table(pages: DataFrame) -> DataFrame:
    """``(host, token, kind, low, high, support, times, chars, above, last, beside)`` over pages (id, url, html).

    low and high are the two halves of the signature, support counts pages,
    times occurrences; chars is the text that an element holds, above its
    parent's token, last whether it isn't entered further, beside the links
    before and all text behind it in its parent.
    """

    def make():
        import xxhash

        def run(batch):
            found: dict[tuple[str, int], list] = {}
            for key, url, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                host = host_of(url)
                if not host:
                    continue
                page = parse(source or "")
                sizes, others = text_sizes(page), beside(page)
                named = {}
                for k, e in enumerate(page.elements):
                    if k:
                        entry = named.setdefault(page.paths[k], [ELEMENT, 0, page.paths[e.parent], False, 0])
                        entry[1] += sizes[k]
                        entry[3] = entry[3] or e.main > 0 or e.headline
                        entry[4] += others[k]
                for token, n in Counter(tokens_of(page)).items():
                    kind, chars, above, last, other = named.get(token, (TEXT, 0, 0, False, 0))
                    entry = found.setdefault((host, token), [kind, 0, 0, 0, 0, 0, above, False, 0])
                    h = xxhash.xxh64_intdigest(f"{key} {n}", 2)
                    entry[1] += h & 0xFFFFFFFF
                    entry[2] += h >> 32
                    entry[3] += 1
                    entry[4] += n
                    entry[5] += chars
                    entry[7] = entry[7] or last
                    entry[8] += other
                found.setdefault((host, 0), [HOST, 0, 0, 0, 0, 0, 0, False, 0])[3] += 1
            if not found:
                return None
            kind, low, high, support, times, chars, above, last, other = zip(*found.values(), strict=True)
            return {"host": [h for h, _ in found], "token": _signed([t for _, t in found]), "kind": kind, "low": low, "high": high, "support": support, "times": times, "chars": chars, "above": _signed(above), "last": last, "beside": other}

        return run

    rows = by_batch(pages, "host string, token long, kind int, low long, high long, support long, times long, chars long, above long, last boolean, beside long", make)
    return rows.groupBy("host", "token").agg(*[F.min(c).alias(c) for c in ("kind", "above")], *[F.sum(c).alias(c) for c in ("low", "high", "support", "times", "chars", "beside")], F.max("last").alias("last"))


def templates(pages: DataFrame, least_pages: int = 4, share: float = 0.8, least_tokens: int = 2, broadcast_hosts: int = 200_000) -> DataFrame:
    """``(host, tokens)``: the template's tokens of each host, with the class of each and what is known of elements.

    A token of at least ``share`` of the pages is in the template; so a host's
    list is no longer than 1 / share times the tokens of a page.  Up to
    ``broadcast_hosts`` hosts are broadcast, so a large one's tokens stay where
    they are; more are joined, and large ones split.
    """
    table = written(token_table(pages), "tokens")
    hosts = table.where(F.col("kind") == HOST).select("host", F.col("support").alias("pages")).where(F.col("pages") >= least_pages)
    # what too few pages have is in no template: most tokens go before they meet their host
    frequent = table.where((F.col("kind") != HOST) & (F.col("support") >= share * least_pages)).join(F.broadcast(hosts) if hosts.count() <= broadcast_hosts else hosts, "host").where(F.col("support") >= share * F.col("pages"))
    token = F.struct("token", "kind", F.xxhash64("low", "high").alias("class"), (F.col("times") == F.col("support")).alias("once"), "chars", "above", "last", "beside")
    classes = frequent.groupBy("host", "low", "high", "support").agg(F.collect_list(token).alias("tokens"))
    return classes.where(F.size("tokens") >= least_tokens).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


@dataclass
class Template:
    """A host's template tokens with their classes, and the token of the main text's slot (0: none)."""

    classes: dict[int, int]
    slot: int


def template_of(tokens: list[dict], inner: float = 0.6) -> Template:
    """Nests the template's elements and goes from the outermost to the slot of the main text."""
    within: dict[int, list[dict]] = defaultdict(list)
    elements = {t["token"] for t in tokens if t["kind"] == ELEMENT and t["once"]}
    for t in tokens:
        if t["token"] in elements:
            within[t["above"] if t["above"] in elements else 0].append(t)
    now, best = None, lambda found: max(found, key=lambda t: (t["chars"], -t["token"]))
    while found := within.get(now["token"] if now else 0):
        top = best(found)
        if now and (now["last"] or top["chars"] < inner * now["chars"] or top["chars"] < now["chars"] and not top["beside"]) or not top["chars"]:
            break
        now = top
    return Template({t["token"] % 2**64: t["class"] for t in tokens}, now["token"] % 2**64 if now else 0)


def valid_tokens(tokens: list[int], classes: dict[int, int]) -> set[int]:
    """The page's tokens that are template, leaving out classes whose stretches cross another's."""
    spans: dict[int, list[int]] = {}
    for at, h in enumerate(tokens):
        c = classes.get(h)
        if c is not None:
            spans.setdefault(c, [at, at])[1] = at
    open_: list[tuple[int, int]] = []
    bad: set[int] = set()
    for c, (a, b) in sorted(spans.items(), key=lambda x: (x[1][0], -x[1][1])):
        while open_ and open_[-1][0] < a:
            open_.pop()
        if open_ and open_[-1][0] < b:
            bad.add(c)
        else:
            open_.append((b, c))
    return {h for h in tokens if classes.get(h, None) is not None and classes[h] not in bad}


def _joined(texts: list[Text]) -> str:
    blocks: dict[int, list[str]] = {}
    for t in texts:
        blocks.setdefault(t.block, []).append(t.words)
    return "\n".join(x for parts in blocks.values() if (x := " ".join("".join(parts).split())))


def _size(texts: list[Text]) -> int:
    return sum(len(t.words.strip()) for t in texts if not t.link)


def _inside(page: Page, hit: list[bool]) -> list[bool]:
    """Which elements are hit or stand in one that is."""
    out = [False] * len(page.elements)
    for k, e in enumerate(page.elements):
        out[k] = hit[k] or k > 0 and out[e.parent]
    return out


def _without_menus(texts: list[Text]) -> list[Text]:
    """Texts less blocks that are links for the most part."""
    by_block: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for t in texts:
        by_block[t.block][t.link] += len(t.words.strip())
    return [t for t in texts if by_block[t.block][1] <= by_block[t.block][0]]


def extract(source: str | None, template: Template | None = None) -> str:
    """The main text of a page."""
    page = parse(source or "")
    if not any(t.token and not t.out for t in page.texts):
        # a class that reads like a side matter's stands around everything
        page = parse(source or "", by_class=False)
    texts = [t for t in page.texts if not t.out]
    solid = [t for t in texts if t.token]
    if not solid:
        return ""
    if template:
        known = valid_tokens(tokens_of(page), template.classes)
        if template.slot in known:
            hit = [p == template.slot for p in page.paths]
            inside = _inside(page, hit)
            held = [t for t in texts if inside[t.element]]
            kept = [t for t in held if not (t.token and t.token in known)]
            if 2 * _size(kept) >= _size(held) > 0:
                if not any(page.elements[k].main for k, h in enumerate(hit) if h):
                    kept = _without_menus(kept)
                return _joined(kept)
            if _size(held):
                return _joined(held)
    return _alone(page, texts, solid)


def _alone(page: Page, texts: list[Text], solid: list[Text]) -> str:
    """The main text of a page that has no template."""
    weight: Counter = Counter()
    main = [e.main for e in page.elements]
    for t in solid:
        if main[t.element]:
            weight[main[t.element]] += len(t.words) if not t.link else 0
    if weight:
        best = max(weight, key=lambda k: (weight[k], -k))
        return _joined([t for t in texts if main[t.element] == best])
    for t in solid:
        if not t.link:
            weight[page.plain[max(page.elements[t.element].parent, 0)]] += len(t.words)
    if not weight:
        return ""
    best = max(weight.items(), key=lambda x: x[1])[0]
    inside = _inside(page, [p == best for p in page.plain])
    return _joined(_without_menus([t for t in texts if inside[t.element]]))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 4, share: float = 0.8, inner: float = 0.6, broadcast_tokens: int = 400_000) -> DataFrame:
    """``(id, url, text)`` for every row of ``pages``.

    Templates of at most ``broadcast_tokens`` tokens in all are broadcast; more
    are joined by host, where large hosts can be split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    made = written(templates(rows, least_pages, share), "templates")
    size = made.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)) + F.count("*")).first()[0]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1))
    joined = rows.withColumn("host", host).join(F.broadcast(made) if size <= broadcast_tokens else made, "host", "left").select("id", "url", "html", "host", "tokens")

    def make():
        known: dict[str, Template | None] = {}

        def run(batch):
            out = []
            host, tokens = batch.column(3).to_pylist(), batch.column(4)
            for k, source in enumerate(batch.column(2).to_pylist()):
                h = host[k]
                if h not in known:
                    if len(known) > 200:
                        known.clear()
                    t = tokens[k].as_py()
                    known[h] = template_of(t, inner) if t else None
                out.append(extract(source, known[h]))
            return {"id": batch.column(0), "url": batch.column(1), "text": out}

        return run

    return by_batch(joined, "id long, url string, text string", make)


def op4_html_extract(spark, sf_dir):
    from .common import table

    return main_texts(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
