"""Main text of web pages by host consensus.

A tolerant reader turns each page into blocks of text, each with the path of
containers around it: tags with their classes, digits generalised ("div.post-N").
First pass: a page votes for the lowest container that holds nearly all of its text
outside links, raised where title, lead or lists stand beside it.  Spark adds the
votes of a host by path, and the pages that have the path, so a hot host is summed
before the shuffle.  A path wins where most of the pages that have it vote for it.
Second pass: every page is read again and gives the blocks under its own path if
that has won, else under the host's strongest winning path that it has, else under
its own path.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out wherever they stand.  A name alone never makes
furniture of an element with most of a page's text, with main or with the only
articles, and a header with an unlinked h1 and no links is the title of a page
that has no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, mapped, slices

#: No part gives back what it took and every tag ends at the text's end at the latest, so reading is linear in the text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
#: References to numbers longer than any character's.
ZEROS, TOO_LONG = re.compile(r"(&#[xX]?)0+(?=[0-9A-Fa-f])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9A-Fa-f]{7,});?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select"}
#: Of these, those that can hold no elements: without an end tag they last to the end.
ENDLESS = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center", "details", "header", "footer", "nav", "aside", "form", "fieldset", "table", "ul", "ol", "dl", "menu", "dialog", "figure"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = CONTAINERS | HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "address", "figcaption", "caption", "summary", "tr", "th", "thead", "tbody", "tfoot", "hgroup", "legend", "head", "option", "label"}
#: An opening tag of these ends an open tag of the second set, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "input", "label", "fieldset"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
DROPPED_WORDS = set(
    "nav navbar navigation menu menus footer sidebar aside rail widget widgets notice notices cookie cookies consent gdpr banner alert alerts ad ads adbox advert adverts advertisement advertising "
    "adslot sponsor sponsored promo promotion comment comments disqus reply replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login breadcrumb "
    "breadcrumbs pagination pager popup modal overlay paywall copyright masthead toolbar skip".split()
)
#: Words that may stand beside those in a name; with any other word the name is a phrase of its own.
QUALIFIERS = set(
    "site page main primary secondary top bottom left right upper lower inner outer mobile desktop sticky fixed global local list area box container wrapper wrap section block blocks link links bar button buttons btn icon "
    "icons item items post posts article articles entry entries content col column columns panel group row holder unit slot zone text title heading head body label form message msg policy js by us id nav previous prev next "
    "first last root media network networks follow tools actions meta info count more also stories story news letter popular latest recent sub toggle wide full close header".split()
)
#: A name with one of these says something about an element, not what it is.
STATES = {"has", "with", "without", "no", "not", "is"}
#: Readers' comments, which may be longer than the text.
COMMENT_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: As ids of sections, and as classes of sections of an article, these are made from headings.
TITLES = {"discussion", "related", "notice", "notices", "alert", "alerts", "promotion", "navigation", "copyright", "subscription", "share", "sharing", "social", "advertising", "advertisement"}
#: Words that are as likely what a text is about as what it is: in an article, by themselves, they make furniture only of links.
TOPICS = TITLES | {"rail", "skip", "banner", "menu", "menus", "masthead"}
#: Blocks of running text.
TEXTS = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "blockquote", "pre", "address", "figcaption", "caption", "summary"}
#: Parts of forms that stand in sentences too.
CONTROLS = {"label", "button"}
KEPT_TAGS = {"html", "body", "main", "article"}
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Containers whose text is a part of what stands around them; cells with a class may be columns of the page.
FLOW = {"ul", "ol", "dl", "table", "td", "figure", "header", "details"}
#: The lowest container with this share of a page's unlinked text is its own.
NEARLY = 0.95
#: A path must have this share of a host's votes to overrule the own paths of other pages.
SHARE = 0.1
#: Winning paths are sent to every task up to this size; beyond it they are joined by host.
BROADCAST_BYTES = 16 << 20
KEY_BYTES = 12


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    return unescape(TOO_LONG.sub("\ufffd", ZEROS.sub(r"\1", text)) if "&#" in text else text)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): _decoded((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)}


#: What _boilerplate() finds: always left out; left out unless it holds the page's text; a header, which may hold the title; comments; left out if mostly links.
NONE, ALWAYS, UNLESS_MOST, HEADER, COMMENTS, IF_LINKS = range(6)


def _named(words: list[str], inside: bool) -> int:
    if not words or not STATES.isdisjoint(words) or not all(w in DROPPED_WORDS or w in QUALIFIERS or len(w) == 1 for w in words):
        return NONE
    if not COMMENT_WORDS.isdisjoint(words):
        return COMMENTS
    return UNLESS_MOST if not DROPPED_WORDS.isdisjoint(words) or "header" in words and not inside else NONE


def _boilerplate(tag: str, a: dict[str, str], inside: bool) -> int:
    """Which kind of furniture an element is; `inside`: within article or main, where a header holds the title."""
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return ALWAYS
    if tag == "header" and not inside:
        return HEADER
    if tag in DROPPED_TAGS:
        return UNLESS_MOST if tag in ("form", "fieldset", "aside") else ALWAYS
    if tag in KEPT_TAGS or not a:
        return NONE
    if (role := a.get("role", "").lower()) in DROPPED_ROLES:
        return UNLESS_MOST if role == "form" else ALWAYS
    names = [WORD.findall(CAMEL.sub(" ", name).lower()) for name in a.get("class", "").split()]
    if tag not in HEADINGS:
        words = WORD.findall(CAMEL.sub(" ", a.get("id", "")).lower())
        if tag != "section" or not TITLES.issuperset(words):
            names.append(words)
    if tag == "section" and inside:
        names = [words for words in names if not TITLES.issuperset(words)]
    topics = [words for words in names if words and TOPICS.issuperset(words)] if inside and (tag in TEXTS or tag == "div" and not a.get("class")) else []
    kind = max((_named(words, inside) for words in names if words not in topics), default=NONE)
    return IF_LINKS if topics and kind == NONE else kind


class Page:
    """Containers and blocks of a page; containers with one path (tags and generalised classes from the root) are one, 0 is the root.

    A container's key is a hash of its path, made from the key of the container around it.
    """

    def __init__(self) -> None:
        self.tags, self.up, self.depth, self.keys, self.holder = [""], [0], [0], [b""], [0]
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int, str]] = []  # container, text, characters in links, tag if a heading

    def enter(self, above: int, tag: str, classes: str) -> int:
        """The number of a container inside another."""
        made = self.known.get((above, part := f"{tag}.{classes}" if classes else tag))
        if made is None:
            made = self.known[above, part] = len(self.tags)
            self.tags.append(tag)
            self.up.append(above)
            self.depth.append(self.depth[above] + 1)
            self.keys.append(blake2b(self.keys[above] + part.encode("utf-8", "replace"), digest_size=KEY_BYTES).digest())
            # lists, tables, figures and headers belong to what holds them
            self.holder.append(self.holder[above] if tag in FLOW and not (tag == "td" and classes) else made)
        return made

    def summed(self, values: list[int]) -> list[int]:
        """Each container's value with those of all containers inside it."""
        for k in range(len(values) - 1, 0, -1):
            values[self.up[k]] += values[k]
        return values

    def below(self, top: int) -> list[bool]:
        """Which containers are this one or inside it."""
        out = [False] * len(self.up)
        out[top] = True
        for k in range(top + 1, len(out)):
            out[k] = out[self.up[k]]
        return out

    def holding(self) -> list[int]:
        """How many blocks are in each container or inside it."""
        counts = [0] * len(self.up)
        for k, *_ in self.blocks:
            counts[k] += 1
        return self.summed(counts)


class _Furniture:
    """Elements of a page that may be furniture, nested as they stand, and which of them are."""

    def __init__(self) -> None:
        self.kinds: list[int] = []
        self.up: list[int] = []
        self.comments: list[bool] = []  # comments, or inside them
        self.links: list[bool] = []  # with a menu or link inside
        self.holds: dict[str, list[int]] = {"article": [], "main": []}  # the furniture around each

    def add(self, kind: int, around: int) -> int:
        self.kinds.append(kind)
        self.up.append(around)
        self.comments.append(kind == COMMENTS or around >= 0 and self.comments[around])
        self.links.append(False)
        return len(self.kinds) - 1

    def _risen(self, marked: list[bool]) -> list[bool]:
        for k in range(len(marked) - 1, -1, -1):
            if marked[k] and self.up[k] >= 0:
                marked[self.up[k]] = True
        return marked

    def sound(self, blocks: list[tuple[int, str, int, str, int]]) -> list[bool]:
        """Which are no furniture, nor inside any: those with most of the text, with main, with the only articles, and headers with no more than the title."""
        size = len(self.kinds)
        words = any(k < 0 or not self.comments[k] for *_, k in blocks)  # without other text comments are the text
        mass, total = [0] * size, 0
        for _, text, linked, _, k in blocks:
            if k < 0 or not words or not self.comments[k]:
                total += len(text) - linked
                if k >= 0:
                    mass[k] += len(text) - linked
        links = [0] * size
        for _, _, linked, _, k in blocks:
            if k >= 0:
                links[k] += linked
        for k in range(size - 1, -1, -1):
            if self.up[k] >= 0:
                mass[self.up[k]] += mass[k]
                links[self.up[k]] += links[k]
        marked = [(m > held if kind == IF_LINKS else 2 * m > total) and not (words and kind == COMMENTS) for m, held, kind in zip(mass, links, self.kinds, strict=True)]
        holding = [False] * size
        for k in self.holds["main"]:
            if k >= 0:
                holding[k] = True
        if -1 not in self.holds["article"]:
            for k in self.holds["article"]:
                if not self.comments[k]:
                    holding[k] = True
        if not any(h == "h1" and k < 0 for *_, h, k in blocks):
            linked = self._risen(list(self.links))
            for *_, h, k in blocks:
                if h == "h1" and k >= 0 and self.kinds[k] == HEADER and not linked[k]:
                    marked[k] = True
        marked = [a or b for a, b in zip(marked, self._risen(holding), strict=True)]
        for k, around in enumerate(self.up):
            marked[k] = marked[k] and (around < 0 or marked[around])
        return marked


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def read(html: str) -> Page:
    """Containers and blocks of a page, in order, without furniture.  Time and memory are linear in the text, whatever it holds."""
    page, furniture = Page(), _Furniture()
    out: list[tuple[int, str, int, str, int]] = []
    stack: list[tuple] = []  # tag, and what was before it: container, dropped, in a link, inside an article, furniture around, heading
    at: dict[str, list[int]] = {}  # where in the stack each tag is open
    containers: list[int] = []
    block_at: list[int] = []
    here, dropped, linked, inside, around, heading = 0, False, False, False, -1, ""
    text: dict[int, list[str]] = {}
    linked_text: dict[int, int] = {}
    unended: set[str] = set()

    def end_block() -> None:
        for where, pieces in text.items():
            if joined := " ".join("".join(pieces).split()):
                out.append((here, joined, min(linked_text.get(where, 0), len(joined)), heading, where))
        text.clear()
        linked_text.clear()

    def pop_to(k: int) -> None:
        nonlocal here, dropped, linked, inside, around, heading
        if block_at and block_at[-1] >= k:
            end_block()
        for name, *_ in stack[k:]:
            at[name].pop()
        for held in (containers, block_at):
            while held and held[-1] >= k:
                held.pop()
        _, here, dropped, linked, inside, around, heading = stack[k]
        del stack[k:]

    def say(piece: str) -> None:
        if not dropped:
            text.setdefault(around, []).append(piece)
            if linked:
                linked_text[around] = linked_text.get(around, 0) + len(piece)

    pos, size, last = 0, len(html), html.rfind(">")
    while pos < size:
        m = TOKEN.match(html, pos)
        start, pos = pos, m.end()
        tag = m[2]
        if tag is None or start > last:
            piece = m[0]
            if piece[0] != "<" or piece == "<" or tag is not None:
                say(_decoded(piece))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                say(" ")
            elif (open_at := at.get(tag)) and (tag in CONTAINERS or not containers or open_at[-1] > containers[-1]):
                pop_to(open_at[-1])
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                end_block()
            continue
        if tag in RAW:
            if not m[3].endswith("/") and tag not in unended:
                if close := _end_of(tag).search(html, pos):
                    pos = close.end()
                elif tag in ENDLESS:
                    pos = size
                else:
                    unended.add(tag)
            continue
        # in a sentence, a label or button is a part of it
        spoken = tag in CONTROLS and not dropped and bool(block_at) and stack[block_at[-1]][0] in TEXTS and any(not p.isspace() for p in text.get(around, ()))
        block = tag in BLOCKS and not spoken
        if block:
            k = max((at[name][-1] for name in ("p", *ENDS.get(tag, ())) if at.get(name)), default=-1)
            if k >= (containers[-1] if containers else 0):
                pop_to(k)
            end_block()
        elif tag == "a" and at.get("a") and (not block_at or at["a"][-1] > block_at[-1]):
            pop_to(at["a"][-1])
        at.setdefault(tag, []).append(len(stack))
        if tag in CONTAINERS:
            containers.append(len(stack))
        if block:
            block_at.append(len(stack))
        stack.append((tag, here, dropped, linked, inside, around, heading))
        a = _attributes(m[3]) if m[3].strip(" /") else {}
        if tag in CONTAINERS:
            classes = a.get("class", "")
            here, heading = page.enter(here, tag, ".".join(sorted({DIGITS.sub("N", c) for c in classes.split()})) if classes else ""), ""
        elif tag in HEADINGS:
            heading = tag
        if not dropped:
            kind = _boilerplate(tag, a, inside) if not spoken and (tag in BLOCKS or a or tag in DROPPED_TAGS) else NONE
            if around >= 0 and (tag in ("a", "nav") or kind == ALWAYS):
                furniture.links[around] = True
            if kind == ALWAYS:
                dropped = True
            elif kind:
                around = furniture.add(kind, around)
            if tag in furniture.holds:
                furniture.holds[tag].append(around)
        linked = linked or tag == "a"
        inside = inside or tag in ("article", "main")
    end_block()
    if furniture.kinds:
        sound = furniture.sound(out)
        out = [x for x in out if x[4] < 0 or sound[x[4]]]
    page.blocks = [x[:4] for x in out]
    return page


def _raised(page: Page, node: int) -> int:
    """The container, or the one above it that holds what belongs to its text.

    Nothing below an article, or main without one, is a text of its own.  Headings and
    unlinked text directly in a container around it belong to it, and so does an
    unlinked h1 elsewhere if it has none.
    """
    outer: dict[str, int] = {}
    k = node
    while k:
        if page.tags[k] in ("article", "main"):
            outer[page.tags[k]] = k
        k = page.up[k]
    node = top = page.holder[outer.get("article", outer.get("main", node))]
    inside = page.below(node)
    titled = any(h == "h1" and inside[k] for k, _, _, h in page.blocks)
    # the lowest container around both the text and each container
    shared = list(range(len(inside)))
    above = {0}
    k = node
    while k:
        k = page.up[k]
        above.add(k)
    for k in range(1, len(shared)):
        if k not in above:
            shared[k] = shared[page.up[k]]
    for k, text, linked, heading in page.blocks:
        if inside[k]:
            continue
        holder = page.holder[k]
        if holder not in above:
            if titled or heading != "h1" or 2 * linked >= len(text):
                continue
            holder = shared[holder]
        elif not heading and 2 * linked >= len(text):
            continue
        top = min(top, holder, key=page.depth.__getitem__)
    return top


def own(page: Page) -> int | None:
    """The lowest container that holds nearly all unlinked text, raised to what belongs to it; None without such text."""
    mass = [0] * len(page.up)
    for k, text, linked, _ in page.blocks:
        mass[k] += len(text) - linked
    total = page.summed(mass)[0]
    if not total:
        return None
    lowest = 0
    for k, held in enumerate(mass):
        if held >= NEARLY * total and page.depth[k] > page.depth[lowest]:
            lowest = k
    return _raised(page, lowest)


def extract(page: Page, winners: list[bytes]) -> str:
    """Blocks under the page's own path if it has won, else under the first winning path that the page has, else under its own."""
    mine = own(page)
    chosen = mine
    if winners and (mine is None or page.keys[mine] not in winners):
        counts, where = page.holding(), {key: k for k, key in enumerate(page.keys)}
        chosen = next((where[w] for w in winners if w in where and counts[where[w]]), mine)
    if chosen is None:
        return ""
    inside = page.below(_raised(page, chosen))
    return "\n\n".join(text for k, text, *_ in page.blocks if inside[k])


def host_of(url: Column) -> Column:
    """Host of a URL in small letters; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the winning paths of each host, strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            seen: dict[tuple[str, bytes], list[int]] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = read(html or "")
                mine = own(page)
                for k, n in enumerate(page.holding()):
                    if n:
                        x = seen.setdefault((host, page.keys[k]), [0, 0])
                        x[0] += k == mine
                        x[1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in seen], pa.string()), pa.array([p for _, p in seen], pa.binary()), pa.array([v for v, _ in seen.values()], pa.int64()), pa.array([n for _, n in seen.values()], pa.int64())], ["host", "path", "votes", "pages"]
            )

    made = mapped(pages.select(host_of(F.col("url")).alias("host"), "html"), run, "host string, path binary, votes long, pages long")
    votes = made.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages")).filter("votes > 0")
    votes = checkpointed(votes)  # read twice
    # A share of the host's votes leaves at most 1 / SHARE paths, whatever the host's pages hold; other paths hold for pages whose own they are.
    most = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    kept = votes.join(most, "host").filter((F.col("votes") >= SHARE * F.col("all_votes")) & (2 * F.col("votes") >= F.col("pages")))
    ranked = kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path"))).alias("x"))
    return ranked.select("host", F.col("x.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` for every row of `page_id, url, html`.

    Null html is empty, and a page without main text has an empty text; pages whose
    url is null or has no host vote together; equal votes go to the path with the
    least hash; repeated rows vote and come out each; other columns are ignored; an empty
    table gives no rows.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = checkpointed(host_paths(pages))
    few = (winners.agg(F.sum(F.octet_length("host") + KEY_BYTES * F.size("paths") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    joined = pages.withColumn("host", host_of(F.col("url"))).join(F.broadcast(winners) if few else winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(read(h or ""), w or []) for h, w in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return mapped(joined.select("page_id", "url", "html", "paths"), run, f"page_id {kind}, url string, text string, n_chars long")
