"""Main text of web pages by wrappers inferred for each host.

A page is a stream of tags and text slots, balanced by the rules for tags that
may be left open.  A wrapper is a union-free regular expression over such
streams, kept as a tree: each element's content is a sequence of items, an item
being a text slot, an element, or a group of elements that repeats, and each is
marked optional or repeated.  A page alone gives a wrapper by folding its tandem
repeats.  Two wrappers are aligned element by element: items of one kind are
merged in turn, what one side lacks becomes optional, what follows itself becomes
repeated, and texts that differ make their slot a variable one.

Pages of one host whose wrappers have the same structure are summed first, in each
task; different structures are then aligned in the order of a hash of their structure, in
salted parts and then as a whole.  So a host's wrapper doesn't depend on how its pages
came, and no task aligns more than a share of a large host's structures.

A host's wrapper says where its pages carry their article: the element with most text in
slots that vary between pages.  Marks (the tag ``article``, class names) only widen that
place to the whole article around it.  Class names of menus, notices and the like leave
an element out, but not one that also has an article's name, and not where next to no
variable text would remain.  Pages are read at the host's place; one that doesn't have it
is read by its own wrapper.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import json
import re
import zlib
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import join_groups, saved

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "dd", "dt", "li", "tbody", "tfoot", "thead", "tr", "legend", "summary"}
#: An open element of the second kind ends where one of the first starts, unless one of the third is between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
# What is no part of an article.
LEFT_OUT = frozenset("head nav footer aside script style noscript iframe template button select textarea input menu object embed canvas audio video map xmp title noembed noframes datalist desc metadata annotation annotation-xml".split())
#: Left out unless they hold the article; what is a form's own, its fields and their labels, goes in any case.
HOLDERS = frozenset("form dialog fieldset".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted banner banners nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars side rail widget widgets footer foot masthead topbar toolbar site-header page-header cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations teaser teasers copyright legal disclaimer search searchbox form skip hidden".split()
)
ARTICLE_WORDS = frozenset("article articlebody article-body article-content post post-content post-body postbody entry entry-content story story-body storybody".split())
MAIN_WORDS = frozenset("main-content maincontent body-content page-content content main text".split())

LEFT_OUT_PARTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination sidebar footer masthead cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe comment comments disqus respond replies sharing social related recommended copyright disclaimer".split())
#: Words that also name parts of an article: an anchor (the id of a heading or section), a paragraph's kind.
WEAK_WORDS = frozenset("alert alerts banner banners copyright disclaimer discussion legal notice notices overlay page-header pager recommendations related reply respond search side teaser".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre li dd dt td th figure figcaption caption".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
NEGATIONS = frozenset("no not non has have with without is".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+|<)""", re.S)
_NAMED = re.compile(r"</?[a-zA-Z]")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_DIGITS = re.compile(r"\d+")
#: In wrappers, the texts of elements nested this deep or deeper lie flat in the element above; pages are parsed and read to any depth.
DEPTH = 200
#: Class names leave elements out unless less than this share of the variable text would remain.
LEAST_LEFT = 0.1

# How an element is marked: not, as a page's main part, as an article by name, as an article by its tag.
PLAIN, MAIN, NAMED, ARTICLE = range(4)
# How it is left out: not, by a paragraph's word unless its text varies, by its names unless it holds the article, by its tag or role.
KEPT, BY_WORD, BY_NAME, BY_TAG = range(4)


class Element:
    __slots__ = ("children", "depth", "key", "left_out", "marked", "tag", "within")

    def __init__(self, tag: str, attributes: str, depth: int, inside: bool, within: bool, in_form: bool = False):
        self.tag, self.depth, self.children = tag, depth, []
        self.key, self.marked = tag, {"article": ARTICLE, "main": MAIN}.get(tag, PLAIN)
        given = {} if not attributes or attributes.isspace() else _attributes(attributes)
        self.left_out = BY_NAME if tag in HOLDERS else BY_TAG if tag in LEFT_OUT or tag == "header" and not inside or tag == "label" and (in_form or "for" in given) else KEPT
        if given:
            self.left_out = max(self.left_out, BY_TAG if given.get("role") in LEFT_OUT_ROLES - {"form", "dialog"} or given.get("itemprop") == "comment" or "hidden" in given or given.get("aria-hidden") == "true" else BY_NAME if given.get("role") in ("form", "dialog") else KEPT)
            self.marked = max(self.marked, {"main": MAIN, "article": NAMED}.get(given.get("role", ""), PLAIN))
            by_id, by_class = ([w.strip("-_") for w in _DIGITS.sub("", given.get(name, "")).split()] for name in ("id", "class"))
            words = by_id + by_class
            article = given.get("itemprop") == "articlebody" or any(w in ARTICLE_WORDS for w in words)
            # An article's name wins, but not within an article ("related post").
            if self.left_out == KEPT and tag not in ("body", "html", "article", "main") and (within or not article):
                self.left_out = _by_words(tag, by_id, by_class)
            self.marked = max(self.marked, NAMED if article else MAIN if any(w in MAIN_WORDS for w in words) else PLAIN)
            self.key = ".".join([tag, *sorted(set(words))][:4])
        #: Whether it is in an element that is marked as an article, or is one.
        self.within = within or self.marked >= NAMED


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag, of one that repeats the first; names and values in lower case."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), next(filter(None, values), "").lower())
    return out


def _by_words(tag: str, by_id: list[str], by_class: list[str]) -> int:
    """How the words of id and class leave an element out; a heading's id is an anchor."""
    if tag in HEADINGS:
        return BY_NAME if any(_is_left_out(w) and w not in WEAK_WORDS for w in by_class) else KEPT
    if tag == "section":
        by_id = [w for w in by_id if w not in WEAK_WORDS]
    found = [w for w in by_id + by_class if _is_left_out(w)]
    return BY_WORD if found and tag in PROSE and all(w in WEAK_WORDS for w in found) else BY_NAME if found else KEPT


def _is_left_out(word: str) -> bool:
    """Whether a class or id names what is no part of an article, whole or in one of its parts; "no-sidebar" and the like don't."""
    if word in LEFT_OUT_WORDS or word in ARTICLE_WORDS or word in MAIN_WORDS:
        return word in LEFT_OUT_WORDS
    parts = re.split(r"[-_]+", word)
    return any(p in LEFT_OUT_PARTS for p in parts) and not any(p in NEGATIONS for p in parts)


def parse(page: str) -> Element:
    """Balanced tree of a page; texts are strings among the children."""
    root = Element("#page", "", 0, False, False)
    stack, inside, at, n = [root], 0, 0, len(page)
    opened: dict[str, int] = {}

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    while at < n:
        m = _TOKEN.match(page, at)
        closing, name, attributes, text = m.groups()
        if text == "<" and _NAMED.match(page, at):
            # A quote in the tag isn't closed, or the tag never ends.
            m = _LOOSE.match(page, at)
            if m is None:
                break
            closing, name, attributes, text = *m.groups(), None
        at = m.end()
        if text is not None:
            stack[-1].children.append(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                if stack[i].tag == name:
                    inside -= sum(e.tag in ("article", "main") for e in stack[i:])
                    cut(i)
                    break
            continue
        if name in CLOSES_P or name in ENDS:
            ends, bounds = ENDS.get(name, (("p",), ("button", "td", "th", "table", "li", "dd", "article", "main", "section", "div", "blockquote", "body")))
            found = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    found = i
                    if name not in ("tbody", "tr"):
                        break
            if found:
                cut(found)
        element = Element(name, attributes, len(stack), inside > 0, stack[-1].within, any(opened.get(t) for t in HOLDERS))
        if name in ("article", "main"):
            for e in stack:
                if e.tag in HOLDERS and e.left_out == BY_NAME:
                    e.left_out = KEPT
        stack[-1].children.append(element)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not attributes.endswith("/") or name in BLOCK and name not in VOID:
            stack.append(element)
            opened[name] = opened.get(name, 0) + 1
            inside += name in ("article", "main")
    return root


# Wrappers are lists, to travel as JSON: [kind, optional, repeated, payload ..].
# Slot: ["#", optional, repeated, pages, characters, least hash, greatest hash].
# Element: [key, optional, repeated, marked, left_out, items].


def _folded(items: list) -> list:
    """Tandem repeats of one to three items become one repeated item or group."""
    for width in (1, 2, 3):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * width and [i[0] for i in out[-2 * width : -width]] == [i[0] for i in out[-width:]] and (width == 1 or all(i[0] not in "#*" for i in out[-width:])):
                last = out[-width:]
                del out[-width:]
                out[-width:] = [_merged_item(a, b) for a, b in zip(out[-width:], last, strict=True)]
                for i in out[-width:]:
                    i[2] = 1
        items = out
    return items


def _merged_item(a: list, b: list) -> list:
    head = [a[0], a[1] | b[1], a[2] | b[2]]
    if a[0] == "#":
        return [*head, a[3] + b[3], a[4] + b[4], min(a[5], b[5]), max(a[6], b[6])]
    return [*head, max(a[3], b[3]), max(a[4], b[4]), merge(a[5], b[5])]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by rows of bits: a zero at j is where the subsequence with b[: j + 1] gets longer."""
    where: dict[str, int] = {}
    for j, k in enumerate(b):
        where[k] = where.get(k, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row, rows = whole, [whole]
    for k in a:
        hit = row & where.get(k, 0)
        row = (row + hit | row - hit) & whole
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: list, b: list) -> list:
    """Items of two wrappers aligned: a longest common subsequence of kinds is merged, the rest is optional."""
    ka, kb = [i[0] for i in a], [i[0] for i in b]
    if ka == kb:
        return [_merged_item(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*_common(ka, kb), (len(a), len(b))]:
        out += [[k[0], 1, *k[2:]] for k in [*a[i:x], *b[j:y]]]
        if x < len(a):
            out.append(_merged_item(a[x], b[y]))
        i, j = x + 1, y + 1
    return _folded(out)


def structure(items: list) -> list:
    """What of a wrapper is no slot's content: pages alike in it are summed in any order."""
    return [[*i[:3], *([structure(i[5])] if len(i) == 6 else [])] for i in items]


def _flat(element: Element):
    """Children, with the texts of those at DEPTH and deeper in their place."""
    for child in element.children:
        todo = [child]
        while todo:
            c = todo.pop()
            if isinstance(c, str) or c.depth < DEPTH:
                yield c
            elif c.left_out != BY_TAG:
                todo += reversed(c.children)


def wrapper(element: Element) -> list:
    """Items of a page alone."""
    items = []
    for child in _flat(element):
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                items.append(["#", 0, 0, 1, len(text), h, h])
        elif child.tag not in ("br", "b", "i", "em", "strong", "span", "u", "wbr", "small", "font"):
            items.append([child.key, 0, 0, child.marked, child.left_out, wrapper(child) if child.left_out != BY_TAG else []])
        else:
            items += wrapper(child)
    return _folded(items)


class Place:
    """Where pages carry their article: keys from the root to its element, and keys of elements that names don't leave out."""

    def __init__(self, path: list[str], lifted: frozenset[str] = frozenset()):
        self.path, self.lifted = path, lifted

    def dump(self) -> str:
        return json.dumps([self.path, sorted(self.lifted)])

    @classmethod
    def load(cls, data: str | None) -> Place | None:
        if not data:
            return None
        path, lifted = json.loads(data)
        return cls(path, frozenset(lifted))

    def has(self, element: Element) -> bool:
        return element.left_out == KEPT or element.left_out != BY_TAG and element.key in self.lifted


def _variable_text(items: list, lifted: frozenset[str], everything: bool = False) -> int:
    """Characters in slots of these items whose text differs between pages or repeats, without what is left out."""
    total = 0
    for i in items:
        if i[0] == "#":
            total += i[4] if i[3] == 1 or i[5] != i[6] else 0
        elif i[4] == KEPT or i[4] != BY_TAG and (everything or i[0] in lifted):
            total += _variable_text(i[5], lifted, everything)
    return total


def _any_article(items: list) -> bool:
    """Whether an element that isn't left out is marked as an article and has variable text."""
    return any(i[0] != "#" and i[4] == KEPT and (i[3] >= NAMED and _variable_text(i[5], frozenset()) > 0 or _any_article(i[5])) for i in items)


def _varying(items: list) -> frozenset[str]:
    """Keys of paragraphs with a word that leaves them out, but not with the same text on all pages."""
    found: set[str] = set()

    def walk(items: list) -> None:
        for i in items:
            if i[0] != "#" and i[4] != BY_TAG:
                if i[4] == BY_WORD and _variable_text(i[5], frozenset(), True):
                    found.add(i[0])
                walk(i[5])

    walk(items)
    return frozenset(found)


def _lifted(items: list) -> frozenset[str]:
    """Keys of elements that are not left out for their names: paragraphs that vary, and of others with most variable text as many as it takes to have enough.

    There are no others where an article remains, and comments only where nothing would.
    """
    whole = _variable_text(items, frozenset(), True)
    lifted = _varying(items)
    if _any_article(items):
        return lifted

    def named(items: list, found: dict[str, int]) -> None:
        """Elements that names leave out, the outermost only."""
        for i in items:
            if i[0] != "#" and i[4] in (BY_WORD, BY_NAME) and i[0] not in lifted:
                found[i[0]] = found.get(i[0], 0) + _variable_text(i[5], lifted, True)
            elif i[0] != "#" and i[4] != BY_TAG:
                named(i[5], found)

    while (left := _variable_text(items, lifted)) < LEAST_LEFT * whole:
        found: dict[str, int] = {}
        named(items, found)
        others = {k: n for k, n in found.items() if not COMMENT_WORDS.intersection(re.split(r"[-_.]+", k))}
        if left and not others:
            break
        lifted |= {max(others or found, key=lambda k: (found[k], k))}
    return lifted


_OWN = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "table", "dl", "figure")


def article_place(items: list) -> Place:
    """The element with most variable text in blocks of its own, and what belongs to its article around it."""
    lifted = _lifted(items)
    there = lambda i: i[0] != "#" and (i[4] == KEPT or i[4] != BY_TAG and i[0] in lifted)
    best: tuple[int, int, list[list]] = (0, 0, [])

    def walk(items: list, path: list[list]) -> None:
        nonlocal best
        for i in filter(there, items):
            place = [*path, i]
            own = sum(_variable_text([c] if c[0] == "#" else c[5], lifted) for c in i[5] if c[0] == "#" or there(c) and c[0].split(".")[0] in _OWN)
            best = max(best, (own, -len(place), place), key=lambda x: x[:2])
            walk(i[5], place)

    walk(items, [])
    path = best[2]
    inner = [i for i in path if i[0].split(".")[0] not in ("body", "html")]
    kind = max((i[3] for i in inner), default=PLAIN)
    if kind > PLAIN:
        # The outermost of the strongest mark around it.
        path = path[: next(n for n, i in enumerate(path, 1) if i in inner and i[3] == kind)]
    else:
        # Up to an element that has the article's heading, or other parts without a name like this one, beside it.
        beside = lambda c: there(c) and (c[0].split(".")[0] in ("h1", "h2") or c[0] in ("div", "section") and (c is not path[-1] or c[2])) and _variable_text(c[5], lifted) > 0
        while len(path) > 1 and path[-2] in inner and any(map(beside, path[-2][5])):
            path = path[:-1]
    return Place([i[0] for i in path], lifted)


def _at(element: Element, place: Place) -> list[Element]:
    found = [element]
    for key in place.path:
        found = [c for e in found for c in _through(e) if c.key == key and place.has(c)]
    return found


def _through(element: Element):
    """Child elements, with those of inline elements in their place, as in wrappers."""
    todo = element.children[::-1]
    while todo:
        c = todo.pop()
        if not isinstance(c, str):
            if c.tag in ("b", "i", "em", "strong", "span", "u", "small", "font"):
                todo += reversed(c.children)
            else:
                yield c


def block_texts(elements: list[Element], place: Place) -> list[str]:
    """Texts of the blocks, in page order, without what is left out."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    def walk(e: Element) -> None:
        todo = [(iter(e.children), False)]
        while todo:
            children, block = todo[-1]
            c = next(children, None)
            if c is None:
                todo.pop()
                if block:
                    end()
            elif isinstance(c, str):
                run.append(html_entities.unescape(c))
            elif place.has(c):
                if c.tag in BLOCK:
                    end()
                elif c.tag in ("br", "td", "th", "img", "wbr"):
                    run.append("" if c.tag == "wbr" else " ")
                todo.append((iter(c.children), c.tag in BLOCK))

    for e in elements:
        walk(e)
        end()
    return blocks


def main_text(page: str, place: Place | None) -> str:
    root = parse(page)
    found = _at(root, place) if place and place.path else []
    blocks = block_texts(found, place) if found else []
    if not blocks:
        place = article_place(wrapper(root))
        blocks = block_texts(_at(root, place) if place.path else [root], place)
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


PARTIAL_ARROW = pa.schema([("host", pa.string()), ("salt", pa.int64()), ("pages", pa.int64()), ("structure", pa.string()), ("wrapper", pa.string())])
PARTIAL = "host string, salt long, pages long, structure string, wrapper string"
#: Parts in which a host's structures are aligned before they are aligned as a whole: so many of so many each.
SALTS = 32
#: Wrappers that a task sums before it passes them on.
HELD = 2000


def _dump(items: list) -> str:
    return json.dumps(items, separators=(",", ":"))


def _rows(known: dict[tuple[str, str], list]) -> pa.RecordBatch:
    rows = [(host, int.from_bytes(hashlib.blake2b(kind.encode(), digest_size=8).digest(), "big") >> 1, n, kind, _dump(w)) for (host, kind), (n, w) in known.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PARTIAL_ARROW)], schema=PARTIAL_ARROW)


def _partial(batches):
    """Wrappers of each host and structure, summed over a task's pages."""
    known: dict[tuple[str, str], list] = {}
    for batch in batches:
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            items = wrapper(parse(page or ""))
            key = (host_of(url), hashlib.blake2b(_dump(structure(items)).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            if key in known:
                known[key][0] += 1
                known[key][1] = merge(known[key][1], items)
            else:
                known[key] = [1, items]
            if len(known) >= HELD:
                yield _rows(known)
                known = {}
    yield _rows(known)


def _merged_rows(table: pa.Table) -> pa.Table:
    """One wrapper of all: those of one structure are summed, and the sums aligned in the order of structures."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("structure", "wrapper")), strict=True))
    whole: list | None = None
    for _, same in groupby(rows, key=lambda r: r[0]):
        one = None
        for _, w in same:
            one = json.loads(w) if one is None else merge(one, json.loads(w))
        whole = one if whole is None else merge(whole, one)
    row = (table.column("host")[0].as_py(), table.column("salt")[0].as_py() // SALTS, sum(table.column("pages").to_pylist()), rows[0][0], _dump(whole))
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, PARTIAL_ARROW, strict=True)], schema=PARTIAL_ARROW)


def _placed(batches):
    for batch in batches:
        places = [article_place(json.loads(w)).dump() for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(places, pa.string())], names=["host", "pages", "place"])


def _host(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())], names=[*batch.schema.names, "host"])


def _read(batches):
    places: dict[str | None, Place | None] = {}
    for batch in batches:
        texts = []
        for page, data in zip(batch.column("html").to_pylist(), batch.column("place").to_pylist(), strict=True):
            if data not in places:
                places[data] = Place.load(data)
            texts.append(main_text(page or "", places[data]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper as JSON) from (url, html)."""
    part = pages.select("url", "html").mapInArrow(_partial, PARTIAL).withColumn("salt", F.col("salt") % (SALTS * SALTS))
    for _ in range(2):
        part = part.groupBy("host", "salt").applyInArrow(_merged_rows, PARTIAL)
    return part.withColumn("salt", F.lit(0).cast("long")).groupBy("host").applyInArrow(_merged_rows, PARTIAL).select("host", "pages", "wrapper")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text (blocks joined by a line feed), n_chars (code points).

    Null and empty pages have an empty text.  A null or broken url counts as the
    host ''.  Tags left open, raw text with tags in it, and tags that never end are
    read as browsers do, in the main.  Elements may nest to any depth; a host's
    article is looked for down to DEPTH.  Texts of any length are taken whole.  Of two
    elements with equally much variable text the one that is less deep, then the first,
    is the article.  Repeated rows give equal rows; a repeated page_id is kept as often
    as it comes.  Other columns are ignored.  An empty table gives no rows.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    places = saved(host_wrappers(rows).mapInArrow(_placed, "host string, pages long, place string"))
    total = places.agg(F.sum("pages")).first()[0] or 0
    hosted = rows.mapInArrow(_host, "page_id long, url string, html string, host string")
    return join_groups(hosted, places, "host", "pages", total, "html").select("page_id", "url", "html", "place").mapInArrow(_read, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(pages: DataFrame) -> DataFrame:
    return extract(pages)


#: What the pages of the test tables have in their article, by patterns for their one layout and the references that they use.
OP10_SQL = r"""WITH b AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>')) AS block, generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>'), 1) AS i FROM pages),
t AS (SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(block, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b),
j AS (SELECT page_id, url, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (WHERE text <> ''), '') AS text FROM t GROUP BY 1, 2)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j"""
