"""Main text of web pages by union-free wrappers that are inferred for every host.

A wrapper is a regular expression without alternatives over a host's pages: elements, text slots, optional parts and
repeated groups. It starts as one page and takes in one page after the other: both token streams (trees of
block elements, so that groups close) are aligned level by level; text that differs becomes a slot, parts that only one side
has become optional, and neighbours or sequences that recur become repeated groups. Wrappers align with each
other in the same way, so tasks fold their own pages, and partial wrappers of a host are folded by (host, salt) and then by
host; a host with a third of all pages is no task of its own.

From a host's wrapper come its plan: the path to the main part and the texts that stand on every page. The main part is the
article element (or main, or an element named so) with most text; without any, the part that holds most
text that varies and is no link, less what the host repeats. Every page is then read along this path; a
page without it is read along a plan of its own. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are left out by element, role and name wherever they stand; headings in an article's own header
stay. Blocks are trimmed, runs of white space are one space, a line break is white space.

The plans are joined by host; Spark broadcasts them if they are small and splits hot hosts if not. Pages are never
shuffled to infer wrappers.

Null or empty html, and pages without text: empty text. A null url is a host of its own. Very long pages are read whole; elements
nested deeper than DEPTH only end blocks. Repeated rows and ties of page_id give a row each. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, give_back, ship, slices

DEPTH = 80
SALTS = 32
HOSTS = 512  # wrappers that a task holds
CONSTANT_PAGES = 3
SLICE_BYTES = 8 << 20

# Fixed values of HTML: elements by how they nest.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html head legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
IN_PARAGRAPH = BLOCKS - set("body caption html head legend li optgroup option tbody td tfoot th thead tr".split())
#: What a start tag closes, and the elements that keep it from being looked for further out.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CLOSES |= dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}} | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), {"table"})
SCOPE = set("table td th caption html object button".split())

#: Parts that are no main text, by element, role and words of class and id.
OUT_TAGS = set(
    "head script style noscript template nav header footer aside form button select textarea input label fieldset dialog iframe object "
    "svg canvas audio video menu search title".split()
)
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = set(
    "ad ads adbox advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion "
    "cookie cookies consent gdpr notice notices notification alert alerts nav navbar navigation menu menus menubar breadcrumb breadcrumbs "
    "sidebar sidebars aside widget widgets footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies "
    "share sharing sharebar social related recommended recommendations newsletter subscribe subscription signup signin login search "
    "searchbox pagination pager popup modal overlay skip copyright".split()
)
MAIN_WORDS = ("article", "story", "post", "entry", "content")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*+(?:\"|\Z)|=\s*'[^']*+(?:'|\Z)|[^>=]++|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """A block element of a page: children are elements and texts [text, characters in links]."""

    __slots__ = ("children", "key", "main", "out", "tag", "holds_main")

    def __init__(self, tag: str, key: str, out: bool, main: int):
        self.tag, self.key, self.out, self.main, self.children, self.holds_main = tag, key, out, main, [], False


@lru_cache(maxsize=4096)
def kind_of(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Key for alignment, whether the element is left out, and 3 for article, 2 for main, 1 for an element named so."""
    found = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), references.unescape("".join(values)))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in NAME_WORD.findall(names)}
    role = found.get("role", "").lower()
    key = " ".join(filter(None, [tag, role, *sorted(re.sub(r"\d+", "0", names).split())]))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    out = tag in OUT_TAGS or role in OUT_ROLES or hidden or bool(words & OUT_WORDS) and tag not in ("html", "body", "main")
    article = tag == "article" or role == "article" or "articleBody" in found.get("itemprop", "")
    main = 3 if article else 2 if tag == "main" or role == "main" else 1 if words & set(MAIN_WORDS) else 0
    return key, out, main


def parse(page: str) -> Element:
    """The page as a tree of block elements. Inline elements leave only their text; those left out leave nothing."""
    root = Element("#", "#", False, 0)
    stack: list[tuple[str, Element | None, bool]] = [("#", root, False)]  # (tag, element unless inline, left out though inline)
    nodes = [root]  # open elements
    text: list[str] = []
    linked = skipped = links = 0  # characters in links, open inline elements left out, open links
    open_tags: Counter = Counter()
    at = 0

    def end_block() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                nodes[-1].children.append([words, min(linked, len(words))])
            text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal skipped, links
        while len(stack) > to:
            tag, element, out = stack.pop()
            open_tags[tag] -= 1
            skipped -= out
            links -= tag == "a"
            if element is not None:
                end_block()
                if nodes[-1] is element:
                    nodes.pop()

    while at < len(page):
        found = TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at and not skipped:
            some = references.unescape(page[at:stop])
            text.append(some)
            if links:
                linked += len(some)
        if not found:
            break
        at = found.end()
        close, tag = found.group(1), found.group(2)
        if close:
            close = close.lower()
            for i in range(len(stack) - 1, 0, -1) if open_tags[close] else ():
                if stack[i][0] == close:
                    pop(i)
                    break
                if stack[i][0] in SCOPE and close not in SCOPE and close not in ("table", "tbody", "thead", "tfoot", "tr", "body"):
                    break
        elif tag:
            tag = tag.lower()
            if tag in ("br", "hr", "wbr"):
                if tag == "hr":
                    end_block()
                elif not skipped and tag == "br":
                    text.append(" ")
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                ends = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = ends.end() if ends else len(page)
                continue
            if tag in IN_PARAGRAPH and open_tags["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
            if tag in CLOSES and any(open_tags[x] for x in CLOSES[tag]):
                i, least = len(stack) - 1, None
                while i > 0 and stack[i][0] not in HOLDS[tag]:
                    if stack[i][0] in CLOSES[tag]:
                        least = i
                    i -= 1
                if least is not None:
                    pop(least)
            key, out, main = kind_of(tag, found.group(3))
            open_tags[tag] += 1
            links += tag == "a"
            if tag in BLOCKS or main or out and tag in OUT_TAGS:
                end_block()
                element, deep = Element(tag, key, out or bool(skipped), main), len(nodes) >= DEPTH
                if not deep:
                    nodes[-1].children.append(element)
                    nodes.append(element)
                    for holder in nodes[:-1] if main > 1 else ():
                        holder.holds_main = True
                stack.append((tag, element, out and deep))
                skipped += out and deep
            else:
                stack.append((tag, None, out))
                skipped += out
    pop(1)
    end_block()
    return root


def left_out(element: Element) -> bool:
    """Left out, unless an article or main part lies inside."""
    return element.out and not element.holds_main


# Wrappers are JSON: a slot is ["t", hash of its text or "", text, link characters, flags], an element
# ["e", key, items, flags, pages, kind of main], a repeated sequence ["g", items, flags].
OPTIONAL, REPEATED = 1, 2
FLAGS = {"t": 4, "e": 3, "g": 2}


def key_of(item: list) -> str:
    return item[1] if item[0] == "e" else "t" if item[0] == "t" else "g" + "\t".join(map(key_of, item[1]))


def similar(a: list, b: list) -> bool:
    """Same key; elements without a name, of which a page has many, must hold similar things too."""
    if key_of(a) != key_of(b):
        return False
    if a[0] != "e" or a[1] not in ("div", "section", "td"):
        return True
    x, y = ({key_of(i) for i in items[2]} for items in (a, b))
    return 2 * len(x & y) >= len(x | y)


def merged(a: list, b: list, flags: int = 0) -> list:
    """One item for two that are similar."""
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else "", a[2] + b[2], a[3] + b[3], a[4] | b[4] | flags]
    if a[0] == "g":
        return ["g", aligned(a[1], b[1]), a[2] | b[2] | flags]
    return ["e", a[1], aligned(a[2], b[2]), a[3] | b[3] | flags, a[4] if flags & REPEATED else a[4] + b[4], max(a[5], b[5])]


def flagged(item: list, flag: int) -> list:
    at = FLAGS[item[0]]
    return [*item[:at], item[at] | flag, *item[at + 1 :]]


def repeats(items: list) -> list:
    """Neighbours that recur become one repeated item, sequences that recur a repeated group."""
    out: list[list] = []
    last: dict[str, int] = {}  # place of the last item of a key
    group_at = None
    for item in items:
        if out and similar(out[-1], item):
            out[-1] = merged(out[-1], item, REPEATED)
            continue
        out.append(item)
        key, n = key_of(item), len(out)
        size = len(out[group_at][1]) if group_at is not None else 0
        period = n - 1 - last.get(key, n - 1)
        last[key] = n - 1
        if item[0] == "g":
            group_at = n - 1
            continue
        if size and n - 1 - group_at == size and all(map(similar, out[group_at][1], out[-size:])):
            out[group_at:] = [merged(out[group_at], ["g", out[-size:], REPEATED])]
        elif period >= 2 and n >= 2 * period and all(map(similar, out[-2 * period : -period], out[-period:])):
            out[-2 * period :] = [["g", [merged(x, y, REPEATED) for x, y in zip(out[-2 * period : -period], out[-period:], strict=True)], REPEATED]]
            group_at = len(out) - 1
        else:
            continue
        last = {key_of(x): i for i, x in enumerate(out)}
    return out


def grouped(items: list, groups: list[list]) -> list:
    """Sequences that the other side repeats become groups here too."""
    for group in groups:
        n, i, out = len(group[1]), 0, []
        while i < len(items):
            if len(items) - i >= n and all(similar(a, b) for a, b in zip(group[1], items[i : i + n], strict=True)):
                out.append(["g", items[i : i + n], 0])
                i += n
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def aligned(a: list, b: list) -> list:
    """Two sequences as one: what has no partner becomes optional, looking for the nearest place to meet again."""
    groups_a, groups_b = ([x for x in items if x[0] == "g"] for items in (a, b))
    a, b = grouped(a, groups_b) if groups_b else a, grouped(b, groups_a) if groups_a else b
    places: dict[str, list[int]] = {}
    for j, item in enumerate(b):
        places.setdefault(key_of(item), []).append(j)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if similar(a[i], b[j]):
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        meet = None
        for x in range(i, len(a)):
            if meet and x - i >= meet[0]:
                break
            y = next((y for y in places.get(key_of(a[x]), ()) if y >= j and similar(a[x], b[y])), None)
            if y is not None and (meet is None or x - i + y - j < meet[0]):
                meet = (x - i + y - j, x, y)
        if meet is None:
            break
        out += [flagged(x, OPTIONAL) for x in a[i : meet[1]] + b[j : meet[2]]]
        i, j = meet[1], meet[2]
    out += [flagged(x, OPTIONAL) for x in a[i:] + b[j:]]
    return repeats(out)


def page_items(element: Element) -> list:
    """A page's elements as the items of a wrapper; parts left out have no place in it."""
    items = []
    for child in element.children:
        if isinstance(child, list):
            items.append(["t", xxhash.xxh64_hexdigest(child[0]), len(child[0]), child[1], 0])
        elif not left_out(child):
            items.append(["e", child.key, page_items(child), 0, 1, child.main])
    return repeats(items)


def elements(items: list, path: tuple = ()) -> Iterator[tuple[tuple, list]]:
    """All elements with their paths of places; members of a group count behind one another."""
    for place, item in enumerate(spread(items)):
        if item[0] == "e":
            yield (*path, place), item
            yield from elements(item[2], (*path, place))


def spread(items: list) -> list:
    return [x for item in items for x in (spread(item[1]) if item[0] == "g" else [item])]


def weight(items: list, constant: set[str]) -> int:
    """Characters of text outside links and not in ``constant``."""
    return sum(max(0, x[2] - x[3]) * (x[1] not in constant) if x[0] == "t" else weight(x[2], constant) for x in spread(items))


def constants(items: list, pages: int) -> set[str]:
    """Hashes of texts that stand on all of at least CONSTANT_PAGES pages, if other texts vary."""
    found, varies = set(), False
    todo = [(items, pages)]
    while todo:
        some, seen = todo.pop()
        for x in spread(some):
            if x[0] == "e":
                todo.append((x[2], x[4]))
            elif x[1] and not x[4] & OPTIONAL and seen >= CONSTANT_PAGES:
                found.add(x[1])
            else:
                varies |= not x[1]
    return found if varies else set()


def plan(items: list, pages: int) -> dict:
    """The path to the main part, with the items beside it for alignment, and texts to leave out."""
    everything = list(elements(items))
    for kind in (3, 2, 1):
        marked = [(path, x) for path, x in everything if x[5] == kind and weight(x[2], set())]
        if marked:
            most = max(weight(x[2], set()) for _, x in marked)
            path = next(path for path, x in marked if weight(x[2], set()) == most)
            return {"levels": levels(items, path), "constant": []}
    constant, path, inside = constants(items, pages), [], items
    while True:
        parts = spread(inside)
        total = weight(inside, constant)
        heavy = [i for i, x in enumerate(parts) if x[0] == "e" and 5 * weight(x[2], constant) > 3 * total > 0 and not x[3] & REPEATED and x[1].split(" ")[0] not in ("p", "li", "pre")]
        if not heavy:
            return {"levels": levels(items, tuple(path)), "constant": sorted(constant), "dense": True}
        path.append(heavy[0])
        inside = parts[heavy[0]][2]


def levels(items: list, path: tuple) -> list:
    """For each step of a path: what stands on that level, as far as alignment needs it, and the place."""
    out = []
    for place in path:
        parts = spread(items)
        out.append([[[x[0], key_of(x), sorted({key_of(i) for i in x[2]}) if x[0] == "e" else [], x[FLAGS[x[0]]]] for x in parts], place])
        items = parts[place][2]
    return out


def located(root: Element, steps: list) -> list[Element]:
    """The page's elements at the path of a plan."""
    found = [root]
    for sketch, place in steps:
        following = []
        for element in found:
            at = 0
            for child in element.children:
                if isinstance(child, list) or left_out(child):
                    continue
                inner = {"t" if isinstance(x, list) else x.key for x in child.children if isinstance(x, list) or not left_out(x)}

                def fits(x: list, child: Element = child, inner: set = inner) -> bool:
                    return x[0] == "e" and x[1] == child.key and (x[1] not in ("div", "section", "td") or 2 * len(inner & set(x[2])) >= len(inner | set(x[2])))

                to = next((i for i in range(at, len(sketch)) if fits(sketch[i])), None)
                to = next((i for i, x in enumerate(sketch) if fits(x)), None) if to is None else to
                if to is None:
                    continue
                if to == place:
                    following.append(child)
                at = to if sketch[to][3] & REPEATED else to + 1
        found = following
    return found


def blocks(element: Element, constant: set[str], dense: bool, header: bool = False) -> Iterator[str]:
    """Texts of the blocks inside, without parts left out; of an article's header the headings."""
    for child in element.children:
        if isinstance(child, list):
            if not header and not (constant and xxhash.xxh64_hexdigest(child[0]) in constant) and not (dense and 2 * child[1] > len(child[0])):
                yield child[0]
        elif header:
            yield from blocks(child, constant, dense, child.tag not in HEADINGS) if child.tag in HEADINGS or not left_out(child) else ()
        elif not left_out(child):
            yield from blocks(child, constant, dense)
        elif child.tag == "header" and element.main > 1:
            yield from blocks(child, constant, dense, True)


def main_text(page: str | None, of_host: dict | None) -> str:
    root = parse((page or "").replace("\0", ""))
    chosen, found = of_host or {"levels": [], "constant": []}, []
    if chosen["levels"]:
        found = located(root, chosen["levels"])
    if not found and not (of_host and "dense" in of_host and not of_host["levels"]):
        own = plan(page_items(root), 1)
        chosen, found = own | {"constant": chosen["constant"] if "dense" in own else []}, located(root, own["levels"])
    return "\n".join(x for part in found or [root] for x in blocks(part, set(chosen["constant"]), "dense" in chosen))


WRAPPERS = "host string, salt int, pages long, wrapper string"
WRAPPER_SCHEMA = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("pages", pa.int64()), ("wrapper", pa.string())])
PLANS = "host string, plan string"


def wrapper_rows(held: dict[str, tuple[int, list]], salt: int) -> pa.RecordBatch:
    rows = [{"host": h, "salt": salt, "pages": n, "wrapper": json.dumps(w)} for h, (n, w) in held.items()]
    return pa.RecordBatch.from_pylist(rows, WRAPPER_SCHEMA)


def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of a task's pages, by host."""
    salt = TaskContext.get().partitionId() % SALTS
    held: dict[str, tuple[int, list]] = {}
    for some in slices(batches, 1, SLICE_BYTES):
        for host, page in zip(some.column(0).to_pylist(), some.column(1), strict=True):
            items = page_items(parse((page.as_py() or "").replace("\0", "")))
            before = held.get(host)
            held[host] = (1, items) if before is None else (before[0] + 1, aligned(before[1], items))
            if len(held) > HOSTS:
                yield wrapper_rows(held, salt)
                held = {}
    yield wrapper_rows(held, salt)


def folded(rows: Iterable[dict]) -> Iterator[tuple[str, int, list]]:
    """(host, pages, wrapper) of rows sorted by host."""
    host, pages, items = None, 0, None
    for row in rows:
        if items is not None and row["host"] != host:
            yield host, pages, items
            items = None
        own = json.loads(row["wrapper"])
        items, pages = (own, row["pages"]) if items is None else (aligned(items, own), pages + row["pages"])
        host = row["host"]
    if items is not None:
        yield host, pages, items


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, pages, items in folded(row for batch in batches for row in batch.to_pylist()):
        yield wrapper_rows({host: (pages, items)}, 0)


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, pages, items in folded(row for batch in batches for row in batch.to_pylist()):
        yield pa.RecordBatch.from_pylist([{"host": host, "plan": json.dumps(plan(items, pages))}])


def host_plans(pages: DataFrame) -> DataFrame:
    """(host, plan) for every host of (host, html)."""
    partial = pages.select("host", "html").mapInArrow(infer, WRAPPERS)
    for keys, step, shape in ((["host", "salt"], fold, WRAPPERS), (["host"], choose, PLANS)):
        partial = partial.repartition(*keys).sortWithinPartitions(*keys, "pages", "wrapper").mapInArrow(step, shape)
    return partial


@lru_cache(maxsize=1024)
def read_plan(text: str | None) -> dict | None:
    return json.loads(text) if text else None


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in slices(batches, 2, SLICE_BYTES):
        texts = [main_text(page.as_py(), read_plan(of_host.as_py())) for page, of_host in zip(some.column(2), some.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])
    give_back()


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    read = pages.select("page_id", "url", "html", host.alias("host"))
    plans = cut(host_plans(read), "plans")
    return read.join(plans, "host", "left").select("page_id", "url", "html", "plan").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op11_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
