"""Main text of web pages by template deduction over pages of one host.

Every tag and every text node is a token, told apart by its place (the path of
open elements with their classes).  The occurrence vector of a
token says how often each page of the host holds it; it is kept as an
order-free fingerprint, so counting is one aggregation with partial sums and a
host with most of the pages is no special case.  Tokens with one vector form an
equivalence class.  Classes that most pages hold, once each, and whose opening
and closing tags are both members, nest into the host's template.  What lies
between template tokens are the slots; a slot's place in the template says what
it is.  The main slot is the narrowest element of the template that still holds
half of the host's text that is not template; it is read out block by block,
without texts of the template.  Tag names and class words break ties: they say
what does not count as main text, and they decide where a host has too few pages.
"""

from __future__ import annotations

import hashlib
import html as html_codec
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.llm import common
from dayweave.session import cut_lineage

#: Share of a host's pages that hold a template token, and pages that a host needs.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Share of a host's pages that confirms a part beside the article, at least two pages.
SIDE_SUPPORT = 0.05
#: Share of a host's own text that the main slot holds at least; share of a page's main slot beyond which repeated texts mean copies.
MAIN_SHARE, COPY_SHARE = 0.5, 0.75
#: Templates are broadcast up to this size; beyond it pages and templates are joined by a shuffle.
BROADCAST_BYTES = 32_000_000
#: Levels of nesting that a place spells out; what lies deeper is named by a hash of its way there.
DEEP = 100
#: Token counts held by a task before it passes them on.
HELD_TOKENS = 200_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text for readers.
SILENT = frozenset("head title script style noscript template textarea select option button iframe object svg canvas audio video map".split())
RAW = frozenset("script style textarea title noscript iframe".split())
SIDE = frozenset("nav aside footer form menu dialog".split())
CLOSED_BY_SIBLING = {
    "p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
MAIN = frozenset(["article", "main"])
#: Elements that can be a main slot.
HOLDERS = frozenset("html body div section article main td center form".split())
_SIDE_WORD = (
    r"(?:nav|navigation|navbar|menu|sidebar|side|aside|ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|newsletter|subscri\w+|share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|footer|masthead|breadcrumbs?|pagination|pager|"
    r"related|recommended|widgets?|login|signup|search|toolbar)"
)
_PLAIN_WORD = r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|box|bar|block|area|slot|unit|list|item|items|links?|buttons?|icons?|form|posts|stories|articles|thread|\d+)"
#: Whole classes and ids that mark a part beside the article: words of such parts, with words of position or shape.
SIDE_WORDS = re.compile(rf"(?:{_PLAIN_WORD}[_-])*{_SIDE_WORD}(?:[_-](?:{_SIDE_WORD}|{_PLAIN_WORD}))*|site-header|skip-link", re.I)
#: The ids that do so inside an article, where other ids are names of its own parts.
COMMENT_IDS = re.compile(r"comments?|comment[_-]?list|disqus(?:_thread)?|respond|replies", re.I)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WHITE = re.compile(r"\s+")


class Element:
    """``strong`` and ``weak`` say that tag or role, or else class or id, mark a part beside the article; ``side`` is set by ``parsed``."""

    __slots__ = ("name", "label", "path", "stem", "depth", "parent", "head", "main", "strong", "weak", "side", "slot", "silent", "chars")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        role = own.get("role", "").lower()
        self.name, self.parent = name, parent
        self.label = name + "".join(f"{mark}{own[a]}" for a, mark in (("class", "."), ("role", "@")) if own.get(a))
        self.depth = parent.depth + 1 if parent else 0
        self.path = f"{parent.path}/{self.label}" if parent else self.label
        if self.depth > DEEP:
            self.path = f"{parent.stem}/{self.label}@~{hashlib.blake2b(self.path.encode('utf-8', 'replace'), digest_size=16).hexdigest()}"
        self.stem = self.path if self.depth <= DEEP else parent.stem
        inside = bool(parent and parent.main)
        self.head = name in MAIN or role == "main"
        self.main = inside or self.head
        self.strong = name in SIDE or (name == "header" and not self.main) or role in SIDE_ROLES
        self.weak = bool(own) and not self.head and name not in ("html", "body") and (
            any(SIDE_WORDS.fullmatch(w) for w in own.get("class", "").split()) or bool((COMMENT_IDS if inside else SIDE_WORDS).fullmatch(own.get("id", "").strip()))
        )
        self.side = self.slot = False
        self.silent = bool(parent and parent.silent) or name in SILENT
        self.chars = 0


def events(page: str) -> Iterator[tuple[str, Element | None, str, str]]:
    """("open" or "close", element, tag name, "") and ("text", enclosing element, "", text) in page order.

    Tags that are not closed end with their parent; a closing tag without an
    opening one, comments and declarations give nothing.
    """
    stack: list[Element] = []
    at = 0

    def close_to(n: int) -> Iterator[tuple[str, Element | None, str, str]]:
        while len(stack) > n:
            e = stack.pop()
            yield "close", e, e.name, ""

    while at < len(page):
        m = _MARKUP.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            yield "text", stack[-1] if stack else None, "", page[at:end]
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if depth is not None and not (name not in BLOCKS and any(e.name in BLOCKS for e in stack[depth + 1 :])):
                yield from close_to(depth)
            continue
        while stack and name in CLOSED_BY_SIBLING.get(stack[-1].name, ()):
            yield from close_to(len(stack) - 1)
        if name in BLOCKS:  # an open paragraph ends, inline elements within it too
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name in BLOCKS), None)
            if depth is not None and stack[depth].name == "p":
                yield from close_to(depth)
        e = Element(name, m[3] or "", stack[-1] if stack else None)
        yield "open", e, name, ""
        if name in VOID or (m[3] or "").endswith("/"):
            yield "close", e, name, ""
            continue
        stack.append(e)
        if name in RAW:
            ended = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = ended.end() if ended else len(page)
            yield from close_to(len(stack) - 1)
    yield from close_to(0)


def clean(text: str) -> str:
    return _WHITE.sub(" ", html_codec.unescape(text)).strip()


def _text_key(path: str, text: str) -> str:
    return f"{path}#{hashlib.blake2b(text.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"


def parsed(page: str, place: str = "", side_places: frozenset[str] | None = None) -> list[tuple[str, Element | None, str, str]]:
    """The events of a page, with ``side`` and ``slot`` of its elements.

    What encloses the page's article, its main element or the main slot at
    ``place`` is no side part, nor is a form around the page's title.  A part
    marked by class or id alone counts only at one of ``side_places``, if given.
    """
    found = list(events(page))
    elements = [e for k, e, _, _ in found if k == "open"]
    marked = {id(e) for e in elements if e.strong or (e.weak and (side_places is None or e.path in side_places))}
    if marked:
        around: list[list[Element]] = []
        for e in elements:
            if e.head or (place and e.path == place):
                above, up = [], e if e.path == place else e.parent
                while up:
                    if id(up) in marked:
                        above.append(up)
                    up = up.parent
                around.append(above)
        least = min(map(len, around), default=0)
        marked -= {id(e) for above in around if len(above) == least for e in above}
        if not around:
            for e in elements:
                up = e.parent if e.name == "h1" else None
                while up:
                    if up.name == "form":
                        marked.discard(id(up))
                    up = up.parent
    for e in elements:
        e.side = id(e) in marked or bool(e.parent and e.parent.side)
        e.slot = bool(place) and (e.path == place or bool(e.parent and e.parent.slot))
    return found


def tokens(page: str) -> dict[str, list[int]]:
    """Per token of a page how often it is there, its characters outside links and side parts, and how often it is marked as a side part by class or id.

    Tokens are opening and closing tags and text nodes; an opening tag has the
    characters of all that it encloses, the empty token those of the page.
    """
    found: dict[str, list[int]] = {"": [1, 0, 0]}
    in_link = 0
    for kind, element, name, text in parsed(page):
        path = element.path if element else ""
        if kind == "text":
            if (element and element.silent) or not (text := clean(text)):
                continue
            n = 0 if in_link or (element and element.side) else len(text)
            own = found.setdefault(_text_key(path, text), [0, 0, 0])
            own[0] += 1
            own[1] += n
            found[""][1] += n
            if element:
                element.chars += n
            continue
        if name == "a":
            in_link += 1 if kind == "open" else -1
        own = found.setdefault(f"{path}{'>' if kind == 'open' else '<'}", [0, 0, 0])
        own[0] += 1
        if kind == "open":
            own[2] += element.weak
        else:
            found[f"{path}>"][1] += element.chars
            if element.parent:
                element.parent.chars += element.chars
    return found


def host(url_column) -> F.Column:
    """Lower-cased host of a url; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url_column, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def templates(pages: DataFrame, *, url: str = "url", html: str = "html", support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, template): per host the deduced template as JSON, see ``deduce``.

    Hosts with fewer than ``least_pages`` different pages have none; equal pages
    of a host count once.
    """
    rows = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).where("html is not null").withColumn("print", F.xxhash64("html", F.length("html")))
    copies = cut_lineage(rows.groupBy("host", "print").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    n_bytes = copies.agg(F.coalesce(F.sum(F.length("host") + 16), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(copies) if n_bytes <= BROADCAST_BYTES else copies, ["host", "print"], "left")
    rows = rows.select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    names = ["pages", "times", "print_a", "print_b", "chars", "side", "different"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[float]] = {}

        def out() -> pa.RecordBatch:
            values = list(zip(*held.values(), strict=True))
            kinds = [pa.int64()] * 6 + [pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))],
                names=["host", "token", *names],
            )

        for batch in batches:
            for name, page, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=16).digest()
                marks: dict[int, tuple[int, int]] = {}
                for token, (n, chars, side) in tokens(page).items():
                    if n not in marks:
                        mark = hashlib.blake2b(n.to_bytes(8, "little"), digest_size=8, key=digest).digest()
                        marks[n] = int.from_bytes(mark[:4], "little"), int.from_bytes(mark[4:], "little")
                    own = held.setdefault((name, token), [0, 0, 0, 0, 0, 0, 0.0])
                    own[0] += 1
                    own[1] += n
                    own[2] += marks[n][0]
                    own[3] += marks[n][1]
                    own[4] += chars
                    own[5] += side
                    own[6] += 1 / same
                if len(held) > HELD_TOKENS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = common.arrow_map(rows, count, "host string, token string, pages long, times long, print_a long, print_b long, chars long, side long, different double")
    counted = counted.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in names))
    # a token of a single page is never a template token; written, as the sums below read it twice
    counted = common.written(counted.where("token = '' or different > 1.5"))
    totals = counted.where("token = ''").select("host", F.col("different").alias("all_pages"), F.col("chars").alias("all_chars"))
    # a share of the pages holds at most its inverse times the tokens of a mean page, so a host's row stays small
    frequent = counted.where("token <> ''").join(totals, "host").where(F.col("all_pages") > least_pages - 0.5).where(F.col("different") > F.col("all_pages") * F.lit(min(support, SIDE_SUPPORT)) - 1e-6)
    by_host = frequent.groupBy("host", "all_pages", "all_chars").agg(F.to_json(F.sort_array(F.collect_list(F.struct("token", *names)))).alias("found"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                json.dumps(deduce(json.loads(found), n, chars, support=support, least_pages=least_pages), sort_keys=True)
                for n, chars, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "template"])

    return common.arrow_map(by_host, nest, "host string, template string")


def _named(path: str) -> str:
    """Tag name of the element at a path."""
    return re.split(r"[.@]", path.rpartition("/")[2])[0]


def _under(path: str, place: str) -> bool:
    return not place or path.startswith(f"{place}/")


def deduce(found: list[dict], all_pages: float, all_chars: int, *, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> dict:
    """A host's template from its repeated tokens: ``tokens``, ``main`` (place of the main slot, empty if it is the whole body) and ``side`` (confirmed side places)."""
    frequent = [t for t in found if t["different"] > max(2.0, all_pages * support) - 1e-6]
    classes: dict[tuple, set[str]] = {}
    for t in frequent:
        classes.setdefault((t["print_a"], t["print_b"], t["pages"], t["times"]), set()).add(t["token"])
    kept, texts = [], []
    for t in frequent:
        token, members = t["token"], classes[t["print_a"], t["print_b"], t["pages"], t["times"]]
        if token[-1] not in "<>":
            # inside an article, two pages may as well be versions of one
            if not any(_named(p) in MAIN for p in _prefixes(token.rpartition("#")[0])) or t["different"] > least_pages - 0.5:
                kept.append(token)
                texts.append(t)
        elif t["pages"] == t["times"] and token[:-1] + ("<" if token[-1] == ">" else ">") in members:
            kept.append(token)
    once = {t[:-1] for t in kept if t[-1] == ">"}
    opened = {t["token"][:-1]: t["chars"] for t in frequent if t["token"][-1] == ">"}
    for t in texts:
        all_chars -= t["chars"]
        for p in _prefixes(t["token"].rpartition("#")[0]):
            if p in opened:
                opened[p] -= t["chars"]
    holders = [p for p in opened if _named(p) in MAIN or (p in once and _named(p) in HOLDERS)]
    titles = [p for p, n in opened.items() if _named(p) == "h1" and n > 0]
    main = ""
    while all_chars > 0:
        below = [p for p in holders if _under(p, main) and opened[p] >= MAIN_SHARE * all_chars and (_named(p) in MAIN or not any(_named(x) in MAIN for x in _prefixes(p)))]
        if not below:
            break
        inner = min(below, key=lambda p: (p.count("/"), -opened[p], p))
        if _named(inner) not in MAIN and any(_under(h, main) and not _under(h, inner) for h in titles):
            break
        main = inner
    return {"tokens": sorted(kept), "main": "" if _named(main) in ("html", "body") else main, "side": sorted(t["token"][:-1] for t in found if t["side"] and t["token"][-1] == ">")}


def _prefixes(path: str) -> list[str]:
    """The places of an element and of all that enclose it."""
    parts = path.split("/")
    return ["/".join(parts[: k + 1]) for k in range(len(parts))]


class Template:
    """A host's template, ready to be held against pages; false if the host has none."""

    def __init__(self, written: str | None = None):
        read = json.loads(written) if written else {"tokens": [], "main": "", "side": []}
        self.tokens = frozenset(read["tokens"])
        self.main = read["main"]
        self.side = frozenset(read["side"]) if written else None
        self.text_places = frozenset(t.rpartition("#")[0] for t in self.tokens if t[-1] not in "<>")

    def has_text(self, path: str, text: str) -> bool:
        return path in self.text_places and _text_key(path, clean(text)) in self.tokens


NO_TEMPLATE = Template()


def extract_text(page: str | None, template: Template = NO_TEMPLATE) -> str:
    """Blocks of a page's main slot, each on white space of one space, joined by an empty line.

    The main slot is the template's; on a page without it, or if the template
    has none within the body, the page's own article and main elements, and
    without these the body.  Texts of the template are left out, unless nearly
    all of a main slot repeats, which means copies; so are side parts.  Where the
    whole body is read, blocks without a letter outside links are left out too.
    Character references are decoded within a text node.
    """
    if not page:
        return ""
    found = parsed(page, template.main, template.side)
    opened = [e for k, e, _, _ in found if k == "open" and not e.side]
    by_slot = any(e.slot for e in opened)
    has_main = by_slot or any(e.main for e in opened)

    def reads(e: Element | None) -> bool:
        if e is None:
            return not has_main
        return not (e.silent or e.side) and (e.slot if by_slot else e.main or not has_main)

    repeated = {k for k, (kind, e, _, text) in enumerate(found) if kind == "text" and reads(e) and template.has_text(e.path if e else "", text)}
    if repeated and has_main:
        sizes = {k: len(clean(text)) for k, (kind, e, _, text) in enumerate(found) if kind == "text" and reads(e)}
        if sum(sizes[k] for k in repeated) > COPY_SHARE * sum(sizes.values()):
            repeated = set()

    blocks: list[str] = []
    pieces: list[str] = []
    in_link = 0
    own = has_main

    def end_block() -> None:
        nonlocal own
        text = _WHITE.sub(" ", "".join(pieces)).strip()
        if text and own:
            blocks.append(text)
        pieces.clear()
        own = has_main

    for k, (kind, element, name, text) in enumerate(found):
        if kind == "text":
            if k in repeated or not reads(element):
                continue
            pieces.append(html_codec.unescape(text))
            own = own or not in_link and any(map(str.isalpha, pieces[-1]))
            continue
        if name == "a":
            in_link += 1 if kind == "open" else -1
        if name in BLOCKS:
            end_block()
        elif name == "br" and kind == "open":
            pieces.append(" ")
    end_block()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_template): the main text of every row of ``pages``.

    Null or empty html gives an empty text.  Rows with equal ids stay apart.  A
    null url belongs to the host without a name.  ``n_template`` is the number of
    template tokens of the page's host.  Other columns are left behind.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("_host"))
    found = templates(pages, url=url, html=html, support=support, least_pages=least_pages).withColumnRenamed("host", "_host")
    found = cut_lineage(found)
    n_bytes = found.agg(F.coalesce(F.sum(F.length("template") + F.length("_host")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(found) if n_bytes <= BROADCAST_BYTES else found, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Template] = {}
        for batch in batches:
            texts, sizes = [], []
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if template not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[template] = Template(template)
                texts.append(extract_text(page, known[template]))
                sizes.append(len(known[template].tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_template"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    return common.arrow_map(joined.select("page_id", "url", "html", "template"), run, f"page_id {kind}, url string, text string, n_chars long, n_template int")
