"""Main text of web pages by deducing each host's template.

A page is a sequence of tokens: an element at its spot (tags with class and id, and
which of its like among its siblings, from the root down) or a text at its spot. So
a token is on a page once at most, and its occurrence vector says on which pages.

1. Pages of a host with the same blocks are one body, so that repeated rows and copies
   add nothing. Vectors are kept as mergeable fingerprints (sums of keyed hashes of the
   bodies), so they are compared without being gathered. Tokens with one vector are an
   equivalence class; it is valid if it has two tokens or more and ``share`` of the bodies.
2. A second look at the bodies keeps of each class the tokens that have the same place in its
   order wherever they are; it also sums, for each template element, the words of the slots inside it.
   Classes nest by place: a token's spot holds the spots around it.
3. The template of a host is then small: its constants (texts of valid classes), its
   menus (elements of which most words are links), and its main element, the deepest
   of several blocks that holds half of what the slots hold; a body counts the same, long or short.
4. A page's text is what its slots inside the main element hold; constants inside it stay:
   near copies of an article are no template. <article> and <main> are asked only on a page that
   lacks the host's main element. Tags that are never main text, and names of classes
   that say so, go as well. Hosts with too few bodies rest on tags and names alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored, whole, with_small
from .url_filter import host_of

#: Elements that hold no main text.
OUTSIDE = frozenset(
    "head nav header footer aside form script style noscript template svg math button select option textarea input iframe object embed canvas audio video map dialog menu datalist title".split()
)
#: Words in class or id that mark what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu sidebar header masthead footer cookie cookies consent gdpr notice notices alert "
    "popup modal overlay comment comments commentlist disqus respond share sharing social related recommended newsletter subscribe signup login breadcrumb breadcrumbs pagination pager widget toolbar skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that end a block of text where they begin or end.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select".split()
)
#: An opening tag closes an open element of these names, unless one of the third kind lies between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'<>]+)")
_WORDS = re.compile(r"[A-Za-z]+")
_ALL = (1 << 64) - 1
HEADINGS = frozenset(("h1", "h2"))


@dataclass
class _Element:
    name: str
    code: int
    index: int
    outside: bool
    article: bool
    link: bool
    heading: bool
    children: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Block:
    text: str
    element: int  # index into the page's elements
    outside: bool
    article: bool
    linked: int  # words inside links
    heading: bool


@dataclass
class Page:
    """What tokenising a page gives: its blocks, and the code and parent of each element in page order (the root is 0)."""

    blocks: list[Block] = field(default_factory=list)
    codes: list[int] = field(default_factory=lambda: [0])
    parents: list[int] = field(default_factory=lambda: [-1])

    def within(self, codes: frozenset[int]) -> list[bool]:
        """For each element whether it or one around it has one of the codes."""
        out: list[bool] = []
        for code, parent in zip(self.codes, self.parents, strict=True):
            out.append(code in codes or (parent >= 0 and out[parent]))
        return out


def _code(text: str, place: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), place & _ALL) - (1 << 63)


def _mark(name: str, raw: str) -> tuple[str, bool]:
    """How an element is written in a path, and whether its attributes put it outside the main text."""
    if not raw or raw.isspace():
        return name, False
    found = {}
    for m in _ATTRIBUTE.finditer(raw):
        key = (m[1] or m[5]).lower()
        found.setdefault(key, html.unescape(m[2] or m[3] or m[4] or ""))
    label = f"{found.get('class', '')} {found.get('id', '')}".strip()
    outside = (
        any(w.lower() in MARKS for w in _WORDS.findall(label))
        or found.get("role", "").lower() in ROLES
        or "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    )
    return f"{name}.{re.sub(r'[0-9]+', '0', label)}" if label else name, outside


def tokenise(source: str) -> Page:
    page, stack = Page(), [_Element("", 0, 0, False, False, False, False)]
    held: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                links = len(html.unescape(" ".join(linked)).split()) if linked else 0
                page.blocks.append(Block(text, top.index, top.outside, top.article, links, top.heading))
            linked.clear()

    def hold(raw: str) -> None:
        held.append(raw)
        if stack[-1].link:
            linked.append(raw)

    def close(index: int) -> None:
        if any(e.name in BLOCK or e.outside != stack[index - 1].outside for e in stack[index:]):
            flush()
        del stack[index:]

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            if not m[0].startswith(("<!", "<?")):
                hold(m[0])
            continue
        name = name.lower()
        if m[1]:
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if index:
                close(index)
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            held.append(" ")
            continue
        label, outside = _mark(name, m[3])
        outside = outside or name in OUTSIDE
        if name in BLOCK:  # a paragraph ends where any block begins
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in BLOCK), 0)
            if index and stack[index].name == "p":
                close(index)
            flush()
        if name in _CLOSES:
            ends, walls = _CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in walls:
                    break
                if stack[i].name in ends:
                    close(i)
                    break
        top = stack[-1]
        if outside and not top.outside:
            flush()
        place = top.children[label] = top.children.get(label, 0) + 1
        page.codes.append(_code(f"{place} {label}", top.code))
        page.parents.append(top.index)
        if name in VOID or m[3].endswith("/"):
            continue
        element = _Element(
            name, page.codes[-1], len(page.codes) - 1, top.outside or outside, top.article or name in ("article", "main"), top.link or name == "a", top.heading or name in HEADINGS
        )
        if name in RAW:
            close_at = re.compile(rf"</{name}", re.IGNORECASE).search(source, at)
            inner = source[at : close_at.start() if close_at else end]
            at = close_at.start() if close_at else end
            if name == "textarea":
                stack.append(element)
                held.append(inner.replace("<", "&lt;"))
                continue
            gt = source.find(">", at) if close_at else -1
            at = gt + 1 if gt >= 0 else end
            continue
        stack.append(element)
    flush()
    return page


# --- the template of a host ---------------------------------------------------------------------------

ELEMENT = np.dtype([("code", "<i8"), ("parent", "<i4")])
BLOCKS = np.dtype([("code", "<i8"), ("element", "<i4"), ("words", "<i4"), ("linked", "<i4")])


def pack_page(page: Page) -> tuple[int, bytes, bytes]:
    """Fingerprint of the blocks that may be main text, and the page's tokens in numbers."""
    elements = np.array(list(zip(page.codes[1:], page.parents[1:], strict=True)), ELEMENT)
    blocks = np.array(
        [(_code(b.text, page.codes[b.element]), b.element, len(b.text.split()), b.linked) for b in page.blocks if not b.outside], BLOCKS
    )
    inside = any(b.article for b in page.blocks)
    body = "\n".join(b.text for b in page.blocks if not b.outside and (b.article or not inside))
    return _code(body, 0), elements.tobytes(), blocks.tobytes()


def _bodies(pages: DataFrame) -> DataFrame:
    """(host, body, elements, blocks): one row for each distinct body of a host."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[tuple[str, int], tuple[bytes, bytes]] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, *rest = pack_page(tokenise(source.as_py()))
                least[host, body] = min(least.get((host, body), tuple(rest)), tuple(rest))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in least], pa.string()), pa.array([k[1] for k in least], pa.int64()), *(pa.array([v[i] for v in least.values()], pa.binary()) for i in (0, 1))],
                names=["host", "body", "elements", "blocks"],
            )

    packed = pages.mapInArrow(pack, "host string, body long, elements binary, blocks binary")
    return packed.groupBy("host", "body").agg(F.min(F.struct("elements", "blocks")).alias("page")).select("host", "body", "page.elements", "page.blocks")


def classes_of(bodies: DataFrame, share: float, least_pages: int) -> DataFrame:
    """(host, token, class): the tokens on ``share`` of a host's bodies whose vector another token has too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}  # a batch's bodies at once: a hot host sends few rows
            for host, body, elements, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lot = xxhash.xxh3_128_intdigest(body.to_bytes(8, "little", signed=True))
                one, two = lot & 0xFFFFFFFF, lot >> 96
                found = {*np.frombuffer(elements, ELEMENT)["code"].tolist(), *np.frombuffer(blocks, BLOCKS)["code"].tolist(), 0}
                for token in found:  # 0: the page itself
                    s = sums.setdefault((host, token), [0, 0, 0])
                    s[0] += 1
                    s[1] += one
                    s[2] += two
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(3))],
                names=["host", "token", "n", "one", "two"],
            )

    tokens = bodies.mapInArrow(count, "host string, token long, n long, one long, two long").groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("n", "one", "two")))
    tokens = stored(tokens.where(F.col("n") >= least_pages), "tokens")  # a token of fewer bodies is in no template
    hosts = tokens.where("token = 0").select("host", F.col("n").alias("pages"))
    frequent = tokens.where("token <> 0").join(hosts, "host").where(F.col("n") >= share * F.col("pages"))
    found = frequent.groupBy("host", "n", "one", "two").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= 2)
    return found.select("host", F.array_min("tokens").alias("class"), F.explode("tokens").alias("token"))


#: part: of the body's words outside links, in millionths.
INSIDE = ("depth", "bodies", "words", "linked", "blocks", "part")


def look_at(elements: bytes, blocks: bytes, class_of: dict[int, int]) -> dict[int, tuple[int, ...]]:
    """On one body, for each token of a class: its rank in the class's order, and what the slots inside it hold (INSIDE, zeros if nothing). 0 is the body."""
    rows, texts = np.frombuffer(elements, ELEMENT), np.frombuffer(blocks, BLOCKS)
    codes, parents = [0, *rows["code"].tolist()], [-1, *rows["parent"].tolist()]
    depth, sums = [0] * len(codes), [[0, 0, 0] for _ in codes]
    for i in range(1, len(codes)):
        depth[i] = depth[parents[i]] + 1
    constants = []
    for code, element, words, linked in texts.tolist():
        if code in class_of:  # a constant, not a slot
            constants.append((element, code))
        else:
            sums[element][0] += words
            sums[element][1] += linked
            sums[element][2] += 1
    for i in range(len(codes) - 1, 0, -1):  # an element comes after those around it
        for k in range(3):
            sums[parents[i]][k] += sums[i][k]
    plain = sums[0][0] - sums[0][1]
    out = {0: (0, 0, 1, *sums[0], 1_000_000 if plain else 0)}
    met: dict[int, int] = {}
    ordered = sorted([*((i, c, True) for i, c in enumerate(codes) if c in class_of), *((i, c, False) for i, c in constants)], key=lambda x: (x[0], not x[2]))
    for i, c, is_element in ordered:
        rank = met[class_of[c]] = met.get(class_of[c], 0) + 1
        filled = is_element and sums[i][0] > 0
        part = 1_000_000 * (sums[i][0] - sums[i][1]) // plain if plain and is_element else 0
        out[c] = (rank, depth[i], 1, *sums[i], part) if filled else (rank, depth[i], 0, 0, 0, 0, 0)
    return out


def templates(pages: DataFrame, share: float, least_pages: int) -> DataFrame:
    """(host, constants, menus, main) of each host of pages (host, html) with least_pages bodies or more.

    A host has no more template tokens than an average body has tokens, over share.
    """
    bodies = stored(_bodies(pages), "bodies")
    valid = classes_of(bodies, share, least_pages)
    known = stored(valid.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("tokens")), "classes")
    weight = F.length("_of") + 16 * F.size("tokens") + 64
    met = with_small(bodies, known.withColumnRenamed("host", "_of"), {"host": "_of"}, weight, F.col("body")).where(F.col("tokens").isNotNull()).select("host", "elements", "blocks", "tokens")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, dict[int, int]] = {}
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for i, host in enumerate(batch.column(0).to_pylist()):
                if host not in classes:
                    if len(classes) > 1000:
                        classes.clear()
                    classes[host] = {x["token"]: x["class"] for x in batch.column(3)[i].as_py()}
                for code, (rank, depth, *values) in look_at(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), classes[host]).items():
                    s = sums.setdefault((host, code), [rank, rank, depth, *[0] * len(values)])
                    s[0], s[1] = min(s[0], rank), max(s[1], rank)
                    for at, v in enumerate(values, 3):
                        s[at] += v
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(2 + len(INSIDE)))],
                names=["host", "code", "low", "high", *INSIDE],
            )

    seen = met.mapInArrow(look, "host string, code long, low long, high long, " + ", ".join(f"{c} long" for c in INSIDE))
    seen = stored(seen.groupBy("host", "code").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in INSIDE[1:])), "seen")
    whole_page = seen.where("code = 0").select("host", F.col("part").alias("all_parts"))
    judged = seen.where("code <> 0 and low = high").join(whole_page, "host")
    token = F.col("code")
    is_main = (2 * F.col("part") >= F.col("all_parts")) & (F.col("part") > 0) & (F.col("blocks") > F.col("bodies"))
    return judged.groupBy("host").agg(
        F.collect_list(F.when(F.col("bodies") == 0, token)).alias("constants"),
        F.collect_list(F.when(2 * F.col("linked") > F.col("words"), token)).alias("menus"),
        F.max(F.when(is_main, F.struct("depth", "part", "code")))["code"].alias("main"),
    )


@dataclass(frozen=True)
class Template:
    constants: frozenset[int]
    menus: frozenset[int]
    main: int | None


def main_text(source: str, template: Template | None = None) -> str:
    page = tokenise(source)
    blocks = [b for b in page.blocks if not b.outside]
    if template is None:
        in_article = any(b.article for b in page.blocks)
        return "\n".join(b.text for b in blocks if b.article or not in_article)
    in_menu, in_main = page.within(template.menus), page.within(frozenset() if template.main is None else frozenset((template.main,)))
    slots = [b for b in blocks if not in_menu[b.element]]
    found = [b for b in slots if in_main[b.element]] or [b for b in slots if b.article]  # tags speak where the page lacks the template's element
    if not found:
        return "\n".join(b.text for b in slots if _code(b.text, page.codes[b.element]) not in template.constants and not any(x.article for x in page.blocks))
    taken = {id(b) for b in found}
    rest = [b for b in slots if id(b) not in taken and _code(b.text, page.codes[b.element]) not in template.constants]
    if not any(b.heading for b in found):  # a headline before the main element is the text's own
        found = [*[b for b in rest if b.heading][:1], *found]
    return "\n".join(b.text for b in found)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.9, least_pages: int = 8
) -> DataFrame:
    """pages without html_col, with text (string, '' if none) and n_chars (its code points, long).

    Blocks are joined by one line feed; white space inside a block is one space.
    Null html counts as empty; pages with a null URL are one host. Hosts with
    fewer than least_pages pages of different main text have no template. Repeated rows
    are extracted alike and change no template. Columns named text and n_chars are
    replaced, all others are kept whatever they are called. An empty table gives an empty table.
    """
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    host, of, found_in, source_in = fresh(pages.columns, "host", "of", "template", "html")
    url, raw = host_of(whole(url_col)), whole(html_col).cast("string")
    found = stored(templates(pages.select(url.alias("host"), raw.alias("html")), share, least_pages), "templates")
    sent = found.select(F.col("host").alias(of), F.struct("constants", "menus", "main").alias(found_in))
    rows = pages.select(*names, raw.alias(source_in), url.alias(host))
    weight = F.length(of) + 8 * (F.size(F.col(found_in)["constants"]) + F.size(F.col(found_in)["menus"])) + 64
    joined = with_small(rows, sent, {host: of}, weight, F.xxhash64(source_in)).select(*names, source_in, host, found_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for batch in batches:
            k, texts = len(names), []
            for source, host, template in zip(*(batch.column(i) for i in range(k, k + 3)), strict=True):
                at = host.as_py()
                if at not in known:
                    if len(known) > 1000:
                        known.clear()
                    t = template.as_py()
                    known[at] = t and Template(frozenset(t["constants"]), frozenset(t["menus"]), t["main"])
                texts.append(main_text(source.as_py(), known[at]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return joined.mapInArrow(run, T.StructType([*joined.schema.fields[: len(names)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
