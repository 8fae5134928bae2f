"""HTML extraction by union-free regular expressions inferred for each host.

A page becomes a stream of tags and text slots. Streams of one host are aligned one after the other: equal parts stay,
parts that follow each other again and again become repeated groups, parts that only some pages have become optional
groups, and texts become slots, or template text where (nearly) all pages have the same. The result is the host's wrapper. It
tells which slots are no article: repeated groups of links (menus), repeated cards that lead elsewhere (teasers),
template text; and, with the text that its slots hold, which element holds the articles. Names of elements and class words that
are usual for menus, notices and the like count before that. Streams are folded and counted before they are
shuffled, so a host with a third of all pages sends its few shapes, and these are aligned in groups of bounded
size, whose wrappers are aligned again.
"""

from __future__ import annotations

import functools
import html as entities
import json
import math
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialise

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no markup.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")
#: Elements that are never part of the article; a form only where it holds no article.
OUTSIDE = frozenset("head nav header footer aside button select option menu dialog label fieldset object canvas video audio map".split()) | frozenset(RAW)
#: Words of class, id or role for what is no part of the article, wherever it stands.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter"
    " comment comments commentlist disqus respond reply replies discussion related recommended share sharing social pagination pager tagcloud".split()
)
#: Words for parts of a layout; an article or main element inside such a part counts nevertheless.
LAYOUT_NAMES = frozenset(
    "banner notice notices notification alert subscribe subscription signup signin login register menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars rail aside complementary widget widgets"
    " footer foot contentinfo header masthead topbar toolbar search searchbox skip print hidden form dialog".split()
)
#: Words for the parts of an article, where a host has neither article nor main elements.
ARTICLE_NAMES = frozenset("article content post story entry main".split())
#: Words that make a part's name of a word before them, as in comment-list, and words that deny the one after them, as in no-sidebar.
PART_NAMES = frozenset("list area box wrapper wrap container section bar block form left right top bottom inner menu item items links link widget banner region panel holder group column col main primary secondary message text".split())
DENIALS = frozenset("no not has with without is hide hides show toggle".split())
#: Start tags that close an open element of these names.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {
    x: ("p",) for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul figure".split()
}
# A tag ends at the first > outside quoted values; quotes that are not closed as such do not count. Nothing is scanned beyond the next < or 2000 characters.
_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)(?:((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>|((?:[^<>\"'=]|=\s*+\"[^\"]{0,2000}+\"(?=[\s/>])|=\s*+'[^']{0,2000}+'(?=[\s/>])|=)*+)>|([^<>]*+)>)", regex.DOTALL
)
_ATTRIBUTE = regex.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", regex.IGNORECASE)
_RAW_END = {x: regex.compile(rf"</{x}\s*>", regex.IGNORECASE) for x in RAW}
_NAME_PART = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TEXT = "#"
#: Template text has at most this many characters; shapes aligned in one task; cells of an alignment beyond which the differing middles are optional as they are.
TEMPLATE_CHARS, FAN_IN, MOST_CELLS = 400, 64, 1 << 27
#: Template text is on this share of a host's different pages, on so many of them at least, and all of it is at most this share of their text.
TEMPLATE_SHARE, TEMPLATE_PAGES, TEMPLATE_MASS = 0.9, 5, 0.3
#: Hosts whose verdicts are copied to all executors instead of shuffled.
MOST_COPIED_HOSTS = 100_000
HARD, SOFT, IN_ARTICLE, IN_MAIN, LINKED, NAMED = 1, 2, 4, 8, 16, 32


@functools.lru_cache(1 << 16)
def class_words(value: str) -> tuple[tuple[str, ...], int]:
    """(letters of each class word, whether one of them marks a part outside the article, HARD or SOFT, or in it, NAMED)."""
    words, flag = [], 0
    for token in value.split():
        parts = [x.lower() for x in _NAME_PART.findall(token)]
        if not parts:
            continue
        words.append("-".join(parts))
        if len(parts) == 1 or parts[0] not in DENIALS:
            marks = {parts[-1]} | ({parts[0]} if set(parts[1:]) <= PART_NAMES else set())
            flag |= HARD * bool(marks & OUTSIDE_NAMES) | SOFT * bool(marks & LAYOUT_NAMES) | NAMED * (not ARTICLE_NAMES.isdisjoint(parts))
    return tuple(sorted(set(words))), flag


@functools.lru_cache(1 << 16)
def _described(name: str, attributes: str) -> tuple[str, int]:
    """(symbol, flags of its own) of a start tag."""
    words, flag = [], 0
    for a in _ATTRIBUTE.finditer(attributes):
        found, own = class_words(a[2] or a[3] or a[4] or "")
        words += found
        flag |= own
    if name in ("html", "body", "main"):
        flag = 0
    elif name == "article":
        flag &= HARD
    return name + "".join(f".{w}" for w in sorted(set(words))), flag | (HARD if name in OUTSIDE else SOFT if name == "form" else 0)


def path_hash(parent: int, symbol: str) -> int:
    return xxhash.xxh64_intdigest(symbol, parent & 0xFFFFFFFFFFFFFFFF) >> 1


def opened(state: tuple[int, int], name: str, symbol: str, own: int) -> tuple[int, int]:
    """(path, flags) inside an element, from those around it."""
    path, flags = state
    if name in ("article", "main"):
        flags = flags & ~SOFT | (IN_ARTICLE if name == "article" else IN_MAIN)
    return (path if name in INLINE else path_hash(path, symbol)), flags | own | (LINKED if name == "a" else 0)


def stream(page: str) -> tuple[list[str], list[tuple[int, int, str]]]:
    """(tags and slots in order, (path, flags, text) of each block of text); inline tags other than links are no part of the shape."""
    shape: list[str] = []
    blocks: list[tuple[int, int, str]] = []
    stack: list[tuple[str, tuple[int, int]]] = []
    now, count, piece, linked, at, size = (0, 0), Counter(), [], 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if piece:
            raw = "".join(piece)
            text = " ".join(entities.unescape(raw).split())
            piece.clear()
            if text:
                blocks.append((now[0], now[1] & ~LINKED | (LINKED if linked > 0.8 * len(raw.strip()) else 0), text))
            linked = 0

    def text(upto: int) -> None:
        nonlocal linked
        if upto > at:
            part = page[at:upto]
            if (not shape or shape[-1] != TEXT) and not part.isspace():
                shape.append(TEXT)
            piece.append(part)
            if now[1] & LINKED:
                linked += len(part)

    def pop(upto: int) -> None:
        nonlocal now
        for x, _ in stack[:upto - len(stack) - 1:-1] if upto < len(stack) else ():
            count[x] -= 1
            if x not in INLINE or x == "a":
                shape.append(f"/{x}")
        now = stack[upto][1]
        del stack[upto:]

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(size)
            break
        text(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            if count[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        pop(i)
                        break
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        for other in CLOSES.get(name, ()):
            if count[other]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == other:
                        pop(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in CLOSES[name]:
                        break
        attributes = m[3] or m[4] or m[5] or ""
        symbol, own = _described(name, attributes) if len(attributes) < 500 else _described.__wrapped__(name, attributes)
        alone = name in VOID or attributes.rstrip().endswith("/")
        if name not in INLINE or name == "a":
            shape += [symbol, f"/{name}"] if alone and name not in VOID else [symbol]
        if not alone:
            stack.append((name, now))
            count[name] += 1
            now = opened(now, name, symbol, own)
    flush()
    return shape, blocks


# A wrapper is a list of nodes: a string (tag or slot), ["+", nodes] (repeated) or ["?", nodes] (optional).


def fold(nodes: list, longest: int = 12) -> list:
    """Equal neighbouring parts become one repeated group, shortest parts first."""
    for size in range(1, longest + 1):
        out: list = []
        for x in nodes:
            out.append(x)
            if len(out) < size + 1:
                continue
            if len(out) >= 2 * size and out[-1] == out[-1 - size] and out[-size:] == out[-2 * size : -size]:
                del out[-size:]
                if size > 1 or not isinstance(out[-1], list) or out[-1][0] != "+":
                    out[-size:] = [["+", out[-size:]]]
            before = out[-size - 1] if len(out) > size else None
            if isinstance(before, list) and before[0] == "+" and len(before[1]) == size and before[1] == out[-size:]:
                del out[-size:]
        nodes = out
    return nodes


def absorb(nodes: list, groups: list) -> list:
    """Single occurrences of what is a repeated group elsewhere become that group."""
    for g in {json.dumps(g): g for g in groups}.values():
        inside, out, i = g[1], [], 0
        while i < len(nodes):
            if nodes[i] == inside[0] and nodes[i : i + len(inside)] == inside:
                out.append(g)
                i += len(inside)
            else:
                out.append(nodes[i])
                i += 1
        nodes = fold(out) if len(out) < len(nodes) else nodes
    return nodes


def _bare(x):
    return x[1] if isinstance(x, list) and x[0] == "?" else None


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, where an optional node equals its content.

    Rows of the table are bit vectors, so an alignment takes len(a) steps over integers of len(b) bits.
    """
    key = lambda x: json.dumps(_bare(x)[0] if _bare(x) is not None and len(_bare(x)) == 1 else x)
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    head = 0
    while head < min(len(a), len(b)) and ka[head] == kb[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    pairs = []
    if n and m and n * m <= MOST_CELLS:
        where: dict[str, int] = {}
        for j in range(m):
            where[kb[head + j]] = where.get(kb[head + j], 0) | 1 << j
        ones = (1 << m) - 1
        row, rows = ones, []
        for i in range(n):  # bit j of a row is 0 where the length grows at column j
            rows.append(row)
            u = row & where.get(ka[head + i], 0)
            row = (row + u | row - u) & ones
        rows.append(row)
        i, j = n, m
        while i and j:
            if ka[head + i - 1] == kb[head + j - 1] and not rows[i] >> j - 1 & 1 and rows[i - 1] >> j - 1 & 1:
                pairs.append((head + i - 1, head + j - 1))
                i, j = i - 1, j - 1
            elif not rows[i] >> j - 1 & 1:  # column j adds to the length of row i, by an earlier row
                i -= 1
            else:
                j -= 1
    return [(i, i) for i in range(head)] + pairs[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: list, b: list) -> list:
    """The least general wrapper found that matches what a and b match: a longest common part, the rest optional."""
    groups = [x for x in (*a, *b) if isinstance(x, list) and x[0] == "+"]
    a, b = absorb(a, groups), absorb(b, groups)
    out: list = []
    i = j = 0
    for p, q in [*common(a, b), (len(a), len(b))]:
        out += [x if _bare(x) is not None else ["?", [x]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(a[p] if _bare(a[p]) is not None else b[q])
        i, j = p + 1, q + 1
    return out


def wrapper(shapes: list[list]) -> list:
    """The wrapper of folded streams, aligned one after the other."""
    out = shapes[0]
    for s in shapes[1:]:
        if s != out:
            out = align(out, s)
    return out


def slots_outside(nodes: list) -> tuple[list[int], list[int]]:
    """Paths of the slots of menus (repeated groups with links only) and of teasers (article elements, repeated or led by a link, with a link in them)."""
    menus: set[int] = set()
    teasers: set[int] = set()
    stack: list[list] = []  # name, (path, flags) around it, and for an article: its slots' paths, whether a link leads, whether it is repeated
    now = (0, 0)

    def walk(part: list, repeated: bool) -> list[tuple[int, bool]]:
        nonlocal now
        found: list[tuple[int, bool]] = []
        for x in part:
            if isinstance(x, list):
                inside = walk(x[1], repeated or x[0] == "+")
                if x[0] == "+" and inside and all(linked for _, linked in inside):
                    menus.update(p for p, _ in inside)
                found += inside
            elif x == TEXT:
                linked = bool(now[1] & LINKED)
                found.append((now[0], linked))
                for s in stack:
                    if s[0] == "article":
                        s[2].append((now[0], linked))
            elif x[0] == "/":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == x[1:]:
                        now = stack[i][1]
                        for s in stack[i:]:
                            links = [linked for _, linked in s[2]]
                            if s[0] == "article" and (any(links[:1]) or s[3] and any(links)):
                                teasers.update(p for p, _ in s[2])
                        del stack[i:]
                        break
            else:
                name = x.split(".")[0]
                if name not in VOID:
                    stack.append([name, now, [], repeated])
                    now = opened(now, name, x, 0)
        return found

    walk(nodes, False)
    return sorted(menus), sorted(teasers)


def region(article: int, main: int, named: int, everything: int) -> str | None:
    """The element that holds a host's articles, by the characters of its pages outside links and marked parts."""
    if article and 2 * article >= main and 4 * article >= everything:
        return "article"
    if main and 4 * main >= everything:
        return "main"
    return "named" if named and not article and not main and 4 * named >= everything else None


def article_text(blocks: list[tuple[int, int, str]], root: str | None, menus: frozenset[int], teasers: frozenset[int], fixed: frozenset[int]) -> str:
    """The text of a page by its host's verdicts; a page without the element that holds its host's articles is taken whole."""
    some = [b for b in blocks if not b[1] & (HARD | SOFT)]
    at = {"article": IN_ARTICLE, "main": IN_MAIN, "named": NAMED}.get(root or "", 0)
    inside = [b for b in some if b[1] & at]
    if not inside:
        inside = [b for b in some if not (b[1] & LINKED and b[0] in menus)]
    elsewhere = [b for b in inside if b[0] not in teasers]
    own = elsewhere or inside
    return " ".join(t for _, _, t in own if not fixed or len(t) > TEMPLATE_CHARS or text_hash(t) not in fixed)


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_PARSED = "page_id bigint, url string, host string, shape string, blocks binary, content bigint, article bigint, main bigint, named bigint, everything bigint, short array<struct<text: bigint, chars: bigint>>"
_ARROW = [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shape", pa.string()), ("blocks", pa.binary())] + [(x, pa.int64()) for x in ("content", "article", "main", "named", "everything")] + [("short", pa.list_(pa.struct([("text", pa.int64()), ("chars", pa.int64())])))]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part, rows = batch.slice(begin, 500), []
            for page_id, url, page in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html")):
                shape, blocks = stream(page.as_py() or "")
                inside = [b for b in blocks if not b[1] & (HARD | SOFT)]
                free = [(b[1], len(b[2])) for b in inside if not b[1] & LINKED]
                short = {text_hash(b[2]): len(b[2]) for b in inside if len(b[2]) <= TEMPLATE_CHARS}
                mass = [sum(n for f, n in free if f & at == at) for at in (IN_ARTICLE, IN_MAIN, NAMED, 0)]
                rows.append((page_id, url, _host(url), json.dumps(fold(shape)), packer.compress(json.dumps(blocks).encode()), text_hash("\n".join(b[2] for b in inside)), *mass, [{"text": h, "chars": n} for h, n in short.items()]))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ARROW)], names=[n for n, _ in _ARROW])


def infer_wrappers(shapes: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """host and wrapper (JSON) from shapes (host, shape, n).

    Shapes are aligned in groups of about `fan_in`, most frequent first, and the groups' wrappers again, until each host has
    one: as many rounds as the most different shapes of a host need.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "shape"], ascending=[False, True])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "shape": [json.dumps(wrapper([json.loads(s) for s in rows["shape"]]))], "n": [int(rows["n"].sum())]})

    shapes = materialise(shapes.select("host", "shape", "n"))
    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while True:
        groups = math.ceil(most / fan_in)
        # a host's own number of groups follows from its number of shapes, so that small hosts need one
        sizes = shapes.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / fan_in)).alias("groups"))
        dealt = shapes.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.col("groups")))
        shapes = dealt.groupBy("host", "part").applyInPandas(one, "host string, shape string, n bigint")
        if groups == 1:
            return shapes.select("host", F.col("shape").alias("wrapper"))
        shapes, most = materialise(shapes), groups


def template_texts(parsed: DataFrame) -> DataFrame:
    """host and fixed (hashes of the texts that its template holds), for hosts that have any."""
    once = parsed.groupBy("host", "content").agg(F.max("everything").alias("everything"), F.first("short").alias("short"))
    hosts = once.groupBy("host").agg(F.count("*").alias("pages"), F.sum("everything").alias("mass"))
    counts = once.select("host", F.explode("short").alias("x")).groupBy("host", F.col("x.text").alias("text")).agg(F.count("*").alias("n"), F.max("x.chars").alias("chars"))
    often = counts.filter(F.col("n") >= TEMPLATE_PAGES).join(hosts.filter(F.col("pages") >= TEMPLATE_PAGES), "host").filter(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    found = often.groupBy("host").agg(F.collect_list("text").alias("fixed"), (F.sum(F.col("chars") * F.col("n")) / F.greatest(F.max("mass"), F.lit(1))).alias("share"))
    return found.filter(F.col("share") <= TEMPLATE_MASS).select("host", "fixed")


def host_verdicts(parsed: DataFrame) -> DataFrame:
    """host, root (article, main, named or null), menus and teasers (paths of slots) and fixed (hashes of template texts)."""

    @F.udf("struct<menus: array<bigint>, teasers: array<bigint>>")
    def outside(found: str):
        return slots_outside(json.loads(found))

    @F.udf("string")
    def root(article: int, main: int, named: int, everything: int):
        return region(article, main, named, everything)

    shapes = parsed.groupBy("host", "shape").agg(F.count("*").alias("n"))
    masses = parsed.groupBy("host").agg(*(F.sum(x).alias(x) for x in ("article", "main", "named", "everything")))
    one = infer_wrappers(shapes).select("host", outside("wrapper").alias("x"))
    return one.join(masses, "host").join(template_texts(parsed), "host", "left").select("host", root("article", "main", "named", "everything").alias("root"), "x.menus", "x.teasers", "fixed")


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opener, sets = zstandard.ZstdDecompressor(), functools.lru_cache(4096)(frozenset)
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            verdicts = zip(*(part.column(x).to_pylist() for x in ("root", "menus", "teasers", "fixed")))
            texts = [article_text(json.loads(opener.decompress(packed)), root, *(sets(tuple(x or ())) for x in rest)) for packed, (root, *rest) in zip(part.column("blocks").to_pylist(), verdicts)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    A null html, or one without article text, gives an empty text. Pages without a host share a wrapper. Pages of any length
    are read whole, in time in proportion to them; repeated rows are extracted each and count once for template
    text; shapes that tie in number are aligned in text order, so reruns agree; an empty table gives no rows; other columns
    are ignored. page_id may be null.
    """
    parsed = materialise(pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_parse, _PARSED))
    verdicts = materialise(host_verdicts(parsed))
    if verdicts.count() <= MOST_COPIED_HOSTS:  # beyond that the pages are shuffled, and a hot host's are split by adaptive execution
        verdicts = F.broadcast(verdicts)
    return parsed.select("page_id", "url", "host", "blocks").join(verdicts, "host").select("page_id", "url", "root", "menus", "teasers", "fixed", "blocks").mapInArrow(_choose, "page_id bigint, url string, text string, n_chars bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
