"""Main text of web pages: blocks by markup, and boilerplate by a suffix array for each host.

Markup says which blocks are menus, adverts, forms and the like, and which stand in an
article. A name is no proof: what holds the main element, or the page's text, stays whatever
it is called, and a part of an article that is named like boilerplate but reads like prose is
left to the host. The token streams of the pages of one host are concatenated and their suffixes
sorted as deep as the shortest repeat that counts. A run of tokens that stands on enough
distinct pages of the host is boilerplate and is removed; unique runs are kept. Large hosts
are dealt into chunks of bounded size: a run that is frequent on a host is frequent in one of
its chunks, so chunks name candidates, which are then counted over all pages of the host.
Pages with the same token stream are one page.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, offered, sliced, table, written

#: Distinct pages of a chunk on average, its tokens on average, and rows that are cleaned at a time.
CHUNK, CHUNK_TOKENS, CHUNK_ROWS = 256, 1 << 20, 1_000
#: Pages of which a task remembers that it has passed them on.
REMEMBERED = 100_000
#: Doublings of the suffix order, so repeats have 2**3 tokens at least.
DOUBLINGS = 3
SPAN = 2**DOUBLINGS
#: Least distinct pages of a run, and its least share of a host's distinct pages: where text stands in an article, and elsewhere.
LEAST_PAGES, ARTICLE_SHARE, OTHER_SHARE = 5, 0.6, 0.2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|math)\b[^>]*+(?:/>|>.*?(?:</(?P=raw)\s*+>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|<[a-zA-Z/!?][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head button select option label dialog menu object audio video canvas".split())
#: Elements around the page's text, if they are closed where they should be.
_LAYOUT_TAGS = frozenset("nav footer header aside".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that say what no main text is, and words that may stand beside them.
_TELLING = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adsbygoogle sponsor sponsored sponsors promo promos promotion promotions"
    " nav navbar navigation menu menus masthead breadcrumb breadcrumbs sidebar sidebars cookie cookies consent gdpr ccpa notice notices alert"
    " popup modal overlay banner banners teaser teasers newsletter subscribe subscription signup login share sharing social related recommended recommendations"
    " comment comments reply replies respond disqus feedback widget widgets pager pagination toolbar copyright footer tagcloud topbar bottombar".split()
)
_BESIDE = frozenset(
    "box container wrapper wrap block section area slot bar top bottom left right main site page global primary secondary list item items link links"
    " button buttons form panel inner outer holder content post posts article articles news stories story more thread unit text message js column col row"
    " fixed sticky mobile desktop user users reader readers legal search skip side the and your our".split()
)
#: Those among the telling words that name a part of the page's layout, and those that name what readers write.
_LAYOUT = frozenset("nav navbar navigation menu menus masthead sidebar sidebars banner banners widget widgets toolbar footer topbar bottombar header overlay modal popup".split())
_READERS = frozenset("comment comments reply replies respond disqus feedback".split())
#: Least words and share of characters outside links of a named part of an article that reads like prose.
PROSE_WORDS, PROSE_SHARE = 25, 0.8
_CONTENT = frozenset("content main maincontent articlebody postcontent entrycontent storybody articlecontent postbody bodycontent pagecontent".split())


def _named(names: str, inside: bool) -> str | None:
    """layout, readers or other where a name consists of telling words and of such as may stand beside them."""
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x]
        telling = [x in _TELLING or (x == "header" and not inside) for x in parts]
        if any(telling) and all(t or x in _BESIDE for t, x in zip(telling, parts, strict=True)):
            words = {x for t, x in zip(telling, parts, strict=True) if t}
            return "readers" if words & _READERS else "layout" if words <= _LAYOUT else "other"
    return None


def _is_dropped(tag: str, attrs: dict) -> bool:
    """Whether an element is never a part of a main text: controls, and what is hidden."""
    if tag in _DROPPED:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))


def _mark_of(tag: str, attrs: dict, inside: bool) -> str | None:
    """What an element's tag, role or names tell of it: layout, readers, other, or nothing."""
    if tag in _LAYOUT_TAGS and not (tag == "header" and inside):
        return "layout"
    if not attrs or tag in ("html", "body", "main", "article") or tag in _HEADINGS:
        return None
    if attrs.get("role", "").lower() in _ROLES:
        return "layout"
    return _named(f"{attrs.get('class', '')} {attrs.get('id', '')}", inside)


def _is_content(attrs: dict) -> bool:
    return any(re.sub(r"[^a-z]", "", name.lower()) in _CONTENT for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split())


class _Mark:
    """A marked element: what its names tell, whether it stands in an article, and whether it holds the main element."""

    __slots__ = ("kind", "inside", "holds_main")

    def __init__(self, kind: str, inside: bool):
        self.kind, self.inside, self.holds_main = kind, inside, False


class _Block:
    """Text of a block, its characters outside links, and whether it stands in an article, a form, a content element and in marked elements."""

    __slots__ = ("text", "plain", "inside", "in_form", "in_content", "marks", "doubtful")

    def __init__(self, text: str, plain: int, inside: bool, in_form: bool, in_content: bool, marks: tuple[_Mark, ...]):
        self.text, self.plain, self.inside, self.in_form, self.in_content, self.marks = text, plain, inside, in_form, in_content, marks
        self.doubtful = False


def _unmarked(found: list[_Block]) -> list[_Block]:
    """The blocks that no marked element drops; those that only the host can judge are doubtful.

    An element is not dropped if it holds the main element, or if it is layout, no article or main
    element has text outside of marked elements, and it holds most of the page's text; its blocks of
    links go then. In an article, a marked element other than readers' words is doubtful
    if it reads like prose; it counts as one with what it holds.
    """
    has_article = any(b.inside and b.plain for b in found if not b.marks)
    told = lambda b, but=None: any(x.kind != "layout" and not x.holds_main for x in b.marks if x is not but)
    page = sum(b.plain for b in found if not told(b))
    held: dict[_Mark, list[_Block]] = {}
    for b in found:
        for m in b.marks:
            held.setdefault(m, []).append(b)
    verdicts: dict[_Mark, str] = {}
    for m, own in held.items():
        plain = sum(b.plain for b in own if not told(b, m))
        if m.holds_main:
            verdicts[m] = "stays"
        elif m.kind == "layout" and not has_article and plain * 2 > page:
            verdicts[m] = "unclosed"
        elif m.inside and m.kind != "readers" and sum(b.text.count(" ") + 1 for b in own) >= PROSE_WORDS and sum(b.plain for b in own) >= PROSE_SHARE * sum(len(b.text) - b.text.count(" ") for b in own):
            verdicts[m] = "doubtful"
        else:
            verdicts[m] = "goes"
    out = []
    for b in found:
        of = {verdicts[m] for m in b.marks}
        linked = "unclosed" in of and b.plain * 2 < len(b.text) - b.text.count(" ")
        if "goes" in of or linked:
            continue
        b.doubtful = "doubtful" in of
        out.append(b)
    return out


def _chosen(found: list[_Block]) -> list[_Block]:
    """The main text among the blocks that no element drops.

    Forms go unless most of the text stands in them. Blocks of articles are the main text if
    there are any, unless other text outweighs them: three times as much in a content element,
    or four times as much and over 600 characters anywhere.
    """
    size = lambda some: sum(b.plain for b in some)
    own = [b for b in found if not b.in_form]
    own = found if size(own) * 2 < size(found) else own
    main, others = [b for b in own if b.inside], [b for b in own if not b.inside]
    if not main:
        return own
    if size([b for b in others if b.in_content]) > 3 * size(main):
        return [b for b in own if b.in_content]
    return own if size(others) > max(600, 4 * size(main)) else main


def marked_blocks(page: str | None) -> list[tuple[str, bool]]:
    """(block, whether it is an article's): the main text by markup in page order, white space collapsed."""
    stack: list[tuple[str, bool, bool, bool, bool, tuple]] = []  # tag, dropped, in an article, a form, a content element, marked elements
    none = ("", False, False, False, False, ())
    text: list[tuple[str, bool]] = []
    found: list[_Block] = []

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(t for t, _ in text)).split())
            plain = sum(len("".join(html.unescape(t).split())) for t, linked in text if not linked)
            text.clear()
            if block:
                found.append(_Block(block, plain, *(stack[-1] if stack else none)[2:]))

    def pop_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at, page, links = 0, page or "", 0
    for m in _TAG.finditer(page):
        top = stack[-1] if stack else none
        if m.start() > at and not top[1]:
            text.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if m["close"] else 1
        if tag in _VOID:
            if tag == "br":
                text.append((" ", True))
            elif tag == "hr":
                flush()
            continue
        tags = [s[0] for s in stack]
        if m["close"]:
            if tag in tags:
                depth = len(tags) - 1 - tags[::-1].index(tag)
                if _BLOCKS.isdisjoint(tags[depth:]):
                    del stack[depth:]
                elif tag in _BLOCKS:
                    pop_to(depth)
            elif tag in _BLOCKS:
                flush()
            continue
        if tag in _BLOCKS:
            flush()
            links = 0
            if "p" in tags:
                pop_to(len(tags) - 1 - tags[::-1].index("p"))
            elif tag in _CLOSES:
                for depth in range(len(stack) - 1, -1, -1):
                    if tags[depth] in _CLOSES[tag]:
                        pop_to(depth)
                        break
                    if tags[depth] in ("ul", "ol", "dl", "table", "tbody", "thead", "div", "article"):
                        break
            elif tag in ("article", "main"):
                for depth, t in enumerate(tags):
                    if t in ("nav", "header", "head"):
                        pop_to(depth)  # it was never closed
                        break
        if not m["attrs"].endswith("/"):
            _, dropped, inside, in_form, in_content, marks = stack[-1] if stack else none
            attrs = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
            gone = dropped or _is_dropped(tag, attrs)
            kind = None if gone else _mark_of(tag, attrs, inside)
            if (gone and not dropped) or kind:
                flush()
            if tag == "main" and not gone:
                for mark in marks:
                    mark.holds_main = True
            stack.append((tag, gone, inside or (not gone and tag in ("article", "main")), in_form or tag == "form" or attrs.get("role") == "form", in_content or _is_content(attrs), (*marks, _Mark(kind, inside)) if kind else marks))
    if at < len(page) and not (stack[-1] if stack else none)[1]:
        text.append((page[at:], links > 0))
    flush()
    kept = _unmarked(found)
    chosen = {id(b) for b in _chosen([b for b in kept if not b.doubtful])}
    return [(b.text, not b.doubtful and (b.inside or b.in_content)) for b in kept if b.doubtful or id(b) in chosen]


def blocks(page: str | None) -> list[str]:
    """Blocks of the main text by markup, in page order, white space collapsed."""
    return [b for b, _ in marked_blocks(page)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed(tokens: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.array([known.get(t) or known.setdefault(t, xxhash.xxh3_64_intdigest(t) >> 1) for t in tokens], np.uint64)


def windows(stream: np.ndarray) -> np.ndarray:
    """A hash of the SPAN tokens that begin at each place."""
    n = max(0, len(stream) - SPAN + 1)
    total = np.zeros(n, np.uint64)
    for i in range(SPAN if n else 0):
        total = _mixed(total + stream[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return total.view(np.int64)


def runs(pages: list[np.ndarray], least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(run, pages): the runs of SPAN tokens that stand on so many pages at least, and on how many.

    The streams are concatenated with a separator of its own after each page. Doubling sorts
    all suffixes by their first SPAN tokens; suffixes of one rank begin with the same run, and
    any longer repeat is covered by these.
    """
    stream = np.concatenate([np.append(p, np.uint64((1 << 63) + k)) for k, p in enumerate(pages)])
    page = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    _, rank = np.unique(stream, return_inverse=True)
    step = 1
    for _ in range(DOUBLINGS):
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
        step *= 2
    order = np.lexsort((page, rank))  # the suffix array as deep as SPAN
    ranks, owners = rank[order], page[order]
    first = np.ones(len(order), bool)
    first[1:] = (ranks[1:] != ranks[:-1]) | (owners[1:] != owners[:-1])
    stands_on = np.bincount(ranks[first], minlength=int(ranks.max()) + 1)
    begins = np.zeros(len(order), bool)
    begins[0], begins[1:] = True, ranks[1:] != ranks[:-1]
    places = order[begins & (stands_on[ranks] >= least)]
    places = places[places + SPAN <= len(stream)]
    last = places + SPAN - 1
    places = places[(page[last] == page[places]) & (stream[last] < np.uint64(1 << 63))]  # whole on its page
    return windows(stream)[places], stands_on[rank[places]]


def covered(own: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens a window among those found covers; own: the windows of the n tokens."""
    marks = np.zeros(n + SPAN + 1, np.int64)
    starts = np.flatnonzero(np.isin(own, found))
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + SPAN, -1)
    return np.cumsum(marks)[:n] > 0


def repeated_tokens(pages: list[list[str]], least_pages: int = LEAST_PAGES, least_share: float = ARTICLE_SHARE) -> list[np.ndarray]:
    """For each page of tokens, which of them a run covers that stands on enough pages."""
    streams = [hashed(p) for p in pages]
    found, n = runs(streams) if pages else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = found[n >= max(least_pages, np.ceil(least_share * len(pages)))]
    return [covered(windows(s), found, len(s)) for s in streams]


def cleaned(page: list[tuple[str, bool]], everywhere: np.ndarray, outside: np.ndarray) -> str:
    """Text of a page without runs: those everywhere, and outside articles the others too.

    An article of which more than half would go is a copy of others and stays whole.
    """
    tokens = [b.split(" ") for b, _ in page]
    inside = np.repeat([i for _, i in page], [len(t) for t in tokens]).astype(bool)
    own = windows(hashed([t for b in tokens for t in b]))
    gone = covered(own, everywhere, len(inside))
    if (gone & inside).sum() * 2 > inside.sum():
        gone[inside] = False
    gone |= covered(own, outside, len(inside)) & ~inside
    kept, at = [], 0
    for (block, _), t in zip(page, tokens, strict=True):
        here = gone[at : at + len(t)]
        at += len(t)
        if not here.any():
            kept.append(block)
        elif not here.all():
            kept.append(" ".join(x for x, g in zip(t, here, strict=True) if not g))
    return "\n".join(kept)


def main_texts(pages: list[list[str]]) -> list[str]:
    """Texts of the pages of one host, each a list of blocks that stand in no article."""
    streams = {" ".join(p): None for p in pages}
    distinct = [hashed(s.split(" ")) for s in streams]
    found, n = runs(distinct) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = found[n >= max(LEAST_PAGES, np.ceil(OTHER_SHARE * len(distinct)))]
    return [cleaned([(b, False) for b in p], found[:0], found) for p in pages]


def _pack(page: list[tuple[str, bool]]) -> bytes:
    return zlib.compress("\n".join(f"{'+' if i else '-'}{b}" for b, i in page).encode())


def _unpack(packed: bytes) -> list[tuple[str, bool]]:
    text = zlib.decompress(packed).decode()
    return [(b[1:], b[0] == "+") for b in text.split("\n")] if text else []


def _parse(batches):
    """(id, url, host, stream, first, tokens, packed): a hash of the tokens, whether the task sees them first, their number, the blocks."""
    seen: set[tuple[str, int]] = set()
    for batch in sliced(batches):
        streams, first, tokens, packed = [], [], [], []
        for page, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = marked_blocks(page)
            text = " ".join(b for b, _ in own)
            streams.append(xxhash.xxh3_64_intdigest(text) >> 1)
            tokens.append(text.count(" ") + bool(text))
            packed.append(_pack(own))
            if len(seen) >= REMEMBERED:
                seen.clear()
            first.append((host, streams[-1]) not in seen)
            seen.add((host, streams[-1]))
        columns = [pa.array(streams, pa.int64()), pa.array(first, pa.bool_()), pa.array(tokens, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), *columns], names=["id", "url", "host", "stream", "first", "tokens", "packed"])


def _candidates(batches):
    """(host, run): runs frequent on the distinct pages of a chunk; pages are sorted by host and chunk."""

    def of(host, pages):
        # few pages: a share of them may be a single one
        found, n = runs([hashed(" ".join(b for b, _ in p).split(" ")) for p in pages.values()], 1 if OTHER_SHARE * len(pages) <= 1 else 2)
        outside = [windows(hashed(" ".join(b for b, _ in p).split(" "))) for p in pages.values() if any(not i for _, i in p)]
        common = n >= ARTICLE_SHARE * len(pages)
        if outside:
            common |= (n >= OTHER_SHARE * len(pages)) & np.isin(found, np.concatenate(outside))
        return pa.RecordBatch.from_arrays([pa.array([host] * int(common.sum()), pa.string()), pa.array(found[common], pa.int64())], names=["host", "run"])

    here, pages = None, {}
    for batch in sliced(batches):
        for host, chunk, stream, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, chunk) != here:
                if pages:
                    yield of(here[0], pages)
                here, pages = (host, chunk), {}
            if stream not in pages:
                pages[stream] = _unpack(packed)
    if pages:
        yield of(here[0], pages)


def _counted(batches):
    """(host, run, pages): how often each candidate stands on pages; each row says what part of a distinct page it is."""
    for batch in sliced(batches):
        total: dict[tuple[str, int], float] = {}
        for host, packed, part, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = windows(hashed(" ".join(b for b, _ in _unpack(packed)).split(" ")))
            for run in np.intersect1d(own, np.array(found, np.int64)).tolist():
                total[host, run] = total.get((host, run), 0.0) + part
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.float64())], names=["host", "run", "pages"])


def boilerplate(parsed: DataFrame) -> DataFrame | None:
    """(host, everywhere, outside): the runs that go; None where there are none.

    A run that stands on a share of a host's pages stands on that share in one of its chunks.
    """
    streams = parsed.groupBy("host", "stream").agg(F.max("tokens").alias("tokens"), F.sum(F.col("first").cast("int")).alias("rows"))
    streams = written(streams)
    hosts = written(streams.groupBy("host").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("tokens") / CHUNK_TOKENS)).alias("chunks")).where(F.col("n") >= LEAST_PAGES))
    asked = parsed.where("first").join(offered(hosts, 96), "host").withColumn("chunk", F.pmod("stream", "chunks"))
    dealt = asked.select("host", "chunk", "stream", "packed").repartition("host", "chunk").sortWithinPartitions("host", "chunk")
    candidates = written(dealt.mapInArrow(_candidates, "host string, run long").distinct().groupBy("host").agg(F.collect_list("run").alias("found")))
    if candidates.isEmpty():
        discard(streams, hosts, candidates)
        return None
    copied = streams.where("rows > 1").select("host", "stream", "rows")
    rows = parsed.where("first").join(offered(candidates, 96 + 8 * F.size("found")), "host").join(offered(copied, 112), ["host", "stream"], "left")
    rows = rows.select("host", "packed", (F.lit(1.0) / F.coalesce("rows", F.lit(1))).alias("part"), "found")
    counted = rows.mapInArrow(_counted, "host string, run long, pages double").groupBy("host", "run").agg(F.round(F.sum("pages")).alias("pages"))
    share = F.col("pages") / F.col("n")
    counted = counted.join(offered(hosts, 96), "host").where((F.col("pages") >= LEAST_PAGES) & (share >= OTHER_SHARE))
    of = lambda test: F.collect_list(F.when(test, F.col("run")))
    out = written(counted.groupBy("host").agg(of(share >= ARTICLE_SHARE).alias("everywhere"), of(share >= OTHER_SHARE).alias("outside")))
    discard(streams, hosts, candidates)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: (id, url, text).

    Blocks are joined by one newline; null and empty pages have an empty text. Pages whose url
    is null or has no host are one host. A run of 8 tokens or more is removed if it stands on
    at least 5 distinct pages of its host and, in an article, on 60 % of them, elsewhere, and in
    parts of an article that are named like boilerplate, on 20 %; hosts with fewer distinct pages
    keep all. An article of which more than half would
    go is a near copy of others and stays. Pages with the same tokens are one. Null and
    repeated ids keep their rows; the result does not depend on chunks or partitions. Other
    columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host.alias("host"))
    # blocks have no line breaks of their own; packed, they take half the room in the shuffle
    parsed = written(source.mapInArrow(_parse, f"id {kind}, url string, host string, stream long, first boolean, tokens long, packed binary"))
    found = boilerplate(parsed)
    none = F.lit(None).cast("array<bigint>")
    if found is None:
        rows = parsed.select("id", "url", "packed", none.alias("everywhere"), none.alias("outside"))
    else:
        rows = parsed.join(offered(found, 96 + 8 * (F.size("everywhere") + F.size("outside"))), "host", "left").select("id", "url", "packed", "everywhere", "outside")

    def clean(batches):
        for batch in sliced(batches, CHUNK_ROWS):
            texts = []
            for packed, everywhere, outside in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                page = _unpack(packed)
                texts.append("\n".join(b for b, _ in page) if everywhere is None else cleaned(page, np.array(everywhere, np.int64), np.array(outside, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return rows.mapInArrow(clean, f"`{id_col}` {kind}, `{url_col}` string, text string")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_main_text": op4_main_text}
SQL: dict[str, str] = {}
