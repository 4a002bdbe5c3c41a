"""Main text of web pages: a suffix array over each host's token streams, with markup where repeats can't tell.

What stands outside an article, and elements that only may be furniture of one, are a token stream of their page. The
streams of a host's distinct pages are concatenated and their suffixes sorted; substrings of K tokens or more that repeat on
distinct pages are boilerplate. A page that has no article keeps the runs that they leave; an element of doubtful name, inside
an article or not, goes if they cover most of it. An article's own text stays even where pages repeat it, and what tag, class,
id or role clearly name a menu, an advert, a form and the like goes even where it occurs once."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, quoted, stored

#: Tokens that a repeated substring has at least; pages whose streams a task sorts together.
K, SHARD = 8, 128
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of raw text run to their end tag, or to the page's end; the others of these are nothing without one.
ENDLESS = frozenset("script style textarea title".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
#: Elements that never hold text of an article.
DROPPED = RAW | frozenset("head nav footer aside form button select option menu dialog object audio video canvas map fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option".split())
#: Words of class, id and role names that mark what is no text of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside "
    "related recommended sharing newsletter subscribe subscription signup popup modal overlay comment comments disqus respond replies login pagination pager toolbar masthead complementary contentinfo".split()
)
#: Whole names that mark it too; as one word of a longer name they leave it to the repeats.
DOUBTFUL = frozenset("search skip share social widget alert banner".split())
OUTER_MARKS = frozenset(["header", "top", "topbar"])  # only outside an article
MAIN_WORDS = frozenset("content main-content maincontent main article article-body articlebody article-content post-body post-content entry-content story story-body page-content".split())
SPACE = re.compile(r"\s+")
REGIONS = ("article", "main", "body", "html")
ITEMS = frozenset("li td th tr dt dd option".split())
#: Elements that hold others rather than text: a name can leave one out inside an article.
HOLDERS = frozenset("div section ul ol dl table details figure center dir hgroup".split())
#: Words that say no more of an element than that it is a box.
BOXES = frozenset("area articles bar block body bottom box button buttons center col column container content count embed footer form frame full group header holder icon inline inner item items left lg link links list main md mobile module outer panel post posts right row section side slot sm small text thread title top unit widget wide wrap wrapper xs".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)} if "=" in text or "hidden" in text else {}


class _RawEnds:
    """Where raw elements of a page end; each tag's ends are looked for once, so that a page without them takes no longer."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.known: dict[str, list[int] | dict[int, int]] = {}

    def end(self, tag: str, start: int, at: int) -> int:
        """The end of a raw element whose start tag lies from start to at."""
        if tag in ENDLESS:
            if tag not in self.known:
                self.known[tag] = [m.end() for m in re.finditer(rf"</{tag}\b[^<>]*+>?", self.page, re.I)]
            ends = self.known[tag]
            found = bisect_right(ends, at)
            return ends[found] if found < len(ends) else len(self.page)
        if tag not in self.known:
            ends, opened = {}, []
            for m in re.finditer(rf"<(/?){tag}\b([^<>]*+)>", self.page, re.I):
                if not m[1]:
                    opened += [m.start()] * (not m[2].endswith("/"))
                elif opened:
                    ends[opened.pop()] = m.end()
            self.known[tag] = ends
        return self.known[tag].get(start, at)


def _clear(names: list[str], marks: frozenset[str]) -> bool:
    """Whether a name consists of marking words and words for any box."""
    return any(not marks.isdisjoint(w := re.split(r"[-_]+", n)) and marks.union(BOXES).issuperset(w) for n in names)


def blocks(page: str | None) -> list[tuple[str, int, bool, bool]]:
    """(text, place, doubtful, continues) of the pieces of each block in page order; place is 3 inside an article, 2 inside another
    main region, 1 elsewhere, and 0 for what tag, class, id or role leave out. Scripts, styles and other raw elements are skipped
    altogether. A piece that continues belongs to the block of the piece before; its white space at the ends is kept as one space.

    Each tag takes the same time however long and deep the page is: what is open is known by name."""
    page = page or ""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, left out, main, doubtful
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    levels: list[int] = []  # places of blocks in it
    parts: list[str] = []
    raw = _RawEnds(page)
    left_out, main, doubtful, going, at, n = False, 1, False, False, 0, len(page)

    def piece():
        """Ends a piece; the block goes on."""
        nonlocal going
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts)))
            if text.strip() or going and text:
                out.append((text, 0 if left_out else main, doubtful, going))
                going = True
            parts.clear()

    def flush():
        """Ends a block."""
        nonlocal going
        piece()
        going = False

    def close(k):
        nonlocal left_out, main, doubtful
        for tag, *_ in stack[k:]:
            opened[tag].pop()
        while levels and levels[-1] >= k:
            levels.pop()
        del stack[k:]
        left_out, main, doubtful = stack[-1][1:] if stack else (False, 1, False)

    def top(*tags):
        """The highest place in the stack of any of these tags, -1 if none is open."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            parts.append(page[at:])
            break
        if start > at:
            parts.append(page[at:start])
        m = MARKUP.match(page, start)
        if not m:
            parts.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending = name.lower(), bool(m[1] or m[4])
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
        if ending:
            k = top(tag)
            if k >= 0 and (tag in REGIONS or top(*REGIONS) < k) and (tag in BLOCK or tag in DROPPED or not levels or levels[-1] < k):
                if levels and levels[-1] >= k:  # the end of a block, whatever else it ends
                    flush()
                elif (stack[k - 1][1:] if k else (False, 1, False)) != (left_out, main, doubtful):
                    piece()
                close(k)
            continue
        if tag in RAW:  # skipped up to its own end
            if not (m[3] or m[6] or "").endswith("/") or tag in ENDLESS:
                at = raw.end(tag, start, at)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and levels and stack[levels[-1]][0] == "p":
            close(levels[-1])
        if tag in ITEMS:
            k = top(tag)
            if k >= 0 and k > top("ul", "ol", "table", "dl", "div", "article", "select", *["tr"] * (tag in ("td", "th"))):
                close(k)
        attributes = _attributes(m[3] or m[6] or "")
        names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".lower().split()
        words = {w for x in names for w in re.split(r"[-_]+", x)}
        inner = 3 if tag == "article" else max(main, 2) if tag == "main" or "main" in attributes.get("role", "").split() or tag in ("div", "section") and not MAIN_WORDS.isdisjoint(names) else main
        content = tag in REGIONS
        marked = not content and not (words.isdisjoint(MARKS) and DOUBTFUL.isdisjoint(names))
        if main == 3:  # inside an article names leave out what only holds other elements; the repeats decide on the rest
            drop = marked and tag in HOLDERS and (_clear(names, MARKS) or not DOUBTFUL.isdisjoint(names))
        else:
            drop = marked or inner == main == 1 and (tag == "header" or not content and not words.isdisjoint(OUTER_MARKS))
        drop = drop or left_out or tag in DROPPED or tag == "article" and _clear(names, COMMENTS) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        doubt = doubtful or marked or not content and not DOUBTFUL.isdisjoint(words)
        if (drop, inner, doubt) != (left_out, main, doubtful):
            piece()
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            levels.append(len(stack))
        stack.append((tag, drop, inner, doubt))
        left_out, main, doubtful = drop, inner, doubt
    flush()
    return out


#: What becomes of a piece: it goes, its runs without repeats stay, all of it stays unless repeats cover most of it, it stays. CONTINUES is added
#: for a piece of the block of the piece before.
OUT, RUNS, DOUBT, IN = range(4)
CONTINUES = 4


def parse(page: str | None) -> list[tuple[str, int]]:
    """(text, fate) of each piece, in page order. The blocks of the page's articles stay, or else of another main region; on a
    page that has neither, of all blocks that markup does not leave out the runs without repeats do."""
    found = blocks(page)
    top = max((p for _, p, _, _ in found), default=1)
    fate = lambda place, doubtful: OUT if not place or place < top else DOUBT if doubtful else IN if top > 1 else RUNS
    return [(t, fate(p, d) + CONTINUES * c) for t, p, d, c in found]


def joined(pieces: list[tuple[str, bool]]) -> str:
    """Blocks of kept pieces (text, continues), white space collapsed, trimmed and joined by line feeds."""
    lines: list[list[str]] = []
    for text, continues in pieces:
        if continues and lines:
            lines[-1].append(text)
        else:
            lines.append([text])
    return "\n".join(t for x in lines if (t := " ".join("".join(x).split())))


def repeated(streams: list[np.ndarray], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, position, many) of every suffix of at least k tokens of the concatenated streams (hashes), sorted to a depth
    of k by doubling; many: a neighbour in that order shares k tokens and comes from another stream."""
    sizes = np.array([len(s) for s in streams], np.int64)
    owner = np.repeat(np.arange(len(streams)), sizes)
    tokens = np.concatenate(streams) if len(streams) else np.empty(0, np.uint64)
    _, rank = np.unique(tokens, return_inverse=True)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rank, depth = rank.reshape(-1) + 1, 1
    while depth < k:  # ranks of prefixes of `depth` tokens; a stream's end sorts first
        step = min(depth, k - depth)
        after = np.r_[rank[step:], np.zeros(min(step, len(rank)), rank.dtype)][: len(rank)]
        after[place + step >= sizes[owner]] = 0
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + after, return_inverse=True)
        rank, depth = rank.reshape(-1) + 1, depth + step
    order = np.argsort(rank, kind="stable")
    order = order[place[order] + k <= sizes[owner][order]]
    if not len(order):
        return order, order, order.astype(bool)
    r, o = rank[order], owner[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    many = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
    return o, place[order], np.repeat(many, np.diff(np.r_[first, len(r)]))


def _sorted_host(key, rows):
    pages = rows["uid"].to_pylist()
    streams = [np.frombuffer(x, "<u8") for x in rows["tokens"].to_pylist()]
    who, pos, many = repeated(streams)
    out: list[list] = [[], [], [], []]  # kind, gram, uid, pos
    grams = [xxhash.xxh64_intdigest(streams[s][p : p + K].tobytes()) for s, p in zip(who.tolist(), pos.tolist(), strict=True)]
    told = set()
    for s, p, m, g in zip(who.tolist(), pos.tolist(), many.tolist(), grams, strict=True):
        g -= (g >> 63) << 64
        out[0].append(0 if m else 1)
        out[1].append(g)
        out[2].append(pages[s])
        out[3].append(p)
        if m and g not in told:  # a gram that repeats here is one mark for the host's other shards
            told.add(g)
            for column, v in zip(out, (2, g, None, None), strict=True):
                column.append(v)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
    host = pa.array([key[0].as_py()] * len(out[0]), pa.string())
    return pa.table([host, *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["host", "kind", "gram", "uid", "pos"])


def kept_text(texts: list[str], fates: list[int], starts: list[int], k: int = K) -> str:
    """The text of blocks with these fates, where repeated substrings begin at these tokens of all blocks but those that stay."""
    tokens = [None if f % CONTINUES == IN else t.split() for t, f in zip(texts, fates, strict=True)]
    covered = np.zeros(sum(len(x) for x in tokens if x is not None) + 1, bool)
    for s in starts:
        covered[s : s + k] = True
    kept, at = [], 0
    for text, words, fate in zip(texts, tokens, fates, strict=True):
        if words is not None:
            hit = covered[at : at + len(words)]
            at += len(words)
            if fate % CONTINUES == RUNS:
                text = " ".join(["", *(w for w, c in zip(words, hit.tolist(), strict=True) if not c), ""])
            elif fate % CONTINUES == OUT or 2 * hit.sum() > len(words):
                text = " " * (text != text.strip())
        kept.append((text, fate >= CONTINUES))
    return joined(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", shard: int = SHARD) -> DataFrame:
    """For each page: its id, url, text (empty if there is none) and n_chars (code points).

    White space inside a block is one space, blocks are joined by a line feed. A null html counts as empty; a null url has a
    host of its own; an empty table gives no rows; other columns are not read. Pages of a host whose streams are alike (repeated
    rows, copies) are one page when repeats are sought, so that copies without an article keep their text; a page without an
    article whose every token repeats on distinct pages has an empty text. A host's pages are dealt to shards of about `shard`
    pages; a substring that shards do not repeat is compared across the host's shards, by its hash, so that the result does not
    depend on them."""
    source = pages.select(col(id_col).alias("id"), col(url).cast("string").alias("url"), col(html).cast("string").alias("html"))
    kind = source.schema["id"].dataType.simpleString()

    def make():
        def step(batch, most=250):
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                found = [parse(x) for x in part.column(2).to_pylist()]
                streams = [np.fromiter((xxhash.xxh64_intdigest(w) for t, f in x if f % CONTINUES != IN for w in t.split()), "<u8").tobytes() for x in found]
                sure = [all(f % CONTINUES in (OUT, IN) for _, f in x) for x in found]  # no repeat changes such a page
                texts = [kept_text([t for t, _ in x], [f for _, f in x], []) if s else None for x, s in zip(found, sure, strict=True)]
                rest = [[None if s else [r[i] for r in x] for x, s in zip(found, sure, strict=True)] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(rest[0], pa.list_(pa.string())), pa.array(rest[1], pa.list_(pa.int32())), pa.array(streams, pa.binary()), pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in streams], pa.int64())],
                    ["id", "url", "text", "blocks", "fates", "tokens", "uid"],
                )

        return step

    parsed = stored(map_arrow(source, make, f"id {kind}, url string, text string, blocks array<string>, fates array<int>, tokens binary, uid long"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    streams = parsed.filter("length(tokens) > 0").groupBy(host.alias("host"), "uid").agg(F.first("tokens").alias("tokens"))  # equal uids have equal tokens
    # written, so that Spark knows its size when it chooses the join; dealt by host and shard, so that a large host is many tasks' work
    streams = stored(streams)
    counts = stored(streams.groupBy("host").agg(F.ceil(F.count("*") / shard).alias("shards")))
    dealt = streams.join(counts, "host").withColumn("shard", F.pmod("uid", "shards")).select("host", "shard", "uid", "tokens").repartition("host", "shard")
    grams = stored(dealt.groupBy("host", "shard").applyInArrow(_sorted_host, "host string, kind int, gram long, uid long, pos int"))
    told = grams.filter("kind > 0").groupBy("host", "gram").agg(F.max("kind").alias("k"), F.min("uid").alias("a"), F.max("uid").alias("b")).filter("k = 2 or a <> b").select("host", "gram")
    covers = grams.filter("kind = 0").select("host", "uid", "pos").unionAll(grams.filter("kind = 1").join(told, ["host", "gram"]).select("host", "uid", "pos"))
    open_ = parsed.filter("text is null").select("id", "url", "uid", host.alias("host"), "blocks", "fates")
    starts = covers.join(open_.select("host", "uid").distinct(), ["host", "uid"], "left_semi").groupBy("host", "uid").agg(F.collect_set("pos").alias("starts"))

    def finish():
        def step(batch):
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([kept_text(t, f, s or []) for t, f, s in rows], pa.string())], ["id", "url", "text"])

        return step

    rest = map_arrow(open_.join(starts, ["host", "uid"], "left").select("id", "url", "blocks", "fates", "starts"), finish, f"id {kind}, url string, text string")
    texts = parsed.filter("text is not null").select("id", "url", "text").unionAll(rest)
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
