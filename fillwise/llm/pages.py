"""Main text of web pages: a suffix array over the pages of a host, with markup as the prior.

Each page is parsed once into blocks.  Blocks in elements that are plainly no article text (scripts, menus, footers, forms,
elements whose class or id says advert, notice, comments, ...) go; the others are marked as inside an article, outside
any, or doubtful: inside an article, but in an element whose class or id holds such a word beside others
(``share-price``, ``related-work``).

The pages of a host are then put one after the other as streams of tokens.  Their suffix array and its longest common
prefixes show which passages stand on several distinct pages: the intervals of suffixes that share PASSAGE tokens or more
(a block shorter than that is a passage as a whole).  In doubtful blocks, and outside on pages without any article, what
such passages cover is boilerplate, and the unique runs are kept.  Inside an article, copies and quotations are text;
only a passage that most of the host's distinct articles hold is boilerplate.  A host with many pages is cut into chunks of
bounded size.  Equal pages are in one chunk, so that the chunks' counts of a passage (a 64-bit hash of its tokens) add up
to the host's; the sums decide in each chunk, so that the cut changes no text.  If all pages of a host have an article and
no doubtful block, only a passage over the share in some chunk can be over it in the host, and only such are summed.

Defined results: a null or empty html gives an empty text; a null url is a host of its own; equal pages count once as
evidence and each get their text; a null page_id is kept; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import grams, materialize, slices

#: Tokens of a passage, at least; a power of two.
PASSAGE = 8
#: Distinct pages that make a passage boilerplate outside an article; inside, and the share of distinct articles.
PAGES_OUTSIDE, PAGES_INSIDE, SHARE_INSIDE = 3, 8, 0.5
#: Pages of a host that are sorted together; pages of a bundle of small hosts, about.
CHUNK, BUNDLE = 256, 512
#: Hosts up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_HOSTS = 50_000

INSIDE, OUTSIDE, DOUBTFUL = 0, 1, 2
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object textarea title".split())
#: Elements within which a tag may close itself.
_FOREIGN = frozenset("svg math".split())
_DROP = frozenset("nav footer aside form button select dialog menu head audio video canvas map".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_SPACE = frozenset("br td th img".split())
#: Elements that are kept on the stack; others matter only if they are dropped.
_STRUCTURE = frozenset("article main nav header footer aside form div section ul ol dl table figure dialog details menu head body blockquote fieldset".split())
#: Words of a class or id that mark something other than the article.
_MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies disqus disclaimer footer footnav gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification
    overlay pager pagination popular popup promo promoted promotion recommend recommended recommendations related replies reply respond search
    share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar trending widget widgets""".split()
)
#: Words that leave the sense of a marking word beside them as it is.
_BESIDE = frozenset(
    """area article bar block body bottom box button buttons container content count form global google group header icon icons inline inner
    item items js left link links list main module outer page panel placeholder post primary reader readers right secondary section site slot
    text thread title top tree unit user wrap wrapper""".split()
)
_NOT_BEFORE = frozenset("with has no without is".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


#: What an element's mark says.
CLEAR, DOUBT, DROP = 0, 1, 2


def marked(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is marked as something other than article text: CLEAR (it isn't), DOUBT or DROP."""
    if tag in _DROP:
        return DROP
    if tag == "header":
        return CLEAR if in_article else DROP
    if not attributes or tag in ("html", "body", "main"):
        return CLEAR
    out = CLEAR
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and m[2] is None and m[3] is None and m[4] is None or name == "aria-hidden" and value == "true":
            return DROP
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return DROP
        if name == "role" and value in _ROLES:
            return DROP
        if name in ("class", "id"):
            for one in value.split():
                parts = [p for p in _NAME_PARTS.split(one) if p]
                if not parts or parts[0] in _NOT_BEFORE:
                    continue
                if parts[-1] == "header" and not in_article:
                    return DROP
                if parts[0] in _MARKS or parts[-1] in _MARKS:
                    if all(p in _MARKS or p in _BESIDE or any(c.isdigit() for c in p) for p in parts):
                        return DROP
                    out = DOUBT
    return out


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, INSIDE, DOUBTFUL or OUTSIDE, number of its article or -1) of each block in page order."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, dropped, article, doubtful
    drop, article, doubt, articles, foreign = False, -1, False, 0, 0
    at, end = 0, len(page)

    def close() -> None:
        if held:
            text = html.unescape("".join(held))
            text = " ".join(text.split())
            held.clear()
            if text:
                out.append((text, OUTSIDE if article < 0 else DOUBTFUL if doubt else INSIDE, article))

    def pop(to: int) -> None:
        nonlocal drop, article, doubt
        del stack[to:]
        drop, article, doubt = stack[-1][1:] if stack else (False, -1, False)

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            if not drop:
                held.append(page[at:])
            break
        if m.start() > at and not drop:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        if tag in _FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not (m[3] or m[6] or "").endswith("/"))
        if tag in _RAW:
            if not closing and not (foreign and (m[3] or m[6] or "").endswith("/")):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in _BLOCK:
            close()
            if not closing and stack and stack[-1][0] in ("p", "li", "dd", "dt") and (stack[-1][1] or stack[-1][3]):
                pop(len(stack) - 1)  # an open paragraph ends where the next block starts
        elif tag in _SPACE and not drop:
            held.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in _VOID:
            continue
        attributes = m[3] or m[6] or ""
        if tag == "body":
            pop(0)
        mark = marked(tag, attributes, article >= 0)
        inner, own = mark == DROP, article
        if tag in ("article", "main") and not inner:
            by_form = drop and all(t == "form" or not d or any(s[1] for s in stack[:k]) for k, (t, d, _) in enumerate(s[:3] for s in stack))
            if by_form:
                drop = False
            if not drop and article < 0:
                own, articles = articles, articles + 1
        if tag in _STRUCTURE or mark != CLEAR and not attributes.endswith("/"):
            if mark != CLEAR:
                close()
            stack.append((tag, drop or inner, own, doubt or mark == DOUBT))
            drop, article, doubt = stack[-1][1:]
    close()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes' starts in order, the common prefix of each with the one before it, 0 for the first).

    Prefix doubling; from round to round only suffixes that are not yet told apart are sorted again.  The ranks of each
    round tell whether two passages of its length are equal, so prefixes are measured by halving steps."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # the end
    first = np.concatenate(([True], tokens[order][1:] != tokens[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rounds, span = [rank], 1
    while True:
        # a class of equal suffixes holds the places from its rank on
        alone = np.concatenate((first[1:], [True])) & first
        if alone.all():
            break
        at = np.flatnonzero(~alone)
        members = order[at]
        after = rank[np.minimum(members + span, n)]
        again = np.lexsort((after, rank[members]))
        members, after = members[again], after[again]
        order[at] = members
        group = rank[members]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        first = first.copy()
        first[at] = fresh
        rank = rank.copy()
        rank[members] = np.maximum.accumulate(np.where(fresh, at, 0))
        rounds.append(rank)
        span *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(rounds) - 1, -1, -1):
        same = (rounds[k][np.minimum(a, n)] == rounds[k][np.minimum(b, n)]) & (a < n) & (b < n)
        step = same.astype(np.int64) << k
        common[1:] += step
        a += step
        b += step
    return order, common


def padded(stream: list[str], depth: int = PASSAGE) -> list[str]:
    """A block shorter than a passage is one, with its end."""
    return stream + ["\n"] * (depth - len(stream)) if len(stream) < depth else stream


def counted(streams: list[list[str]], pages: list[int], depth: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens' numbers, bounds of the streams, on how many distinct pages the passage from each token on stands)."""
    number: dict[str, int] = {}
    tokens: list[int] = []
    owner: list[int] = []
    starts = [0]
    for k, stream in enumerate(streams):
        tokens += [number.setdefault(t, len(number)) for t in stream]
        tokens.append(-1 - k)  # a mark that no other stream has
        owner += [pages[k]] * (len(stream) + 1)
        starts.append(len(tokens))
    ids, own = np.array(tokens, np.int64), np.array(owner, np.int64)
    n = len(ids)
    count = np.zeros(n, np.int64)
    if n >= depth:
        order, common = suffix_array(ids)
        # an interval of suffixes that share a passage; those that run over a mark belong to one stream and stand once
        interval = np.cumsum(common < depth) - 1
        pair = np.unique(interval * (int(own.max()) + 1) + own[order]) // (int(own.max()) + 1)
        count[order] = np.bincount(pair)[interval]
        mark = ids < 0
        reach = np.convolve(mark, np.ones(depth, np.int64))[depth - 1 : n]
        count[: n - depth + 1][reach > 0] = 0
        count[n - depth + 1 :] = 0
    return ids, np.array(starts), count


def spread_over(count: np.ndarray, depth: int = PASSAGE) -> np.ndarray:
    """For each token the largest count of a passage over it."""
    spread, n = np.zeros(len(count), np.int64), len(count)
    for k in range(min(depth, n)):
        np.maximum(spread[k:], count[: n - k], out=spread[k:])
    return spread


def passages(stream: list[str]) -> np.ndarray:
    """The hash of the passage from each token on, as far as passages go; of a short block, its own."""
    stream = padded(stream)
    return grams(np.fromiter((xxhash.xxh3_64_intdigest(t) for t in stream), np.uint64, len(stream)), PASSAGE).view(np.int64)


def body_of(page: list[tuple[str, int, int]]) -> tuple[int, bool, bool]:
    """(hash of what makes a page distinct: its articles, or all of it if it has none; whether it has an article;
    whether repetition alone decides some of its blocks)."""
    inside = [t for t, zone, _ in page if zone != OUTSIDE]
    return xxhash.xxh3_64_intdigest(repr((bool(inside), inside or [t for t, _, _ in page]))) - (1 << 63), bool(inside), not inside or any(zone == DOUBTFUL for _, zone, _ in page)


def repeated(streams: list[list[str]], pages: list[int], depth: int = PASSAGE) -> list[np.ndarray]:
    """For each token of each stream: on how many distinct pages the most common passage over it stands.

    ``pages`` numbers the streams' pages; streams of one page count once."""
    full = [padded(t, depth) for t in streams]
    _, starts, count = counted(full, pages, depth)
    spread = spread_over(count, depth)
    return [spread[a : a + len(t)] for a, t in zip(starts[:-1].tolist(), streams)]


def main_texts(pages: list[list[tuple[str, int, int]]], sums: tuple[np.ndarray, np.ndarray, int] | None = None) -> list[str]:
    """The texts of pages of one host, given their blocks.

    ``sums`` has the host's counts if these are not all of its pages: sorted hashes of passages, on how many distinct
    pages each stands, and the host's distinct articles."""
    bodies = [tuple(t for t, zone, _ in p if zone != OUTSIDE) for p in pages]
    number: dict[tuple, int] = {}
    distinct = [number.setdefault((b, tuple(t for t, zone, _ in p if zone == OUTSIDE)) if not b else b, len(number)) for b, p in zip(bodies, pages)]
    streams = [t.split(" ") for p in pages for t, _, _ in p]
    owners = [distinct[k] for k, p in enumerate(pages) for _ in p]
    if not streams:
        return ["" for _ in pages]
    words = iter(streams)
    if sums is None:
        spread = iter(repeated(streams, owners))
        with_article = len({distinct[k] for k, b in enumerate(bodies) if b})
    else:
        keys, totals, with_article = sums
        spread = (spread_over(_looked_up(keys, totals, t)) for t in streams)
    limit = max(PAGES_INSIDE, SHARE_INSIDE * with_article)
    out = []
    for p, body in zip(pages, bodies):
        kept = []
        for t, zone, _ in p:
            tokens, count = next(words), next(spread)
            if body and zone == OUTSIDE:
                continue
            common = (count > limit) & (len(tokens) >= PASSAGE) if zone == INSIDE else count >= PAGES_OUTSIDE
            if not common.any():
                kept.append(t)
            elif not common.all():
                kept.append(" ".join(w for w, c in zip(tokens, common.tolist()) if not c))
        out.append("\n\n".join(kept))
    return out


def _looked_up(keys: np.ndarray, totals: np.ndarray, stream: list[str]) -> np.ndarray:
    out = np.zeros(len(stream), np.int64)
    found = passages(stream)[: len(stream)] if len(keys) else keys
    if len(found):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        out[: len(found)] = np.where(keys[at] == found, totals[at], 0)
    return out


_CENSUS = "host string, chunk int, hash long, n long, articles long, pages long, open boolean"


def census(table: pa.Table, full: bool) -> pa.Table:
    """Of one chunk: a row with its pages and distinct articles and whether one is open, and counts of its passages.

    These are all of them, or (unless ``full``) those that can be over the share in their host."""
    host, chunk = (table.column(c)[0].as_py() for c in ("host", "chunk"))
    first: dict[int, int] = {}
    for i, (body, texts) in enumerate(zip(table.column("body").to_pylist(), table.column("texts"))):
        if texts.is_valid:
            first.setdefault(body, i)
    at = pa.array(list(first.values()), pa.int64())
    one = table.take(at)
    articles = sum(one.column("article").to_pylist())
    streams, owners = [], []
    for k, texts in enumerate(one.column("texts").to_pylist()):
        streams += [padded(t.split(" ")) for t in texts]
        owners += [k] * len(texts)
    hashes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if streams:
        _, starts, count = counted(streams, owners)
        use = count >= 1 if full else count > SHARE_INSIDE * articles
        code, n = [], []
        for t, a, b in zip(streams, starts[:-1].tolist(), starts[1:].tolist()):
            where = np.flatnonzero(use[a:b])
            if len(where):
                code.append(passages(t)[where])
                n.append(count[a:b][where])
        if code:
            hashes, which = np.unique(np.concatenate(code), return_index=True)
            counts = np.concatenate(n)[which]
    m = len(hashes) + 1
    columns = ([host] * m, [chunk] * m, [None, *hashes.tolist()], [0, *counts.tolist()], [articles] + [0] * (m - 1), [sum(table.column("copies").to_pylist())] + [0] * (m - 1), [any(table.column("open").to_pylist())] * m)
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), *[pa.int64()] * 4, pa.bool_()))], ["host", "chunk", "hash", "n", "articles", "pages", "open"])


def _distinct_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's first page of each body; of further ones only how many there are."""
    more: dict[tuple, int] = {}
    seen: set[tuple] = set()

    def rest() -> pa.RecordBatch:
        keys = list(more)
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], t) for j, t in enumerate(kinds)), pa.array(list(more.values()), pa.int64()), pa.nulls(len(keys), pa.list_(pa.string()))], names)

    names = ["host", "chunk", "open", "body", "article", "copies", "texts"]
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in names[:5]))):
            if key in seen:
                more[key] = more.get(key, 0) + 1
            else:
                seen.add(key)
                keep.append(i)
        if len(seen) > 200_000:
            seen.clear()
        if len(more) > 200_000:
            yield rest()
            more.clear()
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:5]), pa.array([1] * len(keep), pa.int64()), part.column("texts")], names)
    yield rest()


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, body) of the candidates that each page holds."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for host, body, texts, wanted in zip(*(batch.column(c).to_pylist() for c in ("host", "body", "texts", "wanted"))):
            own = np.unique(np.concatenate([np.zeros(0, np.int64), *(passages(t.split(" ")) for t in texts)]))
            own = np.intersect1d(own, np.array(wanted, np.int64), assume_unique=True)
            out[0].extend([host] * len(own))
            out[1].extend(own.tolist())
            out[2].extend([body] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64()))], ["host", "hash", "body"])


def host_counts(large: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the pages of hosts with several chunks: (host, chunk, salts) where copies need several groups, and
    (host, chunk, hash, n, articles) with the host's sums.  ``chunks`` has (host, chunks).

    A host with a page of which repetition alone decides blocks has all its passages summed, others those that can be
    over the share."""
    told = large.select("host", "chunk", "open", "body", "article", "texts").mapInArrow(_distinct_pages, "host string, chunk int, open boolean, body long, article boolean, copies long, texts array<string>")
    found = materialize(told.groupBy("host", "chunk").applyInArrow(lambda t: census(t, False), _CENSUS))
    heads = found.where("hash is null").select("host", "chunk", "pages", "articles", "open")
    of_host = heads.groupBy("host").agg(F.sum("articles").alias("articles"), F.max("open").alias("bare"))
    salts = heads.where(F.col("pages") > 2 * CHUNK).select("host", "chunk", F.ceil(F.col("pages") / CHUNK).cast("int").alias("salts"))
    bare = of_host.where("bare").select("host")
    full = found.where("false")
    if not bare.isEmpty():
        full = materialize(told.join(bare, "host", "left_semi").groupBy("host", "chunk").applyInArrow(lambda t: census(t, True), _CENSUS).where("hash is not null"))
    of_host = of_host.select("host", "articles", "bare")
    sums = full.groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES_OUTSIDE)
    near = full.select("host", "chunk", "hash").join(sums, ["host", "hash"]).join(of_host.drop("bare"), "host").select("host", "chunk", "hash", "n", "articles")
    known = found.where("hash is not null").select("host", "hash").join(of_host.where("not bare").drop("bare", "articles"), "host").join(chunks, "host")
    of_host = of_host.drop("bare")
    wanted = materialize(known.groupBy("host", "chunks").agg(F.collect_set("hash").alias("wanted")))
    if wanted.isEmpty():
        return salts, materialize(near)
    hits = large.select("host", "body", "texts").join(wanted.select("host", "wanted"), "host").select("host", "body", "texts", "wanted").mapInArrow(_hits, "host string, hash long, body long")
    over = hits.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).join(of_host, "host").where(F.col("n") > F.greatest(F.lit(PAGES_INSIDE), SHARE_INSIDE * F.col("articles")))
    over = over.join(wanted.select("host", "chunks"), "host").select("host", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "hash", "n", "articles")
    return salts, materialize(near.unionByName(over))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{markup}`").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [blocks(h or "") for h in batch.column(2).to_pylist()]
            body, article, bare = zip(*map(body_of, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string()), pa.array(body, pa.int64()), pa.array(article, pa.bool_()), pa.array(bare, pa.bool_()), *(pa.array([[b[k] for b in p] for p in found], pa.list_(t)) for k, t in ((0, pa.string()), (1, pa.int32()), (2, pa.int32())))],
                ["page_id", "url", "host", "body", "article", "open", "texts", "zones", "articles"],
            )

    parsed = rows.mapInArrow(parse, f"page_id {kind}, url string, host string, body long, article boolean, open boolean, texts array<string>, zones array<int>, articles array<int>")
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([host_of(u) for u in batch.column(0).to_pylist()], pa.string())], ["host"])

    # the pages of each host; a small table
    hosts = materialize(rows.select("url").mapInArrow(named, "host string").groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("count")))
    # broadcast while the table is known to be small, so that the blocks are shuffled once
    few = hosts.count() <= BROADCAST_HOSTS
    sized = parsed.join(F.broadcast(hosts) if few else hosts, F.col("host") == F.col("_host"))
    chunks = F.ceil(F.col("count") / CHUNK).cast("int")
    chunk = F.pmod(F.col("body"), chunks).cast("int")
    large = F.col("count") > CHUNK
    sized = sized.select("page_id", "url", "host", "body", "article", "open", "count", "texts", "zones", "articles", chunk.alias("chunk"))
    total = F.greatest(F.lit(1), F.lit(pages.count() // BUNDLE)).cast("int")
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("host"), total))
    sums = None
    if not hosts.where(large).isEmpty():
        salts, sums = host_counts(sized.where(large), hosts.where(large).select(F.col("_host").alias("host"), chunks.alias("chunks")))
        # copies of one page are dealt out further
        many = salts.select(F.col("host").alias("_host"), F.col("chunk").alias("_chunk"), "salts")
        sized = sized.join(F.broadcast(many) if few else many, (F.col("host") == F.col("_host")) & (F.col("chunk") == F.col("_chunk")) & large, "left")
        salt = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1)))
        group = F.when(large, F.concat_ws("|", F.lit("c"), "host", "chunk", salt)).otherwise(bundle)
        sums = sums.join(salts, ["host", "chunk"], "left").select("host", "chunk", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "hash", "n", "articles")
        sums = sums.select(F.concat_ws("|", F.lit("c"), "host", "chunk", "salt").alias("group"), "hash", "n", F.col("articles").alias("with_article"))

    def work(table: pa.Table, known: pa.Table | None = None) -> pa.Table:
        hosts_ = table.column("host").to_pylist()
        found = [list(zip(*x)) for x in zip(*(table.column(c).to_pylist() for c in ("texts", "zones", "articles")))]
        given = None
        if table.num_rows and table.column("count")[0].as_py() > CHUNK:
            keys, n = (known.column(c).to_numpy() for c in ("hash", "n"))
            order = np.argsort(keys)
            given = keys[order], n[order], known.column("with_article")[0].as_py() if len(keys) else 0
        by_host: dict[str, list[int]] = {}
        for i, h in enumerate(hosts_):
            by_host.setdefault(h, []).append(i)
        texts = [""] * len(found)
        for members in by_host.values():
            for i, t in zip(members, main_texts([found[i] for i in members], given)):
                texts[i] = t
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    result = f"page_id {kind}, url string, text string, n_chars long"
    if sums is None:
        return sized.select(bundle.alias("group"), "page_id", "url", "host", "count", "texts", "zones", "articles").groupBy("group").applyInArrow(lambda table: work(table), result)
    dealt = sized.select(group.alias("group"), "page_id", "url", "host", "count", "texts", "zones", "articles")
    return dealt.groupBy("group").cogroup(sums.groupBy("group")).applyInArrow(work, result)
