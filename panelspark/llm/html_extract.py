"""Main text of web pages, with boilerplate found by a suffix array of each host.

A page is parsed into blocks of three zones. `main` blocks lie in an article or main element and outside of menus, headers,
footers, sidebars, notices, adverts, forms and comments; `chrome` blocks lie in one of those; the rest is `open`. Where
a page has main blocks, they are its text, otherwise open blocks are, both without boilerplate. Main blocks are one stream of
tokens a page and all others a second one, and the streams of a host are sorted as suffixes:

* Of open text, runs of RUN tokens or more that the second streams of two pages or more have are cut, where pages with the same
  main and open text are copies and count as one.
* Of main text, blocks are cut that lie wholly in runs of RUN tokens or more which the first streams of more than half of the
  host's distinct main texts have, and of MAIN_PAGES at least: a notice without a telling class, inside the articles of a
  host. Prose that a few pages share stays, and so does a main text of which more than half would go: it is a copy or another
  version of an article. Most windows of RUN tokens are known beforehand to be on fewer main texts: each follows from the
  least hash of four tokens in it, and these are counted first. What that lets pass is sorted and counted exactly.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import LOWER, UPPER, bound_batches, id_filter, mixed, passes, spread
from panelspark.session import cut_lineage

#: Tokens of the shortest repeated run: a power of two, as the sort doubles its depth.
RUN = 8
#: Main texts of a host that have to share a run before it is boilerplate there; more than half of them have to as well.
MAIN_PAGES = 5
#: Tokens whose least hash stands for a window of main text.
ANCHOR = 4
#: Bits of an anchor's key that are counted: others with the same key only let more windows pass.
KEY_BITS = 40
#: Slots of the table that tells before counting how many main texts of a host have to share a run: the least of the hosts in a slot.
HOST_SLOTS = 1 << 16
SALTS = 16
#: Tokens of a host that one task sorts, about; a host with more is dealt out by content.
GROUP_TOKENS = 1 << 21

# What HTML elements and common class names mean.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "select", "title", "audio",
       "video", "button", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "header"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
CHROME_WORDS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
                "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
                "signup", "login", "sidebar", "widget", "widgets", "related", "recommended", "recommendations", "share", "sharing", "social",
                "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar",
                "toolbar", "copyright", "disclaimer", "skip", "search", "teaser", "outbrain", "taboola"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
#: Words that names of page parts are made with, besides the ones above: related-posts, ad-container-2, comment-list.
FRAME_WORDS = {"area", "bar", "block", "body", "box", "buttons", "container", "content", "form", "inner", "item", "items", "links", "list", "outer",
               "posts", "articles", "row", "section", "slot", "thread", "title", "unit", "wrap", "wrapper"}
#: Words that alone say what an element in a main zone is also as its id, which there is often a title: id="related", id="search".
SURE_WORDS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsored", "cookies", "gdpr", "popup", "modal", "newsletter",
              "sidebar", "widget", "widgets", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "toolbar",
              "outbrain", "taboola", "comment", "comments", "commentlist", "disqus", "respond"}
#: Words that make an article in a main zone something else.
ARTICLE_WORDS = {"ad", "advert", "advertisement", "comment"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[^-_:.\d\s]+")
TITLE = re.compile(r"\s*<(h[1-6])\b[^>]*>(.*?)</\1\s*>", re.I | re.S)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN, CHROME, OPEN, HEADER, COMMENT = 0, 1, 2, 3, 4


def _words(names: str, alone: set[str]) -> set[str]:
    """Words of those class names or ids that name a page part as a whole: all their words do, one of `alone` or two other than frames."""
    found: set[str] = set()
    for name in names.split():
        parts = set(PART.findall(name))
        named = parts & (CHROME_WORDS | COMMENT_WORDS)
        if named and parts <= named | FRAME_WORDS and (named & alone or len(named) > 1):
            found |= named
    return found


def _titled(name: str, page: str, at: int) -> bool:
    """Whether an id was made from the heading that follows at `at`."""
    m = TITLE.match(page, at)
    title = entities.unescape(re.sub(r"<[^>]*>", "", m[2])).lower() if m else ""
    return bool(title) and re.findall(r"\w+", title.replace("_", " ")) == re.findall(r"\w+", name.replace("_", " "))


def _zone(tag: str, attributes: str, zone: int, page: str, at: int) -> int:
    """The zone inside an element whose content starts at `at`, from the zone around it.

    A class counts if the whole name says what the element is, an id only if it is no title; neither on an article, but
    in chrome and for the few names of ARTICLE_WORDS in a main zone.
    """
    words: set[str] = set()
    for name, value in NAMES.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class":
            words |= _words(value, CHROME_WORDS | COMMENT_WORDS)
        elif name == "id":
            found = set() if tag in HEADINGS else _words(value, SURE_WORDS if zone in (MAIN, HEADER) else CHROME_WORDS | SURE_WORDS)
            if found & SURE_WORDS & COMMENT_WORDS or found and not _titled(value, page, at):
                words |= found
        elif name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" \
                or name == "style" and "display:none" in value.replace(" ", ""):
            return CHROME if zone != COMMENT else zone
    if tag == "article" and zone != CHROME:
        words &= ARTICLE_WORDS if zone in (MAIN, HEADER) else set()
    if zone == COMMENT or words & COMMENT_WORDS and tag not in ("html", "body", "main"):
        return COMMENT
    if tag in CHROME_TAGS:
        return HEADER if tag == "header" and zone == MAIN else CHROME
    if tag in ("html", "body"):
        return zone
    if tag in ("article", "main"):
        return CHROME if words & CHROME_WORDS and tag == "article" else MAIN
    return CHROME if words & CHROME_WORDS else zone


def blocks(page: str) -> list[tuple[int, str]]:
    """Zone and text of each block, in page order; white space is single blanks, character references are decoded."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, heading = OPEN, False

    def end_block():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((MAIN if zone == MAIN or zone == HEADER and heading else OPEN if zone == OPEN else CHROME, text))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(page, at)
                if tag == "head" and not end:
                    continue
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                end_block()
            continue
        inline = tag in INLINE
        if not inline:
            end_block()
            heading = tag in HEADINGS and not closing
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if inline and zone != stack[k][1]:
                        end_block()
                    zone = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and not attributes:
            continue  # may lack an end, and without attributes changes no zone
        inside = _zone(tag, attributes, zone, page, at)
        if inside != zone and inline:
            end_block()
        if not attributes.endswith("/"):
            stack.append((tag, zone))
            zone = inside
    end_block()
    return out


def _parser():
    import xxhash
    side = pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            article, text, rest = [], [], []
            for page in batch.column("html").to_pylist():
                got = blocks(page or "")
                main = [t for z, t in got if z == MAIN]
                article.append(xxhash.xxh3_64_intdigest(" ".join(main)) - (1 << 63) if main else None)
                text.append(main or None)
                rest.append([{"open": z == OPEN, "text": t} for z, t in got if z != MAIN])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "page_id", "url", "host")), pa.array(article, pa.int64()),
                                              pa.array(text, pa.list_(pa.string())), pa.array(rest, side)],
                                             ["row", "page_id", "url", "host", "article", "main", "side"])
    return run


def _hash_tokens(tokens: list[str]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def _pieces(n_groups: int):
    """Runs of a page's stream whose windows of RUN tokens go to the same group: the group follows from a window's least token.

    `page` is a hash of the main and open text, equal for copies of a page.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for row, host, side, main in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "side", "main"))):
                h = _hash_tokens([t for b in side for t in b["text"].split()])
                if len(h) < RUN:
                    continue
                own = " ".join(t for b in side if b["open"] for t in b["text"].split())
                page = xxhash.xxh3_64_intdigest(f"{own}\n{' '.join(main or ())}") - (1 << 63)
                least = np.lib.stride_tricks.sliding_window_view(mixed(h), RUN).min(1)
                group = (least % np.uint64(n_groups)).astype(np.int64)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    for c, x in zip(cols, (row, page, host, int(group[lo]), lo, h[lo:hi + RUN - 1].tobytes(), main is None)):
                        c.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "page", "host", "part", "start", "piece", "wanted"])
    return run


def _anchors(h: np.ndarray, host: int) -> np.ndarray:
    """The key of each window of RUN tokens: the least hash of ANCHOR tokens in it, with the host's hash."""
    grams = mixed(h[:len(h) - ANCHOR + 1])
    for k in range(1, ANCHOR):
        grams = mixed(grams + h[k:len(h) - ANCHOR + 1 + k])
    least = np.lib.stride_tricks.sliding_window_view(grams, RUN - ANCHOR + 1).min(1)
    return mixed(least ^ np.uint64(host))


def _short(anchors: np.ndarray) -> np.ndarray:
    return (anchors & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)


def _unpacked(bitmap) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bitmap.value), np.uint8)


def _anchor_keys(n_parts: int, firsts, levels: np.ndarray):
    """Keys of the anchors in each main text, as 5 bytes each, and on how many texts of a batch; copies of a text are left out as far as `firsts` knows them.

    They are counted by the level of their host: 2**level main texts or more have to share a run there. Hosts of level 0 have too few.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _unpacked(firsts)
        for batch in batches:
            batch = batch.filter(pa.array(passes(bitmap, batch.column("row").to_numpy())))
            found = []
            for host, main in zip(batch.column("host").to_pylist(), batch.column("main").to_pylist()):
                host = xxhash.xxh3_64_intdigest(host)
                level = int(levels[host % HOST_SLOTS])
                h = _hash_tokens([t for b in main for t in b.split()]) if level else ()
                if len(h) >= RUN:
                    found.append(np.unique(_short(_anchors(h, host))) | level << KEY_BITS)
            keys, times = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            part = (keys >> KEY_BITS) + 64 * ((keys & (1 << KEY_BITS) - 1) % n_parts)
            order = np.lexsort((times, part))
            part, times, low = part[order], times[order], keys[order].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]
            cut = [0, *(np.flatnonzero(np.diff(part) | np.diff(times)) + 1).tolist(), len(part)] if len(part) else [0]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int64()), pa.array(times[cut[:-1]], pa.int64()), pa.array(
                [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["part", "times", "keys"])
    return run


def _frequent_keys(_key, group):
    blobs = group["keys"].to_pylist()
    low = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BITS // 8)
    keys = np.zeros((len(low), 8), np.uint8)
    keys[:, :KEY_BITS // 8] = low
    times = np.repeat(group["times"].to_numpy(), [len(b) // (KEY_BITS // 8) for b in blobs])
    value, at = np.unique(keys.view("<i8").ravel(), return_inverse=True)
    return pa.table({"key": pa.array(value[np.bincount(at, times) >= max(MAIN_PAGES, 1 << group["part"][0].as_py() % 64)], pa.int64())})


def _main_pieces(n_groups: int, frequent, levels: np.ndarray):
    """Runs of a main text's windows whose anchors are frequent and of one group; `new` tells the windows that the text hasn't had before."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _unpacked(frequent)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for row, article, host, main in zip(*(batch.column(c).to_pylist() for c in ("row", "article", "host", "main"))):
                hashed = xxhash.xxh3_64_intdigest(host)
                h = _hash_tokens([t for b in main for t in b.split()]) if levels[hashed % HOST_SLOTS] else ()
                if len(h) < RUN:
                    continue
                anchors = _anchors(h, hashed)
                ok = passes(bitmap, _short(anchors))
                if not ok.any():
                    continue
                windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(h, RUN)).view(f"V{8 * RUN}").ravel()
                new = np.zeros(len(windows), np.uint8)
                had: set[bytes] = set()
                for k in np.flatnonzero(ok).tolist():
                    w = windows[k].tobytes()
                    new[k] = w not in had
                    had.add(w)
                group = np.where(ok, (anchors % np.uint64(n_groups)).astype(np.int64), -1)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if ok[lo]:
                        for c, x in zip(cols, (row, article, host, int(group[lo]), lo, h[lo:hi + RUN - 1].tobytes(), new[lo:hi].tobytes())):
                            c.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "article", "host", "part", "start", "piece", "new"])
    return run


def _classes(sequences: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of all sequences its sequence, the class of the suffix that starts there and whether that has `run` tokens; ends of the sequences.

    Suffixes are sorted by doubling to a depth of `run` tokens (a power of two); neighbours with a common prefix that long are one class.
    """
    sizes = np.array([len(s) for s in sequences])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sequences)), sizes)
    rank = np.unique(np.concatenate(sequences), return_inverse=True)[1].astype(np.int64) + 1
    n, depth = len(rank), 1
    left = ends[of] - np.arange(n)  # tokens up to the sequence's end
    while depth < run:
        behind = np.zeros(n, np.int64)
        ok = np.flatnonzero(left > depth)
        behind[ok] = rank[ok + depth]
        rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
        depth *= 2
    return of, rank, left >= run, ends


def _covered(hit: np.ndarray, ends: np.ndarray, run: int) -> list[np.ndarray]:
    """For each sequence, which of its tokens lie in `run` tokens whose first one is hit."""
    delta = np.zeros(len(hit) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + run, -1)
    return np.split(np.cumsum(delta[:-1]) > 0, ends[:-1])


def repeated_runs(sequences: list[np.ndarray], first: np.ndarray, last: np.ndarray, run: int = RUN) -> list[np.ndarray]:
    """For each sequence, which of its tokens are covered by `run` tokens that also occur on another page.

    first and last are the least and largest page of each sequence, where copies of a page are one.
    """
    of, rank, whole, ends = _classes(sequences, run)
    n = len(rank)
    low, high = np.full(n + 2, np.iinfo(np.int64).max), np.full(n + 2, np.iinfo(np.int64).min)
    np.minimum.at(low, rank[whole], first[of[whole]])
    np.maximum.at(high, rank[whole], last[of[whole]])
    return _covered(whole & (low[rank] != high[rank]), ends, run)


def frequent_runs(sequences: list[np.ndarray], new: list[np.ndarray], pages: np.ndarray, least: int, run: int = RUN) -> list[np.ndarray]:
    """For each sequence, which of its tokens are covered by `run` tokens that occur on `least` pages or more.

    `pages` has the number of pages of each sequence, `new` the windows of `run` tokens that count for them: the first of a page.
    """
    of, rank, whole, ends = _classes(sequences, run)
    counts = np.zeros(len(rank) + 2, np.int64)
    np.add.at(counts, rank[whole], pages[of[whole]] * np.concatenate(new))
    return _covered(whole & (counts[rank] >= least), ends, run)


def _sorted_group(_key, group):
    sequences = [np.frombuffer(p, np.uint64) for p in group["piece"].to_pylist()]
    masks = repeated_runs(sequences, group["first"].to_numpy(), group["last"].to_numpy())
    some = [i for i, m in enumerate(masks) if m.any()]
    taken = group.select(["host", "part", "piece"]).take(pa.array(some, pa.int64()))
    return taken.append_column("mask", pa.array([masks[i].astype(np.uint8).tobytes() for i in some], pa.binary()))


def _frequent_group(_key, group):
    sequences = [np.frombuffer(p, np.uint64) for p in group["piece"].to_pylist()]
    new = [np.frombuffer(p, np.uint8).astype(np.int64) for p in group["new"].to_pylist()]
    masks = frequent_runs(sequences, new, group["n"].to_numpy(), group["least"][0].as_py())
    some = [i for i, m in enumerate(masks) if m.any()]
    taken = group.select(["host", "part", "piece", "new"]).take(pa.array(some, pa.int64()))
    return taken.append_column("mask", pa.array([masks[i].astype(np.uint8).tobytes() for i in some], pa.binary()))


def _gone(n: int, cuts: list[dict] | None) -> np.ndarray:
    """Which of a stream's n tokens are cut."""
    gone = np.zeros(n, np.bool_)
    for c in cuts or ():
        mask = np.frombuffer(c["mask"], np.uint8)
        gone[c["start"]:c["start"] + len(mask)] |= mask > 0
    return gone


def _main_text(main: list[str], cuts: list[dict] | None) -> str:
    """The main blocks without those that are cut as a whole, or all where more than half of the tokens would go."""
    if not cuts:
        return " ".join(main)
    sizes = np.array([len(b.split()) for b in main])
    ends = np.cumsum(sizes)
    gone = np.concatenate([[0], np.cumsum(_gone(int(ends[-1]), cuts))])
    whole = gone[ends] - gone[ends - sizes] == sizes
    return " ".join(main if 2 * sizes[whole].sum() > ends[-1] else [b for b, w in zip(main, whole) if not w])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for main, side, cuts in zip(*(batch.column(c).to_pylist() for c in ("main", "side", "cuts"))):
            if main is not None:
                text.append(_main_text(main, cuts))
                continue
            tokens = [(b["open"], t) for b in side for t in b["text"].split()]
            text.append(" ".join(t for (is_open, t), g in zip(tokens, _gone(len(tokens), cuts)) if is_open and not g))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])


def _open_cuts(parsed: DataFrame, n_groups: int) -> DataFrame:
    """row, cuts: what is cut from the streams outside of main zones, of pages without main text."""
    pieces = cut_lineage(parsed.select("row", "host", "side", "main").mapInArrow(
        _pieces(n_groups), "row long, page long, host string, part long, start int, piece binary, wanted boolean"), "page_runs")
    masks = (pieces.groupBy("host", "part", "piece").agg(F.min("page").alias("first"), F.max("page").alias("last"))
             .groupBy("host", "part").applyInArrow(_sorted_group, "host string, part long, piece binary, mask binary"))
    return (pieces.filter("wanted").join(masks, ["host", "part", "piece"])
            .groupBy("row").agg(F.collect_list(F.struct("start", "mask")).alias("cuts")))


def _host_levels(hosts: DataFrame) -> np.ndarray:
    """For each slot of hosts the least whole log2 of their `least`; 0 in a slot without hosts."""
    import xxhash

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(h) % HOST_SLOTS for h in batch.column("host").to_pylist()], pa.int32()), pa.array(
                [n.bit_length() - 1 for n in batch.column("least").to_pylist()], pa.int32())], ["slot", "level"])

    found = hosts.mapInArrow(slots, "slot int, level int").groupBy("slot").agg(F.min("level").alias("level")).toArrow()  # at most HOST_SLOTS rows
    levels = np.zeros(HOST_SLOTS, np.uint8)
    levels[found["slot"].to_numpy()] = found["level"].to_numpy()
    return levels


def _main_cuts(parsed: DataFrame, n_groups: int) -> DataFrame:
    """row, cuts: what more than half of a host's distinct main texts, and MAIN_PAGES at least, have in common."""
    share = parsed.sparkSession.sparkContext.broadcast
    texts = parsed.filter("main IS NOT NULL")
    firsts = texts.groupBy("host", "article").agg(F.min("row").alias("row"))
    hosts = (firsts.groupBy("host").agg(F.count("*").alias("n_host")).filter(F.col("n_host") >= MAIN_PAGES)
             .select("host", F.greatest(F.lit(MAIN_PAGES), F.expr("n_host DIV 2 + 1")).cast("long").alias("least")))
    levels = _host_levels(hosts)
    keys = (texts.select("row", "host", "main")
            .mapInArrow(_anchor_keys(n_groups, share(zlib.compress(id_filter(firsts, "row"), 1)), levels), "part long, times long, keys binary")
            .groupBy("part").applyInArrow(_frequent_keys, "key long"))
    pieces = cut_lineage(texts.select("row", "article", "host", "main").mapInArrow(
        _main_pieces(n_groups, share(zlib.compress(id_filter(keys, "key"), 1)), levels),
        "row long, article long, host string, part long, start int, piece binary, new binary"), "article_runs")
    # a host's number goes to its pieces in SALTS parts, as one host may have most of them
    masks = (pieces.groupBy("host", "part", "piece", "new").agg(F.countDistinct("article").alias("n"))
             .withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(SALTS)).cast("int"))
             .join(hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"])
             .groupBy("host", "part").applyInArrow(_frequent_group, "host string, part long, piece binary, new binary, mask binary"))
    return (pieces.join(masks, ["host", "part", "piece", "new"])
            .groupBy("row").agg(F.collect_list(F.struct("start", "mask")).alias("cuts")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: one row for each row of `pages`, also where ids or pages repeat; other columns are not read.

    A null or empty page, and one without text, has the text ''. Pages without a URL or host are one host. Rows of a host
    with the same text outside of chrome count as one page, for main text those with the same main text.
    """
    bound_batches(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    host = F.translate(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), UPPER, LOWER)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = spread(pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host.alias("host"), F.col(f"`{html_col}`").alias("html")))
    parsed = cut_lineage(
        rows.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "url", "host", "html")
        .mapInArrow(_parser(), f"row long, page_id {id_type}, url string, host string, article long, main array<string>, "
                               "side array<struct<open:boolean,text:string>>"), "parsed_pages")
    n_side, n_main = parsed.agg(F.sum(F.expr("aggregate(side, 0L, (n, b) -> n + length(b.text) DIV 6 + 1)")),
                                F.sum(F.expr("aggregate(main, 0L, (n, b) -> n + length(b) DIV 6 + 1)"))).first()
    cuts = cut_lineage(_open_cuts(parsed, 1 + (n_side or 0) // GROUP_TOKENS).unionByName(_main_cuts(parsed, 1 + (n_main or 0) // GROUP_TOKENS)), "page_cuts")
    return (parsed.select("row", "page_id", "url", "main", F.when(F.col("main").isNull(), F.col("side")).alias("side"))
            .join(cuts, "row", "left").select("page_id", "url", "main", "side", "cuts")
            .mapInArrow(_cutter, f"page_id {id_type}, url string, text string"))
