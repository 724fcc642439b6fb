"""Main text of HTML pages: nearest-URL page differencing, with page structure as its guard.

Every page is paired with up to NEAREST pages of the same host that share the most folders of
its URL path, have other lines, and are like it in whether they declare ``article`` or ``main``
(as pages of one template do); its text lines are aligned with those of each by longest common
subsequence, and lines that it shares with any of them are deleted. Blocks of links alone
(menus) are lines link by link, so that two menus meet in the entries that they have in common.

Structure guards what differencing must not delete: running text (paragraphs, headings, list
items, quotes, cells) inside ``article`` or ``main`` is the page's own even if a neighbour
repeats it, as two articles may share a sentence and whole pages have copies; such lines take
no part in the alignment. Structure also removes
what differs from page to page and is no main text: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, told by tag, role, class or
id, and what stands outside ``article`` or ``main`` where a page declares one.

Pairs come from a few pages kept per folder, so a host with a third of all pages needs no task
of its own. Which of a folder's pages are kept follows from hashes of their lines.

Defined cases: null html gives empty text; copies of a page are compared with pages that
differ; a page without such a neighbour, or without a host, is left to structure alone;
broken markup is read forwards once, in time linear in its length. An alignment holds about
HELD bits twice, however long the two pages are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.llm.common import landed, mapped

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu"}
MAIN = {"article", "main"}
#: Blocks that hold running text.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# Words of class, id and role that mark what is not main text.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|sidebar|side-bar|"
    r"menu|nav|navbar|navigation|breadcrumbs?|toolbar|masthead|footer|site-header|page-header|topbar|comments?|comment-\w+|disqus|replies|reply|related|recommend\w*|share|sharing|social|pagination|pager|widget|contentinfo|complementary|search)(?:$|[\s_-])",
    re.I,
)
COMMENT = re.compile(r"\b(?:comments?|replies|reply|related|recommend\w*|teaser)\b", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_STOP = re.compile(r"[>\"']")
#: Neighbours of a page.
NEAREST = 3
#: Bits of rows, and at most as many of masks, that an alignment holds: 8 MB each.
HELD = 1 << 26
#: Lines of the other page that one step of counting takes.
WIDTH = 4096
_P_ENDS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "aside", "footer", "header", "nav", "main", "form", "blockquote", "pre", "hr", "figure", "dl", "address"}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, name with a slash if it closes, attributes) of each tag, and the rest under no name; comments and declarations have no name either.

    Moves forward only. A tag without an end swallows the rest, as browsers do; where a quote
    is never closed, quotes do not count from there on.
    """
    at, begin, quoted, size = 0, 0, True, len(page)
    while (at := page.find("<", at)) >= 0:
        name = _NAME.match(page, at + 1)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
        elif name:
            end = name.end()
            while quoted:
                stop = _STOP.search(page, end)
                if stop and stop[0] == ">":
                    end = stop.end()
                    break
                close = page.find(stop[0], stop.end()) if stop else -1
                if close < 0:
                    quoted = False
                    end = name.end()
                else:
                    end = close + 1
            if not quoted:
                end = page.find(">", end) + 1 or size
        elif page.startswith(("<!", "<?", "</"), at):
            end = page.find(">", at) + 1 or size
        else:
            at += 1
            continue
        yield page[begin:at], (name[1] + name[2].lower()) if name else "", page[name.end() : end - 1] if name else ""
        at = begin = end
        if name and not name[1] and name[2].lower() in RAW:
            close = _RAW_ENDS[name[2].lower()].search(page, at)
            at = begin = close.start() if close else size
    yield page[begin:], "", ""


_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _spaced(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _pieces(parts: list[tuple[str, int]]) -> list[str]:
    """A block's text, in one piece, or cut between its links if it holds nothing else; cut at white space only, so that the pieces joined by a space are the whole."""
    whole = _spaced([text for text, _ in parts])
    if not whole or len({link for _, link in parts if link}) < 2 or any(c.isalnum() for text, link in parts if not link for c in text):
        return [whole] if whole else []
    pieces: list[list[str]] = []
    last = 0
    for text, link in parts:
        if pieces and (link == last or not (pieces[-1][-1][-1].isspace() or text[0].isspace())):
            pieces[-1].append(text)
        else:
            pieces.append([text])
        last = link
    cut = [x for x in map(_spaced, pieces) if x]
    return cut if " ".join(cut) == whole else [whole]


def guarded(line: tuple[str, bool, bool, str]) -> bool:
    """Whether a line is running text of a main element, which differencing leaves alone."""
    return line[1] and not line[2] and line[3] in TEXT


def lines(page: str) -> list[tuple[str, bool, bool, str]]:
    """(text, inside a main element, in a part that is dropped, nearest block element) of each block, or link of a block of links, in page order."""
    out: list[tuple[str, bool, bool, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, drops, main
    blocks: list[int] = []  # places in stack of elements that are not inline
    opened: Counter = Counter()
    drops = mains = 0
    links = 0
    held: tuple[list, list] = ([], [])  # (text, number of its link or 0) of kept and of dropped parts

    def flush() -> None:
        for dropped, parts in enumerate(held):
            if parts:
                block = stack[blocks[-1]][0] if blocks else ""
                out.extend((text, mains > 0, bool(dropped), block) for text in _pieces(parts))
                parts.clear()

    def pop(to: int) -> None:
        nonlocal drops, mains
        if any(m for _, _, m in stack[to:]):
            flush()
        while len(stack) > to:
            tag, d, m = stack.pop()
            opened[tag] -= 1
            drops -= d
            mains -= m
        while blocks and blocks[-1] >= to:
            blocks.pop()

    for before, name, attributes in tokens(page):
        if before:
            held[drops > 0].append((before, links if opened["a"] else 0))
        closes, tag = name[:1] == "/", name.lstrip("/")
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if closes:
            if opened[tag]:
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                pop(at)
            continue
        if tag in _P_ENDS and blocks and stack[blocks[-1]][0] == "p":
            pop(blocks[-1])
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        marked = tag not in ("body", "html") and any(UNWANTED.search(a or b or c) for a, b, c in _MARKS.findall(attributes))
        m = tag in MAIN
        d = tag in DROPPED or (marked and (not m or bool(COMMENT.search(attributes))))
        links += tag == "a"
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, d, m))
        opened[tag] += 1
        drops += d
        mains += m
    flush()
    return out


def _masks(a: list, b: list) -> dict:
    """For each line of a that b has: its places in b as bits."""
    masks = dict.fromkeys(a, 0)
    for j, x in enumerate(b):
        if x in masks:
            masks[x] |= 1 << j
    return masks


def _rows(a: list, b: list) -> Iterator[int]:
    """After each line of a: bit j is 0 where the longest common subsequence with b's first j + 1 lines is longer than with its first j."""
    masks = _masks(a, b)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks[x]
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b.

    Takes WIDTH lines of b at a time: what a row's addition carries into the next ones is a bit for each line of a.
    """
    carried = bytearray(len(a))
    longer = []
    for low in range(0, len(b), WIDTH):
        part = b[low : low + WIDTH]
        width = len(part)
        places: dict = {}
        for j, x in enumerate(part):
            places[x] = places.get(x, 0) | 1 << j
        full = v = (1 << width) - 1
        for i, x in enumerate(a):
            u = v & places.get(x, 0)
            if u or carried[i]:
                total = v + u + carried[i]
                carried[i] = total >> width
                v = (total | (v - u)) & full
        longer.append(np.unpackbits(np.frombuffer(v.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")[:width] == 0)
    return np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, bool), *longer]))])


def common(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by bit rows: len(a) * len(b) / 64 steps, however often lines repeat.

    Where the rows would take over HELD bits, a is halved at the place of b that both halves meet best (Hirschberg).
    """
    found, work = set(), [(0, len(a), 0, len(b))]
    while work:
        first, end, low, high = work.pop()
        while first < end and low < high and a[first] == b[low]:
            found.add(first)
            first, low = first + 1, low + 1
        while first < end and low < high and a[end - 1] == b[high - 1]:
            found.add(end - 1)
            end, high = end - 1, high - 1
        if first >= end or low >= high:
            continue
        if end - first > 1 and (end - first) * (high - low) > HELD:
            mid = (first + end) // 2
            met = _lengths(a[first:mid], b[low:high]) + _lengths(a[mid:end][::-1], b[low:high][::-1])[::-1]
            cut = low + int(met.argmax())
            work += [(first, mid, low, cut), (mid, end, cut, high)]
            continue
        rows = [-1, *_rows(a[first:end], b[low:high])]
        i, j = end - first, high - low
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                found.add(first + i - 1)
                i, j = i - 1, j - 1
    return found


def _hashes(found: list[tuple]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x[0]) for x in found], np.uint64).view(np.int64)


def told(page: str | None) -> tuple[bool, int, np.ndarray]:
    """(whether the page declares a main element, a digest of all its lines, hashes of the lines that differencing may delete)."""
    found = lines(page or "")
    digest = np.uint64(xxhash.xxh3_64_intdigest(_hashes(found).tobytes())).astype(np.int64)
    return any(m and not d for _, m, d, _ in found), int(digest), _hashes([x for x in found if not guarded(x)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        declares, digests, own = zip(*(told(x.as_py()) for x in batch.column(3))) if batch.num_rows else ((), (), ())
        ends = pa.array(np.cumsum([0, *map(len, own)], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(declares, pa.bool_()), pa.array(digests, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *own])))], ["rid", "host", "path", "declares", "digest", "lines"])


def main_text(page: str, theirs: list[list[int]] | None) -> tuple[str, int]:
    """The page's text, and how many lines went because a neighbour has them too; theirs: told()'s hashes of each neighbour."""
    found = lines(page)
    open_ = [i for i, x in enumerate(found) if not guarded(x)]
    own = _hashes([found[i] for i in open_]).tolist() if theirs else []
    gone = {open_[i] for other in theirs or () for i in common(own, other)}
    kept = [(text, main) for i, (text, main, dropped, _) in enumerate(found) if not dropped and i not in gone]
    declared = any(main and not dropped for _, main, dropped, _ in found)
    return " ".join(text for text, main in kept if main or not declared), len(gone)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts, gone = zip(*(main_text(x.as_py(), y.as_py()) for x, y in zip(part.column(2), part.column(3))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_shared_lines"])


def neighbours(rows: DataFrame) -> DataFrame:
    """(rid, near) rows: for each row of rows (rid, host, path, declares, digest, seq) the seq of up to NEAREST that equal it in declares and differ in digest, those whose URLs share the most path segments first.

    Each folder of a host, up to the host itself, keeps the row of smallest digest in each of
    NEAREST parts and the one of largest digest, combined before the shuffle. The smallest and
    the largest differ wherever the folder has two digests, and then every row of it has one to
    be compared with.
    """
    folders = F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.struct(k.alias("level"), F.concat_ws("/", F.col("declares"), F.col("host"), F.slice(folders, F.lit(1), k)).alias("folder")))
    placed = rows.filter("host <> ''").select("rid", "digest", "seq", F.explode(levels).alias("x")).select("rid", "digest", "seq", "x.*")
    one = F.struct("digest", "seq")
    parts = [F.min(F.when(F.pmod("digest", F.lit(NEAREST)) == k, one)).alias(f"low{k}") for k in range(NEAREST)]
    kept = placed.groupBy("folder").agg(*parts, F.max(one).alias("high"))
    kept = kept.select("folder", F.array_distinct(F.array_compact(F.array("high", *[f"low{k}" for k in range(NEAREST)]))).alias("kept"))
    # Landed, so that nothing stands between the join and its exchanges and Spark can split the folder of a hot host.
    kept = landed(kept.filter("exists(kept, x -> x.digest <> kept[0].digest)"), "page-folders")
    others = F.transform(F.filter("kept", lambda x: x["digest"] != F.col("digest")), lambda x: F.struct((-F.col("level")).alias("up"), x["digest"].alias("digest"), x["seq"].alias("seq")))
    met = placed.join(kept, "folder").groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list(others))).alias("met"))
    return met.select("rid", F.explode(F.slice(F.array_distinct(F.transform("met", lambda x: x["seq"])), 1, NEAREST)).alias("near"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared_lines) of every page; n_shared_lines counts the lines that differencing deleted.

    Pages are parsed twice: first to line hashes, on which neighbours are found, then to texts. So the only rows that meet whole pages are hashes.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("rid", F.xxhash64("page_id", "url", "html"))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)).alias("host")
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path")
    hashed = mapped(rows.select("rid", host, path, "html"), _hashed, "rid long, host string, path string, declares boolean, digest long, lines array<long>")
    hashed = landed(hashed.withColumn("seq", F.monotonically_increasing_id()), "page-lines")
    near = landed(neighbours(hashed), "page-neighbours")
    # Both sides are scans and seq is unique on the right: Spark can split a page that many are compared with.
    theirs = near.join(hashed.select(F.col("seq").alias("near"), "lines"), "near").groupBy("rid").agg(F.collect_list("lines").alias("theirs"))
    met = landed(theirs, "page-meetings")
    return mapped(rows.join(met, "rid", "left").select("page_id", "url", "html", "theirs"), _texts, "page_id long, url string, text string, n_shared_lines long").withColumn("n_chars", F.length("text").cast("long"))
