"""Main text of web pages by differencing each page against the page whose URL is nearest on its host.

A page becomes blocks of text in page order. Pages of a host are ordered by URL path, each is paired with the neighbour whose path
agrees with its own the longest, the two lists of blocks are aligned by longest common subsequence, and the blocks they share go:
what pages of a site repeat is the site's, not the article's. Only hashes of blocks travel for this.

Differencing alone gives wrong results where a host has one page, where two URLs show one article (all of it would go), where
articles quote one passage, and for adverts that change from page to page. So markup has a say beside it: menus, headers, footers,
sidebars, notices, adverts, forms and comments that are marked as such always go, and a shared block inside ``article`` or ``main``
goes only if an exact count says that it is the site's: it stands on at least ``NOTICE_PAGES`` different pages of the host and on
more than half of them. All other blocks, in an article or not, are decided by the alignment. Where no neighbour can be compared,
blocks outside article and main go if those hold most of the text.

All blocks take part in the alignment, those of menus and footers too. ``n_shared`` counts the blocks that went because the
neighbour has them, whatever markup says of them, ``n_marked`` those that only markup condemns (adverts that change from page to
page, menus of a host's only page).

Pages of a host with equal blocks are one page for this and share its result. A neighbour that shares ``COPY`` of the characters
in question is a copy as well and is passed over for the one on the other side; if both are, the nearest pages beyond the run of
copies are used.

Defined results: null, empty or broken html gives what text there is, or an empty text; a null or odd URL is a path on a host of
its own kind; repeated rows are copies of each other and don't delete each other's text; an empty table gives an empty result.
Other columns of the input are kept; those named as the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ovenplan.llm.common import importable, running_total, settled

#: A neighbour that shares this part of the characters that markup doesn't drop is a copy of the page.
COPY = 0.8
#: A shared block of an article is the site's if it is on so many different pages of the host, and on more than half of them.
NOTICE_PAGES = 5
#: Ranks of pages that are compared in one group, and ranks of one key where hosts and their blocks are looked up.
STRETCH = 4096
GROUP = 256
#: Cells of an alignment kept at once; larger ones are halved.
CELLS = 1 << 28

# Elements of HTML by their part in a page.
RAW = "script|style|template|noscript|svg|math|iframe|object|textarea|title|select"
DROPPED = set("head nav footer aside form button dialog menu".split())
BLOCKS = set(
    "address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Words in class, id or role that mark a part which is not the article: the whole word, or with one of the usual suffixes.
MARKS = re.compile(
    r"(?<!\S)(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|"
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|replies|disqus|search)"
    r"(?:[_-](?:area|bar|block|body|box|container|inner|item|items|links?|list|section|slot|unit|widget|wrap|wrapper|\d+))*(?!\S)",
    re.I,
)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|<[a-z/][^>]*+>|[^<]++|<",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACES = re.compile(r"\s+")

IN_QUESTION, ARTICLE, OUT = 0, 1, 2


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, zone) of the blocks of a page in page order. A zone says whether markup keeps a block, drops it or leaves it open.

    An element isn't dropped for a word in its class if an unmarked article or main is inside it or, on a page without text in
    an article or main, if it holds most of the page's text.
    """
    spared: set[int] = set()
    while True:
        found, marked = _parse(html, spared)
        half = sum(len(text) for text, _ in found) / 2
        article = any(zone == ARTICLE for _, zone in found)
        wrong = {at for at, (holds, chars) in marked.items() if holds or not article and chars > half}
        if not wrong:
            return found
        spared |= wrong


def _parse(html: str | None, spared: set[int]) -> tuple[list[tuple[str, int]], dict[int, tuple[bool, int]]]:
    """Blocks, and by place the elements dropped for a class word: whether an article is inside, and their characters."""
    found: list[tuple[str, int]] = []
    held: list[str] = []
    dropped: list[str] = []  # open elements that are dropped, innermost last
    depth: dict[str, int] = {}  # open elements of the same name inside the innermost of them
    inside = 0  # open article and main elements
    marked: dict[int, tuple[bool, int]] = {}
    why = None  # place of the element that is dropped for a class word

    def flush() -> None:
        text = SPACES.sub(" ", unescape("".join(held))).strip()
        held.clear()
        if text:
            found.append((text, OUT if dropped else ARTICLE if inside else IN_QUESTION))
            if dropped and why is not None:
                marked[why] = (marked[why][0], marked[why][1] + len(text))

    for token in TOKEN.finditer(html or ""):
        name = token[3]
        if name is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                held.append(text)
            continue
        name, closing = name.lower(), bool(token[2])
        if name == "br":
            held.append(" ")
        known = name in BLOCKS or name in DROPPED
        if dropped and name == dropped[-1]:
            flush()
            depth[name] = depth.get(name, 1) + (-1 if closing else 1)
            # A paragraph or list item that isn't closed ends where the next begins.
            if depth[name] <= 0 or not closing and name in ("p", "li"):
                dropped.pop()
                depth.pop(name)
            else:
                continue
        elif known:
            flush()
        by_word = any(MARKS.search(m.strip("\"'")) for m in NAMED.findall(token[4])) if token[4] and not closing else False
        if dropped and why is not None and name in ("article", "main") and not closing and not by_word:
            marked[why] = (True, marked[why][1])
        if name in ("article", "main") and not dropped:
            inside = max(0, inside - 1) if closing else inside + 1
        if closing or name in VOID or dropped:
            continue
        by_word = by_word and name not in ("html", "body", "article", "main") and token.start() not in spared
        by_name = name in DROPPED or name == "header" and not inside
        if by_name or by_word:
            flush()
            why = None if by_name else token.start()
            if why is not None:
                marked[why] = (False, 0)
            dropped.append(name)
            depth[name] = 1
    flush()
    return found, marked


def shared_places(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` that a longest common subsequence with ``other`` covers."""
    begin, n, m = 0, len(own), len(other)
    while begin < n and begin < m and own[begin] == other[begin]:
        begin += 1
    end = 0
    while end < n - begin and end < m - begin and own[n - 1 - end] == other[m - 1 - end]:
        end += 1
    middle = _align(own[begin : n - end], other[begin : m - end])
    return [*range(begin), *(begin + i for i in middle), *range(n - end, n)]


def _rows(own: list[int], other: list[int]):
    """After each element of ``own``: bit j is 0 where the subsequence grows with other[j]."""
    places: dict[int, int] = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row = full
    for x in own:
        at = row & places.get(x, 0)
        row = (row + at | row - at) & full
        yield row


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Length of the subsequence of ``own`` with every prefix of ``other``."""
    row = (1 << len(other)) - 1
    for row in _rows(own, other):  # noqa: B007
        pass
    bits = np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8)
    grows = 1 - np.unpackbits(bits, bitorder="little")[: len(other)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(grows)])


def _align(own: list[int], other: list[int]) -> list[int]:
    if not own or not other or set(own).isdisjoint(other):
        return []
    if len(own) * len(other) > CELLS and len(own) > 1:
        half = len(own) // 2
        ahead, behind = _lengths(own[:half], other), _lengths(own[half:][::-1], other[::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        return _align(own[:half], other[:cut]) + [half + i for i in _align(own[half:], other[cut:])]
    rows = list(_rows(own, other))
    i, j, found = len(own), len(other), []
    while i and j:
        if own[i - 1] == other[j - 1]:
            i, j = i - 1, j - 1
            found.append(i)
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return found[::-1]


def _signatures(pages: DataFrame, html_col: str) -> DataFrame:
    """Key columns and, for each page, the hashes, lengths and zones of its blocks."""
    schema = "__id string, __key long, __host string, __path string, __lines array<long>, __sizes array<int>, __zones array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes, zones = [], [], []
            for html in batch.column("__html").to_pylist():
                found = blocks(html)
                lines.append([xxhash.xxh64_intdigest(text) - (1 << 63) for text, _ in found])
                sizes.append([len(text) for text, _ in found])
                zones.append([zone for _, zone in found])
            arrays = [pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(zones, pa.list_(pa.int32()))]
            names = ["__id", "__key", "__host", "__path"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *arrays], names=[*names, "__lines", "__sizes", "__zones"])

    return pages.select("__id", "__key", "__host", "__path", F.col(html_col).alias("__html")).mapInArrow(work, schema)


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _deletions(
    own: list[int], sizes: list[int], zones: list[int], path: str, neighbours: list[tuple[str, list[int]] | None]
) -> tuple[list[int] | None, list[int], list[bool]]:
    """Places that the nearest neighbour which isn't a copy shares, None without such a neighbour; which of them are in an article,
    where the host decides; and which neighbours are copies."""
    open_ = [i for i, zone in enumerate(zones) if zone != OUT]
    whole = sum(sizes[i] for i in open_)
    copies = [False] * len(neighbours)
    gone: list[int] | None = None
    articles: list[int] = []
    for at in sorted((k for k, x in enumerate(neighbours) if x), key=lambda k: -_alike(path, neighbours[k][0])):
        covered = set(shared_places(own, neighbours[at][1]))
        copies[at] = bool(open_) and sum(sizes[i] for i in open_ if i in covered) >= COPY * whole
        if gone is None and not copies[at]:
            gone = sorted(i for i in covered if zones[i] != ARTICLE)
            articles = sorted(i for i in covered if zones[i] == ARTICLE)
    return gone, articles, copies


def _unaided(sizes: list[int], zones: list[int]) -> list[int]:
    """Blocks that go where no neighbour can be compared: those outside article and main, if these hold most of the text."""
    article, beside = (sum(n for n, zone in zip(sizes, zones, strict=True) if zone == z) for z in (ARTICLE, IN_QUESTION))
    return [i for i, zone in enumerate(zones) if zone == IN_QUESTION] if article > beside else []


COMPARED = (
    "_rank long, __host string, __sig long, __gone array<int>, __asked array<struct<place: int, line: long>>, _b_copy boolean, _a_copy boolean"
)


def _verdict(page: dict, before: dict | None, after: dict | None) -> tuple:
    """A row of ``COMPARED`` for a page and two pages beside it; one of another host is none."""
    near = [(x["__path"], x["__lines"]) if x and x["__host"] == page["__host"] else None for x in (before, after)]
    gone, articles, copies = _deletions(page["__lines"], page["__sizes"], page["__zones"], page["__path"], near)
    asked = [{"place": i, "line": page["__lines"][i]} for i in articles]
    return page["_rank"], page["__host"], page["__sig"], gone, asked, *copies


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    asked = pa.list_(pa.struct([("place", pa.int32()), ("line", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), asked, pa.bool_(), pa.bool_()]
    names = ["_rank", "__host", "__sig", "__gone", "__asked", "_b_copy", "_a_copy"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def _side_by_side(ranked: DataFrame) -> DataFrame:
    """Every page compared with the pages next to it in the order of addresses.

    Pages are dealt by stretches of ``STRETCH`` ranks, and a stretch has a copy of the page before and after it, so the lists of
    blocks are shuffled once and a task keeps three pages at a time.
    """
    stretch = F.floor(F.col("_rank") / STRETCH)
    edges = F.array_distinct(F.array(stretch, F.floor((F.col("_rank") - 1) / STRETCH), F.floor((F.col("_rank") + 1) / STRETCH)))
    dealt = ranked.withColumn("_stretch", F.explode(edges)).repartition("_stretch").sortWithinPartitions("_stretch", "_rank")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = page = None

        def beside(row: dict | None) -> dict | None:
            return row if row and row["_stretch"] == page["_stretch"] else None

        for batch in batches:
            out = []
            for after in batch.to_pylist():
                if page and page["_rank"] // STRETCH == page["_stretch"]:
                    out.append(_verdict(page, beside(before), beside(after)))
                before, page = page, after
            yield _batch(out)
        if page and page["_rank"] // STRETCH == page["_stretch"]:
            yield _batch([_verdict(page, beside(before), None)])

    columns = ["_stretch", "_rank", "__host", "__sig", "__path", "__lines", "__sizes", "__zones"]
    return dealt.select(*columns).mapInArrow(work, COMPARED)


def _compared(pages: DataFrame, ranked: DataFrame) -> DataFrame:
    """``pages`` have the ranks b and a of two other pages and are compared with these."""
    for tag in "ba":
        named = ranked.select(F.col("_rank").alias(tag), F.struct("__host", "__path", "__lines").alias(f"_{tag}"))
        pages = pages.join(named, tag, "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_verdict(row, row["_b"], row["_a"]) for row in batch.to_pylist()])

    columns = ["_rank", "__host", "__sig", "__path", "__lines", "__sizes", "__zones", "_b", "_a"]
    return pages.select(*columns).mapInArrow(work, COMPARED)


def _with_notices(compared: DataFrame, ranked: DataFrame) -> DataFrame:
    """``compared`` with the shared blocks of articles that are the site's added to ``__gone``: those on ``NOTICE_PAGES`` or more
    different pages of the host and on more than half of them.

    The ranks of a host's pages follow each other. Both joins take a stretch of ranks into their key, so a host with a third of
    all pages and a block on all of them are many small groups; a block is repeated once per stretch it may be asked for in, which is
    less than its number of pages.
    """
    stretches = F.explode(F.sequence(F.floor(F.col("_low") / GROUP), F.floor(F.col("_high") / GROUP))).alias("_group")
    bounds = [F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_low"), F.max("_rank").alias("_high")]
    hosts = ranked.select("__host", "_rank").groupBy("__host").agg(*bounds).select("__host", F.col("_n").alias("_pages"), stretches)
    lines = ranked.select("__host", "_rank", F.explode(F.array_distinct("__lines")).alias("_line")).groupBy("__host", "_line").agg(*bounds)
    often = lines.filter(F.col("_n") >= NOTICE_PAGES).withColumn("_group", F.floor(F.col("_low") / GROUP))
    notices = often.join(hosts, ["__host", "_group"]).filter("_n * 2 > _pages").select("__host", "_line", stretches)
    asked = compared.select("_rank", "__host", F.floor(F.col("_rank") / GROUP).alias("_group"), F.explode("__asked").alias("_at"))
    asked = asked.select("_rank", "__host", "_group", F.col("_at.place").alias("_place"), F.col("_at.line").alias("_line"))
    found = asked.join(notices, ["__host", "_line", "_group"]).groupBy("_rank").agg(F.collect_list("_place").alias("_more"))
    more = F.coalesce("_more", F.array().cast("array<int>"))
    return compared.join(found, "_rank", "left").withColumn("__gone", F.concat("__gone", more))


def _beyond_copies(first: DataFrame) -> DataFrame:
    """_rank, b, a: for pages between copies, the last page before and the first page after the run of copies."""
    linked = first.select((F.col("_rank") - 1).alias("_rank"), F.col("_b_copy").alias("_back"))
    # A page ends its run unless it or the next one takes the other for a copy.
    ends = first.join(linked, "_rank", "left").select(
        "_rank", F.when(F.col("_a_copy") | F.coalesce("_back", F.lit(False)), 0).otherwise(1).cast("long").alias("_end"),
        (F.isnull("__gone") & (F.col("_a_copy") | F.col("_b_copy"))).alias("_between"),
    )
    runs = settled(running_total(ends, ["_rank"], "_end", "_run"), "page-runs")
    bounds = runs.groupBy("_run").agg((F.min("_rank") - 1).alias("b"), (F.max("_rank") + 1).alias("a"))
    return runs.filter("_between").select("_run", "_rank").join(bounds, "_run").select("_rank", "b", "a")


def shared_blocks(pages: DataFrame, html_col: str) -> DataFrame:
    """__id, __key, __gone: places of the blocks that a page shares with its nearest neighbour; null if there was none to compare."""
    signed = _signatures(pages, html_col).withColumn("__sig", F.xxhash64("__lines", "__zones"))
    signed = settled(signed, "page-blocks")
    names = ["__host", "__path", "__id", "__key"]
    rows = signed.select(*names, "__sig")
    # Pages of a host with equal blocks differ in nothing, so the first of them stands for all. The order of pages is made from
    # addresses alone; it is cut into ranges, never one task.
    firsts = rows.groupBy("__host", "__sig").agg(F.min(F.struct("__path", "__id", "__key")).alias("_first"))
    firsts = firsts.select("__host", "__sig", "_first.*", F.lit(1).cast("long").alias("_one"))
    order = settled(running_total(firsts, names, "_one", "_rank").drop("_one"), "page-order")
    ranked = signed.hint("merge").join(order, [*names, "__sig"]).dropDuplicates([*names, "__sig"])
    ranked = settled(ranked, "page-ranked")
    first = settled(_side_by_side(ranked), "page-compared")
    result = first.select("_rank", "__host", "__sig", "__gone", "__asked")
    if not first.filter("__gone is null and (_a_copy or _b_copy)").isEmpty():
        beyond = settled(ranked.join(_beyond_copies(first), "_rank"), "page-beyond")
        again = settled(_compared(beyond, ranked), "page-again").filter("__gone is not null")
        result = result.join(again.select("_rank"), "_rank", "left_anti").unionByName(again.select(*result.columns))
    result = settled(_with_notices(result, ranked).select("__host", "__sig", "__gone"), "page-results")
    return rows.select("__id", "__key", "__host", "__sig").distinct().join(result, ["__host", "__sig"]).select("__id", "__key", "__gone")


def _block_texts(pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` with, instead of the html, the texts of their blocks, null for those that markup drops, and what goes if no
    neighbour can be compared."""
    kept = [c for c in pages.columns if c != html_col]
    schema = StructType([*(pages.schema[c] for c in kept), *StructType.fromDDL("__texts array<string>, __alone array<int>")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, alone = [], []
            for html in batch.column("__html").to_pylist():
                found = blocks(html)
                texts.append([text if zone != OUT else None for text, zone in found])
                alone.append(_unaided([len(text) for text, _ in found], [zone for _, zone in found]))
            arrays = [pa.array(texts, pa.list_(pa.string())), pa.array(alone, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=schema.fieldNames())

    return pages.select(*kept, F.col(html_col).alias("__html")).mapInArrow(work, schema)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """``pages`` without the html, with ``text``, ``n_chars`` and the blocks by what became of them: ``n_shared`` went because the
    neighbour has them too, ``n_marked`` by markup alone, ``n_kept`` stayed."""
    address = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"
    importable(pages.sparkSession)
    added = ["text", "n_chars", "n_shared", "n_marked", "n_kept"]
    kept = [c for c in pages.columns if c not in (html_col, *added)]
    key = {"__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__key": F.xxhash64(url_col, html_col)}
    place = {
        "__host": F.lower(F.regexp_extract(address, parts, 1)),
        "__path": F.regexp_replace(F.regexp_extract(address, parts, 2), r"(?:index)?(?:\.html?)?/*$", ""),
    }
    gone = settled(shared_blocks(pages.withColumns({**key, **place}), html_col), "page-shared")
    texts = _block_texts(pages.withColumns(key).select(*kept, html_col, *key), html_col)
    # Texts and what goes meet by a shuffle at every size: the list of deletions has a row per page.
    joined = texts.hint("merge").join(gone, [*key], "left")
    places = F.sequence(F.lit(0), F.size("__texts") - 1)
    left = joined.withColumn("__left", F.when(F.size("__texts") == 0, F.array().cast("array<int>")).otherwise(
        F.array_except(places, F.coalesce("__gone", "__alone"))
    ))
    stay = left.withColumn("__stay", F.filter(F.transform("__left", lambda i: F.get(F.col("__texts"), i)), lambda t: t.isNotNull()))
    compared = F.col("__gone").isNotNull()
    shared = F.when(compared, F.size("__gone")).otherwise(0).cast("long")
    n_kept = F.size("__stay").cast("long")
    text = F.array_join("__stay", "\n")
    return stay.select(
        *kept, text.alias("text"), F.length(text).cast("long").alias("n_chars"), shared.alias("n_shared"),
        (F.size("__texts") - n_kept - shared).alias("n_marked"), n_kept.alias("n_kept"),
    )
