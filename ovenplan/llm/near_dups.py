"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text's runs of ``K`` words are labelled with how often the run occurred before. Each of ``SKETCHES`` hash functions picks the
``PICKED`` labelled runs with the smallest values; a sketch is these runs in the order of the text, so texts agree in a sketch the
likelier the smaller their edit distance is. Two texts that agree in any sketch are candidates. They are near duplicates if the
edit distance of their words, found in a diagonal band, is at most a fifth of the longer text (similarity ``SIMILARITY``).

Classes are the connected components of these links. Not all pairs of a bucket are compared to find them: each text is first
compared with the smallest text of its buckets, in rounds, and only texts of one bucket that are in different components after that
are compared with each other, first by their lengths and the words they have in common (which bound the edit distance from below),
then by alignment, where they meet: only links between components leave that group, never pairs. No pair of candidates is left out: what isn't compared is connected already or can't be within the limit. The
texts of a bucket meet in blocks of bounded size. Exact copies are one text from the start.

Two texts with a share J of common runs miss each other in all sketches with probability (1 - J**PICKED) ** SKETCHES. Measured on
texts of 60 to 300 words with scattered edits, 7 % of the pairs with an edit similarity of 0.80 are missed, 2.3 % at 0.82, 0.7 % at
0.85 and none of 600 from 0.86 on (tests/llm holds these up); edits that stand together leave more runs whole. An edit spoils five runs, which is most of a short text, so texts of up to
``SHORT`` words are also in a bucket for each of their first runs of q words in the order of a hash, q the longest of up to
``GRAM`` with q * (1 - similarity) < 1. An edit spoils at most q of the n + q - 1 runs of a text padded at both ends, so near
duplicates of n words or more share over n - n * q * (1 - similarity) + q - 2 of them, and two texts that do share one among the
floor(n * q * (1 - similarity)) + 1 that come first in any common order: no pair of short texts is missed. ``exact`` gives such
buckets to all texts, rare runs first (counts by hash, ``BINS`` bins), so that no pair within the limit is missed at any length, at
several times the disk. Texts are told apart by a 64-bit hash.

Defined results: null and empty texts are copies of one another; texts of fewer than ``K`` words count as one run; a class is named
by the smallest id in it, null ids last; repeated rows are copies; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ovenplan.llm.common import WORD, importable, settled, word_count
from ovenplan.llm.components import components
from ovenplan.operators.intake import key_bitmap, possibly_among

K = 5
SKETCHES = 48
PICKED = 2
SIMILARITY = 0.8
GRAM = 3
SHORT = 50
BINS = 1 << 20
#: Texts of a bucket that meet in one block, and the bins that their words are counted in.
OPEN_BLOCK = 1024
BAG_BINS = 2048
#: Counts up to which a product of counts stands for the lesser of them, and rows that are compared with a block at a time.
LIGHT = 3
STRIP = 128
#: Texts of a group up to which its pairs are gone through one by one.
FEW = 16

ODD = np.uint64(0x9E3779B97F4A7C15)
ONE, TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * ONE
    x = (x ^ (x >> np.uint64(27))) * TWO
    return x ^ (x >> np.uint64(31))


SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * ODD) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word: the sum of hashes of its bytes and their places in the word."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    inside = np.flatnonzero(~BLANK[data])
    if not inside.size:
        return np.empty(0, np.uint64)
    begins = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    place = inside - np.repeat(inside[begins], np.diff(begins, append=inside.size))
    return mix(np.add.reduceat(mix((place.astype(np.uint64) << np.uint64(8) | data[inside]) * ODD), begins))


def _with_occurrence(runs: np.ndarray) -> np.ndarray:
    """Hashes of runs and of how often each occurred before."""
    n = len(runs)
    order = np.argsort(runs, kind="stable")
    fresh = np.concatenate([[True], runs[order][1:] != runs[order][:-1]])
    begins = np.flatnonzero(fresh)
    earlier = np.empty(n, np.uint64)
    earlier[order] = np.arange(n) - np.repeat(begins, np.diff(begins, append=n))
    return mix(runs + earlier * ODD)


def padded_runs(text: str | None, q: int) -> tuple[np.ndarray, int]:
    """Labelled runs of ``q`` words of a text padded at both ends, and its number of words."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words, 0
    pad = np.arange(1, q, dtype=np.uint64)
    padded = np.concatenate([pad, words, pad])
    runs = np.zeros(n + q - 1, np.uint64)
    for j in range(q):
        runs = mix(runs * ODD + padded[j : j + n + q - 1])
    return _with_occurrence(runs), n


def run_length(similarity: float) -> int:
    return max(q for q in range(1, GRAM + 1) if q == 1 or q * (1 - similarity) < 1 - 1e-9)


def rarest_runs(text: str | None, similarity: float, common: np.ndarray) -> np.ndarray:
    """Buckets of which two texts within ``similarity`` share at least one."""
    q = run_length(similarity)
    runs, n = padded_runs(text, q)
    wanted = min(len(runs), int(n * q * (1 - similarity) + 1e-9) + 1) if n else 0
    return runs[np.lexsort((runs, common[runs >> np.uint64(44)]))[:wanted]].view(np.int64)


def sketches(text: str | None, words: np.ndarray | None = None) -> np.ndarray:
    """The bucket of a text under each hash function; none for a text without words. ``words`` are its hashes, if they are known."""
    words = word_hashes(text) if words is None else words
    n = max(1, len(words) - K + 1) if len(words) else 0
    if not n:
        return np.empty(0, np.int64)
    runs = np.zeros(n, np.uint64)
    for j in range(min(K, len(words))):
        runs = mix(runs * ODD + words[j : j + n])
    labelled = _with_occurrence(runs)
    out = np.empty(SKETCHES, np.uint64)
    picked, step = min(PICKED, n), max(1, (1 << 22) // n)
    for s in range(0, SKETCHES, step):  # a few functions at a time for very long texts
        values = (labelled[None, :] ^ SEEDS[s : s + step, None]) * SEEDS[s : s + step, None]
        least = np.argpartition(values, picked - 1, axis=1)[:, :picked] if picked < n else np.tile(np.arange(n), (len(values), 1))
        chosen = runs[np.sort(least, axis=1)]
        joint = SEEDS[s : s + step].copy()
        for p in range(picked):
            joint = mix(joint * ODD + chosen[:, p])
        out[s : s + step] = joint
    return out.view(np.int64)


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of two sequences if it is at most ``band``, else ``band + 1``. Cells off the band aren't looked at."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    far = np.int64(1 << 40)
    width = 2 * band + 1
    slots = np.arange(width)
    padded = np.full(m + n + width + 1, -1, np.int64)
    padded[band : band + m] = b
    row = np.full(width + 1, far)
    row[band : band + min(m, band) + 1] = np.arange(min(m, band) + 1)
    for i in range(1, n + 1):
        across = row[:width] + (padded[i - 1 : i - 1 + width] != a[i - 1])
        new = np.minimum(across, row[1:] + 1)
        if i <= band:
            new[: band - i] = far
            new[band - i] = i
        if m - i < band:
            new[m - i + band + 1 :] = far
        new = np.minimum.accumulate(new - slots) + slots
        if new.min() > band:
            return band + 1
        row[:width] = new
    return int(min(row[m - n + band], band + 1))


def distance_within(a: list[str], b: list[str], limit: int) -> int | None:
    """Edit distance of two lists of words, or None if it is above ``limit``."""
    longer = max(len(a), len(b))
    if abs(len(a) - len(b)) > limit:
        return None
    # Words that the other text lacks have to be edited, whatever the alignment.
    least = longer - (Counter(a) & Counter(b)).total()
    if least > limit:
        return None
    begin, end = 0, 0
    short = min(len(a), len(b))
    while begin < short and a[begin] == b[begin]:
        begin += 1
    while end < short - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t[begin : len(t) - end]], np.int64) for t in (a, b))
    band = min(limit, max(4, least + least // 4))
    while True:
        found = banded_distance(x, y, band)
        if found <= band:
            return found
        if band == limit:
            return None
        band = min(limit, 2 * band)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text)


def edits_allowed(longer: int, similarity: float) -> int:
    return int(longer * (1 - similarity) + 1e-9)


def common_runs(texts: DataFrame, similarity: float) -> np.ndarray:
    """How often runs of each bin occur, for the bins with over four times the mean; 0 for the others."""
    q = run_length(similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                np.add.at(counts, (padded_runs(t, q)[0] >> np.uint64(44)).astype(np.int64), 1)
        bins = np.flatnonzero(counts)
        for k in range(0, len(bins), 1 << 16):
            part = bins[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], names=["bin", "n"])

    found = settled(texts.select("text").mapInArrow(work, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")), "run-counts")
    mean = (found.agg(F.sum("n")).first()[0] or 0) / BINS
    common = np.zeros(BINS, np.int64)
    for row in found.filter(F.col("n") > max(1.0, 4 * mean)).toLocalIterator():  # fewer than a quarter of the bins
        common[row["bin"]] = row["n"]
    return common


def buckets_of(text: str | None, similarity: float, common: np.ndarray | None) -> np.ndarray:
    """Sketches of a text; also buckets of its first runs if it is short or ``common`` tells how common runs are."""
    words = word_hashes(text)
    found = sketches(text, words)
    if common is None:
        if len(words) > SHORT:
            return found
        common = np.zeros(BINS, np.int64)
    return np.concatenate([found, rarest_runs(text, similarity, common)])


def _sketched(texts: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """(node, text) -> (node, buckets)."""
    common = texts.sparkSession.sparkContext.broadcast(common_runs(texts, similarity) if exact else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets_of(t, similarity, common.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "buckets"])

    return texts.mapInArrow(work, "node long, buckets array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose texts are near duplicates, with their edit distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, words = None, []
        for batch in batches:
            out = []
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                    if a != before:
                        before, words = a, words_of(x)
                    other = words_of(y)
                    found = distance_within(words, other, edits_allowed(max(len(words), len(other)), similarity))
                    if found is not None:
                        out.append((a, b, found))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "edits"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long, edits long")


def _node(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def near_links(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, edits) between different texts, named by their hash, that connect every class; and (node, comp)."""
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(_node(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = settled(_sketched(texts, similarity, exact).select("node", F.explode("buckets").alias("bucket")), "sketches")
    # Buckets with more than one text, and the smallest text of each. Copies of a text combine before the shuffle.
    heads = placed.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").select("bucket", "head")
    members = settled(placed.join(settled(heads, "bucket-heads"), "bucket").select("bucket", "head", "node").distinct(), "bucket-members")
    found = settled(members.select("node").distinct(), "candidate-nodes")
    # Most texts share no bucket: a bitmap of the nodes that do, of bounded size, drops them where they are read.
    # An inner join, as Spark moves a semi join below the bitmap and then shuffles all texts; the nodes are distinct.
    near = possibly_among(texts, ["node"], key_bitmap(found, ["node"]))
    wanted = settled(
        near.join(found, "node").dropDuplicates(["node"]).withColumn("n_words", word_count(F.col("text"))), "candidate-texts"
    )
    star = settled(
        members.filter("node <> head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("agreed")), "star-pairs"
    )
    # First the head that a text agrees with most; then its other heads, unless they are connected by now; then what is left.
    closest = star.groupBy("b").agg(F.max_by("a", F.struct("agreed", "a")).alias("a")).select("a", "b")
    links = settled(verified(closest, wanted, similarity), "links-found")
    tried = settled(closest, "pairs-tried")
    comps = components(links)
    pairs = settled(other_heads(star, comps).join(tried, ["a", "b"], "left_anti"), "pairs-left")
    if not pairs.isEmpty():
        links = settled(links.unionByName(verified(pairs, wanted, similarity)), "links-found")
        comps = components(links)
    across = settled(cross_pairs(members, comps, wanted, similarity), "links-across")
    if not across.isEmpty():
        links = settled(links.unionByName(across), "links-found")
        comps = components(links)
    return links, comps


def _labelled(rows: DataFrame, comps: DataFrame, name: str, label: str) -> DataFrame:
    """Add the component of node ``name``; a node without links is its own."""
    return rows.join(comps.select(F.col("node").alias(name), F.col("comp").alias("_comp")), name, "left").withColumn(
        label, F.coalesce("_comp", name)
    ).drop("_comp")


def other_heads(star: DataFrame, comps: DataFrame) -> DataFrame:
    """Texts and heads of their buckets that are in different components."""
    return _labelled(_labelled(star, comps, "a", "ca"), comps, "b", "cb").filter("ca <> cb").select("a", "b")


def word_bag(text: str) -> bytes:
    """How many words of a text fall into each bin of their hashes: the bins that occur (16 bits), then their counts (32 bits)."""
    bins, counts = np.unique(word_hashes(text) >> np.uint64(53), return_counts=True)
    return bins.astype(np.uint16).tobytes() + counts.astype(np.uint32).tobytes()


def open_pairs(nodes: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sides: np.ndarray, bags: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes in different components that lengths and common words leave within the limit. If there are two sides, only
    pairs across them.

    Common words are bounded from above: by the lesser count in bins that are full, by the product of both counts in the others, where it
    is hardly more, so that one matrix product serves a whole block.
    """
    counts = np.zeros((len(nodes), BAG_BINS), np.float32)
    for row, bag in zip(counts, bags, strict=True):
        n = len(bag) // 6
        row[np.frombuffer(bag, np.uint16, n)] = np.frombuffer(bag, np.uint32, n, 2 * n)
    most = counts.max(axis=0)
    light, heavy = counts[:, (most > 0) & (most <= LIGHT)], counts[:, most > LIGHT].astype(np.float64)
    across, out = sides.min() != sides.max(), []
    rows, others = (np.flatnonzero(sides == sides.min()), np.flatnonzero(sides != sides.min())) if across else (np.arange(len(nodes)),) * 2
    for begin in range(0, len(rows), STRIP):
        some = rows[begin : begin + STRIP]
        longer, shorter = np.maximum.outer(sizes[some], sizes[others]), np.minimum.outer(sizes[some], sizes[others])
        allowed = np.floor(longer * (1 - similarity) + 1e-9)
        fits = (longer - shorter <= allowed) & np.not_equal.outer(comps[some], comps[others]) & np.not_equal.outer(nodes[some], nodes[others])
        if not across:
            fits &= np.less.outer(some, others)
        if fits.any():
            common = (light[some] @ light[others].T).astype(np.float64)
            for column in heavy.T:
                common += np.minimum.outer(column[some], column[others])
            one, two = np.nonzero(fits & (longer - common <= allowed))
            out += [tuple(sorted(pair)) for pair in zip(nodes[some[one]].tolist(), nodes[others[two]].tolist(), strict=True)]
    return out


def linked_pairs(
    nodes: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sides: np.ndarray, texts: list[str], places: list[list[int]], bucket: int, similarity: float
) -> list[tuple[int, int, int]]:
    """Near duplicates (a, b, edits) among the texts of a group, as far as they connect components: at most one fewer than texts.

    ``places`` are the open buckets of each text. A pair that shares several is compared in one of them, told by its names, so the
    work of a pair isn't repeated and no bucket gets all of it.
    """
    row_of = dict(zip(nodes.tolist(), range(len(nodes)), strict=True))
    labels, shared = comps.tolist(), [set(p) for p in places]
    above: dict[int, int] = {}
    spelt: dict[str, str] = {}  # each word is held once, however many texts have it
    held: dict[int, tuple[list[str], Counter]] = {}
    out = []

    def root(label: int) -> int:
        while (up := above.get(label, label)) != label:
            above[label] = above.get(up, up)
            label = up
        return label

    def read(row: int) -> tuple[list[str], Counter]:
        if row not in held:
            words = [spelt.setdefault(w, w) for w in words_of(texts[row])]
            held[row] = words, Counter(words)
        return held[row]

    if len(nodes) > FEW:
        pairs = [(row_of[a], row_of[b]) for a, b in open_pairs(nodes, comps, sizes, sides, [word_bag(t) for t in texts], similarity)]
    else:
        across = sides.min() != sides.max()
        pairs = [(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes)) if not across or sides[i] != sides[j]]
    names, n_words = nodes.tolist(), sizes.tolist()
    for i, j in pairs:
        (a, i), (b, j) = sorted([(names[i], i), (names[j], j)])
        longer = max(n_words[i], n_words[j])
        if longer - min(n_words[i], n_words[j]) > edits_allowed(longer, similarity):
            continue
        both = shared[i] & shared[j]
        if len(both) > 1 and sorted(both)[(a ^ b) % len(both)] != bucket:
            continue
        one, two = root(labels[i]), root(labels[j])
        if one == two:
            continue
        (x, x_counts), (y, y_counts) = read(i), read(j)
        limit = edits_allowed(max(len(x), len(y)), similarity)
        if max(len(x), len(y)) - (x_counts & y_counts).total() > limit:
            continue
        found = distance_within(x, y, limit)
        if found is not None:
            above[one] = two
            out.append((a, b, found))
    return out


def cross_pairs(members: DataFrame, comps: DataFrame, wanted: DataFrame, similarity: float, block: int = OPEN_BLOCK) -> DataFrame:
    """Near duplicates (a, b, edits) that share a bucket but no component, as many as connect the components.

    A bucket is dealt into blocks of about ``block`` texts, and every two of its blocks meet in a group of their own with their texts.
    Pairs are compared there: their number may grow with the square of a bucket, so only links leave the group.
    """
    labelled = _labelled(members.select("bucket", "node"), comps, "node", "comp")
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("_n")).filter("least < most")
    open_ = settled(labelled.join(mixed.select("bucket", "_n"), "bucket"), "open-buckets")
    # A text has at most as many buckets as it has sketches and, if it is short, first runs.
    placed = open_.groupBy("node").agg(F.collect_set("bucket").alias("places"))
    texts = wanted.select("node", "n_words", "text").join(placed, "node")
    last = F.ceil(F.col("_n") / block).cast("long") - 1
    dealt = (
        open_.withColumn("_last", last)
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("_last") + 1))
        .withColumn("_other", F.explode(F.expr("sequence(0L, _last)")))
        .select("bucket", F.least("side", "_other").alias("low"), F.greatest("side", "_other").alias("high"), "node", "comp", "side")
        .join(texts, "node")
    )
    keys = ["bucket", "low", "high"]
    met = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before = None

        def group() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            columns = [table.column(c).to_numpy() for c in ("node", "comp", "n_words", "side")]
            links = linked_pairs(*columns, table.column("text").to_pylist(), table.column("places").to_pylist(), int(before[0]), similarity)
            ends = list(zip(*links, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ends], names=["a", "b", "edits"])

        for batch in batches:
            named = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            begins = [0, *(np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1).tolist(), len(named)] if len(named) else []
            for begin, end in zip(begins, begins[1:], strict=False):
                name = tuple(named[begin])
                if held and name != before:
                    yield group()
                    held = []
                before = name
                held.append(batch.slice(begin, end - begin))
        if held:
            yield group()

    return met.select(*keys, "node", "comp", "n_words", "side", "text", "places").mapInArrow(work, "a long, b long, edits long")


def _classes(docs: DataFrame, similarity: float, id_col: str, text_col: str, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and per text: copy_of, comp, n_links, class_id and ``leader``, the text that leads its class."""
    links, comps = near_links(docs, similarity, id_col, text_col, exact)
    ids = settled(docs.select(F.col(id_col).alias("doc_id"), _node(text_col).alias("node")), "text-ids")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    copies = _labelled(ids.groupBy("node").agg(F.min("doc_id").alias("copy_of")), comps, "node", "comp").join(ends, "node", "left")
    copies = settled(copies, "text-copies")
    first = F.min(F.struct(F.col("copy_of").isNull(), F.col("copy_of"), F.col("node")))
    leaders = copies.groupBy("comp").agg(first.alias("_first")).select("comp", "_first.copy_of", "_first.node")
    named = copies.join(leaders.select("comp", F.col("copy_of").alias("class_id"), F.col("node").alias("leader")), "comp")
    return ids, settled(named.select("node", "copy_of", "class_id", "leader", F.coalesce("n_links", F.lit(0)).alias("n_links")), "text-classes")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact: bool = False
) -> DataFrame:
    """One row per row of ``docs``: its id, ``copy_of`` (smallest id with the same text), ``class_id`` (smallest id in its class)
    and ``n_links`` (links of its text that were used to connect the class; which ones depends on the order of comparing)."""
    ids, named = _classes(docs, similarity, id_col, text_col, exact)
    return ids.join(named, "node").select("doc_id", "copy_of", "class_id", "n_links")


def one_per_class(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact: bool = False
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text and id lead their class; of repeated rows one."""
    _, named = _classes(docs, similarity, id_col, text_col, exact)
    leading = named.filter("node = leader").select(F.col("copy_of").alias("_id"), F.col("node").alias("_node"))
    keyed = docs.withColumn("__text_hash", _node(text_col))
    kept = keyed.join(leading, keyed[id_col].eqNullSafe(F.col("_id")) & (F.col("__text_hash") == F.col("_node")), "left_semi")
    repeated = docs.groupBy(id_col, _node(text_col).alias("_node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([id_col, "__text_hash"])
    return kept.drop("__text_hash")
