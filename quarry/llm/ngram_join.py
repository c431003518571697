"""N-gram Jaccard join on token-combination prefixes, and the components of its links.

The tokens of a document are its distinct 5-word shingles, as 64-bit hashes. Documents with the same
set are one node, named by a 64-bit fingerprint of the set; everything below is between nodes.

Classes: a shingle is *frequent* if its bucket of a bitmap of fixed size is set. The bitmap comes from
counts over all documents: each run of documents adds up what occurs at least twice in it, and the sums of
at least FREQUENT set bits; over r runs in any mixed order that finds what more than about 4 sqrt(r) documents hold. Which shingles count as frequent only steers the work; any fixed order of
all shingles gives the same links. Here rare ones come first, then frequent ones, each by hash.

Prefixes: with n shingles, of which a partner of Jaccard t or more must share o = ceil(t n), two
linked documents share a shingle among the first n - o + 1. If a document has more than n - o rare
ones, its prefix has only those, and each is indexed alone. Otherwise the prefix is all rare ones,
each alone, and those frequent ones that a link without any common rare shingle must still share: of
its f frequent shingles such a pair has o in common, so it shares at least K among the first
f - o + K. These are dealt into groups by hash, a power of two that depends on n only, and K is one more than
the groups of the largest partner. So the first K common ones, which both prefixes have, put two into one group of
the partner with more groups, which then are in one group of the other as well; the index gets every pair of
shingles of a group. Sets too small for that (a single shingle) are indexed by each shingle. A pair of frequent shingles is far rarer than
either, which keeps the lists of passages that many documents quote out of the way.

Groups: lists with the same members are one list, and the lists of one smallest node are one group, which
has each of its nodes once however many keys they share. A sketch of a set holds the parity of each of its hashed
buckets; two sketches differ in no more bits than the sets in members, which rules most pairs out before any set is
fetched. Groups are compared in tiles of bounded size. The first round takes, within each block of a group, every pair
that sizes and sketches allow, or, where these are more than a few for each node, a spanning forest of the closest. Only such crowds and
groups of several blocks see two more rounds: a forest between the components that are left, then every such pair between components.
A crowd of near copies is so linked by a forest, without forming its pairs, and no link between components is lost.
Verification is exact, on the whole sets of 64-bit shingle hashes, as a JVM-side array intersection.

Defined results: null and empty texts, and those without words, have 0 shingles and link with nothing;
a text of fewer than 5 words has its whole sequence as one shingle. Repeated rows link with each
other. Rows with null ids keep the component null and take no part in links. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import cut, likely_members, table
from .components import components

WORDS = 5
#: Documents that hold a shingle, as counted within runs, from which it is frequent.
FREQUENT = 16
#: Shingles that a worker holds while it looks for repeated ones.
RUN_TOKENS = 1 << 21
#: log2 of the bits of the bitmap of frequent shingles.
BITMAP_BITS = 23
#: Bits of the sketch that stands for a set where a pair is first judged: a power of two, this times the set's size or up to twice that.
SKETCH_BITS = 2
#: Nodes of a block of a group; a tile compares two blocks at most.
TILE = 512
#: Likely pairs that a tile sends for each of its nodes before it falls back to a spanning forest: in the first round, in the second.
PAIRS_A_NODE = (2, 8)
#: Words of sketches that are compared at once.
PAIR_WORDS = 1 << 20


def _word_hashes(texts) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, hashes of its words), in order."""
    at, held = 0, []
    for ids, buf, ends in kernels.segments(texts, kernels.WHITE):
        buf = kernels.LOWER[buf]
        begin, end = kernels.words(buf, kernels.WHITE)
        hashed = kernels.Hasher(buf)(begin, end)
        cuts = np.searchsorted(begin, ends)
        for i, part in zip(ids.tolist(), np.split(hashed, cuts[:-1]), strict=True):
            if i != at:
                yield at, np.concatenate(held) if len(held) != 1 else held[0]
                at, held = i, []
            held.append(part)
    if held:
        yield at, np.concatenate(held) if len(held) != 1 else held[0]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a word sequence."""
    if not len(words):
        return words
    if len(words) < WORDS:
        grams = [words[k : k + 1] for k in range(len(words))]
        seed = len(words)
    else:
        grams, seed = [words[k : len(words) - WORDS + 1 + k] for k in range(WORDS)], WORDS
    h = np.full(len(grams[0]), seed, np.uint64)
    for g in grams:
        h = kernels.mix(h * np.uint64(0x9E3779B97F4A7C15) + g)
    return np.unique(h)


def _sets(texts) -> Iterator[tuple[np.ndarray, int]]:
    """(set, fingerprint) of each text."""
    for _, words in _word_hashes(texts):
        s = shingle_set(words)
        with np.errstate(over="ignore"):
            mark = kernels.mix(np.array([kernels.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]
        yield s, int(mark)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles that at least two distinct sets hold, with their number, by runs of about RUN_TOKENS shingles."""
    distinct, held = {}, 0
    for batch in batches:
        for s, mark in _sets(batch["text"]):
            if mark not in distinct:
                distinct[mark] = s
                held += len(s)
            if held >= RUN_TOKENS:
                yield _counted(distinct)
                distinct, held = {}, 0
    if distinct:
        yield _counted(distinct)


def _counted(sets: dict[int, np.ndarray]) -> pd.DataFrame:
    tokens, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    more = n > 1
    return pd.DataFrame({"token": tokens[more].view(np.int64), "n": n[more].astype(np.int64)})


def frequent_bitmap(docs: DataFrame) -> np.ndarray:
    """One bit a bucket: at most 2**BITMAP_BITS / 64 rows come to the driver."""
    counts = docs.mapInPandas(_repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    bucket = F.shiftrightunsigned("token", 64 - BITMAP_BITS)
    words = counts.groupBy(F.shiftright(bucket, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits"))
    got = words.toArrow().to_pandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def least_overlap(n, percent: int):
    """ceil(percent n / 100): what a set of n shares with any partner of that Jaccard similarity."""
    return -(-percent * n // 100)


def groups_of(n: int) -> int:
    """Groups of a set of n: a power of two, so that two in one group of many are in one group of fewer."""
    return 1 << max(0, (n // 8).bit_length() - 1)


def _met(n: int, percent: int) -> int:
    """Common shingles that must be in the prefix of a set of n: one more than the groups of its largest partner."""
    return groups_of(100 * n // percent) + 1


def _alone(n: int, percent: int) -> bool:
    return least_overlap(n, percent) < _met(n, percent)


def index_keys(s: np.ndarray, bitmap: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set is indexed."""
    at = _bucket(s)
    frequent = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    rare, common = s[~frequent], s[frequent]
    n, f = len(s), len(common)
    o = least_overlap(n, percent)
    if f < o:  # the prefix ends among the rare ones
        return rare[: n - o + 1]
    groups, k = groups_of(n), _met(n, percent)
    # singles where the smallest partner has too few shingles in common for its groups
    alone = common[: f - o + 1] if _alone(o, percent) or _alone(n, percent) else common[:0]
    if _alone(n, percent):
        return np.r_[rare, alone]
    first = common[: f - o + k]
    group = first % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    first, group = first[order], group[order]
    keys = [alone]
    for gap in range(1, len(first)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        keys.append(kernels.mix(first[:-gap][same] * np.uint64(3) + kernels.mix(first[gap:][same])))
    return np.concatenate([rare, *keys])


def _postings(bitmap, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, held = [], [], 0
            for s, mark in _sets(batch["text"]):
                if len(s) and mark not in seen:
                    seen.add(mark)
                    keys.append(index_keys(s, bitmap.value, percent))
                    nodes.append(mark)
                    held += len(keys[-1])
                    if held > 1 << 20:
                        yield _posting_rows(keys, nodes)
                        keys, nodes, held = [], [], 0
            if keys:
                yield _posting_rows(keys, nodes)

    return run


def _posting_rows(keys, nodes) -> pd.DataFrame:
    return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "node": np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])})


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parities of the set's hashed buckets, as 64-bit words; that of half the length is the exclusive or of its halves."""
    size = max(64, 1 << int(np.ceil(np.log2(max(SKETCH_BITS * len(s), 1)))))
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        got = [(len(s), mark, _sketch(s)) for s, mark in _sets(texts)]
        yield pd.DataFrame(got, columns=["n_shingles", "node", "sketch"])


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), 512):
            got = list(_sets(batch["text"].iloc[lo : lo + 512]))
            yield pd.DataFrame({"node": np.array([g[1] for g in got], np.int64), "tokens": [g[0].view(np.int64) for g in got]})


class _Sketches:
    """Sketches of many rows in one buffer, by width and folded as needed."""

    def __init__(self, sketches):
        self.width = np.array([len(s) for s in sketches], np.int64)
        self.rows = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            place = np.empty(len(sketches), np.int64)
            place[at] = np.arange(len(at))
            self.rows[w] = np.stack([np.asarray(sketches[k], np.int64) for k in at]).view(np.uint64), place

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of each pair differ, the wider one folded: at most the sets' symmetric difference."""
        out = np.zeros(len(i), np.int64)
        low, high = np.minimum(self.width[i], self.width[j]), np.maximum(self.width[i], self.width[j])
        for w, wide in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
            at = np.flatnonzero((low == w) & (high == wide))
            less = np.where(self.width[i[at]] <= self.width[j[at]], i[at], j[at])
            more = i[at] + j[at] - less
            (a, pa), (b, pb) = self.rows[w], self.rows[wide]
            while b.shape[1] > w:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            step = max(1, PAIR_WORDS // w)
            for lo in range(0, len(at), step):
                of = slice(lo, lo + step)
                out[at[of]] = np.bitwise_count(a[pa[less[of]]] ^ b[pb[more[of]]]).sum(axis=1)
        return out


def _forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the edges of a least spanning forest between the classes that ``label`` names."""
    left = np.argsort(weight, kind="stable")
    label = np.unique(label, return_inverse=True)[1]
    taken = []
    while True:
        left = left[label[i[left]] != label[j[left]]]
        if not len(left):
            break
        ends = np.stack([label[i[left]], label[j[left]]], axis=1)
        # each class takes its first edge; edges have one strict order, so no cycle arises
        first = np.unique(ends.ravel(), return_index=True)[1] // 2
        chosen = np.unique(first)
        taken.append(left[chosen])
        low = np.arange(label.max() + 1)
        a, b = ends[chosen].T
        while True:
            least = np.minimum(low[a], low[b])
            after = low.copy()
            np.minimum.at(after, a, least)
            np.minimum.at(after, b, least)
            after = after[after]
            if (after == low).all():
                break
            low = after
        label = low[label]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _tile_pairs(tiles: pd.DataFrame, percent: int, few: int | None) -> pd.DataFrame:
    """Pairs of whole tiles that neither sizes nor sketches rule out, between components.

    Tiles that have more than ``few`` such pairs a node (None: any number is few) send a spanning forest of the closest, and
    a row that names their group instead of a pair.
    """
    tiles = tiles.sort_values(["tile", "n_shingles"], kind="stable").reset_index(drop=True)
    tile = np.unique(tiles["tile"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    n, node, doc, component, minor = (tiles[c].to_numpy() for c in ("n_shingles", "node", "doc", "component", "minor"))
    far = np.int64(n.max() + 1) if len(n) else np.int64(1)
    place = tile * far + n
    most = np.minimum(100 * n // percent, far - 1)  # the largest partner, since rows of a tile come by size
    after = np.searchsorted(place, tile * far + most, side="right") - np.arange(len(n)) - 1
    sketches = _Sketches(tiles["sketch"].tolist())
    found = []
    ends = np.cumsum(after)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIR_WORDS, side="right")))
        i = np.repeat(np.arange(lo, hi), after[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[lo:hi] - after[lo:hi] - (ends[lo - 1] if lo else 0), after[lo:hi])
        ok = (component[i] != component[j]) & (minor[i] | minor[j])
        i, j = i[ok], j[ok]
        apart = sketches.apart(i, j)
        ok = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
        found.append((i[ok], j[ok], apart[ok]))
        lo = hi
    i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    dense = np.zeros(0, np.int64)
    if few is not None and len(i):
        many = np.bincount(tile[i], minlength=tile[-1] + 1) > few * np.bincount(tile)
        full = many[tile[i]]
        classes = np.unique(np.stack([tile, component]), axis=1, return_inverse=True)[1].ravel()
        best = np.flatnonzero(full)[_forest(i[full], j[full], (apart / (n[i] + n[j]))[full], classes)]
        dense = tiles["group"].to_numpy()[np.searchsorted(tile, np.flatnonzero(many))]
        i, j = (np.r_[x[~full], x[best]] for x in (i, j))
    i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
    none = np.zeros(len(dense), np.int64)
    ends = {name: np.r_[of[at], none] for name, of, at in (("a", node, i), ("b", node, j), ("doc_a", doc, i), ("doc_b", doc, j))}
    return pd.DataFrame({"group": np.r_[np.zeros(len(i), np.int64), dense], "pair": np.arange(len(i) + len(dense)) < len(i), **ends})


def _compared(percent: int, few: int | None):
    """Over a partition whose rows come ordered by tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            held.append(batch)
            if sum(map(len, held)) < TILE:
                continue
            rows = pd.concat(held, ignore_index=True)
            whole = int(np.searchsorted((rows["tile"] == rows["tile"].iloc[-1]).to_numpy(), True))  # the last tile may go on
            if whole:
                yield _tile_pairs(rows.iloc[:whole], percent, few)
            held = [rows.iloc[whole:]]
        if held:
            yield _tile_pairs(pd.concat(held, ignore_index=True), percent, few)

    return run


def _groups(postings: DataFrame) -> DataFrame:
    """(group, node): every two nodes with a common key are in one group.

    The lists of one smallest node are a group, unless that has more pairs than its lists have one by one.
    """
    w = Window.partitionBy("key")
    # lists with the same members, as far as their hash tells, become one
    part = F.shiftright(F.xxhash64("node"), 32)
    lists = postings.select("node", F.min("node").over(w).alias("least"), F.max("node").over(w).alias("most"), F.xxhash64(F.sum(part).over(w), F.count("*").over(w)).alias("sig"))
    shared = cut(lists.where("least <> most").select(F.xxhash64("sig", "least", "most").alias("list"), "node", "least").distinct())
    by_least = shared.repartition("least")  # one exchange serves all that follows
    one_by_one = by_least.groupBy("least", "list").agg(F.count("*").cast("double").alias("n")).groupBy("least").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    stars = by_least.select("least", "node").distinct()
    wide = stars.groupBy("least").agg(F.count("*").cast("double").alias("n")).join(one_by_one, "least").where("n * n > pairs").select("least")
    together = stars.join(wide, "least", "left_anti").select(F.xxhash64(F.lit(0), "least").alias("group"), "node")
    return together.union(by_least.join(wide, "least", "left_semi").select(F.xxhash64(F.lit(1), "list"), "node"))


def _may_meet(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (group, node, doc, n_shingles) without nodes that no other of their group is near enough in size."""
    by_size = Window.partitionBy("group").orderBy("n_shingles", "node")
    near = lambda less, more: F.coalesce(100 * less >= percent * more, F.lit(False))
    n = F.col("n_shingles")
    marked = rows.withColumn("near", near(F.lag(n).over(by_size), n) | near(n, F.lead(n).over(by_size)))
    return marked.where("near").drop("near")


def _candidates(rows: DataFrame, members: DataFrame, percent: int, few: int | None) -> DataFrame:
    """(group, pair, a, b, doc_a, doc_b) from ``rows`` (group, node, doc, n_shingles, component, minor) of the tiles (group, part, other)."""
    sketches = likely_members(members.select("node", "sketch"), rows, "node").dropDuplicates(["node"])
    dealt = rows.withColumn("tile", F.xxhash64("group", "part", "other")).drop("part", "other").join(sketches, "node")
    ordered = dealt.repartition("tile").sortWithinPartitions("tile")
    return cut(ordered.mapInPandas(_compared(percent, few), "group long, pair boolean, a long, b long, doc_a long, doc_b long"))


def _within(rows: DataFrame) -> DataFrame:
    """``rows`` (group, node, doc, n_shingles) of groups in blocks of about TILE nodes, each a tile of its own."""
    blocks = rows.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    whole = rows.join(blocks, "group").withColumns({"component": F.col("node"), "minor": F.lit(True)})
    return whole.withColumns({"part": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "other": F.lit(0)})


def _across(rows: DataFrame) -> DataFrame:
    """``rows`` (group, node, doc, n_shingles, component) of the groups that hold several components, dealt to tiles.

    All but a group's largest component are its minor nodes. They go in parts of about TILE to every block of the
    group, and every node to each part: any two nodes of different components meet in a tile, and a crowd of one
    component is not compared with itself.
    """
    by = rows.groupBy("group", "component").agg(F.count("*").alias("n"))
    sizes = by.groupBy("group").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("major"), F.count("*").alias("c")).where("c > 1")
    parts, blocks = (F.ceil(n / TILE).cast("int").alias(name) for n, name in ((F.col("n") - F.col("major.n"), "parts"), (F.col("n"), "blocks")))
    open_rows = rows.join(sizes.select("group", F.col("major.component").alias("major"), parts, blocks), "group")
    marked = open_rows.withColumns({"minor": F.col("component") != F.col("major"), "hash": F.xxhash64("node")})
    own_part, own_block = F.pmod("hash", F.col("parts")), F.pmod(F.shiftright("hash", 20), F.col("blocks"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.cast("long").alias("part"), own_block.alias("other")))
    as_minor = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(own_part.alias("part"), b.cast("long").alias("other")))
    tiles = F.when(F.col("minor"), F.array_union(as_any, as_minor)).otherwise(as_any)
    kept = ["group", "node", "doc", "n_shingles", "component", "minor"]
    return marked.select(*kept, F.explode(tiles).alias("t")).select(*kept, "t.part", "t.other")


def _similar(found: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs in ``found`` whose whole sets reach the similarity; each set is made again from one document that holds it."""
    pairs = found.where("pair").select("a", "b", "doc_a", "doc_b").distinct()
    ids = pairs.select(F.col("doc_a").alias("doc_id")).union(pairs.select("doc_b"))
    chosen = likely_members(rows, ids, "doc_id").join(ids.hint("merge"), "doc_id", "left_semi").select("text")
    sets = chosen.mapInPandas(_full_sets, "node long, tokens array<long>")  # one exchange serves both joins
    of = lambda side: sets.select(F.col("node").alias(side), F.col("tokens").alias(f"t_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b")))
    return cut(both.where(100 * F.col("shared") >= percent * (F.size("t_a") + F.size("t_b") - F.col("shared"))).select("a", "b"))


def link_components(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = F.pandas_udf(_described, "n_shingles long, node long, sketch array<long>")
    members = cut(rows.select("doc_id", described("text").alias("m")).select("doc_id", "m.*"))
    named = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows, worded = rows.where("doc_id is not null"), members.where(named)
    nodes = cut(worded.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles")))
    texts = rows.select("text")
    bitmap = spark.sparkContext.broadcast(frequent_bitmap(texts))
    met = _groups(texts.mapInPandas(_postings(bitmap, percent), "key long, node long"))
    tiles = cut(_within(_may_meet(met.join(nodes, "node"), percent)))
    found = _candidates(tiles, worded, percent, PAIRS_A_NODE[0])
    groups = components(_similar(found, rows, percent))
    # groups of several blocks, and those that sent a forest only, may have links left between components
    again = tiles.select("group", "node", "doc", "n_shingles")
    dense = found.where("not pair").select("group").union(tiles.where("blocks > 1").select("group")).distinct()
    for few in (PAIRS_A_NODE[1], None):  # where there are many, first the likeliest, then whatever is left
        again = again.join(dense, "group", "left_semi")
        across = cut(_across(again.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))))
        if across.isEmpty():
            break
        found = _candidates(across, worded, percent, few)
        more = _similar(found, rows, percent)
        if not more.isEmpty():
            groups = components(groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        dense = found.where("not pair").select("group").distinct()
        if few is None or dense.isEmpty():
            break
    placed = nodes.join(groups, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_node = placed.join(smallest, "component").select("node", "component_id")
    out = worded.join(by_node, "node").select("doc_id", "n_shingles", "component_id")
    return out.union(members.where(~named).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
