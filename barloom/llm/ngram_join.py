"""Near copies by an exact Jaccard join on word n-grams: a prefix join over groups of documents.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets are one node. Two nodes whose sets
reach the limit share a shingle among the first ``n - ceil(limit * n) + 1`` of each set, in any order of shingles that
all sets share. The order puts rare shingles first: shingles in the lowest part of the hash range (``low_part``) come
first, then the others; within either, by the number of sets that list them, then by hash. A set lists its low shingles,
or all of them where the low ones do not fill its prefix, so frequencies are counted over every document but over
a part of its shingles only. Shingles of one set alone join nothing and are dropped, counted but not carried.

Nodes with the same prefix and size form a group. Candidates are pairs of groups that share a prefix shingle, cut by
size, by position and by bitmap: a set's parity bitmap differs from another's in no more bits than the sets differ in
shingles, and the difference of two groups is at least that of their first members less what members differ from
them. As only connected components are asked for, candidates are met in passes: members with the first of their
group, groups with the group of each shingle that has the fewest shingles of its own, first members of every pair of groups
that is not connected yet, and the members of the pairs that then are still apart. Each pass verifies its pairs on
whole sets.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, UPPER, components, map_arrow, small_side
from barloom.session import cut_lineage, recorded_tables, remove_tables

LANES = 16
MEMORY = 32 << 20
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHash(dict):
    """64-bit hashes of words for one task, forgotten when the words take ``MEMORY`` bytes."""

    def __init__(self):
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self.bytes += len(word) + 150
        if self.bytes > MEMORY:
            self.clear()
            self.bytes = 0
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of all its words together where they are fewer."""
    found = text.encode().translate(_FOLD).split() if text else []  # bytes are split at ASCII blanks only
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(codes))
    h = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : k + len(h)]) * _MIX[0]
        h ^= h >> np.uint64(29)
    for mix in _MIX[1:]:
        h = h * mix
        h ^= h >> np.uint64(31)
    return np.unique(h)


def prefix_length(n, percent: int):
    """How many first shingles a set of ``n`` must be looked up by."""
    return n - (percent * n + 99) // 100 + 1


def low_part(percent: int) -> float:
    """Part of the hash range whose shingles come first: a third more than the prefix takes, so that they mostly fill it."""
    return min(1.0, (100 - percent) / 75)


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of how many of the hashes fall on each of 64 * ``LANES`` bits."""
    counts = np.bincount((found >> np.uint64(20)).astype(np.int64) % (64 * LANES), minlength=64 * LANES)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def _parts(batches):
    """The rows a thousand at a time, so that the sets of a whole batch are never held together."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield batch.slice(start, 1000)


def _listed(words: int, percent: int):
    edge = np.uint64(min(int(low_part(percent) * 2**64), 2**64 - 1))

    def run(batches):
        hashes = WordHash()
        for batch in _parts(batches):
            ids, nodes, sizes, low, high, bits = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = shingle_set(text, words, hashes)
                ids.append(doc)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                cut = int(np.searchsorted(found, edge, "right"))
                enough = cut >= prefix_length(len(found), percent)
                low.append(found[:cut].view(np.int64))
                high.append(found[:0].view(np.int64) if enough else found[cut:].view(np.int64))
                bits.append(bitmap(found))
            yield ids, batch.column("text_key"), nodes, sizes, low, high, bits

    return run


def _whole(words: int):
    def run(batches):
        hashes = WordHash()
        for batch in _parts(batches):
            sets = [shingle_set(t, words, hashes) for t in batch.column("text").to_pylist()]
            yield batch.column("node"), [s.view(np.int64) for s in sets]

    return run


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def component_rows(documents: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, text_key.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets. component_id is the smallest doc_id
    reachable. A null text, or one without words, has an empty set and links with nothing. Rows that repeat an id
    are judged each by its own text; a null doc_id takes the smallest id it reaches, or null. text_key is a hash of the
    text, to find the row again. Other columns are ignored; an empty table gives an empty result.
    """
    source = documents.select("doc_id", "text").withColumn("text_key", text_key(F.col("text")))
    listed = "doc_id long, text_key long, node long, n int, low array<long>, high array<long>, bits array<long>"
    listed = cut_lineage(map_arrow(source, _listed(words, percent), listed))
    rows = listed.select("doc_id", "text_key", "node", "n")
    full = listed.filter("node is not null")
    nodes = cut_lineage(full.groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("low_id"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("bits").alias("bits")))
    tokens = lambda: nodes.select("node", F.explode(F.concat(F.transform("low", lambda x: F.struct(F.lit(0).alias("high"), x.alias("token"))), F.transform("high", lambda x: F.struct(F.lit(1).alias("high"), x.alias("token"))))).alias("s")).select("node", "s.*")
    common = cut_lineage(tokens().groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = tokens().join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("high", "df", "token"))).alias("s"))
    sized = nodes.select("node", "n", "bits", F.size("low").alias("n_low"), F.size("high").alias("n_high"))
    groups = _groups(sized.join(shared, "node"), percent)
    groups = cut_lineage(groups)
    links = _links(documents, nodes.select("node", "at"), groups, words, percent)
    roots = components(links)
    lowest = nodes.select("node", F.col("low_id").alias("low")).join(roots, "node")
    first = cut_lineage(lowest.groupBy("root").agg(F.min("low").alias("component_id")))
    per_node = cut_lineage(lowest.join(first, "root").select("node", "component_id").union(nodes.join(roots, "node", "left_anti").select("node", "low_id")))
    out = rows.join(per_node, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")


def _groups(found: DataFrame, percent: int) -> DataFrame:
    """Nodes with the part of their prefix that other sets share: rows (node, n, bits, own, gid, prefix of (token, place))."""
    low, high = F.filter("s", lambda x: x["high"] == 0), F.filter("s", lambda x: x["high"] == 1)
    found = found.withColumns({"p": F.expr(f"cast(n - ceil({percent} * n / 100.0) + 1 as int)"), "low": low, "high": high})
    found = found.withColumns({"alone_low": F.col("n_low") - F.size("low"), "before_high": F.col("n_low") + F.col("n_high") - F.size("high")})
    place = lambda side, base: F.transform(side, lambda x, i: F.struct(x["token"].alias("token"), (F.col(base) + i).alias("place")))
    both = F.concat(place("low", "alone_low"), place("high", "before_high"))
    found = found.withColumn("prefix", F.filter(both, lambda x: x["place"] < F.col("p"))).filter(F.size("prefix") > 0)
    own = F.col("n_low") + F.col("n_high") - F.size("low") - F.size("high")
    return found.select("node", "n", "bits", own.alias("own"), "prefix", F.when(F.size("prefix") == F.col("p"), F.xxhash64("n", "prefix")).otherwise(F.col("node")).alias("gid"))


def one_of_each(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """``documents`` without those whose component holds a smaller doc_id; of rows equal in id and text one stays.

    Documents without words stay. A document without an id goes if it links with one that has an id.
    """
    with recorded_tables() as written:
        rows = component_rows(documents, words, percent).groupBy("doc_id", "text_key").agg(F.min("component_id").alias("low"), F.count("*").alias("times"))
        rows = cut_lineage(rows.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("low"))))
    remove_tables(documents.sparkSession, written[:-1])  # the rows found are all that is read from here on
    gone, repeated = (small_side(rows.filter(what).select("doc_id", "text_key")) for what in ("not stays or times > 1", "stays and times > 1"))
    at = lambda side: documents["doc_id"].eqNullSafe(side["doc_id"]) & (text_key(documents["text"]) == side["text_key"])
    once = documents.join(repeated, at(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return documents.join(gone, at(gone), "left_anti").union(once)


def _forest(batches):
    """Of a task's links, those that join two trees: they connect the same nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        kept = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            u, v = find(a), find(b)
            if u != v:
                root[u] = v
                kept.append((a, b))
        yield [a for a, _ in kept], [b for _, b in kept]


def _links(documents: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect all nodes that are connected."""
    wanted = groups.select("node").join(nodes, "node").select("node", "at.*")
    texts = documents.select("doc_id", "text").withColumn("text_key", text_key(F.col("text")))
    wanted = small_side(wanted)
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_key"] == wanted["text_key"])
    sets = cut_lineage(map_arrow(texts.join(wanted, same).select("node", "text").dropDuplicates(["node"]), _whole(words), "node long, s array<long>"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of rows (a, b), those that link, with the number of shingles they differ in."""
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        met = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("m"))
        met = met.filter(f"100 * m >= {percent} * (na + nb - m)")
        return cut_lineage(met.select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("m")).alias("apart")))

    # members with the first of their group; those that do not link with it go on alone
    heads_of = groups.groupBy("gid").agg(F.min(F.struct("node", "n", "bits")).alias("first"), F.count("*").alias("members")).filter("members > 1")
    in_group = groups.join(heads_of, "gid").filter("node <> first.node").filter(_near_bits("bits", "first.bits", "n", "first.n", percent))
    inside = verified(in_group.select(F.col("node").alias("a"), F.col("first.node").alias("b")))
    slack = inside.groupBy("b").agg(F.max("apart").alias("slack")).withColumnRenamed("b", "node")
    kept = inside.select(F.col("a").alias("node"), F.col("b").alias("head"))
    groups = groups.join(kept, "node", "left").withColumn("gid", F.coalesce("head", "node")).drop("head")
    groups = cut_lineage(groups.join(slack, "node", "left").withColumn("slack", F.coalesce("slack", F.lit(0))))
    links = inside.select("a", "b")
    heads = groups.filter("node = gid").select("gid", "n", "bits", "own", "slack", (F.size("prefix") - 1).alias("end"), F.posexplode("prefix").alias("pos", "x")).select("gid", "n", "bits", "own", "slack", (F.col("pos") == F.col("end")).alias("tail"), "x.*")

    # groups with the most central group of each shingle
    pivots = heads.groupBy("token").agg(F.min(F.struct("own", "gid", "n", "place", "bits", "slack")).alias("to"), F.count("*").alias("groups")).filter("groups > 1")
    near = heads.join(cut_lineage(pivots), "token").filter("gid <> to.gid").filter(_may_link("n", "to.n", "place", "to.place", percent))
    near = near.filter(_near_bits("bits", "to.bits", "n", "to.n", percent))
    links = cut_lineage(links.union(verified(near.select(F.col("gid").alias("a"), F.col("to.gid").alias("b")).distinct()).select("a", "b")))

    # pairs of groups not connected yet. Their first members are compared: first of those that share the commonest
    # prefix shingle of either, which meets most pairs of a large group once or twice, then of all that are left. Only
    # where these do not link either, the members are brought in, one side after the other
    for tails in (True, False):
        apart = _apart(heads, components(links), tails, percent)
        near = apart.filter(_near_bits("bits", "bits2", "n", "n2", percent)).select(F.col("gid").alias("a"), F.col("gid2").alias("b"))
        links = cut_lineage(links.union(map_arrow(verified(near).select("a", "b"), _forest, "a long, b long")))
    crowded = groups.groupBy("gid").agg(F.count("*").alias("members")).filter("members > 1").select("gid")
    roots = cut_lineage(components(links).withColumnRenamed("node", "gid"))
    rooted = lambda side: roots.select(F.col("gid").alias(f"gid{side}"), F.col("root").alias(f"root{side}"))
    rest = apart.join(rooted(""), "gid", "left").join(rooted("2"), "gid2", "left").filter("coalesce(root, gid) <> coalesce(root2, gid2)").drop("root", "root2")
    rest = rest.join(crowded.withColumn("many", F.lit(True)), "gid", "left").join(crowded.select(F.col("gid").alias("gid2"), F.lit(True).alias("many2")), "gid2", "left")
    rest = cut_lineage(rest.filter("many or many2"))  # groups of one member each were compared just now
    member = lambda a, b: groups.select(F.col("gid").alias(a), F.col("node").alias(b), F.col("n").alias(f"n{b}"), F.col("bits").alias(f"bits{b}"))
    one = cut_lineage(rest.join(member("gid", "a"), "gid").filter(_near_bits("bitsa", "bits2", "na", "n2", percent, "slack2")).select("gid2", "a", "na", "bitsa"))
    pairs = one.join(member("gid2", "b"), "gid2").filter(_near_bits("bitsa", "bitsb", "na", "nb", percent)).select("a", "b")
    return links.union(map_arrow(verified(pairs).select("a", "b"), _forest, "a long, b long"))


def _apart(heads: DataFrame, roots: DataFrame, tails: bool, percent: int) -> DataFrame:
    """Pairs of groups in different components that may hold a link, by shingles whose groups are not in one yet."""
    placed = cut_lineage(heads.join(roots.withColumnRenamed("node", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid")))
    ends = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.bool_or("tail").alias("tail"))
    open_ = cut_lineage(ends.filter("x <> y and tail" if tails else "x <> y").select("token"))
    left = cut_lineage(placed.join(open_, "token"))
    right = left.select("token", *(F.col(x).alias(f"{x}2") for x in ("gid", "n", "bits", "slack", "place", "root", "tail")))
    # the place of a shingle bounds a pair only where it is the first common one
    where = f"(tail or tail2) and {_may_link('n', 'n2', '0', '0', percent)}" if tails else _may_link("n", "n2", "place", "place2", percent)
    met = f"gid < gid2 and root <> root2 and {where} and {_near_bits('bits', 'bits2', 'n', 'n2', percent, 'slack + slack2')}"
    return cut_lineage(left.join(right, "token").filter(met).select("gid", "gid2", "n", "n2", "bits", "bits2", "slack", "slack2").dropDuplicates(["gid", "gid2"]))


def _near_bits(one: str, other: str, n1: str, n2: str, percent: int, slack: str = "0") -> str:
    """The bitmaps differ in no more places than sets that link can, plus ``slack``."""
    apart = " + ".join(f"bit_count({one}[{k}] ^ {other}[{k}])" for k in range(LANES))
    return f"({apart} - ({slack})) * {100 + percent} <= ({n1} + {n2}) * {100 - percent}"


def _may_link(n1: str, n2: str, p1: str, p2: str, percent: int) -> str:
    """Sizes near enough, and enough shingles left after the places of a first common one."""
    return (
        f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and "
        f"(1 + least({n1} - {p1} - 1, {n2} - {p2} - 1)) * {100 + percent} >= {percent} * ({n1} + {n2})"
    )
