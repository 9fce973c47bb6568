"""Join of documents whose sets of word 3-grams have a Jaccard similarity of 0.9 or more.

Equal sets are one class. Classes that may be linked are brought together without loss: the
hashes of a set are dealt to one bucket more than two similar sets of that size can differ in, so
two such sets agree in a whole bucket. Classes that share a bucket's sum form candidate groups, and
a signature tree over each group is joined with itself: nodes hold the OR of the token bitmaps
and the range of set sizes, and pairs of nodes that can't overlap enough are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comeback.llm.common import staged
from comeback.llm.components import connected
from comeback.llm.fuzzy_lines import _bitmap, _meet
from comeback.llm.textarrays import U64, buffers, mix, run_hashes, small_batches, span_hashes, words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDS64 = 32  # 64-bit words of a bitmap
TURNS = 16  # deals of a set's elements to buckets
#: Classes with this part of all rows, and HOT_ROWS rows, are broadcast; so 1 / HOT_PART of them at most.
HOT_PART, HOT_ROWS = 1e-5, 256


@dataclass(frozen=True)
class SetJoin:
    """``percent``: least similarity. ``block``: classes of a candidate group joined in one task;
    larger groups are joined in blocks. ``bin_bytes``: text of the groups that share a task."""

    gram: int = 3
    percent: int = 90
    block: int = 4096
    bin_bytes: int = 8 << 20
    fanout: int = 8


def shingles(column: pa.Array, gram: int) -> list[np.ndarray]:
    """The sorted set of ``gram``-word hashes of each text; of fewer words, their one sequence."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs = run_hashes(hashes, gram)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= gram:
            found = np.sort(runs[a : b - gram + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            out.append(run_hashes(hashes[a:b], b - a) + U64(b - a))
        else:
            out.append(hashes[:0])
    return out


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = mix(np.add.reduce(mix(found), keepdims=True) + U64(len(found)))[0]
    b = mix(np.add.reduce(mix(found ^ U64(0x5851F42D4C957F2D)), keepdims=True))[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def size_classes(most: int, percent: int) -> np.ndarray:
    """Largest size of each size class; similar sets are in the same class or in neighbouring ones."""
    tops, low = [], 1
    while low <= most:
        tops.append(low * 100 // percent)
        low = tops[-1] + 1
    return np.array(tops, np.int64)


_TOPS = {}


@lru_cache(None)
def spare_buckets(most: int, least: int) -> int:
    """So many more buckets than ``most`` that a set of ``least`` elements leaves fewer of them empty by a
    standard deviation; where none are enough, as for few elements, the deals have to do it."""
    for spare in range(1, most // 3 + 2):
        empty = (most + spare) * math.exp(-least / (most + spare))
        if empty + math.sqrt(empty) < spare:
            return spare
    return 1 + most // 8


def bucket_sums(found: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set: for its size class and the next one, the sum of each bucket that isn't empty.

    Sets of at most ``top`` elements with the least similarity differ in at most
    2 top (100 - percent) / (100 + percent) elements, so with ``spare`` buckets more, at least ``spare``
    agree. Those that are empty in both say nothing: a set with fewer than ``spare`` empty ones is done,
    any other deals its elements again. Of two similar sets, the one that is done first has an agreeing
    bucket with elements at that deal, and the other has dealt as often. A set that is never done (one in
    millions, of a few elements) tells of its empty buckets too.
    """
    if percent not in _TOPS:
        _TOPS[percent] = size_classes(1 << 34, percent)
    tops = _TOPS[percent]
    own = int(np.searchsorted(tops, len(found)))
    weights = mix(found)
    out = []
    for tag in (own, own + 1):
        most = int(2 * tops[tag] * (100 - percent) // (100 + percent))
        spare = spare_buckets(most, int(tops[tag - 2]) + 1 if tag > 1 else 1)
        buckets = most + spare
        for turn in range(TURNS):
            place = (mix(found + U64(turn * 977 + 1)) % U64(buckets)).astype(np.int64)
            count = np.bincount(place, minlength=buckets)
            sums = np.zeros(buckets, U64)
            np.add.at(sums, place, weights)
            base = mix(np.arange(buckets, dtype=U64) + U64((tag << 44) + (turn << 38)))
            signed = mix(sums + base * U64(3) + count.astype(U64))
            done = buckets - np.count_nonzero(count) < spare
            out.append(signed[count > 0] if done or turn + 1 < TURNS else signed)
            if done:
                break
    return np.concatenate(out)


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class SignatureTree:
    """Nodes over sets, level by level: OR of bitmaps, least and largest size, and most elements
    that share a bit with another element of their own set."""

    def __init__(self, sets: list[np.ndarray], fanout: int):
        n = len(sets)
        self.fanout = fanout
        size = np.array([len(s) for s in sets])
        bits = np.zeros((n, WORDS64 * 64), bool)
        bits[np.repeat(np.arange(n), size), (np.concatenate(sets) >> U64(20)) % U64(WORDS64 * 64)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        slack = size - bits.sum(axis=1)
        # Similar sets have similar least hashes, so they come to stand under the same nodes.
        order = np.lexsort(([int(s[1]) if len(s) > 1 else 0 for s in sets], [int(s[0]) for s in sets]))
        self.order = order
        self.bits, self.low, self.high, self.slack = [packed[order]], [size[order]], [size[order]], [slack[order]]
        while len(self.low[-1]) > 1:
            edges = np.arange(0, len(self.low[-1]), fanout)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], edges, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], edges))
            self.high.append(np.maximum.reduceat(self.high[-1], edges))
            self.slack.append(np.maximum.reduceat(self.slack[-1], edges))
        self.one = [[True] * n] + [[False] * len(x) for x in self.low[1:]]

    def children(self, level: int, node: int) -> range:
        return range(node * self.fanout, min((node + 1) * self.fanout, len(self.low[level - 1])))


def link_sets(sets: list[np.ndarray], percent: int, fanout: int = 8) -> Forest:
    """Joins the tree with itself; sets that are connected already aren't compared."""
    forest = Forest(len(sets))
    if len(sets) < 2:
        return forest
    tree = SignatureTree(sets, fanout)
    order = tree.order.tolist()

    def leaf(level: int, node: int) -> int:
        return order[node * fanout**level]

    def joined(level: int, node: int) -> bool:
        """Whether all sets under the node are connected; once true it stays true."""
        if not tree.one[level][node]:
            below = tree.children(level, node)
            tree.one[level][node] = all(joined(level - 1, c) for c in below) and len({forest.find(leaf(level - 1, c)) for c in below}) == 1
        return tree.one[level][node]

    def may(level: int, node: int, others: np.ndarray) -> np.ndarray:
        """Which of the nodes may hold a set similar to one under ``node``."""
        bits, low, high, slack = tree.bits[level], tree.low[level], tree.high[level], tree.slack[level]
        common = np.bitwise_count(bits[node] & bits[others]).sum(axis=1) + np.minimum(slack[node], slack[others])
        common = np.minimum(common, np.minimum(high[node], high[others]))
        enough = common * (100 + percent) >= percent * (low[node] + low[others])
        sizes = (high[node] * 100 >= percent * low[others]) & (high[others] * 100 >= percent * low[node])
        return others[enough & sizes]

    def cross(level: int, a: int, b: int) -> None:
        if joined(level, a) and joined(level, b) and forest.find(leaf(level, a)) == forest.find(leaf(level, b)):
            return
        if level == 0:
            x, y = sets[order[a]], sets[order[b]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                forest.join(order[a], order[b])
            return
        below = np.array(tree.children(level, b))
        for c in tree.children(level, a):
            for d in may(level - 1, c, below).tolist():
                cross(level - 1, c, d)

    def alone(level: int, node: int) -> None:
        if level == 0:
            return
        below = list(tree.children(level, node))
        for c in below:
            alone(level - 1, c)
        for i, c in enumerate(below[:-1]):
            for d in may(level - 1, c, np.array(below[i + 1 :])).tolist():
                cross(level - 1, c, d)

    alone(len(tree.low) - 1, 0)
    return forest


def _profiles(docs: DataFrame, rule: SetJoin) -> DataFrame:
    """(doc_id, h, n, f, g): id, hash of the text, size and fingerprint of the set, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            sets = shingles(batch.column(2), rule.gram)
            marks = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64())]
                + [pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)],
                names=["doc_id", "h", "n", "f", "g"],
            )

    return docs.mapInArrow(run, "doc_id bigint, h bigint, n bigint, f bigint, g bigint")


def _candidates(docs: DataFrame, rule: SetJoin) -> DataFrame:
    """(node, least): each class that shares a bucket with others, and the least of them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            sets = [s for s in shingles(batch.column(2), rule.gram) if len(s)]
            if not sets:
                continue
            sums = [bucket_sums(s, rule.percent) for s in sets]
            node = np.repeat(np.array([fingerprint(s)[0] for s in sets], np.int64), [len(s) for s in sums])
            signed = np.concatenate(sums).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed), pa.array(node)], names=["sig", "node"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so the first node of a signature is its least; it may be batches back."""
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.concatenate([[last is None or sig[0] != last], sig[1:] != sig[:-1]])
            at = np.cumsum(new) - 1
            heads = node[new]
            least = np.where(at >= 0, heads[np.maximum(at, 0)] if len(heads) else 0, 0)
            if held is not None:
                least = np.where(at < 0, held, least)
            last, held = sig[-1], least[-1]
            pairs = np.unique(np.stack([node, least], axis=1)[node != least], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["node", "least"])

    signed = docs.mapInArrow(sign, "sig bigint, node bigint")
    dealt = signed.repartition("sig").sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(star, "node bigint, least bigint").distinct()


def _links(members: DataFrame, rule: SetJoin, bins: int) -> DataFrame:
    """(a, b): links that connect the similar sets of each (grp, block) of (grp, block, doc_id, text)."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("block", "ascending"), ("doc_id", "ascending"), ("h", "ascending")])
        ids, grp, block = (np.asarray(table.column(c)) for c in ("doc_id", "grp", "block"))
        sets = []
        for chunk in table.column("text").chunks:
            sets += shingles(chunk, rule.gram)
        edges = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (block[1:] != block[:-1])]))
        a, b = [], []
        for low, high in zip(edges, [*edges[1:], len(ids)], strict=True):
            forest = link_sets(sets[low:high], rule.percent, rule.fanout)
            for i in range(high - low):
                if (root := forest.find(i)) != i:
                    a.append(ids[low + i])
                    b.append(ids[low + root])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    binned = members.withColumn("bin", F.pmod(F.xxhash64("grp", "block"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(join, "a bigint, b bigint")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = docs[text_column].cast("string")
    return docs.select(docs[id_column].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def similar_documents(
    docs: DataFrame, rule: SetJoin | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, the size of its set, and its component.

    The component is the smallest id reachable by links. A null text, or one without words, has an
    empty set and is linked with nothing; rows without an id are linked with nothing and have no
    component; rows that share an id are linked each by its own text. Other columns are not looked
    at. Hashes of 3-grams have 64 bits, classes of equal sets 128.
    """
    found = _components(_keyed(docs, id_column, text_column), rule or SetJoin())
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each_group(
    docs: DataFrame, rule: SetJoin | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns unchanged.

    Of each component the row with the smallest id stays (of rows that repeat it, the one with the
    smallest text hash, once). Rows without an id, without a text or without words all stay.
    """
    keyed = _keyed(docs, id_column, text_column)
    found = _components(keyed, rule or SetJoin()).where("doc_id is not null and n > 0")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("one")).select("one.*")
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_column].cast("bigint").alias("doc_id"),
        F.xxhash64(docs[text_column].cast("string")).alias("h"),
        docs[text_column].cast("string").rlike(r"[^\x20\x09-\x0D]").alias("worded"),
    )
    joins = F.coalesce("worded", F.lit(False)) & F.col("doc_id").isNotNull()
    stays = packed.where(joins).join(staged(first, "keepers"), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    return stays.select("row.*").unionByName(packed.where(~joins).select("row.*"))


def _components(source: DataFrame, rule: SetJoin) -> DataFrame:
    """(doc_id, h, n, component) of every row of (doc_id, h, text)."""
    profiles = staged(_profiles(source, rule), "profiles")
    usable = profiles.where("doc_id is not null and n > 0")
    # Equal sets: a map-side combined minimum, however many copies there are.
    classes = usable.groupBy("f", "g", "n").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.select("f", "g", "n", "first.*", "copies"), "classes")

    groups = connected(_candidates(source.where("doc_id is not null"), rule), "node", "least")
    members = groups.withColumnRenamed("node", "f").join(classes, "f").select(F.col("component").alias("grp"), "doc_id", "h", "f", "g", "n")
    members = staged(members, "members")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(sizes, "grp").where("size > 1")
    parts = F.ceil(F.col("size") / rule.block).cast("bigint")
    members = members.withColumn("block", F.pmod(F.xxhash64("f", "g"), parts)).drop("size")
    # Only rows that may be members are moved: a bitmap of bounded size, then the exact join.
    spot = F.xxhash64("doc_id", "h")
    maybe = _meet(source.withColumn("spot", spot), _bitmap(members.select(spot.alias("spot")), "spot"), "spot")
    wanted = maybe.where("maybe").select("doc_id", "h", "text")
    texts = staged(members.join(wanted, ["doc_id", "h"]).dropDuplicates(["grp", "doc_id", "h"]), "texts")
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    bins = max(1, -(-total // rule.bin_bytes))
    links = staged(_links(texts, rule, bins), "set-links")

    split = texts.where("block > 0").select("grp").distinct()
    if split.head(1):
        links = _across_blocks(texts.join(split, "grp"), links, rule)

    found = connected(links).withColumnRenamed("node", "doc_id")
    named = classes.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    multiple = named.where("copies > 1 or component <> doc_id")
    # A class may hold a third of all rows: the few large ones are broadcast, and their rows stay in place.
    large = F.col("copies") >= max(HOT_ROWS, math.ceil(profiles.count() * HOT_PART))
    multiple = staged(multiple.select("f", "g", "n", "component", "copies"), "classes-named")
    hot = multiple.where(large).select("f", "g", "n", F.col("component").alias("hot"))
    marked = profiles.join(F.broadcast(hot), ["f", "g", "n"], "left")
    rest = marked.where("hot is null").drop("hot").join(multiple.where(~large).drop("copies"), ["f", "g", "n"], "left")
    joined = rest.unionByName(marked.where("hot is not null").withColumnRenamed("hot", "component"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "h", "n", F.when(F.col("doc_id").isNotNull(), component).alias("component"))


def _across_blocks(texts: DataFrame, links: DataFrame, rule: SetJoin) -> DataFrame:
    """Links between blocks of large groups: first between one set of each connected part, then
    of blocks of the sets outside a group's largest part with each block of the group."""

    def parted() -> DataFrame:
        found = connected(links).withColumnRenamed("node", "doc_id")
        joined = texts.select("grp", "block", "doc_id", "h", "text").join(found, "doc_id", "left")
        return staged(joined.withColumn("part", F.coalesce("component", "doc_id")).drop("component"), "parts")

    def add(more: DataFrame) -> DataFrame:
        total = more.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        return staged(links.unionAll(_links(more, rule, max(1, -(-total // rule.bin_bytes)))), "set-links")

    def slots(rows: DataFrame, name: str) -> DataFrame:
        """Rows with a number below their group's rows / block."""
        count = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / rule.block).cast("bigint").alias("slots"))
        return rows.join(count, "grp").withColumn(name, F.pmod(F.xxhash64("doc_id", "h"), F.col("slots"))).drop("slots")

    heads = parted().groupBy("grp", "block", "part").agg(F.min(F.struct("doc_id", "h", "text")).alias("one"))
    links = add(slots(heads.select("grp", "one.*"), "block"))
    current = parted()
    sizes = current.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("grp").agg(F.max(F.struct("size", "part")).alias("top"), F.count(F.lit(1)).alias("parts"))
    unlinked = current.join(largest, "grp").where("parts > 1")
    left = unlinked.where("part <> top.part")
    if left.head(1):
        left = slots(left.select("grp", "doc_id", "h", "text"), "slot")
        pairs = texts.select("grp", "block").distinct().join(left.select("grp", "slot").distinct(), "grp")
        both = F.xxhash64("block", "slot").alias("block")
        one = unlinked.select("grp", "block", "doc_id", "h", "text").join(pairs, ["grp", "block"])
        two = left.join(pairs, ["grp", "slot"])
        rows = [x.select("grp", both, "doc_id", "h", "text") for x in (one, two)]
        links = add(rows[0].unionByName(rows[1]).dropDuplicates(["grp", "block", "doc_id", "h"]))
    return links
