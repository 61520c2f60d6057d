"""N-gram Jaccard join: size-aware, heavy-light.

A document's set holds the hashes of its distinct word n-grams; equal sets
collapse to one node. Pairs of nodes with Jaccard similarity of at least
``percent`` / 100 are linked:

* Light (small) sets enumerate subsets of a fixed size: for sizes a <= b the
  least overlap c of a linked pair is known, so both sides emit all their
  c-subsets under the key (a, b, subset). Linked sets share such a key; sets
  of the larger size alone may share one too, so overlaps are still counted.
* Heavy (large) sets are cut into k segments by hash. A linked pair differs in
  H elements at most, so of k > H + 1 segments two at least are equal; each
  segment's contents key an inverted list. Empty segments, which a part of all
  sets shares, do so only for sets that may have no other in common with one
  they are linked with, and k is such that these are few. The lists are scanned: members meet
  under the list's smallest node (its hub) once, however many lists they
  share, in blocks of bounded size. Parity sketches, which can only
  underestimate how many elements differ, sort out pairs that can have no link
  there. Each member is compared exactly with its leader, the smallest member
  it may link with; then members that may link with one of another component
  are grouped by those possible links alone, not by the hubs they met under,
  and each group is compared exactly in blocks, so no link between components
  is lost.
* The boundary is the size at which the emitted subsets would outnumber what
  the inverted lists cost, summed over the corpus's own size histogram.

Blocks return a spanning forest of the links they find, never all pairs, and
components come from repeated minimum labels over those edges.

Words are hashed by XXH3 of their bytes, n-grams by mixing those, sets by XXH64
of their n-grams; all have 64 bits, so two different n-grams or sets are taken
for equal with a chance of about 5e-20 a pair.

Cases: null, empty or blank text has the empty set, links with nothing and is
its own component; repeated rows share a node; a null ``doc_id`` takes part
and counts last when the smallest id of a component is sought, so it gets the
smallest known id, or null if there is none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrlens.llm.common import SPACES, identity, pack, small_batches, stored, unpack

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Join:
    """``n``: words of a shingle. ``percent``: least Jaccard similarity.
    ``block``, ``block_shingles``: nodes, and their elements, that one task
    compares with as many others; ``sketch_block``: the same for sketches.
    ``max_light``: largest boundary considered. ``probe``: what one entry of an
    inverted list costs, in emitted subsets (it is also verified)."""

    n: int = 3
    percent: int = 90
    block: int = 512
    block_shingles: int = 200_000
    sketch_block: int = 4096
    max_light: int = 60
    probe: float = 2.0


# --- sets -------------------------------------------------------------------


MULTIPLIER = 0x9E3779B97F4A7C15
BLOCK = 1 << 20  # bytes worked on at a time


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, one after another, and each text's
    number of words. A hash is XXH3 of the word's bytes, made once a word."""
    split = [t.split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    if not count.sum():
        return np.empty(0, np.uint64), count
    codes, words = pd.factorize(np.array([x for w in split for x in w], dtype=object))
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[codes], count


def shingle_sets(texts: Iterable[str | None], n: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-grams, ASCII letters
    lowered; of the whole word sequence where it is shorter; none without
    words."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):  # texts of a block or so together
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < BLOCK):
            size += len(raw[end]) + 1
            end += 1
        group = raw[at:end]
        hashes, count = word_hashes([x.translate(LOWER) for x in group])
        first = np.cumsum(count) - count

        def grams(k: int, h: np.ndarray = hashes) -> np.ndarray:
            acc = np.full(max(0, len(h) - k + 1), k, np.uint64)
            for i in range(k):
                acc = _mix(acc * np.uint64(MULTIPLIER) + h[i : i + len(acc)])
            return acc

        by_size = {k: grams(k) for k in {min(n, int(c)) for c in count} if k}
        for f, c in zip(first.tolist(), count.tolist()):
            k = min(n, c)
            if not k:
                out.append(np.empty(0, np.uint64))
                continue
            s = np.sort(by_size[k][f : f + c - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        at = end
    return out


def _node(s: np.ndarray) -> int:
    """The id of a set: a hash of its contents."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes()))))


# --- bounds -----------------------------------------------------------------


def least_overlap(a: int, b: int, percent: int) -> int:
    """Least common elements of linked sets of a and b elements."""
    return -(-percent * (a + b) // (100 + percent))


def partners(a: int, percent: int) -> range:
    """Sizes b >= a that a set of a elements may be linked with."""
    return range(a, 100 * a // percent + 1)


@lru_cache(1000)
def light_keys(a: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) under which a set of a elements
    enumerates subsets; equal sets are one node already."""
    out = [(a, b, least_overlap(a, b, percent)) for b in partners(a, percent)]
    b = a - 1
    while b > 0 and a in partners(b, percent):
        out.append((b, a, least_overlap(b, a, percent)))
        b -= 1
    return [(x, y, c) for x, y, c in out if c <= x and not (x == y == c)]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(min(k, n - k)):
        out = out * (n - i) // (i + 1)
    return out


def light_cost(a: int, percent: int) -> int:
    return sum(_choose(a, c) for _, _, c in light_keys(a, percent))


@lru_cache(100_000)
def buckets(a: int, percent: int) -> list[tuple[int, int, int]]:
    """The two size buckets (number, segments, how many of these are equal at
    least in a linked pair) in which a set of a elements keeps inverted lists:
    its own, and the one below, whose sets it may extend."""

    def differ(x: int, y: int) -> int:
        return (100 - percent) * (x + y) // (100 + percent)

    lo, i = 1, 0
    below = None
    while True:
        hi = max(lo + 1, -(-100 * lo // percent))  # sizes lo..hi-1
        k = differ(hi - 1, 100 * (hi - 1) // percent) + 2
        bare = k * exp(-(hi - 1) / k)  # empty segments, as expected
        k += ceil(bare + 2 * sqrt(bare))
        if a < hi:
            own = (i, k, k - differ(a, 100 * a // percent))
            return [own, (*below, below[1] - differ(a, lo - 1))] if below else [own]
        below, lo, i = (i, k), hi, i + 1


def heavy_cost(a: int, percent: int) -> int:
    return sum(k for _, k, _ in buckets(a, percent))


def boundary(histogram: dict[int, int], join: Join) -> int:
    """Largest size of a light set: the one of least total cost."""

    def cost(b: int) -> float:
        heavy_from = b * join.percent // 100  # light sets next to the boundary also meet heavy ones
        return sum(
            c * ((light_cost(a, join.percent) if a <= b else 0) + (join.probe * heavy_cost(a, join.percent) if a > heavy_from else 0))
            for a, c in histogram.items()
            if 0 < a <= join.max_light * 100 // join.percent + 1
        )

    return min(range(1, join.max_light + 1), key=lambda b: (cost(b), b))


# --- keys -------------------------------------------------------------------


def _subset_sums(s: np.ndarray, c: int) -> list[int]:
    """Sums (mod 2^64) of all subsets of c elements, by what each leaves out."""
    h = [int(x) for x in _mix(s)]
    total = sum(h)
    return [(total - sum(out)) & 0xFFFFFFFFFFFFFFFF for out in combinations(h, len(h) - c)]


def light_entries(s: np.ndarray, percent: int) -> list[int]:
    out = []
    for a, b, c in light_keys(len(s), percent):
        salt = (a << 20) + b
        out += [xxhash.xxh64_intdigest(x.to_bytes(8, "little"), salt) for x in _subset_sums(s, c)]
    return out


def heavy_entries(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which set) of all ``sets``: a key for each segment of each of a
    set's buckets, a hash of the segment's contents. Empty segments are keys
    only for sets that have as many as may be all that a linked pair shares:
    with fewer, one filled segment at least is equal."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    mixed = _mix(flat)
    own = [buckets(int(a), percent) for a in sizes]
    keys, which = [], []
    for j in (0, 1):
        # Sets without a second bucket have no segments in it.
        number = np.array([b[j][0] if j < len(b) else 0 for b in own], np.uint64)
        k = np.array([b[j][1] if j < len(b) else 0 for b in own])
        least = np.array([b[j][2] if j < len(b) else 0 for b in own])
        has = np.repeat(k > 0, sizes)
        first = np.cumsum(k) - k
        at = _mix(flat + np.repeat(number, sizes)) % np.maximum(np.repeat(k, sizes), 1).astype(np.uint64)
        place = (np.repeat(first, sizes) + at.astype(np.int64))[has]
        total = int(k.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, place, mixed[has])
        filled = np.bincount(place, minlength=total) > 0
        owner = np.repeat(np.arange(len(sets)), k)
        empty = np.bincount(owner[~filled], minlength=len(sets))
        use = filled | (empty >= least)[owner]
        salt = (number << np.uint64(32)) + np.uint64(1 << 60)
        within = (np.arange(total) - first[owner]).astype(np.uint64)
        keys.append(_mix(sums + _mix(salt[owner] + within))[use])
        which.append(owner[use])
    return np.concatenate(keys), np.concatenate(which)


# --- the join ---------------------------------------------------------------


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's elements by hash, in a power of two of bits, one
    an element at least. An element that two sets do not share turns one bit,
    so they differ in no fewer elements than their sketches in bits."""
    bits = 64
    while bits < len(s):
        bits *= 2
    odd = np.bincount((_mix(s) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(made: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest one's bits."""
    width = min(map(len, made)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0) for x in made])


def _able(
    sizes: np.ndarray, blocks: np.ndarray, sketches: list[bytes], lo: int, hi: int, percent: int, labels: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of the block ``lo`` that may be linked with some of ``hi``
    (of another label), and those."""
    words, two = _folded(sketches), np.flatnonzero(blocks == hi)
    for i in np.flatnonzero(blocks == lo):
        differ = np.bitwise_count(words[two] ^ words[i]).sum(axis=1, dtype=np.int64)
        able = (100 + percent) * differ <= (100 - percent) * (sizes[two] + sizes[i])
        able &= two != i
        if labels is not None:
            able &= labels[two] != labels[i]
        if able.any():
            yield i, two[able]


def _partners(nodes: np.ndarray, links: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Which members may be linked with another, and the smallest such partner
    of each."""
    out, best = np.zeros(len(nodes), bool), np.full(len(nodes), np.iinfo(np.int64).max)
    for i, with_i in links:
        out[with_i] = out[i] = True
        best[with_i] = np.minimum(best[with_i], nodes[i])
        best[i] = min(best[i], nodes[with_i].min())
    return out, best


def _tree(nodes: np.ndarray, links: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links, each member's given together."""
    top, out = np.arange(len(nodes)), []
    for i, with_i in links:
        tops, first = np.unique(top[with_i], return_index=True)
        for t, j in zip(tops, with_i[first]):
            if t != top[i]:
                top[top == t] = top[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def with_node(docs: DataFrame, join: Join, text: str, carry: list[Column]) -> DataFrame:
    """``carry``, node (null for the empty set), n_shingles, sketch."""

    @F.pandas_udf("node long, n_shingles long, sketch binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = shingle_sets(texts, join.n)
        nodes = pd.array([_node(s) if len(s) else None for s in sets], "Int64")
        return pd.DataFrame({"node": nodes, "n_shingles": [len(s) for s in sets], "sketch": [sketch(s) for s in sets]})

    return docs.select(*carry, run(F.col(text)).alias("s")).select("*", "s.node", "s.n_shingles", "s.sketch").drop("s")


def keyed(docs: DataFrame, join: Join, light: int, text: str) -> DataFrame:
    """key, node: the entries of every set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        heavy_from = light * join.percent // 100
        for b in batches:
            fresh = {}
            for s in shingle_sets(b["text"], join.n):
                node = _node(s) if len(s) else None
                if node is not None and node not in done:
                    fresh[node] = s
            if len(done) < 200_000:  # copies met again in this task
                done.update(fresh)
            small = [(node, light_entries(s, join.percent)) for node, s in fresh.items() if len(s) <= light]
            keys = [np.array([k for _, made in small for k in made], np.uint64)]
            nodes = [np.repeat(np.array([n for n, _ in small], np.int64), [len(made) for _, made in small])]
            large = {node: s for node, s in fresh.items() if len(s) > heavy_from}
            if large:
                made, which = heavy_entries(list(large.values()), join.percent)
                keys.append(made)
                nodes.append(np.array(list(large), np.int64)[which])
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes)})

    return docs.select(F.col(text).alias("text")).mapInPandas(run, "key long, node long")


def _linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``a`` are linked with which of ``b``, by exact overlaps."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    overlap = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), 4096):  # so many columns of the incidence matrices at a time
        part = both[lo : lo + 4096]

        def incidence(flat: np.ndarray, rows: np.ndarray, n: int, part: np.ndarray = part) -> np.ndarray:
            col = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[col] == flat
            m = np.zeros((n, len(part)), np.float32)
            m[rows[hit], col[hit]] = 1
            return m

        overlap += incidence(fa, ra, len(a)) @ incidence(fb, rb, len(b)).T
    o = overlap.astype(np.int64)
    return 100 * o >= percent * (na[:, None] + nb[None, :] - o)


def _forest(nodes: np.ndarray, links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join what earlier ones have not."""
    up = np.arange(len(nodes))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in links:
        x, y = top(i), top(j)
        if x != y:
            up[y] = x
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _edges(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], lo: int, hi: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between blocks ``lo`` and ``hi``."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        linked = 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)
        return [(int(nodes[0]), int(nodes[1]))] if linked else []
    one, two = np.flatnonzero(blocks == lo), np.flatnonzero(blocks == hi)
    if not len(one) or not len(two):
        return []
    hit = _linked([sets[i] for i in one], [sets[i] for i in two], percent)
    return _forest(nodes, ((one[i], two[j]) for i, j in np.argwhere(hit)))


def _by_pair(members: DataFrame, values: list[str], made: Callable, shape: str) -> DataFrame:
    """``made(key, rows)`` of the rows of each pair of blocks (hub, lo, hi):
    they come together, sorted, and one pair is held at a time."""
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for b in batches:
            for hub, lo, hi, *row in zip(b["hub"], b["lo"], b["hi"], *[b[v] for v in values]):
                if key != (hub, lo, hi):
                    out += made(key, held) if len(held) > 1 else []
                    key, held = (hub, lo, hi), []
                held.append(row)
            yield pd.DataFrame(out, columns=names, dtype="int64")
            out = []
        out += made(key, held) if len(held) > 1 else []
        yield pd.DataFrame(out, columns=names, dtype="int64")

    pairs = members.repartition("hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi")
    return pairs.select("hub", "lo", "hi", *values).mapInPandas(run, shape)


def able(members: DataFrame, join: Join) -> DataFrame:
    """hub, node, leader: members that may be linked with another of their
    hub, and the smallest of those (each pair of blocks has its own)."""

    def made(key: tuple, rows: list) -> list[tuple[int, int, int]]:
        node, block, size, sketches = zip(*rows)
        may, best = _partners(np.array(node), _able(np.array(size), np.array(block), list(sketches), key[1], key[2], join.percent))
        return [(key[0], node[i], best[i]) for i in np.flatnonzero(may)]

    return _by_pair(members, ["node", "block", "n", "sketch"], made, "hub long, node long, leader long")


def apart(members: DataFrame, join: Join) -> DataFrame:
    """a, b: for each pair of blocks, edges of a spanning forest of the links
    that there may be between members of other ``label``."""

    def made(key: tuple, rows: list) -> list[tuple[int, int]]:
        node, block, size, label, sketches = zip(*rows)
        return _tree(np.array(node), _able(np.array(size), np.array(block), list(sketches), key[1], key[2], join.percent, np.array(label)))

    return _by_pair(members, ["node", "block", "n", "label", "sketch"], made, "a long, b long")


def stars(leaders: DataFrame, join: Join) -> DataFrame:
    """hub, node, lo, hi: each node (node, leader, n) beside its leader, the
    members of a leader dealt over parts that each get the leader too."""
    parts = F.greatest(F.ceil(F.count("*") / join.block), F.ceil(F.sum("n") / join.block_shingles))
    counts = leaders.groupBy(F.col("leader").alias("hub")).agg(parts.alias("parts"))
    members = leaders.withColumnRenamed("leader", "hub").join(counts, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), "parts").alias("lo"))
    heads = counts.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("lo"))
    return members.unionByName(heads).withColumn("hi", F.col("lo"))


def led(members: DataFrame, join: Join) -> DataFrame:
    """a, b: the links between a star's leader and its members."""

    def made(key: tuple, rows: list) -> list[tuple[int, int]]:
        sets = {node: np.asarray(x, np.int64) for node, x in rows}
        lead = sets.pop(key[0])
        out = []
        for node, other in sets.items():
            both = len(np.intersect1d(lead, other, assume_unique=True))
            if 100 * both >= join.percent * (len(lead) + len(other) - both):
                out.append((key[0], node))
        return out

    return _by_pair(members, ["node", "shingles"], made, "a long, b long")


def verified(members: DataFrame, join: Join) -> DataFrame:
    """a, b: edges of a spanning forest for each pair of blocks."""

    def made(key: tuple, rows: list) -> list[tuple[int, int]]:
        node, block, shingles = zip(*rows)
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in shingles]
        return _edges(np.array(node), np.array(block), sets, key[1], key[2], join.percent)

    return _by_pair(members, ["node", "block", "shingles"], made, "a long, b long")


def in_blocks(near: DataFrame, needed: Column) -> DataFrame:
    """``near`` (hub, node, ...) with each hub's members dealt over ``needed``
    blocks: a row for every pair (lo, hi) of blocks that its ``block`` is of.
    Spark takes these for no more rows than ``near`` has, so the hint keeps
    them from being gathered in the driver for a broadcast."""
    counts = near.groupBy("hub").agg(needed.alias("blocks"))
    near = near.join(counts, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return near.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other").hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it is linked to, over any number
    of links). Each round points every node of an edge to the smallest
    neighbour's label and follows labels of labels; rounds are written to the
    shared folder, and end when nothing changes."""
    both = stored(edges.union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A node's old label learns what the node has learnt, then all follow their label's label.
        told = step.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("told"))
        step = step.join(told, "node", "left").select("node", "old", F.least("label", F.coalesce("told", "label")).alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = stored(
            step.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels"
        )
        moved = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels


def components_of(docs: DataFrame, join: Join, text: str, doc_id: str, carry: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, ``carry``, node, n_shingles for each row of
    ``docs``; node, label for each node, nodes of one component sharing a
    label."""
    small_batches(docs.sparkSession)
    rows = stored(with_node(docs, join, text, [F.col(doc_id).cast("long").alias("doc_id"), *carry]), "nodes")
    sizes = rows.where("node is not null").groupBy("n_shingles").count()
    # One row for each size up to the largest boundary: a bounded histogram.
    histogram = {r[0]: r[1] for r in sizes.where(F.col("n_shingles") <= 2 * join.max_light).collect()}
    light = boundary(histogram, join)

    # Each list is read once, sorted by key: its smallest node, and whether there is another.
    of_list = Window.partitionBy("key")
    lists = keyed(docs, join, light, text).select("key", "node", F.min("node").over(of_list).alias("hub"), F.max("node").over(of_list).alias("last"))
    near = stored(lists.where("hub < last").select("hub", "node").distinct(), "members")

    # Members of each hub in blocks, and the pairs of blocks that a task compares.
    met = rows.join(near.select("node").distinct(), "node", "left_semi")
    met = met.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    met = stored(met, "met")
    by_count, by_sketch = F.ceil(F.count("*") / join.block), F.ceil(F.count("*") / join.sketch_block)
    near = stored(able(in_blocks(near, by_sketch).join(met.drop("id"), "node"), join), "able")
    near = stored(near.groupBy("hub", "node").agg(F.min("leader").alias("leader")), "leaders")
    leaders = near.groupBy("node").agg(F.min("leader").alias("leader"))
    chosen = stored(met.join(leaders, "node").select("node", "id", "n", "leader"), "chosen")

    # Each member is compared with its leader first; near copies are one star.
    pairs = stars(chosen.select("node", "leader", "n"), join)
    edges = stored(led(pairs.join(shingles_of(docs, chosen, join, text, doc_id), "node"), join), "links")
    labels = components(edges)

    # What may still link two components: in blocks, all that a chain of such links joins as one.
    rest = near.select("hub", "node").join(met.drop("id"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = stored(apart(in_blocks(rest, by_sketch), join), "apart")
    if rest.limit(1).count():
        groups = components(rest).select(F.col("label").alias("hub"), "node")
        rest = stored(groups.join(chosen.select("node", "n"), "node"), "rest")
        pairs = in_blocks(rest, F.greatest(by_count, F.ceil(F.sum("n") / join.block_shingles))).select("hub", "node", "block", "lo", "hi")
        wanted = chosen.join(rest.select("node"), "node", "left_semi")
        more = stored(verified(pairs.join(shingles_of(docs, wanted, join, text, doc_id), "node"), join), "links")
        labels = components(edges.unionByName(more))
    nodes = rows.where("node is not null").select("node").distinct().join(labels, "node", "left")
    return rows, nodes.select("node", F.coalesce("label", "node").alias("label"))


def join_components(docs: DataFrame, join: Join = Join(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    rows, nodes = components_of(docs, join, text, doc_id, [])
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    least = stored(least.join(nodes, "node"), "least")
    found = least.join(least.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("node", "component_id")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.drop("sketch").join(found, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join(5, 80), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id
    (null last, then by a hash of the row). Rows with the empty set all stay."""
    key = identity(docs)
    rows, nodes = components_of(docs, join, text, doc_id, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first")
    linked = rows.where("node is not null")
    firsts = linked.groupBy("node").agg(first).join(nodes, "node").groupBy("label").agg(F.min("first").alias("first"))
    stay = firsts.select("first.h1", "first.h2").union(rows.where("node is null").select("h1", "h2"))
    blank = (F.length(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")) == 0).alias("blank")
    kept = docs.select(*key, blank, pack(docs.columns)).join(stay.distinct(), ["h1", "h2"], "left_semi")
    kept = kept.where("not blank").dropDuplicates(["h1", "h2"]).unionByName(kept.where("blank"))
    return kept.select(*unpack(docs.columns))


def shingles_of(docs: DataFrame, chosen: DataFrame, join: Join, text: str, doc_id: str) -> DataFrame:
    """node, shingles: the sets of the chosen nodes, built from the text of one
    document of each (of all whose id is null)."""
    ids = chosen.select(F.col("id").alias("wanted")).distinct()
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    d = d.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [s for s in shingle_sets(b["text"], join.n) if len(s)]
            yield pd.DataFrame({"node": np.array([_node(s) for s in sets], np.int64), "shingles": [s.view(np.int64) for s in sets]})

    made = d.mapInPandas(run, "node long, shingles array<long>").join(chosen.select("node"), "node", "left_semi")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))
