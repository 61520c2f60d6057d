"""The prefix trie of conversations, from their sorted order.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that start with it.

Method: equal conversations become one path with a count. Paths (16 digest
bytes a turn) are sorted over all tasks and cut into blocks of neighbours; a
block also gets the last path before it and the first after it, so each
adjacent common prefix (LCP, in turns) is that of the whole order. Per block,
a sparse table over the LCPs answers range minima. Each candidate prefix, a
path with a depth, binary-searches how far its interval goes to the left and
to the right, independently of all others; it is a node where it goes nowhere
to the left. Counts, children, leaves and saved text are differences of prefix
sums over the interval, the smallest member is a range minimum over a second
table. A node whose interval leaves its block has a part in each block; parts
are added up by the node's digest. At most two paths' depths a block are such
parts, so a root with all conversations, or a first turn of a third of them,
is a few numbers a block.

``ends_sha256`` needs the ids that end at a node as one ordered text. Ids are
sorted by (node, id) over all tasks, joined to pieces of ``PIECE`` ids where
they lie, and the pieces are hashed one after another, so no task holds a
node's ids at once.

Cases: null role or text is empty; a null turn comes first; rows of one
conversation with equal turns are ordered by their digest; repeated rows are
turns of their own; rows without a conv_id belong to no conversation. A
conversation without turns (after ``rebuilt``) is a member of the root. An
empty table has no root: no rows. A conversation is a unit: its digests (24
bytes a turn) fit a task. Turns are equal where 128 bits of the SHA-256 of
role and text are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrlens.llm.common import stored

#: Turns of a block, about; ids of a piece.
BLOCK_TURNS = 400_000
PIECE = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
DIGEST = 16

TURNS = "array<struct<digest:binary,chars:long>>"
BLOCK = "block long, paths binary, sizes array<int>, chars array<long>, members array<long>, least array<long>, ends array<string>, first binary, last binary"
NODE = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, open boolean, parent_open boolean"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ``turns`` in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.struct("turn", F.unhex(F.substring(whole, 1, 2 * DIGEST)).alias("digest"), F.length(text).cast("long").alias("chars")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["chars"])).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c %
    ``group`` and then its own after its first h; h = crc32(c) % ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.where(F.col("conv_id") == base).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    own = convs.withColumn("_base", base).join(heads, "_base", "left")
    head = F.when(F.col("_head").isNull() | (h == 0), F.array().cast(TURNS)).otherwise(F.slice("_head", F.lit(1), F.greatest(h, F.lit(1))))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.select("conv_id", F.concat(head, tail).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """path -> SHA-256 of its members' ids, ascending, joined by commas."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, ids, done = None, [], []
        for frame in frames:
            for p, c in zip(frame["path"], frame["conv_id"].tolist(), strict=True):
                if ids and (p != path or len(ids) == PIECE):
                    done.append((path, ids[0], ",".join(map(str, ids))))
                    ids = []
                path = p
                ids.append(c)
            yield pd.DataFrame(done, columns=["path", "first", "ids"])
            done = []
        if ids:
            yield pd.DataFrame([(path, ids[0], ",".join(map(str, ids)))], columns=["path", "first", "ids"])

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, state = None, None
        for frame in frames:
            done = []
            for p, x in zip(frame["path"], frame["ids"], strict=True):
                if p == path:
                    state.update(b",")
                else:
                    done += [(path, state.hexdigest())] if state else []
                    path, state = p, hashlib.sha256()
                state.update(x.encode())
            yield pd.DataFrame(done, columns=["path", "ends"])
        if state:
            yield pd.DataFrame([(path, state.hexdigest())], columns=["path", "ends"])

    ids = members.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = ids.mapInPandas(pieces, "path binary, first long, ids string")
    return parts.repartition("path").sortWithinPartitions("path", "first").mapInPandas(hashed, "path binary, ends string")


def _paths(convs: DataFrame) -> DataFrame:
    """Distinct paths with their characters a turn, number of members,
    smallest member and the digest of their members."""
    joined = F.concat_ws("", F.transform("turns", lambda t: F.hex(t["digest"])))
    c = convs.select("conv_id", F.unhex(joined).alias("steps"), F.col("turns.chars").alias("chars"))
    c = c.withColumn("path", F.unhex(F.substring(F.sha2("steps", 256), 1, 2 * DIGEST)))
    c = stored(c, "conversations")
    each = c.groupBy("path").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("least"), F.min(F.struct("steps", "chars")).alias("_p")
    )
    return each.join(_ends(c.select("path", "conv_id")), "path").select("_p.steps", "_p.chars", "members", "least", "ends")


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition of sorted paths as one block, or as more if it is long."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def made(rows: list) -> pd.DataFrame:
        steps = [r[0] for r in rows]
        flat = [n for r in rows for n in r[1]]
        sizes = [len(x) // DIGEST for x in steps]
        row = [number, b"".join(steps), sizes, flat, [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], steps[0], steps[-1]]
        return pd.DataFrame([row], columns=["block", "paths", "sizes", "chars", "members", "least", "ends", "first", "last"])

    held, n = [], 0
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            held.append(row)
            n += 1 + len(row[1])
            if n >= BLOCK_TURNS:
                yield made(held)
                held, n, number = [], 0, number + 1
    if held:
        yield made(held)


def _lcp(steps: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common turns of each path with the one before it (the first: none)."""
    common = np.minimum(sizes[1:], sizes[:-1])
    begin = np.concatenate([[0], np.cumsum(common)])
    inner = np.arange(begin[-1]) - np.repeat(begin[:-1], common)
    one, two = np.repeat(at[:-1], common) + inner, np.repeat(at[1:], common) + inner
    differ = (steps[one] != steps[two]).any(axis=1)
    # the first place that differs, of each pair; its end if none does
    places = np.append(np.flatnonzero(differ), begin[-1])
    first = np.minimum(places[np.searchsorted(places, begin[:-1])], begin[1:])
    return np.concatenate([[0], first - begin[:-1]])


def _table(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table of range minima."""
    out, width = [values], 1
    while 2 * width <= len(values):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def _minimum(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima over a..b, both included."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level):
        mine = level == k
        out[mine] = np.minimum(table[k][a[mine]], table[k][b[mine] - (1 << int(k)) + 1])
    return out


def _reach(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """How many values after each place are at least ``depth`` in a row."""
    n, out = len(table[0]), np.zeros(len(at), np.int64)
    for k in range(len(table) - 1, -1, -1):
        start = at + out
        fits = start + (1 << k) <= n
        fits &= table[k][np.minimum(start, n - (1 << k))] >= depth
        out[fits] += 1 << k
    return out


def _nodes(row: pd.Series, before: bytes | None, after: bytes | None) -> pd.DataFrame:
    """The nodes of one block, and its parts of nodes that leave it."""
    sizes = np.asarray(row["sizes"], np.int64)
    own = len(sizes)
    # the neighbours take part in comparisons only
    blob = (before or b"") + row["paths"] + (after or b"")
    sizes_all = np.concatenate([[len(before or b"") // DIGEST], sizes, [len(after or b"") // DIGEST]])
    steps = np.frombuffer(blob, np.dtype(">u8")).reshape(-1, 2)
    at = np.concatenate([[0], np.cumsum(sizes_all)])[:-1]
    lcp = _lcp(steps, at, sizes_all)[1:]  # of own paths with the one before, then of the next block's first
    lcp[0] = lcp[0] if before is not None else -1
    lcp[own] = lcp[own] if after is not None else -1
    down, up = _table(lcp[1:]), _table(lcp[::-1][1:])
    chars = np.asarray(row["chars"], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([[0], np.cumsum(chars)])  # characters before a turn, in the block
    members = np.asarray(row["members"], np.int64)
    least = _table(np.asarray(row["least"], np.int64))
    text = total[begin[1:]] - total[begin[:-1]]
    leaf = lcp[1:] < sizes  # the next path does not extend it
    # Candidates: each path with each depth up to its size.
    path = np.repeat(np.arange(own), sizes + 1)
    depth = np.arange(len(path)) - np.repeat(begin[:-1] + np.arange(own), sizes + 1)
    left = path - np.minimum(_reach(up, own - 1 - path, depth), path)
    lead = left == path
    path, depth = path[lead], depth[lead]
    right = path + np.minimum(_reach(down, path, depth), own - 1 - path)
    leaves_left = lcp[path] >= depth  # goes on in the block before
    leaves_right = (right == own - 1) & (lcp[own] >= depth)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    upto = lambda s: s[right + 1] - s[path]
    # Text of all members from this depth on, and that of the distinct nodes:
    # a path owns its nodes deeper than its LCP.
    before_depth = np.maximum(depth - 1, 0)
    skipped = total[begin[path] + before_depth] - total[begin[path]]
    weight = upto(sums(members))
    distinct = np.maximum(lcp[:own], 0)
    owned = text - (total[begin[:-1] + distinct] - total[begin[:-1]])
    first = text[path] - np.where(leaves_left, total[begin[path] + distinct[path]] - total[begin[path]], skipped)
    saved = upto(sums(members * text)) - weight * skipped - (upto(sums(owned)) - owned[path] + first)
    # A child starts at a path after the first whose LCP is the depth, and at
    # the first where that is longer and the node starts there.
    order = np.lexsort((np.arange(own), lcp[:own]))
    key = lcp[:own][order] * (own + 1) + order
    children = np.searchsorted(key, depth * (own + 1) + right, side="right") - np.searchsorted(key, depth * (own + 1) + path, side="right")
    children += (sizes[path] > depth) & (~leaves_left | (lcp[path] == depth))
    data = {
        "depth": depth,
        "conv_id": _minimum(least, path, right),
        "n_convs": weight,
        "n_children": children,
        "n_leaves": upto(sums(leaf)),
        "saved_tokens": saved,
        "open": leaves_left | leaves_right,
    }
    # A path's own end is the node of its size; equal paths are one.
    ends = np.where((depth == sizes[path]), np.asarray(row["ends"], object)[path], NO_ENDS)
    # The parent leads at the path where the interval of depth - 1 starts.
    start = path - np.minimum(_reach(up, own - 1 - path, depth - 1), path)
    deep = int(sizes.max()) + 1
    parent = np.where(depth > 0, np.searchsorted(path * deep + depth, start * deep + depth - 1), -1)
    out = pd.DataFrame(data)
    digests = _digests(row["paths"], begin, path, depth, np.flatnonzero(data["open"]))
    out["node"] = digests
    out["parent"] = [digests[i] if i >= 0 else None for i in parent.tolist()]
    conv = out["conv_id"].to_numpy()
    out["parent_conv_id"] = pd.array(np.where(parent >= 0, conv[parent], 0), "Int64")
    out.loc[parent < 0, "parent_conv_id"] = pd.NA
    out["parent_open"] = np.where(parent >= 0, out["open"].to_numpy()[parent], False)
    out["ends_sha256"] = ends
    return out[[x.split()[0] for x in NODE.split(", ")]]


def _digests(paths: bytes, begin: np.ndarray, path: np.ndarray, depth: np.ndarray, which: np.ndarray) -> list:
    """Digests of the nodes ``which`` (by path, then depth); None for others."""
    out: list = [None] * len(path)
    at, done, state = -1, 0, None
    for i in which.tolist():
        p, d = int(path[i]), int(depth[i])
        if p != at:
            at, done, state = p, 0, hashlib.sha256()
        state.update(paths[(begin[p] + done) * DIGEST : (begin[p] + d) * DIGEST])
        done = d
        out[i] = state.digest()[:DIGEST] + d.to_bytes(4, "big")
    return out


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the conversations ``conv_id, turns``: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (repeats of turns below, in characters) and
    ends_sha256."""
    paths = _paths(convs)
    paths = stored(paths, "paths")
    turns = paths.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    parts = max(1, -(-turns // BLOCK_TURNS))
    cols = ["steps", "chars", "members", "least", "ends"]
    ordered = paths.select(cols).repartitionByRange(parts, "steps").sortWithinPartitions("steps")
    blocks = stored(ordered.mapInPandas(_pack, BLOCK), "blocks")
    side = Window.orderBy("block")  # a row a block: its two paths
    edges = blocks.select("block", F.lag("last").over(side).alias("before"), F.lead("first").over(side).alias("after"))

    def nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                yield _nodes(row, row["before"], row["after"])

    found = stored(blocks.join(edges, "block").mapInPandas(nodes, NODE), "nodes")
    same = ("node", "parent", "depth")
    whole = found.where("open").groupBy(*same).agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    whole = stored(whole, "open-nodes")  # at most two paths a block
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    numbers = ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    inside = found.where("not open and not parent_open").select("depth", "conv_id", "parent_conv_id", *numbers)
    below = found.where("not open and parent_open").select("parent", "depth", "conv_id", *numbers)
    rest = below.unionByName(whole.drop("node")).join(above, "parent", "left")
    return inside.unionByName(rest.select("depth", "conv_id", F.col("_above").alias("parent_conv_id"), *numbers))
