"""Exact top-k inner product search with ball trees, shard by shard.

Vectors are dealt over shards by place: cutting planes, taken from a bounded
sample, give cells, and a cell of more rows than a shard should hold is dealt
further by a hash. Each shard's vectors form a ball tree. A query descends a
tree best-first, by the upper bound of the inner product with any vector of a
node (q . centre + |q| * radius), and stops when no open node can beat its kth
score. Each query searches the shard of its own vector first; the kth score
found there goes with it, and it is sent only to those other shards whose own
ball can hold as good a score.

Scores are exact whole numbers: float64 where no sum can pass 2^53, int64 below
2^63, Python's integers beyond; a score that a long cannot hold counts as the
nearest long. Bounds carry a margin for rounding, and nodes whose bound equals
the kth score are still searched, since a tie goes to the smaller id.

Vectors go to a shard once, queries (a small share of the rows) to the shards
that they have to see. A task reads a shard's vectors, then its queries as they
come; it holds one shard and one batch of queries. The driver holds the sample
and a ball for each shard: 2 * ``most_shards`` of them at most, and one more
for each length of vectors.

Cases: vectors that are null, empty, or hold null or non-finite components
take no part; a null id takes no part; a query has as many rows as there are
candidates, k at most; vectors of differing lengths are compared with those of
their own length only; equal vectors tie by id, and a repeated row is a
candidate of its own, but rows with a query's id are its own and not candidates.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrlens.llm.common import small_batches, stored

MARGIN = 1e-9
LEAST, MOST = -(2**63), 2**63 - 1  # of a long


@dataclass(frozen=True)
class Search:
    """``shard_rows``: vectors per shard, about. ``most_shards``: beyond that
    many, shards grow. ``sample_rows``: vectors that the cutting planes are
    taken from, at most. ``block``: rows that a task takes in at a time.
    ``leaf``: vectors of a tree's leaf."""

    k: int = 5
    shard_rows: int = 8192
    most_shards: int = 4096
    sample_rows: int = 20_000
    block: int = 2048
    leaf: int = 64


class BallTree:
    """A tree over the rows of ``x``: nodes in a list, children of node i in
    ``kids[i]``, a leaf's rows ``order[lo:hi]``."""

    def __init__(self, exact: np.ndarray, leaf: int):
        x = exact.astype(np.float64)
        order = np.arange(len(x))
        self.centre, self.radius, self.span, self.kids = [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            lo, hi, up = todo.pop()
            rows = x[order[lo:hi]]
            c = rows.mean(axis=0)
            far = np.sqrt(((rows - c) ** 2).sum(axis=1))
            node = len(self.centre)
            self.centre.append(c)
            self.radius.append(float(far.max()))
            self.span.append((lo, hi))
            self.kids.append([])
            if up >= 0:
                self.kids[up].append(node)
            if hi - lo > leaf and self.radius[-1] > 0:
                order[lo:hi] = order[lo:hi][np.argsort(rows @ _across(rows, far), kind="stable")]
                mid = (lo + hi) // 2
                todo += [(lo, mid, node), (mid, hi, node)]
        self.order = order
        self.centre = np.array(self.centre)
        self.radius = np.array(self.radius)
        self.exact, self.sorted = exact[order], x[order]
        self.largest = float(np.abs(x).max())
        self.leaves = 0  # visited so far

    def _scores(self, q: np.ndarray, lo: int, hi: int) -> np.ndarray:
        top = self.largest * float(np.abs(q.astype(np.float64)).max()) * len(q)
        if top < 2**53:
            return (self.sorted[lo:hi] @ q.astype(np.float64)).astype(np.int64)
        if top < 2**62:
            return self.exact[lo:hi] @ q
        scores = self.exact[lo:hi].astype(object) @ q.astype(object)
        return np.array([min(max(x, LEAST), MOST) for x in scores], dtype=np.int64)

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, known: int) -> list[tuple[int, int]]:
        """(score, id) of the best k rows whose score is at least ``known``."""
        bound = upper(q.astype(np.float64), self.centre, self.radius)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        kth = known
        open_ = [(-float(bound[0]), 0)]
        while open_:
            least, node = heapq.heappop(open_)
            if -least < kth:
                break
            if self.kids[node]:
                for c in self.kids[node]:
                    if float(bound[c]) >= kth:
                        heapq.heappush(open_, (-float(bound[c]), c))
                continue
            self.leaves += 1
            lo, hi = self.span[node]
            scores = self._scores(q, lo, hi)
            for j in np.flatnonzero(scores >= kth):
                key = int(ids[self.order[lo + j]])
                if key == own:
                    continue
                one = (int(scores[j]), -key)
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -i) for s, i in best]


def upper(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """At least the inner product of ``q`` with any vector of each ball."""
    norm = float(np.sqrt(q @ q))
    reach = np.sqrt((centre**2).sum(axis=1)) + radius
    return np.maximum(centre @ q + norm * radius + MARGIN * (norm * reach + 1), float(LEAST))


def _across(rows: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The direction between two rows far apart, given distances to the mean."""
    a = rows[far.argmax()]
    return rows[((rows - a) ** 2).sum(axis=1).argmax()] - a


def planes(x: np.ndarray, cells: int) -> list[tuple[np.ndarray, float] | None]:
    """Cutting planes (direction, place) as a heap: node i has 2i+1 below its
    plane and 2i+2 above; None where a cell is whole."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    out: list[tuple[np.ndarray, float] | None] = [None] * (2**depth - 1)
    held = {0: x}
    for i in range(len(out)):
        rows = held.pop(i, None)
        if rows is None or len(rows) < 2:
            continue
        across = _across(rows, ((rows - rows.mean(axis=0)) ** 2).sum(axis=1))
        side = rows @ across
        cut = float(np.median(side))
        if side.max() > cut:
            out[i] = (across, cut)
            held[2 * i + 1], held[2 * i + 2] = rows[side <= cut], rows[side > cut]
    return out


def cell_of(x: np.ndarray, cuts: list[tuple[np.ndarray, float] | None]) -> np.ndarray:
    """The node in which each row of ``x`` ends."""
    at = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        at[rows] = node
        if node < len(cuts) and cuts[node] and len(rows):
            above = x[rows] @ cuts[node][0] > cuts[node][1]
            todo += [(2 * node + 1, rows[~above]), (2 * node + 2, rows[above])]
    return at


def scaled(embedding: Column) -> Column:
    """floor(256 * x) of each component as a long array; null where a
    component is null or not finite."""
    d = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(F.size(embedding) > 0, F.lit(False)) & ~bad, F.transform(d, lambda x: F.floor(x * 256).cast("long")))


FOUND = "query_id long, vec_id long, score long, dim int, shard string, centre array<double>, radius double"


def _searched(queries: DataFrame, dealt: DataFrame, spec: Search, balls: bool) -> DataFrame:
    """The best of each shard for the queries (dim, shard, query_id, v, known)
    sent to it; with ``balls`` also a row per shard: its centre and radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, ids, tree = None, [], [], None
        for b in batches:
            out = []
            same = (b["dim"] == b["dim"].shift()) & (b["shard"] == b["shard"].shift()) & (b["asks"] == b["asks"].shift())
            for _, g in b.groupby((~same).cumsum(), sort=False):
                here = (int(g["dim"].iloc[0]), g["shard"].iloc[0])
                if here != place:
                    if balls and held:
                        tree = tree or BallTree(np.concatenate(held), spec.leaf)
                        out.append((None, None, None, *place, tree.centre[0], tree.radius[0]))
                    place, held, ids, tree = here, [], [], None
                if not g["asks"].iloc[0]:
                    held.append(np.stack(g["v"].to_numpy()).astype(np.int64))
                    ids.append(g["vec_id"].to_numpy())
                    continue
                if not held:
                    continue
                if tree is None:
                    tree, ids = BallTree(np.concatenate(held), spec.leaf), [np.concatenate(ids)]
                for query, q, known in zip(g["vec_id"], g["v"], g["known"]):
                    for score, i in tree.search(np.asarray(q, np.int64), ids[0], int(query), spec.k, int(known)):
                        out.append((int(query), i, score, None, None, None, None))
            yield _frame(out)
        if balls and held:
            tree = tree or BallTree(np.concatenate(held), spec.leaf)
            yield _frame([(None, None, None, *place, tree.centre[0], tree.radius[0])])

    asked = queries.select("dim", "shard", F.lit(True).alias("asks"), F.col("query_id").alias("vec_id"), "v", "known")
    rows = dealt.select("dim", "shard", F.lit(False).alias("asks"), "vec_id", "v", F.lit(LEAST).cast("long").alias("known"))
    rows = rows.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    return rows.mapInPandas(run, FOUND)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["query_id", "vec_id", "score", "dim", "shard", "centre", "radius"]
    kinds = dict.fromkeys(names[:3], "Int64") | {"dim": "Int32", "shard": object, "centre": object, "radius": "Float64"}
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=kinds[c]) for i, c in enumerate(names)})


def _dealt(rows: DataFrame, n: int, spec: Search) -> DataFrame:
    """``rows`` with the shard of each: the cell it lies in, and a part of the
    cell where that holds more than a shard should."""
    limit = max(spec.shard_rows, -(-n // spec.most_shards))
    cells = -(-n // limit)
    if cells <= 1:
        return rows.withColumn("shard", F.lit("0"))
    # Smallest hashes of the vectors: the same sample in every run.
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").select("dim", "v").limit(spec.sample_rows).toPandas()
    cuts = {}
    for dim, g in sample.groupby("dim"):
        cuts[int(dim)] = planes(np.stack(g["v"].to_numpy()).astype(np.float64), -(-cells * len(g) // len(sample)))

    @F.pandas_udf("int")
    def cell(dim: pd.Series, v: pd.Series) -> pd.Series:
        out = pd.Series(0, index=dim.index, dtype="int32")
        for d, g in v.groupby(dim):
            out[g.index] = cell_of(np.stack(g.to_numpy()).astype(np.float64), cuts.get(int(d), []))
        return out

    rows = stored(rows.withColumn("cell", cell("dim", "v")), "cells")
    # At most most_shards cells hold more than the limit: a number each.
    large = rows.groupBy("dim", "cell").count().where(F.col("count") > limit)
    large = large.select("dim", "cell", F.ceil(F.col("count") / limit).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce(F.col("parts"), F.lit(1)))
    return rows.join(F.broadcast(large), ["dim", "cell"], "left").withColumn("shard", F.concat_ws(".", "cell", part)).drop("cell", "parts")


def _open_shards(balls: list[tuple]) -> Column:
    """The shards other than a query's own whose ball may hold a score of at
    least the one it knows."""
    by_dim = {}
    for dim, shard, centre, radius in balls:
        by_dim.setdefault(dim, []).append((shard, centre, radius))
    table = {d: (np.array([x[0] for x in b]), np.array([x[1] for x in b], dtype=np.float64), np.array([x[2] for x in b])) for d, b in by_dim.items()}

    @F.pandas_udf("array<string>")
    def run(dim: pd.Series, own: pd.Series, v: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for d, home, q, least in zip(dim, own, v, known):
            names, centre, radius = table[int(d)]
            bound = upper(np.asarray(q, np.float64), centre, radius)
            out.append([s for s, x in zip(names, bound) if float(x) >= int(least) and s != home])
        return pd.Series(out, dtype=object)

    return run("dim", "shard", "v", "known")


def top_k(vectors: DataFrame, is_query: Column, spec: Search = Search(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` for each of
    its rows that ``is_query`` holds for."""
    small_batches(vectors.sparkSession, spec.block)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("v is not null and vec_id is not null").withColumn("dim", F.size("v"))
    dealt = stored(_dealt(rows, rows.count(), spec), "vectors")
    # First each query in the shard of its own vector, then in all others that its kth score leaves open.
    first = dealt.where("asks").dropDuplicates(["vec_id", "v"]).withColumnRenamed("vec_id", "query_id")
    found = stored(_searched(first.withColumn("known", F.lit(LEAST).cast("long")), dealt, spec, True), "first")
    balls = [tuple(r) for r in found.where("query_id is null").select("dim", "shard", "centre", "radius").collect()]
    found = found.where("query_id is not null").select("query_id", "vec_id", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if len(balls) > 1:
        kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == spec.k).select("query_id", F.col("score").alias("known"))
        # An id that stands on several vectors knows nothing: each of them is a query.
        kth = kth.join(first.groupBy("query_id").count().where("count = 1"), "query_id", "left_semi")
        rest = first.join(kth, "query_id", "left").withColumn("known", F.coalesce("known", F.lit(LEAST).cast("long")))
        rest = rest.withColumn("shard", F.explode(_open_shards(balls)))
        found = found.unionByName(_searched(rest, dealt, spec, False).select("query_id", "vec_id", "score"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= spec.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
