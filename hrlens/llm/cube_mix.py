"""Mixing sources to target weights by cube-method balanced sampling.

Sources weigh in by a repeating pattern and share a multiple of the corpus's
words; no target may exceed a multiple of its source's size, and what that
cuts off goes to the others by weight. A document of a source with target /
size = r is taken floor(r) times for certain and once more with inclusion
probability r - floor(r). Those fractions are settled by the cube method: each
step moves the probabilities of three documents along the null space of the
balancing constraints (documents and words taken stay at their expectation)
until one of them is 0 or 1.

The flight runs in blocks of bounded size, a source dealt over many by a hash,
so a source may hold any share of the rows. Each block leaves two documents
undecided at most; these are gathered and flown again, block by block, until
a source has one block, whose two last documents are the landing problem:
the outcome nearest to the words still owed is taken.

Sources are ranked and their targets found by running sums over ranges, so
there may be as many of them as there are documents.

Draws are hashes of the document, so reruns agree.

Cases: null text has size 0, null source is a source of its own (last in the
order); a source without words has target 0 and its documents are not taken;
repeated rows are separate documents, taken together as often as their number
asks for and dealt out evenly; an empty table gives no rows; other
columns (of any name) pass through ``mixed``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrlens.llm.common import count_words, identity, pack, stored, unpack


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, null last.
    ``share``: words the mix takes, as a part of all. ``most``: largest target
    of a source, as a multiple of its size. ``block``: documents of one flight.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: Fraction = Fraction(3, 2)
    most: Fraction = Fraction(2)
    block: int = 20_000


def _unit(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers in [0, 1)."""
    return (h.view(np.uint64) >> np.uint64(11)) * 2.0**-53


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase over one block: probabilities with two fractions at most,
    balanced on the count and on the sizes."""
    eps = 1e-9
    x = p.astype(float).tolist()
    s = size.astype(float).tolist()
    open_: list[int] = []
    for i in range(len(x)):
        if eps < x[i] < 1 - eps:
            open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        # The null space of (1, 1, 1) and the sizes: sums of both stay as they are.
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - x[k]) / v if v > 0 else -x[k] / v for k, v in zip(open_, u) if v)
        down = min(x[k] / v if v > 0 else (x[k] - 1) / v for k, v in zip(open_, u) if v)
        move = up if draw[i] * (up + down) < down else -down
        for k, v in zip(open_, u):
            x[k] += move * v
        keep = [k for k in open_ if eps < x[k] < 1 - eps]
        if len(keep) == 3:  # rounding left the wall by a hair: the nearest one is it
            k = min(keep, key=lambda k: min(x[k], 1 - x[k]))
            x[k] = float(round(x[k]))
            keep.remove(k)
        for k in open_:
            if k not in keep:
                x[k] = float(round(x[k]))
        open_ = keep
    return np.clip(np.array(x, float), 0.0, 1.0)


def land(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Settle what a flight leaves: of all outcomes the one whose words come
    nearest to the expectation, then whose count does, then by the draw."""
    x = p.copy()
    left = np.flatnonzero((x > 1e-9) & (x < 1 - 1e-9))
    if len(left):
        owed, many = float((x[left] * size[left]).sum()), float(x[left].sum())

        def distance(bits: int) -> tuple[float, float, float]:
            chosen = np.array([(bits >> k) & 1 for k in range(len(left))])
            return (abs(float((chosen * size[left]).sum()) - owed), abs(float(chosen.sum()) - many), abs(float(draw[left[0]]) - bits / 2))

        best = min(range(1 << len(left)), key=distance)
        x[left] = [(best >> k) & 1 for k in range(len(left))]
    return np.round(x)


def _flown(rows: DataFrame, last: bool) -> DataFrame:
    """``rows`` after a flight by source and block, and a landing where the
    block is the source's last. Blocks come one after the other, large
    documents first: what is left for the landing is small."""

    def settle(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        size, draw, p = g["size"].to_numpy(), _unit(g["draw"].to_numpy()), g["p"].to_numpy().copy()
        for lo, hi in zip(starts, [*starts[1:], len(g)]):
            x = fly(p[lo:hi], size[lo:hi], draw[lo:hi])
            p[lo:hi] = land(x, size[lo:hi], draw[lo:hi]) if last else x
        return g.assign(p=p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            g = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(g):
                continue
            key = g[["place", "block"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            if len(starts) > 1:
                yield settle(g.iloc[: starts[-1]], starts[:-1])
            rest = g.iloc[starts[-1] :]
        if rest is not None:
            yield settle(rest, np.array([0]))

    dealt = rows.repartition("place", "block").sortWithinPartitions("place", "block", F.desc("size"), "h1", "h2")
    return dealt.mapInPandas(run, rows.schema)


def _in_parts(rows: DataFrame, name: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part`` and ``nth``, their place within the part; the parts'
    places): ``rows`` cut at quantiles of ``order``, so that a running sum
    needs one row of each part beside the part itself."""
    cut = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    return cut.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("decimal(38,0)")), cut.groupBy("part")


def _before(parts: DataFrame, sums: list[str]) -> DataFrame:
    """``sums`` of all parts before each: a row for each part, of which there
    are as many as shuffle partitions."""
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).cast("decimal(38,0)").alias(f"{x}_before") for x in sums])


def sources_of(sized: DataFrame, mix: Mix) -> DataFrame:
    """place, name, source_size, target, over, under of each source, in code
    point order, null last: over / under is target / source_size in whole
    numbers. ``sized``: source, size, rows.

    The weights share the total; whoever is above the cap stops there, and the
    excess is shared again by weight among the rest. In the order of size /
    weight those at the cap are the first ones, so running sums of sizes and
    weights find the last of them and the words a unit of weight gets."""
    whole = "decimal(38,0)"
    totals = stored(sized.groupBy(F.col("source").alias("name")).agg(F.sum(F.col("size") * F.col("rows")).cast(whole).alias("s")), "totals")
    ranked, parts = _in_parts(totals, "by_name", F.col("name").asc_nulls_last())
    counts = _before(parts.agg(F.count("*").cast(whole).alias("n")), ["n"])
    place = (F.col("n_before") + F.col("nth") - 1).cast("long")
    k = len(mix.weights)
    weight = F.get(F.lit(list(mix.weights)), F.pmod("place", F.lit(k)).cast("int")).cast(whole)
    lcm = math.lcm(*mix.weights)
    per = F.get(F.lit([lcm // w for w in mix.weights]), F.pmod("place", F.lit(k)).cast("int")).cast(whole)
    named = ranked.join(counts, "part").select("name", "s", place.alias("place"))
    named = named.select("*", weight.alias("w"), (F.col("s") * per).cast(whole).alias("ratio"))

    order = [F.col("ratio"), F.col("place")]
    cut, parts = _in_parts(named, "by_ratio", *order)
    sums = _before(parts.agg(F.sum("s").cast(whole).alias("s"), F.sum("w").cast(whole).alias("w")), ["s", "w"])
    earlier = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda x: (F.coalesce(F.sum(x).over(earlier), F.lit(0)) + F.col(f"{x}_before")).cast(whole)
    cut = cut.drop("nth").join(sums, "part").select("name", "place", "s", "w", "ratio", run("s").alias("s_run"), run("w").alias("w_run"))
    total, weights = cut.agg(F.sum("s"), F.sum("w")).first()
    a, b, c, d = *mix.share.as_integer_ratio(), *mix.most.as_integer_ratio()
    number = lambda n: F.lit(str(n)).cast(whole)
    # Words left to share times b * d, and whether the weight's part of them is below the cap.
    left = (number(a * d * int(total or 0)) - number(c * b) * F.col("s_run")).cast(whole)
    below = F.col("w") * left < number(c * b) * F.col("s") * (number(int(weights or 0)) - F.col("w_run"))
    first = cut.where(below).agg(F.min(F.struct("ratio", "place", "s_run", "w_run")).alias("x")).first()["x"]
    if first is None:  # all stop at their caps
        unit = Fraction(0)
        full = F.lit(True)
    else:
        unit = Fraction(a * d * int(total) - c * b * int(first["s_run"]), b * d * (int(weights) - int(first["w_run"])))
        full = F.struct("ratio", "place") < F.struct(number(first["ratio"]).alias("ratio"), F.lit(first["place"]).cast("long").alias("place"))
    shared = F.get(F.lit([float(w * unit) for w in mix.weights]), F.pmod("place", F.lit(k)).cast("int"))
    empty = F.col("s") == 0
    out = cut.select(
        F.col("place"),
        "name",
        F.col("s").cast("long").alias("source_size"),
        F.when(full, (F.col("s") * number(c)).cast("double") / F.lit(float(d))).otherwise(shared).alias("target"),
        F.when(empty, number(0)).when(full, number(c)).otherwise(F.col("w") * number(unit.numerator)).cast(whole).alias("over"),
        F.when(empty, number(1)).when(full, number(d)).otherwise(F.col("s") * number(unit.denominator)).cast(whole).alias("under"),
    )
    return stored(out, "sources")


def decided(docs: DataFrame, mix: Mix, text: str, source: str) -> DataFrame:
    """h1, h2, size, source_size, target, rows, copies: for all equal rows of
    ``docs`` together how many there are and how often the mix takes them.
    They are one unit of the flight."""
    sized = docs.select(*identity(docs), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size"))
    sized = sized.groupBy("h1", "h2").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("rows"))
    sized = stored(sized, "sized")
    # Spark sees the bytes of the stored table of sources before it joins it.
    known = sized.join(sources_of(sized, mix), F.col("source").eqNullSafe(F.col("name")))
    all_, under = F.col("rows") * F.col("over"), F.col("under")
    known = known.withColumn("whole", F.expr("(rows * over) div under"))
    known = known.withColumn("p", (all_ - F.col("whole") * under).cast("double") / under.cast("double"))
    known = known.select("place", "h1", "h2", "size", "rows", "source_size", "target", "whole", "p")
    draw = F.xxhash64("h1", "h2", F.lit("draw")).alias("draw")
    facts = ["place", "h1", "h2", "size", "rows", "source_size", "target", "whole", "p"]
    done = [known.where("p = 0")]  # no part in a flight
    rest, level = known.where("p > 0").select(*facts, draw), 0
    while True:
        counts = stored(rest.groupBy("place").agg(F.ceil(F.count("*") / mix.block).alias("blocks")), "blocks")
        most = counts.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        last = most == 1
        block = F.pmod(F.xxhash64("h1", "h2", F.lit(level)), F.col("blocks")).alias("block")
        flown = stored(_flown(rest.join(counts, "place").select(*facts, "draw", block), last), "flown").drop("block")
        is_open = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
        done.append((flown if last else flown.where(~is_open)).select(*facts))
        if last:
            break
        rest, level = flown.where(is_open), level + 1
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    return settled.select("h1", "h2", "size", "source_size", "target", "rows", copies)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (h1, h2, ...) with ``nth``: 1, 2, ... among equal ones. Each
    piece of the table numbers its own, so that rows without end of one kind
    never meet; which of them gets which number does not matter."""
    cut = stored(rows.withColumn("part", F.spark_partition_id()), "equal")
    counts = cut.groupBy("h1", "h2", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("h1", "h2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("h1", "h2", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("h1", "h2", "part").orderBy("h1"))
    return cut.withColumn("nth", own).join(before, ["h1", "h2", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")


def taken(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of ``docs`` plus a struct ``_mix``:
    size, source_size, target, copies, taken. Equal rows share out the copies
    that the mix takes of them."""
    carry = [c for c in docs.columns if c != "_mix"] if carry is None else carry
    chosen = stored(decided(docs, mix, text, source), "chosen")
    rows = docs.select(*identity(docs), pack(carry)).join(chosen, ["h1", "h2"])
    uneven = F.col("copies") % F.col("rows") != 0
    even = rows.where(~uneven).withColumn("nth", F.lit(1).cast("long"))
    rows = even if chosen.where(uneven).isEmpty() else even.unionByName(numbered(rows.where(uneven)))
    each = F.floor(F.col("copies") / F.col("rows"))
    own = (each + (F.col("nth") <= F.col("copies") - each * F.col("rows")).cast("long")).alias("copies")
    rows = rows.select("body", "size", "source_size", "target", own)
    made = F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return rows.select(*unpack(carry), made.alias("_mix"))


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    chosen = stored(decided(docs, mix, text, source).where("copies > 0").select("h1", "h2", "rows", "copies"), "chosen")
    rows = docs.select(*identity(docs), pack(docs.columns)).join(chosen, ["h1", "h2"])
    if not chosen.where("rows > 1").isEmpty():  # only these bodies are dealt out again
        rows = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["h1", "h2"]))
    rows = rows.select("body", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*unpack(docs.columns))
