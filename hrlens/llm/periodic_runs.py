"""Periodic runs: stretches of words that repeat with one period.

A run is a stretch of consecutive words with smallest period q and at least
``max(least, exponent * q)`` words that no neighbouring word extends.

Method, for a batch of texts laid out as one sequence of word numbers with a
separator of its own after each text:

* Difference-cover LCE. Of all suffixes, only those at cover positions modulo
  ``COVER`` are sorted (what is tied is sorted again, by the next word up to
  ``COVER`` words, then by the rank ``COVER``, 2 ``COVER``, ... words on). The
  order's adjacent common prefixes go into a sparse table. The common
  extension of two positions is compared word by word until a mismatch or
  until both are at cover positions, which takes less than ``COVER`` words; a
  range minimum gives the rest. The same index over the reversed sequence
  extends to the left.
* Harmonic grid. A run of period p holds at least ``max(least - p, (exponent -
  1) * p)`` consecutive positions i whose word equals the word at i + p, so
  one of these is a multiple of that number. For each p only those positions
  are looked at, n / p in all; equal words are extended both ways. A stretch
  found with several periods has the smallest of them, which divides the
  others.

Words of a batch are numbered by their bytes, so nothing rests on a hash.

Cases: null and empty texts have no words and no runs; their collapsed text is
empty. Repeated rows are each answered. A text is a unit: its words fit a task
(some 60 bytes a word while it is worked on), batches end at ``BATCH_WORDS``
words. Columns of any name are carried along. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.common import byte_batches, pack, unpack

COVER = 31
#: A perfect difference set: any two residues modulo 31 meet at one shift.
RESIDUES = (1, 5, 11, 24, 25, 27)
BATCH_WORDS = 250_000

RUNS = "array<struct<start:long,length:long,period:long>>"


@dataclass(frozen=True)
class Runs:
    """``least``: fewest words of a run. ``exponent``: fewest repeats."""

    least: int = 6
    exponent: int = 4


def _shifts() -> np.ndarray:
    """For residues a, b: the shift that takes both into the cover."""
    inside = np.zeros(COVER, bool)
    inside[list(RESIDUES)] = True
    out = np.zeros((COVER, COVER), np.int64)
    for a in range(COVER):
        for b in range(COVER):
            out[a, b] = next(s for s in range(COVER) if inside[(a + s) % COVER] and inside[(b + s) % COVER])
    return out


SHIFTS = _shifts()


class Extensions:
    """Longest common extensions to the right in a sequence of numbers whose
    separators are all different."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        self.seq = np.concatenate([seq, np.arange(-COVER - 2, 0, dtype=np.int64) - len(seq) - 1])
        self.table: list[np.ndarray] | None = None

    def _build(self) -> None:
        """Order of the sampled suffixes and the sparse table over their
        common prefixes; only built where a comparison gets that far."""
        inside = np.zeros(COVER, bool)
        inside[list(RESIDUES)] = True
        at = np.flatnonzero(inside[np.arange(self.n) % COVER])
        m = len(at)
        place = np.full(self.n + COVER + 1, -1, np.int64)
        place[at] = np.arange(m)
        rank = np.zeros(m, np.int64)
        live = np.arange(m)
        for j in range(COVER):
            live = self._split(rank, live, self.seq[at[live] + j])
            if not len(live):
                break
        levels, step = [rank.copy()], COVER
        while len(live):
            # rank of the suffix ``step`` words on; beyond the end none is like another
            on = place[np.minimum(at[live] + step, self.n)]
            live = self._split(rank, live, np.where(on >= 0, rank[on], -1 - at[live]))
            levels.append(rank.copy())
            step *= 2
        order = np.argsort(rank, kind="stable")
        left, right = at[order[:-1]], at[order[1:]]
        lcp = np.zeros(len(left), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            width = COVER << level
            a, b = place[np.minimum(left + lcp, self.n)], place[np.minimum(right + lcp, self.n)]
            same = (a >= 0) & (b >= 0)
            same &= levels[level][np.maximum(a, 0)] == levels[level][np.maximum(b, 0)]
            lcp[same] += width
        lcp = self._compare(left, right, lcp, np.full(len(left), COVER))
        self.rank, self.place = np.empty(m, np.int64), place
        self.rank[order] = np.arange(m)
        self.table = [lcp]
        width = 1
        while 2 * width <= len(lcp):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _split(rank: np.ndarray, live: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Sort ``live``, the members of tied ranks, by rank and ``keys``; a
        class's rank is its first member's place. What is still tied."""
        groups = rank[live]
        inner = np.lexsort((keys, groups))
        live, groups, keys = live[inner], groups[inner], keys[inner]
        head = np.ones(len(live) + 1, bool)
        head[1:-1] = groups[1:] != groups[:-1]
        new = head.copy()
        new[1:-1] |= keys[1:] != keys[:-1]
        index = np.arange(len(live))
        first = np.maximum.accumulate(np.where(head[:-1], index, 0))
        start = np.maximum.accumulate(np.where(new[:-1], index, 0))
        rank[live] = groups + start - first
        return live[~(new[:-1] & new[1:])]

    def _compare(self, i: np.ndarray, j: np.ndarray, done: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Extend ``done`` word by word, by ``most`` words at most."""
        done = done.copy()
        live = np.flatnonzero(most > 0)
        for k in range(1, COVER + 1):
            live = live[self.seq[i[live] + done[live]] == self.seq[j[live] + done[live]]]
            if not len(live):
                break
            done[live] += 1
            live = live[most[live] > k]
        return done

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and ``j`` (different, below n) share."""
        shift = SHIFTS[i % COVER, j % COVER]
        out = self._compare(i, j, np.zeros(len(i), np.int64), shift)
        far = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < self.n))
        if len(far):
            if self.table is None:
                self._build()
            a = self.rank[self.place[i[far] + shift[far]]]
            b = self.rank[self.place[j[far] + shift[far]]]
            a, b = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            more = np.empty(len(far), np.int64)
            for k in np.unique(level):
                mine = level == k
                more[mine] = np.minimum(self.table[k][a[mine]], self.table[k][b[mine] - (1 << int(k))])
            out[far] += more
        return out


def find(seq: np.ndarray, longest: int, rules: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs, by start, then
    period. ``longest``: most words between two separators."""
    n = len(seq)
    onward, backward = Extensions(seq), Extensions(seq[::-1])
    found, held, many = [], [], 0

    def extend() -> None:
        """Extend what is held both ways and keep what is long enough."""
        p = np.repeat([p for p, _ in held], [len(i) for _, i in held])
        i = np.concatenate([i for _, i in held])
        least = np.maximum(np.maximum(rules.least - p, (rules.exponent - 1) * p), 1)
        # an equal word apart is no run: the word before or after must be equal too
        after, before = np.minimum(i + 1, n - 1 - p), np.maximum(i - 1, 0)
        near = (after > i) & (seq[after] == seq[after + p]) | (before < i) & (seq[before] == seq[before + p]) | (least == 1)
        p, i, least = p[near], i[near], least[near]
        stop = i + onward(i, i + p)
        start, inner = i.copy(), i > 0
        start[inner] -= backward(n - i[inner], n - i[inner] - p[inner])
        enough = stop - start >= least
        stretch = np.stack([start, stop + p - start, p])[:, enough]
        found.append(np.unique(stretch, axis=1) if stretch.shape[1] > 1 else stretch)

    for p in range(1, min(longest // rules.exponent, n - 1) + 1):
        grid = max(rules.least - p, (rules.exponent - 1) * p, 1)
        i = np.flatnonzero(seq[: n - p : grid] == seq[p::grid]) * grid
        if len(i):
            held.append((p, i))
            many += len(i)
        if many > BATCH_WORDS:
            extend()
            held, many = [], 0
    if held:
        extend()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)  # one stretch has its smallest period
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _answers(words: list[list[bytes]], rules: Runs) -> tuple[list[np.ndarray], list[str]]:
    """Runs (rows of start, length, period) and collapsed text of each text."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    codes = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # a separator ends each text
    seq = np.empty(begin[-1], np.int64)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(words)), sizes)
    seq[begin[1:] - 1] = -1 - np.arange(len(words))
    seq[place] = codes
    start, length, period = find(seq, int(sizes.max(initial=0)), rules)
    owner = np.searchsorted(begin, start, side="right") - 1
    gone = np.zeros(len(seq) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    gone = np.cumsum(gone) > 0
    bounds = np.searchsorted(owner, np.arange(len(words) + 1))
    runs, texts = [], []
    for d, w in enumerate(words):
        a, b = bounds[d], bounds[d + 1]
        runs.append(np.stack([start[a:b] - begin[d], length[a:b], period[a:b]], axis=1))
        kept = w if a == b else [x for x, drop in zip(w, gone[begin[d] : begin[d] + len(w)].tolist(), strict=True) if not drop]
        texts.append(b" ".join(kept).decode("utf-8"))
    return runs, texts


def with_runs(docs: DataFrame, rules: Runs = Runs(), text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all, if None) and a struct ``_runs``: ``n_words``,
    ``runs`` (by start, then period) and ``collapsed``, the words joined by
    one space without those that a run holds after its first period."""
    names = docs.columns if carry is None else carry

    @F.pandas_udf(f"n_words long, runs {RUNS}, collapsed string")
    def answers(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            held, n = [], 0
            for i, x in enumerate(column, 1):
                held.append(x.encode("utf-8").split())
                n += len(held[-1])
                if n >= BATCH_WORDS or i == len(column):
                    yield answered(held)
                    held, n = [], 0

    def answered(words: list[list[bytes]]) -> pd.DataFrame:
        runs, texts = _answers(words, rules)
        listed = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r.tolist()] for r in runs]
        return pd.DataFrame({"n_words": list(map(len, words)), "runs": listed, "collapsed": texts})

    byte_batches(docs.sparkSession)
    out = docs.select(pack(names), answers(F.coalesce(F.col(text), F.lit(""))).alias("_runs"))
    return out.select(*unpack(names), "_runs")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of every tenth text (by crc32 of its id) made
    periodic from a word on, as the query's contract says; a null id leaves
    its text as it is."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")
    d = docs.withColumn("_h", hashed).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    d = d.withColumn("_a", F.when(n > 0, (g % n).cast("int")))
    d = d.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))

    def moved(i: Column) -> Column:
        return F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), moved))
    return d.withColumn("text", F.when(n > 0, text).otherwise(F.col("text"))).drop("_h", "_w", "_a", "_p")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period of ``runs`` (by start, then
    period; the first of equals), null if there is none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best: Column, run: Column) -> Column:
        wins = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(wins, run).otherwise(best)

    return F.aggregate(runs, none, better)
