"""Repeated passages of texts as UTF-8 bytes, by longest-previous-factor arrays.

A byte is repeated if a string of ``length`` bytes that covers it starts
anywhere else too, in the same text or another; no string crosses texts. With
``keep="none"`` all copies go, with ``keep="first"`` a string that starts
nowhere earlier (by id, then text, then position) stays.

Method:

1. Anchors deal the work out. Each string of ``length`` bytes has as its
   anchor the ``core`` bytes in it with the smallest hash (leftmost of equal
   ones), which only its own bytes decide: equal strings have equal anchors.
   The strings of one anchor are neighbours; the bytes that they span are the
   anchor's segment. Segments are grouped by their core's hash; one that is
   alone in its group holds no repeated string.
2. Equal segments of a group are one kind with a count (a partial aggregation,
   so a passage of a third of all texts is a row a task); all their strings
   repeat where the count is above 1.
3. The different segments of a group are laid out one after another, many
   groups a batch: the suffixes at their strings are sorted by ``length``
   bytes, the common prefixes of neighbours taken, and the previous and next
   smaller positions in suffix order give each string's longest match that
   starts earlier (LPF); larger ones, that starts later. A string repeats
   where such a match is ``length`` long.
4. A group with more than ``Repeats.group`` different segments is not laid out
   in one task: its strings are counted by 128 bits of their digest, with
   partial aggregation. That is exact whatever the group's size.

Cases: null and empty texts have no bytes; texts below ``length`` bytes lose
none. Rows of equal id and text are two texts of which none is earlier: with
``keep="first"`` both are answered as the first is. Rows of equal id and
other text are texts of their own; a null id sorts first. An empty table gives
no rows. Columns of any name are carried along. A text is a unit: its spans
fit a row; anchors are looked for in ``STRETCH`` bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.llm.common import byte_batches, pack, stored, unpack

#: Bytes worked on at once: while anchors are looked for, while segments are sorted.
STRETCH = 1 << 19
SORTED = 1 << 18
#: Stands between texts; no UTF-8 text holds it.
BETWEEN = b"\xff"
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)

SEGMENT = "core long, digest long, id {id}, th long, first int, last int"
SPAN = "id {id}, th long, start int, stop int"
OUT = "array<struct<start:int,stop:int>>"


@dataclass(frozen=True)
class Repeats:
    """``length``: bytes of a string. ``core``: bytes of an anchor. ``group``:
    most different segments of a group that one task sorts."""

    length: int = 200
    core: int = 64
    group: int = 1000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


_UP = _powers(_ODD, 2 * STRETCH)
_DOWN = _powers(pow(_ODD, -1, 1 << 64), 2 * STRETCH)


def anchors(data: np.ndarray, rules: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the core at each place, and the anchor of each string."""
    n, wide = len(data), rules.length - rules.core + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[rules.core :] - sums[: -rules.core]) * _DOWN[: n - rules.core + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    low = np.uint64(n.bit_length())  # the place decides between equal hashes
    m = len(h)
    key = np.full(-(-m // wide) * wide, np.uint64(2**64 - 1))
    key[:m] = (h >> low << low) | np.arange(m, dtype=np.uint64)
    rows = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = m - wide + 1
    least = np.minimum(behind[:strings], ahead[wide - 1 : wide - 1 + strings])
    return h, (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """All strings of the texts in pieces of at most ``STRETCH`` bytes, many
    pieces a time: text number, offset, bytes."""
    which, offsets, parts, n = [], [], [], 0
    step = STRETCH - length + 1
    for k, text in enumerate(texts):
        for begin in range(0, len(text) - length + 1, step):
            part = text[begin : begin + STRETCH]
            if n + len(part) > STRETCH and parts:
                yield which, offsets, parts
                which, offsets, parts, n = [], [], [], 0
            which.append(k)
            offsets.append(begin)
            parts.append(part)
            n += len(part)
    if parts:
        yield which, offsets, parts


def segments(texts: list[bytes], rules: Repeats) -> Iterator[tuple[np.ndarray, ...]]:
    """core, digest, text number, first and last string of all anchors."""
    for which, offsets, parts in _stretches(texts, rules.length):
        blob = BETWEEN.join(parts)
        h, at = anchors(np.frombuffer(blob, np.uint8), rules)
        sizes = np.array([len(p) for p in parts])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        place = np.arange(len(at))
        piece = np.searchsorted(begin, place, side="right") - 1
        place = place[place + rules.length <= begin[piece] + sizes[piece]]  # strings within a piece
        piece = piece[place]
        cut = np.ones(len(place) + 1, bool)
        cut[1:-1] = (at[place[1:]] != at[place[:-1]]) | (piece[1:] != piece[:-1])
        first, last = place[cut[:-1]], place[cut[1:]]
        piece, at = piece[cut[:-1]], at[first]
        view, length, digest = memoryview(blob), rules.length, xxhash.xxh3_64_intdigest
        made = [digest(view[i : j + length], s) for i, j, s in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)]
        there = np.array(offsets)[piece] - begin[piece]
        yield h[at].view(np.int64), np.array(made, np.uint64).view(np.int64), np.array(which)[piece], first + there, last + there


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` (ascending) by their first ``depth`` bytes,
    equal ones by place, as numbers of starts; their common prefixes with the
    one before, at most ``depth``."""
    strings = np.ascontiguousarray(sliding_window_view(data, depth)[starts])
    order = np.argsort(strings.view(f"S{depth}").ravel(), kind="stable")
    strings = strings[order]
    differ = strings[1:] != strings[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return order, np.concatenate([[0], lcp])


def factors(order: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the longest match that starts earlier (LPF), and later;
    0 where it is below ``least``.

    The earlier start of the longest match is the previous or next smaller one
    in suffix order (the later: the larger). All are found at once: a place's
    candidate is the place before; while that is no answer, the place jumps to
    its candidate's candidate and takes the smaller of the common prefixes.
    """
    n = len(order)
    both = []
    for value in (order, -order):
        longest = np.zeros(n, np.int64)
        for way in (1, -1):
            v = value[::way]
            to = np.arange(n) - 1
            reach = lcp.copy() if way == 1 else np.concatenate([[0], lcp[1:][::-1]])
            live = np.flatnonzero(reach >= least)
            while len(live):
                live = live[(to[live] >= 0) & (reach[live] >= least)]
                live = live[v[to[live]] > v[live]]
                on = to[live]
                reach[live] = np.minimum(reach[live], reach[on])
                to[live] = to[on]
            fits = np.where((to >= 0) & (reach >= least), reach, 0)
            target = order[::way]
            longest[target] = np.maximum(longest[target], fits)
        both.append(longest)
    return both[0], both[1]


def _repeating(rows: list[tuple[bytes, int]], rules: Repeats, later_too: bool) -> list[tuple[int, int, int]]:
    """Of segments with their number of strings, in order: the runs of strings
    that also start earlier (or later): row, first and last string."""
    data = np.frombuffer(BETWEEN.join(r[0] for r in rows), np.uint8)
    sizes, many = np.array([len(r[0]) for r in rows]), np.array([r[1] for r in rows])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    before = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(rows)), many)
    inner = np.arange(before[-1]) - before[row]
    order, lcp = sorted_suffixes(data, begin[row] + inner, rules.length)
    earlier, later = factors(order, lcp, rules.length)
    hit = np.flatnonzero((earlier > 0) | (later > 0) if later_too else earlier > 0)
    if not len(hit):
        return []
    cut = np.ones(len(hit) + 1, bool)
    cut[1:-1] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
    first, last = hit[cut[:-1]], hit[cut[1:]]
    return list(zip(row[first].tolist(), inner[first].tolist(), inner[last].tolist(), strict=True))


def _anchored(texts: DataFrame, rules: Repeats, kind: str) -> DataFrame:
    """The segments of all texts ``id, th, text``."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for core, digest, k, first, last in segments([t.encode("utf-8") for t in frame["text"]], rules):
                yield pd.DataFrame({"core": core, "digest": digest, "id": frame["id"].iloc[k].array, "th": frame["th"].iloc[k].array, "first": first, "last": last})

    return texts.mapInPandas(found, SEGMENT.format(id=kind))


def _bytes(kinds: DataFrame, texts: DataFrame, rules: Repeats, kind: str) -> DataFrame:
    """``kinds`` with the bytes of their first segment."""
    listed = kinds.groupBy("id", "th").agg(F.collect_list(F.struct("core", "n", "m", "first", "last")).alias("kinds"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, h, text, found in frame[["id", "th", "text", "kinds"]].itertuples(index=False, name=None):
                text = text.encode("utf-8")
                rows += [(x["core"], x["n"], x["m"], i, h, x["first"], x["last"], text[x["first"] : x["last"] + rules.length]) for x in found]
            yield pd.DataFrame(rows, columns=["core", "n", "m", "id", "th", "first", "last", "bytes"])

    same = texts.id.eqNullSafe(listed.id) & (texts.th == listed.th)
    joined = texts.join(listed, same).select(listed.id, listed.th, "text", "kinds").dropDuplicates(["id", "th"])
    return joined.mapInPandas(cut, f"core long, n long, m long, id {kind}, th long, first int, last int, bytes binary")


def _sorted_groups(parts: DataFrame, rules: Repeats, all_copies: bool, kind: str) -> DataFrame:
    """Spans of the strings that repeat among different segments of a group."""

    def spans(rows: list[tuple]) -> pd.DataFrame:
        runs = _repeating([(r[6], r[5] - r[4] + 1) for r in rows], rules, all_copies)
        # all strings of a kind with copies are spans already
        out = [(*rows[k][2:4], rows[k][4] + i, rows[k][4] + j + rules.length) for k, i, j in runs if not all_copies or rows[k][1] == 1]
        return pd.DataFrame(out, columns=["id", "th", "start", "stop"])

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, last, size = [], [], 0  # groups that have ended, and the one that may go on
        for frame in frames:
            for r in frame[["core", "n", "id", "th", "first", "last", "bytes"]].itertuples(index=False, name=None):
                if last and last[-1][0] != r[0]:
                    whole += last
                    last = []
                    if size > SORTED:
                        yield spans(whole)
                        whole, size = [], 0
                last.append(r)
                size += len(r[6])
        if whole or last:
            yield spans(whole + last)

    dealt = parts.repartition("core").sortWithinPartitions("core", "id", "th", "first")
    return dealt.mapInPandas(groups, SPAN.format(id=kind))


def _counted_groups(parts: DataFrame, rules: Repeats, all_copies: bool, kind: str) -> DataFrame:
    """The same for groups of any size: strings counted by their digest."""

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for frame in frames:
            for r in frame[["n", "id", "th", "first", "last", "bytes"]].itertuples(index=False, name=None):
                view = memoryview(r[5])
                m = r[4] - r[3] + 1
                yield pd.DataFrame({"string": [digest(view[i : i + rules.length]) for i in range(m)], "n": r[0], "id": [r[1]] * m, "th": r[2], "start": range(r[3], r[4] + 1)})

    each = parts.mapInPandas(strings, f"string binary, n long, id {kind}, th long, start int")
    place = F.struct("id", "th", "start")
    total = each.groupBy("string").agg(F.sum("n").alias("all"), F.count("*").alias("places"), F.min(place).alias("earliest"))
    if all_copies:
        hit = each.where("n = 1").join(total.where("all > 1"), "string")
    else:
        hit = each.join(total.where("places > 1"), "string").where(F.struct("id", "th", "start") != F.col("earliest"))
    return hit.select("id", "th", "start", (F.col("start") + rules.length).alias("stop"))


def spans(docs: DataFrame, rules: Repeats = Repeats(), keep: str = "none", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id, th`` (id and hash of a text) and its repeated strings' spans
    ``start, stop`` in bytes, one row a run of strings; runs may overlap."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    byte_batches(spark)
    texts = _texts(docs, text, key).where(F.octet_length("text") >= rules.length)
    found = _anchored(texts, rules, kind)
    # written, so that the join below has plain shuffles that AQE can split at a hot core
    cores = stored(found.groupBy("core").count().where("count > 1").select("core"), "cores")
    hits = stored(found.join(cores, "core"), "hits")
    place = F.struct("id", "th", "first", "last")
    kinds = stored(hits.groupBy("core", "digest").agg(F.count("*").alias("n"), F.min(place).alias("at")), "kinds")
    copies = hits.join(kinds.where("n > 1"), ["core", "digest"])
    if keep == "first":
        copies = copies.where(F.struct("id", "th", "first", "last") != F.col("at"))
    copies = copies.select("id", "th", F.col("first").alias("start"), (F.col("last") + rules.length).alias("stop"))
    groups = kinds.groupBy("core").agg(F.count("*").alias("m"), F.min("n").alias("_n")).where("m > 1")
    groups = groups.where("_n = 1") if keep == "none" else groups
    mixed = kinds.join(groups.drop("_n"), "core").select("core", "n", "m", "at.*")
    parts = stored(_bytes(mixed, texts, rules, kind), "segments")
    every = keep == "none"
    small = _sorted_groups(parts.where(F.col("m") <= rules.group), rules, every, kind)
    large = _counted_groups(parts.where(F.col("m") > rules.group), rules, every, kind)
    return copies.unionByName(small).unionByName(large)


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(whole).alias("th"), whole.alias("text"))


def without(docs: DataFrame, rules: Repeats = Repeats(), keep: str = "none", text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all, if None) and a struct ``_repeats``: the
    ``spans`` removed (disjoint, in order), ``n_bytes`` of the text and the
    bytes ``kept``, which may start within a character."""
    names = docs.columns if carry is None else carry
    listed = spans(docs, rules, keep, text, key).groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("_runs"))

    @F.pandas_udf(f"spans {OUT}, kept binary")
    def cut(whole: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(whole, runs, strict=True):
            if r is None:
                out.append((None, None))
                continue
            merged = _merged([(x["start"], x["stop"]) for x in r])
            data, at, kept = t.encode("utf-8"), 0, []
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append(([{"start": a, "stop": b} for a, b in merged], b"".join(kept)))
        return pd.DataFrame(out, columns=["spans", "kept"])

    rows = docs.select(pack(names), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.join(listed, rows.id.eqNullSafe(listed.id) & (rows.th == listed.th), "left").select("body", "_t", "_runs")
    rows = rows.withColumn("_cut", cut(F.when(F.col("_runs").isNotNull(), F.col("_t")), F.col("_runs")))
    made = F.struct(
        F.coalesce("_cut.spans", F.array().cast(OUT)).alias("spans"),
        F.octet_length("_t").cast("long").alias("n_bytes"),
        F.coalesce("_cut.kept", F.col("_t").cast("binary")).alias("kept"),
    )
    return rows.select(*unpack(names), made.alias("_repeats"))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
