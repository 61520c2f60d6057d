"""SentencePiece encoding and decoding by a max-plus parallel scan.

A byte-fallback BPE model's segmentation of a text is the one path through the
lattice of its pieces on which each two neighbours would also be kept apart if
they stood alone. With weight 0 for such neighbours and minus infinity for
others, that path is the only one of weight 0, and it is found by max-plus
products: a chunk of a text gives a matrix from the pieces that may span its
start to those that may span its end, matrices are combined associatively,
and once the piece on each boundary is known, every chunk traces its own path
back, apart from the others.

Texts of up to ``chunk`` characters are one chunk. Longer ones are dealt out
chunk by chunk; their matrices meet in runs, the runs in one small product per
text, and the states go back down to the chunks, so the text itself never
meets in one task again.

Between two characters that stand side by side in no piece, every path has a
boundary. Stretches between such places have a path of their own; those seen
before are remembered by each worker.

The model is read from ``model`` (a path that every executor can open); it must
be of BPE type with byte fallback and identity normalisation.

Cases: null or empty text has no ids and decodes to ""; texts of any length,
with or without spaces, are encoded whole; equal texts are encoded alike;
other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from hrlens.llm.common import pack, small_batches, stored, unpack

SPACE = "▁"
CHUNK = 65_536
MEMORY = 400_000  # stretches in each generation of a worker's memory
RUN = 256
NONE = -np.inf
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """The pieces of a model and what may stand next to what."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.control = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or i in self.control or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known_pairs: dict[tuple[str, str], bool] = {}
        # Two generations each: once the younger is full it becomes the older.
        self.units: dict[str, bytes] = {}
        self.older_units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        # A piece's text; bytes below 128 are characters, others need their neighbours.
        self.texts = np.array(self.names, object)
        for i in self.control:
            self.texts[i] = ""
        for b, i in self.bytes.items():
            self.texts[i] = chr(b)
        self.split_byte = np.zeros(size, bool)
        self.split_byte[[i for b, i in self.bytes.items() if b >= 128]] = True
        self.byte_of = {i: b for b, i in self.bytes.items()}

    def merged(self, s: str) -> list[str]:
        """The model's merges on a short string."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a ("" before the first piece or a
        sure boundary): weight 0, else minus infinity."""
        key = (a, b)
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) > 1_000_000:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def sure(self, s: str, p: int) -> bool:
        """Whether every path has a boundary between s[p - 1] and s[p]."""
        return s[p - 1 : p + 1] not in self.inside

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def path(self, s: str) -> list[str]:
        """The pieces of a stretch between sure boundaries."""
        ids, pairs, follows = self.ids, self.known_pairs, self.follows
        if s in ids and follows("", s):
            return [s]
        # By end: the last piece of the one path to there, None if there is no such path.
        last: list[str | None] = [""]
        for e in range(1, len(s) + 1):
            found = None
            for b in range(max(0, e - self.longest), e):
                piece = s[b:e]
                if piece in ids or b + 1 == e:
                    before = last[b]
                    if before is None:
                        continue
                    ok = pairs.get((before, piece))
                    if follows(before, piece) if ok is None else ok:
                        found = piece
                        break
            last.append(found)
        out, e = [], len(s)
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def part(self, s: str) -> bytes:
        """Ids (little-endian int32) of a stretch without sure boundaries."""
        known = self.parts.get(s) or self.older_parts.get(s)
        if known is None:
            known = np.array([i for p in self.path(s) for i in self.ids_of(p)], "<i4").tobytes()
        if len(s) <= 64:
            if len(self.parts) >= MEMORY:
                self.older_parts, self.parts = self.parts, {}
            self.parts[s] = known
        return known

    def unit(self, s: str) -> bytes:
        """Ids of a stretch between sure boundaries."""
        known = self.units.get(s) or self.older_units.get(s)
        if known is None:
            inside = self.inside
            cuts = [0, *[p for p in range(1, len(s)) if s[p - 1 : p + 1] not in inside], len(s)]
            known = self.part(s) if len(cuts) == 2 else b"".join([self.part(s[a:b]) for a, b in zip(cuts, cuts[1:])])
        if len(s) <= 64:
            if len(self.units) >= MEMORY:
                self.older_units, self.units = self.units, {}
            self.units[s] = known
        return known

    def whole(self, s: str) -> bytes:
        """Ids of a normalised stretch whose ends are sure boundaries."""
        parts = s.split(SPACE)
        if not parts[0] and "" not in parts[1:]:
            unit = self.unit
            return b"".join([self.units.get(k) or unit(k) for k in [SPACE + p for p in parts[1:]]])
        return b"".join(map(self.unit, _UNITS.findall(s)))

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for."""
        if not self.split_byte[ids].any():
            s = "".join(self.texts[ids].tolist()).replace(SPACE, " ")
            return s[1:] if s.startswith(" ") else s
        out, held = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.texts[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        s = "".join(out).replace(SPACE, " ")
        return s[1:] if s.startswith(" ") else s


@lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


# --- one chunk --------------------------------------------------------------
# A chunk is (s, lo, hi): a stretch lo..hi of s, which holds ``longest``
# characters more on either side where the text has them. A state is a piece
# (b, e) on a boundary p: b < p <= e. At the text's start the one state is (lo, lo).


def states(m: Pieces, s: str, p: int, first: bool, last: bool) -> list[tuple[int, int]]:
    """The pieces that may span boundary p."""
    if first:
        return [(p, p)]
    out = []
    for b in range(max(0, p - m.longest), p):
        for e in range(p, (p if last else min(len(s), b + m.longest)) + 1):
            if e - b <= m.longest and (e - b == 1 or s[b:e] in m.ids):
                out.append((b, e))
    return out


def _reach(m: Pieces, s: str, begin: dict[tuple[int, int], int], stop: int) -> dict[tuple[int, int], int]:
    """From the pieces ``begin`` (a bit set each) to all pieces that span
    ``stop``: which bits reach them. A start (p, p) counts as a sure boundary."""
    by_end: dict[int, dict[int, int]] = {}
    out: dict[tuple[int, int], int] = {}
    for (b, e), bits in begin.items():
        if e >= stop and b < e:
            out[(b, e)] = out.get((b, e), 0) | bits
        else:
            by_end.setdefault(e, {})[b] = by_end.get(e, {}).get(b, 0) | bits
    at = min(by_end, default=stop)
    while at < stop:
        here = by_end.pop(at, None)
        if here:
            free = at in here or m.sure(s, at) if at else True
            for e in range(at + 1, min(len(s), at + m.longest) + 1):
                piece = s[at:e]
                if e - at > 1 and piece not in m.ids:
                    continue
                bits = 0
                for b, x in here.items():
                    if m.follows("" if free else s[b:at], piece):
                        bits |= x
                if bits:
                    if e >= stop:
                        out[(at, e)] = out.get((at, e), 0) | bits
                    else:
                        known = by_end.setdefault(e, {})
                        known[at] = known.get(at, 0) | bits
        at += 1
    return out


def transfer(m: Pieces, s: str, lo: int, hi: int, first: bool, last: bool) -> np.ndarray:
    """Max-plus matrix from the states at ``lo`` to those at ``hi``."""
    ins, outs = states(m, s, lo, first, False), states(m, s, hi, False, last)
    place = {x: j for j, x in enumerate(outs)}
    mat = np.full((len(ins), len(outs)), NONE)
    begin = {x: 1 << i for i, x in enumerate(ins)}
    # First and last sure boundary before hi; the text's start is one.
    a = lo if first else next((p for p in range(max(lo, 1), hi) if m.sure(s, p)), None)
    if a is None:
        reached = _reach(m, s, begin, hi)
    else:
        # All paths meet there: the matrix is the sum of a column and a row.
        z = next((p for p in range(hi - 1, a, -1) if m.sure(s, p)), a)
        head = 1 if first else 0
        for (_, e), bits in ({} if first else _reach(m, s, begin, a)).items():
            head |= bits if e == a else 0
        reached = {x: head for x in _reach(m, s, {(z, z): 1}, hi)}
    for x, bits in reached.items():
        for i in range(len(ins)):
            if bits >> i & 1 and x in place:
                mat[i, place[x]] = 0.0
    return mat


def trace(m: Pieces, s: str, state: tuple[int, int], to: tuple[int, int]) -> bytes:
    """Ids of the pieces after ``state`` up to ``to``."""
    if state == to:
        return b""
    lo, hi = state[1], to[0]
    # The first and last sure boundaries enclose what can be looked up; the rest is traced piece by piece.
    a = next((p for p in range(max(lo, 1), hi + 1) if m.sure(s, p)), None) if hi > lo else None
    out, at, prev = [], lo, s[state[0] : state[1]]
    if a is not None:
        z = next(p for p in range(hi, a - 1, -1) if m.sure(s, p))
        out.append(_between(m, s, prev, at, a))
        out.append(m.whole(s[a:z]) if z > a else b"")
        at, prev = z, ""
    out.append(_between(m, s, prev, at, to[0], s[to[0] : to[1]]))
    out.append(np.array(m.ids_of(s[to[0] : to[1]]), "<i4").tobytes())
    return b"".join(out)


def _between(m: Pieces, s: str, prev: str, lo: int, hi: int, then: str = "") -> bytes:
    """Ids of the path over lo..hi that starts after piece ``prev`` ("" for a
    sure boundary) and goes on with ``then`` ("" likewise)."""
    if lo == hi:
        return b""
    # Node (b, e): the piece, and the node that it follows.
    ways: dict[int, dict[int, int | None]] = {lo: {lo: None}}
    for at in range(lo, hi):
        for b in list(ways.get(at, ())):
            before = prev if at == lo else s[b:at]
            if at > lo and m.sure(s, at):
                before = ""
            for e in range(at + 1, min(hi, at + m.longest) + 1):
                piece = s[at:e]
                if (e - at == 1 or piece in m.ids) and m.follows(before, piece):
                    ways.setdefault(e, {}).setdefault(at, b)
    ends = [b for b in ways[hi] if not then or m.sure(s, hi) or m.follows(s[b:hi], then)]
    out, e, b = [], hi, ends[0]
    while e > lo:
        out.append(s[b:e])
        b, e = ways[e][b], b
    return np.array([i for p in reversed(out) for i in m.ids_of(p)], "<i4").tobytes()


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NONE)


def product(mats: list[np.ndarray]) -> np.ndarray:
    """Associative product of consecutive matrices, pair by pair."""
    while len(mats) > 1:
        mats = [combined(*mats[i : i + 2]) if i + 1 < len(mats) else mats[i] for i in range(0, len(mats), 2)]
    return mats[0]


def boundary_states(mats: list[np.ndarray], start: int, end: int) -> list[int]:
    """The state on each boundary of consecutive chunks, given the states at
    both ends."""
    ahead = [np.full(mats[0].shape[0], NONE)]
    ahead[0][start] = 0.0
    for x in mats:
        ahead.append(combined(ahead[-1][None, :], x)[0])
    behind = np.full(mats[-1].shape[1], NONE)
    behind[end] = 0.0
    out = [end]
    for k in range(len(mats) - 1, -1, -1):
        behind = combined(mats[k], behind[:, None])[:, 0]
        out.append(int(np.argmax(ahead[k] + behind)))
    return out[::-1]


# --- Spark ------------------------------------------------------------------


def _mats(g: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, "<f8").reshape(r, c) for x, r, c in zip(g["mat"], g["rows"], g["cols"])]


def long_ids(texts: DataFrame, model: str, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """h1, h2, ids for each row (h1, h2, text) of ``texts``, chunk by chunk."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = pieces(model).longest + 1
        for b in batches:
            for h1, h2, t in zip(b["h1"], b["h2"], b["text"]):
                s = normalised(t)
                n = -(-len(s) // chunk)
                for k in range(n):
                    lo, hi = k * chunk, min(len(s), (k + 1) * chunk)
                    a = max(0, lo - reach)
                    yield pd.DataFrame(
                        {"h1": [h1], "h2": [h2], "part": [k], "parts": [n], "s": [s[a : hi + reach]], "lo": [lo - a], "hi": [hi - a]}
                    )

    cuts = texts.mapInPandas(cut, "h1 long, h2 long, part int, parts int, s string, lo int, hi int")
    cuts = stored(cuts.repartition("h1", "h2", "part"), "chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(model)
        for b in batches:
            made = [transfer(m, s, lo, hi, k == 0, k == n - 1) for s, lo, hi, k, n in zip(b["s"], b["lo"], b["hi"], b["part"], b["parts"])]
            out = b[["h1", "h2", "part"]].assign(run=b["part"] // run)
            yield out.assign(rows=[x.shape[0] for x in made], cols=[x.shape[1] for x in made], mat=[x.astype("<f8").tobytes() for x in made])

    shape = "h1 long, h2 long, part int, run int, rows int, cols int, mat binary"
    mats = stored(cuts.mapInPandas(matrices, shape), "matrices")

    def up(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        x = product(_mats(g))
        return g.iloc[:1].assign(rows=x.shape[0], cols=x.shape[1], mat=[x.astype("<f8").tobytes()])

    runs = mats.groupBy("h1", "h2", "run").applyInPandas(up, shape)

    def over(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("run")
        mats = _mats(g)
        end = int(np.argmax(product(mats)[0]))
        at = boundary_states(mats, 0, end)
        return pd.DataFrame({"h1": g["h1"], "h2": g["h2"], "run": g["run"], "start": at[:-1], "end": at[1:]})

    ends = runs.groupBy("h1", "h2").applyInPandas(over, "h1 long, h2 long, run int, start int, end int")

    def down(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        at = boundary_states(_mats(g), int(g["start"].iloc[0]), int(g["end"].iloc[0]))
        return pd.DataFrame({"h1": g["h1"], "h2": g["h2"], "part": g["part"], "start": at[:-1], "end": at[1:]})

    known = mats.join(ends, ["h1", "h2", "run"]).groupBy("h1", "h2", "run").applyInPandas(down, "h1 long, h2 long, part int, start int, end int")

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(model)
        for b in batches:
            ids = []
            for s, lo, hi, k, n, x, y in zip(b["s"], b["lo"], b["hi"], b["part"], b["parts"], b["start"], b["end"]):
                one = states(m, s, lo, k == 0, False)[x]
                two = states(m, s, hi, False, k == n - 1)[y]
                ids.append(np.frombuffer(trace(m, s, one, two), "<i4"))
            yield b[["h1", "h2", "part"]].assign(ids=ids)

    parts = cuts.join(known, ["h1", "h2", "part"]).mapInPandas(back, "h1 long, h2 long, part int, ids array<int>")
    whole = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return parts.groupBy("h1", "h2").agg(F.flatten(whole["ids"]).alias("ids"))


def _encoded(docs: DataFrame, text: str, chunk: int, carry: list[str], model: str, short: Callable, long: Callable) -> DataFrame:
    """The columns ``carry`` and ``_out``: ``short`` of texts that are one
    chunk, ``long`` of the ids and the text of others."""
    small_batches(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(pack(carry), t.alias("text"))
    is_long = F.length("text") >= chunk  # one character goes before a text
    done = rows.where(~is_long).select("body", short(F.col("text")).alias("_out"))
    keys = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    big = rows.where(is_long).select("body", "text", *keys)
    ids = long_ids(big.dropDuplicates(["h1", "h2"]).select("h1", "h2", "text"), model, chunk)
    both = done.unionByName(big.join(ids, ["h1", "h2"]).select("body", long(F.col("ids"), F.col("text")).alias("_out")))
    return both.select(*unpack(carry), "_out")


def encode(docs: DataFrame, model: str, text: str = "text", chunk: int = CHUNK, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of ``docs`` plus ``_ids``."""

    @F.pandas_udf("array<int>")
    def short(texts: pd.Series) -> pd.Series:
        m = pieces(model)
        return pd.Series([np.frombuffer(m.whole(normalised(t)), "<i4") for t in texts], dtype=object)

    carry = [c for c in docs.columns if c != "_ids"] if carry is None else carry
    out = _encoded(docs, text, chunk, carry, model, short, lambda ids, _: ids)
    return out.withColumnRenamed("_out", "_ids")


CHECKED = "n_tokens long, ids_crc32 long, round_trip boolean"


def encode_and_back(docs: DataFrame, model: str, text: str = "text", chunk: int = CHUNK, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of ``docs`` plus ``_tokens``: the
    number of ids, their checksum, and whether they decode to the text. Ids
    are made, counted and decoded in one place, so none travels for it."""

    def checked(m: Pieces, t: str, ids: np.ndarray) -> tuple[int, int, bool]:
        return len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), m.decode(ids) == t

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in CHECKED.split(", ")])

    @F.pandas_udf(CHECKED)
    def short(texts: pd.Series) -> pd.DataFrame:
        m = pieces(model)
        return frame([checked(m, t, np.frombuffer(m.whole(normalised(t)), "<i4")) for t in texts])

    @F.pandas_udf(CHECKED)
    def long(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        m = pieces(model)
        return frame([checked(m, t, np.asarray(x)) for x, t in zip(ids, texts)])

    carry = [c for c in docs.columns if c != "_tokens"] if carry is None else carry
    return _encoded(docs, text, chunk, carry, model, short, long).withColumnRenamed("_out", "_tokens")


def decoded(model: str):
    """A column function from ids to the text that they stand for."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        m = pieces(model)
        return pd.Series([m.decode(np.asarray(x)) for x in ids], dtype=object)

    return run


@F.pandas_udf(LongType())
def checksum(ids: pd.Series) -> pd.Series:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return pd.Series([zlib.crc32(np.asarray(x).astype("<u4").tobytes()) for x in ids], dtype="int64")
