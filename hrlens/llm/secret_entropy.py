"""Secret scans, as DataFrame expressions only.

Base patterns find assignments, access keys and long hex strings. Sliding
windows of Shannon entropy add strings that no pattern names: for each
character class, runs of its characters are candidates; the counts of a
window's characters are kept while it slides by one (one in, one out), and
the windows at or above the class's bound make a span. Allow-listed strings
are not added, nor spans that a base span meets; ``redact`` keeps those, unless
a base span covers them whole, so that no part of a secret stays.

Entropy is compared in whole numbers (c * log2 c in units of 1e-9), so equal
windows are judged equally everywhere. Positions are code points, end
exclusive.

Keys of fewer than 16 characters, and those of fewer than 24 that signs (+ / _
-) cut into parts of fewer than 16, are found by the base patterns only.

Cases: null or empty text has no spans; texts of any length are read whole;
repeated rows give the same spans; other columns pass through.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.common import pack, unpack

# The base patterns, in their order (the length bounds follow).
ASSIGN = (
    "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_MIN = 8
# Runs are matched whole, so a shorter match can only be a run that fails.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``chars`` (a regex class) of ``window``
    characters or more; a window counts at ``bits`` of entropy or more over
    ``alphabet`` (``fold``: after lower-casing)."""

    kind: str
    chars: str
    alphabet: str
    window: int
    bits: float
    fold: bool = False

    @property
    def pattern(self) -> str:
        return f"(?<![{self.chars}])[{self.chars}]{{{self.window},}}"

    @property
    def most(self) -> int:
        """Largest sum of c * log2 c, in 1e-9, of a window that counts."""
        return round((self.window * math.log2(self.window) - self.window * self.bits) * 1e9)


def weight(c: int) -> int:
    """c * log2 c in units of 1e-9."""
    return round(c * math.log2(c) * 1e9) if c > 1 else 0


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdef", 24, 3.0, fold=True),
    CharClass("entropy_base64", "A-Za-z0-9+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0),
    # Keys of one case or without signs, of 16 characters or more: the bounds are
    # about the 1 % quantile of random strings (upper: of base32, the smaller one).
    CharClass("entropy_lower", "a-z0-9", "abcdefghijklmnopqrstuvwxyz0123456789", 16, 3.07),
    CharClass("entropy_upper", "A-Z0-9", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 3.02),
    CharClass("entropy_mixed", "A-Za-z0-9", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 16, 3.28),
)

# Candidates that are no secrets: digits or letters of one case alone (a
# leading capital aside), words joined by capitals, identifiers in UUID form, plain alphabets, and
# runs that call themselves examples or hold a piece of an alphabet, with 15
# characters at most before and after that: fewer than any window, so no secret
# beside it goes with it.
ALLOW = (
    "^[0-9]+$",
    "^[A-Za-z]?[a-z]+$",
    "^[A-Z]+$",
    "^[A-Za-z]?[a-z]+([A-Z][a-z]+)+$",
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "^(abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|0123456789|234567|[+/_-])+$",
    "(?i)^.{0,15}(0123456789|abcdefghijklm|qwertyuiop).{0,15}$",
    "(?i)^.{0,15}(example|sample|placeholder|dummy|changeme|xxxxxxxx).{0,15}$",
)


def located(d: DataFrame, pattern: str, out: str, group: int = 0) -> DataFrame:
    """``d`` plus an array ``out`` of (start, end, match, group) of the matches
    of ``pattern`` in column ``_t``. The text between matches, from a split by
    the pattern, gives the positions."""
    has = F.col("_t").rlike(pattern)
    d = d.withColumn("_gap", F.when(has, F.split("_t", pattern)))
    d = d.withColumn("_hit", F.when(has, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))))
    d = d.withColumn("_grp", F.when(has, F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))))
    shape = "array<struct<start:int,end:int,match:string,grp:string>>"
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(shape).alias("out"))

    def step(a: Column, i: Column) -> Column:
        start = a["pos"] + F.length(F.get("_gap", i))
        end = start + F.length(F.get("_hit", i))
        one = F.struct(start.alias("start"), end.alias("end"), F.get("_hit", i).alias("match"), F.get("_grp", i).alias("grp"))
        return F.struct(end.alias("pos"), F.concat(a["out"], F.array(one)).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), F.size("_hit") - 1), begin, step, lambda a: a["out"])
    made = F.when(F.size("_hit") > 0, found).otherwise(F.array().cast(shape))
    return d.withColumn(out, made).drop("_gap", "_hit", "_grp")


def entropy_spans(codes: Column, cls: CharClass) -> Column:
    """(lo, hi) over the windows that count in a candidate given as ``codes``,
    the 0-based places of its characters in the alphabet."""
    weights = F.lit([weight(c) for c in range(cls.window + 1)])
    w = cls.window
    begin = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(None).cast("int").alias("lo"),
        F.lit(0).alias("hi"),
    )

    def step(a: Column, i: Column) -> Column:
        come = F.get(codes, i)
        gone = F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
        same = come == gone
        up, down = F.get(a["counts"], come), F.coalesce(F.get(a["counts"], gone), F.lit(0))
        gain = F.get(weights, up + 1) - F.get(weights, up)
        loss = F.when(gone >= 0, F.get(weights, down) - F.get(weights, down - 1)).otherwise(F.lit(0))
        total = F.when(same, a["total"]).otherwise(a["total"] + gain - loss)
        counts = F.when(same, a["counts"]).otherwise(
            F.transform(a["counts"], lambda c, j: c + (j == come).cast("int") - (j == gone).cast("int"))
        )
        counts_here = (i >= w - 1) & (total <= cls.most)
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(counts_here, F.coalesce(a["lo"], i - (w - 1))).otherwise(a["lo"]).alias("lo"),
            F.when(counts_here, i + 1).otherwise(a["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))


def _added(d: DataFrame, name: str, cls: CharClass, place: int, allow: tuple[str, ...], overlapping: bool) -> DataFrame:
    """``d`` plus the entropy spans ``name`` of one character class."""
    d = located(d, cls.pattern, name)
    known = lambda x: functools.reduce(lambda a, b: a | b, [x["match"].rlike(p) for p in allow], F.lit(False))
    d = d.withColumn(name, F.filter(name, lambda x: ~known(x)))

    def codes(match: Column) -> Column:
        chars = F.split(F.lower(match) if cls.fold else match, "")
        return F.transform(chars, lambda ch: F.instr(F.lit(cls.alphabet), ch) - 1)

    # Codes first, so that no step of a window derives them again.
    d = d.withColumn(name, F.transform(name, lambda x: F.struct(x["start"].alias("start"), codes(x["match"]).alias("codes"))))
    d = d.withColumn(name, F.transform(name, lambda x: F.struct(x["start"].alias("start"), entropy_spans(x["codes"], cls).alias("w"))))

    def span(x: Column) -> Column:
        ends = [(x["start"] + x["w"][k]).alias(v) for k, v in (("lo", "start"), ("hi", "end"))]
        return F.struct(ends[0], F.lit(place).alias("place"), ends[1], F.lit(cls.kind).alias("kind"))

    d = d.withColumn(name, F.transform(F.filter(name, lambda x: x["w"]["lo"].isNotNull()), span))
    # A span is added where no base span meets it, or (``overlapping``) holds it whole.
    meets = lambda x, b: (b["start"] < x["end"]) & (x["start"] < b["end"])
    holds = lambda x, b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])
    drop = holds if overlapping else meets
    return d.withColumn(name, F.filter(name, lambda x: ~F.exists("_base", lambda b: drop(x, b))))


def scan(
    docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, overlapping: bool = False
) -> DataFrame:
    """``docs`` plus an array ``_spans`` of (start, place, end, kind), sorted;
    ``place`` is the kind's place in the order of kinds. With ``overlapping``
    an entropy span stays unless a base span holds it whole."""
    carry = [c for c in docs.columns if c != "_spans"]
    d = docs.select(pack(carry), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = located(d, ASSIGN, "_assign", 2)
    d = located(d, ACCESS, "_access")
    d = located(d, HEX, "_hex")
    d = d.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["grp"]) >= ASSIGN_MIN))

    def spans(name: str, place: int, kind: str) -> Column:
        return F.transform(
            name, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    d = d.withColumn("_base", F.concat(*[spans(f"_{k}", i, k) for i, k in enumerate(KINDS)]))
    for n, cls in enumerate(classes):
        d = _added(d, f"_c{n}", cls, len(KINDS) + n, allow, overlapping)
    added = [f"_c{n}" for n in range(len(classes))]
    d = d.withColumn("_spans", F.sort_array(F.concat("_base", *added)))
    return d.select(*unpack(carry), "_spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping
    spans by one); null texts stay null."""
    d = scan(docs.select(pack(docs.columns), F.col(text).alias("text")), "text", overlapping=True)
    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], F.substr("text", a["pos"] + 1, x["start"] - a["pos"]), F.lit(mark))
        return F.struct(
            F.greatest(a["pos"], x["end"]).alias("pos"), F.when(x["start"] >= a["pos"], more).otherwise(a["out"]).alias("out")
        )

    cleaned = F.aggregate("_spans", begin, step, lambda a: F.concat(a["out"], F.substr("text", a["pos"] + 1)))
    out = F.when(F.size("_spans") > 0, cleaned).otherwise(F.col("text")).alias(text)
    return d.select(*[out if c == text else old for c, old in zip(docs.columns, unpack(docs.columns))])
