"""Quality rules by distribution divergence, as DataFrame expressions only.

Each document gives two histograms: characters by class, and its words by a
fixed list of common function words (the rest in one bin). References are the
same histograms summed over all documents of a language. A document whose
Jensen-Shannon distance to the nearest reference is above a bound is rejected,
provided it is long enough for its histogram to mean anything.

The languages with a word list (``COMMON_WORDS``) are judged by both
histograms, against the references of all of these. A document of any other
language is held to character classes only: to the nearest of those and of the
reference of its own language, from the other documents of it; where these are
too few, from all such documents that consist of the same kind of letter. A
document never counts towards its own reference. References need
``least_docs`` documents and ``least_chars`` characters; a listed language
with fewer is treated as unlisted.

Cases: null or empty text counts as a text without words (``base_failed``);
documents whose language is null are held to the nearest reference and the
letters' own; where a table has no reference, only the base rules decide (these count words by white space, so texts of scripts without it have
few); repeated rows are judged alike; other columns pass
through untouched by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.common import SPACE_CLASS, SPACES, pack, stored, unpack

# Common function words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in is that it was for on are with as be at by this from or an a",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
}
LANGS = sorted(COMMON_WORDS)
WORD_LIST = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()})

# Symbols counted by the base rules, and sentence punctuation.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

# Character classes in the order in which they are taken out of a text.
CLASS_PATTERNS = [
    ("lower", "[a-z]+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("letter", "[\\p{L}\\p{M}]+"),
    ("symbol", "[#*$%&|<>]+"),
    ("punctuation", "[.,;:!?'\"()\\-]+"),
]
CLASSES = [name for name, _ in CLASS_PATTERNS] + ["other"]


@dataclass(frozen=True)
class Rules:
    """Bounds of the verdict.

    ``class_bound`` / ``word_bound``: (a, b) of the largest Jensen-Shannon
    distance (base 2, so 0 to 1) to the nearest language reference,
    a + b / sqrt(n) for a histogram of n characters or words: the distance of
    n draws from the reference itself falls as 1 / sqrt(n).
    ``least_docs`` / ``least_chars``: what a reference is made of at least,
    beside the document that is judged.
    ``min_class_chars`` / ``min_words``: shorter texts are not judged by the
    histogram.
    """

    base_min_words: int = 20
    base_repeat_percent: int = 30
    class_bound: tuple[float, float] = (0.17, 2.5)
    word_bound: tuple[float, float] = (0.12, 2.2)
    min_class_chars: int = 200
    min_words: int = 60
    least_docs: int = 20
    least_chars: int = 10_000


def features(docs: DataFrame, text: str, lang: str, carry: list[str]) -> DataFrame:
    """body (the columns ``carry``), lang, and a struct ``_f`` with the base
    counts and both histograms."""
    d = docs.select(pack(carry), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_r0", F.translate("_t", SPACES, ""))
    for i, (_, pattern) in enumerate(CLASS_PATTERNS):
        d = d.withColumn(f"_r{i + 1}", F.regexp_replace(f"_r{i}", pattern, ""))
    lengths = [F.length(f"_r{i}").cast("long") for i in range(len(CLASS_PATTERNS) + 1)]
    classes = F.array(*[a - b for a, b in zip(lengths, lengths[1:])], lengths[-1])

    d = d.withColumn("_w", F.filter(F.split("_t", f"{SPACE_CLASS}+"), lambda w: w != ""))
    d = d.withColumn("_hw", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    window = lambda i: F.xxhash64(*[F.get("_hw", i + k) for k in range(8)])
    none = F.array().cast("array<bigint>")
    d = d.withColumn("_win", F.when(n >= 8, F.transform(F.sequence(F.lit(0), n - 8), window)).otherwise(none))
    # Windows that occur again: sorted by hash, equal ones are neighbours.
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    d = d.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, j: F.coalesce(F.get("_s", j)["h"] == s["h"], F.lit(False))
    d = d.withColumn("_again", F.transform("_s", lambda s, j: F.when(same(s, j - 1) | same(s, j + 1), s["i"])))
    d = d.withColumn("_pos", F.sort_array(F.filter("_again", lambda p: p.isNotNull())))
    # Windows overlap: each start covers the words up to the next start, 8 at most.
    covered = F.aggregate(
        F.transform("_pos", lambda p, j: F.least(F.lit(8), F.coalesce(F.get("_pos", j + 1) - p, F.lit(8)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))

    known = F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: w.isin(WORD_LIST))
    d = d.withColumn("_k", F.transform(known, lambda w: F.array_position(F.lit(WORD_LIST), w).cast("int")))
    bins = [F.size("_k") - F.size(F.array_remove("_k", F.lit(i + 1))) for i in range(len(WORD_LIST))]
    common = F.array(*[b.cast("long") for b in bins], (n - F.size("_k")).cast("long"))
    made = F.struct(
        n.cast("long").alias("n_words"),
        lengths[0].alias("word_chars"),
        (lengths[4] - lengths[5]).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        common.alias("common"),
    )
    return d.select("body", "lang", made.alias("_f"))


def references(counted: DataFrame, rules: Rules) -> list[dict]:
    """Summed histograms of each known language, over all its documents: one
    row for each of ``LANGS`` at most."""
    sizes = {"classes": len(CLASSES), "common": len(WORD_LIST) + 1}
    sums = [
        F.sum(F.col("_f")[name][i].cast("decimal(38,0)")).alias(f"{name}{i}") for name, k in sizes.items() for i in range(k)
    ]
    rows = counted.where(F.col("lang").isin(LANGS)).groupBy("lang").agg(F.count("*").alias("docs"), *sums)
    rows = rows.where(F.col("docs") > rules.least_docs).orderBy("lang").collect()
    out = []
    for r in rows:
        made = {"lang": r["lang"]}
        for name, k in sizes.items():
            v = [int(r[f"{name}{i}"]) for i in range(k)]
            total = sum(v)
            made[name] = [x / total for x in v] if total else None
        if sum(int(r[f"classes{i}"]) for i in range(len(CLASSES))) >= rules.least_chars:
            out.append(made)
    return out


# Classes whose texts are writing: junk of digits or symbols backs no other junk.
LETTERS = ["lower", "upper", "letter"]


def dominant() -> Column:
    """The class that most characters are of, the first of equals."""
    counts = F.col("_f")["classes"]
    return F.get(F.lit(CLASSES), F.array_position(counts, F.array_max(counts)).cast("int") - 1)


def summed(rest: DataFrame, key: str) -> DataFrame:
    """key, {key}_docs, {key}_sums: class counts over all documents of each
    key, those of null language aside."""
    sums = [F.sum(F.col("_f")["classes"][i].cast("decimal(38,0)")).cast("double") for i in range(len(CLASSES))]
    made = rest.where(F.col("lang").isNotNull()).groupBy(key)
    return made.agg(F.count("*").alias(f"{key}_docs"), F.array(*sums).alias(f"{key}_sums"))


def left_out(key: str, rules: Rules) -> Column:
    """Class distance to the documents of a key but for the document itself;
    null where these are too few."""
    counts, chars = F.col("_f")["classes"], F.col("_f")["word_chars"]
    own = F.when(F.col("lang").isNotNull(), 1).otherwise(0)
    docs, sums = F.col(f"{key}_docs") - own, F.zip_with(f"{key}_sums", counts, lambda s, k: s - k * own)
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    enough = (docs >= rules.least_docs) & (total >= rules.least_chars)
    return F.when(enough, js_distance(counts, chars, F.transform(sums, lambda s: s / total)))


def js_distance(counts: Column, total: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance (base 2) of a count histogram, summing to
    ``total``, to a reference."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def term(n: Column, q: Column) -> Column:
        p = n.cast("double") / total
        m = (p + q) / 2
        return part(p, m) + part(q, m)

    terms = F.zip_with(counts, reference if isinstance(reference, Column) else F.lit(reference), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def nearest(counts: Column, total: Column, refs: list[list[float]]) -> Column:
    """Distance to the nearest reference; null if there is none."""
    found = [js_distance(counts, total, r) for r in refs if r]
    if not found:
        return F.lit(None).cast("double")
    return F.least(*found) if len(found) > 1 else found[0]


def judge(
    docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", carry: list[str] | None = None
) -> DataFrame:
    """The columns ``carry`` (default: all) of ``docs`` plus a struct
    ``_quality``: base counts, ``base_failed``, both distances (null where the
    text is too short) and ``kept``. The counts are written once and read for
    the references and for the verdict; so are the sums of the other languages,
    for Spark to see their bytes before it joins them."""
    carry = [c for c in docs.columns if c != "_quality"] if carry is None else carry
    counted = stored(features(docs, text, lang, carry), "features")
    refs = references(counted, rules)
    f = F.col("_f")
    chars, n = f["word_chars"], f["n_words"]
    listed, long = F.coalesce(F.col("lang").isin([r["lang"] for r in refs]), F.lit(False)), chars >= rules.min_class_chars
    class_js = nearest(f["classes"], chars, [r["classes"] for r in refs])
    word_js = nearest(f["common"], n, [r["common"] for r in refs])
    d = counted.withColumn("_cj", F.when(long & listed, class_js)).withColumn("_wj", F.when((n >= rules.min_words) & listed, word_js))
    rest = d.where(~listed).withColumn("kind", F.when(dominant().isin(LETTERS), dominant()))
    if not rest.isEmpty():
        langs = stored(summed(rest, "lang"), "langs")
        kinds = stored(summed(rest.where(F.col("kind").isNotNull()), "kind"), "kinds")
        apart = rest.join(langs, "lang", "left").join(kinds, "kind", "left")
        near = F.coalesce(left_out("lang", rules), left_out("kind", rules))
        # least() passes over nulls.
        apart = apart.withColumn("_cj", F.when(long, F.least(near, class_js)))
        d = d.where(listed).unionByName(apart.select(d.columns))
    failed = (f["n_words"] < rules.base_min_words) | (f["n_repeat_words"] * 100 > f["n_words"] * rules.base_repeat_percent)
    bound = lambda ab, k: F.lit(ab[0]) + F.lit(ab[1]) / F.sqrt(k)
    far = F.coalesce(F.col("_cj") > bound(rules.class_bound, chars), F.lit(False)) | F.coalesce(
        F.col("_wj") > bound(rules.word_bound, n), F.lit(False)
    )
    made = F.struct(
        *[f[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        F.col("_cj").alias("class_distance"),
        F.col("_wj").alias("word_distance"),
        (~failed & ~far).alias("kept"),
    )
    return d.select(*unpack(carry), made.alias("_quality"))


def keep(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns."""
    judged = judge(docs.select(pack(docs.columns), text, lang), rules, text, lang, carry=["body"])
    return judged.where("_quality.kept").select(*unpack(docs.columns))
