"""Prefix trie, repeated passages and periodic runs against brute force, with
nulls, empty and long texts, repeated rows, empty tables and columns of
clashing names; and the cross-check SQL of this subpackage's queries."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from hrlens.llm import periodic_runs, prefix_trie, queries, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
TURN = "conv_id long, turn long, role string, text string"


def by_nulls(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


# --- prefix trie -----------------------------------------------------------


def brute_trie(rows):
    """Every prefix as a key of a dictionary."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[c].append((t is not None, t or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(int)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = turns.get(c - int(math.fmod(c, 100)), [])
        seq = tuple(base[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest))
    return sorted(out, key=by_nulls)


def trie_rows(df):
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(df)))
    return sorted((tuple(r) for r in nodes.select(NODE).collect()), key=by_nulls)


@pytest.mark.parametrize("block", [400_000, 100])
def test_trie_against_brute_force(spark, monkeypatch, block):
    """Nulls in every column, ties, repeated rows, conversations without base
    and without turns, copies, and blocks of one path."""
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    r = random.Random(block)
    rows = []
    for c in r.sample(range(-50, 900), 60):
        for t in range(r.choice([0, 1, 2, 3, 8])):
            rows.append((c if r.random() > 0.03 else None, t if r.random() > 0.1 else None, r.choice(["u", "a", None]), r.choice(["x", "yy", "", None, "é"])))
    rows += [(c, t, "u", f"same {t}") for c in range(1000, 1040) for t in range(3)]
    rows += [(2000, 0, "u", "z")] * 2
    rows += [(3001, t, "a", "t" * t) for t in range(300)]
    assert trie_rows(spark.createDataFrame(rows, TURN)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], TURN)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "u", "x")], TURN)) == []


def test_trie_on_given_data(spark, sf01):
    df = spark.read.parquet(f"{sf01}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = df.selectExpr("conv_id", "turn", "role", "text", "1 AS node", "2 AS path", "3 AS _base")
    want = brute_trie([tuple(r) for r in df.collect()])
    assert trie_rows(df) == want
    assert trie_rows(extra) == want


def test_reach_and_minimum():
    """Each extent and minimum alone against a scan."""
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        v = r.integers(0, 5, n)
        table = prefix_trie._table(v)
        at = np.repeat(np.arange(n), 6)
        depth = np.tile(np.arange(6), n)
        want = [next((k for k in range(n - a) if v[a + k] < d), n - a) for a, d in zip(at, depth, strict=True)]
        assert prefix_trie._reach(table, at, depth).tolist() == want
        a, b = np.triu_indices(n)
        assert prefix_trie._minimum(table, a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b, strict=True)]


# --- repeated passages -----------------------------------------------------


def brute_repeats(rows, length, first):
    starts = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for d, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            starts[b[i : i + length]].append((d, i))
    covered = [bytearray(len(b)) for b in texts]
    for places in starts.values():
        least = min(places, key=lambda x: (rows[x[0]][0], x[1]))
        for d, i in places if len(places) > 1 else []:
            if not first or (d, i) != least:
                covered[d][i : i + length] = b"\1" * length
    out = []
    for (k, _), b, c in zip(rows, texts, covered, strict=True):
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(c))]
        out.append((k, len(b), spans, bytes(x for x, y in zip(b, c, strict=True) if not y)))
    return sorted(out, key=lambda x: by_nulls(x[:1]))


def repeat_rows(df, rules, keep):
    rows = repeats.without(df, rules, keep).select("doc_id", "_repeats.*").collect()
    out = [(r.doc_id, r.n_bytes, [(x.start, x.stop) for x in r.spans], bytes(r.kept)) for r in rows]
    return sorted(out, key=lambda x: by_nulls(x[:1]))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("group, stretch", [(1000, 1 << 19), (3, 300)])
def test_repeats_against_brute_force(spark, monkeypatch, keep, group, stretch):
    """Shared passages, copies, periodic texts, bytes within characters, and
    groups above the bound that one task sorts."""
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    r = random.Random(group)
    base = ["".join(r.choice("abé ") for _ in range(90)) for _ in range(6)]
    rows = [
        (k, "".join(r.choice([*base, "x" * r.randrange(40), "ab" * r.randrange(30), str(k) * 3])[r.randrange(3) :] for _ in range(r.randrange(6))))
        for k in range(100)
    ]
    rows += [(200, None), (201, ""), (202, "q" * 3000), (203, rows[3][1]), (204, "no copy of this one is anywhere at all in here")]
    rules = repeats.Repeats(length=40, core=12, group=group)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeat_rows(df, rules, keep) == brute_repeats(rows, 40, keep == "first")


def test_repeats_odd_rows(spark):
    """A null id, an id with two texts, repeated rows and columns of the
    operator's own names."""
    a, b = "abcdefghij" * 3 + "klmnopqrst", "0123456789" * 4 + "unlike"
    rows = [(None, a, "1", 1), (5, b, "2", 2), (5, a, "3", 3), (7, "only here, and so it stays in", "4", 4), (7, "only here, and so it stays in", "4", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string, core int")
    out = repeats.without(df, repeats.Repeats(length=20, core=8)).collect()
    assert len(out) == 5 and out[0].__fields__ == ["doc_id", "text", "th", "core", "_repeats"]
    want = {k: (s, t) for (_, _, s, t), (k) in zip(brute_repeats([(i, x[1]) for i, x in enumerate(rows)], 20, False), range(5), strict=True)}
    got = sorted(((r.text, r.th, [(x.start, x.stop) for x in r._repeats.spans], bytes(r._repeats.kept)) for r in out), key=str)
    assert got == sorted(((x[1], x[2], *want[i]) for i, x in enumerate(rows)), key=str)


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without(df).collect() == []
    with pytest.raises(ValueError):
        repeats.without(df, keep="last")


def test_longest_previous_factors():
    """Every suffix's longest earlier and later match against a scan."""
    r = random.Random(4)
    for _ in range(30):
        text = bytes(r.choice(b"ab") for _ in range(r.randrange(20, 70)))
        depth = 12
        starts = np.arange(len(text) - depth + 1)
        order, lcp = repeats.sorted_suffixes(np.frombuffer(text, np.uint8), starts, depth)
        earlier, later = repeats.factors(order, lcp)

        def common(i, j, text=text, depth=depth):
            return next((k for k in range(depth) if text[i + k] != text[j + k]), depth)

        assert earlier.tolist() == [max((common(i, j) for j in starts[:i]), default=0) for i in starts]
        assert later.tolist() == [max((common(i, j) for j in starts[i + 1 :]), default=0) for i in starts]


def test_repeats_on_given_data(spark, sf001):
    df = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_suffix_dedup(spark, sf001).collect()}
    for k, n, spans, kept in brute_repeats(rows, 200, False):
        assert got[k] == (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


# --- periodic runs ---------------------------------------------------------


def brute_runs(w, least=6, exponent=4):
    out = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - start + p >= max(least, exponent * p):
                out.setdefault((start, i - start + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in out.items())


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_against_brute_force():
    r = random.Random(7)
    words = []
    for _ in range(600):
        n, k = r.choice([0, 1, 5, 6, 7, 20, 60, 200]), r.choice([1, 2, 2, 3, 5, 50])
        w = [b"%d" % r.randrange(k) for _ in range(n)]
        if n > 5 and r.random() < 0.4:
            a = r.randrange(n)
            p = r.randrange(1, max(2, (n - a) // 3 + 1))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        words.append(w)
    for rules in (periodic_runs.Runs(), periodic_runs.Runs(least=2, exponent=2), periodic_runs.Runs(least=10, exponent=3)):
        runs, texts = periodic_runs._answers(words, rules)
        for w, got, text in zip(words, runs, texts, strict=True):
            want = brute_runs(w, rules.least, rules.exponent)
            assert [tuple(x) for x in got.tolist()] == want
            assert text == collapsed([x.decode() for x in w], want)


def test_extensions_against_a_scan():
    r = np.random.default_rng(3)
    for n, k in ((5, 2), (200, 2), (400, 1), (300, 40)):
        seq = np.concatenate([r.integers(0, k, n), [-1], np.tile(r.integers(0, k, 37), 6), [-2]])
        i, j = np.triu_indices(len(seq), 1)
        pick = r.integers(0, len(i), min(len(i), 3000))
        i, j = i[pick], j[pick]
        want = [next((x for x in range(len(seq) - b) if seq[a + x] != seq[b + x]), len(seq) - b) for a, b in zip(i, j, strict=True)]
        assert periodic_runs.Extensions(seq)(i, j).tolist() == want


def test_long_periodic_texts_take_no_quadratic_time():
    runs, texts = periodic_runs._answers([[b"a"] * 50_000, [b"a", b"b", b"c"] * 20_000], periodic_runs.Runs())
    assert [x.tolist() for x in runs] == [[[0, 50_000, 1]], [[0, 60_000, 3]]] and texts == ["a", "a b c"]


def want_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *strongest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def test_runs_query_against_brute_force(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf001).collect()}
    assert got == {r.doc_id: want_row(r.doc_id, r.text) for r in rows}
    assert sum(x[1] > 0 for x in got.values()) > 5


def test_runs_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names, no rows."""
    long = "one two three " * 20_000
    rows = [(None, "a b " * 9, 1), (2, None, 2), (3, "", 3), (4, " \n\t", 4), (5, long, 5), (5, long, 5), (7, "a\x0bb\x1cb\x85c d", 6)]
    rows += [(k, "x y z " * 40 + str(k), k) for k in range(20, 90)]  # some of them are made periodic
    df = spark.createDataFrame(rows, "doc_id long, text string, _runs int")
    out = periodic_runs.with_runs(df.withColumnRenamed("_runs", "n_words")).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in out) == sorted((x[0] or 0, x[2]) for x in rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=by_nulls)
    assert got == sorted((want_row(x[0], x[1]) for x in rows), key=by_nulls)
    assert periodic_runs.with_runs(df.limit(0)).collect() == []


# --- cross-check SQL -------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf001, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    df = queries.queries()[name](spark, sf001)
    cols = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=by_nulls)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=by_nulls) == theirs


# --- hashes of the Jaccard join --------------------------------------------


def test_words_that_polynomials_take_for_equal_are_not_linked(spark):
    """Thue-Morse words collide under any polynomial modulo 2^64."""
    from hrlens.llm import jaccard_join

    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{word} one two"), (2, f"{other} one two"), (3, f"{word.upper()} one two")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
