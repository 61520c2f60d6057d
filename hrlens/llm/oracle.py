"""Cross-check SQL (DuckDB) of the queries that SQL can express, written by
other means than the operators where there are any."""

from __future__ import annotations

from hrlens.llm.divergence import CLASSES as CLASS_NAMES
from hrlens.llm.divergence import LANGS, LETTERS, WORD_LIST, Rules
from hrlens.llm.secret_entropy import ALLOW, CLASSES, weight

_SPACE = "[\\x20\\x09-\\x0D]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Top 5 by brute force over all pairs.
OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
    "[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def _found(kind: str, place: int, pattern: str, least: int, group: int = 0) -> str:
    """(doc_id, kind, place, start, end, match) of the matches of a pattern of
    ``least`` characters or more: positions by running sums of lengths."""
    p = _quoted(pattern)
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, ends - length(m) AS start, ends AS stop, m FROM (
    SELECT doc_id, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (
      SELECT doc_id, unnest(string_split_regex(t, {p})[:-2]) AS gap, unnest(regexp_extract_all(t, {p})) AS m,
             unnest(regexp_extract_all(t, {p}, {group})) AS g, unnest(range(len(regexp_extract_all(t, {p})))) AS i FROM d))
  WHERE length(g) >= {least}"""


_WEIGHTS = "[" + ", ".join(str(weight(c)) for c in range(max(x.window for x in CLASSES) + 1)) + "]"


def _entropy(n: int) -> str:
    """Spans of a character class: every window's counts taken anew."""
    c = CLASSES[n]
    text = "lower(m)" if c.fold else "m"
    allowed = " AND ".join(f"NOT regexp_matches(m, {_quoted(p)})" for p in ALLOW)
    return f"""
c{n} AS (SELECT doc_id, start, m FROM ({_found(c.kind, 3 + n, f"[{c.chars}]+", c.window)}) WHERE {allowed}),
w{n} AS (SELECT doc_id, start, i, substr({text}, i + 1, {c.window}) AS w
         FROM (SELECT doc_id, start, m, unnest(range(length(m) - {c.window} + 1)) AS i FROM c{n})),
k{n} AS (SELECT doc_id, start, i, ch, count(*) AS k FROM (SELECT doc_id, start, i, unnest(string_split(w, '')) AS ch FROM w{n}) GROUP BY ALL),
h{n} AS (SELECT doc_id, start, i FROM k{n} GROUP BY ALL HAVING sum({_WEIGHTS}[k + 1]) <= {c.most}),
e{n} AS (SELECT doc_id, '{c.kind}' AS kind, {3 + n} AS place, start + min(i) AS start, start + max(i) + {c.window} AS stop
         FROM h{n} GROUP BY doc_id, h{n}.start)"""


OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_found("assign", 0, _ASSIGN, 8, 2)}
  UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", 16)}
  UNION ALL {_found("hex", 2, "[0-9a-f]+", 32)}),
{",".join(_entropy(n) for n in range(len(CLASSES)))},
added AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM e{n}" for n in range(len(CLASSES)))}) e
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)),
spans AS (SELECT doc_id, kind, place, start, stop FROM base UNION ALL SELECT * FROM added)
SELECT d.doc_id,
       CAST(count(*) FILTER (place = 0) AS BIGINT) AS n_assign,
       CAST(count(*) FILTER (place = 1) AS BIGINT) AS n_access,
       CAST(count(*) FILTER (place = 2) AS BIGINT) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place)
              FILTER (place < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place)
              FILTER (place IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

_R = Rules()


def _count(chars: str) -> str:
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"


def _left_out(key: str) -> str:
    """Class distance of the documents without a listed language to all others of the key."""
    return f"""
{key}_sum AS (SELECT {key}, bin, sum(k) AS s, count(*) AS docs FROM class_counts JOIN apart USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
{key}_rest AS (SELECT doc_id, bin, k, s - k * own AS s, docs - own AS docs, sum(s - k * own) OVER (PARTITION BY doc_id) AS total
  FROM apart JOIN {key}_sum USING ({key}) JOIN class_counts USING (doc_id, bin)),
{key}_js AS (SELECT doc_id, sqrt(greatest(sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS js
  FROM (SELECT doc_id, k / chars AS p, s / total AS q FROM {key}_rest JOIN words_of USING (doc_id)
        WHERE chars > 0 AND docs >= {_R.least_docs} AND total >= {_R.least_chars}) GROUP BY doc_id)"""


def _divergence(counts: str, total: str, name: str) -> str:
    """Distance of each document's histogram to the nearest language's."""
    return f"""
{name}_ref AS (SELECT lang, bin, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS q
  FROM {counts} JOIN d USING (doc_id) WHERE lang IN (SELECT lang FROM known) GROUP BY lang, bin),
{name}_js AS (SELECT doc_id, lang, sqrt(greatest(sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS js
  FROM (SELECT doc_id, lang, k / {total} AS p, q FROM {counts} JOIN {name}_ref USING (bin) JOIN words_of USING (doc_id) WHERE {total} > 0)
  GROUP BY doc_id, lang),
{name}_near AS (SELECT doc_id, min(js) AS js FROM {name}_js GROUP BY doc_id)"""


OP6 = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w
  FROM documents),
words_of AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars FROM d),
tokens AS (SELECT doc_id, unnest(w) AS word FROM d),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
class_counts AS (SELECT doc_id, unnest(['lower', 'upper', 'digit', 'letter', 'symbol', 'punctuation', 'other']) AS bin,
    unnest([a, b, c, l - a - b, s, p, chars - l - c - s - p]) AS k FROM (
  SELECT doc_id, chars, {_count("a-z")} AS a, {_count("A-Z")} AS b, {_count("0-9")} AS c, {_count("\\p{L}\\p{M}")} AS l,
         {_count("#*$%&|<>")} AS s, {_count(".,;:!?''\"()\\-")} AS p FROM d JOIN words_of USING (doc_id))),
seen AS (SELECT doc_id, CASE WHEN lower(word) IN ({", ".join(_quoted(x) for x in WORD_LIST)}) THEN lower(word) ELSE '' END AS bin, count(*) AS k
  FROM tokens GROUP BY ALL),
word_counts AS (SELECT doc_id, bin, coalesce(k, 0) AS k
  FROM (SELECT doc_id, unnest([{", ".join(_quoted(x) for x in [*WORD_LIST, ""])}]) AS bin FROM words_of) LEFT JOIN seen USING (doc_id, bin)),
known AS (SELECT lang FROM d JOIN words_of USING (doc_id) WHERE lang IN ({", ".join(_quoted(x) for x in LANGS)})
  GROUP BY lang HAVING count(*) > {_R.least_docs} AND sum(chars) >= {_R.least_chars}),
kinds AS (SELECT doc_id, CASE WHEN kind IN ({", ".join(_quoted(x) for x in LETTERS)}) THEN kind END AS kind
  FROM (SELECT doc_id, arg_max(bin, 10 * k - list_position([{", ".join(_quoted(x) for x in CLASS_NAMES)}], bin)) AS kind FROM class_counts GROUP BY doc_id)),
apart AS (SELECT doc_id, lang, kind, (lang IS NOT NULL)::INT AS own FROM d JOIN kinds USING (doc_id)
  WHERE lang IS NULL OR lang NOT IN (SELECT lang FROM known)),
{_left_out("lang")},
{_left_out("kind")},
{_divergence("class_counts", "chars", "class")},
{_divergence("word_counts", "n", "word")},
judged AS (SELECT w.doc_id, w.n, w.chars, coalesce(l.k, 0) AS dup, coalesce(r.k, 0) AS rep, least(c.js, coalesce(lj.js, kj.js)) AS cj,
    CASE WHEN a.doc_id IS NULL THEN j.js END AS wj, s.k AS sym,
    n < {_R.base_min_words} OR 100 * coalesce(r.k, 0) > {_R.base_repeat_percent} * n AS failed
  FROM words_of w LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)
  LEFT JOIN class_near c USING (doc_id) LEFT JOIN word_near j USING (doc_id)
  LEFT JOIN lang_js lj USING (doc_id) LEFT JOIN kind_js kj USING (doc_id) LEFT JOIN apart a USING (doc_id)
  JOIN (SELECT doc_id, k FROM class_counts WHERE bin = 'symbol') s USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(sym AS BIGINT) AS n_symbols,
       CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed
       AND NOT coalesce(chars >= {_R.min_class_chars} AND cj > {_R.class_bound[0]} + {_R.class_bound[1]} / sqrt(chars), FALSE)
       AND NOT coalesce(n >= {_R.min_words} AND wj > {_R.word_bound[0]} + {_R.word_bound[1]} / sqrt(n), FALSE) AS kept
FROM judged
"""

# Records as the archive must hold them.
OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT *, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS best FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM m
"""

# All pairs that share a shingle, and reachability by recursion.
OP9 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o.k >= 90 * (x.k + y.k - o.k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

# crc32 bit by bit; every prefix of every conversation as a list of turns.
OP11 = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), c AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(list_concat([4294967295],
           list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
           lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) % 6 AS h
  FROM c, crc
), r AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.s, []), 1, h), list_slice(h.s, h + 1, len(h.s))) AS s
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100
), n AS (
  SELECT conv_id, d, list_slice(s, 1, d) AS k, len(s) = d AS ends
  FROM r, unnest(range(0, len(s) + 1)) AS u(d)
), g AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM n GROUP BY k, d
), q AS (
  SELECT p.k, p.d, count(*) AS n_children FROM g JOIN g p ON p.d = g.d - 1 AND p.k = list_slice(g.k, 1, g.d - 1)
  GROUP BY p.k, p.d
), u AS (
  SELECT list_slice(g.k, 1, a) AS k, a AS d, count(*) FILTER (WHERE q.k IS NULL) AS n_leaves,
         sum(CASE WHEN g.d > 0 THEN (g.n_convs - 1) * length(g.k[g.d].x) ELSE 0 END) AS saved_tokens
  FROM g LEFT JOIN q ON q.d = g.d AND q.k = g.k, unnest(range(0, g.d + 1)) AS v(a) GROUP BY 1, 2
)
SELECT g.conv_id, g.d AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN u ON u.d = g.d AND u.k = g.k
LEFT JOIN q ON q.d = g.d AND q.k = g.k
LEFT JOIN g p ON p.d = g.d - 1 AND p.k = list_slice(g.k, 1, g.d - 1)
"""

SQL = {
    "op3_top_k": OP3,
    "op5_secret_scan": OP5,
    "op6_quality_rules": OP6,
    "op7_warc": OP7,
    "op9_jaccard_join": OP9,
    "op11_prefix_trie": OP11,
}
