"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5 = rf"""
WITH d AS (SELECT doc_id, {WORDS.format(text="lower(coalesce(text, ''))")} AS w FROM documents),
it AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {WORDS.format(text="lower(coalesce(text, ''))")} AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM it)),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
widths AS (SELECT DISTINCT k FROM it),
doc_shingles AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN widths WHERE len(w) >= k)),
found AS (SELECT doc_id, item_id, count(*) AS n_found FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_found, round(n_found / n_item, 6) AS containment
FROM found JOIN sizes USING (item_id) WHERE n_found / n_item >= 0.8
"""

_CLASSES = ("upper", "lower", "letter", "number", "punct", "space", "other")


def _half(p: str, q: str) -> str:
    side = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END"
    return f"(({side(p)}) + ({side(q)})) / 2"


def _op3() -> str:
    def count(pattern: str) -> str:
        return f"length(regexp_replace(text, '[^{pattern}]+', '', 'g'))"

    shares = ", ".join(f"sum({c}_n) / sum(chars) AS ref_{c}" for c in _CLASSES)
    char_js = " + ".join(_half(f"({c}_n / chars)", f"ref_{c}") for c in _CLASSES)
    other_p, other_q = "greatest(0, 1 - coalesce(p_used, 0))", "greatest(0, 1 - coalesce(common_share, 0))"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS.format(text="coalesce(text, '')")} AS w, row_number() OVER () AS r FROM documents),
pos AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM pos),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) >= 2),
covered AS (SELECT DISTINCT r, i + k AS p FROM win JOIN twice USING (r, g) CROSS JOIN (VALUES (0), (1), (2)) AS ks(k)),
rep AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT r, doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(text) AS chars, {count(r'\p{Lu}')} AS upper_n, {count(r'\p{Ll}')} AS lower_n, {count(r'\p{L}')} - {count(r'\p{Lu}')} - {count(r'\p{Ll}')} AS letter_n,
    {count(r'\p{N}')} AS number_n, {count(r'\p{P}')} AS punct_n, length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS space_n
  FROM t LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
mm AS (SELECT *, chars - upper_n - lower_n - letter_n - number_n - punct_n - space_n AS other_n FROM m),
cref AS (SELECT lang AS cl, {shares} FROM mm GROUP BY lang),
uw AS (SELECT r, lang, unnest(w) AS word FROM t),
wc AS (SELECT lang, word, count(*) AS n FROM uw GROUP BY lang, word),
wt AS (SELECT lang, sum(n) AS total FROM wc GROUP BY lang),
wref AS (SELECT wc.lang, wc.word, wc.n / wt.total AS q FROM wc JOIN wt ON wc.lang IS NOT DISTINCT FROM wt.lang WHERE wc.n * 512 >= wt.total),
held AS (SELECT lang AS hl, sum(q) AS common_share, count(*) AS bins FROM wref GROUP BY lang),
hit AS (SELECT uw.r, uw.word, count(*) AS hits, any_value(q) AS q FROM uw JOIN wref ON uw.word = wref.word AND uw.lang IS NOT DISTINCT FROM wref.lang GROUP BY uw.r, uw.word),
hp AS (SELECT hit.r, hits / n_words AS p, q FROM hit JOIN mm USING (r)),
used AS (SELECT r, sum(p) AS p_used, sum(q) AS q_used, sum({_half('p', 'q')}) AS js_used FROM hp GROUP BY r),
j AS (
  SELECT mm.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce(bins, 0) AS bins,
    CASE WHEN chars > 0 THEN {char_js} END AS char_js,
    CASE WHEN n_words > 0 THEN coalesce(js_used, 0) + (coalesce(common_share, 0) - coalesce(q_used, 0)) / 2 + {_half(other_p, other_q)} END AS word_js
  FROM mm LEFT JOIN used USING (r) LEFT JOIN cref ON lang IS NOT DISTINCT FROM cl LEFT JOIN held ON lang IS NOT DISTINCT FROM hl)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(CASE WHEN char_js IS NULL THEN NULL ELSE sqrt(greatest(char_js, 0)) END, 6) AS char_distance,
  round(CASE WHEN word_js IS NULL THEN NULL ELSE sqrt(greatest(word_js, 0)) END, 6) AS word_distance,
  NOT base_failed AND NOT (coalesce(word_chars >= 200 AND sqrt(greatest(char_js, 0)) > 0.27, false)
    OR coalesce(n_words >= 50 AND sqrt(greatest(word_js - bins / (8 * ln(2) * n_words), 0)) > 0.45, false)) AS kept
FROM j
"""


def _op2(source: str) -> str:
    return r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS r FROM {source}),
ls AS (SELECT r, string_split_regex(text, '\r?\n') AS l FROM m),
lines AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM ls),
lv AS (SELECT r, i, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS body FROM lines),
ch AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY i) IS DISTINCT FROM level THEN 1 ELSE 0 END AS fresh, coalesce(lead(level) OVER (PARTITION BY r ORDER BY i), 0) AS next_level FROM lv),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM ch),
passages AS (SELECT r, level, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY i)), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM rn WHERE level > 0 GROUP BY r, run, level),
mine AS (SELECT *, level = 0 AND NOT (next_level > 0 AND regexp_matches(body, '(?i)(wrote|writes|said|écrit|schrieb|escribió)[ \t]*:[ \t]*$')) AS mine FROM rn),
kept AS (SELECT r, string_agg(body, chr(10) ORDER BY i) FILTER (mine) AS own, string_agg(CASE WHEN mine THEN body ELSE '' END, chr(10) ORDER BY i) AS broken FROM mine GROUP BY r),
own AS (SELECT m.*, regexp_replace(coalesce(kept.own, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS own, coalesce(kept.broken, '') AS broken FROM m LEFT JOIN kept USING (r)),
said AS (SELECT conv_id, turn, trim(regexp_replace(lower(own), '[\x20\x09-\x0D]+', ' ', 'g')) AS said FROM own WHERE turn IS NOT NULL),
pieces AS (
  SELECT conv_id, turn, own AS u FROM own
  UNION ALL SELECT conv_id, turn, unnest(string_split_regex(broken, '\n[\x20\x09-\x0D]*\n')) FROM own
  UNION ALL SELECT conv_id, turn, unnest(string_split(broken, chr(10))) FROM own),
units AS (SELECT conv_id, trim(regexp_replace(lower(u), '[\x20\x09-\x0D]+', ' ', 'g')) AS u, min(turn) AS unit_of FROM pieces GROUP BY ALL),
parts AS (SELECT m.conv_id, p.text AS u, min(said.turn) AS part_of FROM passages p JOIN m USING (r) JOIN said ON said.conv_id IS NOT DISTINCT FROM m.conv_id
  AND contains(' ' || said.said || ' ', ' ' || p.text || ' ') GROUP BY ALL),
links AS (SELECT p.r, m.conv_id, m.turn, p.level, coalesce(CASE WHEN units.unit_of < m.turn THEN units.unit_of END, CASE WHEN parts.part_of < m.turn THEN parts.part_of END) AS original
  FROM passages p JOIN m USING (r) LEFT JOIN units ON units.conv_id IS NOT DISTINCT FROM m.conv_id AND units.u = p.text
  LEFT JOIN parts ON parts.conv_id IS NOT DISTINCT FROM m.conv_id AND parts.u = p.text WHERE p.text <> ''),
lowest AS (SELECT conv_id, turn, min(level) AS level FROM links WHERE original IS NOT NULL GROUP BY conv_id, turn),
replies AS (SELECT l.conv_id, l.turn, max(l.original) AS parent FROM links l JOIN lowest w ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.turn = w.turn AND l.level = w.level WHERE l.original IS NOT NULL GROUP BY l.conv_id, l.turn),
tops AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth, true AS open FROM replies
  UNION ALL SELECT t.conv_id, t.turn, p.parent, t.depth + 1, true FROM tops t JOIN replies p ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.turn = t.root),
top AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM tops GROUP BY conv_id, turn),
counts AS (SELECT r, count(*) AS n_passages, count(original) AS n_linked FROM links GROUP BY r),
rows_ AS (SELECT o.conv_id, o.turn, o.role, o.own AS own_text, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, replies.parent AS parent_turn, coalesce(top.root, o.turn) AS thread_turn, coalesce(top.depth, 0) AS depth
  FROM own o LEFT JOIN counts USING (r) LEFT JOIN replies ON replies.conv_id IS NOT DISTINCT FROM o.conv_id AND replies.turn = o.turn LEFT JOIN top ON top.conv_id IS NOT DISTINCT FROM o.conv_id AND top.turn = o.turn)
SELECT conv_id, turn, role, own_text, n_passages, n_linked, parent_turn, thread_turn, CAST(depth AS BIGINT) AS depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST) - 1 AS position
FROM rows_
""".replace("{source}", source)


#: Messages that quote the one before: its third to twelfth words, or its whole text and what that may quote, line by line.
REPLIES = r"""(
  SELECT conv_id, turn, role, CASE
    WHEN before IS NULL THEN text
    WHEN turn % 3 = 1 THEN '> ' || array_to_string(string_split(replace(before, chr(10), ' '), ' ')[3:12], ' ') || chr(10) || text
    WHEN turn % 3 = 2 THEN 'One wrote:' || chr(10) || '> ' || replace(before, chr(10), chr(10) || '> ') || chr(10) || text
    ELSE '>> ' || replace(before, chr(10), chr(10) || '>> ') || chr(10) || text || chr(10) || '> no such words were ever said' END AS text
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations))"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


#: kind, pattern, number of the group whose length counts, least length; letters of the first in either case are spelled out, as (?i) takes more than a-z.
SECRETS = (
    ("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("login", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x09-\x0D\x20/:@]+:[^\x09-\x0D\x20/:@]+@", 0, 0),
)


def _op12() -> str:
    def of(place: int, kind: str, pattern: str, group: int, least: int) -> str:
        return f"""
  SELECT r, {place} AS place, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n
  FROM (SELECT r, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM t WHERE regexp_matches(text, '{pattern}')))
  WHERE length(regexp_extract(ms[i], '{pattern}', {group})) >= {least}"""

    every = " UNION ALL ".join(of(k, *secret) for k, secret in enumerate(SECRETS))
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in SECRETS[:3])
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in SECRETS[:3])
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
m AS ({every}),
g AS (SELECT r, {counts}, coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, place) FILTER (place < 3), '') AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, place) AS spans, count(*) FILTER (place >= 3) AS n_added FROM m GROUP BY r)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added FROM t LEFT JOIN g USING (r)
"""


OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN low < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT *, contains(fails, f) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM c, steps),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM j GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
""".replace("{words}", WORDS.format(text="text"))

ORACLE: dict[str, str] = {"op2_quote_linking": _op2("conversations"), "op2_quoted_replies": _op2(REPLIES), "op3_divergence_rules": _op3(), "op5_containment_search": OP5, "op12_blob_ledger": _op12(), "op13_filter_audit": OP13}
