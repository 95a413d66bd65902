"""DuckDB SQL for the queries that SQL can express.

The classifier, the HTML trees, the multiset hash, the test battery and the Feistel
network have no SQL here; their tests compare them with brute-force versions.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BLANK_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

# 5 hex digits are 4 digits of base 32
_GROUP = "('0x' || substr(h, 5 * i + 1, 5))::INTEGER"
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((" + _GROUP + " >> {shift}) & 31) + 1, 1)"
_BASE32 = "list_aggregate([" + " || ".join(_DIGIT.format(shift=s) for s in (15, 10, 5, 0)) + " FOR i IN range(0, 8)], 'string_agg', '')"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

OP5 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT r, i, win.n AS n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id"""


def _hash32(parts: str) -> str:
    return f"('0x' || substr(md5({parts}), 1, 8))::BIGINT"


def mixing(block_words: int, shard_slots: int, seed: str, rounds: int, most: int) -> str:
    """The mix, with the same draws and permutations."""
    state = "x0"
    steps = []
    for r in range(rounds):
        key = f"('0x' || substr(md5('mix:' || s || ':{r}'), 1, 10))::BIGINT"
        odd = f"(2 * ({key} % 524288) + 1)"
        low = f"((xor({state}, {key} & mask) * {odd}) & mask)"
        steps.append(f"p{r} AS (SELECT * EXCLUDE ({state}), (CASE WHEN {state} <= mask THEN xor({low}, {low} >> half) ELSE {state} END + {key}) % blocks AS x{r + 1} FROM {'p' + str(r - 1) if r else 'slots'})")
        state = f"x{r + 1}"
    return f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM totals),
capped AS (SELECT *, [1, 2, 3][(s % 3 + 1)::INTEGER] AS w, {most} * source_size AS cap FROM ranked),
ratios AS (SELECT *, cap / w AS ratio FROM capped),
rates AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER (ORDER BY ratio, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS rate FROM ratios),
share AS (SELECT arg_min(rate, (ratio, s)) AS rate FROM rates WHERE ratio >= rate),
sources AS (SELECT source, s, source_size, coalesce(least(cap::DOUBLE, (SELECT rate FROM share) * w), cap::DOUBLE) AS target, ((source_size + {block_words} - 1) // {block_words})::BIGINT AS blocks FROM rates),
live0 AS (SELECT *, target * blocks / source_size AS slots FROM sources WHERE source_size > 0),
live1 AS (SELECT *, greatest(1, ceil(sum(slots) OVER () / {shard_slots}))::BIGINT AS shards FROM live0),
live2 AS (SELECT *, floor(slots / shards)::BIGINT AS whole, slots / shards - floor(slots / shards) AS part FROM live1),
live3 AS (SELECT *, sum(part) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, sum(part) OVER () AS total FROM live2),
live AS (SELECT *, hi - part AS lo FROM live3),
head AS (SELECT max(shards) AS shards, max(total) AS total FROM live),
shard AS (SELECT total, unnest(range(0, shards)) AS shard FROM head),
drawn AS (SELECT shard, total, unnest(range(0, (floor((shard + 1) * total + 0.5) - floor(shard * total + 0.5))::BIGINT)) AS i FROM shard),
u AS (SELECT shard, {_hash32(f"'{seed}:' || shard || ':' || i")} / 4294967296.0::DOUBLE * total AS u FROM drawn),
counts0 AS (SELECT s, unnest(range(0, shards)) AS shard, whole AS count FROM live WHERE whole > 0 UNION ALL SELECT s, shard, count(*) FROM u JOIN live ON u >= lo AND u < hi GROUP BY s, shard),
counts AS (SELECT s, shard, sum(count)::BIGINT AS count FROM counts0 GROUP BY s, shard),
starts AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY s ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM counts),
ks AS (SELECT s, unnest(range(start, start + count)) AS k FROM starts),
slots AS (SELECT s, blocks, (1 << (length(bin(blocks)) - 1)::BIGINT) - 1 AS mask, ((length(bin(blocks)) - 1) // 2 + 1)::BIGINT AS half, k % blocks AS x0 FROM ks JOIN live USING (s) WHERE k < {most} * blocks),
{", ".join(steps)},
used AS (SELECT s, {state} AS block, count(*) AS times FROM p{rounds - 1} GROUP BY 1, 2),
n AS (SELECT greatest(1, ceil(sqrt(count(*))))::BIGINT AS n FROM sized),
placed0 AS (SELECT doc_id, size, s, source_size, target, {_hash32("'order:' || coalesce(doc_id::VARCHAR, '')")} % (SELECT n FROM n) AS bucket, row_number() OVER () AS r FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY s ORDER BY bucket, doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS off FROM placed0),
parts AS (SELECT r, s, block, least((block + 1) * {block_words}, off + size) - greatest(block * {block_words}, off) AS words FROM (SELECT r, s, size, off, unnest(range(off // {block_words}, (off + size - 1) // {block_words} + 1)) AS block FROM placed WHERE size > 0)),
taken AS (SELECT r, sum(words * times)::BIGINT AS taken FROM parts JOIN used USING (s, block) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (r)"""


def licenses(templates: dict[str, str], phrases: dict[str, str], k: int, near: int, cover: float) -> str:
    """Phrases and template votes, with the k-grams themselves in place of hashes."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(label)}, {quoted(text)})" for label, text in templates.items())
    places = " UNION ALL ".join(
        f"SELECT r, i - 1 AS start, '{label}' AS label FROM spots WHERE array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'" for label, p in phrases.items()
    )
    gram = f"array_to_string(w[i:i + {k - 1}], ' ')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM_WORDS} AS w FROM documents),
t AS (SELECT label, {_ALNUM_WORDS} AS w FROM (VALUES {values}) v(label, text)),
spots AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
places AS ({places}),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
tg AS (SELECT label, len(w) AS size, i - 1 AS tpos, {gram} AS g FROM (SELECT label, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM t)),
dg AS (SELECT r, i - 1 AS pos, {gram} AS g FROM (SELECT r, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM d)),
cells AS (SELECT r, label, size, pos, tpos, pos - tpos AS diagonal FROM dg JOIN tg USING (g)),
diagonals AS (SELECT DISTINCT r, label, diagonal FROM cells),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) <= {near} THEN 0 ELSE 1 END AS fresh FROM diagonals),
merged AS (SELECT *, sum(fresh) OVER (PARTITION BY r, label ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM fresh),
covered AS (SELECT r, label, span, count(DISTINCT x) / max(size)::DOUBLE AS cover, min(pos) AS a, max(pos) + {k} AS b FROM (SELECT r, label, span, size, pos, unnest(range(tpos, tpos + {k})) AS x FROM cells JOIN merged USING (r, label, diagonal)) GROUP BY r, label, span),
good AS (SELECT * FROM covered WHERE cover >= {cover}),
best AS (SELECT * FROM good x WHERE NOT EXISTS (SELECT 1 FROM good y WHERE y.r = x.r AND y.cover > x.cover AND y.a < x.b AND x.a < y.b)),
own AS (SELECT r, list(DISTINCT label) AS labels, max(cover) AS cover FROM best GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
 CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)"""


def secrets(base: tuple, token: str, alphabets: list[tuple[str, str]], rest: str, kinds: tuple, rate: float, missed: float, decoys: int, least_token: int, bins: int, per_octave: int) -> str:
    """Base spans by splitting at the patterns; the battery and the procedure on the rest."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"

    def matches(kind: str, pattern: str, group: int, least: int, source: str = "d") -> str:
        p = quoted(pattern)
        return f"""SELECT r, i, '{kind}' AS kind, (e - length(x))::BIGINT AS a, e::BIGINT AS b, v FROM (
 SELECT r, i, x, v, sum(length(y) + length(x)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM (
  SELECT r, i, ys[i] AS y, xs[i] AS x, vs[i] AS v FROM (SELECT r, ys, xs, vs, unnest(range(1, len(xs) + 1)) AS i FROM (
   SELECT r, string_split_regex(t, {p}) AS ys, regexp_extract_all(t, {p}) AS xs, regexp_extract_all(t, {p}, {group}) AS vs FROM {source} WHERE regexp_matches(t, {p}))))) WHERE length(v) >= {least}"""

    alphabet = "CASE " + " ".join(f"WHEN regexp_matches(plain, {quoted(p)}) THEN {quoted(a)}" for p, a in alphabets) + f" ELSE {quoted(rest)} END"
    tail = lambda z: (
        f"least(1.0, 2 * greatest(1e-300, exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * ((1 / (1 + 0.2316419 * ({z}))) * (0.319381530 + (1 / (1 + 0.2316419 * ({z}))) * (-0.356563782 + (1 / (1 + 0.2316419 * ({z})))"
        f" * (1.781477937 + (1 / (1 + 0.2316419 * ({z}))) * (-1.821255978 + (1 / (1 + 0.2316419 * ({z}))) * 1.330274429)))))))"
    )
    order = "list_position([" + ", ".join(quoted(k) for k in kinds) + "], kind)"
    listed = f"string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, {order})"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(matches(*one) for one in base)}),
cov AS (SELECT r, list_distinct(flatten(list(range(a + 1, b + 1)))) AS cov FROM base GROUP BY r),
rest AS (SELECT r, t FROM d WHERE r NOT IN (SELECT r FROM cov) UNION ALL SELECT r, array_to_string([CASE WHEN list_contains(cov, i) THEN ' ' ELSE chars[i] END FOR i IN range(1, len(chars) + 1)], '') FROM (SELECT r, cov, string_split(t, '') AS chars FROM d JOIN cov USING (r))),
found AS ({matches("random", token, 0, least_token, "rest")}),
ordinary AS (SELECT r, regexp_replace(regexp_replace(t, {quoted(token)}, ' ', 'g'), '[^A-Za-z0-9]+', '', 'g') AS plain FROM rest WHERE r IN (SELECT r FROM found)),
decoys AS (SELECT substr(plain, 1 + ((('0x' || substr(md5(v || ':' || (i - 1) || ':' || k), 1, 8))::BIGINT) % (length(plain) - length(v) + 1)), length(v)) AS v FROM found JOIN ordinary USING (r), (SELECT unnest(range(0, {decoys})) AS k) WHERE length(plain) >= length(v)),
t1 AS (SELECT r, kind, a, b, regexp_replace(v, '=+$', '') AS plain FROM found UNION ALL SELECT NULL, 'decoy', NULL, NULL, v FROM decoys),
t2 AS (SELECT *, {alphabet} AS alphabet FROM t1),
t3 AS (SELECT *, length(plain)::DOUBLE AS n, length(alphabet)::DOUBLE AS k, [(instr(alphabet, c) - 1)::DOUBLE FOR c IN string_split(plain, '')] AS codes FROM t2 WHERE length(plain) >= {least_token}),
t4 AS (SELECT *, list_sum([x::DOUBLE * x FOR x IN map_values(list_histogram(codes))]) AS squares, [CASE WHEN c >= k / 2 THEN 1 ELSE 0 END FOR c IN codes] AS high, list_sum(codes) / n AS mean FROM t3),
t5 AS (SELECT *, k / n * squares - n AS chi2, list_sum(high)::DOUBLE AS n1, 1.0 + len([i FOR i IN range(2, len(high) + 1) IF high[i] <> high[i - 1]]) AS runs, list_sum([(c - mean) * (c - mean) FOR c IN codes]) AS var, list_sum([(codes[i] - mean) * (codes[i - 1] - mean) FOR i IN range(2, len(codes) + 1)]) AS cov FROM t4),
t6 AS (SELECT *, 2 * n1 * (n - n1) AS pairs, abs((pow(greatest(chi2, 0.0) / (k - 1), 1.0 / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))) AS z1, abs(CASE WHEN var > 0 THEN cov / var * sqrt(n) ELSE sqrt(n) END) AS z3 FROM t5),
t7 AS (SELECT *, abs(CASE WHEN pairs * (pairs - n) / (n * n * (n - 1)) > 0 THEN (runs - 1 - pairs / n) / sqrt(pairs * (pairs - n) / (n * n * (n - 1))) ELSE sqrt(n) END) AS z2 FROM t6),
t8 AS (SELECT *, -(ln({tail("least(z1, 37.0)")}) + ln({tail("least(z2, 37.0)")}) + ln({tail("least(z3, 37.0)")})) AS h FROM t7),
t9 AS (SELECT r, kind, a, b, floor(2 * log2(n))::INTEGER AS class, least({bins}, floor(-log2(least(1.0, greatest(1e-300, exp(-h) * (1 + h + h * h / 2)))) * {per_octave}))::INTEGER AS bin FROM t8),
counts AS (SELECT class, bin, count(*) FILTER (kind <> 'decoy') AS c, count(*) FILTER (kind = 'decoy') AS d FROM t9 GROUP BY class, bin),
sums AS (SELECT *, sum(c) OVER w AS total, sum(d) OVER w AS decoy_total, sum(c) OVER (PARTITION BY class ORDER BY bin DESC) AS lower, sum(c) OVER (PARTITION BY class ORDER BY bin) AS upper, sum(d) OVER (PARTITION BY class ORDER BY bin) AS decoys_upper FROM counts WINDOW w AS (PARTITION BY class)),
limits AS (SELECT class, min(CASE WHEN c > 0 AND pow(2.0, -bin / {per_octave}::DOUBLE) <= {missed} * lower / total THEN bin END) AS lim, max(CASE WHEN (CASE WHEN decoy_total > 0 THEN (decoys_upper + 1) * total / decoy_total::DOUBLE ELSE 0 END) <= {rate} * upper THEN bin END) AS upto FROM sums GROUP BY class),
noise AS (SELECT r, kind, a, b FROM t9 JOIN limits USING (class) WHERE kind <> 'decoy' AND (lim IS NULL OR bin < lim) AND bin <= upto),
spans AS (SELECT r, kind, a, b FROM base UNION ALL SELECT * FROM noise),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {listed} FILTER (kind <> 'random') AS listed_base, {listed} AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(listed_base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"""
