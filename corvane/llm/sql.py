"""SQL twins of the operators that need more than a line."""

from __future__ import annotations

from .common import LOWER, UPPER
from .licenses import PHRASES, TEMPLATES
from .secrets import ACCESS, ASSIGN, HEX, OWNED
from .sharding import GRID, SHARE

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def licenses_sql(num: int = 8, den: int = 10) -> str:
    low = f"translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    given = ", ".join(f"('{label}', {sorted(set(t.replace('.', ' ').split()))!r})" for label, t in TEMPLATES)
    return f"""WITH phrases(p, label) AS (VALUES {phrases}), templates(label, t) AS (VALUES {given}),
 d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all({low.format('text')}, '{WORD}') AS w FROM documents),
 hits AS (SELECT r, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) AS i FROM d, phrases),
 base AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, list(DISTINCT label) AS labels FROM hits GROUP BY r),
 lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
 held AS (SELECT r, list_distinct(regexp_extract_all({low.format('line')}, '{WORD}')) AS w FROM lines),
 met AS (SELECT r, label, len(list_intersect(w, t)) AS n, len(t) AS size FROM held, templates WHERE len(list_intersect(w, t)) * {den} >= len(t) * {num}),
 found AS (SELECT r, list(DISTINCT label) AS labels, max(n / size) AS share FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
 coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []::VARCHAR[]), coalesce(found.labels, []::VARCHAR[])))), ','), '') AS labels,
 CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


def secrets_sql(copied: int = 3) -> str:
    def spans(pattern, kind, group=0):
        q = pattern.replace("'", "''")
        return f"""SELECT r, owner, {kind} AS kind, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM (
 SELECT r, owner, regexp_extract_all(t, '{q}') AS m, regexp_extract_all(t, '{q}', {group}) AS v, string_split_regex(t, '{q}') AS g FROM d)"""

    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
 raw AS ({spans(ASSIGN, 0, 2)} UNION ALL {spans(ACCESS, 1)} UNION ALL {spans(HEX, 2)} UNION ALL {spans(OWNED, 3)}),
 placed AS (SELECT r, owner, kind, v[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS n FROM raw),
 kept AS (SELECT *, s + n AS e FROM placed WHERE CASE kind WHEN 0 THEN length(value) >= 6
   WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END),
 owners AS (SELECT value, count(DISTINCT owner) >= {copied} AS example FROM kept GROUP BY value),
 marked AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS txt FROM kept JOIN owners USING (value)),
 per AS (SELECT r, count_if(kind = 0) AS a, count_if(kind = 1) AS c, count_if(kind = 2) AS h, count_if(example) AS ex,
  count_if(NOT example AND length(value) >= 12 AND regexp_matches(value, '[0-9]')) AS lv,
  string_agg(txt, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(txt, ',' ORDER BY s, kind, e) FILTER (kind < 3 OR NOT example) AS allsp
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(allsp, '') AS spans, coalesce(ex, 0)::BIGINT AS n_example, coalesce(lv, 0)::BIGINT AS n_live
FROM d LEFT JOIN per USING (r)"""


def shards_sql(shards: int = 40) -> str:
    """Twin of operator 13 for unique ids: all atoms of a node sorted in one window per level; CRC by its table."""
    def number(c):
        return f"coalesce(('0x' || rpad(substr(hex(encode({c})), 1, 12), 12, '0'))::BIGINT, NULL)::DOUBLE"

    dims = range(4)
    low = [f"min(d{i}) OVER () AS lo{i}, max(d{i}) OVER () AS hi{i}" for i in dims]
    scaled = [f"CASE WHEN lo{i} = hi{i} OR e{i} IS NULL THEN 0 ELSE floor((e{i} - lo{i}) / (hi{i} - lo{i}) * {GRID}.0::DOUBLE)::BIGINT END AS c{i}" for i in dims]
    levels, last = [], "a0"
    for n in range((shards - 1).bit_length()):
        span = [f"max(c{i}) OVER (PARTITION BY node) - min(c{i}) OVER (PARTITION BY node) AS s{i}" for i in dims]
        pick = "CASE greatest(s0, s1, s2, s3) WHEN s0 THEN c0 WHEN s1 THEN c1 WHEN s2 THEN c2 ELSE c3 END AS v"
        levels.append(f"""w{n} AS (SELECT *, sum(size) OVER (PARTITION BY node) AS all_, {', '.join(span)} FROM {last}),
 v{n} AS (SELECT *, {pick} FROM w{n}),
 m{n} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY v, digest, tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(size) OVER (PARTITION BY node, v, digest, tie) AS own FROM v{n}),
 a{n + 1} AS (SELECT doc_id, size, crc, digest, tie, c0, c1, c2, c3, CASE WHEN k = 1 OR 2 * k * upto - k * own <= 2 * all_ * (k // 2) THEN node ELSE node + k // 2 END AS node,
  CASE WHEN k = 1 THEN 1 WHEN 2 * k * upto - k * own <= 2 * all_ * (k // 2) THEN k // 2 ELSE k - k // 2 END AS k FROM m{n})""")
        last = f"a{n + 1}"
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE bits(b, c, n) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT b, {step}, n + 1 FROM bits WHERE n < 8),
 tab AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE n = 8),
 t AS (SELECT doc_id, source, lang, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
 r AS (SELECT doc_id, (strlen(x) + 16)::BIGINT AS size, ('0x' || substr(sha256(x), 1, 15))::BIGINT AS digest,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(x) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
   lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS crc,
  {number('source')} AS d0, {number('lang')} AS d1, (strlen(x) + 16)::DOUBLE AS d2, doc_id::DOUBLE AS d3 FROM t, tab),
 g AS (SELECT *, {', '.join(low)}, sum(size) OVER (PARTITION BY digest) > sum(size) OVER () // {shards * SHARE} AS heavy FROM r),
 e AS (SELECT *, {', '.join(f'CASE WHEN heavy THEN d{i} ELSE min(d{i}) OVER (PARTITION BY digest) END AS e{i}' for i in dims)} FROM g),
 a0 AS (SELECT doc_id, size, crc, digest, CASE WHEN heavy THEN doc_id ELSE 0 END AS tie, {', '.join(scaled)}, 0 AS node, {shards} AS k FROM e),
 {', '.join(levels)}
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, node::INTEGER AS shard,
 (row_number() OVER (PARTITION BY node ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM {last}"""
