"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

import hashlib

from .queries import SHARDS, SLOTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT d.r, d.w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


def _claims() -> str:
    """The slots of each shard, found the other way round: by walking turns and looking each claim up in a set."""
    taken: dict[int, str] = {}
    number = {s: (int(hashlib.md5(f"offset:{s}".encode()).hexdigest()[:15], 16) % SLOTS, int(hashlib.md5(f"skip:{s}".encode()).hexdigest()[:15], 16) % (SLOTS - 1) + 1) for s in SHARDS}
    tries = dict.fromkeys(SHARDS, 0)
    while len(taken) < SLOTS:
        for s in SHARDS:
            if len(taken) == SLOTS:
                break
            a, b = number[s]
            while (slot := (a + tries[s] * b) % SLOTS) in taken:
                tries[s] += 1
            taken[slot] = s
    return ",".join(taken[i] for i in range(SLOTS))


def op3() -> str:
    return f"""
WITH t AS (SELECT string_split('{_claims()}', ',') AS shards),
s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1] AS shard FROM s, t
"""


OP8 = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{U}', '{L}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
x AS (SELECT s.doc_id, s.sh FROM s JOIN f USING (sh)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS v, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v),
m AS (SELECT v, min(r) AS r FROM c GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id
""".replace("{U}", _UPPER).replace("{L}", _LOWER)

OP9 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, coalesce(page_id % 97 = 0 AND ascii(html) BETWEEN 32 AND 125, false) AS other, coalesce(page_id % 101 = 0, false) AS longer,
  coalesce(page_id % 103 = 0, false) AS lost, coalesce(page_id % 107 = 0, false) AS twice FROM pages),
v AS (SELECT 0 AS side, page_id, url, html FROM p
  UNION ALL SELECT 1, page_id, url, CASE WHEN other THEN '~' || substr(html, 2) WHEN longer THEN html || '!' ELSE html END FROM p WHERE NOT lost
  UNION ALL SELECT 1, page_id, url, 'second' FROM p WHERE twice AND NOT page_id % 97 = 0 AND NOT longer AND NOT lost),
q AS (SELECT side, page_id, page_id // 512 AS warc_file,
  encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10)
  || html || chr(13) || chr(10) || chr(13) || chr(10)) AS data FROM v),
h AS (SELECT side, page_id, warc_file, octet_length(data) AS n, sha256(data) AS h FROM q),
r AS (SELECT side, page_id, warc_file, CAST(0 AS BIGINT) AS shelf, CAST(row_number() OVER w - 1 AS BIGINT) AS place, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
  CAST(n AS BIGINT) AS record_length, h AS record_sha256 FROM h WINDOW w AS (PARTITION BY side, warc_file ORDER BY page_id, h)),
l AS (SELECT a.* EXCLUDE (side), b.place IS NULL AS damaged, coalesce(a.record_offset <> b.record_offset, false) AS moved
  FROM (SELECT * FROM r WHERE side = 0) a LEFT JOIN (SELECT * FROM r WHERE side = 1) b ON a.page_id = b.page_id AND a.record_sha256 = b.record_sha256)
SELECT * FROM l
UNION ALL SELECT r.* EXCLUDE (side), true, false FROM r JOIN p USING (page_id) WHERE side = 1 AND twice AND NOT page_id % 97 = 0 AND NOT longer AND NOT lost
  AND NOT EXISTS (SELECT 1 FROM r x WHERE x.side = 0 AND x.page_id = r.page_id AND x.record_sha256 = r.record_sha256)
"""

OP10 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""

#: Offsets a day before and after a wall time tell whether a change lies between; each is then tried at the time that it gives.
OP13 = r"""
WITH t AS (SELECT row_number() OVER () AS r, stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
x AS (SELECT *, regexp_full_match(t, '[0-9]{10}|[0-9]{13}') AS epoch, regexp_extract(t, '^(20\d\d-\d\d-\d\d|20\d{6}|\d\d\.\d\d\.20\d\d|\d\d (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20\d\d|\d\d/\d\d/20\d\d)'
  || '(?:[T ](\d\d):([0-5]\d)(?::([0-5]\d))?(?: ?([AP]M))?(?: ?(Z|[+-](?:0\d|1[0-4]):?[0-5]\d))?)?$', ['d', 'h', 'm', 's', 'half', 'off']) AS g FROM t),
f AS (SELECT * EXCLUDE (g), CASE WHEN g.d LIKE '%-%' THEN g.d WHEN g.d LIKE '%.%' OR g.d LIKE '%/%' THEN g.d[7:10] || '-' || g.d[4:5] || '-' || g.d[1:2]
    WHEN g.d LIKE '% %' THEN g.d[8:11] || '-' || lpad(CAST((instr('JanFebMarAprMayJunJulAugSepOctNovDec', g.d[4:6]) + 2) // 3 AS VARCHAR), 2, '0') || '-' || g.d[1:2]
    ELSE g.d[1:4] || '-' || g.d[5:6] || '-' || g.d[7:8] END AS first, CASE WHEN g.d LIKE '%/%' THEN g.d[7:10] || '-' || g.d[1:2] || '-' || g.d[4:5] END AS second,
  CASE WHEN g.h = '' THEN 0 WHEN g.half <> '' AND try_cast(g.h AS INT) BETWEEN 1 AND 12 THEN try_cast(g.h AS INT) % 12 + CASE g.half WHEN 'PM' THEN 12 ELSE 0 END WHEN g.half = '' AND try_cast(g.h AS INT) < 24 THEN try_cast(g.h AS INT) END * 3600
    + CASE g.m WHEN '' THEN 0 ELSE try_cast(g.m AS INT) END * 60 + CASE g.s WHEN '' THEN 0 ELSE try_cast(g.s AS INT) END AS secs,
  CASE WHEN g.off = '' THEN NULL WHEN g.off = 'Z' THEN 0 ELSE (try_cast(g.off[2:3] AS INT) * 3600 + try_cast(g.off[-2:] AS INT) * 60) * CASE g.off[1:1] WHEN '-' THEN -1 ELSE 1 END END AS off FROM x),
d AS (SELECT *, secs * CAST(1000000 AS BIGINT) + epoch_us(CAST(try_cast(first AS DATE) AS TIMESTAMP)) AS df, secs * CAST(1000000 AS BIGINT) + epoch_us(CAST(try_cast(second AS DATE) AS TIMESTAMP)) AS mf FROM f WHERE off IS NOT NULL OR zone IN (SELECT name FROM pg_timezone_names())),
v AS (SELECT source, sum(CAST(mf IS NULL AS INT)) AS nd, sum(CAST(df IS NULL AS INT)) AS nm FROM d WHERE second IS NOT NULL AND (df IS NULL) <> (mf IS NULL) GROUP BY source),
w AS (SELECT d.*, df <> mf AS either, CASE WHEN df IS NULL OR (mf IS NOT NULL AND nm > nd) THEN mf ELSE df END AS wall, coalesce(nm <> nd, false) AS told FROM d LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source WHERE df IS NOT NULL OR mf IS NOT NULL),
o AS (SELECT *, epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - 86400000000)))) - wall + 86400000000 AS before, epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall + 86400000000)))) - wall - 86400000000 AS after FROM w WHERE off IS NULL),
c AS (SELECT r, before, after, epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - before)))) = wall AS early, epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - after)))) = wall AS late FROM o)
SELECT t.stamp_id, CAST(CASE WHEN x.epoch THEN CAST(t.t AS BIGINT) * CASE length(t.t) WHEN 10 THEN 1000000 ELSE 1000 END WHEN w.off IS NOT NULL THEN wall - w.off * CAST(1000000 AS BIGINT) WHEN early AND NOT late THEN wall - before ELSE wall - after END AS BIGINT) AS utc_us,
  CASE WHEN x.epoch THEN 'epoch' WHEN w.r IS NULL THEN 'bad' WHEN coalesce(either, false) THEN CASE WHEN told THEN 'votes' ELSE 'default' END ELSE 'plain' END AS rule,
  coalesce(either, false) OR coalesce(before <> after AND early = late, false) AS ambiguous
FROM t JOIN x USING (r) LEFT JOIN w USING (r) LEFT JOIN c USING (r)
"""


def op12() -> str:
    """crc32 by its table, byte by byte; near words by the words that they become when a code point is taken out or masked."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(str(i))
    return f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
r AS (SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= 6 GROUP BY doc_id, w),
tab AS (SELECT [{", ".join(table)}] AS t),
b AS (SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce(bytes, lambda a, x: xor(t[CAST((xor(a, x) & 255) + 1 AS INT)], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS i FROM v)),
p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.a || d.z = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.a || d.z = v.word),
m AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN m USING (word)),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f e ON e.word = c.at WHERE e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op3_shard": op3(), "op8_ngram_join": OP8, "op9_warc_fixity": OP9, "op10_knn": OP10, "op12_spelling": op12(), "op13_timestamps": OP13}
