"""SQL of conversation repair, the Merkle manifest and sharding, over the same tables in DuckDB."""

#: crc32 of a list of bytes, by the table of its 256 steps.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS steps FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


CONVERSATION_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
faulty AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
         unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM faulty WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
marked AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         right(bare, 1) NOT IN ('.', '!', '?') AS open, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
turns AS (
  SELECT *, NOT blank AND NOT duplicate AND open AS truncated, blank OR duplicate AS gone,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS kind FROM marked),
findings AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (i > 1 AND coalesce(earlier[1] || role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id),
inserts(state, later, paid, done) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'),
         (0, 3, 4, 'II'), (1, 3, 4, 'II')),
keeps(kind, state, later) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
steps AS (
  SELECT conv_id, i, state, state AS later, 3 AS paid, 'D' AS done FROM turns, range(4) AS r(state)
  UNION ALL SELECT conv_id, i, state, CASE state WHEN 2 THEN 3 ELSE 2 END, 2 + truncated::INT, 'R' FROM turns, range(4) AS r(state) WHERE NOT gone
  UNION ALL SELECT conv_id, i, state, later, truncated::INT, 'K' FROM turns JOIN keeps USING (kind) WHERE NOT gone),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM findings
  UNION ALL
  SELECT w.conv_id, s.i, s.later::BIGINT, min({{'cost': (w.best.cost + n.paid + s.paid)::BIGINT, 'audit': w.best.audit || n.done || s.done}})
  FROM ways w JOIN inserts n ON w.state = n.state
  JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.state = n.later GROUP BY 1, 2, 3),
audits AS (
  SELECT w.conv_id, min({{'cost': (w.best.cost + n.paid)::BIGINT, 'audit': w.best.audit || n.done}}) AS best
  FROM ways w JOIN findings f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n JOIN inserts n ON w.state = n.state
  WHERE n.later IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS p
            FROM audits WHERE best.audit <> ''),
edits AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS e
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
replayed AS (
  SELECT x.conv_id, x.p, x.edit, x.e, t.role, t.text,
         bool_or(x.e = 1 AND x.edit = 'K' AND t.kind = 's') OVER (PARTITION BY x.conv_id) AS system
  FROM edits x LEFT JOIN turns t ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND x.i = t.i AND x.edit <> 'I' WHERE x.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole FROM replayed GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
       coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(a.best.cost, 0) AS cost,
       coalesce(a.best.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN findings f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN audits a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"({_field(v)})" for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MERKLE_MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} ELSE {_leaf("n_chars")} END AS after
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, rank, leaf AS h, n FROM leaves
  UNION ALL SELECT lang, level + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), (n + 1) // 2 FROM nodes WHERE n > 1
  GROUP BY lang, level, rank // 2, n),
subroots AS (SELECT lang, level AS height, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
             FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, rank, h, n FROM subroots
  UNION ALL SELECT level + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), (n + 1) // 2 FROM tops WHERE n > 1
  GROUP BY level, rank // 2, n),
steps AS (
  SELECT l.id, o.level AS step, l.rank >> o.level AS at, b.h AS sibling
  FROM leaves l JOIN nodes o ON l.lang IS NOT DISTINCT FROM o.lang AND o.rank = l.rank >> o.level AND o.n > 1
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM o.lang AND b.level = o.level AND b.rank = xor(o.rank, 1)
  UNION ALL
  SELECT l.id, s.height + o.level, s.rank >> o.level, b.h
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tops o ON o.rank = s.rank >> o.level AND o.n > 1
  LEFT JOIN tops b ON b.level = o.level AND b.rank = xor(o.rank, 1)),
folded AS (
  SELECT id, 0::BIGINT AS step, after AS h FROM leaves
  UNION ALL
  SELECT f.id, f.step + 1, sha256(CASE WHEN s.at % 2 = 0 THEN f.h || coalesce(s.sibling, '') ELSE s.sibling || f.h END)
  FROM folded f JOIN steps s ON f.id = s.id AND f.step = s.step),
proofs AS (SELECT id, string_agg(coalesce(sibling, ''), '' ORDER BY step) AS siblings, max(step) + 1 AS height FROM steps GROUP BY id)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root,
       f.h = r.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tops r ON r.n = 1
LEFT JOIN proofs p ON l.id = p.id JOIN folded f ON f.id = l.id AND f.step = coalesce(p.height, 0)
"""

SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
points AS (
  SELECT *, row_number() OVER (ORDER BY place, shard) - 1 AS arc FROM (
    SELECT s.shard, CAST('0x' || substr(md5(s.shard || ':' || v.v), 1, 15) AS BIGINT) AS place
    FROM range(40) AS s(shard), range(256) AS v(v))),
keys AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(strlen(text), 0) AS bytes, coalesce({_crc32("coalesce(text, '')")}, 0) AS crc,
         CAST('0x' || substr(md5('key:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place FROM documents, crc),
on_ring AS (
  SELECT k.*, (SELECT count(*) FROM points p WHERE p.place < k.place) % 10240 AS arc, count(*) OVER () AS n FROM keys k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY place, doc_id NULLS FIRST, crc, bytes) AS rank FROM on_ring),
walk AS (
  SELECT id, arc, rank, n, 0::BIGINT AS step, NULL::BIGINT AS shard, NULL::BIGINT AS slot FROM ranked
  UNION ALL
  SELECT id, arc, rank, n, step + 1, coalesce(shard, CASE WHEN turn <= free THEN asked END), coalesce(slot, CASE WHEN turn <= free THEN load + turn - 1 END)
  FROM (
    SELECT *, row_number() OVER (PARTITION BY asked, shard IS NULL ORDER BY arc, rank) AS turn,
           n // 40 + CASE WHEN asked < n % 40 THEN 1 ELSE 0 END - load AS free
    FROM (
      SELECT w.*, coalesce(w.shard, p.shard) AS asked, count(w.shard) OVER (PARTITION BY coalesce(w.shard, p.shard)) AS load,
             count(*) FILTER (w.shard IS NULL) OVER () AS waiting
      FROM walk w JOIN points p ON p.arc = (w.arc + w.step) % 10240)
    WHERE waiting > 0))
SELECT k.doc_id, k.bytes + 16 AS size, k.crc AS text_crc32, 'rows' AS law, CAST(w.shard AS INTEGER) AS shard, w.slot, CAST(NULL AS INTEGER) AS grown_shard
FROM keys k JOIN walk w ON k.id = w.id AND w.step = (SELECT max(step) FROM walk)
"""
