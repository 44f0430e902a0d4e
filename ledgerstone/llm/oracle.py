"""DuckDB SQL for the corpus queries that SQL can express over whole tables; tests hold the others against brute force."""

from __future__ import annotations

from .chat import END, OPEN, SHUT
from .decontaminate import SLOP, WINDOW
from .secrets import RULES
from .sharding import BITS, BYTE_LIMIT

SHARDING = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
  p AS (SELECT depth, h >> ({BITS} - depth) AS bucket, sum(n_bytes) AS total FROM d, range({BITS + 1}) t(depth) GROUP BY 1, 2),
  s AS (SELECT d.h, min(p.depth) AS depth FROM (SELECT DISTINCT h FROM d) d, p WHERE p.bucket = d.h >> ({BITS} - p.depth) AND p.total <= {BYTE_LIMIT} GROUP BY 1)
SELECT doc_id, n_bytes, left(to_base(d.h, 2, {BITS}), coalesce(depth, {BITS})) AS shard, coalesce(depth, {BITS})::INT AS shard_depth, 0::BIGINT AS shard_page, n_bytes > {BYTE_LIMIT} AS shard_oversized
FROM d LEFT JOIN s USING (h)"""

_SPECIAL = "(length({x}) - length(replace(replace(replace({x}, '\\', ''), '<', ''), '>', '')))"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, t, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
  e AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(SHUT) + len(END)} + length(r) + length(x) + {_SPECIAL.format(x="r")} + {_SPECIAL.format(x="x")})::BIGINT AS formatted_chars, sum(length(x))::BIGINT AS branch_score
FROM e GROUP BY conv_id"""

_ESCAPED = "replace(replace(replace({x}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
BRANCHES = f"""
WITH RECURSIVE n AS (SELECT coalesce(conv_id::VARCHAR, '') AS tree, row_number() OVER (PARTITION BY coalesce(conv_id::VARCHAR, '') ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)::INT AS node,
    count(*) OVER (PARTITION BY coalesce(conv_id::VARCHAR, '')) AS size, length(coalesce(text, '')) AS score, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations),
  up AS (SELECT tree, node AS leaf, node FROM n WHERE 2 * node > size UNION ALL SELECT tree, leaf, node // 2 FROM up WHERE node > 1),
  b AS (SELECT tree, leaf, sum(score)::BIGINT AS branch_score, count(*)::BIGINT AS n_turns, string_agg(node::VARCHAR, '>' ORDER BY node) AS path, coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(string_agg('{OPEN}' || {_ESCAPED.format(x="r")} || '{SHUT}' || {_ESCAPED.format(x="x")} || '{END.strip()}' || chr(10), '' ORDER BY node)) AS formatted_sha256 FROM up JOIN n USING (tree, node) GROUP BY 1, 2)
SELECT tree, leaf, (row_number() OVER (PARTITION BY tree ORDER BY branch_score DESC, leaf))::INT AS branch_rank, branch_score, n_turns, path, formatted_sha256, loss_chars FROM b QUALIFY row_number() OVER (PARTITION BY tree ORDER BY branch_score DESC, leaf) <= 2"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH b AS (SELECT * FROM (SELECT item_id::VARCHAR AS item_id, text, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
  bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS n, ws[s : s + least({WINDOW}, len(ws)) - 1] AS win FROM (SELECT *, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS s FROM b)),
  d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
  dw AS (SELECT doc_id, s, n, ws[s : s + n - 1] AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) k WHERE len(ws) >= n)),
  m AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
  h AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
  i AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1),
  dp AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM d),
  k AS (SELECT row_number() OVER () AS k, ws FROM (SELECT DISTINCT item_id, text, ws FROM b)),
  kt AS (SELECT k, term, place, coalesce(n, 0) AS n FROM (SELECT k, unnest(ws) AS term, unnest(range(len(ws))) AS place FROM k) LEFT JOIN (SELECT term, count(*) AS n FROM dp GROUP BY 1) USING (term)),
  kr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS side, count(*) OVER (PARTITION BY k) AS sides FROM (SELECT * FROM kt QUALIFY row_number() OVER (PARTITION BY k ORDER BY n, term, place) <= 2)),
  np AS (SELECT doc_id, k, pos FROM dp JOIN kr USING (term) WHERE sides = 1
    UNION SELECT x.doc_id, a.k, least(x.pos, y.pos) FROM kr a JOIN kr z ON a.k = z.k AND a.side = 1 AND z.side = 2 JOIN dp x ON x.term = a.term JOIN dp y ON y.term = z.term AND y.doc_id = x.doc_id WHERE abs((x.pos - a.place) - (y.pos - z.place)) <= {SLOP}),
  c AS (SELECT doc_id, count(*)::BIGINT AS n_near FROM np GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: Of each kind, what a match must hold; hex needs its length in the pattern only to keep the number of matches small.
_KEPT = {"assign": "length(regexp_extract(v, '{p}', 2)) >= 6", "access": "length(v) >= 20", "hex": "TRUE", "forge": "length(v) >= 24", "chat": "length(v) >= 20", "map": "length(v) >= 35", "webtoken": "length(v) >= 40", "pem": "TRUE"}


def _secrets() -> str:
    parts = []
    for n, rule in enumerate(RULES):
        pattern = (rule.trigger if rule.kind == "hex" else rule.pattern).replace("'", "''")
        pattern = f"(?i){pattern}" if rule.ignore_case else pattern
        parts.append(
            f"SELECT doc_id, {n} AS k, '{rule.kind}' AS kind, v, begin, begin + length(v) AS stop FROM (SELECT doc_id, vs[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(vs[1:i-1], lambda x: length(x))), 0)::BIGINT AS begin "
            f"FROM (SELECT doc_id, vs, gaps, unnest(range(1, len(vs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS vs, string_split_regex(text, '{pattern}') AS gaps FROM documents))) WHERE {_KEPT[rule.kind].replace('{p}', pattern)}"
        )
    order = "ORDER BY begin, k"
    named = "kind || ':' || begin || ':' || stop"
    return f"""
WITH s AS ({" UNION ALL ".join(parts)}), g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg({named}, ',' {order}) FILTER (k < 3) AS base, string_agg({named}, ',' {order}) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(g.spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


ORACLE: dict[str, str] = {"op1_sharding": SHARDING, "op3_chat_trees": CHAT, "reply_branches": BRANCHES, "op4_decontamination": DECONTAMINATION, "op7_secrets": _secrets()}
