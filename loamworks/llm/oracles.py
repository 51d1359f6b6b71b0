"""SQL of the training-data operators that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string, bit by bit (3988292384 is the reversed polynomial)."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    byte = f"list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: {bit}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP2 = r"""
WITH sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size, md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, ''))) AS ord FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, (2 * source_size)::DOUBLE AS cap FROM sources),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS own FROM weighed
  WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(own, cap / w) AS rest FROM levels WHERE cap / w > own),
aims AS (SELECT source, source_size, CASE WHEN cap / w <= own THEN cap ELSE (SELECT rest FROM level) * w END AS target FROM levels),
placed AS (SELECT s.doc_id, s.source, s.size, s.ord, a.source_size, a.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
copies AS (SELECT *, coalesce((p * source_size + cum)::DOUBLE / target, 0) AS t FROM placed, (SELECT unnest([0, 1]) AS p)),
line AS (SELECT *, sum(size) OVER (ORDER BY t, source NULLS LAST, p, ord, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (SELECT doc_id, source, ord, size, source_size, target, (count(*) FILTER (WHERE upto <= (SELECT sum(size) * 1.5 FROM sized)))::BIGINT AS n FROM line GROUP BY ALL)
SELECT doc_id, size, source_size, target, size * n AS taken FROM taken
"""

OP11 = r"""
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false)), false)),
scored AS (SELECT q.vec_id AS query_id, q.row_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.row_id <> c.row_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12 = rf"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT h.conv_id, 0 AS own, r.place, r.role, r.text FROM heads h JOIN turns r ON r.conv_id = h.base AND r.place <= h.h
  UNION ALL SELECT h.conv_id, 1, r.place, r.role, r.text FROM heads h JOIN turns r ON r.conv_id = h.conv_id AND r.place > h.h),
steps AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS size,
    list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
paths AS (SELECT conv_id, depth, size, path FROM steps UNION ALL SELECT conv_id, 0, 0, [] FROM heads),
keyed AS (SELECT *, md5(array_to_string(path, '')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(path[:-2], '')) END AS parent,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (SELECT node, min(conv_id) AS conv_id, depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM keyed GROUP BY node, depth),
sons AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (SELECT a.node AS top, n.node FROM nodes n JOIN keyed a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
sums AS (SELECT u.top AS node, count(*) FILTER (WHERE s.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM under u JOIN nodes n USING (node) LEFT JOIN sons s USING (node) GROUP BY u.top)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(s.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums t USING (node) LEFT JOIN sons s USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""


def _moved(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """A state of the repair after one more edit: k is the cost in nine digits and the audit, t the repaired lines."""
    key = f"lpad((left({state}.k, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}.k, 10) || '{edit}'"
    text = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'k': {key}, 't': {text}}} END"


def _repair() -> str:
    kept, cut = "role || ':' || text", "(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)"
    fine = "fault NOT IN ('blank', 'duplicate')"
    moved = {n: [_moved(s, "3", "D") for s in (f"s{n}",)] for n in range(4)}
    moved[1] += [f"CASE WHEN {fine} AND left(role, 1) = 's' THEN {_moved('s0', cut, 'K', kept)} END"]
    for to, name, sources in ((2, "user", (0, 1, 3)), (3, "assistant", (2,))):
        for n in sources:
            moved[to] += [f"CASE WHEN {fine} AND left(role, 1) = '{name[0]}' THEN {_moved(f's{n}', cut, 'K', kept)} END"]
            moved[to] += [f"CASE WHEN {fine} THEN {_moved(f's{n}', f'2 + {cut}', 'R', f"'{name}:' || text")} END"]
    layer = ", ".join(f"least({', '.join(m)}) AS s{n}" if len(m) > 1 else f"{m[0]} AS s{n}" for n, m in moved.items())
    users = "least(s2, " + ", ".join(_moved(f"s{n}", "2", "I", "'user:'") for n in (0, 1, 3)) + ")"
    bots = f"least(s3, {_moved('s2', '2', 'I', "'assistant:'")})"
    closed = lambda rows: f"SELECT conv_id, i, s0, s1, s2, {bots} AS s3 FROM (SELECT conv_id, i, s0, s1, {users} AS s2, s3 FROM ({rows}))"
    start = "SELECT conv_id, 0::BIGINT AS i, {'k': '000000000', 't': []::VARCHAR[]} AS s0, " + ", ".join(f"NULL::STRUCT(k VARCHAR, t VARCHAR[]) AS s{n}" for n in (1, 2, 3)) + " FROM ids"
    step = f"SELECT v.conv_id, f.i, {layer} FROM v JOIN faults f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1"
    return rf"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM dealt),
placed AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN regexp_matches(text, '[.!?][ \t-\r]*$') THEN 'none' ELSE 'truncated' END AS fault FROM placed),
v AS ({closed(start)} UNION ALL {closed(step)}),
counts AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
best AS (SELECT v.conv_id, c.* EXCLUDE (conv_id), least(v.s0, v.s3) AS s FROM v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id WHERE v.i = coalesce(c.n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, left(s.k, 9)::BIGINT AS cost, substr(s.k, 10) AS audit, sha256(array_to_string(s.t, chr(10))) AS repaired_sha256 FROM best
"""


OP13 = _repair()
