"""DuckDB SQL for the clustering, mixing and repair queries, written out from their parameters."""

from __future__ import annotations

from . import centroid_clustering as cc, source_mixing as sm

# --- clustering: plain rounds, every distance measured


def clustering(k: int = cc.K, rounds: int = cc.ROUNDS, width: int = cc.WIDTH, scale: int = cc.SCALE, seed: int = cc.SEED) -> str:
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
a{turn} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT x.rid, m.c, CAST(sum((x.x - m.x) * (x.x - m.x)) AS BIGINT) AS d FROM long_x x JOIN c{turn} m USING (j) GROUP BY x.rid, m.c) GROUP BY rid)""")
        if turn < rounds:
            steps.append(f"""
c{turn + 1} AS MATERIALIZED (
  SELECT m.c, m.j, coalesce(n.x, m.x) AS x FROM c{turn} m LEFT JOIN (
    SELECT a.c, x.j, CAST(floor(CAST(sum(x.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM long_x x JOIN a{turn} a USING (rid) GROUP BY a.c, x.j) n USING (c, j))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
long_x AS MATERIALIZED (SELECT rid, unnest(x) AS x, unnest(range({width})) AS j FROM v),
first AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
  SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k})),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS x, unnest(range({width})) AS j FROM first),{",".join(steps)},
s AS (SELECT c, sum(d) AS part FROM a{rounds} GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(part AS BIGINT) AS cluster_inertia, CAST((SELECT sum(part) FROM s) AS BIGINT) AS inertia, centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN s USING (c) JOIN h USING (c)
"""


# --- mixing: the same draws, met without stretches, bins or stops in order


def _mixed(x: str, salt: int) -> str:
    a, b = 1103515245 + 65537 * salt, 12345 + salt
    y = f"((({x} & {sm.PRIME}) * {a} + ({x} >> 31) + {b}) % {sm.PRIME})"
    return f"((((({y} * {y} + {a}) % {sm.PRIME}) * {y}) + {b}) % {sm.PRIME})"


def _shuffled(x: str, n: str, keys: str) -> str:
    other = f"((k % {n} - p + {n}) % {n})"
    low = f"((greatest(p, {other}) & {sm.PRIME}) + (greatest(p, {other}) >> 31))"
    bit = f"(({low} * (k & {sm.PRIME}) + (k >> 31)) % {sm.PRIME}) & {1 << 20}"
    return f"list_reduce(list_prepend({x}, {keys}), lambda p, k: CASE WHEN {bit} = 0 THEN p ELSE {other} END)"


def mixing(block: int = sm.BLOCK, limit: int = sm.LIMIT, weights: tuple[int, ...] = sm.WEIGHTS) -> str:
    tag = f"(g * {sm.ROUNDS} + r)"
    return f"""
WITH doc AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, coalesce(doc_id, -1) & 9223372036854775807 AS id FROM documents),
total AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS all_words FROM doc),
named AS (SELECT row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src, * FROM (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM doc GROUP BY source)),
weighed AS MATERIALIZED (SELECT *, {list(weights)}[src % {len(weights)} + 1] AS weight, {limit} * words AS most FROM named),
-- the level at which the targets add up: tried at each source's own limit, the last one that still fits
tried AS (SELECT l.most / l.weight AS level, sum(least(CAST(s.most AS DOUBLE), s.weight * (l.most / l.weight))) AS needs FROM weighed l, weighed s GROUP BY l.src, l.most, l.weight),
stop AS (SELECT coalesce(max(level), -1) AS level FROM tried, total WHERE needs <= all_words),
target AS MATERIALIZED (
  SELECT *, CASE WHEN most / weight <= level THEN CAST(most AS DOUBLE)
    ELSE weight * CAST(all_words - CAST((SELECT coalesce(sum(most), 0) FROM weighed w WHERE w.most / w.weight <= level) AS BIGINT) AS DOUBLE) / (SELECT CAST(sum(weight) AS BIGINT) FROM weighed w WHERE w.most / w.weight > level) END AS target
  FROM weighed, stop, total),
want AS (
  SELECT *, (words + {block - 1}) // {block} AS blocks, CASE WHEN words > 0 THEN need // words ELSE 0 END AS passes, CASE WHEN words > 0 THEN need % words ELSE 0 END AS rest
  FROM (SELECT *, CAST(least(floor(target + 0.5), most) AS BIGINT) AS need FROM target)),
seeds AS (SELECT 0 AS g UNION SELECT src * {limit + 1} + t + 1 FROM want, range({limit + 1}) x(t)),
keys AS MATERIALIZED (SELECT g, list({_mixed(tag, 1)} * {sm.PRIME} + {_mixed(tag, 2)} ORDER BY r) AS ks FROM (SELECT CAST(g AS BIGINT) AS g, CAST(r AS BIGINT) AS r FROM seeds, range({sm.ROUNDS}) x(r)) GROUP BY g),
-- every place of every pass with the words that the block there has; a source takes places while words are wanted
places AS (SELECT want.*, t, CAST(i AS BIGINT) AS i, {_shuffled("CAST(i AS BIGINT)", "blocks", "ks")} AS block
  FROM want, range({limit + 1}) x(t), range(blocks) y(i), keys WHERE words > 0 AND g = src * {limit + 1} + t + 1 AND t <= passes),
filled AS (SELECT src, block, t * blocks + i AS number, least({block}, words - block * {block}) AS room, need,
  sum(least({block}, words - block * {block})) OVER (PARTITION BY src ORDER BY t, i) AS so_far FROM places),
slot AS MATERIALIZED (SELECT src, block, room - greatest(0, so_far - need) AS room FROM filled WHERE so_far - room < need),
copies AS (SELECT doc.*, src, words, target, row_number() OVER (PARTITION BY doc_id, doc.source, size ORDER BY size) AS copy FROM doc JOIN target ON doc.source IS NOT DISTINCT FROM target.source),
placed AS MATERIALIZED (SELECT *, row_number() OVER () AS rid,
  CAST(sum(size) OVER (PARTITION BY src ORDER BY {_mixed("id", 4)} % {sm.BINS}, {_mixed("id", 5)}, doc_id NULLS FIRST, size, copy) - size AS BIGINT) AS start FROM copies),
piece AS (SELECT rid, src, b AS block, greatest(start, b * {block}) - b * {block} AS low, least(start + size, b * {block} + {block}) - b * {block} AS high
  FROM (SELECT *, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS b FROM placed WHERE size > 0)),
took AS (SELECT rid, sum(greatest(0, least(high, room) - low)) AS taken FROM piece JOIN slot USING (src, block) GROUP BY rid)
SELECT doc_id, size, words AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN took USING (rid)
"""


# --- repair: all four states of the pattern, row by row


def _step(state: str, cost: str, letter: str, row: str | None = None, when: str = "TRUE") -> str:
    text = f"{state}.t" + (f" || chr(10) || {row}" if row else "")
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def repair() -> str:
    user, assistant, kept = "'user:' || text", "'assistant:' || text", "role || ':' || text"
    stays, charge = "NOT gone", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    gone = [_step(f"s{k}", "4", "D") for k in range(4)]

    def turn(frm: str, put: str) -> str:
        return _step(frm, f"3 + {charge}", "R", put, stays)

    def keep(frm: str, initial: str) -> str:
        return _step(frm, charge, "K", kept, f"{stays} AND initial = '{initial}'")

    to_user = [turn(s, user) for s in ("s0", "s1", "s3")] + [keep(s, "u") for s in ("s0", "s1", "s3")]
    reach = [gone[0], _least(gone[1], keep("s0", "s")), _least(gone[2], *to_user), _least(gone[3], turn("s2", assistant), keep("s2", "a"))]
    insert_user = [_step(s, "3", "I", "'user:'") for s in ("n0", "n1", "n3")]
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(v ORDER BY n) AS byte FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n))),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
  lambda c, b: xor(c >> 8, byte[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS kind FROM d, crc),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy, again) AS pos,
  substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM e)),
g AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS gone, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM f)),
zero AS (SELECT {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 3, 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3),
r AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s1, s2, s3 FROM g, zero
  UNION ALL
  SELECT conv_id, pos, n0, n1, m2, {_least("n3", _step("m2", "3", "I", "'assistant:'"))} FROM (
    SELECT *, {_least("n2", *insert_user)} AS m2 FROM (
      SELECT r.conv_id, g.pos, {", ".join(f"{x} AS n{k}" for k, x in enumerate(reach))}
      FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND g.pos = r.pos + 1))),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
best AS (SELECT sums.*, {_least("s0", "s3")} AS way FROM sums JOIN r ON sums.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = sums.n)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(way.c, 0) AS BIGINT) AS cost, coalesce(way.a, '') AS audit, sha256(substr(coalesce(way.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
"""
