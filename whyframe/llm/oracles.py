"""SQL of those training-data queries that SQL can express, written for small tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

# CRC-32, bit by bit for the table of 256 entries, byte by byte for the texts.
CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i))"""


def crc32(hexed: str) -> str:
    """Of the column ``hexed``, a text's bytes in hexadecimal; needs ``crc`` beside it."""
    digit = f"(strpos('0123456789ABCDEF', substr({hexed}, 2 * i + {{}}, 1)) - 1)"
    data = f"list_transform(range(length({hexed}) // 2), lambda i: ({digit.format(1)} * 16 + {digit.format(2)})::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


OP7 = f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
    keyed AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM lines),
    common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    judged AS (SELECT doc_id, line, place, coalesce(doc_id <> last, false) AS dropped FROM keyed LEFT JOIN common USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id"""

OP11 = f"""
    WITH {CRC_TABLE},
    turns AS (SELECT conv_id AS c, length(coalesce(text, '')) AS size, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT c, hex(c::VARCHAR) AS hx FROM turns),
    convs AS (SELECT c, c - c % 100 AS base, {crc32('hx')} % 6 AS h FROM ids, crc),
    built AS (SELECT v.c, 0 AS kind, pos, m, size FROM convs v JOIN turns t ON t.c = v.base AND pos <= h
      UNION ALL SELECT v.c, 1, pos, m, size FROM convs v JOIN turns t ON t.c = v.c AND pos > h),
    placed AS (SELECT c, m, size, row_number() OVER (PARTITION BY c ORDER BY kind, pos) AS depth FROM built),
    paths AS (SELECT c, depth, size, string_agg(m, '') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key FROM placed
      UNION ALL SELECT c, 0, 0, '' FROM convs),
    nodes AS (SELECT key, any_value(depth) AS depth, min(c) AS low, count(*) AS n, any_value(size) AS size FROM paths GROUP BY key),
    kids AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (key)),
    last AS (SELECT c, arg_max(key, depth) AS key FROM paths GROUP BY c),
    ends AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM last GROUP BY key),
    sums AS (SELECT a.key, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.size) AS saved FROM whole a JOIN whole b ON starts_with(b.key, a.key) GROUP BY a.key)
    SELECT w.low AS conv_id, CAST(w.depth AS BIGINT) AS depth, CASE WHEN w.depth > 0 THEN p.low END AS parent_conv_id, w.n AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
      n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM whole w JOIN sums USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON w.depth > 0 AND p.key = left(w.key, length(w.key) - 32)"""

OP13 = f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    held AS (SELECT run, hex(id || ':' || run) AS hx, count(*) AS n FROM runs GROUP BY id, run),
    hashed AS (SELECT run, n, {crc32('hx')} AS h FROM held, crc),
    spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    gaps AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) r(i)),
    near AS (SELECT DISTINCT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, b.word FROM gaps a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM gaps a JOIN words b ON a.rest = b.word),
    best AS (SELECT x.word, x.n, o.word AS other, o.n AS m, count(*) OVER (PARTITION BY x.word) AS n_near FROM near JOIN words x USING (word) JOIN words o ON o.word = near.other
      QUALIFY row_number() OVER (PARTITION BY x.word ORDER BY o.n DESC, o.word) = 1),
    forms AS (SELECT word, other AS form, m FROM best WHERE m >= 5 * n),
    follow AS (SELECT word, word AS root FROM words UNION ALL SELECT follow.word, forms.form FROM follow JOIN forms ON forms.word = follow.root)
    SELECT w.word, f.form, r.root, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, f.m AS form_n
    FROM words w LEFT JOIN forms f USING (word) LEFT JOIN best USING (word) JOIN follow r ON r.word = w.word WHERE r.root NOT IN (SELECT word FROM forms)"""
