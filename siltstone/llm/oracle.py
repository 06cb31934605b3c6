"""SQL (of DuckDB) that gives the rows of the queries that SQL can express, over the same tables.

It states what the operators compute, by plain joins and windows, not how they do it.  Only among rows that agree in
doc_id and differ in text is the order of lines left open here, where the operator orders by a hash.
"""

from __future__ import annotations

from siltstone.llm import lines, sharding
from siltstone.llm.decontaminate import WINDOW

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS low, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
cut AS (SELECT item, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1), lambda i: w[i:i + {WINDOW - 1}])) AS win FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, len(win) AS width, array_to_string(win, ' ') AS win FROM cut),
widths AS (SELECT DISTINCT width FROM wanted),
own AS (SELECT r, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: {{'i': i, 'win': array_to_string(w[i:i + width - 1], ' ')}})) AS o FROM docs, widths WHERE len(w) >= width),
found AS (SELECT r, item, width, o.i AS i FROM own JOIN wanted USING (width) WHERE o.win = wanted.win),
hit AS (SELECT DISTINCT r, unnest(range(i, i + width)) AS p FROM found),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
parts AS (SELECT r, unnest(regexp_extract_all(low, '{_WORD}|{_OTHER}')) AS part, generate_subscripts(regexp_extract_all(low, '{_WORD}|{_OTHER}'), 1) AS k FROM docs WHERE r IN (SELECT r FROM found)),
placed AS (SELECT r, k, part, sum(length(part)) OVER (PARTITION BY r ORDER BY k) AS until, regexp_full_match(part, '{_WORD}') AS is_word FROM parts),
ends AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS p, until - length(part) AS a, until AS b FROM placed WHERE is_word),
islands AS (SELECT r, min(a) AS a, max(b) AS b FROM (SELECT r, p, a, b, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM ends JOIN hit USING (r, p)) GROUP BY r, g),
spanned AS (SELECT r, string_agg(a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a) AS spans FROM islands GROUP BY r),
hits AS (SELECT r, count(*) AS n_hit FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN spanned USING (r)
"""

#: White space of the lines, but the blank.
_BLANKS = r"[\t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

LINES = f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
cut AS (SELECT doc_id, text, unnest(ls) AS l, generate_subscripts(ls, 1) AS no FROM docs),
worded AS (SELECT doc_id, text, no, list_filter(string_split(regexp_replace(l, '{_BLANKS}', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM cut),
numbered AS (SELECT doc_id, text, no, list_sort(list_distinct(w)) AS s, row_number() OVER (ORDER BY doc_id NULLS FIRST, text, no) AS pos FROM worded WHERE len(w) > 0),
classes AS (SELECT s, min(pos) AS pos, count(*) AS n FROM numbered GROUP BY s),
words AS (SELECT pos, len(s) AS size, n, unnest(s) AS x FROM classes),
common AS (SELECT x, sum(n) AS df FROM words GROUP BY x),
ranked AS (SELECT pos, size, x, row_number() OVER (PARTITION BY pos ORDER BY df, x) AS place FROM words JOIN common USING (x)),
prefix AS (SELECT * FROM ranked WHERE place <= size - ({lines.NUMERATOR} * size + {lines.DENOMINATOR - 1}) // {lines.DENOMINATOR} + 1),
pairs AS (SELECT DISTINCT a.pos AS early, b.pos AS late FROM prefix a JOIN prefix b ON a.x = b.x AND a.pos < b.pos AND {lines.DENOMINATOR} * a.size >= {lines.NUMERATOR} * b.size AND {lines.DENOMINATOR} * b.size >= {lines.NUMERATOR} * a.size),
near AS (SELECT late, min(early) AS early FROM pairs JOIN classes a ON a.pos = early JOIN classes b ON b.pos = late
  WHERE {lines.NUMERATOR + lines.DENOMINATOR} * len(list_intersect(a.s, b.s)) >= {lines.NUMERATOR} * (len(a.s) + len(b.s)) GROUP BY late),
gone AS (SELECT doc_id, text, list(no) AS nos FROM numbered JOIN classes USING (s) LEFT JOIN near ON late = classes.pos WHERE numbered.pos > least(classes.pos, coalesce(early, classes.pos)) GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN nos IS NULL THEN t.text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(nos, i)), lambda i: ls[i]), chr(10)) END AS text,
  len(ls)::BIGINT AS n_lines, coalesce(len(nos), 0)::BIGINT AS n_removed
FROM documents d JOIN docs t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND coalesce(d.text, '') = t.text
LEFT JOIN gone g ON t.doc_id IS NOT DISTINCT FROM g.doc_id AND t.text = g.text
"""


def _mixed(x: str, key: int) -> str:
    """A subquery's column ``y`` for ``x`` of the row before, as ``sharding.mix`` has it."""
    m, first = sharding.BITS, f"(({x} % {sharding.BITS} + {sharding.BITS}) % {sharding.BITS} * 1103515245 + {key % sharding.BITS}) % {sharding.BITS}"
    second = lambda y: f"(xor({y}, {y} >> 15) * 69069 + {key // 7 % m}) % {m}"
    last = second(f"({first})")
    return f"xor({last}, ({last}) >> 13)"


def _feistel(source: str) -> str:
    """The network over ``x`` of ``source``, whose rows have the grid's ``a`` and ``b`` and the rows' ``number``."""
    out = f"(SELECT number, n, a, b, x // b AS l, x % b AS r FROM {source})"
    for k, key in enumerate(sharding.round_keys(sharding.SEED)):
        halves = f"l, (r + {_mixed('l', key)}) % b AS r" if k % 2 else f"(l + {_mixed('r', key)}) % a AS l, r"
        out = f"(SELECT number, n, a, b, {halves} FROM {out})"
    return f"(SELECT number, n, a, b, l * b + r AS x FROM {out})"


_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"

SHARDS = f"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, {_STEP}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
sized AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
  xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM documents, crc),
counted AS (SELECT greatest({sharding.LEAST_BUCKETS}, (count(*) + {sharding.BUCKET_ROWS - 1}) // {sharding.BUCKET_ROWS}) AS buckets FROM (SELECT DISTINCT * FROM sized)),
numbered AS (SELECT *, row_number() OVER (ORDER BY {_mixed(f'(coalesce(doc_id, 0) % {sharding.BITS} + size % {sharding.BITS} + text_crc32 % {sharding.BITS})', sharding.SEED)} % buckets, doc_id NULLS FIRST, size, text_crc32) - 1 AS number FROM sized, counted),
total AS (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS a FROM sized),
start AS (SELECT number, n, a, (n + a - 1) // a AS b, number AS x FROM numbered, total),
walk AS (SELECT * FROM {_feistel('start')} UNION ALL SELECT * FROM {_feistel('(SELECT * FROM walk WHERE x >= n)')})
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {sharding.SHARDS})::INTEGER AS shard, (x // {sharding.SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN walk USING (number) WHERE x < n
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINES, "op4_sharding": SHARDS, "op9_decontaminate": DECONTAMINATE}
