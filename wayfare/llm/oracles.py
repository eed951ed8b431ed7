"""SQL equivalents of those corpus queries that SQL can say, for tables of the size of the tests.

They are plain: whole joins, windows and recursion, without the operators' ways of bounding memory.
"""

from __future__ import annotations

from . import mixing

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"


def _hash(*parts: str) -> str:
    """What common.hashed gives."""
    return f"CAST('0x' || substr(sha256({(' || ' + repr('|') + ' || ').join(parts)}), 1, 15) AS BIGINT)"


OP9 = f"""WITH d AS (SELECT doc_id, source, len({WORDS.format(text=_TEXT)}) AS size, {_hash("'mix'", "coalesce(CAST(doc_id AS VARCHAR), '')", _TEXT)} AS tie, CAST(floor(log2(len({WORDS.format(text=_TEXT)}) + 1) * 8) AS INT) AS band FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % {len(mixing.WEIGHTS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(mixing.WEIGHTS))} END AS weight FROM s),
r AS (SELECT *, {mixing.MOST} * words / CAST(weight AS DOUBLE) AS full_at, row_number() OVER (ORDER BY {mixing.MOST} * words / CAST(weight AS DOUBLE), nth) AS k FROM w),
c AS (SELECT *, (SELECT sum(words) FROM s) - coalesce(sum({mixing.MOST} * words) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM r),
u AS (SELECT coalesce(arg_min(left_words / CAST(left_weight AS DOUBLE), k) FILTER (left_words / CAST(left_weight AS DOUBLE) <= full_at), 1e300) AS unit FROM c),
g AS (SELECT source, words, least(CAST({mixing.MOST} * words AS DOUBLE), unit * weight) AS target, CAST('0x' || substr(sha256('mix|0|' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS shift FROM w, u),
n AS (SELECT d.*, CAST(ceil(count(*) OVER (PARTITION BY d.source, band) / CAST(greatest({mixing.LEAST}, (SELECT count(*) FROM d) // ({mixing.SPREAD} * 200)) AS DOUBLE)) AS BIGINT) AS salts FROM d),
p AS (SELECT n.*, row_number() OVER (PARTITION BY n.source ORDER BY band, tie % salts, size, tie) AS place FROM n)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target, CAST((floor(place * each + shift) - floor((place - 1) * each + shift)) * size AS BIGINT) AS taken FROM (SELECT p.*, g.words, g.target, g.shift, CASE WHEN g.words > 0 THEN g.target / g.words ELSE 0 END AS each FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)"""

_SHARDS = 24
#: CRC-32 by its rule: eight steps of the reversed polynomial a byte.
_STEP = "(CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END)"


def _table_entry(x: str) -> str:
    for _ in range(8):
        x = f"list_transform([{x}], lambda z : CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END)[1]"
    return x


OP4 = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b : {_table_entry('b')}) AS t),
e AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x : CAST('0x' || x AS BIGINT)) AS b FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
k AS (SELECT text, CASE WHEN len(b) = 0 THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda s, x : xor(t[xor(s, x) % 256 + 1], s // 256)), 4294967295) END AS crc FROM e, crc),
d AS (SELECT doc_id, CAST(coalesce(strlen(documents.text), 0) + 8 AS BIGINT) AS size, CAST(coalesce(k.crc, 0) AS BIGINT) AS text_crc32, CASE WHEN documents.text IS NULL THEN -1 ELSE {_hash('documents.text')} END AS h FROM documents LEFT JOIN k ON k.text = documents.text),
g AS (SELECT h, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY h),
o AS (SELECT list(s ORDER BY h) AS sums, max(s) AS total, max(bytes) AS most FROM (SELECT h, bytes, CAST(sum(bytes) OVER (ORDER BY h) AS BIGINT) AS s FROM g)),
find(lo, hi, base, cuts) AS (SELECT greatest(most, -(-total // {_SHARDS})), total, CAST(0 AS BIGINT), 0 FROM o
UNION ALL SELECT CASE WHEN nb < total AND cuts + 1 >= {_SHARDS} THEN cap + 1 ELSE lo END, CASE WHEN nb = total THEN cap ELSE hi END, CASE WHEN nb = total OR cuts + 1 >= {_SHARDS} THEN 0 ELSE nb END, CASE WHEN nb = total OR cuts + 1 >= {_SHARDS} THEN 0 ELSE cuts + 1 END
FROM (SELECT lo, hi, base, cuts, (lo + hi) // 2 AS cap, total, list_max(list_filter(sums, lambda x : x <= base + (lo + hi) // 2)) AS nb FROM find, o WHERE lo < hi)),
best AS (SELECT min(hi) AS cap FROM find),
cut(shard, base) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT shard + 1, list_max(list_filter(sums, lambda x : x <= base + cap)) FROM cut, o, best WHERE base < total),
p AS (SELECT h, CAST(sum(bytes) OVER (ORDER BY h) AS BIGINT) AS s FROM g),
a AS (SELECT p.h, (SELECT count(*) - 1 FROM cut WHERE cut.base < p.s) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY d.h, doc_id NULLS FIRST, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM d JOIN a ON a.h = d.h"""

#: Sets of word shingles, links by counting shared ones, components by spreading the least id.
OP6 = f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM t),
node AS (SELECT sha256(array_to_string(list_sort(s), chr(10))) AS n, min(r) AS rep, len(min(s)) AS size, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 1),
item AS (SELECT n, size, unnest(s) AS x FROM node),
link AS (SELECT a.n AS u, b.n AS v FROM item a JOIN item b ON a.x = b.x AND a.n < b.n AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size) GROUP BY a.n, b.n, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
walk(n, root) AS (SELECT n, n FROM node UNION SELECT edge.v, walk.root FROM walk JOIN edge ON edge.u = walk.n),
comp AS (SELECT n, min(root) AS root FROM walk GROUP BY n),
own AS (SELECT r, doc_id, len(s) AS k, CASE WHEN len(s) > 0 THEN sha256(array_to_string(list_sort(s), chr(10))) END AS n FROM sets),
named AS (SELECT root, min(doc_id) AS component_id FROM own JOIN comp ON comp.n = own.n GROUP BY root)
SELECT doc_id, CAST(k AS BIGINT) AS n_shingles, CASE WHEN k > 0 THEN component_id ELSE doc_id END AS component_id FROM own LEFT JOIN comp ON comp.n = own.n LEFT JOIN named ON named.root = comp.root"""

#: Every 100-byte string, its first place, the bytes that later places cover, and what is left.
OP8 = """WITH t AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, coalesce(text, '')) AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5(hex(b[i:i + 99])) AS s FROM (SELECT r, b, unnest(range(1, n - 98)) AS i FROM t WHERE n >= 100)),
f AS (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM w),
c AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM f WHERE k > 1),
g AS (SELECT r, i, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM c),
s AS (SELECT r, span, min(i) AS lo, max(i) + 99 AS hi FROM g GROUP BY r, span),
h AS (SELECT r, span, lo, hi, lag(hi) OVER (PARTITION BY r ORDER BY span) AS before FROM s),
z AS (SELECT r, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM s GROUP BY r),
kept AS (SELECT h.r, string_agg(hex(b[coalesce(before, 0) + 1:lo - 1]), '' ORDER BY span) AS x FROM h JOIN t ON t.r = h.r GROUP BY h.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN z.r IS NULL THEN b ELSE unhex(x || hex(b[last + 1:n])) END) AS kept_sha256 FROM t LEFT JOIN z ON z.r = t.r LEFT JOIN kept ON kept.r = t.r"""

ORACLES = {"op4_sharding": OP4, "op6_jaccard_join": OP6, "op8_suffix_dedup": OP8, "op9_mixing": OP9}
