"""The registered queries of this subpackage and the SQL that some can be held against.

Without SQL: 1 (draws of a keyed hypergeometric tree), 6 (approximate search),
8 (ids of a tokenizer, keyed permutation), 9 (trained models), 10 (tokenizer,
greedy retrieval). Tests hold those against plain versions.
"""

from __future__ import annotations

from .ann import op6_ann
from .chat import CLOSE, CONTROL, OPEN, op7_chat
from .cotrain import op9_cotrain
from .mixing import op1_mix
from .neardup import op2_neardup
from .packing import op10_packing
from .repetition import op4_repetition
from .sharding import op3_shard
from .tokenbin import op8_tokenbin
from .warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_mix, op2_neardup, op3_shard, op4_repetition, op5_warc, op6_ann, op7_chat, op8_tokenbin, op9_cotrain, op10_packing)}

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (
  SELECT doc_id AS id, doc_id AS seen FROM w
  UNION
  SELECT r.id, z.t FROM r JOIN (SELECT a AS f, b AS t FROM e UNION ALL SELECT b, a FROM e) z ON z.f = r.seen),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def _tree_sql(n: int) -> str:
    """The descent of ``sharding.tree_of(n)`` for n of 8 or 9, written out."""
    draw = lambda node, weight: f"-ln((('0x' || substr(md5(k || ':{node}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}"
    pair = lambda a, b, x, y, w: f"CASE WHEN {draw(a, w)} <= {draw(b, w)} THEN {x} ELSE {y} END"
    rack = lambda s: pair(f"s{s}", f"s{s + 1}", s, s + 1, 1)
    region = lambda r: pair(f"k{r}/0", f"k{r}/1", rack(4 * r), rack(4 * r + 2), 2)
    if n == 8:
        return pair("r0", "r1", region(0), region(1), 4)
    a, b, c = draw("r0", 4), draw("r1", 4), draw("rown8", 1)
    return f"CASE WHEN {a} <= {b} AND {a} <= {c} THEN {region(0)} WHEN {b} <= {c} THEN {region(1)} ELSE 8 END"


OP3 = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS x FROM documents),
b AS (
  SELECT doc_id, k, octet_length(encode(x)) + 1 AS size, hex(encode(x)) AS h FROM d),
m AS (
  SELECT doc_id, k, size,
    xor(list_reduce(list_concat([4294967295], list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS text_crc32,
    {_tree_sql(8)} AS shard, {_tree_sql(9)} AS grown_shard
  FROM b, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 13), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM m
"""


def _covered_sql(k: int) -> str:
    return f"""(
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i + {k - 1}], ' '))) AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w)), (SELECT unnest(range({k})) AS j)
  WHERE c > 1 GROUP BY 1)"""


OP4 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT y) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS y FROM w)
  WHERE regexp_matches(y, {_WORDS}) GROUP BY 1),
b AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered_words, coalesce(o.n, 0) > 0 AS over_100
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN {_covered_sql(3)} r USING (doc_id) LEFT JOIN {_covered_sql(8)} c USING (doc_id)
    LEFT JOIN {_covered_sql(101)} o USING (doc_id))
SELECT *, NOT base_failed AND NOT (100 * n_covered_words > 30 * n_words OR over_100) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes,
    array_to_string(list_transform(range(1, 41), lambda j: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', sha1(h)[j])]), '') AS bits,
    max(page_id) OVER (PARTITION BY sha1(h), octet_length(encode(h))) AS keeper
  FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1]), '') AS payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d
"""


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP7 = f"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, {len(OPEN) + len(CLOSE) + 1} + length(replace({_escaped('role')}, chr(10), '\\n')) + length({_escaped('text')}) AS width FROM a),
o AS (
  SELECT *, sum(width) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR r = n))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

ORACLES = {"op2_neardup": OP2, "op3_shard": OP3, "op4_repetition": OP4, "op5_warc": OP5, "op7_chat": OP7}
