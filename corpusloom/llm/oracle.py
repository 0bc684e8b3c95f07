"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

_OP9 = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORM}) AS text_sha256
           FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
      FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256
FROM r
"""

_OP8 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                  CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
           FROM pages),
f AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM p
      WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM f
"""

# Every pair of equal words on one diagonal, without any seeds.
_OP2 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')),
                  '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')),
             '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'), lambda w: w <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, len(words) AS n_doc, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos
       FROM d),
bw AS (SELECT item_id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM b),
pairs AS (SELECT doc_id, item_id, n, p, pos - p AS start, n_doc FROM dw JOIN bw USING (w)),
many AS (SELECT doc_id, item_id, start FROM pairs GROUP BY ALL
         HAVING count(*) >= ceil(0.8 * least(16, any_value(n)))),
laid AS (SELECT doc_id, item_id, start, n,
                count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY p
                               RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS best,
                count(*) OVER (PARTITION BY doc_id, item_id, start) AS matched
         FROM pairs SEMI JOIN many USING (doc_id, item_id, start)
         WHERE least(n, n_doc - start) - greatest(0, -start) >= least(16, n)),
good AS (SELECT doc_id, item_id, start, any_value(n) AS item_words, max(best) AS best,
                any_value(matched) AS matched
         FROM laid GROUP BY ALL HAVING max(best) >= ceil(0.8 * least(16, any_value(n))))
SELECT doc_id, item_id, start, best, matched, item_words FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, start) = 1
"""

# The unsigned crc32 of a string, over a table of 256 remainders.
_CRC_TABLE = """crc AS (SELECT list(list_reduce(range(8),
    lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), b) ORDER BY b) AS rest
  FROM range(256) r(b))"""


def _crc32(text: str) -> str:
    code = f"hex(encode({text}))"
    steps = f"list_transform(range(length({code}) // 2), lambda i: ('0x' || substr({code}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, rest[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


_OP11 = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, coalesce(text, '') AS x,
             sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 5 AS base, {_crc32("c::VARCHAR")} % 9 AS h
      FROM (SELECT DISTINCT c FROM t), crc),
got AS (SELECT v.c, h, count(t.p) AS m FROM v LEFT JOIN t ON t.c = v.base AND t.p <= v.h GROUP BY ALL),
rb AS (SELECT v.c, p AS d, k, strlen(x) AS b FROM v JOIN t ON t.c = v.base AND t.p <= v.h
       UNION ALL
       SELECT c, p - h + m, k, strlen(x) FROM got JOIN t USING (c) WHERE p > h),
pre AS (SELECT c, d, b, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path FROM rb
        UNION ALL SELECT c, 0, 0, '' FROM v),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n, any_value(b) AS b FROM pre GROUP BY ALL),
up AS (SELECT n.path, n.d, n.n, n.b, n.conv_id, a.path AS above, a.d AS above_d
       FROM nodes n JOIN pre a ON a.c = n.conv_id AND a.d <= n.d),
kids AS (SELECT above AS path, count(*) AS n_children FROM up WHERE above_d = d - 1 GROUP BY ALL),
below AS (SELECT above AS path, sum((n - 1) * b) AS saved, count(*) FILTER (path NOT IN (FROM kids SELECT path)) AS leaves
          FROM up GROUP BY ALL),
lengths AS (SELECT c, max(d) AS d FROM pre GROUP BY ALL),
ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM pre JOIN lengths USING (c, d) GROUP BY ALL),
parents AS (SELECT u.path, p.conv_id AS parent FROM up u JOIN nodes p ON p.path = u.above WHERE above_d = u.d - 1)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs,
       coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes LEFT JOIN kids USING (path) JOIN below USING (path) LEFT JOIN ends USING (path)
LEFT JOIN parents USING (path)
"""

_OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
long AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
drawn AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM long, crc),
bent AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                     ELSE run END AS word, n FROM drawn),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM bent WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2),
cut AS (SELECT word, n, length(word) AS l, i, left(word, i - 1) || substr(word, i + 1) AS rest
        FROM w, range(1, length(word) + 1) r(i)),
pairs AS (SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y USING (rest, i, l)
          WHERE x.word <> y.word
          UNION SELECT w.word, w.n, c.word, c.n FROM w JOIN cut c ON c.rest = w.word
          UNION SELECT c.word, c.n, w.word, w.n FROM w JOIN cut c ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n
         FROM pairs GROUP BY ALL),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
                 CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root FROM found
        UNION ALL SELECT way.word, found.form FROM way JOIN found ON found.word = way.root WHERE found.form IS NOT NULL),
last AS (SELECT way.word, way.root FROM way JOIN found ON found.word = way.root WHERE found.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN last USING (word)
"""

ORACLE = {
    "op2_decontaminate": _OP2,
    "op8_warc": _OP8,
    "op9_exact_dedup": _OP9,
    "op11_prefix_trie": _OP11,
    "op12_spelling": _OP12,
}
