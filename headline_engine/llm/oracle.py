"""DuckDB SQL for the registered queries that SQL can express, written from the result definitions."""

from __future__ import annotations

from headline_engine.llm import linechunks, lmscore

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL = {
    "op1_decontamination": f"""
WITH dw AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
iw AS (SELECT item_id, {_words('text')} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS k, least(len(ws), 10) AS n
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
pos AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM pos p JOIN win w ON p.k = w.k AND p.n = w.n),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_lm_scores": f"""
WITH dw AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
occ AS (SELECT doc_id, j, ws[j] AS w, CASE WHEN j > 1 THEN ws[j - 1] END AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM dw)),
ut AS (SELECT w, count(*) AS c FROM occ GROUP BY w),
uo AS (SELECT doc_id, w, count(*) AS c FROM occ GROUP BY doc_id, w),
u AS (SELECT uo.doc_id, uo.w, ut.c - uo.c AS c FROM uo JOIN ut USING (w)),
bt AS (SELECT p, w, count(*) AS c FROM occ WHERE p IS NOT NULL GROUP BY p, w),
bo AS (SELECT doc_id, p, w, count(*) AS c FROM occ WHERE p IS NOT NULL GROUP BY doc_id, p, w),
b AS (SELECT bo.doc_id, bo.p, bo.w, bt.c - bo.c AS c FROM bo JOIN bt USING (p, w)),
n AS (SELECT doc_id, sum(len(ws)) OVER () - len(ws) AS others FROM dw),
s AS (SELECT o.doc_id, sum(CASE
        WHEN b.c > 0 THEN log10(b.c / up.c)
        ELSE CASE WHEN o.p IS NULL THEN 0 ELSE log10({lmscore.ALPHA}) END + CASE WHEN uw.c > 0 THEN log10(uw.c / n.others) ELSE -log10(n.others + 1) END END) AS x
      FROM occ o JOIN n ON n.doc_id = o.doc_id JOIN u uw ON uw.doc_id = o.doc_id AND uw.w = o.w
      LEFT JOIN u up ON up.doc_id = o.doc_id AND up.w = o.p LEFT JOIN b ON b.doc_id = o.doc_id AND b.p = o.p AND b.w = o.w
      GROUP BY o.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 4) AS log10_score,
       round(coalesce(x / nullif(len(ws), 0), 0), 6) AS log10_per_word
FROM dw LEFT JOIN s USING (doc_id)""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op8_substring_dedup": """
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM dw WHERE len(ws) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM pos GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM pos JOIN least USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, j, ws[j] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM dw)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)""",
    "op9_line_dedup": f"""
WITH line AS (SELECT doc_id, i, ls[i] AS l, len(ls) AS n, ('0x' || substr(md5(ls[i]), 1, 8))::BIGINT AS h
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
roll AS (SELECT *, (i >= {linechunks.SPAN} AND (h + {linechunks.ROLL} * lag(h) OVER w) % {linechunks.DIVISOR} = 0) AS cut
         FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
part AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM roll),
chunk AS (SELECT doc_id, c, count(*) AS m, string_agg(l, chr(10) ORDER BY i) AS t FROM part GROUP BY doc_id, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, c) AS r FROM chunk WHERE m >= {linechunks.MIN_LINES}),
gone AS (SELECT doc_id, c FROM ranked WHERE r > 1),
kept AS (SELECT doc_id, count(*) AS m, string_agg(l, chr(10) ORDER BY i) AS t FROM part ANTI JOIN gone USING (doc_id, c) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(m, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op10_ngram_join": f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
cls AS (SELECT array_to_string(ws, ' ') AS k, min(doc_id) AS rep, count(*) AS n_same_text, any_value(ws) AS ws FROM dw GROUP BY 1),
g AS (SELECT DISTINCT rep, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [k]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM cls),
sz AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
pair AS (SELECT a.rep AS ra, b.rep AS rb, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.rep < b.rep GROUP BY 1, 2),
link AS (SELECT ra, rb FROM pair JOIN sz x ON x.rep = ra JOIN sz y ON y.rep = rb WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
both_ways AS (SELECT ra AS a, rb AS b FROM link UNION ALL SELECT rb, ra FROM link),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
grp AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS rep, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT d.doc_id, coalesce(grp.class_id, c.rep) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, c.rep AS same_text_id, c.n_same_text::BIGINT AS n_same_text
FROM dw d JOIN cls c ON c.k = array_to_string(d.ws, ' ') LEFT JOIN grp ON grp.rep = c.rep LEFT JOIN deg ON deg.rep = c.rep""",
}


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """op12: rounds unrolled; a nearest entry is the smallest (squared distance, index), squared distances are exact in doubles."""
    out = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, q, v[q * len(v) // {parts} + 1:(q + 1) * len(v) // {parts}]::DOUBLE[] AS p FROM kept, range({parts}) t(q)),
c0 AS MATERIALIZED (SELECT q, e, p AS c FROM (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e FROM cut) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, q, any_value(p) AS p,
  min({{'d': list_inner_product(p, p) - 2 * list_inner_product(p, c) + list_inner_product(c, c), 'e': e}}) AS m FROM cut JOIN c{r} USING (q) GROUP BY vec_id, q)""")
        if r < rounds:
            out.append(f"""
s{r} AS (SELECT q, m.e AS e, i, sum(p[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(p)) FROM cut) + 1) t(i) GROUP BY 1, 2, 3),
n{r} AS (SELECT q, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{r} GROUP BY q, e),
c{r + 1} AS MATERIALIZED (SELECT q, e, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n USING (q, e))""")
    out.append(f"""
f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e::INTEGER), '' ORDER BY q) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY q, e, i)) FROM (SELECT q, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM c{rounds})) AS codebooks_sha256
FROM f""")
    return ",".join(out)


SQL["op12_vector_codes"] = _vector_codes()

#: op11: crc32 bit by bit; a prefix is the chain of its turns' md5s; subtree totals go to every prefix of a node.
SQL["op11_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
sz AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
hs AS (SELECT conv_id, n, conv_id - conv_id % 20 AS donor, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda acc, byte:
      list_reduce(list_concat([xor(acc, byte)], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h FROM sz),
info AS (SELECT hs.conv_id, donor, h, hs.n, least(h, coalesce(d.n, 0)) AS k FROM hs LEFT JOIN sz d ON d.conv_id = donor),
reb AS (SELECT t.conv_id, pos - h + k AS d, r, x FROM t JOIN info USING (conv_id) WHERE pos > h
  UNION ALL SELECT i.conv_id, pos, r, x FROM info i JOIN t ON t.conv_id = i.donor AND t.pos <= i.k),
pre AS (SELECT conv_id, d, string_agg(md5(length(r) || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY d) AS k,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, max(d) OVER (PARTITION BY conv_id) = d AS last FROM reb
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM reb) FROM info),
node AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM pre GROUP BY k),
kid AS (SELECT k[1:length(k) - 32] AS k, count(*) AS n_children FROM node WHERE k <> '' GROUP BY 1),
sub AS (SELECT p.k, count(*) FILTER (WHERE kid.k IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM node u JOIN pre p ON p.conv_id = u.conv_id AND p.d <= u.depth LEFT JOIN kid ON kid.k = u.k GROUP BY p.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN sub USING (k) LEFT JOIN kid USING (k) LEFT JOIN node up ON n.k <> '' AND up.k = n.k[1:length(n.k) - 32]"""
