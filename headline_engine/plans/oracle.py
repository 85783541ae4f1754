"""Oracle SQL for DuckDB over the driver tables, written independently of the Spark plans.

Each statement restates the adapter (FIXTURES §2) and the operator semantics in
plain SQL. Column names equal the Spark query's aliases.
"""

from __future__ import annotations

from headline_engine.config import DRIVER_CONFIG

CFG = DRIVER_CONFIG

# JavaScript trim set and key/token patterns (RE2 syntax, same code points as the Spark side)
WS = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
KEYDROP = r"[^\x{4e00}-\x{9fa5}a-z0-9]"
TOKRE = r"[\x{4e00}-\x{9fa5}]|[a-z0-9]+"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trimjs(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def keyof(x: str) -> str:
    return f"regexp_replace(lower({x}), '{KEYDROP}', '', 'g')"


def weight_sql(n: str, s: str, top: str) -> str:
    return (
        f"(((1.0::DOUBLE / ({s}::DOUBLE / {n}::DOUBLE)) * 0.6::DOUBLE + {n}::DOUBLE * 0.3::DOUBLE)"
        f" + ({top}::DOUBLE / {n}::DOUBLE) * 0.1::DOUBLE)"
    )


# documents -> snapshots -> items -> headlines
BASE = f"""
docs AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS crawl_id
  FROM documents),
plat AS (
  SELECT platform_id, row_number() OVER (ORDER BY platform_id) AS platform_ord
  FROM (SELECT DISTINCT source AS platform_id FROM documents WHERE source IS NOT NULL)),
raw_items AS (
  SELECT crawl_id, TIMESTAMP '2024-01-01 00:00:00' + (crawl_id - 1) * INTERVAL 12 HOUR AS crawl_ts,
         source AS platform_id,
         unnest(string_split(text, chr(10))) AS raw_title,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS rank
  FROM docs WHERE text IS NOT NULL),
items AS (
  SELECT crawl_id, crawl_ts, platform_id, rank, {trimjs('raw_title')} AS title FROM raw_items),
valid AS (SELECT * FROM items WHERE title IS NOT NULL AND title <> ''),
heads AS (
  SELECT v.crawl_id, v.crawl_ts, v.platform_id, p.platform_ord, v.platform_id AS source, v.title,
         list(v.rank ORDER BY v.rank) AS ranks, count(*) AS appearances, min(v.rank) AS first_rank,
         sum(v.rank) AS rank_sum, count(*) FILTER (WHERE v.rank <= 10) AS top_count
  FROM valid v JOIN plat p USING (platform_id)
  GROUP BY v.crawl_id, v.crawl_ts, v.platform_id, p.platform_ord, v.title),
hw AS (
  SELECT *, {weight_sql('appearances', 'rank_sum', 'top_count')} AS weight FROM heads)
"""

# rule text -> rules, filters
RULES = f"""
rt AS (SELECT {_lit(CFG.rules_text)} AS text),
rgrp AS (
  SELECT unnest(string_split(text, chr(10) || chr(10))) AS gtext,
         unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS group_ord
  FROM rt),
rline AS (
  SELECT group_ord, unnest(string_split(gtext, chr(10))) AS line,
         unnest(range(0, len(string_split(gtext, chr(10))))) AS line_ord
  FROM rgrp WHERE {trimjs('gtext')} <> ''),
rw AS (
  SELECT group_ord, line_ord, lower({trimjs('line')}) AS w FROM rline WHERE {trimjs('line')} <> ''),
rk AS (
  SELECT group_ord, line_ord,
         CASE WHEN starts_with(w, '@') THEN 'cap' WHEN starts_with(w, '!') THEN 'exclude'
              WHEN starts_with(w, '+') THEN 'required' ELSE 'normal' END AS kind,
         CASE WHEN starts_with(w, '!') OR starts_with(w, '+') THEN substr(w, 2) ELSE w END AS word,
         TRY_CAST(NULLIF(regexp_extract(w, '^@{WS}*([+-]?[0-9]+)', 1), '') AS INTEGER) AS cap
  FROM rw),
rules AS (
  SELECT g.group_ord,
         CASE WHEN len(g.normal) > 0 THEN array_to_string(g.normal, ' ') ELSE array_to_string(g.required, ' ') END AS group_key,
         g.required, g.normal,
         coalesce((SELECT arg_max(c.cap, c.line_ord) FROM rk c
                   WHERE c.group_ord = g.group_ord AND c.kind = 'cap' AND c.cap > 0), 0) AS max_count
  FROM (SELECT group_ord,
               coalesce(list(word ORDER BY line_ord) FILTER (WHERE kind = 'required' AND word <> ''), []) AS required,
               coalesce(list(word ORDER BY line_ord) FILTER (WHERE kind = 'normal' AND word <> ''), []) AS normal
        FROM rk GROUP BY group_ord) g
  WHERE len(g.required) > 0 OR len(g.normal) > 0),
filters AS (SELECT DISTINCT word FROM rk WHERE kind = 'exclude' AND word <> ''),
caps AS (
  SELECT group_key, min(group_ord) AS key_ord,
         CASE WHEN arg_min(max_count, group_ord) > 0 THEN arg_min(max_count, group_ord) ELSE {CFG.default_cap} END AS cap
  FROM rules GROUP BY group_key)
"""

MATCH = """
kept AS (
  SELECT * FROM hw h WHERE NOT EXISTS (SELECT 1 FROM filters f WHERE contains(lower(h.title), f.word))),
matched AS (
  SELECT h.*, r.group_ord, r.group_key
  FROM kept h JOIN rules r
    ON len(list_filter(r.required, lambda w: NOT contains(lower(h.title), w))) = 0
   AND (len(r.normal) = 0 OR len(list_filter(r.normal, lambda w: contains(lower(h.title), w))) > 0)),
ranked AS (
  SELECT m.*, c.cap, c.key_ord,
         row_number() OVER (PARTITION BY m.crawl_id, m.group_key
                            ORDER BY m.appearances DESC, m.weight DESC, m.platform_ord, m.first_rank, m.group_ord) AS rank_in_group
  FROM matched m JOIN caps c USING (group_key)),
capped AS (SELECT * FROM ranked WHERE rank_in_group <= cap)
"""


def with_ctes(*parts: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


H = with_ctes(BASE)
R = with_ctes(BASE, RULES, MATCH)

SQL = {
    "feed_explode": H + """
SELECT v.crawl_id, strftime(v.crawl_ts, '%Y-%m-%d %H:%M:%S') AS crawl_ts, p.platform_ord, v.platform_id, v.rank, v.title
FROM valid v JOIN plat p USING (platform_id)""",
    "rank_collapse": H + """
SELECT crawl_id, platform_id, title, array_to_string(ranks, ',') AS ranks, appearances::BIGINT AS appearances,
       first_rank::BIGINT AS first_rank, '' AS url, '' AS mobile_url
FROM hw""",
    "weights": H + """
SELECT crawl_id, platform_id, title, round(weight, 9) AS weight, appearances >= 3 AS is_hot FROM hw""",
    "match_groups": R + """
SELECT crawl_id, platform_id, source, title, group_ord::BIGINT AS group_ord, group_key, round(weight, 9) AS weight
FROM matched""",
    "top_headlines": R + """
SELECT crawl_id, group_key, rank_in_group::BIGINT AS rank_in_group, platform_id, title, round(weight, 9) AS weight,
       appearances::BIGINT AS appearances, first_rank::BIGINT AS first_rank
FROM capped""",
}


def local(x: str) -> str:
    return f"(({x} AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai')"


def esc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def toks(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{TOKRE}'))"


NREG = "(SELECT count(DISTINCT source) FROM documents WHERE source IS NOT NULL)"
ASOF = "(SELECT TIMESTAMP '2024-01-01 00:00:00' + (max(crawl_id) - 1) * INTERVAL 12 HOUR + INTERVAL 1 HOUR FROM docs)"

TOTALS = f"""
reported AS (SELECT DISTINCT crawl_id, crawl_ts FROM (SELECT crawl_id, text, TIMESTAMP '2024-01-01 00:00:00' + (crawl_id - 1) * INTERVAL 12 HOUR AS crawl_ts FROM docs)
             WHERE text IS NOT NULL),
totals AS (
  SELECT crawl_id, crawl_ts, count(title) AS total_news, count(*) FILTER (WHERE appearances >= 3) AS hot_news,
         strftime({local('crawl_ts')}, '%Y%m%d') AS report_day,
         strftime({local('crawl_ts')}, '%Y年%m月%d日') AS generate_date,
         strftime({local('crawl_ts')}, '%H时%M分') AS generate_time
  FROM reported LEFT JOIN capped USING (crawl_id, crawl_ts) GROUP BY crawl_id, crawl_ts)
"""

NOVELTY_CAPPED = f"""
ck AS (SELECT c.*, {keyof('c.title')} AS title_key FROM capped c),
cn AS (SELECT DISTINCT title_key, crawl_id, crawl_ts FROM ck),
cnl AS (
  SELECT title_key, crawl_id,
         (lg IS NULL OR epoch(crawl_ts) - epoch(lg) >= 7 * 86400) AS is_new
  FROM (SELECT *, lag(crawl_ts) OVER (PARTITION BY title_key ORDER BY crawl_ts) AS lg FROM cn)),
cnew AS (SELECT ck.*, cnl.is_new FROM ck JOIN cnl USING (title_key, crawl_id)),
per AS (
  SELECT r.crawl_id, r.crawl_ts, count(DISTINCT title) AS current_titles, count(*) FILTER (WHERE is_new) AS new_items,
         array_to_string((list(substr(title, 1, 30) || '...' ORDER BY key_ord, rank_in_group) FILTER (WHERE is_new))[1:3], ' | ') AS samples
  FROM reported r LEFT JOIN cnew ON cnew.crawl_id = r.crawl_id GROUP BY r.crawl_id, r.crawl_ts),
hist AS (SELECT DISTINCT title, crawl_ts FROM capped),
hn AS (
  SELECT p.crawl_ts, count(DISTINCT h.title) AS n
  FROM (SELECT DISTINCT crawl_ts FROM per) p JOIN hist h
    ON h.crawl_ts > p.crawl_ts - INTERVAL 7 DAY AND h.crawl_ts < p.crawl_ts
  GROUP BY p.crawl_ts),
incr AS (
  SELECT per.crawl_id, coalesce(hn.n, 0) AS history_titles, current_titles, new_items, coalesce(samples, '') AS samples
  FROM per LEFT JOIN hn USING (crawl_ts)),
push AS (
  SELECT crawl_id, new_items, new_items > 0 AS push,
         CASE WHEN new_items > 0 THEN '发现' || new_items || '条新内容' ELSE '无新内容' END AS push_reason
  FROM incr)
"""

HK = f"""
hk AS (SELECT DISTINCT {keyof('title')} AS title_key, crawl_id, crawl_ts FROM heads),
hkn AS (
  SELECT title_key, crawl_id, crawl_ts,
         (lg IS NULL OR epoch(crawl_ts) - epoch(lg) >= 7 * 86400) AS is_new
  FROM (SELECT *, lag(crawl_ts) OVER (PARTITION BY title_key ORDER BY crawl_ts) AS lg FROM hk))
"""

RC = with_ctes(BASE, RULES, MATCH, TOTALS, NOVELTY_CAPPED)
HN = with_ctes(BASE, HK)

SQL.update({
    "report_totals": RC + """
SELECT crawl_id, report_day, 'incremental' AS report_mode, '增量监控' AS mode_label, total_news, hot_news, generate_date, generate_time FROM totals""",
    "group_summary": RC + """
SELECT crawl_id, group_key, count(*) AS item_count,
       CASE WHEN count(*) >= 20 THEN 'hot' WHEN count(*) >= 10 THEN 'warm' ELSE '' END AS heat,
       row_number() OVER (PARTITION BY crawl_id ORDER BY min(key_ord))::BIGINT AS group_index,
       (SELECT count(*) FROM caps)::BIGINT AS total_groups
FROM capped GROUP BY crawl_id, group_key""",
    "report_view": RC + f"""
SELECT crawl_id, group_key, rank_in_group::BIGINT AS rank_in_group, {esc('source')} AS source_html,
       first_rank::BIGINT AS first_rank,
       CASE WHEN first_rank <= 3 THEN 'top' WHEN first_rank <= 10 THEN 'high' ELSE '' END AS rank_badge,
       {esc('title')} AS title_html, {esc("''")} AS url_html, is_new
FROM cnew""",
    "report_latest_per_day": RC + """
SELECT report_day, arg_max(crawl_id, crawl_ts) AS crawl_id, arg_max(total_news, crawl_ts) AS total_news,
       arg_max(hot_news, crawl_ts) AS hot_news, arg_max(generate_date, crawl_ts) AS generate_date,
       arg_max(generate_time, crawl_ts) AS generate_time
FROM totals GROUP BY report_day""",
    "crawl_outcome": with_ctes(BASE) + f"""
SELECT crawl_id, count(*) FILTER (WHERE text IS NOT NULL) AS ok_platforms,
       {NREG} - count(*) FILTER (WHERE text IS NOT NULL) AS failed_platforms,
       count(*) FILTER (WHERE text IS NOT NULL) > 0 AS has_report
FROM docs GROUP BY crawl_id""",
    "title_keys": H + f"""
SELECT title, {keyof('title')} AS title_key, length({keyof('title')})::BIGINT AS key_len,
       len({toks(keyof('title'))})::BIGINT AS n_tokens, len({toks('lower(title)')})::BIGINT AS n_words
FROM (SELECT DISTINCT title FROM heads)""",
    "novelty": HN + """
SELECT title_key, crawl_id, is_new FROM hkn""",
    "presence_sessions": HN + """
SELECT title_key, strftime(min(crawl_ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(max(crawl_ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*)::BIGINT AS sightings
FROM (SELECT *, sum(is_new::INT) OVER (PARTITION BY title_key ORDER BY crawl_ts ROWS UNBOUNDED PRECEDING) AS sess FROM hkn)
GROUP BY title_key, sess""",
    "strict_dedup": RC + """
SELECT crawl_id, title_key, title, group_key, rank_in_group::BIGINT AS rank_in_group
FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, title_key ORDER BY key_ord, rank_in_group) AS rn
      FROM cnew WHERE is_new) WHERE rn = 1""",
    "history_asof": RC + f"""
SELECT DISTINCT title, {keyof('title')} AS title_key FROM (SELECT DISTINCT crawl_id, crawl_ts, title FROM capped)
WHERE crawl_ts > {ASOF} - INTERVAL 7 DAY AND crawl_ts <= {ASOF}
  AND strftime({local('crawl_ts')}, '%Y%m%d') <> strftime({local(ASOF)}, '%Y%m%d')""",
    "history_stats": RC + f"""
SELECT count(DISTINCT crawl_ts) AS live_records, count(*) AS total_titles, count(DISTINCT title) AS distinct_titles
FROM (SELECT DISTINCT crawl_id, crawl_ts, title FROM capped)
WHERE crawl_ts > {ASOF} - INTERVAL 7 DAY AND crawl_ts <= {ASOF}""",
    "increment_stats": RC + """
SELECT crawl_id, history_titles, current_titles, new_items, samples FROM incr""",
    "push_decision": RC + """
SELECT crawl_id, new_items, push, push_reason FROM push""",
    "crawl_summary": RC + f""",
oc AS (SELECT crawl_id, count(*) FILTER (WHERE text IS NOT NULL) AS ok_platforms FROM docs GROUP BY crawl_id)
SELECT oc.crawl_id, coalesce(t.total_news, 0) AS total_news, coalesce(t.hot_news, 0) AS hot_news,
       oc.ok_platforms, {NREG} - oc.ok_platforms AS failed_platforms,
       coalesce(p.push, false) AS notification_sent, coalesce(p.push_reason, '无新内容') AS push_reason
FROM oc LEFT JOIN totals t USING (crawl_id) LEFT JOIN push p USING (crawl_id)""",
})


def jacc(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
            f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END)")


def hybrid(ka: str, kb: str, j: str, la: str, lb: str) -> str:
    return (f"(CASE WHEN {ka} = {kb} THEN 1.0::DOUBLE "
            f"WHEN {j} * 0.6::DOUBLE + 0.4::DOUBLE < 0.8::DOUBLE THEN {j} * 0.6::DOUBLE "
            f"ELSE {j} * 0.6::DOUBLE + (1.0::DOUBLE - levenshtein({ka}, {kb})::DOUBLE / greatest({la}, {lb})::DOUBLE) * 0.4::DOUBLE END)")


GUARD = "NOT (abs(a.kl - b.kl) > greatest(a.kl, b.kl) * 0.6::DOUBLE)"
SIZE23 = "least(len(a.tk), len(b.tk))::DOUBLE >= greatest(len(a.tk), len(b.tk))::DOUBLE * (2.0 / 3.0) - 1e-9"

UNITS = f"""
uk AS (
  SELECT crawl_id, title, {keyof('title')} AS k, length({keyof('title')}) AS kl, {toks('lower(title)')} AS tk
  FROM (SELECT DISTINCT crawl_id, title FROM heads))
"""
GUNITS = f"""
gk AS (
  SELECT title, {keyof('title')} AS k, length({keyof('title')}) AS kl, {toks('lower(title)')} AS tk
  FROM (SELECT DISTINCT title FROM heads))
"""
CHARS = """
ck2 AS (
  SELECT crawl_id, title, list_distinct(regexp_extract_all(lower(title), '(?s).')) AS tk
  FROM (SELECT DISTINCT crawl_id, title FROM heads))
"""
DEDUP_IN = f"""
di AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, title_key ORDER BY key_ord, rank_in_group) AS rn
                 FROM cnew WHERE is_new) WHERE rn = 1),
dk AS (SELECT crawl_id, crawl_ts, title, title_key AS k, length(title_key) AS kl, {toks('lower(title)')} AS tk FROM di),
hu AS (
  SELECT h_ts, title, {keyof('title')} AS k, length({keyof('title')}) AS kl, {toks('lower(title)')} AS tk
  FROM (SELECT DISTINCT crawl_ts AS h_ts, title FROM capped)),
hpairs AS (
  SELECT a.crawl_id, a.title, {jacc('a.tk', 'b.tk')} AS j, a.k AS ka, b.k AS kb, a.kl AS la, b.kl AS lb
  FROM dk a JOIN hu b ON b.h_ts > a.crawl_ts - INTERVAL 7 DAY AND b.h_ts < a.crawl_ts AND {GUARD}
  WHERE len(a.tk) > 0 AND len(b.tk) > 0),
hdup AS (SELECT DISTINCT crawl_id, title FROM hpairs WHERE {hybrid('ka', 'kb', 'j', 'la', 'lb')} > 0.8::DOUBLE),
dflag AS (
  SELECT di.*, (hdup.title IS NOT NULL) AS hist_dup FROM di LEFT JOIN hdup USING (crawl_id, title))
"""

SQL.update({
    "jaccard_pairs": with_ctes(BASE, UNITS) + f"""
SELECT crawl_id, title_a, title_b, round(j, 9) AS jaccard FROM (
  SELECT a.crawl_id, a.title AS title_a, b.title AS title_b, {jacc('a.tk', 'b.tk')} AS j
  FROM uk a JOIN uk b ON a.crawl_id = b.crawl_id AND a.title < b.title)
WHERE j > 0.1::DOUBLE""",
    "char_jaccard_pairs": with_ctes(BASE, CHARS) + f"""
SELECT crawl_id, title_a, title_b, round(j, 9) AS jaccard FROM (
  SELECT a.crawl_id, a.title AS title_a, b.title AS title_b, {jacc('a.tk', 'b.tk')} AS j
  FROM ck2 a JOIN ck2 b ON a.crawl_id = b.crawl_id AND a.title < b.title)
WHERE j > 0.8::DOUBLE""",
    "near_dup_edges": with_ctes(BASE, UNITS) + f"""
SELECT crawl_id, title_a, title_b, round(sim, 9) AS sim FROM (
  SELECT crawl_id, title_a, title_b, {hybrid('ka', 'kb', 'j', 'la', 'lb')} AS sim FROM (
    SELECT a.crawl_id, a.title AS title_a, b.title AS title_b, a.k AS ka, b.k AS kb, a.kl AS la, b.kl AS lb,
           {jacc('a.tk', 'b.tk')} AS j
    FROM uk a JOIN uk b ON a.crawl_id = b.crawl_id AND a.title < b.title AND a.k <> b.k AND {GUARD}))
WHERE sim > 0.8::DOUBLE""",
    "near_dup_edges_global": with_ctes(BASE, GUNITS) + f"""
SELECT title_a, title_b, round(sim, 9) AS sim FROM (
  SELECT title_a, title_b, {hybrid('ka', 'kb', 'j', 'la', 'lb')} AS sim FROM (
    SELECT a.title AS title_a, b.title AS title_b, a.k AS ka, b.k AS kb, a.kl AS la, b.kl AS lb,
           {jacc('a.tk', 'b.tk')} AS j
    FROM gk a JOIN gk b ON a.title < b.title AND a.k <> b.k AND {GUARD} AND {SIZE23}
    WHERE len(a.tk) > 0 AND len(b.tk) > 0))
WHERE sim > 0.8::DOUBLE""",
    "near_dup_vs_history": with_ctes(BASE, RULES, MATCH, TOTALS, NOVELTY_CAPPED, DEDUP_IN) + """
SELECT crawl_id, title, hist_dup FROM dflag""",
})

CAND = f"""
cl AS (
  SELECT crawl_id, crawl_ts, title, title_key, key_ord, rank_in_group, weight, source,
         row_number() OVER (PARTITION BY crawl_id ORDER BY key_ord, rank_in_group) - 1 AS pos
  FROM dflag WHERE NOT hist_dup),
clk AS (SELECT crawl_id, crawl_ts, pos, title, weight, source, title_key AS k, length(title_key) AS kl,
               {toks('lower(title)')} AS tk FROM cl)
"""

# G1 as a recursive fold: state = kept slots per crawl; one step per item in list order.
GREEDY = f"""
gedges AS (
  SELECT a.crawl_id, a.title AS ta, b.title AS tb FROM clk a JOIN clk b
    ON a.crawl_id = b.crawl_id AND a.title <> b.title AND a.k <> b.k AND {GUARD}
  WHERE len(a.tk) > 0 AND len(b.tk) > 0
    AND {hybrid('a.k', 'b.k', jacc('a.tk', 'b.tk'), 'a.kl', 'b.kl')} > 0.8::DOUBLE),
gadj AS (
  SELECT c.crawl_id, c.pos + 1 AS i, c.title, c.weight, c.source,
         coalesce(list(e.tb) FILTER (WHERE e.tb IS NOT NULL), []) AS adj
  FROM clk c LEFT JOIN gedges e ON e.crawl_id = c.crawl_id AND e.ta = c.title
  GROUP BY c.crawl_id, c.pos, c.title, c.weight, c.source),
grec AS (
  SELECT crawl_id, 0 AS i, []::STRUCT(title VARCHAR, weight DOUBLE, source VARCHAR)[] AS slots
  FROM (SELECT DISTINCT crawl_id FROM clk)
  UNION ALL
  SELECT r.crawl_id, r.i + 1,
    CASE WHEN coalesce(list_position(list_transform(r.slots, lambda s: list_contains(a.adj, s.title)), true), 0) = 0
           THEN list_append(r.slots, {{'title': a.title, 'weight': a.weight, 'source': a.source}})
         WHEN a.weight > r.slots[list_position(list_transform(r.slots, lambda s: list_contains(a.adj, s.title)), true)].weight
           THEN list_transform(r.slots, lambda s, j: CASE
                  WHEN j = list_position(list_transform(r.slots, lambda s2: list_contains(a.adj, s2.title)), true)
                  THEN {{'title': a.title, 'weight': a.weight, 'source': a.source}} ELSE s END)
         ELSE r.slots END
  FROM grec r JOIN gadj a ON a.crawl_id = r.crawl_id AND a.i = r.i + 1),
gfinal AS (
  SELECT r.crawl_id, r.slots FROM grec r
  JOIN (SELECT crawl_id, max(i) AS n FROM grec GROUP BY crawl_id) m ON m.crawl_id = r.crawl_id AND m.n = r.i),
gslots AS (
  SELECT crawl_id, unnest(slots) AS s, unnest(range(0, len(slots))) AS slot FROM gfinal)
"""

# The reviewer walks what the greedy dedup kept.
TRIAGE = f"""
tl AS (
  SELECT g.crawl_id, c.crawl_ts, g.slot AS pos, g.s.title AS title, g.s.source AS source
  FROM gslots g JOIN (SELECT DISTINCT crawl_id, crawl_ts FROM cl) c USING (crawl_id)),
tlk AS (SELECT *, {toks('lower(title)')} AS tk FROM tl),
hpc AS (
  SELECT c.crawl_id, h.title, min({{'h_ts': h.crawl_ts, 'key_ord': h.key_ord, 'rank_in_group': h.rank_in_group}}) AS hpos
  FROM (SELECT DISTINCT crawl_id, crawl_ts FROM tl) c
  JOIN capped h ON h.crawl_ts > c.crawl_ts - INTERVAL 7 DAY AND h.crawl_ts < c.crawl_ts
  GROUP BY c.crawl_id, h.title),
hpk AS (SELECT crawl_id, title, hpos, {toks('lower(title)')} AS tk FROM hpc),
ihp AS (
  SELECT a.crawl_id, a.title AS title_a, b.title AS title_b, b.hpos
  FROM tlk a JOIN hpk b ON a.crawl_id = b.crawl_id
  WHERE len(a.tk) > 0 AND len(b.tk) > 0 AND {jacc('a.tk', 'b.tk')} > 0.1::DOUBLE),
inp AS (
  SELECT a.crawl_id, a.title AS title_a, b.title AS title_b
  FROM tlk a JOIN tlk b ON a.crawl_id = b.crawl_id AND a.title < b.title
  WHERE len(a.tk) > 0 AND len(b.tk) > 0 AND {jacc('a.tk', 'b.tk')} > 0.1::DOUBLE),
sus AS (
  SELECT DISTINCT crawl_id, title FROM (
    SELECT crawl_id, title_a AS title FROM ihp UNION ALL SELECT crawl_id, title_a FROM inp
    UNION ALL SELECT crawl_id, title_b FROM inp)),
flags AS (
  SELECT tl.crawl_id, tl.pos, tl.title, tl.source, (sus.title IS NOT NULL) AS ambiguous
  FROM tl LEFT JOIN sus USING (crawl_id, title)),
flags2 AS (
  SELECT *, CASE WHEN ambiguous THEN row_number() OVER (PARTITION BY crawl_id, ambiguous ORDER BY pos) - 1 END AS item_id
  FROM flags),
ctx AS (
  SELECT crawl_id, title, row_number() OVER (PARTITION BY crawl_id ORDER BY hpos, title) - 1 AS ctx_ord
  FROM (SELECT DISTINCT crawl_id, title_b AS title, hpos FROM ihp)),
toxic AS (
  SELECT d.crawl_id, d.source FROM labels l JOIN docs d USING (doc_id) WHERE l.toxic = 1),
verdicts AS (
  SELECT f.crawl_id, f.item_id FROM flags2 f JOIN toxic t ON f.crawl_id = t.crawl_id AND f.source = t.source
  WHERE f.ambiguous),
vkept AS (
  SELECT f.* FROM flags2 f WHERE NOT EXISTS (
    SELECT 1 FROM verdicts v WHERE v.crawl_id = f.crawl_id AND v.item_id = f.item_id)),
vfinal AS (
  SELECT crawl_id, title, row_number() OVER (PARTITION BY crawl_id ORDER BY ambiguous, pos) - 1 AS final_pos FROM vkept)
"""

SIMPLE = f"""
sitems AS (
  SELECT crawl_id, title, lower(title) AS lowered,
         row_number() OVER (PARTITION BY crawl_id ORDER BY key_ord, rank_in_group, group_ord) AS i,
         list_distinct(regexp_extract_all({trimjs('lower(title)')}, '(?s).')) AS tk
  FROM capped),
sunits AS (SELECT DISTINCT crawl_id, title, tk FROM sitems),
sedges AS (
  SELECT a.crawl_id, a.title AS ta, b.title AS tb FROM sunits a JOIN sunits b
    ON a.crawl_id = b.crawl_id AND a.title <> b.title
  WHERE len(a.tk) > 0 AND len(b.tk) > 0 AND {jacc('a.tk', 'b.tk')} > 0.8::DOUBLE),
sadj AS (
  SELECT s.crawl_id, s.i, s.title, s.lowered, coalesce(list(e.tb) FILTER (WHERE e.tb IS NOT NULL), []) AS adj
  FROM sitems s LEFT JOIN sedges e ON e.crawl_id = s.crawl_id AND e.ta = s.title
  GROUP BY s.crawl_id, s.i, s.title, s.lowered),
srec AS (
  SELECT crawl_id, 0 AS i, []::VARCHAR[] AS kept, []::VARCHAR[] AS seen FROM (SELECT DISTINCT crawl_id FROM sitems)
  UNION ALL
  SELECT r.crawl_id, r.i + 1,
    CASE WHEN list_contains(r.seen, a.lowered) OR len(list_filter(r.kept, lambda k: list_contains(a.adj, k))) > 0
         THEN r.kept ELSE list_append(r.kept, a.title) END,
    CASE WHEN list_contains(r.seen, a.lowered) OR len(list_filter(r.kept, lambda k: list_contains(a.adj, k))) > 0
         THEN r.seen ELSE list_append(r.seen, a.lowered) END
  FROM srec r JOIN sadj a ON a.crawl_id = r.crawl_id AND a.i = r.i + 1),
sfinal AS (
  SELECT r.crawl_id, r.kept FROM srec r
  JOIN (SELECT crawl_id, max(i) AS n FROM srec GROUP BY crawl_id) m ON m.crawl_id = r.crawl_id AND m.n = r.i)
"""

RG = with_ctes(BASE, RULES, MATCH, TOTALS, NOVELTY_CAPPED, DEDUP_IN, CAND, GREEDY, recursive=True)
RV = with_ctes(BASE, RULES, MATCH, TOTALS, NOVELTY_CAPPED, DEDUP_IN, CAND, GREEDY, TRIAGE, recursive=True)

SQL.update({
    "triage": RV + """
SELECT crawl_id, pos::BIGINT AS pos, title, ambiguous, item_id::BIGINT AS item_id FROM flags2""",
    "triage_context": RV + """
SELECT crawl_id, ctx_ord::BIGINT AS ctx_ord, title FROM ctx WHERE ctx_ord < 50""",
    "apply_verdicts": RV + """
SELECT crawl_id, final_pos::BIGINT AS final_pos, title FROM vfinal""",
    "greedy_dedup": RG + """
SELECT crawl_id, slot::BIGINT AS slot, s.title AS title, round(s.weight, 9) AS weight FROM gslots""",
    "simple_dedup": with_ctes(BASE, RULES, MATCH, SIMPLE, recursive=True) + """
SELECT crawl_id, unnest(range(0, len(kept)))::BIGINT AS pos, unnest(kept) AS title FROM sfinal""",
    "text_report": RG + """
SELECT p.crawl_id, count(ln)::BIGINT AS items,
       '🔥 热点新闻推送' || chr(10) || chr(10) || ' ' || count(ln) || '条 |  ' || any_value(t.generate_time) || chr(10) ||
       coalesce(string_agg(ln, '' ORDER BY rn), '') AS body
FROM (SELECT crawl_id FROM push WHERE push) p JOIN totals t USING (crawl_id)
LEFT JOIN (SELECT crawl_id, row_number() OVER (PARTITION BY crawl_id ORDER BY s.weight DESC, slot) AS rn,
             row_number() OVER (PARTITION BY crawl_id ORDER BY s.weight DESC, slot) || '. ' || s.title || ' - ' || s.source || chr(10) AS ln
      FROM gslots) g ON g.crawl_id = p.crawl_id
GROUP BY p.crawl_id""",
})

CJKCLS = r"[\x{4e00}-\x{9fa5}]"
NOTEOL = r"[^\n\r\x{2028}\x{2029}]"


def eng(x: str) -> str:
    return f"(NOT regexp_matches({x}, '{CJKCLS}') AND regexp_matches({x}, '[a-zA-Z]'))"


def unwrap(x: str) -> str:
    return (f"(CASE WHEN starts_with({x}, '\"') AND ends_with({x}, '\"') "
            f"THEN substr({x}, 2, greatest(length({x}) - 2, 0)) ELSE {x} END)")


def strip_md(x: str) -> str:
    x = f"regexp_replace({x}, '\\*\\*({NOTEOL}*?)\\*\\*', '\\1', 'g')"
    x = f"regexp_replace({x}, '\\*({NOTEOL}*?)\\*', '\\1', 'g')"
    x = f"regexp_replace({x}, '\\[({NOTEOL}*?)\\]\\({NOTEOL}*?\\)', '\\1', 'g')"
    x = f"regexp_replace({x}, '`({NOTEOL}*?)`', '\\1', 'g')"
    x = f"regexp_replace({x}, '#{{1,6}}{WS}', '', 'g')"
    return x


LANG = f"""
cache AS (
  SELECT sha256({trimjs('line')}) AS text_hash, '"' || upper({trimjs('line')}) || '"' AS translated,
         TIMESTAMP '2024-01-01 00:00:00' - item_id * INTERVAL 1 HOUR AS written_ts
  FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)
  WHERE {trimjs('line')} <> ''),
ci AS (
  SELECT crawl_id, crawl_ts, platform_id, title,
         CASE WHEN {eng('title')} THEN sha256(title) END AS text_hash
  FROM heads),
live AS (
  SELECT k.crawl_id, k.text_hash, arg_max(c.translated, c.written_ts) AS translated
  FROM (SELECT DISTINCT crawl_id, crawl_ts, text_hash FROM ci WHERE text_hash IS NOT NULL) k
  JOIN cache c ON c.text_hash = k.text_hash AND c.written_ts <= k.crawl_ts AND c.written_ts > k.crawl_ts - INTERVAL 30 DAY
  GROUP BY k.crawl_id, k.text_hash)
"""

TL = f"""
tl AS (SELECT event_id, ts, event_type AS module, floor(value)::BIGINT AS total_tokens,
              strftime({local('ts')}, '%Y%m%d') AS day FROM events),
pl AS (SELECT event_id, ts AS push_ts, event_type AS report_type, strftime({local('ts')}, '%Y%m%d') AS day
       FROM events WHERE event_type = 'purchase')
"""


def pack_rec(name: str, src: str, keys: str, limit: str) -> str:
    """Recursive CTE packing `body` of `src` into parts (state: current part, finished parts)."""
    test = "(r.cur || CASE WHEN r.cur <> '' THEN chr(10) ELSE '' END || r.lines[r.i + 1])"
    return f"""
{name}_rec AS (
  SELECT {keys}, {limit} AS lim, string_split(body, chr(10)) AS lines, 0 AS i, ''::VARCHAR AS cur, []::VARCHAR[] AS done
  FROM {src} WHERE strlen(body) > {limit}
  UNION ALL
  SELECT {', '.join('r.' + k.strip() for k in keys.split(','))}, r.lim, r.lines, r.i + 1,
         CASE WHEN strlen({test}) > r.lim AND r.cur <> '' THEN r.lines[r.i + 1] ELSE {test} END,
         CASE WHEN strlen({test}) > r.lim AND r.cur <> '' THEN list_append(r.done, r.cur) ELSE r.done END
  FROM {name}_rec r WHERE r.i < len(r.lines)),
{name}_parts AS (
  SELECT {keys}, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS ps
  FROM {name}_rec WHERE i = len(lines)
  UNION ALL
  SELECT {keys}, [body] AS ps FROM {src} WHERE strlen(body) <= {limit})
"""


CALSQL = ("cal AS (SELECT d::DATE AS day, s AS status FROM (VALUES ('2024-01-01', '1'), ('2024-01-06', '2'), "
          "('2024-01-08', '1'), ('2024-01-20', '2'), ('2024-01-22', '1')) v(d, s))")

SQL.update({
    "english_titles": H + f"""
SELECT title, {eng('title')} AS is_english FROM (SELECT DISTINCT title FROM heads)""",
    "translate_lookup": with_ctes(BASE, LANG) + f"""
SELECT ci.crawl_id, ci.platform_id, ci.title,
       live.translated IS NOT NULL AS hit,
       CASE WHEN coalesce({unwrap('live.translated')}, '') <> '' THEN {unwrap('live.translated')} ELSE ci.title END AS display_title
FROM ci LEFT JOIN live ON live.crawl_id = ci.crawl_id AND live.text_hash = ci.text_hash""",
    "translation_backlog": with_ctes(BASE, LANG) + """
SELECT DISTINCT ci.crawl_id, ci.title, ci.text_hash FROM ci
WHERE ci.text_hash IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM live WHERE live.crawl_id = ci.crawl_id AND live.text_hash = ci.text_hash)""",
    "token_daily": with_ctes(TL) + """
SELECT day, sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens, count(*) AS records,
       array_to_string(list_sort(list_distinct(list(module))), ',') AS modules
FROM tl GROUP BY day""",
    "token_total": with_ctes(TL) + """,
d AS (SELECT day, sum(coalesce(total_tokens, 0)) AS t FROM tl GROUP BY day)
SELECT coalesce(sum(t), 0)::BIGINT AS total_tokens, count(*) AS days FROM d
WHERE strptime(day, '%Y%m%d')::DATE <= (SELECT max(strptime(day, '%Y%m%d'))::DATE FROM tl)
  AND strptime(day, '%Y%m%d')::DATE > (SELECT max(strptime(day, '%Y%m%d'))::DATE FROM tl) - INTERVAL 7 DAY""",
    "push_daily": with_ctes(TL) + """
SELECT day, strftime(push_ts, '%Y-%m-%d %H:%M:%S') AS push_ts, report_type FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY push_ts DESC, event_id DESC) AS rn FROM pl)
WHERE rn = 1
  AND strptime(day, '%Y%m%d')::DATE <= (SELECT max(strptime(day, '%Y%m%d'))::DATE FROM pl)
  AND strptime(day, '%Y%m%d')::DATE > (SELECT max(strptime(day, '%Y%m%d'))::DATE FROM pl) - INTERVAL 7 DAY""",
    "schedule_gate": with_ctes(CALSQL) + f""",
e AS (SELECT event_id, hour({local('ts')}) AS local_hour, {local('ts')}::DATE AS day FROM events),
f AS (SELECT e.event_id, e.local_hour,
             CASE WHEN c.status = '1' THEN true WHEN c.status = '2' THEN false
                  ELSE dayofweek(e.day) IN (0, 6) END AS is_holiday
      FROM e LEFT JOIN cal c USING (day))
SELECT event_id, local_hour::BIGINT AS local_hour, is_holiday, (NOT is_holiday OR local_hour IN (10, 12, 16, 20)) AS run FROM f""",
    "retention": with_ctes(TL) + """,
a AS (SELECT max(ts) + INTERVAL 1 DAY AS as_of FROM events)
SELECT 'token_log' AS log, count(*) AS kept_rows FROM tl WHERE ts > (SELECT as_of FROM a) - INTERVAL 30 DAY
UNION ALL
SELECT 'push_log' AS log, count(*) AS kept_rows FROM pl WHERE push_ts > (SELECT as_of FROM a) - INTERVAL 7 DAY""",
    "strip_markdown": H + f"""
SELECT crawl_id, platform_id, rank, {strip_md('title')} AS stripped FROM valid""",
    "pack_messages": with_ctes("rt AS (SELECT conv_id, turn, text AS body FROM conversations)",
                               pack_rec("pk", "rt", "conv_id, turn", "200"), recursive=True) + """
SELECT conv_id, turn, (i + 1)::BIGINT AS part, len(ps)::BIGINT AS parts,
       CASE WHEN len(ps) > 1 THEN ps[i + 1] || chr(10) || chr(10) || '第 ' || (i + 1) || '/' || len(ps) || ' 部分' ELSE ps[i + 1] END AS body
FROM (SELECT conv_id, turn, ps, unnest(range(0, len(ps))) AS i FROM pk_parts)""",
    "channel_messages": with_ctes(
        "ch AS (SELECT * FROM (VALUES ('feishu', 30000, true), ('dingtalk', 20000, false), ('wework', 4000, false), "
        "('telegram', 4000, false)) v(channel, lim, rule))",
        "rt AS (SELECT conv_id, turn, channel, lim, rule, text AS body FROM conversations, ch)",
        pack_rec("cm", "rt", "conv_id, turn, channel", "lim"), recursive=True) + """
SELECT p.conv_id, p.turn, p.channel, (i + 1)::BIGINT AS part, len(ps)::BIGINT AS parts,
       CASE WHEN len(ps) > 1 THEN ps[i + 1] || chr(10) || chr(10) ||
            CASE WHEN p.channel = 'feishu' THEN '━━━━━━━━━━━━━━━━━━━' || chr(10) ELSE '' END ||
            '第 ' || (i + 1) || '/' || len(ps) || ' 部分' ELSE ps[i + 1] END AS body
FROM (SELECT conv_id, turn, channel, ps, unnest(range(0, len(ps))) AS i FROM cm_parts) p""",
    "channel_conversations": with_ctes(
        "ch AS (SELECT * FROM (VALUES ('feishu', 30000, true), ('dingtalk', 20000, false), ('wework', 4000, false), "
        "('telegram', 4000, false)) v(channel, lim, rule))",
        "rt AS (SELECT c.*, ch.channel, ch.lim, ch.rule FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body "
        "FROM conversations GROUP BY conv_id) c, ch)",
        pack_rec("cc", "rt", "conv_id, channel", "lim"), recursive=True) + """
SELECT p.conv_id, p.channel, (i + 1)::BIGINT AS part, len(ps)::BIGINT AS parts,
       CASE WHEN len(ps) > 1 THEN ps[i + 1] || chr(10) || chr(10) ||
            CASE WHEN p.channel = 'feishu' THEN '━━━━━━━━━━━━━━━━━━━' || chr(10) ELSE '' END ||
            '第 ' || (i + 1) || '/' || len(ps) || ' 部分' ELSE ps[i + 1] END AS body
FROM (SELECT conv_id, channel, ps, unnest(range(0, len(ps))) AS i FROM cc_parts) p""",
    "page_lines": f"""
WITH pg AS (
  SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS platform_id,
         {trimjs("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title
  FROM pages),
rk AS (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY page_id) AS rank FROM pg),
hc AS (SELECT platform_id, title, min(rank) AS first_rank, arg_min(url, rank) AS url FROM rk GROUP BY platform_id, title)
SELECT platform_id, first_rank::BIGINT AS first_rank,
       CASE WHEN coalesce(url, '') <> '' THEN first_rank || '. [' || title || '](' || url || ') - ' || platform_id
            ELSE first_rank || '. ' || title || ' - ' || platform_id END AS line,
       {esc('title')} AS title_html, {esc('url')} AS url_html
FROM hc WHERE title <> ''""",
})

SQL.update({
    "stream_novelty": RC + """
SELECT title_key, crawl_id, is_new FROM cnl""",
    "stream_token_daily": with_ctes(TL) + """
SELECT day, sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens, count(*) AS records FROM tl GROUP BY day""",
})

SQL["stream_text_report"] = SQL["text_report"]
SQL["stream_keyed_novelty"] = SQL["stream_novelty"]
SQL["translate_cached"] = SQL["translate_lookup"]
SQL["report_page"] = RC + f"""
SELECT l.report_day, c.crawl_id, group_key, rank_in_group::BIGINT AS rank_in_group, {esc('source')} AS source_html, first_rank::BIGINT AS first_rank,
       CASE WHEN first_rank <= 3 THEN 'top' WHEN first_rank <= 10 THEN 'high' ELSE '' END AS rank_badge,
       {esc('title')} AS title_html, {esc("''")} AS url_html
FROM cnew c JOIN (SELECT report_day, arg_max(crawl_id, crawl_ts) AS crawl_id FROM totals GROUP BY report_day) l ON l.crawl_id = c.crawl_id"""


def _kept(log: str, source: str, ts: str, days: int) -> str:
    """Rows and UTC+8 days of a table that are kept 12 hours after its newest row."""
    return f"""SELECT '{log}' AS log, count(*) AS kept_rows, count(DISTINCT strftime({local('t')}, '%Y%m%d')) AS kept_days
FROM (SELECT t, max(t) OVER () AS last FROM (SELECT {ts} AS t FROM {source})) WHERE t > last + INTERVAL 12 HOUR - INTERVAL {days} DAY"""


SQL["retention_stored"] = with_ctes(BASE, RULES, MATCH, TOTALS, NOVELTY_CAPPED, TL, CALSQL,
                                    "lines AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)") + "\nUNION ALL\n".join([
    _kept("reports", "capped", "crawl_ts", 7), _kept("push_log", "pl", "push_ts", 7),
    _kept("history", "(SELECT DISTINCT crawl_id, crawl_ts, title FROM capped)", "crawl_ts", 30), _kept("token_log", "tl", "ts", 30),
    _kept("translations", "lines WHERE trim(line) <> ''", "TIMESTAMP '2024-01-01' - item_id * INTERVAL 1 HOUR", 30),
    _kept("calendar", "cal", "day::TIMESTAMP", 1)])
