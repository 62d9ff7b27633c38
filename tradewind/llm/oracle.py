"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tradewind.llm.quality import STOP_WORDS

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs
), keyed AS (
  SELECT *, {_LOWERED.format(f"trim(line, {_WHITE})")} AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND s.keeper IS DISTINCT FROM k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

_STOPS = ", ".join(f"'{w}'" for s in STOP_WORDS for w in sorted({s, s.capitalize()}))

OP10 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l
  FROM docs
), windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i,
         unnest([array_to_string(w[j : j + 2], ' ') FOR j IN range(1, len(w) - 1)]) AS g
  FROM worded WHERE len(w) >= 3
), again AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) >= 2
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again)
  GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len([x FOR x IN w IF x IN ({_STOPS})])::BIGINT AS n_stop_words,
         len(l)::BIGINT AS n_lines
  FROM worded LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words
       AND 100 * n_symbols <= 25 * n_words AND 100 * n_stop_words >= 2 * n_words
       AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM judged
"""

OP2 = """
WITH paged AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), digested AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
         max(page_id) OVER (PARTITION BY h) AS latest
  FROM paged
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM latest
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM latest
            THEN latest END AS refers_to
FROM digested
"""

_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

OP12 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_TERM}') AS terms
  FROM documents
), worded AS (
  SELECT r, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM worded
  GROUP BY ALL HAVING count(DISTINCT r) >= 10
), found AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n
  FROM worded JOIN kept USING (lang, term) GROUP BY ALL
), of_lang AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(f.n), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN found f USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(f.n, 0) AS own,
         1 + 1000000000::HUGEINT * (coalesce(f.n, 0) + 2) // (t.total + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM totals t JOIN of_lang l USING (lang) JOIN kept k USING (lang)
       LEFT JOIN found f ON f.lang = t.lang AND f.source = t.source AND f.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item,
         sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), telling AS (
  SELECT lang, source, 'term' AS part, term AS item,
         ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM shares WHERE own > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (
           PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM telling)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_CRC = """list_reduce(
    [4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split({}::VARCHAR, '')],
    lambda s, b: list_reduce(
      [xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda u, _: xor(u >> 1, 3988292384 * (u & 1))))"""

OP13 = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
         ) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor({_CRC.format("c")}, 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM turns)
), joined AS (
  SELECT v.c, 0 AS own, t.i, t.role, t.text
  FROM convs v JOIN turns t ON t.c = v.c - v.c % 100 AND t.i < v.h
  UNION ALL
  SELECT v.c, 1 AS own, t.i, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.i >= v.h
), rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS depth,
         sha256(length(role) || ':' || role || text) AS digest, length(text)::BIGINT AS chars
  FROM joined
), prefixes AS (
  SELECT c, 0 AS depth, '' AS node, '' AS above, 0 AS chars FROM convs
  UNION ALL
  SELECT r.c, r.depth, sha256(string_agg(b.digest, ',' ORDER BY b.depth)) AS node,
         coalesce(sha256(string_agg(b.digest, ',' ORDER BY b.depth) FILTER (b.depth < r.depth)), ''),
         any_value(r.chars)
  FROM rebuilt r JOIN rebuilt b ON b.c = r.c AND b.depth <= r.depth GROUP BY r.c, r.depth
), lengths AS (
  SELECT c, max(depth) AS n FROM prefixes GROUP BY c
), nodes AS (
  SELECT depth, node, above, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), ''))
           AS ends_sha256
  FROM prefixes JOIN lengths USING (c) GROUP BY depth, node, above
), fans AS (
  SELECT depth - 1 AS depth, above AS node, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY ALL
), valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_children IS NULL)::BIGINT AS leaf
  FROM nodes n LEFT JOIN fans USING (depth, node)
), sums AS (
  SELECT a.depth, a.node, sum(v.leaf)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
  FROM valued v JOIN prefixes a ON a.c = v.conv_id AND a.depth <= v.depth GROUP BY ALL
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN sums s USING (depth, node)
     LEFT JOIN nodes u ON u.depth = v.depth - 1 AND u.node = v.above
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1,
        "op2_warc": OP2,
        "op10_quality_rules": OP10,
        "op12_divergence": OP12,
        "op13_conversation_trie": OP13,
    }
