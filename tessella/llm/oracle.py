"""DuckDB SQL for the operators that SQL can express."""

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op9_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM rep, range(5) AS r(k)) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        coalesce(cov.n, 0) AS n_repeat_words, coalesce(top.n, 0) AS top_word,
        len(regexp_extract_all(text, '[A-Za-z]|[^\x00-\x7f]')) AS letters
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * n_dup_lines > n_lines OR 2 * letters < word_chars OR 2 * top_word > n_words) AS kept
FROM b
"""


def _fill(nodes: str, parent: str, child: str) -> str:
    """Splits parent_budget over the siblings of ``nodes``, as mixing.water_fill does."""
    of = f"PARTITION BY {parent}" if parent else ""
    by = f"{of} ORDER BY cap / weight, {child}"
    return f"""
    SELECT * EXCLUDE (l, wl, r, filled), CASE WHEN filled THEN cap
        ELSE (first_value(CASE WHEN NOT filled THEN l END IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) * weight
          // (first_value(CASE WHEN NOT filled THEN wl END IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS budget
    FROM (SELECT *, cap * wl <= l * weight AS filled FROM (SELECT *,
        greatest(parent_budget - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS l,
        (sum(weight) OVER ({of}) - coalesce(sum(weight) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS wl, 0 AS r
      FROM ({nodes})))"""


MIXING = rf"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN '?'
        ELSE 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 AS VARCHAR) END AS domain,
      coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, CAST(len({_WORDS}) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS leaf_tokens, CAST(2 * sum(tokens) AS BIGINT) AS cap FROM d GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(leaf_tokens) AS BIGINT) // 2 FROM leaves) AS parent_budget,
      CAST(CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS BIGINT) AS weight FROM leaves GROUP BY domain),
dom_b AS ({_fill('SELECT * FROM dom', '', 'domain')}),
lan AS (SELECT domain, lang, CAST(sum(leaves.cap) AS BIGINT) AS cap, any_value(dom_b.budget) AS parent_budget,
      CAST(CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS BIGINT) AS weight FROM leaves JOIN dom_b USING (domain) GROUP BY domain, lang),
lan_b AS ({_fill('SELECT * FROM lan', 'domain', 'lang')}),
src AS (SELECT domain, lang, source, leaf_tokens, leaves.cap, lan_b.budget AS parent_budget, CAST(1 AS BIGINT) AS weight FROM leaves JOIN lan_b USING (domain, lang)),
src_b AS ({_fill('SELECT * FROM src', 'domain, lang', 'source')}),
e AS (SELECT d.*, epoch, leaf_tokens, budget, md5('17:' || CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k
      FROM d JOIN src_b USING (domain, lang, source), range(2) AS r(epoch)),
c AS (SELECT *, CAST(epoch * leaf_tokens + coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY k, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_tokens FROM e)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, tokens, before_tokens, CAST(least(tokens, budget - before_tokens) AS BIGINT) AS take_tokens
FROM c WHERE before_tokens < budget
"""
ORACLE["op10_mixing"] = MIXING

ORACLE["op8_ann"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(generate_series(1, len(q.e)), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE["op2_minhash_lsh_forest"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
      UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
u AS (SELECT DISTINCT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = d.doc_id
"""

ORACLE["op12_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS latest FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN latest IS NOT NULL AND (page_id IS NULL OR page_id < latest) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN latest IS NOT NULL AND (page_id IS NULL OR page_id < latest) THEN latest END AS refers_to, true AS intact
FROM d
"""

# crc32 by bits (fixed value: its reflected polynomial), then the edits by dynamic programming over (row, state of the grammar)
ORACLE["op11_conversation_repair"] = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT * EXCLUDE k, CAST(xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda acc, x:
      list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS INT) AS how FROM raw),
g AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
      CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE how <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), role, text) AS i FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before,
      regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM o),
r AS (SELECT conv_id, turn, role, text, ini, i, before, CASE WHEN ending = '' THEN 1 WHEN again THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
n AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
      count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
ins(st, k, nst) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
ops(op, st, ini, nst, price) AS (SELECT 'D', s, CAST(NULL AS VARCHAR), s, 3 FROM range(4) AS t(s) UNION ALL SELECT 'R', s, CAST(NULL AS VARCHAR), CASE s WHEN 2 THEN 3 ELSE 2 END, 2 FROM range(4) AS t(s)
      UNION ALL VALUES ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0)),
way AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, '00000000' AS key FROM n
  UNION ALL
  SELECT way.conv_id, r.i, ops.nst, min(lpad(CAST(CAST(left(key, 8) AS INT) + 2 * k + price + CASE WHEN op <> 'D' AND fault = 3 THEN 1 ELSE 0 END AS VARCHAR), 8, '0') || substr(key, 9) || repeat('I', k) || op)
  FROM way JOIN r ON r.conv_id IS NOT DISTINCT FROM way.conv_id AND r.i = way.i + 1 JOIN ins ON ins.st = way.st
    JOIN ops ON ops.st = ins.nst AND (ops.ini IS NULL OR ops.ini = r.ini) AND (op = 'D' OR fault IN (0, 3))
  GROUP BY way.conv_id, r.i, ops.nst),
best AS (SELECT n.conv_id, min(lpad(CAST(CAST(left(key, 8) AS INT) + 2 * k AS VARCHAR), 8, '0') || substr(key, 9) || repeat('I', k)) AS key
  FROM n JOIN way ON way.conv_id IS NOT DISTINCT FROM n.conv_id AND way.i = n.n JOIN ins ON ins.st = way.st AND ins.nst IN (0, 3) GROUP BY n.conv_id),
letters AS (SELECT conv_id, unnest(string_split(substr(key, 9), '')) AS l, unnest(generate_series(1, length(key) - 8)) AS p FROM best),
placed AS (SELECT conv_id, l, p, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS q FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT placed.conv_id, l, p, q, r.role, r.text, max(CASE WHEN l = 'K' AND q = 1 AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.conv_id) AS s
  FROM placed LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM placed.conv_id AND r.i = placed.i AND l <> 'I' WHERE l <> 'D'),
whole AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS digest FROM lines GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(CAST(left(key, 8) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(key, 9), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
