"""SQL for the contract queries that it can express: the others need hashes, tokenizers or trained models."""

SPACE = r"[\x20\x09-\x0D]"
LINES = rf"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
GONE = "length(t) - length(regexp_replace(t, '{}', '', 'g'))"

#: The base measures, and the verdict of all rules in any order.
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS w, {LINES} AS l FROM d),
 g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
 p AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1), c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest(range(5)) AS k) GROUP BY 1),
 f AS (SELECT r, max(n) AS most FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM w) GROUP BY 1, 2) GROUP BY 1),
 m AS (SELECT w.r, doc_id, t, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars, CAST({GONE.format('[#*$%&|<>]')} AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(most, 0) AS most FROM w LEFT JOIN c ON c.r = w.r LEFT JOIN f ON f.r = w.r),
 v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
 OR 2 * ({GONE.format(r'\p{L}')}) < word_chars OR 10 * ({GONE.format('[0-9]')}) > 3 * word_chars OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 9 * n_lines
 OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) > 3 * n_lines OR 100 * most > 40 * n_words) AS kept FROM v"""

#: CRC-32 of a decimal number's digits, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

#: Prefixes as lists of turns; a node's subtree is all nodes whose list begins with its own.
OP11 = f"""
WITH a AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text))) AS p FROM a),
 c AS (SELECT conv_id, {CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM a)),
 r AS (SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE p <= h UNION ALL SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE p > h),
 s AS (SELECT c.conv_id, coalesce(l, []) AS l FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY p) AS l FROM r GROUP BY 1) USING (conv_id)),
 x AS (SELECT conv_id, len(l) AS n, l, unnest(range(len(l) + 1)) AS d FROM s),
 n AS (SELECT d, l[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(strlen(l[d].text)), 0) * (count(*) - 1) AS own, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM x GROUP BY 1, 2),
 u AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n AS p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]),
 q AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
 v AS (SELECT n.d, n.k, n.own, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN q ON q.d = n.d AND q.k = n.k),
 z AS (SELECT y.k[1:y.i] AS k, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS i FROM v) AS y GROUP BY 1)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, u.parent_conv_id, u.n_convs, v.n_children, z.leaves AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN v ON v.k = u.k JOIN z ON z.k = u.k"""

#: Every document through every order.
OP12 = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
   + CASE WHEN 100 * ({GONE.format('[A-Z]')}) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS f FROM d LEFT JOIN l USING (doc_id)),
 b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM b AS a, b, b AS c, b AS d, b AS e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, step, CAST(pow(2, ascii(filter_order[step]) - 65) AS INTEGER) AS own, CAST(list_sum(list_transform(range(1, step), lambda i: pow(2, ascii(filter_order[i]) - 65))) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
 g AS (SELECT part, filter_order, step, own, count(*) FILTER (f & (own | coalesce(before, 0)) = 0) AS kept, count(*) FILTER (f & own > 0 AND f & coalesce(before, 0) = 0) AS removed, count(*) FILTER (f & own > 0 AND f & coalesce(before, 0) > 0) AS redundant,
   count(*) FILTER (f = own) AS unique_fails, count(*) FILTER (f & own > 0 AND f & coalesce(before, 0) = 0 AND good = 1) AS good_lost, count(*) FILTER (f & own > 0 AND f & coalesce(before, 0) = 0 AND toxic = 1) AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g"""

ORACLE_SQL = {"op10_quality_rules": OP10, "op11_prefix_trie": OP11, "op12_filter_audit": OP12}
