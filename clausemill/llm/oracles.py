"""Oracle SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op5_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *,
    CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'ANS' WHEN 'system' THEN 'SYS' ELSE 'ROLE:' || lower(hex(role)) END AS tag,
    regexp_replace(regexp_replace(text, '<(\\*/?s)>', '<\\\1>', 'g'), '\[(\\*/?(?:INST|ANS|SYS|ROLE:[0-9a-f]*))\]', '[\\\1]', 'g') AS safe
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + 2 * length(tag) + 14) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

ORACLES["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)
), places AS (
  SELECT r AS item, s AS start, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT r, size, s, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT d.r, d.w, sizes.size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), hit AS (SELECT dw.r, dw.s, dw.size, iw.item_id FROM dw JOIN iw USING (size, win)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + size)) FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
), steps AS (
  SELECT dw.r, dw.s, item, start, dw.size, dw.s - row_number() OVER (PARTITION BY dw.r, item, dw.s - start ORDER BY dw.s) AS island FROM dw JOIN places USING (size, win)
), runs AS (SELECT r, min(s) - 1 AS place, count(*) + min(size) - 1 AS words FROM steps GROUP BY r, item, s - start, island),
longest AS (SELECT r, max(words) AS longest_words, arg_max(place, [words, -place]) AS longest_start FROM runs GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest_words, 0) AS longest_words, longest_start
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
"""

# Runs by their diagonals: equal lines of two places, neighbours on one diagonal joined, runs of 50 words or more.
ORACLES["op2_line_dedup"] = r"""
WITH d AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM d),
w AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS i,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), p AS (
  SELECT a.r AS ar, a.i AS ai, b.r AS br, a.i - b.i AS diag, a.n, a.k
  FROM w a JOIN w b ON a.line = b.line AND (b.r < a.r OR b.r = a.r AND b.i < a.i)
), g AS (SELECT *, ai - row_number() OVER (PARTITION BY ar, br, diag ORDER BY ai) AS island FROM p),
runs AS (SELECT ar, min(k) AS f, max(k) AS t FROM g GROUP BY ar, br, diag, island HAVING sum(n) >= 50),
gone AS (SELECT DISTINCT ar AS r, unnest(range(f, t + 1)) AS k FROM runs),
kept AS (
  SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.k) AS t FROM l ANTI JOIN gone ON l.r = gone.r AND l.k = gone.k GROUP BY l.r
), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, coalesce(n.n, 0) AS n_deleted, length(coalesce(kept.t, '')) AS kept_chars, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

ORACLES["op3_revisits"] = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS h, length(html) AS n, 1700000000 + page_id * 60 AS s,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), u AS (
  SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[^/?@]*@)?([^/?]*)', 1)), '^www\d*\.', ''), ':(?:80|443)?$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*(/[^?]*)?', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS q
  FROM p
), k AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM u
), r AS (
  SELECT 2 * page_id AS record_id, url_key, s, true AS full_, page_id, h, n FROM k
  UNION ALL SELECT 2 * page_id + 1, url_key, s + 10800, false, page_id, h, n FROM k
), f AS (
  SELECT *, last_value(CASE WHEN full_ THEN {'id': record_id, 's': s, 'h': h, 'n': n} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY s, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM r
), o AS (
  SELECT *, CASE WHEN b IS NULL THEN 'missing'
    WHEN page_id % 10 = 0 THEN 'changed'
    WHEN page_id % 10 = 2 THEN 'unchecked'
    WHEN h = b.h THEN 'matched' ELSE 'changed' END AS outcome
  FROM f WHERE NOT full_
)
SELECT record_id, url_key, b.id AS response_id, b.s AS response_s, outcome,
  CASE WHEN outcome = 'matched' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || b.n || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: "' || b.h[1:12] || '"' ELSE '' END AS headers
FROM o
"""


ORACLES["op4_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
), x AS (
  SELECT r, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w, length(l) AS c, length(regexp_replace(l, '\p{Lu}+', '', 'g')) AS no_lu, length(regexp_replace(l, '\p{Ll}+', '', 'g')) AS no_ll
  FROM (SELECT r, unnest(ls) AS l FROM d)
), j AS (
  SELECT r, l, w, len(w) AS n, len(list_distinct(w)) AS u, c, c - no_lu AS up, c - no_ll AS lo, c - length(regexp_replace(l, '[#*$%&|<>]+', '', 'g')) AS sym,
    c - length(regexp_replace(l, '[|»›>·•]+', '', 'g')) AS sep, (c - length(regexp_replace(l, '!+', '', 'g'))) / 2.0 AS ex
  FROM x
), v AS (
  SELECT r, l, w, n, n = 0 OR NOT (
    sym > 0.1 * c OR up + lo >= 20 AND up > 0.6 * (up + lo) OR n >= 3 AND ex > 0.3 * n OR sep >= 2 AND sep > 0.25 * n OR n >= 12 AND u < 0.25 * n
    OR n <= 3 AND NOT regexp_matches(l, '[.!?…:;。！？"''”’»)\]]\s*$')
    OR n <= 40 AND regexp_matches(lower(l), 'accept all cookies|we use cookies|cookie policy|enable javascript|javascript is disabled|all rights reserved|terms of use|terms of service|privacy policy|sign up for our newsletter|subscribe to our newsletter|click here to|lorem ipsum')
  ) AS ok FROM j
), lines AS (
  SELECT r, coalesce(sum(length(array_to_string(w, ''))) FILTER (ok), 0) AS left_, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS dup FROM v GROUP BY r
), win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT win.r, unnest(range(i, i + 8)) AS k FROM win JOIN (SELECT r, t FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (r, t)) GROUP BY r),
b AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, left_
  FROM d JOIN lines USING (r) LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_ >= 0.5 * word_chars AS kept
FROM b
"""

ORACLES["op7_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS other FROM n UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.other),
c AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.other GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""

# CRC-32 of an id's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# All pairs of distinct names of like length; five cells about the diagonal, row by row.
_CELL = "CASE WHEN i - 1 + {o} BETWEEN 0 AND lq THEN least(s{o} + CASE WHEN a[i + 1] = b[i - 1 + {o}] THEN 0 ELSE 1 END, {more} CASE WHEN i >= 1 AND a[i + 1] = b[i - 2 + {o}] AND a[i] = b[i - 1 + {o}] THEN p{o} + 1 ELSE 3 END, {left} 3) ELSE 3 END AS n{o}"
_CELLS = ", ".join(_CELL.format(o=o, more=f"s{o + 1} + 1," if o < 4 else "", left=f"n{o - 1} + 1," if o else "") for o in range(5))
ORACLES["op12_edit_distance_names"] = rf"""
WITH RECURSIVE c AS (
  SELECT name, count(*) AS n, min(client_id) AS first, CAST(coalesce(sum(crc), 0) AS BIGINT) AS crc
  FROM (SELECT {_LOWER.format("name")} AS name, client_id, {_CRC.format("client_id")} AS crc FROM clients WHERE name <> '') GROUP BY name
), h AS (SELECT vendor_id, name, {_CRC.format("vendor_id")} AS h FROM vendors WHERE name <> ''),
v AS (
  SELECT vendor_id, {_LOWER.format("CASE WHEN h % 2 = 0 AND len(name) >= 2 THEN name[:h % (len(name) - 1)] || name[h % (len(name) - 1) + 2] || name[h % (len(name) - 1) + 1] || name[h % (len(name) - 1) + 3:] ELSE name END")} AS name FROM h
), p AS (
  SELECT v.name AS q, c.name AS n, string_split(v.name, '') AS b, string_split(c.name, '') AS a, len(v.name) AS lq, len(c.name) AS ln
  FROM (SELECT DISTINCT name FROM v) v, c WHERE abs(len(v.name) - len(c.name)) <= 2
), d AS (
  SELECT *, 0 AS i, 3 AS s0, 3 AS s1, 0 AS s2, CASE WHEN lq >= 1 THEN 1 ELSE 3 END AS s3, CASE WHEN lq >= 2 THEN 2 ELSE 3 END AS s4, 3 AS p0, 3 AS p1, 3 AS p2, 3 AS p3, 3 AS p4 FROM p
  UNION ALL
  SELECT q, n, b, a, lq, ln, i + 1, n0, n1, n2, n3, n4, s0, s1, s2, s3, s4
  FROM (SELECT *, {_CELLS} FROM d WHERE i < ln AND least(s0, s1, s2, s3, s4) <= 2)
), near AS (SELECT q, n, [s0, s1, s2, s3, s4][lq - ln + 3] AS distance FROM d WHERE i = ln)
SELECT vendor_id, CAST(distance AS INTEGER) AS distance, CAST(sum(c.n) AS BIGINT) AS n_clients, min(first) AS first_client_id, CAST(sum(crc) AS BIGINT) AS clients_crc
FROM near JOIN c ON c.name = near.n JOIN v ON v.name = near.q WHERE distance <= 2 GROUP BY vendor_id, distance
"""

ORACLES["op13_embedding_neardup"] = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, row_number() OVER () AS r, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings
), links AS (
  SELECT x.r AS a, y.r AS b FROM e x JOIN e y ON x.label = y.label AND x.r <> y.r AND x.good AND y.good AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reach AS (SELECT r AS a, r AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM e JOIN least USING (r) LEFT JOIN n USING (r)
"""

# Forward over the rows: for each state the cheapest edits so far, as nine digits of cost and the letters, so that the least text is the best.
_ADD = "lpad(CAST(CAST({s}[1:9] AS INT) + {cost} AS VARCHAR), 9, '0') || {s}[10:] || '{edit}'"
_STEP = ", ".join(
    f"least({_ADD.format(s=f's{q}', cost=2, edit='D')}{more}) AS t{q}"
    for q, more in enumerate([
        "",
        ", CASE WHEN kind = 's' THEN " + _ADD.format(s="s0", cost="late", edit="K") + " END",
        ", CASE WHEN kind <> 'x' THEN " + _ADD.format(s="least(s0, s1, s3)", cost="(1 + late)", edit="R") + " END, CASE WHEN kind = 'u' THEN " + _ADD.format(s="least(s0, s1, s3)", cost="late", edit="K") + " END",
        ", CASE WHEN kind <> 'x' THEN " + _ADD.format(s="s2", cost="(1 + late)", edit="R") + " END, CASE WHEN kind = 'a' THEN " + _ADD.format(s="s2", cost="late", edit="K") + " END",
    ])
)
_SPREAD = f"least(t2, {_ADD.format(s='least(t0, t1, t3)', cost=5, edit='I')}) AS u2, least(t3, {_ADD.format(s='u2', cost=5, edit='I')}) AS u3"
ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
f AS (
  SELECT c.c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f
  FROM conversations v JOIN c ON v.conv_id IS NOT DISTINCT FROM c.conv_id
), d AS (
  SELECT c, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]+', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE f WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM f)
), o AS (
  SELECT *, i > min(i) OVER (PARTITION BY c, role, text) AS again,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS broken, role[1:1] AS initial
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d)
), k AS (
  SELECT *, CASE WHEN empty OR again THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS kind, CASE WHEN NOT (empty OR again) AND broken THEN 5 ELSE 0 END AS late,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM o
), n AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank, count(*) FILTER (again AND NOT empty) AS duplicate,
    count(*) FILTER (late > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY c
), dp AS (
  SELECT c, 0 AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM c
  UNION ALL
  SELECT c, i, t0, t1, u2, u3 FROM (SELECT *, {_SPREAD} FROM (SELECT dp.c, k.i, {_STEP} FROM dp JOIN k ON k.c = dp.c AND k.i = dp.i + 1))
), best AS (SELECT dp.c, least(s0, s3) AS b FROM dp LEFT JOIN n USING (c) WHERE i = coalesce(n, 0)),
e AS (SELECT c, CAST(b[1:9] AS BIGINT) AS cost, b[10:] AS audit FROM best),
rp AS (
  SELECT c, audit, 0 AS step, 0 AS i, 0 AS q, []::VARCHAR[] AS told FROM e
  UNION ALL
  SELECT c, audit, step + 1, i + CASE edit WHEN 'I' THEN 0 ELSE 1 END, p, CASE edit WHEN 'D' THEN told ELSE list_append(told, CASE edit WHEN 'K' THEN role WHEN 'R' THEN who ELSE who END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT *, CASE p WHEN 2 THEN 'user' ELSE 'assistant' END AS who FROM (
      SELECT rp.*, k.role, k.text, audit[step + 1] AS edit, CASE audit[step + 1] WHEN 'D' THEN q WHEN 'K' THEN CASE k.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE q WHEN 2 THEN 3 ELSE 2 END END AS p
      FROM rp LEFT JOIN k ON k.c = rp.c AND k.i = rp.i + 1 WHERE step < len(audit)
    )
  )
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, e.audit, sha256(array_to_string(told, chr(10))) AS repaired_sha256
FROM c JOIN e USING (c) LEFT JOIN n USING (c) JOIN rp ON rp.c = c.c AND rp.step = len(e.audit)
"""
