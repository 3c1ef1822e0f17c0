"""DuckDB forms of the document flow, retrieval and session folds, as parts of WITH lists that oracles share."""

from __future__ import annotations

#: Words and single punctuation marks of a text.
TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
#: A text with its blanks collapsed.
CLAUSE = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'), ' ')"
#: A text in lower case with anything but a-z, 0-9 and blanks as a space, blanks collapsed.
CHANGE = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
#: The number that the deterministic scorer draws from a text: the first 32 bits of an MD5.
DRAW = "CAST('0x' || md5('{0}:' || {1})[1:8] AS BIGINT)"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def paragraphs(docs: str = "documents", s: str = "") -> str:
    """``p`` (doc_id, paragraph_id, t): the lines that are not empty, in order."""
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANK})), lambda x: x <> '')"
    return f"l{s} AS (SELECT doc_id, {lines} AS ps FROM {docs}), p{s} AS (SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS paragraph_id, unnest(ps) AS t FROM l{s})"


def chunks(limit: int, docs: str = "documents", s: str = "") -> str:
    """``ch`` (doc_id, chunk_id, paragraph_id, text, estimated_tokens, is_subchunk): lines of 15 characters or more, long ones by packed sentences.

    The greedy packing is the recursive part, so the list begins with WITH RECURSIVE.
    """
    sentences = rf"""list_filter(list_transform(string_split(regexp_replace(t, '([.!?]["'')\]]?)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_BLANK})), lambda x: x <> '')"""
    return f"""
{paragraphs(docs, s)}, q{s} AS (SELECT doc_id, paragraph_id, CASE WHEN {TOKENS.format("t")} <= {limit} THEN [t] ELSE {sentences} END AS parts FROM p{s} WHERE length(t) >= 15),
c{s} AS (SELECT doc_id, paragraph_id, parts, list_transform(parts, lambda x: {TOKENS.format("x")}) AS ns FROM q{s}),
f{s} AS (SELECT doc_id, paragraph_id, ns, 1 AS i, ns[1] AS held, 1 AS g FROM c{s}
  UNION ALL SELECT doc_id, paragraph_id, ns, i + 1, CASE WHEN held + ns[i + 1] > {limit} THEN ns[i + 1] ELSE held + ns[i + 1] END, CASE WHEN held + ns[i + 1] > {limit} THEN g + 1 ELSE g END FROM f{s} WHERE i < len(ns)),
e{s} AS (SELECT doc_id, paragraph_id, g, string_agg(parts[i], ' ' ORDER BY i) AS text FROM f{s} JOIN c{s} USING (doc_id, paragraph_id) GROUP BY 1, 2, 3),
ch{s} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, g) - 1 AS INTEGER) AS chunk_id, paragraph_id, text, CAST({TOKENS.format("text")} AS INTEGER) AS estimated_tokens,
  count(*) OVER (PARTITION BY doc_id, paragraph_id) > 1 AS is_subchunk FROM e{s})"""


def analysis(scorer: str = "hash", docs: str = "documents", s: str = "") -> str:
    """``an``: the chunks of 256 tokens with the deterministic scorer's topic and harm class."""
    draw = DRAW.format(scorer, "text")
    return f"""{chunks(256, docs, s)},
an{s} AS (SELECT *, ['t' || {draw} % 7] AS predicted_topics, ['Harmful', 'Neutral', 'Fair'][{draw} % 3 + 1] AS predicted_harm_class, CAST(1 AS DOUBLE) AS harm_confidence FROM ch{s})"""


def merged(changes: str) -> str:
    """``merged`` from ``changes`` (document, pos, what, harm_label, change_type): the greedy fold, then the order of harm and type."""
    order = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " ELSE 9 END"
    return f"""
ct AS (SELECT *, {CHANGE.format("what")} AS t FROM ({changes})), cw AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) > 2)) AS w FROM ct),
co AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY pos, t, harm_label, change_type, what) AS n FROM cw),
cf AS (SELECT document, 1 AS n, [{{'n': n, 't': t, 'w': w}}] AS kept FROM co WHERE n = 1
  UNION ALL SELECT x.document, x.n, CASE WHEN x.t <> '' AND len(list_filter(f.kept, lambda k: k.t <> '' AND (k.t = x.t OR len(list_intersect(k.w, x.w)) / greatest(len(k.w) + len(x.w) - len(list_intersect(k.w, x.w)), 1) >= 0.82))) > 0
    THEN f.kept ELSE list_append(f.kept, {{'n': x.n, 't': x.t, 'w': x.w}}) END FROM cf f JOIN co x ON x.document = f.document AND x.n = f.n + 1),
ck AS (SELECT document, unnest(list_transform(arg_max(kept, n), lambda k: k.n)) AS n FROM cf GROUP BY document),
merged AS (SELECT document, 'change_' || lpad(CAST(row_number() OVER (PARTITION BY document ORDER BY {order("harm_label", ("harmful", "neutral", "fair"))}, {order("change_type", ("modified", "added", "removed"))}, pos, what, harm_label, change_type) AS VARCHAR), 3, '0') AS id,
  what AS what_changed, harm_label, change_type FROM co JOIN ck USING (document, n))"""


#: ``rel`` (query_id, chunk_id): documents that hold an item, or six of its words in a row, blanks and case aside.
RELEVANT = f"""
ri AS (SELECT item_id AS query_id, lower({CLAUSE.format("text")}) AS n FROM benchmark), rd AS (SELECT doc_id AS chunk_id, lower({CLAUSE.format("text")}) AS h FROM documents),
rw AS (SELECT query_id, n, string_split(n, ' ') AS w FROM ri WHERE n <> ''),
rr AS (SELECT DISTINCT query_id, CASE WHEN len(w) < 6 THEN n ELSE array_to_string(w[i:i + 5], ' ') END AS run FROM rw, unnest(range(1, greatest(len(w) - 4, 2))) AS u(i)),
rel AS (SELECT DISTINCT query_id, chunk_id FROM rr JOIN rd ON contains(h, run))"""

#: ``me``: hit, mrr, precision, recall and ndcg at 15 of the ranking ``r`` against ``rel``.
MEASURED = """
mk AS (SELECT r.query_id, rank, CASE WHEN rel.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM r LEFT JOIN rel USING (query_id, chunk_id) WHERE rank <= 15),
mg AS (SELECT query_id, sum(rel) AS f, count(*) AS n, min(rank) FILTER (rel = 1) AS first, sum(rel * ln(2) / ln(rank + 1)) AS dcg FROM mk GROUP BY 1),
mt AS (SELECT query_id, count(*) AS total FROM rel GROUP BY 1),
me AS (SELECT query_id, CAST(CASE WHEN f > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hit, round(coalesce(1 / first, 0), 6) AS mrr, round(f / n, 6) AS precision, round(coalesce(f / total, 0), 6) AS recall,
  round(CASE WHEN f > 0 THEN dcg / list_sum(list_transform(range(1, CAST(f AS INT) + 1), lambda i: ln(2) / ln(i + 1))) ELSE 0 END, 6) AS ndcg FROM mg LEFT JOIN mt USING (query_id))"""

#: ``nn`` (id, best_id, paragraph_id, similarity): the paragraph of all documents that is most like a benchmark item by TF-IDF of character 3- to 5-grams inside words.
NEAREST = f"""
{paragraphs()}, tr AS (SELECT doc_id, paragraph_id, lower({CLAUSE.format("t")}) AS t FROM p), te AS (SELECT item_id, lower({CLAUSE.format("text")}) AS t FROM benchmark),
tw AS (SELECT doc_id, paragraph_id, word, count(*) AS c FROM (SELECT doc_id, paragraph_id, unnest(string_split(t, ' ')) AS word FROM tr) WHERE word <> '' GROUP BY 1, 2, 3),
ew AS (SELECT item_id, word, count(*) AS c FROM (SELECT item_id, unnest(string_split(t, ' ')) AS word FROM te) WHERE word <> '' GROUP BY 1, 2),
wg AS (SELECT word, substr(' ' || word || ' ', i, n) AS gram, count(*) AS k FROM (SELECT word FROM tw UNION SELECT word FROM ew), (SELECT unnest([3, 4, 5]) AS n), unnest(range(1, length(word) + 4 - n)) AS u(i) GROUP BY 1, 2),
tg AS (SELECT doc_id, paragraph_id, gram, sum(c * k) AS tf FROM tw JOIN wg USING (word) GROUP BY 1, 2, 3),
gi AS (SELECT gram, ln((1 + (SELECT count(*) FROM p)) / (1 + count(*))) + 1 AS idf FROM tg GROUP BY 1 HAVING count(*) >= 2),
tn AS (SELECT doc_id, paragraph_id, sqrt(sum((tf * idf) ** 2)) AS norm FROM tg JOIN gi USING (gram) GROUP BY 1, 2),
eg AS (SELECT item_id, gram, sum(c * k) * any_value(idf) AS w, any_value(idf) AS idf FROM ew JOIN wg USING (word) JOIN gi USING (gram) GROUP BY 1, 2),
en AS (SELECT item_id, sqrt(sum(w ** 2)) AS norm FROM eg GROUP BY 1),
dp AS (SELECT item_id, doc_id, paragraph_id, sum(w * tf * tg.tf_idf) AS dot FROM (SELECT tg.*, idf AS tf_idf FROM tg JOIN gi USING (gram)) tg JOIN eg USING (gram) GROUP BY 1, 2, 3),
sm AS (SELECT item_id, doc_id, paragraph_id, dot / tn.norm / en.norm AS s FROM dp JOIN tn USING (doc_id, paragraph_id) JOIN en USING (item_id)),
bs AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id, paragraph_id) = 1),
nn AS (SELECT item_id AS id, doc_id AS best_id, CAST(paragraph_id AS BIGINT) AS paragraph_id, coalesce(s, 0) AS similarity FROM te LEFT JOIN bs USING (item_id))"""

#: Overlapping chunks of 1,000 characters: a paragraph end, else a sentence end, in the second half ends a chunk. (doc_id, chunk_index, text).
OVERLAPPING = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, text, n, -1 AS k, 0 AS first, 0 AS stop FROM d
  UNION ALL SELECT doc_id, text, n, k + 1, head, CASE WHEN head + 1000 >= n THEN n WHEN contains(seg, chr(10) || chr(10)) THEN head + 501 + length(regexp_extract(seg, '(?s)^(.*)\n\n', 1))
      WHEN contains(seg, '. ') THEN head + 502 + length(regexp_extract(seg, '(?s)^(.*)\. ', 1)) ELSE head + 1000 END
    FROM (SELECT *, substr(text, head + 502, 499) AS seg FROM (SELECT *, CASE WHEN k < 0 THEN 0 ELSE stop - 200 END AS head FROM b WHERE stop < n))),
t AS (SELECT doc_id, k, trim(substr(text, first + 1, stop - first), {_BLANK}) AS text FROM b WHERE k >= 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, text FROM t WHERE text <> ''"""

#: The session state machine over the events: a signup starts a session, an error ends it; twenty studies.
STAMPED = """
WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS study, event_id AS arrival, epoch_us(ts) // 1000 AS server_ms, CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'session_end' ELSE event_type END AS event_type,
    props AS data, CAST(user_id AS VARCHAR) AS participant, CAST(event_id AS VARCHAR) AS session FROM events),
k AS (SELECT *, last_value(CASE WHEN event_type IN ('session_start', 'session_end') THEN event_type END IGNORE NULLS) OVER w = 'session_start' AS open_, count(*) FILTER (event_type = 'session_end') OVER w AS part
  FROM e WINDOW w AS (PARTITION BY study ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, coalesce(open_, false) <> (event_type = 'session_start') AS logged FROM k),
o AS (SELECT *, row_number() OVER w - 1 AS place, first_value(participant) OVER w AS own, first_value(session) OVER w AS its, first_value(server_ms) OVER w AS began FROM m WINDOW w AS (PARTITION BY study, part, logged ORDER BY arrival))
SELECT study, arrival, server_ms, event_type, data, CASE WHEN logged THEN own END AS participant_id, CASE WHEN logged THEN its END AS session_id, CASE WHEN logged THEN place END AS seq, CASE WHEN logged THEN server_ms - began END AS t_ms, logged,
  CASE WHEN logged THEN NULL WHEN event_type = 'session_start' THEN 'already_active' ELSE 'no_active_session' END AS reason FROM o"""

SCREENS = ("profile", "analyzing", "results", "preview", "ask_ai")

#: ``sp``: for each session and screen the wall and active time inside the session, over entries; the log is made from the events.
SCREEN_TIMES = f"""
sl AS (SELECT CAST(user_id AS VARCHAR) AS participant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_id, ts, event_type, value, {list(SCREENS)}[CAST(event_id // 7 % 5 + 1 AS INT)] AS scr, epoch_us(ts) // 1000 - epoch_ms(date_trunc('day', ts)) AS t FROM events),
sr AS (SELECT *, event_type = 'view' AS beat, CASE event_type WHEN 'view' THEN round(value * 100) ELSE round(value * 90) END AS wall, round(value * 50) AS active FROM sl WHERE event_type = 'view' OR event_type = 'signup' AND round(value * 90) >= 100),
sb AS (SELECT *, coalesce(NOT lag(beat) OVER w OR beat AND wall < lag(wall) OVER w, true) AS opens FROM sr WINDOW w AS (PARTITION BY participant_id, session_id, scr ORDER BY event_id)),
se AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY participant_id, session_id, scr ORDER BY event_id) AS entry FROM sb),
ss AS (SELECT participant_id, session_id, scr, entry, max(active) AS active, greatest(0, max(wall) - greatest(0, arg_min(wall - t, event_id))) AS inside FROM se GROUP BY 1, 2, 3, 4),
sp AS (SELECT participant_id, session_id, scr, sum(inside) AS wall, sum(least(active, inside)) AS active FROM ss GROUP BY 1, 2, 3)"""


def _seconds(scr: str, what: str) -> str:
    return f"printf('%.1f', coalesce(max({what}) FILTER (scr = '{scr}'), 0) / 1000) AS {scr}_{what}_s"


_NAMES = "participant_id, session_id"
#: The session roll-up of that log, which has no starts, ends, selections or cards.
SESSIONS = f"""
WITH {SCREEN_TIMES}, sw AS (SELECT {_NAMES}, {", ".join(_seconds(s, w) for s in SCREENS for w in ("wall", "active"))} FROM sp GROUP BY ALL),
sc AS (SELECT {_NAMES}, CAST(arg_min(ts, event_id) AS VARCHAR) AS started_at, false AS ended, '' AS end_reason, max(t) AS duration_ms, '' AS note, 'v1' AS app_commit, '' AS model_dir, '' AS ollama_model, '' AS risk_scorer, '' AS diff_inject_classifier_context,
  count(*) AS n_client_events, count(*) FILTER (event_type = 'view') AS n_heartbeats, coalesce(printf('%.1f', arg_min(t, event_id) FILTER (scr = 'results') / 1000), '') AS time_to_results_s,
  '' AS profile_service, '' AS profile_role, '' AS profile_concerns, '' AS profile_mode, '' AS profile_context_length, CAST(NULL AS INTEGER) AS n_cards_shown, CAST(NULL AS INTEGER) AS n_harmful_shown,
  CAST(0 AS BIGINT) AS n_cards_expanded_unique, CAST(0 AS BIGINT) AS n_expands, CAST(0 AS BIGINT) AS n_original_clause_open_unique, CAST(0 AS BIGINT) AS n_cards_seen_1s, count(*) FILTER (event_type = 'error') AS n_category_toggles,
  CAST(0 AS BIGINT) AS n_preview_toggles, CAST(0 AS BIGINT) AS n_ask_ai_opens, count(*) FILTER (event_type NOT IN ('view', 'click', 'signup', 'error')) AS n_ask_ai_messages,
  CAST(coalesce(sum(event_id % 13) FILTER (event_type NOT IN ('view', 'click', 'signup', 'error')), 0) AS BIGINT) AS ask_ai_chars, count(*) FILTER (event_type = 'click') AS n_clicks FROM sl GROUP BY ALL)
SELECT sc.*, {", ".join(f"coalesce({s}_{w}_s, '0.0') AS {s}_{w}_s" for s in SCREENS for w in ("wall", "active"))} FROM sc LEFT JOIN sw USING ({_NAMES})"""
