"""Queries on parsing functions, probes, scorer flows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausemill.functions import numeric as N
from clausemill.functions import text as T
from clausemill.operators import analysis, dual_head, metrics, probes, retrieval, scoring
from clausemill.plans import oracle_parts as O
from clausemill.plans.label_queries import HARM, harm
from clausemill.plans.registry import query
from clausemill.plans.table_queries import BM25, _search, stamped
from clausemill.session import checkpoint_dir, table, written
from clausemill.streaming import events as S

COMMENT = "CASE doc_id % 7 WHEN 0 THEN 'acc_sus 0; ip -1' WHEN 1 THEN 'acc_del 1, tran 0' WHEN 2 THEN 'docu odd' WHEN 3 THEN 'uncle' WHEN 4 THEN 'zzz 1; ip' WHEN 5 THEN '' ELSE 'ip 1 ' END"


@query("comment_segments", f"""
WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array({COMMENT}, '[;,]'))) AS seg FROM documents), n AS (SELECT * FROM s WHERE seg <> ''),
p AS (SELECT *, regexp_extract(seg, '^([A-Za-z_]+)\\s+(-?1|0)\\s*$', 1) AS c, regexp_extract(seg, '^([A-Za-z_]+)\\s+(-?1|0)\\s*$', 2) AS v, regexp_extract(seg, '^([A-Za-z_]+)', 1) AS w FROM n)
SELECT doc_id, seg, CASE c WHEN '' THEN NULL WHEN 'ip' THEN 'IP' WHEN 'tran' THEN 'transfer' ELSE c END AS code, CASE WHEN v <> '' THEN CAST(v AS INT) END AS score,
  CASE WHEN lower(seg) LIKE 'docu%' THEN 'document_note' WHEN lower(seg) LIKE 'uncle%' THEN 'unclear' WHEN lower(CASE w WHEN 'ip' THEN 'IP' WHEN 'tran' THEN 'transfer' ELSE w END) NOT IN ('acc_sus', 'acc_del', 'ip', 'transfer') THEN 'unknown_code'
    WHEN v = '' THEN 'missing_score' ELSE 'parsed' END AS status FROM p""")
def comment_segments(spark, sf_dir):
    alias = {"ip": "IP", "tran": "transfer"}
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.segments(F.expr(COMMENT))).alias("seg"))
    return d.select("doc_id", "seg", T.code_of(F.col("seg"), alias).alias("code"), T.score_of(F.col("seg")).alias("score"), T.segment_status(F.col("seg"), ["acc_sus", "acc_del", "IP", "transfer"], alias).alias("status"))


TAGS = "CASE doc_id % 4 WHEN 0 THEN 'ch2 ltd3' WHEN 1 THEN 'a1' WHEN 2 THEN 'bad9' ELSE '' END"


@query("tagged_sentences", f"""
WITH t AS (SELECT doc_id, unnest(string_split({TAGS}, ' ')) AS tag FROM documents)
SELECT doc_id, tag, NULLIF(regexp_extract(tag, '^([a-z]+)([123])$', 1), '') AS topic, 2 - TRY_CAST(NULLIF(regexp_extract(tag, '^([a-z]+)([123])$', 2), '') AS INT) AS score FROM t WHERE tag <> ''""")
def tagged_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.expr(TAGS), r"\s+")).alias("tag")).where("tag != ''")
    topic, level = T.tag_parts(F.col("tag"))
    return d.select("doc_id", "tag", topic.alias("topic"), T.level_score(level).alias("score"))


@query("class_scores", """
WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'blocker' WHEN 1 THEN 'Bad' WHEN 2 THEN 'neutral' WHEN 3 THEN ' good' ELSE 'odd' END AS c FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS score, doc_id % 5 = 0 AS blocker, CASE WHEN doc_id % 5 = 4 THEN 'unknown_class' ELSE 'parsed' END AS status FROM c""")
def class_scores(spark, sf_dir):
    c = F.element_at(F.array(*map(F.lit, ("blocker", "Bad", "neutral", " good", "odd"))), (F.col("doc_id") % 5 + 1).cast("int"))
    score, blocker, status = T.class_score(c)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), blocker.alias("blocker"), status.alias("status"))


@query("cell_functions", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN value = floor(value) AND value BETWEEN -1 AND 1 THEN CAST(value AS INT) END AS domain, list_filter([event_type, 'x', 'error'], lambda t: t NOT IN ('error', 'x')) AS kept,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS first_text, event_type LIKE '%ic%' OR event_type LIKE '%up%' AS any_code, CASE WHEN event_id % 2 = 0 THEN 'ACME' ELSE event_type END AS company FROM events""")
def cell_functions(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").select(
        "event_id", T.json_cell(F.col("props"), "struct<k:bigint>")["k"].alias("k"), T.domain_int(F.col("value").cast("string")).alias("domain"), T.without_ids(F.array("event_type", F.lit("x"), F.lit("error")), ["error", "x"]).alias("kept"),
        T.first_text(F.when(even, F.lit(" ")).otherwise(F.lit("none")), F.col("event_type")).alias("first_text"), T.holds_any_code(F.col("event_type"), ["ic", "up"]).alias("any_code"), T.company_of(F.when(even, F.lit("ACME.docx")), F.col("event_type")).alias("company"),
    )


@query("changed_pairs", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text, ' ' || chr(10)) ELSE 'old' END AS source FROM conversations WHERE turn % 3 <> 0 AND trim(text, ' ' || chr(10)) <> ''")
def changed_pairs(spark, sf_dir):
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.changed_pair(F.lit("old"), F.when(t % 2 == 0, F.col("text")), F.when(t % 3 != 0, F.lit("why"))).alias("p"))
    return c.where("p IS NOT NULL").select("conv_id", "turn", "p.source")


@query("topic_probabilities", """
SELECT vec_id, list_transform(list_sort(list_filter(list_transform([1, 2, 3], lambda i: {'p': -1 / (1 + exp(-CAST(embedding[i] AS DOUBLE))), 'i': i}), lambda r: r.p <= -0.5)), lambda r: 't' || (r.i - 1)) AS topics,
  round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 3) AS p0 FROM embeddings""")
def topic_probabilities(spark, sf_dir):
    e, names = table(spark, sf_dir, "embeddings"), ["t0", "t1", "t2"]
    return e.select("vec_id", N.predicted_topics(F.col("embedding"), names).alias("topics"), F.round(N.topic_probabilities(F.col("embedding"), names, 9)["t0"], 3).alias("p0"))


@query("point_groups", "SELECT user_id, event_type, min(event_id) AS first_event, list_sort(list(DISTINCT value)) AS values_, count(*) AS n FROM events GROUP BY 1, 2")
def point_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"), F.array_sort(F.collect_set("value")).alias("values_"), F.count("*").alias("n"))


@query("top_labels", "WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def top_labels(spark, sf_dir):
    """The twenty most frequent words: a top-k report, counted over all texts."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word != ''")
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("first_active_topic", """
SELECT vec_id, coalesce((list_filter(['t0', 't1', 't2'], lambda t, i: embedding[i] > 0))[1], 'none') AS primary_topic FROM embeddings""")
def first_active_topic(spark, sf_dir):
    active = F.filter(F.array(*map(F.lit, ("t0", "t1", "t2"))), lambda t, i: F.get("embedding", i) > 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(F.get(active, F.lit(0)), F.lit("none")).alias("primary_topic"))


@query("answer_spans", """
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'No Answer' ELSE array_to_string((string_split(text, ' '))[2:3], ' ') END AS answer FROM conversations""")
def answer_spans(spark, sf_dir):
    none = F.col("conv_id") % 3 == 0
    starts = F.when(none, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.9))).otherwise(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.2)))
    ends = F.when(none, F.array(F.lit(0.9), F.lit(0.2), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.9)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.answer_span(starts, ends, F.split("text", " ")).alias("answer"))


def _split(rows):
    return rows.withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))


@query("length_probe")
def length_probe(spark, sf_dir):
    """What a document's length alone says of its quality."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "quality", F.col("n_chars").cast("double").alias("n"))
    out = probes.linear_probe(_split(d), "quality", ["n"]).where("split = 'test'")
    return metrics.class_summary(metrics.confusion(out.withColumn("mask", F.lit(1.0))))


@query("embedding_probe")
def embedding_probe(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", "embedding")
    out = probes.linear_probe(_split(e), "label", array="embedding").where("split = 'test'")
    return metrics.class_summary(metrics.confusion(out.withColumn("mask", F.lit(1.0))))


@query("dual_head_training")
def dual_head_training(spark, sf_dir):
    """Two heads trained over all embeddings: topics from the label, masked by id, and a risk class; the losses of each epoch."""
    n, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").select(
        n.alias("row_id"), F.when(n % 5 == 0, "validation").otherwise("train").alias("split"), F.col("embedding").cast("array<double>").alias("x"),
        F.array(*[(label % 4 == k).cast("double") for k in range(4)]).alias("labels"), F.array(*[(n % (k + 3) != 0).cast("double") for k in range(4)]).alias("mask"),
        (label % 3).cast("int").alias("risk"), (n % 7 != 0).cast("double").alias("risk_mask"),
    )
    state = dual_head.train(written(rows, "embedded"), 4, f"{checkpoint_dir(spark)}/dual-{uuid.uuid4().hex}", epochs=6, rate=0.02)
    return spark.createDataFrame(state.losses, "epoch int, train_loss double, validation_loss double")


@query("analyzed_documents", f"WITH RECURSIVE {O.analysis()} SELECT * FROM an")
def analyzed_documents(spark, sf_dir):
    """Text to predictions with the deterministic scorer."""
    return analysis.analyze(table(spark, sf_dir, "documents").select("doc_id", "text"), scoring.HashScorer(), separator="\n")


_EXPLAINED = O.DRAW.format("explain", "text")


@query("explained_clauses", f"""
WITH RECURSIVE {O.analysis()} SELECT doc_id, chunk_id, text, predicted_harm_class, 't' || {_EXPLAINED} % 7 AS title, substr(text, 1, 20) AS description FROM an WHERE predicted_harm_class = 'Harmful'""")
def explained_clauses(spark, sf_dir):
    return analysis.explain(analyzed_documents(spark, sf_dir), scoring.HashScorer("explain"), ["harmful"])


_CHANGED = f"""
SELECT doc_id AS document, chunk_id AS pos, text AS what, lower(predicted_harm_class) AS harm_label, CASE WHEN EXISTS (FROM gone g WHERE g.doc_id = c.doc_id AND g.paragraph_id = c.paragraph_id) THEN 'modified' ELSE 'added' END AS change_type FROM came c
UNION ALL SELECT doc_id, chunk_id, text, lower(predicted_harm_class), 'removed' FROM gone g WHERE NOT EXISTS (FROM came c WHERE g.doc_id = c.doc_id AND g.paragraph_id = c.paragraph_id)"""


@query("version_changes", f"""
WITH RECURSIVE newer AS (SELECT doc_id, regexp_replace(text, '^\\S+', 'Changed') || chr(10) || 'This paragraph is new and of some length.' AS text FROM documents), {O.analysis()}, {O.analysis(docs="newer", s="2")},
a1 AS (SELECT *, {O.CHANGE.format("text")} AS key FROM an), a2 AS (SELECT *, {O.CHANGE.format("text")} AS key FROM an2), gone AS (SELECT * FROM a1 ANTI JOIN a2 USING (doc_id, key)), came AS (SELECT * FROM a2 ANTI JOIN a1 USING (doc_id, key)),
{O.merged(_CHANGED)} SELECT * FROM merged""")
def version_changes(spark, sf_dir):
    """Each document against a version whose first words are changed and to which a paragraph is added."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = d.withColumn("text", F.concat(F.regexp_replace("text", r"\A\S+", "Changed"), F.lit("\nThis paragraph is new and of some length.")))
    return analysis.compared(d, new, scoring.HashScorer(), separator="\n")  # one ledger of both: what did not change is asked once


@query("grouped_comparison", f"""
WITH {HARM}, z AS (SELECT 'single' AS side, truth, predicted, doc_id FROM h UNION ALL SELECT 'group', truth, predicted, doc_id FROM h WHERE doc_id % 11 <> 0),
k AS (SELECT unnest([0, 1, 2]) AS k), t AS (SELECT side, k, count(*) FILTER (truth = k AND predicted = k) AS tp, count(*) FILTER (truth = k OR predicted = k) + count(*) FILTER (truth = k AND predicted = k) AS both_ FROM z, k GROUP BY 1, 2),
f AS (SELECT side, round(avg(2 * tp / both_), 9) AS f1 FROM t WHERE both_ > 0 GROUP BY 1), b AS (SELECT sum(ceil(n / 20)) AS calls FROM (SELECT count(*) AS n FROM h GROUP BY doc_id % 3))
SELECT (SELECT count(*) FROM h) AS rows, (SELECT count(*) FROM h WHERE doc_id % 11 <> 0) AS valid_rows, (SELECT round(avg(1.0), 9) FROM h) AS agreement, (SELECT f1 FROM f WHERE side = 'single') AS single_f1, (SELECT f1 FROM f WHERE side = 'group') AS group_f1,
  CAST(calls AS BIGINT) AS calls, round(100.0 * (1 - calls / (SELECT count(*) FROM h)), 9) AS reduction_percent FROM b""")
def grouped_comparison(spark, sf_dir):
    h = harm(spark, sf_dir).select(F.col("doc_id").alias("row_id"), (F.col("truth") - 1).alias("truth"), (F.col("predicted") - 1).alias("score"))
    grouped = h.select("row_id", F.when(F.col("row_id") % 11 != 0, F.col("score")).alias("score"))
    calls = scoring.batches(h.withColumn("g", F.col("row_id") % 3), 20, "g", "row_id").select("g", "batch").distinct()
    s = analysis.comparison_summary(h, grouped, calls)
    return s.withColumns({c: F.round(c, 9) for c in ("agreement", "single_f1", "group_f1", "reduction_percent")})


_PAIR = O.DRAW.format("rerank", "b.text || chr(10) || chr(10) || d.text")


@query("reranked_chunks", f"""
WITH {BM25}, s AS (SELECT query_id, chunk_id, CAST({_PAIR} % 3 - 1 AS DOUBLE) AS score FROM r JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 10)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 4""", rank="INTEGER")
def reranked_chunks(spark, sf_dir):
    queries, chunks, ranked = _search(spark, sf_dir, 10)
    pairs = ranked.select("query_id", "chunk_id").join(queries, "query_id").join(chunks, "chunk_id")
    return retrieval.reranked(pairs, scoring.HashScorer("rerank"), 4)


@query("merged_rank_lists", """
WITH l AS (SELECT user_id AS query_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS list, event_id AS rank, CAST(floor(value) AS BIGINT) AS content FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY list, rank) AS n FROM l), p AS (SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY list, rank) AS place FROM o WHERE n = 1)
SELECT * FROM p WHERE place <= 5""", place="INTEGER")
def merged_rank_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("list"), F.col("event_id").alias("rank"), F.floor("value").cast("long").alias("content"))
    return retrieval.merged_ranks(rows, "content", 5).select("query_id", "content", "place")


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_gap_sessions", """
WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n_events, round(sum(value), 6) AS value FROM k GROUP BY user_id, s""")
def stream_gap_sessions(spark, sf_dir):
    """The gap sessions read as a stream, written as Parquet and read again."""
    out = S.drained(spark, S.gap_sessions(_stream(spark, sf_dir), late="3650 days"), f"gaps_{uuid.uuid4().hex}", "complete")
    return stamped(out)


@query("stream_stamped_events", O.STAMPED)
def stream_stamped_events(spark, sf_dir):
    """The events through the session state machine: a signup starts a session, an error ends it."""
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "error", "session_end").otherwise(F.col("event_type"))
    rows = _stream(spark, sf_dir).select(
        (F.col("user_id") % 20).cast("string").alias("study"), F.col("event_id").alias("arrival"), F.unix_millis("ts").alias("server_ms"), kind.alias("event_type"), F.col("props").alias("data"),
        F.col("user_id").cast("string").alias("participant_id"), F.col("event_id").cast("string").alias("session_id"),
    )
    return S.drained(spark, S.stamped(rows), f"stamped_{uuid.uuid4().hex}")
