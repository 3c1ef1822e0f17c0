"""Queries on the relational tables, the events, and the vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausemill.functions import numeric as N
from clausemill.operators import fusion, relational as R
from clausemill.operators import retrieval, sessions, vector_index
from clausemill.operators.inverted import InvertedIndex
from clausemill.operators.vector_index import VectorIndex
from clausemill.plans import oracle_parts as O
from clausemill.plans.registry import query
from clausemill.schemas import violations, with_columns_of
from clausemill.session import checkpoint_dir, table
from clausemill.streaming import events as S


@query("crosstab_margins", """
WITH c AS (SELECT CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang))
SELECT source, CAST(coalesce(sum(n) FILTER (lang = 'de'), 0) AS BIGINT) AS de, CAST(coalesce(sum(n) FILTER (lang = 'en'), 0) AS BIGINT) AS en, CAST(coalesce(sum(n) FILTER (lang = 'es'), 0) AS BIGINT) AS es, CAST(coalesce(sum(n) FILTER (lang = 'fr'), 0) AS BIGINT) AS fr, CAST(coalesce(sum(n) FILTER (lang = 'All'), 0) AS BIGINT) AS "All" FROM c GROUP BY source""")
def crosstab_margins(spark, sf_dir):
    return R.crosstab(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("pivot_lang_source", "SELECT source, CAST(coalesce(sum(n_chars) FILTER (lang = 'de'), 0) AS BIGINT) AS de, CAST(coalesce(sum(n_chars) FILTER (lang = 'en'), 0) AS BIGINT) AS en, CAST(coalesce(sum(n_chars) FILTER (lang = 'es'), 0) AS BIGINT) AS es, CAST(coalesce(sum(n_chars) FILTER (lang = 'fr'), 0) AS BIGINT) AS fr FROM documents GROUP BY source")
def pivot_lang_source(spark, sf_dir):
    return R.pivot(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"], F.sum("n_chars"))


@query("unpivot_labels", "SELECT doc_id, 'quality' AS variable, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def unpivot_labels(spark, sf_dir):
    return R.melt(table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])


@query("value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return R.value_counts(table(spark, sf_dir, "events"), "event_type").withColumn("share", F.round("share", 9))


@query("group_spread", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(stddev_pop(l_quantity), 6) AS std_pop, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def group_spread(spark, sf_dir):
    q = F.col("l_quantity")
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.round(F.stddev_pop(q), 6).alias("std_pop"), F.min(q).alias("least"), F.max(q).alias("most"), F.count("*").alias("n"))


@query("distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("multi_tag_groups", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def multi_tag_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n > 1")


@query("conditional_profile", "SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors FROM events", errors="BIGINT")
def conditional_profile(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("inner_two_key_join", "SELECT c.c_custkey, c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_mktsegment = CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'AUTOMOBILE' END GROUP BY 1, 2")
def inner_two_key_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("AUTOMOBILE").alias("segment"), "o_totalprice")
    return c.join(o, ["c_custkey", "segment"]).groupBy("c_custkey", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("suffixed_join", "SELECT a.n_nationkey AS k, a.n_name AS name_x, b.r_name AS name_y FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def suffixed_join(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    return R.merge(a, b, ["region"]).drop("region")


@query("filtered_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 45 GROUP BY 1")
def filtered_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("left_compare", "SELECT d.doc_id, l.quality, (d.doc_id % 2 = l.quality) AS agrees, (d.doc_id % 2) IS DISTINCT FROM l.quality AS differs FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("guess"))
    told = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return told.select("doc_id", "quality", (F.col("guess") == F.col("quality")).alias("agrees"), (~F.col("guess").eqNullSafe(F.col("quality"))).alias("differs"))


@query("dimension_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = R.lookup(s, table(spark, sf_dir, "nation"), ["n_nationkey"], required=True)
    return R.lookup(n.withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, sf_dir, "region"), ["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("conflict_membership", "WITH c AS (SELECT o_custkey, o_orderstatus FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) > 1) SELECT o_orderkey, c.o_custkey IS NOT NULL AS in_conflict FROM orders o LEFT JOIN c USING (o_custkey, o_orderstatus)")
def conflict_membership(spark, sf_dir):
    from clausemill.plans.label_queries import conflict_detect

    c = conflict_detect(spark, sf_dir).select("o_custkey", "o_orderstatus", F.lit(True).alias("hit"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.join(c, ["o_custkey", "o_orderstatus"], "left").select("o_orderkey", F.col("hit").isNotNull().alias("in_conflict"))


@query("identity_gaps", "SELECT doc_id, 'a' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def identity_gaps(spark, sf_dir):
    return R.identity_gaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("set_counts", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b")
def set_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return R.set_counts(side("A"), side("R"))


@query("union_missing", "SELECT doc_id, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def union_missing(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.unionByName(lab, allowMissingColumns=True)


@query("excluded_values", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup') OR event_type IS NULL")
def excluded_values(spark, sf_dir):
    return R.excluded(table(spark, sf_dir, "events"), "event_type", ["error", "signup"]).select("event_id")


@query("validator_counts", "SELECT count(*) FILTER (NOT (quality IN (0, 1))) AS quality_domain, count(*) FILTER (NOT (toxic = 0)) AS never_toxic FROM labels")
def validator_counts(spark, sf_dir):
    return violations(table(spark, sf_dir, "labels"), {"quality_domain": F.col("quality").isin(0, 1), "never_toxic": F.col("toxic") == 0})


@query("projected_schema", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS r_comment FROM region")
def projected_schema(spark, sf_dir):
    return with_columns_of(table(spark, sf_dir, "region"), {"r_regionkey": "int", "r_name": "string", "r_comment": "string"})


@query("row_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 150 OFFSET 50")
def row_slice(spark, sf_dir):
    """A slice by position is the operator itself."""
    return R.positions(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 50, 200)


@query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 * 5000 + 1 AS VARCHAR) || '-' || CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 * 5000 + 5000 AS VARCHAR) AS range FROM orders")
def row_numbers(spark, sf_dir):
    return R.range_labels(R.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]), "row_id", 5000)


@query("ffill", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def ffill(spark, sf_dir):
    from clausemill.sources.readers import forward_filled

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return forward_filled(e, ["last_purchase"], "event_id", "user_id")


@query("cumulative_entry_time", """
WITH e AS (SELECT user_id, event_id, value, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) OR lag(value) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 1 ELSE 0 END AS o FROM events),
n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e), m AS (SELECT user_id, k, max(value) AS most FROM n GROUP BY 1, 2)
SELECT user_id, round(sum(most), 6) AS total, count(*) AS entries FROM m GROUP BY 1""")
def cumulative_entry_time(spark, sf_dir):
    return sessions.cumulative_entries(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("total", F.round("total", 6))


@query("event_session_rollup", """
SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_clicks, count(DISTINCT event_type) AS n_types, min(event_id) AS first_event,
  arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, arg_min(event_id, event_id) FILTER (event_type = 'purchase') AS first_purchase,
  max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest_k FROM events GROUP BY user_id""")
def event_session_rollup(spark, sf_dir):
    t, i = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.count_if(t == "click").alias("n_clicks"), F.countDistinct(t).alias("n_types"), F.min(i).alias("first_event"),
        F.min_by(t, i).alias("first_type"), F.max_by(t, i).alias("last_type"), F.min(F.when(t == "purchase", i)).alias("first_purchase"),
        F.max(F.get_json_object("props", "$.k").try_cast("long")).alias("largest_k"),
    )


def study_log(spark, sf_dir):
    """The events as an interaction log: a user's events of a day are a session on five screens."""
    e, i = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    screens = F.array(*map(F.lit, sessions.SCREENS))
    kind = F.when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "screen_view").when(F.col("event_type") == "error", "category_toggle").otherwise("ask_ai_message")
    screen = F.element_at(screens, (F.floor(i / 7) % 5 + 1).cast("int"))
    data = F.to_json(F.struct(screen.alias("screen"), F.round(F.col("value") * 100).cast("long").alias("screen_ms"), F.round(F.col("value") * 50).cast("long").alias("active_ms"), F.round(F.col("value") * 90).cast("long").alias("duration_ms"), (i % 13).alias("length")))
    return e.select(
        F.col("ts").cast("string").alias("server_ts"), F.col("user_id").cast("string").alias("participant_id"), F.to_date("ts").cast("string").alias("session_id"), i.alias("seq"),
        (F.unix_millis("ts") - F.unix_millis(F.date_trunc("day", F.col("ts")))).alias("t_ms"), kind.alias("event_type"), screen.alias("screen"), F.lit("c").alias("client_id"), i.alias("client_seq"),
        F.lit(None).cast("string").alias("client_ts"), F.lit("v1").alias("app_commit"), data.alias("data"), i.alias("line"),
    )


@query("study_sessions", O.SESSIONS)
def study_sessions(spark, sf_dir):
    """The whole session roll-up."""
    return sessions.session_rollup(study_log(spark, sf_dir))[0]


@query("screen_wall_times", """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, ['profile', 'analyzing', 'results', 'preview', 'ask_ai'][CAST(event_id // 7 % 5 + 1 AS INT)] AS scr,
    CASE event_type WHEN 'view' THEN 'hb' ELSE 'view' END AS kind, CASE event_type WHEN 'view' THEN round(value * 100) ELSE round(value * 90) END AS wall, epoch_ms(ts) - epoch_ms(date_trunc('day', ts)) AS t
  FROM events WHERE event_type = 'view' OR event_type = 'signup' AND round(value * 90) >= 100),
l AS (SELECT *, lag(kind) OVER w AS pk, lag(wall) OVER w AS pw FROM e WINDOW w AS (PARTITION BY user_id, day, scr ORDER BY event_id)),
n AS (SELECT *, sum(CASE WHEN pk IS NULL OR pk = 'view' OR kind = 'hb' AND wall < pw THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day, scr ORDER BY event_id) AS entry FROM l),
s AS (SELECT user_id, day, scr, entry, max(wall) AS wall, arg_min(greatest(0, wall - t), event_id) AS pre FROM n GROUP BY 1, 2, 3, 4)
SELECT CAST(user_id AS VARCHAR) AS participant_id, CAST(day AS VARCHAR) AS session_id, scr AS "at", sum(greatest(0, wall - pre)) AS wall FROM s GROUP BY 1, 2, 3""")
def screen_wall_times(spark, sf_dir):
    log = sessions.ordered(study_log(spark, sf_dir))
    return sessions.screen_times(sessions.screen_reports(log))[0].select("participant_id", "session_id", "at", "wall")


@query("gap_sessions", """
WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n_events, round(sum(value), 6) AS value FROM k GROUP BY user_id, s""")
def gap_sessions(spark, sf_dir):
    return stamped(S.gap_sessions(table(spark, sf_dir, "events")))


def stamped(found):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")
    return found.select("user_id", micros("start"), micros("end"), "n_events", F.round("value", 6).alias("value"))


@query("accepted_events", "SELECT CASE event_type WHEN 'click' THEN 'click' ELSE 'x' END AS event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def accepted_events(spark, sf_dir):
    taken, _ = S.accepted(table(spark, sf_dir, "events").select("event_type", F.col("props").alias("data")))
    return taken.groupBy("event_type").agg(F.count("*").alias("n"))


@query("rejected_events", "SELECT 'unknown_type' AS reason, count(*) AS n FROM events WHERE event_type <> 'click'")
def rejected_events(spark, sf_dir):
    _, refused = S.accepted(table(spark, sf_dir, "events").select("event_type", F.col("props").alias("data")))
    return refused.groupBy("reason").agg(F.count("*").alias("n"))


@query("sequence_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events", seq="INTEGER")
def sequence_numbers(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(by) - 1).alias("seq"))


@query("session_status", """
SELECT CAST(user_id AS VARCHAR) AS participant_id, count(*) AS n_events, max(event_id) FILTER (event_type = 'view') AS last_view FROM events GROUP BY 1""")
def session_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "heartbeat").otherwise("click")
    rows = e.select(F.col("user_id").cast("string").alias("participant_id"), F.lit("s").alias("session_id"), F.col("event_id").alias("server_ms"), kind.alias("event_type"), F.lit(None).cast("string").alias("screen"), F.col("event_id").alias("seq"))
    s = S.status(rows, F.lit(0).cast("long"))
    return s.select("participant_id", "n_events", F.round(-F.col("last_heartbeat_age_s") * 1000).cast("long").alias("last_view"))


@query("numeric_participants", "SELECT c_name, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), c_custkey) AS place FROM customer")
def numeric_participants(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name", F.regexp_extract("c_name", "([0-9]+)$", 1).alias("participant_id"), F.lit("").alias("started_at"), F.format_string("%09d", F.col("c_custkey")).alias("session_id"))
    keyed = c.select("c_name", *[k.alias(f"k{i}") for i, k in enumerate(sessions.participant_order())])
    return R.numbered(keyed, [f"k{i}" for i in range(5)], "n").select("c_name", (F.col("n") + 1).alias("place"))


@query("denormalize_nested", """
WITH c AS (SELECT c_nationkey, c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT n_nationkey AS service_id, count(c_custkey) AS n_cases, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_points FROM nation LEFT JOIN c ON n_nationkey = c_nationkey GROUP BY 1""")
def denormalize_nested(spark, sf_dir):
    services = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("service_id"), "n_name")
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), "c_name")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("service_id"))
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey").join(own, "case_id")
    nested = fusion.nested_export(services, cases, points)
    total = F.aggregate(F.transform("cases", lambda c: F.size(c["points"])), F.lit(0), lambda a, b: a + b)
    return nested.select("service_id", F.size("cases").cast("long").alias("n_cases"), total.cast("long").alias("n_points"))


@query("document_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'tagged:' || source WHEN doc_id % 3 = 1 THEN 'svc' || lang ELSE 'unknown:' || doc_id END AS document FROM documents")
def document_ids(spark, sf_dir):
    n = F.col("doc_id")
    a = F.when(n % 3 == 0, F.array(F.struct(F.lit("points").alias("source_dataset"), F.lit("9").alias("source_id")), F.struct(F.lit("tagged").alias("source_dataset"), F.concat("source", F.lit(":4:a1")).alias("source_id"))))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fusion.document_id(a, F.when(n % 3 == 1, F.concat(F.lit("svc"), "lang")), n, ["tagged", "coded"]).alias("document"))


@query("vector_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings)
SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""", rank="INTEGER")
def vector_topk(spark, sf_dir):
    """The ten best of all vectors for each query, which are the rows whose id 100 divides: top-k is the feature."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.vector_search(q, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10).select("query_id", "chunk_id", "rank")


@query("vector_index_recall")
def vector_index_recall(spark, sf_dir):
    """For each query (rows whose id 100 divides) the share of its ten exact neighbours that the index finds, and the share of vectors that it reads."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex.build(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    probes = index.calibrated(10, 0.96)
    shares = index.read(q, probes).select("query_id", F.round(F.col("read") / F.col("of"), 6).alias("share_read"))
    return vector_index.recall(index.search(q, 10, probes), vector_topk(spark, sf_dir)).join(shares, "query_id")


@query("vector_topk_source", """
WITH q AS (SELECT vec_id AS query_id, label, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM q JOIN embeddings e USING (label))
SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""", rank="INTEGER")
def vector_topk_source(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    return retrieval.vector_search(q, e.select(F.col("vec_id").alias("chunk_id"), "label", "embedding"), 5, "label").select("query_id", "chunk_id", "rank")


def _search(spark, sf_dir, k=25):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return queries, chunks, retrieval.bm25(queries, chunks, k)


BM25 = r"""
t AS (SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), ' '), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), x AS (SELECT doc_id, len(w) AS len, unnest(w) AS token FROM t),
tf AS (SELECT token, doc_id, len, count(*) AS tf FROM x GROUP BY 1, 2, 3), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(list_filter(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), ' '), lambda x: x <> '')) AS token FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 9) AS score FROM q JOIN tf USING (token) JOIN df USING (token), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)
"""


@query("bm25_topk", f"WITH {BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 25", rank="INTEGER")
def bm25_topk(spark, sf_dir):
    return _search(spark, sf_dir)[2].select("query_id", "chunk_id", "rank", N.half_away(F.col("score"), 6).alias("score"))


@query("bm25_index_topk", f"WITH {BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 25", rank="INTEGER")
def bm25_index_topk(spark, sf_dir):
    """The same ranks by way of a stored index with block maxima."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = InvertedIndex.build(chunks, f"{checkpoint_dir(spark)}/inverted-{uuid.uuid4().hex}", span=16)
    return index.search(queries, 25)[0].select("query_id", "chunk_id", "rank", N.half_away(F.col("score"), 6).alias("score"))


@query("rrf_fusion", f"""
WITH {BM25}, a AS (SELECT query_id, chunk_id, rank FROM r WHERE rank <= 25), b AS (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank_b FROM a),
u AS (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS s FROM a UNION ALL SELECT query_id, chunk_id, 0.5 / (60 + rank_b) FROM b), g AS (SELECT query_id, chunk_id, round(sum(s), 12) AS score FROM u GROUP BY 1, 2)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g""", rank="INTEGER")
def rrf_fusion(spark, sf_dir):
    a = _search(spark, sf_dir)[2].select("query_id", "chunk_id", "rank")
    b = a.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return retrieval.fused([a, b], [0.5, 0.5]).select("query_id", "chunk_id", "rank")


def _measured(spark, sf_dir):
    queries, chunks, ranked = _search(spark, sf_dir)
    one = lambda df: df.withColumn("contract", F.lit(0))
    answers = one(queries.withColumnRenamed("query", "answer"))
    return ranked, retrieval.relevance(answers, one(chunks), "contract")


@query("answer_relevance", f"WITH {O.RELEVANT} SELECT query_id, chunk_id FROM rel")
def answer_relevance(spark, sf_dir):
    """Which documents hold an item or six of its words in a row."""
    return _measured(spark, sf_dir)[1]


@query("ir_metrics", f"WITH {BM25}, {O.RELEVANT}, {O.MEASURED} SELECT * FROM me")
def ir_metrics(spark, sf_dir):
    ranked, relevant = _measured(spark, sf_dir)
    m = retrieval.measures(ranked, relevant, 15)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in retrieval.MEASURES])


@query("ir_summary", f"""
WITH {BM25}, {O.RELEVANT}, {O.MEASURED}, u AS (UNPIVOT me ON hit, mrr, precision, recall, ndcg INTO NAME measure VALUE value)
SELECT measure, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM u GROUP BY measure""")
def ir_summary(spark, sf_dir):
    s = retrieval.summary(ir_metrics(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("ir_measures_oracle", f"""
WITH {BM25}, k AS (SELECT * FROM r WHERE rank <= 10), m AS (SELECT query_id, rank, CASE WHEN (chunk_id + query_id) % 4 = 0 THEN 1 ELSE 0 END AS rel FROM k),
g AS (SELECT query_id, sum(rel) AS f, count(*) AS n, min(rank) FILTER (rel = 1) AS first, sum(rel * ln(2) / ln(rank + 1)) AS dcg FROM m GROUP BY 1),
tot AS (SELECT item_id AS query_id, count(*) AS total FROM benchmark, documents WHERE (doc_id + item_id) % 4 = 0 GROUP BY 1)
SELECT query_id, CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END AS hit, round(coalesce(1 / first, 0), 6) AS mrr, round(f / n, 6) AS precision, round(f / total, 6) AS recall,
  round(CASE WHEN f > 0 THEN dcg / list_sum(list_transform(range(1, CAST(f AS INT) + 1), lambda i: ln(2) / ln(i + 1))) ELSE 0 END, 6) AS ndcg FROM g JOIN tot USING (query_id)""", hit="DOUBLE")
def ir_measures_oracle(spark, sf_dir):
    """The measures on a rule for relevance that SQL can repeat."""
    queries, chunks, ranked = _search(spark, sf_dir)
    relevant = ranked.where((F.col("chunk_id") + F.col("query_id")) % 4 == 0).select("query_id", "chunk_id")
    sizes = chunks.groupBy(F.pmod(-F.col("chunk_id"), F.lit(4)).alias("rest")).agg(F.count("*").alias("n_relevant"))
    totals = queries.select("query_id", F.pmod("query_id", F.lit(4)).alias("rest")).join(sizes, "rest").select("query_id", "n_relevant")
    m = retrieval.measures(ranked, relevant, 10, totals)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in retrieval.MEASURES])


@query("pinned_context", f"""
WITH {BM25}, e AS (SELECT min(doc_id) AS a, max(doc_id) AS z FROM documents), k AS (SELECT * FROM r WHERE rank <= 25),
u AS (SELECT DISTINCT query_id, a AS chunk_id, 0 AS pin, 0 AS place FROM k, e UNION ALL SELECT DISTINCT query_id, z, 0, 1 FROM k, e UNION ALL SELECT query_id, chunk_id, 1, rank FROM k),
o AS (SELECT u.*, row_number() OVER (PARTITION BY query_id, text ORDER BY pin, place) AS n FROM u JOIN documents ON chunk_id = doc_id), p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pin, place) AS rank FROM o WHERE n = 1)
SELECT * FROM p WHERE rank <= 15""", rank="INTEGER")
def pinned_context(spark, sf_dir):
    _, chunks, ranked = _search(spark, sf_dir)
    return retrieval.pinned(ranked, chunks, 15)


@query("softmax_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax, round(exp(list_max(embedding) - list_max(embedding)) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 6) AS confidence FROM embeddings")
def softmax_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", N.argmax(F.col("embedding")).alias("argmax"), F.round(F.array_max(N.softmax(F.col("embedding"))), 6).alias("confidence"))


@query("vector_compaction", "SELECT vec_id, [embedding[1], embedding[3], embedding[6]] AS kept, list_transform([0, 1, 2, 3], lambda i: CAST(CASE WHEN i = label % 4 THEN 10 ELSE -10 END AS DOUBLE)) AS one_hot FROM embeddings")
def vector_compaction(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", N.compacted(F.col("embedding"), [0, 2, 5]).alias("kept"), N.one_hot_logits(F.array(F.col("label") % 4), 4).alias("one_hot"))


@query("token_pooling", """
WITH m AS (SELECT vec_id, embedding AS e, CASE WHEN vec_id % 2 = 0 THEN list_transform(range(len(embedding)), lambda i: CASE WHEN i < 1 + vec_id % 5 THEN 1 ELSE 0 END)
  ELSE list_transform(range(len(embedding)), lambda i: CASE WHEN i >= vec_id % 5 THEN 1 ELSE 0 END) END AS m FROM embeddings),
p AS (SELECT vec_id, e, list_filter(range(len(e)), lambda i: m[i + 1] > 0) AS r FROM m)
SELECT vec_id, [e[r[1] + 1], CAST(r[1] AS FLOAT)] AS first, [e[r[-1] + 1], CAST(r[-1] AS FLOAT)] AS last FROM p""")
def token_pooling(spark, sf_dir):
    """First and last real token of sequences padded on the right (even ids) and on the left (odd ids); a token is (value, place)."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id") % 5
    tokens = F.transform("embedding", lambda x, i: F.array(x.cast("float"), i.cast("float")))
    mask = F.transform("embedding", lambda x, i: F.when(F.col("vec_id") % 2 == 0, i < 1 + k).otherwise(i >= k).cast("int"))
    told = e.select("vec_id", tokens.alias("t"), mask.alias("m"))
    return told.select("vec_id", N.pooled(F.col("t"), F.col("m")).alias("first"), N.pooled(F.col("t"), F.col("m"), last=True).alias("last"))


@query("formatted_cells", "SELECT l_returnflag, printf('%.3f [%.3f, %.3f]', avg(l_discount), min(l_discount), max(l_discount)) AS cell, printf('%.1f', sum(l_quantity) / 1000) AS seconds FROM lineitem GROUP BY 1")
def formatted_cells(spark, sf_dir):
    from clausemill.functions.text import interval_cell

    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(interval_cell(F.avg(d), F.min(d), F.max(d)).alias("cell"), N.seconds_text(F.sum("l_quantity")).alias("seconds"))


@query("top_k_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 10", rank="INTEGER")
def top_k_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    return retrieval.top_k(li, 10, "l_returnflag").select("l_returnflag", "l_orderkey", "l_linenumber", "rank")
