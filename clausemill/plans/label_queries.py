"""Queries on labels: masked metrics, resampling, splits and fusion, over cells made from the labels table.

The cells stand in for predictions: topic 0 is quality, topic 1 toxicity, topic 2 a mix; masks and predictions
follow arithmetic rules on the ids, which SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import fusion, metrics, resample, scoring, splits
from clausemill.plans import oracle_parts as O
from clausemill.plans.registry import query
from clausemill.session import table

CELLS = """
cells AS (
  SELECT doc_id AS row_id, t AS topic_index,
    CAST(CASE t WHEN 0 THEN quality WHEN 1 THEN toxic ELSE (doc_id + quality) % 2 END AS DOUBLE) AS label,
    CAST(CASE WHEN (doc_id + t) % 5 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS mask,
    CASE WHEN (doc_id * 7 + t * 3) % 4 < 2 THEN 1 ELSE 0 END AS prediction,
    CASE WHEN (doc_id * 5 + t) % 3 = 0 THEN 1 ELSE 0 END AS prediction_b,
    ((doc_id * 7 + t * 3) % 20 - 9.5) / 4 AS logit
  FROM labels, (SELECT unnest([0, 1, 2]) AS t)
), per AS (
  SELECT topic_index, count(*) FILTER (prediction = 1 AND label = 1) AS tp, count(*) FILTER (prediction = 1 AND label = 0) AS fp,
    count(*) FILTER (prediction = 0 AND label = 1) AS fn, count(*) AS observed
  FROM cells WHERE mask = 1 GROUP BY topic_index
), tab AS (
  SELECT topic_index, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, tp + fn AS support, observed FROM per
)
"""


def cells(spark, sf_dir):
    n, t = F.col("doc_id"), F.col("topic_index")
    rows = table(spark, sf_dir, "labels").withColumn("topic_index", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    return rows.select(
        n.alias("row_id"), t,
        F.when(t == 0, F.col("quality")).when(t == 1, F.col("toxic")).otherwise((n + F.col("quality")) % 2).cast("double").alias("label"),
        F.when((n + t) % 5 == 0, 0.0).otherwise(1.0).alias("mask"),
        F.when((n * 7 + t * 3) % 4 < 2, 1).otherwise(0).alias("prediction"),
        F.when((n * 5 + t) % 3 == 0, 1).otherwise(0).alias("prediction_b"),
        (((n * 7 + t * 3) % 20 - 9.5) / 4).alias("logit"),
    )


@query("mask_cell_counts", f"WITH {CELLS} SELECT topic_index, count(*) FILTER (mask = 1 AND label = 1) AS positive, count(*) FILTER (mask = 1 AND label = 0) AS negative, count(*) FILTER (mask = 0) AS unsupervised, round(count(*) FILTER (mask = 1 AND label = 0) / count(*) FILTER (mask = 1 AND label = 1), 9) AS negative_ratio FROM cells GROUP BY topic_index")
def mask_cell_counts(spark, sf_dir):
    return metrics.cell_counts(cells(spark, sf_dir), "topic_index").withColumn("negative_ratio", F.round("negative_ratio", 9))


@query("per_topic_table", f"""
WITH {CELLS}, named AS (SELECT CAST(topic_index AS VARCHAR) AS topic, precision, recall, f1, support, observed FROM tab)
SELECT topic, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support, observed FROM (
  SELECT * FROM named
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT), CAST(sum(observed) AS BIGINT) FROM tab
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT), CAST(sum(observed) AS BIGINT) FROM tab
)""")
def per_topic_table(spark, sf_dir):
    t = metrics.with_average_rows(metrics.per_topic(cells(spark, sf_dir)))
    return t.select("topic", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support", "observed")


@query("masked_topic_f1", f"""
WITH {CELLS} SELECT round(avg(f1), 9) AS topic_macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS topic_micro_f1, round(sum(f1 * support) / sum(support), 9) AS topic_weighted_f1,
  round(sum(tp) / (sum(tp) + sum(fp)), 9) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS micro_recall, CAST(sum(observed) AS BIGINT) AS observed FROM tab""")
def masked_topic_f1(spark, sf_dir):
    s = metrics.topic_summary(metrics.per_topic(cells(spark, sf_dir)))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns[:-1]], "observed")


@query("support_threshold_f1", f"WITH {CELLS} SELECT k AS least_support, round(coalesce(avg(f1) FILTER (support >= k), 0), 9) AS topic_macro_f1 FROM tab, (SELECT unnest([1, 20, 50, 100]) AS k) GROUP BY k")
def support_threshold_f1(spark, sf_dir):
    t = metrics.per_topic(cells(spark, sf_dir)).withColumn("least_support", F.explode(F.array(*map(F.lit, (1, 20, 50, 100)))))
    return t.groupBy("least_support").agg(F.round(F.coalesce(F.avg(F.when(F.col("support") >= F.col("least_support"), F.col("f1"))), F.lit(0.0)), 9).alias("topic_macro_f1"))


@query("subset_accuracy", f"""
WITH {CELLS}, r AS (SELECT row_id, bool_and(prediction = label OR mask = 0) AS ok, count(*) FILTER (mask = 1) AS s, count(*) FILTER (mask = 1 AND prediction = 1) AS p,
  sum(1 / (1 + exp(-logit))) FILTER (mask = 1) AS q FROM cells GROUP BY row_id)
SELECT round(avg(CAST(ok AS DOUBLE)), 9) AS subset_accuracy, round(sum(p) / sum(s), 9) AS positive_rate, round(sum(q) / sum(s), 9) AS mean_probability FROM r""")
def subset_accuracy(spark, sf_dir):
    from clausemill.functions.numeric import sigmoid

    s = metrics.subset_accuracy(cells(spark, sf_dir).withColumn("probability", sigmoid(F.col("logit"))))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query("masked_loss", f"WITH {CELLS} SELECT round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 9) AS loss, count(*) AS cells FROM cells WHERE mask = 1")
def masked_loss(spark, sf_dir):
    return metrics.masked_loss(cells(spark, sf_dir)).withColumn("loss", F.round("loss", 9))


@query("degenerate_guard", f"WITH {CELLS}, o AS (SELECT topic_index, sum(label) AS tp, count(*) - sum(label) AS fp FROM cells WHERE mask = 1 GROUP BY 1) SELECT round(avg(2 * tp / (2 * tp + fp)), 9) AS topic_macro_f1, avg(2 * tp / (2 * tp + fp)) >= 0.95 AS degenerate FROM o")
def degenerate_guard(spark, sf_dir):
    return metrics.degenerate(cells(spark, sf_dir)).withColumn("topic_macro_f1", F.round("topic_macro_f1", 9))


HARM = """
h AS (SELECT l.doc_id, d.source, quality + toxic AS truth, (l.doc_id * 7 + quality) % 3 AS predicted, CASE WHEN l.doc_id % 6 = 0 THEN 0.0 ELSE 1.0 END AS mask FROM labels l JOIN documents d USING (doc_id)),
v AS (SELECT * FROM h WHERE mask = 1)
"""


def harm(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select(n, "source", (F.col("quality") + F.col("toxic")).alias("truth"), ((n * 7 + F.col("quality")) % 3).cast("int").alias("predicted"), F.when(n % 6 == 0, 0.0).otherwise(1.0).alias("mask"))


@query("confusion_matrix", f"WITH {HARM} SELECT truth, predicted, count(*) AS n FROM v GROUP BY truth, predicted", predicted="INTEGER")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(harm(spark, sf_dir))


CLASSES = """
c AS (SELECT unnest([0, 1, 2]) AS k), t AS (
  SELECT k, count(*) FILTER (truth = k AND predicted = k) AS tp, count(*) FILTER (truth <> k AND predicted = k) AS fp, count(*) FILTER (truth = k AND predicted <> k) AS fn FROM v, c GROUP BY k
), f AS (SELECT *, tp + fn AS support, 2 * tp / (2 * tp + fp + fn) AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM t WHERE tp + fp + fn > 0)
"""


@query("harm_metrics", f"""
WITH {HARM}, {CLASSES} SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
  round(avg(recall), 9) AS balanced_accuracy, round(max(support) / sum(support), 9) AS majority_share, CAST(sum(support) AS BIGINT) AS valid_rows FROM f""")
def harm_metrics(spark, sf_dir):
    s = metrics.class_summary(metrics.confusion(harm(spark, sf_dir)))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns[:-1]], "valid_rows")


@query("source_breakdown", f"WITH {HARM} SELECT source, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS valid_rows FROM v GROUP BY source")
def source_breakdown(spark, sf_dir):
    s = metrics.class_summary(metrics.confusion(harm(spark, sf_dir), "source"), "source")
    return s.select("source", F.round("accuracy", 9).alias("accuracy"), "valid_rows")


@query("agreement_rate", f"""
WITH {HARM}, p AS (SELECT truth - 1 AS a, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE predicted - 1 END AS b FROM h)
SELECT count(*) AS rows, count(*) FILTER (b IS NOT NULL) AS valid_rows, round(avg(CASE WHEN a = b THEN 1.0 WHEN b IS NOT NULL THEN 0.0 END), 9) AS agreement, count(*) FILTER (a IS DISTINCT FROM b) AS differ FROM p""")
def agreement_rate(spark, sf_dir):
    h = harm(spark, sf_dir)
    pairs = h.select((F.col("truth") - 1).alias("a"), F.when(F.col("doc_id") % 9 != 0, F.col("predicted") - 1).alias("b"))
    return metrics.agreement(pairs).withColumn("agreement", F.round("agreement", 9))


@query("metric_parity", f"WITH {CELLS} SELECT 0.0 AS largest, 0 AS one_sided, true AS within FROM (SELECT 1)", largest="DOUBLE", one_sided="BIGINT")
def metric_parity(spark, sf_dir):
    t = metrics.per_topic(cells(spark, sf_dir))
    return metrics.parity(t, t, "topic_index", "f1")


@query("mcnemar_counts", f"WITH {CELLS} SELECT count(*) FILTER (prediction = label AND prediction_b <> label) AS b, count(*) FILTER (prediction <> label AND prediction_b = label) AS c FROM cells WHERE mask = 1")
def mcnemar_counts(spark, sf_dir):
    c = cells(spark, sf_dir).where("mask = 1")
    return resample.discordant(c.select((F.col("prediction") == F.col("label")).alias("right_a"), (F.col("prediction_b") == F.col("label")).alias("right_b")))


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    """Seeded hash weights are not portable to SQL; tests check the weights, the point and the spread."""
    return resample.bootstrap_interval(cells(spark, sf_dir))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    c = cells(spark, sf_dir).withColumnRenamed("prediction", "prediction_a")
    return resample.paired_delta(c)


@query("seed_deltas", f"""
WITH {HARM}, s AS (SELECT doc_id % 3 AS seed, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN truth = 1 THEN 1.0 ELSE 0.0 END) AS b FROM v GROUP BY 1), d AS (SELECT a - b AS d FROM s)
SELECT round(avg(d), 9) AS delta, round(avg(d) - 4.303 * stddev_samp(d) / sqrt(count(*)), 9) AS low, round(avg(d) + 4.303 * stddev_samp(d) / sqrt(count(*)), 9) AS high, bool_and(d > 0) AS all_positive, count(*) AS seeds FROM d""")
def seed_deltas(spark, sf_dir):
    v = harm(spark, sf_dir).where("mask = 1").withColumn("seed", F.col("doc_id") % 3)
    share = lambda arm, c: v.groupBy("seed").agg(F.avg(c.cast("double")).alias("value")).withColumn("arm", F.lit(arm))
    out = resample.seed_deltas(share("a", F.col("truth") == F.col("predicted")).unionByName(share("b", F.col("truth") == 1)))
    return out.select(*[F.round(c, 9).alias(c) for c in ("delta", "low", "high")], "all_positive", "seeds")


@query("interval_overlap", """
WITH i AS (SELECT lang AS name, quantile_cont(n_chars, 0.25) AS lo, quantile_cont(n_chars, 0.75) AS hi FROM documents GROUP BY lang)
SELECT a.name AS first, b.name AS second, NOT (a.hi < b.lo OR a.lo > b.hi) AS overlap FROM i a JOIN i b ON a.name < b.name""")
def interval_overlap(spark, sf_dir):
    i = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.percentile("n_chars", F.lit(0.25)).alias("lo"), F.percentile("n_chars", F.lit(0.75)).alias("hi"))
    return resample.overlapping(i)


# ---- splits


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "text", "source", splits.stratum(F.col("lang"), F.col("quality")).alias("stratum"))


LABELLED = """
x AS (SELECT doc_id AS row_id, text, lang || '__harm' || quality AS stratum FROM documents JOIN labels USING (doc_id))"""


@query("split_assignment", f"""
WITH {LABELLED}, n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY stratum) < 5 THEN '__rare__' ELSE stratum END AS k FROM x),
r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY md5('42:' || row_id), row_id) - 0.5) / count(*) OVER (PARTITION BY k) AS place FROM n)
SELECT row_id, CASE WHEN place < 0.1 THEN 'test' WHEN place < 0.2 THEN 'validation' ELSE 'train' END AS split, md5(text) AS text_hash FROM r""")
def split_assignment(spark, sf_dir):
    """Membership follows a seeded hash, which other engines can repeat."""
    s = splits.stratified_split(_labelled(spark, sf_dir), "stratum")
    return splits.assignment(s, "text")


@query("split_sizes", """
WITH k AS (SELECT lang || '__harm' || quality AS stratum FROM documents JOIN labels USING (doc_id)), n AS (SELECT stratum, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT CASE WHEN n < 5 THEN '__rare__' ELSE stratum END AS stratum, sum(n) AS n FROM n GROUP BY 1), r AS (SELECT stratum, n, unnest(range(1, CAST(n AS BIGINT) + 1)) AS i FROM c)
SELECT stratum, count(*) FILTER ((i - 0.5) / n < 0.1) AS test, count(*) FILTER ((i - 0.5) / n >= 0.1 AND (i - 0.5) / n < 0.2) AS validation, count(*) FILTER ((i - 0.5) / n >= 0.2) AS train FROM r GROUP BY stratum""")
def split_sizes(spark, sf_dir):
    d = splits.collapse_rare(_labelled(spark, sf_dir), "stratum", 5)
    s = splits.stratified_split(d, "stratum", least=0)
    return s.groupBy("stratum").agg(*[F.count_if(F.col("split") == x).alias(x) for x in ("test", "validation", "train")])


@query("group_split", """
WITH p AS (SELECT source, CAST('0x' || md5('42:' || source)[1:8] AS BIGINT) / 4294967296 AS place FROM documents)
SELECT source, CASE WHEN place < 0.1 THEN 'test' WHEN place < 0.2 THEN 'validation' ELSE 'train' END AS split, count(*) AS count FROM p GROUP BY 1, 2""")
def group_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.group_split(d, "source").groupBy("source", "split").count()


@query("group_straddle", "SELECT source, 'x' AS first, 'x' AS last FROM documents WHERE false")
def group_straddle(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.straddling(splits.group_split(d, "source"), "source")


_SIDE = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END"


def _sided(spark, sf_dir):
    n = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").withColumn("split", F.when(n == 0, "test").when(n == 1, "validation").otherwise("train"))


@query("leakage_check", f"SELECT text, min({_SIDE}) AS split_a, max({_SIDE}) AS split_b FROM documents GROUP BY text HAVING min({_SIDE}) <> max({_SIDE})")
def leakage_check(spark, sf_dir):
    return splits.leakage(_sided(spark, sf_dir), "text")


@query("leakage_counts", f"""
WITH s AS (SELECT DISTINCT text, {_SIDE} AS split FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(*) AS count FROM s a JOIN s b ON a.text = b.text AND a.split < b.split GROUP BY 1, 2""")
def leakage_counts(spark, sf_dir):
    return splits.overlap_counts(_sided(spark, sf_dir), "text")


@query("source_holdout", f"SELECT doc_id, {_SIDE} AS split FROM documents WHERE CASE WHEN {_SIDE} = 'test' THEN list_contains([source, lang], 'src0') ELSE NOT list_contains([source, lang], 'src0') END")
def source_holdout(spark, sf_dir):
    d = _sided(spark, sf_dir).withColumn("sources", F.array("source", "lang"))
    return splits.hold_out(d, "src0").select("doc_id", "split")


@query("assignment_check", "SELECT 0 AS without_split, 0 AS without_row, 0 AS changed", without_split="BIGINT", without_row="BIGINT", changed="BIGINT")
def assignment_check(spark, sf_dir):
    d = _sided(spark, sf_dir).withColumn("row_id", F.col("doc_id"))
    return splits.check_assignment(d, splits.assignment(d, "text"), "text")


@query("stratified_sample", f"""
WITH {LABELLED}, f AS (SELECT *, md5('42:' || row_id) AS h, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || row_id), row_id) > 1 AS later FROM x) SELECT row_id, stratum FROM f ORDER BY later, h, row_id LIMIT 60""")
def stratified_sample(spark, sf_dir):
    return splits.stratified_sample(_labelled(spark, sf_dir), "stratum", 60).select("row_id", "stratum")


@query("retained_ratio", f"""
WITH {HARM}, s AS (SELECT source, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) FILTER (doc_id % 10 = 0) AS held, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) FILTER (doc_id % 10 <> 0) AS within FROM v GROUP BY source)
SELECT source, round(CASE WHEN within > 0 THEN held / within END, 9) AS retained FROM s""")
def retained_ratio(spark, sf_dir):
    v = harm(spark, sf_dir).where("mask = 1")
    right, held = (F.col("truth") == F.col("predicted")).cast("double"), F.col("doc_id") % 10 == 0
    g = v.groupBy("source").agg(F.avg(F.when(held, right)).alias("h"), F.avg(F.when(~held, right)).alias("w"))
    return g.select("source", F.round(F.try_divide("h", "w"), 9).alias("retained"))


# ---- fusion: documents are clauses, their source group is the source, labels give topics


LONG = r"""
long AS (
  SELECT trim(regexp_replace(d.text, '\s+', ' ', 'g'), ' ') AS text, 's' || d.doc_id % 3 AS source, 't' || k AS topic_id,
    CASE k WHEN 0 THEN l.quality ELSE l.toxic END - (d.doc_id // 7) % 2 AS score, d.text AS raw, d.doc_id AS pos
  FROM documents d JOIN labels l USING (doc_id), (SELECT unnest([0, 1, 2, 3]) AS k) WHERE (d.doc_id + k) % 3 <> 0 AND k < 3
), full_ AS (SELECT DISTINCT source, topic_id FROM long),
m AS (SELECT DISTINCT l.text, f.topic_id FROM long l JOIN full_ f USING (source) WHERE l.source <> 's2' UNION SELECT text, topic_id FROM long WHERE source = 's2'),
sc AS (SELECT text, topic_id, min(score) AS score, count(DISTINCT score) > 1 AS conflict FROM long GROUP BY 1, 2),
cell AS (
  SELECT x.text, t AS topic_index, 't' || t AS topic_id, CAST(CASE WHEN sc.score IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS label, CAST(CASE WHEN m.text IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS mask, sc.score, coalesce(sc.conflict, false) AS conflict
  FROM (SELECT DISTINCT text FROM long) x, (SELECT unnest([0, 1, 2, 3]) AS t) LEFT JOIN sc ON sc.text = x.text AND sc.topic_id = 't' || t LEFT JOIN m ON m.text = x.text AND m.topic_id = 't' || t
)
"""


def long_table(spark, sf_dir):
    from clausemill.functions.text import collapse

    n, k = F.col("doc_id"), F.col("k")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    rows = d.where((n + k) % 3 != 0)
    score = F.when(k == 0, F.col("quality")).otherwise(F.col("toxic")) - (F.floor(n / 7) % 2)
    return rows.select(
        collapse(F.col("text")).alias("text"), F.concat(F.lit("s"), (n % 3).cast("string")).alias("source"), F.concat(F.lit("t"), k.cast("string")).alias("topic_id"),
        score.cast("int").alias("score"), F.col("text").alias("raw"), n.alias("pos"),
    )


def topic_table(spark):
    one = spark.sql("SELECT array(named_struct('id', 't0', 'name', 'Quality'), named_struct('id', 't1', 'name', 'Toxic'), named_struct('id', 't2', 'name', 'Mixed_case'), named_struct('id', 't3', 'name', 'Never used')) AS topics")
    return fusion.taxonomy(one)


def fused(spark, sf_dir):
    long = long_table(spark, sf_dir)
    mask = fusion.masks(long, fusion.coverage(long), ["s2"])
    return long, fusion.cells(long, mask, topic_table(spark))


@query("taxonomy_dimension", "SELECT * FROM (VALUES (0, 't0', 'Quality'), (1, 't1', 'Toxic'), (2, 't2', 'Mixed_case'), (3, 't3', 'Never used')) v(topic_index, topic_id, name)")
def taxonomy_dimension(spark, sf_dir):
    return topic_table(spark)


@query("fused_cells", f"WITH {LONG} SELECT * FROM cell", score="INTEGER")
def fused_cells(spark, sf_dir):
    return fused(spark, sf_dir)[1]


@query("fused_wide", f"""
WITH {LONG}, w AS (
  SELECT text, list(label ORDER BY topic_index) AS labels_presence, list(mask ORDER BY topic_index) AS topic_mask, list(score ORDER BY topic_index) AS scores,
    coalesce(list(topic_id ORDER BY topic_index) FILTER (label = 1), []) AS active_topic_ids, coalesce(list(topic_id ORDER BY topic_index) FILTER (conflict), []) AS conflict_topic_ids, bool_or(conflict) AS has_score_conflict
  FROM cell GROUP BY text
), p AS (SELECT text, list_sort(list(DISTINCT source)) AS sources, min(score) AS harm_score FROM long GROUP BY text)
SELECT w.*, sources, harm_score, harm_score + 1 AS harm_score_class, 1.0 AS harm_mask FROM w JOIN p USING (text)""", scores="INTEGER[]", harm_score="INTEGER", harm_score_class="INTEGER", harm_mask="DOUBLE")
def fused_wide(spark, sf_dir):
    long, cell = fused(spark, sf_dir)
    return fusion.wide_table(cell, long).drop("topic_scores", "native_annotations")


@query("narrow_wide", f"WITH {LONG} SELECT text, list(CASE WHEN conflict THEN NULL ELSE score END ORDER BY topic_index) AS scores FROM cell GROUP BY text", scores="INTEGER[]")
def narrow_wide(spark, sf_dir):
    long, cell = fused(spark, sf_dir)
    return fusion.wide_table(cell, long, "null").select("text", "scores")


@query("fusion_conflicts", f"""
WITH {LONG} SELECT text, topic_id, list_sort(list(DISTINCT score)) AS scores, list_sort(list(DISTINCT source)) AS sources, count(*) AS n_rows, arg_min(raw, [-length(raw), pos]) AS raw
FROM long GROUP BY 1, 2 HAVING count(DISTINCT score) > 1""", scores="INTEGER[]")
def fusion_conflicts(spark, sf_dir):
    return fusion.conflicts(long_table(spark, sf_dir))


@query("conflict_detect", """
SELECT o_custkey, o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS priorities, count(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) > 1""")
def conflict_detect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.groupBy("o_custkey", "o_orderstatus").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"), F.count("*").alias("n_rows"))
    return g.where(F.size("priorities") > 1)


@query("mask_policies", f"""
WITH {LONG}, e AS (SELECT source, topic_id FROM full_ WHERE NOT (source = 's0' AND topic_id = 't1')),
me AS (SELECT DISTINCT l.text, f.topic_id FROM long l JOIN e f USING (source) WHERE l.source <> 's2' UNION SELECT text, topic_id FROM long WHERE source = 's2')
SELECT 'raw' AS policy, topic_id, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'effective', topic_id, count(*) FROM me GROUP BY 2""")
def mask_policies(spark, sf_dir):
    long = long_table(spark, sf_dir)
    never = spark.sql("SELECT 's0' AS source, 't1' AS topic_id")
    count = lambda policy: fusion.masks(long, fusion.coverage(long), ["s2"], policy, never).groupBy("topic_id").agg(F.count("*").alias("n")).select(F.lit(policy).alias("policy"), "topic_id", "n")
    return count("raw").unionByName(count("effective"))


@query("identical_columns", f"""
WITH {LONG}, s AS (SELECT topic_index, list([text, CAST(label AS VARCHAR), CAST(mask AS VARCHAR)] ORDER BY text) AS v FROM cell GROUP BY 1)
SELECT a.topic_index AS first, b.topic_index AS second FROM s a JOIN s b ON a.v = b.v AND a.topic_index < b.topic_index""")
def identical_columns(spark, sf_dir):
    return fusion.identical_columns(fused(spark, sf_dir)[1])


@query("source_composition", f"WITH {LONG} SELECT l.topic_id, l.source, count(DISTINCT l.text) AS n_texts FROM long l JOIN m ON l.text = m.text AND l.topic_id = m.topic_id GROUP BY 1, 2")
def source_composition(spark, sf_dir):
    return fusion.source_composition(*fused(spark, sf_dir))


@query("asserted_mask", f"WITH {LONG} SELECT c.text, c.topic_index, c.label FROM cell c JOIN (SELECT DISTINCT text, topic_id FROM long WHERE source = 's1') o ON c.text = o.text AND c.topic_id = o.topic_id WHERE c.mask = 1")
def asserted_mask(spark, sf_dir):
    return fusion.source_asserted_mask(*fused(spark, sf_dir), "s1").select("text", "topic_index", "label")


@query("mask_coverage", f"WITH {LONG} SELECT l.source, c.topic_id, round(avg(c.mask), 9) AS coverage FROM (SELECT DISTINCT text, source FROM long) l JOIN cell c USING (text) GROUP BY 1, 2")
def mask_coverage(spark, sf_dir):
    long, cell = fused(spark, sf_dir)
    return long.select("text", "source").distinct().join(cell, "text").groupBy("source", "topic_id").agg(F.round(F.avg("mask"), 9).alias("coverage"))


@query("source_combinations", f"WITH {LONG}, s AS (SELECT text, string_agg(DISTINCT source, ' + ' ORDER BY source) AS combination FROM long GROUP BY text) SELECT combination, count(*) AS n FROM s GROUP BY 1")
def source_combinations(spark, sf_dir):
    s = long_table(spark, sf_dir).groupBy("text").agg(F.array_join(F.array_sort(F.collect_set("source")), " + ").alias("combination"))
    return s.groupBy("combination").agg(F.count("*").alias("n"))


@query("supervision_lost", f"""
WITH {LONG}, t AS (SELECT topic_id, count(DISTINCT text) AS total, count(DISTINCT text) FILTER (source = 's0') AS s0 FROM long GROUP BY 1)
SELECT topic_id, s0 AS lost, total - s0 AS remaining, round(s0 / total, 9) AS share FROM t""")
def supervision_lost(spark, sf_dir):
    long = long_table(spark, sf_dir)
    t = long.groupBy("topic_id").agg(F.countDistinct("text").alias("total"), F.countDistinct(F.when(F.col("source") == "s0", F.col("text"))).alias("lost"))
    return t.select("topic_id", "lost", (F.col("total") - F.col("lost")).alias("remaining"), F.round(F.col("lost") / F.col("total"), 9).alias("share"))


@query("label_rules", """
WITH l AS (SELECT source, lang AS native_label, quality, toxic FROM documents JOIN labels USING (doc_id)), o AS (SELECT DISTINCT source, native_label FROM l WHERE toxic = 1)
SELECT source, native_label, 'toxic' AS topic_id, 'override' AS rule_kind FROM o
UNION ALL SELECT DISTINCT source, native_label, 'quality' || quality, 'default' FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source = l.source AND o.native_label = l.native_label)""")
def label_rules(spark, sf_dir):
    """Rules from the labelled documents: a topic for each quality of a source and language, overridden where toxic documents are."""
    told = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("native_label", F.col("lang"))
    defaults = told.select("source", "native_label", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("topic_id")).distinct()
    overrides = told.where("toxic = 1").select("source", "native_label", F.lit("toxic").alias("topic_id")).distinct()
    return fusion.label_rules(defaults, overrides)


def _parsed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"), F.col("lang").alias("native_label"), F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("source"), F.when(F.col("doc_id") % 7 != 0, F.lit(1)).alias("score"))
    rules = spark.sql("SELECT * FROM VALUES ('s0', 'en', 't0'), ('s0', 'fr', 't0'), ('s0', 'fr', 't1'), ('s1', 'en', 't2') AS t(source, native_label, topic_id)")
    return fusion.mapped_annotations(rows, rules)


@query("parse_diagnostics", """
SELECT CASE WHEN doc_id % 11 = 0 OR trim(text) = '' THEN 'empty_text' WHEN doc_id % 7 = 0 THEN 'unknown_class' ELSE 'unmapped_topic' END AS parse_status, count(*) AS n FROM documents
WHERE doc_id % 11 = 0 OR trim(text) = '' OR doc_id % 7 = 0 OR NOT (doc_id % 2 = 0 AND lang IN ('en', 'fr') OR doc_id % 2 = 1 AND lang = 'en') GROUP BY 1""")
def parse_diagnostics(spark, sf_dir):
    bad = _parsed(spark, sf_dir)[1].dropDuplicates(["doc_id"])
    return bad.groupBy("parse_status").agg(F.count("*").alias("n"))


@query("mapped_annotations", """
SELECT doc_id, r.topic_id FROM documents d JOIN (VALUES (0, 'en', 't0'), (0, 'fr', 't0'), (0, 'fr', 't1'), (1, 'en', 't2')) r(p, l, topic_id) ON doc_id % 2 = r.p AND lang = r.l
WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND trim(text) <> ''""")
def mapped_annotations(spark, sf_dir):
    return _parsed(spark, sf_dir)[0].select("doc_id", "topic_id")


# ---- scorer runs


_DRAWN = O.DRAW.format("hash", "text")


@query("scored_run", f"""
WITH n AS (SELECT item_id, text, {_DRAWN} AS n FROM benchmark), a AS (SELECT *, n % 9 <> 0 AS ok FROM n)
SELECT item_id AS row_id, CASE WHEN ok THEN '{{"score": ' || (n % 3 - 1) || ', "title": "t' || n % 7 || '", "description": ' || to_json(substr(text, 1, 20)) || '}}' ELSE 'no answer' END AS raw,
  CASE WHEN ok THEN CAST(n % 3 - 1 AS INTEGER) END AS score, ok AS parse_ok, ok AND trim(substr(text, 1, 20)) <> '' AS complete FROM a""")
def scored_run(spark, sf_dir):
    """The deterministic scorer over all benchmark items, answers parsed."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    return scoring.parsed(scoring.scored(rows, scoring.HashScorer(fail_every=9))).select("row_id", "raw", "score", "parse_ok", "complete")


@query("keep_last_attempt", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def keep_last_attempt(spark, sf_dir):
    return scoring.last_attempts(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "value")


@query("resume_remaining", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_remaining(spark, sf_dir):
    log = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("parse_ok"))
    return scoring.remaining(table(spark, sf_dir, "documents").select("doc_id"), log, "doc_id")


@query("batch_assign", "SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 20 AS batch FROM events")
def batch_assign(spark, sf_dir):
    return scoring.batches(table(spark, sf_dir, "events"), 20, "event_type", "event_id").select("event_id", "event_type", "batch")


@query("batch_prompts", """
WITH b AS (SELECT item_id, text, item_id % 3 AS g, (row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) - 1) // 5 AS batch FROM benchmark) SELECT g, batch, count(*) AS n_rows, min(item_id) AS first_id FROM b GROUP BY 1, 2""")
def batch_prompts(spark, sf_dir):
    b = scoring.batches(table(spark, sf_dir, "benchmark").withColumn("g", F.col("item_id") % 3), 5, "g", "item_id")
    p = scoring.prompts(b, "g", "item_id")
    return p.select("g", "batch", "n_rows", F.get_json_object("prompt", "$[0].id").cast("long").alias("first_id"))


@query("best_run", "SELECT o_orderstatus, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice")
    return scoring.best_run(o, "o_orderstatus", "o_orderpriority", value="o_totalprice", run="o_orderkey")


@query("run_matrix", """
WITH e AS (SELECT DISTINCT lang AS encoder FROM documents), s AS (SELECT DISTINCT CAST(quality AS INT) AS seed FROM labels)
SELECT encoder, seed, 'dual' AS heads, encoder || '__seed' || seed || '__dual' AS run_id FROM e, s
UNION ALL SELECT encoder, seed, 'risk', encoder || '__seed' || seed || '__risk' FROM (SELECT min(encoder) AS encoder FROM e), s""")
def run_matrix(spark, sf_dir):
    """A run for each language and quality of the tables, and an ablation of the first language."""
    one = lambda df: [r[0] for r in df.distinct().orderBy(df.columns[0]).collect()]  # the axes of an experiment, a few values each
    encoders = one(table(spark, sf_dir, "documents").select("lang"))
    return scoring.run_matrix(spark, encoders, one(table(spark, sf_dir, "labels").select("quality")), ["dual"], (encoders[0], "risk"))


@query("rubric_text", "WITH d AS (SELECT DISTINCT lang, doc_id % 3 - 1 AS score, 'level ' || doc_id % 3 AS description FROM documents) SELECT lang, string_agg(score || ': ' || description, chr(10) ORDER BY score) AS rubric FROM d GROUP BY lang")
def rubric_text(spark, sf_dir):
    n = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select("lang", (n - 1).alias("score"), F.concat(F.lit("level "), n.cast("string")).alias("description")).distinct()
    return scoring.rubric_text(d, "lang")


@query("resolved_labels", "SELECT doc_id AS row_id, [0, 2] AS topics FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, [1] FROM documents WHERE doc_id % 2 = 1")
def resolved_labels(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.when(even, F.array(F.lit("t0"), F.lit("MIXED  case"))).otherwise(F.array(F.lit(" toxic"), F.lit("nonsense"))).alias("labels"))
    return scoring.resolved_labels(p, topic_table(spark))[0]
