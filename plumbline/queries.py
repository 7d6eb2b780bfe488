"""The engine's queries over the test tables, each with the SQL that must give the same rows.

Stand-ins: orders and lineitem serve as scored cases (lineitem with many ties), documents and labels as labelled files,
embeddings as thumbnails, events as the prediction log, part as numeric properties. Doubles are rounded to six digits
where sums depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar
from plumbline.operators import bootstrap, compare, duplicates, errors, evaluation, explain, predlog, profile, splitting
from plumbline.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def orders(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return load(spark, d, "orders").select(F.lit("orders").alias("model_name"), F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y_true"), ((price - F.floor(price / 1000) * 1000) / 1000).alias("y_prob"))


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.lit("lineitem").alias("model_name"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("case_id"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_quantity") / 50).alias("y_prob"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).unionByName(lineitem(spark, d))


def error_rows(spark: SparkSession, d: str) -> DataFrame:
    return errors.error_table(orders(spark, d), 0.5)


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as samples: class from labels, group from the text."""
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("idx"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("class_name"), F.col("quality").alias("label"), F.md5(F.col("text").cast("binary")).alias("group_id"), "n_chars")


ORDERS_SQL = "SELECT 'orders' AS model_name, o_orderkey AS case_id, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS y_true, (o_totalprice - floor(o_totalprice / 1000) * 1000) / 1000 AS y_prob FROM orders"
LINEITEM_SQL = "SELECT 'lineitem' AS model_name, l_orderkey * 8 + l_linenumber AS case_id, CAST(l_returnflag = 'R' AS INTEGER) AS y_true, l_quantity / 50 AS y_prob FROM lineitem"
SCORED_SQL = f"WITH scored AS ({ORDERS_SQL} UNION ALL {LINEITEM_SQL})"
ONE_SQL = f"WITH scored AS ({ORDERS_SQL})"
ERRORS_SQL = f"""{ONE_SQL}, e AS (SELECT *, CASE WHEN p = 1 THEN y_prob ELSE 1 - y_prob END AS confidence, y_true = p AS correct,
  CASE WHEN y_true = p AND y_true = 1 THEN 'true_positive' WHEN y_true = p THEN 'true_negative' WHEN p = 1 THEN 'false_positive' ELSE 'false_negative' END AS category
  FROM (SELECT *, CAST(y_prob >= 0.5e0 AS INTEGER) AS p FROM scored))"""
FILES_SQL = "WITH s AS (SELECT doc_id AS idx, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS class_name, quality AS label, md5(text) AS group_id, n_chars FROM documents JOIN labels USING (doc_id))"
CELLS_SQL = "count(*) FILTER (y_true = 0 AND p = 0) AS tn, count(*) FILTER (y_true = 0 AND p = 1) AS fp, count(*) FILTER (y_true = 1 AND p = 0) AS fn, count(*) FILTER (y_true = 1 AND p = 1) AS tp"


def over(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


RATES_SQL = f"""{over('tp + tn', 'tn + fp + fn + tp')} AS accuracy, ({over('tp', 'tp + fn')} + {over('tn', 'tn + fp')}) / 2 AS balanced_accuracy, {over('tp', 'tp + fn')} AS sensitivity,
  {over('tn', 'tn + fp')} AS specificity, {over('tp', 'tp + fp')} AS "precision", {over('tn', 'tn + fn')} AS npv, {over('2 * tp', '2 * tp + fp + fn')} AS f1, {over('fp', 'fp + tn')} AS false_positive_rate, {over('fn', 'fn + tp')} AS false_negative_rate"""
STEPS_SQL = """c AS (SELECT model_name, y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg FROM scored GROUP BY ALL),
  s AS (SELECT *, sum(pos) OVER w AS pos_ge, sum(neg) OVER w AS neg_ge, sum(pos) OVER (PARTITION BY model_name) AS p, sum(neg) OVER (PARTITION BY model_name) AS n FROM c
    WINDOW w AS (PARTITION BY model_name ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
AREAS_SQL = "a AS (SELECT model_name, CAST(sum(pos * (2 * (n - neg_ge) + neg)) AS DOUBLE) / CAST(2 * max(p) * max(n) AS DOUBLE) AS roc_auc, sum(pos * CAST(pos_ge AS DOUBLE) / CAST(pos_ge + neg_ge AS DOUBLE)) / max(p) AS pr_auc FROM s GROUP BY model_name)"
SWEEP_SQL = f"w AS (SELECT model_name, threshold, {CELLS_SQL} FROM (SELECT *, CAST(y_prob >= threshold AS INTEGER) AS p FROM scored CROSS JOIN (SELECT i * 0.01e0 AS threshold FROM range(101) t(i))) GROUP BY ALL)"


@query(f"{SCORED_SQL} SELECT model_name, {CELLS_SQL} FROM (SELECT *, CAST(y_prob >= 0.5e0 AS INTEGER) AS p FROM scored) GROUP BY model_name")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(scored(spark, d))


@query(f"{SCORED_SQL}, k AS (SELECT model_name, {CELLS_SQL} FROM (SELECT *, CAST(y_prob >= 0.5e0 AS INTEGER) AS p FROM scored) GROUP BY model_name), {STEPS_SQL}, {AREAS_SQL} SELECT model_name, tn, fp, fn, tp, {RATES_SQL}, 0.5e0 AS threshold, roc_auc, round(pr_auc, 6) AS pr_auc FROM k JOIN a USING (model_name)")
def point_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.point_metrics(scored(spark, d)).withColumn("pr_auc", F.round("pr_auc", 6))


@query(f"{SCORED_SQL}, {STEPS_SQL}, {AREAS_SQL} SELECT model_name, roc_auc FROM a")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.areas(scored(spark, d)).select("model_name", "roc_auc")


@query(f"{SCORED_SQL}, {STEPS_SQL}, {AREAS_SQL} SELECT model_name, round(pr_auc, 6) AS pr_auc FROM a")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.areas(scored(spark, d)).select("model_name", "pr_auc"))


@query(f"{SCORED_SQL}, {SWEEP_SQL} SELECT model_name, threshold, tn, fp, fn, tp, {RATES_SQL} FROM w")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.threshold_sweep(scored(spark, d))


def _operating_sql(target: str) -> str:
    return f"""{SCORED_SQL}, {SWEEP_SQL}, r AS (SELECT *, sensitivity >= {target} AS ok FROM (SELECT model_name, threshold, {RATES_SQL} FROM w))
    SELECT model_name, ok AS target_met, threshold, sensitivity, specificity, "precision", f1 FROM r
    QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY ok DESC, CASE WHEN ok THEN threshold END DESC, sensitivity DESC, threshold) = 1"""


@query(_operating_sql("0.95e0"))
def operating_point(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.operating_point(scored(spark, d), 0.95)


@query(_operating_sql("1.1e0"))
def operating_point_unreachable(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.operating_point(scored(spark, d), 1.1)


@query(f"""{SCORED_SQL}, {STEPS_SQL}, b AS (SELECT *, lag(pos_ge) OVER v AS p0, lead(pos_ge) OVER v AS p1, lag(neg_ge) OVER v AS n0, lead(neg_ge) OVER v AS n1 FROM s WINDOW v AS (PARTITION BY model_name ORDER BY y_prob DESC))
SELECT model_name, CAST(neg_ge AS DOUBLE) / n AS fpr, CAST(pos_ge AS DOUBLE) / p AS tpr, y_prob AS threshold FROM b WHERE p0 IS NULL OR p1 IS NULL OR p1 - 2 * pos_ge + p0 <> 0 OR n1 - 2 * neg_ge + n0 <> 0
UNION ALL SELECT DISTINCT model_name, 0e0, 0e0, NULL FROM scored""")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc_curve(scored(spark, d))


@query(f'{SCORED_SQL}, {STEPS_SQL} SELECT model_name, CAST(pos_ge AS DOUBLE) / (pos_ge + neg_ge) AS "precision", CAST(pos_ge AS DOUBLE) / p AS recall, y_prob AS threshold FROM s UNION ALL SELECT DISTINCT model_name, 1e0, 0e0, NULL FROM scored')
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pr_curve(scored(spark, d))


BINS_SQL = """g AS (SELECT i, i * 0.1e0 AS bin_lower, (i + 1) * 0.1e0 AS bin_upper FROM range(10) t(i)), m AS (SELECT DISTINCT model_name FROM scored),
  b AS (SELECT m.model_name, bin_lower, bin_upper, count(y_prob) AS count, avg(y_prob) AS confidence, CAST(sum(y_true) AS DOUBLE) / count(y_prob) AS accuracy FROM g CROSS JOIN m
    LEFT JOIN scored s ON s.model_name = m.model_name AND y_prob <= bin_upper AND (y_prob > bin_lower OR i = 0 AND y_prob = bin_lower) GROUP BY ALL)"""


@query(f"{SCORED_SQL}, {BINS_SQL} SELECT model_name, round(bin_lower, 6) AS bin_lower, round(bin_upper, 6) AS bin_upper, count, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.calibration_bins(scored(spark, d)))


@query(f"{SCORED_SQL}, {BINS_SQL} SELECT model_name, round(sum(count * abs(accuracy - confidence)) / sum(count), 6) AS ece FROM b GROUP BY model_name")
def expected_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.expected_calibration_error(scored(spark, d)))


@query(f"{SCORED_SQL} SELECT model_name, count(*) AS n, count(*) FILTER (y_true = 1) AS positives, count(*) FILTER (y_true <> 1) AS negatives, round(avg(y_true), 6) AS positive_rate FROM scored GROUP BY model_name")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.class_balance(scored(spark, d)))


@query(f"{SCORED_SQL} SELECT model_name, truth, predicted, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY model_name, truth) AS row_rate FROM (SELECT model_name, y_true AS truth, CAST(y_prob >= 0.5e0 AS INTEGER) AS predicted, count(*) AS n FROM scored GROUP BY ALL)")
def confusion_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_rates(scored(spark, d))


@query(f"{ERRORS_SQL} SELECT model_name, case_id, y_true AS true_label, p AS predicted_label, y_prob AS probability_positive, confidence, correct, category FROM e")
def error_table(spark: SparkSession, d: str) -> DataFrame:
    return error_rows(spark, d)


@query(f"{ERRORS_SQL} SELECT 'orders' AS model_name, c AS category, count(category) AS n FROM (VALUES ('true_positive'), ('true_negative'), ('false_positive'), ('false_negative')) v(c) LEFT JOIN e ON category = c GROUP BY c")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    return errors.category_counts(error_rows(spark, d))


@query(f"{ONE_SQL} SELECT CASE WHEN greatest(y_prob, 1 - y_prob) >= 0.9e0 THEN 'high' WHEN greatest(y_prob, 1 - y_prob) >= 0.7e0 THEN 'moderate' ELSE 'low' END AS band, count(*) AS n FROM scored GROUP BY 1")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(scalar.confidence_band(F.col("y_prob")).alias("band")).agg(F.count("*").alias("n"))


@query(f"""{ERRORS_SQL}, h AS (SELECT *, 'most_confident_errors' AS kind, row_number() OVER (ORDER BY confidence DESC, case_id) AS place FROM e WHERE NOT correct
  UNION ALL SELECT *, 'least_confident', row_number() OVER (ORDER BY confidence, case_id) FROM e) SELECT model_name, kind, CAST(place AS INTEGER) AS place, case_id, category, confidence FROM h WHERE place <= 10""")
def hardest_cases(spark: SparkSession, d: str) -> DataFrame:
    return errors.hardest_cases(error_rows(spark, d))


@query(f"{ERRORS_SQL} SELECT case_id, confidence FROM e WHERE category = 'false_negative' ORDER BY case_id LIMIT 10")
def first_false_negatives(spark: SparkSession, d: str) -> DataFrame:
    return errors.first_of_category(error_rows(spark, d), "false_negative").select("case_id", "confidence")


@query(f"{ERRORS_SQL}, k AS (SELECT avg(confidence) FILTER (correct) AS mean_correct, median(confidence) FILTER (correct) AS median_correct, avg(confidence) FILTER (NOT correct) AS mean_incorrect, median(confidence) FILTER (NOT correct) AS median_incorrect FROM e) SELECT 'orders' AS model_name, round(mean_correct, 6) AS mean_correct, round(median_correct, 6) AS median_correct, round(mean_incorrect, 6) AS mean_incorrect, round(median_incorrect, 6) AS median_incorrect, round(mean_correct - mean_incorrect, 6) AS gap FROM k")
def confidence_separation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(errors.confidence_separation(error_rows(spark, d)))


@query(f"{ERRORS_SQL} SELECT 'orders' AS model_name, cutoff, CAST(count(*) FILTER (confidence >= cutoff) AS DOUBLE) / count(*) AS coverage, CAST(count(*) FILTER (confidence >= cutoff AND correct) AS DOUBLE) / nullif(count(*) FILTER (confidence >= cutoff), 0) AS accuracy, count(*) FILTER (confidence >= cutoff) AS n_covered FROM e CROSS JOIN (SELECT 0.5e0 + i * 0.025e0 AS cutoff FROM range(21) t(i)) GROUP BY cutoff")
def abstention_curve(spark: SparkSession, d: str) -> DataFrame:
    return errors.abstention_curve(error_rows(spark, d))


PROPERTIES_SQL = """l AS (UNPIVOT (SELECT CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CASE WHEN p_type LIKE 'STANDARD%' THEN 'a' ELSE 'b' END AS side FROM part) ON p_size, p_retailprice INTO NAME property VALUE value),
  k AS (SELECT property, avg(value) FILTER (side = 'a') AS ma, avg(value) FILTER (side = 'b') AS mb, stddev_samp(value) FILTER (side = 'a') AS sa, stddev_samp(value) FILTER (side = 'b') AS sb, var_samp(value) FILTER (side = 'a') AS va, var_samp(value) FILTER (side = 'b') AS vb, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM l GROUP BY property),
  d AS (SELECT *, (mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM k WHERE na >= 2 AND nb >= 2)"""


@query(f"WITH {PROPERTIES_SQL} SELECT 'parts' AS model_name, property, round(ma, 6) AS mean_correct, round(sa, 6) AS std_correct, round(mb, 6) AS mean_incorrect, round(sb, 6) AS std_incorrect, round(d, 6) AS cohens_d, CASE WHEN abs(d) < 0.2e0 THEN 'negligible' WHEN abs(d) < 0.5e0 THEN 'small' WHEN abs(d) < 0.8e0 THEN 'medium' ELSE 'large' END AS interpretation FROM d")
def property_comparison(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").select(F.lit("parts").alias("model_name"), F.col("p_type").startswith("STANDARD").alias("correct"), F.struct(F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("p_retailprice")).alias("properties"))
    return rounded(errors.property_comparison(parts, ["p_size", "p_retailprice"]))


@query(f"WITH {PROPERTIES_SQL} SELECT property, 'a' AS class_a, 'b' AS class_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS cohens_d, abs(d) >= 0.5e0 AS concern FROM d")
def shortcut_check(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").withColumn("class_name", F.when(F.col("p_type").startswith("STANDARD"), "a").otherwise("b"))
    return rounded(profile.shortcut_check(parts, ["p_size", "p_retailprice"]))


@query(f"{FILES_SQL} SELECT class_name, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM s GROUP BY class_name")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_distribution(files(spark, d))


@query("""SELECT p_brand AS class_name, count(*) AS count, count(*) FILTER (p_name LIKE '%a%') AS with_mask, min(CAST(p_size AS DOUBLE)) AS width_min, max(CAST(p_size AS DOUBLE)) AS width_max, round(avg(p_size), 9) AS width_mean,
  min(CAST(length(p_name) AS DOUBLE)) AS height_min, max(CAST(length(p_name) AS DOUBLE)) AS height_max, round(avg(length(p_name)), 9) AS height_mean, round(avg(p_retailprice), 9) AS intensity_mean, round(stddev_pop(p_retailprice), 9) AS intensity_std, count(DISTINCT (p_size, length(p_name))) AS distinct_sizes FROM part GROUP BY p_brand""")
def class_summary(spark: SparkSession, d: str) -> DataFrame:
    masks = F.when(F.col("p_name").contains("a"), F.array("p_name")).otherwise(F.array().cast("array<string>"))
    return rounded(profile.class_summary(load(spark, d, "part").select(F.col("p_brand").alias("class_name"), F.col("p_size").alias("width"), F.length("p_name").alias("height"), F.col("p_retailprice").alias("mean_intensity"), masks.alias("mask_paths"))), 9)


@query(f"{FILES_SQL}, n AS (SELECT count(*) AS n FROM s GROUP BY class_name) SELECT sum(n) AS total, max(n) AS largest, min(n) AS smallest, round(CAST(max(n) AS DOUBLE) / greatest(1, min(n)), 3) AS imbalance_ratio FROM n")
def class_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return profile.imbalance(files(spark, d))


@query(f"{FILES_SQL} SELECT class_name, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight FROM s GROUP BY class_name")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_weights(files(spark, d))


def _by_remainder(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("idx") % 7 == 0, "test").when(F.col("idx") % 7 == 1, "val").otherwise("train"))


SPLIT_SQL = f"{FILES_SQL}, x AS (SELECT *, CASE WHEN idx % 7 = 0 THEN 'test' WHEN idx % 7 = 1 THEN 'val' ELSE 'train' END AS split FROM s)"


@query(f"{SPLIT_SQL} SELECT split, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share, count(*) FILTER (class_name = 'bad') AS bad, count(*) FILTER (class_name = 'good') AS good, count(DISTINCT group_id) AS n_groups FROM x GROUP BY split")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    r = profile.split_report(_by_remainder(files(spark, d)))
    return r.select("split", "n", "share", *(F.coalesce(F.try_element_at("per_class", F.lit(c)), F.lit(0)).alias(c) for c in ("bad", "good")), "n_groups")


@query(f"{SPLIT_SQL}, c AS (SELECT split, class_name, count(*) AS n FROM x GROUP BY ALL) SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY class_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c")
def split_composition(spark: SparkSession, d: str) -> DataFrame:
    return profile.split_composition(_by_remainder(files(spark, d)))


@query("""WITH v AS (SELECT p_brand AS class_name, CAST(p_size AS DOUBLE) AS v FROM part), e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM v WINDOW w AS (PARTITION BY class_name)),
  b AS (SELECT *, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) * 10 / (hi - lo)), 9) ELSE 0 END AS INTEGER) AS bin FROM e)
SELECT class_name, bin, round(lo + bin * ((hi - lo) / 10), 6) AS bin_lower, round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS bin_upper, count(*) AS n FROM b GROUP BY class_name, bin, lo, hi""")
def intensity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.histogram(load(spark, d, "part"), "p_size", "p_brand", 10))


@query(f"{FILES_SQL} SELECT s.class_name, count(*) AS n, any_value(expected) AS expected, coalesce(count(*) = any_value(expected), true) AS matches FROM s LEFT JOIN (VALUES ('good', 437), ('bad', 210)) v(class_name, expected) ON v.class_name = s.class_name GROUP BY s.class_name")
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.against_expected(files(spark, d), spark.createDataFrame([("good", 437), ("bad", 210)], "class_name string, expected int"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_duplicate_groups(load(spark, d, "documents"), "text", "doc_id")


Z_SQL = """v AS (SELECT vec_id AS idx, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  m AS (SELECT *, list_sum(v) / len(v) AS m FROM v), q AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)) AS s FROM m),
  z AS (SELECT idx, label, list_transform(v, lambda x: CASE WHEN s > 1e-8 THEN (x - m) / s ELSE 0e0 END) AS z FROM q)"""
PAIRS_SQL = f"{Z_SQL}, p AS (SELECT a.idx AS i, b.idx AS j, list_inner_product(a.z, b.z) / 64 AS corr FROM z a JOIN z b ON a.idx < b.idx WHERE list_inner_product(a.z, b.z) / 64 > 0.4e0)"
CLUSTERS_SQL = f"{PAIRS_SQL}, e AS (SELECT i AS u, j AS v FROM p UNION ALL SELECT j, i FROM p), r(idx, root) AS (SELECT idx, idx FROM z UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.idx), c AS (SELECT idx, min(root) AS root FROM r GROUP BY idx)"


@query(f"WITH {PAIRS_SQL} SELECT i, j, round(corr, 6) AS corr FROM p")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(duplicates.correlated_pairs(load(spark, d, "embeddings"), 0.4))


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT idx, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM c")
def near_duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicate_clusters(load(spark, d, "embeddings"), 0.4)


@query(f"""WITH RECURSIVE {CLUSTERS_SQL}, k AS (SELECT root, count(*) AS size FROM c GROUP BY root), b AS (SELECT idx, max(corr) AS best FROM (SELECT i AS idx, corr FROM p UNION ALL SELECT j, corr FROM p) GROUP BY idx),
  x AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1)
SELECT CAST(sum(size) AS BIGINT) AS n_samples, (SELECT count(*) FROM x) AS exact_groups, (SELECT coalesce(sum(n), 0) FROM x) AS exact_files, count(*) AS n_clusters, count(*) FILTER (size > 1) AS multi_member_clusters, max(size) AS largest_cluster,
  (SELECT count(*) FILTER (best > 0.42e0) FROM b) / sum(size) AS near_rate_42, (SELECT count(*) FILTER (best > 0.45e0) FROM b) / sum(size) AS near_rate_45, sum(size) / count(*) AS reduction_factor FROM k""")
def integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    contents = load(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return duplicates.integrity_audit(load(spark, d, "embeddings"), contents, 0.4, thresholds=(0.42, 0.45))


@query(f"WITH {Z_SQL}, b AS (SELECT a.idx, max(list_inner_product(a.z, b.z) / 64) AS best FROM z a JOIN z b ON a.idx <> b.idx AND a.idx % 5 = 0 AND b.idx % 5 <> 0 GROUP BY a.idx) SELECT t AS threshold, CAST(count(*) FILTER (best > t) AS DOUBLE) / count(*) AS leakage FROM b CROSS JOIN (VALUES (0.3e0), (0.35e0), (0.4e0)) v(t) GROUP BY t")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return duplicates.split_leakage(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), (0.3, 0.35, 0.4))


@query(f"{FILES_SQL} SELECT 0 AS shared_groups, count(*) AS in_manifest, count(*) AS in_split, count(DISTINCT idx) AS distinct_in_split, 6 AS class_split_pairs FROM s")
def group_split_invariants(spark: SparkSession, d: str) -> DataFrame:
    s = files(spark, d)
    split = splitting.train_val_test_split(s)
    one = F.lit(1).alias("one")
    shared = splitting.groups_in_two_splits(split).agg(F.count("*").cast("int").alias("shared_groups")).select("*", one)
    pairs = split.select("split", "label").distinct().agg(F.count("*").cast("int").alias("class_split_pairs")).select("*", one)
    return shared.join(splitting.coverage(s, split).select("*", one), "one").join(pairs, "one").drop("one")


@query(f"{FILES_SQL} SELECT split, n FROM (SELECT 'test' AS split, CAST(round(0.2e0 * count(*)) AS BIGINT) AS n FROM s UNION ALL SELECT 'train', count(*) - CAST(round(0.2e0 * count(*)) AS BIGINT) FROM s)")
def naive_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return splitting.naive_split(files(spark, d)).groupBy("split").agg(F.count("*").alias("n"))


@query(f"{FILES_SQL}, g AS (SELECT DISTINCT group_id FROM s) SELECT count(*) AS in_folds, (SELECT count(*) FROM g) AS n_groups, (SELECT count(*) FROM g) AS group_fold_pairs, 5 AS folds FROM s")
def group_kfold_invariants(spark: SparkSession, d: str) -> DataFrame:
    f = splitting.group_folds(files(spark, d), 5)
    return f.agg(F.count("*").alias("in_folds"), F.count_distinct("group_id").alias("n_groups"), F.count_distinct("group_id", "fold").alias("group_fold_pairs"), F.count_distinct("fold").cast("int").alias("folds"))


@query("SELECT doc_id AS idx, 'moved/' || source AS recorded, source AS current FROM documents WHERE doc_id % 100 = 3")
def stale_split_rows(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("path"))
    return splitting.stale_rows(m.withColumn("path", F.when(F.col("idx") % 100 == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))), m)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 10")
def log_latest_page(spark: SparkSession, d: str) -> DataFrame:
    return predlog.page(load(spark, d, "events"), 50, 10, "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id DESC OFFSET 500)")
def log_retention(spark: SparkSession, d: str) -> DataFrame:
    return predlog.retained(load(spark, d, "events").select("event_id", "event_type"), 500, "event_id")


@query("""WITH e AS (SELECT event_type, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS band, value FROM events)
SELECT 'total' AS kind, NULL AS value, count(*) AS n, round(avg(value), 2) AS mean_ms FROM e UNION ALL SELECT 'label', event_type, count(*), NULL FROM e GROUP BY event_type UNION ALL SELECT 'band', band, count(*), NULL FROM e GROUP BY band""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "events").select("event_type", F.when(F.col("value") >= 50, "high").otherwise("low").alias("band"), F.col("value").alias("ms"))
    return predlog.summary(log, "event_type", "band", "ms")


@query("SELECT count(*) AS n, nullif(round(avg(value), 2), 0) AS mean_ms FROM events")
def log_latency(spark: SparkSession, d: str) -> DataFrame:
    return predlog.latency(load(spark, d, "events"), "value")


def _models(spark: SparkSession, d: str) -> DataFrame:
    """One model per priority: its share of high prices, with an interval around it."""
    m = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model_name")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("k"))
    p = F.col("k") / F.col("n")
    return m.select("model_name", p.alias("sensitivity"), (p - 1 / F.sqrt("n")).alias("lower"), (p + 1 / F.sqrt("n")).alias("upper"))


MODELS_SQL = "WITH m AS (SELECT o_orderpriority AS model_name, CAST(count(*) FILTER (o_totalprice > 150000) AS DOUBLE) / count(*) AS sensitivity, CAST(count(*) FILTER (o_totalprice > 150000) AS DOUBLE) / count(*) - 1 / sqrt(count(*)) AS lower, CAST(count(*) FILTER (o_totalprice > 150000) AS DOUBLE) / count(*) + 1 / sqrt(count(*)) AS upper FROM orders GROUP BY 1)"


@query(f"{MODELS_SQL} SELECT model_name, round(sensitivity, 6) AS sensitivity, round(lower, 6) AS lower, round(upper, 6) AS upper, CAST(row_number() OVER (ORDER BY sensitivity DESC, model_name) AS INTEGER) AS place FROM m")
def model_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.leaderboard(_models(spark, d)))


@query(f"{MODELS_SQL}, b AS (SELECT * FROM m ORDER BY sensitivity DESC, model_name LIMIT 1) SELECT b.model_name AS best, m.model_name, m.upper >= b.lower AS overlaps FROM m JOIN b ON m.model_name <> b.model_name")
def ci_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compare.interval_overlap(_models(spark, d))


@query("WITH n AS (SELECT unnest(['n_regionkey', 'n_name', 'first']) AS key) SELECT 'n_name' AS key, count(DISTINCT n_name) AS n_values FROM nation UNION ALL SELECT 'n_regionkey', count(DISTINCT n_regionkey) FROM nation")
def fairness_divergence(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("model_name"), "n_name", "n_regionkey", F.lit(42).alias("seed"))
    return compare.divergent_settings(n, ["n_name", "n_regionkey", "seed"])


@query("SELECT n_name AS model_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)")
def missing_models(spark: SparkSession, d: str) -> DataFrame:
    """A model is evaluated where any supplier names it."""
    nations = load(spark, d, "nation")
    seen = load(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("model_name"))
    return compare.missing_models(nations.select(F.col("n_name").alias("model_name")), seen)


@query("SELECT coalesce(min(n_name) FILTER (n_regionkey <> 0), min(n_name)) AS default_name FROM nation")
def default_model(spark: SparkSession, d: str) -> DataFrame:
    return compare.default_model(load(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("legacy")))


@query("SELECT p_brand AS model_name, p_partkey AS epoch, p_retailprice AS val_loss FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return compare.best_epoch(load(spark, d, "part").select(F.col("p_brand").alias("model_name"), F.col("p_partkey").alias("epoch"), F.col("p_retailprice").alias("val_loss")))


@query("""WITH f AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 7 = 0 THEN page_id || '.EXE' ELSE page_id || '.PNG' END AS name,
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 3 = 0 THEN 'BM' || html ELSE html END AS payload FROM pages)
SELECT page_id, CASE WHEN name = '' THEN 'missing filename' WHEN name LIKE '%.EXE' THEN 'extension not allowed' WHEN payload = '' THEN 'empty file' WHEN strlen(payload) > 5000 THEN 'file too large' WHEN payload NOT LIKE 'BM%' THEN 'not a supported image' END AS error FROM f""")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages")
    i = F.col("page_id")
    name = F.when(i % 11 == 0, "").when(i % 7 == 0, F.concat(i.cast("string"), F.lit(".EXE"))).otherwise(F.concat(i.cast("string"), F.lit(".PNG")))
    payload = F.when(i % 5 == 0, "").when(i % 3 == 0, F.concat(F.lit("BM"), "html")).otherwise(F.col("html")).cast("binary")
    return p.select("page_id", scalar.validation_error(payload, name, 5000).alias("error"))


@query("""WITH f AS (SELECT p_brand AS class_name, 'img' || (p_partkey // 3) AS stem, p_partkey % 3 AS k FROM part)
SELECT class_name || '/' || i.stem || '.png' AS path, CAST((SELECT count(*) FROM f m WHERE m.k > 0 AND m.class_name = i.class_name AND m.stem = i.stem) AS INTEGER) AS n_masks, class_name || '/' || i.stem AS group_id FROM f i WHERE i.k = 0""")
def mask_attach(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.images import manifest

    part = load(spark, d, "part")
    name = F.concat(F.lit("img"), F.floor(F.col("p_partkey") / 3).cast("string"), F.element_at(F.array(F.lit(""), F.lit("_mask"), F.lit("_MASK_2")), (F.col("p_partkey") % 3 + 1).cast("int")))
    listed = part.select(F.concat("p_brand", F.lit("/"), name, F.lit(".png")).alias("path"), F.col("p_brand").alias("class_name"), name.alias("stem"), F.lit(".png").alias("ext"))
    brands = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]  # the class list is a parameter of a scan
    return manifest(listed, brands).select("path", F.size("mask_paths").alias("n_masks"), "group_id")


def mixed_sql(source: str, out: str, value: str) -> str:
    """source with out: the 32-bit mixing function of value, a step a level, as SQL has no variables."""
    one, two = bootstrap.MIX
    steps = (value, "xor(z, z >> 16)", f"(z * {one}) & 4294967295", "xor(z, z >> 15)", f"(z * {two}) & 4294967295", "xor(z, z >> 16)")
    for i, step in enumerate(steps):
        source = f"(SELECT *{' EXCLUDE z' if i else ''}, CAST({step} AS UBIGINT) AS z FROM {source})"
    return f"(SELECT * EXCLUDE z, z AS {out} FROM {source})"


def replicates_sql(scored_sql: str, iterations: int, seed: int = 42) -> str:
    """Draws by hash of (seed, replicate, case number), added up by score; counts, rates and areas of each replicate."""
    first = mixed_sql(f"(SELECT CAST(unnest(range(0, {iterations})) AS UBIGINT) AS r)", "h", f"(r * {bootstrap.STEP} + {seed}) & 4294967295")
    again = mixed_sql("k0", "g", "(h + 1) & 4294967295")
    near = mixed_sql("(SELECT model_name, y_prob, y_true, r, g, h, i FROM c CROSS JOIN k)", "a", "(h + i) & 4294967295")
    far = mixed_sql(near, "u", "(a + g) & 4294967295")  # cases beyond 2**32 add to g, and there are none here
    weight = " + ".join(f"CAST(u >> 16 >= {x} AS INTEGER)" for x in bootstrap.LEVELS)
    return f"""{scored_sql},
c AS (SELECT model_name, y_prob, y_true, CAST(row_number() OVER (PARTITION BY model_name ORDER BY y_prob DESC, y_true DESC) - 1 AS UBIGINT) AS i FROM scored),
k0 AS (SELECT * FROM {first}), k AS (SELECT * FROM {again}),
w AS (SELECT model_name, r, y_prob, sum(w) FILTER (y_true = 1) AS pos, sum(w) FILTER (y_true <> 1) AS neg FROM (SELECT *, {weight} AS w FROM {far}) WHERE w > 0 GROUP BY ALL),
v AS (SELECT model_name, r, y_prob, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM w),
q AS (SELECT *, sum(pos) OVER o AS tps, sum(neg) OVER o AS fps FROM v WINDOW o AS (PARTITION BY model_name, r ORDER BY y_prob DESC)),
t AS (SELECT model_name, CAST(r AS INTEGER) AS replicate, sum(neg) FILTER (y_prob < 0.5e0) AS tn0, sum(neg) FILTER (y_prob >= 0.5e0) AS fp0, sum(pos) FILTER (y_prob < 0.5e0) AS fn0, sum(pos) FILTER (y_prob >= 0.5e0) AS tp0,
  CAST(sum(pos * (2 * fps - neg)) AS DOUBLE) AS lost, sum(pos * CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE)) AS step FROM q GROUP BY model_name, r),
d AS (SELECT model_name, replicate, CAST(coalesce(tn0, 0) AS BIGINT) AS tn, CAST(coalesce(fp0, 0) AS BIGINT) AS fp, CAST(coalesce(fn0, 0) AS BIGINT) AS fn, CAST(coalesce(tp0, 0) AS BIGINT) AS tp, lost, step FROM t),
s AS (SELECT model_name, replicate, tn, fp, fn, tp, {RATES_SQL}, 1 - lost / (2e0 * (tp + fn) * (tn + fp)) AS roc_auc, step / (tp + fn) AS pr_auc FROM d WHERE tp + fn > 0 AND tn + fp > 0)"""


def intervals_sql(scored_sql: str, iterations: int) -> str:
    names = (*evaluation.RATES, *bootstrap.AREAS)
    ends = lambda m: f"list({m} ORDER BY {m})"
    at = lambda share: f"round(v[CAST(floor({share} * (len(v) - 1)) AS BIGINT) + 1] + ({share} * (len(v) - 1) - floor({share} * (len(v) - 1))) * (v[least(len(v), CAST(floor({share} * (len(v) - 1)) AS BIGINT) + 2)] - v[CAST(floor({share} * (len(v) - 1)) AS BIGINT) + 1]), 6)"
    each = " UNION ALL ".join(f"SELECT model_name, '{m}' AS metric, {ends(m)} AS v FROM s GROUP BY model_name" for m in names)
    return f"{replicates_sql(scored_sql, iterations)}, f AS ({each}) SELECT model_name, metric, {at('0.025e0')} AS lower, {at('0.975e0')} AS upper, CAST(len(v) AS BIGINT) AS n FROM f"


@query(replicates_sql(SCORED_SQL, 20) + f" SELECT model_name, replicate, tn, fp, fn, tp, {', '.join(f'round({c}, 6) AS {c}' for c in (*evaluation.RATES, *bootstrap.AREAS))} FROM s")
def bootstrap_replicates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.replicates(scored(spark, d), iterations=20))


@query(intervals_sql(SCORED_SQL, 2000))
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.intervals(scored(spark, d)))


@query(intervals_sql(ONE_SQL, 2000))
def bootstrap_ci_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.intervals(orders(spark, d)))


@query(f"""{MODELS_SQL}, l AS (SELECT model_name, 'sensitivity' AS metric, sensitivity AS value, lower, upper FROM m UNION ALL SELECT model_name, 'upper', upper, NULL, NULL FROM m)
SELECT model_name, metric, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper, round(coalesce(greatest(0, value - lower), 0), 6) AS bar_low, round(coalesce(greatest(0, upper - value), 0), 6) AS bar_high FROM l""")
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    ci = m.select("model_name", F.lit("sensitivity").alias("metric"), "lower", "upper")
    return rounded(compare.comparison_table(m.select("model_name", "sensitivity", "upper"), ci, ["sensitivity", "upper"]))


@query("SELECT n_name AS name, n_regionkey AS region, coalesce(n_regionkey = 0, false) AS legacy FROM nation UNION ALL SELECT 'LEGACY', NULL, true")
def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.artifacts import model_catalog as catalog

    n = load(spark, d, "nation")
    meta = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (F.col("n_regionkey") == 0).alias("legacy"))
    return catalog(n.select(F.col("n_name").alias("name")), meta, "LEGACY")


@query("SELECT n_name AS name, r_regionkey IS NOT NULL AS available, r_name AS document, CASE WHEN r_regionkey IS NULL THEN 'not available; run the evaluation' END AS message FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def results_index(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.artifacts import availability

    n = load(spark, d, "nation")
    made = n.join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("document"))
    return availability(n.select(F.col("n_name").alias("name")), made, "run the evaluation")


@query("WITH u AS (SELECT n_name AS model_name FROM nation WHERE n_nationkey < 15 UNION SELECT n_name FROM nation WHERE n_nationkey > 9) SELECT model_name, CAST(row_number() OVER (ORDER BY model_name) AS INTEGER) AS place FROM u")
def merged_index(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.artifacts import merged_index as merged

    n = load(spark, d, "nation").withColumn("model_name", F.col("n_name"))
    return merged(n.where("n_nationkey < 15"), n.where("n_nationkey > 9"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey < 5 THEN r_name ELSE 'none' END AS test_metrics, CASE WHEN n_nationkey IN (0, 2, 4) THEN n_nationkey / 10e0 ELSE 0.5e0 END AS operating_threshold FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def metadata_write_back(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.artifacts import write_back

    n = load(spark, d, "nation")
    results = n.join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("test_metrics"), (F.col("n_nationkey") % 2 == 0).alias("target_met"), (F.col("n_nationkey") / 10).alias("threshold"))
    return write_back(n.select(F.col("n_name").alias("name"), F.lit("none").alias("test_metrics"), F.lit(0.5).alias("operating_threshold")), results)


@query(f"{ONE_SQL} SELECT case_id, CASE WHEN y_prob >= 0.4e0 THEN 'malignant' ELSE 'benign' END AS label, CASE WHEN y_prob >= 0.4e0 THEN y_prob ELSE 1 - y_prob END AS shown FROM scored")
def label_choice(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    label = scalar.chosen_label(F.array(1 - F.col("y_prob"), F.col("y_prob")), ["benign", "malignant"], "malignant", 0.4)
    return o.select("case_id", label.alias("label"), scalar.shown_probability(F.col("y_prob"), label == "malignant").alias("shown"))


@query("SELECT md5(text) AS digest, doc_id AS key FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_members(load(spark, d, "documents"), "text", "doc_id")


@query(f"WITH {PROPERTIES_SQL} SELECT property, round(d, 6) AS cohens_d FROM d ORDER BY abs(d) DESC, property LIMIT 1")
def top_property(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").select(F.lit("parts").alias("model_name"), F.col("p_type").startswith("STANDARD").alias("correct"), F.struct(F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("p_retailprice")).alias("properties"))
    return rounded(errors.top_properties(errors.property_comparison(parts, ["p_size", "p_retailprice"]), 1).select("property", "cohens_d"))


@query(f"{FILES_SQL} SELECT class_name, idx, group_id FROM s QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || idx), idx) <= 5")
def sample_per_class(spark: SparkSession, d: str) -> DataFrame:
    return profile.sample_per_class(files(spark, d), 5, "idx").select("class_name", "idx", "group_id")


@query(f"{FILES_SQL}, w AS (SELECT class_name, idx, CAST(row_number() OVER (PARTITION BY class_name ORDER BY md5('7:' || idx), idx) - 1 AS INTEGER) AS place FROM s) SELECT class_name, idx, place AS \"column\", CAST(dense_rank() OVER (ORDER BY class_name) - 1 AS INTEGER) AS \"row\" FROM w WHERE place < 4")
def sample_grid(spark: SparkSession, d: str) -> DataFrame:
    return profile.sample_grid(files(spark, d), 4, "idx", 7).select("class_name", "idx", "column", "row")


@query("""WITH p AS (SELECT event_id AS id, event_type AS model, coalesce(user_id % 2 = 0, false) AS legacy, floor(value * 10) % 1000 / 1000 AS p FROM events),
  l AS (SELECT *, CASE WHEN p >= 0.5e0 THEN 'malignant' ELSE 'benign' END AS label, CASE WHEN p >= 0.5e0 THEN p ELSE 1 - p END AS shown, CASE WHEN greatest(p, 1 - p) >= 0.9e0 THEN 'high' WHEN greatest(p, 1 - p) >= 0.7e0 THEN 'moderate' ELSE 'low' END AS band FROM p)
SELECT id, model, CAST(legacy AS VARCHAR) AS legacy, label, round(shown, 4) AS probability, band, 'The model assigns ' || label || ' with a probability of ' || printf('%.1f', shown * 100) || '%.' AS statement,
  CASE band WHEN 'high' THEN 'The probability is far from one half.' WHEN 'moderate' THEN 'The probability is at some distance from one half.' ELSE 'The probability is close to one half; treat the answer as undecided.' END AS note,
  '["Research output, not a diagnosis.","' || CASE WHEN legacy THEN 'A legacy model: its accuracy was measured on a leaking split.' ELSE 'Valid only for images like those of the training set.' END || '"]' AS limitations FROM l""")
def prediction_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of every event, with all that a report says."""
    from plumbline.plans.bundles import prediction_reports as reports

    p = F.floor(F.col("value") * 10) % 1000 / 1000
    legacy = F.coalesce(F.col("user_id") % 2 == 0, F.lit(False))
    log = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_utc"), F.col("event_type").alias("model_name"), legacy.alias("model_legacy"), F.when(p >= 0.5, "malignant").otherwise("benign").alias("predicted_label"), p.alias("probability_positive"))
    said = {"model": "model.name", "legacy": "model.legacy", "label": "prediction.label", "probability": "prediction.probability", "band": "prediction.band", "statement": "statement", "note": "note", "limitations": "limitations"}
    return reports(log).select("id", *(F.get_json_object("report", f"$.{at}").cast("double" if c == "probability" else "string").alias(c) for c, at in said.items()))


CASES_SQL = f"""{ERRORS_SQL}, t AS (SELECT e.model_name, case_id, 'cases/' || o_orderpriority || '/' || case_id || '.png' AS path, o_orderpriority AS class_name, case_id || '.png' AS filename, y_true AS true_label, p AS predicted_label,
  y_prob AS probability_positive, confidence, correct, category FROM e JOIN orders ON o_orderkey = case_id)"""


def case_rows(spark: SparkSession, d: str) -> DataFrame:
    """The error table of orders with their paths, classes and a property."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("cases/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"), F.col("o_orderpriority").alias("class_name"), F.col("o_totalprice").alias("price"))
    return errors.error_table(orders(spark, d).join(o, "case_id"), 0.5, ["price"], carry=["path", "class_name"])


@query(f"{CASES_SQL} SELECT * FROM t")
def error_table_cases(spark: SparkSession, d: str) -> DataFrame:
    return case_rows(spark, d).drop("properties")


@query(f"{CASES_SQL} SELECT *, 0 AS property_fields FROM t")
def error_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The error report as it is written and read again: JSON rows without properties."""
    from plumbline.sources.artifacts import write_reports
    from plumbline.tables import new_path

    rows = case_rows(spark, d)
    folder = write_reports({"errors": rows}, new_path(spark, "report"))[0]
    back = spark.read.text(folder)
    schema = rows.drop("properties").schema
    fields = F.size(F.coalesce(F.from_json(F.get_json_object("value", "$.properties"), "map<string, double>"), F.create_map().cast("map<string, double>")))
    return back.select(F.from_json("value", schema).alias("r"), fields.alias("property_fields")).select("r.*", "property_fields")


@query("SELECT event_type, count(*) AS n, round(1000e0 * sum(value) / greatest(1, count(*)), 6) AS ms FROM events GROUP BY event_type UNION ALL SELECT 'none', 0, 2500e0")
def per_image_latency(spark: SparkSession, d: str) -> DataFrame:
    spent = load(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("seconds"), F.count("*").alias("n"))
    spent = spent.unionByName(spark.createDataFrame([("none", 2.5, 0)], "event_type string, seconds double, n long"))
    return spent.select("event_type", "n", F.round(scalar.per_image_ms(F.col("seconds"), F.col("n")), 6).alias("ms"))


@query("SELECT n_name AS name, n_regionkey = 0 AS legacy, 'standard_224' AS profile FROM nation")
def registry_description(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.artifacts import described

    return described(load(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("legacy"), F.lit("standard_224").alias("profile"), F.to_json(F.struct("n_nationkey")).alias("config")))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN i = p_size % 10 THEN 1 ELSE 0 END), ',') AS hot FROM part WHERE p_size % 10 < 8 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 10 >= 8")
def one_hot_labels(spark: SparkSession, d: str) -> DataFrame:
    hot = scalar.one_hot(F.col("p_size") % 10, 8)
    return load(spark, d, "part").select("p_partkey", F.when(hot.isNotNull(), F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), ",")).alias("hot"))


@query(f"{ONE_SQL} SELECT case_id, 1 - y_prob AS benign, y_prob AS malignant FROM scored")
def class_probability_map(spark: SparkSession, d: str) -> DataFrame:
    both = scalar.class_probabilities(F.array(1 - F.col("y_prob"), F.col("y_prob")), ["benign", "malignant"])
    return orders(spark, d).select("case_id", *(F.element_at(both, c).alias(c) for c in ("benign", "malignant")))


@query(f"{FILES_SQL} SELECT class_name, count(*) AS n, CASE WHEN class_name = 'good' THEN 0.5e0 END AS weight FROM s GROUP BY class_name")
def class_weights_given(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_weights(files(spark, d), mode={"good": 0.5, "other": 2})


@query("""SELECT event_id, '{"at":{"a":' || user_id || ',"b":"' || event_type || '"},"props":' || replace(props, ' ', '') || ',"z":1}' AS document FROM events""")
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    loose = F.format_string('{"z": 1, "props": %s, "at": {"b": "%s", "a": %d}}', "props", "event_type", "user_id")
    return load(spark, d, "events").select("event_id", scalar.canonical_json(loose).alias("document"))


@query("SELECT 'region' AS key, count(DISTINCT n_regionkey) AS n_values FROM nation UNION ALL SELECT 'first', 2")
def divergent_maps(spark: SparkSession, d: str) -> DataFrame:
    """Settings as maps: seed is the same for all, first is known of one model only."""
    n = load(spark, d, "nation")
    settings = F.map_concat(F.create_map(F.lit("seed"), F.lit("42"), F.lit("region"), F.col("n_regionkey").cast("string")), F.when(F.col("n_nationkey") == 0, F.create_map(F.lit("first"), F.lit("yes"))).otherwise(F.create_map().cast("map<string, string>")))
    return compare.divergent_maps(n.select(F.col("n_name").alias("model_name"), settings.alias("settings")))


@query(f"{FILES_SQL} SELECT idx, class_name, CASE WHEN idx % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM s WHERE idx % 7 <> 1")
def split_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a stored split that leaves every seventh out."""
    stored = load(spark, d, "documents").where("doc_id % 7 <> 1").select(F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train").alias("split"))
    return splitting.split_samples(files(spark, d), stored).select("idx", "class_name", "split")


@query("SELECT 'm' AS model_name, doc_id AS case_id, CAST(lang = 'de' AS INTEGER) AS y_true, n_chars / 20000e0 AS y_prob FROM documents JOIN labels USING (doc_id)")
def aligned_cases(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    scores = docs.select(F.lit("m").alias("model_name"), F.col("doc_id").alias("case_id"), (F.col("n_chars") / 20000).alias("y_prob"))
    truth = docs.join(load(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("label"))
    return splitting.aligned(truth, scores, "de")


@query("SELECT n_name AS model_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_nationkey")
def models_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").withColumn("model_name", F.col("n_name"))
    known = n.join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_nationkey")).select("model_name", F.col("r_name").alias("region"))
    return compare.with_metadata(n, known)


@query("SELECT p_brand AS class_name, p_size AS width, length(p_name) AS height, count(*) AS n FROM part WHERE p_size IS NOT NULL AND p_name IS NOT NULL GROUP BY ALL")
def dimension_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.dimensions(load(spark, d, "part").select(F.col("p_brand").alias("class_name"), F.col("p_size").alias("width"), F.length("p_name").alias("height")))


@query("SELECT p_brand AS model_name, p_partkey AS epoch, 'loss' AS metric, CAST(p_retailprice AS DOUBLE) AS train, CAST(p_size AS DOUBLE) AS val FROM part UNION ALL SELECT p_brand, p_partkey, 'auc', NULL, NULL FROM part")
def training_history(spark: SparkSession, d: str) -> DataFrame:
    return profile.training_history(load(spark, d, "part").select(F.col("p_brand").alias("model_name"), F.col("p_partkey").alias("epoch"), F.col("p_retailprice").alias("loss"), F.col("p_size").alias("val_loss")), ["loss", "auc"])


@query("SELECT p_brand AS model_name, 'auc' AS metric, count(*) AS n, min(CAST(p_size AS DOUBLE)) AS low, quantile_cont(CAST(p_size AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS middle, quantile_cont(CAST(p_size AS DOUBLE), 0.75) AS q3, max(CAST(p_size AS DOUBLE)) AS high FROM part GROUP BY p_brand")
def fold_stability(spark: SparkSession, d: str) -> DataFrame:
    return profile.fold_stability(load(spark, d, "part").select(F.col("p_brand").alias("model_name"), F.col("p_partkey").alias("fold"), F.col("p_size").alias("auc")), ["auc"])


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as activations of 4 x 4 cells with 4 channels, and themselves backwards as gradients."""
    v = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.col("label").alias("class_index"), F.lit(4).alias("height"), F.lit(4).alias("width"), v.alias("activations"), F.reverse(v).alias("gradients"))


HEAT_SQL = """WITH w AS (SELECT vec_id, label, embedding AS a, list_transform(range(1, 5), lambda c: list_sum(list_transform(range(0, 16), lambda p: CAST(embedding[64 - (4 * p + c) + 1] AS DOUBLE))) / 16) AS w FROM embeddings),
r AS (SELECT vec_id, label, a, list_transform(range(0, 16), lambda p: greatest(0e0, a[4 * p + 1] * w[1] + a[4 * p + 2] * w[2] + a[4 * p + 3] * w[3] + a[4 * p + 4] * w[4])) AS h FROM w),
h AS (SELECT vec_id, label, a, CASE WHEN list_max(h) > 1e-12 THEN list_transform(h, lambda x: x / list_max(h)) ELSE list_transform(h, lambda x: 0e0) END AS h FROM r)"""


@query(f"{HEAT_SQL} SELECT vec_id AS path, label AS class_index, CAST(unnest(range(0, 16)) AS INTEGER) AS cell, round(unnest(h), 6) AS heat, list_max(h) = 0 AS degenerate FROM h")
def class_heatmaps(spark: SparkSession, d: str) -> DataFrame:
    maps = explain.heatmaps(layers(spark, d))
    return maps.select("path", "class_index", F.posexplode("heatmap").alias("cell", "heat"), "degenerate").withColumn("heat", F.round("heat", 6))


@query(f"""{HEAT_SQL}, m AS (SELECT vec_id, label, h, list_transform(a[1:16], lambda x: x > 0.05e0) AS m, list_sort(h)[13] AS cut FROM h),
b AS (SELECT *, list_transform(h, lambda x: x >= cut AND x > 0) AS hot FROM m),
n AS (SELECT *, len(list_filter(range(1, 17), lambda i: hot[i] AND m[i])) AS inside, len(list_filter(range(1, 17), lambda i: hot[i] OR m[i])) AS joint, len(list_filter(hot, lambda x: x)) AS n_hot FROM b)
SELECT vec_id AS path, label AS class_index, m[list_position(h, list_max(h))] AS pointing_hit, round(CASE WHEN joint > 0 AND n_hot > 0 THEN inside / joint ELSE 0e0 END, 6) AS iou,
  round(len(list_filter(m, lambda x: x)) / 16, 6) AS mask_coverage, n_hot = 0 AS degenerate FROM n""")
def mask_agreements(spark: SparkSession, d: str) -> DataFrame:
    """Two masks an image, united: the even and the odd ones of the cells whose first channels are above 0.05."""
    seen = load(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.slice("embedding", 1, 16).alias("a"), F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"))
    cells = F.transform("a", lambda x, i: F.when((x > 0.05) & (i % 2 == F.col("odd")), "FF").otherwise("00"))
    masks = seen.select("path", F.lit(4).alias("height"), F.lit(4).alias("width"), F.unhex(F.array_join(cells, "")).alias("data"))
    return rounded(explain.agreement(explain.heatmaps(layers(spark, d)), masks))
