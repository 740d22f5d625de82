"""Folds, quality measures and model comparison over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.numbers import rounded
from parlance.operators import evaluation, reports
from parlance.plans.inputs import PREDICTIONS, predictions, r6, table, with_ctes
from parlance.plans.join_queries import FOLD_SCORES, fold_scores
from parlance.plans.registry import query
from parlance.plans.report_queries import _text2


def round_all(df, *columns):
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


@query(
    "h01_encode_labels",
    """SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS label_index FROM part""",
)
def _(spark, sf):
    return evaluation.encode_labels(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


@query(
    "h02_stratified_folds",
    """SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY
    md5(concat_ws('_', '42', event_id)), event_id) - 1) % 5 AS INTEGER) AS fold FROM events""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return evaluation.stratified_folds(events, "event_type", 5, ["event_id"])


@query(
    "h03_plain_folds",
    """SELECT event_id, CAST((row_number() OVER (ORDER BY md5(concat_ws('_', '42', event_id)), event_id) - 1) % 5
    AS INTEGER) AS fold FROM events""",
)
def _(spark, sf):
    return evaluation.plain_folds(table(spark, sf, "events").select("event_id"), 5, ["event_id"])


@query(
    "h04_hold_out",
    """SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('_', '42', event_id)), event_id)
    <= floor((SELECT count(*) FROM events) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM events""",
)
def _(spark, sf):
    return evaluation.hold_out(table(spark, sf, "events").select("event_id"), 0.2, ["event_id"])


@query(
    "h09_class_weights",
    f"""SELECT lang, count(*) AS n, {r6('(SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*))')}
    AS weight FROM documents GROUP BY 1""",
)
def _(spark, sf):
    return round_all(evaluation.class_weights(table(spark, sf, "documents"), "lang"), "weight")


@query(
    "h09_add_class_weights",
    f"""SELECT doc_id, lang, {r6('(count(*) OVER ())::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*) OVER (PARTITION BY lang))')}
    AS weight FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return round_all(evaluation.add_class_weights(docs, "lang"), "weight").select("doc_id", "lang", "weight")


PER_CLASS = """cls AS (SELECT DISTINCT c FROM (SELECT y_true AS c FROM predictions UNION ALL SELECT y_pred FROM predictions)),
  per AS (SELECT c, (SELECT count(*) FROM predictions WHERE y_true = c AND y_pred = c) AS tp,
    (SELECT count(*) FROM predictions WHERE y_true = c) AS support,
    (SELECT count(*) FROM predictions WHERE y_pred = c) AS called FROM cls),
  rep AS (SELECT c, support, CASE WHEN called > 0 THEN tp::DOUBLE / called ELSE 0::DOUBLE END AS precision,
    CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0::DOUBLE END AS recall,
    CASE WHEN support + called > 0 THEN 2 * tp::DOUBLE / (support + called) ELSE 0::DOUBLE END AS f1, tp FROM per)"""


@query(
    "h12_quality",
    with_ctes(
        PREDICTIONS,
        PER_CLASS,
        select=f"""SELECT {r6('sum(tp)::DOUBLE / sum(support)::DOUBLE')} AS accuracy, {r6('avg(f1)')} AS f1_macro,
        {r6('sum(f1 * support) / sum(support)::DOUBLE')} AS f1_weighted FROM rep""",
    ),
)
def _(spark, sf):
    measured = evaluation.quality(predictions(spark, sf), "y_true", "y_pred")
    return round_all(measured, "accuracy", "f1_macro", "f1_weighted")


@query(
    "h13_class_report",
    with_ctes(
        PREDICTIONS,
        PER_CLASS,
        select=f"""SELECT CAST(c AS VARCHAR) AS class, {r6('precision')} AS precision, {r6('recall')} AS recall,
        {r6('f1')} AS f1, support FROM rep UNION ALL
        SELECT 'macro avg', {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM rep
        UNION ALL SELECT 'weighted avg', {r6('sum(precision * support) / sum(support)::DOUBLE')},
        {r6('sum(recall * support) / sum(support)::DOUBLE')}, {r6('sum(f1 * support) / sum(support)::DOUBLE')},
        CAST(sum(support) AS BIGINT) FROM rep""",
    ),
)
def _(spark, sf):
    report = evaluation.full_report(predictions(spark, sf), "y_true", "y_pred")
    return round_all(report, "precision", "recall", "f1")


@query(
    "h14_confusion_matrix",
    with_ctes(
        PREDICTIONS,
        PER_CLASS,
        select="""SELECT a.c AS y_true, b.c AS y_pred, count(p.id) AS n FROM cls a CROSS JOIN cls b LEFT JOIN predictions p
        ON p.y_true = a.c AND p.y_pred = b.c GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    return evaluation.confusion_matrix(predictions(spark, sf), "y_true", "y_pred")


@query(
    "h15_pending_runs",
    """SELECT DISTINCT l_shipmode AS embedding, l_flag AS model FROM (SELECT l_returnflag AS l_flag,
    concat('emb_', l_linenumber) AS l_shipmode, l_quantity FROM lineitem) w WHERE NOT EXISTS (
    SELECT 1 FROM orders o WHERE concat('emb_', substr(o_orderpriority, 1, 1)) = w.l_shipmode AND w.l_flag = 'A')""",
)
def _(spark, sf):
    wanted = table(spark, sf, "lineitem").select(
        F.concat(F.lit("emb_"), "l_linenumber").alias("embedding"), F.col("l_returnflag").alias("model")
    ).distinct()
    log = table(spark, sf, "orders").select(
        F.concat(F.lit("emb_"), F.substring("o_orderpriority", 1, 1)).alias("embedding"), F.lit("A").alias("model")
    )
    return evaluation.pending_runs(wanted, log)


@query(
    "h16_fold_metrics",
    with_ctes(
        FOLD_SCORES,
        select=f"""SELECT model, fold, {r6('accuracy')} AS accuracy, {r6('f1_macro')} AS f1_macro, 0::DOUBLE AS f1_weighted
        FROM fold_scores WHERE model = 'AF_1'""",
    ),
)
def _(spark, sf):
    log = fold_scores(spark, sf).withColumn("f1_weighted", F.lit(None).cast("double"))
    return round_all(evaluation.fold_metrics(log, "AF_1"), "accuracy", "f1_macro")


# Student's t with 4 degrees of freedom in closed form.
T4_SQL = "1::DOUBLE - sin(atan(abs(t) / 2)) * (1 + 0.5::DOUBLE * cos(atan(abs(t) / 2)) * cos(atan(abs(t) / 2)))"


@query(
    "h17_paired_tests",
    with_ctes(
        FOLD_SCORES,
        "s AS (SELECT * FROM fold_scores)",
        """pm AS (SELECT model, count(*) AS n, avg(accuracy) AS mean FROM s GROUP BY 1)""",
        """pairs AS (SELECT a.model AS model_a, b.model AS model_b, a.n AS na, b.n AS nb, a.mean AS mean_a, b.mean AS mean_b
        FROM pm a JOIN pm b ON a.model < b.model)""",
        """d AS (SELECT a.model AS model_a, b.model AS model_b, avg(a.accuracy - b.accuracy) AS md,
        stddev_samp(a.accuracy - b.accuracy) AS sd FROM s a JOIN s b ON a.fold = b.fold AND a.model < b.model GROUP BY 1, 2)""",
        """x AS (SELECT p.*, d.md, d.md / (d.sd / sqrt(5::DOUBLE)) AS t, na = 5 AND nb = 5 AS usable,
        0.05::DOUBLE / (SELECT count(*) FROM pairs) AS alpha FROM pairs p JOIN d USING (model_a, model_b))""",
        select=f"""SELECT model_a, model_b, {r6('mean_a')} AS mean_a, {r6('mean_b')} AS mean_b,
        {r6('CASE WHEN usable THEN md ELSE 9 END')} AS mean_difference, {r6('CASE WHEN usable THEN t ELSE 9 END')} AS t,
        {r6(f'CASE WHEN usable THEN {T4_SQL} ELSE 9 END')} AS p_value, {r6('alpha')} AS alpha,
        CASE WHEN usable THEN {T4_SQL} < alpha ELSE false END AS significant,
        CASE WHEN usable THEN 'none' ELSE 'unequal number of folds' END AS error FROM x""",
    ),
)
def _(spark, sf):
    tests = evaluation.paired_tests(fold_scores(spark, sf), "accuracy", 5)
    tests = tests.fillna(9.0, ["mean_difference", "t", "p_value"]).fillna("none", ["error"]).fillna(False, ["significant"])
    return round_all(tests, "mean_a", "mean_b", "mean_difference", "t", "p_value", "alpha")


@query(
    "h18_model_table",
    with_ctes(
        FOLD_SCORES,
        select=f"""SELECT model, concat({_text2('avg(accuracy) * 100')}, ' (', {_text2('stddev_pop(accuracy) * 100')}, ')')
        AS accuracy, concat({_text2('avg(f1_macro) * 100')}, ' (', {_text2('stddev_pop(f1_macro) * 100')}, ')') AS f1_macro
        FROM fold_scores GROUP BY 1""",
    ),
)
def _(spark, sf):
    return evaluation.model_table(fold_scores(spark, sf), ["accuracy", "f1_macro"])


@query(
    "h22_prediction_counts",
    with_ctes(
        PREDICTIONS,
        select=f"""SELECT y_pred, count(*) AS n, {r6('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM predictions)')} AS percent
        FROM predictions GROUP BY 1""",
    ),
)
def _(spark, sf):
    return round_all(reports.value_shares(predictions(spark, sf), "y_pred"), "percent")
