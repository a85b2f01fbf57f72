"""Hypothesis tests and classifier metrics on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episcope.functions.expr import flag
from episcope.operators import hypothesis, metrics
from workbook.panels import rounded
from workbook.registry import query, table
from workbook.tables import SCORED, scored_lines



@query("welch_t", " UNION ALL ".join(f"""SELECT '{c}' AS variable, n_a, n_b, round(mean_a, 4) AS mean_a,
  round(mean_b, 4) AS mean_b, round((mean_a - mean_b) / sqrt(va + vb), 6) AS t,
  round((va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)), 2) AS dof FROM (
    SELECT count(*) FILTER (WHERE l_linestatus = 'F') AS n_a, count(*) FILTER (WHERE l_linestatus = 'O') AS n_b,
      avg({c}) FILTER (WHERE l_linestatus = 'F') AS mean_a, avg({c}) FILTER (WHERE l_linestatus = 'O') AS mean_b,
      var_samp({c}) FILTER (WHERE l_linestatus = 'F') / count(*) FILTER (WHERE l_linestatus = 'F') AS va,
      var_samp({c}) FILTER (WHERE l_linestatus = 'O') / count(*) FILTER (WHERE l_linestatus = 'O') AS vb
    FROM lineitem)""" for c in ("l_quantity", "l_extendedprice")))
def welch_t(spark, sf):
    out = hypothesis.welch_t(table(spark, sf, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice"], "F", "O")
    return out.select("variable", "n_a", "n_b", F.round("mean_a", 4).alias("mean_a"),
                      F.round("mean_b", 4).alias("mean_b"), F.round("t", 6).alias("t"), F.round("dof", 2).alias("dof"))


@query("welch_t_p_values")
def welch_t_p_values(spark, sf):
    return hypothesis.welch_t(table(spark, sf, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice"], "F", "O")


@query("mann_whitney", """WITH r AS (
  SELECT l_linestatus AS g, rank() OVER (ORDER BY l_extendedprice)
    + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS midrank FROM lineitem),
t AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_extendedprice)),
s AS (SELECT CAST(count(*) FILTER (WHERE g = 'F') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE g = 'O') AS DOUBLE) AS b,
  CAST(sum(midrank) FILTER (WHERE g = 'F') AS DOUBLE) AS rank_sum FROM r),
u AS (SELECT a, b, rank_sum - a * (a + 1) / 2 AS u,
  sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))) AS spread FROM s, t)
SELECT CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b, u,
  round((greatest(u, a * b - u) - a * b / 2 - 0.5) / spread, 6) AS z FROM u""")
def mann_whitney(spark, sf):
    return hypothesis.mann_whitney(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice", "F", "O").select(
        "n_a", "n_b", "u", F.round("z", 6).alias("z"))


@query("mann_whitney_p_values")
def mann_whitney_p_values(spark, sf):
    return hypothesis.mann_whitney(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice", "F", "O")


@query("cohens_d", """WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS mu,
  var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
p AS (SELECT x.g || ' vs ' || y.g AS comparison, x.mu AS mean_a, y.mu AS mean_b,
  (y.mu - x.mu) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) AS d
  FROM m x JOIN m y ON x.g < y.g)
SELECT comparison, round(mean_a, 3) AS mean_a, round(mean_b, 3) AS mean_b, round(d, 6) AS cohens_d,
  CASE WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM p""")
def cohens_d(spark, sf):
    out = hypothesis.cohens_d(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice",
                              [("A", "N"), ("A", "R"), ("N", "R")])
    return out.select("comparison", F.round("mean_a", 3).alias("mean_a"), F.round("mean_b", 3).alias("mean_b"),
                      F.round("cohens_d", 6).alias("cohens_d"), "magnitude")


CHI2 = """WITH cells AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS rt FROM cells GROUP BY 1), c AS (SELECT b, sum(o) AS ct FROM cells GROUP BY 1),
n AS (SELECT CAST(sum(o) AS DOUBLE) AS n FROM cells),
f AS (SELECT coalesce(o, 0) AS o, rt * ct / n AS e, n FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN cells USING (a, b)),
s AS (SELECT sum({term}) AS chi2, any_value(n) AS n FROM f)
SELECT round(chi2, 5) AS chi2, (SELECT count(*) FROM r) * (SELECT count(*) FROM c) - (SELECT count(*) FROM r)
    - (SELECT count(*) FROM c) + 1 AS dof, CAST(n AS BIGINT) AS n,
  round(sqrt(chi2 / (n * (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1))), 7) AS cramers_v FROM s"""


@query("chi2_test", CHI2.format(a="l_returnflag", b="l_linenumber", t="lineitem", term="(o - e) * (o - e) / e"))
def chi2_test(spark, sf):
    out = hypothesis.chi2_test(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber")
    return out.select(F.round("chi2", 5).alias("chi2"), "dof", "n", F.round("cramers_v", 7).alias("cramers_v"))


@query("chi2_two_by_two", CHI2.format(a="l_returnflag = 'R'", b="l_linestatus", t="lineitem",
                                      term="power(abs(o - e) - least(0.5, abs(o - e)), 2) / e"))
def chi2_two_by_two(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    out = hypothesis.chi2_test(li, "returned", "l_linestatus")
    return out.select(F.round("chi2", 5).alias("chi2"), "dof", "n", F.round("cramers_v", 7).alias("cramers_v"))


@query("feature_report", " UNION ALL ".join(f"""SELECT '{c}' AS variable, n_a, n_b, round(mean_a, 4) AS mean_a,
  round(mean_b, 4) AS mean_b, round(sqrt(v_a), 4) AS sd_a, round(sqrt(v_b), 4) AS sd_b, round(median_a, 4) AS median_a,
  round(q1_a, 4) AS q1_a, round(q3_b, 4) AS q3_b,
  round((mean_a - mean_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) AS cohens_d FROM (
    SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS n_a, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_b,
      avg({c}) FILTER (WHERE l_returnflag = 'R') AS mean_a, avg({c}) FILTER (WHERE l_returnflag <> 'R') AS mean_b,
      var_samp({c}) FILTER (WHERE l_returnflag = 'R') AS v_a, var_samp({c}) FILTER (WHERE l_returnflag <> 'R') AS v_b,
      quantile_cont({c}, 0.5) FILTER (WHERE l_returnflag = 'R') AS median_a,
      quantile_cont({c}, 0.25) FILTER (WHERE l_returnflag = 'R') AS q1_a,
      quantile_cont({c}, 0.75) FILTER (WHERE l_returnflag <> 'R') AS q3_b FROM lineitem)"""
                                            for c in ("l_quantity", "l_extendedprice")))
def feature_report(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", flag(F.col("l_returnflag") == "R"))
    out = hypothesis.feature_report(li, "y", ["l_quantity", "l_extendedprice"])
    four = ("mean_a", "mean_b", "sd_a", "sd_b", "median_a", "q1_a", "q3_b")
    return out.select("variable", "n_a", "n_b", *[F.round(c, 4).alias(c) for c in four],
                      F.round("cohens_d", 6).alias("cohens_d"))


CATEGORIES = {"l_linestatus": "l_linestatus", "l_linenumber": "CASE WHEN l_linenumber <> 3 THEN l_linenumber END",
              "large": "l_quantity > 25", "same": "'x'"}
CELLS = "WITH cells AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, CAST({sql} AS VARCHAR) AS category, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
    "count(*) AS n FROM lineitem GROUP BY 2, 3" for name, sql in CATEGORIES.items()) + "),\nok AS (SELECT * FROM cells WHERE category IS NOT NULL)"


def _category_cells(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(flag(F.col("l_returnflag") == "R").alias("y"), *[F.expr(sql).alias(c) for c, sql in CATEGORIES.items()])
    return hypothesis.contingency_cells(df, "y", list(CATEGORIES))


@query("categorical_report", CELLS + """,
r AS (SELECT feature, category, sum(n) AS rt FROM ok GROUP BY 1, 2), c AS (SELECT feature, y, sum(n) AS ct FROM ok GROUP BY 1, 2),
k AS (SELECT feature, count(*) AS kr, CAST(sum(rt) AS DOUBLE) AS total FROM r GROUP BY 1), q AS (SELECT feature, count(*) AS kc FROM c GROUP BY 1),
f AS (SELECT feature, coalesce(n, 0) AS o, rt * ct / total AS e, kr, kc, total FROM r JOIN c USING (feature) JOIN k USING (feature)
  JOIN q USING (feature) LEFT JOIN ok USING (feature, category, y)),
s AS (SELECT feature, sum(CASE WHEN kr = 2 AND kc = 2 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e
    WHEN kr = 1 OR kc = 1 THEN 0 ELSE (o - e) * (o - e) / e END) AS chi2,
  (any_value(kr) - 1) * (any_value(kc) - 1) AS dof, least(any_value(kr), any_value(kc)) - 1 AS smaller, any_value(total) AS total FROM f GROUP BY 1),
m AS (SELECT feature, count(DISTINCT category) AS n_categories, CAST(coalesce(sum(n) FILTER (WHERE category IS NULL), 0) AS BIGINT) AS missing_count,
  sum(n) AS n FROM cells GROUP BY 1),
v AS (SELECT *, CASE WHEN smaller > 0 THEN sqrt(chi2 / (total * smaller)) END AS v FROM m JOIN s USING (feature))
SELECT feature, n_categories, missing_count, round(missing_count * 100e0 / n, 6) AS missing_pct, round(chi2, 5) AS chi2, dof,
  round(v, 7) AS cramers_v, CASE WHEN v < 0.1 THEN 'Small' WHEN v < 0.3 THEN 'Medium' WHEN v >= 0.3 THEN 'Large' END AS effect_size FROM v""")
def categorical_report(spark, sf):
    out = hypothesis.association(_category_cells(spark, sf))
    return out.select("feature", "n_categories", "missing_count", F.round("missing_pct", 6).alias("missing_pct"),
                      F.round("chi2", 5).alias("chi2"), "dof", F.round("cramers_v", 7).alias("cramers_v"), "effect_size")


@query("category_shares", CELLS + """
SELECT feature, category, CAST(sum(n) AS BIGINT) AS n, round(sum(n) FILTER (WHERE y = 0) * 100e0 / sum(n), 6) AS neg_pct,
  round(coalesce(sum(n) FILTER (WHERE y = 1), 0) * 100e0 / sum(n), 6) AS pos_pct FROM ok GROUP BY 1, 2""")
def category_shares(spark, sf):
    return rounded(hypothesis.category_shares(_category_cells(spark, sf)), 6)


CONFUSION = f"""WITH {SCORED},
k AS (
  SELECT l_linestatus, CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS DOUBLE) AS tn,
    CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS DOUBLE) AS fn,
    avg(power(label - score, 2)) AS brier, avg(-(label * ln(least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) + (1 - label) * ln(1 - least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) AS ll FROM scored GROUP BY 1),
r AS (SELECT l_linestatus, label, score, rank() OVER (PARTITION BY l_linestatus ORDER BY score)
    + (count(*) OVER (PARTITION BY l_linestatus, score) - 1) / 2e0 AS midrank FROM scored),
a AS (SELECT l_linestatus, sum(midrank) FILTER (WHERE label = 1) AS rs, CAST(sum(label) AS DOUBLE) AS p,
    CAST(count(*) - sum(label) AS DOUBLE) AS q FROM r GROUP BY 1),
v AS (SELECT l_linestatus, score, CAST(sum(label) AS DOUBLE) AS np, CAST(count(*) AS DOUBLE) AS n
  FROM scored GROUP BY 1, 2),
cv AS (SELECT *, sum(np) OVER w AS cp, sum(n) OVER w AS cn FROM v
  WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC)),
ap AS (SELECT l_linestatus, sum(np * cp / cn) / sum(np) AS ap FROM cv GROUP BY 1)"""


@query("binary_metrics", CONFUSION + """
SELECT l_linestatus, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
  CAST(fn AS BIGINT) AS fn, round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision,
  round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1_score,
  round(5 * tp / (5 * tp + 4 * fn + fp), 8) AS f2_score, round(1.25e0 * tp / (1.25e0 * tp + 0.25e0 * fn + fp), 8) AS f05_score,
  round(tn / (tn + fp), 8) AS specificity, round(tn / (tn + fn), 8) AS npv,
  round((tp / (tp + fn)) / (fp / (fp + tn)), 8) AS lr_positive, round((fn / (tp + fn)) / (tn / (fp + tn)), 8) AS lr_negative,
  round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 8) AS matthews_corrcoef,
  round(((tp + tn) / (tp + fp + tn + fn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / power(tp + fp + tn + fn, 2))
    / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / power(tp + fp + tn + fn, 2)), 8) AS cohens_kappa,
  round(brier, 8) AS brier_score, round(ll, 8) AS log_loss, round((rs - p * (p + 1) / 2) / (p * q), 8) AS roc_auc,
  round(ap, 8) AS pr_auc
FROM k JOIN a USING (l_linestatus) JOIN ap USING (l_linestatus)""")
def binary_metrics(spark, sf):
    out = metrics.binary_metrics(scored_lines(spark, sf), "label", "pred", "score", ["l_linestatus"])
    names = ("accuracy", "precision", "recall", "f1_score", "f2_score", "f05_score", "specificity", "npv", "lr_positive",
             "lr_negative", "matthews_corrcoef", "cohens_kappa", "brier_score", "log_loss", "roc_auc", "pr_auc")
    return out.select("l_linestatus", "tp", "fp", "tn", "fn", *[F.round(n, 8).alias(n) for n in names])


@query("auc", CONFUSION + """
SELECT round((rs - p * (p + 1) / 2) / (p * q), 8) AS roc_auc, round(ap, 8) AS pr_auc, l_linestatus
FROM a JOIN ap USING (l_linestatus)""")
def auc(spark, sf):
    return rounded(metrics.auc(scored_lines(spark, sf), "label", "score", ["l_linestatus"]), 8)


@query("roc_points", CONFUSION + """
SELECT l_linestatus, score AS threshold, round(cp / p, 8) AS tpr, round((cn - cp) / q, 8) AS fpr
FROM cv JOIN a USING (l_linestatus)""")
def roc_points(spark, sf):
    return rounded(metrics.roc_points(scored_lines(spark, sf), "label", "score", ["l_linestatus"]), 8)


@query("pr_points", CONFUSION + """
SELECT score AS threshold, round(cp / cn, 8) AS precision, round(cp / (SELECT sum(p) FROM a), 8) AS recall FROM (
  SELECT score, sum(sum(np)) OVER (ORDER BY score DESC) AS cp, sum(sum(n)) OVER (ORDER BY score DESC) AS cn
  FROM v GROUP BY score)""")
def pr_points(spark, sf):
    return rounded(metrics.pr_points(scored_lines(spark, sf), "label", "score"), 8)


@query("roc_curve", CONFUSION + """
SELECT l_linestatus, score AS threshold, round(cp / p, 8) AS tpr, round((cn - cp) / q, 8) AS fpr
FROM cv JOIN a USING (l_linestatus) UNION ALL SELECT l_linestatus, NULL, 0e0, 0e0 FROM a""")
def roc_curve(spark, sf):
    keys = ["l_linestatus"]
    points = metrics.roc_points(scored_lines(spark, sf), "label", "score", keys)
    return rounded(metrics.with_start(points, keys, tpr=0, fpr=0), 8)


@query("pr_curve", CONFUSION + """
SELECT score AS threshold, round(cp / cn, 8) AS precision, round(cp / (SELECT sum(p) FROM a), 8) AS recall FROM (
  SELECT score, sum(sum(np)) OVER (ORDER BY score DESC) AS cp, sum(sum(n)) OVER (ORDER BY score DESC) AS cn
  FROM v GROUP BY score) UNION ALL SELECT NULL, 1e0, 0e0""")
def pr_curve(spark, sf):
    return rounded(metrics.with_start(metrics.pr_points(scored_lines(spark, sf), "label", "score"), precision=1, recall=0), 8)


@query("calibration", f"""WITH {SCORED}
SELECT CAST(greatest(ceil(score * 10) - 1, 0) AS BIGINT) AS bin, count(*) AS n, round(avg(label), 8) AS observed,
  round(avg(score), 8) AS predicted FROM scored GROUP BY 1""")
def calibration(spark, sf):
    return rounded(metrics.calibration(scored_lines(spark, sf), "label", "score"), 8)


@query("calibration_error", f"""WITH {SCORED},
b AS (SELECT l_linestatus, greatest(ceil(score * 10) - 1, 0) AS bin, avg(label) AS o, avg(score) AS p
  FROM scored GROUP BY 1, 2)
SELECT l_linestatus, round(avg(abs(o - p)), 8) AS calibration_error FROM b GROUP BY 1""")
def calibration_error(spark, sf):
    bins = metrics.calibration(scored_lines(spark, sf), "label", "score", keys=["l_linestatus"])
    return rounded(metrics.calibration_error(bins, ["l_linestatus"]), 8)


SWEEP = f"""WITH {SCORED},
t AS (SELECT round(0.05e0 + i * 0.01e0, 12) AS threshold FROM range(76) AS r(i)),
k AS (SELECT threshold, CAST(count(*) FILTER (WHERE label = 1 AND score >= threshold) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (WHERE label = 0 AND score >= threshold) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE label = 0 AND score < threshold) AS DOUBLE) AS tn,
    CAST(count(*) FILTER (WHERE label = 1 AND score < threshold) AS DOUBLE) AS fn FROM scored, t GROUP BY 1),
m AS (SELECT *, tp + fp + tn + fn AS n, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, tp / (tp + fn) AS recall,
    tn / (tn + fp) AS specificity, 2 * tp / (2 * tp + fp + fn) AS f1 FROM k)"""


@query("threshold_sweep", SWEEP + """
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  round((tp + fn) / n, 8) AS prevalence, round(precision, 8) AS precision, round(recall, 8) AS recall,
  round(specificity, 8) AS specificity, round(f1, 8) AS f1_score, round(5 * tp / (5 * tp + 4 * fn + fp), 8) AS f2_score,
  round(recall + specificity - 1, 8) AS youdens_j, round((tp + fp) / n * 1000, 6) AS alerts_per_1000,
  round(fp / n * 1000, 6) AS false_positives_per_1000, round(tp / n * 1000, 6) AS true_positives_per_1000 FROM m""")
def threshold_sweep(spark, sf):
    out = metrics.threshold_sweep(scored_lines(spark, sf), "label", "score")
    return out.select(*[F.round(c, 6 if "_per_" in c else 8).alias(c) if t == "double" and c != "threshold" else F.col(c)
                        for c, t in out.dtypes])


@query("operating_points", SWEEP + """,
g AS (SELECT unnest([0.95e0, 0.85e0, 0.75e0, 0.65e0, 0.55e0, 0.40e0, 0.25e0]) AS target),
o AS (SELECT threshold, recall, row_number() OVER (PARTITION BY target ORDER BY abs(recall - target), threshold) AS rn
  FROM m, g)
SELECT DISTINCT threshold, round(recall, 8) AS recall FROM o WHERE rn = 1""")
def operating_points(spark, sf):
    sweep = metrics.threshold_sweep(scored_lines(spark, sf), "label", "score")
    return metrics.operating_points(sweep).select("threshold", F.round("recall", 8).alias("recall"))


@query("tuned_threshold", f"""WITH {SCORED},
t AS (SELECT round(0.01e0 + i * (0.98e0 / 499), 12) AS threshold FROM range(500) AS r(i)),
h AS (SELECT l_linestatus, score, count(*) AS n, sum(label) AS p FROM scored GROUP BY 1, 2),
k AS (SELECT l_linestatus, threshold, CAST(sum(p) FILTER (WHERE score >= threshold) AS DOUBLE) AS tp,
    CAST(sum(n - p) FILTER (WHERE score >= threshold) AS DOUBLE) AS fp, CAST(sum(p) AS DOUBLE) AS pos FROM h, t GROUP BY 1, 2),
m AS (SELECT l_linestatus, threshold, tp / (tp + fp) AS precision, tp / pos AS recall, 2 * tp / (tp + fp + pos) AS f1 FROM k)
SELECT l_linestatus, threshold, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1_score
FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY f1 DESC, threshold) AS rn FROM m
  WHERE recall >= 0.7) WHERE rn = 1""")
def tuned_threshold(spark, sf):
    return metrics.tune_threshold(scored_lines(spark, sf), "label", "score", keys=["l_linestatus"]).select(
        "l_linestatus", "threshold", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"),
        F.round("f1_score", 8).alias("f1_score"))


@query("class_report", """WITH d AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_discount > 0.055
  THEN 'N' ELSE 'R' END AS p FROM lineitem),
c AS (SELECT class, count(*) FILTER (WHERE y = class AND p = class) AS hit, count(*) FILTER (WHERE p = class) AS called,
    count(*) FILTER (WHERE y = class) AS support FROM d, (VALUES ('A'), ('N'), ('R')) AS v(class) GROUP BY 1),
k AS (SELECT class, hit, hit / called AS precision, hit / support AS recall, 2 * hit / (called + support) AS f1_score,
    support FROM c)
SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1_score, 8) AS f1_score, support FROM k
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 8), round(sum(hit) / sum(support), 8),
  round(sum(hit) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM k
UNION ALL SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1_score), 8),
  CAST(sum(support) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8),
  round(sum(recall * support) / sum(support), 8), round(sum(f1_score * support) / sum(support), 8),
  CAST(sum(support) AS BIGINT) FROM k""")
def class_report(spark, sf):
    p = F.when(F.col("l_quantity") < 15, "A").when(F.col("l_discount") > 0.055, "N").otherwise("R")
    return rounded(metrics.class_report(table(spark, sf, "lineitem").withColumn("p", p), "l_returnflag", "p"), 8)


@query("regression_metrics", """WITH d AS (SELECT l_returnflag, l_extendedprice AS y, 1800 * l_quantity + 50 AS p FROM lineitem),
m AS (SELECT l_returnflag, avg(y) AS mu FROM d GROUP BY 1)
SELECT l_returnflag, round(avg(abs(y - p)), 5) AS mae, round(sqrt(avg(power(y - p, 2))), 5) AS rmse,
  round(1 - sum(power(y - p, 2)) / sum(power(y - mu, 2)), 8) AS r2,
  round(avg(abs(y - p) / y) FILTER (WHERE y > 0.05) * 100, 6) AS mape, count(*) AS n
FROM d JOIN m USING (l_returnflag) GROUP BY 1""")
def regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("p", 1800 * F.col("l_quantity") + 50)
    return metrics.regression_metrics(df, "l_extendedprice", "p", keys=["l_returnflag"]).select(
        "l_returnflag", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("r2", 8).alias("r2"),
        F.round("mape", 6).alias("mape"), "n")


FOLDS = f"""WITH {SCORED},
k AS (SELECT l_linestatus, CAST(round(score * 100) AS BIGINT) % 5 AS fold,
    count(*) FILTER (WHERE label = pred) / count(*) AS accuracy,
    count(*) FILTER (WHERE label = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE label = 1), 0) AS recall
  FROM scored GROUP BY 1, 2),
l AS (SELECT l_linestatus, 'accuracy' AS metric, accuracy AS v FROM k UNION ALL SELECT l_linestatus, 'recall', recall FROM k)"""


def _folds(spark, sf):
    fold = F.round(F.col("score") * 100).cast("long") % 5
    return metrics.binary_metrics(scored_lines(spark, sf).withColumn("fold", fold), "label", "pred",
                                  keys=["l_linestatus", "fold"])


@query("cv_summary", FOLDS + """
SELECT l_linestatus, metric, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS sd, round(min(v), 8) AS min,
  round(max(v), 8) AS max, round(stddev_pop(v) / avg(v), 8) AS cv FROM l GROUP BY 1, 2""")
def cv_summary(spark, sf):
    return rounded(metrics.cv_summary(_folds(spark, sf), ["accuracy", "recall"], ["l_linestatus"]), 8)


@query("model_comparison", FOLDS + """
SELECT l_linestatus, max(cell) FILTER (WHERE metric = 'accuracy') AS accuracy,
  max(cell) FILTER (WHERE metric = 'recall') AS recall FROM (
    SELECT l_linestatus, metric, printf('%.3f (%.3f)', round(round(avg(v), 9), 3), round(round(stddev_pop(v), 9), 3)) AS cell
    FROM l GROUP BY 1, 2) GROUP BY 1""")
def model_comparison(spark, sf):
    summary = metrics.cv_summary(_folds(spark, sf), ["accuracy", "recall"], ["l_linestatus"])
    return metrics.comparison_table(summary, "l_linestatus", ["accuracy", "recall"])
