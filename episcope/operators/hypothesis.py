"""Group comparisons. The data is reduced to moments or counted values; p-values are added to the small result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions import dist
from episcope.functions.expr import ladder
from episcope.operators.joins import enrich
from episcope.operators.ordered import range_cuts, running_totals
from episcope.operators.tabulate import drop_null_keys
from episcope.session import durable


def stack_columns(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Numeric columns under one another as (variable, value), nulls left out."""
    cast = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(list(keep), list(cols), "variable", "value").where(F.col("value").isNotNull())


def _two_groups(df: DataFrame, group: str, cols: Sequence[str], a, b) -> DataFrame:
    """Moments of both groups side by side, one row per variable, from one aggregate."""
    long = stack_columns(df.where(F.col(group).isin(a, b)), [group], cols)
    first = F.col(group) == F.lit(a)
    side = {"a": F.when(first, F.col("value")), "b": F.when(~first, F.col("value"))}
    return long.groupBy("variable").agg(*[
        fn(v).alias(f"{name}_{s}") for s, v in side.items()
        for name, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])


def _welch(table: DataFrame) -> DataFrame:
    se_a, se_b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se_a + se_b))
    dof = F.try_divide((se_a + se_b) ** 2, se_a ** 2 / (F.col("n_a") - 1) + se_b ** 2 / (F.col("n_b") - 1))
    return table.withColumns({"t": t, "dof": dof})


def _pooled_d() -> Column:
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"))
                    / (F.col("n_a") + F.col("n_b") - 2))
    return F.when(pooled > 0, (F.col("mean_b") - F.col("mean_a")) / pooled)


def effect_size(d: str | Column) -> Column:
    return ladder(F.abs(F.col(d) if isinstance(d, str) else d), [(0.8, "large"), (0.5, "medium")], "small",
                  inclusive=True)


def welch_t(df: DataFrame, group: str, cols: Sequence[str], a, b) -> DataFrame:
    """Welch's t-test of group ``a`` against ``b`` for several outcome columns, in one pass."""
    table = _welch(_two_groups(df, group, cols, a, b).where("n_a > 1 AND n_b > 1"))
    return table.select("variable", "n_a", "n_b", "mean_a", "mean_b", "t", "dof",
                        dist.t_p_value(F.col("t"), F.col("dof")).alias("p_value"))


def rank_table(df: DataFrame, keys: Sequence[str], value: str, first: Column, descending: bool = False, count: str | None = None) -> DataFrame:
    """Distinct values with the rows of either side and their running counts. ``count``: how many rows each one stands for.

    Everything that ranks (U statistic, ROC area, average precision) reads this table. Rows are counted per value
    before any ordering, and the running counts are carried across value ranges.
    """
    present = drop_null_keys(df, [*keys, value])
    rows = lambda side: F.count_if(side) if count is None else F.coalesce(F.sum(F.when(side, F.col(count))), F.lit(0))
    counted = present.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(
        rows(first).alias("n_first"), rows(~first).alias("n_second"))
    both = counted.withColumn("n", F.col("n_first") + F.col("n_second"))
    return running_totals(both, keys, "value", {"cum_first": "n_first", "cum_second": "n_second"}, descending,
                          cuts=range_cuts(present, value))


def mann_whitney(df: DataFrame, group: str, value: str, a, b, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney U of group ``a``: average ranks for ties, normal tail with tie and continuity correction."""
    return u_test(rank_table(df.where(F.col(group).isin(a, b)), keys, value, F.col(group) == F.lit(a)), keys)


def u_test(ranks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The U statistic and its p-value from a :func:`rank_table`."""
    cum, n = F.col("cum_first") + F.col("cum_second"), F.col("n").cast("double")
    midrank = cum - n + (n + 1) / 2
    sums = ranks.groupBy(*keys).agg(
        F.sum("n_first").alias("n_a"), F.sum("n_second").alias("n_b"),
        F.sum(F.col("n_first") * midrank).alias("rank_sum"), F.sum(n * n * n - n).alias("ties"))
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    total = n_a + n_b
    u = F.col("rank_sum") - n_a * (n_a + 1) / 2
    spread = F.sqrt(n_a * n_b / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    z = F.try_divide(F.greatest(u, n_a * n_b - u) - n_a * n_b / 2 - 0.5, spread)
    return sums.select(*keys, "n_a", "n_b", u.alias("u"), z.alias("z")).withColumn(
        "p_value", F.least(dist.z_p_value(F.greatest(F.col("z"), F.lit(0.0))), F.lit(1.0)))


def cohens_d(df: DataFrame, group: str, col: str, pairs: Sequence[tuple]) -> DataFrame:
    """Cohen's d with pooled SD per ordered pair of groups; pairs with a group under two rows are left out."""
    levels = list(dict.fromkeys(x for pair in pairs for x in pair))
    here = {lv: F.when(F.col(group) == F.lit(lv), F.col(col)) for lv in levels}
    row = df.agg(*[fn(here[lv]).alias(f"{name}_{i}") for i, lv in enumerate(levels)
                   for name, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    index = {lv: i for i, lv in enumerate(levels)}
    pair_rows = F.array(*[F.struct(
        F.lit(f"{x} vs {y}").alias("comparison"),
        *[F.col(f"{name}_{index[lv]}").alias(f"{name}_{side}") for side, lv in (("a", x), ("b", y))
          for name in ("n", "mean", "var")]) for x, y in pairs])
    table = row.select(F.explode(pair_rows).alias("p")).select("p.*").where("n_a > 1 AND n_b > 1")
    return table.select("comparison", "mean_a", "mean_b", _pooled_d().alias("cohens_d")).withColumn(
        "magnitude", effect_size("cohens_d"))


def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test of independence with Cramer's V; 2 x 2 tables get the continuity correction.

    Works on the counted cells. Empty cells need no rows: the statistic is sum(O^2 / E) - N.
    """
    cells = drop_null_keys(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    with_margins = (cells
                    .withColumn("row_total", F.sum("o").over(Window.partitionBy(a)))
                    .withColumn("col_total", F.sum("o").over(Window.partitionBy(b)))
                    .withColumn("total", cells.select(F.sum("o")).scalar()))
    expected = F.col("row_total") * F.col("col_total") / F.col("total")
    # Each margin is met once per cell of its row or column, so weight 1/margin by the cell's part of the margin.
    s = with_margins.agg(
        F.max("total").alias("n"), F.countDistinct(a).alias("rows"), F.countDistinct(b).alias("cols"),
        (F.sum(F.col("o") * F.col("o") / expected) - F.max("total")).alias("plain"),
        F.max(F.abs(F.col("o") - expected)).alias("gap"),
        F.sum(F.col("o") / (F.col("row_total") ** 2)).alias("inv_rows"),
        F.sum(F.col("o") / (F.col("col_total") ** 2)).alias("inv_cols"))
    reduced = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = reduced ** 2 * F.col("n") * F.col("inv_rows") * F.col("inv_cols")
    two_by_two = (F.col("rows") == 2) & (F.col("cols") == 2)
    smaller = F.least("rows", "cols") - 1
    out = s.select(F.when(two_by_two, yates).otherwise(F.col("plain")).alias("chi2"),
                   ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"), F.col("n").cast("long").alias("n"),
                   smaller.alias("smaller"))
    return out.select("chi2", "dof", "n", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * F.col("smaller"))).alias(
        "cramers_v"), dist.chi2_p_value(F.col("chi2"), F.col("dof").cast("double")).alias("p_value"))


def contingency_cells(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Rows per feature, category and target class, for all features from one pass over the table. Missing categories and
    classes have their own cells. Every report on categorical features reads this table."""
    long = df.select(F.col(target).alias("__class"), *[F.col(c).cast("string").alias(c) for c in features]).unpivot(
        ["__class"], list(features), "feature", "category")
    return durable(long.groupBy("feature", "category", F.col("__class").alias("class")).agg(F.count(F.lit(1)).alias("n")))


def association(cells: DataFrame) -> DataFrame:
    """Chi-square test, Cramer's V and its size per feature, with categories and missing values, from
    :func:`contingency_cells`.

    Missing categories and classes stay out of the test. 2 x 2 tables get the continuity correction; a feature with one
    category (or one class) has chi-square 0 and neither V nor size, one without any category has no test at all. Margins are aggregates joined back, so a feature
    with very many categories is spread over tasks.
    """
    sizes = cells.groupBy("feature").agg(
        F.countDistinct("category").alias("n_categories"),
        F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.sum("n").alias("n_rows"))
    full = cells.dropna(subset=["category", "class"]).withColumn("n", F.col("n").cast("double"))
    rows = full.groupBy("feature", "category").agg(F.sum("n").alias("row_total"))
    cols = full.groupBy("feature", "class").agg(F.sum("n").alias("col_total"))
    total = cols.groupBy("feature").agg(F.sum("col_total").alias("total"), F.count(F.lit(1)).alias("cols"),
                                        F.sum(1 / F.col("col_total")).alias("inv_cols"))
    wide = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.sum(1 / F.col("row_total")).alias("inv_rows"))
    margins = total.join(wide, "feature")
    expected = F.col("row_total") * F.col("col_total") / F.col("total")
    marked = enrich(enrich(full.join(rows, ["feature", "category"]), cols, ["feature", "class"]), total.select("feature", "total"), "feature")
    sums = marked.groupBy("feature").agg(F.sum(F.col("n") * F.col("n") / expected).alias("ratio"),
                                         F.max(F.abs(F.col("n") - expected)).alias("gap"))
    reduced = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = reduced ** 2 * F.col("total") * F.col("inv_rows") * F.col("inv_cols")
    smaller = F.least("rows", "cols") - 1
    chi2 = (F.when(smaller == 0, 0.0).when((F.col("rows") == 2) & (F.col("cols") == 2), yates)
            .when(F.col("ratio").isNotNull(), F.greatest(F.col("ratio") - F.col("total"), F.lit(0.0))))
    out = sizes.join(margins.join(sums, "feature"), "feature", "left").select(
        "feature", "n_categories", "missing_count", (F.col("missing_count") * 100.0 / F.col("n_rows")).alias("missing_pct"),
        chi2.alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"),
        F.sqrt(F.try_divide(chi2, F.col("total") * smaller)).alias("cramers_v"))
    p = F.when(F.col("dof") == 0, 1.0).otherwise(dist.chi2_p_value(F.col("chi2"), F.greatest(F.col("dof"), F.lit(1)).cast("double")))
    out = out.withColumn("p_value", F.when(F.col("dof").isNotNull(), p))
    return out.withColumns({
        "significant": F.when(F.col("p_value") < 0.05, "Yes").when(F.col("p_value").isNotNull(), "No"),
        "effect_size": F.when(F.col("cramers_v").isNotNull(), ladder(
            F.col("cramers_v"), [(0.3, "Large"), (0.1, "Medium")], "Small", inclusive=True))})


def category_shares(cells: DataFrame, positive=1) -> DataFrame:
    """Percent of negative and positive rows per feature and category, from :func:`contingency_cells`."""
    full = cells.dropna(subset=["category", "class"])
    hit = F.sum(F.when(F.col("class") == F.lit(positive), F.col("n")).otherwise(0))
    out = full.groupBy("feature", "category").agg(F.sum("n").alias("n"), hit.alias("__hit"))
    return out.select("feature", "category", "n", ((F.col("n") - F.col("__hit")) * 100.0 / F.col("n")).alias("neg_pct"),
                      (F.col("__hit") * 100.0 / F.col("n")).alias("pos_pct"))


def _side_quartiles(ranks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Exact quartiles of both sides per variable, read off the running counts of a rank table."""
    joined = ranks.join(F.broadcast(sizes), "variable")  # one row per variable
    picks, out = [], []
    for side, col in (("a", "first"), ("b", "second")):
        last, first = F.col(f"cum_{col}") - 1, F.col(f"cum_{col}") - F.col(f"n_{col}")
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            rank = (F.col(f"n_{side}") - 1) * F.lit(p)
            for end, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
                picks.append(F.max(F.when((first <= at) & (at <= last), F.col("value"))).alias(f"{end}_{name}_{side}"))
            part = (F.col(f"n_{side}") - 1) * p % 1
            low, high = F.col(f"lo_{name}_{side}"), F.col(f"hi_{name}_{side}")
            out.append((low + part * (high - low)).alias(f"{name}_{side}"))
    return joined.groupBy("variable", "n_a", "n_b").agg(*picks).select("variable", *out)


def feature_report(df: DataFrame, outcome: str, cols: Sequence[str]) -> DataFrame:
    """Per continuous feature: moments and quartiles by outcome (1 against 0), t-test, U test and effect size."""
    long = stack_columns(df.where(F.col(outcome).isin(0, 1)), [outcome], cols)
    base = _welch(_two_groups(df, outcome, cols, 1, 0))
    ranks = rank_table(long, ["variable"], "value", F.col(outcome) == 1)
    wide = _side_quartiles(ranks, base.select("variable", "n_a", "n_b"))
    u = u_test(ranks, ["variable"]).select("variable", "u", F.col("p_value").alias("u_p_value"))
    d = -_pooled_d()  # cases minus non-cases
    return (base.join(wide, "variable").join(u, "variable")
            .withColumns({"sd_a": F.sqrt("var_a"), "sd_b": F.sqrt("var_b"), "cohens_d": d,
                          "t_p_value": dist.t_p_value(F.col("t"), F.col("dof"))})
            .withColumn("magnitude", effect_size("cohens_d")).drop("var_a", "var_b"))
