"""Models against closed forms and brute force on small data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episcope.functions import dist
from episcope.operators import (anomaly, fixed_effects, forecast, hypothesis, learning, metrics, mixed, neighbours,
                                regression, resample)


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def test_tail_probabilities():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-10)
    assert dist.chi2_sf(3.84, 1) == pytest.approx(0.05004352124870, rel=1e-9)
    assert dist.chi2_sf(20, 5) == pytest.approx(0.00124973056303, rel=1e-9)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.22813885198627, rel=1e-9)
    assert dist.normal_quantile(0.975) == pytest.approx(1.95996398454005, rel=1e-9)
    assert dist.f_sf(4.0, 1, 20) == pytest.approx(dist.t_two_sided(2.0, 20), rel=1e-10)


def test_ols_equals_normal_equations(spark, rng):
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - z + rng.normal(size=200)
    got = {r["term"]: r for r in regression.ols_table(frame(spark, x=x, z=z, y=y), "y", ["x", "z"]).collect()}
    design = np.c_[np.ones(200), x, z]
    beta = np.linalg.solve(design.T @ design, design.T @ y)
    resid = y - design @ beta
    se = np.sqrt(np.diag(resid @ resid / 197 * np.linalg.inv(design.T @ design)))
    for i, name in enumerate(("intercept", "x", "z")):
        assert got[name]["estimate"] == pytest.approx(beta[i])
        assert got[name]["se"] == pytest.approx(se[i])
    assert got["x"]["r_squared"] == pytest.approx(1 - resid @ resid / ((y - y.mean()) ** 2).sum())


def test_moments_by_rows_equal_moments_by_columns(spark, rng):
    df = frame(spark, a=rng.normal(size=50), b=rng.normal(size=50), c=rng.normal(size=50))
    one, two = regression.moments(df, ["a", "b", "c"]), regression.moments(df, ["a", "b", "c"], few_rows=True)
    assert np.allclose(one.cross, two.cross)


def test_logit_two_by_two_and_fit_statistics(spark):
    counts = {(1, 1): 40, (1, 0): 60, (0, 1): 20, (0, 0): 80}
    data = [(g, y) for (g, y), n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(data, "g int, y int")
    for collapse in (False, True):
        row = regression.odds_ratios(df, F.col("y") == 1, ["g"], digits=None, collapse=collapse).first()
        assert row["odds_ratio"] == pytest.approx(40 * 80 / (60 * 20), rel=1e-6)
        half = 1.96 * math.sqrt(1 / 40 + 1 / 60 + 1 / 20 + 1 / 80)
        assert row["ci_low"] == pytest.approx(math.exp(math.log(8 / 3) - half), rel=1e-5)
        fit = regression.logit_fit(df, "y", ["g"], collapse).first()
        ll = 40 * math.log(.4) + 60 * math.log(.6) + 20 * math.log(.2) + 80 * math.log(.8)
        ll0 = 60 * math.log(.3) + 140 * math.log(.7)
        assert fit["log_likelihood"] == pytest.approx(ll) and fit["ll_null"] == pytest.approx(ll0)
        assert fit["aic"] == pytest.approx(4 - 2 * ll) and fit["pseudo_r2"] == pytest.approx(1 - ll / ll0)
        assert fit["n"] == 200
    with pytest.raises(ValueError, match="single class"):
        regression.logit_table(df.where("y = 1"), "y", ["g"])


def _panel(rng, units=12, periods=8):
    u, t = np.repeat(np.arange(units), periods), np.tile(np.arange(periods), units)
    start = np.where(u % 3 == 0, np.nan, 3 + u % 3)
    post = (t >= np.nan_to_num(start, nan=99)).astype(float)
    y = u * 0.3 + t * 0.2 - 1.1 * post + rng.normal(size=len(u))
    return pd.DataFrame(dict(u=u, t=t, post=post, y=y, start=start))


def _dummies(p, x):
    return np.c_[x, pd.get_dummies(p.u).to_numpy(float), pd.get_dummies(p.t).to_numpy(float)[:, 1:]]


def test_two_way_effects_equal_dummies(spark, rng):
    p = _panel(rng)
    for part in (p, p.drop(index=[3, 4, 20])):  # balanced, then not
        d = _dummies(part, part.post.to_numpy())
        beta, *_ = np.linalg.lstsq(d, part.y.to_numpy(), rcond=None)
        resid = part.y - d @ beta
        se = math.sqrt(resid @ resid / (len(part) - d.shape[1]) * np.linalg.pinv(d.T @ d)[0, 0])
        row = fixed_effects.twoway_fe(spark.createDataFrame(part.drop(columns="start")), "y", ["post"], "u", "t").first()
        assert row["estimate"] == pytest.approx(beta[0], abs=1e-4)
        assert row["se"] == pytest.approx(se, rel=1e-4)


def test_event_study_equals_dummies(spark, rng):
    p = _panel(rng)
    df = spark.createDataFrame(p).withColumn("start", F.when(~F.isnan("start"), F.col("start").cast("int")))
    got = {r["rel_time"]: r["estimate"] for r in fixed_effects.event_study(df, "y", "u", "t", "start", -2, 2).collect()}
    rel = np.clip(p.t - p.start, -2, 2)
    x = np.column_stack([(rel == k).astype(float) for k in (-2, 0, 1, 2)])
    beta, *_ = np.linalg.lstsq(_dummies(p, x), p.y.to_numpy(), rcond=None)
    assert [got[k] for k in (-2, 0, 1, 2)] == pytest.approx(list(beta[:4]), abs=1e-8)
    assert got[-1] == 0.0


def test_unit_effects_equal_dummies(spark, rng):
    p = _panel(rng)
    d = np.c_[p.post, p.t, pd.get_dummies(p.u).to_numpy(float)]
    beta, *_ = np.linalg.lstsq(d, p.y.to_numpy(), rcond=None)
    got = [r["estimate"] for r in fixed_effects.one_way_fe(spark.createDataFrame(p), "y", ["post", "t"], "u").collect()]
    assert got == pytest.approx(list(beta[:2]))


def test_random_intercept_equals_anova(spark, rng):
    g = np.repeat(np.arange(15), 8)
    y = 3 + rng.normal(size=15)[g] * 2 + rng.normal(size=120)
    row = mixed.lmm(frame(spark, g=g, y=y), "y", [], "g").first()
    between = 8 * pd.Series(y).groupby(g).mean().var()
    within = pd.Series(y).groupby(g).var().mean()
    assert row["residual_var"] == pytest.approx(within, rel=1e-4)
    assert row["group_var"] == pytest.approx((between - within) / 8, rel=1e-3)
    assert row["estimate"] == pytest.approx(y.mean())


def test_contrasts_and_anova(spark, rng):
    n = 300
    arm = rng.choice(["a", "b", "c"], n)
    x = rng.normal(size=n)
    y = x + 2.0 * (arm == "b") + rng.normal(size=n) * 0.1
    df = frame(spark, arm=arm, x=x, y=y, g=np.arange(n) % 20)
    coded, names = mixed.interaction_columns(df, "x", "arm", ["a", "b", "c"])
    fit = mixed.lmm_fit(coded, "y", names, "g")
    rows = {r["term"]: r for r in mixed.contrasts(spark, fit, "arm", ["a", "b", "c"], "x").collect()}
    assert rows["a - b"]["estimate"] == pytest.approx(-2.0, abs=0.1) and rows["a - b"]["p_value"] < 1e-10
    assert rows["a - c"]["p_value"] > 0.001
    test = {r["term"]: r for r in mixed.wald_anova(spark, fit, {"x": ["x"], "arm": ["arm_b", "arm_c"]}).collect()}
    assert test["arm"]["p_value"] < 1e-10 and test["arm"]["dof"] == 2


def _explicit_dummies(d, xs):
    """Coefficients, degrees of freedom and both kinds of covariance from explicit dummies."""
    x = d[xs].to_numpy(float)
    x = x - x.mean(axis=0)  # the effects take the means up
    full = np.column_stack([x, *[(d["u"] == v).to_numpy(float) for v in sorted(d["u"].unique())],
                            *[(d["t"] == v).to_numpy(float) for v in sorted(d["t"].unique())]])
    left = np.linalg.pinv(full, rcond=1e-10)
    inv, beta = left @ left.T, left @ d["y"].to_numpy()
    resid = d["y"].to_numpy() - full @ beta
    n, units, dof = len(d), d["u"].nunique(), len(d) - int(np.linalg.matrix_rank(full))
    scores = pd.DataFrame(full * resid[:, None]).groupby(d["u"].to_numpy()).sum().to_numpy()
    k = len(xs)
    clustered = (inv @ (scores.T @ scores) @ inv)[:k, :k] * units / (units - 1) * (n - 1) / dof
    return beta[:k], dof, (inv * (resid @ resid) / dof)[:k, :k], clustered


@pytest.mark.parametrize("kind", ["holes", "repeats", "two parts", "long calendar"])
@pytest.mark.parametrize("cluster", [False, True])
def test_unbalanced_panels_equal_explicit_dummies(spark, rng, monkeypatch, kind, cluster):
    d = pd.DataFrame([(u, t) for u in range(24) for t in range(9)], columns=["u", "t"])
    if kind == "two parts":  # no unit links the early periods with the late ones
        d = d[(d["u"] < 12) == (d["t"] < 5)]
    d = d.sample(frac=0.7, random_state=4)
    if kind == "repeats":
        d = pd.concat([d, d.iloc[:30], d.iloc[:11]])
    d = d.assign(x=rng.normal(1e4, 1, len(d)) + d["u"] + d["t"] ** 2, post=(d["t"] >= d["u"] % 7 + 1).astype(float))
    d["y"] = 1e5 + 0.3 * d["x"] + d["post"] + d["u"] ** 2 + 3 * np.sin(d["t"]) + rng.normal(size=len(d))
    if kind == "long calendar":
        monkeypatch.setattr(fixed_effects._twoway, "__defaults__", (False, 3))
    beta, dof, plain, clustered = _explicit_dummies(d, ["x", "post"])
    got = {r["term"]: r for r in fixed_effects.twoway_fe(spark.createDataFrame(d), "y", ["x", "post"], "u", "t", cluster).collect()}
    for i, name in enumerate(["x", "post"]):
        assert got[name]["estimate"] == pytest.approx(beta[i], rel=1e-5 if kind == "long calendar" else 1e-7)
        assert got[name]["se"] == pytest.approx(math.sqrt((clustered if cluster else plain)[i, i]), rel=1e-5)


def test_neighbours_far_from_the_origin(spark, rng):
    """Copies at norm 1e4 are at distance 0, and points a millionth apart keep their order."""
    base = rng.normal(1e4, 1, (40, 3))
    points = np.vstack([base, base[:10], base[10:20] + 1e-6 * rng.normal(size=(10, 3))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    got = {(r["qid"], r["rank"]): r for r in neighbours.nearest_neighbours(df, df, 2).collect()}
    every = np.sqrt(((points[:, None] - points[None, :]) ** 2).sum(2))
    first = min(r for _, r in got)
    for i in range(10):
        assert got[(i, first)]["pid"] == 40 + i and got[(i, first)]["dist"] == 0.0
    for i in range(10, 20):
        assert got[(i, first)]["pid"] == 40 + i and got[(i, first)]["dist"] == pytest.approx(every[i, 40 + i], abs=1e-9)  # nine digits


def _least_squares(x, y, names):
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[0], None
    rss = float(((y - x @ beta) ** 2).sum())
    s2 = rss / (len(y) - x.shape[1])
    return mixed.MixedFit(names, beta, s2 * np.linalg.inv(x.T @ x), {}, s2, len(y), {}), rss


def _unbalanced(rng, n=240):
    arm = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    site = np.where(rng.random(n) < np.where(arm == "a", 0.8, 0.3), "s", "t")
    x = rng.normal(2, 1, n) + (arm == "b")
    y = x + 1.5 * (arm == "b") - (site == "t") + 0.8 * (arm == "c") * (site == "t") + rng.normal(size=n)
    return arm, site, x, y


@pytest.mark.parametrize("base", ["abc", "cab"])
def test_type3_tests_are_sums_of_squares_of_nested_fits(spark, rng, base):
    """Unbalanced two-way table with a covariate: each test is the loss from leaving out the term's columns in a coding
    whose columns add up to zero over levels, whichever base levels the treatment coding has."""
    arm, site, x, y = _unbalanced(rng)
    design = mixed.Design(["x"], {"arm": list(base), "site": ["t", "s"]},
                          [("x",), ("arm",), ("site",), ("arm", "site"), ("x", "arm")])
    coded, names = design.coded(frame(spark, arm=arm, site=site, x=x, y=y, i=np.arange(len(y))))
    made = coded.orderBy("i").toPandas()
    fit, rss = _least_squares(np.column_stack([np.ones(len(y)), made[names].to_numpy()]), y, ["intercept", *names])
    a = np.column_stack([1.0 * (arm == lv) - (arm == "c") for lv in "ab"])
    s = (1.0 * (site == "s") - (site == "t"))[:, None]
    blocks = {"x": x[:, None], "arm": a, "site": s, "arm:site": a * s, "x:arm": x[:, None] * a}
    for row in mixed.type3_tests(spark, fit, design).collect():
        rest = np.column_stack([np.ones((len(y), 1)), *[b for k, b in blocks.items() if k != row["term"]]])
        _, less = _least_squares(rest, y, None)
        assert row["dof"] == blocks[row["term"]].shape[1]
        assert row["chi2"] == pytest.approx((less - rss) / fit.residual_var, rel=1e-8)


def test_marginal_means_average_predictions(spark, rng):
    arm, site, x, y = _unbalanced(rng)
    design = mixed.Design(["x"], {"arm": ["a", "b", "c"], "site": ["s", "t"]}, [("x",), ("arm",), ("site",), ("arm", "site"), ("x", "arm")])
    df = frame(spark, arm=arm, site=site, x=x, y=y, i=np.arange(len(y)))
    made = design.coded(df)[0].orderBy("i").toPandas()
    names = list(design.columns())
    fit, _ = _least_squares(np.column_stack([np.ones(len(y)), made[names].to_numpy()]), y, ["intercept", *names])
    at = mixed.covariate_means(df, design, "y")
    assert at["x"] == pytest.approx(x.mean())
    grid = frame(spark, arm=np.repeat(["a", "b", "c"], 2), site=np.tile(["s", "t"], 3), x=np.full(6, x.mean()), i=np.arange(6))
    points = np.column_stack([np.ones(6), design.coded(grid)[0].orderBy("i").toPandas()[names].to_numpy()]) @ fit.beta
    means = {r["term"]: r for r in mixed.marginal_means(spark, fit, design, "arm", at).collect()}
    for i, lv in enumerate("abc"):
        assert means[lv]["estimate"] == pytest.approx(points[2 * i:2 * i + 2].mean())
    pairs = {r["term"]: r for r in mixed.marginal_contrasts(spark, fit, design, "arm", at).collect()}
    assert pairs["a - c"]["estimate"] == pytest.approx(means["a"]["estimate"] - means["c"]["estimate"])


def test_design_needs_margins(spark):
    with pytest.raises(ValueError, match="margins"):
        mixed.Design(["x"], {"arm": ["a", "b"]}, [("x",), ("x", "arm")])
    with pytest.raises(ValueError, match="neither"):
        mixed.Design([], {"arm": ["a", "b"]}, [("sex",)])


def test_association_of_edge_cases(spark):
    """One category, no category at all, missing classes, and a clean split."""
    df = spark.createDataFrame([("u", "p", None, 1), ("u", "p", None, 1), ("u", "q", None, 0), ("u", "q", None, 0),
                                ("u", None, None, 0), ("u", "q", None, None)], "one string, two string, none string, y int")
    cells = hypothesis.contingency_cells(df, "y", ["one", "two", "none"])
    got = {r["feature"]: r for r in hypothesis.association(cells).collect()}
    assert (got["one"]["chi2"], got["one"]["dof"], got["one"]["p_value"], got["one"]["cramers_v"], got["one"]["effect_size"]) == (0.0, 0, 1.0, None, None)
    assert (got["none"]["n_categories"], got["none"]["missing_count"], got["none"]["chi2"], got["none"]["significant"]) == (0, 6, None, None)
    assert got["two"]["chi2"] == pytest.approx(1.0) and got["two"]["missing_pct"] == pytest.approx(100 / 6)
    assert got["two"]["p_value"] == pytest.approx(math.erfc(math.sqrt(0.5))) and got["two"]["effect_size"] == "Large"
    shares = {(r["feature"], r["category"]): (r["n"], r["neg_pct"], r["pos_pct"]) for r in hypothesis.category_shares(cells).collect()}
    assert shares[("two", "p")] == (2, 0.0, 100.0) and shares[("one", "u")] == (5, 60.0, 40.0) and ("none", None) not in shares


def test_binomial_mixed_model_recovers_truth(spark, rng):
    n = 4000
    site, period, x = rng.integers(0, 12, n), rng.integers(0, 4, n), rng.integers(0, 2, n)
    effect, shift = rng.normal(size=12) * 0.6, rng.normal(size=4) * 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.4 + 0.8 * x + effect[site] + shift[period])))).astype(int)
    fit = mixed.glmm_binomial_fit(frame(spark, site=site, period=period, x=x, y=y), "y", ["x"], ["site", "period"])
    assert fit.beta[1] == pytest.approx(0.8, abs=0.25)
    assert 0.05 < fit.group_var["site"] < 1.5
    with pytest.raises(ValueError, match="combinations"):
        mixed.glmm_binomial_fit(frame(spark, site=site, x=x, y=y), "y", ["x"], ["site"], max_cells=3)


def _ranks(v):
    return pd.Series(v).rank().to_numpy()


def test_tests_against_closed_forms(spark, rng):
    a, b = np.round(rng.normal(0, 1, 60), 1), np.round(rng.normal(0.4, 1.5, 45), 1)
    df = frame(spark, g=["a"] * 60 + ["b"] * 45, v=np.r_[a, b])
    w = hypothesis.welch_t(df, "g", ["v"], "a", "b").first()
    se = a.var(ddof=1) / 60 + b.var(ddof=1) / 45
    assert w["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(se))
    u = hypothesis.mann_whitney(df, "g", "v", "a", "b").first()
    ranks = _ranks(np.r_[a, b])
    assert u["u"] == pytest.approx(ranks[:60].sum() - 60 * 61 / 2)
    d = hypothesis.cohens_d(df, "g", "v", [("a", "b"), ("a", "zz")]).collect()
    pooled = math.sqrt((59 * a.var(ddof=1) + 44 * b.var(ddof=1)) / 103)
    assert len(d) == 1 and d[0]["cohens_d"] == pytest.approx((b.mean() - a.mean()) / pooled)


def test_chi2_with_an_empty_cell(spark):
    data = [("x", "p")] * 5 + [("y", "p")] * 7 + [("y", "q")] * 9
    row = hypothesis.chi2_test(spark.createDataFrame(data, "a string, b string"), "a", "b").first()
    obs = np.array([[5.0, 0.0], [7.0, 9.0]])
    exp = np.outer(obs.sum(1), obs.sum(0)) / obs.sum()
    assert row["chi2"] == pytest.approx(((np.abs(obs - exp) - 0.5) ** 2 / exp).sum())
    assert row["p_value"] == pytest.approx(dist.chi2_sf(row["chi2"], 1))


def test_area_is_invariant_and_counts_add_up(spark, rng):
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = frame(spark, y=y, s=s).withColumn("p", (F.col("s") >= 0.5).cast("int"))
    m = metrics.binary_metrics(df, "y", "p", "s").first()
    assert m["tp"] + m["fp"] + m["tn"] + m["fn"] == 400
    assert metrics.auc(df.withColumn("s", F.exp("s")), "y", "s").first()["roc_auc"] == pytest.approx(m["roc_auc"])
    n1, n0 = y.sum(), 400 - y.sum()
    assert m["roc_auc"] == pytest.approx((_ranks(s)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    m = metrics.binary_metrics(df, "y", "p").first()
    assert (m["precision"], m["recall"], m["f1_score"], m["matthews_corrcoef"]) == (0.0, 0.0, 0.0, 0.0)
    assert m["lr_positive"] == math.inf and m["specificity"] == 1.0


def test_tuned_threshold_falls_back(spark):
    df = spark.createDataFrame([(1, 0.005), (0, 0.5), (1, 0.3)], "y int, s double")
    row = metrics.tune_threshold(df, "y", "s", min_recall=0.9).first()
    assert row["recall"] == pytest.approx(0.5) and row["threshold"] == pytest.approx(0.01)


def test_sweep_equals_brute_force(spark, rng):
    y, s = rng.integers(0, 2, 300), rng.random(300)
    cuts = [0.1, 0.25, 0.5, 0.99]
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in metrics.threshold_counts(frame(spark, y=y, s=s), "y", "s", cuts).collect()}
    for t in cuts:
        p = s >= t
        assert got[t] == ((y[p] == 1).sum(), (y[p] == 0).sum(), (y[~p] == 0).sum(), (y[~p] == 1).sum())


def test_bootstrap_is_paired_and_seeded(spark):
    data = [("k", i, 2.0 * (i + 1), float(i + 1)) for i in range(8)]
    df = spark.createDataFrame(data, "g string, unit int, num double, den double")
    row = resample.bootstrap_ratio(df, ["g"], "unit", "num", "den", 200).first()
    assert (row["ratio"], row["ci_low"], row["ci_high"]) == (2.0, 2.0, 2.0)
    noisy = df.withColumn("num", F.col("num") + F.col("unit") % 3)
    a = resample.bootstrap_ratio(noisy.repartition(1), ["g"], "unit", "num", "den", 200).collect()
    b = resample.bootstrap_ratio(noisy.repartition(7), ["g"], "unit", "num", "den", 200).collect()
    assert a == b and a[0]["ci_low"] < a[0]["ratio"] < a[0]["ci_high"]


def test_bootstrap_skips_missing_on_each_side(spark):
    data = [("k", 0, None, 1.0), ("k", 1, 4.0, None), ("k", 2, 6.0, 3.0)]
    row = resample.bootstrap_ratio(spark.createDataFrame(data, "g string, u int, n double, d double"), ["g"], "u", "n", "d", 50).first()
    assert row["ratio"] == pytest.approx(5.0 / 2.0) and row["n_units"] == 2


def test_median_difference_interval(spark, rng):
    a, b = rng.normal(5, 1, 40), rng.normal(3, 1, 30)
    df = frame(spark, g=["a"] * 40 + ["b"] * 30, v=np.r_[a, b])
    row = resample.bootstrap_median_diff(df, "g", "a", "b", "v", 500).first()
    assert row["n_per_draw"] == 30 and row["ci_low"] < row["median_diff"] < row["ci_high"]
    assert row["median_diff"] == pytest.approx(2.0, abs=0.6)


@pytest.mark.parametrize("kind", ["normal", "ties", "outlier", "one value", "no ties"])
def test_quantiles_of_all_differences(spark, rng, kind):
    n, m = (900, 700) if kind == "normal" else (60, 45)
    a, b = rng.normal(5, 1, n), rng.normal(3, 2, m)
    if kind == "ties":
        a, b = np.round(a), np.round(b)
    if kind == "outlier":
        a[0], b[0] = 1e12, -1e9
    if kind == "one value":
        b[:] = 2.5
    every = np.sort((a[:, None] - b[None, :]).ravel())
    half = len(every) // 2
    sides = [resample._value_counts(frame(spark, v=x), "v") for x in (a, b)]
    groups = [[1], [half, half + 1, half + 40], [1, len(every)], [half + 20, half + 60], [len(every)]]
    got = resample.difference_quantiles(*sides, groups)
    assert got == {r: every[r - 1] for g in groups for r in g}


def test_difference_quantiles_narrow_their_bands(spark, rng, monkeypatch):
    """With little room the bands are narrowed in rounds, and the pairs that are listed stay few."""
    a, b = rng.normal(5, 1, 4000), np.r_[rng.normal(3, 2, 3000), np.full(2000, 3.25)]
    every = np.sort((a[:, None] - b[None, :]).ravel())
    rounds = []
    counted = resample._pairs_below
    monkeypatch.setattr(resample, "_pairs_below", lambda *args: rounds.append(len(args[2])) or counted(*args))
    ranks = [len(every) // 40, len(every) // 40 + 5000]
    got = resample.difference_quantiles(*[resample._value_counts(frame(spark, v=x), "v") for x in (a, b)], [ranks])
    assert got == {r: every[r - 1] for r in ranks} and 1 <= len(rounds) <= 6


@pytest.mark.parametrize("n, m", [(31, 40), (30, 44), (1, 5), (2, 2)])
def test_median_difference_agrees_with_plain_draws(spark, rng, n, m):
    """The limits agree with replicates that are written out, odd and even sizes, within the draws' own spread."""
    a, b = rng.normal(5, 1, n), rng.normal(3, 1, m)
    df = frame(spark, g=["a"] * n + ["b"] * m, v=np.r_[a, b])
    row = resample.bootstrap_median_diff(df, "g", "a", "b", "v", 8000, seed=3).first()
    size = min(n, m)
    medians = np.median(rng.choice(a, (40000, size)) - rng.choice(b, (40000, size)), axis=1)
    for name, p in (("median_diff", 0.5), ("ci_low", 0.025), ("ci_high", 0.975)):
        low, high = np.quantile(medians, [max(0, p - 0.012), min(1, p + 0.012)])
        assert low - 1e-9 <= row[name] <= high + 1e-9


def test_replicate_percentile_reads_only_deciding_ranks(spark, rng):
    """Looking up a few ranks gives the percentile over all replicates."""
    a, b = rng.integers(0, 9, 40).astype(float), rng.integers(0, 7, 30) / 2
    every = np.sort((a[:, None] - b[None, :]).ravel())
    sides = [resample._value_counts(frame(spark, v=x), "v") for x in (a, b)]
    middle = resample._middle_ranks(30, len(every), 400, np.random.default_rng(5))
    means = [(every[x - 1] + every[y - 1]) / 2 for x, y in middle]
    probs = (0.025, 0.5, 0.975)
    assert resample._replicate_percentiles(sides, middle, probs) == pytest.approx(list(np.quantile(means, probs)), abs=1e-12)


def _weekly(spark, rng, n=260, bump=0.0):
    t = np.arange(n)
    day = pd.to_datetime("2010-01-03") + pd.to_timedelta(7 * t, unit="D")
    y = 5 + 3 * np.cos(2 * math.pi * t / 52) + rng.normal(size=n) * 0.2
    y[n - 20:] += bump
    return spark.createDataFrame(pd.DataFrame(dict(d=day.date, y=y, s=[f"s{v // 52}" for v in t])), "d date, y double, s string")


def test_decomposition_adds_up(spark, rng):
    df = _weekly(spark, rng).withColumn("k", F.lit("x"))
    for robust in (False, True):
        parts = forecast.decompose(df, ["k"], "d", "y", 52, robust).toPandas()
        assert len(parts) == 260
        assert np.allclose(parts.trend + parts.seasonal + parts.residual, parts.observed)
        strength = forecast.amplitude(forecast.decompose(df, ["k"], "d", "y", 52, robust), ["k"]).first()
        assert strength["strength_of_seasonality_fs"] > 0.95
        assert strength["seasonal_amplitude_range"] == pytest.approx(6.0, abs=0.8)
    assert forecast.decompose(df.limit(80), ["k"], "d", "y", 52).count() == 0


def test_forecast_detects_a_jump_and_is_stable(spark, rng):
    df = _weekly(spark, rng, bump=4.0)
    train_end = "2014-06-01"
    train = F.col("d") <= train_end
    merged = {g: forecast.seasonal_forecast(df, "d", "y", train, g, keep=["s"]) for g in ("flat", "linear")}
    table = forecast.compare_detections(merged, "d", "y", train_end).collect()
    jump = df.orderBy(F.desc("d")).limit(20).agg(F.min("d")).first()[0]
    assert all(abs((r["first_detection"] - jump).days) <= 7 for r in table if r["model"] == "flat")
    loo = forecast.leave_one_out(df, "d", "y", "s", train, train_end).collect()
    assert len(loo) == 5 and {r["direction"] for r in loo} <= {"Same", "Later", "Earlier"}
    gap = forecast.season_gap(merged["flat"].where("y IS NOT NULL"), "y", ["s"]).collect()
    assert len(gap) == 5


def test_fold_by_subtraction_equals_refit(spark, rng):
    df = _weekly(spark, rng)
    coded, names = forecast.design(df, "d", "flat", 3)
    parts = forecast._season_moments(coded, "s", ["y", *names])
    kept = [v for k, v in parts.items() if k != "s1"]
    n = sum(v[0] for v in kept)
    mean = sum(v[1] for v in kept) / n
    cross = sum(v[2] for v in kept) - n * np.outer(mean, mean)
    direct = regression.moments(coded.where("s <> 's1'"), ["y", *names])
    assert n == direct.n and np.allclose(cross, direct.cross, atol=1e-8)


def test_trend_change_is_found(spark, rng):
    t = np.arange(260)
    y = 5 + 3 * np.cos(2 * math.pi * t / 52) + np.where(t > 104, (t - 104) * 0.08, 0) + rng.normal(size=260) * 0.05
    day = pd.to_datetime("2010-01-03") + pd.to_timedelta(7 * t, unit="D")
    df = spark.createDataFrame(pd.DataFrame(dict(d=day.date, y=y)), "d date, y double")
    top = forecast.trend_changes(df, "d", "y").first()
    assert abs((top["change_date"] - day[104].date()).days) < 200 and top["delta"] > 0


def _brute(x, k):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def test_neighbours_equal_brute_force_on_skewed_points(spark, rng):
    x = np.r_[rng.normal(size=(150, 3)), np.zeros((120, 3)), rng.normal(size=(90, 3)) * 0.1 + 4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>")
    got = neighbours.nearest_neighbours(df, df, 4, n_pivots=16, block=40).toPandas().sort_values(["qid", "rank"])
    assert len(got) == 360 * 4 and (got.qid != got.pid).all()
    assert np.allclose(got.dist.to_numpy().reshape(360, 4), _brute(x, 4), atol=1e-6)


def test_neighbours_compare_equal_vectors_once(spark, rng, monkeypatch):
    """2,000 rows of 60 vectors: 60 queries meet 60 points, and the ids are still those of all rows."""
    x = rng.normal(size=(60, 3))[rng.integers(0, 60, 2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>")
    seen, search = [], neighbours._nearest_distinct
    monkeypatch.setattr(neighbours, "_nearest_distinct", lambda q, p, *rest: seen.append((q.count(), p.count())) or search(q, p, *rest))
    got = neighbours.nearest_neighbours(df, df, 4).toPandas().sort_values(["qid", "rank"])
    kinds = len(np.unique(x, axis=0))
    assert seen == [(kinds, kinds)] and len(got) == 2000 * 4
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    assert (got.pid.to_numpy().reshape(2000, 4) == np.argsort(d, axis=1, kind="stable")[:, :4]).all()


def test_neighbours_copy_a_query_once_per_block(rng):
    """What leaves Python for a query is one row, however many cells and blocks the points have."""
    x, centre = rng.normal(size=(500, 4)), rng.normal(size=(8, 4))
    first, count = neighbours._layout(np.array([3, 4, 100, 2, 5, 9, 1, 1]), 10)
    assert count.tolist() == [1, 1, 10, 1, 1, 1, 1, 1] and first.tolist() == [0, 0, 1, 11, 11, 12, 12, 13]
    inside = np.zeros((8, 14), "float32")
    for c in range(8):
        inside[c, first[c]:first[c] + count[c]] = 1
    batch = pd.DataFrame({"q": np.arange(500), "vec": list(x)})
    out = next(neighbours._offer(iter([batch]), centre, np.full(8, 50.0), np.zeros(8), np.full(8, 5), inside, 3))
    assert len(out) == 500 and all((b == np.arange(14)).all() for b in out["blk"])


@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 1e4), (1e-20, 0), (1e18, 0), (1e-6, 1e4)])
def test_nearest_in_steps_equals_brute_force(rng, scale, shift):
    x = rng.normal(size=(300, 5)) * scale + shift
    x[100:150], x[7] = x[:50], np.nan
    row, col, _ = neighbours._nearest(x, x, 6, rows=64, cols=70)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    want = np.delete(np.argsort(np.nan_to_num(d, nan=np.inf), axis=1, kind="stable")[:, :6], 7, axis=0)
    assert (col.reshape(299, 6) == want).all() and 7 not in row


def test_smote_counts_and_segments(spark, rng):
    x = rng.normal(size=(200, 2))
    label = (np.arange(200) < 40).astype(int)
    x[label == 1] += 1.0
    df = spark.createDataFrame([(i, int(y), v) for i, (y, v) in enumerate(zip(label, x.tolist()))], "id long, y int, f array<double>")
    for border in (False, True):
        made = neighbours.smote(df, "id", "y", "f", 0.7, borderline=border).where("id IS NULL").toPandas()
        assert len(made) == int(0.7 * 160) - 40
        rare = x[label == 1]
        low, high = rare.min(0), rare.max(0)
        pts = np.stack(made.f)
        assert (pts >= low - 1e-9).all() and (pts <= high + 1e-9).all()
    again = neighbours.smote(df.repartition(9), "id", "y", "f", 0.7).where("id IS NULL").toPandas()
    first = neighbours.smote(df.repartition(2), "id", "y", "f", 0.7).where("id IS NULL").toPandas()
    assert sorted(map(tuple, again.f)) == sorted(map(tuple, first.f))


def test_oversample_counts(spark):
    df = spark.range(100).select("id", (F.col("id") < 10).cast("int").alias("y"))
    got = {r["y"]: r["n"] for r in neighbours.oversample(df, "id", "y", 0.7, 1).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 90, 1: int(0.7 * 90)}


def test_isolation_forest_finds_the_outlier(spark, rng):
    x = np.r_[rng.normal(size=(400, 2)), [[9.0, 9.0]]]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "id long, a double, b double")
    base = df.where("id < 400")
    scores = anomaly.isolation_forest(base, df, "id", ["a", "b"], n_trees=60).toPandas()
    assert scores.sort_values("anomaly_score").id.iloc[0] == 400
    assert scores.anomaly_score.between(-1, 0).all()
    assert scores[scores.id < 400].anomaly.mean() == pytest.approx(0.10, abs=0.01)
    sweep = anomaly.contamination_sweep(base, df, "id", ["a", "b"], n_trees=60, excluded=["x"]).toPandas()
    assert sweep[sweep.robust_anomaly == "Yes"].id.isin(["400"]).any() and (sweep.robust_anomaly == "N/A").sum() == 1
    for row in sweep.itertuples():
        if row.flag_05 == "Anomaly":
            assert row.flag_10 == "Anomaly" and row.flag_15 == "Anomaly"


def test_average_path():
    assert anomaly.average_path(1) == 0.0 and anomaly.average_path(2) == 1.0
    assert anomaly.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_preprocessor_unknown_and_binary(spark):
    train = spark.createDataFrame([("a", "m", 1.0), ("b", "f", 3.0), ("c", "m", 5.0)], "c string, b string, x double")
    model = learning.preprocessor(categorical=["c"], binary_words=["b"], scaled=["x"]).fit(train)
    from pyspark.ml.functions import vector_to_array
    new = spark.createDataFrame([("zz", "m", 3.0), ("a", "f", 1.0)], "c string, b string, x double")
    got = [r[0] for r in model.transform(new).select(vector_to_array("features")).collect()]
    assert got[0] == pytest.approx([1.0, 0, 0, 0, 0.0]) and got[1] == pytest.approx([0.0, 1, 0, 0, -1.0])
    assert len(learning.feature_names(model.transform(train))) == 5


def test_evaluation_reports_every_split(spark, rng):
    n = 600
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x - 1))).astype(int)
    df = frame(spark, id=np.arange(n), x=x, y=1 - y)
    chain, few = learning.preprocessor(scaled=["x"]), int((1 - y).sum())
    split = learning.stratified_split(df, "id", "y", {"train": 0.7, "valid": 0.15, "test": 0.15})
    models = learning.tree_models("y", weights=True)
    small = {"DecisionTree": models["DecisionTree"], "BoostedWeighted": models["BoostedWeighted"].copy({models["BoostedWeighted"].maxIter: 3})}
    got = learning.fit_and_eval(split, "split", "id", "y", small, chain).toPandas().set_index(["model", "split"])
    assert set(got.index) == {(m, s) for m in small for s in ("train", "valid", "test")} and (got.roc_auc > 0.6).all()
    # Only training rows are resampled, and not those of the model with weights.
    train = split.where("split = 'train'").groupBy("y").count().toPandas().set_index("y")["count"]
    assert got.total["DecisionTree", "train"] == train[0] + int(0.7 * train[0]) and got.total["BoostedWeighted", "train"] == train.sum()
    assert got.total["DecisionTree", "valid"] + got.total["DecisionTree", "test"] + train.sum() == n
    folds = learning.cross_validate(df, "id", "y", small, chain, k=3, resampling="smote").toPandas()
    assert len(folds) == 6 and (folds.groupby("model").total.sum() == n).all() and ((folds.tp + folds.fn).groupby(folds.model).sum() == few).all()
    table = learning.imbalance_table(split.where("split = 'train'"), split.where("split = 'test'"), "id", "y", small, chain, methods=("none", "smote")).toPandas()
    assert len(table) == 4 and (table.roc_auc > 0.6).all()
    own = learning.prepare(df, chain, "id", "y")
    top = learning.importances(small["DecisionTree"].fit(own.rows), learning.feature_names(own.chain.transform(df))).first()
    assert top["importance"] == pytest.approx(1.0)


def test_text_forest_merges_equal_rows(spark, rng, monkeypatch):
    """Above the limit the trees read merged rows with the weight of all; below it every row."""
    n = 3000
    x = rng.integers(0, 5, n).astype(float)
    df = frame(spark, id=np.arange(n), x=x, t=np.where(np.arange(n) % 2 == 0, "fever cough", "none"), y=np.where(x > 2, "a", "b"))
    read, fit = [], learning.RandomForestClassifier.fit

    def spy(self, rows, *rest):
        read.append(rows.agg(F.count(F.lit(1)), F.sum("weight")).first())
        return fit(self, rows, *rest)
    monkeypatch.setattr(learning.RandomForestClassifier, "fit", spy)
    models = []
    for limit in (n, 100, 4):
        monkeypatch.setattr(learning, "MERGED_ROWS", limit)
        models.append(learning.text_forest(df, "y", "t", ["x"], trees=5))
    assert read[0][0] == n and 10 < read[1][0] <= 100 and read[2][0] == 10  # ten kinds of rows
    assert [r[1] for r in read] == pytest.approx([n] * 3)
    scaler = [m.stages[2] for m in models]
    assert all(list(s.mean) == pytest.approx([x.mean()]) for s in scaler)
    for m in models[:2]:
        assert m.transform(df).where("predicted <> y").count() == 0


def test_chains_know_training_rows_only(spark, rng):
    n = 300
    df = frame(spark, id=np.arange(n), x=rng.normal(size=n), c=np.where(np.arange(n) % 3 == 0, "a", "b"), y=(np.arange(n) % 4 == 0).astype(int))
    folded = learning.stratified_folds(df, "id", "y", 3)
    held = (F.col("fold") == 0) & (F.col("id") % 2 == 0)
    changed = folded.withColumns({"x": F.when(held, 1e6).otherwise(F.col("x")), "c": F.when(held, "zz").otherwise(F.col("c"))}).drop("fold")
    chain = learning.preprocessor(categorical=["c"], scaled=["x"])
    for kind in ("none", "smote", "oversample"):
        (_, before), (rows, after) = (learning.fold_rows(x, "id", "y", chain, 3, resampling=kind) for x in (df, changed))
        kept = [r.chain.stages[-2] for r in (before[0], after[0])]
        assert [*kept[0].mean, *kept[0].std] == pytest.approx([*kept[1].mean, *kept[1].std], rel=1e-12)
        assert before[0].chain.stages[0].labels == after[0].chain.stages[0].labels == ["a", "b"]
        sets = [sorted((r["y"], *r["features"]) for r in own.rows.collect()) for own in (before[0], after[0])]
        assert len(sets[0]) == len(sets[1]) and np.allclose(sets[0], sets[1], rtol=1e-9)
        assert "zz" in after[1].chain.stages[0].labels  # there the changed rows are training rows
        seen = after[0].chain.transform(rows.where("fold = 0"))
        assert seen.count() == rows.where("fold = 0").count()


def test_training_rows_do_not_depend_on_partitions(spark, rng):
    df = frame(spark, id=np.arange(200), x=rng.normal(size=200), y=(np.arange(200) % 5 == 0).astype(int))
    chain = learning.preprocessor(passthrough=["x"])
    first, second = (learning.prepare(df.repartition(n), chain, "id", "y", "smote").rows.collect() for n in (2, 7))
    assert [r["id"] for r in first] == [r["id"] for r in second] and len(first) == len(second)  # order included


def test_resampling_reads_kept_rows(spark, rng, monkeypatch, capsys):
    """Resampling reads its rows many times, so they come without the chain's functions behind them."""
    df = frame(spark, id=np.arange(200), x=rng.normal(size=200), c=np.where(np.arange(200) % 3 == 0, "a", "b"), y=(np.arange(200) % 5 == 0).astype(int))
    plans = []

    def spy(rows, *rest):
        capsys.readouterr()
        rows.explain()
        plans.append(capsys.readouterr().out)
        return rows
    monkeypatch.setattr(learning, "resample", spy)
    own = learning.prepare(df, learning.preprocessor(categorical=["c"], scaled=["x"]), "id", "y", "smote")
    assert len(plans) == 1 and "Plan" in plans[0] and "UDF" not in plans[0]
    assert own.rows.count() == 200 and own.rows.columns == ["id", "y", "features", "balanced_weight", "positive_weight"]


def test_training_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    got = {r["y"]: (r["balanced_weight"], r["positive_weight"]) for r in learning.with_training_weights(df, "y").collect()}
    assert got == {0: (8 / 12, 1.0), 1: (2.0, 4.5)}
    assert learning.with_training_weights(df.where("y = 0"), "y").select("positive_weight").distinct().collect()[0][0] == 1.0


def test_together_keeps_order_and_raises(spark):
    assert learning.run_together([lambda i=i: spark.range(i).count() for i in range(20)], 4) == list(range(20))
    assert learning.run_together([]) == []
    with pytest.raises(ZeroDivisionError):
        learning.run_together([lambda: 1 / 0, lambda: 1])


def test_tails_at_many_degrees_of_freedom():
    for dof in (2e6, 1e10, 1e14):
        assert dist.t_two_sided(2.0, dof) == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-5)
    d = 1.1e6  # both forms at the same degrees of freedom, just beyond the change
    assert dist.t_two_sided(2.0, d) == pytest.approx(dist.beta_cdf(d / (d + 4.0), d / 2.0, 0.5), rel=1e-8)
    assert dist.f_sf(4.0, 1.0, 1e12) == pytest.approx(dist.t_two_sided(2.0, 1e12), rel=1e-12)
    assert dist.f_sf(3.0, 2.0, 1e12) == pytest.approx(math.exp(-3.0), rel=1e-9)


def test_rows_without_a_label_stay_in_the_split(spark):
    df = spark.range(50).selectExpr("id", "case when id < 30 then 1 when id < 40 then 0 end as y")
    parts = learning.stratified_split(df, "id", "y", {"train": 0.7, "test": 0.3})
    found = {(r["y"], r["split"]): r["count"] for r in parts.groupBy("y", "split").count().collect()}
    assert found == {(1, "train"): 21, (1, "test"): 9, (0, "train"): 7, (0, "test"): 3, (None, "train"): 7, (None, "test"): 3}
    weighted = learning.with_class_weights(df, "y")
    assert weighted.count() == 50 and weighted.where("weight is null").count() == 10


def test_scores_that_are_no_numbers_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, float("nan")), (0, None)], "y int, s double")
    row = metrics.threshold_counts(df, "y", "s", [0.5]).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1, 0, 1, 0)


def test_trees_draw_without_replacement(spark):
    df = spark.range(300).selectExpr("id", "cast(id as double) as x")
    forest = anomaly.fit_forest(df, "id", ["x"], n_trees=4, sample=200)
    assert forest.sample == 200
    assert anomaly.fit_forest(df, "id", ["x"], n_trees=2, sample=500).sample == 300
