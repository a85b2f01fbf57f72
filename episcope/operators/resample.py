"""Bootstrap intervals. Draws come from hashes of (replicate, draw, seed) or a seeded generator, so results do not depend on
partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.operators.joins import enrich
from episcope.operators.ordered import running_totals
from episcope.session import durable


def _draws(sizes: DataFrame, keys: Sequence[str], replicates: int, size: str = "n") -> DataFrame:
    """One row per key, replicate and draw; replicates are spread over the cluster before the draws are made."""
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return reps.repartition(*keys, "rep").withColumn("draw", F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)))


def _pick(seed: int, n: Column, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), n).cast("long")


def percentile_ci(reps: DataFrame, keys: Sequence[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile limits over replicates (a fixed number per key)."""
    return reps.groupBy(*keys).agg(F.count(value).alias("n_reps"), F.percentile(value, low).alias("ci_low"),
                                   F.percentile(value, high).alias("ci_high"))


def bootstrap_ratio(df: DataFrame, keys: Sequence[str], unit: str, num: str, den: str, replicates: int = 1000,
                    seed: int = 88) -> DataFrame:
    """Ratio of two means with percentile limits, resampling units (seasons) in pairs.

    ``df`` is a summary table with one row per key and unit. Each replicate draws as many units as there are; a unit
    enters with its number of draws, and missing values are skipped in numerator and denominator on their own.
    Replicates whose denominator is not positive are left out; under ten of them there are no limits.
    """
    keys = list(keys)
    window = Window.partitionBy(*keys).orderBy(unit)  # one row per unit of a summary table
    units = df.select(*keys, unit, F.col(num).cast("double").alias("__g"), F.col(den).cast("double").alias("__r")).withColumn(
        "__idx", (F.row_number().over(window) - 1).cast("long"))
    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    drawn = _draws(sizes, keys, replicates).withColumn("__idx", _pick(seed, F.col("n"), "rep", "draw"))
    weights = drawn.groupBy(*keys, "rep", "__idx").agg(F.count(F.lit(1)).alias("w"))

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("w"))))

    reps = weights.join(units, [*keys, "__idx"]).groupBy(*keys, "rep").agg(mean("__g").alias("__g"), mean("__r").alias("__r"))
    ratio = reps.select(*keys, F.when(F.col("__r") > 0, F.col("__g") / F.col("__r")).alias("ratio"))
    limits = percentile_ci(ratio, keys, "ratio")
    point = units.groupBy(*keys).agg(F.count("__g").alias("n_units"), F.avg("__g").alias("mean_num"),
                                     F.avg("__r").alias("mean_den"), F.sum("__r").alias("sum_den"))
    joined = point.join(limits, keys) if keys else point.withColumns(
        {c: limits.select(c).scalar() for c in ("n_reps", "ci_low", "ci_high")})
    ok = F.col("n_reps") >= 10
    return joined.select(
        *keys, "n_units", "mean_num", "mean_den",
        F.when(F.col("sum_den") != 0, F.try_divide(F.col("mean_num"), F.col("mean_den"))).alias("ratio"),
        F.when(ok, F.col("ci_low")).alias("ci_low"), F.when(ok, F.col("ci_high")).alias("ci_high"))


def rate_ratio_table(df: DataFrame, phase: str, season: str, group: str, rate: str, reference: str,
                     groups: Sequence[str], note: str | None = None, replicates: int = 1000, seed: int = 88) -> DataFrame:
    """Rate ratios against a reference group by phase.

    ``df`` has one row per phase, season and group with the end-of-season rate. Phases without any reference rate are
    left out; the reference has ratio 1 and its own row; a group without rates says "No data".
    """
    wide = df.groupBy(phase, season).agg(
        *[F.avg(F.when(F.col(group) == g, F.col(rate))).alias(f"r{i}") for i, g in enumerate([reference, *groups])],
        *([F.max(note).alias("__note")] if note else []))
    seen = wide.groupBy(phase).agg(F.count(F.lit(1)).alias("n_seasons"), F.count("r0").alias("ref_n"),
                                   F.avg("r0").alias("ref_mean"),
                                   *([F.concat_ws(", ", F.sort_array(F.collect_set("__note"))).alias("denom_note")]
                                     if note else []))
    seen = seen.where("ref_n > 0")
    long = wide.select(phase, season, "r0", F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.col(f"r{i + 1}").alias("rate")) for i, g in enumerate(groups)])).alias("s")
    ).select(phase, season, "r0", "s.*")
    boot = bootstrap_ratio(long, [phase, "grp"], season, "rate", "r0", replicates, seed)
    extra = ["denom_note"] if note else []
    shown = lambda c: F.format_string("%.2f", F.round(c, 2))
    rows = boot.join(seen, phase).select(
        phase, F.col("grp").alias("race_group"),
        F.when(F.col("n_units") == 0, F.col("n_seasons")).otherwise(F.col("n_units")).alias("n_seasons"),
        F.round("mean_num", 2).alias("mean_adj_rate"),
        F.when(F.col("n_units") == 0, "—").otherwise(shown("ratio")).alias("rr"),
        F.when(F.col("n_units") == 0, "No data").otherwise(F.concat(shown("ci_low"), F.lit("–"), shown("ci_high"))).alias("ci_95"),
        *extra)
    ref = seen.select(phase, F.lit(f"{reference} (reference)").alias("race_group"), "n_seasons",
                      F.round("ref_mean", 2).alias("mean_adj_rate"), F.lit("1.00").alias("rr"),
                      F.lit("Reference").alias("ci_95"), *extra)
    return rows.unionByName(ref)


def _value_counts(rows: DataFrame, value: str) -> DataFrame:
    return durable(rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))


def _against(a: DataFrame, b: DataFrame, cuts: Sequence[tuple[int, float]]) -> DataFrame:
    """For each numbered threshold t: the values ``at`` = a - t with their rows of A, and the rows (``cum_n``) and distinct
    values (``cum_d``) of B that are at or above, that is the pairs with difference at most t."""
    marks = F.array(*[F.struct(F.lit(i).alias("j"), F.lit(t).alias("t")) for i, t in cuts])
    left = a.withColumn("m", F.explode(marks)).select(
        F.col("m.j").alias("j"), (F.col("v") - F.col("m.t")).alias("at"), F.col("n").alias("na"), F.lit(1).cast("long").alias("da"),
        F.lit(0).cast("long").alias("nb"), F.lit(0).cast("long").alias("db"))
    right = b.withColumn("j", F.explode(F.array(*[F.lit(i) for i, _ in cuts]))).select(
        "j", F.col("v").alias("at"), F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("da"),
        F.col("n").alias("nb"), F.lit(1).cast("long").alias("db"))
    cells = left.unionByName(right).groupBy("j", "at").agg(*[F.sum(c).alias(c) for c in ("na", "da", "nb", "db")])
    return running_totals(cells, ["j"], "at", {"cum_n": "nb", "cum_d": "db"}, descending=True)


def _pairs_below(a: DataFrame, b: DataFrame, cuts: Sequence[float]) -> list[tuple[int, int]]:
    """Pairs of rows and of distinct values with difference at most each threshold."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    found = _against(a, b, list(enumerate(cuts))).where("da > 0").groupBy("j").agg(
        F.sum(wide("na") * wide("cum_n")).alias("rows"), F.sum(wide("da") * wide("cum_d")).alias("values")).collect()
    table = {r["j"]: (int(r["rows"]), int(r["values"])) for r in found}
    return [table.get(j, (0, 0)) for j in range(len(cuts))]


def difference_quantiles(a: DataFrame, b: DataFrame, groups: Sequence[Sequence[int]], steps: int = 32) -> dict[int, float]:
    """The values at 1-based ranks among all differences A - B, without writing all pairs out.

    ``a`` and ``b`` hold distinct values ``v`` with their rows ``n``; the ranks of a group lie close together. Thresholds
    are narrowed around the first and the last rank of each group by counting the pairs at or below them, which takes
    running totals over both value lists. Once such a band holds no more pairs of distinct values than eight times the
    values of both lists and half a million (or ends at neighbouring floating-point numbers, where each value of A meets
    few of B), the pairs of each group's bands and between them are listed, added up per difference and ranked. The driver
    holds the ranks and the thresholds only. Exact while a group spans fewer than 2^52 pairs of rows.
    """
    groups = [sorted(set(g)) for g in groups]
    ends = [t.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first() for t in (a, b)]
    room = 8 * (ends[0][2] + ends[1][2]) + 500_000
    margin = max(1.0, *[abs(x) for e in ends for x in e[:2]]) / 1000
    top = (max(g[-1] for g in groups), ends[0][2] * ends[1][2])
    whole = ((ends[0][0] - ends[1][1] - margin, (0, 0)), (ends[0][1] - ends[1][0] + margin, top))
    # Around each wanted end: a threshold with fewer pairs and one with enough, each with its counts.
    bands = {rank: whole for g in groups for rank in (g[0], g[-1])}
    while True:
        inner = set()
        for (lo, under), (hi, upto) in bands.values():
            if upto[1] - under[1] > room:
                inner |= {t for t in (lo + (hi - lo) * i / steps for i in range(1, steps)) if lo < t < hi}
        if not inner:
            break
        cuts = sorted(inner)
        found = list(zip(cuts, _pairs_below(a, b, cuts)))
        bands = {rank: (max([lo, *[c for c in found if c[1][0] < rank]]), min([hi, *[c for c in found if c[1][0] >= rank]]))
                 for rank, (lo, hi) in bands.items()}
    cuts = [t for g in groups for t in (bands[g[0]][0][0], bands[g[-1]][1][0])]
    edges = _against(a, b, list(enumerate(cuts))).where("da > 0").select("j", "at", "cum_d")
    marks = F.array(*[F.struct(F.lit(i).alias("j"), F.lit(t).alias("t")) for i, t in enumerate(cuts)])
    reach = a.withColumn("m", F.explode(marks)).select("v", "n", "m.j", (F.col("v") - F.col("m.t")).alias("at")).join(
        edges, ["j", "at"])
    end = F.col("j") % 2
    spans = reach.groupBy("v", "n", F.floor(F.col("j") / 2).cast("int").alias("g")).agg(
        F.max(F.when(end == 0, F.col("cum_d"))).alias("lo"), F.max(F.when(end == 1, F.col("cum_d"))).alias("hi")).where("hi > lo")
    # Places of B from its largest value down; a long span is cut before it is written out.
    chunk = 10_000
    pieces = spans.withColumn("lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(chunk).cast("long"))))
    pairs = pieces.select("g", F.col("v").alias("va"), F.col("n").alias("na"), F.explode(F.sequence(
        F.col("lo") + 1, F.least(F.col("lo") + chunk, F.col("hi")))).alias("place"))
    placed = running_totals(b.withColumn("one", F.lit(1).cast("long")), [], "v", {"place": "one"}, descending=True).select(
        "place", F.col("v").alias("vb"), F.col("n").alias("nb"))
    diffs = durable(enrich(pairs, placed, "place", how="inner").groupBy("g", (F.col("va") - F.col("vb")).alias("diff")).agg(
        F.sum(F.col("na") * F.col("nb")).alias("n")))
    ranked = running_totals(diffs, ["g"], "diff", {"upto": "n"})
    # One axis for all groups, each group's pairs counted from where the one before ends. Splits lie half-way between.
    starts = [0]
    for g in groups:
        starts.append(starts[-1] + bands[g[-1]][1][1][0] - bands[g[0]][0][1][0])
    wanted = [(starts[i] + r - bands[g[0]][0][1][0], r) for i, g in enumerate(groups) for r in g]
    splits = [-math.inf, *[w - 0.5 for w, _ in wanted], math.inf]
    base = F.array(*[F.lit(x).cast("long") for x in starts])[F.col("g")]
    for name, count in (("before", F.col("upto") - F.col("n")), ("upto", F.col("upto"))):
        ranked = Bucketizer(splits=splits, inputCol="__c", outputCol=f"__{name}").transform(
            ranked.withColumn("__c", (base + count).cast("double"))).drop("__c")
    hits = ranked.where("__upto > __before").select("diff", F.col("__before").cast("int").alias("first"),
                                                    F.col("__upto").cast("int").alias("last"))
    return {wanted[i][1]: r["diff"] for r in hits.collect() for i in range(r["first"], r["last"])}


def bootstrap_median_diff(df: DataFrame, group: str, a, b, value: str, replicates: int = 8000, seed: int = 1) -> DataFrame:
    """Median of paired differences A - B, both groups resampled to the size n of the smaller one, with limits.

    ``df`` has one row per episode; null and non-finite values are left out, a group without values is an error. The n differences of a
    replicate are independent draws from all pairs, so their middle ones are the differences at the middle order
    statistics of n uniform numbers. These are drawn directly (beta distributed, one or two numbers per replicate, on the
    driver) and only the few that decide the median and the limits over replicates are looked up among the pairs: no
    replicate is written out, whatever the size of the groups.
    """
    rows = df.where(F.abs(F.col(value).cast("double")) < math.inf)
    sides = [_value_counts(rows.where(F.col(group) == F.lit(level)), value) for level in (a, b)]
    sizes = [t.agg(F.sum("n")).first()[0] or 0 for t in sides]
    size = min(sizes)
    if size == 0:
        raise ValueError("both groups need values")
    middle = _middle_ranks(size, sizes[0] * sizes[1], replicates, np.random.default_rng(seed))
    limits = _replicate_percentiles(sides, middle, (0.5, 0.025, 0.975))
    return df.sparkSession.createDataFrame([(*limits, size)], "median_diff double, ci_low double, ci_high double, n_per_draw long")


def _middle_ranks(size: int, pairs: int, replicates: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Per replicate, the ranks among all pairs of its middle differences (the same one twice where the size is odd)."""
    lower = rng.beta((size + 1) // 2, size - (size + 1) // 2 + 1, replicates)
    # Above the lower middle one lie size/2 uniform numbers; the least of them is the upper middle one.
    upper = lower + (1 - lower) * rng.beta(1, size // 2, replicates) if size % 2 == 0 else lower
    rank = lambda u: min(pairs, int(Fraction(float(u)) * pairs) + 1)
    return [(rank(x), rank(y)) for x, y in zip(lower, upper)]


def _replicate_percentiles(sides: Sequence[DataFrame], middle: Sequence[tuple[int, int]], probs: Sequence[float]) -> list[float]:
    """Interpolated percentiles over replicates of the mean of their two middle differences.

    The k-th smallest mean lies between the differences at the k-th smallest lower and the k-th smallest upper rank.
    Replicates wholly under the first or wholly above the second are only counted; the others' differences are looked up.
    """
    lowers, uppers = sorted(m[0] for m in middle), sorted(m[1] for m in middle)
    picks = []
    for p in probs:
        at = (len(middle) - 1) * p
        floor, ceiling = lowers[math.floor(at)], uppers[math.ceil(at)]
        picks.append((at, sum(m[1] < floor for m in middle), [m for m in middle if m[1] >= floor and m[0] <= ceiling]))
    found = difference_quantiles(*sides, [[r for m in near for r in m] for _, _, near in picks])
    out = []
    for at, under, near in picks:
        means = sorted((found[x] + found[y]) / 2 for x, y in near)
        low, high = means[math.floor(at) - under], means[math.ceil(at) - under]
        out.append(low + (at - math.floor(at)) * (high - low))
    return out


def bootstrap_contrasts(df: DataFrame, group: str, pairs: Sequence[tuple], metrics: Mapping[str, str],
                        replicates: int = 8000, seed: int = 1) -> DataFrame:
    """The median difference for several pairs of groups and several metrics, one row each."""
    out = None
    for a, b in pairs:
        for label, col in metrics.items():
            row = bootstrap_median_diff(df, group, a, b, col, replicates, seed).select(
                F.lit(f"{a} - {b}").alias("comparison"), F.lit(label).alias("metric"), "*")
            out = row if out is None else out.unionByName(row)
    return out
