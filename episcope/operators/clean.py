"""Row and column clean-up of raw extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions.expr import any_of, flag, logistic
from episcope.session import durable

# How the source extracts write "no value".
MISSING_MARKERS = ("X", "null", "NULL", "Null", "NA", "N/A", "")
BLANK_WORDS = ("", "nan", "none")
# Words that stand for "in the program" and "not in the program".
TRUE_TOKENS = ("1", "yes", "y", "true", "t", "intervention", "treated", "treatment", "program", "enrolled",
               "participant", "participated", "intervene", "cessation program")
FALSE_TOKENS = ("0", "no", "n", "false", "f", "control", "comparison", "baseline", "none", "not enrolled",
                "did not participate", "didn’t participate", "didnt participate", "usual care")
# Ordinal codes of survey answers.
EDUCATION_CODES = {"<HS": 0, "HS Grad": 1, "Some College": 2, "Associate": 3, "Bachelor": 4, "Graduate": 5}
INCOME_CODES = {"<25k": 0, "25k-49k": 1, "50k-74k": 2, "75k-99k": 3, "100k+": 4}


def rename_known(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; columns outside the map keep their name."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def unmapped_columns(df: DataFrame, names: Mapping[str, str]) -> list[str]:
    return [c for c in df.columns if c not in names]


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim every string column and every header."""
    types = dict(df.dtypes)
    return df.select(*[(F.trim(F.col(f"`{c}`")) if types[c] == "string" else F.col(f"`{c}`")).alias(c.strip())
                       for c in df.columns])


def coerce_rate(df: DataFrame, col: str, markers: Sequence[str] = MISSING_MARKERS) -> DataFrame:
    """Text to double. Markers become null, and so does text that is no number."""
    return df.withColumn(col, rate_value(col, markers))


def rate_value(col: str, markers: Sequence[str] = MISSING_MARKERS) -> Column:
    text = F.trim(F.col(col).cast("string"))
    number = F.when(~text.isin(*markers), text).try_cast("double")
    return F.when(~F.isnan(number), number)


def coercion_failures(df: DataFrame, cols: Sequence[str], markers: Sequence[str] = MISSING_MARKERS) -> DataFrame:
    """Per column: values that were neither a marker nor a number. One pass over the table."""
    counts = df.agg(*[
        F.count_if(F.col(c).isNotNull() & ~F.trim(F.col(c)).isin(*markers) & rate_value(c, markers).isNull()).alias(c)
        for c in cols])
    return counts.unpivot([], list(cols), "column", "n_failed")


def coerce_int(df: DataFrame, col: str) -> DataFrame:
    """Text or number to nullable integer; ``"12.0"`` counts as 12."""
    return df.withColumn(col, F.col(col).try_cast("double").try_cast("int"))


def mapping_value(col: str, mapping: Mapping, default: Column | None = None) -> Column:
    """Literal lookup. The map is part of the query text, so its size is fixed; larger tables belong in a join."""
    if len(mapping) > 500:
        raise ValueError("use enrich() for large lookups")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.col(col))
    return found if default is None else F.coalesce(found, default)


def lookup(df: DataFrame, col: str, mapping: Mapping, out: str, default=None, keep_unmapped: bool = False) -> DataFrame:
    """Dictionary lookup; unmapped values become null, ``default``, or stay as they are."""
    fallback = F.col(col) if keep_unmapped else (None if default is None else F.lit(default))
    return df.withColumn(out, mapping_value(col, mapping, fallback))


def replace_values(df: DataFrame, col: str, corrections: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(corrections), subset=[col])


def correction_counts(df: DataFrame, col: str, corrections: Mapping[str, str]) -> DataFrame:
    """How many rows each correction of :func:`replace_values` touches; corrections that touch none are listed with 0."""
    old = list(corrections)
    counted = df.agg(*[F.count_if(F.col(col) == F.lit(o)).alias(f"n{i}") for i, o in enumerate(old)])
    return counted.select(F.explode(F.array(*[F.struct(
        F.lit(o).alias("value"), F.lit(corrections[o]).alias("corrected"), F.col(f"n{i}").alias("n_rows"))
        for i, o in enumerate(old)])).alias("c")).select("c.*")


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def add_flag(df: DataFrame, out: str, condition: Column) -> DataFrame:
    return df.withColumn(out, flag(condition))


def structural_gap(season: str, gap_season: str, stratum: str, value: str, total: str = "Overall") -> Column:
    """1 where a sub-stratum has no value in a season that is known to have none."""
    return flag((F.col(season) == gap_season) & (F.col(stratum) != total) & F.col(value).isNull())


def one_hot(df: DataFrame, col: str, levels: Sequence, prefix: str, drop_first: bool = False) -> DataFrame:
    kept = list(levels)[1:] if drop_first else list(levels)
    return df.withColumns({f"{prefix}_{level}": flag(F.col(col) == F.lit(level)) for level in kept})


def bounded_levels(df: DataFrame, col: str, limit: int = 200) -> list:
    """Sorted distinct values of a category column; raises when there are more than ``limit``."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values; it is not a category")
    return sorted(r[0] for r in rows)


def normalize_binary(df: DataFrame, col: str, true_tokens: Sequence[str] = TRUE_TOKENS,
                     false_tokens: Sequence[str] = FALSE_TOKENS, out: str | None = None) -> DataFrame:
    """Free-text yes/no to 1/0.

    Known tokens win. When exactly two other values occur, the smaller becomes 0 and the larger 1; otherwise others
    are null. At most three of the other values reach the driver.
    """
    token = F.lower(F.trim(F.col(col).cast("string")))
    known = [*true_tokens, *false_tokens]
    rest = (df.select(token.alias("t")).where(F.col("t").isNotNull() & ~F.col("t").isin(*known))
            .distinct().limit(3).collect())
    value = F.when(token.isin(*true_tokens), 1).when(token.isin(*false_tokens), 0)
    if len(rest) == 2:
        low, high = sorted(r["t"] for r in rest)
        value = value.when(token == low, 0).when(token == high, 1)
    return df.withColumn(out or col, value)


def sentinel_to_null(df: DataFrame, col: str, sentinel=999) -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(sentinel)))


def treatment_flags(df: DataFrame, period: str, start: str, never=999) -> DataFrame:
    """``treated_group`` (ever treated), ``post_treatment`` and ``time_since_tx`` (null for the never treated)."""
    begin = F.nullif(F.col(start), F.lit(never))
    return df.withColumns({
        "treated_group": flag(begin.isNotNull()),
        "post_treatment": flag(begin.isNotNull() & (F.col(period) >= begin)),
        "time_since_tx": F.col(period) - begin,
    })


def group_code(df: DataFrame, keys: Sequence[str], out: str, small: int = 100_000) -> DataFrame:
    """Dense 1-based code of the combined keys in text order.

    A key table of at most ``small`` rows (counted first) is numbered in one window and broadcast. A larger one is
    range-sorted into a durable table and numbered with per-partition offsets.
    """
    name = F.concat_ws("_", *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys])
    named = df.withColumn("__name", name)
    distinct = named.select("__name").distinct()
    if distinct.count() <= small:
        coded = distinct.withColumn(out, F.row_number().over(Window.orderBy("__name")).cast("long"))
        return named.join(F.broadcast(coded), "__name", "left").drop("__name")
    mid = F.monotonically_increasing_id()
    placed = durable(distinct.orderBy("__name").withColumn("__mid", mid))
    part = F.shiftright("__mid", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per sort partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    coded = (placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
             .select("__name", (F.col("__off") + F.col("__mid") % F.lit(1 << 33) + 1).alias(out)))
    return named.join(coded, "__name", "left").drop("__name")


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(cols) if cols else None)


def exposure_terms(df: DataFrame, exposures: Sequence[str], foreign_born: str, smoking: Column,
                   workplace: Column) -> DataFrame:
    """Total exposure count, heavy exposure (3 or more), vulnerability (foreign born with 2 or more) and the
    smoking by workplace term, which takes conditions because the columns hold words."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in exposures[1:]), F.coalesce(F.col(exposures[0]), F.lit(0)))
    return df.withColumns({
        "total_exposure": total,
        "high_exposure": flag(total >= 3),
        "vulnerable": flag((F.col(foreign_born) == 1) & (total >= 2)),
        "smoking_workplace": flag(smoking & workplace),
    })


def risk_score(df: DataFrame, intercept: float, terms: Mapping[str, float], out: str) -> DataFrame:
    """Logistic probability from a linear predictor; each term is a SQL expression (a condition counts as 0/1)."""
    z = F.lit(float(intercept))
    for expression, weight in terms.items():
        z = z + F.expr(f"double({expression})") * F.lit(float(weight))
    return df.withColumn(out, logistic(z))


def drop_blank_rows(df: DataFrame, col: str, words: Sequence[str] = BLANK_WORDS) -> DataFrame:
    """Remove footer rows: a blank, ``nan`` or ``none`` in the key column."""
    return df.where(F.col(col).isNotNull() & ~F.lower(F.trim(F.col(col))).isin(*words))


def suffix_columns(df: DataFrame, cols: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in cols if c in df.columns})


def starts_with_any(col: str, prefixes: Sequence[str]) -> Column:
    return any_of([F.col(col).startswith(p) for p in prefixes])
