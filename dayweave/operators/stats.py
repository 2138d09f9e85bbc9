"""Significance tests and weighted / circular summaries on grouped rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.functions.pvalues import normal_two_sided, t_two_sided
from dayweave.operators.ordered import attach


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- rates --------------------------------------------------------------------

def poisson_z(n1, e1, n2, e2) -> Column:
    """Score statistic of two Poisson counts with exposures, equal rates."""
    n1, e1, n2, e2 = (_c(v).cast("double") for v in (n1, e1, n2, e2))
    d = F.try_divide(e1, e2)
    return F.try_divide(n1 - n2 * d, F.sqrt((n1 + n2) * d))


def rate_ratio(n_desc, e_desc, n_asc, e_asc) -> Column:
    """Ascending rate over descending rate."""
    up = F.try_divide(_c(n_asc).cast("double"), _c(e_asc).cast("double"))
    down = F.try_divide(_c(n_desc).cast("double"), _c(e_desc).cast("double"))
    return F.try_divide(up, down)


def poisson_test(df: DataFrame, n1: str, e1: str, n2: str, e2: str) -> DataFrame:
    """Adds ``z``, ``p_value`` and ``ratio`` (second rate over first)."""
    out = df.withColumn("z", poisson_z(n1, e1, n2, e2))
    return out.withColumns({"p_value": normal_two_sided(F.col("z")), "ratio": rate_ratio(n1, e1, n2, e2)})


def cycle_rate_tests(scores: DataFrame, days: DataFrame, keys: Sequence[str], with_p: bool = True) -> DataFrame:
    """Three rate tests of strain peaks against the pain cycle, one row each.

    Range 1 compares the whole descent with the ascent; range 2 counts the
    first fifth of the descent as ascent; range 3 the first fifth of the ascent
    as descent.  Exposures move with the ranges.
    """
    keys = list(keys)
    s = F.col("score")
    counts = scores.groupBy(*keys).agg(
        F.count(F.when((s >= -1) & (s < 0), 1)).alias("d1"),
        F.count(F.when((s >= 0) & (s <= 1), 1)).alias("a1"),
        F.count(F.when((s >= -0.8) & (s < 0), 1)).alias("d2"),
        F.count(F.when((s < -0.8) | (s >= 0), 1)).alias("a2"),
        F.count(F.when((s >= -1) & (s < 0.2), 1)).alias("d3"),
        F.count(F.when((s >= 0.2) & (s <= 1), 1)).alias("a3"),
    )
    both = attach(days, keys, counts, "left").fillna(0, subset=["d1", "a1", "d2", "a2", "d3", "a3"])
    down, up = F.col("desc_days"), F.col("asc_days")
    fifth = F.lit(0.2)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("range_id"),
                F.col(f"d{i}").alias("n_desc"),
                e_desc.cast("double").alias("e_desc"),
                F.col(f"a{i}").alias("n_asc"),
                e_asc.cast("double").alias("e_asc"),
            )
            for i, (e_desc, e_asc) in enumerate(
                [(down, up), (F.lit(0.8) * down, up + fifth * down), (down + up * fifth, up * F.lit(0.8))], 1
            )
        ]
    )
    long = both.select(*keys, F.inline(rows))
    if with_p:
        return poisson_test(long, "n_desc", "e_desc", "n_asc", "e_asc")
    return long.withColumns(
        {"z": poisson_z("n_desc", "e_desc", "n_asc", "e_asc"), "ratio": rate_ratio("n_desc", "e_desc", "n_asc", "e_asc")}
    )


# --- means ------------------------------------------------------------------------

def two_sample_t(df: DataFrame, keys: Sequence[str], group: str, value: str, first, second, equal_var: bool = True) -> DataFrame:
    """Student (pooled variance) or Welch t test between two groups."""
    x1 = F.when(F.col(group) == first, F.col(value))
    x2 = F.when(F.col(group) == second, F.col(value))
    m = df.groupBy(*keys).agg(
        F.count(x1).alias("n1"), F.count(x2).alias("n2"),
        F.avg(x1).alias("mean1"), F.avg(x2).alias("mean2"),
        F.var_samp(x1).alias("_v1"), F.var_samp(x2).alias("_v2"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    a, b = F.try_divide(F.col("_v1"), n1), F.try_divide(F.col("_v2"), n2)
    if equal_var:
        dof = n1 + n2 - 2
        pooled = F.try_divide((n1 - 1) * F.col("_v1") + (n2 - 1) * F.col("_v2"), dof)
        error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    else:
        dof = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
        error = F.sqrt(a + b)
    m = m.withColumns({"t": F.try_divide(F.col("mean1") - F.col("mean2"), error), "dof": dof})
    return m.withColumn("p_value", t_two_sided(F.col("t"), F.col("dof"))).drop("_v1", "_v2")


def pearson_test(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation, its t value and two-sided p value."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count(F.when(both, 1)).alias("n"))
    return with_pearson_p(out)


def with_pearson_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    dof = F.col(n).cast("double") - 2
    t = F.col(r) * F.sqrt(F.try_divide(dof, 1 - F.col(r) * F.col(r)))
    out = df.withColumn("t", F.when(dof > 0, t))
    exact = F.abs(F.col(r)) >= 1
    return out.withColumn("p_value", F.when(exact & (dof > 0), 0.0).otherwise(t_two_sided(F.col("t"), dof)))


# --- partial correlation -----------------------------------------------------------

def partial_correlations(df: DataFrame, keys: Sequence[str], targets: Sequence[str], cols: Sequence[str], min_link: float = 0.2, keep: float = 0.01) -> DataFrame:
    """Correlation of every (variable, target) with linked columns held fixed.

    The controls of a variable are the other columns whose correlation with it
    reaches ``min_link``.  One aggregation gathers all correlations; the rest
    is a solve on a matrix as wide as the column list, per key.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    keys, cols = list(keys), list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    rows = df.dropna(subset=cols)
    wide = rows.groupBy(*keys).agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs])
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("target", T.StringType()),
            T.StructField("variable", T.StringType()),
            T.StructField("controls", T.IntegerType()),
            T.StructField("partial_r", T.DoubleType()),
        ]
    )

    def solve(frames):
        for pdf in frames:
            out = []
            for _, row in pdf.iterrows():
                m = np.eye(len(cols))
                for i, j in pairs:
                    m[i, j] = m[j, i] = row[f"c{i}_{j}"]
                for t in targets:
                    for v in cols:
                        if v in targets:
                            continue
                        a, b = cols.index(v), cols.index(t)
                        ctl = [k for k in range(len(cols)) if k not in (a, b) and abs(m[a, k]) >= min_link]
                        block = m[np.ix_([a, b], [a, b])]
                        if ctl:
                            side = m[np.ix_([a, b], ctl)]
                            block = block - side @ np.linalg.pinv(m[np.ix_(ctl, ctl)]) @ side.T
                        spread = block[0, 0] * block[1, 1]
                        r = block[0, 1] / np.sqrt(spread) if spread > 1e-20 else np.nan
                        out.append([*(row[k] for k in keys), t, v, len(ctl), r])
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    found = wide.mapInPandas(solve, schema)
    return found.where(F.abs("partial_r") >= keep)


# --- weighted and circular ------------------------------------------------------------

def weighted_summary(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """Circular weighted mean / sd of x (in half turns), plain ones of y.

    Adds the Mahalanobis distance of the mean from 0 and its chi-squared(2)
    p value, which has the closed form exp(-d^2 / 2).
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull()
    # squares are taken around each key's mean, so a high level loses no digits
    centre = df.where(ok).groupBy(*[F.col(c).alias(f"_key_{c}") for c in keys]).agg(F.avg(y).alias("_centre"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    df = df.join(centre, same).drop(*[f"_key_{c}" for c in keys])
    w, gap = F.col(weight), F.col(y) - F.col("_centre")
    angle = F.lit(pi) * F.col(x)
    s = df.where(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("_w"),
        F.sum(w * F.sin(angle)).alias("_s"),
        F.sum(w * F.cos(angle)).alias("_c"),
        F.sum(w * gap).alias("_y"),
        F.sum(w * gap * gap).alias("_yy"),
        F.first("_centre").alias("_centre"),
    )
    sin, cos = F.try_divide(F.col("_s"), F.col("_w")), F.try_divide(F.col("_c"), F.col("_w"))
    length = F.sqrt(sin * sin + cos * cos)
    off = F.try_divide(F.col("_y"), F.col("_w"))
    s = s.withColumns(
        {
            "mean_x": F.atan2(sin, cos) / F.lit(pi),
            "sd_x": F.when(length > 0, F.sqrt(F.greatest(F.lit(-2.0) * F.log(length), F.lit(0.0))) / F.lit(pi)),
            "mean_y": F.col("_centre") + off,
            "sd_y": F.sqrt(F.greatest(F.try_divide(F.col("_yy"), F.col("_w")) - off * off, F.lit(0.0))),
        }
    )
    zx = F.try_divide(F.col("mean_x"), F.col("sd_x"))
    zy = F.try_divide(F.col("mean_y"), F.col("sd_y"))
    s = s.withColumn("mahalanobis", F.sqrt(zx * zx + zy * zy))
    d = F.col("mahalanobis")
    return s.withColumn("p_mahalanobis", F.exp(-d * d / 2)).drop("_w", "_s", "_c", "_y", "_yy", "_centre")


def hotelling_test(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Hotelling T-squared of the mean of (x, y) against 0.

    With two dimensions the F tail is (1 + 2F/(n-2))^(-(n-2)/2).
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    m = df.where(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_cxy"),
    )
    n = F.col("n").cast("double")
    det = F.col("_vx") * F.col("_vy") - F.col("_cxy") * F.col("_cxy")
    quad = (
        F.col("_mx") * F.col("_mx") * F.col("_vy")
        - 2 * F.col("_mx") * F.col("_my") * F.col("_cxy")
        + F.col("_my") * F.col("_my") * F.col("_vx")
    )
    m = m.withColumn("t2", n * F.try_divide(quad, det))
    m = m.withColumn("f", (n - 2) * F.col("t2") / (2 * (n - 1)))
    tail = F.pow(1 + F.try_divide(2 * F.col("f"), n - 2), -(n - 2) / 2)
    return m.withColumn("p_hotelling", F.when(n < 2, 1.0).when(n > 2, tail)).drop("_mx", "_my", "_vx", "_vy", "_cxy")


def significant_rows(df: DataFrame, p_cols: Sequence[str], order: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Rows where any p value is small enough, infinite ones dropped, sorted."""
    hit = F.lit(False)
    for p in p_cols:
        finite = F.abs(F.col(p)) != F.lit(float("inf"))
        hit = hit | F.coalesce((F.col(p) <= limit) & finite, F.lit(False))
    return df.where(hit).orderBy(*order)
