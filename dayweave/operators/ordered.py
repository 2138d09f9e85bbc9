"""Ordered operations that survive one huge key.

A plain window over an entity sends the whole entity to one task.  For
sample-level data these helpers split each entity into time buckets, work
inside a bucket, summarise every bucket to one row, run the window over those
summaries and join the result back.  Each task then sees one bucket, and the
only per-entity window runs over as many rows as the entity has buckets.

Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def time_bucket(ts: str, seconds: int) -> Column:
    """Number of the ``seconds``-wide bucket that holds timestamp ``ts``."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash rows over all shuffle partitions for work that is heavy per row.

    Adaptive execution merges small partitions by bytes, which would put many
    small but costly groups into one task; a partition count set here is kept
    as it is.  A window or grouping on the same columns needs no further shuffle.
    """
    if not cols:
        return df
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def attach(df: DataFrame, keys: list[str], summary: DataFrame, how: str = "inner") -> DataFrame:
    """Summary columns on every row: joined by key, or read as a scalar subquery
    when there is no key and the summary is one aggregated row."""
    if keys:
        return df.join(summary, list(keys), how)
    cols = summary.columns
    one = summary.select(F.struct(*cols).alias("_one")).scalar()
    return df.withColumn("_one", one).select(*df.columns, *[F.col("_one")[c].alias(c) for c in cols])


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Ordered per-entity columns in one two-level pass.

    Each argument maps a new column to a source column: ``sums`` is the
    inclusive running sum, ``lasts`` the last non-null value up to the row,
    ``before`` / ``after`` the nearest non-null value strictly before / after.
    ``bucket`` must not decrease along ``order``.  With ``keep_bucket`` the
    bucket column stays, so a following scan finds its rows already in place
    and the shuffle of the first one is reused.
    """
    sums, lasts, before, after = sums or {}, lasts or {}, before or {}, after or {}
    df = df if BUCKET in df.columns else df.withColumn(BUCKET, bucket)
    up = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    down = Window.partitionBy(*keys, BUCKET).orderBy(*[F.desc(c) for c in order])
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    later = down.rowsBetween(Window.unboundedPreceding, -1)

    position = F.struct(*order)
    backward = sorted(set(lasts.values()) | set(before.values()))
    forward = sorted(set(after.values()))
    summary = df.groupBy(*keys, BUCKET).agg(
        F.lit(1).alias("_one"),
        *[F.sum(c).alias(f"_sum_{c}") for c in sorted(set(sums.values()))],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_last_{c}") for c in backward],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_first_{c}") for c in forward],
    )
    over = Window.partitionBy(*keys).orderBy(BUCKET)
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys,
        BUCKET,
        *[F.sum(f"_sum_{c}").over(past).alias(f"_psum_{c}") for c in sorted(set(sums.values()))],
        *[F.last(f"_last_{c}", ignorenulls=True).over(past).alias(f"_past_{c}") for c in backward],
        *[F.last(f"_first_{c}", ignorenulls=True).over(future).alias(f"_next_{c}") for c in forward],
    )
    local = df.select(
        "*",
        *[F.sum(c).over(upto).alias(f"_u_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_u_{n}") for n, c in lasts.items()],
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"_u_{n}") for n, c in before.items()],
        *[F.last(c, ignorenulls=True).over(later).alias(f"_u_{n}") for n, c in after.items()],
    )
    joined = local.join(summary, keys + [BUCKET], "left")
    zero = F.lit(0)
    new = {n: F.coalesce(f"_u_{n}", zero) + F.coalesce(f"_psum_{c}", zero) for n, c in sums.items()}
    new.update({n: F.coalesce(f"_u_{n}", f"_past_{c}") for n, c in {**lasts, **before}.items()})
    new.update({n: F.coalesce(f"_u_{n}", f"_next_{c}") for n, c in after.items()})
    kept = [F.col(c) for c in df.columns if (keep_bucket or c != BUCKET) and c not in new]
    return joined.select(*kept, *[col.alias(n) for n, col in new.items()])


def running_sum(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column, suffix: str = "_run") -> DataFrame:
    """Inclusive running sum of each column (NULL counts as nothing)."""
    return scan(df, keys, order, bucket, sums={c + suffix: c for c in cols})


def carry_forward(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column, suffix: str = "") -> DataFrame:
    """Last non-null value of each column at or before the row."""
    return scan(df, keys, order, bucket, lasts={c + suffix: c for c in cols})


def _neighbour(df, keys, order, cols, bucket, suffix, side) -> DataFrame:
    packed = df.withColumn("_packed", F.struct(*cols))
    out = scan(packed, keys, order, bucket, **{side: {"_near": "_packed"}})
    return out.withColumns({c + suffix: F.col("_near")[c] for c in cols}).drop("_near", "_packed")


def next_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column, suffix: str = "_next") -> DataFrame:
    """Columns of the following row of the same entity."""
    return _neighbour(df, keys, order, cols, bucket, suffix, "after")


def previous_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column, suffix: str = "_prev") -> DataFrame:
    """Columns of the preceding row of the same entity."""
    return _neighbour(df, keys, order, cols, bucket, suffix, "before")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], extra: dict[str, Column] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size, with ``n_values`` and ``extra`` aggregates.

    A first pass keeps a mergeable sketch per group, whose values at ranks a little
    below and above a quantile surely enclose it.  A second pass counts what lies
    under such a bracket and sorts only what lies inside: 4 / ``accuracy`` of a group.  Rows
    are never shuffled for it; both passes combine before they send.  A
    group of at most ``accuracy`` values is all bracket.  Groups without a value have
    NULL quantiles.
    """
    keys, v, reach = list(keys), F.col(value).cast("double"), 2.0 / accuracy
    around = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs.values() for d in (-reach, reach)])
    sketch = df.groupBy(*keys).agg(F.percentile_approx(v, around, F.lit(accuracy)).alias("_cuts"), F.count(v).alias("n_values"), *[c.alias(n) for n, c in (extra or {}).items()])
    placed = attach(df.where(v.isNotNull()).select(*keys, v.alias("_v")), keys, sketch.select(*keys, "_cuts", "n_values"))

    def bracket(i: int) -> Column:
        low, high = F.get("_cuts", F.lit(2 * i)), F.get("_cuts", F.lit(2 * i + 1))
        whole = F.col("n_values") <= accuracy
        under = ~whole & (F.col("_v") < low)
        return F.struct(F.lit(i).alias("_q"), F.when(~under, F.col("_v")).alias("_value"), (whole | (F.col("_v") <= high)).alias("_in"))

    brackets = F.filter(F.array(*[bracket(i) for i in range(len(probs))]), lambda b: b["_in"])
    counts = placed.select(*keys, "n_values", F.inline(brackets)).groupBy(*keys, "n_values", "_q", "_value").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys, "_q").orderBy(F.asc_nulls_first("_value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_high", F.sum("_n").over(upto))

    def at(i: int, rank: Column) -> Column:
        hit = (F.col("_q") == i) & (F.col("_high") - F.col("_n") <= rank) & (rank < F.col("_high"))
        return F.max(F.when(hit, F.col("_value")))

    picks = {}
    for i, (name, p) in enumerate(probs.items()):
        rank = (F.col("n_values") - 1) * F.lit(float(p))
        picks |= {f"_{name}_a": at(i, F.floor(rank)), f"_{name}_b": at(i, F.ceil(rank)), f"_{name}_part": F.max(rank - F.floor(rank))}
    found = ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in picks.items()])
    out = attach(sketch.drop("_cuts"), keys, found, "left")
    for name in probs:
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        out = out.withColumn(name, a + (b - a) * F.col(f"_{name}_part"))
    return out.drop(*picks)
