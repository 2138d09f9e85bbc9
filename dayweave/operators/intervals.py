"""Joins of samples, intervals and events on time.

Spark has no interval join and a plain inequality join compares all pairs of a
key.  Two shapes are used instead:

* sums over intervals merge samples and edges in time order, which cuts the
  samples into segments without an edge inside.  Segments are summed once, then
  over a ladder of ever wider blocks; an interval adds up the few blocks that
  fill it.  The work grows with rows, never with pairs, and nothing outside an
  interval enters its sum;
* painting and overlaps put spans into a tree of time blocks, a few blocks per
  span however long it is, and reduce each block to one row before anything meets it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.operators import ordered
from dayweave.operators.ordered import BUCKET, time_bucket

DAY = 86_400
#: Blocks of segments get wider by 2^4 from level to level; ten levels hold 2^40 segments in their widest.
LADDER_BITS, LADDER_LEVELS = 4, 10
#: Levels above this one are summed from its blocks.
LADDER_BASE = 2
#: Blocks of time get wider by 2^2 from level to level.
TREE_BITS, TREE_LEVELS = 2, 13
#: Beyond every count.
FAR = 1 << 62


def intervals_from_events(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str] = (), bucket_seconds: int = DAY
) -> DataFrame:
    """Each event lasts until the next one: ``start_ts, end_ts`` and ``<c>_next``."""
    out = ordered.next_row(df, list(keys), [ts, tie], [ts, *cols], time_bucket(ts, bucket_seconds))
    return out.withColumnRenamed(f"{ts}_next", "end_ts").withColumn("start_ts", F.col(ts))


# --- sums over intervals -------------------------------------------------------------

def _seconds(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / F.lit(1e6)


def _edges(intervals: DataFrame, keys, interval_id: str, start_rank: int, end_rank: int) -> DataFrame:
    """Two rows per interval; the rank orders an edge against samples (rank 1)."""
    both = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("start_ts").alias("ts"), F.lit(start_rank).alias("rank")),
        F.struct(F.lit(1).alias("sign"), F.col("end_ts").alias("ts"), F.lit(end_rank).alias("rank")),
    )
    return intervals.select(*keys, interval_id, F.explode(both).alias("e")).select(
        *keys, interval_id, "e.sign", "e.ts", "e.rank"
    )


def _shifted(direction: str, x: Column, bits: Column) -> Column:
    return F.call_function(f"shift{direction}", x, bits)


def _ranges(low: Column, high: Column, bits: int = LADDER_BITS, levels: int = LADDER_LEVELS) -> Column:
    """Blocks ``(level, block)`` that together are the numbers ``low <= i < high``; those of a level are 2^bits times as wide as those below."""
    nothing = F.array().cast("array<bigint>")

    def run(first: Column, stop: Column) -> Column:
        return F.when(first < stop, F.sequence(first, stop - 1)).otherwise(nothing)

    def edges(level: Column) -> tuple[Column, Column]:
        shift = level * bits
        return _shifted("right", low + _shifted("left", F.lit(1).cast("long"), shift) - 1, shift), _shifted("right", high, shift)

    def at(level: Column) -> Column:
        first, stop = edges(level)
        inner, outer = (F.shiftleft(c, bits) for c in edges(level + 1))
        cut = F.when((level + 1 < levels) & (inner <= outer), F.concat(run(first, inner), run(outer, stop))).otherwise(run(first, stop))
        return F.transform(F.when(first < stop, cut).otherwise(nothing), lambda block: F.struct(level.alias("level"), block.alias("block")))

    # no block is wider than the range
    bit_length = F.length(F.bin(high - low))
    widest = F.least(F.lit(levels - 1), F.floor((bit_length - 1) / bits).cast("int"))
    return F.flatten(F.transform(F.sequence(F.lit(0), widest), at))


def _sums_of_ranges(ranges: DataFrame, segments: DataFrame, keys: list[str], interval_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """``_sum`` and ``n`` of the segments ``_low <= _seg < _high``; ``segments`` has rows with ``_seg, _v, _k``."""
    once = segments.groupBy(*keys, "_seg").agg(F.sum("_v").alias("_v"), F.sum("_k").alias("_k")).where(F.col("_k") > 0)
    def raised(rows: DataFrame, first: int, last: int) -> DataFrame:
        """Sums of the blocks of some levels, from those of ``first`` or lower."""
        rows = rows.withColumn("_level", F.explode(F.sequence(F.lit(first), F.lit(last))))
        rows = rows.withColumn("_block", F.expr(f"shiftright(_seg, {LADDER_BITS} * _level)"))
        return rows.groupBy(*keys, "_level", "_block").agg(F.sum("_v").alias("_v"), F.sum("_k").alias("_k"))

    # the upper levels are summed from the blocks of a lower one, which are far fewer than segments
    lower = raised(once, 0, LADDER_BASE)
    base = lower.where(F.col("_level") == LADDER_BASE).select(*keys, F.shiftleft("_block", LADDER_BITS * LADDER_BASE).alias("_seg"), "_v", "_k")
    blocks = lower.unionByName(raised(base, LADDER_BASE + 1, LADDER_LEVELS - 1))
    pieces = ranges.select(*keys, interval_id, *keep, F.explode_outer(F.when(F.col("_low") < F.col("_high"), _ranges(F.col("_low"), F.col("_high")))).alias("_p"))
    pieces = pieces.select(*keys, interval_id, *keep, F.col("_p.level").alias("_level"), F.col("_p.block").alias("_block"))
    return (
        pieces.join(blocks, [*keys, "_level", "_block"], "left")
        .groupBy(*keys, interval_id)
        .agg(F.sum("_v").alias("_sum"), F.coalesce(F.sum("_k"), F.lit(0)).alias("n"), *[F.max(c).alias(c) for c in keep])
    )


def aggregate_in_intervals(
    intervals: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    interval_id: str = "interval_id",
    value: str = "value",
    start_inclusive: bool = True,
    end_inclusive: bool = False,
    bucket_seconds: int = DAY,
) -> DataFrame:
    """``total``, ``n`` and ``mean`` of the samples inside every interval.

    Edges cut the samples of a key into numbered segments; an interval is a
    range of them.  Intervals without samples, with an edge missing or the end
    before the start get total and mean NULL and n 0.
    """
    keys = list(keys)
    points = samples.select(
        *keys,
        F.lit(None).cast(intervals.schema[interval_id].dataType).alias(interval_id),
        F.lit(None).cast("int").alias("sign"),
        "ts",
        F.lit(1).alias("rank"),
        F.lit(0).cast("long").alias("_edge"),
        F.col(value).cast("double").alias("_v"),
        F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long").alias("_k"),
    )
    # an edge ranked before the samples of its instant opens a segment that holds them
    edges = _edges(intervals, keys, interval_id, 0 if start_inclusive else 2, 2 if end_inclusive else 0)
    edges = edges.withColumns({"_edge": F.lit(1).cast("long"), "_v": F.lit(None).cast("double"), "_k": F.lit(0).cast("long")})
    run = ordered.scan(points.unionByName(edges), keys, ["ts", "rank"], time_bucket("ts", bucket_seconds), sums={"_seg": "_edge"})
    at = {sign: F.max(F.when((F.col("sign") == sign) & F.col("ts").isNotNull(), F.col("_seg"))) for sign in (-1, 1)}
    ranges = run.where(F.col("sign").isNotNull()).groupBy(*keys, interval_id).agg(at[-1].alias("_low"), at[1].alias("_high"))
    sums = _sums_of_ranges(ranges, run.where(F.col("sign").isNull()), keys, interval_id)
    return sums.select(
        *keys,
        interval_id,
        "n",
        F.col("_sum").alias("total"),
        F.try_divide("_sum", "n").alias("mean"),
    )


def prorate_in_intervals(
    intervals: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    interval_id: str = "interval_id",
    value: str = "value",
    tie: str = "sample_id",
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Share of every sample's value by overlap with the interval.

    A sample owns the time until the next sample; the last owns nothing.  The
    owner of an edge is a segment of its own, so an interval is the shares of
    the two owners plus the whole segments between them.  NULL if the interval
    reaches out of the samples or ends before its start.
    """
    keys = list(keys)
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    points = samples.select(
        *keys,
        F.lit(None).cast(intervals.schema[interval_id].dataType).alias(interval_id),
        F.lit(None).cast("int").alias("sign"),
        "ts",
        F.lit(1).alias("rank"),
        F.col(tie).cast("long").alias("_tie"),
        F.lit(1).cast("long").alias("_k"),
        amount.alias("_v"),
        F.struct(F.col("ts").alias("t"), amount.alias("v")).alias("owner"),
    )
    edges = _edges(intervals, keys, interval_id, 2, 2).withColumns(
        {
            "_tie": F.lit(0).cast("long"),
            "_k": F.lit(0).cast("long"),
            "_v": F.lit(0.0),
            "owner": F.lit(None).cast(points.schema["owner"].dataType),
        }
    )
    order = ["ts", "rank", "_tie"]
    merged = points.unionByName(edges).withColumn(BUCKET, time_bucket("ts", bucket_seconds))
    near = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    # a sample next to an edge, or at the rim of a bucket, opens a segment
    alone = (F.coalesce(F.lag("_k").over(near), F.lit(0)) == 0) | (F.coalesce(F.lead("_k").over(near), F.lit(0)) == 0)
    merged = merged.withColumn("_new", F.when((F.col("_k") == 1) & alone, 1).otherwise(0).cast("long"))
    seen = ordered.scan(
        merged,
        keys,
        order,
        F.col(BUCKET),
        sums={"_seg": "_new", "_rank_k": "_k"},
        lasts={"at": "owner"},
        after={"follow": "owner"},
    )
    at, follow = F.col("at"), F.col("follow")
    edge = F.struct(F.col("_seg").alias("seg"), _seconds("ts").alias("s"), _seconds(at["t"]).alias("t"), at["v"].alias("v"), _seconds(follow["t"]).alias("next"))
    starts_after = at.isNotNull() & follow.isNull()
    ends_before = at.isNull() | ((F.col("_rank_k") == 1) & (at["t"] == F.col("ts")))
    outside = F.col("ts").isNull() | F.when(F.col("sign") == -1, starts_after).otherwise(ends_before)
    ranges = (
        seen.where(F.col("sign").isNotNull())
        .groupBy(*keys, interval_id)
        .agg(
            F.max(F.when(F.col("sign") == -1, edge)).alias("_from"),
            F.max(F.when(F.col("sign") == 1, edge)).alias("_to"),
            F.max(outside.cast("int")).alias("_out"),
        )
        .withColumns({"_low": F.col("_from")["seg"] + 1, "_high": F.col("_to")["seg"]})
    )
    sums = _sums_of_ranges(ranges, seen.where(F.col("sign").isNull()), keys, interval_id, ["_from", "_to", "_out"])
    first, last = F.col("_from"), F.col("_to")

    def share(edge: Column, begin: Column, end: Column) -> Column:
        part = F.try_divide(end - begin, edge["next"] - edge["t"])
        return F.when(part > 0, edge["v"] * part).otherwise(F.lit(0.0))

    across = share(first, first["s"], first["next"]) + F.coalesce("_sum", F.lit(0.0)) + share(last, last["t"], last["s"])
    total = F.when(first["seg"] == last["seg"], share(first, first["s"], last["s"])).otherwise(across)
    inside = (F.col("_out") == 0) & (first["s"] <= last["s"])
    return sums.select(*keys, interval_id, F.when(inside, total).alias("total"))


def count_rounded(intervals: DataFrame, samples: DataFrame, keys: Sequence[str], interval_id: str = "interval_id", value: str = "value") -> DataFrame:
    """Sum in [start, end) after rounding the edges to whole seconds."""
    from dayweave.functions.expressions import round_to_second

    rounded = intervals.withColumns({"start_ts": round_to_second("start_ts"), "end_ts": round_to_second("end_ts")})
    return aggregate_in_intervals(rounded, samples, keys, interval_id, value)


# --- covers: a tree of time blocks -----------------------------------------------------

def _blocks(df: DataFrame, keys: list[str], low: Column, high: Column, seconds: int, *cols: str, inner: bool = True, edges: bool = True) -> DataFrame:
    """Time blocks that together are ``low <= t <= high`` (microseconds), as rows ``level, block, low, high``.

    Whole blocks of the tree have a level and no limits; what is left of the two
    outer blocks has level -1 and keeps its limits.  However long a span is, it
    gives a few rows per level of the tree; one with a wrong year gives no more.
    Where whole blocks and edges go separate ways, each is asked for alone, so that
    the tree is worked out once.
    """
    span = F.lit(seconds * 1_000_000)
    df = df.select(*keys, *cols, low.alias("low"), high.alias("high")).where("low <= high")
    df = df.withColumns({"_from": F.floor((F.col("low") + span - 1) / span).cast("long"), "_until": F.floor((F.col("high") + 1) / span).cast("long")})
    first, stop = F.col("_from"), F.col("_until")
    kind = "array<struct<level:int,block:bigint,low:bigint,high:bigint>>"

    def edge(block: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(-1).alias("level"), block.alias("block"), a.cast("long").alias("low"), b.cast("long").alias("high"))

    none = F.array().cast(kind)
    tree = F.transform(_ranges(first, stop, TREE_BITS, TREE_LEVELS), lambda r: F.struct(r["level"].alias("level"), r["block"].alias("block"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    left = F.when(F.col("low") < first * span, F.array(edge(first - 1, F.col("low"), first * span - 1))).otherwise(none)
    right = F.when(F.col("high") >= stop * span, F.array(edge(stop, stop * span, F.col("high")))).otherwise(none)
    inside = F.array(edge(first - 1, F.col("low"), F.col("high")))
    found = ([F.when(first < stop, tree).otherwise(none)] if inner else []) + ([left, right] if edges else [])
    parts = F.when(first > stop, inside if edges else none).otherwise(F.concat(*found).cast(kind))
    return df.select(*keys, *cols, F.explode(parts).alias("_b")).select(*keys, *cols, "_b.*")


def _up(df: DataFrame, spans: DataFrame, low: Column, high: Column, seconds: int) -> DataFrame:
    """Every row of ``df`` with each level that blocks inside the ``spans`` can have and its block there, from its lowest ``block``."""
    width = F.max(F.when(low <= high, high - low + 1))
    wide = [(width >= F.lit(min(seconds * 1_000_000 << TREE_BITS * level, FAR))).cast("int") for level in range(TREE_LEVELS)]
    top = spans.agg((sum(wide, F.lit(0)) - 1).alias("_top"))
    levels = F.explode(F.sequence(F.lit(0), F.col("_top")))
    rows = ordered.attach(df, [], top).where("_top >= 0").withColumn("level", levels).drop("_top")
    return rows.withColumn("_block", F.expr(f"shiftright(block, {TREE_BITS} * level)"))


def _block_of(us: Column, seconds: int) -> Column:
    return F.floor(us / F.lit(seconds * 1_000_000)).cast("long")


def covering(points: DataFrame, point_id: str, us: Column, spans: DataFrame, low: Column, high: Column, keys: Sequence[str], found: dict[str, tuple], seconds: int) -> DataFrame:
    """``keys, point_id`` and aggregates over the spans ``low <= us <= high`` that cover each point; uncovered points are left out.

    ``found`` maps a name to (``F.max`` or ``F.min``, column of the spans).  Spans are
    reduced to one row per block of a tree of time blocks; the blocks over each lowest
    block that has points are reduced to one row again, so a point meets that row
    and the spans with an edge in its block.
    """
    keys, names = list(keys), list(found)
    aggs = [fn(c).alias(c) for c, (fn, _) in found.items()]
    marked = spans.withColumns({c: col for c, (_, col) in found.items()})
    whole = _blocks(marked, keys, low, high, seconds, *names, edges=False).groupBy(*keys, "level", F.col("block").alias("_block")).agg(*aggs)
    at = points.select(*keys, F.col(point_id).alias("_point"), us.alias("_us")).withColumn("block", _block_of(F.col("_us"), seconds))
    above = _up(at.select(*keys, "block").distinct(), spans, low, high, seconds).join(whole, [*keys, "level", "_block"]).groupBy(*keys, "block").agg(*aggs)
    edges = _blocks(marked, keys, low, high, seconds, *names, inner=False).groupBy(*keys, "block", "low", "high").agg(*aggs)
    ever = F.lit(None).cast("long")
    near = edges.unionByName(above.withColumns({"low": ever, "high": ever}))
    hits = at.join(near, [*keys, "block"]).where(F.col("low").isNull() | F.col("_us").between(F.col("low"), F.col("high")))
    return hits.groupBy(*keys, "_point").agg(*aggs).withColumnRenamed("_point", point_id)


def within(spans: DataFrame, span_id: str, low: Column, high: Column, points: DataFrame, us: Column, keys: Sequence[str], found: dict[str, tuple], seconds: int) -> DataFrame:
    """``keys, span_id`` and aggregates over the points with ``low <= us <= high``; empty spans are left out.

    ``found`` is as in ``covering``, of columns of the points.  Points are reduced to one row
    per block of the tree; a span reads its few blocks and the points of its two outer ones.
    """
    keys, names = list(keys), list(found)
    aggs = [fn(c).alias(c) for c, (fn, _) in found.items()]
    marked = spans.withColumn("_span", F.col(span_id))
    at = points.select(*keys, us.alias("_us"), *[col.alias(c) for c, (_, col) in found.items()]).withColumn("block", _block_of(F.col("_us"), seconds))
    lowest = at.groupBy(*keys, "block").agg(*aggs)
    tree = _up(lowest, marked, low, high, seconds).groupBy(*keys, "level", "_block").agg(*aggs)
    inner = _blocks(marked, keys, low, high, seconds, "_span", edges=False).withColumnRenamed("block", "_block").join(tree, [*keys, "level", "_block"])
    outer = _blocks(marked, keys, low, high, seconds, "_span", inner=False).join(at, [*keys, "block"]).where(F.col("_us").between(F.col("low"), F.col("high")))
    both = inner.select(*keys, "_span", *names).unionByName(outer.select(*keys, "_span", *names))
    return both.groupBy(*keys, "_span").agg(*aggs).withColumnRenamed("_span", span_id)


def paint_samples(
    samples: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    sample_id: str,
    values: Sequence[str],
    priority: Sequence[str],
    bucket_seconds: int = 1800,
) -> DataFrame:
    """Values of the highest-priority interval covering each sample ([start, end]).

    All samples stay; uncovered ones get NULL.  See ``covering``.
    """
    keys = list(keys)
    best = F.struct(F.struct(*priority).alias("rank"), F.struct(*values).alias("vals"))
    chosen = covering(
        samples, sample_id, F.unix_micros("ts"), intervals, F.unix_micros("start_ts"), F.unix_micros("end_ts"), keys, {"_best": (F.max, best)}, bucket_seconds
    )
    return samples.join(chosen, keys + [sample_id], "left").select(
        *[F.col(c) for c in samples.columns], *[F.col("_best")["vals"][v].alias(v) for v in values]
    )


def override_in_intervals(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], sample_id: str, value: str, constant: float, bucket_seconds: int = 1800) -> DataFrame:
    """Samples inside any of the intervals ([start, end]) get a constant."""
    marked = paint_samples(
        samples,
        intervals.withColumns({"_mark": F.lit(1), "_prio": F.lit(0)}),
        keys,
        sample_id,
        ["_mark"],
        ["_prio"],
        bucket_seconds,
    )
    new = F.when(F.col("_mark") == 1, F.lit(constant)).otherwise(F.col(value))
    return marked.withColumn(value, new).drop("_mark")


def overlap_labels(
    intervals: DataFrame,
    taps: DataFrame,
    keys: Sequence[str],
    interval_id: str = "interval_id",
    label: str = "label",
    seq: str = "seq",
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Label of the last overlapping tap and overlap share of the first one.

    A tap matches when start < tap end and end >= tap start: it covers the
    interval's start or it starts inside the interval.
    """
    keys = list(keys)
    tap = {
        "_last": (F.max, F.struct(F.col(seq).alias("seq"), F.col(label).alias("label"))),
        "_first": (F.min, F.struct(F.col(seq).alias("seq"), F.unix_micros("start_ts").alias("a"), F.unix_micros("end_ts").alias("b"))),
    }
    start, end = F.unix_micros("start_ts"), F.unix_micros("end_ts")
    spans, taps = intervals.where("start_ts <= end_ts"), taps.where("start_ts <= end_ts")
    over = covering(spans, interval_id, start, taps, start, end - 1, keys, tap, bucket_seconds)
    inside = within(spans, interval_id, start + 1, end, taps, start, keys, tap, bucket_seconds)
    chosen = over.unionByName(inside).groupBy(*keys, interval_id).agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    joined = intervals.join(chosen, keys + [interval_id], "left")
    shared = (F.least(end, F.col("_first.b")) - F.greatest(start, F.col("_first.a"))) / F.lit(1e6)
    share = F.try_divide(shared, _seconds("end_ts") - _seconds("start_ts"))
    return joined.withColumns({"tap_label": F.col("_last.label"), "tap_share": F.when(F.col("_first").isNotNull(), share)}).drop("_last", "_first")


# --- event matching ---------------------------------------------------------------------

def greedy_next_match(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, hours: float = 24.0, bucket_seconds: int = DAY
) -> DataFrame:
    """One-to-one matching of each left event with the next free right event.

    A right event matches when it comes strictly later and within the limit; of
    right events at one instant only the first can match.  Left events wait in a
    queue that they leave from its front, matched or expired, so how many have left
    is all there is to know.  With E expired and A arrived, a right event takes
    that number from n to min(max(n, E) + 1, A).  Such steps compose to
    min(max(n + c, low), high): every time bucket becomes one row of three numbers,
    these are applied one after the other per key, and all buckets are matched
    side by side, also of a key without any gap.  Events without a time match nothing.
    """
    keys = list(keys)
    limit = int(hours * 3600e6)

    def events(df: DataFrame, kind: int, event_id: str, after: int = 0) -> DataFrame:
        return df.where(F.col("ts").isNotNull()).select(
            *keys, (F.unix_micros("ts") + after).alias("_us"), F.lit(kind).alias("_kind"), F.col(event_id).cast("string").alias("_id"), F.lit(int(kind == 2)).alias("_came"), F.lit(int(kind == 0)).alias("_gone")
        )

    # at one instant expired events go first and right events before left ones: a match must come later
    rows = events(left, 0, left_id, limit).unionByName(events(right, 1, right_id)).unionByName(events(left, 2, left_id))
    bucket = F.floor(F.col("_us") / F.lit(bucket_seconds * 1_000_000)).cast("long")
    rows = ordered.scan(rows, keys, ["_us", "_kind", "_id"], bucket, sums={"_arrived": "_came", "_expired": "_gone"}, keep_bucket=True)
    piece = [*keys, ordered.BUCKET]
    takers = rows.where("_kind = 1").groupBy(*piece, "_us").agg(F.min("_id").alias("_id"), F.max("_arrived").alias("_arrived"), F.max("_expired").alias("_expired"))
    takers = ordered.spread(takers, *piece)
    key_fields = [left.schema[k] for k in keys]
    bucket_field = T.StructField(ordered.BUCKET, T.LongType())
    step_schema = T.StructType([*key_fields, bucket_field, *[T.StructField(c, T.LongType()) for c in ("_add", "_low", "_high")]])
    entry_schema = T.StructType([*key_fields, bucket_field, T.StructField("_left", T.LongType())])
    match_schema = T.StructType([*key_fields, T.StructField("_arrived", T.LongType()), T.StructField("_taker", T.StringType())])

    def summarise(frames):
        last, add, low, high = None, 0, -FAR, FAR
        names = [f.name for f in step_schema.fields]
        for pdf in frames:
            done = []
            groups = pdf[piece].itertuples(index=False, name=None)
            for group, arrived, expired in zip(groups, pdf["_arrived"].tolist(), pdf["_expired"].tolist(), strict=True):
                if group != last:
                    if last is not None:
                        done.append((*last, add, low, high))
                    last, add, low, high = group, 0, -FAR, FAR
                add, low, high = add + 1, max(low, expired) + 1, min(max(high, expired) + 1, arrived)
            if done:
                yield pd.DataFrame(done, columns=names)
        if last is not None:
            yield pd.DataFrame([(*last, add, low, high)], columns=names)

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordered.BUCKET)
        n, entries = 0, []
        for add, low, high in zip(pdf["_add"].tolist(), pdf["_low"].tolist(), pdf["_high"].tolist(), strict=True):
            entries.append(n)
            n = min(max(n + add, low), high)
        return pdf.assign(_left=entries)[[f.name for f in entry_schema.fields]]

    def match(frames):
        last, n = None, 0
        for pdf in frames:
            out = []
            groups = pdf[piece].itertuples(index=False, name=None)
            for group, arrived, expired, entry, taker in zip(groups, *(pdf[c].tolist() for c in ("_arrived", "_expired", "_left", "_id")), strict=True):
                if group != last:
                    last, n = group, entry
                n = max(n, expired)
                if n < arrived:
                    n += 1
                    out.append((*group[:-1], n, taker))
            yield pd.DataFrame(out, columns=[f.name for f in match_schema.fields])

    steps = takers.sortWithinPartitions(*piece, "_us").mapInPandas(summarise, step_schema)
    entries = steps.groupBy(*keys).applyInPandas(enter, entry_schema)
    pairs = takers.join(entries, piece).sortWithinPartitions(*piece, "_us").mapInPandas(match, match_schema)
    waiting = rows.where("_kind = 2").select(*keys, "_arrived", F.col("_id").cast(left.schema[left_id].dataType).alias(left_id))
    return waiting.join(pairs, [*keys, "_arrived"]).select(*keys, left_id, F.col("_taker").cast(right.schema[right_id].dataType).alias(right_id))


def ordinal_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order_left: Sequence[str],
    order_right: Sequence[str],
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Pair the n-th row of a day on one side with the n-th on the other.

    The first order column of each side is its time.
    """
    from dayweave.operators.rolling import number_in_group

    a = number_in_group(left, keys, order_left, time_bucket(order_left[0], bucket_seconds))
    b = number_in_group(right, keys, order_right, time_bucket(order_right[0], bucket_seconds))
    return a.join(b, [*keys, "activity_n"])


def drop_days_with_repeats(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], label: str, bucket_seconds: int = 3600) -> DataFrame:
    """Remove every day on which two consecutive rows share a label.

    The first order column is the time.
    """
    group = [*keys, day]
    rows = df.select(*group, *order, label)
    rows = ordered.next_row(rows, group, list(order), [label], time_bucket(order[0], bucket_seconds), "_next")
    bad = rows.where(F.col(f"{label}_next") == F.col(label)).select(*group).distinct()
    return df.join(bad, group, "left_anti")


def lag_pairs(df: DataFrame, keys: Sequence[str], x: str, y: str, lags: Sequence[int], day: str = "day") -> DataFrame:
    """(day, lag, x at day, y at day + lag): long form of a lag self join."""
    shifts = F.explode(F.array(*[F.lit(int(k)) for k in lags])).alias("lag")
    left = df.select(*keys, day, F.col(x).alias("x"), shifts).withColumn("_at", F.date_add(day, F.col("lag")))
    right = df.select(*keys, F.col(day).alias("_at"), F.col(y).alias("y"))
    return left.join(right, [*keys, "_at"]).drop("_at")


def events_before(df: DataFrame, events: DataFrame, keys: Sequence[str], start, days: int = 30, day: str = "day") -> DataFrame:
    """Events in the ``days`` days before each day; NULL too close to the start."""
    keys = list(keys)
    marks = events.select(*keys, day).withColumn("_e", F.lit(1))
    merged = df.select(*keys, day, F.lit(1).alias("_d"), F.lit(0).alias("_e")).unionByName(
        marks.select(*keys, day, F.lit(0).alias("_d"), "_e")
    )
    per_day = merged.groupBy(*keys, day).agg(F.max("_d").alias("_d"), F.sum("_e").alias("_e"))
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -1)
    known = F.datediff(F.col(day), F.lit(start).cast("date")) >= days
    count = F.when(known, F.coalesce(F.sum("_e").over(w), F.lit(0)))
    counted = per_day.withColumn("num_events", count).where(F.col("_d") == 1).drop("_d", "_e")
    return df.join(counted, keys + [day], "left")


def step_points(intervals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Step function of an interval: 0 before, value at both ends, 0 after."""
    v, zero = F.col(value), F.lit(0.0)
    points = F.array(
        F.struct((F.col("start_s") - 1).alias("t"), zero.alias("level")),
        F.struct(F.col("start_s").alias("t"), v.alias("level")),
        F.struct(F.col("end_s").alias("t"), v.alias("level")),
        F.struct((F.col("end_s") + 1).alias("t"), zero.alias("level")),
    )
    return intervals.select(*keys, F.posexplode(points).alias("step", "p")).select(*keys, "step", "p.*")
