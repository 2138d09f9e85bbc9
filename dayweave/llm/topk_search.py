"""Exact top-k inner products with vectors grouped by length.

Candidates fall into buckets of similar length.  Every query first gets a lower
limit for its k-th product from a bounded set of the longest candidates.  In a
bucket the limit becomes a cosine threshold; above one the bucket is skipped, a
high one is checked on the query's largest coordinates (a candidate's share
there is bounded by the threshold), and a low one only cuts the bucket's
candidates by length.  What is left is verified by whole products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm import common

#: Queries of a block and candidates of a bucket; bounds a task's memory.
QUERY_BLOCK = 2048
BUCKET_ROWS = 16_384
#: Candidates that give the first lower limits.
SEED_ROWS = 2048
#: Lengths within a bucket differ by this factor at most.
LENGTH_STEP = 1.1
#: Local cosine threshold from which coordinates prune, and how many of them.
COORDINATE_FROM = 0.6
COORDINATES = 4
#: Whole numbers of this size and beyond are no 64-bit components.
LARGEST = 2.0**63


def quantize(df: DataFrame, scale: int = 64, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component as double.

    Rows whose id or vector is null, or that hold a null or non-finite
    component, are left out, and so are components beyond 64 bits themselves.
    """
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    good = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) * scale < LARGEST, F.lit(False)))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers held as doubles; those beyond 64 bits stand at its ends."""
    largest = max(np.abs(a).max(initial=0.0), 1.0) * max(np.abs(b).max(initial=0.0), 1.0) * a.shape[-1]
    if largest < 2**53:
        return a @ b.T
    if largest < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    # whole numbers of any size, for the few rows of a block that need them
    wide = np.flatnonzero(np.abs(a).max(axis=-1, initial=0.0) >= 2**26) if a.ndim == 2 else None
    if wide is not None and 0 < len(wide) < len(a):
        out = np.empty((len(a), len(b)) if b.ndim == 2 else len(a), dtype=np.int64)
        rest = np.setdiff1d(np.arange(len(a)), wide)
        out[rest], out[wide] = _products(a[rest], b), _products(a[wide], b)
        return out
    whole = np.dot(_integers(a), _integers(b).T)
    return np.vectorize(lambda x: min(max(x, -(2**63)), 2**63 - 1), otypes=[np.int64])(whole) if np.size(whole) else np.zeros(np.shape(whole), dtype=np.int64)


def _integers(a: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    out = np.empty(a.shape, dtype=object)
    out.ravel()[:] = [int(x) for x in a.ravel().tolist()]
    return out


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row, or minus infinity."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def _search(qid: np.ndarray, q: np.ndarray, limit: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """Pairs of one block and one bucket that may be among the k best of a query."""
    order = np.lexsort((cid, -np.linalg.norm(c, axis=1)))
    cid, c = cid[order], c[order]
    size = np.linalg.norm(c, axis=1)
    q_size = np.linalg.norm(q, axis=1)
    safe = limit - 0.5 - 1e-9 * np.abs(limit)
    queries, found, scores = [], [], []
    # the local cosine threshold; limits are lowered a little so that rounding loses no tie
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(safe > 0, safe / (q_size * size[0]), -np.inf) if size[0] > 0 else np.where(safe > 0, np.inf, -np.inf)
    live = np.flatnonzero(~(local > 1))
    by_coordinate = live[local[live] >= COORDINATE_FROM]
    by_length = live[local[live] < COORDINATE_FROM]
    unit = c / np.maximum(size, 1e-12)[:, None]
    for i in by_coordinate:
        # cosine is at most the part on the chosen coordinates plus the product of what is left of both
        d = np.argsort(-np.abs(q[i]))[:COORDINATES]
        u = q[i] / q_size[i]
        left = math.sqrt(max(0.0, 1.0 - float(u[d] @ u[d])))
        part = unit[:, d]
        bound = part @ u[d] + left * np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", part, part)))
        rows = np.flatnonzero(bound * size * q_size[i] * (1 + 1e-9) >= safe[i])
        if len(rows):
            _keep(qid[i], cid[rows], _products(c[rows], q[i]), safe[i], k, queries, found, scores)
    for a in range(0, len(by_length), 256):
        part = by_length[a : a + 256]
        lowest = np.min(np.where(safe[part] > 0, safe[part] / np.maximum(q_size[part], 1e-12), -np.inf))
        n = int(np.searchsorted(-size, -lowest, side="right"))  # candidates long enough for any of these queries
        if n:
            products = _products(q[part], c[:n])
            for row, i in enumerate(part):
                _keep(qid[i], cid[:n], products[row], safe[i], k, queries, found, scores)
    return queries, found, scores


def _keep(qid: int, cid: np.ndarray, score: np.ndarray, limit: float, k: int, queries: list, found: list, scores: list) -> None:
    rows = np.flatnonzero((score >= limit) & (cid != qid))
    if len(rows) > k:
        rows = rows[np.lexsort((cid[rows], -score[rows]))[:k]]
    queries.append(np.full(len(rows), qid))
    found.append(cid[rows])
    scores.append(score[rows].astype(np.int64))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, *, query_block: int = QUERY_BLOCK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of each query.

    Both inputs have (vec_id, v array<long>).  A product beyond 64 bits counts as the
    end of their range.  A query is never its own candidate.  Ties go to the smaller id; fewer candidates give fewer rows;
    shorter vectors are filled with zeros; repeated ids are candidates once per
    row and queries once.  Candidates meet queries in blocks: a task holds one
    block of queries and one bucket.
    """
    spark = candidates.sparkSession
    c = candidates.withColumn("squares", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).withColumn(
        "length_class", F.when(F.col("squares") == 0, F.lit(-1)).otherwise(F.floor(F.log("squares") / (2 * math.log(LENGTH_STEP)))).cast("int")
    )
    # one row per class of length: a few hundred at most, whatever the input
    classes = sorted(((r["length_class"], r["n"], r["w"]) for r in c.groupBy("length_class").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).collect()), reverse=True)
    queries = queries.dropDuplicates(["vec_id"])
    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max([stats["w"] or 0, 1, *(w for _, _, w in classes)])
    blocks = max(1, math.ceil(stats["n"] / query_block))
    splits = {b: math.ceil(n / bucket_rows) for b, n, _ in classes}
    first = dict(zip(splits, np.cumsum([0, *splits.values()]).tolist(), strict=False))
    buckets = sum(splits.values()) or 1

    # seeds: the longest classes, thinned by a hash of the id to a bounded number
    taken, seed_cut = 0, []
    for b, n, _ in classes:
        if taken < SEED_ROWS:
            want = min(n, SEED_ROWS - taken)
            seed_cut.append((b, want / n))
            taken += want
    share = F.lit(0.0)
    for b, s in seed_cut:
        share = F.when(F.col("length_class") == b, F.lit(s)).otherwise(share)
    seeds = c.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("vec_id", "v").limit(2 * SEED_ROWS).toPandas()
    seed = np.zeros((len(seeds), width))
    for i, v in enumerate(seeds["v"]):
        seed[i, : len(v)] = v
    seed_id = seeds["vec_id"].to_numpy(dtype=np.int64)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), width)
            scores = _products(q, seed).astype(np.float64)
            scores[ids[:, None] == seed_id[None, :]] = -np.inf
            limit = _kth(scores, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(np.isfinite(limit), limit, -(2.0**62)))], names=["vec_id", "v", "low"])

    q = common.arrow_map(queries.select("vec_id", "v"), limits, "vec_id long, v array<long>, low double")
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    q = q.select("block", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(0).alias("side"), "vec_id", "v", "low")
    bucket = F.lit(0)
    for b, s in splits.items():
        bucket = F.when(F.col("length_class") == b, F.lit(first[b]) + F.pmod(F.xxhash64("vec_id"), F.lit(s)).cast("int")).otherwise(bucket)
    c = c.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), bucket.alias("bucket"), F.lit(1).alias("side"), "vec_id", "v", F.lit(None).cast("double").alias("low"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and (held[0].column(0)[0] != part.column(0)[0] or held[0].column(1)[0] != part.column(1)[0]):
                    yield from _grid_cell(held, width, k)
                    held = []
                held.append(part)
        if held:
            yield from _grid_cell(held, width, k)

    cells = q.unionByName(c).repartition("block", "bucket").sortWithinPartitions("block", "bucket", "side", "vec_id")
    near = common.arrow_map(cells, verify, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grid_cell(parts: list[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    side = whole.column("side").to_numpy()
    n = int(np.searchsorted(side, 1))
    if n in (0, len(side)):
        return
    ids, v = whole.column("vec_id").to_numpy(), _matrix(whole.column("v").chunk(0), width)
    found = _search(ids[:n], v[:n], whole.column("low").slice(0, n).to_numpy(), ids[n:], v[n:], k)
    if found[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in found], names=["query_id", "vec_id", "score"])
