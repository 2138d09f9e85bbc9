"""Models: forests on the event matrix, and linear time-series models.

The linear models need only cross products.  Partitions add up their own
``X'X`` in Arrow batches, Spark sums the partial matrices, and the solve works
on a matrix as wide as the column list.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.functions.pvalues import gamma_upper
from dayweave.operators.scaling import ordered, whole
from dayweave.session import cut_lineage


# --- cross products ---------------------------------------------------------------

def gram_matrix(df: DataFrame, keys: Sequence[str], cols: Sequence[str], level: str | None = None) -> DataFrame:
    """``keys, level, i, j, v``: summed products of column pairs (i <= j).

    ``level`` names an integer column: a row counts for every level up to its
    value (rows with longer history serve shorter lags too).  Keys in a
    partition are flushed as they come, so memory holds one matrix set.
    """
    keys, k = list(keys), len(cols)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], (F.col(level) if level else F.lit(1)).cast("int").alias("level"))
    schema = T.StructType(
        [df.schema[c] for c in keys]
        + [T.StructField(n, T.IntegerType()) for n in ("level", "i", "j")]
        + [T.StructField("v", T.DoubleType())]
    )
    upper_i, upper_j = np.triu_indices(k)

    def partial(frames):
        for pdf in frames:
            x = np.nan_to_num(pdf[[f"x{i}" for i in range(k)]].to_numpy(dtype=float))
            groups = pdf.groupby(keys, sort=False).indices if keys else {(): np.arange(len(pdf))}
            for key, at in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                for lv, inner in pdf.iloc[at].groupby("level").indices.items():
                    part = x[at[inner]]
                    m = part.T @ part
                    out = pd.DataFrame({"level": int(lv), "i": upper_i, "j": upper_j, "v": m[upper_i, upper_j]})
                    for name, value in zip(keys, key, strict=True):
                        out[name] = value
                    yield out[[f.name for f in schema.fields]]

    partials = rows.mapInPandas(partial, schema)
    return partials.groupBy(*keys, "level", "i", "j").agg(F.sum("v").alias("v"))


def _square(pdf: pd.DataFrame, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[pdf["i"], pdf["j"]] = pdf["v"]
    return np.triu(m) + np.triu(m, 1).T


def _fit(m: np.ndarray, xs: Sequence[int], ys) -> np.ndarray:
    """Least squares of columns ys on columns xs from cross products, on columns of unit length."""
    d = np.sqrt(np.maximum(np.diag(m)[xs], 1e-300))
    right = m[np.ix_(xs, ys)] if isinstance(ys, list) else m[xs, ys]
    beta = np.linalg.lstsq(m[np.ix_(xs, xs)] / d[:, None] / d[None, :], (right.T / d).T, rcond=None)[0]
    return (beta.T / d).T


def _centred(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns less their mean of the key: a level must not eat the digits of cross products."""
    return df.withColumns({c: F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(whole(keys)) for c in cols})


def _residual(m: np.ndarray, y: int, xs: Sequence[int]) -> float:
    """Squared residual sum of column y on columns xs, from cross products."""
    xs = list(xs)
    beta = _fit(m, xs, y)
    return float(m[y, y] - beta @ m[xs, y])


def _schema(df: DataFrame, keys: Sequence[str], extra: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keys] + [T.StructField(n, t) for n, t in extra.items()])


def _solve(gram: DataFrame, keys: Sequence[str], schema: T.StructType, fn) -> DataFrame:
    """Run ``fn(cross products of one key) -> rows`` where the matrix is."""
    names = [f.name for f in schema.fields]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *row] for row in fn(pdf)], columns=names)

    if keys:
        return gram.groupBy(*keys).applyInPandas(run, schema)
    return gram.groupBy(F.lit(1)).applyInPandas(lambda key, pdf: run((), pdf), schema)


#: Largest relative difference of inflations that counts as none.
VIF_TIE = 1e-9


def vif_elimination(df: DataFrame, keys: Sequence[str], cols: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Columns left after dropping the largest variance inflation until all fit.

    The inflation is that of a regression without intercept, so it is
    ``G_jj * inverse(G)_jj`` of the plain cross products, taken on columns of unit
    length.  Of equal largest ones the first column goes: the last two columns
    always inflate each other alike, so inflations that differ by less than their
    last digits count as equal.
    """
    cols = list(cols)
    gram = gram_matrix(df.dropna(subset=cols), keys, cols)
    schema = _schema(df, keys, {"variable": T.StringType(), "vif": T.DoubleType(), "kept": T.BooleanType()})

    def eliminate(pdf: pd.DataFrame):
        m, left, dropped = _square(pdf, len(cols)), list(range(len(cols))), []
        while True:
            part = m[np.ix_(left, left)]
            d = np.sqrt(np.maximum(np.diag(part), 1e-300))
            part = part / d[:, None] / d[None, :]
            vif = np.diag(part) * np.diag(np.linalg.pinv(part))
            worst = int(np.argmax(vif >= vif.max() * (1 - VIF_TIE)))
            if vif[worst] <= limit or len(left) == 1:
                break
            dropped.append((left.pop(worst), float(vif[worst])))
        rows = [[cols[c], v, False] for c, v in dropped]
        return rows + [[cols[c], float(v), True] for c, v in zip(left, vif, strict=True)]

    return _solve(gram, keys, schema, eliminate)


def _lagged(df: DataFrame, keys: Sequence[str], cols: Sequence[str], lags: int, day: str) -> tuple[DataFrame, list[str]]:
    """Design columns: constant, then each variable at lags 0..n, plus ``_hist``."""
    o = ordered(keys, day)
    names = ["_const"] + [f"_{c}_{k}" for c in cols for k in range(lags + 1)]
    design = df.dropna(subset=list(cols)).select(
        *keys,
        F.lit(1.0).alias("_const"),
        *[(F.lag(c, k).over(o) if k else F.col(c)).alias(f"_{c}_{k}") for c in cols for k in range(lags + 1)],
        F.least(F.row_number().over(o) - 1, F.lit(lags)).alias("_hist"),
    )
    return design, names


def granger_matrix(df: DataFrame, keys: Sequence[str], cols: Sequence[str], max_lag: int = 12, day: str = "day") -> DataFrame:
    """Smallest chi-squared p value over lags for "cause helps to predict effect"."""
    cols = list(cols)
    design, names = _lagged(_centred(df, keys, cols), keys, cols, max_lag, day)
    gram = gram_matrix(design, keys, names, level="_hist")
    schema = _schema(df, keys, {"effect": T.StringType(), "cause": T.StringType(), "min_p": T.DoubleType(), "lag": T.IntegerType()})
    at = {(c, k): 1 + cols.index(c) * (max_lag + 1) + k for c in cols for k in range(max_lag + 1)}

    def tests(pdf: pd.DataFrame):
        levels = {lv: _square(g, len(names)) for lv, g in pdf.groupby("level")}
        # rows with history h serve every lag up to h
        total = {n: sum((m for lv, m in levels.items() if lv >= n), np.zeros((len(names),) * 2)) for n in range(1, max_lag + 1)}
        for y in cols:
            for x in cols:
                best = (1.0, 1)
                for n in range(1, max_lag + 1):
                    if x == y:
                        break
                    m = total[n]
                    own = [0, *(at[y, k] for k in range(1, n + 1))]
                    small = _residual(m, at[y, 0], own)
                    full = _residual(m, at[y, 0], own + [at[x, k] for k in range(1, n + 1)])
                    stat = m[0, 0] * (small - full) / full if full > 0 else 0.0
                    best = min(best, (gamma_upper(n / 2.0, max(stat, 0.0) / 2.0), n))
                yield [y, x, best[0], best[1]]

    return _solve(gram, keys, schema, tests)


# Response surface of the unit-root p value (constant, one series).
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def _adf_p(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    coef = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    z = sum(c * stat**i for i, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def unit_root_test(df: DataFrame, keys: Sequence[str], cols: Sequence[str], max_lag: int, difference: bool = False, day: str = "day") -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag count by AIC.

    Series are unfolded so all columns share one plan.  The lag count is
    chosen on the common sample and the statistic fitted on the full one.
    """
    keys = list(keys)
    long = df.select(*keys, day, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_y")) for c in cols])))
    group = keys + ["variable"]
    o = ordered(group, day)
    long = _centred(long.where(F.col("_y").isNotNull()), group, ["_y"])
    if difference:
        long = long.withColumn("_y", F.col("_y") - F.lag("_y").over(o)).where(F.col("_y").isNotNull())
    long = long.withColumns({"_d": F.col("_y") - F.lag("_y").over(o), "_lev": F.lag("_y").over(o), "_hist": F.row_number().over(o) - 2})
    names = ["_const", "_d", "_lev"] + [f"_d{k}" for k in range(1, max_lag + 1)]
    design = long.select(
        *group, F.lit(1.0).alias("_const"), "_d", "_lev",
        *[F.lag("_d", k).over(o).alias(f"_d{k}") for k in range(1, max_lag + 1)],
        F.least("_hist", F.lit(max_lag)).alias("_hist"),
    ).where(F.col("_hist") >= 0)
    gram = gram_matrix(design, group, names, level="_hist")
    schema = _schema(long, group, {"statistic": T.DoubleType(), "p_value": T.DoubleType(), "lags": T.IntegerType(), "n": T.LongType()})

    def fit(pdf: pd.DataFrame):
        levels = {lv: _square(g, len(names)) for lv, g in pdf.groupby("level")}
        sums = [sum((m for lv, m in levels.items() if lv >= n), np.zeros((len(names),) * 2)) for n in range(max_lag + 1)]
        common = sums[max_lag]
        n = common[0, 0]

        def aic(k: int) -> float:
            ssr = _residual(common, 1, [0, 2, *range(3, 3 + k)])
            return n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * (k + 2)

        k = min(range(max_lag + 1), key=aic)
        m, xs = sums[k], [2, 0, *range(3, 3 + k)]
        d = np.sqrt(np.maximum(np.diag(m)[xs], 1e-300))
        inv = np.linalg.pinv(m[np.ix_(xs, xs)] / d[:, None] / d[None, :]) / d[:, None] / d[None, :]
        beta = inv @ m[xs, 1]
        sigma2 = float(m[1, 1] - beta @ m[xs, 1]) / (m[0, 0] - len(xs))
        stat = float(beta[0] / math.sqrt(sigma2 * inv[0, 0]))
        return [[stat, _adf_p(stat), k, int(m[0, 0])]]

    return _solve(gram, group, schema, fit)


def var_order(df: DataFrame, keys: Sequence[str], cols: Sequence[str], max_lag: int = 12, day: str = "day") -> DataFrame:
    """AIC of vector autoregressions of order 1..max_lag on the common sample."""
    cols = list(cols)
    design, names = _lagged(_centred(df, keys, cols), keys, cols, max_lag, day)
    gram = gram_matrix(design.where(F.col("_hist") == max_lag), keys, names)
    schema = _schema(df, keys, {"order": T.IntegerType(), "aic": T.DoubleType(), "best": T.BooleanType()})
    at = {(c, k): 1 + cols.index(c) * (max_lag + 1) + k for c in cols for k in range(max_lag + 1)}

    def orders(pdf: pd.DataFrame):
        m = _square(pdf, len(names))
        n, k = m[0, 0], len(cols)
        ys = [at[c, 0] for c in cols]
        out = []
        for p in range(1, max_lag + 1):
            xs = [0, *(at[c, j] for j in range(1, p + 1) for c in cols)]
            beta = _fit(m, xs, ys)
            cov = (m[np.ix_(ys, ys)] - beta.T @ m[np.ix_(xs, ys)]) / n
            out.append(float(np.linalg.slogdet(cov)[1] + 2.0 / n * (p * k * k + k)))
        best = int(np.argmin(out))
        return [[i + 1, a, i == best] for i, a in enumerate(out)]

    return _solve(gram, keys, schema, orders)


def var_coefficients(df: DataFrame, keys: Sequence[str], cols: Sequence[str], lags: int = 6, hold_out: int = 300, day: str = "day") -> DataFrame:
    """Equation-wise least squares of a vector autoregression, last rows held out."""
    cols = list(cols)
    newest = F.row_number().over(ordered(keys, day).orderBy(F.desc(day)))
    train = df.withColumn("_r", newest).where(F.col("_r") > hold_out).drop("_r") if hold_out else df
    train = train.dropna(subset=cols)
    design, names = _lagged(_centred(train, keys, cols), keys, cols, lags, day)
    gram = gram_matrix(design.where(F.col("_hist") == lags), keys, names)
    schema = _schema(df, keys, {"equation": T.StringType(), "term": T.StringType(), "lag": T.IntegerType(), "coefficient": T.DoubleType()})
    at = {(c, k): 1 + cols.index(c) * (lags + 1) + k for c in cols for k in range(lags + 1)}

    def fit(pdf: pd.DataFrame):
        m = _square(pdf, len(names))
        terms = [("const", 0), *((c, j) for j in range(1, lags + 1) for c in cols)]
        xs = [0, *(at[c, j] for c, j in terms[1:])]
        for c in cols:
            beta = _fit(m, xs, at[c, 0])
            for (term, lag), b in zip(terms, beta, strict=True):
                yield [c, term, lag, float(b)]

    found = _solve(gram, keys, schema, fit)
    # the constant for the variables as they are: what the means add to the equation
    means = train.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"_mean_{c}") for c in cols])
    mean_of = F.lit(0.0)
    for c in cols:
        mean_of = mean_of + F.when(F.col("equation") == c, F.col(f"_mean_{c}")).otherwise(F.lit(0.0))
    carried = F.lit(0.0)
    for c in cols:
        carried = carried + F.when(F.col("term") == c, F.col("coefficient") * F.col(f"_mean_{c}")).otherwise(F.lit(0.0))
    wide = found.join(means, list(keys)) if keys else found.crossJoin(means)
    shift = mean_of - F.sum(carried).over(whole([*keys, "equation"]))
    wide = wide.withColumn("coefficient", F.when(F.col("term") == "const", F.col("coefficient") + shift).otherwise(F.col("coefficient")))
    return wide.select(*found.columns)


# --- forests -------------------------------------------------------------------------

def _assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.dropna())


def train_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str = "pain",
    trees: Sequence[int] = (20,),
    depths: Sequence[int] = (3, 5),
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
):
    """Split 80/20 twice, search tree count and depth by cross-validation.

    Returns (model, confusion counts on the validation part, importances,
    mean accuracy over the folds per tree count and depth).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    spark = df.sparkSession
    # read by every fold and tree: written once instead of recomputed
    data = cut_lineage(_assembled(df, features, label))
    rest, _test = data.randomSplit([0.8, 0.2], seed)
    train, check = rest.randomSplit([0.8, 0.2], seed)
    forest = RandomForestClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    search = CrossValidator(
        estimator=forest,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    )
    found = search.fit(train)
    model = found.bestModel
    confusion = model.transform(check).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    weights = [(c, float(w)) for c, w in zip(features, model.featureImportances.toArray(), strict=True)]
    scores = [(p[forest.numTrees], p[forest.maxDepth], float(a)) for p, a in zip(grid, found.avgMetrics, strict=True)]
    importances = spark.createDataFrame(weights, "variable string, importance double")
    return model, confusion, importances, spark.createDataFrame(scores, "trees int, depth int, accuracy double")


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a dense number: partition offsets plus the number inside.

    The offsets table has one row per partition.
    """
    df = cut_lineage(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = df.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect()
    offset, offsets = 0, {}
    for row in sorted(sizes, key=lambda r: r["_p"]):
        offsets[row["_p"]] = offset
        offset += row["n"]
    if not offsets:
        return df.withColumn("_i", F.lit(0).cast("long")).drop("_m"), 0
    table = df.sparkSession.createDataFrame(list(offsets.items()), "_p long, _o long")
    out = df.withColumn("_p", part).join(F.broadcast(table), "_p")  # one row per partition
    return out.withColumn("_i", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o"), offset


def permuted(i: Column, n: int, key: Column, rounds: int = 4) -> Column:
    """Place of row ``i`` (0 to n - 1) under a pseudo-random permutation of n rows.

    A Feistel network over the bits of the row number, keyed by ``key``: nothing is
    drawn, stored or sorted, and any row is placed by itself.  Places outside
    0 to n - 1 are walked on along their cycle; the domain is below 2 n, so 128
    steps do not end inside only once in 2^128 rows.
    """
    bits = max(2, (max(n, 1) - 1).bit_length())
    low = bits // 2
    low_mask, high_mask = (F.lit((1 << b) - 1).cast("long") for b in (low, bits - low))

    def half(s: Column, r: Column) -> Column:
        high, under = s["high"], s["under"]
        return F.when(
            r % 2 == 0, F.struct(high.bitwiseXOR(F.xxhash64(key, r, under).bitwiseAND(high_mask)).alias("high"), under.alias("under"))
        ).otherwise(F.struct(high.alias("high"), under.bitwiseXOR(F.xxhash64(key, r, high).bitwiseAND(low_mask)).alias("under")))

    def network(x: Column) -> Column:
        start = F.struct(F.shiftright(x, low).alias("high"), x.bitwiseAND(low_mask).alias("under"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, half, lambda s: F.shiftleft(s["high"], low).bitwiseOR(s["under"]))

    walk = F.sequence(F.lit(0), F.lit(128))
    return F.aggregate(walk, i.cast("long"), lambda x, step: F.when((step > 0) & (x < n), x).otherwise(network(x)))


def _binomial_tail(hits: int, rounds: int) -> float:
    return sum(math.comb(rounds, i) for i in range(hits, rounds + 1)) / 2.0**rounds


def sequential_verdict(hits: int, rounds: int, features: int, alpha: float = 0.05) -> str | None:
    """confirmed, rejected or, as yet, neither, after some rounds.

    One binomial test per feature and look; the level is shared out over the
    features and the looks so far.
    """
    level = alpha / (features * rounds)
    if _binomial_tail(hits, rounds) <= level:
        return "confirmed"
    return "rejected" if _binomial_tail(rounds - hits, rounds) <= level else None


def _with_shadows(rows: DataFrame, n: int, features: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Every feature's values once more in a random order per seed, by one join for all of them."""
    names = [f"shadow_{r}_{c}" for r in range(len(seeds)) for c in features]
    values = F.array(*[F.col(c).cast("double") for c in features])
    keys = F.array(*[F.lit(s).cast("long") for s in seeds])
    long = rows.select("_i", values.alias("_x"), F.posexplode(keys).alias("_r", "_s")).select("_i", "_r", "_s", F.posexplode("_x").alias("_k", "_v"))
    moved = long.select(permuted(F.col("_i"), n, F.col("_s") + F.col("_k")).alias("_i"), (F.col("_r") * len(features) + F.col("_k")).alias("_n"), "_v")
    shadows = moved.groupBy("_i").agg(*[F.max(F.when(F.col("_n") == i, F.col("_v"))).alias(c) for i, c in enumerate(names)])
    return rows.join(shadows, "_i")


def shadow_selection(df: DataFrame, features: Sequence[str], label: str = "pain", max_rounds: int = 100, trees: int = 20, depth: int = 5, seed: int = 42, alpha: float = 0.05, together: int = 4) -> DataFrame:
    """``variable, hits, rounds, verdict``: features that beat the best shuffled copy more often than chance.

    Rounds go on until every feature is decided (see ``sequential_verdict``);
    ``rounds`` is when that was, and ``hits`` how often it had won by then.  A feature still
    open after ``max_rounds`` is tentative.  ``together`` rounds share one join for their
    shadows and are fitted side by side.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.classification import RandomForestClassifier

    features = list(features)
    rows, n = _numbered(df.select(*features, label).dropna())
    rows = cut_lineage(rows)
    hits, decided, done = dict.fromkeys(features, 0), {}, 0
    while n and done < max_rounds and len(decided) < len(features):
        numbers = range(done + 1, min(done + together, max_rounds) + 1)
        wide = cut_lineage(_with_shadows(rows, n, features, [seed + r * (len(features) + 1) for r in numbers]))

        @inheritable_thread_target(df.sparkSession)
        def importances(i: int, wide: DataFrame = wide, numbers: range = numbers) -> np.ndarray:
            names = features + [f"shadow_{i}_{c}" for c in features]
            return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed + numbers[i]).fit(_assembled(wide, names, label)).featureImportances.toArray()

        with ThreadPool(len(numbers)) as pool:
            found = pool.map(importances, range(len(numbers)))
        for done, weights in zip(numbers, found, strict=True):
            bar = max(weights[len(features) :])
            for c, w in zip(features, weights, strict=False):
                if c not in decided:
                    hits[c] += int(w > bar)
                    if verdict := sequential_verdict(hits[c], done, len(features), alpha):
                        decided[c] = (done, verdict)
    table = [(c, k, *decided.get(c, (done, "tentative"))) for c, k in hits.items()]
    return df.sparkSession.createDataFrame(table, "variable string, hits int, rounds int, verdict string")
