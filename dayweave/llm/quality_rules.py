"""Quality scores from a sparse ensemble of rules.

Texts become a row of statistics.  A small forest is grown on labelled rows; each
path from a root to a node is a rule, a conjunction of comparisons.  A logistic
model with an L1 penalty weighs the rules, most get no weight, and the rest is
compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.llm import common

#: At most about so many labelled rows are used to fit, and tasks that hold them.
TRAIN_ROWS, TRAIN_TASKS = 20_000, 8
STATISTICS = [
    "log_chars", "upper_share", "digit_share", "space_share", "line_share", "non_ascii_share", "stop_share", "comma_share",
    "mark_share", "other_share", "bar_share", "word_length", "long_word_share", "distinct_share", "repeat_share", "words_a_line",
]


def _byte_classes() -> np.ndarray:
    """One row per kind of byte."""
    c = np.arange(256)
    punct = ((c >= 0x21) & (c <= 0x2F)) | ((c >= 0x3A) & (c <= 0x40)) | ((c >= 0x5B) & (c <= 0x60)) | ((c >= 0x7B) & (c <= 0x7E))
    stop, comma, mark, bar = c == 0x2E, c == 0x2C, (c == 0x21) | (c == 0x3F), c == 0x7C
    return np.stack([common.IS_UPPER, (c >= 0x30) & (c <= 0x39), (c == 0x20) | (c == 0x09), c == 0x0A, c >= 0x80, stop, comma, mark, punct & ~stop & ~comma & ~mark & ~bar, bar])


_CLASSES = _byte_classes()


def measure(texts: list[str | None]) -> np.ndarray:
    """One row of statistics per text, in the order of ``STATISTICS``; all zero for an empty one."""
    data, starts = common.text_bytes(texts)
    n_bytes = np.diff(starts) - 1
    shares = []
    for kind in _CLASSES:
        seen = np.concatenate(([0], np.cumsum(kind[data])))
        shares.append((seen[starts[1:]] - seen[starts[:-1]]) / np.maximum(n_bytes, 1))
    words, first, length = common.hashed_words(data, starts)
    owner = np.searchsorted(starts, first, side="right") - 1
    n = len(texts)
    n_words = np.bincount(owner, minlength=n)
    some = np.maximum(n_words, 1)
    repeat = np.zeros(len(words), dtype=bool)
    repeat[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((words, owner))
    distinct = np.ones(len(words), dtype=bool)
    distinct[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    lines = shares[3] * n_bytes + 1
    columns = [
        np.log1p(n_bytes), *shares,
        np.bincount(owner, weights=length, minlength=n) / some,
        np.bincount(owner, weights=length > 12, minlength=n) / some,
        np.bincount(owner[order], weights=distinct, minlength=n) / some,
        np.bincount(owner, weights=repeat, minlength=n) / some,
        n_words / lines,
    ]
    return np.round(np.stack(columns, axis=1), 9)


def statistics(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics) per row from the whole text; null is empty.  No shuffle."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in common.chunks([len(t or "") for t in texts]):
                values = measure(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(values[:, k]) for k in range(values.shape[1]))], names=["doc_id", *STATISTICS])

    return common.arrow_map(rows, run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, limit) with a weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        held = F.lit(True)
        for name, at_most, limit in self.terms:
            held = held & ((F.col(name) <= F.lit(limit)) if at_most else (F.col(name) > F.lit(limit)))
        return held


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a plain column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)), 6)


def _paths(node, terms: tuple = ()) -> set[tuple]:
    """Conjunctions of all paths below a node of a fitted tree."""
    if node.numDescendants() == 0:
        return set()
    split = node.split()
    name, limit = STATISTICS[split.featureIndex()], float(split.threshold())
    found: set[tuple] = set()
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        own = terms + ((name, at_most, limit),)
        found |= {own} | _paths(child, own)
    return found


def fit(labelled: DataFrame, label: str = "label", *, trees: int = 12, depth: int = 3, penalty: float = 0.002, max_rows: int = TRAIN_ROWS) -> RuleModel:
    """Rules and weights from rows with ``STATISTICS`` and a 0/1 label.

    Rows are thinned by a hash of their statistics to about ``max_rows``.  Without
    both labels the score is the share of label 1 (a half if there is no row).
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *STATISTICS)
    n, ones = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleModel((), math.log(share / (1 - share)))
    rows = rows.where(F.pmod(F.xxhash64(*STATISTICS), F.lit(max(1, math.ceil(n / max_rows)))) == 0)
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, F.lit(n / (2.0 * ones))).otherwise(F.lit(n / (2.0 * (n - ones)))))
    # a bounded sample: each round of the fit is a job, whose cost is its number of tasks
    rows = rows.repartition(TRAIN_TASKS).sortWithinPartitions("label", *STATISTICS).persist()
    try:
        assembled = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(rows)
        forest = RandomForestClassifier(featuresCol="x", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=5).fit(assembled)
        paths = sorted(set().union(*(_paths(t.rootNode()) for t in forest._java_obj.trees())))
        if not paths:
            share = ones / n
            return RuleModel((), math.log(share / (1 - share)))
        names = [f"rule_{k}" for k in range(len(paths))]
        held = rows.select("label", "weight", *(Rule(p).column().cast("double").alias(c) for p, c in zip(paths, names, strict=True)))
        lasso = LogisticRegression(featuresCol="x", weightCol="weight", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
        model = lasso.fit(VectorAssembler(inputCols=names, outputCol="x").transform(held))
    finally:
        rows.unpersist()
    weights = model.coefficients.toArray()
    return RuleModel(tuple(Rule(p, float(w)) for p, w in zip(paths, weights, strict=True) if w), float(model.intercept))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels are never learned: remainder 1 of three folds; null ids may be learned."""
    return F.coalesce(common.crc_fold(doc_id, 3) == 1, F.lit(False))
