"""Near-duplicate join on word shingles by chosen paths.

A document is its set of hashed five-word shingles, represented by one minimum of
each of many hash functions.  A run grows a tree of paths: a node samples two of
these minima, and a document goes on to the child named by its value of each, so
documents meet in a node if they agree on all sampled shared tokens of the path.
Runs are repeated, with tokens of their own, until a pair at the threshold is
missed no more often than the target recall allows.

Nodes are first compared by brute force on the minima, with a cut far below the
threshold; what that connects are candidate groups.  A node whose members are in
one group already is not looked at, so later runs only pay for what is new, and a
node too large for one task is cut into cells that share a sample of its members.
If a large node still has several groups, it is split by further tokens and, last
of all, compared in blocks.  Then every group, which no link can leave, is
compared once by brute force on whole sets, in blocks if it is large.

Equal sets are one class from the start, with one representative that is named by
the set's fingerprint, so that several texts under one id stay apart.  No pairs are
emitted: a block returns, per document, the number of its links and the least
member of its component there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.llm import common

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold meets in some bucket with at least this probability.
RECALL = 0.999_999
#: Levels of the first paths, and of further splits of large nodes.
FIRST_LEVELS, MORE_LEVELS = 2, 4
TOKENS_A_RUN = 6  # two at the root, two at each of its children
#: Hash functions; those beyond the first paths split large nodes, all give the estimate.
MINIMA = 128
#: Standard deviations that the estimate may lie below the threshold before a pair is dismissed.
DEVIATIONS = 4.75
#: Documents of a cell of a node, and shared members that connect the cells of a large one.
CELL, SHARED = 1024, 64
#: Documents and shingles of a block in the comparison of whole sets.
BLOCK, BLOCK_SHINGLES = 2048, 3_000_000
#: Documents of a block that a shingle has at least to be counted by a matrix product.
RARE = 48


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs until the chance to miss a pair at the threshold in all of them is at most 1 - recall."""
    missed = 0.0
    for _ in range(FIRST_LEVELS + MORE_LEVELS):
        missed = (1 - threshold * (1 - missed)) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def _shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes, ordered within each text, and each text's bounds."""
    data, starts = common.text_bytes(texts)
    words, first, _ = common.hashed_words(data, starts)
    h, owner = common.shingles(words, np.searchsorted(starts, first, side="right") - 1, len(texts), width)
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(int(common.mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (shingles, shingles ^ np.uint64(0x5555555555555555)))


def _factors(n: int) -> np.ndarray:
    return common.mix(np.arange(101, 101 + n, dtype=np.uint64)) | np.uint64(1)


def sketches(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, body, p1, p2, n, minima): hash of the text, fingerprint and size of the shingle set and its minima (null for an empty set)."""
    factors = _factors(MINIMA)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in common.chunks([len(t or "") for t in texts]):
                h, bounds = _shingle_sets(texts[a:b], width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                minima = np.zeros((b - a, len(factors)), dtype=np.uint32)
                prints = np.zeros((2, b - a), dtype=np.int64)
                if len(full):
                    at = bounds[:-1][full]
                    for j, f in enumerate(factors):
                        minima[full, j] = np.minimum.reduceat(((h * f) >> np.uint64(32)).astype(np.uint32), at)
                    prints[0, full] = np.add.reduceat(common.mix(h), at).view(np.int64)
                    prints[1, full] = np.add.reduceat(common.mix(h ^ np.uint64(0x5555555555555555)), at).view(np.int64)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        batch.column(2)[a:b],
                        pa.array(prints[0], mask=empty),
                        pa.array(prints[1], mask=empty),
                        pa.array(n.astype(np.int32)),
                        pa.array([None if e else m.tobytes() for e, m in zip(empty, minima, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "body", "p1", "p2", "n", "minima"],
                )

    return common.arrow_map(rows, run, "doc_id long, body long, p1 long, p2 long, n int, minima binary")


def _minima(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint32).reshape(len(column), -1).astype(np.uint64)


def _path_nodes(reps: DataFrame, runs: range) -> DataFrame:
    """(node, rep, label): the nodes of some runs after the first two levels, four a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _minima(batch.column(2))
            nodes = []
            for r in runs:
                for a in range(2):
                    for b in range(2):
                        top = common.mix(m[:, TOKENS_A_RUN * r + a] + np.uint64((r * 2 + a + 1) << 33))
                        nodes.append(common.mix(top + m[:, TOKENS_A_RUN * r + 2 + 2 * a + b] + np.uint64((b + 1) << 33)))
            node = np.stack(nodes, axis=1)
            k = node.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64).ravel()), *(pa.array(np.repeat(batch.column(i).to_numpy(), k)) for i in (0, 1))],
                names=["node", "rep", "label"],
            )

    return common.arrow_map(reps.select("rep", "label", "minima"), run, "node long, rep long, label long")


def _split_nodes(members: DataFrame, labelled: DataFrame, first_token: int) -> DataFrame:
    """(node, rep, label): members of large nodes in the two children that each node samples for them."""
    rows = members.select("node", "rep").join(labelled, "rep").select("node", "rep", "label", "minima")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _minima(batch.column(3))
            node = batch.column(0).to_numpy().view(np.uint64)
            row, n = np.arange(len(node)), np.uint64(MINIMA - first_token)
            first = common.mix(node + np.uint64(7)) % n
            second = (first + np.uint64(1) + common.mix(node + np.uint64(8)) % (n - np.uint64(1))) % n
            children = [common.mix(node + common.mix(m[row, first_token + t.astype(np.int64)] + (t << np.uint64(33)))) for t in (first, second)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(children).view(np.int64)), *(pa.array(np.tile(batch.column(i).to_numpy(), 2)) for i in (1, 2))],
                names=["node", "rep", "label"],
            )

    return common.arrow_map(rows, run, "node long, rep long, label long")


def _open_members(nodes: DataFrame) -> DataFrame:
    """(node, rep, members) of nodes with members of several groups; of nodes with equal members one is kept."""
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("least"), F.max("label").alias("most"), F.bit_xor(F.xxhash64("rep")).alias("print"))
    kept = sizes.where("least <> most").groupBy("members", "print").agg(F.min("node").alias("node"))
    return nodes.join(kept.select("node", "members"), "node").select("node", "rep", "label", "members")


def _estimated(members: DataFrame, reps: DataFrame, cut: float, *, shared: Column | None = None, blocks: bool = False) -> DataFrame:
    """(a, b): connections by the share of equal minima within cells, each document with the least one it reaches.

    A node is one cell or, if large, several, which share the members marked by
    ``shared`` (a sample, unless given); with ``blocks`` every two of its parts
    form a cell instead.
    """
    parts = F.ceil(F.col("members") / F.lit(CELL)).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    if blocks:
        cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.least(k, own) * F.lit(1 << 20) + F.greatest(k, own))
    else:
        if shared is None:
            shared = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("members")) < SHARED
        cells = F.when(shared, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    rows = members.select("node", F.explode(cells).alias("cell"), "rep").join(reps.select("rep", "minima"), "rep")
    rows = rows.select("node", "cell", "rep", "minima").repartition("node", "cell").sortWithinPartitions("node", "cell", "rep")

    def connect(key: tuple, held: list[pa.RecordBatch]) -> list[tuple]:
        rep = np.concatenate([x.column(2).to_numpy() for x in held])
        m = np.concatenate([_minima(x.column(3)) for x in held]).astype(np.uint32)
        pairs = []
        for i in range(0, len(rep), 64):
            same = np.zeros((min(64, len(rep) - i), len(rep)), dtype=np.int16)
            for j in range(m.shape[1]):
                same += m[i : i + 64, j, None] == m[None, :, j]
            a, b = np.nonzero(same >= cut * m.shape[1])
            pairs.append((a[a + i < b] + i, b[a + i < b]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        least = _least(len(rep), a, b)
        return [(int(rep[k]), int(rep[least[k]])) for k in np.flatnonzero(least != np.arange(len(rep)))]

    return common.arrow_map(rows, _by_cell(2, connect, ["a", "b"]), "a long, b long")


def _by_cell(keys: int, work, names: list[str]):
    """Streams sorted batches and calls ``work`` with all rows of each cell; its tuples of whole numbers come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple = ()
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)])
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and key != tuple(place[:, a]):
                    out += work(key, held)
                    held = []
                key = tuple(place[:, a])
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
        out = work(key, held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's component under the pairs (a, b)."""
    least = np.arange(n)
    while len(a):
        before = least.copy()
        both = np.minimum(least[a], least[b])
        np.minimum.at(least, a, both)
        np.minimum.at(least, b, both)
        least = least[least]
        if (before == least).all():
            break
    return least


def candidate_groups(reps: DataFrame, runs: int, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): groups of representatives that no link leaves; those alone are left out."""
    cut = threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / MINIMA)
    alone = reps.select("rep", F.col("rep").alias("label"), "minima")
    found = [common.written(_estimated(_open_members(_path_nodes(alone, range(1))), reps, cut))]
    groups = components(found[0]).withColumnRenamed("node", "rep")
    labelled = reps.join(groups, "rep", "left").select("rep", F.coalesce("root", "rep").alias("label"), "minima")
    nodes = _path_nodes(labelled, range(runs))
    for level in range(MORE_LEVELS + 1):
        members = _open_members(nodes)
        by_label = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        main = by_label.groupBy("node").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("most"))
        members = common.written(members.join(main, "node"))
        # what is outside a large node's main group meets all its members, if that is little
        mixed = (F.col("members") > CELL) & (F.col("members") - F.col("most") > CELL)
        found.append(common.written(_estimated(members.where(~mixed), reps, cut, shared=F.col("label") != F.col("main"))))
        members = members.where(mixed)
        if members.isEmpty():
            break
        if level == MORE_LEVELS:
            found.append(common.written(_estimated(members, reps, cut, blocks=True)))
        else:
            nodes = common.written(_split_nodes(members, labelled, TOKENS_A_RUN * runs))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return components(edges)


def _intersections(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Common shingles of every set before ``split`` with every one from it on (all with all if 0)."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, where, seen = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(where, kind="stable")
    row, ends = owner[order], np.cumsum(seen)
    left = len(sets) if not split else split
    total = np.zeros((left, len(sets) - split), dtype=np.float32)
    # shingles of few documents: their pairs are added one by one
    for n in range(2, RARE):
        begins = (ends - seen)[seen == n]
        for k in range(0, len(begins), 4_000_000 // (n * n)):
            rows = row[begins[k : k + 4_000_000 // (n * n), None] + np.arange(n)]
            a, b = np.repeat(rows, n, axis=1).ravel(), np.tile(rows, (1, n)).ravel()
            some = (a < left) & (b >= split)
            np.add.at(total, (a[some], b[some] - split), 1.0)
    # shingles of many: products of incidence columns
    many = np.flatnonzero(seen >= RARE)
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        x = np.zeros((len(sets), len(part)), dtype=np.float32)
        counts = seen[part]
        col = np.repeat(np.arange(len(part)), counts)
        at = np.repeat((ends - seen)[part] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        x[row[at], col] = 1.0
        total += x[:left] @ x[split:].T
    return total


def _compare(parts: list[pa.RecordBatch], one_block: bool, threshold: float) -> list[tuple[int, int, int]]:
    """(rep, links, least member of its component) for the documents of one cell that have a link."""
    whole = pa.Table.from_batches(parts)
    rep = whole.column("rep").to_numpy()
    side = whole.column("side").to_numpy()
    single = np.ones(len(rep), dtype=bool)
    single[1:] = (rep[1:] != rep[:-1]) | (side[1:] != side[:-1])  # repeated rows
    at = np.flatnonzero(single)
    rep, side = rep[at], side[at]
    weight = whole.column("weight").to_numpy()[at]
    sets = [np.frombuffer(s, dtype=np.uint64) for s in whole.column("shingles").take(pa.array(at)).to_pylist()]
    split = 0 if one_block else int(np.searchsorted(side, 1))
    if len(sets) < 2 or (not one_block and split in (0, len(sets))):
        return []
    size = np.array([len(s) for s in sets], dtype=np.float64)
    inter = _intersections(sets, split)
    left = np.arange(len(sets) if one_block else split)
    right = np.arange(split, len(sets))
    links = np.zeros(len(sets), dtype=np.int64)
    least = np.arange(len(sets))
    order = np.argsort(rep)
    rank = np.empty(len(rep), dtype=np.int64)
    rank[order] = np.arange(len(rep))
    pairs = []
    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        some = inter[i : i + 256]
        linked = some >= threshold * (size[rows][:, None] + size[right][None, :] - some) - 1e-9
        if one_block:
            linked[np.arange(len(rows)), rows] = False
        links[rows] += linked @ weight[right]
        if not one_block:
            links[right] += weight[rows] @ linked
        a, b = np.nonzero(linked)
        pairs.append((rank[rows[a]], rank[right[b]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    least = _least(len(sets), a, b)
    return [(int(rep[i]), int(links[i]), int(rep[order[least[rank[i]]]])) for i in np.flatnonzero(links)]


def compare_groups(df: DataFrame, groups: DataFrame, reps: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, links, least): all pairs within each group, from whole shingle sets of its members."""
    members = groups.withColumnRenamed("node", "rep").join(reps.select("rep", "doc", "body", "n", "p1", "p2", "weight"), "rep")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(BLOCK), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    members = members.join(sizes.select("root", blocks.alias("blocks")), "root").select("rep", "doc", "body", "root", "blocks", "p1", "p2", "weight")
    texts = df.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    rows = texts.join(members.hint("shuffle_hash"), ["doc", "body"]).select("rep", "text", "root", "blocks", "p1", "p2", "weight")
    names = ["root", "low", "high", "side", "rep", "weight", "shingles"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, texts, root, parts, p1, p2, weight = (c.to_pylist() for c in batch.columns)
            for a, b in common.chunks([len(t or "") for t in texts]):
                h, bounds = _shingle_sets(texts[a:b], width)
                out: list[tuple] = []
                for k in range(a, b):
                    own = h[bounds[k - a] : bounds[k - a + 1]]
                    if _fingerprint(own) != (p1[k], p2[k]):
                        continue  # another text with the id and hash of the representative's
                    raw = own.tobytes()
                    mine = int(common.mix(np.array([rep[k]], dtype=np.int64).view(np.uint64))[0] % np.uint64(parts[k]))
                    for other in range(parts[k]):
                        low, high = min(mine, other), max(mine, other)
                        out.append((root[k], low, high, int(low != high and mine == high), rep[k], weight[k], raw))
                    if len(out) > 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    cells = common.arrow_map(rows, spread, "root long, low int, high int, side int, rep long, weight long, shingles binary")
    cells = cells.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "side", "rep")

    def compare(key: tuple, held: list[pa.RecordBatch]) -> list[tuple]:
        return _compare(held, key[1] == key[2], threshold)

    return common.arrow_map(cells, _by_cell(3, compare, ["rep", "links", "least"]), "rep long, links long, least long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of (a, b) rows.

    Labels go to neighbours and then to the label of the label, so rounds grow
    with the logarithm of a component's width.  Every step is a join or an
    aggregation with partial minima; a node with very many edges is split by
    the adaptive join.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = common.written(both)
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = common.written(step.join(far, "low", "left").select("node", "root", F.least("low", F.coalesce("far", "low")).alias("low")))
        labels = step.select("node", F.col("low").alias("root"))
        if step.where("root <> low").isEmpty():
            return labels


def _classified(df: DataFrame, doc_id: str, text: str, width: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows with an id, and (p1, p2, class_id, class_body, n_links) of every set: the least id and text hash of its class and its links."""
    found = common.written(sketches(df.where(F.col(doc_id).isNotNull()), doc_id=doc_id, text=text, width=width))
    sets = found.where("n > 0").groupBy("p1", "p2").agg(
        F.min(F.struct("doc_id", "body")).alias("first"), F.count_distinct("doc_id").alias("weight"), F.min("n").alias("n"), F.min("minima").alias("minima")
    )
    reps = common.written(sets.select("p1", "p2", F.xxhash64("p1", "p2").alias("rep"), F.col("first.doc_id").alias("doc"), F.col("first.body").alias("body"), "weight", "n", "minima"))
    groups = candidate_groups(reps, runs_needed(threshold, recall), threshold)
    compared = common.written(compare_groups(df, groups, reps, doc_id=doc_id, text=text, width=width, threshold=threshold))
    roots = components(compared.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    members = roots.join(reps.select("rep", F.struct("doc", "body").alias("first")), "rep")
    heads = members.select("rep", "root").join(members.groupBy("root").agg(F.min("first").alias("head")), "root").select("rep", "head")
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = reps.select("p1", "p2", "rep", F.struct("doc", "body").alias("first"), "weight").join(links, "rep", "left").join(heads, "rep", "left")
    classes = classes.withColumn("head", F.coalesce("head", "first"))
    return found, classes.select("p1", "p2", F.col("head.doc").alias("class_id"), F.col("head.body").alias("class_body"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): one row per document.

    ``class_id`` is the least id that the document is linked to directly or
    through others, ``n_links`` the number of other documents whose shingle sets
    have a Jaccard similarity of at least ``threshold`` with its own.  A text of
    fewer words than a shingle is one shingle of all its words; null texts and
    texts without words are alone in their class and have no links.  Rows with
    one id and equal sets are one document, rows with one id and different sets
    are documents of their own; rows with a null id keep a null class and are
    not looked at.  Other columns are left behind.
    """
    found, classes = _classified(df, doc_id, text, width, threshold, recall)
    documents = found.select("doc_id", "p1", "p2", "n").distinct()
    out = documents.join(classes, ["p1", "p2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(df.where(F.col(doc_id).isNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def row_classes(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, body, copies, class_id, class_body): one row per id and text, with xxhash64 of the text.

    ``copies`` counts the rows with both; ``class_id`` and ``class_body`` are the
    least of their class, see ``near_duplicates``.  Rows with a null id are left out.
    """
    found, classes = _classified(df, doc_id, text, width, threshold, recall)
    rows = found.groupBy("doc_id", "body", "p1", "p2").agg(F.count(F.lit(1)).alias("copies")).join(classes, ["p1", "p2"], "left")
    return rows.select("doc_id", "body", "copies", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_body", "body").alias("class_body"))


OP5_SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS s FROM doc_words WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, s, s + 4), ' ') AS sh FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * i >= 4 * (x.n + y.n - i)),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
classes AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.doc_id, CAST(c.class_id AS BIGINT) AS class_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links
FROM classes c LEFT JOIN counts n ON n.doc_id = c.doc_id
"""
