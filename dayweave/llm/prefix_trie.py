"""The trie of shared conversation beginnings, by peeling off last turns.

A conversation is the path of its turns' 128-bit marks, one after the other in one
binary value, so that the order of paths is the depth-first order of the trie.  Paths
are dealt out by ranges and sorted; each task peels its stretch of the trie from
the greatest depth upwards: where a path parts from the one before, the last turns of
the nodes that end there are stripped, a stripped node meets the conversations that
end at its parent and the other nodes that were stripped to it, and its counts go up
with it.  Nodes are found and aggregated in that one pass.

A node may reach over the ends of a task's stretch only if it lies on its first or
last path.  These border nodes (at most twice the depth per task) are left open: what
they have gathered is added up over the tasks afterwards, each node's own share
counted in the first task that has it.  A node with very many children is left open
too, so that a task holds a bounded number of children whose parent is not known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm import common

#: Bytes of a turn's mark.
MARK = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Turns borrowed at most, and how many consecutive conversations borrow from one.
MOST_BORROWED, FAMILY = 3, 20
#: Children that wait for their parent's least conversation in a task, per node.
WAITING = 20_000
EMPTY_SHA256 = hashlib.sha256().hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, mark, words): the turns of each conversation, numbered from 1 by turn (null first), ties by mark.

    The mark is a digest of role and text; null role or text is empty.  Rows
    without a conversation are left out.
    """
    who, said = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)).alias("mark"),
        F.regexp_count(said, F.lit(WORD)).alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "mark")
    return rows.select("conv", F.row_number().over(order).alias("pos"), "mark", "words")


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_BORROWED + 1)


def rebuilt(numbered: DataFrame) -> DataFrame:
    """Every conversation begins with the first turns of the first of its family, and goes on with its own behind as many.

    Rows (conv, part, pos, mark, words); a row without a mark stands for the
    conversation itself, as it may have no turn left.
    """
    convs = numbered.where("pos = 1").select("conv")
    heads = numbered.where((F.col("conv") % FAMILY == 0) & (F.col("pos") <= MOST_BORROWED)).withColumnRenamed("conv", "head")
    lent = convs.join(heads, F.col("conv") - F.col("conv") % FAMILY == F.col("head")).where(F.col("pos") <= borrowed(F.col("conv")))
    own = numbered.where(F.col("pos") > borrowed(F.col("conv")))
    alone = convs.select("conv", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("mark"), F.lit(0).alias("words"))
    return own.select("conv", F.lit(1).alias("part"), "pos", "mark", "words").unionByName(lent.select("conv", F.lit(0).alias("part"), "pos", "mark", "words")).unionByName(alone)


def paths(rows: DataFrame) -> DataFrame:
    """(conv, path, words): one row per conversation, its marks in order in one binary value and the words of each turn."""
    turn = F.when(F.col("mark").isNotNull(), F.struct("part", "pos", "mark", "words"))
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv", F.unhex(F.array_join("turns.mark", "")).alias("path"), F.col("turns.words").alias("words"))


class _Node:
    """An open node: what has been merged into it so far."""

    __slots__ = ("border", "convs", "ends", "key", "kids", "least", "leaves", "saved", "waiting", "words")

    def __init__(self, key: bytes, words: int, border: bool):
        self.key, self.words, self.border = key, words, border
        self.convs = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = None
        self.waiting: list[tuple] = []

    def end(self, conv: int) -> None:
        """A conversation ends here."""
        if self.ends is None:
            self.ends = hashlib.sha256(str(conv).encode())
        else:
            self.ends.update(f",{conv}".encode())
        self.merge(1, conv)

    def merge(self, convs: int, least: int) -> None:
        self.convs += convs
        self.least = least if self.least is None else min(self.least, least)


PEELED = pa.schema(
    [("closed", pa.bool_()), ("task", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("words", pa.int64())]
)
PEELED_SQL = "closed boolean, task int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long"


class Peeler:
    """Peels a sorted stretch of paths; rows of finished and of left-open nodes gather in ``done``."""

    def __init__(self, task: int, waiting: int = WAITING):
        self.task, self.most, self.done = task, waiting, []
        self.path: bytes | None = None
        self.open: list[_Node] = []

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        if path != self.path:
            first = self.path is None
            if first:
                self.open, self.path = [_Node(b"", 0, True)], b""
            same = _common(self.path, path) // MARK
            self.strip(same)
            for d in range(same, len(path) // MARK):
                key = hashlib.md5(self.open[-1].key + path[d * MARK : (d + 1) * MARK]).digest()
                self.open.append(_Node(key, words[d], first))
            self.path = path
        self.open[-1].end(conv)

    def strip(self, depth: int) -> None:
        """Takes last turns off until ``depth``, merging each node into its parent."""
        while len(self.open) - 1 > depth:
            node, at = self.open.pop(), len(self.open)
            parent = self.open[-1]
            parent.merge(node.convs, node.least)
            if node.border:
                self._leave(node, at, parent.key)
                continue
            leaves, saved = node.leaves + (node.kids == 0), node.saved + (node.convs - 1) * node.words
            for row in node.waiting:
                self._close(row, None, node.least)
            parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved
            row = (node.least, at, node.convs, node.kids, leaves, saved, _hex(node))
            if parent.border:
                self._close(row, parent.key, None)
            else:
                parent.waiting.append(row)
                if len(parent.waiting) > self.most:
                    self.leave_open()

    def leave_open(self) -> None:
        """All open nodes become border nodes; their children need not wait any longer."""
        for node in self.open:
            node.border = True
            for row in node.waiting:
                self._close(row, node.key, None)
            node.waiting = []

    def finish(self) -> None:
        if self.open:
            self.leave_open()
            self.strip(0)
            self._leave(self.open.pop(), 0, None)

    def _close(self, row: tuple, parent_key: bytes | None, parent: int | None) -> None:
        least, depth, convs, kids, leaves, saved, ends = row
        self.done.append((True, self.task, None, parent_key, least, depth, parent, convs, kids, leaves, saved, ends, None))

    def _leave(self, node: _Node, depth: int, parent_key: bytes | None) -> None:
        ends = node.ends.hexdigest() if node.ends else None
        self.done.append((False, self.task, node.key, parent_key, node.least, depth, None, node.convs, node.kids, node.leaves, node.saved, ends, node.words))


def _hex(node: _Node) -> str:
    return node.ends.hexdigest() if node.ends else EMPTY_SHA256


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PEELED, strict=True)], schema=PEELED)


def peel(conversations: DataFrame, *, waiting: int = WAITING) -> DataFrame:
    """Finished nodes (closed) and what each task knows about its border nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peeler = Peeler(TaskContext.get().partitionId(), waiting)
        for batch in batches:
            for conv, path, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                peeler.add(conv, path, words)
                if len(peeler.done) > 10_000:
                    yield _batch(peeler.done)
                    peeler.done = []
        peeler.finish()
        if peeler.done:
            yield _batch(peeler.done)

    ordered = conversations.select("conv", "path", "words").repartitionByRange("path").sortWithinPartitions("path", "conv")
    return common.arrow_map(ordered, run, PEELED_SQL)


def _sums_within(rows):
    """Subtree sums of one task's border nodes."""
    rows = rows.sort_values("depth", ascending=False)
    at = {bytes(k): i for i, k in enumerate(rows["key"])}
    leaves, saved = rows["leaves"].tolist(), rows["saved"].tolist()
    for i, up in enumerate(rows["parent_key"]):
        if up is not None:
            j = at[bytes(up)]
            leaves[j] += leaves[i]
            saved[j] += saved[i]
    return rows[["key"]].assign(leaves=leaves, saved=saved)


def close_borders(border: DataFrame) -> DataFrame:
    """Finishes nodes that several tasks have a part of; adds ``key`` and ``parent_key``."""
    merged = border.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"), F.min("task").alias("task"),
    )
    kids = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more")).where("key is not null")
    full = merged.join(kids, "key", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    full = common.written(
        full.select(
            "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "task", F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
            (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        )
    )
    own = border.select("task", "key", "parent_key", "depth").join(full.select("key", "task", "leaves", "saved"), ["key", "task"], "left")
    sums = own.select("task", "key", "parent_key", "depth", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    sums = sums.groupBy("task").applyInPandas(_sums_within, "key binary, leaves long, saved long").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = full.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return full.drop("leaves", "saved", "task").join(sums, "key").join(parents, "parent_key", "left")


def trie(conversations: DataFrame, *, waiting: int = WAITING) -> DataFrame:
    """One row per node of the trie of ``paths``.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Conversations without turns are members of the root;
    no conversation, no node.  Equal conversations end in one node; their ids are
    digested as a stream in one task, as one digest in order asks for it.
    """
    peeled = common.written(peel(conversations, waiting=waiting))
    border = common.written(close_borders(peeled.where("not closed")))
    closed = peeled.where("closed")
    least = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    below = closed.where("parent_key is not null").join(least, "parent_key").withColumn("parent_conv_id", F.col("found"))
    return closed.where("parent_key is null").select(*COLUMNS).unionByName(below.select(*COLUMNS)).unionByName(border.select(*COLUMNS))


def shared_prefixes(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", borrow: bool = False) -> DataFrame:
    """The trie of conversations given as rows of turns, see ``turns``, ``rebuilt`` (with ``borrow``) and ``trie``.

    Null roles and texts are empty, rows without a conversation are left out,
    repeated rows are turns of their own.  Other columns are left behind.
    """
    numbered = common.written(turns(df, conv_id=conv_id, turn=turn, role=role, text=text))
    return trie(paths(rebuilt(numbered) if borrow else numbered.withColumn("part", F.lit(0))))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT v.c, 0 AS part, t.pos, t.mark, t.words FROM convs v JOIN turns t ON t.c = v.head AND t.pos <= v.h
  UNION ALL SELECT v.c, 1, t.pos, t.mark, t.words FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
whole AS (
  SELECT v.c, coalesce(string_agg(p.mark, '' ORDER BY p.part, p.pos), '') AS path, coalesce(list(p.words ORDER BY p.part, p.pos) FILTER (WHERE p.c IS NOT NULL), []) AS words
  FROM convs v LEFT JOIN parts p ON p.c = v.c GROUP BY v.c),
steps AS (SELECT c, path, words, unnest(range(0, 1 + length(path) // 32)) AS depth FROM whole),
nodes AS (
  SELECT path[:32 * depth] AS node, depth, CASE WHEN depth > 0 THEN path[:32 * (depth - 1)] END AS parent, min(c) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE length(path) = 32 * depth), '') AS ends
  FROM steps GROUP BY 1, 2, 3),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
trie AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node)),
sums AS (
  SELECT a.node, CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
  FROM trie a JOIN trie b ON starts_with(b.node, a.node) GROUP BY 1)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens, sha256(t.ends) AS ends_sha256
FROM trie t JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = t.parent
"""
