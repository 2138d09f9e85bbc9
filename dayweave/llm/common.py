"""Helpers of the text operators: table access, Arrow batches, hashed words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.session import shared_folder

#: Rows of an Arrow batch sent to Python; texts may be long.
BATCH_ROWS = 1000
#: Bytes of text handled at once by the vectorised helpers.
CHUNK_BYTES = 2_000_000
#: Words: digits, letters a-z after lower-casing A-Z, and everything beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: ends the lineage and packs the files of small parts into few scan tasks."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def crc_fold(col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids give null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary")) % F.lit(folds)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most ``limit`` together; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _byte_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.arange(256)
    is_upper = (codes >= 0x41) & (codes <= 0x5A)
    is_word = ((codes >= 0x30) & (codes <= 0x39)) | ((codes >= 0x61) & (codes <= 0x7A)) | (codes >= 0x80) | is_upper
    value = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
    value[is_upper] = value[0x61:0x7B]
    return is_word, value, is_upper


_IS_WORD, _VALUE, IS_UPPER = _byte_table()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each ended by one zero byte, and each text's start (plus the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=starts[1:])
    return np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8), starts


def hashed_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, length) of every word in order, for bytes from ``text_bytes``."""
    inside = _IS_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[last] - total[first]) * down[first]), first, last - first


def shingles(words: np.ndarray, owner: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``width`` words; a shorter text has one run of all its words."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.bincount(owner, minlength=n_docs)
    n = len(words) - width + 1
    found, docs = [], []
    if n > 0:
        h = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            h += words[k : n + k] * factors[k]
        whole = owner[:n] == owner[width - 1 :]
        found.append(mix(h[whole]))
        docs.append(owner[:n][whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))
        h = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            h[has] += words[begin[short[has]] + k] * factors[k]
        found.append(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        docs.append(short)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h, d = np.concatenate(found), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]
