"""Best-fit packing of token sequences with a bounded number of open bins.

Documents are tokenised, ended with one id and, only if longer than a sequence,
cut into pieces.  Every task packs the pieces of its own partition: open bins
are found through a bitset with one bit per amount of free space, the fullest
bin that still takes the piece gets it, and when no bin does and all places are
taken the fullest bin is closed.  No shuffle; a task's memory is one Arrow
batch, the open bins and a bounded table of encoded words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.llm import common

CAPACITY = 2048
#: Bins that are open at once in a task.
OPEN_BINS = 1024
#: Encoded words kept by a Python worker (as many again from before).
CACHED_WORDS = 700_000
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class OpenBins:
    """A fixed number of open bins, reached through a bitset keyed by free space."""

    def __init__(self, capacity: int = CAPACITY, places: int = OPEN_BINS):
        self.capacity, self.places = capacity, places
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity`` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


def _spaced(text: str) -> str:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


class WordEncoder:
    """Ids of whole texts from a tokenizers file, as little-endian 32-bit bytes.

    Texts are cut at ASCII white space, which this kind of tokenizer (it drops
    white space before its merges) never looks across; equal chunks are encoded
    once while the bounded table has room.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _learn(self, words) -> None:
        new = []
        for w in dict.fromkeys(words):
            if w not in self.known:
                if w in self.before:
                    self.known[w] = self.before[w]
                else:
                    new.append(w)
        lines = [new[i : i + 64] for i in range(0, len(new), 64)]
        for i in range(0, len(lines), 256):
            part = lines[i : i + 256]
            for line, found in zip(part, self.tokenizer.encode_batch([" ".join(x) for x in part], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype="<u4")
                ends = np.cumsum([len(w) + 1 for w in line])
                cut = np.searchsorted([o[0] for o in found.offsets], ends)
                raw, begin = ids.tobytes(), 0
                for w, end in zip(line, cut.tolist(), strict=True):
                    self.known[w] = raw[4 * begin : 4 * end]
                    begin = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known, self.before = {"": b""}, self.known
        split = [_spaced(t).split(" ") if t else [] for t in texts]
        try:
            return [b"".join([self.known[w] for w in words]) for words in split]
        except KeyError:
            self._learn(w for words in split for w in words)
            return [b"".join([self.known[w] for w in words]) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack(df: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0) -> DataFrame:
    """One row per piece: place in the document, ids, sequence and offset in it.

    ``ids`` holds little-endian unsigned 32-bit values.  A null or empty text is
    the end id alone.  Repeated rows are packed once each.  Sequence numbers are
    unique over the whole output and depend only on how the input is split, so a
    task that runs again gives the same rows.  Pieces that arrive in one batch
    are placed longest first.  Other columns are left behind.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, encoder = OpenBins(capacity, open_bins), _encoder(tokenizer_path)
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in common.chunks([len(t or "") for t in texts], 8 * common.CHUNK_BYTES):
                pieces = []
                for doc, ids in zip(docs[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids += end
                    pieces += [(doc, k, ids[at : at + width]) for k, at in enumerate(range(0, len(ids), width))]
                place: list = [None] * len(pieces)
                for i in sorted(range(len(pieces)), key=lambda i: -len(pieces[i][2])):
                    place[i] = bins.put(len(pieces[i][2]) // 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in pieces], pa.int64()),
                        pa.array([p[1] for p in pieces], pa.int32()),
                        pa.array([p[1] * capacity for p in pieces], pa.int64()),
                        pa.array([len(p[2]) // 4 for p in pieces], pa.int64()),
                        pa.array([p[2] for p in pieces], pa.binary()),
                        pa.array([first + s for s, _ in place], pa.int64()),
                        pa.array([o for _, o in place], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    return common.arrow_map(rows, run, SCHEMA)
