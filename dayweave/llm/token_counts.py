"""Exact token counts at every prefix of a text by dynamic programming.

In a byte-pair vocabulary the tokens of a prefix end in exactly one token that
may stand behind the tokens of the shorter prefix before it.  Two tokens may
stand side by side if encoding their joined text gives the two back.  So

    last(i)  = the token t that ends at i and may follow last(i - len(t))
    count(i) = count(i - len(t)) + 1

No piece of the vocabulary holds a space mark after another character or a line
end, so texts fall apart at those places: the table of a segment is made once,
and a text's counts are running sums over its segments.  Budgets and truncation
are then answered from the table without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayweave.llm import common

#: Segments whose totals are kept by a Python worker (as many again from before).
CACHED_SEGMENTS = 700_000
#: Slots of the table that remembers which tokens may stand side by side.
PAIR_SLOTS = 1 << 21
#: Segments solved together; longer ones are solved alone.
TOGETHER, SHORT = 30_000, 48
MARK = "▁"

_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class PrefixCounter:
    """Prefix tables for a sentencepiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        normal = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any("\n" in self.pieces[i] or MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("this vocabulary has pieces across segment boundaries")
        self.longest = max(len(self.pieces[i]) for i in normal)
        hashes = self._spans([self.pieces[i] for i in normal])
        order = np.argsort(hashes)
        self.piece_hash, self.piece_id = hashes[order], np.array(normal, dtype=np.int32)[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.pair_key = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, dtype=bool)
        self.totals: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.alone = np.zeros(n, dtype=bool)
        self.alone[normal] = self._gives_back([(i,) for i in normal])

    @staticmethod
    def _running(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = common._powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(common.mix(codes + np.uint64(1)) * up[: len(codes)], out=total[1:], dtype=np.uint64)
        return total, down

    def _spans(self, strings: list[str]) -> np.ndarray:
        """Hashes of whole strings."""
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        total, down = self._running(codes)
        ends = np.cumsum([len(s) for s in strings])
        begins = np.concatenate(([0], ends[:-1]))
        return common.mix((total[ends] - total[begins]) * down[begins])

    def _gives_back(self, tokens: list[tuple[int, ...]]) -> np.ndarray:
        """Whether encoding the joined text of some tokens gives exactly them."""
        texts = ["\n" + "".join(self.pieces[i] for i in t).replace(MARK, " ") for t in tokens]
        return np.array([tuple(e[2:]) == t for e, t in zip(self.model.encode(texts, num_threads=1), tokens, strict=True)], dtype=bool)

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.pieces) + right
        slot = (common.mix(key.astype(np.uint64)) % np.uint64(PAIR_SLOTS)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            kinds, which = np.unique(key[new], return_inverse=True)
            found = self._gives_back([divmod(int(k), len(self.pieces)) for k in kinds])
            ok[new] = found[which]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], found[which]
        return ok

    def tables(self, segments: list[str]) -> list[np.ndarray]:
        """Tokens of every prefix, 0 to its length, for each segment."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        sizes = np.array([len(segments[i]) for i in order], dtype=np.int64)
        codes = np.frombuffer("".join(segments[i] for i in order).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        in_bytes = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int64)
        total, down = self._running(codes)
        ends_here = []  # by length: the piece that ends at a character, or -1
        for length in range(1, self.longest + 1):
            piece = np.full(len(codes), -1, dtype=np.int32)
            if len(codes) >= length:
                h = common.mix((total[length:] - total[:-length]) * down[: len(codes) - length + 1])
                at = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
                place = np.searchsorted(self.piece_hash, h[at])
                place[place == len(self.piece_hash)] = 0
                hit = self.piece_hash[place] == h[at]
                piece[at[hit] + length - 1] = self.piece_id[place[hit]]
            ends_here.append(piece)
        width = int(sizes[0]) + 1 if len(sizes) else 1
        count = np.zeros((width, len(sizes)), dtype=np.int64)
        last = np.full((width, len(sizes)), -1, dtype=np.int32)  # -1: the start, or a character that became bytes
        for i in range(1, width):
            open_ = np.arange(np.searchsorted(-sizes, -i, side="right"))
            for length in range(min(i, self.longest), 0, -1):
                piece = ends_here[length - 1][begin[open_] + i - 1]
                some = np.flatnonzero(piece >= 0)
                if not len(some):
                    continue
                rows, piece = open_[some], piece[some]
                left = last[i - length, rows]
                ok = np.where(left < 0, self.alone[piece], False)
                behind = np.flatnonzero(left >= 0)
                ok[behind] = self._may_follow(left[behind], piece[behind])
                good = rows[ok]
                last[i, good], count[i, good] = piece[ok], count[i - length, good] + 1
                keep = np.ones(len(open_), dtype=bool)
                keep[some[ok]] = False
                open_ = open_[keep]
                if not len(open_):
                    break
            count[i, open_] = count[i - 1, open_] + in_bytes[begin[open_] + i - 1]
        out: list = [None] * len(segments)
        for k, i in enumerate(order):
            out[i] = count[: sizes[k] + 1, k]
        return out

    def table(self, segment: str) -> np.ndarray:
        return self.tables([segment])[0]

    def _learn(self, segments) -> None:
        """Totals of segments that are not known, solved together."""
        new = []
        for s in dict.fromkeys(segments):
            if s not in self.totals:
                if s in self.before:
                    self.totals[s] = self.before[s]
                else:
                    new.append(s)
        short, long = [s for s in new if len(s) <= SHORT], [s for s in new if len(s) > SHORT]
        for i in range(0, len(short), TOGETHER):
            part = short[i : i + TOGETHER]
            self.totals.update(zip(part, (int(t[-1]) for t in self.tables(part)), strict=True))
        for s in long:
            self.totals[s] = int(self.table(s)[-1])

    def segments(self, text: str | None) -> list[str]:
        return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts: one lookup for each segment that is known."""
        if len(self.totals) > CACHED_SEGMENTS:
            self.totals, self.before = {}, self.totals
        split = [self.segments(t) for t in texts]
        try:
            return [sum([self.totals[s] for s in own]) for own in split]
        except KeyError:
            self._learn(s for own in split for s in own)
            return [sum([self.totals[s] for s in own]) for own in split]

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of every prefix of a text, 0 to its length; the empty prefix has none.

        A prefix of at least one character includes the mark that the model puts
        before a text.
        """
        parts, base = [np.zeros(1, dtype=np.int64)], 0
        for k, segment in enumerate(self.segments(text)):
            own = self.table(segment)
            parts.append(base + own[2 if k == 0 else 1 :])
            base += int(own[-1])
        return np.concatenate(parts)

    def total(self, segment: str) -> int:
        if segment not in self.totals:
            self._learn([segment])
        return self.totals[segment]

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of which every shorter one also has at most ``budget`` tokens."""
        base, at = 0, -1  # the leading mark is no character of the text
        for segment in self.segments(text):
            own = self.total(segment)
            if base + own <= budget and (len(segment) == 1 or own <= budget - base - len(segment)):
                base, at = base + own, at + len(segment)
                continue
            inside = self.table(segment)
            over = np.flatnonzero(base + inside > budget)
            if len(over):
                return max(0, at + int(over[0]) - 1)
            base, at = base + own, at + len(segment)
        return max(0, at)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text", budget: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fit_chars) per row, no shuffle.

    ``fit_chars`` is the length of the longest prefix within ``budget`` tokens.
    Null and empty texts have no bytes and no tokens.  Rows are never merged;
    other columns are left behind.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [n for a, b in common.chunks([len(t or "") for t in texts], 4 * common.CHUNK_BYTES) for n in own.count(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([own.longest_prefix(t, budget) if n > budget else len(t or "") for t, n in zip(texts, tokens, strict=True)], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "fit_chars"],
            )

    return common.arrow_map(rows, run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
