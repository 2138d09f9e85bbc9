"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1.  The vector of an n-gram is the
product of its letters' vectors, each rotated by its place; a text's vector is
the sum over its n-grams; a language's prototype is the sum of the unit vectors
of its training texts.  A text gets the language of the nearest prototype by
cosine.  Everything that is not a letter counts as one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayweave.llm import common

DIMENSIONS = 512
ORDER = 3
#: At most about so many labelled texts are used to learn prototypes.
TRAIN_ROWS = 20_000
UNDETERMINED = "und"
#: n-gram vectors kept by a Python worker (2 KB each).
CACHED_GRAMS = 50_000


class Encoder:
    """Vectors of texts; keeps letter vectors and a bounded table of n-gram vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 11):
        self.dimensions, self.order, self.seed = dimensions, order, seed
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, dtype=bool)
        self.is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        self._forget()

    def _forget(self) -> None:
        self.codes = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros(0, dtype=np.int64)
        self.table = np.zeros((0, self.dimensions), dtype=np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dimensions), dtype=np.float32)
        for place in range(self.order):
            letter = ((codes >> np.uint64(21 * (self.order - 1 - place))) & np.uint64(0x1FFFFF)).astype(np.int64)
            kinds, which = np.unique(letter, return_inverse=True)
            vectors = np.stack([np.roll(self._letter(int(c)), self.order - 1 - place) for c in kinds])
            out *= vectors[which]
        return out

    def _learn(self, codes: np.ndarray) -> None:
        """Adds n-grams to the table as far as it has room."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(self.codes) + len(new) > CACHED_GRAMS:
            self._forget()
            new = codes[:CACHED_GRAMS]
        if len(new):
            rows = np.concatenate((self.rows, np.arange(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate((self.table, self._bind(new)))
            merged = np.concatenate((self.codes, new))
            order = np.argsort(merged, kind="stable")
            self.codes, self.rows = merged[order], rows[order]

    def _sum(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), dtype=bool)
        total = counts[known].astype(np.float32) @ self.table[self.rows[at[known]]] if known.any() else np.zeros(self.dimensions, dtype=np.float32)
        rest = np.flatnonzero(~known)
        for i in range(0, len(rest), 4096):  # beyond the table's room
            part = rest[i : i + 4096]
            total = total + counts[part].astype(np.float32) @ self._bind(codes[part])
        return total

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text as packed code points, with counts."""
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        code[~self.is_letter[code]] = 0
        keep = code != 0
        keep[1:] |= code[:-1] != 0
        code = code[keep]
        n = len(code) - self.order + 1
        if n <= 0 or not code.any():
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        packed = np.zeros(n, dtype=np.uint64)
        for k in range(self.order):
            packed = (packed << np.uint64(21)) | code[k : n + k]
        return np.unique(packed, return_counts=True)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """One unit vector per text; zero for texts without a letter."""
        found = [self.grams(t or "") for t in texts]
        if found:
            self._learn(np.unique(np.concatenate([c for c, _ in found])))
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for i, (codes, counts) in enumerate(found):
            if len(codes):
                v = self._sum(codes, counts)
                out[i] = v / max(float(np.linalg.norm(v)), 1e-9)
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(dimensions: int, order: int) -> Encoder:
    """One encoder per Python worker and shape."""
    if (dimensions, order) not in _ENCODERS:
        _ENCODERS[(dimensions, order)] = Encoder(dimensions, order)
    return _ENCODERS[(dimensions, order)]


def learn(train: DataFrame, text: str = "text", label: str = "lang", *, dimensions: int = DIMENSIONS, order: int = ORDER, max_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by label from rows with a label and text.

    Labelled rows are thinned by a hash of the text to about ``max_rows``; the
    driver receives one vector per label only.  No labelled row: no prototype.
    """
    rows = train.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    keep_one_in = max(1, math.ceil(rows.count() / max_rows))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(keep_one_in)) == 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = _encoder(dimensions, order), {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in common.chunks([len(t) for t in texts]):
                for name, v in zip(labels[a:b], encoder.vectors(texts[a:b]), strict=True):
                    total[name] = total.get(name, 0.0) + v.astype(np.float64)
        for name, v in total.items():
            yield pa.RecordBatch.from_pydict({"label": [name] * dimensions, "i": np.arange(dimensions, dtype=np.int32), "v": np.round(v, 6)})

    parts = common.arrow_map(rows, sums, "label string, i int, v double")
    prototypes: dict[str, np.ndarray] = {}
    for r in parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():
        prototypes.setdefault(r["label"], np.zeros(dimensions, dtype=np.float32))[r["i"]] = r["v"]
    return prototypes


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", *, dimensions: int = DIMENSIONS, order: int = ORDER) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (cosine, 0 to 1) from the whole text.

    Null texts, texts without a letter, and any text when there are no
    prototypes get ``und`` and 0.  Ties go to the smaller label.  Columns of
    these two names are replaced; all others stay.
    """
    labels = sorted(prototypes)
    matrix = np.stack([prototypes[x] / max(float(np.linalg.norm(prototypes[x])), 1e-9) for x in labels]) if labels else np.zeros((0, dimensions), dtype=np.float32)
    df = df.drop("lang_pred", "score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(dimensions, order)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            names, scores = [], []
            for a, b in common.chunks([len(t or "") for t in texts]):
                v = encoder.vectors(texts[a:b])
                cosine = v @ matrix.T if labels else np.zeros((b - a, 1), dtype=np.float32)
                best = cosine.argmax(axis=1)
                for i in range(b - a):
                    seen = bool(labels) and v[i].any()
                    names.append(labels[best[i]] if seen else UNDETERMINED)
                    scores.append(min(1.0, max(0.0, round(float(cosine[i, best[i]]), 6))) if seen else 0.0)
            out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return common.arrow_map(df, predict, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows kept from training: remainder 2 of four folds; null ids are in training."""
    return F.coalesce(common.crc_fold(doc_id, 4) == 2, F.lit(False))
