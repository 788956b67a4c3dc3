"""Quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts
labelled bad. A text is compressed with each, in pieces of ``PIECE`` bytes so
that the dictionaries matter as much in long texts as in short ones. The
normalised difference of the two sizes, with the overall compressibility and
the length to read it by, is calibrated to a probability by logistic
regression on labelled texts that built no dictionary.

The fit uses a bounded sample: at most ``SAMPLE`` rows of each class, half for
the dictionaries and half for calibration, in the order of a hash of their
``doc_id``, of texts of up to ``SAMPLE_CHARS`` characters. Scoring covers
every row and every whole text.

Defined results: null and empty texts get the score of a text without bytes;
labels that are null or name no document are not used; of several labels of
one document the lowest counts; without rows of both classes every score is
the share of good rows in the sample (0.5 without any). Extra columns are
ignored by ``score``; ``keep_good`` returns all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from codeweft.llm._words import buffers, slices
from codeweft.runtime import ship

SAMPLE = 2000
SAMPLE_CHARS = 20_000
DICT_BYTES = 110_000
PIECE = 512
LEVEL = 3
#: Scores from here on count as good.
THRESHOLD = 0.7


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; rows of fold 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    constant: float | None = None

    def _compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
        return tuple(out)

    def features(self, texts: Iterator[bytes]) -> np.ndarray:
        good, bad = self._compressors()
        rows = []
        for data in texts:
            pieces = _pieces(data)
            a, b = sum(len(good.compress(p)) for p in pieces), sum(len(bad.compress(p)) for p in pieces)
            difference = (b - a) / max(a + b, 1)
            ratio = np.log(max(a + b, 1) / (2 * len(data))) if data else 0.0
            length = np.log(len(data) + 1)
            rows.append([difference, ratio, ratio * ratio, difference * abs(difference), min(length, 8) * difference, length])
        return np.array(rows, dtype=float).reshape(-1, 6)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weight[0] + z @ self.weight[1:], -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside fold 2."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(fold(F.col("doc_id")) != 2)
    chosen = None
    for quality in (0, 1):
        part = marked.where(F.col("quality") == quality).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").collect()  # 2 * sample rows at most
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: r.text)}.values(), key=lambda r: r.doc_id)
    by = {q: [r.text.encode() for r in rows if r.quality == q] for q in (0, 1)}
    build = {q: [p for t in x[::2] for p in _pieces(t) if len(p) >= 32] for q, x in by.items()}
    rest = {q: x[1::2] for q, x in by.items()}
    blank = np.zeros(6)
    total = len(by[0]) + len(by[1])
    try:
        dicts = {q: zstandard.train_dictionary(DICT_BYTES, build[q]).as_bytes() for q in (0, 1)} if rest[0] and rest[1] else None
    except zstandard.ZstdError:  # too little text
        dicts = None
    if dicts is None:
        return Model(b"", b"", blank, blank + 1, np.zeros(7), len(by[1]) / total if total else 0.5)
    model = Model(dicts[1], dicts[0], blank, blank + 1, np.zeros(7))
    x = model.features(rest[1] + rest[0])
    y = np.array([1.0] * len(rest[1]) + [0.0] * len(rest[0]))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w, ridge = np.zeros(7), 0.1
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(7), z.T @ (p - y) + ridge * w)
    model.weight = w
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of each row's text as another column; it takes
    the place of one of that name."""
    ship(docs.sparkSession)
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offs = buffers(batch.column("text"))
            whole, cut = data.tobytes(), offs.tolist()
            scores = model.score([whole[a:b] for a, b in zip(cut, cut[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, DoubleType()))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns."""
    return score(docs, model, "__score").where(F.col("__score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
