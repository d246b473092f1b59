"""Quality classifier from compression with good and bad dictionaries.

Two zstandard dictionaries are built from good and bad labelled texts.  A text is
compressed whole with either and without any; the normalised size difference
(bad minus good over their sum), the size without a dictionary per byte and the
length are the inputs of a logistic calibration.  Labels, language, source and id
are never inputs.

The fit uses a bounded sample: at most ``SAMPLE`` labelled texts of each class, one an id, of
at most ``SAMPLE_BYTES`` bytes each (dictionaries from the first 60 %, calibration
from the rest, which the dictionaries have not seen).  Scoring is one
``mapInArrow`` over all documents; the model (a few hundred kilobytes, fixed by
``DICT_BYTES``) is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 1500
SAMPLE_BYTES = 32 << 10
DICT_BYTES = 112 << 10
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    _tools: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_tools": None}

    def compressors(self):
        import zstandard as zstd
        if self._tools is None:
            tools = [zstd.ZstdCompressor(level=LEVEL)]
            for content in (self.good, self.bad):
                d = zstd.ZstdCompressionDict(content)
                d.precompute_compress(level=LEVEL)
                tools.append(zstd.ZstdCompressor(dict_data=d))
            self._tools = tuple(tools)
        return self._tools

    def features(self, texts: list[bytes]) -> np.ndarray:
        plain, good, bad = self.compressors()
        size = np.array([(len(plain.compress(t)), len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], float).reshape(-1, 4)
        p, g, b, n = size.T
        difference = (b - g) / (b + g)
        ratio = p / (n + 20.0)
        length = np.log(n + 20.0)
        return np.stack([difference, ratio, ratio ** 2, length, ratio * length, difference * length, difference ** 2], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = (self.features(texts) - self.center) / self.scale
        z = np.clip(np.c_[np.ones(len(x)), x] @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-z))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts' end as plain content where they are too few."""
    import zstandard as zstd
    try:
        return zstd.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:] or b"\n\n\n\n\n\n\n\n"


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + ridge * np.eye(len(beta)) * w.sum()
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * w.sum() * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def usable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where(F.octet_length("text").between(1, SAMPLE_BYTES))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, int]]:
    """(doc_id, label) of the fit: of the rows outside the held-out fold that have a
    text of usable length at most ``sample`` per class, by hash of the id.  Ids with
    both labels or a null are out."""
    outside = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    one = labels.where(outside & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    one = one.join(usable(docs).select("doc_id").distinct(), "doc_id", "left_semi")
    out = []
    for q in (0, 1):
        rows = one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id").collect()
        out += [(int(r[0]), q) for r in rows]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries and calibration from the bounded sample.  Without texts of both
    classes the score is 0.5 for every text."""
    rows = training_rows(docs, labels, sample)
    spark = docs.sparkSession
    wanted = spark.createDataFrame(rows, "doc_id long, quality int")
    found = usable(docs).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    texts = {q: [] for q in (0, 1)}
    for r in sorted(found.select(F.xxhash64("doc_id"), "doc_id", "quality", "text").collect()):
        texts[r[2]].append(r[3].encode())
    cut = {q: int(len(t) * 0.6) for q, t in texts.items()}
    model = Model(_dictionary(texts[1][:cut[1]]), _dictionary(texts[0][:cut[0]]), np.zeros(7), np.ones(7), np.zeros(8))
    rest = [(t, q) for q in (0, 1) for t in texts[q][cut[q]:]]
    y = np.array([q for _, q in rest], float)
    if 0 < y.sum() < len(y):
        x = model.features([t for t, _ in rest])
        model.center, model.scale = x.mean(0), x.std(0) + 1e-9
        w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        model.weights = _logistic((x - model.center) / model.scale, y, w)
    return model


def _scorer(model):
    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(texts), pa.float64())], names=["doc_id", "score"])
    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per document; null counts as the empty text, repeated
    rows are scored one by one, no other column is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(_scorer(sent), "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs, fit(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
