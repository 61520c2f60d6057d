"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A
text is compressed block by block with either; the difference of both sizes
per byte says which it resembles, and a logistic fit on other labelled texts
turns it into a probability of label 1.

Training takes a bounded sample, ``per_class`` labelled documents of each
label at most, chosen by a hash of their ids; every document is scored, whole.
The driver holds that sample, two dictionaries of ``dictionary`` bytes, and
the fit.

Cases: null text is scored as the empty text, whose difference is 0; without
labelled documents of both labels every score is the share of label 1 (0.5
without any); labels other than 0 and 1 are not learnt from; repeated rows are
scored alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.common import small_batches


@dataclass(frozen=True)
class Training:
    """``per_class``: documents of each label, half of them for the
    dictionaries and half for the fit. ``most_chars``: longer documents are
    not trained on. ``dictionary``: bytes of each. ``block``: bytes compressed
    at a time."""

    per_class: int = 3000
    most_chars: int = 50_000
    dictionary: int = 65_536
    block: int = 1024
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    block: int
    level: int


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


class Scorer:
    """Size differences of texts under a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes, block: int, level: int):
        self.block = block
        self.by = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=level)
            self.by.append(
                zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def difference(self, text: str | None) -> float:
        """(size under bad - size under good) / bytes."""
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0
        good, bad = (sum(len(c.compress(b)) for b in _blocks(data, self.block)) for c in self.by)
        return (bad - good) / len(data)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, lightly ridged."""
    mean, scale = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (p - y)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, spec: Training = Training()) -> Model | float:
    """A model from labelled documents outside the held-out fold, or the share
    of label 1 where a label is missing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id")
    texts = {}
    for q in (1, 0):
        ids = [r[0] for r in known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(spec.per_class).collect()]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(ids) if ids else F.lit(False))
        rows = rows.where(F.length("text").between(1, spec.most_chars)).orderBy(order, "doc_id", "text").limit(spec.per_class)
        texts[q] = [r["text"] for r in rows.collect()]
    total = sum(counts.values())
    if min(len(texts[0]), len(texts[1])) < 4:
        return counts.get(1, 0) / total if total else 0.5
    made = []
    for q in (1, 0):
        samples = [b for t in texts[q][::2] for b in _blocks(t.encode("utf-8", "replace"), spec.block)]
        try:
            made.append(zstandard.train_dictionary(spec.dictionary, samples, level=spec.level).as_bytes())
        except zstandard.ZstdError:  # too little text for a trained one: the text itself
            made.append(b"".join(samples)[-spec.dictionary :])
    scorer = Scorer(*made, spec.block, spec.level)
    x = np.array([scorer.difference(t) for q in (1, 0) for t in texts[q][1::2]])
    n = [len(texts[q][1::2]) for q in (1, 0)]
    y = np.repeat([1.0, 0.0], n)
    weight = np.repeat([counts[1] / n[0], counts[0] / n[1]], n)
    return Model(*made, *logistic(x, y, weight / weight.mean()), spec.block, spec.level)


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``out``."""
    if not isinstance(model, Model):
        return docs.withColumn(out, F.lit(float(model)))
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.good, model.bad, model.block, model.level)
        for texts in batches:
            x = np.array([scorer.difference(t) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -700, 700))))

    return docs.withColumn(out, run(F.col(text)))
