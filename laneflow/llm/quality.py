"""Quality by compression: zstandard dictionaries of good and of bad text; whichever class's dictionaries make a
text smaller is the likelier one, and the difference per byte becomes a calibrated score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.llm.base import fresh, held_out, ship_code

THRESHOLD = 0.7
LEVEL = 3


class Model(NamedTuple):
    """Dictionaries of both classes and the logistic curve from the size difference to a score."""

    good: list[bytes]
    bad: list[bytes]
    window: int
    slope: float
    offset: float


def train_dictionaries(texts: list[str], size: int, parts: int) -> list[bytes]:
    """`parts` dictionaries, each of every `parts`-th text; the texts themselves where they are too few to train on."""
    found = []
    for part in range(parts):
        samples = [t.encode("utf-8", "replace") for t in texts[part::parts] if t]
        if not samples:
            continue
        try:
            found.append(zstandard.train_dictionary(size, samples).as_bytes())
        except zstandard.ZstdError:
            found.append(b"\n".join(samples)[-size:])
    return found


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for data in dictionaries:
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(
            dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        ))
    return made


def difference(text: str | None, good: list, bad: list, window: int) -> float:
    """(bytes with the bad dictionaries - bytes with the good ones) / bytes of the text, over windows of the whole
    text, so that late parts of long texts are still held against the dictionaries. 0 for no text."""
    data = (text or "").encode("utf-8", "replace")
    if not data or not good or not bad:
        return 0.0
    more = less = 0
    for start in range(0, len(data), window):
        piece = data[start : start + window]
        more += sum(len(c.compress(piece)) for c in bad)
        less += sum(len(c.compress(piece)) for c in good)
    return (more / len(bad) - less / len(good)) / len(data)


def calibrate(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of best fit (Newton's method, slightly damped)."""
    if not len(values):
        return 0.0, 0.0
    spread, centre = float(values.std()) or 1.0, float(values.mean())
    x = np.stack([(values - centre) / spread, np.ones(len(values))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def score(model: Model, value: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * value + model.offset))))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    longest: int = 32_768,
    dictionary_bytes: int = 65_536,
    parts: int = 2,
    window: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """A model of `per_class` labelled documents of each class at most, each of at most `longest` bytes.

    Held-out ids, null labels and ids with both labels are left out. The sample
    is drawn by a hash of the id, so it is the same at every run, and its size
    is bounded at any size of the tables (two thirds train, a third calibrates).
    Without both classes every text scores by the classes' shares alone.
    """
    marks = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
        .where("low = high")
    )
    draw = F.xxhash64(F.lit("quality"), F.col("_id"))
    chosen = [
        marks.where(F.col("low") == k).orderBy(draw, "_id").limit(per_class).select("_id", F.col("low").alias("_label"))
        for k in (0, 1)
    ]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class ids
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where(
        F.octet_length("_text").between(1, longest)
    )
    sample = (
        texts.join(picked, F.col("_doc") == F.col("_id"))
        .select("_label", "_text", (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("_fit"), draw.alias("_draw"), "_id")
        .orderBy("_draw", "_id", F.xxhash64("_text")).limit(2 * per_class).toPandas()
    )
    train = sample[~sample["_fit"]]
    good = train_dictionaries(train.loc[train["_label"] == 1, "_text"].tolist(), dictionary_bytes, parts)
    bad = train_dictionaries(train.loc[train["_label"] == 0, "_text"].tolist(), dictionary_bytes, parts)
    counts = {r["low"]: r["count"] for r in marks.groupBy("low").count().collect()}
    held = sample[sample["_fit"]] if sample["_fit"].any() else sample
    ready = compressors(good), compressors(bad)
    values = np.array([difference(t, *ready, window) for t in held["_text"]])
    slope, offset = calibrate(values, held["_label"].to_numpy(dtype=float))
    if slope <= 0 or not good or not bad:
        slope, offset = 0.0, math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    else:  # the sample's class shares are not the table's
        n1, n0 = float((held["_label"] == 1).sum()), float((held["_label"] == 0).sum())
        offset += math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)) - math.log((n1 + 1) / (n0 + 1))
    return Model(good, bad, window, slope, offset)


def with_score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """`docs` with the calibrated score of each whole text, 0 to 1; null and empty texts score as a difference of 0."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dictionaries of fixed size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        ready = compressors(fitted.good), compressors(fitted.bad)
        for texts in batches:
            yield pd.Series([score(fitted, difference(t, *ready, fitted.window)) for t in texts], dtype="float64")

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))


def classify(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, score, predicted (1 from `threshold` on) for every row; repeated rows and null ids are each answered."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(rows, model).select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, in its columns, whose score is at least `threshold`.

    Every row is judged by its own text, so repeated rows stay or go together; null and empty texts score as a
    difference of 0, a score equal to the threshold stays, ids and other columns do not matter, and an empty table
    gives an empty result.
    """
    name = fresh(docs, "_quality_score")
    return with_score(docs, model, name).where(F.col(name) >= threshold).drop(name)
