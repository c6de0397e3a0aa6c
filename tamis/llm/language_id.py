"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of character n-grams, hashed to a fixed
number of features. Each language has a few centroids, found by spherical
k-means; the language of the centroid with the highest cosine is predicted. A
text that is further from it than texts of that language ever were is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tables import chunks, per_batch, written

FEATURES = 1 << 14
MAX_MODEL_BYTES = 128 << 20
_LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")
_PART = 1 << 20


def features(text: str, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 to ``n`` letters and gaps that occur in the whole
    text, and how often. What is no letter is a gap. Long texts are counted part
    by part."""
    points = np.frombuffer(_OTHER.sub(" ", text.lower()).encode("utf-32-le", "replace"), np.uint32)
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(points), _PART):
        part = points[at : at + _PART + n - 1]
        h = np.zeros(len(part), np.uint32)
        for k in range(n):
            own = len(part) - k
            h = (h[:own] * np.uint32(31) + part[k:] + np.uint32(1)) * np.uint32(2654435761)
            # an n-gram belongs to the part it starts in
            counts += np.bincount((h[: min(own, _PART)] >> np.uint32(18)).astype(np.int64), minlength=FEATURES)
    held = np.flatnonzero(counts)
    return held, counts[held]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, counts = features(text)
    weights = (np.log1p(counts) * idf[held]).astype(np.float32)
    return held, weights / (np.linalg.norm(weights) or 1.0)


def kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first row and those furthest from the ones chosen."""
    centres = rows[:1]
    while len(centres) < min(k, len(rows)):
        centres = np.vstack([centres, rows[np.argmin((rows @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.array([rows[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


@dataclass
class LanguageModel:
    """``centroids`` by (feature, centroid); each centroid's language and lowest accepted cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        held, weights = vector(text, self.idf)
        cosine = weights @ self.centroids[held]
        at = int(np.argmax(cosine))
        score = float(min(max(cosine[at], 0.0), 1.0))
        return self.languages[at], score, bool(score < self.floors[at])


def fit(labelled: DataFrame, per_language: int = 400, clusters: int = 4, slack: float = 0.3) -> LanguageModel | None:
    """A model from (text, lang), or None where nothing can be learned.

    Fitted on a bounded sample: of each language the ``per_language`` different
    texts of smallest hash that have a letter. A language's sample is one small group;
    the model has ``clusters`` centroids of 64 KB per language and may not
    exceed MAX_MODEL_BYTES. The rejection floor of a language is ``slack`` times
    the lowest cosine of its sample."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER)).select("lang", "text")
    hashed = usable.select("lang", "text", F.xxhash64("text").alias("h"))
    # the last hash to take of each language, found without the texts; equal texts count once
    order = Window.partitionBy("lang").orderBy("h")
    first = hashed.select("lang", "h").distinct().withColumn("r", F.row_number().over(order))
    limits = first.where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h")).collect()
    if len(limits) * clusters * FEATURES * 4 > MAX_MODEL_BYTES:
        raise ValueError("more languages than the model may hold: is lang a column of languages?")
    if not limits:
        return None
    last = F.create_map(*(F.lit(x) for r in limits for x in r))[F.col("lang")]
    sample = written(
        hashed.where(F.col("h") <= last).dropDuplicates(["lang", "h"]).select("lang", "text"), "language-sample"
    )

    def make():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = np.zeros(FEATURES, np.int64)
            for text in batch["text"].to_pylist():
                seen[features(text)[0]] += 1
            held = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["feature", "n"])

        return convert

    n = sample.count()
    idf = np.full(FEATURES, np.log(1 + n) + 1)
    spread = per_batch(sample.select("text"), "feature bigint, n bigint", make)
    for feature, seen in spread.groupBy("feature").agg(F.sum("n")).collect():  # at most FEATURES rows
        idf[feature] = np.log((1 + n) / (1 + seen)) + 1

    def train(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros((len(group), FEATURES), np.float32)
        for row, text in zip(rows, group["text"].sort_values()):
            held, weights = vector(text, idf)
            row[held] = weights
        centres = kmeans(rows, clusters)
        floor = slack * float((rows @ centres.T).max(axis=1).min())
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floor": floor, "centre": [c.tobytes() for c in centres]})

    found = sample.groupBy("lang").applyInPandas(train, "lang string, floor double, centre binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    centroids = np.array([np.frombuffer(r["centre"], np.float32) for r in found]).T
    return LanguageModel(idf, np.ascontiguousarray(centroids), [r["lang"] for r in found], np.array([r["floor"] for r in found]))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with lang_pred, score (the cosine, 0 to 1) and rejected.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text where no language was learned. Other texts get the nearest language and
    are marked where they are too far from it. Only the text is looked at;
    columns of ``docs`` with the result's names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_MODEL_BYTES
    kept = docs.schema.simpleString()[len("struct<") : -1]
    letters = docs.withColumn("__letter", F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)))

    def make():
        own = shared.value

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            has_letter = iter(batch["__letter"].to_pylist())
            for part in chunks(batch, "text"):
                for text in part["text"].to_pylist():
                    found.append(own.predict(text) if next(has_letter) and own else ("und", 0.0, True))
            base = batch.drop_columns(["__letter"])
            lang, score, rejected = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [*base.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*base.schema.names, "lang_pred", "score", "rejected"],
            )

        return convert

    return per_batch(letters, f"struct<{kept},lang_pred:string,score:double,rejected:boolean>", make)


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by checksum of the id, is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
