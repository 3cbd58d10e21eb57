"""Quality rules: counts of plain features, and a hashed n-gram log-likelihood ratio.

Byte n-grams are hashed to buckets. Two multinomials over the buckets are estimated, one from trusted texts, one from
the whole corpus; a text's score is the mean over its n-grams of the log of their ratio. A text is kept if it passes the
base rules and its score reaches a threshold, the one that best parts good from bad among labelled texts. There is no
sampling: the same text always fares the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_RE, table

GRAM = 4  # bytes
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: The trusted multinomial and the threshold come from at most so many labelled rows of each kind (those with the least
#: hashes of their ids). The corpus multinomial counts every text.
LABELLED_SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SPACE = " \t\n\v\f\r"
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], np.uint64)


def buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of the text's bytes, with a line end before and after it."""
    b = np.frombuffer(b"\n" + text.encode() + b"\n\0\0\0", np.uint8).astype(np.uint32)
    n = len(b) - GRAM + 1
    grams = b[:n] | b[1 : n + 1] << 8 | b[2 : n + 2] << 16 | b[3 : n + 3] << 24
    return grams * np.uint32(2654435769) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD_RE.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if n > WINDOW:
        # Hashes of words serve within one text only, to tell equal windows.
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        m = n - WINDOW + 1
        windows = sum(h[k : m + k] * p for k, p in enumerate(_POWERS))
        _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = count[place] > 1
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            edge[at] += 1
            np.subtract.at(edge, at + WINDOW, 1)
            repeated = int((edge.cumsum()[:n] > 0).sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


@dataclass
class QualityModel:
    """Log ratio of each bucket and the threshold; without labelled rows both are 0 and the score rejects nothing."""

    weights: np.ndarray
    threshold: float = 0.0

    def score(self, text: str) -> float:
        return float(self.weights[buckets(text)].mean())


def _sample(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").dropDuplicates(["id"])
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    return F.broadcast(parts[0].unionByName(parts[1]))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = LABELLED_SAMPLE) -> QualityModel:
    """Count n-grams of all texts and of the trusted ones (label 1), then find the threshold.

    Of labelled rows at most ``sample`` of each label count, those with the least hashes of their ids; rows without label or
    id are passed over. Where documents share an id, all are counted, and that of the least text stands for it when the
    threshold is found. Null texts are empty. Without trusted texts (an empty table too) all scores and the threshold are 0;
    without texts of both labels every score passes.
    """
    chosen = _sample(labels, id_col, label_col, sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(chosen, "id", "left").select("text", "label", "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_texts, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = buckets(text)
                np.add.at(all_texts, c, 1)
                if label == 1:
                    np.add.at(trusted, c, 1)
        at = np.flatnonzero(all_texts)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": all_texts[at], "trusted": trusted[at]})

    counted = rows.mapInArrow(count, "bucket long, n long, trusted long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted:  # BUCKETS at most
        raw[r["bucket"]], good[r["bucket"]] = r["n"], r["trusted"]
    if not good.sum():
        return QualityModel(np.zeros(BUCKETS))

    def logs(c: np.ndarray) -> np.ndarray:
        return np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))

    model = QualityModel(logs(good) - logs(raw))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.score(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["score", "label"])

    one = rows.where("label is not null").groupBy("id", "label").agg(F.min("text").alias("text"))  # twice ``sample`` rows at most
    labelled = one.select("text", "label").mapInArrow(scores, "score double, label int").toPandas().sort_values(["score", "label"])
    if len(set(labelled["label"])) < 2:
        model.threshold = -np.inf
        return model
    # Between two neighbouring scores, where the share of bad texts below is greatest less five times that of good ones.
    s, y = labelled["score"].to_numpy(), labelled["label"].to_numpy()
    gain = np.concatenate([[0.0], np.cumsum(np.where(y == 0, 1 / (y == 0).sum(), -5 / (y == 1).sum()))])
    between = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    gain[1:-1][s[1:] == s[:-1]] = -1
    model.threshold = float(between[int(gain.argmax())])
    return model


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, model: QualityModel, text_col: str = "text", min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """All columns of ``docs``, COUNTS, quality_score, base_failed and kept; columns of these names are replaced.

    One row for each, equal texts judged alike, ids of any type not looked at. A null, empty or blank text has no words and
    fails; texts are read whole, however long. A score equal to the threshold is kept. An empty table gives no rows.
    """
    added = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("quality_score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            counts = np.array([base_features(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            score = np.array([model.score(t) for t in texts], float)
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > most_repeated * counts[:, 0])
            kept = ~failed & (score >= model.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in counts.T), pa.array(score), pa.array(failed), pa.array(kept)], [*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality(docs, model).drop("text")
