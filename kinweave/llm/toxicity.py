"""Toxicity by compression distance between two zstandard dictionaries.

Two dictionaries are made from labelled texts: one of what is peculiar to toxic texts, one of what is peculiar to
ordinary texts; both end with a dictionary trained on ordinary texts. Each window of a text is compressed with
either; where it is shorter with the toxic dictionary, it says what toxic texts say. A window is preceded by a stretch
that both dictionaries hold, so that it is always stored compressed and single matches show in its length. The lengths'
differences over a text's windows give a few numbers, and a logistic curve, fitted on the labelled texts, calibrates
them to a score, with the threshold at 0.5.

What is peculiar is found by short byte strings within words: those in a thirtieth of one kind's texts or more, four
times as often as in the other kind's, and beyond chance by a likelihood ratio test.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, without_cycles

#: At most so many labelled texts of each kind are gathered on the driver to make the dictionaries and fit the curve.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 1000, 3000
GRAM = 5  # code points
WINDOW = 8  # words
LEAD = 160  # bytes before each window
COMMON_BYTES = 2048
PECULIAR_BYTES = 4096


@dataclass
class Distance:
    """The two dictionaries and the curve; small, and sent to the executors as it is."""

    toxic: bytes = b""
    ordinary: bytes = b""
    common: bytes = b""
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _compressors(self):
        if "_pair" not in self.__dict__:
            params = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, window_log=16, hash_log=14, chain_log=14, search_log=6, target_length=64, min_match=GRAM, strategy=zstandard.STRATEGY_LAZY2)
            pair = []
            for own in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(own + self.common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                pair.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress)
            self._pair, self._lead = pair, self.common[-LEAD:]
        return (*self._pair, self._lead)

    def differences(self, text: str) -> np.ndarray:
        """Bytes saved by the toxic dictionary, for each window of the text; 0 for a text without words."""
        ordinary, toxic, lead = self._compressors()
        words = text.lower().split()
        windows = [lead + (" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, len(words), WINDOW)]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows] or [0])

    def features(self, text: str) -> list[float]:
        d = self.differences(text)
        top = np.sort(d)[::-1]
        out = [top[0], top[:3].mean(), d.mean(), top[: max(1, len(d) // 10)].mean()]
        out += [(d >= k).mean() for k in range(1, 7)] + [(d <= -1).mean(), (d <= -3).mean()]
        return out + [min((d >= k).sum(), 5) for k in (2, 3, 4)]

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text; 0 for all if nothing was learnt."""
        if not self.weights or not texts:
            return np.zeros(len(texts))
        x = (np.array([self.features(t) for t in texts], float) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _plain(text: str) -> str:
    """The words of a text in lower case, a blank before, between and after."""
    return f" {' '.join(text.lower().split())} "


def _text_counts(texts: list[str]) -> Counter:
    """In how many texts each short string within a word, with its ends, stands."""
    out: Counter = Counter()
    for t in texts:
        out.update(g for g in {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} if " " not in g[1:-1])
    return out


def _beyond_chance(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio statistic of a in n against b in m."""

    def fit(k: int, total: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((total - k) * math.log(1 - p) if total - k else 0.0)

    p = (a + b) / (n + m)
    if not 0 < p < 1:
        return 0.0
    return 2 * (fit(a, n, a / n) + fit(b, m, b / m) - fit(a, n, p) - fit(b, m, p))


def _peculiar(texts: list[str], own: Counter, n: int, other: Counter, m: int) -> bytes:
    """The stretches of words that peculiar strings cover, each once, the most frequent last."""
    grams = {g for g, c in own.items() if c >= n / 30 and c / n > 4 * other[g] / m and _beyond_chance(c, n, other[g], m) > 25}
    found: Counter = Counter()
    for t in texts:
        for w in set(t.split()):
            w, begin, end = f" {w} ", 0, -1
            for i in range(len(w) - GRAM + 1):
                if w[i : i + GRAM] in grams:
                    if i > end:
                        if end > 0:
                            found[w[begin:end]] += 1
                        begin = i
                    end = i + GRAM
            if end > 0:
                found[w[begin:end]] += 1
    # A stretch that doesn't begin a word stands in longer ones, or is rare.
    found = Counter({s: c for s, c in found.items() if s[0] == " " and c >= n / 30})
    return "".join(s for s, _ in sorted(found.items(), key=lambda x: (x[1], x[0]))).encode()[-PECULIAR_BYTES:]


def fit(toxic: list[str], ordinary: list[str]) -> Distance:
    """Make dictionaries and fit the curve; without texts of both kinds nothing is learnt and all scores are 0."""
    model = Distance()
    if not toxic or not ordinary:
        return model
    kinds = [[_plain(t) for t in texts] for texts in (toxic, ordinary)]
    counts = [_text_counts(k) for k in kinds]
    n, m = len(toxic), len(ordinary)
    model.toxic, model.ordinary = _peculiar(kinds[0], counts[0], n, counts[1], m), _peculiar(kinds[1], counts[1], m, counts[0], n)
    usual = [t.encode() for t in kinds[1]]
    del kinds, counts
    try:
        model.common = zstandard.train_dictionary(COMMON_BYTES, usual, level=3).as_bytes()
    except zstandard.ZstdError:  # too few texts
        model.common = b" ".join(usual)[:COMMON_BYTES]
    x = np.array([model.features(t) for t in toxic + ordinary], float)
    y = np.array([1.0] * n + [0.0] * m)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    # The kinds count as if toxic texts were as many as a fifth of the ordinary ones.
    weight = np.where(y == 1, max(1.0, m / (5 * n)), 1.0)
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-9, *[1e-3 * len(x)] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()
    return model


def _held_out(id_col: str, folds: int):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds) == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE) -> Distance:
    """Fit on labelled rows outside the held-out fold (crc32 of the id as text, modulo ``folds``, is 0).

    At most ``toxic_sample`` and ``ordinary_sample`` rows, those with the least hashes of their ids, go to the driver.
    Rows without label or id are passed over, null texts are empty; of rows that share an id that of the least text
    counts, with the least label. Without rows of both labels nothing is learnt.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~_held_out("id", folds)).groupBy("id").agg(F.min("label").alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((1, toxic_sample), (0, ordinary_sample))]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id").collect()
    return fit([r["text"] for r in rows if r["label"] == 1], [r["text"] for r in rows if r["label"] == 0])


def score_toxicity(docs: DataFrame, model: Distance, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of its text, 0 to 1; a column of that name is replaced.

    Every row gets a score, whatever its id, equal texts equal ones; null and empty texts that of no words. Texts are
    read whole. An empty table gives no rows.
    """
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_cycles()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts), pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, score_col="score").select("doc_id", _held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
