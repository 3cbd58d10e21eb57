"""From tables to matches in one go: candidates through several channels, a model of pairs with its calibration and decision, kept together.

Statistics are fitted once, on the training side, and stored as tables; encoding and retrieval only join them. A trained
system is a folder: the trees, the calibration, and settings as JSON.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import address_keys
from ..functions.text import ascii_norm, char_grams, words
from . import decision, evaluate, model
from . import retrieval as R

#: How each channel of cosines reads its column.
TEXT_CHANNELS = {"word": ("name", words), "char": ("name", char_grams), "addr_text": ("address", lambda c: char_grams(ascii_norm(F.coalesce(c, F.lit("")))))}


@dataclass
class Candidates:
    """Channels with their floor and number of candidates; ``fit`` on the training entities, then ``retrieve`` for any.

    Entities are (e, name, key, address, house, core, city, postal), records (r, ...) with the same columns; only those that
    a channel reads are needed. Address keys of more records than ``cap`` (which grows with the pool) find nothing.
    """

    channels: dict[str, dict] = field(default_factory=lambda: {"exact": {}, "word": {"k": 20, "floor": 0.4}})
    cap_least: int = 200
    cap_per_million: float = 200.0
    tables: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)

    def _tokens(self, df: DataFrame, key: str, channel: str) -> DataFrame:
        if channel == "addr":
            return R.explode_tokens(df, key, address_keys(F.col("house"), F.col("core"), F.col("city"), F.col("postal")))
        column, read = TEXT_CHANNELS[channel]
        return R.explode_tokens(df, key, read(F.col(column)))

    def fit(self, ent: DataFrame, folder: str) -> Candidates:
        """Write each channel's (token, df, idf) under the folder, which executors must share."""
        n = ent.count()
        for c in self.channels:
            if c not in ("exact", "phon"):
                path = f"{folder}/idf-{c}"
                R.idf(R.document_frequency(self._tokens(ent, "e", c)), n).write.mode("overwrite").parquet(path)
                table = ent.sparkSession.read.parquet(path)
                self.tables[c] = (table, R.unseen_idf(table, n))
        return self

    def encode(self, df: DataFrame, key: str, channel: str) -> DataFrame:
        """(id, token, w): vectors of a channel by the fitted statistics."""
        return R.vectors(self._tokens(df, key, channel), *self.tables[channel])

    def channel(self, name: str, ent: DataFrame, rec: DataFrame) -> DataFrame:
        """(e, r, s, rank) of one channel."""
        p = self.channels[name]
        if name in ("exact", "phon"):
            column = p.get("key", "key" if name == "exact" else "phon_key")
            return R.exact_channel(ent, rec, column)
        table, unseen = self.tables[name]
        if name == "addr":
            cap = R.resolve_cap(self.cap_least, self.cap_per_million, rec.count())
            return R.key_channel(self._tokens(ent, "e", name), self._tokens(rec, "r", name), table, unseen, p.get("k", 20), p.get("floor", 2.0), cap)
        pairs = R.cosine_pairs(self.encode(ent, "e", name), self.encode(rec, "r", name), table, p.get("floor", 0.4))
        return R.top_k(pairs, p.get("k", 20), p.get("tie_cap", 0))

    def retrieve(self, ent: DataFrame, rec: DataFrame) -> DataFrame:
        """The union of all channels (``retrieval.union``)."""
        return R.union({c: self.channel(c, ent, rec) for c in self.channels})


@dataclass
class Settings:
    features: list[str]
    mechanism: str = "multi"
    point: dict[str, float] = field(default_factory=dict)
    exclusivity: str = "off"
    calibrated_range: tuple[float, float] = (0.0, 1.0)
    train_countries: list[str] | None = None
    unseen_margin: float = 0.0


@dataclass
class System:
    trees: GBTClassificationModel
    isotonic: IsotonicRegressionModel
    settings: Settings

    def score(self, pairs: DataFrame) -> DataFrame:
        """Adds raw (the trees' probability) and s (calibrated; the raw score's place in the training range breaks ties)."""
        raw = model.predict(self.trees, pairs, self.settings.features, "raw")
        lo, hi = self.settings.calibrated_range
        fine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") - lo) / ((hi - lo) or 1.0)))
        told = self.isotonic.transform(raw)
        return told.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))) + 1e-6 * fine).drop("prediction")

    def decide(self, pairs: DataFrame) -> DataFrame:
        """Pairs (e, r, <features>[, country]) with scores, ranks and ``acc``; entities of countries that training lacked need a margin more."""
        s = self.settings
        frame = decision.ranked(self.score(pairs))
        if s.train_countries is None or not s.unseen_margin or "country" not in pairs.columns:
            return decision.accept(frame, s.mechanism, s.point, s.exclusivity)
        unseen = ~F.coalesce(F.col("country").isin(*s.train_countries), F.lit(False))
        taken = frame.withColumn("acc", F.coalesce(decision.with_margin(s.mechanism, unseen, s.unseen_margin, **s.point), F.lit(False)))
        return decision.exclusive(taken, s.exclusivity)

    def save(self, folder: str) -> None:
        self.trees.write().overwrite().save(f"{folder}/trees")
        self.isotonic.write().overwrite().save(f"{folder}/isotonic")
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")

    @staticmethod
    def load(folder: str) -> System:
        told = json.loads(SparkSession.active().read.text(f"{folder}/settings").first()[0])
        told["calibrated_range"] = tuple(told["calibrated_range"])
        return System(GBTClassificationModel.load(f"{folder}/trees"), IsotonicRegressionModel.load(f"{folder}/isotonic"), Settings(**told))


def train(pairs: DataFrame, truth: DataFrame, features: list[str], mechanism: str = "multi", points: list[dict[str, float]] | None = None, exclusivity: str = "off", rounds: int = 20, depth: int = 5, weights: str = "scale", seed: int = 7) -> System:
    """Fit trees on the pairs of split train_fit, calibrate and tune on calib.

    ``pairs``: (e, r, y, split, <features>[, country]); ``truth``: (e, n_true, split) of all entities. "auto" exclusivity
    looks at the true pairs of train_fit.
    """
    fit, calib = pairs.where("split = 'train_fit'"), pairs.where("split = 'calib'")
    trees = model.fit_trees(model.balanced(fit, weights), features, rounds=rounds, depth=depth, seed=seed)
    raw = model.predict(trees, calib, features, "raw")
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw.select("raw", F.col("y").cast("double").alias("label")))
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    countries = [r[0] for r in fit.select("country").where("country is not null").distinct().orderBy("country").collect()] if "country" in pairs.columns else None
    if exclusivity == "auto":
        from .audit import shared_records

        exclusivity = "all" if shared_records(fit.where("y = 1").select("e", "r")).isEmpty() else "off"
    system = System(trees, isotonic, Settings(list(features), mechanism, {}, exclusivity, (lo or 0.0, hi or 0.0), countries))
    frame = decision.ranked(system.score(calib))
    within = decision.sole_owner(frame) if exclusivity == "all" else frame
    names = list(decision.GRIDS[mechanism])
    best = decision.best_point(decision.tune(within, truth.where("split = 'calib'"), mechanism, points), names).first().asDict()
    system.settings.point = {n: best[n] for n in names}
    return system


def evaluated(system: System, pairs: DataFrame, truth: DataFrame, split: str, strata: list[str] | None = None) -> DataFrame:
    """``stratified`` results of a system on the entities of a split."""
    per = evaluate.per_entity(system.decide(pairs.where(F.col("split") == split)), truth.where(F.col("split") == split).select("e", "n_true"))
    return evaluate.stratified(per.withColumn("cand_bucket", decision.bucket(F.col("cand_count"))), strata or ["cand_bucket", "gt_type"])


def importances(trees: GBTClassificationModel, features: list[str], k: int = 25) -> list[tuple[str, float]]:
    """The k features with the greatest share of impurity removed; a feature's column of nulls counts with it."""
    told, n = trees.featureImportances.toArray(), len(features)
    rows = [(f, round(float(told[i] + told[n + i]), 6)) for i, f in enumerate(features)]
    return sorted(rows, key=lambda x: (-x[1], x[0]))[:k]


def unseen_margin(scored: DataFrame, truth: DataFrame, country: str | Column = "country", mechanism: str = "threshold", points: list[dict[str, float]] | None = None, least: int = 30) -> float:
    """How much higher the best threshold of a country lies than that of the others, on average over countries of ``least`` entities or more; 0 at least.

    ``scored``: ranked pairs with y of every country, each scored by a model that has not seen it; ``truth``: (e, n_true, country).
    """
    t = "t1" if mechanism == "abs2" else "t"
    names = list(decision.GRIDS[mechanism])
    told = truth.withColumn("__c", F.col(country) if isinstance(country, str) else country)
    shifts = []
    for c in [r[0] for r in told.groupBy("__c").count().where((F.col("count") >= least) & F.col("__c").isNotNull()).orderBy("__c").collect()]:
        sides = []
        for of in (F.col("__c") == c, F.col("__c") != c):
            who = told.where(of)
            sides.append(decision.best_point(decision.tune(scored.join(who.select("e"), "e", "left_semi"), who, mechanism, points), names, conservative=False).first()[t])
        shifts.append(sides[0] - sides[1])
    return round(max(0.0, sum(shifts) / len(shifts)), 6) if shifts else 0.0
