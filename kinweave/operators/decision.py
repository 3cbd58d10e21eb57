"""Which scored pairs are accepted: rules per entity, one owner per record, tuning on a grid.

A scored table is (e, r, s[, y]): entity, record, score, truth. Rules need the rank in the entity, its best and its
second score, which ``ranked`` adds once.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluate import f_beta


def ranked(scored: DataFrame) -> DataFrame:
    """Adds rk (ties by record), top and second (minus infinity where there is none)."""
    by = W.partitionBy("e").orderBy(F.col("s").desc(), "r")
    out = scored.withColumn("rk", F.row_number().over(by)).withColumn("second", F.lead("s").over(by))
    whole = W.partitionBy("e")
    second = F.coalesce(F.max(F.when(F.col("rk") == 1, F.col("second"))).over(whole), F.lit(float("-inf")))
    return out.withColumn("top", F.max("s").over(whole)).withColumn("second", second)


def rule(mechanism: str, **p: float | Column) -> Column:
    """Whether a ranked pair is accepted. Parameters may be columns, so that a whole grid is one query."""
    s, rk, top, second = (F.col(c) for c in ("s", "rk", "top", "second"))
    v = {k: x if isinstance(x, Column) else F.lit(x) for k, x in p.items()}
    rules = {
        "threshold": lambda: s >= v["t"],
        "top1": lambda: rk == 1,
        "top1_t": lambda: (rk == 1) & (s >= v["t"]),
        "top1_margin": lambda: (rk == 1) & (s >= v["t"]) & (top - second >= v["m"]),
        "multi": lambda: (s >= v["t"]) & (top - s <= v["delta"]),
        "multi_t2": lambda: (top >= v["t"]) & ((rk == 1) | (s >= v["t2"])) & (s >= F.least(v["t"], v["t2"])),
        "abs2": lambda: (top >= v["t1"]) & F.when(rk == 1, s >= v["t1"]).otherwise(s >= v["t2"]),
        "gmm": lambda: F.col("high") & (s >= v["t"]) & (F.col("high_mean") >= v["t"]),
    }
    return rules[mechanism]()


GMM = "e long, r long, s double, high boolean, high_mean double"


def two_components(scored: DataFrame, rounds: int = 50, least: int = 4) -> DataFrame:
    """(GMM): for each entity a mixture of two normals over its scores; ``high``: a pair more likely of the upper one.

    Starts at the least and greatest score; entities of fewer than ``least`` pairs or with equal scores are high throughout.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        s = group["s"].to_numpy()
        out = group[["e", "r", "s"]].assign(high=True, high_mean=float(s.mean()))
        if len(s) < least or np.ptp(s) < 1e-9:
            return out
        mean, var, share = np.array([s.min(), s.max()]), np.full(2, s.var() + 1e-6), np.array([0.5, 0.5])
        for _ in range(rounds):
            log = np.log(share) - 0.5 * np.log(var) - (s[:, None] - mean) ** 2 / (2 * var)
            part = np.exp(log - log.max(1, keepdims=True))
            part /= part.sum(1, keepdims=True)
            weight = part.sum(0) + 1e-12
            mean, share = part.T @ s / weight, weight / weight.sum()
            var = (part * (s[:, None] - mean) ** 2).sum(0) / weight + 1e-6
        up = int(mean.argmax())
        return out.assign(high=part[:, up] >= 0.5, high_mean=float(mean[up]))

    return scored.select(F.col("e").cast("long"), F.col("r").cast("long"), "s").groupBy("e").applyInPandas(fit, GMM)


def exclusive(decided: DataFrame, mode: str) -> DataFrame:
    """One owner per record, on a table with boolean ``acc``. "accepted": among accepted pairs of a record those with its best score stay (ties too);
    "all": only a pair that is its record's best over all candidates, and alone so."""
    of = W.partitionBy("r")
    if mode == "accepted":
        keep = F.col("s") >= F.max(F.when(F.col("acc"), F.col("s"))).over(of)
    elif mode == "all":
        best = F.max("s").over(of)
        near = decided.withColumn("__best", best).withColumn("__n", F.sum((F.col("s") >= F.col("__best") - 1e-12).cast("int")).over(of))
        return near.withColumn("acc", F.col("acc") & (F.col("s") >= F.col("__best") - 1e-12) & (F.col("__n") == 1)).drop("__best", "__n")
    else:
        return decided
    return decided.withColumn("acc", F.col("acc") & keep)


def bucket(n: Column) -> Column:
    """Entities by their number of candidates; bounds belong to the lower part."""
    return F.when(n <= 1, "0-1").when(n <= 4, "2-4").when(n <= 20, "5-20").otherwise("20+")


def hybrid(frame: DataFrame, choice: dict[str, tuple[str, dict]]) -> Column:
    """A rule for each bucket of candidate counts (column n)."""
    acc = F.lit(False)
    for name, (mechanism, p) in choice.items():
        acc = F.when(bucket(F.col("n")) == name, rule(mechanism, **p)).otherwise(acc)
    return acc


def with_margin(mechanism: str, unseen: Column, margin: float, **p: float) -> Column:
    """The rule, stricter by a margin (below 0.999) where ``unseen`` holds. The sum is the decimal one: 0.4 and 0.55 give 0.95, which a score of 0.95 reaches."""
    first = "t1" if "t1" in p else "t"
    return F.when(unseen, rule(mechanism, **{**p, first: min(0.999, round(p[first] + margin, 12))})).otherwise(rule(mechanism, **p))


STEP = [round(0.05 * i, 3) for i in range(1, 20)]
GRIDS = {
    "threshold": {"t": [round(0.025 * i, 3) for i in range(41)]},
    "top1": {},
    "top1_t": {"t": [round(0.025 * i, 3) for i in range(41)]},
    "top1_margin": {"t": [round(0.05 * i, 3) for i in range(21)], "m": [0.0, 0.05, 0.1, 0.2, 0.3]},
    "multi": {"t": [round(0.025 * i, 3) for i in range(41)], "delta": [0.05, 0.1, 0.2, 0.3]},
    "multi_t2": {"t": [round(0.05 * i, 3) for i in range(21)], "t2": [round(0.05 * i, 3) for i in range(21)]},
    "abs2": {"t1": [round(0.05 * i, 3) for i in range(21)], "t2": [round(0.05 * i, 3) for i in range(21)]},
    "gmm": {"t": [round(0.1 * i, 3) for i in range(11)]},
}


def grid(mechanism: str) -> list[dict[str, float]]:
    names = list(GRIDS[mechanism])
    points = [dict(zip(names, v, strict=True)) for v in product(*GRIDS[mechanism].values())]
    return [p for p in points if mechanism != "multi_t2" or p["t2"] <= p["t"]]


def tune(frame: DataFrame, truth: DataFrame, mechanism: str, points: list[dict[str, float]] | None = None, by: str | None = None) -> DataFrame:
    """(<by>, <parameters>, f05) for all points of a grid at once: each entity's pairs are decided for every point, summed per entity, then averaged.

    ``frame``: ranked, with y. ``truth``: (e, n_true, <by>) of all entities that count.
    """
    points = points or grid(mechanism)
    names = list(points[0]) if points else []
    spark, truth = frame.sparkSession, truth.select("e", "n_true", *([by] if by else []))
    if not names:
        points, names = [{"none": 0.0}], ["none"]
    table = spark.createDataFrame([tuple(p[n] for n in names) for p in points], ", ".join(f"`{n}` double" for n in names))
    every = F.broadcast(table)  # a few hundred rows, made here
    taken = frame.crossJoin(every).where(rule(mechanism, **{n: F.col(n) for n in names}))
    sums = taken.groupBy("e", *names).agg(F.sum("y").alias("tp"), F.count("*").alias("n_pred"))
    spine = truth.crossJoin(every).join(sums, ["e", *names], "left")
    score = f_beta(F.coalesce("tp", F.lit(0)), F.coalesce("n_pred", F.lit(0)), F.col("n_true"))
    return spine.groupBy(*([by] if by else []), *names).agg(F.round(F.avg(score), 6).alias("f05")).drop("none")


def best_point(tuned: DataFrame, names: list[str], by: str | None = None, conservative: bool = True) -> DataFrame:
    """The point with the best score (for each ``by``); among equals the most conservative one, of great thresholds and small deltas, or the first of the grid."""
    order = [F.col(n).desc() if conservative and n != "delta" else F.col(n).asc() for n in names]
    w = (W.partitionBy(by) if by else W.partitionBy(F.lit(0))).orderBy(F.col("f05").desc(), *order)
    return tuned.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")  # as many rows as the grid has points


def accept(frame: DataFrame, mechanism: str, p: dict[str, float], exclusivity: str = "off", labels: DataFrame | None = None) -> DataFrame:
    """The ranked frame with ``acc``: the rule's verdict under one owner per record ("off", "accepted", "all"). "auto" is "all"
    where no record of the labels (e, r) has two entities, else "off"."""
    if exclusivity == "auto":
        from .audit import shared_records

        exclusivity = "all" if shared_records(labels).isEmpty() else "off"
    return exclusive(frame.withColumn("acc", F.coalesce(rule(mechanism, **p), F.lit(False))), exclusivity)


def sole_owner(frame: DataFrame) -> DataFrame:
    """The pairs that exclusivity over all candidates can accept; no rule's parameters enter, so a grid can be tuned on what is left."""
    return exclusive(frame.withColumn("acc", F.lit(True)), "all").where("acc").drop("acc")


def tune_by_bucket(frame: DataFrame, truth: DataFrame, mechanisms: tuple[str, ...] = ("top1_t", "top1_margin", "multi", "threshold"), grids: dict[str, list[dict[str, float]]] | None = None) -> DataFrame:
    """(bucket, mechanism, f05, point): the best rule for each bucket of candidate counts, ``point`` a map of its parameters; earlier mechanisms win ties."""
    counts = frame.groupBy("e").agg(F.count("*").alias("n"))
    truth = truth.join(counts, "e", "left").withColumn("bucket", bucket(F.coalesce("n", F.lit(0))))
    out = None
    for i, m in enumerate(mechanisms):
        points = (grids or {}).get(m) or grid(m)
        names = list(points[0])
        best = best_point(tune(frame, truth, m, points, "bucket"), names, "bucket", conservative=False)
        one = best.select("bucket", F.lit(m).alias("mechanism"), "f05", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("point"), F.lit(i).alias("i"))
        out = one if out is None else out.unionByName(one)
    first = F.row_number().over(W.partitionBy("bucket").orderBy(F.col("f05").desc(), "i"))
    return out.withColumn("__n", first).where("__n = 1").drop("__n", "i")


def simulate_low_counts(frame: DataFrame, calib: DataFrame, held_out: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 4), mechanisms: tuple[str, ...] = ("top1_t", "top1_margin", "multi")) -> DataFrame:
    """(n, mechanism, point, calib_f05, f05): as if retrieval had found the best n only, with each rule tuned on ``calib`` and scored on ``held_out``, both (e, n_true)."""
    out = None
    for n in sizes:
        few = truncated(frame, n)
        for m in mechanisms:
            names = list(GRIDS[m])
            best = best_point(tune(few.join(calib.select("e"), "e", "left_semi"), calib, m), names, conservative=False).first().asDict()
            p = {k: best[k] for k in names}
            score = tune(few.join(held_out.select("e"), "e", "left_semi"), held_out, m, [p] if p else None)
            one = score.select(F.lit(n).alias("n"), F.lit(m).alias("mechanism"), F.to_json(F.create_map(*[F.lit(x) for kv in p.items() for x in kv]) if p else F.create_map()).alias("point"), F.lit(best["f05"]).alias("calib_f05"), "f05")
            out = one if out is None else out.unionByName(one)
    return out


GUARDS = [("cand_bucket", "2-4"), ("gt_type", "no_match"), ("cand_bucket", "0-1")]


def tournament(frames: dict[str, DataFrame], calib: DataFrame, held_out: DataFrame, mechanisms: tuple[str, ...], grids: dict[str, list[dict[str, float]]] | None = None, exclusivity: tuple[str, ...] = ("off", "all"),
               default: str | None = None, tolerance: float = 0.05, gate: float = 0.9) -> tuple[DataFrame, str]:
    """Every rule on every frame, with and without exclusivity, and rules by bucket: (system, point, calib_f05, stratum, value, <summaries>), and the winner.

    Rules are tuned on ``calib`` and judged on ``held_out``, both (e, n_true). A system falls out if it lies more than
    ``tolerance`` below the best of a guarded stratum (few candidates, no match), unless all do. The best of the others
    replaces the default only if it is better in a share ``gate`` of paired resamples of entities.
    """
    from .evaluate import bootstrap, per_entity, stratified

    pairs_of = lambda df, who: df.join(who.select("e"), "e", "left_semi")
    entities, reports = {}, []

    def judge(name: str, decided: DataFrame, point: str, score: float | None) -> None:
        entities[name] = per_entity(pairs_of(decided, held_out), held_out.select("e", "n_true")).withColumn("cand_bucket", bucket(F.col("cand_count")))
        told = [F.lit(name).alias("system"), F.lit(point).alias("point"), F.lit(score).cast("double").alias("calib_f05")]
        reports.append(stratified(entities[name], ["cand_bucket", "gt_type"]).select(*told, "*"))

    for variant, frame in frames.items():
        for mode in exclusivity:
            within = sole_owner(frame) if mode == "all" else frame
            for m in mechanisms:
                points = (grids or {}).get(m) or grid(m)
                best = best_point(tune(pairs_of(within, calib), calib, m, points), list(points[0]), conservative=False).first().asDict()
                score = best.pop("f05")
                judge(f"{variant}:{m}" + ("+excl" if mode == "all" else ""), accept(frame, m, best, mode), str(best), score)
        if choice := {r["bucket"]: (r["mechanism"], r["point"]) for r in tune_by_bucket(pairs_of(frame, calib), calib, tuple(m for m in mechanisms if m in ("top1_t", "top1_margin", "multi", "threshold")) or mechanisms[:1], grids).collect()}:
            counted = frame.withColumn("n", F.count("*").over(W.partitionBy("e")))
            judge(f"{variant}:by_bucket", counted.withColumn("acc", hybrid(counted, choice)), str(choice), None)
    table = reports[0]
    for r in reports[1:]:
        table = table.unionByName(r)
    rows = table.select("system", "stratum", "value", "f05").collect()  # a row for each system and stratum
    score = {(r["system"], r["stratum"], r["value"]): r["f05"] for r in rows}
    best_in = {g: max((v for (_, *k), v in score.items() if tuple(k) == g), default=None) for g in GUARDS}
    falls = {s for s in entities for g in GUARDS if (s, *g) in score and score[(s, *g)] < best_in[g] - tolerance}
    standing = [s for s in entities if s not in falls] or list(entities)
    top = max(standing, key=lambda s: score[(s, "all", "")])
    default = default or next(iter(entities))
    if top != default:
        both = entities[default].select("e", F.col("f05").alias("a")).join(entities[top].select("e", F.col("f05").alias("b")), "e")
        top = top if bootstrap(both, 400).first()["p_improve"] >= gate else default
    return table, top


def truncated(frame: DataFrame, n: int) -> DataFrame:
    """As if retrieval had found the best n only; ranked anew."""
    return ranked(frame.where(F.col("rk") <= n).drop("rk", "top", "second"))


def match_lists(decided: DataFrame, entities: DataFrame, sep: str = ",") -> DataFrame:
    """(e, matches): accepted records by falling score, one row per entity."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("acc"), F.struct((-F.col("s")).alias("s"), F.col("r").alias("r"))))), lambda x: x["r"].cast("string"))
    lists = decided.groupBy("e").agg(F.array_join(ordered, sep).alias("matches"))
    return entities.select("e").join(lists, "e", "left").withColumn("matches", F.coalesce("matches", F.lit("")))


def class_match_lists(near: DataFrame, ent: DataFrame, rec: DataFrame, t: float, delta: float, sep: str = ",") -> DataFrame:
    """As ``match_lists`` with the rule "multi", where all records of the entity's name (e, name; r, name) have score 1 besides the pairs ``near`` (e, r, s).

    Records of a name are listed once and the list joined, so that copies don't multiply into pairs.
    """
    key = F.when(F.col("name") != "", F.md5("name")).alias("class")
    ent, rec = ent.select("e", key), rec.select("r", key)
    one = F.struct((-F.col("s")).alias("s"), F.col("r").alias("r"))
    own = rec.where("class is not null").groupBy("class").agg(F.collect_list(F.struct(F.lit(-1.0).alias("s"), F.col("r").alias("r"))).alias("own"))
    other = near.join(ent, "e").join(rec.withColumnRenamed("class", "of"), "r").where("class is null or of is null or class != of")
    other = other.groupBy("e").agg(F.collect_list(one).alias("other"))
    none = F.array().cast("array<struct<s: double, r: bigint>>")
    lists = ent.join(own, "class", "left").join(other, "e", "left").select("e", F.array_sort(F.concat(F.coalesce("own", none), F.coalesce("other", none))).alias("all"))
    taken = F.filter("all", lambda x: (-x["s"] >= t) & (-F.col("all")[0]["s"] + x["s"] <= delta))
    return lists.select("e", F.array_join(F.transform(taken, lambda x: x["r"].cast("string")), sep).alias("matches"))


def candidate_lists(cand: DataFrame, entities: DataFrame, sep: str = ",") -> DataFrame:
    """(e, candidates): distinct candidates in order, one row per entity."""
    lists = cand.groupBy("e").agg(F.array_join(F.transform(F.array_sort(F.collect_set("r")), lambda x: x.cast("string")), sep).alias("candidates"))
    return entities.select("e").join(lists, "e", "left").withColumn("candidates", F.coalesce("candidates", F.lit("")))
