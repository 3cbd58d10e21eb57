"""How good decisions are: per entity, by strata, between systems; what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA2 = 0.25


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta2: float = BETA2) -> Column:
    """F of beta squared 0.25; 1 where there is nothing to find and nothing was found."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).otherwise((1 + beta2) * tp / (beta2 * n_true + n_pred))


def per_entity(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """(e, n_true, n_pred, tp, fp, fn, cand_count, f05, gt_type): ``decided`` has acc and y, ``truth`` has (e, n_true) of all entities."""
    sums = decided.groupBy("e").agg(F.count("*").alias("cand_count"), F.sum(F.col("acc").cast("int")).alias("n_pred"), F.sum((F.col("acc") & (F.col("y") == 1)).cast("int")).alias("tp"))
    out = truth.join(sums, "e", "left").fillna(0, ["cand_count", "n_pred", "tp"])
    kind = F.when(F.col("n_true") == 0, "no_match").when(F.col("n_true") == 1, "single").otherwise("multi")
    return out.select("e", "n_true", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), "cand_count", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f05"), kind.alias("gt_type"))


def summaries() -> list[Column]:
    """Ten statistics of a table of entities; rates of a kind of entity are null where there is none."""
    none, multi = F.col("gt_type") == "no_match", F.col("gt_type") == "multi"
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    mtp, mfp, mfn = (F.sum(F.when(multi, F.col(c))) for c in ("tp", "fp", "fn"))
    return [
        F.count("*").alias("entities"), F.round(F.avg("f05"), 4).alias("f05"),
        F.round(tp / at_least_one(tp + fp), 4).alias("pair_precision"), F.round(tp / at_least_one(tp + fn), 4).alias("pair_recall"),
        F.round(F.avg(F.when(none, (F.col("n_pred") > 0).cast("double"))), 4).alias("no_match_fp_rate"),
        F.round(F.when(mtp.isNotNull(), mtp / at_least_one(mtp + mfp)), 4).alias("multi_precision"), F.round(F.when(mtp.isNotNull(), mtp / at_least_one(mtp + mfn)), 4).alias("multi_recall"),
        F.round(F.avg("fp"), 4).alias("fp_per_entity"), F.round(F.avg("fn"), 4).alias("fn_per_entity"), F.round(F.avg("n_pred"), 4).alias("accepted_per_entity"),
    ]


def stratified(entities: DataFrame, strata: list[str]) -> DataFrame:
    """(stratum, value, <summaries>): all entities, then by each stratum; one scan with grouping sets."""
    told = entities.withColumns({f"by_{s}": F.col(s).cast("string") for s in strata})
    by = [f"by_{s}" for s in strata]
    sums = told.groupingSets([[], *([F.col(b)] for b in by)], *by).agg(*[F.grouping(b).alias(f"no_{b}") for b in by], *summaries())
    name, value = F.lit("all"), F.lit("")
    for s, b in zip(strata, by, strict=True):
        name, value = F.when(F.col(f"no_{b}") == 0, s).otherwise(name), F.when(F.col(f"no_{b}") == 0, F.col(b)).otherwise(value)
    return sums.select(name.alias("stratum"), value.alias("value"), *[c for c in sums.columns if c not in by and not c.startswith("no_by_")])


def pred_sets(decided: DataFrame, entities: DataFrame) -> DataFrame:
    """(e, records): the set of accepted records, empty where there is none; one row per entity."""
    sets = decided.where("acc").groupBy("e").agg(F.array_sort(F.collect_set("r")).alias("records"))
    return entities.select("e").join(sets, "e", "left").withColumn("records", F.coalesce("records", F.array().cast(sets.schema["records"].dataType)))


def score_lists(lists: DataFrame, labels: DataFrame, entities: DataFrame, sep: str = ",") -> DataFrame:
    """(entities, f05): mean score of an output (e, ids) against labels (e, r); an entity that is missing predicts nothing."""
    said = lists.select("e", F.explode(F.split("ids", sep)).alias("r")).where("r <> ''").distinct().withColumn("p", F.lit(1))
    true = labels.select("e", "r").distinct().withColumn("t", F.lit(1))
    sums = said.join(true, ["e", "r"], "full").groupBy("e").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"))
    spine = entities.select("e").join(sums, "e", "left").fillna(0, ["n_pred", "n_true", "tp"])
    return spine.agg(F.count("*").alias("entities"), F.round(F.avg(f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("f05"))


CLASSES = ["no_match_false_positive", "over_selection", "retrieval_miss", "multi_under_selection", "model_miss", "decision_miss"]


def diagnosis(analysis: DataFrame, target: float = 0.95) -> DataFrame:
    """(measure, n, value): where to look first, on ``score_analysis``: share of true pairs retrieved and whether it reaches the
    target, share of entities whose best true score beats the best false one, and what share of failures each class makes."""
    seen = (F.col("retrieved_true") > 0) & F.col("best_false_score").isNotNull()
    told = analysis.withColumn("class", error_class())
    share = lambda a, b: F.round(a / F.when(b > 0, b), 6)
    failures = F.count(F.when(F.col("class") != "correct", 1))
    found = share(F.sum("retrieved_true"), F.sum("n_true"))
    rows = [("recall", F.sum("n_true"), found), ("reaches_target", F.count("*"), (found >= target).cast("double")), ("separated", F.count(F.when(seen, 1)), share(F.count(F.when(seen & (F.col("best_true_score") > F.col("best_false_score")), 1)), F.count(F.when(seen, 1))))]
    rows += [(c, F.count(F.when(F.col("class") == c, 1)), share(F.count(F.when(F.col("class") == c, 1)), failures)) for c in CLASSES]
    one = told.agg(*[n.cast("long").alias(f"n_{m}") for m, n, _ in rows], *[v.alias(f"v_{m}") for m, _, v in rows])
    return one.selectExpr(f"stack({len(rows)}, " + ", ".join(f"'{m}', n_{m}, v_{m}" for m, _, _ in rows) + ") as (measure, n, value)")


def ambiguous_share(analysis: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """(errors, ambiguous, share): entities decided wrongly whose best score lies between the bounds, bounds included."""
    wrong = analysis.withColumn("class", error_class()).where("class != 'correct'")
    n = F.count(F.when(F.col("best_score").between(low, high), 1))
    return wrong.agg(F.count("*").alias("errors"), n.alias("ambiguous"), F.round(n / F.greatest(F.count("*"), F.lit(1)), 6).alias("share"))


def miss_kinds(missed: DataFrame, a: str, b: str) -> DataFrame:
    """(kind, pairs) of true pairs that retrieval missed: the record has no name, at most one word is shared, or names are alike but others came before."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}_]+"), 0))
    kind = F.when(F.trim(F.coalesce(F.col(b), F.lit(""))) == "", "missing_name").when(F.coalesce(F.size(F.array_intersect(tokens(a), tokens(b))), F.lit(0)) <= 1, "non_lexical").otherwise("outranked")
    return missed.groupBy(kind.alias("kind")).agg(F.count("*").alias("pairs"))


def score_analysis(decided: DataFrame, truth: DataFrame, t: float) -> DataFrame:
    """Per entity: best and second score, best true and false score, least rank of a true pair, counts, gaps, pairs above t."""
    yes, acc = F.col("y") == 1, F.col("acc")
    d = decided.groupBy("e").agg(
        F.count("*").alias("cand_count"), F.max("s").alias("best_score"), F.max(F.when(F.col("rk") == 2, F.col("s"))).alias("second_score"), F.max(F.when(yes, F.col("s"))).alias("best_true_score"),
        F.max(F.when(~yes, F.col("s"))).alias("best_false_score"), F.min(F.when(yes, F.col("rk"))).alias("true_rank"), F.sum("y").alias("retrieved_true"),
        F.sum(acc.cast("int")).alias("n_accepted"), F.sum((acc & yes).cast("int")).alias("tp"), F.sum((F.col("s") >= t).cast("int")).alias("n_above_t"),
    )
    out = truth.join(d, "e", "left").fillna(0, ["cand_count", "retrieved_true", "n_accepted", "tp", "n_above_t"])
    return out.withColumns({"fp": F.col("n_accepted") - F.col("tp"), "fn": F.col("n_true") - F.col("tp"), "score_gap_top2": F.col("best_score") - F.col("second_score"), "true_false_gap": F.col("best_true_score") - F.col("best_false_score")})


def error_class() -> Column:
    """The one thing that went wrong with an entity, on ``score_analysis``."""
    tp, fp, fn, found = (F.col(c) for c in ("tp", "fp", "fn", "retrieved_true"))
    some = F.when(fp > 0, "over_selection").when(found == tp, "retrieval_miss").otherwise("multi_under_selection")
    none = F.when(found == 0, "retrieval_miss").when(F.col("best_false_score") > F.col("best_true_score"), "model_miss").otherwise("decision_miss")
    return F.when((fp == 0) & (fn == 0), "correct").when(F.col("n_true") == 0, "no_match_false_positive").when(tp > 0, some).otherwise(none)


def bootstrap(pairs: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(diff, lo, hi, p_improve): paired bootstrap over entities of (e, a, b). Each resample gives an entity a Poisson(1) weight
    made from a hash, so that a resample is a sum in place of a draw, and the entities stay where they are."""
    u = (F.xxhash64(F.lit(seed), "e", "k").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    cuts, p, total = [], 2.718281828459045**-1, 0.0
    for i in range(8):
        total += p
        cuts.append(total)
        p /= i + 1
    weight = sum(((u > c).cast("int") for c in cuts[1:]), (u > cuts[0]).cast("int"))
    rows = pairs.select("e", (F.col("b") - F.col("a")).alias("d")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    means = rows.groupBy("k").agg((F.sum(weight * F.col("d")) / F.greatest(F.sum(weight), F.lit(1))).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.05)).alias("lo"), F.percentile("m", F.lit(0.95)).alias("hi"), F.avg((F.col("m") > 0).cast("double")).alias("p_improve")).crossJoin(pairs.agg(F.avg(F.col("b") - F.col("a")).alias("diff")))


def regressions(before: DataFrame, after: DataFrame, drop: float = 0.02, least: int = 25) -> DataFrame:
    """Strata of ``least`` entities or more whose score falls by more than ``drop``."""
    both = before.select("stratum", "value", F.col("f05").alias("f05_before")).join(after.select("stratum", "value", "entities", F.col("f05").alias("f05_after")), ["stratum", "value"])
    return both.where((F.col("entities") >= least) & (F.col("f05_before") - F.col("f05_after") > drop))


def pair_quality(scored: DataFrame) -> DataFrame:
    """(auc, log_loss) of scores against y: the area from ranks with ties at their mean; scores clipped to 1e-6 from 0 and 1.

    Ranks come from counts of distinct scores (rounded to nine digits), cumulated over ranges, not from a sort of all pairs.
    """
    from pyspark.sql import Window as W

    by = scored.groupBy(F.round("s", 9).alias("s")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cut = by.withColumn("part", F.floor(F.col("s") * 256))
    parts = cut.groupBy("part").agg(F.sum("neg").alias("n")).withColumn("below", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "below")
    within = F.sum("neg").over(W.partitionBy("part").orderBy("s")) - F.col("neg")
    area = cut.withColumn("within", within).join(parts, "part").agg((F.sum(F.col("pos") * (F.col("below") + F.col("within") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("s")))
    loss = scored.agg((-F.avg(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"))
    return area.crossJoin(loss).select(F.round("auc", 6).alias("auc"), F.round("log_loss", 6).alias("log_loss"))
