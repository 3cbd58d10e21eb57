"""Features of candidate pairs. Set and equality measures are columns; edit kernels share one Arrow pass; null means not comparable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import ok, words


def idf_features(pairs: DataFrame, a: str, b: str, table: DataFrame, unseen: float, rare: float) -> DataFrame:
    """Adds sums of idf over shared and unshared tokens, greatest shared, numbers of rare ones, weighted Jaccard and tokens never seen.

    The pair's distinct tokens are looked up by a join with the table, so that no map of all tokens goes to the executors.
    """
    keys = ["e", "r"]
    x, y = F.array_distinct(words(F.col(a))), F.array_distinct(words(F.col(b)))
    tokens = pairs.where((F.size(x) > 0) & (F.size(y) > 0)).select(*keys, x.alias("x"), y.alias("y"), F.explode(F.array_union(x, y)).alias("token"))
    tokens = tokens.withColumns({"in_x": F.array_contains("x", F.col("token")), "in_y": F.array_contains("y", F.col("token"))}).drop("x", "y")
    known = tokens.join(table.select("token", "idf"), "token", "left")
    w, shared = F.coalesce("idf", F.lit(unseen)), F.col("in_x") & F.col("in_y")
    part = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    one = F.lit(1)
    sums = known.groupBy(*keys).agg(
        F.round(part(shared, w), 6).alias("shared_idf_sum"), F.round(F.coalesce(F.max(F.when(shared, w)), F.lit(0.0)), 6).alias("max_shared_idf"), F.round(part(~shared, w), 6).alias("unshared_idf_sum"),
        part(shared & (w >= rare - 1e-9), one).alias("rare_shared"), part(F.col("in_x") & ~F.col("in_y") & (w >= rare - 1e-9), one).alias("rare_unshared_ent"),
        part(shared & F.col("idf").isNull(), one).alias("unseen_shared"), part(~shared & F.col("idf").isNull(), one).alias("unseen_unshared"),
        F.round(part(shared, w) / F.sum(w), 6).alias("weighted_jaccard"),
    )
    return pairs.join(sums, keys, "left")


def rare_threshold(tokens: DataFrame, table: DataFrame, q: float) -> float:
    """Quantile of idf over all occurrences of tokens in the entities' names."""
    return tokens.join(table.select("token", "idf"), "token").agg(F.percentile("idf", F.lit(q))).first()[0]


def lexical(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the edit kernels and set measures of two columns."""
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    out = pairs.withColumn("__k", S.compare(x, y, "ratio", "token_sort", "token_set", "partial", "jaro_winkler"))
    out = out.withColumns({n: F.round(F.col(f"__k.{n}"), 6) for n in ("ratio", "token_sort", "token_set", "partial")})
    out = out.withColumn("jw", F.when(ok(F.col(a)) & ok(F.col(b)), F.round(F.col("__k.jaro_winkler"), 6))).drop("__k")
    return out.withColumns({n: F.round(c, 6) for n, c in S.set_measures(x, y).items()})


def relative(pairs: DataFrame, key: str, cols: list[str], prefix: str, pct: bool = True) -> DataFrame:
    """Adds for each column, within the pairs of one entity or record: rank (ties at the least), gap to the best, and share of ranks (ties at their mean)."""
    whole = W.partitionBy(key)
    out = {}
    for c in cols:
        v = F.coalesce(F.col(c), F.lit(0.0))
        out[f"{prefix}_{c}_rank"] = F.rank().over(whole.orderBy(v.desc()))
        out[f"{prefix}_{c}_gap"] = F.round(F.max(v).over(whole) - v, 6)
        if pct:
            ties = F.count("*").over(W.partitionBy(key, v))
            out[f"{prefix}_{c}_pct"] = F.round((F.rank().over(whole.orderBy(v)) + (ties - 1) / 2) / F.count("*").over(whole), 6)
    return pairs.withColumns(out)


FIELDS = ["name_key_eq", "jw_hi", "house_eq", "postal_eq", "city_eq", "street_hi"]


def agreements(pairs: DataFrame) -> dict[str, Column]:
    at_least = lambda c, t: F.when(F.col(c).isNotNull(), (F.col(c) >= t).cast("double"))
    return {"name_key_eq": F.col("name_key_eq"), "jw_hi": at_least("jw", 0.92), "house_eq": F.col("house_eq"), "postal_eq": F.col("postal_eq"), "city_eq": F.col("city_eq"), "street_hi": at_least("street_jw", 0.9)}


def agreement_weights(agree: DataFrame, fields: list[str]) -> DataFrame:
    """(field, agree_weight, differ_weight): log2 of the odds that true pairs agree or differ, against false ones; counts are smoothed, nulls are passed over."""

    def share(f: str, y: int) -> Column:
        return (F.count(F.when((F.col(f) == 1) & (F.col("y") == y), 1)) + 1) / (F.count(F.when(F.col(f).isNotNull() & (F.col("y") == y), 1)) + 2)

    one = agree.agg(*[share(f, y).alias(f"{f}_{y}") for f in fields for y in (0, 1)])
    rows = one.selectExpr(f"stack({len(fields)}, {', '.join(f'{chr(39)}{f}{chr(39)}, {f}_1, {f}_0' for f in fields)}) as (field, m, u)")
    return rows.select("field", F.round(F.log2(F.col("m") / F.col("u")), 6).alias("agree_weight"), F.round(F.log2((1 - F.col("m")) / (1 - F.col("u"))), 6).alias("differ_weight"))


def agreement_score(weights: dict[str, tuple[float, float]]) -> Column:
    """Sum of weights over fields; a null field adds nothing."""
    parts = [F.when(F.col(f) == 1, a).when(F.col(f) == 0, d).otherwise(0.0) for f, (a, d) in weights.items()]
    return sum(parts[1:], parts[0])


def hard_negatives(pairs: DataFrame, generic_quantile: float, cap: int, floor: float, upweight: float, no_match_floor: float) -> DataFrame:
    """(e, r, weight, strata): false pairs that look true, in five strata, the hardest ``cap`` of each (by out-of-fold score oof, from ``floor``), get more weight.

    Needs y, oof, has_true, jw, addr_tok_set, max_shared_idf, shared_idf_sum, char_rank.
    """
    neg, shares = F.col("y") == 0, F.coalesce(F.col("shared_idf_sum"), F.lit(0.0)) > 0
    cut = pairs.where(shares).agg(F.percentile("max_shared_idf", F.lit(generic_quantile))).first()[0] or 0.0
    jw, addr = F.coalesce("jw", F.lit(0.0)), F.coalesce("addr_tok_set", F.lit(0.0))
    strata = {
        "similar_name_diff_address": (jw >= 0.85) & (addr < 0.6), "similar_address_diff_name": (addr >= 0.8) & (jw < 0.7),
        "generic_shared_name": shares & (F.coalesce("max_shared_idf", F.lit(0.0)) <= cut), "high_ranked_retrieval_error": F.coalesce("char_rank", F.lit(99)) <= 2,
        "no_match_entity_high_score": ~F.col("has_true") & (F.col("oof") >= no_match_floor),
    }
    flagged = pairs.where(neg).select("e", "r", "oof", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in strata.items()]), lambda x: x.isNotNull())).alias("stratum"))
    hardest = flagged.withColumn("n", F.row_number().over(W.partitionBy("stratum").orderBy(F.col("oof").desc(), "e", "r"))).where((F.col("n") <= cap) & (F.col("oof") >= floor))
    return hardest.groupBy("e", "r").agg(F.lit(upweight).alias("weight"), F.array_join(F.array_sort(F.collect_set("stratum")), "+").alias("strata"))
