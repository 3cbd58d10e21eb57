"""The table of features of candidate pairs that scoring needs, in groups that can be left out.

Each side's columns are joined once; edit kernels of all columns run in one Arrow pass, everything else is expressions.
Null means that a side lacks what is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import words
from . import features

#: What a side may bring; a column that it lacks counts as null throughout.
SIDE = ["name", "name_fold", "name_key", "legal", "name_mp", "name_ny", "house", "unit", "street", "city", "region", "postal", "country", "address"]
CHANNELS = ["exact", "char", "word", "addr", "addr_text", "name_geo", "phon"]
GROUPS = ("lexical", "phonetic", "idf", "address", "missing", "retrieval", "fs", "relative_entity", "relative_record")


def active_channels(cand: DataFrame) -> list[str]:
    """Channels that a union holds."""
    return [c for c in CHANNELS if f"hit_{c}" in cand.columns]


def feature_columns(columns: list[str], groups: set[str]) -> list[str]:
    """The columns of a feature table that a choice of groups keeps; what belongs to no optional group stays."""
    optional = {
        "relative_entity": lambda c: c.startswith("rel_") or c == "cand_count",
        "relative_record": lambda c: c.startswith("recrel_") or c == "rec_n_entities",
        "fs": lambda c: c == "fs_weight",
        "unseen_counts": lambda c: c.startswith("unseen_"),
    }
    return [c for c in columns if all(g in groups or not belongs(c) for g, belongs in optional.items())]


def share_of_tokens(a: Column, b: Column, of: str = "union") -> Column:
    """Common distinct tokens over those of both sides (``union``) or of the first (``left``); null where a side has none."""
    x, y = F.array_distinct(words(F.coalesce(a, F.lit("")))), F.array_distinct(words(F.coalesce(b, F.lit(""))))
    whole = F.size(F.array_union(x, y)) if of == "union" else F.size(x)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.round(F.size(F.array_intersect(x, y)) / whole, 6))


def number_overlap(a: Column, b: Column) -> Column:
    """Common numbers of two arrays over all of them; null where a side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6))


def phonetic(pairs: DataFrame) -> DataFrame:
    e, r = F.col("e_name_mp"), F.col("r_name_mp")
    same = share_of_tokens(e, r)
    return pairs.withColumns({"phon_mp_jacc": same, "phon_ny_jacc": share_of_tokens(F.col("e_name_ny"), F.col("r_name_ny")), "phon_key_eq": (same == 1).cast("double")})


def missing(pairs: DataFrame, sources: list[str]) -> DataFrame:
    """Which parts each side has, and the record's source as its place in the list (-1: none of them)."""
    has = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("int")
    out = {"e_has_name": has("e_name"), "r_has_name": has("r_name"), "e_has_addr": has("e_address"), "r_has_addr": has("r_address"), "r_has_postal": has("r_postal"), "r_has_city": has("r_city")}
    out["r_source"] = F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col("r_source_name")).cast("int"), F.lit(0)) - 1
    return pairs.withColumns(out)


def build(cand: DataFrame, ent: DataFrame, rec: DataFrame, groups: set[str] | None = None, idf: DataFrame | None = None, unseen: float = 0.0, rare: float = 0.0,
          weights: dict[str, tuple[float, float]] | None = None, cosines: dict[str, DataFrame] | None = None, sources: list[str] | None = None) -> DataFrame:
    """(e, r, <features>): one row per candidate pair (e, r, and what ``union`` adds).

    ``ent`` (e, ...) and ``rec`` (r, ..., source) hold columns of SIDE and ``numbers``. ``cosines``: pair tables (e, r, t) by
    the name of their column (char_cos, word_cos, addr_text_cos). ``idf`` with ``unseen`` and ``rare`` serves the group "idf",
    ``weights`` the group "fs". A pair whose entity or record isn't known has nulls; ids must be unique on each side.
    """
    groups = set(GROUPS) if groups is None else groups
    pairs = cand
    for side, table in (("e", ent), ("r", rec)):
        own = [(F.col(c) if c in table.columns else F.lit(None).cast("string")).alias(f"{side}_{c}") for c in SIDE]
        numbers = F.col("numbers") if "numbers" in table.columns else F.array().cast("array<string>")
        more = [F.col("source").alias("r_source_name") if "source" in table.columns else F.lit(None).cast("string").alias("r_source_name")] if side == "r" else []
        pairs = pairs.join(table.select(side, *own, numbers.alias(f"{side}_numbers"), *more), side, "left")
    for name, table in (cosines or {}).items():
        pairs = pairs.join(table.select("e", "r", F.col("t").alias(name)), ["e", "r"], "left").fillna(0.0, [name])
    e, r = (lambda c: F.col(f"e_{c}")), (lambda c: F.col(f"r_{c}"))
    text = lambda c: F.coalesce(c, F.lit(""))
    both = lambda c: (F.trim(text(e(c))) != "") & (F.trim(text(r(c))) != "")
    kernel = {"__n": ("name", ["jaro_winkler", "ratio", "token_sort", "token_set", "partial"]), "__f": ("name_fold", ["ratio"]), "__s": ("street", ["jaro_winkler", "token_set"]), "__c": ("city", ["jaro_winkler"]), "__a": ("address", ["token_set"])}
    pairs = pairs.withColumns({k: S.compare(text(e(c)), text(r(c)), *names) for k, (c, names) in kernel.items()})
    value = lambda k, n: F.round(F.col(f"{k}.{n}"), 6)
    out = {f"{c}_eq": S.equal(e(c), r(c)) for c in ("name_key", "house", "postal", "city")}
    out |= {"jw": F.when(both("name"), value("__n", "jaro_winkler")), "street_jw": F.when(both("street"), value("__s", "jaro_winkler")), "addr_tok_set": F.when(both("address"), value("__a", "token_set"))}
    if "lexical" in groups:
        out |= {"lev": value("__n", "ratio"), "tok_sort": value("__n", "token_sort"), "tok_set": value("__n", "token_set"), "partial": value("__n", "partial"), "lev_fold_full": value("__f", "ratio")}
        out |= {n: F.round(c, 6) for n, c in S.set_measures(text(e("name")), text(r("name"))).items()} | {"legal_eq": S.equal(e("legal"), r("legal"))}
    if "address" in groups:
        out |= {f"{c}_eq": S.equal(e(c), r(c)) for c in ("unit", "region", "country")}
        out |= {"city_jw": F.when(both("city"), value("__c", "jaro_winkler")), "street_tok_set": F.when(both("street"), value("__s", "token_set"))}
        out |= {"postal_prefix_eq": S.equal(F.substring(e("postal"), 1, 3), F.substring(r("postal"), 1, 3)), "num_overlap": number_overlap(e("numbers"), r("numbers")), "addr_containment": share_of_tokens(e("address"), r("address"), "left")}
    pairs = pairs.withColumns(out)
    if "phonetic" in groups:
        pairs = phonetic(pairs)
    if "missing" in groups:
        pairs = missing(pairs, sources or [])
    if "idf" in groups and idf is not None:
        pairs = features.idf_features(pairs, "e_name", "r_name", idf, unseen, rare)
    if "fs" in groups and weights:
        agree = features.agreements(pairs)
        pairs = pairs.withColumns({f"__{k}": c for k, c in agree.items()})
        pairs = pairs.withColumn("fs_weight", F.round(features.agreement_score({f"__{k}": w for k, w in weights.items()}), 6)).drop(*[f"__{k}" for k in agree])
    likeness = [c for c in ("char_cos", "jw", "addr_tok_set") if c in pairs.columns]
    if "relative_entity" in groups:
        pairs = features.relative(pairs.withColumn("cand_count", F.count("*").over(W.partitionBy("e"))), "e", likeness, "rel")
    if "relative_record" in groups:
        pairs = features.relative(pairs.withColumn("rec_n_entities", F.count("*").over(W.partitionBy("r"))), "r", [c for c in likeness if c != "jw"], "recrel", pct=False)
    channel = [c for c in cand.columns if c not in ("e", "r")]
    drop = [f"{s}_{c}" for s in "er" for c in [*SIDE, "numbers"]] + ["r_source_name", *kernel] + ([] if "retrieval" in groups else channel)
    return pairs.drop(*drop, *[c for c in channel if c.startswith("hit_")])
