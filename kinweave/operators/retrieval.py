"""Candidate retrieval: token statistics, exact and address channels, top-k cosine joins, their union and its reports.

Tables of tokens are long: (id, token). Fitted statistics come from the entity side only and are tables of their own, to
be written once and joined. Scores are rounded before they are compared, and ids break ties, so that results don't
depend on the order in which sums were made.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks

DIGITS = 6


def explode_tokens(df: DataFrame, id_col: str, tokens: Column, *keep: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *keep, F.explode(tokens).alias("token"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(token, df): in how many documents each token stands. Two sums, so that a token of all documents is added up where it is read."""
    return tokens.select("id", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n: int) -> DataFrame:
    """(token, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    return df.withColumn("idf", F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1)


def unseen_idf(table: DataFrame, n: int, policy: str = "max") -> float:
    """idf of tokens never seen: as of df 0, or the median of those seen."""
    if policy == "median":
        return table.agg(F.percentile("idf", F.lit(0.5))).first()[0]
    return table.sparkSession.range(1).select(F.log(F.lit(1.0 + n)) + 1).first()[0]


def vectors(tokens: DataFrame, table: DataFrame, unseen: float) -> DataFrame:
    """(id, token, w): unit vectors with weights (1 + ln tf) idf."""
    tf = tokens.groupBy("id", "token").agg(F.count("*").alias("tf"))
    raw = tf.join(table.select("token", "idf"), "token", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen)))
    norm = raw.groupBy(F.col("id").alias("of")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, F.col("id") == F.col("of")).select("id", "token", (F.col("w") / F.col("norm")).alias("w"))


def texts(df: DataFrame, id_col: str) -> DataFrame:
    """(id, name): one row an id, the names of an id's rows between blanks; rows without an id have no place in a retrieval."""
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.concat_ws(" ", F.collect_list("name")).alias("name"))


class Space(tuple):
    """Entity vectors, record vectors, (token, df, idf), as long tables; and the pairs of near rows, which blocks find from the texts, without those tables."""

    def __new__(cls, ent: DataFrame, rec: DataFrame, tokens: Callable[[Column], Column]) -> Space:
        """``ent`` (e, name), ``rec`` (r, name); ``tokens`` of a name, such that a name of several has those of each."""
        n = ent.count()
        et, rt = explode_tokens(ent, "e", tokens(F.col("name"))), explode_tokens(rec, "r", tokens(F.col("name")))
        table = idf(document_frequency(et), n)
        unseen = unseen_idf(table, n)
        self = super().__new__(cls, (vectors(et, table, unseen), vectors(rt, table, unseen), table))
        self.n, self.tokens, self.ent, self.rec = n, tokens, ent, rec
        return self

    def pairs(self, floor: float, only_e: DataFrame | None = None, only_r: DataFrame | None = None, k: int | None = None, groups: DataFrame | None = None, rare: float | None = None) -> DataFrame:
        """(e, r, s): all pairs with cosine of at least the floor, exactly; with ``only_e`` and ``only_r`` (id) among these rows, by the weights of all.

        ``k``: pairs that can't be among their entity's k best are left out where they are found, so that copies of a text don't
        make a row for each of their pairs; with ``groups`` (id, group, an id once), that can't be so among the records of their group.

        ``rare``: adds the columns of ``features.idf_features`` by this space's idf, found in the join, without a row for each token of a pair.
        """

        def bags(df: DataFrame, key: str, only: DataFrame | None) -> DataFrame:
            named = texts(df, key)
            named = named.withColumn("keep", F.lit(True)) if only is None else named.join(only.withColumn("keep", F.lit(True)), "id", "left")
            return named.select("id", self.tokens(F.col("name")).alias("tokens"), F.coalesce("keep", F.lit(False)).alias("keep"))

        rec = bags(self.rec, "r", only_r)
        return blocks.pairs(bags(self.ent, "e", only_e), rec if groups is None else rec.join(groups, "id", "left"), floor, self.n, k, rare)


def cosine_pairs(ent: DataFrame, rec: DataFrame, df: DataFrame, floor: float) -> DataFrame:
    """(e, r, s): all pairs of vectors (id, token, w) with cosine of at least the floor, exactly. ``df`` isn't needed: blocks count the tokens themselves."""

    def bags(vecs: DataFrame) -> DataFrame:
        one = vecs.groupBy("id").agg(F.collect_list(F.struct("token", "w")).alias("x"))
        return one.select("id", F.col("x.token").alias("tokens"), F.col("x.w").alias("weights"), F.lit(True).alias("keep"))

    return blocks.pairs(bags(ent), bags(rec), floor)


def top_k(scored: DataFrame, k: int, tie_cap: int = 0, tolerance: float = 1e-6) -> DataFrame:
    """(e, r, s, rank): the best k of each entity; with ``tie_cap`` also those tied with the k-th, up to so many in all."""
    by = W.partitionBy("e").orderBy(F.col("s").desc(), "r")
    ranked = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(k, tie_cap))
    if tie_cap <= k:
        return ranked
    kth = F.max(F.when(F.col("rank") == k, F.col("s"))).over(W.partitionBy("e"))
    return ranked.withColumn("kth", kth).where((F.col("rank") <= k) | (F.col("s") >= F.col("kth") - tolerance)).drop("kth")


def classes(df: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """(first, <id>): rows of equal names, by the least id of the name; with ``limit`` only the least so many ids of each. Empty names are in none."""
    named = df.where("name <> ''").select(F.md5("name").alias("class"), id_col)
    first = named.groupBy("class").agg(F.min(id_col).alias("first"))
    if limit is not None:
        named = named.withColumn("__n", F.row_number().over(W.partitionBy("class").orderBy(id_col))).where(F.col("__n") <= limit).drop("__n")
    return named.join(first, "class").select("first", id_col)


def class_top_k(ent: DataFrame, rec: DataFrame, space: Space, floor: float, k: int) -> DataFrame:
    """``top_k`` of the pairs of a space, for its rows (e, name) and (r, name): one row of each name is compared, then names are dealt out to their rows.

    A record among the best k has a first of its name among the best k firsts, so pairs of copies are never all made.
    """
    folder = f"{blocks.shared_folder(ent.sparkSession)}/kinweave/classes-{uuid.uuid4().hex}"
    es = blocks.stored(classes(texts(ent, "e").withColumnRenamed("id", "e"), "e"), folder, "e")
    rs = blocks.stored(classes(texts(rec, "r").withColumnRenamed("id", "r"), "r", k), folder, "r")
    firsts = lambda c: c.select(F.col("first").alias("id")).distinct()
    near = top_k(space.pairs(floor, firsts(es), firsts(rs), k), k).select(F.col("e").alias("first_e"), F.col("r").alias("first"), "s")
    near = top_k(near.join(rs, "first").select(F.col("first_e").alias("e"), "r", "s"), k).withColumnRenamed("e", "first")
    return near.join(es, "first").select("e", "r", "s", "rank")


def by_country(scored: DataFrame, ent: DataFrame, rec: DataFrame, k: int, fallback_k: int) -> DataFrame:
    """Top k among records of the entity's country (or where either has none), and the ``fallback_k`` best of all; ranked anew."""
    cc = scored.join(ent.select("e", F.col("country").alias("ce")), "e").join(rec.select("r", F.col("country").alias("cr")), "r")
    near = cc.where(F.coalesce(F.col("ce") == F.col("cr"), F.lit(True)) | (F.col("ce") == "") | (F.col("cr") == "")).select("e", "r", "s")
    best = top_k(near, k).drop("rank")
    if fallback_k:
        best = best.unionByName(top_k(scored, fallback_k).drop("rank")).groupBy("e", "r").agg(F.max("s").alias("s"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("e").orderBy(F.col("s").desc(), "r")))


def exact_channel(ent: DataFrame, rec: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """(e, r, s, rank): all records with the entity's key, score 1 and rank 1; with ``cap``, a key of more records finds none. Null and empty keys match nothing."""
    usable = F.col(key).isNotNull() & (F.col(key) != "")
    found = ent.where(usable).select("e", key)
    if cap is not None:
        found = found.join(rec.where(usable).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") <= cap).select(key), key)
    found = found.join(rec.where(usable).select("r", key), key)
    return found.select("e", "r", F.lit(1.0).alias("s"), F.lit(1).alias("rank"))


def key_channel(ent_keys: DataFrame, rec_keys: DataFrame, table: DataFrame, unseen: float, k: int, floor: float, cap: int) -> DataFrame:
    """Many keys a row (id, token): the sum of idf over shared keys that are rare enough (idf of at least the floor) and short enough (``cap`` records); top k."""
    usable = ent_keys.distinct().join(table.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(unseen))).where(F.col("idf") >= floor)
    rec_keys = rec_keys.distinct()
    few = rec_keys.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("token")
    hits = usable.select(F.col("id").alias("e"), "token", "idf").join(few, "token").join(rec_keys.select(F.col("id").alias("r"), "token"), "token")
    return top_k(hits.groupBy("e", "r").agg(F.round(F.sum("idf"), DIGITS).alias("s")), k)


def dropped_keys(ent_keys: DataFrame, rec_keys: DataFrame, cap: int) -> DataFrame:
    """(probes, dropped): lookups of entity keys that hit records, and those that the cap drops."""
    sizes = rec_keys.distinct().groupBy("token").agg(F.count("*").alias("n"))
    return ent_keys.distinct().join(sizes, "token").agg(F.count("*").alias("probes"), F.count(F.when(F.col("n") > cap, 1)).alias("dropped"))


def resolve_cap(least: int, per_million: float, pool: int) -> int:
    """A posting cap that grows with the pool of records."""
    return max(least, round(per_million * pool / 1e6))


def union(channels: dict[str, DataFrame]) -> DataFrame:
    """(e, r, <channel>_score, <channel>_rank, hit_<channel>, n_channels): one aggregate over all channels, not a chain of joins."""
    rows = None
    for name, found in channels.items():
        one = found.select("e", "r", F.lit(name).alias("channel"), "s", "rank")
        rows = one if rows is None else rows.unionByName(one)
    aggs = []
    for name in channels:
        of = F.col("channel") == name
        aggs += [F.max(F.when(of, F.col("s"))).alias(f"{name}_score"), F.max(F.when(of, F.col("rank"))).alias(f"{name}_rank"), F.max(of.cast("int")).alias(f"hit_{name}")]
    out = rows.groupBy("e", "r").agg(*aggs)
    return out.withColumn("n_channels", sum((F.col(f"hit_{n}") for n in list(channels)[1:]), F.col(f"hit_{next(iter(channels))}")))


def rescore(wide: DataFrame, other: DataFrame, beta: float, k: int) -> DataFrame:
    """The best k of a wide retrieval after adding ``beta`` times another similarity (e, r, t) of the same pairs."""
    scored = wide.select("e", "r", "s").join(other, ["e", "r"], "left")
    return top_k(scored.select("e", "r", F.round(F.col("s") + beta * F.coalesce("t", F.lit(0.0)), DIGITS).alias("s")), k)


def pair_cosine(pairs: DataFrame, ent: DataFrame, rec: DataFrame) -> DataFrame:
    """(e, r, t): cosine of given pairs."""
    left = pairs.select("e", "r").join(ent.select(F.col("id").alias("e"), "token", F.col("w").alias("we")), "e")
    both = left.join(rec.select(F.col("id").alias("r"), "token", F.col("w").alias("wr")), ["r", "token"], "left")
    return both.groupBy("e", "r").agg(F.round(F.sum(F.col("we") * F.coalesce("wr", F.lit(0.0))), DIGITS).alias("t"))


def channel_report(cand: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    """(channel, recall, only_here, marginal_recall, candidates): one pass over the true pairs for all channels."""
    n = truth.count()
    found = truth.join(cand, ["e", "r"])
    hits = [F.sum(f"hit_{c}").alias(f"a_{c}") for c in names] + [F.sum(F.when((F.col(f"hit_{c}") == 1) & (F.col("n_channels") == 1), 1).otherwise(0)).alias(f"b_{c}") for c in names]
    hits = found.agg(*hits).crossJoin(cand.agg(*[F.sum(f"hit_{c}").alias(f"c_{c}") for c in names]))  # one row each
    rows = ", ".join(f"'{c}', a_{c}, b_{c}, c_{c}" for c in names)
    out = hits.selectExpr(f"stack({len(names)}, {rows}) as (channel, hits, only_here, candidates)")
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.lit(float(max(n, 1))), DIGITS)
    return out.select("channel", share("hits").alias("recall"), F.coalesce("only_here", F.lit(0)).cast("long").alias("only_here"), share("only_here").alias("marginal_recall"), F.col("candidates").cast("long").alias("candidates"))


def recall_at(cand: DataFrame, truth: DataFrame, channel: str, ks: list[int]) -> DataFrame:
    """(k, recall) of a channel's ranks."""
    n = truth.count()
    one = truth.join(cand, ["e", "r"]).agg(*[F.sum(F.when(F.col(f"{channel}_rank") <= k, 1).otherwise(0)).alias(f"k{k}") for k in ks])
    return one.selectExpr(f"stack({len(ks)}, {', '.join(f'{k}, k{k}' for k in ks)}) as (k, hits)").select("k", F.round(F.coalesce("hits", F.lit(0)) / F.lit(float(max(n, 1))), DIGITS).alias("recall"))


def candidate_distribution(cand: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates per entity, those without any included: percentiles, mean, greatest, entities with none."""
    counts = entities.select("e").join(cand.groupBy("e").agg(F.count("*").alias("n")), "e", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ps = [0.5, 0.75, 0.9, 0.95, 0.99]
    one = counts.agg(F.percentile("n", F.array(*map(F.lit, ps))).alias("p"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.sum((F.col("n") == 0).cast("long")).alias("without"))
    return one.select(*[F.col("p")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(ps)], "most", F.round("mean", DIGITS).alias("mean"), "without")


def sweep(ranked: DataFrame, truth: DataFrame, ks: list[int], floors: list[float]) -> DataFrame:
    """(k, floor, recall, candidates) for all settings from one retrieval at the widest: top-k lists are nested."""
    n = truth.count()
    spark = ranked.sparkSession
    grid = spark.createDataFrame([(k, f) for k in ks for f in floors], "k int, floor double")
    hit = ranked.join(truth.withColumn("true", F.lit(1)), ["e", "r"], "left")
    rows = hit.crossJoin(F.broadcast(grid)).where((F.col("rank") <= F.col("k")) & (F.col("s") >= F.col("floor")))  # a few settings, known here
    return rows.groupBy("k", "floor").agg(F.round(F.sum(F.coalesce("true", F.lit(0))) / F.lit(float(max(n, 1))), DIGITS).alias("recall"), F.count("*").alias("candidates"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(e, r, side) of pairs in one set only. One aggregate, which reads each set once."""
    both = a.select("e", "r", F.lit("a").alias("side")).unionByName(b.select("e", "r", F.lit("b").alias("side")))
    return both.groupBy("e", "r").agg(F.min("side").alias("side"), F.max("side").alias("other")).where("side = other").drop("other")


def posting_histogram(keys: DataFrame, caps: list[int]) -> DataFrame:
    """Sizes of key groups: percentiles, greatest, and for each cap the share of occurrences and of keys above it."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("c"))
    one = sizes.agg(
        F.count("*").alias("keys"), F.sum("c").alias("occurrences"), F.percentile("c", F.array(*map(F.lit, (0.5, 0.9, 0.99, 0.999)))).alias("p"), F.max("c").alias("most"),
        *[F.round(F.sum(F.when(F.col("c") > cap, F.col("c")).otherwise(0)) / F.sum("c"), DIGITS).alias(f"occurrences_over_{cap}") for cap in caps],
        *[F.round(F.avg((F.col("c") > cap).cast("double")), DIGITS).alias(f"keys_over_{cap}") for cap in caps],
    )
    return one.select("keys", "occurrences", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99", "p999"))], "most", *[c for c in one.columns if "_over_" in c])


def embedding_top_k(vecs: DataFrame, queries: DataFrame, k: int, floor: float) -> DataFrame:
    """(e, r, s, rank): nearest vectors by cosine for given queries (id, v), against all vectors (id, v)."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    unit = lambda df, n: df.select(F.col("id").alias(n), "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias(f"norm_{n}"))
    pairs = unit(queries, "e").withColumnRenamed("v", "ve").join(unit(vecs, "r"), F.col("e") != F.col("r"))
    scored = pairs.select("e", "r", F.round(dot(F.col("ve"), F.col("v")) / (F.col("norm_e") * F.col("norm_r")), DIGITS).alias("s"))
    return top_k(scored.where(F.col("s") >= floor), k)


def recall_report(cand: DataFrame, truth: DataFrame, ent: DataFrame, rec: DataFrame, names: list[str]) -> DataFrame:
    """(part, value, pairs, recall): how much of the truth a retrieval finds: all of it, by channel, by the record's source, by the
    entity's country, of pairs across countries or scripts, and of pairs with a name in another script.

    ``ent`` (e, name, country), ``rec`` (r, name, country, source). Each true pair is told its parts, then one aggregate sums
    them up; ids must be unique on each side.
    """
    from .audit import non_latin

    other = lambda c: F.coalesce(non_latin(F.col(c)), F.lit(False))
    left = ent.select("e", F.col("country").alias("ec"), other("name").alias("eo"))
    right = rec.select("r", F.col("country").alias("rc"), "source", other("name").alias("ro"))
    hits = [F.coalesce(F.col(f"hit_{n}"), F.lit(0)) for n in names]
    pairs = truth.select("e", "r").join(cand, ["e", "r"], "left").join(left, "e", "left").join(right, "r", "left")
    found = F.greatest(*hits, F.lit(0)) if len(hits) > 1 else hits[0]
    part = lambda p, v, f, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(p).alias("part"), v.cast("string").alias("value"), f.cast("int").alias("found")))
    parts = [part("all", F.lit(""), found), *[part("channel", F.lit(n), h) for n, h in zip(names, hits, strict=True)], part("source", F.col("source"), found, F.col("source").isNotNull()), part("country", F.col("ec"), found, F.col("ec").isNotNull())]
    parts += [part("cross_country", F.lit(""), found, ~F.col("ec").eqNullSafe(F.col("rc"))), part("cross_script", F.lit(""), found, F.col("eo") != F.col("ro")), part("other_script", F.lit(""), found, F.col("eo") | F.col("ro"))]
    told = pairs.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return told.groupBy("part", "value").agg(F.count("*").alias("pairs"), F.round(F.avg("found"), 4).alias("recall"))


def count_histogram(cand: DataFrame, entities: DataFrame, bounds: tuple[int, ...] = (1, 4, 20)) -> DataFrame:
    """(bucket, entities, share) of candidate counts, each bucket from its bound up to but without the next, entities without candidates included."""
    counts = entities.select("e").join(cand.groupBy("e").agg(F.count("*").alias("n")), "e", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bucket = F.lit(f"from {bounds[-1]}")
    for low, high in zip(reversed((0, *bounds[:-1])), reversed(bounds), strict=True):
        bucket = F.when(F.col("n") < high, f"from {low}").otherwise(bucket)
    sums = counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entities"))
    return sums.crossJoin(F.broadcast(counts.agg(F.count("*").alias("total")))).select("bucket", "entities", F.round(F.col("entities") / F.col("total"), 3).alias("share"))  # one row


def channel_ablation(cand: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    """(without, recall, candidates): what is left of a union when each channel is taken away; "" is the whole union. One pass over pairs."""
    n = truth.count()
    pairs = cand.join(truth.select("e", "r").withColumn("true", F.lit(1)), ["e", "r"], "left")
    cases = [("", F.lit(True)), *[(c, F.col("n_channels") > F.col(f"hit_{c}")) for c in names]]
    one = pairs.agg(*[F.count(F.when(keep & F.col("true").isNotNull(), 1)).alias(f"t{i}") for i, (_, keep) in enumerate(cases)], *[F.count(F.when(keep, 1)).alias(f"n{i}") for i, (_, keep) in enumerate(cases)])
    rows = one.selectExpr(f"stack({len(cases)}, " + ", ".join(f"'{c}', t{i}, n{i}" for i, (c, _) in enumerate(cases)) + ") as (without, hits, candidates)")
    return rows.select("without", F.round(F.col("hits") / F.lit(float(max(n, 1))), DIGITS).alias("recall"), "candidates")
