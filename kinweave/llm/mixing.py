"""Mixing sources to target weights by a low-discrepancy schedule (native DataFrame operations only).

Each source's documents are shuffled by a hash and laid end to end; the stream of words is cut into equal blocks.
A golden-ratio sequence, mapped through the cumulated shares, says which source each slot of the mix reads, and the
rank of a slot among its source's slots says which block it reads; after the last block a source starts over. The first
points, as many as the mix has blocks, settle what each source gives: their low discrepancy keeps it within a few blocks
of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stored, table

#: 2**32 divided by the golden ratio, as an odd whole number: a fixed constant of Weyl sequences.
GOLDEN = 2654435769
CHUNK = 1 << 12  # slots ranked together
CELLS = 1024  # parts of [0, 1) by which slots find their source
BUCKETS = 1 << 16  # most parts into which a source's shuffled documents are cut for running sums


def targets(sized: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_rows, source_size, target): words each source gives to the mix.

    Weights repeat over the sources in code point order, null last. A target stops at ``cap`` times its source's size;
    what lies above goes to the others by weight, until none is above. One row per source, so windows run over sources.
    """
    by_name, by_fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, W.unboundedFollowing)
    one = sized.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    one = one.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    one = one.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    everything = W.partitionBy(F.lit(1))
    one = one.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    one = one.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    one = one.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    return one.select("source", "source_rows", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def schedule(shares: DataFrame, total: int) -> DataFrame:
    """(source, rank, slot): the ``total`` slots of the mix, for ``shares`` (source, goal) in proportion to the goals.

    Slot t reads the source in whose share, of [0, 1) in code point order, the golden-ratio point of t lies. Ranks within
    a source come from counts by chunk, so that no task ranks all slots of a source.
    """
    spark = shares.sparkSession
    by = W.orderBy(F.col("source").asc_nulls_last())
    upto = shares.where("goal > 0").withColumn("upto", F.sum("goal").over(by)).withColumn("all", F.sum("goal").over(W.partitionBy(F.lit(1))))
    bounds = upto.select("source", ((F.col("upto") - F.col("goal")) / F.col("all")).alias("lo"), (F.col("upto") / F.col("all")).alias("hi"))
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    slots = spark.range(total).select(F.col("id").alias("slot"), (((F.col("id") % (1 << 31)) * GOLDEN) % (1 << 32) / F.lit(float(1 << 32))).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).join(bounds, "cell").where("point >= lo and point < hi")
    slots = slots.select("slot", "source", F.expr(f"slot div {CHUNK}").alias("chunk"))
    per = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    first = per.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.sum("n").over(W.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("ahead"))
    ranked = slots.withColumn("rank", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return ranked.select("source", (F.col("rank") + F.col("ahead")).alias("rank"), "slot")


def shuffled_key(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 4096, seed: str = "") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, slots, first_slots.

    ``taken``: words that the mix takes, repeats counted; ``slots``: slots of the schedule that read the document;
    ``first_slots``: the first of them in each turn of the source. A null text has size 0 and gives nothing; a null
    source is a source of its own, last. Repeated rows count as rows of their own. Blocks have ``block`` words, fewer for
    small corpora (a 16,384th of all words, 1 at least); what a source gives is its target to within a few blocks. No
    document is taken more than ``cap`` times, up to the next whole number. The same rows give the same mix, whatever
    their order or partitions. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), shuffled_key(F.col(id_col), seed).alias("key")), "mix-sizes")
    plan = stored(targets(sized, weights, share, cap), "mix-targets")
    total, most_rows = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("source_rows"), F.lit(0))).first()
    block = min(block, max(1, total // 16384))
    bits = min(BUCKETS.bit_length() - 1, max(0, (most_rows // 256).bit_length()))

    plan = plan.withColumn("goal", F.floor("target")).withColumn("blocks", F.ceil(F.col("source_size") / block))
    everything = plan.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    slots = schedule(plan.select("source", "goal"), -(-everything // block))
    reads = slots.join(plan.select(F.col("source").alias("s"), "source_size", "blocks"), F.col("source").eqNullSafe(F.col("s")))
    reads = reads.withColumn("turn", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks")).withColumn("at", F.col("block") * block)
    reads = reads.withColumn("until", F.least(F.col("at") + block, "source_size", F.floor(F.lit(cap) * F.col("source_size")) - F.col("turn") * F.col("source_size")))
    reads = reads.where("until > at").select(F.col("source").alias("s"), F.col("block").alias("b"), "at", "until", "slot", "turn")

    rows = sized.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - bits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("ahead"))
    order = W.partitionBy("source", "bucket").orderBy("key", "id", "size")
    rows = rows.withColumn("row", F.row_number().over(order)).withColumn("begin", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("begin", F.col("begin") + F.col("ahead")).drop("s", "b", "ahead")
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    pieces = pieces.join(reads, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    words = F.least(F.col("begin") + F.col("size"), "until") - F.greatest("begin", "at")
    pieces = pieces.withColumn("words", words).where("words > 0")
    turns = F.array_compact(F.array(*[F.min(F.when(F.col("turn") == t, F.col("slot"))) for t in range(math.ceil(cap))]))
    taken = pieces.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("row").alias("r")).agg(F.sum("words").alias("taken"), F.count("*").alias("slots"), turns.alias("first_slots"))
    out = rows.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("row") == F.col("r")), "left").drop("s")
    out = out.join(plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("first_slots", F.array().cast("array<long>")).alias("first_slots"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "slots", F.when(F.size("first_slots") > 0, F.col("first_slots")[0]).alias("first_slot"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS fills_at, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT level FROM s3 WHERE level <= fills_at ORDER BY fills_at, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT level FROM s4) * weight), most) AS target FROM s3),
b0 AS (SELECT *, floor(target)::BIGINT AS goal FROM t),
blk AS (SELECT greatest(1, least(4096, sum(source_size)::BIGINT // 16384)) AS block, sum(goal)::BIGINT AS everything FROM b0),
b1 AS (SELECT *, (sum(goal) OVER (ORDER BY source ASC NULLS LAST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM b0),
bounds AS (SELECT b1.*, (upto - goal)::DOUBLE / everything AS lo, upto::DOUBLE / everything AS hi, (source_size + block - 1) // block AS blocks, block FROM b1, blk WHERE goal > 0),
points AS (SELECT slot, ((slot % 2147483648) * 2654435769) % 4294967296 / 4294967296.0::DOUBLE AS point
           FROM (SELECT unnest(generate_series(0, (SELECT (everything + block - 1) // block FROM blk) - 1))::BIGINT AS slot)),
slots AS (SELECT source, source_size, blocks, block, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN bounds ON point >= lo AND point < hi),
reads AS (SELECT source, slot, (rank % blocks) * block AS since,
            least((rank % blocks) * block + block, source_size, 2 * source_size - (rank // blocks) * source_size) AS until, rank % blocks AS nth FROM slots),
laid AS (SELECT sized.*, t.source_size, t.target, row_number() OVER () AS id,
           (sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS b
         FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
pieces AS (SELECT id, source, b, size, unnest(generate_series(b // block, (b + size - 1) // block)) AS nth FROM laid, blk WHERE size > 0),
took AS (SELECT id, sum(least(b + size, until) - greatest(b, since)) AS taken, count(*) AS slots, min(slot) AS first_slot
         FROM pieces JOIN reads ON pieces.source IS NOT DISTINCT FROM reads.source AND pieces.nth = reads.nth AND least(b + size, until) > greatest(b, since) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(slots, 0)::BIGINT AS slots, first_slot
FROM laid LEFT JOIN took USING (id)
"""
