"""Document fingerprints by a homomorphic multiset hash (native DataFrame operations only).

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector and the vectors are summed,
each lane modulo 2**32, so that the order of paragraphs doesn't matter and paragraphs are put in or taken out by adding
or subtracting their vectors. A paragraph's vector has three parts:

- digest lanes: 256 bits hashed from the whole paragraph; equal sums mean equal multisets (the hash is not keyed, so
  this holds for texts that nobody made up to collide),
- likeness lanes: for each pair of neighbouring words 64 bits, one a lane; with the pair count they give a random sign
  projection of the pair counts, and the cosine of two of them tells how much of two texts is shared,
- the number of pairs.

Two lanes of 32 bits share a long: the lanes of a fingerprint are an array of longs, and its text form their hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stored, table

DIGESTS = 4  # longs of digest lanes
SIGNS = 32  # longs of likeness lanes
LOW = (1 << 32) - 1
BOTH = (1 << 32) + 1
GROUP = 64  # split points compared at once
MOST_BUCKETS = 4096


def pair_hashes(paragraph: Column) -> Column:
    """A hash for each word and the word after it; words are what single blanks part."""
    words = F.split(paragraph, " ", -1)
    after = F.slice(words, F.lit(2), F.size(words))
    return F.zip_with(words, after, lambda a, b: F.xxhash64(a, b))


def lanes_of(paragraphs: DataFrame, keys: list[str], kinds: dict[str, list[int]] | None = None) -> DataFrame:
    """Sum the vectors of ``paragraphs`` (keys, paragraph[, kind]) by the keys.

    Returns the keys and, for each name in ``kinds``, the lanes over the paragraphs of those kinds; without ``kinds`` one
    column, lanes. A null paragraph adds nothing.
    """
    groups = [*keys, "kind"] if kinds else keys
    rows = paragraphs.where("paragraph is not null").select(*groups, *[F.xxhash64(F.lit(f"digest{i}"), "paragraph").alias(f"d{i}") for i in range(DIGESTS)], pair_hashes(F.col("paragraph")).alias("pairs"))
    # A null among the pairs stands for the paragraph itself.
    rows = rows.select(*groups, *[f"d{i}" for i in range(DIGESTS)], F.explode(F.concat(F.array(F.lit(None).cast("long")), "pairs")).alias("pair"))
    alone = F.col("pair").isNull()
    sums = []
    for i in range(DIGESTS):
        sums += [F.sum(F.when(alone, F.col(f"d{i}").bitwiseAND(F.lit(LOW)))).alias(f"a{i}"), F.sum(F.when(alone, F.shiftrightunsigned(f"d{i}", 32))).alias(f"b{i}")]
    sums += [F.sum(F.shiftrightunsigned("pair", i).bitwiseAND(F.lit(BOTH))).alias(f"s{i}") for i in range(SIGNS)]
    one = rows.groupBy(*groups).agg(*sums, F.count("pair").alias("n"))
    digests = [F.shiftleft(f"b{i}", 32).bitwiseOR(F.col(f"a{i}").bitwiseAND(F.lit(LOW))) for i in range(DIGESTS)]
    one = one.select(*groups, F.array(*digests, *[F.coalesce(f"s{i}", F.lit(0)) for i in range(SIGNS)], "n").alias("lanes"))
    if not kinds:
        return one
    by_kind = {k: F.first(F.when(F.col("kind") == k, F.col("lanes")), ignorenulls=True) for k in sorted({k for v in kinds.values() for k in v})}
    names = {k: f"of_kind{k}" for k in by_kind}
    one = one.groupBy(*keys).agg(*[c.alias(names[k]) for k, c in by_kind.items()])
    for name, members in kinds.items():
        total = F.coalesce(names[members[0]], nothing())
        for k in members[1:]:
            total = combine(total, F.coalesce(names[k], nothing()))
        one = one.withColumn(name, total)
    return one.drop(*names.values())


def nothing() -> Column:
    """The lanes of no paragraphs."""
    return F.array_repeat(F.lit(0).cast("long"), DIGESTS + SIGNS + 1)


def _mod(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of two multisets together; with sign -1, of the first without the second."""
    return F.zip_with(a, b, lambda x, y: _mod(F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32), x.bitwiseAND(F.lit(LOW)) + sign * y.bitwiseAND(F.lit(LOW))))


def text_form(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the word pair counts, as the likeness lanes estimate it: 0 to 1, and 1 for equal lanes."""

    def signed(lanes: Column) -> Column:
        n = F.element_at(lanes, -1)
        return F.flatten(F.transform(F.slice(lanes, DIGESTS + 1, SIGNS), lambda x: F.array((2 * F.shiftrightunsigned(x, 32) - n).cast("double"), (2 * x.bitwiseAND(F.lit(LOW)) - n).cast("double"))))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = signed(a), signed(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(a == b, 1.0).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lanes, fingerprint) of every row; a null text counts as empty, rows with equal ids are told apart."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("of"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(id_col, "row", F.explode(F.split("of", "\n", -1)).alias("paragraph"))
    return lanes_of(rows, [id_col, "row"]).select(id_col, "lanes", text_form(F.col("lanes")).alias("fingerprint"))


def id_buckets(docs: DataFrame, id_col: str, n: int) -> Column:
    """A number that grows with the id, with about equally many rows each; nulls have the least."""
    n = max(1, min(n, MOST_BUCKETS))
    at = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    at = sorted(set(at)) if n > 1 else []
    if not at:
        return F.lit(0).cast("long")
    parts = [at[i : i + GROUP] for i in range(0, len(at), GROUP)]

    def upto(points: Column) -> Column:
        return F.size(F.filter(points, lambda s: s <= F.col(id_col)))

    part = upto(F.array(*[F.lit(p[0]) for p in parts]))
    within = upto(F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), part))
    return F.when(F.col(id_col).isNull() | (F.col(id_col) < at[0]), 0).otherwise((part - 1) * GROUP + within).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, row, id, text, next_row, next_text): each row and the one after it, by id, then text; after the last the first.

    Rows are dealt by ranges of ids, so that a window sees one range; the first row of each range, at most MOST_BUCKETS
    of them, completes the last row of the range before it.
    """
    spark = docs.sparkSession
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    bucket = id_buckets(rows.select("id"), "id", 4 * partitions(spark))
    rows = rows.withColumn("bucket", bucket).withColumn("by", F.coalesce("id", least))
    firsts = rows.groupBy("bucket").agg(F.min("by").alias("by"))
    firsts = rows.join(F.broadcast(firsts), ["bucket", "by"]).groupBy("bucket").agg(F.min(F.struct("id", "text")).alias("head"))
    ring = W.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    firsts = firsts.select(before.alias("before"), F.col("bucket").alias("then"), F.col("head.text").alias("head"))
    order = W.partitionBy("bucket").orderBy("by", "id", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).drop("by")
    row = F.shiftleft("bucket", 40) + F.col("n")
    rows = rows.join(firsts, (rows["bucket"] == firsts["before"]) & rows["next_text"].isNull(), "left")
    then = F.coalesce(F.when(F.col("next_text").isNotNull(), row + 1), F.shiftleft("then", 40) + 1)
    return rows.select("bucket", row.alias("row"), "id", "text", then.alias("next_row"), F.coalesce("next_text", "head").alias("next_text"))


def tail_edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited copy, and how like they are.

    The edit replaces the last floor(n / 4) code points by the first as many (or all) of the next row's text. The edited
    fingerprint is the text's without the paragraphs that the edit touches, plus those that it makes. Null texts are
    empty; rows with equal ids follow each other by their text; a table of one row is followed by itself; an empty table
    gives no rows; other columns are not read.
    """
    n, cut = F.length("text"), F.expr("length(text) div 4")
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("kept", F.substring(F.col("text"), F.lit(1), n - cut)).withColumn("removed", F.substring(F.col("text"), n - cut + 1, cut)).withColumn("added", F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("bucket", "row", "id", "next_row", "n_chars", F.unhex(F.sha2(F.concat("kept", "added"), 256)).alias("sha"), F.split("kept", "\n", -1).alias("kept"), "removed", "added")
    last = F.element_at("kept", -1)
    common = F.slice("kept", F.lit(1), F.size("kept") - 1)
    keys = ["bucket", "row", "id", "next_row", "n_chars", "sha"]
    parts = F.array(F.struct(F.lit(0).alias("kind"), common.alias("p")), F.struct(F.lit(1).alias("kind"), F.split(F.concat(last, "removed"), "\n", -1).alias("p")), F.struct(F.lit(2).alias("kind"), F.split(F.concat(last, "added"), "\n", -1).alias("p")))
    rows = rows.select(*keys, F.explode(parts).alias("part")).select(*keys, "part.kind", F.explode("part.p").alias("paragraph"))
    made = stored(lanes_of(rows, keys, {"lanes": [0, 1], "edited": [0, 2]}).drop("bucket"), "fingerprints")
    after = made.select(F.col("row").alias("next_row"), F.col("lanes").alias("next_lanes"))
    both = made.join(after, "next_row")
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text_form(F.col("lanes")).alias("fingerprint"), text_form(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail_edit_fingerprints(table(spark, sf_dir, "documents"))
