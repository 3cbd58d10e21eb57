"""Line dedup by prefix doubling over sequences of line ids (native DataFrame operations only).

Every line with a word is a symbol. Prefix doubling names all stretches of 1, 2, 4, ... lines: the name of a stretch of
2n lines comes from the names of its halves. Names are 128-bit hashes of content in place of ranks, so that a doubling
step needs no global renumbering and stays within a document; any stretch of n lines has the pair of names of the power
of two at its start and at its end. Suffixes that share their first n lines have equal names there: they are the
interval of the suffix array whose longest common prefix is n or more. One shuffle gathers those intervals, and all
their members but the first in corpus order are later copies.

A run of lines counts if it has ``min_words`` words. It suffices to look at stretches that are least in that respect:
the maximal repeated runs of that many words are exactly the unions of repeated least stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stored, table

MIN_WORDS = 10


def line_symbols(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, pos, words, a, b) of each line with a word: document, line number from 0, name of the line."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k"), F.xxhash64(text_col).alias("h"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("words", n_words("line")).where("words > 0").select("k", "h", "pos", "words", F.xxhash64(F.lit("a"), "line").alias("a"), F.xxhash64(F.lit("b"), "line").alias("b"))
    return rows


def least_stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(k, h, pos, until, n, a1, b1, a2, b2): stretches of n lines that have ``min_words`` words, but fewer without their first or without their last line."""
    by = W.partitionBy("k", "h").orderBy("pos")
    rows = lines.dropDuplicates(["k", "h", "pos"]).withColumn("upto", F.sum("words").over(by.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumnsRenamed({"a": "a0", "b": "b0"})
    levels = max(1, min_words).bit_length()
    for k in range(1, levels):
        after = [F.lead(f"{c}{k - 1}", 1 << (k - 1)).over(by) for c in "ab"]
        rows = rows.withColumns({f"{c}{k}": F.when(after[0].isNotNull(), F.xxhash64(F.lit(c), f"a{k - 1}", f"b{k - 1}", *after)) for c in "ab"})
    found = []
    for n in range(1, max(1, min_words) + 1):
        k = n.bit_length() - 1
        end, until = F.lead("upto", n - 1).over(by), F.lead("pos", n - 1).over(by)
        words = end - F.col("upto") + F.col("words")
        last = F.lead("words", n - 1).over(by)
        least = (words >= min_words) & ((words - last < min_words) | (words - F.col("words") < min_words))
        tail = [F.lead(f"{c}{k}", n - (1 << k)).over(by) for c in "ab"]
        found.append(F.when(least, F.struct(F.lit(n).alias("n"), until.alias("until"), F.col(f"a{k}").alias("a1"), F.col(f"b{k}").alias("b1"), tail[0].alias("a2"), tail[1].alias("b2"))))
    rows = rows.select("k", "h", "pos", F.array(*found).alias("found")).select("k", "h", "pos", F.explode(F.filter("found", lambda x: x.isNotNull())).alias("s"))
    return rows.select("k", "h", "pos", "s.*")


def later_copies(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(k, h, runs): for each document with later copies the runs of lines that they are in, as [(first, last)] in order."""
    name = ["n", "a1", "b1", "a2", "b2"]
    found = stored(least_stretches(line_symbols(docs, id_col, text_col), min_words), "line-stretches")
    firsts = found.groupBy(*name).agg(F.min(F.struct("k", "h", "pos")).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = found.join(firsts, name).where(F.struct("k", "h", "pos") != F.col("first")).select("k", "h", "pos", "until")
    by = W.partitionBy("k", "h").orderBy("pos", "until")
    later = later.withColumn("new", (F.col("pos") > F.coalesce(F.max("until").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    later = later.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    runs = later.groupBy("k", "h", "run").agg(F.min("pos").alias("first"), F.max("until").alias("last"))
    return runs.groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, the text without later copies, and line_count, deleted_lines, deleted_runs [(first, last)].

    A run of lines is a later copy if the same lines, ``min_words`` words of them at least, stand earlier: by id, nulls
    first, then text hash, then line. The first copy of a line always stays. Lines are what \\n parts; lines without a
    word match nothing, and go where they lie inside a least stretch that goes. Rows with equal id and text count as one document
    and come out alike. A null text stays null (line_count 0), an empty text is one line without a word; a text all of
    whose lines go is empty. Columns of the same names as those added are replaced. Ids are whole numbers, or text that spells one; any other is an error.
    An empty table gives no rows.
    """
    lines = F.split("__text", "\n", -1)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rest = [c for c in docs.columns if c not in ("line_count", "deleted_lines", "deleted_runs")]
    rows = docs.select(F.struct(*rest).alias("__row"), key.alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("__text"))
    rows = rows.join(later_copies(docs, id_col, text_col, min_words), ["k", "h"], "left")
    runs = F.col("runs")
    kept = F.zip_with(F.concat(F.array(F.lit(-1)), F.transform(runs, lambda r: r["last"])), F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines))), lambda last, first: F.slice(lines, last + 2, first - last - 1))
    gone = F.coalesce(F.aggregate(runs, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0))
    text = F.when(runs.isNull(), F.col("__text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    columns = [text.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in rest]
    return rows.select(*columns, F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("line_count"), gone.cast("long").alias("deleted_lines"), runs.alias("deleted_runs"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_count", "deleted_lines", F.sha2("text", 256).alias("kept_sha256"), F.length("text").cast("long").alias("kept_chars"))


OP10_SQL = rf"""
WITH l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
l1 AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM l1 WHERE words > 0),
whole AS (SELECT doc_id, list(line ORDER BY pos) AS ls FROM l2 GROUP BY doc_id),
s AS (SELECT a.doc_id, a.pos, e.pos AS until, array_to_string(w.ls[a.i:e.i], chr(10)) AS content
      FROM l2 a JOIN l2 e ON a.doc_id = e.doc_id AND e.i BETWEEN a.i AND a.i + {MIN_WORDS - 1} JOIN whole w ON w.doc_id = a.doc_id
      WHERE e.upto - a.upto + a.words >= {MIN_WORDS}
        AND (e.upto - a.upto + a.words - e.words < {MIN_WORDS} OR e.upto - a.upto < {MIN_WORDS})),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS nth FROM s),
gone AS (SELECT DISTINCT r.doc_id, l1.pos FROM r JOIN l1 ON l1.doc_id = r.doc_id AND l1.pos BETWEEN r.pos AND r.until WHERE nth > 1),
out AS (SELECT l1.doc_id, count(*) AS line_count, count(gone.pos) AS deleted_lines,
          coalesce(string_agg(l1.line, chr(10) ORDER BY l1.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept
        FROM l1 LEFT JOIN gone ON l1.doc_id = gone.doc_id AND l1.pos = gone.pos GROUP BY l1.doc_id)
SELECT doc_id, line_count::BIGINT AS line_count, deleted_lines::BIGINT AS deleted_lines, sha256(kept) AS kept_sha256, length(kept)::BIGINT AS kept_chars FROM out
"""
