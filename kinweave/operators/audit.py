"""Is the data as it should be: counters over raw lines, statistics of fields, rules for tables and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, non_null, distinct_values): one scan for all columns."""
    one = df.agg(*[F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(f"{c}_a") for c in cols], *[F.count_distinct(F.col(c)).alias(f"{c}_b") for c in cols])
    return one.selectExpr(f"stack({len(cols)}, {', '.join(f'{chr(39)}{c}{chr(39)}, {c}_a, {c}_b' for c in cols)}) as (field, non_null, distinct_values)")


def line_counters(lines: DataFrame, sep: str, fields: int) -> DataFrame:
    """Counters over raw lines (value): rows, wrong numbers of fields, blank lines, carriage returns, quotes."""
    v = F.col("value")
    n = F.size(F.split(v, sep, -1))
    blank = F.trim(v) == ""
    return lines.agg(
        F.count("*").alias("rows"), F.sum(blank.cast("long")).alias("blank_lines"), F.sum((~blank & (n > fields)).cast("long")).alias("too_many_fields"), F.sum((~blank & (n < fields)).cast("long")).alias("too_few_fields"),
        F.sum(v.endswith("\r").cast("long")).alias("crlf"), F.sum(v.contains('"').cast("long")).alias("with_quotes"), F.sum(v.rlike('^".*"$').cast("long")).alias("looks_quoted"),
    )


def unknown_ids(labels: DataFrame, known: DataFrame, col: str) -> DataFrame:
    return labels.select(col).distinct().join(known.select(col), col, "left_anti")


def wrong_prefix(ids: DataFrame, col: str, prefix: str) -> DataFrame:
    return ids.where(~F.col(col).startswith(prefix) | F.col(col).isNull()).select(col)


def duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def validate(entities: DataFrame, records: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, severity, violations) for tables (e, name, address), (r, name, address), (e, r); one row per rule."""

    def row(rule: str, severity: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "violations")

    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = [
        row("null_entity_id", "critical", entities.where("e is null")), row("null_record_id", "critical", records.where("r is null")),
        row("duplicate_entity_id", "critical", duplicates(entities, ["e"])), row("duplicate_record_id", "critical", duplicates(records, ["r"])),
        row("unknown_entity_in_labels", "critical", unknown_ids(labels, entities, "e")), row("unknown_record_in_labels", "critical", unknown_ids(labels, records, "r")),
        row("entity_without_name_and_address", "warning", entities.where(blank("name") & blank("address"))), row("record_without_name_and_address", "warning", records.where(blank("name") & blank("address"))),
        row("duplicate_labels", "warning", duplicates(labels, ["e", "r"])),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def label_cardinality(labels: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """(matches, entities): how many entities have how many records; ``most`` and more together."""
    n = entities.select("e").join(labels.groupBy("e").agg(F.count_distinct("r").alias("n")), "e", "left")
    return n.groupBy(F.least(F.coalesce("n", F.lit(0)), F.lit(most)).alias("matches")).agg(F.count("*").alias("entities"))


def shared_records(labels: DataFrame) -> DataFrame:
    """Records that belong to more than one entity; none means that one owner per record may be enforced."""
    return labels.groupBy("r").agg(F.count_distinct("e").alias("owners")).where("owners > 1")


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates."""
    return matches.select("e", "r").join(candidates.select("e", "r"), ["e", "r"], "left_anti")


def output_issues(lines: DataFrame, entities: DataFrame, records: DataFrame, most: int = 50) -> DataFrame:
    """(rule, key): the first issues of an output (e, ids) against known ids: missing, repeated or unknown entities, repeated, unknown or self matches."""
    ids = lines.select("e", F.explode(F.split("ids", ",")).alias("r")).where("r <> ''")
    found = [
        ("missing_entity", entities.join(lines, "e", "left_anti").select(F.col("e").alias("key"))), ("repeated_entity", duplicates(lines, ["e"]).select(F.col("e").alias("key"))),
        ("unknown_entity", lines.join(entities, "e", "left_anti").select(F.col("e").alias("key"))), ("repeated_match", duplicates(ids, ["e", "r"]).select(F.concat_ws(">", "e", "r").alias("key"))),
        ("unknown_match", ids.join(records, "r", "left_anti").select(F.concat_ws(">", "e", "r").alias("key"))), ("self_match", ids.where("e = r").select(F.col("e").alias("key"))),
    ]
    out = None
    for rule, df in found:
        one = df.select(F.lit(rule).alias("rule"), F.col("key").cast("string"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("rule", "key").limit(most)


def non_latin(c: Column) -> Column:
    """Whether a letter beyond U+024F stands in the text."""
    return c.rlike("[\\p{L}&&[^\\x{0000}-\\x{024F}]]")
