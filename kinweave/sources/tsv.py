"""Tab-separated sources and outputs: quotes are plain characters, every field is text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LayoutError(ValueError):
    """A source isn't laid out as it should be."""


def find(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a file in a folder, its name in any case; an exact match comes first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(conf).listStatus(path)]
    for match in (name.__eq__, lambda n: n.lower() == name.lower()):
        if hit := next(filter(match, sorted(names)), None):
            return f"{folder.rstrip('/')}/{hit}"
    raise FileNotFoundError(f"{folder}/{name}")


def read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The expected columns, in this order, trimmed; other columns are dropped, a missing one is an error.

    Lines with more fields than the header are an error, when they are read; missing fields are empty; blank lines are
    passed over; a byte order mark goes.
    """
    lines = spark.read.text(path)
    first = lines.where(F.trim("value") != "").first()
    if first is None:
        raise LayoutError(f"{path} has no header")
    header = first[0]
    names = [h.strip() for h in header.lstrip("﻿").split("\t")]
    if missing := [c for c in columns if c not in names]:
        raise LayoutError(f"{path} lacks {', '.join(missing)}")
    rows = lines.where((F.trim("value") != "") & (F.col("value") != header)).select(F.split("value", "\t", -1).alias("f"), "value")
    bad = F.raise_error(F.concat(F.lit("more fields than the header: "), F.col("value"))).cast("string")
    field = lambda i: F.trim(F.coalesce(F.try_element_at("f", F.lit(i + 1)), F.lit("")))
    return rows.select(*[F.when(F.size("f") > len(names), bad).otherwise(field(names.index(c))).alias(c) for c in columns])


def labels(rows: DataFrame, entity: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """Distinct (e, r) of a table with a comma list of ids; an empty list gives nothing."""
    out = rows.select(F.col(entity).alias("e"), F.explode(F.split(ids, ",")).alias("r"))
    return out.select("e", F.trim("r").alias("r")).where("r <> ''").distinct()


def canonical(df: DataFrame, prefix: str, source: str | None = None) -> DataFrame:
    """Blank fields to nulls and the source's name; ids must begin with the prefix."""
    wrong = df.where(~F.col("entity_id").startswith(prefix)).select("entity_id").limit(3).collect()
    if wrong:
        raise LayoutError(f"ids without {prefix}: {', '.join(r[0] for r in wrong)}")
    out = df.select("entity_id", *[F.nullif(c, F.lit("")).alias(c) for c in ("business_name", "business_address", "country")])
    return out.withColumn("source", F.lit(source)) if source else out


def write(df: DataFrame, path: str, key: str, ids: str) -> None:
    """One file with a header and a line per row, in the order of the key."""
    body = df.orderBy(key).select(F.concat_ws("\t", key, F.coalesce(ids, F.lit(""))).alias("value"))
    body.coalesce(1).write.mode("overwrite").option("header", "false").text(path)
