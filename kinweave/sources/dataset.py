"""A dataset of three sources with labels in folders by split, output files and their checks, settings and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import address_struct
from . import tsv

#: The layout of the sources.
SOURCES = {"source1": "S1-", "source2": "S2-", "source3": "S3-"}
SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
LABEL_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
OUTPUTS = {"matching_results.tsv": ["source1_entity_id", "matched_entity_ids"], "candidate_set.tsv": ["source1_entity_id", "candidate_entity_ids"]}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


@dataclass
class Dataset:
    """Files ``<root>[/dataset]/<split>/<split>_source1.tsv`` and so on, in any letter case, on any store that Spark reads."""

    spark: SparkSession
    root: str
    parser: int = 2
    issues: list[str] = field(default_factory=list)

    def _step(self, folder: str, name: str) -> str | None:
        try:
            return tsv.find(self.spark, folder, name)
        except Exception as e:  # no such folder, or nothing of that name in it
            if "FileNotFound" in type(e).__name__ or "FileNotFound" in str(e):
                return None
            raise

    def folder(self, split: str) -> str:
        inner = self._step(self.root, "dataset")
        found = (inner and self._step(inner, split)) or self._step(self.root, split)
        if not found:
            raise FileNotFoundError(f"{self.root} has no split {split}")
        return found

    def path(self, split: str, name: str) -> str:
        return tsv.find(self.spark, self.folder(split), f"{split}_{name}.tsv" if name in SOURCES else f"{name}.tsv")

    def available(self, split: str) -> bool:
        try:
            return all(self.path(split, s) for s in SOURCES)
        except FileNotFoundError:
            return False

    def source(self, split: str, name: str) -> DataFrame:
        rows = tsv.canonical(tsv.read(self.spark, self.path(split, name), SOURCE_COLUMNS), SOURCES[name])
        return canonical_entities(rows, self.parser).withColumn("source", F.lit(name))

    def load(self, split: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Entities (source 1), records (the others) and labels (None but for the training split, or where the file is missing)."""
        ent = self.source(split, "source1").drop("source")
        rec = reduce(DataFrame.unionByName, [self.source(split, s) for s in list(SOURCES)[1:]]).withColumnRenamed("entity_id", "record_id")
        return ent, rec, self.labels(ent, rec) if split == "train" else None

    def labels(self, ent: DataFrame, rec: DataFrame) -> DataFrame | None:
        """(e, r); ids of other sources or of no row are errors, entities without a line and repeated lines are reported."""
        try:
            path = self.path("train", "train_ground_truth")
        except FileNotFoundError:
            self.issues.append("no labels")
            return None
        lines = tsv.read(self.spark, path, LABEL_COLUMNS)
        pairs = tsv.labels(lines)
        self.issues += [f"{r['rule']}: {r['n']}" for r in label_report(lines, pairs, ent, rec).where("n > 0 and not fatal").collect()]
        if bad := [f"{r['rule']}: {r['n']}" for r in label_report(lines, pairs, ent, rec).where("n > 0 and fatal").collect()]:
            raise tsv.LayoutError("; ".join(bad))
        return pairs


def canonical_entities(rows: DataFrame, parser: int = 2) -> DataFrame:
    """(entity_id, name, address, city, region, postal, country, full_address): the address read by position (1) or content (2); blanks are null."""
    parsed = rows.withColumn("a", address_struct(F.col("business_address"), F.col("country"), parser))
    part = lambda c: F.nullif(F.col(f"a.{c}"), F.lit("")).alias(c)
    return parsed.select("entity_id", F.col("business_name").alias("name"), part("address"), part("city"), part("region"), part("postal"), F.nullif("country", F.lit("")).alias("country"), F.col("business_address").alias("full_address"))


def label_report(lines: DataFrame, pairs: DataFrame, ent: DataFrame, rec: DataFrame) -> DataFrame:
    """(rule, fatal, n): what is wrong with lines of labels (source1_entity_id, matched_entity_ids) and their pairs (e, r)."""
    named = lines.select(F.col("source1_entity_id").alias("entity_id"))
    rules = [
        ("entities_without_line", False, ent.select("entity_id").join(named, "entity_id", "left_anti")),
        ("repeated_lines", False, named.groupBy("entity_id").count().where("count > 1")),
        ("other_prefix", True, pairs.where(~F.substring("r", 1, 3).isin("S2-", "S3-"))),
        ("unknown_record", True, pairs.join(rec.select(F.col("record_id").alias("r")), "r", "left_anti")),
        ("unknown_entity", True, pairs.join(ent.select(F.col("entity_id").alias("e")), "e", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), F.lit(fatal).alias("fatal"), "n") for r, fatal, df in rules])


# Outputs.


def read_output(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header's names and (e, ids, fields) of each line that isn't blank; a missing second field is empty."""
    lines = spark.read.text(path)
    rows = lines.withColumn("at", F.input_file_name()).where("value <> ''")
    first = rows.select("value").first()
    header = first[0].rstrip("\r").split("\t") if first else []
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    body = rows.where(F.col("value") != (first[0] if first else "")).select(parts.alias("f"))
    return header, body.select(F.col("f")[0].alias("e"), F.coalesce(F.try_element_at("f", F.lit(2)), F.lit("")).alias("ids"), F.size("f").alias("fields"))


def list_issues(lines: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, key) of an output (e, ids, fields) against known entities (e) and records (r): too many fields, repeated, missing and
    unknown entities, blank ids, ids twice in a list, ids of no record's prefix, ids of no record."""
    items = lines.select("e", F.posexplode(F.split("ids", ",")).alias("i", "r")).join(lines.where("ids <> ''").select("e").distinct(), "e", "left_semi")
    usable = items.where("r = trim(r) and r <> ''")
    own = usable.where(~F.substring("r", 1, 3).isin("S2-", "S3-"))
    key, pair = F.col("e").alias("key"), F.concat_ws(">", "e", "r").alias("key")
    rules = {
        "too_many_fields": lines.where("fields > 2").select(key), "repeated_entity": lines.groupBy("e").count().where("count > 1").select(key),
        "missing_entity": entities.select("e").join(lines.select("e"), "e", "left_anti").select(key), "unknown_entity": lines.join(entities.select("e"), "e", "left_anti").select(key),
        "blank_id": items.where("r <> trim(r) or r = ''").select(key).distinct(), "repeated_id": usable.groupBy("e", "r").count().where("count > 1").select(key).distinct(),
        "other_prefix": own.select(pair), "unknown_record": usable.join(records.select("r"), "r", "left_anti").select(pair),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(r).alias("rule"), F.col("key").cast("string")) for r, df in rules.items()])


def subset_issues(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, key): entities with a match that is no candidate."""
    said = [t.select("e", F.explode(F.split("ids", ",")).alias("r")).where("r <> ''") for t in (matches, candidates)]
    return said[0].join(said[1], ["e", "r"], "left_anti").select(F.lit("match_without_candidate").alias("rule"), F.col("e").cast("string").alias("key")).distinct()


def check_outputs(spark: SparkSession, folder: str, entities: DataFrame, records: DataFrame, most: int = 50) -> DataFrame:
    """(file, rule, key): the first issues of both outputs by file, rule and key: a missing file, a wrong header, and the rules above."""
    found, read = [], {}
    for name, columns in OUTPUTS.items():
        if not exists(spark, f"{folder}/{name}"):
            found.append(spark.createDataFrame([(name, "missing_file", name)], "file string, rule string, key string"))
            continue
        header, read[name] = read_output(spark, f"{folder}/{name}")
        if header != columns:
            found.append(spark.createDataFrame([(name, "wrong_header", ",".join(header))], "file string, rule string, key string"))
        found.append(list_issues(read[name], entities, records).select(F.lit(name).alias("file"), "rule", "key"))
    if len(read) == len(OUTPUTS):
        found.append(subset_issues(*read.values()).select(F.lit(next(iter(OUTPUTS))).alias("file"), "rule", "key"))
    return reduce(DataFrame.unionByName, found).orderBy("file", "rule", "key").limit(most)


class OutputError(ValueError):
    """Outputs that break the rules."""


def gate(issues: DataFrame) -> None:
    """Stop unless there are no issues."""
    if rows := issues.collect():  # as many as ``check_outputs`` reports at most
        raise OutputError("; ".join(" ".join(map(str, r)) for r in rows))


# Settings and reports.


def merged(base: dict, over: dict) -> dict:
    """A new dict of both, the second's values first, dicts inside merged in the same way."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return {**base, **both}


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON or, where the yaml package is there, a YAML file on any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def variants(table: dict[str, dict], name: str) -> dict:
    """The settings of a named variant: its own ("over") on those of its parent ("parent"), and so on; a loop is an error."""
    chain = []
    while name:
        if name in chain:
            raise ValueError(f"variant {name} is its own parent")
        chain.append(name)
        name = table[name].get("parent")
    return reduce(merged, (table[n].get("over", {}) for n in reversed(chain)), {})


def write_report(df: DataFrame, path: str, title: str | None = None) -> str:
    """A small table as JSON lines (.json), CSV or a Markdown table by the path's ending, in one file; returns the text."""
    names, rows = df.columns, [r.asDict(recursive=True) for r in df.collect()]
    show = lambda v: "" if v is None else str(v).replace("|", "/")
    if path.endswith(".json"):
        text = "".join(json.dumps(r, default=str, ensure_ascii=False) + "\n" for r in rows)
    elif path.endswith(".csv"):
        import csv
        import io

        out = io.StringIO()
        writer = csv.DictWriter(out, names, lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
        text = out.getvalue()
    else:
        head = [f"# {title}", ""] if title else []
        text = "\n".join([*head, f"| {' | '.join(names)} |", "|" + "-|" * len(names), *(f"| {' | '.join(show(r[n]) for n in names)} |" for r in rows)]) + "\n"
    fs, at = _fs(df.sparkSession, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return text


def most_common(df: DataFrame, c: str | Column, k: int = 10) -> DataFrame:
    """(value, n): the k most frequent values, ties by value."""
    value = F.col(c) if isinstance(c, str) else c
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def first_of(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in an order, for samples and reports."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")
