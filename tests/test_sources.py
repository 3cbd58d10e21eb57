import pytest

from kinweave.operators import audit
from kinweave.sources import tsv

COLS = ["entity_id", "business_name", "business_address", "country"]


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return f"file://{folder}/{name}"


def test_quotes_short_rows_and_blank_lines(spark, tmp_path):
    path = put(tmp_path, "a.tsv", '﻿entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\t"Foo\t Main St \tUS\tx\n\nS1-2\tBar"\n')
    rows = tsv.read(spark, path, COLS).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", '"Foo', "Main St", "US"), ("S1-2", 'Bar"', "", "")]


def test_layout_errors(spark, tmp_path):
    with pytest.raises(tsv.LayoutError):
        tsv.read(spark, put(tmp_path, "b.tsv", "entity_id\tcountry\n"), COLS)
    path = put(tmp_path, "c.tsv", "\t".join(COLS) + "\nS1-1\ta\tb\tc\td\n")
    with pytest.raises(Exception, match="more fields"):
        tsv.read(spark, path, COLS).collect()
    path = put(tmp_path, "d.tsv", "\t".join(COLS) + "\nX1\ta\tb\tc\n")
    with pytest.raises(tsv.LayoutError, match="X1"):
        tsv.canonical(tsv.read(spark, path, COLS), "S1-")


def test_find_ignores_case(spark, tmp_path):
    put(tmp_path, "Train_Source1.TSV", "x\n")
    assert tsv.find(spark, f"file://{tmp_path}", "train_source1.tsv").endswith("Train_Source1.TSV")
    with pytest.raises(FileNotFoundError):
        tsv.find(spark, f"file://{tmp_path}", "other.tsv")


def test_labels_and_written_lists(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "S2-1, S3-2,S2-1"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, tsv.labels(df).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    tsv.write(df, f"file://{tmp_path}/out", "source1_entity_id", "matched_entity_ids")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()] == ["S1-1\tS2-1, S3-2,S2-1", "S1-2\t", "S1-3\t"]


def test_output_issues(spark):
    lines = spark.createDataFrame([("a", "x,x,z"), ("q", "x"), ("b", "b")], "e string, ids string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "e string")
    records = spark.createDataFrame([("x",), ("b",)], "r string")
    got = {tuple(r) for r in audit.output_issues(lines, known, records).collect()}
    assert got == {("missing_entity", "c"), ("unknown_entity", "q"), ("repeated_match", "a>x"), ("unknown_match", "a>z"), ("self_match", "b")}


def test_streamed_records_find_candidates(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinweave.operators.retrieval import exact_channel
    from kinweave.streaming.candidates import match_stream

    ent = spark.createDataFrame([(0, "a"), (1, "b")], "e long, key string")
    spark.createDataFrame([(10, "a"), (11, "c"), (12, "b")], "r long, key string").repartition(3).write.parquet(f"{tmp_path}/in")
    records = spark.readStream.schema("r long, key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    match_stream(records, lambda batch: exact_channel(ent, batch, "key", 10), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").select(F.col("e"), F.col("r")).collect()
    assert sorted(map(tuple, found)) == [(0, 10), (1, 12)]
