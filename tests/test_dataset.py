import pytest
from pyspark.sql import functions as F

from kinweave.sources import dataset as D
from kinweave.sources.tsv import LayoutError


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "Dataset" / "Train"
    folder.mkdir(parents=True)
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (folder / "train_source1.tsv").write_text(head + "S1-1\tAcme Inc\t12 Main Street, Austin, TX 78701, United States\tUS\nS1-2\tFoo\t\t\n")
    (folder / "TRAIN_source2.tsv").write_text(head + "S2-1\tAcme\t12 Main St, Austin\tUS\n")
    (folder / "train_Source3.tsv").write_text(head + "S3-1\tBar\t\tFR\n")
    (folder / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-1\n")
    return tmp_path


def test_load_a_split_in_any_case(spark, root):
    data = D.Dataset(spark, str(root))
    assert data.available("train") and not data.available("test")
    ent, rec, labels = data.load("train")
    one = {r["entity_id"]: r for r in ent.collect()}
    assert (one["S1-1"]["address"], one["S1-1"]["city"], one["S1-1"]["region"], one["S1-1"]["postal"]) == ("12 Main Street", "Austin", "TX", "78701")
    assert one["S1-2"]["full_address"] is None and one["S1-2"]["country"] is None
    assert {(r["record_id"], r["source"]) for r in rec.collect()} == {("S2-1", "source2"), ("S3-1", "source3")}
    assert {tuple(r) for r in labels.collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    assert data.issues == ["entities_without_line: 1"]


def test_labels_of_no_row_are_an_error(spark, root):
    (root / "Dataset" / "Train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-9\n")
    with pytest.raises(LayoutError, match="unknown_record"):
        D.Dataset(spark, str(root)).load("train")


def test_outputs_are_checked(spark, tmp_path):
    (tmp_path / "matching_results.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\n\nS1-2\tS2-1, S1-1\textra\nS1-9\n")
    (tmp_path / "candidate_set.tsv").write_text("source1_entity_id\tids\nS1-1\t\nS1-2\tS2-1\nS1-3\n")
    ent, rec = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "e string"), spark.createDataFrame([("S2-1",)], "r string")
    issues = D.check_outputs(spark, str(tmp_path), ent, rec)
    m = "matching_results.tsv"
    assert {tuple(r) for r in issues.collect()} == {
        ("candidate_set.tsv", "wrong_header", "source1_entity_id,ids"), (m, "too_many_fields", "S1-2"), (m, "missing_entity", "S1-3"), (m, "unknown_entity", "S1-9"),
        (m, "repeated_id", "S1-1"), (m, "blank_id", "S1-2"), (m, "match_without_candidate", "S1-1"), (m, "match_without_candidate", "S1-2"),
    }
    with pytest.raises(D.OutputError):
        D.gate(issues)
    (tmp_path / "candidate_set.tsv").unlink()
    assert ("candidate_set.tsv", "missing_file") in {(r[0], r[1]) for r in D.check_outputs(spark, str(tmp_path), ent, rec).collect()}


def test_settings_variants_and_reports(spark, tmp_path):
    assert D.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 4}}) == {"a": {"b": 4, "c": 2}, "d": 3}
    table = {"v1": {"over": {"k": 1, "x": {"y": 1}}}, "v2": {"parent": "v1", "over": {"x": {"z": 2}}}}
    assert D.variants(table, "v2") == {"k": 1, "x": {"y": 1, "z": 2}}
    with pytest.raises(ValueError):
        D.variants({"a": {"parent": "a"}}, "a")
    (tmp_path / "s.json").write_text('{"a": 1}')
    assert D.read_settings(spark, str(tmp_path / "s.json")) == {"a": 1}
    rows = spark.createDataFrame([("x|y", None)], "a string, b int")
    assert D.write_report(rows, str(tmp_path / "r.md"), "T") == (tmp_path / "r.md").read_text() == "# T\n\n| a | b |\n|-|-|\n| x/y |  |\n"
    D.write_report(rows, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text() == "a,b\nx|y,\n"


def test_first_and_most_common(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "g string, n int")
    assert [tuple(r) for r in D.most_common(rows, "g", 1).collect()] == [("a", 2)]
    assert sorted(tuple(r) for r in D.first_of(rows, ["g"], [F.col("n").desc()]).collect()) == [("a", 3), ("b", 2)]
