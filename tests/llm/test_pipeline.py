import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = {}
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
        found[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == pipeline.COLUMNS
    kept = {r["doc_id"] for r in found["toxicity"]}
    clean = {i for i, t in labels.items() if t == 0}
    assert len(clean - kept) <= 0.05 * len(clean)
    before = sorted((r["doc_id"], r["text"]) for r in found["toxicity"])
    expected = {i: t for i, t in brute.dedup_lines(before, 10).items() if brute.WORD.search(t) or t == dict(before)[i]}
    assert {r["doc_id"]: r["text"] for r in found["line_dedup"]} == expected
    groups = brute.near_duplicates([(r["doc_id"], r["text"]) for r in found["line_dedup"]])
    assert {r["doc_id"] for r in found["ngram_join"]} == {i for i, _, c in groups if i == c}
    assert {r["doc_id"] for r in found["mixing"]} <= {r["doc_id"] for r in found["ngram_join"]}
    assert len(found["sentencepiece"]) == len(found["mixing"])


def test_odd_rows_and_no_rows(spark):
    odd, none = spark.createDataFrame(brute.ROWS, brute.SCHEMA), spark.createDataFrame([], brute.SCHEMA)
    for name, stage in pipeline.STAGES:
        extra = odd.withColumns({"id": F.lit(1), "key": F.lit(2), "times": F.lit(3)})
        rows = stage(spark, extra, SF).collect()
        assert rows, name
        assert stage(spark, none, SF).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    clean = [(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(5))]
    copies = [(7, text(0)), (9, text(3)), (None, text(5)), (9, text(3))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in clean + copies], brute.SCHEMA)
    stages = dict(pipeline.STAGES)
    kept = stages["ngram_join"](spark, docs, SF)
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    assert sorted(r["text"] for r in kept.collect()) == [text(k) for k in range(6)]
    # One source gives all it has 1.5 times, so every text is in the mix, none more than twice.
    mixed = [r["text"] for r in stages["mixing"](spark, kept, SF).collect()]
    assert set(mixed) == {text(k) for k in range(6)} and len(mixed) <= 12


def test_the_rows_that_stay_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i % 3 or None, f"{'same words all over here again ' * 3}{k % 2}", "en", None if k % 3 else "a", 5) for i, k in enumerate(range(20))], brute.SCHEMA)
    for name in ("ngram_join", "mixing"):
        one, many = (sorted(map(str, dict(pipeline.STAGES)[name](spark, rows.repartition(n), SF).collect())) for n in (1, 5))
        assert one == many, name
