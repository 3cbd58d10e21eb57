"""Texts with more copies than any cap, against plain loops."""

import pytest

from kinweave.operators import retrieval as R
from kinweave.plans.registry import QUERIES

COPIES = 70


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Texts in many copies among entities (ids below 1000) and records, and some near them."""
    path = tmp_path_factory.mktemp("copies")
    many, other = "stone river lamp garden mirror copper", "quiet window table letter morning walking"
    ent = [(0, many), (1, many), (2, other), (3, "basket lonely orchard"), (4, ""), (5, "...")]
    rec = [(1000 + k, many) for k in range(COPIES)] + [(2000 + k, other + " today") for k in range(25)] + [(3000, "copper mirror garden lamp river stone"), (3001, ""), (3002, other)]
    rows = [(i, t, "en", "a", len(t)) for i, t in ent + rec]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i, _ in ent], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_all_copies_are_linked(spark, copied):
    found = {r["e"]: [int(x) for x in r["matches"].split(",") if x] for r in QUERIES["linked_records"](spark, copied).collect()}
    copies = [1000 + k for k in range(COPIES)]
    assert set(found) == set(range(6))
    assert set(copies) <= set(found[0]) and found[0] == found[1]
    assert found[2][0] == 3002 and len(found[2]) == 20
    assert found[3] == found[4] == found[5] == []


def test_copies_are_candidates(spark, copied):
    rows = QUERIES["candidate_union"](spark, copied).collect()
    assert {r["r"] for r in rows if r["e"] == 1 and r["hit_exact"]} == {1000 + k for k in range(COPIES)}
    assert sorted(r["word_rank"] for r in rows if r["e"] == 1 and r["hit_word"]) == list(range(1, 21))


def test_common_names_and_sounds_find_all(spark, tmp_path):
    parts = [(k, f"small ring{'s' * (k % 2)}", f"Brand{k % 3}") for k in range(120)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    exact = {(r["e"], r["r"]) for r in QUERIES["exact_channel"](spark, str(tmp_path)).collect()}
    assert exact == {(f"{b}|{n}", k) for k, n, _ in parts for _, m, b in parts if m == n}
    sounds = {(r["e"], r["r"]) for r in QUERIES["phon_channel"](spark, str(tmp_path)).collect()}
    assert {(n, k) for k, n, _ in parts} <= sounds


def test_classes_give_the_same_best(spark, copied):
    from kinweave.plans.views import Views

    v = Views(spark, copied)
    best = lambda df: sorted(tuple(r) for r in df.select("e", "r", "s", "rank").collect())
    assert best(R.class_top_k(v.ent(), v.rec(), v.word_space(), 0.4, 20)) == best(R.top_k(R.cosine_pairs(*v.word_space(), 0.4), 20))


def test_difference_reads_each_set_once(spark, copied):
    union, apart = QUERIES["candidate_union"](spark, copied), QUERIES["candidate_set_symdiff"](spark, copied)
    assert apart._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") <= 1  # records without a label
    expected = {(x["e"], x["r"]): "a" if x["hit_exact"] else "b" for x in union.collect() if x["n_channels"] == 1}
    rows = apart.collect()
    assert len(rows) == len(expected) and {(x["e"], x["r"]): x["side"] for x in rows} == expected
