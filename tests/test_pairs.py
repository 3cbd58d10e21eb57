import duckdb
import pytest

from kinweave.operators import decision, evaluate, pairs
from kinweave.operators import retrieval as R

ENT = [(1, "acme tools", "acme tools inc", "acme tools", "inc", "AKM TLS", "ACN TAL", "12", "3", "main", "austin", "TX", "78701", "US", "12 main street austin", ["12"]),
       (2, "", "", "", "", "", "", None, None, None, None, None, None, None, None, [])]
REC = [(10, "acme tool", "acme tool", "acme tool", "", "AKM TL", "ACN TAL", "12", None, "main", "austin", "TX", "78799", "US", "12 main austin", ["12", "7"], "s2"),
       (11, "zeta", "zeta llc", "zeta", "llc", "ST", "ZAT", None, None, None, "dallas", None, None, "US", "", [], "s3")]
SIDE = ", ".join(f"{c} string" for c in pairs.SIDE) + ", numbers array<string>"


@pytest.fixture(scope="module")
def built(spark):
    cand = R.union({"word": spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.2, 2), (2, 11, 0.1, 1)], "e long, r long, s double, rank int"), "exact": spark.createDataFrame([(1, 10, 1.0, 1)], "e long, r long, s double, rank int")})
    assert pairs.active_channels(cand) == ["exact", "word"]
    char = spark.createDataFrame([(1, 10, 0.8)], "e long, r long, t double")
    out = pairs.build(cand, spark.createDataFrame(ENT, "e long, " + SIDE), spark.createDataFrame(REC, "r long, " + SIDE + ", source string"), cosines={"char_cos": char}, weights={"house_eq": (2.0, -1.0), "city_eq": (1.0, -2.0)}, sources=["s2", "s3"])
    return out.columns, {(r["e"], r["r"]): r for r in out.collect()}


def test_all_features_are_built(built):
    columns, rows = built
    assert len(rows) == 3
    for c in ("jw lev tok_sort tok_set partial lev_fold_full jaccard containment len_ratio len_diff first_tok_eq legal_eq name_key_eq house_eq postal_eq city_eq street_jw addr_tok_set char_cos "
              "phon_mp_jacc phon_ny_jacc phon_key_eq unit_eq region_eq country_eq city_jw street_tok_set postal_prefix_eq num_overlap addr_containment e_has_name r_has_name e_has_addr r_has_addr "
              "r_has_postal r_has_city r_source word_score word_rank exact_score exact_rank n_channels fs_weight cand_count rel_char_cos_rank rel_jw_gap rel_addr_tok_set_pct rec_n_entities recrel_char_cos_rank recrel_addr_tok_set_gap").split():  # fmt: skip
        assert c in columns, c
    assert not [c for c in columns if c.startswith(("e_name", "r_name", "hit_", "__"))]


def test_values(built):
    row = built[1][1, 10]
    assert row["jw"] == pytest.approx(duckdb.execute("select jaro_winkler_similarity('acme tools', 'acme tool')").fetchone()[0], abs=1e-6)
    assert row["lev"] == pytest.approx(2 * 9 / 19, abs=1e-6)
    assert (row["phon_mp_jacc"], row["phon_ny_jacc"], row["phon_key_eq"]) == (pytest.approx(1 / 3, abs=1e-6), 1.0, 0.0)
    assert (row["num_overlap"], row["addr_containment"]) == (0.5, 0.75)
    assert (row["postal_eq"], row["postal_prefix_eq"], row["region_eq"], row["unit_eq"], row["legal_eq"]) == (0.0, 1.0, 1.0, None, None)
    assert (row["fs_weight"], row["r_source"], row["cand_count"], row["rel_char_cos_rank"]) == (3.0, 0, 2, 1)


def test_missing_sides_are_null_not_zero(built):
    row = built[1][2, 11]
    assert (row["jw"], row["jaccard"], row["house_eq"], row["num_overlap"], row["phon_key_eq"]) == (None,) * 5
    assert (row["e_has_name"], row["r_has_name"], row["e_has_addr"], row["r_has_addr"], row["r_has_city"], row["r_source"], row["fs_weight"]) == (0, 1, 0, 0, 1, 1, 0.0)


def test_groups_choose_columns():
    assert pairs.feature_columns(["jw", "rel_x", "cand_count", "recrel_x", "fs_weight", "unseen_shared"], {"fs"}) == ["jw", "fs_weight"]


def test_tournament_prefers_what_wins_out_of_sample(spark):
    rows = [(e, 10 * e + k, s, int(s > 0.5)) for e in range(80) for k, s in enumerate((0.9, 0.7 if e % 2 else 0.3, 0.1))]
    frame = decision.ranked(spark.createDataFrame(rows, "e long, r long, s double, y int"))
    truth = frame.groupBy("e").agg(evaluate.F.sum("y").alias("n_true"))
    points = {"threshold": [{"t": 0.5}, {"t": 0.8}], "top1_t": [{"t": 0.5}]}
    table, winner = decision.tournament({"raw": frame}, truth.where("e < 40"), truth.where("e >= 40"), ("top1_t", "threshold"), points, ("off",))
    best = {r["system"]: r["f05"] for r in table.where("stratum = 'all'").collect()}
    assert winner in ("raw:threshold", "raw:by_bucket") and best["raw:threshold"] == 1.0 > best["raw:top1_t"]


def test_low_counts_and_conservative_points(spark):
    rows = [(e, 10 * e + k, s, int(k == 0)) for e in range(10) for k, s in enumerate((0.9, 0.4))]
    frame = decision.ranked(spark.createDataFrame(rows, "e long, r long, s double, y int"))
    truth = frame.groupBy("e").agg(evaluate.F.sum("y").alias("n_true"))
    got = decision.simulate_low_counts(frame, truth, truth, (1, 2), ("top1", "threshold")).collect()
    assert [(r["n"], r["mechanism"], r["f05"]) for r in got] == [(1, "top1", 1.0), (1, "threshold", 1.0), (2, "top1", 1.0), (2, "threshold", 1.0)]
    tuned = spark.createDataFrame([(0.2, 0.3, 1.0), (0.4, 0.1, 1.0), (0.4, 0.3, 1.0), (0.6, 0.1, 0.5)], "t double, delta double, f05 double")
    assert tuple(decision.best_point(tuned, ["t", "delta"]).first()) == (0.4, 0.1, 1.0)
    assert tuple(decision.best_point(tuned, ["t", "delta"], conservative=False).first()) == (0.2, 0.3, 1.0)
