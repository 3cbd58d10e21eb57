import pytest

from kinweave.operators import decision, evaluate, system
from kinweave.operators import retrieval as R

NAMES = ["small ring", "large ring", "blue bolt", "green nut", "steel rod"]


def test_candidates_are_fitted_once(spark, tmp_path):
    side = lambda key, n: spark.createDataFrame([(i, NAMES[i % 5], NAMES[i % 5], f"{i % 5} Main Street", str(i % 5), "main", "paris", f"7500{i % 5}") for i in range(n)], f"{key} long, name string, key string, address string, house string, core string, city string, postal string")
    ent, rec = side("e", 5), side("r", 10)
    channels = {"exact": {}, "word": {"k": 3, "floor": 0.4}, "char": {"k": 3, "floor": 0.4}, "addr_text": {"k": 2, "floor": 0.4}, "addr": {"k": 2, "floor": 0.5}}
    fitted = system.Candidates(channels).fit(ent, str(tmp_path))
    got = fitted.retrieve(ent, rec)
    rows = {(r["e"], r["r"]): r for r in got.collect()}
    assert all(rows[e, r]["n_channels"] == 5 for e in range(5) for r in (e, e + 5))
    assert all(x["hit_exact"] != 1 or e == r % 5 for (e, r), x in rows.items())
    again = R.cosine_pairs(fitted.encode(ent, "e", "word"), fitted.encode(rec, "r", "word"), fitted.tables["word"][0], 0.4)
    assert {(r["e"], r["r"]) for r in again.where("s > 0.999").collect()} == {(e, r) for e in range(5) for r in (e, e + 5)}


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(e, 10 * e + k, int(k == e % 3), ["train_fit", "calib", "val"][e % 3 if e > 2 else 0], 0.9 - 0.1 * (k != e % 3) - 0.5 * (k != e % 3) * (e % 2), float(k), "US" if e % 2 else "FR") for e in range(90) for k in range(3)]
    pairs = spark.createDataFrame(rows, "e long, r long, y int, split string, jw double, place double, country string")
    truth = pairs.groupBy("e", "split").agg(evaluate.F.sum("y").alias("n_true"))
    return pairs, truth, system.train(pairs, truth, ["jw", "place"], points=[{"t": 0.3, "delta": 0.1}, {"t": 0.5, "delta": 0.1}], exclusivity="auto", rounds=3, depth=3)


def test_train_decide_and_evaluate(trained):
    pairs, truth, fitted = trained
    assert fitted.settings.exclusivity == "all" and fitted.settings.train_countries == ["FR", "US"] and set(fitted.settings.point) == {"t", "delta"}
    assert system.evaluated(fitted, pairs, truth, "val").where("stratum = 'all'").first()["f05"] == 1.0
    (name, share), *_ = system.importances(fitted.trees, ["jw", "place"])
    assert name == "jw" and share > 0.5


def test_saved_systems_decide_alike(trained, tmp_path):
    pairs, _, fitted = trained
    fitted.save(str(tmp_path / "s"))
    other = system.System.load(str(tmp_path / "s"))
    assert other.settings == fitted.settings
    key = lambda df: sorted((r["e"], r["r"], round(r["s"], 9), r["acc"]) for r in df.collect())
    assert key(other.decide(pairs)) == key(fitted.decide(pairs))


def test_unseen_countries_need_more(spark, trained):
    pairs, _, fitted = trained
    fitted.settings.unseen_margin = 5.0
    abroad = pairs.withColumn("country", evaluate.F.lit("XX"))
    assert abroad.count() and fitted.decide(abroad).where("acc").where("s < 0.999").isEmpty()
    fitted.settings.unseen_margin = 0.0
    rows = [(e, 10 * e + k, s, int(k == 0), c) for c, cut in (("A", 0.6), ("B", 0.2)) for e in range(*((0, 40) if c == "A" else (40, 80))) for k, s in enumerate((cut + 0.1, cut - 0.1))]
    frame = decision.ranked(spark.createDataFrame(rows, "e long, r long, s double, y int, country string"))
    truth = frame.groupBy("e", "country").agg(evaluate.F.sum("y").alias("n_true"))
    points = [{"t": t / 10} for t in range(1, 10)]
    assert system.unseen_margin(frame, truth, points=points) == 0.0  # A lies higher by as much as B lies lower
    assert system.unseen_margin(frame, truth.where("country = 'A' or e < 45"), points=points) >= 0.0
