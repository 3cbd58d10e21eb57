"""Retrieval on a small fixture against plain dictionaries, with likenesses around the reference's floors."""

import collections
import math
import random

import pytest

from kinweave.plans.registry import QUERIES

ITEMS = 12
VOCABULARY = [a + b for a in ("stone", "river", "lamp", "garden", "mirror", "copper") for b in ("", "ing", "let", "ward", "field", "smith")]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(VOCABULARY, k=rng.randint(3, 7))) for _ in range(n)]


def grams(name):
    return [w[i : i + 3] for w in (f" {x} " for x in name.split()) for i in range(max(len(w) - 2, 1))]


def cosines(items, turns, tokens):
    """{(e, r): cosine}"""
    df = collections.Counter(t for x in items.values() for t in set(tokens(x)))

    def vector(x):
        v = {t: (1 + math.log(c)) * (math.log((1 + len(items)) / (1 + df[t])) + 1) for t, c in collections.Counter(tokens(x)).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    a, b = ({k: vector(x) for k, x in side.items()} for side in (items, turns))
    return {(e, r): round(sum(w * y.get(t, 0) for t, w in x.items()), 6) for e, x in a.items() for r, y in b.items()}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("floors")
    items, turns = dict(enumerate(texts(ITEMS, 1))), {1000 * k: t for k, t in enumerate(texts(40, 2))}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r // 1000, 0, "user", t) for r, t in turns.items()], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, items, turns


def test_gram_candidates_start_at_the_references_floor(spark, small):
    path, items, turns = small
    near = collections.defaultdict(list)
    for (e, r), s in cosines(items, turns, grams).items():
        if s >= 0.4:
            near[e].append((-s, r))
    expected = {(e, r) for e, found in near.items() for _, r in sorted(found)[:20]}
    assert any(0.4 <= -s < 0.6 for found in near.values() for s, _ in found)
    assert {(x["e"], x["r"]) for x in QUERIES["char_topk"](spark, str(path)).collect()} == expected


def test_pair_features_cover_weak_pairs(spark, small):
    path, items, turns = small
    expected = {p for p, s in cosines(items, turns, str.split).items() if s >= 0.05}
    assert {(x["e"], x["r"]) for x in QUERIES["idf_pair_features"](spark, str(path)).collect()} == expected


def test_sweep_covers_the_references_floors(spark):
    rows = QUERIES["retrieval_sweep"](spark, "/root/testdata/sf0.001").collect()
    assert {0.2, 0.3, 0.4, 0.5} <= {r["floor"] for r in rows}
    assert {10, 20} <= {r["k"] for r in rows}


def test_pair_features_by_hand(spark, small, tmp_path):
    """Against plain dictionaries; an item in two rows is one item with the words of both, and no row is made for a token of a pair."""
    _, items, turns = small
    items = items | {100 + k: f"other{k} words{k}" for k in range(10)}
    rows = [(e, t) for e, t in items.items()] + [(3, "copper stone harbour")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = turns | {41000: "unheard " + items[5], 42000: items[6], 43000: "garden words7 " + items[3]}
    spark.createDataFrame([(r // 1000, 0, "user", t) for r, t in turns.items()], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    items = items | {3: items[3] + " copper stone harbour"}
    df = collections.Counter(t for x in items.values() for t in set(x.split()))
    idf = lambda t: math.log((1 + len(rows)) / (1 + df[t])) + 1
    result = QUERIES["idf_pair_features"](spark, str(tmp_path))
    assert "Generate" not in result._jdf.queryExecution().toString()
    found = {(x["e"], x["r"]): tuple(x)[2:] for x in result.collect()}
    assert len(found) == result.count() and (3, 43000) in found and (5, 41000) in found
    for (e, r), got in found.items():
        x, y = set(items[e].split()), set(turns[r].split())
        shared, apart = [idf(t) for t in x & y], [idf(t) for t in x ^ y]
        rare = lambda ws: sum(w >= 3.0 - 1e-9 for w in ws)
        expected = sum(shared), max(shared), sum(apart), rare(shared), rare(map(idf, x - y)), 0, sum(t not in df for t in y), sum(shared) / sum(shared + apart)
        assert got == pytest.approx(expected, abs=2e-6), (e, r)
    assert found[6, 42000][2] == 0 and found[6, 42000][7] == 1 and found[107, 43000][3] == 1
