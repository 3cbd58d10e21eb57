"""The join in blocks against plain loops, in chunks much smaller than the tables."""

import collections
import math
import random

import numpy as np

from kinweave.operators import blocks
from kinweave.operators import retrieval as R
from pyspark.sql import functions as F


def test_small_chunks_lose_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(80)]
    some = lambda base, n: [(base + i, [words[min(79, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randint(0, 9))]) for i in range(n)]
    ent, rec = some(0, 60), some(1000, 90)
    df = collections.Counter(t for _, x in ent for t in set(x))

    def vector(x):
        v = {t: (1 + math.log(c)) * (math.log((1 + len(ent)) / (1 + df[t])) + 1) for t, c in collections.Counter(x).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    a, b = ([(i, vector(x)) for i, x in side] for side in (ent, rec))
    full = {(e, r): sum(w * y.get(t, 0) for t, w in x.items()) for e, x in a for r, y in b}
    table = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>").withColumn("keep", F.lit(True))
    monkeypatch.setattr(blocks, "CHUNK", 40)
    monkeypatch.setattr(blocks, "BUNDLE", 25)
    for floor in (0.2, 0.4, 0.7):
        found = {(x["e"], x["r"]): x["s"] for x in blocks.pairs(table(ent), table(rec), floor, len(ent)).collect()}
        assert set(found) == {p for p, s in full.items() if round(s, 6) >= floor}
        assert all(abs(s - full[p]) < 1e-5 for p, s in found.items())


def test_rows_of_one_id_are_one_entity(spark):
    """Names of several rows with one id make one vector, a row without an id makes none."""
    from kinweave.functions.text import words

    ent = spark.createDataFrame([(1, "stone river"), (1, "lamp garden"), (None, "stone river")], "e long, name string")
    rec = spark.createDataFrame([(7, "lamp garden stone river"), (8, "mirror"), (9, "")], "r long, name string")
    assert [tuple(x) for x in R.Space(ent, rec, words).pairs(0.4).collect()] == [(1, 7, 1.0)]


def test_copies_make_no_row_for_each_pair(spark, monkeypatch):
    """A join for a top k leaves the best of each entity and task, of each group of records if there are such, ties by id; none of the best is lost."""
    ent = spark.createDataFrame([(e, ["a", "b", "c"]) for e in range(12)], "id long, tokens array<string>").withColumn("keep", F.lit(True))
    rows = [(1000 - k, ["a", "b", "c"] if k % 3 else ["a", "b", "d"], "xyz"[k % 2]) for k in range(90)]
    rec = spark.createDataFrame(rows, "id long, tokens array<string>, group string").withColumn("keep", F.lit(True))
    best = lambda df, k: sorted(tuple(x) for x in R.top_k(df, k).collect())
    plain = rec.drop("group")
    for size in (40, blocks.BUNDLE):
        monkeypatch.setattr(blocks, "BUNDLE", size)
        whole = blocks.pairs(ent, plain, 0.2, 12)
        few = blocks.pairs(ent, plain, 0.2, 12, 4)
        assert whole.count() == 12 * 90
        assert best(few, 4) == best(whole, 4)
        if size > 40:
            assert few.count() == 12 * 4
        few = blocks.pairs(ent, rec, 0.2, 12, 4)
        for g in "xy":
            of = rec.where(F.col("group") == g).select(F.col("id").alias("r"))
            assert best(few.join(of, "r", "left_semi"), 4) == best(whole.join(of, "r", "left_semi"), 4)


def test_few_pairs_are_computed_in_full(tmp_path, monkeypatch):
    """Of rows in two languages, all in several bundles and small steps, k best pairs of each row are found, ties by rank, with about as many computed in full."""
    rng = np.random.default_rng(3)

    def bundle(n):
        m = np.zeros((n, 120))
        for row in m:
            at = 60 * rng.integers(2)
            row[at + np.minimum(59, rng.pareto(0.7, 40).astype(int))] = rng.random(40) + 0.5
        m[n // 2] = m[0]
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        row, number = np.nonzero(m)
        known, token = np.unique(number, return_inverse=True)
        ids = rng.permutation(100_000)[:n].tolist()
        return m, ids, blocks._path(str(tmp_path), blocks._put(str(tmp_path), {"side": "r", "ids": ids, "group": [None] * n, "row": row.astype(np.int32), "token": token.astype(np.int32), "w": m[row, number], "number": known}))

    left, right = [[bundle(n) for n in sizes] for sizes in ((150, 90), (200, 160, 170))]
    monkeypatch.setattr(blocks, "CELLS", 3000)
    monkeypatch.setattr(blocks, "STEPS", 500)
    x, y = (blocks._gather([b[2] for b in side]) for side in (left, right))
    assert len(x["parts"]) > 2
    full = []
    monkeypatch.setattr(blocks, "_in_full", lambda *a, f=blocks._in_full: full.append(len(a[3])) or f(*a))
    cosine = {(e, r): s for m, es, _ in left for n, rs, _ in right for e, row in zip(es, np.round(m @ n.T, 6), strict=True) for r, s in zip(rs, row, strict=True)}
    rank = np.argsort(np.argsort(y["ids"]))
    found = {(x["ids"][i], y["ids"][j]): s for some in blocks.meet(x, y, 0.2) for i, j, s in zip(*some, strict=True)}
    assert set(found) == {p for p, s in cosine.items() if s >= 0.2} and all(abs(s - cosine[p]) < 2e-6 for p, s in found.items())
    for held in (blocks.HELD, 100):
        monkeypatch.setattr(blocks, "HELD", held)
        full.clear()
        near = [(x["ids"][i], -s, y["ids"][j]) for some in blocks.meet(x, y, 0.2, 3, rank=rank) for i, j, s in zip(*some, strict=True)]
        assert held == 100 or sum(full) < 4 * 3 * 240 < len(found) / 2
        for e in x["ids"]:
            assert sorted(p for p in near if p[0] == e)[:3] == sorted((e, -s, r) for (o, r), s in found.items() if o == e)[:3]
