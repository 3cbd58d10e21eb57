"""Edit kernels against plain dynamic programming; codes of the phonetic queries against their rules."""

import itertools
import random

import pytest

from kinweave.functions import similarity as S


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def plain_ratio(a, b):
    return 2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def samples():
    r = random.Random(3)
    some = ["", "a", "ab", "abcd", "small ring", "ring small", "small small ring"] + ["".join(r.choices("ab c", k=r.randint(1, 14))) for _ in range(25)]
    return list(itertools.product(some, some))


def test_ratio():
    for a, b in samples():
        assert S.ratio(a, b) == pytest.approx(plain_ratio(a, b))


def test_sorted_tokens():
    for a, b in samples():
        assert S.token_sort_ratio(a, b) == pytest.approx(plain_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def test_partial_is_the_best_window():
    for a, b in samples():
        short, long = sorted((a, b), key=len)
        windows = {long[i:j] for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(short) or (j - i < len(short) and (i == 0 or j == len(long)))}
        assert S.partial_ratio(a, b) == pytest.approx(max((plain_ratio(short, w) for w in windows), default=float(not long)) if short else float(not long))


def test_token_sets():
    assert S.token_set_ratio("small ring", "ring small small") == 1.0
    assert S.token_set_ratio("small ring", "small ring of gold") == 1.0
    assert S.token_set_ratio("", "a") == 0.0
    for a, b in samples():
        x, y = set(a.split()), set(b.split())
        if x and y and not (x & y):
            assert S.token_set_ratio(a, b) == pytest.approx(plain_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def test_soundex_and_hash_queries(spark):
    from kinweave.plans.queries import QUERIES

    code = {c: d for d, letters in zip("123456", ("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), strict=True) for c in letters}

    def soundex(w):
        out, last = w[0].upper(), code.get(w[0])
        for c in w[1:]:
            now = code.get(c)
            if now and now != last:
                out += now
            if c not in "hw":
                last = now
        return (out + "000")[:4]

    sf = "/root/testdata/sf0.001"
    for r in QUERIES["soundex_codes"](spark, sf).collect():
        assert r["codes"] == [soundex(w) for w in r["p_name"].lower().split()]
    import xxhash

    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    for r in QUERIES["key_hash"](spark, sf).collect():
        assert r["key"] % 2**64 == xxhash.xxh64_intdigest(names[r["p_partkey"]].encode(), 42)
