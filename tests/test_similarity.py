import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.functions import similarity as S

short = st.text("abc de", max_size=9)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(short, short)
def test_lcs(a, b):
    assert S.lcs_length(a, b) == plain_lcs(a, b)


def test_ratios():
    assert S.ratio("", "") == 1 and S.ratio("", "x") == 0
    assert S.token_sort_ratio("b a", "a b") == 1
    assert S.token_set_ratio("a b c", "a b") == 1 and S.token_set_ratio("", "a") == 0
    assert S.partial_ratio("abc", "xxabcxx") == 1


@pytest.mark.parametrize("a,b", [("martha", "marhta"), ("dixon", "dicksonx"), ("abc", "xyz"), ("small ring", "small rung"), ("a", "a")])
def test_jaro_winkler_is_duckdbs(a, b):
    assert S.jaro_winkler(a, b) == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])
