"""Similarity of strings and token sets. Set measures are columns; edit kernels run over distinct pairs of an Arrow batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ok, words


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, with the bits of one number as the table's row."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens, and those with either side's own; 1 if one side has no own, 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, own_x, own_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and not (own_x and own_y):
        return 1.0
    left, right = f"{common} {own_x}".strip(), f"{common} {own_y}".strip()
    best = ratio(left, right)
    return max(best, ratio(common, left), ratio(common, right)) if common else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against the stretches of the longer one that are as long, or cut at an end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return float(not long)
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by up to four common first characters where it is above 0.7."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if b[j] == c and not taken[j]:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


KERNELS = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler}


def compare(a: Column, b: Column, *names: str) -> Column:
    """Struct of the named kernels for two columns, null where a side is null."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        for pair in zip(left, right, strict=True):
            if pair not in memo:
                memo[pair] = tuple(None if None in pair else KERNELS[n](*pair) for n in names)
        return pd.DataFrame([memo[p] for p in zip(left, right, strict=True)], columns=list(names), dtype="float64")

    return run(a, b)


def equal(a: Column, b: Column) -> Column:
    """1 or 0; null unless both are usable."""
    return F.when(ok(a) & ok(b), (a == b).cast("double"))


def set_measures(a: Column, b: Column) -> dict[str, Column]:
    """Jaccard, containment (by the smaller set), length ratio and difference, first tokens equal; null where a side has no tokens."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = (F.size(x) > 0) & (F.size(y) > 0)
    common = F.size(F.array_intersect(x, y)).cast("double")
    return {
        "jaccard": F.when(both, common / F.size(F.array_union(x, y))),
        "containment": F.when(both, common / F.least(F.size(x), F.size(y))),
        "len_ratio": F.when(both, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))),
        "len_diff": F.when(both, F.abs(F.length(a) - F.length(b)).cast("double")),
        "first_tok_eq": F.when(both, (x[0] == y[0]).cast("double")),
    }
