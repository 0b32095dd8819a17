"""Rows of earliest places against their windows one by one, and repetitive texts."""

import random

import numpy as np
import pytest

from lodestone.llm import substring_dedup as S


def test_rising():
    for first, n in ((5, 0), (7, 1), (123, 9)):
        assert S._rising(first, n) == sum((first + k) * pow(S._BASE, k, S._PRIME) for k in range(n)) % S._PRIME


def row(runs):
    sizes = [r[0] for r in runs]
    return S.Row(np.cumsum([0, *sizes])[:-1], sum(sizes), *(np.array([r[k] for r in runs]) for k in (1, 2, 3)))


def test_common_windows():
    rng = random.Random(1)
    some = lambda: [(rng.randint(1, 4), rng.randint(0, 1), 0, rng.randint(0, 5)) for _ in range(rng.randint(1, 8))]
    each = lambda runs: [(b, d, w + k) for n, b, d, w in runs for k in range(n)]
    for _ in range(1000):
        one, two = some(), some()
        if rng.random() < 0.5:
            two = two[:2] + one[rng.randint(0, len(one) - 1) :] + two[2:]
        a, b = each(one), each(two)
        i, j, n = rng.randint(0, len(a) - 1), rng.randint(0, len(b)), 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert row(one).common(i, row(two), j) == n


@pytest.mark.parametrize("block", [10_000, 8_000_000])
def test_repetitive_texts(spark, block):
    lines = ["same line again. ", "a ", "x y z " * 7]
    rows = [(k, line * 3000) for k, line in enumerate(lines)] + [(10 + k, line * 2000 + "end") for k, line in enumerate(lines)]
    got = {r.doc_id: r for r in S.factorize(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), block_chars=block).collect()}
    assert [(got[k].n_words - got[k].n_removed, [tuple(f) for f in got[k].factors]) for k in (0, 1, 2)] == [(n, [(n, got[k].n_words - n, k, 0 if n < 20 else n - period)]) for k, n, period in ((0, 3, 3), (1, 1, 1), (2, 3, 3))]
    assert [(got[k].kept, len(got[k].factors)) for k in (10, 11, 12)] == [("end", 1)] * 3
