"""Change points against the recursion they are defined by, on long series, and for rows in any order."""

from __future__ import annotations

import time

import numpy as np
import pytest

from lathe.operators import windows


def brute(values: np.ndarray, low: int, high: int, size: int, reach: int, limit: float) -> list[int]:
    """Cuts of [low, high): the first place of least p, then those of each side."""
    places = range(low + size, high - size + 1)
    p = [windows.mann_whitney_p(values[max(low, i - reach) : i], values[i : min(high, i + reach)]) for i in places]
    if not p or min(p) >= limit:
        return []
    i = places[int(np.argmin(p))]
    return [*brute(values, low, i, size, reach, limit), i, *brute(values, i, high, size, reach, limit)]


@pytest.mark.parametrize(("size", "reach", "limit"), [(6, 24, 1e-3), (6, 24, 0.2), (12, 5, 0.05), (1, 10, 0.01)])
def test_change_points_against_recursion(size, reach, limit):
    r = np.random.default_rng(3)
    series = [np.zeros(0), np.zeros(90), np.arange(200.0), r.normal(size=2 * size - 1), r.normal(size=2 * size), np.repeat(r.integers(0, 4, 12), 20) + np.round(r.normal(size=240), 1),
              np.repeat(r.normal(size=40), 7), np.where(r.random(150) < 0.2, np.inf, r.integers(0, 3, 150)), np.cumsum(r.normal(size=300))]
    for v in series:
        assert windows.change_points(v, size, reach, limit) == brute(v, 0, len(v), size, reach, limit)


def test_change_points_in_time_of_length():
    """Each cut once cost a look at all the values beside it: 600 levels of 60 values took minutes."""
    v = np.repeat(np.random.default_rng(5).permutation(600), 60)
    began = time.process_time()
    assert windows.change_points(v) == list(range(60, 36_000, 60))
    assert time.process_time() - began < 20


def test_segments_of_rows_in_any_order(spark):
    rows = [("a", t // 4, float(t * 7 % 5 + (t > 60) * 3)) for t in range(120)] + [("b", t, None) for t in range(9)] + [(None, t, float(t > 20)) for t in range(40)] + [("c", 1, 2.0)]
    one, two = (sorted(map(tuple, windows.segments(spark.createDataFrame(x, "k string, t long, v double").coalesce(1), ["k"], "t", "v").collect()), key=str) for x in (rows, rows[::-1]))
    assert one == two
    assert {k: sum(r[4] for r in one if r[0] == k) for k in ("a", "c", None)} == {"a": 120, "c": 1, None: 40}
    assert [r[2:] for r in one if r[0] is None] == [(0, 21, 21, 0.0, 0.0), (21, 40, 19, 1.0, 0.0)]
