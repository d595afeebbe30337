"""The frontier against all pairs: small and large groups, slack chains, ties, nulls."""

import time

import numpy as np
import pytest

from promptloom.operators import score, skyline


def brute(x):
    x = np.where(np.isnan(x), -np.inf, x)
    with np.errstate(invalid="ignore"):
        return np.array([not ((x >= r - skyline.SLACK).all(1) & (x > r + skyline.SLACK).any(1)).any() for r in x])


def test_maximal_decides_about_everybody():
    rng = np.random.default_rng(1)
    for n, dims, grid in ((1, 3, 5), (50, 2, 4), (900, 3, 6), (700, 7, 3), (600, 4, 1000)):
        x = rng.integers(0, grid, (n, dims)) / grid
        x[rng.random((n, dims)) < 0.02] = np.nan
        x += rng.integers(-2, 3, x.shape) * 0.6e-9  # chains within the slack
        best = np.where(np.isnan(x), -np.inf, x)[skyline.maximal(x)]
        filled = np.where(np.isnan(x), -np.inf, x)
        assert all((best >= r).all(1).any() for r in filled)
        assert (~skyline.dominated(filled, best) == brute(x)).all()


@pytest.mark.parametrize(("small", "part"), [(256, 20_000), (3, 40), (0, 7)])
def test_frontier(spark, monkeypatch, small, part):
    monkeypatch.setattr(skyline, "SMALL", small)
    monkeypatch.setattr(skyline, "PART_ROWS", part)
    rng = np.random.default_rng(2)
    rows = []
    for g, n in ((None, 30), ("a", 1), ("b", 600), ("c", 5), ("", 40)):
        for v in rng.integers(0, 8, (n, 3)) / 8 + rng.integers(-1, 2, (n, 3)) * 0.7e-9:
            rows.append((g, len(rows), *(float(c) if rng.random() > 0.01 else None for c in v), "x", True))
    df = spark.createDataFrame(rows, "g string, id long, p double, q double, s double, row string, r boolean")
    got = {r["id"]: r["on_frontier"] for r in skyline.frontier(df, "g", ("p", "q", "s")).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        want = brute(np.array([r[2:5] for r in own], float))
        assert [got[r[1]] for r in own] == want.tolist()
    assert skyline.frontier(df.limit(0), "g", ("p", "q", "s")).count() == 0


def test_one_large_group(spark):
    """A hundred thousand candidates of one prompt with seven objectives; every part's rows are held against the frontier only."""
    n, rng = 100_000, np.random.default_rng(3)
    x = rng.random((n, 7)) ** 0.3
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(x)], "prompt_id long, idx long, " + ", ".join(f"{c} double" for c in score.NAMES))
    began = time.time()
    got = {r["idx"] for r in score.pareto(df).where("on_frontier").select("idx").collect()}
    assert time.time() - began < 120
    on = sorted(got)
    assert brute(x[on]).all()  # none of them dominates another
    off = np.setdiff1d(rng.choice(n, 3000, replace=False), on)
    assert skyline.dominated(x[off], x[on]).all()
