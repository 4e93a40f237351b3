import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from karyon.llm.packing import best_fit, nnls, pack, plan


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plan_uses_each_item_once(sizes):
    hist = np.bincount(np.array(sizes, int), minlength=61)
    used = np.zeros(61, int)
    for lengths, times in plan(hist, 60, window=3, most=200)[0]:
        assert sum(lengths) <= 60
        for n in lengths:
            used[n] += times
    assert (used == hist).all()


@pytest.mark.parametrize("n", [10_000, 100_000])
@pytest.mark.parametrize(("mean", "sd"), [(6.3, 0.7), (6.0, 1.0)])
def test_least_squares_make_most_containers_and_waste_no_more_than_best_fit(n, mean, sd):
    x = np.clip(np.random.default_rng(0).lognormal(mean, sd, n).astype(int), 1, 2048)
    hist = np.bincount(x, minlength=2049)
    made, by_squares = plan(hist, 2048)
    total = sum(t for _, t in made)
    assert by_squares > 0.8 * total
    assert total <= best_fit(hist, 2048).total()
    assert total <= 1.01 * np.ceil(x.sum() / 2048)


def test_nnls():
    rng = np.random.default_rng(1)
    combos = rng.integers(0, 30, (12, 3))
    combos[:, 0] = np.arange(12) + 1
    each = np.array([1, 1, 4])
    x, m = np.maximum(0, rng.normal(size=12)), np.zeros((30, 12))
    for j, c in enumerate(combos):
        for n, k in zip(c, each):
            m[n, j] += k if n else 0
    got = nnls(combos, each, m @ x, np.ones(30), 20_000)
    assert (got >= 0).all() and np.allclose(m @ got, m @ x, atol=1e-2)


def test_places(spark, ws):
    rng = np.random.default_rng(2)
    sizes = [*rng.integers(1, 100, 500).tolist(), *[40] * 300, 250, 300, 100, 0, None]
    df = spark.createDataFrame([(i, None if s is None else int(s), "c") for i, s in enumerate(sizes)], "doc_id long, tokens long, container string")
    rows = pack(df, 100, ws, salts=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert sum(r.tokens for r in pieces) == (s or 0)
        assert len(pieces) == max(1, -(-(s or 0) // 100))
        assert all((r.container is None) == (not s) for r in pieces)
    held = {}
    for r in rows:
        if r.container is not None:
            held.setdefault(r.container, []).append((r.offset, r.tokens))
    for v in held.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 100
    assert sorted(held) == list(range(len(held)))


def test_empty(spark, ws):
    assert pack(spark.createDataFrame([], "doc_id long, tokens long"), 10, ws).count() == 0
