from datetime import datetime

import numpy as np

from karyon.llm.knn import fit, nearest, nearest_samples

S = "id string, vec array<double>, at timestamp, near string"
T = datetime(2020, 1, 1)


def exact(x, ids, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, 1 << 40)
    rank = np.argsort(np.array(ids), kind="stable").argsort()
    return {ids[i]: [ids[j] for j in np.lexsort((rank, d[i]))[:k]] for i in range(len(ids))}


def test_recall_ties_and_copies(spark, ws):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 200, (12, 8))
    x = np.clip(centres[rng.integers(0, 12, 1500)] + rng.integers(-12, 13, (1500, 8)), 0, 200)
    x[700:1200] = x[3]  # a third are exact copies
    ids = [f"s{i:05d}" for i in rng.permutation(1500)]
    rows = [(i, [v / 100 for v in r], T, "clash") for i, r in zip(ids, x.tolist())]
    rows += [(ids[0], [v / 100 for v in x[0].tolist()], T, "again"), ("bad1", [0.5] * 7, T, ""), ("bad2", [2.5] * 8, T, ""), ("bad3", [None] + [0.5] * 7, T, ""), ("bad4", [float("nan")] * 8, T, ""), ("bad5", None, T, ""), (None, [0.5] * 8, T, "")]
    got = {}
    for r in nearest_samples(spark.createDataFrame(rows, S), 8, 2.0, 0.01, 5, ws, parts=4, train=800, gauged=100).collect():
        got.setdefault(r.id, set()).add(r.near)
    want = exact(x, ids, 5)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len(got[i] & set(want[i])) / 5 for i in ids])
    assert recall > 0.97
    copies = [i for i, r in zip(ids, x) if (r == x[3]).all()]
    assert all(got[i] == set(want[i]) for i in copies)


def test_hot_list_is_cut_into_blocks(spark, ws):
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(90, 110, (900, 6)), axis=0)
    df = spark.createDataFrame([(f"s{i:04d}", bytes(r.tolist())) for i, r in enumerate(x.astype(np.uint8))], "id string, vec binary")
    got = {}
    for r in nearest(df, 6, 3, ws, parts=3, block=64, probes=1000).collect():
        got.setdefault(r.id, []).append((r.rank, r.near))
    want = exact(x.astype(int), [f"s{i:04d}" for i in range(len(x))], 3)
    hit = np.mean([[n for _, n in sorted(got[i])] == want[i] for i in want])
    assert hit > 0.97


def test_dense_region_is_searched_whole(spark, ws):
    rng = np.random.default_rng(8)
    x = np.concatenate([100 + rng.integers(-3, 4, (1500, 16)), rng.integers(0, 201, (1500, 16))])
    x = np.unique(x, axis=0)
    ids = [f"s{i:05d}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(i, bytes(r)) for i, r in zip(ids, x.astype(np.uint8).tolist())], "id string, vec binary")
    got = {}
    for r in nearest(df, 16, 5, ws, parts=4, probes=1000).collect():
        got.setdefault(r.id, []).append((r.rank, r.near))
    want = exact(x.astype(int), ids, 5)
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == want


def test_few_lists_of_many_are_probed(spark, ws, caplog):
    """Probes are what the gauge against brute force asks for; the share of lists falls as rows grow."""
    import logging

    rng, share = np.random.default_rng(9), []
    centres = rng.integers(0, 201, (40, 16))
    for n in (1000, 8000):
        x = np.unique(np.clip(centres[rng.integers(0, 40, n)] + rng.integers(-20, 21, (n, 16)), 0, 200), axis=0)
        ids = [f"s{i:05d}" for i in range(len(x))]
        df = spark.createDataFrame([(i, bytes(r)) for i, r in zip(ids, x.astype(np.uint8).tolist())], "id string, vec binary")
        with caplog.at_level(logging.INFO, "karyon.llm.knn"):
            caplog.clear()
            got = {}
            for r in nearest(df, 16, 5, ws, parts=4, gauged=200).collect():
                got.setdefault(r.id, set()).add(r.near)
        _, lists, probed = caplog.records[-1].args
        share.append(probed / lists)
        some = rng.choice(len(x), 300, replace=False)
        d = ((x[some][:, None, :] - x[None]) ** 2).sum(2)
        d[np.arange(300), some] = 1 << 40
        true = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :5]
        assert np.mean([len(got.get(ids[i], set()) & {ids[j] for j in t}) / 5 for i, t in zip(some, true)]) > 0.95
        assert lists >= 3 * np.sqrt(len(x))
    assert share[1] < share[0] < 0.5


def test_empty_one_two(spark, ws):
    assert nearest_samples(spark.createDataFrame([], S), 8, 2.0, 0.01, 5, ws).count() == 0
    one = [("a", [0.1] * 8, T, "")]
    assert nearest_samples(spark.createDataFrame(one, S), 8, 2.0, 0.01, 5, ws).count() == 0
    two = nearest_samples(spark.createDataFrame(one + [("b", [0.1] * 8, T, "")], S), 8, 2.0, 0.01, 5, ws)
    assert sorted((r.id, r.near, r.dist) for r in two.collect()) == [("a", "b", 0), ("b", "a", 0)]


def test_codes_reproduce_vectors_roughly():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 200, (500, 8)).astype(np.float32)
    ix = fit(x, 10, 4, 32)
    near = ix.nearest_lists(x, 1)[:, 0]
    code, off = ix.encode(x - ix.centroids[near])
    back = ix.centroids[near] + np.concatenate([ix.codebooks[j][code[:, j]] for j in range(4)], 1)
    assert np.allclose(np.sqrt(((back - x) ** 2).sum(1)), off, atol=1e-2)
    q = rng.integers(0, 200, (20, 8)).astype(np.float32)
    mine = near == near[0]
    got = ix.distances(q - ix.centroids[near[0]], code[mine])
    assert np.allclose(got, np.sqrt(((q[:, None] - back[mine][None]) ** 2).sum(2)), atol=0.1)
    assert ((back - x) ** 2).mean() < 0.5 * ((x - ix.centroids[near]) ** 2).mean()
