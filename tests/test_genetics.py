import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from karyon.functions import calls as C
from karyon.functions.special import betainc, gamma_cdf, t_two_sided
from karyon.plans.packing import gram, packed_rows
from karyon.plans.sparse import runs, sparse_gram, whole_rows
from karyon.operators import aggregation as agg
from karyon.operators import association as assoc
from karyon.operators import ld, popgen
from karyon.operators import pedigree as ped
from karyon.operators import relatedness as rel
from karyon.operators import windows as win
from karyon.operators.hwe import exact_p


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def gt(*x):
    return F.array(*[F.lit(v) for v in x])


def long(spark, matrix, name="dosage"):
    rows = [(v, s, None if x is None or np.isnan(x) else float(x)) for v, r in enumerate(matrix) for s, x in enumerate(r)]
    return spark.createDataFrame(rows, f"variant_index long, sample_index int, {name} double")


def square(df, n):
    m = np.full((n, n), np.nan)
    for r in df.collect():
        m[r.i, r.j] = np.nan if r.value is None else r.value
    return m


def test_call_expressions(spark):
    r = one(
        spark, a=C.allele_counts(gt(0, 1, -1), 2), f=C.frequencies(C.allele_counts(gt(-1, -1), 2)), h=C.heterozygosity(C.allele_counts(gt(0, 1), 2)), h1=C.heterozygosity(C.allele_counts(gt(0, -1), 2)),
        c=C.complete(gt(0, -1)), m=C.complete(gt(0, -1, -2), True), p=C.call_ploidy(gt(0, -1, -2)), s=C.format_genotype(gt(0, -1, -2)), ph=C.format_genotype(gt(0, 1), F.lit(True)),
        x=C.hard_call(F.array(F.lit(0.05), F.lit(0.92), F.lit(0.03))), y=C.hard_call(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), 0.0), z=C.hard_call(F.array(F.lit(0.6), F.lit(float("nan")), F.lit(0.4)), 0.0),
        hr=C.is_hom_alt(gt(2, 2)), he=C.is_het(gt(0, 0, 1)), ms=C.is_het(gt(0, -1)), k=C.self_kinship(F.lit(0.5), 4),
    )
    assert r.a == [1, 1] and r.f == [None, None] and r.h == 1.0 and r.h1 is None
    assert r.c == [-1, -1] and r.m == [-1, -1, -2] and r.p == 2 and r.s == "0/." and r.ph == "0|1"
    assert (r.x, r.y, r.z) == ([1, 0], [-1, -1], [-1, -1]) and r.hr and r.he and not r.ms and r.k == 2.5 / 4
    with pytest.raises(ValueError):
        C.hard_call("p", 1.5)


def test_genotype_index(spark):
    calls = [(5, 4), (1, 0), (7, 7), (8, 8), (4, 7), (-1, 9), (3, 0), (5, 5)]
    got = [one(spark, i=C.genotype_index(gt(*c), 10, 2)).i for c in calls]
    assert got == [19, 1, 35, 44, 32, -1, 6, 20]
    for k in range(35):
        g = C.index_genotype(k, 4)
        assert g == sorted(g) and one(spark, i=C.genotype_index(gt(*g), 4, 4)).i == k
    assert C.genotype_labels(2, 2) == ["0/0", "0/1", "1/1"]


def test_hardy_weinberg():
    def slow(h, a, b):
        rare, n = 2 * min(a, b) + h, h + a + b
        p = {rare % 2: 1.0}
        for x in range(rare % 2, rare - 1, 2):
            hr, hc = (rare - x) / 2, n - (rare + x) / 2
            p[x + 2] = p[x] * 4 * hr * hc / ((x + 2) * (x + 1))
        total = sum(p.values())
        return min(1.0, sum(v for v in p.values() if v <= p[h] * (1 + 1e-9)) / total)

    for c in [(1, 0, 0), (51, 27, 26), (101, 47, 56), (0, 5, 5), (10, 0, 90), (3, 1, 30)]:
        assert exact_p(*c) == pytest.approx(slow(*c), rel=1e-8)
    assert exact_p(51, 27, 26) == pytest.approx(0.845926828898329)
    assert np.isnan(exact_p(0, 0, 0)) and exact_p(10**5, 0, 0) < 1e-10
    with pytest.raises(ValueError):
        exact_p(-1, 0, 0)


def loci(spark, *contigs):
    rows, k = [], 0
    for c, positions in enumerate(contigs):
        for p in positions:
            rows.append((k, c, p))
            k += 1
    return spark.createDataFrame(rows, "variant_index long, contig int, position long")


def edges(df):
    rows = sorted(df.collect(), key=lambda r: r.window_index)
    return [r.start for r in rows], [r.stop for r in rows]


def test_windows(spark):
    five = loci(spark, range(5), range(5))
    assert edges(win.window_by_variant(five, 3)) == ([0, 3, 5, 8], [3, 5, 8, 10])
    assert edges(win.window_by_variant(five, 3, 2)) == ([0, 2, 4, 5, 7, 9], [3, 5, 5, 8, 10, 10])
    two = loci(spark, [1, 4, 6, 8, 12], [1, 21, 25, 40, 55])
    assert edges(win.window_by_position(two, 10, offset=1)) == ([0, 4, 5, 6, 6, 8, 9, 9], [4, 5, 6, 6, 8, 9, 9, 10])
    assert edges(win.window_by_locus(two, 10, -5)) == ([0, 0, 0, 1, 3, 5, 6, 6, 8, 9], [2, 4, 4, 5, 5, 6, 8, 8, 9, 10])
    assert edges(win.window_by_position(loci(spark, [1, 4, 6, 8, 12]), 10, 5, -5)) == ([0, 0, 2], [2, 4, 5])
    iv = spark.createDataFrame([(0, 1, 5, 0), (0, 7, 10, 1), (1, 2, 22, 2), (1, 30, 50, 3), (1, 56, 60, 4)], "contig int, from_position long, to_position long, interval_index int")
    assert edges(win.window_by_interval(two, iv)) == ([0, 3, 6, 8], [2, 4, 7, 9])
    assert edges(win.window_by_genome(two)) == ([0], [10])
    shuffled = two.drop("variant_index").orderBy(F.rand(1))
    assert [r.variant_index for r in win.genomic_index(shuffled, "contig", "position", bin_size=10).orderBy("contig", "position").collect()] == list(range(10))
    got = {(r.variant_index, r.window_index) for r in win.assign(two.select("variant_index"), win.window_by_variant(two, 3, 2), bin_size=2).collect()}
    assert got == {(v, w) for w, (a, b) in enumerate(zip([0, 2, 4, 5, 7, 9], [3, 5, 5, 8, 10, 10])) for v in range(a, b)}


def test_popgen_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 9, (12, 3, 2))
    n[4, 1] = 0
    rows = [(v, c, n[v, c].tolist()) for v in range(12) for c in range(3)]
    counts = spark.createDataFrame(rows, "variant_index long, cohort int, cohort_allele_count array<long>")
    w = win.window_by_variant(loci(spark, range(12)), 4)
    tot = n.sum(2).astype(float)
    with np.errstate(all="ignore"):
        pi = (tot * (tot - 1) / 2 - (n * (n - 1) / 2).sum(2)) / (tot * (tot - 1) / 2)
        d01 = 1 - (n[:, 0] * n[:, 1]).sum(1) / (tot[:, 0] * tot[:, 1])
    got = {(r.unit, r.cohort): r.value for r in popgen.diversity(counts, w).collect()}
    for u in range(3):
        want = pi[4 * u : 4 * u + 4, 1].sum()
        assert got[u, 1] is None if np.isnan(want) else got[u, 1] == pytest.approx(want)
    f = {(r.unit, r.cohort_0, r.cohort_1): r.value for r in popgen.Fst(counts, w).collect()}
    assert f[0, 0, 1] == pytest.approx(1 - (pi[:4, 0].sum() + pi[:4, 1].sum()) / 2 / d01[:4].sum())
    assert f[1, 0, 1] is None
    assert popgen.pbs(popgen.Fst(counts, w), [(0, 1, 2)]).count() == 3
    with pytest.raises(ValueError):
        popgen.Fst(counts, w, "x")


def test_ld_and_pruning(spark):
    g = np.zeros((10, 10))
    rng = np.random.default_rng(1)
    g[:] = rng.integers(0, 3, (10, 10))
    g[3], g[8], g[5] = g[2], g[7], 1
    v = loci(spark, range(10))
    w = win.window_by_variant(v, 10)
    m = {(r.i, r.j): r.value for r in ld.ld_matrix(long(spark, g), v, w, 10, block=4).collect()}
    assert len(m) == 55 and all(m[i, i] == 1 for i in range(10)) and m[2, 3] == pytest.approx(1) and m[1, 5] is None
    assert m[0, 9] == pytest.approx(np.corrcoef(g[0], g[9])[0, 1] ** 2, rel=1e-5)
    e = spark.createDataFrame([(2, 3, 0), (7, 8, -1), (3, 4, 0)], "i long, j long, cmp int")
    assert sorted(r[0] for r in ld.maximal_independent_set(e).collect()) == [3, 7]
    assert sorted(r.variant_index for r in ld.ld_prune(long(spark, g), v, w, 10, 0.95).collect()) == [0, 1, 2, 4, 5, 6, 7, 9]


def test_pruning_of_very_many_runs(spark):
    """100,000 runs of three variants take no group each."""
    import time

    e = spark.range(100_000).selectExpr("explode(array(struct(3 * id as i, 3 * id + 1 as j, 0 as c), struct(3 * id + 1 as i, 3 * id + 2 as j, 0 as c))) x").selectExpr("x.i i", "x.j j", "x.c cmp")
    began = time.time()
    lost = ld.maximal_independent_set(e).toPandas()["ld_prune_index_to_drop"]
    assert len(lost) == 100_000 and (lost % 3 == 1).all() and time.time() - began < 60


@pytest.mark.parametrize("known", [0.1, 0.9])
def test_ld_of_few_and_of_many_known_calls(spark, known):
    """Both ways to sum give the correlations over common samples; 50,000 samples cost nothing if none is known."""
    rng = np.random.default_rng(17)
    g = np.where(rng.random((60, 80)) < known, rng.integers(0, 3, (60, 80)).astype(float), np.nan)
    v = loci(spark, range(35), range(25))
    x = long(spark, g).withColumn("sample_index", F.col("sample_index") * 600)
    m = {(r.i, r.j): r.value for r in ld.ld_matrix(x, v, win.window_by_variant(v, 12, 5), 50_000, block=8).collect()}
    reach = {r.variant_index: r.stop for r in ld.owner_windows(v, win.window_by_variant(v, 12, 5)).collect()}
    assert set(m) == {(i, j) for i, stop in reach.items() for j in range(i, stop)}
    for (i, j), value in m.items():
        ok = ~np.isnan(g[i]) & ~np.isnan(g[j])
        p, q = g[i][ok], g[j][ok]
        if i == j:
            assert value == 1
        elif len(p) < 2 or p.std() < 1e-6 or q.std() < 1e-6:
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(p, q)[0, 1] ** 2, rel=1e-5, abs=1e-6)


def test_relationships(spark):
    d = [[2, 1, 1], [1, 1, 1], [2, 1, 0], [2, 1, 1], [1, 0, 0], [1, 1, 2]]
    x = long(spark, d)
    freq = x.groupBy("variant_index").agg((F.avg("dosage") / 2).alias("frequency"))
    want = [[0.93617021, -0.21276596, -0.72340426], [-0.21276596, 0.17021277, 0.04255319], [-0.72340426, 0.04255319, 0.68085106]]
    assert np.allclose(square(rel.genomic_relationship(x, freq, 3), 3), want)
    n = np.nan
    d = [[0, 1, 1, 1], [1, n, 0, 1], [2, 0, 1, 1], [1, 2, n, 1], [1, 0, 1, 2], [2, 2, 0, 0]]
    x = long(spark, d)
    freq = x.groupBy("variant_index").agg((F.avg("dosage") / 2).alias("frequency"))
    g = square(rel.genomic_relationship(x, freq, 4, skipna=True), 4)
    assert np.allclose(g[0], [0.9744836, -0.16978417, -0.58417266, -0.33778858]) and np.allclose(g, g.T)
    assert np.isnan(square(rel.genomic_relationship(x, freq, 4), 4)[1]).all()
    full = np.random.default_rng(0).integers(0, 3, (40, 5)).astype(float)
    x = long(spark, full)
    freq = x.groupBy("variant_index").agg((F.avg("dosage") / 2).alias("frequency"))
    got = square(rel.genomic_relationship(x, freq, 5, estimator="Endelman-Jannink"), 5)
    p = full.mean(1) / 2
    w = full - 2 * p[:, None]
    c = w - w.mean(0)
    s = c.T @ c / 40
    t = np.eye(5) * np.diag(s).mean()
    k = min(1, max(0, (((c**2).T @ c**2 / 40 - s**2).sum() / 40) / ((s - t) ** 2).sum()))
    assert np.allclose(got, (k * t + (1 - k) * s + np.outer(w.mean(0), w.mean(0))) / (2 * (p * (1 - p)).mean()))


def test_identity_by_state(spark):
    calls = spark.createDataFrame([(0, 0, [0, 0]), (0, 1, [1, 1]), (0, 2, [1, 0]), (1, 0, [1, 1]), (1, 1, [1, 1]), (1, 2, [1, 0])], "variant_index long, sample_index int, call_genotype array<int>")
    ibs = rel.identity_by_state(calls, 3, 2)
    assert np.allclose(square(ibs, 3), [[1, 0.5, 0.5], [0.5, 1, 0.5], [0.5, 0.5, 0.5]])
    assert np.allclose(square(rel.weir_goudet_beta(ibs), 3), [[1, 0, 0], [0, 1, 0], [0, 0, 0]])
    gap = calls.unionByName(spark.createDataFrame([(2, 0, [0, 0]), (2, 1, [0, 0]), (2, 2, [-1, -1])], calls.schema))
    rows = {(r.i, r.j): r.value for r in rel.identity_by_state(gap, 3, 2, skipna=False).collect()}
    assert rows[0, 1] == pytest.approx(2 / 3) and rows[0, 2] is None and rows[2, 2] is None


def test_tiles_give_the_same_sums(spark, ws):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (90, 23)).astype(float)
    rows = packed_rows(long(spark, x), "variant_index", "sample_index", "dosage").repartition(5)
    features = lambda m, part: {"a": [(m, m)], "b": [(m, np.ones_like(m)), (np.ones_like(m), m)]}
    want = {"a": x.T @ x, "b": x.sum(0)[:, None] + x.sum(0)[None, :]}
    for tile in (2048, 7):
        got = gram(rows, features, ["a", "b"], 23, tile=tile, cells=200, ws=ws).toPandas()
        assert len(got) == 23 * 23
        for k, m in want.items():
            assert np.allclose(got.pivot(index="i", columns="j", values=k).to_numpy(), m)
    packed = rows.select("variant_index", "idx", "val")
    assert packed_rows(packed, "variant_index", "sample_index", "dosage").columns == ["variant_index", "idx", "val"]


def test_sparse_sums_take_only_the_pairs_that_meet(spark):
    rng = np.random.default_rng(12)
    x = np.where(rng.random((90, 53)) < 0.15, rng.integers(1, 3, (90, 53)).astype(float), np.nan)
    x[:, 7], x[40:60] = np.nan, rng.integers(1, 3, (20, 53))
    full, known = np.nan_to_num(x), ~np.isnan(x)
    rows = runs(long(spark, x).where("dosage is not null"), "variant_index", "sample_index", "dosage")
    weights = lambda b: {"s": [b.of["dosage"], b.of["dosage"] ** 2], "n": [np.ones(len(b.col))]}
    for tile, undefined in ((2048, False), (7, False), (7, True)):
        got = sparse_gram(rows, weights, ["s", "n"], 53, undefined, tile).toPandas()
        n = known.T.astype(float) @ known
        assert len(got) == (53 * 53 if undefined else (n > 0).sum()) and not got.duplicated(["i", "j"]).any()
        assert np.allclose(got["n"], n[got["i"], got["j"]]) and np.allclose(got["s"], (full.T @ full + (full**2).T @ full**2)[got["i"], got["j"]])
    blocks = list(whole_rows(rows.coalesce(1)._collect_as_arrow(), 50))
    assert sum(len(b.col) for b in blocks) == known.sum() and sorted(r for b in blocks for r in b.row) == sorted(np.flatnonzero(known.any(1)))


def test_identity_by_state_of_many_samples(spark):
    """6,000 samples, of which a variant has three: only pairs that meet cost memory."""
    calls = spark.range(2000).selectExpr("id variant_index", "explode(array(3 * id, 3 * id + 1, 3 * id + 2)) s").selectExpr("variant_index", "cast(s as int) sample_index", "array(0, cast(s % 2 as int)) call_genotype")
    ibs = rel.identity_by_state(calls, 6000, 2, undefined=False)
    assert ibs.count() == 2000 * 9 and {r.value for r in ibs.where("i = 4 and j in (3, 4, 5)").collect()} == {0.5, 1.0}


def test_beta_of_many_samples(spark):
    """The mean is that of the pairs that meet; identity by state is made once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    ibs = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 0.5), (1, 0, 0.5), (2, 1, 0.0), (1, 2, 0.0)], "i long, j long, value double").mapInPandas(count, "i long, j long, value double")
    got = {(r.i, r.j): r.value for r in rel.weir_goudet_beta(ibs).collect()}
    assert got[0, 1] == pytest.approx((0.5 - 0.25) / 0.75) and got[2, 1] == pytest.approx(-0.25 / 0.75) and seen.value == 6


def test_relationship_of_many_samples(spark):
    """6,000 samples in pairs: rows only for pairs that meet, over the variants known in both."""
    x = spark.range(3000).selectExpr("id v", "explode(array(struct(2 * id as s, 2 as d), struct(2 * id + 1 as s, 1 as d), struct((2 * id + 2) % 6000 as s, 0 as d))) x").selectExpr("v variant_index", "cast(x.s as int) sample_index", "cast(x.d as double) dosage")
    freq = x.groupBy("variant_index").agg((F.avg("dosage") / 2).alias("frequency"))
    g = rel.genomic_relationship(x, freq, 6000, skipna=True, undefined=False)
    assert g.count() == 6000 + 6 * 3000
    got = {(r.i, r.j): r.value for r in g.where("i in (10, 11)").collect()}
    assert got[11, 11] == 0 and got[10, 11] == 0 and got[10, 12] == pytest.approx(-2) and got[10, 10] == pytest.approx(2)


def test_pc_relate_over_tiles(spark):
    """More samples than a tile has, most calls missing."""
    rng = np.random.default_rng(15)
    n, g = 2060, rng.integers(0, 2, (40, 2060, 2))
    known = rng.random((40, n)) < 0.05
    calls = spark.createDataFrame([(int(v), int(s), g[v, s].tolist()) for v, s in zip(*np.nonzero(known))], "variant_index long, sample_index int, call_genotype array<int>")
    pcs = rng.normal(size=(n, 2))
    got = rel.pc_relate(calls, pcs, n).where("i in (3, 2055)").toPandas()
    x = np.where(known, g.sum(2), 0.0)
    x = np.where(known, x, x.sum(1, keepdims=True) / known.sum(1, keepdims=True))
    q = np.linalg.qr(np.column_stack([np.ones(n), pcs]))[0]
    mu = 0.5 * (x @ q) @ q.T
    keep = known & (mu > 0.01) & (mu < 0.99)
    r, s = np.where(keep, x / 2 - mu, 0), np.where(keep, np.sqrt(np.clip(mu * (1 - mu), 0, None)), 0)
    with np.errstate(invalid="ignore"):
        want = ((r.T @ r) / (s.T @ s))[got["i"], got["j"]]
    assert len(got) == 2 * n and np.allclose(got["value"].astype(float), want, equal_nan=True)


def test_inverse_of_a_matrix_with_undefined_values(spark):
    m = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0), (2, 2, None), (0, 2, None), (2, 0, None)], "i long, j long, value double")
    rows = {(r.i, r.j): r.value for r in rel.invert_relationship_matrix(m, [0, 1, 2]).collect()}
    assert rows[0, 0] == 0.5 and rows[1, 1] == 0.25 and rows[2, 2] is None and rows[0, 2] is None


def test_distance(spark):
    x = spark.createDataFrame([(0, [6.0, 4.0, 1.0]), (1, [4.0, 5.0, 2.0]), (2, [9.0, 7.0, 3.0]), (700, [-1.0, 7.0, 3.0])], "row_id long, vector array<double>")
    e = {(r.i, r.j): r.value for r in rel.pairwise_distance(x).collect()}
    assert e[0, 1] == pytest.approx(2.44948974) and e[1, 2] == pytest.approx(5.47722558) and e[2, 700] == 0 and len(e) == 10
    c = {(r.i, r.j): r.value for r in rel.pairwise_distance(x, "correlation").collect()}
    assert c[0, 1] == pytest.approx(2.62956526e-01) and c[0, 2] == pytest.approx(2.82353505e-03)
    with pytest.raises(NotImplementedError):
        rel.pairwise_distance(x, "cosine")


def test_hybrid(spark):
    a = [[1, 0, 0, 0.5, 0, 0.25], [0, 1, 0, 0.5, 0.5, 0.5], [0, 0, 1, 0, 0.5, 0.25], [0.5, 0.5, 0, 1, 0.25, 0.625], [0, 0.5, 0.5, 0.25, 1, 0.625], [0.25, 0.5, 0.25, 0.625, 0.625, 1.125]]
    g = [[1.3, 0.3, 0.71], [0.3, 1.3, 0.73], [0.71, 0.73, 1.45]]
    coo = lambda m, at: spark.createDataFrame([(at[i], at[j], float(x)) for i, r in enumerate(m) for j, x in enumerate(r)], "i long, j long, value double")
    A, G = coo(a, range(6)), coo(g, [3, 4, 5])
    h = square(rel.hybrid_relationship(G, A, list(range(6)), [3, 4, 5]), 6)
    assert np.allclose(h[0], [1.084, 0.056, -0.028, 0.653, -0.013, 0.281], atol=1e-3)
    inv = lambda m, at: rel.invert_relationship_matrix(m, at)
    hi = square(rel.hybrid_inverse_relationship(inv(A, list(range(6))), inv(G, [3, 4, 5]), inv(A, [3, 4, 5])), 6)
    assert np.allclose(h @ hi, np.eye(6), atol=1e-8)


PED = "ped long, id long, p long, q long"


def test_pedigree_small(spark, ws):
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, None, None), (1, 2, 0, 1), (1, 3, 0, 2), (2, 7, None, None)], PED)
    k = {(r.ped, r.i, r.j): r.value for r in ped.pedigree_kinship(df).collect()}
    assert (k[1, 0, 0], k[1, 0, 3], k[1, 1, 3], k[1, 2, 3], k[1, 3, 3], k[2, 7, 7]) == (0.5, 0.375, 0.125, 0.375, 0.625, 0.5) and (1, 0, 1) not in k
    m = square(ped.pedigree_inverse_kinship(df, ped.pedigree_kinship(df)).where("ped = 1"), 4)
    full = np.array([[0.5, 0, 0.25, 0.375], [0, 0.5, 0.25, 0.125], [0.25, 0.25, 0.5, 0.375], [0.375, 0.125, 0.375, 0.625]])
    assert np.allclose(np.nan_to_num(m), np.linalg.inv(full))
    six = spark.createDataFrame([(0, 0, None, None), (0, 1, None, None), (0, 2, 1, 0), (0, 3, 2, 0), (0, 4, 0, 2), (0, 5, 1, 3)], PED)
    c = {(r.x, r.y): r.value for r in ped.pedigree_contribution(six, ws).collect()}
    assert (c[0, 5], c[1, 5], c[0, 3], c[2, 5], c[5, 5]) == (0.375, 0.625, 0.75, 0.25, 1.0)
    s = {r.id: (r.p, r.q) for r in ped.pedigree_sel(six, spark.createDataFrame([(0, 3)], "ped long, id long"), ws, ancestor_depth=1, descendant_depth=-1).collect()}
    assert s == {0: (None, None), 2: (None, 0), 3: (2, 0), 5: (None, 3)}


def test_sparse_self_kinship_is_the_diagonal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 40))
        parents = np.array([[-1, -1] if i < 3 or rng.random() < 0.2 else [int(rng.integers(0, i)), int(rng.integers(0, i))] for i in range(n)])
        turn = rng.permutation(n)
        back = np.argsort(turn)
        parents = np.where(parents[turn] >= 0, back[parents[turn]], -1)
        for g in (ped.Gametes.diploid(parents), ped.Gametes(parents, np.full((n, 2), 2.0), np.full((n, 2), 0.1))):
            assert np.allclose(ped.self_kinship(g), np.diag(ped.kinship(g)))


def test_hamilton_kerr(spark):
    cols = ["ped", "id", "p", "q", "tau_p", "lambda_p", "tau_q", "lambda_q"]
    rows = [
        (1, None, None, 1, 0.0, 1, 0.0), (2, None, None, 2, 0.167, 2, 0.167), (3, None, 2, 0, 0.0, 2, 0.167), (4, 1, None, 2, 0.041, 0, 0.0),
        (5, 1, 3, 1, 0.0, 1, 0.0), (6, 1, 3, 2, 0.918, 2, 0.041), (7, 6, 2, 2, 0.167, 2, 0.167), (8, 6, 2, 2, 0.167, 2, 0.167),
    ]
    df = pd.DataFrame([(1, *r) for r in rows], columns=cols)
    _, g = ped._gametes(df)
    k = ped.kinship(g)
    assert np.allclose(k[4], [0.25, 0.153899400092293, 0.307798800184587, 0.25, 0.5, 0.278899400092294, 0.216399400092293, 0.216399400092293])
    assert np.allclose(np.diag(k), [0.5, 0.307798800184587, 0.615597600369174, 0.5205, 0.5, 0.39758952468851, 0.397214445816028, 0.397214445816028])
    sdf = spark.createDataFrame([(1, r[0], r[1], r[2], float(r[3]), r[4], float(r[5]), r[6]) for r in rows], "ped long, id long, p long, q long, tau_p double, lambda_p double, tau_q double, lambda_q double")
    inv = square(ped.pedigree_inverse_kinship(sdf, ped.pedigree_kinship(sdf)), 9)[1:, 1:]
    assert np.allclose(np.nan_to_num(inv) @ k, np.eye(8), atol=1e-6)
    f = [(0, None, None, 1, 0.0, 1, 0.0), (1, None, None, 1, 0.0, 1, 0.0), (2, 0, None, 4, 1 / 3, 0, 0.0), (3, 1, 2, 2, 0.1, 2, 0.0)]
    _, g = ped._gametes(pd.DataFrame([(1, *r) for r in f], columns=cols))
    own, size = np.diag(ped.kinship(g)), g.tau.sum(1)
    assert np.allclose((own * size - 1) / (size - 1), [0, 0, 1 / 3, 0.07222222])


def test_singular_kinship_is_an_error(spark):
    """A copy of a parent has no inverse; neither has an individual without kinship."""
    df = spark.createDataFrame([(1, 0, None, None, 1.0, 0.0, 1.0, 0.0), (1, 1, 0, None, 2.0, 0.0, 0.0, 0.0)], f"{PED}, tau_p double, lambda_p double, tau_q double, lambda_q double")
    kin = ped.pedigree_kinship(df)
    assert {(r.i, r.j): r.value for r in kin.collect()} == {(0, 0): 0.5, (0, 1): 0.5, (1, 1): 0.5}
    with pytest.raises(Exception, match="singular"):
        ped.pedigree_inverse_kinship(df, kin).collect()
    two = spark.createDataFrame([(1, 0, None, None), (1, 1, None, None)], PED)
    with pytest.raises(Exception, match="individual 1"):
        ped.pedigree_inverse_kinship(two, ped.pedigree_kinship(two).where("i = 0")).collect()


def test_inverse_without_the_kinship_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, *((None, None) if i < 3 else (int(rng.integers(0, i)), int(rng.integers(0, i))))) for k in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, PED)
    kin = ped.pedigree_kinship(df)
    a, b = ({(r.ped, r.i, r.j): r.value for r in x.collect()} for x in (ped.pedigree_inverse_kinship(df), ped.pedigree_inverse_kinship(df, kin)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    copy = spark.createDataFrame([(1, 0, None, None, 1.0, 0.0, 1.0, 0.0), (1, 1, 0, None, 2.0, 0.0, 0.0, 0.0)], f"{PED}, tau_p double, lambda_p double, tau_q double, lambda_q double")
    with pytest.raises(Exception, match="singular"):
        ped.pedigree_inverse_kinship(copy).collect()
    many = spark.range(20000).selectExpr("1L ped", "id", "case when id >= 4 then (id - 1) div 2 end p", "case when id >= 4 then (id - 2) div 3 end q")
    assert ped.pedigree_inverse_kinship(many).where("i = j").count() == 20000


def test_order_and_half_founders():
    assert list(ped.order(np.array([[1, 2], [-1, -1], [1, -1]]))) == [1, 2, 0]
    with pytest.raises(ValueError):
        ped.order(np.array([[1, -1], [0, -1]]))
    with pytest.raises(ValueError):
        ped.kinship(ped.Gametes.diploid(np.array([[-1, -1], [0, -1]])))


def test_parent_indices(spark):
    s = spark.createDataFrame([(0, "a", [".", "."]), (1, "b", ["a", "."])], "sample_index int, sample_id string, parent_id array<string>")
    assert {r.sample_index: r.parent for r in ped.parent_indices(s).collect()} == {0: [-1, -1], 1: [0, -1]}
    with pytest.raises(KeyError):
        ped.parent_indices(spark.createDataFrame([(0, "a", ["z"])], s.schema)).count()
    with pytest.raises(ValueError):
        ped.parent_indices(spark.createDataFrame([(0, ".", ["."])], s.schema)).count()


def test_genedrop_follows_descent(spark):
    p = pd.DataFrame({"ped": 1, "id": [0, 1, 2, 3], "p": [None, None, 0, 0], "q": [None, None, 1, 2]})
    f = spark.createDataFrame([(v, {0: [10, 11], 1: [12, 13]}) for v in range(4000)], "variant_index long, calls map<long, array<int>>")
    a = ped.simulate_genedrop(f, p, seed=3)
    rows = {(r.variant_index, r.id): r.call_genotype for r in a.collect()}
    assert all(rows[v, 2][0] in (10, 11) and rows[v, 2][1] in (12, 13) for v in range(4000))
    ibd = np.mean([len(set(rows[v, 3])) == 1 for v in range(4000)])
    assert abs(ibd - 0.25) < 0.03  # the inbreeding of a backcross
    again = {(r.variant_index, r.id): r.call_genotype for r in ped.simulate_genedrop(f.repartition(7), p, seed=3).collect()}
    assert again == rows


def test_special_functions():
    assert t_two_sided(np.array([2.0, 0.0, np.nan]), 10)[:2] == pytest.approx([0.0733880, 1.0], rel=1e-5)
    assert betainc(2.0, 3.0, np.array([0.4])) == pytest.approx(0.5248)
    assert gamma_cdf(2.0, 3.0) == pytest.approx(1 - np.exp(-3) * 4) and gamma_cdf(0.5, 30.0) == pytest.approx(1.0)


def test_regressions(spark):
    rng = np.random.default_rng(2)
    x, cov = rng.integers(0, 3, (30, 60)).astype(float), rng.normal(size=(60, 2))
    y = 2.0 * x[5] + cov @ [1.0, -1.0] + rng.normal(size=60)
    got = {r.variant_index: r for r in assoc.gwas_linear_regression(long(spark, x), y, cov).collect()}
    m = np.column_stack([x[5], np.ones(60), cov])
    b, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    t = b[0] / np.sqrt(rss[0] / 56 * np.linalg.inv(m.T @ m)[0, 0])
    assert got[5].beta == pytest.approx(b[0]) and got[5].t_value == pytest.approx(t) and got[5].p_value < 1e-8
    with pytest.raises(ValueError):
        assoc.basis(None, 5, False)


def test_regression_on_known_calls_is_that_on_imputed_ones(spark):
    rng = np.random.default_rng(16)
    x = np.where(rng.random((40, 70)) < 0.3, rng.integers(0, 3, (40, 70)).astype(float), -1.0)
    x[3, x[3] >= 0] = 1.0
    y, cov = rng.normal(size=(70, 2)), rng.normal(size=(70, 2))
    for c, intercept in ((cov, True), (None, True), (cov, False)):
        q = assoc.basis(c, 70, intercept)
        beta, t, _ = assoc.linear_regression(assoc._impute(x), y - q @ (q.T @ y), q)
        rows = assoc.gwas_linear_regression(long(spark, np.where(x < 0, np.nan, x)), y, c, intercept).toPandas()
        i, k = rows["variant_index"], rows["trait"]
        assert len(rows) == 80 and np.allclose(rows["beta"], beta[i, k], equal_nan=True) and np.allclose(rows["t_value"], t[i, k], equal_nan=True)
    wide = spark.range(2000).selectExpr("id variant_index", "explode(array(7 * id, 7 * id + 1, 7 * id + 2, 7 * id + 9)) s").selectExpr("variant_index", "cast(s % 50000 as int) sample_index", "cast(s % 3 as double) dosage")
    assert assoc.gwas_linear_regression(wide, rng.normal(size=50000), None).where("p_value is not null").count() == 2000


def test_whole_genome_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (40, 50)).astype(float)
    y = x[:10].T @ rng.normal(size=10) + x[30:].T @ rng.normal(size=10)
    v = spark.createDataFrame([(i, "a" if i < 20 else "b", i) for i in range(40)], "variant_index long, contig string, position long")
    base, meta, loco = assoc.regenie(long(spark, x), v, y[:, None], None, variant_block=10, sample_blocks=5)
    assert base.count() == 4 * 5 * 50 and set(loco) == {"a", "b"}
    z = (y - y.mean()) / y.std()
    assert np.corrcoef(meta[:, 0], z)[0, 1] > 0.3
    out = assoc.regenie_loco_regression(long(spark, x), v, y[:, None], None, loco)
    assert out.count() == 40 and out.where("p_value is null").count() == 0
    with pytest.raises(ValueError):
        assoc.regenie_loco_regression(long(spark, x), v, y[:, None], None, {"a": loco["a"]})


def test_whole_genome_regression_of_many_samples(spark):
    """Predictions of 3,000 samples as they come out of the stages one by one."""
    rng = np.random.default_rng(18)
    n = 3000
    x = rng.integers(0, 3, (12, n)).astype(float)
    y = x[:3].T @ rng.normal(size=3) + rng.normal(size=n)
    rows = spark.createDataFrame([(v, list(range(n)), x[v].tolist()) for v in range(12)], "variant_index long, idx array<int>, val array<double>")
    v = spark.createDataFrame([(i, "a" if i < 6 else "b", i) for i in range(12)], "variant_index long, contig string, position long")
    base, meta, loco = assoc.regenie(rows, v, y[:, None], None, variant_block=3, sample_blocks=4)
    assert base.count() == 4 * 5 * n and base.columns == ["contig", "block", "alpha", "sample", "outcome", "value"]
    z = ((y - y.mean()) / y.std())[:, None]
    q = assoc.basis(None, n)
    part = x[:3].T
    pred, _ = assoc._out_of_fold(np.column_stack([q, part - q @ (q.T @ part)]), z, assoc.penalties(12), assoc.folds(n, 4), 1)
    got = base.where("contig = 'a' and block = 0 and alpha = 2").orderBy("sample").toPandas()["value"].to_numpy()
    assert np.allclose(got, pred[2, :, 0]) and np.corrcoef(meta[:, 0], z[:, 0])[0, 1] > 0.5
    assert assoc.regenie_loco_regression(rows, v, y[:, None], None, loco).count() == 12


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (80, 12)).astype(float)
    proj, explained, loadings = assoc.pca(long(spark, x), 12, 3)
    p = x.mean(1) / 2
    z = ((x - x.mean(1, keepdims=True)) / np.sqrt(p * (1 - p))[:, None]).T
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = proj.pivot(index="sample", columns="component", values="value").to_numpy()
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    assert np.allclose(explained["variance"], (u[:, :3] * s[:3]).var(0))
    assert np.allclose(explained["ratio"], (u[:, :3] * s[:3]).var(0) / z.var(0).sum())
    comp = np.array([r.component for r in loadings.orderBy("variant_index").collect()])
    assert np.allclose(np.abs(comp), np.abs(vt[:3].T), atol=1e-6)
    proj2, explained2, loadings2 = assoc.pca(long(spark, x), 12, 3, algorithm="randomized")
    assert np.allclose(proj2["value"], proj["value"], atol=1e-5) and np.allclose(explained2["ratio"], explained["ratio"])
    with pytest.raises(ValueError):
        assoc.pca(long(spark, x).where("not (variant_index = 3 and sample_index = 2)"), 12, 3, missing="error").count()


def test_leading_vectors_of_a_large_matrix():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(900, 300))
    g = x.T @ x
    want, vectors = np.linalg.eigh(g)
    for room in (40_000_000, 300 * 60):
        value, u, trace = assoc.leading(lambda q: (g @ q, np.trace(g)), 300, 4, room=room)
        assert np.allclose(value, want[::-1][:4]) and trace == np.trace(g)
        assert np.allclose(np.abs((u * vectors[:, ::-1][:, :4]).sum(0)), 1, atol=1e-6)
    with pytest.raises(RuntimeError):
        assoc.leading(lambda q: (g @ q, np.trace(g)), 300, 4, most=3)


def test_components_of_many_samples(spark):
    """3,000 samples known in a few variants each, without their Gram matrix."""
    rows = spark.range(400 * 40).selectExpr("id % 400 v", "pmod(xxhash64(id), 3000) s", "pmod(xxhash64(id, 7), 3) d").groupBy("v", "s").agg(F.max("d").alias("d")).selectExpr("v variant_index", "cast(s as int) sample_index", "cast(d as double) dosage")
    proj, _, loadings = assoc.pca(rows, 3000, 2)
    x = np.full((400, 3000), np.nan)
    for r in rows.collect():
        x[r.variant_index, r.sample_index] = r.dosage
    m = np.nanmean(x, 1, keepdims=True)
    z = np.where(np.isnan(x), 0.0, (x - m) / np.sqrt(m / 2 * (1 - m / 2)))
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    got = proj.pivot(index="sample", columns="component", values="value").to_numpy()
    assert np.allclose(np.abs(got), np.abs(vt[:2].T * s[:2]), atol=1e-4) and loadings.count() == 400


def test_pc_relate_and_gene_test(spark):
    rng = np.random.default_rng(6)
    g = rng.integers(0, 2, (300, 8, 2))
    rows = [(v, s, g[v, s].tolist()) for v in range(300) for s in range(8)]
    calls = spark.createDataFrame(rows, "variant_index long, sample_index int, call_genotype array<int>")
    phi = square(rel.pc_relate(calls, rng.normal(size=(8, 1)), 8), 8)
    assert np.allclose(phi, phi.T) and (np.diag(phi) > 0.2).all()
    v = loci(spark, range(20))
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.concatenate([rng.normal(0, 0.01, 15), rng.normal(0, 1, 5)]))], "variant_index long, beta double")
    e = spark.createDataFrame([(i, i + 1, 0.2) for i in range(19)], "i long, j long, value double")
    out = {r.window_index: r for r in assoc.genee(b, e, win.window_by_variant(v, 10)).collect()}
    assert set(out) == {0, 1} and 0 <= out[1].pval <= 1 and out[1].test_q > out[0].test_q
    assert assoc.weighted_chi2_tail(3.841459, np.array([1.0])) == pytest.approx(0.05, rel=1e-4)


def test_stats_and_datasets(spark, tmp_path):
    from karyon import model

    ds = model.simulate_genotype_calls(spark, 20, 6, n_contig=2, seed=1, missing_pct=0.1)
    got = model.variant_stats(ds)
    rows = {r.variant_index: r for r in got["variants"].collect()}
    calls = {}
    for r in ds["calls"].collect():
        calls.setdefault(r.variant_index, []).append(r.call_genotype)
    for v, c in calls.items():
        full = [g for g in c if min(g) >= 0]
        assert rows[v].n_called == len(full) and rows[v].n_het == sum(g[0] != g[1] for g in full)
        assert rows[v].variant_allele_count == [sum(g.count(a) for g in c) for a in (0, 1)]
    with pytest.warns(model.MergeWarning):
        model.variant_stats(got)
    assert model.individual_heterozygosity(ds)["calls"].where("call_heterozygosity > 1").count() == 0
    assert "0/" in model.display_genotypes(ds, 4, 4) or "1/" in model.display_genotypes(ds, 4, 4)
    ds.save(str(tmp_path / "d"))
    back = model.GenoDataset.load(spark, str(tmp_path / "d"), ["variants", "samples", "calls"])
    assert back["calls"].count() == 120
    with pytest.raises(ValueError):
        model.validate(ds["calls"], "call_dosage")
    with pytest.raises(ValueError):
        model.validate(ds["variants"].withColumn("variant_position", F.lit("x")), "variant_position")
    assert model.block_sizes(10, 3) == [4, 3, 3] and model.cohorts([("a", 1)], ["x", "a"]) == [(1, 1)]
    with pytest.raises(ValueError):
        model.cohorts([(1,), (1, 2)])


def test_cohorts_and_partitions(spark):
    calls = spark.createDataFrame([(v, s, [(v + s) % 2, (v * s) % 2]) for v in range(6) for s in range(5)], "variant_index long, sample_index int, call_genotype array<int>")
    samples = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, -1), (4, None)], "sample_index int, sample_cohort int")
    v = spark.range(6).withColumnRenamed("id", "variant_index")
    a = {(r.variant_index, r.cohort): r.cohort_allele_count for r in agg.count_cohort_alleles(calls, samples, 2, variants=v).collect()}
    assert len(a) == 18 and a[0, 1] == [0, 0] and sum(a[1, 0]) == 4
    b = {(r.variant_index, r.cohort): r.cohort_allele_count for r in agg.count_cohort_alleles(calls.repartition(9), samples, 2, variants=v).collect()}
    assert a == b
    with pytest.raises(ValueError):
        agg.count_variant_alleles(calls, 2, "x")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert agg.variant_stats(calls.limit(0), 5, 2).count() == 0


def test_fixed_ploidy_gives_the_same(spark):
    rng = np.random.default_rng(8)
    rows = [(v, s, rng.integers(-1, 3, 3).tolist()) for v in range(30) for s in range(9)]
    calls = spark.createDataFrame(rows, "variant_index long, sample_index int, call_genotype array<int>")
    a, b = (sorted(agg.variant_stats(calls, 9, 3, ploidy=k).collect()) for k in (None, 3))
    assert a == b
    a, b = (sorted(agg.sample_stats(calls, 30, ploidy=k).collect()) for k in (None, 3))
    assert a == b


def test_segments_don_t_change_pruning(spark):
    rng = np.random.default_rng(9)
    pairs = sorted({(int(i), int(i + rng.integers(1, 4)), int(rng.integers(-1, 2))) for i in rng.integers(0, 200, 90)})
    pairs = list({p[:2]: p for p in pairs}.values())
    lost = set()
    for i, j, c in sorted(pairs):
        if i not in lost:
            lost.add(i if c < 0 else j)
    e = spark.createDataFrame(pairs, "i long, j long, cmp int")
    assert {r[0] for r in ld.maximal_independent_set(e).collect()} == lost
    s = ld.segments(e.withColumn("contig", F.lit(0)), bin_size=16).collect()
    want, top, start = {}, -1, None
    for i in sorted({p[0] for p in pairs}):
        if i > top:
            start = i
        want[i] = start
        top = max(top, *[j for a, j, _ in pairs if a == i])
    assert {r.i: r.segment for r in s} == want
