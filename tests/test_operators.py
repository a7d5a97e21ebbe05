import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitlake.functions import physics as P
from orbitlake.operators import fits, pairs, series, tables, transport, vibration
from orbitlake.operators import kirkwood_buff as kb

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    f = F.lit("Fe2BFe")
    n, x, label = one(spark, P.element_counts(f), P.mole_fraction(f, "B"), P.subscript_label(f))
    assert n == {"Fe": 3, "B": 1} and x == 0.25 and label == "Fe_{2}BFe"
    assert one(spark, P.min_image(F.lit(5.0), F.lit(10.0)))[0] == 5.0  # halves to even
    assert one(spark, P.min_image(F.lit(15.0), F.lit(10.0)))[0] == -5.0
    assert one(spark, P.mixing_entropy_term(F.lit(0.0), F.lit(1500.0)), P.mixing_entropy_term(F.lit(1.0), F.lit(1500.0)))[:] == (0.0, 0.0)
    assert one(spark, P.timestep_fs(F.lit(0.001), F.lit("metal")))[0] == pytest.approx(1.0)
    with pytest.raises(Exception, match="unknown units"):
        one(spark, P.timestep_fs(F.lit(1.0), F.lit("nano")))
    assert one(spark, P.density(F.lit(1.0), F.lit(0.0)))[0] is None
    assert one(spark, P.number_or_na(F.lit(float("nan"))))[0] == "N/A"
    assert one(spark, P.type_label_map(F.lit("1:Na,2=O")))[0] == {"1": "Na", "2": "O"}
    assert one(spark, P.type_label_map(F.lit(" 1 : Na , 2=O, ")))[0] == {"1": "Na", "2": "O"}
    assert one(spark, P.window_weight(F.lit(2.0), F.lit(2.0)), P.window_weight(F.lit(0.0), F.lit(2.0)))[:] == (0.0, 1.0)
    scc = one(spark, P.concentration_structure(F.lit(0.6), F.lit(0.0), F.lit(0.4), F.lit(0.6), F.lit(1.0)))[0]
    assert scc == pytest.approx(0.24)  # ideal mixture: x_Fe x_B


def test_shipped_invariant(spark):
    gamma = one(spark, P.excess_curvature(F.lit(2.5), F.lit(0.3)))[0]
    assert gamma == pytest.approx(1.5 / 0.21)


@QUICK
@given(st.lists(st.floats(-100, 100), min_size=0, max_size=45), st.integers(0, 5), st.integers(1, 10))
def test_block_average(spark, values, skip, block):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, None)], "g string, i int, v double")
    got = series.block_average(df, ["g"], ["i"], "v", skip, block).collect()
    x = np.array(values[skip:])
    if not len(x):
        assert not got
        return
    means = x[: len(x) // block * block].reshape(-1, block).mean(1)
    assert got[0]["mean"] == pytest.approx(x.mean(), abs=1e-9) and got[0]["n"] == len(x) and got[0]["n_blocks"] == len(means)
    if len(means) < 2:
        assert got[0]["err"] is None
    else:
        assert got[0]["err"] == pytest.approx(means.std(ddof=1) / math.sqrt(len(means)), abs=1e-9)


def test_nearest_frames(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(101)] + [(2, 0, 0.0)], "run int, f int, t double")
    got = series.nearest_frames(df, ["run"], "f", "t", 10, 5.0).collect()
    assert sorted(r.frame for r in got) == list(range(55, 101, 5))


def test_segments_and_transitions(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 0.0, -1.0, -2.0, 3.0])], "g int, i int, v double")
    assert sorted((r["first"], r["last"], r["sign"]) for r in series.sign_segments(df, ["g"], "i", "v").collect()) == [(0, 1, 1), (2, 2, 0), (3, 4, -1), (5, 5, 1)]
    t = spark.createDataFrame([(1, i, c) for i, c in enumerate("AABBA")], "g int, i int, c string")
    assert [r.type_id for r in series.transitions(t, ["g"], ["i"], "c").orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_ideal_gas_and_bonds(spark):
    rng = np.random.default_rng(0)
    pos = rng.uniform(0, 6, size=(5, 60, 3))
    rows = [(f, i, i % 2, *map(float, pos[f, i]), 6.0, 6.0, 6.0) for f in range(5) for i in range(60)]
    a = spark.createDataFrame(rows, "frame int, atom_id int, species int, x double, y double, z double, lx double, ly double, lz double")
    g = [r.g for r in pairs.rdf_exact(a, 0.5, 3.0, "total").orderBy("bin").collect()]
    assert np.mean(g[2:]) == pytest.approx(1, abs=0.1)
    want = sum(r.dist <= 1.1 for r in pairs.pair_distances(a).collect())
    edges = pairs.bonds(a, 1.1)
    assert edges.count() == want
    assert pairs.coordination(a, edges).agg(F.sum("cn")).first()[0] == 2 * want
    both = pairs.rdf_exact(a, 0.5, 3.0, "pair", (0, 1)).select("species_a", "species_b").distinct().collect()
    assert [(r[0], r[1]) for r in both] == [(0, 1)]


def test_last_bin_holds_its_edge():
    assert pairs._binned(np.array([0.0, 1.0, 2.0, 2.1]), 1.0, 2).tolist() == [0, 1, 1, -1]


def test_kbi_limit(spark):
    r = np.arange(100) * 0.05 + 0.025
    g = 1 + np.exp(-r) * np.cos(3 * r)
    df = spark.createDataFrame([("AA", float(x), float(y)) for x, y in zip(r, g)], "pair string, r double, g double")
    k = spark.createDataFrame([(0.0,), (1.0,)], "k double")
    plain = kb.integrate_pair(df, 0.05, 4.0).first()
    assert kb.sinc_plateau(df, k, 0.05, 4.0).filter("k = 0").first().g_k == pytest.approx(plain.g_kv)
    w = 1 - 1.5 * np.clip(r / 4, 0, 1) + 0.5 * np.clip(r / 4, 0, 1) ** 3
    i = 4 * np.pi * r**2 * (g - 1) * w
    run = np.cumsum(i) * 0.05 - 0.025 * (i[0] + i)
    assert plain.g_kv == pytest.approx(run[(r >= 3.2) & (r <= 4.0)].mean())


def test_vibrational_identities(spark):
    e = np.linspace(0.001, 0.2, 400)
    g = np.exp(-(((e - 0.05) / 0.01) ** 2))
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(e, g)], "run int, e_ev double, vdos double")
    r = vibration.vibrational_thermo(df, 1000.0).first()
    assert r.f_ev == pytest.approx(r.f_via_sinh_ev) and abs(r.consistency) < 1e-12
    with pytest.raises(ValueError):
        vibration.vibrational_thermo(df, 0.0)


def test_fits(spark):
    x = np.linspace(0.1, 0.9, 11)
    p = [2.0, -3.6, 1.0, 0.5]
    df = spark.createDataFrame([("a", float(v), float(np.polyval(p, v))) for v in x], "g string, x double, y double")
    f = fits.polynomial_fit(df, ["g"], "x", "y", 3)
    assert np.allclose(f.first().coefficients, p)
    assert fits.inflection(f, ["g"]).first().x_inflection == pytest.approx(0.6)
    k = np.linspace(0.1, 0.75, 20)
    s = spark.createDataFrame([(1, float(v), float(0.3 / (1 + 2.5 * v * v))) for v in k], "g int, k double, scc double")
    r = fits.oz_fit(s, ["g"]).first()
    assert (r.a, r.b) == (pytest.approx(0.3, rel=1e-6), pytest.approx(2.5, rel=1e-5))
    assert fits.oz_fit(s.limit(2), ["g"]).first().a is None
    curve = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (2, 1.0, 1.0)], "g int, x double, y double")
    got = {r.g: (r.slope, r.r2) for r in transport.slope_fit(curve, ["g"], "x", "y").collect()}
    assert got[1] == (0.0, None) and got[2] == (None, None)


def test_joins_that_must_match(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="no partner"):
        tables.strict_join(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="unknown key"):
        tables.dimension(left, right, "k", "v").collect()


def test_parity_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0), (None, 1.0), (float("nan"), 1.0)], "t double, p double")
    r = tables.parity(df, "t", "p").first()
    assert (r.rmse, r.mae, r.n) == (pytest.approx(math.sqrt(2.5)), 1.5, 2)


def test_panel_guides_regions_and_endpoints(spark):
    x = np.linspace(0.1, 0.9, 9)
    rows = [(t, float(v), float((v - c) ** 3)) for t, c in ((1500, 0.53), (1800, 0.62)) for v in x]
    df = spark.createDataFrame(rows, "t int, x double, y double")
    got = {r.t: r for r in fits.panel(df, ["t"], "x", "y").collect()}
    for t, c in ((1500, 0.53), (1800, 0.62)):
        assert got[t].x_inflection == pytest.approx(c, abs=1e-5) and got[t].baseline == pytest.approx((0.1 - c) ** 3 - 0.01) and got[t].ymax == pytest.approx((0.9 - c) ** 3)
    fit = fits.polynomial_fit(df, ["t"], "x", "y")
    assert {(r.t, round(r.x, 6)): r.y for r in fits.guide_values(fit).collect()}[1500, 0.25] == pytest.approx(-(0.28**3))
    cut = fits.regions(fits.evaluate(fit, 0.1, 0.9, 9), fits.inflection(fit, ["t"]), ["t"], single=F.col("t") == 1800)
    assert {(r.t, r.region): r["count"] for r in cut.groupBy("t", "region").count().collect()} == {(1500, "convex"): 5, (1500, "concave"): 4, (1800, "convex"): 9}
    table = spark.createDataFrame([(float(v), 100, float(100 * (v * v - (1 - v) * 14.2 - v * 7.1)), float(v * v)) for v in x], "x double, n int, raw double, norm double")
    ends = fits.endpoints(table.withColumn("k", F.lit(1)), ["k"], "raw", "n", "x", "norm").first()
    assert (ends.e_a, ends.e_b) == (pytest.approx(-14.2), pytest.approx(-7.1))


def test_self_correlations_with_gaps_and_strided_origins(spark):
    rng = np.random.default_rng(37)
    rows = [(run, t, a, "AB"[a % 2], *map(float, 50 + np.cumsum(rng.normal(size=3)))) for run in "xy" for a in range(5) for t in range(24) if (t * 7 + a) % 11]
    atoms = spark.createDataFrame(rows, "run string, frame_idx int, atom_id int, species string, xu double, yu double, zu double").repartition(3)
    lags = spark.createDataFrame([(run, lag) for run in "xy" for lag in (1, 2, 5, 23)], "run string, lag int")
    for stride in (1, 3):
        got = {(r.run, r.lag, r.species): r.c for r in transport.self_correlations(atoms, lags, stride).collect()}
        want = {}
        for run in "xy":
            for lag in (1, 2, 5, 23):
                for s in "AB":
                    at = {(t, a): np.array(p) for r, t, a, q, *p in rows if r == run and q == s}
                    sums = [((at[t + lag, a] - at[t, a]) ** 2).sum() for t, a in at if t % stride == 0 and (t + lag, a) in at]
                    held = {t for t, _ in at}
                    n = sum(t % stride == 0 and t + lag in held for t in held)
                    if n:
                        want[run, lag, s] = sum(sums) / n
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_oz_fit_against_a_dense_grid(spark):
    rng = np.random.default_rng(16)
    k = np.linspace(0.05, 0.75, 12)
    s = 0.7 / (1 + 2.3 * k * k) * (1 + 0.02 * rng.normal(size=12))
    r = fits.oz_fit(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(k, s)], "g int, k double, scc double"), ["g"]).first()
    cost = lambda a, b: ((a / (1 + b * k * k) - s) ** 2).sum()
    dense = min(cost(a, b) for a in np.linspace(0.6, 0.8, 201) for b in np.linspace(1.5, 3.5, 401))
    assert cost(r.a, r.b) <= dense + 1e-12
