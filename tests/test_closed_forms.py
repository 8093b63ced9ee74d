"""Closed forms and properties that need no tables."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import distributions as D
from plumbline.functions import kernels as K
from plumbline.functions import special
from plumbline.functions.multivariate import MultivariateNormal, NormalInverseWishart
from plumbline.operators import cluster, design, fdiff, gp, kde, mcmc, mixture, optim, poly, quadrature, resample, sobol, stats, svm
from plumbline.plans.components import connected_components
from plumbline.plans.ranks import global_rank
from plumbline.sources import delimited
from plumbline.streaming import moments


@pytest.mark.parametrize("basis", poly.BASES)
def test_gauss_rules_are_exact(basis):
    nodes, weights = quadrature.rule(basis, 5)
    assert math.isclose(weights.sum(), 1)
    for i in range(5):
        for j in range(5):
            p = poly.evaluate_np(basis, 4, nodes)
            want = poly.norm_squared(basis, i) if i == j else 0
            assert abs((weights * p[i] * p[j]).sum() - want) < 1e-8 * max(1, want)


@given(st.integers(2, 59).flatmap(lambda n: st.tuples(st.just(n), st.integers(2, n))))
@settings(max_examples=40, deadline=None)
def test_fold_sizes(nk):
    n, k = nk
    fold = np.minimum(np.arange(n) // (n // k), k - 1)
    assert set(fold) == set(range(k)) and (np.bincount(fold)[:-1] == n // k).all()


def test_global_rank_and_folds(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).cast("int").alias("g"))
    got = global_rank(df, [F.col("v")], "r").toPandas()
    assert (got.r == got.v).all()
    by = global_rank(df, [F.col("v")], "r", by=["g"]).toPandas()
    for _, part in by.groupby("g"):
        assert sorted(part.r) == list(range(len(part)))
        assert part.sort_values("v").r.is_monotonic_increasing
    folds = resample.kfold(got_df := global_rank(df, [F.col("v")], "row_id"), 1000, 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [333, 333, 334]
    assert got_df.count() == 1000


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len({got[i] for i in range(21)}) == 1 and got[100] == got[101] != got[0]
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_designs(spark):
    for make in (design.sobol, design.niederreiter, design.faure):
        x = make(spark, 1024, [0, 0, 0], [1, 1, 1]).toPandas()[["x0", "x1", "x2"]].to_numpy()
        assert x.min() >= 0 and x.max() < 1 and abs(x.mean() - 0.5) < 0.01
        if make is not design.faure:  # each of 1024 cells of each dimension has one point
            assert all(len(set((x[:, k] * 1024).astype(int))) == 1024 for k in range(3))
    s = design.scrambled_sobol(spark, 512, [0, 0], [1, 1], seed=3).toPandas()
    assert len(set((s.x0 * 512).astype(int))) == 512
    h = design.latin_hypercube(spark, 200, [0, 0], [1, 1]).toPandas()
    assert all(sorted((h[c] * 200).astype(int)) == list(range(200)) for c in ("x0", "x1"))
    assert design.linspaced(spark, 10, [0, 0], [1, 1]).count() == 16
    more = design.sobol(spark, 4, [0], [1], skip=4).toPandas()
    assert sorted(more.x0) == sorted(design.sobol(spark, 8, [0], [1]).toPandas().x0[4:])


def test_special_functions():
    assert abs(special.normal_quantile(0.975) - 1.959963984540054) < 1e-9
    assert abs(special.gamma_cdf(1.0, 2.0)[0] - (1 - math.exp(-2))) < 1e-12
    assert abs(special.beta_cdf(2, 2, 0.3)[0] - (3 * 0.09 - 2 * 0.027)) < 1e-12
    assert abs(special.student_cdf(1.0, 1.0)[0] - 0.75) < 1e-10
    assert abs(special.bessel_k(0.5, np.array([2.0]))[0] - math.sqrt(math.pi / 4) * math.exp(-2)) < 1e-10


@pytest.mark.parametrize("dist,at", [(D.Normal(1, 2), 1.7), (D.Gamma(2.5, 0.7), 1.3), (D.InverseGamma(3, 2), 0.8), (D.Beta(2, 3), 0.4), (D.LogNormal(0.2, 0.7), 1.4), (D.Student(5, 1, 2), 2.5), (D.Pareto(2.5, 1.5), 2.2), (D.SmoothUniform(0, 1, 0.2), 0.9)])
def test_derivatives_and_cdf(spark, dist, at):
    h = 1e-3
    df = spark.createDataFrame([(at - h,), (at,), (at + h,)], "x double").coalesce(1)
    rows = df.select(dist.log_pdf(F.col("x")).alias("l"), dist.d_log_pdf(F.col("x")).alias("d"), dist.dd_log_pdf(F.col("x")).alias("dd")).collect()
    assert abs((rows[2].l - rows[0].l) / (2 * h) - rows[1].d) < 2e-3
    assert abs((rows[2].d - rows[0].d) / (2 * h) - rows[1].dd) < 2e-3
    slope = (dist.cdf_np(np.array([at + h])) - dist.cdf_np(np.array([at - h]))) / (2 * h)
    assert abs(float(slope[0]) - math.exp(rows[1].l)) < 1e-4
    assert abs(float(dist.quantile_np(dist.cdf_np(np.array([at])))[0]) - at) < 1e-6


def test_kernel_derivatives():
    r = np.random.default_rng(0)
    x, theta, h = r.random((4, 2)), np.array([1.3, 0.7]), 1e-5
    for k in (K.SquaredExponential(1), K.Matern52(1), K.Matern(1, 1.5), K.Matern(1, 0.8), K.Constant(0) * K.SquaredExponential(1) + K.WhiteNoise()):
        for i in range(2):
            e = np.eye(2)[i] * h
            up, down = k.matrix(x, x, theta + e), k.matrix(x, x, theta - e)
            assert np.allclose(k.gradient(x, x, theta, i), (up - down) / (2 * h), atol=1e-5)
            for j in range(2):
                e = np.eye(2)[j] * h
                slope = (k.gradient(x, x, theta + e, i) - k.gradient(x, x, theta - e, i)) / (2 * h)
                assert np.allclose(k.hessian(x, x, theta, i, j), slope, atol=1e-3)


def test_density_kernels_integrate_to_one(spark):
    data = spark.createDataFrame([(0, [0.3])], "id long, x array<double>")
    grid = spark.range(2000).select("id", F.array((F.col("id") - 999.5) / 200).alias("x"))
    for name in K.DENSITY:
        total = kde.density(data, grid, K.Bandwidth.of(0.5, 1), name).agg(F.sum("density")).first()[0] / 200
        assert abs(total - 1) < 5e-3


def test_ishigami_chaos_and_saltelli(spark):
    a, b = 1.0, 0.01
    f = lambda x, y, z: F.sin(x) + a * F.sin(y) ** 2 + b * z**4 * F.sin(x)
    pi = math.pi
    grid = design.latin_hypercube(spark, 1000, [-pi] * 3, [pi] * 3)
    rows = grid.withColumn("y", f(F.col("x0"), F.col("x1"), F.col("x2")))
    m = poly.PolynomialExpansion("legendre", (-pi,) * 3, (pi,) * 3, 6).fit(rows, ["x0", "x1", "x2"], "y")
    s = m.sobol_main()
    assert abs(s[0] - 0.818073) < 5e-3 and abs(s[1] - 0.143261) < 5e-3
    loo = m.predict_loo(rows, ["x0", "x1", "x2"], "y").where("row_id = 3").first()
    again = m.fit(rows.where("row_id <> 3"), ["x0", "x1", "x2"], "y")
    assert abs(again.predict(rows.where("row_id = 3"), ["x0", "x1", "x2"]).first()["mean"] - loo.loo_mean) < 1e-6
    part = rows.where("row_id = 3").first()
    updated = again.with_observation([part.x0, part.x1, part.x2], part.y)
    assert np.allclose(updated.coefficients, m.coefficients, atol=1e-8)
    both = design.scrambled_sobol(spark, 1024, [-pi] * 6, [pi] * 6)
    left = both.select("row_id", "x0", "x1", "x2")
    right = both.select("row_id", F.col("x3").alias("x0"), F.col("x4").alias("x1"), F.col("x5").alias("x2"))
    y = sobol.evaluation_grid(left, right, 3).withColumn("y", F.sin("x0") + F.sin("x1") ** 2 + 0.1 * F.col("x2") ** 4 * F.sin("x0"))
    got = {(r.kind, r.i): r.value for r in sobol.indices(sobol.centred(sobol.pivoted(y, 3), 3), 3).collect()}
    assert abs(got["total", 2] - 0.430067) < 0.06 and abs(got["first", 0] - 0.553998) < 0.06


def test_finite_differences():
    for order in fdiff.ORDERS:
        assert abs(fdiff.gradient_np(lambda x: x[0] ** 2 * x[1], [3.0, 2.0], 0, order, 1e-3) - 12) < 1e-5
        assert abs(fdiff.hessian_np(lambda x: x[0] ** 2 * x[1], [3.0, 2.0], 0, 1, order, 1e-2) - 6) < 1e-5


def test_optimisers():
    rosenbrock = optim.Objective(lambda x: -((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2))
    for method in ("nelder_mead", "bfgs"):
        x, _ = optim.maximise(rosenbrock, [-1.2, 1.0], [-5, -5], [5, 5], method)
        assert np.allclose(x, 1, atol=1e-3)
    circle = optim.Objective(lambda x: -math.exp(x[0]) * x[1] ** 2, equalities=[lambda x: x[0] ** 2 + x[1] ** 2 - 1])
    x, _ = optim.maximise(circle, [0.0, 1.0], [-2, -2], [2, 2], "nelder_mead")
    assert abs(x[0] ** 2 + x[1] ** 2 - 1) < 1e-4
    x, _ = optim.maximise(optim.Objective(lambda x: -(math.log(x[0]) - 2) ** 2, log_scale=(0,)), [1.0], [1e-3], [1e3])
    assert abs(math.log(x[0]) - 2) < 1e-3


def test_gaussian_process(spark):
    x = np.linspace(0.05, 0.95, 10)[:, None]
    y = np.sin(2 * np.pi * x[:, 0]) + 1
    m = gp.GaussianProcess(K.Constant(0) * K.SquaredExponential(1), np.array([1.0, 0.2]), nugget=1e-4).condition(x, y)
    theta = np.array([1.0, 0.2])
    for method in ("mle", "loo", "loo_mse"):
        g = m.gradient(theta, method)
        for i in range(2):
            e = np.eye(2)[i] * 1e-5
            slope = (m.objective(theta + e, method) - m.objective(theta - e, method)) / 2e-5
            assert abs(g[i] - slope) < 1e-3 * max(1, abs(slope)), method
    m = gp.GaussianProcess(m.kernel, theta, nugget=1e-4).condition(x, y)
    mean, var = m.loo()
    rest = gp.GaussianProcess(m.kernel, m.theta, nugget=1e-4).condition(x[1:], y[1:])
    pm, pv = rest.predict_np(x[:1])
    assert abs(mean[0] - pm[0]) < 1e-6 and abs(var[0] - pv[0]) < 1e-6
    fitted = gp.GaussianProcess(m.kernel, np.array([1.0, 0.5]), nugget=1e-4).fit(x, y, [0.05, 0.05], [10, 3])
    test = np.linspace(0.1, 0.9, 50)[:, None]
    assert np.abs(fitted.predict_mean_np(test) - np.sin(2 * np.pi * test[:, 0]) - 1).max() < 0.05
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(test[:, 0])], "i long, x array<double>")
    got = fitted.predict(df, "x").orderBy("i").toPandas()
    assert np.allclose(got["mean"], fitted.predict_np(test)[0])
    assert fitted.expected_variance_improvement([0.5], np.zeros((0, 1))) > 0


def test_svm_separates_spirals():
    r = np.random.default_rng(1)
    x, y = [], []
    for k in range(3):
        t = np.linspace(0.3, 1, 40)
        a = 2.5 * t + 2 * np.pi * k / 3
        x.append(np.column_stack([t * np.cos(a), t * np.sin(a)]) + 0.01 * r.standard_normal((40, 2)))
        y += [k] * 40
    x, y = np.concatenate(x), np.array(y)
    m = svm.SVM(K.SquaredExponential(0), np.array([0.2]), 10.0).condition(x, y)
    assert (m.predict_np(x) == y).mean() > 0.95
    p = m.probabilities_np(x)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.9
    assert np.isfinite(m.span_objective())


def test_samplers():
    r = np.random.default_rng(3)
    xs, _, rate = mcmc.adaptive_metropolis(lambda x: -0.5 * float(x @ x), [3.0, -3.0], np.eye(2), 6000, r, burn=2000, thin=2)
    assert np.abs(xs.mean(0)).max() < 0.15 and np.abs(np.cov(xs.T) - np.eye(2)).max() < 0.2 and 0.1 < rate < 0.5
    xs, _, _ = mcmc.adaptive_metropolis(lambda x: -0.5 * float(x @ x), [0.0], np.eye(1), 6000, r, burn=1000, delayed=True)
    assert abs(xs.var() - 1) < 0.2
    xs, _ = mcmc.evolutionary(lambda x: -0.5 * float(x @ x), r.standard_normal((8, 1)) * 3, 3000, r)
    assert abs(xs[500:].var() - 1) < 0.2
    xs, _, _ = mcmc.nuts(lambda x: -0.5 * float(x @ x), lambda x: -x, [2.0, 2.0], 2000, r, warm=500)
    assert np.abs(xs.mean(0)).max() < 0.15 and np.abs(np.cov(xs.T) - np.eye(2)).max() < 0.2


def test_clusters(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 0.2, (40, 2)), r.normal(3, 0.2, (40, 2))])
    df = spark.createDataFrame([(i, float(a), float(b), [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, a double, b double, x array<double>")
    c, done = cluster.kmeans(df, ["a", "b"], 2, "id")
    assert done and sorted(round(v) for v in c[:, 0]) == [0, 3]
    prior = NormalInverseWishart.empirical(x.mean(0), np.cov(x.T) * 0.1)
    got = cluster.dpmm(df, "id", "x", 1, 15, prior).toPandas().sort_values("id")
    top = got.label.value_counts().index[:2]
    assert set(got.label[:40].mode()) != set(got.label[40:].mode()) and got.label.isin(top).mean() > 0.8


def test_mixture_moves(spark):
    scores = spark.createDataFrame([(0, 0, -1.0), (0, 1, -3.0), (1, 0, -5.0), (1, 1, -1.0)], "id long, label int, log_score double")
    p = {(r.id, r.label): r.probability for r in mixture.probabilities(scores, 2.0).collect()}
    assert abs(p[0, 0] - 1 / (1 + math.exp(-1))) < 1e-12
    now = spark.createDataFrame([(0, 0), (1, 0)], "id long, label int")
    assert [tuple(r) for r in mixture.deterministic_switches(scores, now, 5).collect()] == [(1, 1, 4.0)]
    drawn = mixture.stochastic_switches(mixture.probabilities(scores).withColumn("u", F.lit(0.5)), "u").orderBy("id").collect()
    assert [r.label for r in drawn] == [0, 1]
    models = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 3.0, 4.0)], "id long, label int, mean double, variance double")
    half = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.75)], "id long, label int, probability double")
    r = mixture.blend(models, half).first()
    assert r["mean"] == 2.5 and abs(r.variance - (0.0625 * 2 + 0.5625 * 4)) < 1e-12
    merged = mixture.merge(spark.createDataFrame([(0,), (1,), (2,)], "label int"), "label", 0, 1).collect()
    assert [r.new_label for r in merged] == [0, 0, 1]


def test_mvn_derivative():
    cov, d = np.array([[2.0, 0.3], [0.3, 1.0]]), np.array([[1.0, 0.2], [0.2, 0.5]])
    r, h = np.array([0.5, -1.0]), 1e-5
    log = lambda c: -0.5 * r @ np.linalg.solve(c, r) - 0.5 * math.log(np.linalg.det(c))
    assert abs(MultivariateNormal.d_log_pdf(r, cov, d) - (log(cov + h * d) - log(cov - h * d)) / (2 * h)) < 1e-6
    slope = (MultivariateNormal.d_log_pdf(r, cov + h * d, d) - MultivariateNormal.d_log_pdf(r, cov - h * d, d)) / (2 * h)
    assert abs(MultivariateNormal.dd_log_pdf(r, cov, d, d, 0 * d) - slope) < 1e-5


def test_expansion_round_trip(spark, tmp_path):
    m = poly.PolynomialExpansion("hermite", (0.0,), (1.0,), 2, 1.0, (1.0, 2.0, 3.0), ((1.0, 0.0, 0.0),) * 3, 0.5)
    m.save(spark, str(tmp_path / "m"))
    assert poly.PolynomialExpansion.load(spark, str(tmp_path / "m")) == m


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("head\n# note\n1, 2\n\n3,4\nbad,1\n5,6\n")
    strict = delimited.read(spark, str(tmp_path / "a.csv"), header=1).orderBy("line_no").collect()
    assert [r.x for r in strict] == [[1, 2], [3, 4]]
    assert delimited.read(spark, str(tmp_path / "a.csv"), header=1, strict=False).count() == 3
    delimited.write(spark.createDataFrame([([1.5, 2.0], [3.0])], "x array<double>, y array<double>"), str(tmp_path / "out"), y="y")
    assert delimited.read(spark, str(tmp_path / "out")).first().x == [1.5, 2.0, 3.0]


def test_streamed_moments(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 01:20:00", "a", 5.0)], "t string, k string, v double").withColumn("ts", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = moments.windowed_moments(stream, "ts", "k", "v").writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("moments").orderBy("window_start").collect()
    assert [(r.n, r.mean) for r in got] == [(2, 2.0), (1, 5.0)]
    a = spark.createDataFrame([("a", 2, 2.0, 2.0)], "key string, n long, mean double, m2 double")
    b = spark.createDataFrame([("a", 1, 5.0, 0.0)], "key string, n long, mean double, m2 double")
    r = moments.merge(a, b, ["key"]).first()
    assert (r.n, r["mean"], r.m2) == (3, 3.0, 8.0)


def test_quantiles_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 2.0, 2.0, 10.0, None)], "v double")
    got = {r.q: r.value for r in stats.quantiles(df, "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 0.9: pytest.approx(6.8), 1.0: 10.0}
