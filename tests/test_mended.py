"""Values at the edges, in the tails and for unequal sizes, against plain formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import distributions as D
from plumbline.functions.kernels import Bandwidth, Constant, SquaredExponential
from plumbline.operators import distance, kde, mixture, sobol, stats, svm
from plumbline.operators.gp import GaussianProcess
from plumbline.plans.ranks import global_rank


def test_smooth_uniform_far_out(spark):
    su = D.SmoothUniform(0.0, 100.0, 30.0)
    xs = [-400.0, -50.0, 0.0, 20.0, 50.0, 99.0, 150.0, 250.0, 350.0, 1000.0]

    def log_pdf(x):
        a, b = (abs(x - 50) + 50) / 30, (abs(x - 50) - 50) / 30
        if b < 0:
            return math.log(0.5 * (math.erf(a / math.sqrt(2)) - math.erf(b / math.sqrt(2)))) - math.log(100)
        t = np.linspace(b, a, 400_001)
        w = np.exp(-(t * t - b * b) / 2)
        area = (w.sum() - (w[0] + w[-1]) / 2) * (t[1] - t[0])
        return math.log(area) - b * b / 2 - D.LOG_2PI / 2 - math.log(100)

    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", su.log_pdf(F.col("x")).alias("l"), su.d_log_pdf(F.col("x")).alias("d"), su.dd_log_pdf(F.col("x")).alias("dd")).collect()
    for r in got:
        assert abs(r.l - log_pdf(r.x)) < 1e-5 * max(1, abs(r.l))
        assert abs(r.d - (log_pdf(r.x + 0.5) - log_pdf(r.x - 0.5))) < 2e-4
        assert abs(r.dd - (log_pdf(r.x + 0.5) - 2 * log_pdf(r.x) + log_pdf(r.x - 0.5)) * 4) < 2e-3


def test_quantiles_far_out():
    for dist, p, want, close in ((D.Student(5.0, 2e6, 10.0), 0.5, 2e6, 1e-6), (D.SmoothUniform(0.0, 5e6, 1.0), 0.5, 2.5e6, 1e-6), (D.InverseGamma(0.5, 1.0), 0.9999, 1.2732e8, 1e-3)):
        assert abs(float(dist.quantile_np(np.array([p]))[0]) / want - 1) < close
    g = D.Gamma(2.0, 1.0)
    got = g.quantile_np(np.array([0.0, 0.3, 1.0, np.nan]))
    assert got[0] == 0 and np.isinf(got[2]) and np.isnan(got[3]) and abs(g.cdf_np(got[1:2])[0] - 0.3) < 1e-12


@pytest.mark.parametrize("dist", [D.Gamma(2.5, 0.1), D.InverseGamma(3.0, 2.0), D.Beta(2.0, 3.5), D.LogNormal(1.0, 2.0), D.Pareto(2.5, 1.0)], ids=lambda d: type(d).__name__)
def test_derivatives_outside_the_support_are_zero(spark, dist):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,)], "x double")
    for r in df.select(dist.log_pdf(F.col("x")).alias("l"), dist.d_log_pdf(F.col("x")).alias("a"), dist.dd_log_pdf(F.col("x")).alias("b")).collect()[:2]:
        assert (r.l, r.a, r.b) == (-math.inf, 0.0, 0.0)


def test_sampling_has_the_distribution(spark):
    for dist in (D.Gamma(2.5, 0.05), D.Student(5.0, 3.0, 2.0), D.Pareto(2.5, 2.0), D.SmoothUniform(0.0, 10.0, 1.0)):
        x = np.sort([r.x for r in dist.sample(spark, 4000).collect()])
        assert np.abs(dist.cdf_np(x) - (np.arange(4000) + 0.5) / 4000).max() < 0.035


def one_d(a, b, p):
    """By the quantile functions on a grid that holds all steps."""
    n, m = len(a), len(b)
    at = (np.arange(n * m) + 0.5) / (n * m)
    return np.mean(np.abs(np.sort(a)[(at * n).astype(int)] - np.sort(b)[(at * m).astype(int)]) ** p)


def test_wasserstein_of_unequal_sizes(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=(23, 3)), 1), np.round(rng.normal(1, 2, size=(10, 3)), 1)  # ties
    u = rng.normal(size=(4, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    frame = lambda v: spark.createDataFrame([(x.tolist(),) for x in v], "x array<double>").repartition(3)
    directions = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "k long, u array<double>")
    got = distance.sliced_wasserstein(frame(a), frame(b), "x", directions, 3).first().w * distance.sphere_area(3)
    assert abs(got - np.mean([one_d(a @ v, b @ v, 2) for v in u])) < 1e-9
    line = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    assert abs(distance.wasserstein_1d(line(a[:, 0]), line(b[:, 0]), "x", 1).first().w - one_d(a[:, 0], b[:, 0], 1)) < 1e-9


def test_variance_improvement_is_what_an_observation_takes_off():
    rng = np.random.default_rng(2)
    kernel = Constant(0) * SquaredExponential(1)
    x, c, pending = rng.uniform(size=(7, 2)), rng.uniform(size=(4, 2)), rng.uniform(size=(2, 2))
    theta, nu = np.array([1.3, 0.4]), 0.05

    def variance(points, seen):
        k = kernel.matrix(x, x, theta) + 1e-8 * np.eye(len(x))
        if len(seen):
            every = np.vstack([x, seen])
            noise = np.concatenate([np.full(len(x), 1e-8), np.full(len(seen), nu)])
            k, at = kernel.matrix(every, every, theta) + np.diag(noise), every
        else:
            at = x
        ks = kernel.matrix(points, at, theta)
        return np.diag(kernel.matrix(points, points, theta) - ks @ np.linalg.solve(k, ks.T))

    gp = GaussianProcess(kernel, theta).condition(x, rng.normal(size=7))
    for before in (np.zeros((0, 2)), pending):
        got = gp.expected_variance_improvement(c, before, nu)
        want = np.stack([variance(c, before) - variance(c, np.vstack([before, s[None]])) for s in c])
        assert np.allclose(got, want, atol=1e-6)


def test_gp_fit_uses_gradients_with_a_prior():
    rng = np.random.default_rng(1)
    x = np.linspace(0, 1, 12)[:, None]
    y = np.sin(6 * x[:, 0]) + 0.01 * rng.normal(size=12)
    log_prior = lambda t: float(-0.5 * ((np.log(t) - np.log(0.5)) ** 2).sum())
    slope = lambda t: -(np.log(t) - np.log(0.5)) / t
    low, high = np.array([0.05, 0.05]), np.array([10.0, 5.0])
    make = lambda: GaussianProcess(Constant(0) * SquaredExponential(1), np.array([1.0, 0.3]), nugget=1e-4)
    plain, steep = make().fit(x, y, low, high, log_prior=log_prior), make().fit(x, y, low, high, log_prior=log_prior, d_log_prior=slope)
    value = lambda g: g.objective(g.theta, "mle", log_prior)
    assert abs(value(plain) - value(steep)) < 1e-2


def test_quantiles_of_few_values(spark):
    values = [1.0] * 50 + [2.0] * 30 + [7.5] * 20 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.495, 0.7999, 1.0]
    got = {r.q: r.value for r in stats.quantiles(df, "x", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.quantile([v for v in values if v is not None], p)) < 1e-12
    assert stats.quantiles(df.limit(0), "x", probs).count() == 0


def test_ranks_split_a_value_that_all_rows_share(spark):
    df = spark.range(4000).withColumn("v", F.lit(1.0))
    ranked = global_rank(df, [F.col("v")], "r")
    assert sorted(r.r for r in ranked.select("r").collect()) == list(range(4000))


def test_sobol_blocks_side_by_side(spark):
    rng = np.random.default_rng(0)
    a, b = (spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.uniform(size=(30, 2)))], "row_id long, x0 double, x1 double") for _ in range(2))
    model = lambda x, y: x * x + 3 * y
    grid = sobol.pivoted(sobol.evaluation_grid(a, b, 2, True).withColumn("y", model(F.col("x0"), F.col("x1"))), 2, "y", True)
    side = sobol.evaluated(a, b, 2, model, True)
    assert sorted(map(tuple, grid.select(side.columns).collect())) == sorted(map(tuple, side.collect()))


def test_purge_goes_to_the_nearest_centroid(spark):
    rows = [(0, 0, 0.0), (1, 0, 1.0), (2, 5, 10.0), (3, 5, 11.0), (4, 2, 9.0), (5, 7, 0.2)]
    df = spark.createDataFrame(rows, "id long, label int, x double")
    got = {r.id: r.new_label for r in mixture.purge(df, "label", ["x"], 2).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    assert all(r.new_label is None for r in mixture.purge(df, "label", ["x"], 9).collect())


def moons(n=90, classes=3):
    rng = np.random.default_rng(4)
    y = np.arange(n) % classes
    return rng.normal(size=(n, 2)) * 0.6 + np.stack([np.cos(2.1 * y), np.sin(2.1 * y)], 1) * 1.2, y


def test_kernel_classifier_scores(spark):
    x, y = moons()
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, x array<double>, label int")
    candidates = [Bandwidth.of(s, 2) for s in (0.2, 0.7)]

    def brute(h, train, test, own):
        d2 = ((x[test][:, None] - x[train][None]) ** 2).sum(-1) / h**2
        v = np.exp(-d2 / 2)
        if own:
            v[np.array(test)[:, None] == np.array(train)[None]] = 0
        p = np.zeros((len(test), 3))
        for c in range(3):
            n = (y[train] == c).sum() - (own * (y[test] == c))
            p[:, c] = v[:, y[train] == c].sum(1) / n
        q = p[np.arange(len(test)), y[test]] / p.sum(1)
        return np.log(q + 1e-12).mean(), (p.argmax(1) == y[test]).mean()

    rows = list(range(90))
    loo = {r.candidate: r.score for r in kde.classifier_scores(df, candidates, None).collect()}
    for k, h in enumerate((0.2, 0.7)):
        assert abs(loo[k] - brute(h, rows, rows, 1)[0]) < 1e-9
    for metric, at in (("log", 0), ("accuracy", 1)):
        got = {r.candidate: r.score for r in kde.classifier_scores(df, candidates, 3, metric).collect()}
        for k, h in enumerate((0.2, 0.7)):
            folds = [list(range(30 * f, 30 * f + 30)) for f in range(3)]
            assert abs(got[k] - np.mean([brute(h, [i for i in rows if i not in f], f, 0)[at] for f in folds])) < 1e-9
    best = kde.fit_classifier(df, Bandwidth.of(3.0, 2), rounds=3)
    after = kde.classifier_scores(df, [Bandwidth.of(3.0, 2), best], None).collect()
    assert {r.candidate: r.score for r in after}[1] > {r.candidate: r.score for r in after}[0]


def test_neighbours_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(kde, "QUERY_ROWS", 16)
    monkeypatch.setattr(kde, "DATA_ROWS", 20)
    x, _ = moons(70)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r.id, r.rank): r.neighbour for r in kde.knn(df, df.where("id % 2 = 0"), 3).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(np.argsort(d[i], kind="stable")[k]) for i in range(0, 70, 2) for k in range(3)}
    assert kde.knn(df.limit(0), df, 3).count() == 0


def test_svm_search_and_coupling(spark):
    x, y = moons(60)
    m = svm.fit(spark, x, y, SquaredExponential(0), [0.1, 0.1], [5.0, 100.0], rounds=1, per=2)
    assert (m.predict_np(x) == y).mean() > 0.85 and np.isfinite(m.span_objective())
    spread = svm.fit(spark, x, y, SquaredExponential(0), [0.1, 0.1], [5.0, 100.0], metric="span", rounds=1, per=2)
    assert spread.span_objective() >= m.span_objective() - 1e-9
    p = np.array([[0.5, 0.3, 0.2], [0.2, 0.2, 0.6]])
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(svm.couple(r), p, atol=1e-6)


def test_delimited_lines_are_numbered_over_splits(spark, tmp_path):
    from plumbline.sources import delimited

    text = "a;b\n" + "".join("# note\n" if i % 50 == 7 else "\n" if i % 50 == 9 else f"{i}; {i / 2}\n" for i in range(3000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text(text)
    (tmp_path / "in" / "two.txt").write_text("a;b\n1;2\n3;x\n5;6\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = delimited.read(spark, str(tmp_path / "in"), ";", header=1).collect()
        loose = delimited.read(spark, str(tmp_path / "in"), ";", header=1, strict=False).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = sorted((r.line_no, r.x) for r in got if r.file.endswith("one.txt"))
    assert one == [(i + 1, [float(i), i / 2]) for i in range(3000) if i % 50 not in (7, 9)]
    assert [(r.line_no, r.x) for r in got if r.file.endswith("two.txt")] == [(1, [1.0, 2.0])]
    assert loose == len(one) + 2
