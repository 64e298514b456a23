import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lapsekit.operators import statistics as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=200), rng.normal(size=200)
    y = (a + 0.2 * b + rng.normal(size=200) > 0).astype(int)
    rows = [(float(p), float(q), float(-p), float(2 * p), 3.0, 0.0, int(t)) for p, q, t in zip(a, b, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, neg double, twice double, const double, zero double, y int")


def test_correlation_handles_constants_and_signs(data):
    cols = ["a", "neg", "twice", "const"]
    r = S.correlation(data, cols)
    assert r[0, 1] == pytest.approx(-1) and r[0, 2] == pytest.approx(1) and math.isnan(r[0, 3])
    assert S.prune_correlated(r, cols) == ["a", "neg", "const"]
    assert S.prune_correlated(r, cols, absolute=True) == ["a", "const"]


def test_a_dropped_column_still_drops_later_ones():
    r = np.array([[1, 0.95, 0.1], [0.95, 1, 0.95], [0.1, 0.95, 1]])
    assert S.prune_correlated(r, ["i", "j", "k"]) == ["i"]


def test_pairs_use_null_for_constants(data):
    pairs = {(r["col_i"], r["col_j"]): r["r"] for r in S.correlation_pairs(data, ["a", "const"]).collect()}
    assert pairs == {("a", "const"): None}


def test_ols_matches_the_normal_equation_solver(data):
    fit = S.ols(S.moments(data, ["a", "b"], "y"))
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(data)
    model = LinearRegression(featuresCol="v", labelCol="y", solver="normal", fitIntercept=False).fit(vec)
    assert fit.coefficient == pytest.approx(model.coefficients.toArray(), abs=1e-12)
    assert fit.p_value == pytest.approx(model.summary.pValues, abs=1e-10)
    assert fit.std_error == pytest.approx(model.summary.coefficientStandardErrors, abs=1e-10)
    assert fit.df_resid == 198


def test_ols_with_collinear_and_zero_columns(data):
    fit = S.ols(S.moments(data, ["a", "twice", "zero"], "y"))
    assert np.isfinite(fit.p_value[:2]).all() and math.isnan(fit.p_value[2])
    assert fit.df_resid == 199


def test_backward_elimination(data):
    m = S.moments(data, ["a", "b", "zero", "const"], "y")
    kept = S.eliminate_backward(m)
    assert "a" in kept and "zero" not in kept
    assert (S.ols(m.only(kept)).p_value <= 0.05).all()
    assert S.eliminate_backward(m, significance=1.0) == ["a", "b", "const"]
    assert S.eliminate_backward(m.only(["zero"])) == []


@pytest.mark.parametrize(
    "t, df, p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (12.7062047364, 1, 0.05), (2.2281388520, 10, 0.05), (1.9599639845, 10**9, 0.05)]
)
def test_t_distribution(t, df, p):
    assert S.t_two_sided(t, df) == pytest.approx(p, abs=1e-8)
    assert S.t_two_sided(-t, df) == S.t_two_sided(t, df)


@pytest.mark.parametrize("t", [0.01, 0.7, 2.0, 4.5])
def test_t_distribution_is_continuous_where_the_method_changes(t):
    exact = S._beta_ratio(1000 / 2.0, 0.5, 1000 / (1000 + t * t))
    assert S.t_two_sided(t, 1000) == pytest.approx(exact, rel=1e-9)


def test_t_distribution_limits():
    assert S.t_two_sided(math.inf, 3) == 0.0 and math.isnan(S.t_two_sided(math.nan, 3)) and math.isnan(S.t_two_sided(1.0, 0))


def test_density_integrates_to_one(data):
    bins = S.class_density(data, "y", ["a", "const"], bins=8)
    span = {c: (hi - lo) / 8 for c, (lo, hi) in S.value_ranges(data, ["a"]).items()}
    areas = bins.where("feature = 'a'").groupBy("class").agg(F.sum("density")).collect()
    assert [r[1] * span["a"] for r in areas] == pytest.approx([1, 1], abs=1e-6)
    flat = bins.where("feature = 'const'").collect()
    assert {(r["bin"], r["density"]) for r in flat} == {(0, None)}


@pytest.mark.parametrize("fine", [10, 400])
def test_curve_is_within_its_bound_of_the_direct_sum(data, fine):
    got = S.class_curves(data, "y", ["a", "const"], points=5, fine=fine).where("class = 1").orderBy("point").collect()
    assert {r["feature"] for r in got} == {"a"}
    local = np.array([r["a"] for r in data.where("y = 1").collect()])
    h = local.std(ddof=1) * len(local) ** -0.2
    everything = [r["a"] for r in data.select("a").collect()]
    grid = np.linspace(min(everything), max(everything), 5)
    want = [np.exp(-(((x - local) / h) ** 2) / 2).sum() / (len(local) * h * math.sqrt(2 * math.pi)) for x in grid]
    bound = ((grid[1] - grid[0]) / fine) ** 2 / (8 * h**3 * math.sqrt(2 * math.pi))
    assert [r["density"] for r in got] == pytest.approx(want, abs=bound + 1e-6)


def test_curves_make_no_row_for_each_value_and_point(data):
    plan = S.class_curves(data, "y", ["a", "b", "neg"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")  # of finished curves alone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep_drops_the_same_columns_as_fresh_inverses(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 30)) * rng.uniform(0.01, 100, 30)
    x[:, 7] = x[:, 3] + x[:, 5]  # dependent columns at first
    y = x[:, :4] @ np.array([0.5, -2.0, 0.1, 0.02]) + rng.normal(size=400)
    cols = tuple(f"c{i}" for i in range(30))
    m = S.Moments(cols, x.T @ x, x.T @ y, float(y @ y), 400)
    left = list(cols)
    while left:
        p = S.ols(m.only(left)).p_value
        worst = len(p) - 1 - int(np.argmax(p[::-1]))
        if p[worst] <= 0.05:
            break
        del left[worst]
    assert S.eliminate_backward(m) == left and 0 < len(left) < 30
    sweep = S.Sweep(m.only([c for c in cols if c != "c7"]))
    for _ in range(5):
        sweep = sweep.without(2)
        assert sweep.p_values() == pytest.approx(S.ols(sweep.m).p_value, abs=1e-9)


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 1.0, 1), (4.0, 1.0, 1)], ["a.b", "c d", "y"])
    assert S.correlation(df, ["a.b", "c d"]).shape == (2, 2)
    assert S.moments(df, ["a.b"], "y").xtx[0, 0] == 21.0
    assert S.class_density(df, "y", ["a.b", "c d"], bins=2).count() > 0


@pytest.mark.parametrize(("k", "above"), [(0, 1), (1, 0), (1, 1), (2, 1), (700, 0), (700, 1)])
def test_matrix_goes_over_by_rows(spark, k, above):
    """Every entry of the upper triangle under its names, from one local row for each row of the matrix."""
    matrix = np.arange(k * k, dtype=float).reshape(k, k)
    names = [f"c.{i}" for i in range(k)]
    out = S._triangle(spark, matrix, names, above)
    assert out.columns == ["i", "j", "col_i", "col_j", "value"]
    bad = (F.col("j") < F.col("i") + above) | (F.col("value") != F.col("i") * k + F.col("j"))
    bad |= (F.col("col_i") != F.concat(F.lit("c."), "i")) | (F.col("col_j") != F.concat(F.lit("c."), "j"))
    assert out.filter(bad).count() == 0
    assert out.select("i", "j").distinct().count() == out.count() == len(np.triu_indices(k, above)[0])
