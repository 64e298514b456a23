"""Correlation, least squares and class densities over a feature table.

Each step is one aggregate over all rows on Spark. What reaches the driver is a
k x k matrix or a few numbers per column, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.functions.naming import quote


def _vectors(df: DataFrame, cols: Sequence[str], out: str = "_v") -> DataFrame:
    """One dense-or-sparse vector column of ``cols``.

    Columns are first projected under plain names: ML reads a dot as nesting.
    """
    names = [f"c{i}" for i in range(len(cols))]
    plain = df.select(*[F.col(quote(c)).cast("double").alias(n) for c, n in zip(cols, names, strict=True)])
    return VectorAssembler(inputCols=names, outputCol=out).transform(plain).select(out)


# ---------------------------------------------------------------- correlation


def correlation(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson matrix of ``cols``; NaN where a column is constant."""
    matrix = Correlation.corr(_vectors(df, cols), "_v").first()[0]
    return matrix.toArray()


def correlation_pairs(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """The upper triangle as rows (i, j, col_i, col_j, r); r is NULL for constant columns."""
    pairs = _triangle(df.sparkSession, correlation(df, cols), cols, 1)
    known = F.when(~F.isnan("value"), F.round("value", digits))
    return pairs.select("i", "j", "col_i", "col_j", known.alias("r"))


def _triangle(spark: SparkSession, matrix: np.ndarray, names: Sequence[str], above: int) -> DataFrame:
    """(i, j, col_i, col_j, value) of the entries with j - i of ``above`` at least.

    The driver hands over one array a row of the matrix; executors make the k^2 / 2 rows of it.
    """
    k = len(names)
    inside = np.triu(np.ones((k, k), bool), above)
    offsets = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
    packed = pa.table({
        "i": pa.array(np.arange(k), pa.int32()),
        "col_i": pa.array(list(names), pa.string()),
        "entries": pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix[inside], pa.float64())),
    })
    rows = spark.createDataFrame(packed)
    others = rows.select(F.col("i").alias("j"), F.col("col_i").alias("col_j"))
    entries = rows.select("i", "col_i", F.posexplode("entries").alias("pos", "value"))
    entries = entries.withColumn("j", (F.col("i") + F.col("pos") + above).cast("int"))
    return entries.join(F.broadcast(others), "j").select("i", "j", "col_i", "col_j", "value")


def prune_correlated(
    matrix: np.ndarray, cols: Sequence[str], threshold: float = 0.9, absolute: bool = False
) -> list[str]:
    """Columns left after dropping each one that correlates with any earlier column.

    The earlier column counts even if it was dropped itself. Comparison is signed
    unless ``absolute``; NaN (constant columns) never drops anything.
    """
    strength = np.abs(matrix) if absolute else matrix
    with np.errstate(invalid="ignore"):
        too_close = np.triu(strength >= threshold, k=1)
    dropped = too_close.any(axis=0)
    return [c for c, gone in zip(cols, dropped, strict=True) if not gone]


# -------------------------------------------------------------- least squares


@dataclass(frozen=True)
class Moments:
    """Sums of products of features and target: all that least squares needs."""

    cols: tuple[str, ...]
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    n: int

    def only(self, cols: Sequence[str]) -> Moments:
        at = [self.cols.index(c) for c in cols]
        return Moments(tuple(cols), self.xtx[np.ix_(at, at)], self.xty[at], self.yty, self.n)


@dataclass(frozen=True)
class Fit:
    cols: tuple[str, ...]
    coefficient: np.ndarray
    std_error: np.ndarray
    t_value: np.ndarray
    p_value: np.ndarray
    df_resid: int


def moments(df: DataFrame, cols: Sequence[str], target: str) -> Moments:
    """One pass over the rows: the Gram matrix of features, target and a constant 1.

    The constant's own entry is the row count. Partial matrices are added up in a
    tree on the executors.
    """
    rows = df.withColumn("_one", F.lit(1.0))
    vectors = MLUtils.convertVectorColumnsFromML(_vectors(rows, [*cols, target, "_one"]), "_v")
    gram = RowMatrix(vectors).computeGramianMatrix().toArray()
    k = len(cols)
    return Moments(tuple(cols), gram[:k, :k], gram[:k, k], float(gram[k, k]), int(round(gram[k + 1, k + 1])))


def gram_pairs(df: DataFrame, cols: Sequence[str], target: str, digits: int = 2) -> DataFrame:
    """The moments as rows (col_i, col_j, s) with the target as one more column."""
    m = moments(df, cols, target)
    names = [*cols, target]
    full = np.vstack([np.column_stack([m.xtx, m.xty]), np.append(m.xty, m.yty)])
    pairs = _triangle(df.sparkSession, full, names, 0)
    return pairs.select("col_i", "col_j", F.round("value", digits).alias("s"))


def ols(m: Moments) -> Fit:
    """Least squares without intercept, with two-sided t-test p-values.

    Columns are scaled to unit length before the pseudo-inverse, which keeps the
    rank decision independent of their units. An all-zero column has no p-value.
    """
    length = np.sqrt(np.diag(m.xtx))
    unit = np.where(length > 0, length, 1.0)
    scaled = m.xtx / np.outer(unit, unit)
    inverse = np.linalg.pinv(scaled, rcond=1e-10, hermitian=True)
    rank = int(np.linalg.matrix_rank(scaled, tol=1e-10 * max(1.0, np.linalg.norm(scaled, 2)), hermitian=True))
    beta_scaled = inverse @ (m.xty / unit)
    residual = max(m.yty - float(beta_scaled @ (m.xty / unit)), 0.0)
    df_resid = m.n - rank
    variance = residual / df_resid if df_resid > 0 else math.nan
    error_scaled = np.sqrt(variance * np.clip(np.diag(inverse), 0.0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta_scaled / error_scaled
    p = np.array([t_two_sided(v, df_resid) for v in t])
    return Fit(m.cols, beta_scaled / unit, error_scaled / unit, t, p, df_resid)


class Sweep:
    """Least squares that drops one column at a time, by sweeping it out of the inverse: k^2 steps, not a new inverse.

    Columns of full rank only. Every ``REFRESH`` drops the inverse is made anew, against rounding.
    """

    REFRESH = 64

    def __init__(self, m: Moments):
        self.m = m
        length = np.sqrt(np.diag(m.xtx))
        scaled, xty = m.xtx / np.outer(length, length), m.xty / length
        self.inverse = np.linalg.inv(scaled)
        self.beta = self.inverse @ xty
        self.residual = max(m.yty - float(self.beta @ xty), 0.0)
        self.drops = 0

    def p_values(self) -> np.ndarray:
        df_resid = self.m.n - len(self.beta)
        variance = self.residual / df_resid if df_resid > 0 else math.nan
        with np.errstate(divide="ignore", invalid="ignore"):
            t = self.beta / np.sqrt(variance * np.clip(np.diag(self.inverse), 0.0, None))
        return np.array([t_two_sided(v, df_resid) for v in t])

    def without(self, at: int) -> Sweep:
        rest = np.delete(np.arange(len(self.beta)), at)
        m = self.m.only([self.m.cols[i] for i in rest])
        if self.drops + 1 >= self.REFRESH:
            return Sweep(m)
        out = object.__new__(Sweep)
        pivot, column = self.inverse[at, at], self.inverse[rest, at]
        out.m, out.drops = m, self.drops + 1
        out.inverse = self.inverse[np.ix_(rest, rest)] - np.outer(column, column) / pivot
        out.beta = self.beta[rest] - column * self.beta[at] / pivot
        out.residual = self.residual + self.beta[at] ** 2 / pivot
        return out


def eliminate_backward(m: Moments, significance: float = 0.05) -> list[str]:
    """Drop the least significant column until all p-values reach ``significance``.

    Works on sub-matrices of one set of moments, so the data is read once. All-zero
    columns go first; of equal p-values the later column goes. While columns depend on each other, a pseudo-inverse
    judges them; from full rank on, columns are swept out of one inverse.
    """
    cols = [c for c, s in zip(m.cols, np.diag(m.xtx), strict=True) if s > 0]
    sweep = None
    while cols:
        if sweep is None:
            fit = ols(m.only(cols))
            p = fit.p_value
            if fit.df_resid == m.n - len(cols):
                sweep = Sweep(m.only(cols))
        else:
            p = sweep.p_values()
        worst = len(p) - 1 - int(np.argmax(p[::-1]))
        if not p[worst] > significance:
            break
        del cols[worst]
        sweep = sweep.without(worst) if sweep and cols else None
    return cols


def fit_rows(fit: Fit, spark) -> DataFrame:
    """An ``ols`` result as one row per column."""

    def number(v: float) -> float | None:
        return float(v) if math.isfinite(v) else None

    rows = [
        (i, c, number(fit.coefficient[i]), number(fit.std_error[i]), number(fit.t_value[i]), number(fit.p_value[i]))
        for i, c in enumerate(fit.cols)
    ]
    schema = "position int, feature string, coefficient double, std_error double, t_value double, p_value double"
    return spark.createDataFrame(rows, schema)


def t_two_sided(t: float, df: int) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom.

    Log-gamma differences lose their digits when ``df`` counts rows by the
    million; from 1,000 on Hill's normalising transform (CACM 1970) is exact
    to about 1e-12.
    """
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if df >= 1000:
        a = df - 0.5
        square, scale = a * math.log1p(t * t / df), 48.0 * a * a
        inner = ((-0.4 * square - 3.3) * square - 24.0) * square - 85.5
        factor = (inner / (0.8 * square * square + 100.0 + scale) + square + 3.0) / scale + 1.0
        return math.erfc(factor * math.sqrt(square) / math.sqrt(2.0))
    return _beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


# ------------------------------------------------------------------- densities


def value_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column: one aggregate, two numbers per column."""
    exprs = []
    for i, c in enumerate(cols):
        number = F.col(quote(c)).cast("double")
        exprs += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}")]
    row = df.agg(*exprs).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def _long(df: DataFrame, label: str, cols: Sequence[str], classes: Sequence) -> DataFrame:
    """Rows (feature, class, value); a narrow step, feeding a map-side combine."""
    plain = df.where(F.col(quote(label)).isin(list(classes))).select(
        F.col(quote(label)).alias("class"),
        *[F.col(quote(c)).cast("double").alias(f"v{i}") for i, c in enumerate(cols)],
    )
    long = plain.unpivot(["class"], [f"v{i}" for i in range(len(cols))], "slot", "value")
    return long.withColumn("slot", F.substring("slot", 2, 10).cast("int")).where(F.col("value").isNotNull())


def _pick(values: Sequence[float | str | None], kind: str) -> Column:
    """Literal per feature slot, chosen by the ``slot`` column."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("slot") + 1)


def class_density(
    df: DataFrame, label: str, cols: Sequence[str], bins: int = 20, classes: Sequence = (0, 1)
) -> DataFrame:
    """Equal-width histogram of each feature per class, scaled to density.

    The heights of a class's bins times the bin width add up to 1. A constant
    feature has one bin of zero width and no density. The totals have one row per
    feature and class, which bounds what is broadcast.
    """
    ranges = value_ranges(df, cols)
    low = _pick([ranges[c][0] for c in cols], "double")
    width = _pick([_width(ranges[c], bins) for c in cols], "double")
    place = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1)).cast("int")
    binned = _long(df, label, cols, classes).withColumn("bin", F.when(width > 0, place).otherwise(0))
    counts = binned.groupBy("slot", "class", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("slot", "class").agg(F.sum("n").alias("total"))
    joined = counts.join(F.broadcast(totals), ["slot", "class"])
    return joined.select(
        _pick(list(cols), "string").alias("feature"),
        "class",
        "bin",
        F.round(low + F.col("bin") * width, 6).alias("bin_start"),
        "n",
        F.round(F.when(width > 0, F.col("n") / (F.col("total") * width)), 10).alias("density"),
    )


def _width(span: tuple[float | None, float | None], parts: int) -> float:
    low, high = span
    return 0.0 if low is None or high is None else (high - low) / parts


def class_curves(
    df: DataFrame, label: str, cols: Sequence[str], points: int = 50, classes: Sequence = (0, 1), fine: int = 10
) -> DataFrame:
    """Gaussian kernel density of each feature per class on an even grid, by linear binning.

    Bandwidth h is Scott's rule, ``stddev * n^(-1/5)`` of the class. Every value adds two weights to a grid ``fine`` times
    as fine as the points, in one partial aggregate; a task sends at most one row per feature, class and grid
    cell, whatever the values. The curve is the grid's convolution with the kernel. With a grid step d it is off
    by no more than ``d^2 / (8 h^3 sqrt(2 pi))`` from the sum over all values. Constant features have no curve.
    """
    ranges = value_ranges(df, cols)
    cells = (points - 1) * fine + 1
    shift = _pick([ranges[c][0] for c in cols], "double")
    step = _pick([_width(ranges[c], cells - 1) for c in cols], "double")
    placed = _long(df, label, cols, classes).withColumns({"moved": F.col("value") - shift, "step": step}).where("step > 0")
    placed = placed.withColumn("place", F.col("moved") / F.col("step"))
    placed = placed.withColumn("cell", F.least(F.floor("place"), F.lit(cells - 2)).cast("int"))
    grid = placed.groupBy("slot", "class", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("place") - F.col("cell")).alias("above"),
        F.sum("moved").alias("m1"),
        F.sum(F.col("moved") * F.col("moved")).alias("m2"),
    )
    per = grid.groupBy("slot", "class").agg(
        F.sum("n").alias("total"),
        F.sum("m1").alias("m1"),
        F.sum("m2").alias("m2"),
        F.collect_list(F.struct("cell", (F.col("n") - F.col("above")).alias("here"), "above")).alias("grid"),  # one entry a cell
    )
    per = per.where(F.col("total") > 1).withColumn(
        "var", (F.col("m2") - F.col("m1") * F.col("m1") / F.col("total")) / (F.col("total") - 1)
    )
    per = per.where(F.col("var") > 0).withColumns(
        {"step": step, "bandwidth": F.sqrt("var") * F.pow(F.col("total"), F.lit(-0.2))}
    )

    def kernel(distance: Column) -> Column:
        z = distance * F.col("step") / F.col("bandwidth")
        return F.exp(-z * z / 2)

    def height(point: Column) -> Column:
        return F.aggregate(
            "grid",
            F.lit(0.0),
            lambda have, c: have + c["here"] * kernel(point * fine - c["cell"]) + c["above"] * kernel(point * fine - c["cell"] - 1),
        )

    scale = F.col("total") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    curve = per.select(
        "slot", "class", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: height(i) / scale)).alias("point", "density")
    )
    wide = _pick([_width(ranges[c], points - 1) for c in cols], "double")
    return curve.select(
        _pick(list(cols), "string").alias("feature"),
        "class",
        "point",
        F.round(shift + F.col("point") * wide, 6).alias("x"),
        F.round("density", 6).alias("density"),
    )


def prune_report(matrix: np.ndarray, cols: Sequence[str], spark, threshold: float = 0.9) -> DataFrame:
    """Which columns the correlation rule keeps: (position, feature, kept)."""
    kept = set(prune_correlated(matrix, cols, threshold))
    rows = [(i, c, c in kept) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "position int, feature string, kept boolean")

