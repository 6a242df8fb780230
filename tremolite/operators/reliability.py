"""Probabilistic analysis: samples, transforms, first- and second-order reliability, sweeps, sampling with a stop rule."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import normal
from ..functions.distributions import Distribution, Normal

_TWO_52 = float(1 << 52)


def uniform(*keys: Column | str, seed: int = 1) -> Column:
    """A uniform number in [0, 1) fixed by the keys and the seed: the same on any partitioning, after any retry
    and in any database. It is the first 52 bits of the MD5 of seed and keys, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def standard_normal(*keys: Column | str, seed: int = 1) -> Column:
    """Standard normal numbers from the same uniforms, kept off 0 and 1."""
    return normal.inverse(F.least(F.greatest(uniform(*keys, seed=seed), F.lit(1e-7)), F.lit(1 - 1e-7)))


def with_standard_normals(rows: DataFrame, names: list[str], *keys: Column | str, seed: int = 1) -> DataFrame:
    """Rows with independent standard normal columns, in two projections: the approximation looks at its
    argument many times, so the uniforms are columns of their own."""
    edge = lambda i: F.least(F.greatest(uniform(*keys, F.lit(i), seed=seed), F.lit(1e-7)), F.lit(1 - 1e-7))
    rows = rows.withColumns({f"__u_{n}": edge(i) for i, n in enumerate(names)})
    return rows.withColumns({n: normal.inverse(F.col(f"__u_{n}")) for n in names}).drop(*(f"__u_{n}" for n in names))


def to_standard(x: Column, law: Distribution) -> Column:
    """u of an independent variable: the standard normal number of the same probability."""
    return (x - law.mean) / law.stdv if isinstance(law, Normal) else normal.inverse(law.cdf(x))


def from_standard(u: Column, law: Distribution) -> Column:
    """x of an independent variable."""
    return law.mean + law.stdv * u if isinstance(law, Normal) else law.inverse(normal.cdf(u))


def jacobian(x: Column, law: Distribution) -> Column:
    """dx/du = phi(u) / f(x)."""
    return normal.pdf(to_standard(x, law)) / law.pdf(x)


def correlated(columns: list[Column], correlation: list[list[float]]) -> list[Column]:
    """Standard normals with a correlation, from independent ones: a Cholesky factor (small) in the expressions.

    For a Nataf model give the correlation of the underlying normals.
    """
    lower = np.linalg.cholesky(np.array(correlation, float))
    return [sum((float(lower[i, j]) * columns[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(columns))]


_NAMES = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
_CALLS = {"abs", "sqrt", "exp", "ln", "log", "log10", "pow", "power", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "least", "greatest", "floor", "ceil", "pi", "e", "E"}


def limit_state(expression: str, variables: list[str]) -> Column:
    """A limit-state function from text: arithmetic, the variables and known functions only."""
    if re.search(r"[^\w\s.+\-*/(),]", expression.replace("**", "")) or (unknown := set(_NAMES.findall(re.sub(r"\b[0-9.]+[eE][+-]?[0-9]+", "1", expression))) - set(variables) - _CALLS):
        raise ValueError(f"not allowed in a limit state: {expression!r}")
    del unknown
    return F.expr(expression)


def draw(spark: SparkSession, n: int, laws: dict[str, Distribution], seed: int = 1, partitions: int | None = None) -> DataFrame:
    """n samples of independent variables; column ``sample`` from 0."""
    rows = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "sample")
    rows = with_standard_normals(rows, list(laws), "sample", seed=seed)
    rows = rows.withColumns({n: normal.cdf(F.col(n)) for n, law in laws.items() if not isinstance(law, Normal)})
    return rows.select("sample", *((law.mean + law.stdv * F.col(n) if isinstance(law, Normal) else law.inverse(F.col(n))).alias(n) for n, law in laws.items()))


def monte_carlo(samples: DataFrame, g: Column) -> DataFrame:
    """Number of samples, failures (g <= 0), their share, and the coefficient of variation of the share."""
    fail = (g <= 0).cast("double")
    rows = samples.agg(F.count("*").alias("n"), F.sum(fail).cast("long").alias("failures"), F.avg(fail).alias("pf"))
    return rows.withColumn("cov", F.when(F.col("pf") > 0, F.sqrt((1 - F.col("pf")) / (F.col("pf") * F.col("n")))))


def run_per_sample(samples: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python model for each sample, in Arrow batches."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(run, batches)

    return samples.mapInPandas(each, schema)


def stopped_sampling(draws: DataFrame, target: float, limit: int, order: str = "k", q: str = "q", by: list[str] | None = None) -> DataFrame:
    """Importance sampling with its stop rule: running mean and variance of q, and the first draw at which
    (k >= limit or cov <= target) and k > 2. Variance is floored at 0; cov counts from the first failure on.

    ``by`` names independent runs; each is one ordered series.
    """
    keys = by or []
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    k = F.count("*").over(upto)
    rows = draws.withColumn("__k", k).withColumn("__s", F.sum(q).over(upto)).withColumn("__s2", F.sum(F.col(q) * F.col(q)).over(upto))
    mean = F.col("__s") / F.col("__k")
    variance = F.greatest((F.col("__s2") / F.col("__k") - mean * mean) / F.col("__k"), F.lit(0.0))
    rows = rows.withColumn("pf", mean).withColumn("cov", F.when(mean > 0, F.sqrt(variance) / mean))
    done = ((F.col("__k") >= limit) | (F.col("cov") <= target)) & (F.col("__k") > 2)
    return rows.withColumn("__done", done).where("__done").groupBy(*keys).agg(F.min("__k").alias("k"), F.min_by("pf", "__k").alias("pf"), F.min_by("cov", "__k").alias("cov"))


def importance_weight(u: list[Column], centre: list[float], spread: float = 1.0) -> Column:
    """phi(u) / h(u) of independent standard normals against normals at a centre."""
    log = sum((0.5 * ((x - c) / spread) * ((x - c) / spread) - 0.5 * x * x for x, c in zip(u, centre, strict=True)), F.lit(len(u) * math.log(spread)))
    return F.exp(log)


def fosm(gradients: DataFrame, variables: DataFrame, correlations: DataFrame, by: list[str]) -> DataFrame:
    """First-order second-moment variance: sum over pairs of gradient, deviation and correlation.

    ``gradients`` has (by, rv, gradient), ``variables`` (rv, stdv), ``correlations`` (rv1, rv2, rho) for each
    unordered pair that has one. Returns by, variance, stdv.
    """
    scaled = gradients.join(variables, "rv").withColumn("s", F.col("gradient") * F.col("stdv"))
    own = scaled.select(*by, (F.col("s") * F.col("s")).alias("x"))
    side = lambda c, to: scaled.select(*by, F.col("rv").alias(c), F.col("s").alias(to))
    cross = side("rv1", "s1").join(correlations, "rv1").join(side("rv2", "s2"), [*by, "rv2"]).select(*by, (2 * F.col("rho") * F.col("s1") * F.col("s2")).alias("x"))
    out = own.unionByName(cross).groupBy(*by).agg(F.sum("x").alias("variance"))
    return out.withColumn("stdv", F.sqrt("variance"))


def fosm_importance(gradients: DataFrame, variables: DataFrame, by: list[str]) -> DataFrame:
    """gradient times deviation, normalised in each function."""
    scaled = gradients.join(variables, "rv").withColumn("s", F.col("gradient") * F.col("stdv"))
    length = scaled.groupBy(*by).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("__l"))
    return scaled.join(length, by).select(*by, "rv", (F.col("s") / F.col("__l")).alias("importance"))


def response_covariance(gradients: DataFrame, variables: DataFrame, correlations: DataFrame, by: str) -> DataFrame:
    """Covariance of every pair of responses: grad_a C grad_b."""
    scaled = gradients.join(variables, "rv").select(by, "rv", (F.col("gradient") * F.col("stdv")).alias("s"))
    full = correlations.unionByName(correlations.select(F.col("rv2").alias("rv1"), F.col("rv1").alias("rv2"), "rho")).unionByName(variables.select(F.col("rv").alias("rv1"), F.col("rv").alias("rv2"), F.lit(1.0).alias("rho")))
    a = scaled.select(F.col(by).alias("a"), F.col("rv").alias("rv1"), F.col("s").alias("s1"))
    b = scaled.select(F.col(by).alias("b"), F.col("rv").alias("rv2"), F.col("s").alias("s2"))
    return a.join(full, "rv1").join(b, "rv2").groupBy("a", "b").agg(F.sum(F.col("rho") * F.col("s1") * F.col("s2")).alias("covariance"))


def sorm_breitung(curvatures: DataFrame, by: list[str], beta: str = "beta", kappa: str = "kappa") -> DataFrame:
    """Breitung's correction: pf1 times the product of 1 / sqrt(1 + psi kappa), psi = phi(beta) / Phi(-beta)."""
    b = F.col(beta)
    rows = curvatures.withColumn("__pf1", normal.cdf(-b)).withColumn("__psi", normal.pdf(b) / F.col("__pf1"))
    product = F.exp(-0.5 * F.sum(F.log(1 + F.col("__psi") * F.col(kappa))))
    return rows.groupBy(*by).agg(F.first("__pf1").alias("pf1"), (F.first("__pf1") * product).alias("pf2"))


def fragility(rows: DataFrame, beta: str = "beta", slope: str = "slope", gradient_norm: str = "gradient_norm", ok: str = "ok") -> DataFrame:
    """pf = 1 - Phi(beta) and pdf = phi(-beta) / |gradient| times dg/dp along a parameter; -1 where no design point was found."""
    bad = F.lit(-1.0)
    b = F.col(beta)
    return rows.withColumn("pf", F.when(F.col(ok), 1 - normal.cdf(b)).otherwise(bad)).withColumn("pdf", F.when(F.col(ok), normal.pdf(-b) / F.col(gradient_norm) * F.col(slope)).otherwise(bad))


def sweep(spark: SparkSession, first: float, last: float, intervals: int) -> DataFrame:
    """Parameter values from first to last, both included; column ``parameter``."""
    return spark.range(intervals + 1).select((F.lit(first) + F.col("id") * ((last - first) / intervals)).alias("parameter"))


def finite_differences(points: DataFrame, variables: dict[str, float], g: Callable[[dict[str, Column]], Column], by: list[str]) -> DataFrame:
    """Forward-difference gradient of g at every point: (by, rv, gradient), each variable with a step of its own."""
    base = {v: F.col(v) for v in variables}
    found = [F.struct(F.lit(v).alias("rv"), ((g({**base, v: base[v] + h}) - g(base)) / h).alias("gradient")) for v, h in variables.items()]
    return points.select(*by, F.explode(F.array(*found)).alias("x")).select(*by, "x.*")


# small problems, solved on the driver


def phi(x: float) -> float:
    """Standard normal probability."""
    return 0.5 * math.erfc(-x / math.sqrt(2))


def gradient_of(g: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-6) -> np.ndarray:
    """Central-difference gradient."""
    step = np.eye(len(x)) * h
    return np.array([(g(x + s) - g(x - s)) / (2 * h) for s in step])


def hessian_of(g: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    """Central-difference Hessian, symmetric."""
    step = np.eye(len(x)) * h
    m = np.array([(gradient_of(g, x + s, h) - gradient_of(g, x - s, h)) / (2 * h) for s in step])
    return (m + m.T) / 2


def form(g: Callable[[np.ndarray], float], n: int, rounds: int = 100, tol: float = 1e-8) -> dict:
    """First-order reliability in standard space: design point, beta, pf, direction. HLRF directions with
    Armijo steps on the merit |u|²/2 + c |g|."""
    u = np.zeros(n)
    scale = abs(g(u)) or 1.0
    for _ in range(rounds):
        value, grad = g(u), gradient_of(g, u)
        length = np.linalg.norm(grad)
        if length == 0:
            break
        alpha = -grad / length
        if abs(value / scale) < tol and np.linalg.norm(u - (alpha @ u) * alpha) < tol * max(1, np.linalg.norm(u)):
            break
        direction = (value / length + alpha @ u) * alpha - u
        c = 2 * np.linalg.norm(u) / length + 10
        merit = lambda z: z @ z / 2 + c * abs(g(z))  # noqa: B023, E731
        now, step = merit(u), 1.0
        for _ in range(30):
            if merit(u + step * direction) <= now - 1e-4 * step * (direction @ direction):
                break
            step /= 2
        u = u + step * direction
    grad = gradient_of(g, u)
    alpha = -grad / (np.linalg.norm(grad) or 1.0)
    beta = float(alpha @ u)
    return {"u": u, "beta": beta, "pf": phi(-beta), "alpha": alpha, "gradient_norm": float(np.linalg.norm(grad))}


def form_each(rows: DataFrame, by: list[str], g: Callable[..., float], n: int, parameters: list[str]) -> DataFrame:
    """First-order reliability of many limit states: (by, beta, pf, gradient_norm) for each row, whose columns
    ``parameters`` are handed to g after the point. Rows are independent and run in Arrow batches."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, given in zip(batch[by].itertuples(index=False, name=None), batch[parameters].itertuples(index=False, name=None), strict=True):
                found = form(lambda u, given=given: g(u, *given), n)
                out.append((*key, found["beta"], found["pf"], found["gradient_norm"]))
            yield pd.DataFrame(out, columns=[*by, "beta", "pf", "gradient_norm"])

    return rows.select(*dict.fromkeys([*by, *parameters])).mapInPandas(run, f"{keys}, beta double, pf double, gradient_norm double")


def series_bounds(betas: DataFrame, by: list[str], beta: str = "beta") -> DataFrame:
    """Unimodal bounds on the failure of series systems: the largest component's, and that of independent ones."""
    p = normal.cdf(-F.col(beta))
    rows = betas.withColumn("__p", p)
    return rows.groupBy(*by).agg(F.max("__p").alias("low"), (1 - F.exp(F.sum(F.log(1 - F.col("__p"))))).alias("high"))


def multinormal_pcm(betas: list[float], correlation: list[list[float]]) -> float:
    """P(all X_i <= beta_i) by products of conditional marginals: each variable is conditioned on the ones before,
    whose truncated normals are replaced by normals of the same mean and variance."""
    b, r = np.array(betas, float), np.array(correlation, float)
    total = 1.0
    for i in range(len(b)):
        p = phi(b[i])
        total *= p
        ratio = math.exp(-0.5 * b[i] ** 2) / math.sqrt(2 * math.pi) / max(p, 1e-300)
        shrink = ratio * (b[i] + ratio)
        rest = range(i + 1, len(b))
        scale = np.array([math.sqrt(max(1e-300, 1 - r[i, k] ** 2 * shrink)) for k in rest])
        new = r.copy()
        for m, k in enumerate(rest):
            for q, j in enumerate(rest):
                new[k, j] = 1.0 if k == j else (r[k, j] - r[i, k] * r[i, j] * shrink) / (scale[m] * scale[q])
            b[k] = (b[k] + r[i, k] * ratio) / scale[m]
        r = new
    return total


def principal_curvatures(g: Callable[[np.ndarray], float], found: dict) -> np.ndarray:
    """Curvatures of the limit state at the design point, the largest in size first."""
    n = len(found["u"])
    basis = np.linalg.qr(np.column_stack([found["alpha"], np.eye(n)[:, : n - 1] + 1e-9]))[0][:, 1:]
    if basis.shape[1] == 0:
        return np.zeros(0)
    values = np.linalg.eigvalsh(basis.T @ hessian_of(g, found["u"]) @ basis / found["gradient_norm"])
    return values[np.argsort(-abs(values))]


def secant_root(f: Callable[[float], float], a: float, b: float, tol: float = 1e-12, rounds: int = 200) -> float:
    """Root by secant steps over the last two points; a step that leaves a bracket of changing sign is halved into it."""
    (x0, y0), (x1, y1) = (a, f(a)), (b, f(b))
    bracket = (x0, x1) if y0 < 0 < y1 else (x1, x0) if y1 < 0 < y0 else None
    for _ in range(rounds):
        if abs(y1) < tol or y0 == y1:
            break
        new = x1 - y1 * (x1 - x0) / (y1 - y0)
        if bracket and not min(bracket) < new < max(bracket):
            new = sum(bracket) / 2
        x0, y0, x1, y1 = x1, y1, new, f(new)
        if bracket:
            bracket = (x1, bracket[1]) if y1 < 0 else (bracket[0], x1)
    return x1


def bivariate(b1: float, b2: float, rho: float) -> float:
    """P(X <= b1, Y <= b2) of correlated standard normals: Phi(b1) Phi(b2) plus the density integrated over the
    correlation, by Simpson's rule on arcsin rho."""
    if abs(rho) >= 1:
        return phi(min(b1, b2)) if rho > 0 else max(0.0, phi(b1) + phi(b2) - 1)
    n = 400
    t = np.linspace(0, math.asin(rho), n + 1)
    f = np.exp(-(b1 * b1 + b2 * b2 - 2 * b1 * b2 * np.sin(t)) / (2 * np.cos(t) ** 2))
    weights = np.where(np.arange(n + 1) % 2, 4.0, 2.0)
    weights[[0, -1]] = 1
    return phi(b1) * phi(b2) + float((weights * f).sum() * (t[-1] - t[0]) / n / 3) / (2 * math.pi)


@F.pandas_udf(DoubleType())
def bivariate_cdf(b1: pd.Series, b2: pd.Series, rho: pd.Series) -> pd.Series:
    """The same for columns, in Arrow batches."""
    return pd.Series([bivariate(*x) for x in zip(b1, b2, rho, strict=True)], dtype=float)


def system_bounds(betas: list[float], correlation: list[list[float]]) -> dict[str, float]:
    """Uni- and bimodal (Ditlevsen) bounds on the failure of a series system."""
    order = sorted(range(len(betas)), key=lambda i: betas[i])
    p = [phi(-betas[i]) for i in order]
    joint = [[bivariate(-betas[i], -betas[j], correlation[i][j]) for j in order] for i in order]
    low = p[0] + sum(max(0.0, p[i] - sum(joint[i][:i])) for i in range(1, len(p)))
    high = p[0] + sum(p[i] - max(joint[i][:i]) for i in range(1, len(p)))
    return {"uni_low": max(p), "uni_high": 1 - math.prod(1 - x for x in p), "bi_low": low, "bi_high": min(1.0, high)}


def cut_set_probability(cuts: list[list[int]], p: list[float]) -> float:
    """Failure of a system of independent components given by cut sets, by inclusion and exclusion."""
    total = 0.0
    for r in range(1, len(cuts) + 1):
        for chosen in itertools.combinations(cuts, r):
            total += (-1) ** (r + 1) * math.prod(p[i] for i in set().union(*map(set, chosen)))
    return total


def multinormal_cdf(spark: SparkSession, bounds: list[float], correlation: list[list[float]], n: int = 200_000, seed: int = 1) -> DataFrame:
    """P(all X_i <= b_i) by sequential conditioned sampling: each variable is drawn within its bound, and the
    product of the probabilities of doing so is averaged over samples."""
    lower = np.linalg.cholesky(np.array(correlation, float))
    rows, weight, u = spark.range(n), F.lit(1.0), []
    for i, b in enumerate(bounds):
        edge = (b - sum((float(lower[i, j]) * u[j] for j in range(i)), F.lit(0.0))) / float(lower[i, i])
        p = normal.cdf(edge)
        rows = rows.withColumn(f"__p{i}", p).withColumn(f"__u{i}", normal.inverse(F.greatest(F.least(uniform("id", F.lit(i), seed=seed) * F.col(f"__p{i}"), F.lit(1 - 1e-12)), F.lit(1e-300))))
        u.append(F.col(f"__u{i}"))
        weight = weight * F.col(f"__p{i}")
    return rows.agg(F.avg(weight).alias("p"), (F.stddev_pop(weight) / math.sqrt(n)).alias("error"))


def experimental_points(low: float, high: float, n: int) -> list[float]:
    """Uniform design of n points."""
    return [low + (high - low) * i / (n - 1) for i in range(n)] if n > 1 else [(low + high) / 2]


def univariate_surrogate(g: Callable[[np.ndarray], float], centre: np.ndarray, points: list[float]) -> Callable[[np.ndarray], float]:
    """g as a sum of functions of one variable, each a Lagrange polynomial through ``points`` about the centre."""
    base = g(centre)
    values = [[g(centre + p * e) for p in points] for e in np.eye(len(centre))]

    def lagrange(y: list[float], x: float) -> float:
        return sum(y[i] * math.prod((x - q) / (p - q) for j, q in enumerate(points) if j != i) for i, p in enumerate(points))

    return lambda x: base + sum(lagrange(v, x[i] - centre[i]) - base for i, v in enumerate(values))


def bivariate_surrogate(g: Callable[[np.ndarray], float], centre: np.ndarray, points: list[float]) -> Callable[[np.ndarray], float]:
    """g as a sum of functions of two variables, less those of one and the value at the centre as often as they
    are counted twice; each a Lagrange polynomial through ``points`` about the centre."""
    n, base = len(centre), g(centre)
    unit = np.eye(n)
    one = [[g(centre + p * unit[i]) for p in points] for i in range(n)]
    two = {(i, j): [[g(centre + p * unit[i] + q * unit[j]) for q in points] for p in points] for i in range(n) for j in range(i)}

    def weights(x: float) -> list[float]:
        return [math.prod((x - q) / (p - q) for j, q in enumerate(points) if j != i) for i, p in enumerate(points)]

    def value(x: np.ndarray) -> float:
        w = [np.array(weights(x[i] - centre[i])) for i in range(n)]
        pairs = sum(float(w[i] @ np.array(t) @ w[j]) for (i, j), t in two.items())
        return pairs - (n - 2) * sum(float(w[i] @ np.array(one[i])) for i in range(n)) + (n - 1) * (n - 2) / 2 * base

    return value


def function_grid(spark: SparkSession, g: Column, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """g on a grid of named axes (low, high, points)."""
    total = math.prod(n for _, _, n in axes.values())
    rows, size = spark.range(total), 1
    for name, (low, high, n) in axes.items():
        rows = rows.withColumn(name, F.lit(low) + (F.expr(f"id div {size}") % n) * ((high - low) / max(1, n - 1)))
        size *= n
    return rows.withColumn("g", g).drop("id")


def out_crossing_rate(beta: Column, rho_dot: Column) -> Column:
    """Mean rate at which a standard Gaussian process with derivative deviation ``rho_dot`` crosses beta upwards."""
    return rho_dot / math.sqrt(2 * math.pi) * normal.pdf(beta)
