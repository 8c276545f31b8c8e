"""Fixed effects, weights, factors and split fits against dummies in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarflow.operators import regression as R


def panel(seed, units=30, years=7):
    rng = np.random.default_rng(seed)
    rows = [(int(u), int(t), int((t + u) % 5), "ab"[u % 2], float(rng.normal() + 0.1 * u), float(rng.normal() + t), float(rng.uniform(0.2, 3))) for u in range(units) for t in range(years) if rng.random() < 0.8]
    return [(*r[:4], 2 * r[4] - r[5] + float(rng.normal()), *r[4:]) for r in rows]


SCHEMA = "unit int, year int, age int, part string, y double, x double, z double, w double"


def dummies(rows, columns, ways, intercept=False):
    """y, X and how many columns are regressors, then the dummies of each way (all levels of the first)."""
    names = SCHEMA.replace(",", "").split()[::2]
    of = {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)}
    made = [of[c].astype(float) for c in columns]
    for k, way in enumerate(ways):
        levels = sorted(set(of[way].tolist()))
        made += [(of[way] == v).astype(float) for v in levels[k > 0 :]]
    if intercept:
        made.append(np.ones(len(rows)))
    return of, np.column_stack(made)


def clustered(rows, x, ways, weighted, cluster="unit"):
    of, full = dummies(rows, x, ways)
    w = of["w"] if weighted else np.ones(len(rows))
    inverse = np.linalg.pinv(full.T @ (full * w[:, None]))
    beta = inverse @ full.T @ (w * of["y"])
    e = of["y"] - full @ beta
    scores = np.array([((w * e)[:, None] * full)[of[cluster] == g].sum(0) for g in sorted(set(of[cluster].tolist()))])
    levels = sum(len(set(of[c].tolist())) for c in ways) - (len(ways) - 1)
    n, g, k = len(rows), len(scores), len(x)
    v = g / (g - 1) * (n - 1) / (n - levels - k) * inverse @ scores.T @ scores @ inverse
    return beta[:k], np.sqrt(np.diag(v))[:k]


@pytest.mark.parametrize("ways", [["unit"], ["unit", "year"], ["unit", "year", "age"], ["year", "age"]])
@pytest.mark.parametrize("weighted", [False, True])
def test_ways_and_weights(spark, ways, weighted):
    rows = panel(len(ways) + 7 * weighted)
    df = spark.createDataFrame(rows, SCHEMA)
    fit = R.fixed_effects(df, "y", ["x", "z"], ways, "unit", weight="w" if weighted else None)
    beta, se = clustered(rows, ["x", "z"], ways, weighted)
    assert fit.converged and fit.passes <= 2 and fit.n == len(rows)
    assert np.allclose(fit.beta, beta, rtol=1e-8) and np.allclose(fit.se, se, rtol=1e-8)
    assert fit.p[0] == pytest.approx(math.erfc(abs(beta[0] / se[0]) / math.sqrt(2))) and fit.low[0] == pytest.approx(beta[0] - 1.96 * se[0])
    # what is left has no weighted mean in any way
    free, _, worst = R.absorbed(df, ["y", "x"], ways, weight="w" if weighted else None)
    for way in ways:
        assert max(abs(r[1]) for r in free.groupBy(way).agg(F.sum(F.col("y") * (F.col("w") if weighted else F.lit(1.0)))).collect()) < 1e-7
    assert worst < 1e-8


def test_many_levels_are_demeaned_in_turn(spark, monkeypatch):
    rows = panel(3)
    monkeypatch.setattr(R, "MAX_GROUP_LEVELS", 2)
    fit = R.fixed_effects(spark.createDataFrame(rows, SCHEMA), "y", ["x", "z"], ["unit", "year"], "unit", weight="w", passes=60)
    beta, se = clustered(rows, ["x", "z"], ["unit", "year"], True)
    assert fit.converged and fit.passes > 2 and np.allclose(fit.beta, beta, rtol=1e-6) and np.allclose(fit.se, se, rtol=1e-6)


def test_split_fits_are_those_of_the_parts(spark):
    rows = panel(5)
    df = spark.createDataFrame(rows, SCHEMA)
    split = R.by_group(df.withColumn("part", F.when(F.col("year") != 3, F.col("part"))), {"part": F.col("part"), "odd": F.col("age") % 2}, "y", [["x"], ["x", "z"]], ["unit", "year"], "unit")
    assert [(d, v) for d, v, _ in split] == [("odd", "0"), ("odd", "1"), ("part", "a"), ("part", "b")]
    for dimension, level, fits in split:
        own = [r for r in rows if (r[1] != 3 and r[3] == level if dimension == "part" else r[2] % 2 == int(level))]
        for x, fit in zip((["x"], ["x", "z"]), fits, strict=True):
            beta, se = clustered(own, x, ["unit", "year"], False)
            assert fit.n == len(own) and np.allclose(fit.beta, beta, rtol=1e-7) and np.allclose(fit.se, se, rtol=1e-7)


def test_split_fits_take_as_many_jobs_for_many_groups(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(groups):
        df = spark.createDataFrame([(*r[:3], f"g{r[0] % groups}", *r[4:]) for r in panel(6, 60)], SCHEMA)
        spark.sparkContext.setJobGroup(f"split {groups}", "")
        R.by_group(df, {"part": F.col("part")}, "y", [["x"]], ["unit", "year"], "unit")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"split {groups}"))

    assert jobs(12) <= jobs(2) + 2  # adaptive execution may cut a query into a job more


def test_factor_fit(spark):
    rows = panel(9)
    df = spark.createDataFrame(rows, SCHEMA)
    for factor in (None, "part", "age"):
        got = {t: (b, s) for t, b, s in R.factor_fit(df, "y", ["x", "z"], factor, "w")}
        names = SCHEMA.replace(",", "").split()[::2]
        of = {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)}
        levels = sorted({str(v) for v in of[factor].tolist()}) if factor else []
        columns = {"x": of["x"], "z": of["z"], "constant": np.ones(len(rows)), **{f"{factor}={v}": np.array([float(str(u) == v) for u in of[factor].tolist()]) for v in levels[1:]}}
        full, w = np.column_stack(list(columns.values())), of["w"]
        inverse = np.linalg.inv(full.T @ (full * w[:, None]))
        beta = inverse @ full.T @ (w * of["y"])
        e = of["y"] - full @ beta
        se = np.sqrt(np.diag(inverse) * (w * e * e).sum() / (len(rows) - full.shape[1]))
        assert set(got) == set(columns)
        for name, b, s in zip(columns, beta, se, strict=True):
            assert got[name][0] == pytest.approx(b, rel=1e-7) and got[name][1] == pytest.approx(s, rel=1e-7)


def test_rows_that_take_no_part(spark):
    rows = panel(11)
    odd = [(None, 1, 1, "a", 9.0, 9.0, 9.0, 1.0), (1, None, 1, "a", 9.0, 9.0, 9.0, 1.0), (1, 1, 1, "a", None, 9.0, 9.0, 1.0), (1, 1, 1, "a", 9.0, 9.0, 9.0, None), (1, 1, 1, "a", 9.0, 9.0, 9.0, 0.0)]
    one, two = (R.fixed_effects(spark.createDataFrame(r, SCHEMA), "y", ["x"], ["unit", "year"], "unit", weight="w") for r in (rows, rows + odd))
    assert one.n == two.n and one.beta == pytest.approx(two.beta) and one.se == pytest.approx(two.se)
