"""Fits over works that are rows, and the tables these are made of."""

import datetime
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarflow.operators import panels as P
from scholarflow.operators import ranks
from scholarflow.operators import regression as R
from scholarflow.plans import bridge as B
from scholarflow.plans import queries as Q

from .test_regression import clustered, panel


def wide(spark, rows, units=30, years=7):
    """A row for each unit of a panel, with arrays by year; what is missing is NaN."""
    at = {(r[0], r[1]): r for r in rows}
    nan = float("nan")
    held = [(*([float(at[u, t][c]) if (u, t) in at else nan for t in range(years)] for c in (4, 5, 6)), [(t + u) % 5 for t in range(years)]) for u in range(units)]
    return spark.createDataFrame(held, "y array<double>, x array<double>, z array<double>, age array<int>").repartition(3)


def cells():
    """For a Design; made here, because tasks can't import tests."""

    def whole(t):
        return {**t, "year": np.broadcast_to(np.arange(t["y"].shape[1]), t["y"].shape)}, ~np.isnan(t["y"])

    return whole


@pytest.mark.parametrize("ways", [["unit", "year"], ["unit", "year", "age"], ["year", "age"]])
def test_units_as_rows_give_the_fits_of_dummies(spark, monkeypatch, ways):
    monkeypatch.setattr(R, "UNITS", 8)
    rows, sets = panel(21 + len(ways)), [["x"], ["x", "z"]]
    design = R.Design("y", sets, [w for w in ways if w != "unit"], cells(), "unit" in ways)
    for x, fit in zip(sets, R.unit_fits(wide(spark, rows), {"one": design})["one"], strict=True):
        beta, se = clustered(rows, x, ways, False)
        assert fit.converged and fit.passes == 1 and (fit.n, fit.groups) == (len(rows), len({r[0] for r in rows}))
        assert np.allclose(fit.beta, beta, rtol=1e-8) and np.allclose(fit.se, se, rtol=1e-8)


def test_too_many_levels_are_left_to_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_GROUP_LEVELS", 2)
    assert R.unit_fits(wide(spark, panel(3)), {"one": R.Design("y", [["x"]], ["year"], cells())}) is None


def shuffles(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in folders for p in Path(d).rglob("shuffle_*.data")}


def test_cuts_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    with ranks.passing(spark):
        ranks.cut(spark.range(1000).repartition("id").groupBy((F.col("id") % 7).alias("k")).count())
        until = time.time() + 10  # they are taken away by another thread
        while shuffles(spark) - before and time.time() < until:
            time.sleep(0.2)
    assert not shuffles(spark) - before


def tables(spark, folder, seed=5, twice=False):
    """Orders of unknown customers, or without a customer, a date, or lines; lines of unknown orders, of no part, and twice."""
    r = random.Random(seed)
    day = lambda: datetime.datetime(r.choice([1992, *range(1995, 2003)]), r.randint(1, 12), r.randint(1, 28))
    orders = [(k, r.choice([*range(6), *range(6), 99, None]), None if r.random() < 0.03 else day(), "1") for k in range(300)]
    lines = [(r.randrange(310), r.choice([*range(25), None]), 1, n) for n in range(900)]
    if twice:
        orders += [(7, 3, datetime.datetime(1997, 3, 3), "1"), (9, 2, datetime.datetime(1996, 3, 3), "1")]
    for name, rows, schema in (("customer", [(k, "m", 1) for k in range(6)], "c_custkey bigint, c_mktsegment string, c_nationkey int"), ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string"), ("lineitem", lines + lines[:40], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_histories_are_the_exposures(spark, tmp_path):
    d = tables(spark, tmp_path)
    years = range(Q.START, Q.END + 1)
    rows = Q._histories(spark, d, "work_id", "pub_year", "cite_counts", "unrelated", "related").collect()
    got = sorted((r.work_id, t, r.cite_counts[i], r.unrelated[i], r.related[i]) for r in rows for i, t in enumerate(years) if r.pub_year is None or t >= r.pub_year)
    want = sorted(tuple(r) for r in Q.exposures(spark, d).select("work_id", "year", "cite_counts", "unrelated", "related").collect())
    assert got == want and any(r[4] > r[2] for r in got)
    nodes, pairs = B.histories(spark, d, Q.START, Q.END)
    assert pairs.count() == pairs.distinct().count() > 0 and P.stocks(nodes, pairs, Q.START, Q.END).count() == sum(r.pub_year is None or r.pub_year <= Q.END for r in rows)


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, "")
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_r9_is_that_of_rows_in_fewer_jobs(spark, tmp_path, monkeypatch):
    d = tables(spark, tmp_path)
    got, few = jobs(spark, "r9 units", lambda: sorted(map(tuple, Q.r9_effect_variants(spark, d).collect())))
    monkeypatch.setattr(B, "histories", lambda *_: None)
    want, many = jobs(spark, "r9 rows", lambda: sorted(map(tuple, Q.r9_effect_variants(spark, d).collect())))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)
    assert few * 2 < many and few <= 45


def test_q9_is_that_of_rows_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    d, before = tables(spark, tmp_path), shuffles(spark)
    got = sorted(map(tuple, Q.q9_two_way_effects(spark, d).collect()))
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - before
    monkeypatch.setattr(B, "histories", lambda *_: None)
    want = sorted(map(tuple, Q.q9_two_way_effects(spark, d).collect()))
    assert [(*r[:2], *r[5:]) for r in got] == [(*r[:2], *r[5:]) for r in want] and np.allclose([r[2:5] for r in got], [r[2:5] for r in want], atol=2e-6)


def test_works_that_share_a_key_are_left_to_rows(spark, tmp_path):
    d = tables(spark, tmp_path, twice=True)
    assert B.histories(spark, d, Q.START, Q.END) is None
    assert Q.r9_effect_variants(spark, d).count() == 4
