"""Fixed-effects least squares over DataFrames.

The first way (units: many levels) is absorbed by its means. The other ways
(years, ages, factors: few levels) are dummies whose moments, less those of their
unit means, come from two aggregations; their effects are solved for on the
driver, subtracted, and the units' means taken off once more. What is left has no
group mean in any way, so one turn does, and the means are measured again to say
so. Only if the other ways have more than MAX_LEVELS levels is each way demeaned in
turn until nothing is left.

Rows are brought together by unit once: units of MAX_ROWS rows at most are kept as
one row with an array each, and all that follows is done within these rows or is a
sum over them. With larger units means are joined to rows instead, so no task
needs a whole group. A fit takes its moments by cluster, once for all its models.

A fit may be split by a column: all its groups are absorbed and measured in the
same aggregations. Weights are those of rows in every mean and moment. Only sums by
level reach the driver.

Rows with a null in a way, the column that splits, a weight or a variable, and
rows without a weight above 0, take no part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import cut, once, passing, quantiles, ranked

#: Levels of all ways but the first, in all groups of a split fit, that are solved for at once.
MAX_LEVELS = 20_000
#: Of one group: its matrix has the square of that.
MAX_GROUP_LEVELS = 2_000
#: Rows of a unit that is kept as an array.
MAX_ROWS = 4_096
#: Units that are rows, worked on at once.
UNITS = 16_384


def _mean(column: str, weight: str | None) -> Column:
    return F.sum(F.col(weight) * F.col(column)) / F.sum(weight) if weight else F.avg(column)


def demean(df: DataFrame, columns: list[str], key: str | list[str], weight: str | None = None) -> DataFrame:
    """columns less their means over the key's groups."""
    keys = [key] if isinstance(key, str) else key
    means = df.groupBy(*keys).agg(*(_mean(c, weight).alias(f"_{c}") for c in columns))
    return df.join(means, keys).select(*(F.col(c) - F.col(f"_{c}") if c in columns else F.col(c) for c in df.columns)).toDF(*df.columns)


def _by_level(df: DataFrame, key: str, ways: list[str], *sums: Column) -> DataFrame:
    """key, _level, the sums over the rows of each level of each way, and _k, the way's place."""
    return reduce(DataFrame.unionByName, (df.groupBy(key, F.col(way).cast("string").alias("_level")).agg(*sums).withColumn("_k", F.lit(k)) for k, way in enumerate(ways)))


class _Effects:
    """The dummies of all ways but the first: by group their labels, weights, and the inverse of their moments within units.

    rows: by, the ways, _w. shapes: by, _unit (units that have the same rows but for their columns are one), _times (how many), the ways, _w.
    """

    def __init__(self, rows: DataFrame, shapes: DataFrame, ways: list[str], by: str):
        z = lambda k, way: F.struct(F.lit(k).alias("k"), F.col(way).cast("string").alias("level"))
        both = [(k, a, m, b) for k, a in enumerate(ways) for m, b in enumerate(ways) if k <= m]
        raw = reduce(DataFrame.unionByName, (rows.groupBy(by, *dict.fromkeys((a, b))).agg(F.sum("_w").alias("_s")).select(by, z(k, a).alias("_a"), z(m, b).alias("_b"), "_s") for k, a, m, b in both))
        marked = shapes.select(by, "_unit", "_times", "_w", F.explode(F.array(*(z(k, way) for k, way in enumerate(ways)))).alias("_a"))
        held = marked.groupBy(by, "_unit", "_times", "_a").agg(F.sum("_w").alias("_w"))
        own = held.groupBy(by, "_unit", "_times").agg(F.collect_list(F.struct("_a", "_w")).alias("_l"), (F.sum("_w") / len(ways)).alias("_all"))  # levels of a unit: few
        both = own.select(by, "_times", "_all", "_l", F.explode("_l").alias("_x")).select(by, "_times", "_all", "_x", F.explode("_l").alias("_y")).where("_x._a <= _y._a")
        shared = both.groupBy(by, F.col("_x._a").alias("_a"), F.col("_y._a").alias("_b")).agg((-F.sum(F.col("_times") * F.col("_x._w") * F.col("_y._w") / F.col("_all"))).alias("_s"))
        self.places: dict[str, dict[tuple[int, str], int]] = {}
        moments: dict[str, dict] = {}
        for r in raw.unionByName(shared).groupBy(by, "_a", "_b").agg(F.sum("_s").alias("_s")).collect():  # MAX_GROUP_LEVELS squared for a group at most
            at = self.places.setdefault(r[0], {})
            i, j = (at.setdefault((x.k, x.level), len(at)) for x in (r._a, r._b))
            moments.setdefault(r[0], {})[i, j] = r._s
        self.inverses = {}
        for g, at in self.places.items():
            m = np.zeros((len(at), len(at)))
            for (i, j), s in moments[g].items():
                m[i, j] = m[j, i] = s
            self.inverses[g] = np.linalg.pinv(m, rcond=1e-11, hermitian=True)

    def solve(self, sums: dict[str, dict[tuple[int, str], list[float]]]) -> list[tuple]:
        """Rows (group, way, level, effect on each column)."""
        out = []
        for g, own in sums.items():
            at = self.places[g]
            right = np.zeros((len(at), len(next(iter(own.values())))))
            for label, s in own.items():
                right[at[label]] = s
            effects = self.inverses[g] @ right
            out += [(g, k, level, *map(float, effects[i])) for (k, level), i in at.items()]
        return out


class _Arrays:
    """Rows brought together by unit: one row for each unit, with its rows as an array and the means of its columns."""

    def __init__(self, rows: DataFrame, columns: list[str], unit: str, small: list[str], weight: str | None, key: str):
        self.rows, self.columns, self.unit, self.small, self.weight, self.key = rows, columns, unit, small, weight, key
        inside = [c for c in rows.columns if c not in (key, unit)]
        w = F.col(weight) if weight else F.lit(1.0)
        means = (_mean(c, weight).alias(f"_m{i}") for i, c in enumerate(columns))
        # rows meet before they are collected: arrays that are made on the way would be sorted twice
        met = rows.repartition(key, unit).groupBy(key, unit)
        self.units = cut(met.agg(F.collect_list(F.struct(*inside)).alias("_rows"), F.sum(w).alias("_n"), *means))
        self.effects: dict[tuple, list[float]] = {}

    def levels(self) -> dict:
        return {r[0]: r[1] for r in self.units.groupBy(self.key).agg(F.count("*")).collect()}

    def add(self, effects: list[tuple]) -> None:
        for g, k, level, *e in effects:
            self.effects[g, k, level] = [a + b for a, b in zip(self.effects.get((g, k, level), [0.0] * len(e)), e, strict=True)]

    def left(self) -> DataFrame:
        """The rows with columns without units' means and the effects so far."""
        units, size = self.units, range(len(self.columns))
        shift = [F.lit(0.0)] * len(self.columns)
        if self.effects:
            kind = units.schema[self.key].dataType.simpleString()
            spread = units.sparkSession.createDataFrame([(g, k, level, e) for (g, k, level), e in self.effects.items()], f"_g {kind}, _k int, _level string, _e array<double>")  # MAX_LEVELS at most
            maps = spread.groupBy("_g").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("_k") == k, F.struct("_level", "_e")))).alias(f"_map{k}") for k in range(len(self.small))))
            w = lambda r: r[self.weight] if self.weight else F.lit(1.0)
            of = lambda r: reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), (F.element_at(f"_map{k}", r[way].cast("string")) for k, way in enumerate(self.small)))
            units = units.join(F.broadcast(maps), F.col(self.key) == F.col("_g")).withColumn("_e", F.transform("_rows", of))
            total = F.aggregate(F.arrays_zip("_rows", "_e"), F.array(*(F.lit(0.0) for _ in size)), lambda a, z: F.zip_with(a, z["_e"], lambda x, y: x + w(z["_rows"]) * y))
            units = units.withColumn("_total", total).select(self.key, self.unit, "_n", *(f"_m{i}" for i in size), "_total", F.inline(F.arrays_zip("_rows", "_e")))
            shift = [F.col("_e")[i] - F.col("_total")[i] / F.col("_n") for i in size]
        else:
            units = units.select(self.key, self.unit, "_n", *(f"_m{i}" for i in size), F.explode("_rows").alias("_rows"))
        place = {c: F.col(f"_rows.{c}") - F.col(f"_m{i}") - shift[i] for i, c in enumerate(self.columns)}
        return units.select(*(F.col(c) if c in (self.key, self.unit) else place.get(c, F.col(f"_rows.{c}")).alias(c) for c in self.rows.columns))

    def shapes(self) -> DataFrame:
        """For _Effects: units that have the same levels and weights in all rows are counted."""
        shape = F.sort_array(F.transform("_rows", lambda r: F.struct(*(r[way].alias(way) for way in self.small), (r[self.weight] if self.weight else F.lit(1.0)).alias("_w"))))
        kinds = self.units.select(self.key, shape.alias("_shape")).groupBy(self.key, "_shape").agg(F.count("*").cast("double").alias("_times"))
        return cut(kinds.withColumn("_unit", F.monotonically_increasing_id())).select(self.key, "_unit", "_times", F.inline("_shape"))


class _Joined:
    """The same for units of any size: means and effects are joined to rows."""

    def __init__(self, rows: DataFrame, columns: list[str], unit: str, small: list[str], weight: str | None, key: str):
        self.columns, self.unit, self.small, self.weight, self.key = columns, unit, small, weight, key
        self.now = cut(demean(rows, columns, [key, unit], weight))

    def levels(self) -> dict:
        return {r[0]: r[1] for r in self.now.groupBy(self.key).agg(F.count_distinct(self.unit)).collect()}

    def add(self, effects: list[tuple]) -> None:
        out = self.now
        kinds = ", ".join([f"{self.key} {out.schema[self.key].dataType.simpleString()}", "_k int", "_level string", *(f"_e{i} double" for i in range(len(self.columns)))])
        table = out.sparkSession.createDataFrame(effects, kinds)
        for k, way in enumerate(self.small):
            one = table.where(F.col("_k") == k).drop("_k")
            out = out.withColumn("_level", F.col(way).cast("string")).join(one, [self.key, "_level"])
            out = out.withColumns({c: F.col(c) - F.col(f"_e{i}") for i, c in enumerate(self.columns)}).drop("_level", *(f"_e{i}" for i in range(len(self.columns))))
        self.now = cut(demean(out, self.columns, [self.key, self.unit], self.weight))

    def left(self) -> DataFrame:
        return self.now

    def shapes(self) -> DataFrame:
        return self.now.select(self.key, F.col(self.unit).alias("_unit"), F.lit(1.0).alias("_times"), *self.small, (F.col(self.weight) if self.weight else F.lit(1.0)).alias("_w"))


def _absorbed(df: DataFrame, columns: list[str], ways: list[str], tolerance: float, passes: int, weight: str | None, key: str) -> tuple[DataFrame, int, float, dict]:
    """df without the effects, the turns, the greatest mean left, and the levels of all ways by group."""
    small = ways[1:]
    rows = df.dropna(subset=[*dict.fromkeys([key, *ways, *columns, *([weight] if weight else [])])])
    if weight:
        rows = rows.where(F.col(weight) > 0)
    rows = rows.select(*(F.col(c).cast("double").alias(c) if c in columns or c == weight else F.col(c) for c in rows.columns))
    largest = rows.groupBy(key, ways[0]).agg(F.count("*").alias("_k")).agg(F.max("_k")).first()[0] or 0
    held = (_Arrays if largest <= MAX_ROWS and not {key, ways[0]} & {*columns, weight} else _Joined)(rows, columns, ways[0], small, weight, key)
    levels = held.levels()
    if not small:
        return held.left(), 1, 0.0, levels
    w = F.col(weight) if weight else F.lit(1.0)
    effects, turn = None, 0
    while True:
        out = held.left()
        found = _by_level(out, key, small, F.sum(w).alias("_w"), *(F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(columns))).limit(MAX_LEVELS + 1).collect()
        if effects is None:
            each: dict = {}
            for r in found:
                each[r[0]] = each.get(r[0], 0) + 1
            if len(found) > MAX_LEVELS or max(each.values(), default=0) > MAX_GROUP_LEVELS:
                out, turn, worst = _alternating(out, columns, ways, tolerance, passes, weight, key)
                return out, turn, worst, {r[0]: sum(r[1:]) for r in out.groupBy(key).agg(*(F.count_distinct(c) for c in ways)).collect()}
            levels = {g: n + each.get(g, 0) for g, n in levels.items()}
        sums: dict[str, dict] = {}
        worst = 0.0
        for r in found:
            s = [r[f"_s{i}"] for i in range(len(columns))]
            sums.setdefault(r[0], {})[r["_k"], r["_level"]] = s
            worst = max(worst, *(abs(x / r["_w"]) for x in s))
        if worst <= tolerance or turn >= passes:
            return out, turn, worst, levels
        turn += 1
        effects = effects or _Effects(out.select(key, *small, w.alias("_w")), held.shapes(), small, key)
        held.add(effects.solve(sums))


def absorbed(df: DataFrame, columns: list[str], ways: list[str], tolerance: float = 1e-8, passes: int = 30, weight: str | None = None, by: str | None = None) -> tuple[DataFrame, int, float]:
    """df with columns without the effects of the ways (the one with most levels first); the turns it took; the greatest group mean left."""
    out, turn, worst, _ = _absorbed(df if by else df.withColumn("_by", F.lit("")), columns, ways, tolerance, passes, weight, by or "_by")
    return out.select(*(c for c in out.columns if by or c != "_by")), turn, worst


def _alternating(out: DataFrame, columns: list[str], ways: list[str], tolerance: float, passes: int, weight: str | None, by: str) -> tuple[DataFrame, int, float]:
    """Each way demeaned in turn until every group mean is below the tolerance."""
    turn, worst = 0, math.inf
    while turn < passes and worst > tolerance:
        turn += 1
        for way in ways:
            out = demean(out, columns, [by, way], weight)
        out = cut(out)
        worst = 0.0  # the last way's means are 0, the others' tell
        for way in ways[:-1]:
            means = out.groupBy(by, way).agg(*(F.abs(_mean(c, weight)).alias(c) for c in columns))
            worst = max(worst, means.agg(F.max(F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))).first()[0] or 0.0)
    return out, turn, worst


def absorb(df: DataFrame, columns: list[str], ways: list[str], tolerance: float = 1e-8, passes: int = 30, weight: str | None = None) -> DataFrame:
    return absorbed(df, columns, ways, tolerance, passes, weight)[0]


@dataclass
class Fit:
    names: list[str]
    beta: list[float]
    se: list[float]
    p: list[float]
    low: list[float]
    high: list[float]
    within_r2: float
    n: int
    groups: int
    #: Passes of absorption, and if no group mean above the tolerance was left.
    passes: int = 0
    converged: bool = True


def _fit(x: list[str], b: np.ndarray, bread: np.ndarray, meat: np.ndarray | None, sse: float, syy: float, n: int, groups: int, absorbed: int) -> Fit:
    """From sums over the rows; meat: of the clusters' scores, None for plain errors."""
    free = max(1, n - absorbed - len(x))
    variance = bread * sse / free if meat is None else (groups / (groups - 1) * (n - 1) / free if groups > 1 else 1.0) * bread @ meat @ bread
    se = np.sqrt(np.maximum(np.diag(variance), 0.0))
    p = [math.erfc(abs(u) / s / math.sqrt(2)) if s > 0 else 1.0 for u, s in zip(b, se, strict=True)]
    return Fit(x, b.tolist(), se.tolist(), p, (b - 1.96 * se).tolist(), (b + 1.96 * se).tolist(), float(1 - sse / syy) if syy > 0 else 0.0, n, groups)


def ols(df: DataFrame, y: str, x: list[str], cluster: str | None = None, absorbed: int = 0, weight: str | None = None) -> Fit:
    """Least squares of columns as they are (no intercept), with cluster-robust or plain standard errors."""
    fits = _fits(df.withColumn("_by", F.lit("")), y, [x], cluster, {"": absorbed}, weight, "_by")[0]
    return fits[""] if fits else Fit(x, [0.0] * len(x), [0.0] * len(x), [1.0] * len(x), [0.0] * len(x), [0.0] * len(x), 0.0, 0, 0)


def _fits(df: DataFrame, y: str, sets: list[list[str]], cluster: str | None, absorbed: dict[str, int], weight: str | None, by: str) -> list[dict]:
    """For each set of regressors a fit for each group of by, all from the moments of the clusters: one pass over the rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    names = list(dict.fromkeys([*(c for x in sets for c in x), y]))
    size = range(len(names))
    at = lambda i, j: f"_{min(i, j)}_{max(i, j)}"
    entries = [(i, j) for i in size for j in size if i <= j]
    products = [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(at(i, j)) for i, j in entries]
    total = lambda some: some.groupBy(by).agg(F.sum("_n").cast("bigint").alias("_n"), F.count("*").alias("_g"), *(F.sum(at(*e)).alias(at(*e)) for e in entries))
    moments = df.groupBy(by, *([cluster] if cluster else [])).agg(F.count("*").alias("_n"), *products)
    if cluster:
        moments = cut(moments)
    rows = {r[0]: r for r in total(moments).collect()}  # one for each group of a split fit
    if not rows:
        return [{} for _ in sets]
    full = {g: np.array([[r[at(i, j)] or 0.0 for j in size] for i in size], float) for g, r in rows.items()}
    places = [[names.index(c) for c in x] for x in sets]
    last = names.index(y)
    inverse = [{g: np.linalg.pinv(m[np.ix_(p, p)]) for g, m in full.items()} for p in places]
    beta = [{g: inv[g] @ full[g][p, last] for g in full} for p, inv in zip(places, inverse, strict=True)]
    kinds = ", ".join([f"{by} {df.schema[by].dataType.simpleString()}", *(f"_b{m}_{i} double" for m, p in enumerate(places) for i in range(len(p)))])
    known = df.sparkSession.createDataFrame([(g, *(float(v) for b in beta for v in b[g])) for g in full], kinds)
    if cluster:  # a cluster's score of x is its moment with y less what the fit explains of it
        score = lambda m, i: F.col(at(places[m][i], last)) - sum((F.col(f"_b{m}_{j}") * F.col(at(places[m][i], q)) for j, q in enumerate(places[m])), F.lit(0.0))
        with_b = moments.join(F.broadcast(known), by).select(by, *(score(m, i).alias(f"_s{m}_{i}") for m, p in enumerate(places) for i in range(len(p))))
        meat = with_b.groupBy(by).agg(F.count("*").alias("_g"), *(F.sum(F.col(f"_s{m}_{i}") * F.col(f"_s{m}_{j}")).alias(f"_v{m}_{i}_{j}") for m, p in enumerate(places) for i in range(len(p)) for j in range(i, len(p))))
        sums = {r[0]: r for r in meat.collect()}
    else:
        error = lambda m: F.col(y) - sum((F.col(f"_b{m}_{i}") * F.col(c) for i, c in enumerate(sets[m])), F.lit(0.0))
        sums = {r[0]: r for r in df.join(F.broadcast(known), by).groupBy(by).agg(F.count("*").alias("_g"), *(F.sum(w * error(m) * error(m)).alias(f"_e{m}") for m in range(len(sets)))).collect()}
    out: list[dict] = []
    for m, (x, p) in enumerate(zip(sets, places, strict=True)):
        k, made = len(x), {}
        for g, r in rows.items():
            n, b, bread = r["_n"], beta[m][g], inverse[m][g]
            if cluster:
                sse = max(0.0, float(full[g][last, last] - 2 * b @ full[g][p, last] + b @ full[g][np.ix_(p, p)] @ b))
                v = np.array([[sums[g][f"_v{m}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float).reshape(k, k)
            else:
                sse, v = sums[g][f"_e{m}"] or 0.0, None
            made[g] = _fit(x, b, inverse[m][g], v, sse, float(full[g][last, last]), n, r["_g"] if cluster else n, absorbed.get(g, 0))
        out.append(made)
    return out


def split_models(df: DataFrame, y: str, sets: list[list[str]], ways: list[str], cluster: str | None, by: str, tolerance: float = 1e-8, passes: int = 30, weight: str | None = None) -> dict[str, list[Fit]]:
    """For each group of by a fit for each set of regressors, over one absorption of all groups; degrees of freedom count every group of every way but one each after the first."""
    columns = list(dict.fromkeys([y, *(c for x in sets for c in x)]))
    data = df.select(*dict.fromkeys([by, *ways, *([cluster] if cluster else []), *([weight] if weight else []), *columns]))
    with passing(df.sparkSession):
        free, turns, worst, found = _absorbed(data, columns, ways, tolerance, passes, weight, by)
        levels = {g: n - (len(ways) - 1) for g, n in found.items()}
        fits = _fits(free, y, sets, cluster, levels, weight, by)
    return {g: [replace(one[g], passes=turns, converged=worst <= tolerance) for one in fits] for g in fits[0]}


def models(df: DataFrame, y: str, sets: list[list[str]], ways: list[str], cluster: str | None, **options) -> list[Fit]:
    """A fit for each set of regressors over one absorption."""
    return next(iter(split_models(df.withColumn("_by", F.lit("")), y, sets, ways, cluster, "_by", **options).values()))


@dataclass(frozen=True)
class Design:
    """A fit over units that are rows: the units' own effects (or not), effects of the ways, errors clustered by unit.

    cells makes of a task's rows, by column, a matrix of each regressor, y and way, with a row for each unit (ways hold whole numbers), and of which cells count.
    """

    y: str
    sets: list[list[str]]
    ways: list[str]
    cells: Callable[[dict[str, np.ndarray]], tuple[dict[str, np.ndarray], np.ndarray]]
    within: bool = True

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.y, *(c for x in self.sets for c in x)]))


def _matrix(column) -> np.ndarray:
    """An Arrow column of numbers (nulls are NaN), or of lists of them that are equally long, a row of a matrix each."""
    if hasattr(column.type, "value_type"):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


class _Levels:
    """The levels of all ways in some cells: their labels, and for each way the place among them of each cell."""

    def __init__(self, ways: list[np.ndarray]):
        self.labels, self.at = [], []
        for k, values in enumerate(ways):
            known, at = np.unique(values, return_inverse=True)
            self.at.append(at.reshape(-1) + len(self.labels))
            self.labels += [f"{k}:{int(v)}" for v in known]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of cells (rows) by level."""
        return sum(np.column_stack([np.bincount(at, v, len(self.labels)) for v in values.T]) for at in self.at)


def _sums(design: Design, known: tuple | None, table: dict[str, np.ndarray]) -> Iterator[tuple[str, str, float]]:
    """(a, b, sum): without known effects and slopes the moments within units of columns and levels; with them those of what is left, and of the scores."""
    made, counts = design.cells(table)
    counts = np.asarray(counts, bool)
    unit, _ = np.nonzero(counts)
    if not len(unit):
        return
    _, unit = np.unique(unit, return_inverse=True)
    size = np.bincount(unit).astype(float)
    mean = lambda v: np.column_stack([np.bincount(unit, c, len(size)) for c in v.T]) / size[:, None]
    freed = lambda v: v - mean(v)[unit] if design.within else v
    names, levels = design.columns, _Levels([np.asarray(made[way])[counts] for way in design.ways])
    values = freed(np.column_stack([np.asarray(made[c], float)[counts] for c in names]))
    yield "n", "", float(len(unit))
    yield "g", "", float(len(size))
    if len(levels.labels) > MAX_GROUP_LEVELS:
        yield "many", "", 1.0
        return
    if known is None:
        total = len(levels.labels)
        raw = sum(np.bincount(a * total + b, minlength=total * total) for a in levels.at for b in levels.at).astype(float).reshape(total, total)
        if design.within:
            some = max(1, 1_000_000 // total)  # units at once
            for at in range(0, len(size), some):
                own = slice(*np.searchsorted(unit, [at, at + some]))
                held = sum(np.bincount((unit[own] - at) * total + a[own], minlength=some * total) for a in levels.at).reshape(-1, total)[: len(size) - at]
                raw -= (held / size[at : at + some, None]).T @ held
        for i, j in zip(*np.nonzero(raw), strict=True):
            yield levels.labels[i], levels.labels[j], float(raw[i, j])
        shares = zip(levels.labels, levels.sums(values), strict=True)
    else:
        effects, slopes = known
        none = np.zeros(len(names))
        spread = np.array([effects.get(label, none) for label in levels.labels]).reshape(len(levels.labels), len(names))
        values = values - freed(sum((spread[at] for at in levels.at), np.zeros_like(values)))
        shares = zip(levels.labels, levels.sums(values), strict=True)
        for label, n in zip(levels.labels, levels.sums(np.ones((len(values), 1)))[:, 0], strict=True):
            yield label, "n", float(n)
        for m, (x, b) in enumerate(zip(design.sets, slopes, strict=True)):
            its = values[:, [names.index(c) for c in x]]
            error = values[:, names.index(design.y)] - its @ b
            yield "sse", str(m), float(error @ error)
            scores = mean(its * error[:, None]) * size[:, None]
            for (i, j), v in np.ndenumerate(scores.T @ scores):
                yield f"meat{m}", f"{i},{j}", float(v)
    for label, own in shares:
        for c, v in enumerate(own):
            yield label, f"x{c}", float(v)
    for (i, j), v in np.ndenumerate(values.T @ values):
        yield f"x{i}", f"x{j}", float(v)


def unit_fits(df: DataFrame, designs: dict[str, Design], tolerance: float = 1e-8, passes: int = 30) -> dict[str, list[Fit]] | None:
    """By design a fit for each set of regressors, over rows that are units: no row moves, and all designs share two passes over them.

    The first takes the moments of columns and dummies, from which effects and slopes come; the second measures what is left
    and takes the scores, again if anything is left. None if a design has more than MAX_GROUP_LEVELS levels.
    """
    known: dict[str, tuple | None] = dict.fromkeys(designs)
    inverses: dict[str, tuple[list[str], np.ndarray]] = {}
    levels: dict[str, int] = {}
    out: dict[str, list[Fit]] = {}
    turns = 0
    while known:
        some, columns = {name: (designs[name], known[name]) for name in known}, df.columns

        def run(batches, some=some, columns=columns):
            def whole():
                held: list = []
                for b in batches:
                    if b.num_rows:
                        held.append(dict(zip(columns, map(_matrix, b.columns), strict=True)))
                    if sum(len(t[columns[0]]) for t in held) >= UNITS:
                        yield held
                        held = []
                if held:
                    yield held

            total: dict = {}
            for held in whole():
                table = {c: np.concatenate([t[c] for t in held]) for c in columns}
                for name, (design, now) in some.items():
                    for a, b, s in _sums(design, now, table):
                        total[name, a, b] = total.get((name, a, b), 0.0) + s
            if total:
                names, a, b = (list(c) for c in zip(*total, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(total.values()), pa.float64())], ["design", "a", "b", "s"])

        found: dict[str, dict] = {name: {} for name in known}
        with once(df.sparkSession):
            for r in df.mapInArrow(run, "design string, a string, b string, s double").groupBy("design", "a", "b").agg(F.sum("s").alias("s")).collect():  # MAX_GROUP_LEVELS squared for a design at most
                found[r[0]][r[1], r[2]] = r[3]
        for name, s in found.items():
            design, size = designs[name], len(designs[name].columns)
            if ("many", "") in s:
                return None
            moments = np.array([[s.get((f"x{i}", f"x{j}"), 0.0) for j in range(size)] for i in range(size)])
            labels = sorted({a for a, b in s if ":" in a and b == "x0"})
            shares = np.array([[s[a, f"x{c}"] for c in range(size)] for a in labels]).reshape(len(labels), size)
            places = [[design.columns.index(c) for c in x] for x in design.sets]
            if known[name] is None:
                if len(labels) > MAX_GROUP_LEVELS:
                    return None
                inverses[name] = labels, np.linalg.pinv(np.array([[s.get((a, b), 0.0) for b in labels] for a in labels]).reshape(len(labels), len(labels)), rcond=1e-11, hermitian=True)
                levels[name] = len(labels) + (int(s.get(("g", ""), 0)) if design.within else 0) - (len(design.ways) + design.within - 1)
                solved = inverses[name][1] @ shares
                moments = moments - shares.T @ solved
                known[name] = dict(zip(labels, solved, strict=True)), _slopes_of(moments, places)
                continue
            worst = max((abs(x) / s[a, "n"] for a, own in zip(labels, shares, strict=True) for x in own), default=0.0)
            effects, slopes = known[name]
            again = _slopes_of(moments, places)
            if turns < passes and (worst > tolerance or any(not np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(slopes, again, strict=True))):
                solved = dict(zip(labels, inverses[name][1] @ shares, strict=True))
                known[name] = {a: e + solved[a] for a, e in effects.items()}, again
                continue
            n, groups = int(s.get(("n", ""), 0)), int(s.get(("g", ""), 0))
            out[name] = []
            for m, (x, p) in enumerate(zip(design.sets, places, strict=True)):
                meat = np.array([[s.get((f"meat{m}", f"{i},{j}"), 0.0) for j in range(len(x))] for i in range(len(x))]).reshape(len(x), len(x))
                fit = _fit(x, slopes[m], np.linalg.pinv(moments[np.ix_(p, p)]), meat, s.get(("sse", str(m)), 0.0), float(moments[0, 0]), n, groups, levels[name])
                out[name].append(replace(fit, passes=turns, converged=bool(worst <= tolerance)))
        known = {name: now for name, now in known.items() if name not in out}
        turns += 1
    return {name: out[name] for name in designs}


def _slopes_of(moments: np.ndarray, places: list[list[int]]) -> list[np.ndarray]:
    """For each set of regressors, from moments in which y is the first."""
    return [np.linalg.pinv(moments[np.ix_(p, p)]) @ moments[p, 0] for p in places]


def fixed_effects(df: DataFrame, y: str, x: list[str], ways: list[str], cluster: str | None, **options) -> Fit:
    return models(df, y, [x], ways, cluster, **options)[0]


def factor_fit(df: DataFrame, y: str, x: list[str], factor: str | None, weight: str | None = None) -> list[tuple[str, float, float]]:
    """(term, beta, se) of weighted least squares with an intercept and a factor, with plain errors: slopes, the factor's levels against its first, and the constant.

    The factor is absorbed; the constant is that of its first level.
    """
    way = factor or "_one"
    data = df if factor else df.withColumn("_one", F.lit("1"))
    data = data.withColumn(way, F.col(way).cast("string")).dropna(subset=[way, y, *x, *([weight] if weight else [])])
    data = data.where(F.col(weight) > 0) if weight else data
    fit = fixed_effects(data, y, x, [way], None, weight=weight)
    w = F.col(weight) if weight else F.lit(1.0)
    means = data.groupBy(way).agg(F.sum(w).alias("w"), *(_mean(c, weight).alias(f"m{i}") for i, c in enumerate([y, *x]))).orderBy(way).collect()  # the factor's levels
    free, turns, _ = absorbed(data, [y, *x], [way], weight=weight)
    gram = free.agg(*(F.sum(w * F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)), F.sum(w * (F.col(y) - sum((F.lit(b) * F.col(c) for b, c in zip(fit.beta, x, strict=True)), F.lit(0.0))) ** 2).alias("sse")).first()
    inverse = np.linalg.pinv(np.array([[gram[f"{i}_{j}"] for j in range(len(x))] for i in range(len(x))], float).reshape(len(x), len(x)))
    sigma = gram["sse"] / max(1, fit.n - len(x) - len(means))
    level = {r[0]: (r["w"], r["m0"] - sum(b * r[f"m{i + 1}"] for i, b in enumerate(fit.beta)), np.array([r[f"m{i + 1}"] for i in range(len(x))])) for r in means}
    base = level[means[0][0]]
    out = list(zip(x, fit.beta, fit.se, strict=True))
    for r in means[1:]:
        n, effect, at = level[r[0]]
        apart = at - base[2]
        out.append((f"{factor}={r[0]}", effect - base[1], math.sqrt(sigma * (1 / n + 1 / base[0] + apart @ inverse @ apart))))
    return [*out, ("constant", base[1], math.sqrt(sigma * (1 / base[0] + base[2] @ inverse @ base[2])))]


def winsorize(df: DataFrame, columns: list[str], q: float = 0.99, tops: dict[str, float] | None = None) -> DataFrame:
    """columns cut at their upper q-quantile (linear between values), or at tops, if these are known."""
    tops = tops or quantiles(df, columns, q)
    return df.withColumns({c: F.least(F.col(c).cast("double"), F.lit(tops[c])) for c in columns})


def variants(df: DataFrame, y: str, x: list[str], unit: list[str], age: str, ages: list[int]) -> dict[str, DataFrame]:
    """The panel as it is, of units with all these ages, and with outcome, regressors or all cut at their 99th percentile."""
    tops = quantiles(df, [y, *x], 0.99)
    return {"full": df, "balanced": complete_ages(df, unit, age, ages), **{name: winsorize(df, c, tops=tops) for name, c in (("outcome_winsorized", [y]), ("exposure_winsorized", x), ("all_winsorized", [y, *x]))}}


def by_group(df: DataFrame, dimensions: dict[str, Column], y: str, sets: list[list[str]], ways: list[str], cluster: str, **options) -> list[tuple[str, str, list[Fit]]]:
    """Fits for each level of each dimension (null levels are left out), all in one pass: a row counts once in each dimension."""
    levels = F.array(*(F.struct(F.lit(name).alias("dimension"), level.cast("string").alias("level")) for name, level in dimensions.items()))
    rows = df.withColumn("_x", F.explode(levels)).where("_x.level is not null").withColumn("_group", F.to_json("_x")).drop("_x")
    made = split_models(rows, y, sets, ways, cluster, "_group", **options)
    return sorted((v["dimension"], v["level"], fits) for g, fits in made.items() for v in [json.loads(g)])


def first_differences(df: DataFrame, unit: list[str], time: str, columns: list[str]) -> DataFrame:
    """Changes from one year to the next; rows of which the year before is missing go."""
    w = W.partitionBy(*unit).orderBy(time)
    lagged = df.withColumns({"_t": F.lag(time).over(w), **{f"_{c}": F.lag(c).over(w) for c in columns}}).where(F.col(time) == F.col("_t") + 1)
    return lagged.withColumns({c: F.col(c) - F.col(f"_{c}") for c in columns}).drop("_t", *(f"_{c}" for c in columns))


def complete_ages(df: DataFrame, unit: list[str], age: str, ages: list[int]) -> DataFrame:
    """Rows at these ages of units that have all of them."""
    rows = df.where(F.col(age).isin(ages))
    full = rows.groupBy(*unit).agg(F.size(F.collect_set(age)).alias("_k")).where(F.col("_k") == len(ages)).select(*unit)
    return rows.join(full, unit, "left_semi")


def binned_means(df: DataFrame, x: str, y: str, tie: list[str], bins: int = 20) -> DataFrame:
    """bin, n, x, y: means over equal-count bins in order of x."""
    rows = cut(ranked(df.withColumn("_all", F.lit(1)), ["_all"], [x, *tie]))
    n = F.lit(rows.count())
    ranks = rows.withColumn("i", F.col("rank") - 1)
    # the first n mod bins groups have one more
    size, extra = F.floor(n / bins), n % bins
    upto = extra * (size + 1)
    number = F.when(F.col("i") < upto, F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - upto) / F.greatest(size, F.lit(1))))
    return ranks.withColumn("bin", number.cast("int") + 1).groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def partial_out(df: DataFrame, y: str, x: str, controls: list[str]) -> tuple[DataFrame, float]:
    """y and x without what the controls explain, and the partial R squared of x."""
    if controls:
        fits = {c: ols(df, c, controls).beta for c in (y, x)}
        df = df.withColumns({c: F.col(c) - sum((F.lit(b) * F.col(k) for b, k in zip(fits[c], controls, strict=True)), F.lit(0.0)) for c in (y, x)})
    return df, ols(df, y, [x]).within_r2
