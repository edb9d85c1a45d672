"""Factorial statistics: water capacity, coding, effects, interactions, analysis of variance, least squares."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_capacity(clay: Column, sand: Column, om: Column) -> Column:
    """Water at -33 kPa in percent; the published constant is added twice, as at the origin."""
    c, s = clay / 100, sand / 100
    return (0.299 - 0.251 * s + 0.195 * c + 0.011 * om + 0.006 * s * om - 0.027 * c * om + 0.452 * c * c + 0.299) * 100


def wilting_point(clay: Column, sand: Column, om: Column) -> Column:
    c, s = clay / 100, sand / 100
    return (0.031 - 0.024 * s + 0.487 * c + 0.006 * om + 0.005 * s * om - 0.013 * c * om + 0.068 * c * c + 0.031) * 100


def available_water(clay: Column, sand: Column, om: Column, density: Column, depth: Column) -> Column:
    return (field_capacity(clay, sand, om) - wilting_point(clay, sand, om)) * density * depth / 10


#: Parts that a pass cuts a range of values into.
_BINS = 1024


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0) of the finite numbers of columns, exactly.

    Each pass counts the values in parts of the range that holds the rank, and goes on with the one part where it lies, from
    the least to the largest value there, until these are the same. Tasks hold and return the counts of the parts alone, however many
    different values there are; a double is found in a few passes.
    """
    columns = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in ranks}
    ends = df.agg(*[f(v).alias(f"{c}|{n}") for c, v in columns.items() for n, f in (("low", F.min), ("high", F.max))]).first()
    todo = [[c, r, ends[f"{c}|low"], ends[f"{c}|high"], 0] for c, rs in ranks.items() for r in sorted(set(rs)) if ends[f"{c}|low"] is not None]
    found: dict[tuple[str, int], float] = {}
    while todo:
        found |= {(c, r): low for c, r, low, high, _ in todo if low == high}
        todo = [t for t in todo if t[2] != t[3]]
        if not todo:
            break
        # halves keep differences of large numbers finite
        bins = [F.least(F.lit(_BINS - 1), F.floor((columns[c] / 2 - low / 2) / (high / 2 - low / 2) * _BINS)).cast("int") for c, _, low, high, _ in todo]
        inside = [F.when(columns[c].between(low, high), F.struct(F.lit(i).alias("t"), b.alias("bin"), columns[c].alias("v"))) for i, ((c, _, low, high, _), b) in enumerate(zip(todo, bins))]
        each = df.select(F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("x")).select("x.*")
        parts: dict[int, list] = {}
        for row in each.groupBy("t", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():  # 1,024 rows a rank
            parts.setdefault(row["t"], []).append(row)
        for i, t in enumerate(todo):
            for row in sorted(parts[i], key=lambda x: x["bin"]):
                if t[4] + row["n"] > t[1]:
                    t[2], t[3] = row["low"], row["high"]
                    break
                t[4] += row["n"]
    return found


def quantiles(df: DataFrame, asked: dict[str, list[float]]) -> dict[tuple[str, float], float | None]:
    """Exact quantiles of columns, between neighbouring values by interpolation; null for a column without finite numbers."""
    finite = lambda c: F.count(F.when(F.abs(F.col(c).cast("double")) < float("inf"), 1)).alias(c)
    counts = df.agg(*[finite(c) for c in asked]).first()
    at = {(c, p): p * (counts[c] - 1) for c, ps in asked.items() if counts[c] for p in ps}
    ranks: dict[str, list[int]] = {}
    for (c, _), x in at.items():
        ranks.setdefault(c, []).extend((math.floor(x), math.ceil(x)))
    values = order_statistics(df, ranks) if ranks else {}

    def between(c: str, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        return values[c, low] if low == high else (high - x) * values[c, low] + (x - low) * values[c, high]

    return {(c, p): between(c, at[c, p]) if (c, p) in at else None for c, ps in asked.items() for p in ps}


def coded(df: DataFrame, factors: list[str]) -> DataFrame:
    """Each factor as -1 below its median, else +1, in a column `<factor>_c`."""
    medians = quantiles(df, {f: [0.5] for f in factors})
    return df.select(*df.columns, *[F.when(F.col(f) < F.lit(medians[f, 0.5]), -1).otherwise(1).alias(f"{f}_c") for f in factors])


def main_effects(df: DataFrame, factors: list[str], y: str) -> DataFrame:
    """(factor, effect, mean and population deviation of both levels, counts)."""
    long = df.select(
        y, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"{f}_c").alias("level")) for f in factors])).alias("x")
    ).select(y, "x.factor", "x.level")
    at = lambda fn, level: fn(F.when(F.col("level") == level, F.col(y)))
    g = long.groupBy("factor").agg(
        at(F.avg, 1).alias("mean_high"), at(F.avg, -1).alias("mean_low"), at(F.stddev_pop, 1).alias("std_high"),
        at(F.stddev_pop, -1).alias("std_low"), at(F.count, 1).alias("n_high"), at(F.count, -1).alias("n_low")
    )
    return g.withColumn("effect", F.col("mean_high") - F.col("mean_low"))


def interactions(df: DataFrame, factors: list[str], y: str) -> DataFrame:
    """(first, second, effect) of every pair; an empty cell counts as 0."""
    pairs = list(combinations(factors, 2))
    mean = lambda a, b, i, j: F.coalesce(F.avg(F.when((F.col(f"{a}_c") == i) & (F.col(f"{b}_c") == j), F.col(y))), F.lit(0.0))
    one = df.agg(*[(((mean(a, b, 1, 1) + mean(a, b, -1, -1)) - (mean(a, b, 1, -1) + mean(a, b, -1, 1))) / 2).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("effect")) for a, b in pairs
    ])).alias("x")).select("x.*")


def anova(df: DataFrame, factors: list[str], y: str) -> DataFrame:
    """(factor, f): one-way F of both levels, from sums."""
    e = main_effects(df, factors, y)
    n, total = F.col("n_high") + F.col("n_low"), F.col("n_high") * F.col("mean_high") + F.col("n_low") * F.col("mean_low")
    between = F.col("n_high") * F.pow(F.col("mean_high") - total / n, 2) + F.col("n_low") * F.pow(F.col("mean_low") - total / n, 2)
    within = F.col("n_high") * F.pow("std_high", 2) + F.col("n_low") * F.pow("std_low", 2)
    return e.select("factor", (between / (within / (n - 2))).alias("f"), (n - 2).alias("df"))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f), by the continued fraction of the incomplete beta function."""
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    p = front * h
    return 1 - p if flip else p


def least_squares(df: DataFrame, factors: list[str], y: str) -> tuple[np.ndarray, dict[str, float]]:
    """Coefficients (intercept first) and fit of y on coded factors: one pass of sums, a small system on the driver."""
    x = [F.lit(1.0), *[F.col(f"{f}_c").cast("double") for f in factors]]
    k = len(x)
    sums = df.agg(
        *[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(x[i] * F.col(y)).alias(f"b{i}") for i in range(k)], F.sum(F.col(y) * F.col(y)).alias("yy")
    ).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([sums[f"b{i}"] for i in range(k)])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    n, rss = a[0, 0], max(float(sums["yy"] - beta @ b), 0.0)
    tss = float(sums["yy"] - b[0] ** 2 / n)
    predicted = sum((float(c) * v for c, v in zip(beta, x)), F.lit(0.0))
    mae = df.agg(F.avg(F.abs(F.col(y) - predicted)).alias("m")).first()["m"]
    return beta, {"r2": 1 - rss / tss if tss > 0 else 0.0, "rmse": math.sqrt(rss / n), "mae": float(mae)}


def durbin_watson(df: DataFrame, residual: str, by: str, order: list[str]) -> DataFrame:
    """(by, dw) of residuals in order within each key.

    Rows are dealt to tasks by ranges of (key, order), so a key with most of the rows is spread. A task returns, for each of
    its keys, the sums of its piece and the piece's first and last residual; the step from a piece to the next one is added where
    the pieces meet. A null residual is no value: it has no square and no difference.
    """
    kind = df.schema[by].dataType.simpleString()

    def pieces(it):
        import pyarrow as pa
        from pyspark import TaskContext

        rows: list[list] = []  # key, squared differences, squares, first, last
        for b in it:
            if not len(b.column(0)):
                continue
            keys = b.column(0).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy()
            x = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(x)]
            for i, j in zip(cuts, cuts[1:]):
                key = keys.dictionary[int(codes[i])].as_py() if codes[i] >= 0 else None
                steps, squares = np.nansum(np.diff(x[i:j]) ** 2), np.nansum(x[i:j] ** 2)
                if rows and rows[-1][0] == key:
                    edge = (x[i] - rows[-1][4]) ** 2
                    rows[-1][1:] = [rows[-1][1] + steps + (0.0 if np.isnan(edge) else edge), rows[-1][2] + squares, rows[-1][3], x[j - 1]]
                else:
                    rows.append([key, steps, squares, x[i], x[j - 1]])
        if rows:
            columns = list(zip(*rows))
            own = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64())
            ends = [pa.array(np.array(c), from_pandas=True) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), own, pa.array(columns[1]), pa.array(columns[2]), *ends], ["key", "piece", "steps", "squares", "first", "last"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(df.schema[by].dataType)
    slim = df.select(F.col(by).alias("key"), F.col(residual).cast("double").alias("x"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    sort = ["key", *[f"o{i}" for i in range(len(order))]]
    dealt = slim.repartitionByRange(*sort).sortWithinPartitions(*sort).select("key", "x")
    found = dealt.mapInArrow(pieces, f"key {kind}, piece long, steps double, squares double, first double, last double")
    # a row for each task that holds a part of the key
    step = F.col("first") - F.lag("last").over(Window.partitionBy("key").orderBy("piece"))
    joined = found.withColumn("edge", step * step).groupBy("key").agg(F.sum(F.col("steps") + F.coalesce("edge", F.lit(0.0))).alias("d"), F.sum("squares").alias("s"))
    return joined.select(F.col("key").alias(by), F.when(F.col("s") > 0, F.col("d") / F.col("s")).alias("dw"))


def levene(df: DataFrame, group: str, y: str) -> DataFrame:
    """One row, the mean-centred statistic of homogeneity of variances."""
    m = df.groupBy(group).agg(F.avg(y).alias("_m"))
    z = df.join(F.broadcast(m), group).select(group, F.abs(F.col(y) - F.col("_m")).alias("z"))  # one row for each level
    g = z.groupBy(group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    t = g.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq")
    )
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    return t.select(((F.col("n") - F.col("k")) / (F.col("k") - 1) * between / F.col("within")).alias("levene"))


# The rational approximation of the normal quantile (its central and tail parts), and the
# polynomials of the Shapiro-Wilk weights and of the distribution of the statistic.
_CENTRE = ([3.3871327179, 50.434271938, 159.29113202, 59.109374720], [1.0, 17.895169469, 78.757757664, 67.187563600])
_TAIL = ([1.4234372777, 2.7568153900, 1.3067284816, 0.17023821103], [1.0, 0.73700164250, 0.12021132975])
_FAR = ([6.6579051150, 3.0812263860, 0.42868294337, 0.017337203997], [1.0, 0.24197894225, 0.012258202635])
_FIRST = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
_SECOND = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_SMALL = ([0.544, -0.39978, 0.025054, -6.714e-4], [1.3822, -0.77857, 0.062767, -0.0020322], [-2.273, 0.459])
_LARGE = ([-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302])


def _poly(coefficients: list[float], x):
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, to about seven digits."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    centre = q * _poly(_CENTRE[0], 0.180625 - q * q) / _poly(_CENTRE[1], 0.180625 - q * q)
    tail = F.when(r <= 5, _poly(_TAIL[0], r - 1.6) / _poly(_TAIL[1], r - 1.6)).otherwise(_poly(_FAR[0], r - 5) / _poly(_FAR[1], r - 5))
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -tail).otherwise(tail))


def ranked(df: DataFrame, x: str, parts: int = 48) -> tuple[DataFrame, int]:
    """df with `_rank`, the place of x in ascending order from 1, and the number of rows; rows without x are left out.

    Places are counted inside ranges of x that hold about the same number of rows, so no task sorts everything;
    a value that many rows share stays in one range.
    """
    rows = df.where(F.col(x).isNotNull())
    edges = rows.agg(F.percentile_approx(x, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts)).alias("e")).first()["e"] or []
    table = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>")
    marked = rows.withColumn("_part", F.size(F.filter(table, lambda e: e < F.col(x))))
    counts = {r["_part"]: r["n"] for r in marked.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before long"))  # at most `parts` rows
    place = F.row_number().over(Window.partitionBy("_part").orderBy(x)) + F.col("_before")
    return marked.join(offsets, "_part").withColumn("_rank", place).drop("_part", "_before"), total


def shapiro_wilk(df: DataFrame, x: str) -> tuple[float, float]:
    """The statistic and its p-value for at least three values; 1 and 1 where all are equal.

    Weights come from the places in order, so everything is one pass of sums over ranked values.
    """
    placed, n = ranked(df.select(F.col(x).cast("double").alias(x)), x)
    if n < 3:
        raise ValueError("at least three values")
    m = normal_quantile((F.col("_rank") - 0.375) / (n + 0.25))
    if n == 3:
        ends = {1: -math.sqrt(0.5), 3: math.sqrt(0.5)}
        own, factor = {**ends, 2: 0.0}, 1.0
    else:
        spread, first, second = (float(v) for v in placed.agg(
            F.sum(m * m), F.max(F.when(F.col("_rank") == n, m)), F.max(F.when(F.col("_rank") == n - 1, m))
        ).first())
        root, rsn = math.sqrt(spread), 1 / math.sqrt(n)
        a1 = _poly(_FIRST, rsn) + first / root
        own = {n: a1, 1: -a1}
        if n > 5:
            a2 = _poly(_SECOND, rsn) + second / root
            own |= {n - 1: a2, 2: -a2}
            factor = math.sqrt((spread - 2 * first**2 - 2 * second**2) / (1 - 2 * a1**2 - 2 * a2**2))
        else:
            factor = math.sqrt((spread - 2 * first**2) / (1 - 2 * a1**2))
    weight = m / factor
    for place, a in own.items():
        weight = F.when(F.col("_rank") == place, a).otherwise(weight)
    one = placed.agg(F.sum(weight * F.col(x)).alias("s"), (F.var_pop(x) * n).alias("ss")).first()
    if not one["ss"]:
        return 1.0, 1.0
    w = min(1.0, one["s"] ** 2 / one["ss"])
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        gamma = _poly(_SMALL[2], n)
        if y >= gamma:
            return w, 1e-19
        y, mean, deviation = -math.log(gamma - y), _poly(_SMALL[0], n), math.exp(_poly(_SMALL[1], n))
    else:
        mean, deviation = _poly(_LARGE[0], ln), math.exp(_poly(_LARGE[1], ln))
    return w, 0.5 * math.erfc((y - mean) / deviation / math.sqrt(2))


def optimum(beta: np.ndarray, factors: list[str]) -> tuple[dict[str, int], float]:
    """The level of each factor that raises the response, and the response predicted there."""
    levels = {f: 1 if b > 0 else -1 for f, b in zip(factors, beta[1:])}
    return levels, float(beta[0] + sum(abs(b) for b in beta[1:]))
