"""Sensor series: three definitions of the latest row, roll-ups, gap filling, rolling figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_max_id(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Definition A: the row with the largest id of each key, by one aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), id_col).alias("_r")).select(key, "_r.*")


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int = 1, place: str | None = None) -> DataFrame:
    """The first n rows of each key in the given order; Spark limits each partition before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return out.withColumnRenamed("_n", place) if place else out.drop("_n")


def latest_by_ts(rows: DataFrame, key: str, ts: str, id_col: str) -> DataFrame:
    """Definition B: by time; its ties, undefined at the origin, go to the smaller id."""
    return newest(rows, [key], [F.desc(ts), F.col(id_col)])


def latest_by_ts_id(rows: DataFrame, key: str, ts: str, id_col: str) -> DataFrame:
    """Definition C: by time to the second, then the larger id."""
    return newest(rows, [key], [F.date_trunc("SECOND", F.col(ts)).desc(), F.desc(id_col)])


def latest_metrics(rows: DataFrame, key: str, metric: str, value: str, ts: str, names: dict[str, str], id_col: str = "event_id") -> DataFrame:
    """One row for each key with the newest value of every metric: one pass instead of a subquery for each."""
    return rows.groupBy(key).agg(
        *[F.max_by(value, F.when(F.col(metric) == m, F.struct(F.col(ts), F.col(id_col)))).alias(out) for m, out in names.items()],
        F.max(ts).alias("created_at")
    )


def daily(rows: DataFrame, ts: str, value: str, extra: list[Column] = ()) -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day"), *extra).agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"))


def filled(days: DataFrame, fill: DataFrame, key: str = "day") -> DataFrame:
    """days, and the rows of fill for days they lack, told apart by `source`."""
    lacking = fill.join(days.select(key), key, "left_anti")
    return days.withColumn("source", F.lit("parcel")).unionByName(lacking.withColumn("source", F.lit("global")), allowMissingColumns=True)


def not_repeated(rows: DataFrame, by: list[str], text: str, ts: str, id_col: str, minutes: int) -> DataFrame:
    """Rows that do not say again what the row before them with their key said so many minutes ago or less."""
    w = Window.partitionBy(*by).orderBy(ts, id_col)
    marked = rows.withColumns({"_ts": F.lag(ts).over(w), "_text": F.lag(text).over(w)})
    again = (F.col("_text") == F.col(text)) & (F.col(ts) <= F.col("_ts") + F.make_interval(mins=F.lit(minutes)))
    return marked.where(F.col("_ts").isNull() | ~F.coalesce(again, F.lit(False))).drop("_ts", "_text")


def parcel(latest: DataFrame, whole: DataFrame, metrics: list[str], unfilled: tuple[str, ...] = ("light",)) -> DataFrame:
    """One row: the mean of the crops' latest readings by metric, gaps filled from `whole` (one row), some never."""
    own = latest.agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("crops"))
    one = F.broadcast(whole.select(*[F.col(m).alias(f"_{m}") for m in metrics]))
    return own.crossJoin(one).select(*[F.col(m) if m in unfilled else F.coalesce(m, f"_{m}").alias(m) for m in metrics], "crops")


def series(rows: DataFrame, fill: DataFrame, ts: str, value: str, since: Column, limit: int) -> DataFrame:
    """Daily means since a day, the newest `limit` days, and those of fill for the days that are missing."""
    own = daily(rows.where(F.to_date(ts) >= since), ts, value).orderBy(F.desc("day")).limit(limit)
    return filled(own, daily(fill.where(F.to_date(ts) >= since), ts, value))


def week(ts: Column) -> Column:
    """The Monday that starts the ISO week."""
    return F.to_date(F.date_trunc("WEEK", ts))


def weekly_latest(rows: DataFrame, key: str, ts: str, id_col: str, weeks: int = 24) -> DataFrame:
    """The newest reading of each week, of the newest `weeks` weeks."""
    by_week = rows.withColumn("week", week(F.col(ts)))
    best = newest(by_week, [key, "week"], [F.desc(ts), F.desc(id_col)])
    return newest(best, [key], [F.desc("week")], weeks)


def buckets(value: Column, bounds: list[float]) -> Column:
    """The upper bound of the histogram bucket, infinity above the last."""
    out = F.lit(float("inf"))
    for b in reversed(bounds):
        out = F.when(value <= b, F.lit(float(b))).otherwise(out)
    return out
