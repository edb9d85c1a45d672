"""Row-level operators: composed filters, patches, upserts, cascades, clamps, fuzzy look-ups, import resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filters(**given: tuple[Column, object]) -> Column:
    """The conjunction of column == value for those that are given; None and `todos` mean no filter."""
    parts = [c == v for c, v in given.values() if v is not None and v != "todos"]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def holds(c: Column, part: str | None) -> Column:
    """Whether a text holds the part in any case; nothing to look for is held by all."""
    return F.lit(True) if not part else F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(part.lower()))


def all_tokens_in(tokens: list[str], columns: list[Column]) -> Column:
    """Every token occurs, lower-cased, in at least one of the columns; null columns are empty."""
    lowered = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    anywhere = lambda t: reduce(lambda a, b: a | b, [F.contains(c, F.lit(t.lower())) for c in lowered])
    return reduce(lambda a, b: a & b, [anywhere(t) for t in tokens], F.lit(True))


def recent(ts: Column, as_of: Column, days: int) -> Column:
    return ts >= as_of - F.make_interval(days=F.lit(days))


def clamp(c: Column, low: float, high: float) -> Column:
    """The value within its physical range; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def in_order(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether no lower bound exceeds its upper one; missing bounds are in order."""
    return reduce(lambda a, b: a & b, [F.coalesce(low <= high, F.lit(True)) for low, high in pairs], F.lit(True))


def missing_or(c: Column, value: Column) -> Column:
    """Rows of everybody (null) and those of one."""
    return c.isNull() | F.coalesce(c == value, F.lit(False))


def active(status: Column, strict: bool = True) -> Column:
    """A null status is active. strict: only `activo` counts; else everything but `inactivo`."""
    s = F.coalesce(status, F.lit("activo"))
    return s == "activo" if strict else s != "inactivo"


def limited(n: int, low: int = 1, high: int = 200) -> int:
    """A page size or limit asked for, within its bounds."""
    return max(low, min(high, int(n)))


def facet(rows: DataFrame, column: str, falling: bool = False) -> DataFrame:
    """(facet, value, n, place): the distinct values of a column with their counts, in order."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc(column) if falling else F.asc(column))  # as many rows as there are choices
    return counted.select(
        F.lit(column).alias("facet"), F.col(column).cast("string").alias("value"), "n",
        F.row_number().over(order).cast("long").alias("place")
    )


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Sparse update: a patch's non-null values replace those of the row with its key."""
    p = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in patch.columns if c != key])
    joined = base.join(p, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if f"_new_{c}" in p.columns else F.col(c) for c in base.columns])


def upserted(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of fresh in place of those with their key, and added where there was none."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows that belong to the deleted keys, children included."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(ids, F.col(k) == F.col("_gone"), "left_anti") for name, (df, k) in tables.items()}


def _grams(c: Column, n: int) -> Column:
    """The distinct pieces of n characters."""
    many = F.greatest(F.length(c) - (n - 1), F.lit(0))
    return F.array_distinct(F.transform(
        F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i, F.lit(n))
    ))


def contained_pairs(small: DataFrame, large: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): distinct values of small[a] and large[b] where the latter holds the former, empty ones aside.

    Both sides may be large: each short value goes by the rarest of its three-character pieces (itself, if it is
    shorter), long ones by all of theirs, and what meets is verified.
    """
    x = small.select(a).distinct().where(F.length(a) > 0)
    y = large.select(b).distinct().where(F.length(b) > 0)
    pieces = F.concat(*[_grams(F.col(b), n) for n in (1, 2, 3)])
    of_large = y.select(b, F.explode(pieces).alias("_piece"))
    own = F.when(F.length(a) >= 3, _grams(F.col(a), 3)).otherwise(F.array(a))
    often = of_large.groupBy("_piece").agg(F.count("*").alias("_often"))
    met = x.select(a, F.explode(own).alias("_piece")).join(often, "_piece", "left")
    # a piece that no long value has rules the pair out: it counts as the rarest
    rarest = met.groupBy(a).agg(F.min_by("_piece", F.struct(F.coalesce("_often", F.lit(0)), "_piece")).alias("_piece"))
    return rarest.join(of_large, "_piece").where(F.contains(b, a)).select(a, b)


def best_name_match(
    wanted: DataFrame, profiles: DataFrame, name: str, profile_name: str, value: str, default: int, least: int, both_ways: bool = False
) -> DataFrame:
    """For each wanted name the value of the profile named alike: the same name first, else one that holds it
    (both_ways: or that it holds).

    Ties go to the first profile name. Names meet through equal pieces, so neither side need be small.
    """
    names = wanted.select(F.lower(F.trim(name)).alias("_a")).distinct()
    lowered = profiles.select(F.lower(profile_name).alias("_b"), F.col(profile_name).alias("_profile"), F.col(value).alias("_value"))
    one = lowered.groupBy("_b").agg(F.min(F.struct("_profile", "_value")).alias("_best"))
    pairs = contained_pairs(names, one, "_a", "_b")
    if both_ways:
        pairs = pairs.union(contained_pairs(one, names, "_b", "_a").select("_a", "_b"))
    choice = F.struct((F.col("_a") != F.col("_b")).alias("other"), F.col("_best"))
    found = pairs.join(one, "_b").groupBy("_a").agg(F.min(choice).alias("_choice")).select("_a", F.col("_choice._best._value").alias("_value"))
    joined = wanted.withColumn("_key", F.lower(F.trim(name))).join(found, F.col("_key") == F.col("_a"), "left")
    return joined.select(*wanted.columns, F.when(F.col("_value").isNotNull(), F.greatest(F.lit(least), F.col("_value"))).otherwise(F.lit(default)).alias(value))


def with_wildcard(entities: DataFrame, rules: DataFrame, key: str, wildcard: str = "*") -> DataFrame:
    """Rules of an entity's own key and those of the wildcard: a union of an equi-join and a broadcast of the latter."""
    every = F.broadcast(rules.where(F.col(key) == wildcard).drop(key))  # a reference list
    return entities.join(rules.where(F.col(key) != wildcard), key).unionByName(entities.crossJoin(every))


def resolved(rows: DataFrame, targets: DataFrame, by_id: str, by_place: str, by_name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with target_id found by id, then by place, then by name; and those of which nothing was found.

    targets: id, place, name. Names compare in lower case; of equal names the smallest id counts.
    """
    ids = targets.select(F.col("id").alias("_i"))
    places = targets.select(F.col("place").alias("_p"), F.col("id").alias("_pi"))
    names = targets.groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("_ni"))
    found = rows.join(ids, F.col(by_id) == F.col("_i"), "left").join(places, F.col(by_place) == F.col("_p"), "left").join(names, F.lower(by_name) == F.col("_n"), "left")
    done = found.select(*rows.columns, F.coalesce("_i", "_pi", "_ni").alias("target_id"))
    return done.where("target_id is not null"), done.where("target_id is null").drop("target_id")


def zero_as_null(c: Column) -> Column:
    """Spreadsheet numbers: 0 counts as missing, as at the origin."""
    return F.nullif(c, F.lit(0).cast("double"))
