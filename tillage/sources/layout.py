"""Page layout as data: union boxes, column gaps, reading order of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_box(blocks: DataFrame, by: list[str]) -> DataFrame:
    return blocks.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def column_gaps(blocks: DataFrame, columns: int, page_width: float) -> DataFrame:
    """(page, gap, at): the columns - 1 widest gaps between neighbouring left edges, of at least 8 % of the width or 30 points."""
    edges = blocks.select("page", "x0").distinct()
    ahead = edges.withColumn("next", F.lead("x0").over(Window.partitionBy("page").orderBy("x0")))
    gaps = ahead.where(F.col("next") - F.col("x0") > max(0.08 * page_width, 30.0)).select(
        "page", (F.col("next") - F.col("x0")).alias("gap"), ((F.col("next") + F.col("x0")) / 2).alias("at")
    )
    best = Window.partitionBy("page").orderBy(F.desc("gap"), "at")
    return gaps.withColumn("n", F.row_number().over(best)).where(F.col("n") < columns).drop("n")


def column_cuts(blocks: DataFrame, page_width: float) -> DataFrame:
    """(page, cuts): where the columns of a page part, none for a single column.

    The two widest gaps between the centres of neighbouring blocks cut a page of at least six blocks in three,
    the widest one of at least four in two, if all are at least 8 % of the width and 30 points and the centres
    spread by a tenth of the width. A page's blocks are one list.
    """
    least = max(0.08 * page_width, 30.0)
    centers = F.array_sort(F.collect_list((F.col("x0") + F.col("x1")) / 2))
    pages = blocks.groupBy("page").agg(centers.alias("c"), F.stddev_samp((F.col("x0") + F.col("x1")) / 2).alias("spread"))
    gaps = F.transform(
        F.slice("c", 1, F.size("c") - 1), lambda c,
        i: F.struct((c - F.get("c", i + 1)).alias("less"), ((c + F.get("c", i + 1)) / 2).alias("at"))
    )
    widest = lambda n: F.slice("gaps", 1, n)
    wide_enough = lambda n: (F.size("c") >= 2 * (n + 1)) & F.forall(widest(n), lambda g: -g["less"] >= least)
    places = lambda n: F.array_sort(F.transform(widest(n), lambda g: g["at"]))
    many = (F.size("c") >= 4) & (F.col("spread") >= 0.1 * page_width)
    cuts = F.when(many & wide_enough(2), places(2)).when(many & wide_enough(1), places(1)).otherwise(F.array().cast("array<double>"))
    return pages.withColumn("gaps", F.array_sort(gaps)).select("page", cuts.alias("cuts"))


def reading_order(blocks: DataFrame, page_width: float, wide: float = 0.78, tie: str = "x1") -> DataFrame:
    """blocks with `column` and `place`: columns are parted at a page's gaps; a wide block stands between what begins
    above it and what does not; inside such a band column by column, then downwards. Where a column would be
    empty, the page has one column and is read downwards. Blocks at one place go by `tie`.
    """
    cut = blocks.join(column_cuts(blocks, page_width), "page")
    center = (F.col("x0") + F.col("x1")) / 2
    cut = cut.withColumn("wide", ((F.col("x1") - F.col("x0")) >= wide * page_width) & (F.size("cuts") > 0))
    cut = cut.withColumn("column", F.when(F.col("wide"), -1).otherwise(F.size(F.filter("cuts", lambda c: center >= c))))
    page = Window.partitionBy("page")
    used = F.size(F.collect_set(F.when(~F.col("wide"), F.col("column"))).over(page))
    single = (F.size("cuts") == 0) | (used <= F.size("cuts"))
    cut = cut.withColumn("single", single)
    # wide blocks that begin at or above a block come before it
    above = F.sum(F.when(F.col("wide"), 1).otherwise(0)).over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.sum(F.when(F.col("wide"), 1).otherwise(0)).over(page.orderBy("y0", "x0", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    band = F.when(F.col("single"), 0).when(F.col("wide"), 2 * nth - 1).otherwise(2 * above)
    column = F.when(F.col("single"), 0).when(F.col("wide"), 0).otherwise(F.col("column"))
    placed = cut.withColumn("band", band).withColumn("column", column.cast("int"))
    order = page.orderBy("band", "column", "y0", "x0", tie)
    return placed.withColumn("place", F.row_number().over(order)).select(*blocks.columns, "column", "place")
