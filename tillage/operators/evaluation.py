"""Retrieval metrics over arrays: precision, recall, reciprocal rank, nDCG, entity coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_at(pred: Column, gold: Column, k: int) -> Column:
    """Hits by the length of the top list, which may be shorter than k."""
    top = F.slice(pred, 1, k)
    return F.when(F.size(top) > 0, F.size(F.filter(top, lambda x: F.array_contains(gold, x))) / F.size(top)).otherwise(0.0)


def recall_at(pred: Column, gold: Column, k: int) -> Column:
    top = F.slice(pred, 1, k)
    return F.when(F.size(gold) > 0, F.size(F.filter(gold, lambda x: F.array_contains(top, x))) / F.size(gold)).otherwise(0.0)


def reciprocal_rank(pred: Column, gold: Column) -> Column:
    """Of the first gold id, in gold order, that was returned at all; not of the best placed one."""
    first = F.get(F.filter(gold, lambda x: F.array_contains(pred, x)), 0)
    return F.coalesce(1.0 / F.nullif(F.array_position(pred, first), F.lit(0)), F.lit(0.0))


def ndcg_at(pred: Column, gold: Column, k: int) -> Column:
    """Against the best order of what was returned: gold that is missing does not count."""
    gains = F.transform(pred, lambda x: F.when(F.array_contains(gold, x), 1.0).otherwise(0.0))
    dcg = lambda g: F.aggregate(F.transform(F.slice(g, 1, k), lambda x, i: x / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)
    ideal = dcg(F.sort_array(gains, asc=False))
    return F.when(ideal > 0, dcg(gains) / ideal).otherwise(0.0)


def entity_coverage_at(asked: Column, found: Column, k: int) -> Column:
    q = F.array_distinct(asked)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.flatten(F.slice(found, 1, k)))) / F.size(q)).otherwise(0.0)


def per_query(gold: DataFrame, pred: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Metrics of each query in both inputs; of repeated queries the last row, by `n`, counts.

    gold: query, n, gold_ids, query_entities; pred: query, n, pred_ids, pred_entities, faithfulness.
    Entity coverage and faithfulness are null for queries that do not supply them.
    """
    last = lambda df: df.groupBy("query").agg(F.max_by(
        F.struct(*[c for c in df.columns if c not in ("query", "n")]), "n"
    ).alias("r")).select("query", "r.*")
    both = last(gold).join(last(pred), "query")
    p, g = F.col("pred_ids"), F.col("gold_ids")
    given = (F.size(F.coalesce("query_entities", F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce("pred_entities", F.array().cast("array<array<string>>"))) > 0)
    columns = []
    for k in ks:
        columns += [
            precision_at(p, g, k).alias(f"precision_{k}"), recall_at(p, g, k).alias(f"recall_{k}"), ndcg_at(p, g, k).alias(f"ndcg_{k}"),
            F.when(given, entity_coverage_at(F.col("query_entities"), F.col("pred_entities"), k)).alias(f"entity_coverage_{k}")
        ]
    return both.select("query", *columns, reciprocal_rank(p, g).alias("mrr"), "faithfulness")


def summary(metrics: DataFrame) -> DataFrame:
    """(metric, value): the mean over the queries that supply the metric, and how many queries there are."""
    names = [c for c in metrics.columns if c != "query"]
    one = metrics.agg(F.count("*").cast("double").alias("queries_evaluated"), *[F.avg(c).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("queries_evaluated", *names)])).alias("x")
    return one.select(pairs).select("x.metric", "x.value").where("value is not null")


def canary_ranks(hits: DataFrame, fragments: DataFrame, canaries: DataFrame, modes: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(mode, query_id, found, rank_of_canary): where the first hit with the planted string stands, from 0; -1 if none.

    hits: mode, query_id, id, rank, the few that a search returns; canaries: query_id, needle.
    """
    met = hits.join(canaries, "query_id").join(fragments.select(id_col, text_col), id_col).where(F.contains(F.coalesce(F.col(text_col), F.lit("")), F.col("needle")))
    first = met.groupBy("mode", "query_id").agg(F.min("rank").alias("_rank"))
    every = canaries.select("query_id", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    joined = every.join(first, ["mode", "query_id"], "left")
    return joined.select("mode", "query_id", F.col("_rank").isNotNull().alias("found"), (F.coalesce("_rank", F.lit(0)) - 1).alias("rank_of_canary"))


def audit(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: fragments, distinct documents, titles in rank order, whether nothing was found.

    hits: query_id, rank, doc, title, the few that a search returns; queries: query_id, query and whatever else.
    """
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.coalesce("title", F.substring(F.col("doc").cast("string"), 1, 8)).alias("title")))),
        lambda x: x["title"]
    )
    found = hits.groupBy("query_id").agg(F.count("*").alias("_n"), F.count_distinct("doc").alias("_docs"), listed.alias("_titles"))
    joined = queries.join(found, "query_id", "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select(
        *queries.columns, n.alias("n_fragments"), F.coalesce("_docs", F.lit(0)).alias("unique_docs"),
        F.coalesce("_titles", F.array().cast("array<string>")).alias("titles"), (n == 0).alias("insufficient")
    )
