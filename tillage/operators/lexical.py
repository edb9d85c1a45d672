"""Lexical index and search: postings, corpus statistics, BM25."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.stemming import stem
from tillage.functions.text import stripped, tokens
from tillage.session import kept


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(posted: DataFrame, id_col: str) -> DataFrame:
    return posted.groupBy("term").agg(F.count(id_col).alias("df"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n documents, avgdl mean length in tokens."""
    return docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(
    docs: DataFrame, queries: list[tuple[int, str]], id_col: str = "doc_id", text_col: str = "text", k: int = 100, k1: float = 1.5,
    b: float = 0.75, keep=None
) -> DataFrame:
    """(query_id, id, score, rank): the best k documents of each query with a positive score.

    Repeated query words count as often as they occur; n, df and avgdl are those of all documents even
    where `keep` (a condition on docs) filters what may be returned. One reading of docs: the words that some query
    holds are counted by document and stored, and both the terms' figures and the scores come from that table.
    queries is a list given by the caller, so what is collected and broadcast, a row a term, is bounded.
    """
    asked = docs.sparkSession.createDataFrame(queries, "query_id long, query string").select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    return _scored(docs, asked, tokens(F.col(text_col)), id_col, k, k1, b, keep)


#: Word forms up to this number are broadcast, more of them meet the texts' words in a shuffle join.
BROADCAST_FORMS = 100_000
#: First characters that a word shares with its stem.
SAME = 2


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf, dl, average: float, k1: float, b: float):
    """The part of a term's weight that a document gets: grows with tf, falls with the length dl."""
    norm = (1 - b) + dl * (b / average) if average else F.lit(1.0)
    return tf * (k1 + 1) / (tf + norm * k1)


def _scored(docs: DataFrame, asked: DataFrame, words: Column, id_col: str, k: int, k1: float = 1.5, b: float = 0.75, keep=None, stems: bool = False) -> DataFrame:
    """bm25 for asked (query_id, term). With stems terms are stems, else words."""
    spark = docs.sparkSession
    times = asked.groupBy("query_id", "term").agg(F.count("*").alias("times")).collect()  # the caller's few queries
    terms = sorted({r["term"] for r in times})
    # every document counts once under the empty term, which is no word: its rows give n and avgdl
    looked = spark.createDataFrame([("", ""), *([] if stems else [(t, t) for t in terms])], "word string, term string")
    allowed = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    sized = docs.select(F.col(id_col), allowed.alias("_keep"), words.alias("_words"))
    each = sized.select(id_col, "_keep", F.size("_words").alias("_dl"), F.explode(F.array_append("_words", F.lit(""))).alias("word"))
    if stems:
        # the words that begin as some term does are counted and stored; only their forms are stemmed
        near = F.col("word").substr(1, SAME).isin("", *sorted({t[:SAME] for t in terms}))
        each = kept(each.where(near).groupBy(id_col, "_keep", "_dl", "word").agg(F.count("*").alias("tf")))
        forms = each.where("word != ''").select("word").distinct().withColumn("term", stem(F.col("word")))
        forms = kept(forms.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select("word", "term"))
        looked = looked.union(forms)
        looked = F.broadcast(looked) if forms.count() <= BROADCAST_FORMS else looked
        held = each.join(looked, "word").groupBy(id_col, "_keep", "_dl", "term").agg(F.sum("tf").alias("tf"))
    else:
        held = each.join(F.broadcast(looked), "word").groupBy(id_col, "_keep", "_dl", "term").agg(F.count("*").alias("tf"))
    held = kept(held)
    sums = held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("_dl")).alias("dl"))
    figures = {r["term"]: r for r in sums.collect()}  # a row a term
    n = figures[""]["n"] if "" in figures else 0
    average = figures[""]["dl"] / n if n else 0.0
    weight = {t: idf(n, figures[t]["df"] if t in figures else 0) for t in terms}
    weights = spark.createDataFrame([(r["query_id"], r["term"], r["times"] * weight[r["term"]]) for r in times], "query_id long, term string, weight double")
    part = F.col("weight") * saturation(F.col("tf"), F.col("_dl"), average, k1, b)
    scored = held.where(F.col("_keep") & (F.col("term") != "")).join(F.broadcast(weights), "term").groupBy("query_id", id_col).agg(F.round(F.sum(part), 9).alias("score"))
    return best(scored, id_col, k)


def best(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k rows of each query with the highest positive score, ranked; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


# Words that the stopping analyser leaves out.
STOP_WORDS = (
    "a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we when will with yet you your"
).split()


def analysed_search(
    docs: DataFrame, queries: list[tuple[int, str]], id_col: str = "doc_id", text_col: str = "text", k: int = 100, labels_col: str | None = None, stop: list[str] = (), least: int = 1
) -> DataFrame:
    """BM25 over Spanish stems: plural and inflected forms of a query's words count as those words.

    The vocabulary is stemmed, not the texts. Labels (an array column) are searched as if they were words of
    the text. With stop and least, words of the list and shorter ones are left out on both sides. Queries are
    read leniently: whatever is no word is ignored. Word forms stay a table that the texts' words are joined with.
    """
    spark = docs.sparkSession
    usable = lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least
    body = F.col(text_col) if labels_col is None else F.concat_ws(" ", F.col(text_col), F.array_join(labels_col, " "))
    words = F.filter(tokens(body), usable)
    asked = spark.createDataFrame(queries, "query_id long, query string").select("query_id", F.explode(F.filter(tokens(F.col("query")), usable)).alias("word"))
    asked = asked.select("query_id", stem(F.col("word")).alias("term"))
    return _scored(docs, asked, words, id_col, k, stems=True)


def indexable(docs: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """What a rebuilt index takes: documents in order inside each task, those without text left out."""
    return docs.where(stripped(F.coalesce(F.col(text_col), F.lit(""))) != "").sortWithinPartitions(*order)


def replaced(index: DataFrame, fresh: DataFrame, id_col: str) -> DataFrame:
    """An index with the rows of `fresh` in place of what it held for those ids (re-index, upsert)."""
    return index.join(fresh.select(id_col).distinct(), id_col, "left_anti").unionByName(fresh, allowMissingColumns=True)


def without(index: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    return index.join(gone.select(id_col).distinct(), id_col, "left_anti")
