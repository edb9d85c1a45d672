"""Extractive answers: question type, relevant sentences, composition with citations, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.text import ANSWER_STOPWORDS, clip, contained, fold, keywords, sentences
from tillage.operators.ranking import focus_class, greedy_keep

# What makes a question of one type; the first that fits decides.
QUESTION_TYPES = [
    ("definicion", r"\b(que es|definicion|describe|describir)\b"),
    ("accion", r"\b(como|cuando|paso|pasos|protocolo|recomenda|aplica|aplicar|controla|prevenir|gestionar|manejar)\b"),
    (
        "parametro",
        r"\b(temperatura|humedad|ph|conductividad|riego|fertilizacion|dosis|profundidad|densidad|distancia|ciclo|dias|edad|altitud|luz|nutriente|n|p|k|mg|ca|microelemento)\b"
    ),
]
HEADERS = {
    "definicion": "Definición de «{}»:", "parametro": "Parámetros agronómicos relevantes para «{}»:",
    "accion": "Pasos y recomendaciones para «{}»:", "general": "Hallazgos en la biblioteca para «{}»:"
}


def question_type(query: Column) -> Column:
    t, out = fold(query), F.lit("general")
    for name, pattern in reversed(QUESTION_TYPES):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def relevant_sentences(text: Column, terms: Column, most: Column) -> Column:
    """The sentences with most terms, earlier ones first among equals; without any, the first sentence."""
    all_of = sentences(text)
    scored = F.transform(all_of, lambda s, i: F.struct((-contained(terms, fold(s))).alias("n"), i.alias("i"), s.alias("s")))
    hit = F.array_sort(F.filter(scored, lambda x: x["n"] < 0))
    chosen = F.transform(F.slice(hit, F.lit(1), most), lambda x: x["s"])
    return F.when(F.size(hit) > 0, chosen).otherwise(F.slice(all_of, 1, 1))


def _terms(query: Column, focus: str | None) -> Column:
    own = keywords(query, ANSWER_STOPWORDS)
    return own if not focus else F.when(F.array_contains(own, focus), own).otherwise(F.concat(F.array(F.lit(focus)), own))


def citation(number: Column, author: Column, title: Column, doc: Column, page: Column) -> Column:
    name = F.when(
        author.isNotNull() & title.isNotNull(), F.concat(author, F.lit(', "'), title, F.lit('"'))
    ).when(title.isNotNull(), F.concat(F.lit('"'), title, F.lit('"'))).otherwise(F.coalesce(
        author, F.concat(F.lit("Documento "), F.substring(doc.cast("string"), 1, 16), F.lit("..."))
    ))
    return F.concat_ws(" — ", F.concat(F.lit("["), number.cast("string"), F.lit("]")), name, F.concat(F.lit("p. "), page.cast("string")))


def citation_struct(
    number: Column, doc: Column, fragment: Column, score: Column, title: Column, author: Column, page: Column, bbox: Column,
    place: dict[str, Column]
) -> Column:
    """What a citation points at; the page 0 is none. place: table_id, row, col, figure_id, caption; cells only count
    with their table, captions with their figure."""
    table, figure = place["table_id"], place["figure_id"]
    return F.struct(
        F.concat(F.lit("cite_"), number.cast("string")).alias("citation_id"), F.coalesce(doc.cast("string"), F.lit("unknown")).alias("doc_id"), fragment.alias("fragment_id"),
        F.coalesce(score, F.lit(0.0)).alias("score"), title.alias("doc_title"), author.alias("doc_author"), F.nullif(page, F.lit(0)).alias("page"), bbox.alias("bbox"),
        table.alias("table_id"), F.when(table.isNotNull(), place["row"]).alias("row"), F.when(table.isNotNull(), place["col"]).alias("col"),
        figure.alias("figure_id"), F.when(figure.isNotNull(), place["caption"]).alias("caption"),
    )


def concatenated(hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, context, citations): a query's first fragments one after the other, numbered, and their sources.

    hits: query_id, rank, doc_id, page, text.
    """
    first = hits.where(F.col("rank") <= most)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown"))
    item = F.struct(
        "rank", F.coalesce("text", F.lit("")).alias("text"), F.substring(doc, 1, 8).alias("doc"),
        F.coalesce(F.col("page").cast("string"), F.lit("?")).alias("page")
    )
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    number = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
    return listed.select(
        "query_id", F.array_join(F.transform("x", lambda e, i: F.concat(number(i), e["text"])), "\n\n").alias("context"),
        F.transform("x", lambda e, i: F.concat(number(i), F.lit("Documento "), e["doc"], F.lit(", página "), e["page"])).alias("citations"),
    )


def faithfulness(answer: Column, bodies: Column) -> Column:
    """Share of the answer's sentences of which some body holds three long words; four places."""
    words = lambda s: F.filter(F.regexp_extract_all(fold(s), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3)
    all_of, folded = sentences(answer), F.transform(bodies, lambda b: fold(b))
    backed = F.filter(all_of, lambda s: F.exists(folded, lambda b: (F.size(words(s)) >= 3) & (contained(words(s), b) >= 3)))
    return F.when((F.size(all_of) > 0) & (F.size(bodies) > 0), F.round(F.size(backed) / F.size(all_of), 4)).otherwise(0.0)


def in_focus(hits: DataFrame, focus: Column, hints: Column, rank: str = "rank") -> DataFrame:
    """hits ranked anew: those of the crop in focus first, then those without hints, with several, with another;
    inside a class as before."""
    order = Window.partitionBy("query_id").orderBy(focus_class(focus, hints), rank)
    return hits.withColumn("_rank", F.row_number().over(order).cast("long")).drop(rank).withColumnRenamed("_rank", rank)


def compose(hits: DataFrame, queries: DataFrame, fragments: int = 3, focus: str | None = None) -> DataFrame:
    """One answer for each query: (query_id, question_type, answer, faithfulness, warning). A crop in focus counts
    as the first of the query's keywords.

    hits: (query_id, rank, doc_id, text, author, title, page); queries: (query_id, query). Hits are
    de-duplicated in rank order, the first `fragments` give one or two sentences as bullets with their
    number, and numbered sources follow. A query without hits gets no row.
    """
    kept = greedy_keep(hits, ["query_id"], "rank", F.col("doc_id"), F.col("page"), F.lit(None).cast("string"), F.col("text"), per_title=1 << 30)
    order = Window.partitionBy("query_id").orderBy("rank")
    top = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fragments)
    asked = queries.withColumn("question_type", question_type(F.col("query"))).withColumn("terms", _terms(F.col("query"), focus))
    both = top.join(F.broadcast(asked), "query_id")
    per = F.when(F.col("question_type").isin("parametro", "accion"), 2).otherwise(1)
    bullets = F.transform(
        relevant_sentences(F.coalesce("text", F.lit("")), F.col("terms"), per),
        lambda s: F.concat(F.lit("- "), clip(s), F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    )
    parts = both.withColumn("bullets", bullets).withColumn("source", citation(F.col("n"), F.col("author"), F.col("title"), F.col("doc_id"), F.col("page")))
    listed = parts.groupBy("query_id", "query", "question_type").agg(F.array_sort(F.collect_list(F.struct("n", "bullets", "source", "text"))).alias("x"))
    header = F.lit(None).cast("string")
    for name, pattern in HEADERS.items():
        a, z = pattern.split("{}")
        header = F.when(F.col("question_type") == name, F.concat(F.lit(a), F.trim("query"), F.lit(z))).otherwise(header)
    body = F.array_join(F.array_distinct(F.flatten(F.transform("x", lambda e: e["bullets"]))), "\n")
    answer = F.concat(header, F.lit("\n\n"), body, F.lit("\n\nFuentes:\n"), F.array_join(F.transform("x", lambda e: e["source"]), "\n"))
    done = listed.withColumn("answer", answer).withColumn(
        "faithfulness", faithfulness(F.col("answer"), F.transform("x", lambda e: F.coalesce(e["text"], F.lit(""))))
    )
    return done.select("query_id", "question_type", "answer", "faithfulness", F.when(F.col("faithfulness") < 0.55, "baja_fidelidad").alias("warning"))
