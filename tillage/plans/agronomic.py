"""Queries of dictionary entities and crop hints, and of the composed answer."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from tillage.functions import text as T
from tillage.operators import entities as E
from tillage.operators import lexical
from tillage.operators import synthesis as Y
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.plans.retrieval import QUERIES
from tillage.plans.texts import WORDS
from tillage.session import kept, table

add = REGISTRY.add
TEXT = "coalesce(text, '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def _found_sql(cte: str, pieces: str, terms: list[tuple[str, str]]) -> str:
    """CTE of (doc_id, type, value, start) from a CTE (doc_id, w, i): w the pieces, i a place."""
    piece = "array_to_string(w[i : i + 2 * len(string_split(value, ' ')) - 2], '')"
    return f"""{cte} AS (SELECT doc_id, type, value, length(array_to_string(w[1 : i - 1], '')) AS start FROM {pieces}, (VALUES {S.values(terms)}) x(type, value)
WHERE w[i] = string_split(value, ' ')[1] AND {piece} = value)"""


def _pieces_sql(text: str) -> str:
    return f"""t AS (SELECT doc_id, {text} AS t FROM documents), p AS (SELECT doc_id, regexp_extract_all(t, '[a-z0-9_]+|[^a-z0-9_]+') AS w FROM t),
o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM p)"""


_NAMED = " Elote con roya amarilla y araña roja; temp 20, NPK n p k"
_THIRD = " zea mays en Oaxaca"
_NAMED_SQL = f"({TEXT} || '{_NAMED}' || CASE WHEN doc_id % 3 = 0 THEN '{_THIRD}' ELSE '' END)"


def _synonyms_sql(text: str) -> str:
    for k, v in sorted(E.SYNONYMS.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        text = rf"regexp_replace({text}, '\b{k}\b', '{v}', 'g')"
    return text


_ALL_TERMS = [(t, v) for t, vs in E.TAXONOMY.items() for v in vs]


@add(
    "agronomic_entities",
    f"WITH {_pieces_sql(_synonyms_sql(S.ascii_only(S.squeeze(_NAMED_SQL))))}, {_found_sql('e', 'o', _ALL_TERMS)} SELECT type, value, count(DISTINCT doc_id) AS docs, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM e GROUP BY ALL",
)
def agronomic_entities(spark, sf_dir):
    """Normalised, synonyms rewritten, entities with their places; a sentence that names some ends every text."""
    text = F.concat("text", F.lit(_NAMED), F.when(F.col("doc_id") % 3 == 0, _THIRD).otherwise(""))
    found = E.entities(_docs(spark, sf_dir), E.TAXONOMY, normal=T.synonyms_applied(S.ascii_only(T.squeeze(text)), E.SYNONYMS))
    return found.groupBy("type", "value").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n"), F.sum("start").alias("starts"))


_FIRST = {"ARTICULO": ["the"], "PAR": ["of the"]}
_SECOND = {"ARTICULO": ["the"], "ENLACE": ["and"], "PAR": ["of the"]}


@add(
    "entities_added",
    f"""WITH {_pieces_sql(S.squeeze(TEXT))}, {_found_sql('f', 'o', [(t, v) for t, vs in _FIRST.items() for v in vs])}, {_found_sql('g', 'o', [(t, v) for t, vs in _SECOND.items() for v in vs])}
SELECT doc_id, type, count(*) AS n FROM (SELECT * FROM f UNION SELECT * FROM g) GROUP BY ALL""",
)
def entities_added(spark, sf_dir):
    """A second recogniser adds what the first has not marked; what both mark counts once."""
    every = {t: sorted({*_FIRST.get(t, []), *_SECOND.get(t, [])}) for t in {**_FIRST, **_SECOND}}
    hits = kept(E.entities(_docs(spark, sf_dir), every))  # texts are read once for both
    by = lambda taxonomy: hits.where(reduce(or_, [(F.col("type") == t) & F.col("value").isin(vs) for t, vs in taxonomy.items()]))
    return E.with_phrases(by(_FIRST), by(_SECOND)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


_HINTED = sorted(v for vs in WORDS.values() for v in vs if " " not in v)
_HINT = ", ".join(rf"CASE WHEN regexp_matches(t, '\b{w}\b') THEN '{w}' END" for w in _HINTED)


@add(
    "crop_hints_multi",
    f"""WITH t AS (SELECT doc_id, {S.ascii_only(S.squeeze(TEXT))} AS t, CASE WHEN doc_id % 3 = 0 THEN ['zanahoria'] ELSE [] END AS s FROM documents),
h AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_filter([{_HINT}], lambda x: x IS NOT NULL), s))) AS h FROM t) SELECT doc_id, array_to_string(h, ',') AS hints, len(h) > 1 AS multi FROM h""",
)
def crop_hints_multi(spark, sf_dir):
    """Words named in the text, and those stored with it."""
    stored = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("zanahoria"))).otherwise(F.array().cast("array<string>"))
    h = E.crop_hints(S.ascii_only(T.fold(F.col("text"))), _HINTED, stored)
    return _docs(spark, sf_dir).select("doc_id", h.alias("h")).select("doc_id", F.array_join("h", ",").alias("hints"), (F.size("h") > 1).alias("multi"))


@add(
    "concatenated_answer",
    f"""WITH {S.bm25(QUERIES, 8)}, h AS (SELECT query_id, rank, doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS page, {TEXT} AS text FROM lex JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT query_id, md5(string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS context, string_agg('[' || rank || '] Documento ' || substr(CAST(doc_id AS VARCHAR), 1, 8) || ', página ' || coalesce(CAST(page AS VARCHAR), '?'), '|' ORDER BY rank) AS citations FROM h GROUP BY query_id""",
)
def concatenated_answer(spark, sf_dir):
    """The first five fragments one after the other."""
    hits = lexical.bm25(_docs(spark, sf_dir), QUERIES, k=8).join(_docs(spark, sf_dir), "doc_id")
    shaped = hits.select("query_id", "rank", "doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3).alias("page"), "text")
    return Y.concatenated(shaped).select("query_id", F.md5("context").alias("context"), F.array_join("citations", "|").alias("citations"))


@add(
    "citations",
    f"""WITH {S.bm25(QUERIES, 8)} SELECT 'cite_' || rank AS citation_id, query_id, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 6) AS score, nullif(doc_id % 4, 0) AS page, CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id END AS table_id,
CASE WHEN doc_id % 2 = 0 THEN rank END AS "row", CASE WHEN doc_id % 5 = 0 THEN 'f' END AS figure_id, CASE WHEN doc_id % 5 = 0 THEN source END AS caption FROM lex JOIN documents USING (doc_id)""",
)
def citations(spark, sf_dir):
    """Citations as structures: cells only with a table, captions only with a figure."""
    i, c = F.col("doc_id"), F.col
    hits = lexical.bm25(_docs(spark, sf_dir), QUERIES, k=8).join(_docs(spark, sf_dir), "doc_id")
    place = {
        "table_id": F.when(i % 2 == 0, F.concat(F.lit("t"), i.cast("string"))), "row": c("rank"), "col": F.lit(1),
        "figure_id": F.when(i % 5 == 0, "f"), "caption": c("source")
    }
    made = Y.citation_struct(c("rank"), i, i, c("score"), c("source"), F.lit(None).cast("string"), i % 4, F.lit(None).cast("array<double>"), place)
    out = hits.select("query_id", made.alias("c"))
    return out.select(
        "c.citation_id", "query_id", "c.doc_id", F.round("c.score", 6).alias("score"), "c.page", "c.table_id", "c.row", "c.figure_id",
        "c.caption"
    )


@add(
    "answer_order",
    f"""WITH {S.bm25(QUERIES, 8)}, h AS (SELECT query_id, rank, doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'maiz' END, CASE WHEN doc_id % 3 = 0 THEN 'chile' END], lambda x: x IS NOT NULL) AS hints FROM lex)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN list_contains(hints, 'chile') THEN 0 WHEN len(hints) = 0 THEN 1 WHEN len(hints) > 1 THEN 2 ELSE 3 END, rank) AS rank FROM h""",
)
def answer_order(spark, sf_dir):
    """Fragments of the crop in focus come first in an answer."""
    i = F.col("doc_id")
    hits = lexical.bm25(_docs(spark, sf_dir), QUERIES, k=8)
    hints = F.array_compact(F.array(F.when(i % 2 == 0, "maiz"), F.when(i % 3 == 0, "chile")))
    return Y.in_focus(hits, F.lit("chile"), hints).select("query_id", "doc_id", "rank")


@add("answer_compose")
def answer_compose(spark, sf_dir):
    """Ranking, de-duplication, sentences, citations and faithfulness in one; a test follows it in plain Python."""
    hits = lexical.bm25(_docs(spark, sf_dir), QUERIES, k=8).join(_docs(spark, sf_dir), "doc_id")
    shaped = hits.select(
        "query_id", "rank", "doc_id", "text", F.lit(None).cast("string").alias("author"), F.col("source").alias("title"),
        F.col("lang").alias("page")
    )
    return Y.compose(shaped, spark.createDataFrame(QUERIES, "query_id long, query string"))
