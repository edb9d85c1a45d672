"""Queries of the retrieval family: lexical, dense, fused, re-ranked, gated, focused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.text import RANK_STOPWORDS, fold, keywords, tokens
from tillage.functions.vectors import hashed_embedding, norm
from tillage.operators import evaluation, lexical, lexindex, ranking
from tillage.operators.assistant import named_crop
from tillage.operators.dense import probes_for, search_lists, top_vectors, top_vectors_of_set, write_lists
from tillage.operators.entities import coverage, crop_hints
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.session import kept, scratch, table

#: The stated query set, and the crop-like words that focus rules look for on the test corpus.
QUERIES = [(1, "the and that with"), (2, "der und die nicht"), (3, "les des une dans les"), (4, "para los que con"), (5, "threat stupid attention")]
FOCUS_WORDS = ["with", "und", "les", "para", "that"]
DIM = 64


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def _query_vectors(spark, queries=QUERIES, dim: int = DIM) -> list[tuple[int, list[float]]]:
    rows = spark.createDataFrame(queries, "query_id long, query string").select("query_id", hashed_embedding(F.col("query"), dim).alias("v"))
    return [(r["query_id"], r["v"]) for r in rows.orderBy("query_id").collect()]  # the caller's few queries


_QV = f"qv AS (SELECT query_id, {S.hashed('query', DIM)} AS v FROM q)"
_Q = f"q AS (SELECT * FROM (VALUES {S.values(QUERIES)}) t(query_id, query))"


@REGISTRY.add("bm25_topk", f"WITH {S.bm25(QUERIES, 20)} SELECT query_id, doc_id, score, rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf_dir), QUERIES, k=20).select("query_id", "doc_id", "score", "rank")


_DUP = [(1, "the the the and"), (2, "the and")]


@REGISTRY.add("bm25_dup_terms", f"WITH {S.bm25(_DUP, 10)} SELECT query_id, doc_id, score, rank FROM lex")
def bm25_dup_terms(spark, sf_dir):
    return lexical.bm25(_docs(spark, sf_dir), _DUP, k=10).select("query_id", "doc_id", "score", "rank")


@REGISTRY.add("bm25_label_filter", f"WITH {S.bm25(QUERIES, 10, keep='''list_has_any([lang], ['en', 'fr'])''')} SELECT query_id, doc_id, score, rank FROM lex")
def bm25_label_filter(spark, sf_dir):
    keep = F.arrays_overlap(F.array("lang"), F.array(F.lit("en"), F.lit("fr")))
    return lexical.bm25(_docs(spark, sf_dir), QUERIES, k=10, keep=keep).select("query_id", "doc_id", "score", "rank")


@REGISTRY.add("analysed_search")
def analysed_search(spark, sf_dir):
    """Stems have no SQL; membership is tested on hand-made rows."""
    return lexical.analysed_search(
        _docs(spark, sf_dir), [(1, "las plantas para regiones"), (2, "los cultivos con datos")], k=20
    ).select("query_id", "doc_id", "score", "rank")


@REGISTRY.add(
    "postings_df_stats",
    f"""WITH d AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf, any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl FROM p, s GROUP BY term""",
)
def postings_df_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    by_term = lexical.postings(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))
    stats = lexical.corpus_stats(docs, "text")
    return by_term.crossJoin(F.broadcast(stats)).select("term", "df", "cf", "max_tf", "n", F.round("avgdl", 6).alias("avgdl"))  # one row


def _every_fiftieth(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_VQ = "vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0)"


@REGISTRY.add("dense_cosine_topk", f"WITH {_VQ}, {S.dense('vq')} SELECT query_id, doc_id AS vec_id, round(score, 6) AS score, rank FROM den")
def dense_cosine_topk(spark, sf_dir):
    found = top_vectors_of_set(table(spark, sf_dir, "embeddings"), _every_fiftieth(spark, sf_dir))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@REGISTRY.add(
    "dense_where_label",
    f"WITH {_VQ}, {S.dense('vq', where='label IN (1, 3)')} SELECT query_id, doc_id AS vec_id, round(score, 6) AS score, rank FROM den"
)
def dense_where_label(spark, sf_dir):
    found = top_vectors_of_set(table(spark, sf_dir, "embeddings").where("label in (1, 3)"), _every_fiftieth(spark, sf_dir))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@REGISTRY.add("dense_l2_score", f"WITH {_VQ}, {S.dense('vq', score='2 * c - 1')} SELECT query_id, doc_id AS vec_id, round(score, 6) AS score, rank FROM den")
def dense_l2_score(spark, sf_dir):
    found = top_vectors_of_set(table(spark, sf_dir, "embeddings"), _every_fiftieth(spark, sf_dir), score="l2")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@REGISTRY.add(
    "dummy_embedding_norm",
    f"""WITH e AS (SELECT doc_id, {S.hashed('coalesce(text, chr(32))', 8)} AS v FROM documents)
SELECT doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[8] / sqrt(list_dot_product(v, v)), 6) AS last, 1.0 AS norm FROM e""",
)
def dummy_embedding_norm(spark, sf_dir):
    v = hashed_embedding(F.coalesce(F.col("text"), F.lit(" ")), 8)
    return _docs(spark, sf_dir).select("doc_id", v.alias("v")).select(
        "doc_id", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 7), 6).alias("last"),
        F.round(norm(F.col("v")), 6).alias("norm")
    )


def hybrid(spark, sf_dir, k_lexical: int = 100, k_dense: int = 8, queries: list[tuple[int, str]] = QUERIES, lex: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rrf_score, rank): both searches for all queries at once, fused. lex: the lexical result, if there is one."""
    lex = (lexical.bm25(_docs(spark, sf_dir), queries, k=k_lexical) if lex is None else lex).select("query_id", "doc_id", "rank")
    den = top_vectors(table(spark, sf_dir, "embeddings"), _query_vectors(spark, queries), k=k_dense).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return ranking.reciprocal_rank_fusion([den, lex], ["query_id"], "doc_id")


_HYBRID = f"{S.bm25(QUERIES)}, {_QV}, {S.dense('qv')}, {S.fusion(['den', 'lex'])}"


@REGISTRY.add("rrf_fusion", f"WITH {_HYBRID} SELECT query_id, doc_id, rrf_score, rank FROM rrf")
def rrf_fusion(spark, sf_dir):
    return hybrid(spark, sf_dir)


@REGISTRY.add("hybrid_search", f"WITH {_HYBRID} SELECT query_id, doc_id, rrf_score, rank, source FROM rrf LEFT JOIN documents USING (doc_id) WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    top = hybrid(spark, sf_dir).where("rank <= 10")
    return top.join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", "left").select("query_id", "doc_id", "rrf_score", "rank", "source")


_STOP = ", ".join(f"'{w}'" for w in RANK_STOPWORDS)
_TERMS = f"qk AS (SELECT query_id, list_filter(regexp_extract_all({S.fold('query')}, '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS terms FROM q)"
_COVER = f"""{_TERMS},
cv AS (SELECT query_id, doc_id, source, text, rrf_score, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains({S.fold("coalesce(text, '')")}, t))) / len(terms) ELSE 0.0 END AS coverage
       FROM (SELECT * FROM rrf WHERE rank <= 20) JOIN documents USING (doc_id) JOIN qk USING (query_id)),
bo AS (SELECT *, round(rrf_score * (1 + 0.5 * coverage), 9) AS boosted FROM cv)"""


def _reranked(spark, sf_dir) -> DataFrame:
    top = hybrid(spark, sf_dir).where("rank <= 20").drop("rank").join(_docs(spark, sf_dir), "doc_id")
    asked = spark.createDataFrame(QUERIES, "query_id long, query string").withColumn("terms", keywords(F.col("query"), RANK_STOPWORDS))
    both = top.join(F.broadcast(asked), "query_id")  # the stated query set
    boosted, share = ranking.term_coverage(F.col("rrf_score"), F.col("terms"), F.coalesce("text", F.lit("")))
    return both.withColumn("coverage", share).withColumn("boosted", F.round(boosted, 9))


@REGISTRY.add(
    "term_coverage_rerank",
    f"WITH {_HYBRID}, {_COVER} SELECT query_id, doc_id, rrf_score, round(coverage, 6) AS coverage, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, doc_id) AS rank FROM bo",
)
def term_coverage_rerank(spark, sf_dir):
    out = ranking.ranked(_reranked(spark, sf_dir), "boosted", ["query_id"], "doc_id")
    return out.select("query_id", "doc_id", "rrf_score", F.round("coverage", 6).alias("coverage"), "boosted", "rank")


_ASKED = ["the", "and", "les"]


@REGISTRY.add(
    "multifactor_rerank",
    f"""WITH {_HYBRID}, a AS (SELECT max(o_orderdate) AS as_of FROM orders),
m AS (SELECT query_id, doc_id, rrf_score, source, {S.fold("coalesce(text, '')")} AS t,
      CASE WHEN o_orderdate IS NULL THEN 0.5 ELSE greatest(0.0, 1 - date_diff('day', CAST(o_orderdate AS DATE), CAST(as_of AS DATE)) / 365.0) END AS fresh
      FROM (SELECT * FROM rrf WHERE rank <= 20) JOIN documents USING (doc_id) LEFT JOIN orders ON o_orderkey = doc_id AND doc_id % 3 <> 0, a),
s AS (SELECT query_id, doc_id, fresh, round(0.4 * rrf_score + 0.2 * fresh + 0.2 * CASE WHEN regexp_matches(lower(coalesce(source, '')), 'inifap|fao|sagarpa|senasica') THEN 1.0 ELSE 0.5 END
      + 0.2 * round(len(list_filter({_ASKED}, lambda w: list_contains(regexp_extract_all(t, '[a-z0-9_]+'), w))) / {len(_ASKED)}, 4), 9) AS rerank_score FROM m)
SELECT query_id, doc_id, round(fresh, 6) AS fresh, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM s""",
)
def multifactor_rerank(spark, sf_dir):
    """Orders stand in for dates of documents: the order with the document's number; every third has none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    as_of = orders.agg(F.max("o_orderdate").alias("as_of"))
    dated = orders.where("o_orderkey % 3 <> 0")
    top = hybrid(spark, sf_dir).where("rank <= 20").drop("rank").join(_docs(spark, sf_dir), "doc_id").join(dated, F.col("o_orderkey") == F.col("doc_id"), "left").crossJoin(F.broadcast(as_of))
    fresh = ranking.freshness(F.col("o_orderdate"), F.col("as_of"))
    asked = F.array(*[F.lit(w) for w in _ASKED])
    entity = coverage(asked, F.array_distinct(tokens(F.col("text"))))
    score = ranking.multifactor(F.col("rrf_score"), fresh, ranking.authority(F.col("source")), entity)
    return ranking.ranked(
        top.select("query_id", "doc_id", F.round(fresh, 6).alias("fresh"), F.round(score, 9).alias("rerank_score")), "rerank_score",
        ["query_id"], "doc_id"
    )


@REGISTRY.add(
    "evidence_gate",
    f"""WITH {_HYBRID}, h AS (SELECT query_id, source, rrf_score FROM rrf JOIN documents USING (doc_id) WHERE rank <= 10),
g AS (SELECT query_id, count(*) AS n_all, count(*) FILTER (rrf_score >= 0.001) AS n_strong, count(DISTINCT source) FILTER (rrf_score >= 0.001) AS s1, count(DISTINCT source) AS s2,
      sum(rrf_score) FILTER (rrf_score >= 0.001) AS x1, sum(rrf_score) AS x2 FROM h GROUP BY query_id),
k AS (SELECT query_id, CASE WHEN n_strong > 0 THEN n_strong ELSE n_all END AS kept, CASE WHEN n_strong > 0 THEN s1 ELSE s2 END AS sources, CASE WHEN n_strong > 0 THEN x1 ELSE x2 END AS x FROM g),
r AS (SELECT query_id, kept, sources, x / greatest(kept, 1) AS mean_score, CASE WHEN kept < 3 THEN 'k_min_after_filter' WHEN sources < 2 THEN 'min_sources' WHEN x / greatest(kept, 1) < 0.0145 THEN 'mean_score' END AS reason FROM k)
SELECT query_id, kept, sources, round(mean_score, 6) AS mean_score, reason IS NULL AS sufficient, reason FROM r""",
)
def evidence_gate(spark, sf_dir):
    hits = hybrid(spark, sf_dir).where("rank <= 10").join(_docs(spark, sf_dir), "doc_id")
    return ranking.evidence_gate(hits, ["query_id"], doc="source", k_min=3, sources_min=2, mean_min=0.0145)


_HINT_SQL = "list_sort(list_filter([" + ", ".join(f"'{w}'" for w in FOCUS_WORDS) + f"], lambda w: regexp_matches({S.squeeze('''coalesce(text, '')''')}, '\\b' || w || '\\b')))"


def _focused(spark, sf_dir, scope: str) -> DataFrame:
    hits = _reranked(spark, sf_dir).withColumn("hints", crop_hints(F.coalesce("text", F.lit("")), FOCUS_WORDS))
    factor, reason = ranking.focus_factor(F.lit("with"), F.col("hints"), F.coalesce("text", F.lit("")), scope)
    return hits.withColumn("factor", F.round(factor, 6)).withColumn("reason", reason).withColumn("score", F.round(F.col("boosted") * factor, 9))


def _focus_sql(match: float, many: float, other: float) -> str:
    text = S.fold("coalesce(text, '')")
    beside = rf"regexp_matches({text}, '\bcultivo\b') AND contains({text}, hints[1])"
    rule = rf"regexp_matches({text}, '\b(si|cuando|para)\s+(el\s+)?cultivo\s+(es\s+)?([a-z]{{2,}})\b')"
    return f"""fo AS (SELECT *, {_HINT_SQL} AS hints FROM bo),
fa AS (SELECT *, CASE WHEN len(hints) = 0 THEN 1.0 WHEN list_contains(hints, 'with') THEN {match} WHEN len(hints) > 1 THEN {many}
       ELSE {other} * CASE WHEN {rule} THEN 0.7 ELSE 1.0 END * CASE WHEN {beside} THEN 0.85 ELSE 1.0 END END AS factor,
       CASE WHEN len(hints) = 0 THEN 'neutral_no_hints' WHEN list_contains(hints, 'with') THEN 'match_crop' WHEN len(hints) > 1 THEN 'multi_crop_missing_focus'
       WHEN {beside} THEN 'other_single_crop_near_cultivo_keyword' WHEN {rule} THEN 'other_single_crop_rule_like' ELSE 'other_single_crop' END AS reason FROM fo)"""


@REGISTRY.add(
    "focus_boost",
    f"""WITH {_HYBRID}, {_COVER}, {_focus_sql(1.25, 0.92, 0.65)}
SELECT query_id, doc_id, round(CAST(factor AS DOUBLE), 6) AS factor, reason, round(boosted * CAST(factor AS DOUBLE), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted * CAST(factor AS DOUBLE), 9) DESC, doc_id) AS rank FROM fa""",
)
def focus_boost(spark, sf_dir):
    out = ranking.ranked(_focused(spark, sf_dir, "crop_boost"), "score", ["query_id"], "doc_id")
    return out.select("query_id", "doc_id", "factor", "reason", "score", "rank")


@REGISTRY.add(
    "focus_strict",
    f"""WITH {_HYBRID}, {_COVER}, {_focus_sql(1.15, 0.80, 0.12)}, ok AS (SELECT * FROM fa WHERE NOT (len(hints) = 1 AND hints[1] <> 'with'))
SELECT query_id, doc_id, round(CAST(factor AS DOUBLE), 6) AS factor, CASE WHEN list_contains(hints, 'with') THEN 0 WHEN len(hints) = 0 THEN 1 WHEN len(hints) > 1 THEN 2 ELSE 3 END AS class,
       round(boosted * CAST(factor AS DOUBLE), 9) AS score FROM ok""",
)
def focus_strict(spark, sf_dir):
    hits = _focused(spark, sf_dir, "crop_strict").where(~ranking.strictly_other(F.lit("with"), F.col("hints")))
    return hits.select("query_id", "doc_id", "factor", ranking.focus_class(F.lit("with"), F.col("hints")).alias("class"), "score")


_LONGEST = "(SELECT w FROM (VALUES " + ", ".join(f"('{w}')" for w in FOCUS_WORDS) + ") t(w) WHERE length(w) >= 3 AND contains({text}, w) ORDER BY length(w) DESC, w LIMIT 1)"


@REGISTRY.add(
    "auto_focus_detect",
    f"""WITH d AS (SELECT doc_id, {S.squeeze("coalesce(text, '')")} AS t FROM documents),
l AS (SELECT doc_id, max(length(w) * 1000 - k) AS best FROM d, (VALUES {S.values([(i, w) for i, w in enumerate(sorted(FOCUS_WORDS))])}) x(k, w) WHERE contains(t, w) GROUP BY doc_id),
n AS (SELECT doc_id, w AS focus FROM l, (VALUES {S.values([(i, w) for i, w in enumerate(sorted(FOCUS_WORDS))])}) x(k, w) WHERE length(w) * 1000 - k = best)
SELECT doc_id, focus, CASE WHEN focus IS NULL THEN 'global' ELSE 'crop_boost' END AS scope, CASE WHEN focus IS NULL THEN 'consulta' ELSE 'documentacion agronomica sobre ' || focus || ': consulta' END AS rewritten
FROM documents LEFT JOIN n USING (doc_id)""",
)
def auto_focus_detect(spark, sf_dir):
    """Longest dictionary word in the text (ties: first in the alphabet) becomes the focus and rewrites the query."""
    from tillage.functions.text import squeeze

    t = squeeze(F.coalesce("text", F.lit("")))
    ordered = sorted((w for w in FOCUS_WORDS if len(w) >= 3), key=lambda w: (-len(w), w))
    focus = F.coalesce(*[F.when(F.contains(t, F.lit(w)), w) for w in ordered])
    out = _docs(spark, sf_dir).select("doc_id", focus.alias("focus"))
    return out.select(
        "doc_id", "focus", F.when(F.col("focus").isNull(), "global").otherwise("crop_boost").alias("scope"),
        F.when(F.col("focus").isNull(), F.lit("consulta")).otherwise(F.concat(
            F.lit("documentacion agronomica sobre "), "focus", F.lit(": consulta")
        )).alias("rewritten")
    )


@REGISTRY.add(
    "fragment_dedupe_rules",
    f"""WITH RECURSIVE {S.bm25(QUERIES, 50)},
h AS (SELECT query_id, rank, doc_id, source, coalesce(CAST(doc_id // 4 AS VARCHAR), '') || '/' || lang AS place,
      regexp_replace(lower(trim(CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(source, '') END)), '\\s+', ' ', 'g') AS title,
      lower(substr(regexp_replace(coalesce(text, ''), '^\\s+', ''), 1, 220)) AS head FROM lex JOIN documents USING (doc_id)),
g AS (SELECT query_id, 0::BIGINT AS rank, []::VARCHAR[] AS places, []::VARCHAR[] AS titles, []::VARCHAR[] AS heads, false AS kept FROM q
      UNION ALL
      SELECT query_id, h.rank, CASE WHEN ok THEN list_append(places, place) ELSE places END, CASE WHEN ok THEN list_append(titles, title) ELSE titles END, CASE WHEN ok THEN list_append(heads, head) ELSE heads END, ok
      FROM (SELECT g.query_id, h.rank, h.place, h.title, h.head, g.places, g.titles, g.heads,
                   NOT list_contains(g.places, h.place) AND (h.title = '' OR len(list_filter(g.titles, lambda t: t = h.title)) < 2) AND (h.head = '' OR NOT list_contains(g.heads, h.head)) AS ok
            FROM g JOIN h ON h.query_id = g.query_id AND h.rank = g.rank + 1) h)
SELECT query_id, rank, doc_id, source FROM g JOIN h USING (query_id, rank) WHERE kept""",
)
def fragment_dedupe_rules(spark, sf_dir):
    """Four neighbouring documents stand for one, the language for the page, the source for the title; every fifth is untitled."""
    hits = lexical.bm25(_docs(spark, sf_dir), QUERIES, k=50).join(_docs(spark, sf_dir), "doc_id")
    title = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))
    kept = ranking.greedy_keep(hits, ["query_id"], "rank", F.floor(F.col("doc_id") / 4), F.col("lang"), title, F.col("text"))
    return kept.select("query_id", "rank", "doc_id", "source")


@REGISTRY.add(
    "exact_dup_by_prefix_hash",
    f"""WITH h AS (SELECT doc_id, md5(substr({S.fold("coalesce(text, '')")}, 1, 220)) AS prefix_hash FROM documents)
SELECT prefix_hash, min(doc_id) AS kept_id, count(*) AS n FROM h GROUP BY prefix_hash""",
)
def exact_dup_by_prefix_hash(spark, sf_dir):
    h = F.md5(F.substring(fold(F.coalesce("text", F.lit(""))), 1, 220))
    return _docs(spark, sf_dir).select("doc_id", h.alias("prefix_hash")).groupBy("prefix_hash").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n"))


@REGISTRY.add(
    "planted_strings",
    f"""WITH b AS (SELECT item_id AS query_id, {S.fold("coalesce(text, '')")} AS t FROM benchmark),
d AS (SELECT doc_id, {S.fold("coalesce(text, '')")} AS t FROM documents)
SELECT query_id, count(doc_id) AS n_docs, min(doc_id) AS first_doc, count(doc_id) > 0 AS found FROM b LEFT JOIN d ON contains(d.t, b.t) GROUP BY query_id""",
)
def planted_strings(spark, sf_dir):
    """Which documents hold a planted string whole."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), fold(F.coalesce("text", F.lit(""))).alias("needle"))
    return planted(items, _docs(spark, sf_dir).select("doc_id", fold(F.coalesce("text", F.lit(""))).alias("t")))


#: Query and planted string, by query.
CANARIES = [(1, "that"), (2, "nicht"), (3, "dans"), (4, "para los"), (5, "no such string")]


@REGISTRY.add(
    "canary_recall",
    f"""WITH {_HYBRID}, c AS (SELECT * FROM (VALUES {S.values(CANARIES)}) t(query_id, needle)),
h AS (SELECT 'hybrid' AS mode, query_id, doc_id, rank FROM rrf WHERE rank <= 8 UNION ALL SELECT 'lex', query_id, doc_id, rank FROM lex WHERE rank <= 8),
x AS (SELECT mode, query_id, min(rank) AS rank FROM h JOIN c USING (query_id) JOIN documents USING (doc_id) WHERE contains(coalesce(text, ''), needle) GROUP BY ALL)
SELECT m.mode, c.query_id, x.rank IS NOT NULL AS found, coalesce(x.rank, 0) - 1 AS rank_of_canary FROM c CROSS JOIN (VALUES ('hybrid'), ('lex')) m(mode) LEFT JOIN x ON x.mode = m.mode AND x.query_id = c.query_id""",
)
def canary_recall(spark, sf_dir):
    """Whether and where each way of searching brings up the planted string, among the first eight."""
    docs = _docs(spark, sf_dir)
    lex = kept(lexical.bm25(docs, QUERIES))  # one search for both ways
    both = hybrid(spark, sf_dir, lex=lex).select(F.lit("hybrid").alias("mode"), "query_id", "doc_id", "rank")
    both = both.unionByName(lex.select(F.lit("lex").alias("mode"), "query_id", "doc_id", "rank")).where("rank <= 8")
    canaries = spark.createDataFrame(CANARIES, "query_id long, needle string")
    return evaluation.canary_ranks(both, docs, canaries, ["hybrid", "lex"])


@REGISTRY.add(
    "audit_summary",
    f"""WITH {_HYBRID}, h AS (SELECT query_id, count(*) AS n_fragments, count(DISTINCT doc_id // 4) AS unique_docs, string_agg(source, '|' ORDER BY rank) AS titles, max(rrf_score) AS best FROM rrf JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, query, coalesce(n_fragments, 0) AS n_fragments, coalesce(unique_docs, 0) AS unique_docs, coalesce(titles, '') AS titles, coalesce(n_fragments, 0) = 0 AS insufficient FROM q LEFT JOIN h USING (query_id)""",
)
def audit_summary(spark, sf_dir):
    """Four neighbouring documents stand for one, the source for the title."""
    hits = hybrid(spark, sf_dir).where("rank <= 10").join(_docs(spark, sf_dir), "doc_id").select(
        "query_id", "rank", F.floor(F.col("doc_id") / 4).alias("doc"), F.col("source").alias("title")
    )
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    return evaluation.audit(hits, asked).select("query_id", "query", "n_fragments", "unique_docs", F.array_join("titles", "|").alias("titles"), "insufficient")


_FOCUS_CASES = [
    (1, "plagas del maiz", None, None, "global"), (2, "plagas del maiz", "Frijol", None, "crop_strict"),
    (3, "plagas", "Chile", "Tomate Rojo", "crop_boost"), (4, "clima", None, None, "global"), (5, "maiz y frijol", None, None, "crop_boost"),
    (6, "calabaza y chile", "", None, "global")
]
_FOCUS_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _FOCUS_CASES)


@REGISTRY.add(
    "focus_precedence",
    f"""WITH f AS (SELECT * FROM (VALUES {_FOCUS_ROWS}) t(id, query, asked, crop_of_id, scope)),
g AS (SELECT *, coalesce(nullif(lower(trim(crop_of_id)), ''), nullif(lower(trim(asked)), '')) AS given,
      CASE WHEN contains(query, 'calabaza') THEN 'calabaza' WHEN contains(query, 'frijol') THEN 'frijol' WHEN contains(query, 'chile') THEN 'chile' WHEN contains(query, 'maiz') THEN 'maiz' END AS seen FROM f),
a AS (SELECT *, given IS NULL AND crop_of_id IS NULL AND asked IS NULL AND scope = 'global' AND seen IS NOT NULL AS auto FROM g),
e AS (SELECT id, query, auto, coalesce(given, CASE WHEN auto THEN seen END) AS focus, CASE WHEN auto THEN 'crop_boost' ELSE scope END AS scope FROM a)
SELECT *, CASE WHEN focus IS NOT NULL AND scope <> 'global' THEN 'documentacion agronomica sobre ' || focus || ': ' || query ELSE query END AS search_query FROM e""",
)
def focus_precedence(spark, sf_dir):
    """The crop of an id before the crop asked for before the crop that the query names."""
    rows = spark.createDataFrame(_FOCUS_CASES, "id long, query string, asked string, crop_of_id string, scope string")
    seen = named_crop(F.col("query"), F.array(*[F.lit(c) for c in ("calabaza", "frijol", "chile", "maiz")]))
    focus = ranking.effective_focus(F.col("crop_of_id"), F.col("asked"), seen, F.col("scope"))
    done = rows.withColumn("f", focus).withColumn("search_query", ranking.focused_query(F.col("query"), F.col("f")))
    return done.select("id", "query", "f.auto", "f.focus", "f.scope", "search_query")


_MODES = f"""WITH {_HYBRID},
m AS (SELECT 'hybrid' AS mode, query_id, doc_id, rrf_score, NULL::DOUBLE AS score FROM rrf WHERE rank <= 8 UNION ALL SELECT 'lex', query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.0 END, score FROM lex WHERE rank <= 8),
u AS (SELECT mode, query_id, doc_id, round(coalesce(nullif(rrf_score, 0), score, rrf_score, 0), 9) AS rrf_score FROM m)"""


def _by_mode(spark, sf_dir) -> DataFrame:
    """Hits of both modes with one score; the single search's have no fused score, or 0."""
    found = kept(lexical.bm25(_docs(spark, sf_dir), QUERIES))  # one search for both modes
    lex = found.where("rank <= 8").select(
        F.lit("lex").alias("mode"), "query_id", "doc_id", F.when(F.col("doc_id") % 2 == 0, 0.0).alias("rrf_score"), "score"
    )
    both = hybrid(spark, sf_dir, lex=found).where("rank <= 8").select(
        F.lit("hybrid").alias("mode"), "query_id", "doc_id", "rrf_score", F.lit(None).cast("double").alias("score")
    )
    return both.unionByName(lex).select("mode", "query_id", "doc_id", F.round(ranking.unified_score(F.col("score"), F.col("rrf_score")), 9).alias("rrf_score"))


@REGISTRY.add(
    "fusion_metadata",
    f"""WITH {_HYBRID}, m AS (SELECT query_id, doc_id, 0 AS run, 'denso' AS found_by, rank FROM den UNION ALL SELECT query_id, doc_id, 1, 'lexico', rank FROM lex),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY run) AS n FROM m) SELECT query_id, doc_id, found_by, rank FROM f WHERE n = 1""",
)
def fusion_metadata(spark, sf_dir):
    """What is known of a fused hit comes from the vector search if that found it."""
    lex = lexical.bm25(_docs(spark, sf_dir), QUERIES).select("query_id", "doc_id", F.lit("lexico").alias("found_by"), "rank")
    den = top_vectors(table(spark, sf_dir, "embeddings"), _query_vectors(spark))
    den = den.select("query_id", F.col("vec_id").alias("doc_id"), F.lit("denso").alias("found_by"), "rank")
    return ranking.first_metadata([den, lex], ["query_id"], "doc_id", ["found_by", "rank"])


@REGISTRY.add("score_unification", f"{_MODES} SELECT * FROM u")
def score_unification(spark, sf_dir):
    return _by_mode(spark, sf_dir)


@REGISTRY.add(
    "insufficient_payload",
    f"""{_MODES}, g AS (SELECT mode, query_id, count(*) FILTER (rrf_score >= 0.001) AS n1, count(*) AS n0, avg(rrf_score) FILTER (rrf_score >= 0.001) AS m1, avg(rrf_score) AS m0,
      count(DISTINCT source) FILTER (rrf_score >= 0.001) AS s1, count(DISTINCT source) AS s0 FROM u JOIN documents USING (doc_id) GROUP BY ALL),
k AS (SELECT mode, query_id, CASE WHEN n1 > 0 THEN n1 ELSE n0 END AS kept, CASE WHEN n1 > 0 THEN s1 ELSE s0 END AS sources, CASE WHEN n1 > 0 THEN m1 ELSE m0 END AS mean FROM g)
SELECT mode, query_id, CASE WHEN kept < 3 THEN 'k_min_after_filter' WHEN sources < 2 THEN 'min_sources' WHEN mean < 0.02 THEN 'mean_score' END AS reason,
CASE WHEN kept < 3 OR sources < 2 OR mean < 0.02 THEN '<p><em>Insuficiente evidencia en el conjunto documental actual.</em></p>' END AS html,
CASE WHEN kept < 3 OR sources < 2 OR mean < 0.02 THEN 'insuficiente_evidencia' END AS warning FROM k""",
)
def insufficient_payload(spark, sf_dir):
    hits = _by_mode(spark, sf_dir).join(_docs(spark, sf_dir), "doc_id")
    gate = ranking.evidence_gate(hits, ["mode", "query_id"], doc="source", k_min=3, sources_min=2, mean_min=0.02)
    p = ranking.insufficient_payload(F.col("kept"), F.col("sources"), F.col("mean_score"), F.col("reason"))
    return gate.select("mode", "query_id", "reason", p["respuesta_html"].alias("html"), F.get(p["advertencias"], 0).alias("warning"))


@REGISTRY.add(
    "hit_hydration",
    f"""WITH {_HYBRID}, h AS (SELECT query_id, doc_id AS f, rrf_score, rank FROM rrf WHERE rank <= 10),
x AS (SELECT query_id, f, rank, CASE WHEN f % 7 = 0 THEN NULL ELSE f // 4 END AS doc, CASE WHEN f % 5 = 0 THEN 0 ELSE f % 5 END AS page, source, text FROM h JOIN documents ON doc_id = f)
SELECT query_id, f AS fragment_id, rank, doc AS doc_id, d.source AS doc_title, page AS page_start, CAST(length(coalesce(x.text, '')) AS BIGINT) AS n_chars,
CASE WHEN f % 3 = 1 THEN 4 END AS n_box, CASE WHEN doc IS NOT NULL AND page > 0 THEN '/api/documents/' || doc || '/render?page=' || page || '&fragment_id=' || f END AS render_url,
CASE WHEN doc IS NOT NULL AND page > 0 THEN '/api/documents/' || doc || '/fragments/' || f || '/locate' END AS locate_url FROM x LEFT JOIN documents d ON d.doc_id = x.doc""",
)
def hit_hydration(spark, sf_dir):
    """Documents stand for fragments, four neighbouring ones for a document that the one with its number describes."""
    d = _docs(spark, sf_dir)
    f = F.col("doc_id")
    box = F.when(f % 3 == 0, "not a list").when(f % 3 == 1, "[1, 2, 3.5, 4]").otherwise("[1, 2]")
    fragments = d.select(
        f.alias("fragment_id"), F.when(f % 7 != 0, F.floor(f / 4)).alias("doc_id"), "text", (f % 5).cast("int").alias("page_start"),
        (f % 5).cast("int").alias("page_end"), box.alias("bbox"), "source"
    )
    hits = hybrid(spark, sf_dir).where("rank <= 10").select("query_id", F.col("doc_id").alias("fragment_id"), "rank")
    out = ranking.hydrated(hits, fragments, d.select("doc_id", F.col("source").alias("title")))
    return out.select(
        "query_id", "fragment_id", "rank", "doc_id", "doc_title", "page_start", F.length("text").cast("long").alias("n_chars"),
        F.nullif(F.coalesce(F.size("bbox"), F.lit(-1)), F.lit(-1)).alias("n_box"), "render_url", "locate_url"
    )


def planted(items: DataFrame, docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """(query_id, n_docs, first_doc, found) of items (query_id, needle): documents (doc_id, t) that contain the needle.

    Needles of seven words or more are joined on words two to six, which are whole in any text that contains
    them, then verified. Shorter and empty ones have no such key: blocks of them, of bounded size, are
    broadcast and looked for in every text.
    """
    spark = items.sparkSession
    needles = items.select("needle", F.split("needle", " ").alias("n")).distinct()
    keyed = needles.where(F.size("n") >= 7).select("needle", F.array_join(F.slice("n", 2, 5), " ").alias("key"))
    five = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 4)), lambda i: F.array_join(F.slice(w, i, F.lit(5)), " "))
    # only the keys travel with a document's number; its text is met again where a key fits
    words = docs.select("doc_id", F.split("t", " ").alias("w"))  # split once, not once for every piece
    grams = words.select("doc_id", F.explode(F.array_distinct(five(F.col("w")))).alias("key"))
    counted = lambda hit: hit.groupBy("needle").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    met = grams.join(keyed, "key").select("doc_id", "needle").distinct()
    found = counted(docs.join(met, "doc_id").where(F.contains("t", "needle")))
    short = needles.where(F.size("n") < 7).select("needle")
    size = short.agg(F.sum(F.octet_length("needle") + 8).alias("b")).first()["b"]
    if size is not None:
        blocks, at = -(-size // block_bytes), None
        for b in range(blocks):
            block = short.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b)
            hit = counted(docs.join(F.broadcast(block), F.contains("t", "needle")))
            if blocks > 1:  # one block after the other, each result kept in the shared folder
                at = at or scratch(spark)
                hit.write.mode("append").parquet(at)
        found = found.unionByName(spark.read.parquet(at) if at else hit)
    out = items.join(found, "needle", "left").groupBy("query_id")
    return out.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).cast("long").alias("n_docs"), F.min("first_doc").alias("first_doc"),
        (F.coalesce(F.sum("n_docs"), F.lit(0)) > 0).alias("found")
    )


#: Queries of the stored index, and what happens to it after it is built: some ids go, some get another text.
_EXTRA = " the die les"
_LIVE = f"""live AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '{_EXTRA}' ELSE text END AS text FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 <> 2)"""


def _updated_index(spark, sf_dir) -> str:
    """An index of all documents, then without every seventh and with a new text for every fifth."""
    docs, at = _docs(spark, sf_dir), f"{scratch(spark)}/index"
    lexindex.build_index(docs, at)
    fresh = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(_EXTRA)))
    lexindex.update_index(spark, at, fresh, docs.where("doc_id % 7 = 2"))
    return at


@REGISTRY.add("indexed_search", f"WITH {_LIVE}, {S.bm25(QUERIES, 20).replace('FROM documents', 'FROM live')} SELECT query_id, doc_id, score, rank FROM lex")
def indexed_search(spark, sf_dir):
    """bm25_topk from the stored index, after an update."""
    return lexindex.search_index(spark, _updated_index(spark, sf_dir), QUERIES, k=20)


_PHRASED = [
    lexindex.TextQuery(1, words="the", phrases=["of the"]), lexindex.TextQuery(2, words="der", must="und die", without="nicht"),
    lexindex.TextQuery(3, words="les des", phrases=["dans les", "de la"]), lexindex.TextQuery(4, must="para", phrases=["de los"], without="que"), lexindex.TextQuery(5, words="attention stupid"),
]


def _phrase_sql(queries: list) -> str:
    """Words by plain counts, phrases by comparing lists at every place."""
    q = [(t.query_id, kind, i, text) for t in queries for kind, texts in (("words", [t.words]), ("must", [t.must]), ("without", [t.without]), ("phrase", t.phrases)) for i, text in enumerate(texts) if text]
    return f"""WITH q AS (SELECT * FROM (VALUES {S.values(q)}) t(query_id, kind, number, query)),
qt AS (SELECT query_id, kind, number, {S.tokens('query')} AS ts FROM q), w AS (SELECT query_id, kind, number, unnest(ts) AS term FROM qt),
d AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM w) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, n),
single AS (SELECT query_id, doc_id, kind, term AS item, sum(idf) AS weight, any_value(tf) AS tf, any_value(dl) AS dl FROM w JOIN tf USING (term) JOIN idf USING (term) WHERE kind <> 'phrase' GROUP BY ALL),
pl AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM d),
ph AS (SELECT query_id, doc_id, 'phrase' AS kind, number, ts, count(*) AS tf, len(any_value(toks)) AS dl FROM pl JOIN qt ON kind = 'phrase' AND toks[i] = ts[1] AND toks[i : i + len(ts) - 1] = ts GROUP BY query_id, doc_id, number, ts),
pw AS (SELECT query_id, doc_id, kind, CAST(number AS VARCHAR) AS item, (SELECT sum(idf) FROM w JOIN idf USING (term) WHERE w.query_id = ph.query_id AND w.kind = 'phrase' AND w.number = ph.number) AS weight, tf, dl FROM ph),
a AS (SELECT * FROM single UNION ALL SELECT * FROM pw),
s AS (SELECT query_id, doc_id, round(sum(CASE WHEN kind = 'without' THEN 0 ELSE weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) END), 9) AS score,
      count(*) FILTER (kind = 'must') AS m, count(*) FILTER (kind = 'phrase') AS p, count(*) FILTER (kind = 'without') AS x FROM a, st GROUP BY query_id, doc_id),
need AS (SELECT query_id, count(DISTINCT term) FILTER (kind = 'must') AS nm, count(DISTINCT number) FILTER (kind = 'phrase') AS np FROM w GROUP BY query_id)
SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN need USING (query_id) WHERE m = nm AND p = np AND x = 0 AND score > 0) WHERE rank <= 20"""


@REGISTRY.add("phrase_search", _phrase_sql(_PHRASED))
def phrase_search(spark, sf_dir):
    """Words in a row, required and excluded words, from the positions of the stored index."""
    at = f"{scratch(spark)}/index"
    lexindex.build_index(_docs(spark, sf_dir), at)
    return lexindex.search_phrases(spark, at, _PHRASED, k=20)


def _listed(spark, sf_dir, recall: float) -> DataFrame:
    vectors, at = table(spark, sf_dir, "embeddings"), f"{scratch(spark)}/lists"
    centres = write_lists(vectors, at)
    probes = probes_for(spark, at, centres, recall) if recall < 1 else 1.0
    found = search_lists(spark, at, centres, _every_fiftieth(spark, sf_dir), probes=probes)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@REGISTRY.add("ann_cosine_topk")
def ann_cosine_topk(spark, sf_dir):
    """Approximate: as many inverted lists as calibration asks for; the tests hold its recall against dense_cosine_topk."""
    return _listed(spark, sf_dir, 0.95)


@REGISTRY.add("ann_all_lists", f"WITH {_VQ}, {S.dense('vq')} SELECT query_id, doc_id AS vec_id, round(score, 6) AS score, rank FROM den")
def ann_all_lists(spark, sf_dir):
    """All inverted lists: every row is in one of them, so the result is exact."""
    return _listed(spark, sf_dir, 1.0)
