"""Fusion, re-ranking, focus and evidence rules over ranked hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.functions.text import contained, fold, squeeze, stripped

#: Sources that count as authorities.
AUTHORITIES = ("inifap", "fao", "sagarpa", "senasica")
RULE_LIKE = r"\b(si|cuando|para)\s+(el\s+)?cultivo\s+(es\s+)?([a-z]{2,})\b"


def ranked(df: DataFrame, score: str, by: list[str], tie: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order).cast("long"))


def reciprocal_rank_fusion(runs: list[DataFrame], by: list[str], key: str, k: int = 60) -> DataFrame:
    """Sum of 1/(k + rank) over the runs in which a key occurs: a union and one aggregate, not an outer join."""
    rows = reduce(lambda a, b: a.unionByName(b), [r.select(*by, key, (1.0 / (k + F.col("rank"))).alias("_part")) for r in runs])
    return ranked(rows.groupBy(*by, key).agg(F.round(F.sum("_part"), 9).alias("rrf_score")), "rrf_score", by, key)


def first_metadata(runs: list[DataFrame], by: list[str], key: str, columns: list[str]) -> DataFrame:
    """(by, key, columns): what the first of the runs that has a key says of it."""
    rows = reduce(lambda a, b: a.unionByName(b), [r.select(*by, key, *columns, F.lit(i).alias("_run")) for i, r in enumerate(runs)])
    return rows.groupBy(*by, key).agg(F.min_by(F.struct(*columns), "_run").alias("_m")).select(*by, key, "_m.*")


def term_coverage(score: Column, terms: Column, text: Column) -> tuple[Column, Column]:
    """(boosted score, share of terms that occur): score x (1 + share / 2); no terms, no change."""
    share = F.when(F.size(terms) > 0, contained(terms, fold(text)) / F.size(terms)).otherwise(0.0)
    return score * (1 + 0.5 * share), share


def freshness(created: Column, as_of: Column) -> Column:
    """Linear decay over a year; 0.5 without a date."""
    return F.when(created.isNotNull(), F.greatest(F.lit(0.0), 1 - F.datediff(as_of, created) / 365.0)).otherwise(0.5)


def authority(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(reduce(lambda a, b: a | b, [F.contains(s, F.lit(x)) for x in AUTHORITIES]), 1.0).otherwise(0.5)


def multifactor(score: Column, fresh: Column, auth: Column, entity: Column, weights: tuple[float, ...] = (0.4, 0.2, 0.2, 0.2)) -> Column:
    return weights[0] * score + weights[1] * fresh + weights[2] * auth + weights[3] * entity


def focus_factor(focus: Column, hints: Column, text: Column, scope: str) -> tuple[Column, Column]:
    """(factor, reason) of a hit whose text hints at crops, for one crop in focus."""
    t, other, many = fold(text), F.get(hints, 0), F.size(hints) > 1
    base = F.lit(0.65 if scope == "crop_boost" else 0.12)
    rule = F.when(t.rlike(RULE_LIKE), 0.70).otherwise(1.0)
    beside = t.rlike(r"\bcultivo\b") & F.contains(t, other)
    single = base * rule * F.when(beside, 0.85).otherwise(1.0)
    reason = F.when(beside, "other_single_crop_near_cultivo_keyword").when(t.rlike(RULE_LIKE), "other_single_crop_rule_like").otherwise("other_single_crop")
    off, none, match = focus.isNull() | F.lit(scope == "global"), F.size(hints) == 0, F.array_contains(hints, focus)
    factor = F.when(off | none, 1.0).when(match, 1.25 if scope == "crop_boost" else 1.15).when(many, 0.80 if scope == "crop_strict" else 0.92).otherwise(single)
    return factor, F.when(off, "global_scope").when(none, "neutral_no_hints").when(match, "match_crop").when(many, "multi_crop_missing_focus").otherwise(reason)


def strictly_other(focus: Column, hints: Column) -> Column:
    return F.coalesce((F.size(hints) == 1) & (F.get(hints, 0) != focus), F.lit(False))


def focus_class(focus: Column, hints: Column) -> Column:
    """Order of fragments in answers: focus 0, no hints 1, several 2, another 3."""
    return F.when(focus.isNull() | F.array_contains(hints, focus), 0).when(F.size(hints) == 0, 1).when(F.size(hints) > 1, 2).otherwise(3)


def evidence_gate(
    hits: DataFrame, by: list[str], score: str = "rrf_score", doc: str = "doc_id", k_min: int = 1, sources_min: int = 1,
    mean_min: float = 0.005, fragment_min: float = 0.001
) -> DataFrame:
    """One row for each query: kept hits, sources, mean score, sufficient and the first rule that failed.

    Hits under fragment_min are left out unless that leaves none.
    """
    strong = F.col(score) >= fragment_min
    agg = hits.groupBy(*by).agg(
        F.count("*").alias("n_all"), F.count(F.when(strong, 1)).alias("n_strong"), F.count_distinct(F.when(strong, F.col(doc))).alias("sources_strong"), F.count_distinct(doc).alias("sources_all"),
        F.sum(F.when(strong, F.col(score))).alias("sum_strong"), F.sum(score).alias("sum_all"),
    )
    any_strong = F.col("n_strong") > 0
    kept = F.when(any_strong, F.col("n_strong")).otherwise(F.col("n_all"))
    sources = F.when(any_strong, F.col("sources_strong")).otherwise(F.col("sources_all"))
    mean = F.when(any_strong, F.col("sum_strong")).otherwise(F.col("sum_all")) / F.greatest(kept, F.lit(1))
    reason = F.when(kept < k_min, "k_min_after_filter").when(sources < sources_min, "min_sources").when(mean < mean_min, "mean_score")
    return agg.select(
        *by, kept.alias("kept"), sources.alias("sources"), F.round(mean, 6).alias("mean_score"), reason.isNull().alias("sufficient"),
        reason.alias("reason")
    )


def greedy_keep(
    hits: DataFrame, by: list[str], rank: str, doc: Column, page: Column, title: Column, text: Column, per_title: int = 2, prefix: int = 220
) -> DataFrame:
    """Hits in rank order, one for each (doc, page), at most per_title for a title, one for a text prefix.

    Titles are compared in lower case with single blanks, texts by their first characters in lower case.
    What is missing or empty restricts nothing: no title, no text, neither document nor page (page 0 is none).
    Whether a hit stays depends on those kept before it, so each query's hits are folded in order; the
    lists are the top-k that ranking left.
    """
    strings = "array<string>"
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = F.when(known(page) == "0", "").otherwise(known(page))
    place = F.when((known(doc) != "") | (leaf != ""), F.concat_ws("\x1f", known(doc), leaf)).otherwise("")
    name = F.regexp_replace(F.lower(stripped(known(title))), r"\s+", " ")
    start_of = F.lower(F.substring(stripped(known(text)), 1, prefix))
    print_ = F.when(start_of == "", "").otherwise(F.md5(start_of))
    item = F.struct(F.col(rank).alias("rank"), place.alias("place"), name.alias("title"), print_.alias("print"))
    empty = lambda kind: F.array().cast(kind)
    start = F.struct(empty(strings).alias("places"), empty(strings).alias("titles"), empty(strings).alias("prints"), empty("array<bigint>").alias("ranks"))

    def step(s, x):
        new = lambda seen, v: (v == "") | ~F.array_contains(seen, v)
        room = (x["title"] == "") | (F.size(F.filter(s["titles"], lambda t: t == x["title"])) < per_title)
        fits = new(s["places"], x["place"]) & new(s["prints"], x["print"]) & room
        grown = [
            F.array_append(s[list_], x[one].cast("bigint") if one == "rank" else x[one]).alias(list_) for list_,
            one in (("places", "place"), ("titles", "title"), ("prints", "print"), ("ranks", "rank"))
        ]
        return F.when(fits, F.struct(*grown)).otherwise(s)

    listed = hits.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kept = listed.select(*by, F.explode(F.aggregate("_items", start, step)["ranks"]).alias(rank))
    return hits.join(kept, [*by, rank])


def unified_score(score: Column, fused: Column) -> Column:
    """The fused score, or where it is missing or 0 the score of the single search; 0 without both."""
    return F.coalesce(F.nullif(fused.cast("double"), F.lit(0.0)), score.cast("double"), fused.cast("double"), F.lit(0.0))


def effective_focus(crop_of_id: Column, asked: Column, detected: Column, scope: Column) -> Column:
    """struct(focus, scope, auto): the crop with the given id, else the crop asked for, else, if neither was
    given and the scope is global, the crop that the query names, which then is boosted."""
    given = F.coalesce(F.nullif(squeeze(crop_of_id), F.lit("")), F.nullif(squeeze(asked), F.lit("")))
    auto = given.isNull() & crop_of_id.isNull() & asked.isNull() & (scope == "global") & detected.isNotNull()
    focus = F.coalesce(given, F.when(auto, squeeze(detected)))
    return F.struct(focus.alias("focus"), F.when(auto, "crop_boost").otherwise(scope).alias("scope"), auto.alias("auto"))


def focused_query(query: Column, focus: Column) -> Column:
    """The query as it is sent to the searches; focus: effective_focus."""
    apply = focus["focus"].isNotNull() & (focus["scope"] != "global")
    return F.when(apply, F.concat(F.lit("documentacion agronomica sobre "), focus["focus"], F.lit(": "), query)).otherwise(query)


# The answer without evidence.
INSUFFICIENT = ("<p><em>Insuficiente evidencia en el conjunto documental actual.</em></p>", "insuficiente_evidencia")


def insufficient_payload(kept: Column, sources: Column, mean: Column, reason: Column) -> Column:
    """The structured answer of a query whose evidence does not suffice; null for the others."""
    diagnosis = F.struct(kept.alias("kept"), sources.alias("sources"), mean.alias("mean_score"), reason.alias("reason"))
    payload = F.struct(
        F.lit(INSUFFICIENT[0]).alias("respuesta_html"), F.array().cast("array<string>").alias("citas"),
        F.array(F.lit(INSUFFICIENT[1])).alias("advertencias"), diagnosis.alias("diagnostico")
    )
    return F.when(reason.isNotNull(), payload)


def hydrated(hits: DataFrame, fragments: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with what a caller shows: text, title, pages, source, box and links.

    fragments: fragment_id, doc_id, text, page_start, page_end, bbox (JSON), source; docs: doc_id, title.
    Hits whose fragment is gone are left out; a box that is no list of four numbers is null; without a
    document and a page there are no links.
    """
    box = F.from_json("bbox", "array<double>")
    page = F.nullif(F.col("page_start"), F.lit(0))
    base = F.concat(F.lit("/api/documents/"), F.col("doc_id").cast("string"))
    name = F.col("fragment_id").cast("string")
    linked = F.col("doc_id").isNotNull() & page.isNotNull()
    own = fragments.select("fragment_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "page_start", "page_end", "bbox", "source")
    joined = hits.join(own, "fragment_id").join(docs.select("doc_id", "title"), "doc_id", "left")
    return joined.select(
        *hits.columns, "doc_id", "text", F.col("title").alias("doc_title"), "page_start", "page_end", "source",
        F.when((F.size(box) >= 4) & ~F.exists(F.slice(box, 1, 4), lambda x: x.isNull()), F.slice(box, 1, 4)).alias("bbox"),
        F.when(linked, F.concat(base, F.lit("/render?page="), page.cast("string"), F.lit("&fragment_id="), name)).alias("render_url"),
        F.when(linked, F.concat(base, F.lit("/fragments/"), name, F.lit("/locate"))).alias("locate_url"),
    )
