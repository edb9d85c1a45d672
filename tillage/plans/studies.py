"""Queries of evaluation and statistics; documents by source stand in for queries, lines of orders for soil samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillage.operators import evaluation as V
from tillage.operators import statistics as Q
from tillage.plans.catalogue import REGISTRY
from tillage.session import table

add = REGISTRY.add
FACTORS = ["clay", "om", "density", "depth"]


def _gold_pred(spark, sf_dir):
    """Gold: a source's good labelled documents by id. Prediction: its ten longest documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().join(docs, "doc_id")
    gold = good.groupBy(F.col("source").alias("query")).agg(
        F.array_sort(F.collect_list("doc_id")).alias("gold_ids"), F.array(F.lit("en"), F.lit("fr")).alias("query_entities"),
        F.lit(1).alias("n")
    )
    from tillage.operators.timeseries import newest

    top = newest(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], 10, "place")
    listed = F.array_sort(F.collect_list(F.struct("place", "doc_id", "lang")))
    pred = top.groupBy(F.col("source").alias("query")).agg(listed.alias("x")).select(
        "query", F.transform("x", lambda e: e["doc_id"]).alias("pred_ids"),
        F.transform("x", lambda e: F.array(e["lang"])).alias("pred_entities"), F.lit(None).cast("double").alias("faithfulness"),
        F.lit(1).alias("n")
    )
    return gold, pred


_LISTS = """g AS (SELECT source AS query, list(doc_id ORDER BY doc_id) AS gold FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source),
t AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents),
p AS (SELECT source AS query, list(doc_id ORDER BY place) AS pred, list(lang ORDER BY place) AS langs FROM t WHERE place <= 10 GROUP BY source),
j AS (SELECT query, gold, pred, langs, list_transform(pred, lambda x: CASE WHEN list_contains(gold, x) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rel FROM g JOIN p USING (query))"""


def _dcg(rel: str, k: int) -> str:
    return f"list_sum(list_transform(range(1, least({k}, len(pred)) + 1), lambda i: ({rel})[i] / log2(i + 1)))"


_PR = ", ".join(f"round(list_sum(rel[1:{k}]) / len(rel[1:{k}]), 6) AS precision_{k}, round(len(list_filter(gold, lambda x: list_contains(pred[1:{k}], x))) / len(gold), 6) AS recall_{k}" for k in (3, 10))
_ND = ", ".join(f"round(CASE WHEN {_dcg('list_sort(rel, {q}DESC{q})'.format(q=chr(39)), k)} > 0 THEN {_dcg('rel', k)} / {_dcg('list_sort(rel, {q}DESC{q})'.format(q=chr(39)), k)} ELSE 0 END, 6) AS ndcg_{k}" for k in (3, 10))
_RR = "round(coalesce(1.0 / list_position(pred, list_filter(gold, lambda x: list_contains(pred, x))[1]), 0), 6) AS mrr"


def _metrics(spark, sf_dir):
    return V.per_query(*_gold_pred(spark, sf_dir), (3, 10))


def _rounded(df, names):
    return df.select("query", *[F.round(n, 6).alias(n) for n in names])


@add("precision_recall_at_k", f"WITH {_LISTS} SELECT query, {_PR} FROM j")
def precision_recall_at_k(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), ["precision_3", "recall_3", "precision_10", "recall_10"])


@add("mrr_first_gold", f"WITH {_LISTS} SELECT query, CAST({_RR.replace(' AS mrr', '')} AS DOUBLE) AS mrr FROM j")
def mrr_first_gold(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), ["mrr"])


@add("ndcg_at_k", f"WITH {_LISTS} SELECT query, {_ND} FROM j")
def ndcg_at_k(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), ["ndcg_3", "ndcg_10"])


@add(
    "entity_coverage_at_k",
    f"WITH {_LISTS} SELECT query, CAST(round(len(list_filter(['en', 'fr'], lambda x: list_contains(langs[1:3], x))) / 2, 6) AS DOUBLE) AS entity_coverage_3 FROM j"
)
def entity_coverage_at_k(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), ["entity_coverage_3"])


@add(
    "eval_summary",
    f"WITH {_LISTS}, m AS (SELECT {_PR}, {_RR} FROM j) SELECT 'queries_evaluated' AS metric, CAST(count(*) AS DOUBLE) AS value FROM m UNION ALL SELECT 'precision_3', round(avg(precision_3), 5) FROM m UNION ALL SELECT 'recall_10', round(avg(recall_10), 5) FROM m UNION ALL SELECT 'mrr', round(avg(mrr), 5) FROM m"
)
def eval_summary(spark, sf_dir):
    m = _rounded(_metrics(spark, sf_dir), ["precision_3", "recall_10", "mrr"])
    return V.summary(m).select("metric", F.round("value", 5).alias("value"))


_SOIL = """s AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS DOUBLE) AS clay, 60 - l_quantity AS sand, l_discount * 10 AS om, 1 + l_tax * 5 AS density, l_linenumber * 10.0 AS depth FROM lineitem),
w AS (SELECT *, ((0.299 - 0.251 * (sand / 100) + 0.195 * (clay / 100) + 0.011 * om + 0.006 * (sand / 100) * om - 0.027 * (clay / 100) * om + 0.452 * (clay / 100) * (clay / 100) + 0.299) * 100
 - (0.031 - 0.024 * (sand / 100) + 0.487 * (clay / 100) + 0.006 * om + 0.005 * (sand / 100) * om - 0.013 * (clay / 100) * om + 0.068 * (clay / 100) * (clay / 100) + 0.031) * 100) * density * depth / 10 AS awc FROM s),
m AS (SELECT """ + ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in FACTORS) + " FROM w),\nc AS (SELECT w.*, " + ", ".join(f"CASE WHEN {f} < m_{f} THEN -1 ELSE 1 END AS {f}_c" for f in FACTORS) + " FROM w, m)"


def _soil(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("clay"),
        (60 - F.col("l_quantity")).alias("sand"), (F.col("l_discount") * 10).alias("om"), (1 + F.col("l_tax") * 5).alias("density"),
        (F.col("l_linenumber") * 10.0).alias("depth")
    )
    return s.withColumn("awc", Q.available_water(*[F.col(c) for c in ("clay", "sand", "om", "density", "depth")]))


def _coded(spark, sf_dir):
    return Q.coded(_soil(spark, sf_dir), FACTORS)


@add(
    "awc_columns",
    f"WITH {_SOIL} SELECT l_returnflag, count(*) AS n, round(avg(awc), 6) AS mean_awc, round(min(awc), 6) AS low, round(max(awc), 6) AS high FROM w GROUP BY l_returnflag"
)
def awc_columns(spark, sf_dir):
    return _soil(spark, sf_dir).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg("awc"), 6).alias("mean_awc"), F.round(F.min("awc"), 6).alias("low"),
        F.round(F.max("awc"), 6).alias("high")
    )


@add(
    "quartile_levels",
    "WITH " + _SOIL + " " + " UNION ALL ".join(f"SELECT '{f}' AS factor, round(quantile_cont({f}, 0.25), 6) AS low, round(quantile_cont({f}, 0.75), 6) AS high FROM w" for f in FACTORS)
)
def quartile_levels(spark, sf_dir):
    found = Q.quantiles(_soil(spark, sf_dir), {f: [0.25, 0.75] for f in FACTORS})
    rows = [(f, found[f, 0.25], found[f, 0.75]) for f in FACTORS]
    return spark.createDataFrame(rows, "factor string, low double, high double").select("factor", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@add("median_split", f"WITH {_SOIL} SELECT clay_c, om_c, density_c, depth_c, count(*) AS n FROM c GROUP BY ALL")
def median_split(spark, sf_dir):
    return _coded(spark, sf_dir).groupBy(*[f"{f}_c" for f in FACTORS]).agg(F.count("*").alias("n"))


def _per_factor(select: str) -> str:
    return "WITH " + _SOIL + " " + " UNION ALL ".join(select.replace("{f}", f) for f in FACTORS)


@add(
    "main_effects",
    _per_factor("SELECT '{f}' AS factor, round(avg(awc) FILTER ({f}_c = 1) - avg(awc) FILTER ({f}_c = -1), 5) AS effect, round(stddev_pop(awc) FILTER ({f}_c = 1), 5) AS std_high, count(*) FILTER ({f}_c = -1) AS n_low FROM c")
)
def main_effects(spark, sf_dir):
    return Q.main_effects(_coded(spark, sf_dir), FACTORS, "awc").select(
        "factor", F.round("effect", 5).alias("effect"), F.round("std_high", 5).alias("std_high"), "n_low"
    )


_MEAN = lambda a, b, i, j: f"coalesce(avg(awc) FILTER ({a}_c = {i} AND {b}_c = {j}), 0)"


@add(
    "interactions",
    "WITH " + _SOIL + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, round((({_MEAN(a, b, 1, 1)} + {_MEAN(a, b, -1, -1)}) - ({_MEAN(a, b, 1, -1)} + {_MEAN(a, b, -1, 1)})) / 2, 5) AS effect FROM c" for i,
        a in enumerate(FACTORS) for b in FACTORS[i + 1 :]
    )
)
def interactions(spark, sf_dir):
    return Q.interactions(_coded(spark, sf_dir), FACTORS, "awc").select("first", "second", F.round("effect", 5).alias("effect"))


@add(
    "anova_f",
    _per_factor("SELECT '{f}' AS factor, round((count(*) FILTER ({f}_c = 1) * pow(avg(awc) FILTER ({f}_c = 1) - avg(awc), 2) + count(*) FILTER ({f}_c = -1) * pow(avg(awc) FILTER ({f}_c = -1) - avg(awc), 2)) / ((count(*) FILTER ({f}_c = 1) * var_pop(awc) FILTER ({f}_c = 1) + count(*) FILTER ({f}_c = -1) * var_pop(awc) FILTER ({f}_c = -1)) / (count(*) - 2)), 3) AS f FROM c")
)
def anova_f(spark, sf_dir):
    return Q.anova(_coded(spark, sf_dir), FACTORS, "awc").select("factor", F.round("f", 3).alias("f"))


@add("anova_p_values")
def anova_p_values(spark, sf_dir):
    rows = [(r["factor"], r["f"], float(Q.f_tail(r["f"], 1, r["df"]))) for r in Q.anova(_coded(spark, sf_dir), FACTORS, "awc").collect()]  # one row for each factor
    return spark.createDataFrame(
        [(f, x, p, "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "NS") for f, x, p in rows],
        "factor string, f double, p double, mark string"
    )


@add(
    "corr_rank",
    "WITH " + _SOIL + ", r AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, round(corr({f}, awc), 6) AS r FROM w" for f in FACTORS) + ") SELECT factor, r, row_number() OVER (ORDER BY abs(r) DESC, factor) AS place FROM r"
)
def corr_rank(spark, sf_dir):
    from pyspark.sql import Window

    one = _soil(spark, sf_dir).agg(*[F.round(F.corr(f, "awc"), 6).alias(f) for f in FACTORS])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("r")) for f in FACTORS])).alias("x")).select("x.*")
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.abs("r").desc(), "factor")).cast("long"))


@add("ols_fit")
def ols_fit(spark, sf_dir):
    """Coefficients, fit and optimum; the normal equations are checked by ols_residuals."""
    beta, fit = Q.least_squares(_coded(spark, sf_dir), FACTORS, "awc")
    levels, best = Q.optimum(beta, FACTORS)
    named = [(n, float(b)) for n, b in zip(["intercept", *FACTORS], beta)]
    asked = {f: [0.75 if levels[f] > 0 else 0.25] for f in FACTORS}
    advised = {f: v for (f, _), v in Q.quantiles(_soil(spark, sf_dir), asked).items()}
    more = [*[(f"level_{f}", float(levels[f])) for f in FACTORS], *[(f"advised_{f}", float(advised[f])) for f in FACTORS], ("optimum", best)]
    return spark.createDataFrame([*named, *fit.items(), *more], "term string, value double")


@add("ols_residuals", "SELECT t.term, 0.0::DOUBLE AS correlation FROM (VALUES ('intercept'), " + ", ".join(f"('{f}')" for f in FACTORS) + ") t(term)")
def ols_residuals(spark, sf_dir):
    """What the fit leaves over correlates with nothing in it: of all coefficients only those of least squares do that."""
    coded = _coded(spark, sf_dir)
    beta, _ = Q.least_squares(coded, FACTORS, "awc")
    x = [F.lit(1.0), *[F.col(f"{f}_c").cast("double") for f in FACTORS]]
    left = F.col("awc") - sum((float(b) * v for b, v in zip(beta, x)), F.lit(0.0))
    one = coded.agg(*[(F.sum(left * v) / F.sum(F.abs(left))).alias(n) for n, v in zip(["intercept", *FACTORS], x)])
    listed = F.array(*[F.struct(F.lit(n).alias("term"), (F.round(n, 6) + 0.0).alias("correlation")) for n in ["intercept", *FACTORS]])
    return one.select(F.explode(listed).alias("x")).select("x.term", F.abs("x.correlation").alias("correlation"))


@add("shapiro_wilk")
def shapiro_wilk(spark, sf_dir):
    """Whether water in the soil is normal; quantiles of the normal distribution are beyond SQL."""
    w, p = Q.shapiro_wilk(_soil(spark, sf_dir), "awc")
    return spark.createDataFrame([(float(w), float(p))], "w double, p double")


@add(
    "value_ranks",
    "WITH " + _SOIL + """, r AS (SELECT l_orderkey * 10 + l_linenumber AS number, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM w)
SELECT CAST(number AS DOUBLE) AS number, count(*) AS n, CAST(sum(r) AS BIGINT) AS ranks FROM r GROUP BY number""",
)
def value_ranks(spark, sf_dir):
    """Places in a global order, found without sorting everything in one task."""
    lines = _soil(spark, sf_dir).withColumn("number", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double"))
    placed, _ = Q.ranked(lines, "number")
    return placed.groupBy("number").agg(F.count("*").alias("n"), F.sum("_rank").cast("long").alias("ranks"))


@add(
    "durbin_watson",
    f"""WITH {_SOIL}, r AS (SELECT l_returnflag, l_orderkey, l_linenumber, awc - avg(awc) OVER (PARTITION BY l_returnflag) AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, awc) AS i FROM w),
d AS (SELECT l_returnflag, e, e - lag(e) OVER (PARTITION BY l_returnflag ORDER BY i) AS d FROM r) SELECT l_returnflag, round(sum(d * d) / sum(e * e), 6) AS dw FROM d GROUP BY l_returnflag""",
)
def durbin_watson(spark, sf_dir):
    w = _soil(spark, sf_dir)
    means = w.groupBy("l_returnflag").agg(F.avg("awc").alias("m"))
    e = w.join(F.broadcast(means), "l_returnflag").withColumn("e", F.col("awc") - F.col("m"))  # one row for each flag
    return Q.durbin_watson(e, "e", "l_returnflag", ["l_orderkey", "l_linenumber", "awc"]).select("l_returnflag", F.round("dw", 6).alias("dw"))


@add(
    "levene",
    f"WITH {_SOIL}, z AS (SELECT l_returnflag, abs(awc - avg(awc) OVER (PARTITION BY l_returnflag)) AS z FROM w), g AS (SELECT l_returnflag, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS wi, sum(n * m * m) AS sq FROM g) SELECT round((n - k) / (k - 1) * (sq - n * mean * mean) / wi, 4) AS levene FROM t"
)
def levene(spark, sf_dir):
    return Q.levene(_soil(spark, sf_dir), "l_returnflag", "awc").select(F.round("levene", 4).alias("levene"))
