"""Relational queries: search, facets, joins, patches, imports, calendars, on the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillage.functions.text import clip, table_signature
from tillage.operators import planning as K
from tillage.operators import relational as R
from tillage.operators import timeseries as W
from tillage.plans import sqlparts as S
from tillage.plans.catalogue import REGISTRY
from tillage.session import table

add = REGISTRY.add


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")


@add(
    "library_search_like",
    "SELECT doc_id, source FROM documents WHERE contains(lower(coalesce(text, '')), 'threat') OR contains(lower(coalesce(source, '')), 'threat')"
)
def library_search_like(spark, sf_dir):
    return _docs(spark, sf_dir).where(R.all_tokens_in(["threat"], [F.col("text"), F.col("source")])).select("doc_id", "source")


@add(
    "library_search_tokens",
    """SELECT d.source, d.lang, count(*) AS n FROM documents d WHERE (contains(lower(coalesce(source, '')), 'src1') OR EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id AND contains(lower(coalesce(x.text, '')), 'src1')))
AND (contains(lower(coalesce(source, '')), 'the') OR EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id AND contains(lower(coalesce(x.text, '')), 'the'))) GROUP BY ALL""",
)
def library_search_tokens(spark, sf_dir):
    """Every token in the title or in some fragment: one semi-join for each token on ids that hold it."""
    docs = _docs(spark, sf_dir).drop("text")
    for t in ("src1", "the"):
        holds = _docs(spark, sf_dir).where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(t))).select(F.col("doc_id").alias("_d")).distinct()
        titled = F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit(t))
        docs = docs.join(holds.withColumn("_hit", F.lit(True)), F.col("doc_id") == F.col("_d"), "left").where(titled | F.col("_hit")).drop("_d", "_hit")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"))


@add(
    "library_page",
    "SELECT doc_id, source, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40"
)
def library_page(spark, sf_dir):
    match = _docs(spark, sf_dir).where(R.optional_filters(lang=(F.col("lang"), "en"), source=(F.col("source"), "todos"))).select("doc_id", "source", "n_chars")
    total = match.agg(F.count("*").alias("total"))
    return match.orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20).crossJoin(F.broadcast(total))  # one row


@add(
    "library_facets",
    """SELECT 'source' AS facet, source AS value, count(*) AS n, row_number() OVER (ORDER BY source) AS place FROM documents GROUP BY source
UNION ALL SELECT 'length', CAST(n_chars // 1000 AS VARCHAR), count(*), row_number() OVER (ORDER BY n_chars // 1000 DESC) FROM documents GROUP BY n_chars // 1000""",
)
def library_facets(spark, sf_dir):
    """What there is to choose from: sources in alphabetical order, thousands of characters (for years) falling."""
    docs = _docs(spark, sf_dir).select("source", F.floor(F.col("n_chars") / 1000).alias("length"))
    return R.facet(docs, "source").unionByName(R.facet(docs, "length", falling=True))


@add("fragments_by_page_source", "SELECT source, lang, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def fragments_by_page_source(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars")
    )


@add(
    "source_totals",
    "SELECT coalesce(source, 'unknown') AS source, count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY 1"
)
def source_totals(spark, sf_dir):
    total = _docs(spark, sf_dir).agg(F.count("*").alias("total"))
    by = _docs(spark, sf_dir).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")
    )
    return by.crossJoin(F.broadcast(total))  # one row


@add("first_fragment_per_group", "SELECT source, lang, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL")
def first_fragment_per_group(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))


@add(
    "seq_backfill",
    "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS seq FROM lineitem"
)
def seq_backfill(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("seq"))


@add(
    "user_activity_counts",
    "SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines, max(l_shipdate) AS last_ship FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey",
)
def user_activity_counts(spark, sf_dir):
    """Two left joins fan out; lines are counted for each order first, so no row is multiplied before the shuffle by customer."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.max("l_shipdate").alias("last"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(
        F.count_distinct("o_orderkey").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.max("last").alias("last_ship")
    )


@add(
    "recommendations_filtered",
    "WITH a AS (SELECT max(o_orderdate) AS as_of FROM orders) SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey, a WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent') AND o_orderdate >= as_of - INTERVAL 365 DAY",
)
def recommendations_filtered(spark, sf_dir):
    as_of = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("as_of"))
    o = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & F.contains(F.lower("o_orderpriority"), F.lit("urgent"))).crossJoin(F.broadcast(as_of)).where(R.recent(F.col("o_orderdate"), F.col("as_of"), 365))
    return o.join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey")
    ).select("o_orderkey", "c_name", "o_orderpriority")


@add(
    "recommendation_dedupe_window",
    """WITH e AS (SELECT event_id, user_id, event_type, ts, 'texto ' || CAST(floor(value / 60) AS BIGINT) AS text, CASE WHEN event_id % 4 = 0 THEN 'hecho' ELSE 'pendiente' END AS status FROM events),
p AS (SELECT *, lag(ts) OVER w AS before, lag(text) OVER w AS said FROM e WHERE status = 'pendiente' WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, user_id, event_type FROM p WHERE before IS NULL OR said <> text OR ts > before + INTERVAL 75 MINUTE""",
)
def recommendation_dedupe_window(spark, sf_dir):
    """A pending recommendation repeats the one before it (same crop, action and text) within 75 minutes: a lag, not a self join."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "ts", F.concat(F.lit("texto "), F.floor(F.col("value") / 60).cast("string")).alias("text"),
        F.when(i % 4 == 0, "hecho").otherwise("pendiente").alias("status")
    )
    return W.not_repeated(e.where("status = 'pendiente'"), ["user_id", "event_type"], "text", "ts", "event_id", 75).select("event_id", "user_id", "event_type")


@add(
    "seed_guard_anti_join",
    "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F')"
)
def seed_guard_anti_join(spark, sf_dir):
    had = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(had, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@add(
    "calendar_left_joins",
    "SELECT n_name, coalesce(r_name, 'sin region') AS region, count(s_suppkey) AS suppliers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL",
)
def calendar_left_joins(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(
        table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left"
    )
    return n.groupBy("n_name", F.coalesce("r_name", F.lit("sin region")).alias("region")).agg(F.count("s_suppkey").alias("suppliers"))


@add(
    "enum_quarantine",
    "SELECT CASE WHEN o_orderstatus IN ('O', 'F') THEN 'valid' ELSE 'quarantine' END AS side, coalesce(o_orderpriority, 'none') AS priority, count(*) AS n FROM orders GROUP BY ALL"
)
def enum_quarantine(spark, sf_dir):
    side = F.when(F.col("o_orderstatus").isin("O", "F"), "valid").otherwise("quarantine")
    return table(spark, sf_dir, "orders").groupBy(
        side.alias("side"), F.coalesce("o_orderpriority", F.lit("none")).alias("priority")
    ).agg(F.count("*").alias("n"))


@add(
    "derived_labels",
    "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || coalesce(' ' || nullif(trim(p_brand), ''), '') AS display, CASE p_partkey % 4 WHEN 0 THEN 'norte' WHEN 1 THEN 'sur' WHEN 2 THEN 'este' ELSE 'oeste' END AS zone, coalesce(nullif(regexp_extract(p_brand, '#([0-9]+)$', 1), ''), 'desconocido') AS ext FROM part",
)
def derived_labels(spark, sf_dir):
    name = F.concat(
        F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"),
        F.coalesce(F.concat(F.lit(" "), F.nullif(F.trim("p_brand"), F.lit(""))), F.lit(""))
    )
    m = F.pmod(F.col("p_partkey"), F.lit(4))
    zone = F.when(m == 0, "norte").when(m == 1, "sur").when(m == 2, "este").otherwise("oeste")
    return table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("display"), zone.alias("zone"),
        F.coalesce(F.nullif(F.regexp_extract("p_brand", "#([0-9]+)$", 1), F.lit("")), F.lit("desconocido")).alias("ext")
    )


_RULES = [
    ("*", "monitoring", 0, "Visita a {crop_display}"), ("*", "harvest", 200, "Cosecha de {crop_display}"),
    ("building", "irrigation", 30, "Riego de {crop_name}"), ("machinery", "fertilizer", 45, "Abono de {crop_name}"),
    ("household", "pest", 60, "Revision de {crop_display}")
]
_CROPS = """a AS (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders),
c AS (SELECT c_custkey AS crop_id, lower(c_mktsegment) AS crop_name, c_name AS display, max(CAST(o_orderdate AS DATE)) AS planted FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def _calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    today = o.agg(F.max("d").alias("today"))
    crops = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(
        F.col("c_custkey").alias("crop_id"), F.lower("c_mktsegment").alias("crop_name"), F.col("c_name").alias("display")
    ).agg(F.max("d").alias("planted"))
    return crops.crossJoin(F.broadcast(today))  # one row


@add(
    "calendar_rule_expand",
    f"""WITH {_CROPS}, r AS (SELECT * FROM (VALUES {S.values(_RULES)}) t(rule_crop, event_type, day_offset, title_template)),
e AS (SELECT crop_id, today, coalesce(planted, today) + day_offset AS event_date, replace(replace(title_template, '{{crop_display}}', display), '{{crop_name}}', crop_name) AS title, event_type FROM c JOIN r ON rule_crop = crop_name OR rule_crop = '*', a)
SELECT crop_id, CAST(event_date AS VARCHAR) AS event_date, title, event_type FROM e WHERE event_date >= today AND NOT (crop_id % 10 = 0 AND event_type = 'monitoring')""",
)
def calendar_rule_expand(spark, sf_dir):
    """Visits of every tenth crop count as planned already."""
    crops = _calendar(spark, sf_dir)
    rules = spark.createDataFrame(_RULES, "crop_name string, event_type string, day_offset int, title_template string")
    existing = crops.where("crop_id % 10 = 0").select(
        "crop_id", F.concat(F.lit("Visita a "), "display").alias("title"), F.coalesce("planted", "today").alias("event_date")
    )
    out = K.expand_rules(crops, rules, existing, F.col("today"))
    return out.select("crop_id", F.col("event_date").cast("string").alias("event_date"), "title", "event_type")


@add(
    "rolling_visits",
    f"WITH {_CROPS}, v AS (SELECT crop_id, 'Visita de campo — ' || display AS title, today + d AS event_date, d FROM c, a, (VALUES (0), (7), (14)) t(d)) SELECT crop_id, title, CAST(event_date AS VARCHAR) AS event_date FROM v WHERE NOT (d = 7 AND crop_id % 5 = 0)",
)
def rolling_visits(spark, sf_dir):
    crops = _calendar(spark, sf_dir)
    existing = crops.where("crop_id % 5 = 0").select(
        "crop_id", F.concat(F.lit("Visita de campo — "), "display").alias("title"), F.date_add("today", 7).alias("event_date")
    )
    return K.rolling_visits(crops, existing, F.col("today")).select("crop_id", "title", F.col("event_date").cast("string").alias("event_date"))


@add(
    "upcoming_tasks",
    """WITH a AS (SELECT CAST(max(o_orderdate) AS DATE) - 30 AS today FROM orders),
u AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN CAST(o_orderdate AS DATE) >= today THEN 1 WHEN today - CAST(o_orderdate AS DATE) <= 14 THEN 0 END AS urgency FROM orders, a)
SELECT id, CAST(start AS VARCHAR) AS start, urgency FROM u WHERE urgency IS NOT NULL ORDER BY urgency, start, id LIMIT 10""",
)
def upcoming_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("start"),
        F.when(F.col("o_orderstatus") == "F", "completado").otherwise("programado").alias("status")
    )
    today = o.agg(F.date_sub(F.max("start"), 30).alias("today"))
    tasks = o.crossJoin(F.broadcast(today)).withColumn("urgency", K.urgency(F.col("start"), F.col("status"), F.col("today")))
    return K.next_tasks(tasks).select("id", F.col("start").cast("string").alias("start"), "urgency")


@add(
    "profile_fuzzy_lookup",
    """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS wanted FROM part), p AS (SELECT lower(p_name) AS pn, max(p_size) AS cycle FROM part GROUP BY 1),
j AS (SELECT wanted, cycle, row_number() OVER (PARTITION BY wanted ORDER BY (pn = lower(wanted)) DESC, pn) AS n FROM w LEFT JOIN p ON contains(pn, lower(wanted)))
SELECT wanted, coalesce(greatest(15, cycle), 115) AS cycle FROM j WHERE n = 1""",
)
def profile_fuzzy_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.get(F.split("p_name", " "), 1).alias("wanted")).distinct()
    profiles = part.groupBy(F.lower("p_name").alias("pn")).agg(F.max("p_size").alias("cycle"))
    return R.best_name_match(wanted, profiles, "wanted", "pn", "cycle", 115, 15)


@add(
    "sparse_patch",
    "SELECT c_custkey, CASE WHEN o_custkey IS NOT NULL THEN 'patched' ELSE c_name END AS c_name, c_mktsegment, CASE WHEN o_custkey IS NOT NULL AND total > 0 THEN total ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey",
)
def sparse_patch(spark, sf_dir):
    patch = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.lit("patched").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"),
        F.round(F.sum("o_totalprice"), 2).alias("c_acctbal")
    )
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return R.patched(base, patch, "c_custkey")


@add(
    "clamp_ranges",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_id % 11 END AS low, event_id % 9 AS high FROM events)
SELECT event_id, CASE WHEN value < 5 THEN 5.0 WHEN value > 60 THEN 60.0 ELSE value END AS clamped, value < 5 OR value > 60 AS outside, low IS NULL OR low <= high AS in_order FROM e""",
)
def clamp_ranges(spark, sf_dir):
    """Missing values stay missing; bounds that are the wrong way round are told."""
    i = F.col("event_id")
    v = F.when(i % 7 != 0, F.col("value"))
    ordered = R.in_order([(F.when(i % 5 != 0, i % 11), i % 9)])
    return table(spark, sf_dir, "events").select(
        "event_id", R.clamp(v, 5.0, 60.0).alias("clamped"), ((v < 5) | (v > 60)).alias("outside"), ordered.alias("in_order")
    )


@add(
    "status_and_owner_filters",
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'activo' WHEN 1 THEN 'inactivo' WHEN 2 THEN 'pausa' END AS status, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS owner FROM customer)
SELECT c_custkey, coalesce(status, 'activo') = 'activo' AS strictly, coalesce(status, 'activo') <> 'inactivo' AS loosely FROM c WHERE owner IS NULL OR owner = 2""",
)
def status_and_owner_filters(spark, sf_dir):
    """Two readings of a missing status, and rows of everybody or of one owner."""
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "activo").when(k % 4 == 1, "inactivo").when(k % 4 == 2, "pausa")
    rows = table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"), F.when(k % 3 > 0, k % 3).alias("owner"))
    return rows.where(R.missing_or(F.col("owner"), F.lit(2))).select(
        "c_custkey", R.active(F.col("status")).alias("strictly"), R.active(F.col("status"), strict=False).alias("loosely")
    )


@add("limits_in_bounds", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def limits_in_bounds(spark, sf_dir):
    """Somebody asks for 720 rows of a list that gives fifty at most."""
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(R.limited(720, high=50)).select("c_custkey")


@add(
    "library_filters",
    """SELECT p_partkey FROM part WHERE p_size = 15 AND contains(lower(p_brand), 'brand#1') AND (NULL IS NULL OR p_type = 'todos')""",
)
def library_filters(spark, sf_dir):
    """Filters that are given: a year stands for itself, an author is looked for inside, `todos` and nothing mean all."""
    given = R.optional_filters(year=(F.col("p_size"), 15), kind=(F.col("p_type"), "todos"), status=(F.col("p_type"), None))
    return table(spark, sf_dir, "part").where(given & R.holds(F.col("p_brand"), "Brand#1")).select("p_partkey")


@add(
    "upsert_merge",
    "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_name || '*', s_acctbal + 1 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 7 = 0"
)
def upsert_merge(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changed = base.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    added = base.where("s_suppkey % 7 = 0").select((F.col("s_suppkey") + 1000000000).alias("s_suppkey"), "s_name", "s_acctbal")
    return R.upserted(base, changed.unionByName(added), "s_suppkey")


@add(
    "delete_cascade",
    "WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT 'orders' AS part, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT * FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM g)"
)
def delete_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = R.cascade_delete(
        {"orders": (o, "o_orderkey"), "lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, o.where("o_orderstatus = 'F'"),
        "o_orderkey"
    )
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


@add(
    "index_reconcile",
    "SELECT 'orphan' AS kind, vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'missing', doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'both', vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
)
def index_reconcile(spark, sf_dir):
    d, v = _docs(spark, sf_dir).select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "id")
    return tag(v.exceptAll(d), "orphan").unionByName(tag(d.exceptAll(v), "missing")).unionByName(tag(d.intersect(v), "both"))


@add(
    "import_resolution",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS by_id, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey + 1 END AS by_place, CASE WHEN o_orderkey % 3 = 2 THEN 'customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') END AS by_name FROM orders),
j AS (SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey, c.c_custkey) AS target_id FROM r LEFT JOIN customer a ON a.c_custkey = by_id LEFT JOIN customer b ON b.c_custkey + 1 = by_place LEFT JOIN customer c ON lower(c.c_name) = lower(by_name))
SELECT CASE WHEN target_id IS NULL THEN 'skipped' ELSE 'resolved' END AS outcome, count(*) AS n, CAST(coalesce(sum(target_id), 0) AS BIGINT) AS check_sum FROM j GROUP BY 1""",
)
def import_resolution(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    name = F.concat(F.lit("customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k == 0, F.col("o_custkey")).alias("by_id"), F.when(k == 1, F.col("o_custkey") + 1).alias("by_place"),
        F.when(k == 2, name).alias("by_name")
    )
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1).alias("place"), F.col("c_name").alias("name"))
    found, lost = R.resolved(rows, targets, "by_id", "by_place", "by_name")
    total = lambda df, outcome, v: df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(v), F.lit(0)).cast("long").alias("check_sum")
    ).select(F.lit(outcome).alias("outcome"), "n", "check_sum")
    return total(found, "resolved", F.col("target_id")).unionByName(total(lost, "skipped", F.lit(0))).where("n > 0")


@add(
    "json_config",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.absent'), 'default') AS other FROM events"""
)
def json_config(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"),
        F.coalesce(F.get_json_object("props", "$.absent"), F.lit("default")).alias("other")
    )


@add(
    "array_ops",
    "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS top_place FROM embeddings"
)
def array_ops(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.get(e, 0).cast("double").alias("first"), F.array_max(e).cast("double").alias("top"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.array_position(e, F.array_max(e)).cast("long").alias("top_place")
    )


@add("hash_functions", "SELECT doc_id, sha256(coalesce(text, '')) AS h256, sha1(coalesce(text, '')) AS h1, md5(coalesce(text, '')) AS h5 FROM documents")
def hash_functions(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t, 256).alias("h256"), F.sha1(t).alias("h1"), F.md5(t).alias("h5"))


@add(
    "clipped_text",
    r"WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 239)) || '…' END AS snippet FROM t"
)
def clipped_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clip(F.coalesce("text", F.lit(""))).alias("snippet"))


@add(
    "batch_registration",
    "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_id, count(*) AS files FROM documents GROUP BY sha256(coalesce(text, '')) HAVING max(CAST(lang = 'es' AS INT)) = 0"
)
def batch_registration(spark, sf_dir):
    """Files whose content is not registered yet (Spanish ones are): an anti-join on the content hash."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_id"))
    known = d.where("lang = 'es'").select("content_id").distinct()
    return d.join(known, "content_id", "left_anti").groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("files"))


@add(
    "table_signatures",
    r"""WITH c AS (SELECT l_orderkey, l_linenumber, ['a b' || lower(l_linestatus), lower(l_returnflag), '', NULL, 'x'] AS cells FROM lineitem WHERE l_linenumber <= 4),
s AS (SELECT l_orderkey, l_linenumber, sha1('1x5|' || array_to_string(list_filter(cells[1:4], lambda x: x <> ''), '|')) AS signature FROM c)
SELECT l_orderkey, signature, min(l_linenumber) AS kept, count(*) AS found FROM s GROUP BY ALL""",
)
def table_signatures(spark, sf_dir):
    """A table found in two ways is one: by the signature of its size and first cells."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    rows = F.array(F.array(F.concat(F.lit(" A  b"), F.col("l_linestatus")), F.col("l_returnflag"), F.lit(" "), F.lit(None).cast("string"), F.lit("x")))
    signed = li.select("l_orderkey", "l_linenumber", table_signature(rows).alias("signature"))
    return signed.groupBy("l_orderkey", "signature").agg(F.min("l_linenumber").alias("kept"), F.count("*").alias("found"))


@add(
    "newest_orders",
    "SELECT o_custkey, o_orderkey, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3"
)
def newest_orders(spark, sf_dir):
    out = W.newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, "place")
    return out.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))
