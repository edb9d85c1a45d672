"""Queries over readings: events stand in for sensors, users for crops, event types for metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillage.operators import agronomy as G
from tillage.operators import timeseries as W
from tillage.plans.catalogue import REGISTRY
from tillage.session import table

add = REGISTRY.add
#: Stand-ins: event type and metric.
METRICS = {"view": "soil_moisture", "signup": "air_temp", "error": "air_humidity", "purchase": "light", "click": "precipitation"}


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@add("latest_by_max_id", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_by_max_id(spark, sf_dir):
    return W.latest_by_max_id(_events(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "value")


@add(
    "latest_by_ts",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1"
)
def latest_by_ts(spark, sf_dir):
    return W.latest_by_ts(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@add(
    "latest_by_ts_id",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, event_id DESC) AS n FROM events) WHERE n = 1"
)
def latest_by_ts_id(spark, sf_dir):
    return W.latest_by_ts_id(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@add(
    "top_n_recent",
    "SELECT user_id, event_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 12"
)
def top_n_recent(spark, sf_dir):
    out = W.newest(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 12, "place")
    return out.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


_LATEST = "l AS (SELECT user_id, " + ", ".join(
    f"arg_max(value, (ts, event_id)) FILTER (event_type = '{e}') AS {m}" for e, m in METRICS.items()
) + ", max(ts) AS created_at FROM events GROUP BY user_id)"
_LAST_ROW = "x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)"


def _latest(spark, sf_dir):
    return W.latest_metrics(_events(spark, sf_dir), "user_id", "event_type", "value", "ts", METRICS)


@add("latest_metrics_wide", f"WITH {_LATEST} SELECT user_id, {', '.join(METRICS.values())} FROM l")
def latest_metrics_wide(spark, sf_dir):
    return _latest(spark, sf_dir).select("user_id", *METRICS.values())


_WHOLE = ", ".join(f"avg(value) FILTER (event_type = '{e}') AS g_{m}" for e, m in METRICS.items())
_FILLED = ", ".join(f"round({f'avg({m})' if m == 'light' else f'coalesce(avg({m}), any_value(g_{m}))'}, 6) AS {m}" for m in METRICS.values())


@add(
    "parcel_latest_avg",
    f"WITH {_LATEST}, k AS (SELECT * FROM l WHERE user_id % 50 = 7), g AS (SELECT {_WHOLE} FROM events) SELECT {_FILLED}, count(*) AS crops FROM g LEFT JOIN (SELECT * REPLACE (CASE WHEN user_id > 0 THEN NULL END AS air_temp, NULL AS light) FROM k) ON true".replace("count(*) AS crops", "count(user_id) AS crops")
)
def parcel_latest_avg(spark, sf_dir):
    """Mean over one owner's crops of their latest readings; temperature and light were never read: one is filled
    from the global mean, light never is."""
    none = F.lit(None).cast("double")
    own = _latest(spark, sf_dir).where("user_id % 50 = 7").withColumns({"air_temp": none, "light": none})
    e = _events(spark, sf_dir)
    whole = e.agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(m) for t, m in METRICS.items()])
    out = W.parcel(own, whole, list(METRICS.values()))
    return out.select(*[F.round(m, 6).alias(m) for m in METRICS.values()], "crops")


@add("parcel_daily", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY ALL")
def parcel_daily(spark, sf_dir):
    return W.daily(_events(spark, sf_dir), "ts", "value", ["event_type"]).select(
        F.col("day").cast("string").alias("day"), "event_type", F.round("avg_value", 6).alias("avg_value"), "n"
    )


_FILL = """p AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS avg_value, count(*) AS n FROM events WHERE user_id < 3 AND event_type = 'view' GROUP BY ALL),
g AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS avg_value, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL)"""


@add(
    "parcel_daily_filled",
    f"WITH {_FILL} SELECT *, 'parcel' AS source FROM p UNION ALL SELECT *, 'global' AS source FROM g WHERE day NOT IN (SELECT day FROM p)"
)
def parcel_daily_filled(spark, sf_dir):
    """A parcel of three crops; days it lacks come from all crops."""
    soil = _events(spark, sf_dir).where("event_type = 'view'")
    shape = lambda df: W.daily(df, "ts", "value").select(
        F.col("day").cast("string").alias("day"), F.round("avg_value", 6).alias("avg_value"), "n"
    )
    return W.filled(shape(soil.where("user_id < 3")), shape(soil))


@add(
    "weekly_latest",
    """WITH w AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY ts DESC, event_id DESC) AS n FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week DESC) AS m FROM r WHERE n = 1)
SELECT user_id, CAST(week AS VARCHAR) AS week, event_id, value FROM k WHERE m <= 24""",
)
def weekly_latest(spark, sf_dir):
    return W.weekly_latest(_events(spark, sf_dir), "user_id", "ts", "event_id").select(
        "user_id", F.col("week").cast("string").alias("week"), "event_id", "value"
    )


@add(
    "day_merge",
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT CAST(day AS VARCHAR) AS day, round(avg(v), 6) AS mean_of_means, count(*) AS histories, min(v) <= max(v) AS ok FROM d GROUP BY day"
)
def day_merge(spark, sf_dir):
    d = W.daily(_events(spark, sf_dir), "ts", "value", ["user_id"])
    return d.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.round(F.avg("avg_value"), 6).alias("mean_of_means"), F.count("*").alias("histories"),
        (F.min("avg_value") <= F.max("avg_value")).alias("ok")
    )


_PROGRESS = "pmod(user_id * 7, 101)"
CROPS_SQL = f"""{_LATEST}, a AS (SELECT max(CAST(ts AS DATE)) AS as_of FROM events),
c AS (SELECT user_id, soil_moisture, air_temp, air_humidity, light, precipitation, (user_id * 7) % 101 AS progress, p_name, nullif(CAST(p_size AS DOUBLE), 0) AS soil_min, nullif(p_size + 30.0, 0) AS soil_max,
      greatest(15, coalesce(60 + p_size * 2, 15)) AS cycle, CASE WHEN user_id % 11 <> 5 THEN CAST(as_of - CAST((user_id * 3) % 150 AS INT) AS DATE) END AS planted, as_of FROM l LEFT JOIN part ON p_partkey = user_id, a),
e AS (SELECT *, CASE WHEN planted IS NOT NULL THEN greatest(0, as_of - planted) END AS days, CASE WHEN planted IS NOT NULL THEN least(100, CAST(round_even(greatest(0, as_of - planted) / cycle * 100, 0) AS INT)) END AS expected,
      CASE WHEN planted IS NOT NULL THEN least(100, CAST(round((as_of - planted) / cycle * 100) AS INT)) END AS expected_up,
      coalesce(soil_min, 35) AS b1, coalesce(soil_max, 75) AS b2, coalesce(soil_max, 80) AS b2b FROM c)"""


def crops(spark, sf_dir):
    """A crop for each user: latest readings, a profile from the part with its number, planting and progress from its id;
    one in eleven has no planting date."""
    as_of = _events(spark, sf_dir).agg(F.max(F.to_date("ts")).alias("as_of"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    size = F.col("p_size").cast("double")
    base = _latest(spark, sf_dir).join(part, F.col("p_partkey") == F.col("user_id"), "left").crossJoin(F.broadcast(as_of))  # one row
    planted = F.expr("case when user_id % 11 <> 5 then date_sub(as_of, cast((user_id * 3) % 150 as int)) end")
    c = base.select(
        "user_id", *METRICS.values(), ((F.col("user_id") * 7) % 101).alias("progress"), "p_name", size.alias("soil_min"),
        (size + 30).alias("soil_max"),
        F.greatest(F.lit(G.LEAST_CYCLE), F.coalesce(60 + F.col("p_size") * 2, F.lit(G.LEAST_CYCLE))).alias("cycle"),
        planted.alias("planted"), "as_of"
    )
    days = G.days_between(F.col("planted"), F.col("as_of"))
    return c.withColumn("days", days).withColumn("expected", G.expected_progress(days, F.col("cycle"))).withColumn(
        "expected_up", G.expected_progress(days, F.col("cycle"), half_even=False)
    )


def _bounds(defaults: dict[str, float]):
    own = {"soil_min": F.col("soil_min"), "soil_max": F.col("soil_max")}
    return {k: G.bound(own[k], v) if k in own else F.lit(v) for k, v in defaults.items()}


_ROUND = "round(soil_moisture, 6)"
_RULES1 = """[CASE WHEN soil_moisture IS NULL AND air_temp IS NULL THEN 'sin_telemetria' END,
CASE WHEN soil_moisture < b1 - 12 THEN 'agua_critica' WHEN soil_moisture < b1 THEN 'agua_baja' WHEN soil_moisture > b2 + 10 THEN 'agua_excesiva' END,
CASE WHEN air_temp >= 37 THEN 'calor_extremo' WHEN air_temp > 33 THEN 'calor' WHEN air_temp < 10 THEN 'frio' END,
CASE WHEN air_humidity < 25 THEN 'aire_seco' WHEN air_humidity > 95 THEN 'aire_humedo' END,
CASE WHEN progress - expected < -35 THEN 'fenologia_atrasada' WHEN progress - expected < -18 THEN 'fenologia_rezaga' END]"""
_RULES2 = """[CASE WHEN soil_moisture IS NULL AND air_temp IS NULL THEN 'sin_telemetria' END,
CASE WHEN soil_moisture < 28 THEN 'agua_critica' WHEN soil_moisture < 40 THEN 'agua_baja' END,
CASE WHEN air_temp >= 39 THEN 'calor_extremo' WHEN air_temp > 35 THEN 'calor' END,
CASE WHEN air_humidity < 35 THEN 'aire_seco' END,
CASE WHEN progress - expected_up < -35 THEN 'fenologia_atrasada' WHEN progress - expected_up < -18 THEN 'fenologia_rezaga' END]"""
_POINTS = "CASE x WHEN 'sin_telemetria' THEN 15 WHEN 'agua_critica' THEN 38 WHEN 'agua_baja' THEN 18 WHEN 'agua_excesiva' THEN 18 WHEN 'calor_extremo' THEN 35 WHEN 'calor' THEN 15 WHEN 'frio' THEN 25 WHEN 'aire_seco' THEN 12 WHEN 'aire_humedo' THEN 10 WHEN 'fenologia_atrasada' THEN 28 ELSE 14 END"


def _health_sql(rules: str) -> str:
    return f"""WITH {CROPS_SQL}, f AS (SELECT *, list_filter({rules}, lambda x: x IS NOT NULL) AS fs FROM e),
s AS (SELECT *, greatest(0, 100 - coalesce(list_sum(list_transform(fs, lambda x: {_POINTS})), 0)) AS score, list_has_any(fs, ['agua_critica', 'calor_extremo', 'frio', 'fenologia_atrasada']) AS severe FROM f)
SELECT user_id, CAST(score AS BIGINT) AS score, array_to_string(fs, ',') AS factors, CASE WHEN coalesce(days < 21, false) AND NOT severe THEN 'Establecimiento' WHEN score >= 72 AND NOT severe THEN 'Saludable' WHEN score >= 48 THEN 'Vigilancia'
WHEN score >= 28 THEN 'Crítico' WHEN severe THEN 'Crítico' ELSE 'Establecimiento' END AS label FROM s"""


@add("health_score", _health_sql(_RULES1))
def health_score(spark, sf_dir):
    c = crops(spark, sf_dir)
    score, codes, label = G.health(
        *[F.col(x) for x in ("soil_moisture", "air_temp", "air_humidity", "progress", "days", "expected")], _bounds(G.HEALTH_FALLBACK)
    )
    return c.select("user_id", score.cast("long").alias("score"), F.array_join(codes, ",").alias("factors"), label.alias("label"))


@add("health_by_settings", _health_sql(_RULES2))
def health_by_settings(spark, sf_dir):
    c = crops(spark, sf_dir)
    score, codes, label = G.health_by_settings(*[F.col(x) for x in ("soil_moisture", "air_temp", "air_humidity", "progress", "days", "expected_up")])
    return c.select("user_id", score.cast("long").alias("score"), F.array_join(codes, ",").alias("factors"), label.alias("label"))


@add(
    "health_factors",
    f"WITH h AS ({_health_sql(_RULES1)}) SELECT factor, count(*) AS crops FROM (SELECT unnest(string_split(factors, ',')) AS factor FROM h) WHERE factor <> '' GROUP BY factor"
)
def health_factors(spark, sf_dir):
    return health_score(spark, sf_dir).select(F.explode(F.split("factors", ",")).alias("factor")).where("factor <> ''").groupBy("factor").agg(F.count("*").alias("crops"))


@add(
    "phenology_stage",
    f"WITH {CROPS_SQL} SELECT user_id, days, CAST(expected AS BIGINT) AS expected, CASE WHEN expected < 18 THEN 'establecimiento' WHEN expected < 45 THEN 'vegetativo' WHEN expected < 70 THEN 'floración' WHEN expected < 90 THEN 'fructificación' WHEN expected IS NULL THEN 'establecimiento' ELSE 'cosecha' END AS stage, CASE WHEN progress >= 75 THEN 'Maduración' WHEN progress >= 45 THEN 'Floración' WHEN progress >= 20 THEN 'Desarrollo vegetativo' ELSE 'Establecimiento' END AS reported FROM e"
)
def phenology_stage(spark, sf_dir):
    return crops(spark, sf_dir).select(
        "user_id", F.col("days").cast("long").alias("days"), F.col("expected").cast("long").alias("expected"),
        G.stage(F.col("expected")).alias("stage"), G.stage_from_progress(F.col("progress")).alias("reported")
    )


_ACTION = """CASE WHEN air_temp >= 55 THEN 'alerta de calor extremo y medidas de emergencia|high' WHEN soil_moisture < b1 - 10 THEN 'riego urgente|high' WHEN air_temp >= 38 THEN 'proteger del calor|high'
WHEN air_humidity > 90 THEN 'vigilar enfermedades fúngicas|high' WHEN soil_moisture < b1 THEN 'programar riego|medium' WHEN air_temp > 33 THEN 'sombra o acolchado|medium' WHEN soil_moisture > b2b THEN 'drenar exceso de agua|medium'
WHEN air_humidity < 40 THEN 'riego foliar|medium' ELSE 'monitoreo continuo|low' END"""


@add("action_classifier", f"WITH {CROPS_SQL} SELECT user_id, split_part({_ACTION}, '|', 1) AS action, split_part({_ACTION}, '|', 2) AS priority FROM e")
def action_classifier(spark, sf_dir):
    a = G.action(F.col("soil_moisture"), F.col("air_temp"), F.col("air_humidity"), _bounds(G.FALLBACK))
    return crops(spark, sf_dir).select("user_id", a.alias("a")).select("user_id", "a.action", "a.priority")


def _whole(c: str) -> str:
    return f"CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR)"


_SAID = f"""CASE WHEN soil_moisture < b1 THEN 'humedad del suelo baja (' || {_whole('soil_moisture')} || '%) por debajo del mínimo del cultivo (' || {_whole('b1')} || '%) requiere riego inmediato'
WHEN soil_moisture > b2b THEN 'humedad del suelo excesiva (' || {_whole('soil_moisture')} || '%) por encima del máximo (' || {_whole('b2b')} || '%) riesgo encharcamiento' WHEN soil_moisture IS NOT NULL THEN 'humedad del suelo ' || {_whole('soil_moisture')} || '%' END,
CASE WHEN air_temp >= 55 THEN 'temperatura extrema (' || {_whole('air_temp')} || '°C) calor crítico activar alerta de calor extremo y medidas de emergencia'
WHEN air_temp > 33 THEN 'temperatura alta (' || {_whole('air_temp')} || '°C) por encima del máximo del cultivo (33°C) estrés térmico riesgo de aborto floral'
WHEN air_temp < 12 THEN 'temperatura baja (' || {_whole('air_temp')} || '°C) por debajo del mínimo (12°C) riesgo helada' WHEN air_temp IS NOT NULL THEN 'temperatura ' || {_whole('air_temp')} || '°C' END,
CASE WHEN air_humidity < 40 THEN 'humedad ambiental baja (' || {_whole('air_humidity')} || '%) por debajo del mínimo (40%) riesgo deshidratación reducir estrés hídrico'
WHEN air_humidity > 85 THEN 'humedad ambiental alta (' || {_whole('air_humidity')} || '%) por encima del máximo (85%) riesgo enfermedades fúngicas' WHEN air_humidity IS NOT NULL THEN 'humedad aire ' || {_whole('air_humidity')} || '%' END,
CASE WHEN light < 20 THEN 'baja luminosidad' WHEN light > 90 THEN 'alta radiación solar' END, CASE WHEN precipitation > 0 THEN 'precipitación reciente ' || CAST(round_even(precipitation, 1) AS DECIMAL(18, 1)) || 'mm' END"""


@add(
    "sensor_query_text",
    f"WITH {CROPS_SQL} SELECT user_id, concat_ws('. ', 'recomendaciones para cultivo de ' || coalesce(p_name, 'cultivo'), {_SAID}) AS query FROM e"
)
def sensor_query_text(spark, sf_dir):
    c = crops(spark, sf_dir)
    return c.select("user_id", G.query_text(F.coalesce("p_name", F.lit("cultivo")), *[F.col(m) for m in METRICS.values()], _bounds(G.FALLBACK)).alias("query"))


@add(
    "status_words",
    f"""WITH {CROPS_SQL} SELECT user_id, CASE WHEN soil_moisture IS NULL THEN 'sin datos' WHEN soil_moisture < b1 THEN 'baja' WHEN soil_moisture > b2 THEN 'alta' ELSE 'adecuada' END AS water,
CASE WHEN air_temp IS NULL THEN 'sin datos' WHEN air_temp < 12 THEN 'baja' WHEN air_temp > 34 THEN 'alta' ELSE 'adecuada' END AS temperature,
CASE WHEN light IS NULL THEN 'sin datos' WHEN light < 35 THEN 'baja' WHEN light > 90 THEN 'alta' ELSE 'adecuada' END AS light_word,
CASE WHEN precipitation IS NULL THEN 'sin datos' WHEN precipitation <= 0 THEN 'sin lluvia reciente' WHEN precipitation < 5 THEN 'lluvia ligera' WHEN precipitation < 20 THEN 'lluvia moderada' ELSE 'lluvia alta' END AS rain,
CASE WHEN air_humidity IS NULL THEN 'sin datos' WHEN air_humidity < 15 THEN 'normal' WHEN air_humidity < 30 THEN 'moderado' ELSE 'alto' END AS wind,
CASE WHEN light IS NULL THEN 'sin datos' WHEN light <= 1.5 THEN 'normal' WHEN light <= 3.0 THEN 'moderada' ELSE 'alta' END AS conductivity FROM e""",
)
def status_words(spark, sf_dir):
    b = _bounds(G.HEALTH_FALLBACK)
    return crops(spark, sf_dir).select(
        "user_id", G.bounded_status(F.col("soil_moisture"), b["soil_min"], b["soil_max"]).alias("water"), G.bounded_status(F.col("air_temp"), F.lit(12.0), F.lit(34.0)).alias("temperature"),
        G.light_status(F.col("light")).alias("light_word"), G.rain_status(F.col("precipitation")).alias("rain"), G.wind_status(F.col("air_humidity")).alias("wind"), G.conductivity_status(F.col("light")).alias("conductivity"),
    )


@add(
    "alerts",
    f"""WITH {CROPS_SQL} SELECT user_id, array_to_string(list_filter([CASE WHEN soil_moisture < b1 THEN 'danger:soil_low' WHEN soil_moisture > b2b THEN 'warning:soil_high' END, CASE WHEN air_temp > 33 THEN 'warning:temp_high' WHEN air_temp < 12 THEN 'warning:temp_low' END,
CASE WHEN air_humidity < 40 THEN 'warning:hum_low' END, CASE WHEN light >= 33 THEN 'danger:regional_heat' END], lambda x: x IS NOT NULL), ',') AS alerts FROM e""",
)
def alerts(spark, sf_dir):
    a = G.alerts(F.col("soil_moisture"), F.col("air_temp"), F.col("air_humidity"), F.col("light"), _bounds(G.FALLBACK))
    return crops(spark, sf_dir).select("user_id", F.array_join(a, ",").alias("alerts"))


@add(
    "water_summary_by_status",
    f"""WITH {CROPS_SQL}, w AS (SELECT user_id // 5 AS owner, user_id, CASE WHEN soil_moisture IS NULL THEN 'sin datos' WHEN soil_moisture < b1 THEN 'baja' WHEN soil_moisture > b2 THEN 'alta' ELSE 'adecuada' END AS water FROM e)
SELECT owner, water, count(*) AS crops, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS ids FROM w GROUP BY owner, water""",
)
def water_summary_by_status(spark, sf_dir):
    """An owner's crops by their water: what is listed is one owner's crops."""
    b = _bounds(G.HEALTH_FALLBACK)
    w = crops(spark, sf_dir).select(
        F.floor(F.col("user_id") / 5).alias("owner"), "user_id",
        G.bounded_status(F.col("soil_moisture"), b["soil_min"], b["soil_max"]).alias("water")
    )
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("user_id")), lambda x: x.cast("string")), ",")
    return w.groupBy("owner", "water").agg(F.count("*").alias("crops"), ids.alias("ids"))


_DRY = "CASE WHEN user_id % 4 <> 1 THEN {} END"


@add(
    "irrigation_efficiency",
    f"""WITH a AS (SELECT max(CAST(ts AS DATE)) AS as_of FROM events),
i AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 13 <> 0 THEN value ELSE 0 END AS liters, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 50 AS DOUBLE) END AS before,
      {_DRY.format('CAST(event_id % 50 AS DOUBLE) + value / 10')} AS after, {_DRY.format('CAST(event_id % 60 AS DOUBLE)')} AS minutes, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
p AS (SELECT p_partkey AS user_id, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size + 20 END AS best_l, p_size + 5 AS best_d FROM part),
g AS (SELECT user_id, count(*) AS events, avg(liters) AS l, count(*) FILTER (day >= as_of - 30) AS recent, coalesce(nullif(any_value(best_l), 0), 45) AS ol, coalesce(any_value(best_d), 12) AS od,
      avg(CASE WHEN liters > 0 AND before IS NOT NULL AND after IS NOT NULL THEN CASE WHEN (after - before) / coalesce(best_d, 12) * 100 > 100 THEN 100.0 WHEN after < before THEN 0.0 ELSE (after - before) / coalesce(best_d, 12) * 100 END END) AS gn,
      var_pop(after) AS v, avg(minutes) AS m FROM i LEFT JOIN p USING (user_id), a WHERE n <= 30 GROUP BY user_id),
q AS (SELECT user_id, events, CAST(round_even(least(100.0, l / ol * 100), 0) AS INT) AS cantidad, CAST(round_even(least(100.0, recent / 4 * 100), 0) AS INT) AS frecuencia,
      CASE WHEN v IS NULL THEN 70 ELSE CAST(round_even(greatest(40.0, 100 - round(v, 6) * 2), 0) AS INT) END AS distribucion,
      CAST(round_even(coalesce(round(gn, 6), 70), 0) AS INT) AS absorcion, CASE WHEN m IS NULL THEN 75 ELSE CAST(round_even(least(100.0, m / 35 * 100), 0) AS INT) END AS tiempo FROM g),
f AS (SELECT *, CAST(round_even((cantidad + frecuencia + distribucion + absorcion + tiempo) / 5, 0) AS INT) AS eficiencia FROM q)
SELECT *, greatest(0, 91 - eficiencia) AS mejora FROM f""",
)
def irrigation_efficiency(spark, sf_dir):
    """One user in four measures nothing after watering; litres and gain have a crop's own optimum, 0 is none."""
    e = W.newest(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30)
    as_of = _events(spark, sf_dir).agg(F.max(F.to_date("ts")).alias("as_of"))
    i, wet = F.col("event_id"), F.col("user_id") % 4 != 1
    level = (i % 50).cast("double")
    shaped = e.crossJoin(F.broadcast(as_of)).select(
        "user_id", F.to_date("ts").alias("day"), F.when(i % 13 != 0, F.col("value")).otherwise(0.0).alias("liters"), F.when(i % 6 != 0, level).alias("before"),
        F.when(wet, level + F.col("value") / 10).alias("after"), F.when(wet, (i % 60).cast("double")).alias("minutes"), "as_of",
    )
    size = F.col("p_size")
    profiles = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("user_id"), F.when(size % 3 == 0, 0).otherwise(size + 20).alias("liters"), (size + 5).alias("delta")
    )
    return G.irrigation(shaped, "user_id", F.col("as_of"), profiles)


@add("hash_bucket", "SELECT event_type, (event_id * 31 + user_id) % 100 < 25 AS rollout, count(*) AS n FROM events GROUP BY ALL")
def hash_bucket(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(
        "event_type", (F.pmod(F.col("event_id") * 31 + F.col("user_id"), F.lit(100)) < 25).alias("rollout")
    ).agg(F.count("*").alias("n"))


#: Upper bounds of the latency histogram in milliseconds.
_BOUNDS = [50, 100, 200, 400, 800, 1500, 3000, 6000, 12000]


_LE = "CASE " + " ".join(f"WHEN value * 20 <= {b} THEN {b}.0" for b in _BOUNDS) + " ELSE 1e9 END::DOUBLE"


@add("histogram_buckets", f"SELECT event_type, {_LE} AS le, count(*) AS n FROM events GROUP BY ALL")
def histogram_buckets(spark, sf_dir):
    """Latencies in their buckets: an event's value counts twenty milliseconds."""
    le = W.buckets(F.col("value") * 20, _BOUNDS)
    return _events(spark, sf_dir).groupBy("event_type", F.when(le == float("inf"), 1e9).otherwise(le).alias("le")).agg(F.count("*").alias("n"))


@add(
    "proxy_metrics",
    """SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 100) AS slow,
CAST((SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) AS BIGINT) AS in_flight FROM events""",
)
def proxy_metrics(spark, sf_dir):
    """Counters over all events and a gauge, what is under way in the last hour, in one row."""
    e = _events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("last"))
    counters = e.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failed"),
        F.count(F.when(F.col("value") > 100, 1)).alias("slow")
    )
    gauge = e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 1 HOUR")).agg(F.count("*").alias("in_flight"))
    return counters.crossJoin(F.broadcast(gauge))  # one row each


@add(
    "rolling_p95",
    """WITH w AS (SELECT event_id, user_id, list(value) OVER r AS vs, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER r AS er FROM events WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, list_sort(vs)[least(len(vs) - 1, CAST(floor(len(vs) * 0.95) AS INT)) + 1] AS p95, round(er, 6) AS error_rate FROM w""",
)
def rolling_p95(spark, sf_dir):
    """The breaker's figures: 95th value and error share of the last 30 observations."""
    r = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-29, 0)
    w = _events(spark, sf_dir).select(
        "event_id", "user_id", F.sort_array(F.collect_list("value").over(r)).alias("vs"),
        F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).over(r).alias("er")
    )
    at = F.least(F.size("vs") - 1, F.floor(F.size("vs") * 0.95).cast("int"))
    return w.select("event_id", "user_id", F.get("vs", at).alias("p95"), F.round("er", 6).alias("error_rate"))


@add(
    "parcel_series_since",
    """WITH a AS (SELECT max(CAST(ts AS DATE)) AS as_of FROM events), p AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v, count(*) AS n FROM events, a WHERE user_id < 40 AND event_type = 'view' AND CAST(ts AS DATE) >= as_of - 20 GROUP BY ALL),
t AS (SELECT * FROM p ORDER BY day DESC LIMIT 15), g AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v, count(*) AS n FROM events, a WHERE event_type = 'view' AND CAST(ts AS DATE) >= as_of - 20 GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, round(v, 6) AS avg_value, n, 'parcel' AS source FROM t UNION ALL SELECT CAST(day AS VARCHAR), round(v, 6), n, 'global' FROM g WHERE day NOT IN (SELECT day FROM t)""",
)
def parcel_series_since(spark, sf_dir):
    """The newest fifteen days of the last twenty, and what all crops say on the others."""
    soil = _events(spark, sf_dir).where("event_type = 'view'")
    as_of = F.broadcast(soil.sparkSession.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.to_date("ts")).alias("as_of")))  # one row
    out = W.series(soil.where("user_id < 40").crossJoin(as_of), soil.crossJoin(as_of), "ts", "value", F.date_sub("as_of", 20), 15)
    return out.select(F.col("day").cast("string").alias("day"), F.round("avg_value", 6).alias("avg_value"), "n", "source")


@add("chat_thread_latest", "SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS role, count(*) AS n FROM conversations GROUP BY conv_id")
def chat_thread_latest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("role"), F.count("*").alias("n")
    )


@add(
    "vertical_rollup",
    "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY user_id"
)
def vertical_rollup(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct(F.to_date("ts")).alias("days")
    )
