"""Crop rules: thresholds, phenology, two health scores, actions, query texts, status words, alerts, irrigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds used where a crop's profile gives none (0 counts as none).
FALLBACK = {"soil_min": 35.0, "soil_max": 80.0, "temp_min": 12.0, "temp_max": 33.0, "hum_min": 40.0, "hum_max": 85.0}
HEALTH_FALLBACK = {"soil_min": 35.0, "soil_max": 75.0, "temp_min": 12.0, "temp_max": 33.0, "hum_min": 40.0, "hum_max": 90.0}
EXTREME_HEAT, SOIL_CRITICAL, TEMP_SEVERE = 55.0, 10.0, 5.0
DEFAULT_CYCLE, LEAST_CYCLE = 115, 15
#: Upper bounds of progress in percent, and the stage below them.
STAGES = [(18, "establecimiento"), (45, "vegetativo"), (70, "floración"), (90, "fructificación")]
IRRIGATION = {"liters": 45.0, "per_month": 4.0, "minutes": 35.0, "delta": 12.0, "goal": 91}


def bound(profile: Column, default: float) -> Column:
    """A profile's threshold; null and 0 mean it has none."""
    return F.coalesce(F.nullif(profile.cast("double"), F.lit(0.0)), F.lit(default))


def days_between(start: Column, end: Column, floor_at_zero: bool = True) -> Column:
    """Whole days; null where a date is missing."""
    d = F.datediff(end, start)
    return F.when(d.isNotNull(), F.greatest(F.lit(0), d)) if floor_at_zero else d


def expected_progress(days: Column, cycle: Column, half_even: bool = True) -> Column:
    """Percent of the cycle, at most 100, null without a planting date; half-even in the first score, half-up in
    the second."""
    share = (F.bround if half_even else F.round)(days / cycle * 100).cast("int")
    return F.when(share.isNotNull(), F.least(F.lit(100), share))


def plan_base(planted: Column, today: Column) -> Column:
    """The day from which activities are planned: planting if it is still ahead, else today."""
    return F.when(planted > today, planted).otherwise(today)


def stage(percent: Column) -> Column:
    out = F.lit("cosecha")
    for most, name in reversed(STAGES):
        out = F.when(percent < most, name).otherwise(out)
    return F.when(percent.isNull(), "establecimiento").otherwise(out)


def stage_from_progress(progress: Column) -> Column:
    return F.when(progress >= 75, "Maduración").when(progress >= 45, "Floración").when(progress >= 20, "Desarrollo vegetativo").otherwise("Establecimiento")


def _score(rules: list[tuple[Column, int, str, str]]) -> tuple[Column, Column, Column]:
    """(score, factor codes, whether one is severe) of (condition, penalty, code, severity); no condition may be null."""
    total, severe = F.lit(100), F.lit(False)
    for hit, penalty, _, severity in rules:
        total = total - F.when(hit, penalty).otherwise(0)
        if severity == "high":
            severe = severe | F.coalesce(hit, F.lit(False))
    codes = F.array_compact(F.array(*[F.when(hit, code) for hit, _, code, _ in rules]))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)), codes, severe


def _label(score: Column, severe: Column, days: Column) -> Column:
    young = F.coalesce(days < 21, F.lit(False)) & ~severe
    return F.when(young, "Establecimiento").when((score >= 72) & ~severe, "Saludable").when(score >= 48, "Vigilancia").when(score >= 28, "Crítico").otherwise(F.when(severe, "Crítico").otherwise("Establecimiento"))


def health(soil: Column, temp: Column, hum: Column, progress: Column, days: Column, expected: Column, b: dict[str, Column]) -> tuple[Column, Column, Column]:
    """First health score, (score, factors, label): parcel readings against the crop's profile."""
    lag = F.coalesce(progress, F.lit(0)) - expected
    score, codes, severe = _score([
        (soil.isNull() & temp.isNull(), 15, "sin_telemetria", "info"),
        (soil < b["soil_min"] - 12, 38, "agua_critica", "high"),
        ((soil >= b["soil_min"] - 12) & (soil < b["soil_min"]), 18, "agua_baja", "medium"),
        ((soil >= b["soil_min"]) & (soil > b["soil_max"] + 10), 18, "agua_excesiva", "medium"),
        (temp >= b["temp_max"] + 4, 35, "calor_extremo", "high"),
        ((temp < b["temp_max"] + 4) & (temp > b["temp_max"]), 15, "calor", "medium"),
        ((temp <= b["temp_max"]) & (temp < b["temp_min"] - 2), 25, "frio", "high"),
        (hum < b["hum_min"] - 15, 12, "aire_seco", "low"),
        ((hum >= b["hum_min"] - 15) & (hum > b["hum_max"] + 5), 10, "aire_humedo", "low"),
        (lag < -35, 28, "fenologia_atrasada", "high"),
        ((lag >= -35) & (lag < -18), 14, "fenologia_rezaga", "medium"),
    ])
    return score, codes, _label(score, severe, days)


def health_by_settings(
    soil: Column, temp: Column, hum: Column, progress: Column, days: Column, expected: Column, soil_min=40.0, temp_max=35.0, hum_min=50.0
) -> tuple[Column, Column, Column]:
    """Second health score: a user's settings, no upper bounds for water, no cold rule."""
    lag = F.coalesce(progress, F.lit(0)) - expected
    score, codes, severe = _score([
        (soil.isNull() & temp.isNull(), 15, "sin_telemetria", "info"),
        (soil < soil_min - 12, 38, "agua_critica", "high"),
        ((soil >= soil_min - 12) & (soil < soil_min), 18, "agua_baja", "medium"),
        (temp >= temp_max + 4, 35, "calor_extremo", "high"),
        ((temp < temp_max + 4) & (temp > temp_max), 15, "calor", "medium"),
        (hum < hum_min - 15, 12, "aire_seco", "low"),
        ((days >= 0) & (lag < -35), 28, "fenologia_atrasada", "high"),
        ((days >= 0) & (lag >= -35) & (lag < -18), 14, "fenologia_rezaga", "medium"),
    ])
    return score, codes, _label(score, severe, days)


#: Action and priority, in the order in which they are tried.
ACTIONS = [
    ("alerta de calor extremo y medidas de emergencia", "high"), ("riego urgente", "high"), ("proteger del calor", "high"), ("vigilar enfermedades fúngicas", "high"),
    ("programar riego", "medium"), ("sombra o acolchado", "medium"), ("drenar exceso de agua", "medium"), ("riego foliar", "medium"),
]


def action(soil: Column, temp: Column, hum: Column, b: dict[str, Column]) -> Column:
    """struct(action, priority): the first rule that fits, else monitoring."""
    tests = [
        temp >= EXTREME_HEAT, soil < b["soil_min"] - SOIL_CRITICAL, temp >= b["temp_max"] + TEMP_SEVERE, hum > b["hum_max"] + 5,
        soil < b["soil_min"], temp > b["temp_max"], soil > b["soil_max"], hum < b["hum_min"],
    ]
    pick = lambda a, p: F.struct(F.lit(a).alias("action"), F.lit(p).alias("priority"))
    out = pick("monitoreo continuo", "low")
    for test, (a, p) in reversed(list(zip(tests, ACTIONS))):
        out = F.when(test, pick(a, p)).otherwise(out)
    return out


def query_text(crop: Column, soil: Column, temp: Column, hum: Column, light: Column, rain: Column, b: dict[str, Column]) -> Column:
    """A search query in words from a reading; parts without a reading are left out."""
    f = lambda c: F.bround(c).cast("bigint").cast("string")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else f(x) for x in xs])
    soil_part = F.when(
        soil < b["soil_min"],
        say("humedad del suelo baja (", soil, "%) por debajo del mínimo del cultivo (", b["soil_min"], "%) requiere riego inmediato")
    ).when(
        soil > b["soil_max"],
        say("humedad del suelo excesiva (", soil, "%) por encima del máximo (", b["soil_max"], "%) riesgo encharcamiento")
    ).when(soil.isNotNull(), say("humedad del suelo ", soil, "%"))
    temp_part = F.when(
        temp >= EXTREME_HEAT,
        say("temperatura extrema (", temp, "°C) calor crítico activar alerta de calor extremo y medidas de emergencia")
    ).when(
        temp > b["temp_max"],
        say("temperatura alta (", temp, "°C) por encima del máximo del cultivo (", b["temp_max"], "°C) estrés térmico riesgo de aborto floral")
    ).when(
        temp < b["temp_min"], say("temperatura baja (", temp, "°C) por debajo del mínimo (", b["temp_min"], "°C) riesgo helada")
    ).when(temp.isNotNull(), say("temperatura ", temp, "°C"))
    hum_part = F.when(
        hum < b["hum_min"],
        say("humedad ambiental baja (", hum, "%) por debajo del mínimo (", b["hum_min"], "%) riesgo deshidratación reducir estrés hídrico")
    ).when(
        hum > b["hum_max"],
        say("humedad ambiental alta (", hum, "%) por encima del máximo (", b["hum_max"], "%) riesgo enfermedades fúngicas")
    ).when(hum.isNotNull(), say("humedad aire ", hum, "%"))
    light_part = F.when(light < 20, "baja luminosidad").when(light > 90, "alta radiación solar")
    rain_part = F.when(rain > 0, F.concat(F.lit("precipitación reciente "), F.bround(rain, 1).cast("string"), F.lit("mm")))
    return F.concat_ws(". ", F.concat(F.lit("recomendaciones para cultivo de "), crop), soil_part, temp_part, hum_part, light_part, rain_part)


def bounded_status(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNull(), "sin datos").when(value < low, "baja").when(value > high, "alta").otherwise("adecuada")


def wind_status(v: Column) -> Column:
    return F.when(v.isNull(), "sin datos").when(v < 15, "normal").when(v < 30, "moderado").otherwise("alto")


def rain_status(v: Column) -> Column:
    return F.when(v.isNull(), "sin datos").when(v <= 0, "sin lluvia reciente").when(v < 5, "lluvia ligera").when(v < 20, "lluvia moderada").otherwise("lluvia alta")


def light_status(v: Column) -> Column:
    return F.when(v.isNull(), "sin datos").when(v < 35, "baja").when(v > 90, "alta").otherwise("adecuada")


def conductivity_status(v: Column) -> Column:
    return F.when(v.isNull(), "sin datos").when(v <= 1.5, "normal").when(v <= 3.0, "moderada").otherwise("alta")


def alerts(soil: Column, temp: Column, hum: Column, regional: Column, b: dict[str, Column]) -> Column:
    """Alert kinds in their order."""
    return F.array_compact(F.array(
        F.when(soil < b["soil_min"], "danger:soil_low").when(soil > b["soil_max"], "warning:soil_high"),
        F.when(temp > b["temp_max"], "warning:temp_high").when(temp < b["temp_min"], "warning:temp_low"),
        F.when(hum < b["hum_min"], "warning:hum_low"),
        F.when(regional >= b["temp_max"], "danger:regional_heat"),
    ))


def irrigation(events: DataFrame, key: str, as_of: Column, profiles: DataFrame | None = None) -> DataFrame:
    """Five metrics, their mean and the gap to the goal, over the newest events of each key.

    events: key, day, liters, before, after, minutes. profiles: key and any of liters, per_month, minutes,
    delta, a crop's own optima; null and 0 mean the default. Population variance; half-even rounding. What no
    event tells takes its neutral value: distribution and absorption 70, time 75. Events without liters give
    no absorption and do not count in their mean.
    """
    o, whole = IRRIGATION, lambda c: F.bround(c).cast("int")
    names = ["liters", "per_month", "minutes", "delta"]
    had = [n for n in names if profiles is not None and n in profiles.columns]
    if had:
        events = events.join(profiles.select(key, *[F.col(n).alias(f"best_{n}") for n in had]), key, "left")
    best = {n: bound(F.col(f"best_{n}"), o[n]) if n in had else F.lit(o[n]) for n in names}
    percent = lambda c: F.when(c.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)))
    gain = F.when(F.col("liters") > 0, percent((F.col("after") - F.col("before")) / best["delta"] * 100))
    agg = events.groupBy(key).agg(
        F.count("*").alias("events"), F.avg("liters").alias("l"), F.count(F.when(F.col("day") >= F.date_sub(as_of, 30), 1)).alias("recent"), F.avg(gain).alias("g"),
        F.var_pop("after").alias("v"), F.avg("minutes").alias("m"), *[F.max(best[n]).alias(f"o_{n}") for n in names],
    )
    spread = F.when(F.col("v").isNotNull(), F.greatest(F.lit(40.0), 100 - F.round("v", 6) * 2))
    parts = agg.select(
        key, "events", whole(F.coalesce(percent(F.col("l") / F.col("o_liters") * 100), F.lit(0.0))).alias("cantidad"), whole(percent(F.col("recent") / F.col("o_per_month") * 100)).alias("frecuencia"),
        whole(F.coalesce(spread, F.lit(70.0))).alias("distribucion"), whole(F.coalesce(F.round("g", 6), F.lit(70.0))).alias("absorcion"), whole(F.coalesce(percent(F.col("m") / F.col("o_minutes") * 100), F.lit(75.0))).alias("tiempo"),
    )
    mean = whole((F.col("cantidad") + F.col("frecuencia") + F.col("distribucion") + F.col("absorcion") + F.col("tiempo")) / 5)
    return parts.withColumn("eficiencia", mean).withColumn("mejora", F.greatest(F.lit(0), F.lit(o["goal"]) - F.col("eficiencia")))
